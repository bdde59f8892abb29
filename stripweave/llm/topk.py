"""Exact top-k search by exhaustive term-at-a-time accumulation.

Rows are sparse: terms and integer weights. Candidates are dealt by a hash into blocks of bounded size, and each block is one
inverted index: for every term the places of its rows and their weights. A query takes its terms one at a time and scatters
weight times weight into a dense array with a score for every row of the block; the k best of a block are selected by
partitioning that array, and the blocks' best are merged. Nothing is skipped, so the result is exact, ties included.

Queries travel in blocks too. Each block of candidates meets each block of queries once, by a join on both blocks' numbers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stripweave.llm.common import written

CANDIDATES_EACH, QUERIES_EACH = 4096, 4096
#: Small tables are cut into so many blocks too, so that all cores have work.
LEAST_BLOCKS, MOST_TASKS = 64, 20_000
SPARSE = "vec_id long, terms array<int>, weights array<long>"
RESULT = "query_id long, rank int, vec_id long, score long"


def sparse_rows(rows: DataFrame, scale: float, *, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, terms, weights`` of each vector: the places where ``floor(scale * x)`` is not 0, and those numbers. Rows whose id
    or vector is null, and vectors that hold null or non-finite components, take no part."""
    rows = rows.select(
        F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v")
    )
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite)
    places = F.filter(
        F.transform("v", lambda x, i: F.struct(i.cast("int").alias("t"), F.floor(x * scale).cast("long").alias("w"))),
        lambda p: p["w"] != 0,
    )
    rows = rows.select("vec_id", places.alias("p"))
    return rows.select(
        "vec_id", F.transform("p", lambda p: p["t"]).alias("terms"), F.transform("p", lambda p: p["w"]).alias("weights")
    )


@dataclass
class Rows:
    """Sparse rows one after the other: ``terms[starts[i]:starts[i + 1]]`` are those of row i."""

    ids: np.ndarray
    starts: np.ndarray
    terms: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, found: pa.StructArray) -> Rows:
        terms, weights = found.field("terms"), found.field("weights")
        starts = terms.offsets.to_numpy().astype(np.int64)
        flat = (terms.flatten().to_numpy(), weights.flatten().to_numpy())
        return cls(found.field("vec_id").to_numpy(), starts - starts[0], *flat)


@dataclass
class Postings:
    """The inverted index of a block: ``docs[starts[t]:starts[t + 1]]`` are the rows that hold ``terms[t]``, with ``weights``."""

    ids: np.ndarray
    terms: np.ndarray
    starts: np.ndarray
    docs: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, rows: Rows) -> Postings:
        docs = np.repeat(np.arange(len(rows.ids)), np.diff(rows.starts))
        order = np.lexsort((docs, rows.terms))
        terms, docs, weights = rows.terms[order], docs[order], rows.weights[order]
        if len(terms):  # a term that a row holds twice weighs the sum
            first = np.flatnonzero(np.append(True, (np.diff(terms) != 0) | (np.diff(docs) != 0)))
            terms, docs, weights = terms[first], docs[first], np.add.reduceat(weights, first)
        known, starts = np.unique(terms, return_index=True)
        return cls(rows.ids, known, np.append(starts, len(terms)), docs, weights)

    def scores(self, terms: np.ndarray, weights: np.ndarray, into: np.ndarray) -> np.ndarray:
        """The scores of all rows for one query, accumulated term by term in ``into``."""
        into[:] = 0
        at = np.searchsorted(self.terms, terms)
        for t, term, weight in zip(at.tolist(), terms.tolist(), weights.tolist(), strict=True):
            if t == len(self.terms) or self.terms[t] != term:
                continue
            own = slice(self.starts[t], self.starts[t + 1])
            if own.stop - own.start == len(into):  # all rows hold it, in order
                into += self.weights[own] * weight
            else:
                into[self.docs[own]] += self.weights[own] * weight
        return into


def _largest(weights: np.ndarray) -> int:
    return max(abs(int(weights.max())), abs(int(weights.min()))) if len(weights) else 0


def search_block(postings: Postings, queries: Rows, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its place, and the ids and scores of its k best rows, ties to the smaller id; rows of its own id are left out.
    A score that a long cannot hold is an error."""
    lengths = np.diff(queries.starts)
    bound = _largest(postings.weights) * _largest(queries.weights) * int(lengths.max(initial=0))
    if bound >= 1 << 63:
        raise OverflowError("top-k search: a score may not fit a long")
    kind = np.int32 if bound < 1 << 31 else np.int64
    postings.weights = postings.weights.astype(kind)
    into, n = np.empty(len(postings.ids), kind), len(postings.ids)
    for i, own_id in enumerate(queries.ids.tolist()):
        own = slice(queries.starts[i], queries.starts[i + 1])
        scores = postings.scores(queries.terms[own], queries.weights[own], into)
        # One more than wanted for each row of the query's own id, which its vectors of that id may hold.
        want = min(n, k + int(np.count_nonzero(postings.ids == own_id)))
        found = np.flatnonzero(scores >= np.partition(scores, n - want)[n - want])
        found = found[postings.ids[found] != own_id]
        found = found[np.lexsort((postings.ids[found], -scores[found].astype(np.int64)))[:k]]
        yield i, postings.ids[found], scores[found].astype(np.int64)


def _blocks(rows: DataFrame, name: str, count: int) -> DataFrame:
    """``name`` from 0 to ``count`` - 1, and ``{name}_rows``: its rows, dealt by a hash."""
    rows = rows.withColumn(name, F.pmod(F.xxhash64("vec_id", "terms", "weights"), F.lit(count)).cast("int"))
    return rows.groupBy(name).agg(F.collect_list(F.struct("vec_id", "terms", "weights")).alias(f"{name}_rows"))


def _times(blocks: DataFrame, name: str, count: int) -> DataFrame:
    return blocks.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(count - 1))))


def top_k(rows: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of the highest inner product with each row for which ``is_query`` (over
    ``vec_id``) holds, all if there are fewer, ties to the smaller id.

    ``rows`` are ``vec_id, terms, weights``; rows without terms score 0. Repeated rows count once; a row does not find rows of
    its own id, and an id with several vectors asks with each. Without rows or queries the result is empty.
    """
    spark = rows.sparkSession
    rows = written(rows.select("vec_id", "terms", "weights").filter(F.col("vec_id").isNotNull()).distinct(), "sparse")
    n, asked = rows.agg(F.count("*"), F.count_if(is_query)).first()
    if not asked:
        return spark.createDataFrame([], RESULT)
    blocks, groups = max(LEAST_BLOCKS, math.ceil(n / CANDIDATES_EACH)), math.ceil(asked / QUERIES_EACH)
    tasks = min(blocks * groups, MOST_TASKS)
    left = _times(_blocks(rows, "block", blocks), "asked", groups).repartition(tasks, "block", "asked")
    right = _times(_blocks(rows.filter(is_query), "asked", groups), "block", blocks).repartition(tasks, "block", "asked")
    met = left.join(right, ["block", "asked"]).select("block_rows", "asked_rows")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, theirs in zip(batch["block_rows"], batch["asked_rows"], strict=True):
                postings, queries = Postings.of(Rows.of(own.values)), Rows.of(theirs.values)
                found = list(search_block(postings, queries, k))
                counts = [len(ids) for _, ids, _ in found]
                at = np.repeat([i for i, _, _ in found], counts).astype(np.int64)
                marks = [hash_row(queries, i) for i in range(len(queries.ids))]
                columns = [
                    pa.array(queries.ids[at], pa.int64()),
                    pa.array([marks[i] for i in at.tolist()], pa.binary()),
                    pa.array(np.concatenate([ids for _, ids, _ in found]), pa.int64()),
                    pa.array(np.concatenate([scores for _, _, scores in found]), pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "mark", "vec_id", "score"])

    found = met.mapInArrow(search, "query_id long, mark binary, vec_id long, score long").distinct()
    place = F.row_number().over(Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def hash_row(rows: Rows, i: int) -> bytes:
    """Tells the vectors of one id apart."""
    own = slice(rows.starts[i], rows.starts[i + 1])
    return hashlib.md5(rows.terms[own].tobytes() + b"|" + rows.weights[own].tobytes()).digest()


ORACLE = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.w, c.w)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
