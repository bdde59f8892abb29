"""Approximate nearest neighbours by an inverted multi-index (Babenko and Lempitsky, 2012), for the largest inner product.

Vectors get one more component that makes all norms equal, so that the nearest by distance are those of the largest inner
product. The two halves are quantised separately; a pair of centroids is a cell. A query visits cells by rising sum of the two distances, taken off a
heap, until it has met enough entries; how many are enough is measured on sample queries, some of them from the emptiest cells, against all rows. All
entries of the visited cells are ranked by their exact inner products. Equal vectors are one entry with its smallest ids.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from stripweave.llm.common import written
from stripweave.session import ship

NEAREST = 20
#: At most so many distinct vectors train the centroids; so many sample queries, and as many from the emptiest cells, set how far searches go.
TRAIN_ROWS, SAMPLE_QUERIES = 20_000, 128
RECALL = 0.97
CELL_ROWS, MOST_CENTROIDS = 200, 256
#: Entries of neighbouring cells that are read together, and the queries that meet them at a time.
GROUP_ROWS, ASKED_ROWS = 8192, 2048
#: Queries whose best entries a task holds before it sends them on.
HELD = 20_000


def usable_vectors(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    """``vec_id, key, v``: rows with a finite vector that is not zero, once per id and vector. A table's vectors are of one length; those of another than the commonest are
    invalid and take no part. ``v`` holds floats where the table does, else doubles; ``key`` names equal vectors."""
    ship(rows.sparkSession)
    kind = _kind(rows, vector)
    rows = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter(finite & F.exists("v", lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    width = lengths[0].n if lengths else 0
    rows = rows.filter(F.size("v") == width)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, max(width, 1)) + 0.0
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array([x.tobytes() for x in flat.astype(kind)], pa.binary())], ["vec_id", "v"])

    return rows.mapInArrow(pack, "vec_id long, v binary").select("vec_id", F.md5("v").alias("key"), "v").dropDuplicates(["vec_id", "key"])


def _kmeans(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    pick = np.random.default_rng(7)
    c = x[pick.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[pick.choice(len(x), k)])
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)


def _kind(rows: DataFrame, vector: str) -> str:
    """How a table's vectors are held: its floats stay floats, anything else becomes doubles."""
    element = getattr(rows.schema[vector].dataType, "elementType", None)
    return "<f4" if isinstance(element, T.FloatType) else "<f8"


def _vector(held: bytes, width: int) -> np.ndarray:
    return np.frombuffer(held, "<f4" if len(held) == 4 * width else "<f8").astype(np.float64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors as doubles."""
    held = column.to_pylist()
    return np.frombuffer(b"".join(held), "<f4" if held and len(held[0]) == 4 * width else "<f8").reshape(-1, width).astype(np.float64)


@dataclass
class Quantiser:
    """Centroids of the halves, the largest norm, entries per cell, and how many entries a search must meet."""

    halves: tuple[np.ndarray, np.ndarray]
    norm: float
    width: int
    counts: np.ndarray | None = None
    enough: int = 0

    @property
    def cells(self) -> int:
        return len(self.halves[0]) * len(self.halves[1])

    def _parts(self, x: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.width // 2
        return x[:, :cut], np.column_stack([x[:, cut:], last])

    def cell(self, x: np.ndarray) -> np.ndarray:
        first, second = self._parts(x, np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0)))
        return _nearest(first, self.halves[0]) * len(self.halves[1]) + _nearest(second, self.halves[1])

    def visits(self, query: np.ndarray, enough: int | None = None) -> Iterator[int]:
        """Cells by rising distance of their centroid pair, until their entries are enough, and no fewer than a result and the query itself."""
        enough = max(self.enough, NEAREST + 1) if enough is None else enough
        q = query[None] * (self.norm / np.sqrt((query * query).sum()))
        d = [((c * c).sum(1) - 2 * x @ c.T)[0] for x, c in zip(self._parts(q, np.zeros(1)), self.halves, strict=True)]
        order = [np.argsort(x, kind="stable") for x in d]
        a, b = (x[o].tolist() for x, o in zip(d, order, strict=True))
        first, second, k = order[0].tolist(), order[1].tolist(), len(b)
        heap, seen, met = [(a[0] + b[0], 0, 0)], {(0, 0)}, 0
        while heap and met < enough:
            _, i, j = heapq.heappop(heap)
            cell = first[i] * k + second[j]
            if self.counts[cell]:
                met += int(self.counts[cell])
                yield cell
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(a) and y < k and (x, y) not in seen:
                    seen.add((x, y))
                    heapq.heappush(heap, (a[x] + b[y], x, y))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores, ties to the smaller id."""
    top = np.lexsort((ids, -scores))[:k]
    return ids[top], scores[top]


def _entries(vectors: DataFrame) -> DataFrame:
    """``key, v, ids``: distinct vectors with their smallest ids, one more than a result holds."""
    place = F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))
    few = vectors.select("key", "vec_id", "v").withColumn("_at", place).filter(F.col("_at") <= NEAREST + 1)
    return few.groupBy("key").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("vec_id")).alias("ids"))


def build_index(entries: DataFrame, width: int) -> tuple[Quantiser, DataFrame]:
    """The quantiser and ``cell, key, ids, v`` of all entries. Only the training vectors, the cells' sizes and the sample queries'
    neighbours come to the driver; all of these are bounded."""
    x = np.array([_vector(bytes(r.v), width) for r in entries.orderBy("key").limit(TRAIN_ROWS).select("v").collect()])

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, n = 0.0, 0
        for batch in batches:
            m = _matrix(batch["v"], width)
            if len(m):
                most, n = max(most, float(np.sqrt((m * m).sum(1)).max())), n + len(m)
        yield pa.RecordBatch.from_arrays([pa.array([most]), pa.array([n])], ["norm", "n"])

    told = entries.select("v").mapInArrow(norms, "norm double, n long").agg(F.max("norm").alias("norm"), F.sum("n").alias("n")).first()
    k = int(np.clip(round((told.n / CELL_ROWS) ** 0.5), 2, MOST_CENTROIDS))
    k = min(k, len(x))
    q = Quantiser((np.zeros((k, width // 2)), np.zeros((k, width - width // 2 + 1))), told.norm, width)
    q.halves = tuple(_kmeans(p, k) for p in q._parts(x, np.sqrt(np.maximum(q.norm**2 - (x * x).sum(1), 0))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = q.cell(_matrix(batch["v"], width)) if len(batch) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), batch["key"], batch["ids"], batch["v"]], ["cell", "key", "ids", "v"])

    index = written(entries.select("key", "ids", "v").mapInArrow(place, "cell long, key string, ids array<long>, v binary"), "index")
    q.counts = np.zeros(q.cells, np.int64)
    for r in index.groupBy("cell").count().collect():
        q.counts[r.cell] = r["count"]
    _calibrate(q, index, x)
    return q, index


def _calibrate(q: Quantiser, index: DataFrame, x: np.ndarray) -> None:
    """Sets ``enough``: so many entries that the wanted share of sample queries have all their true neighbours among them. Queries from the
    emptiest cells are judged for themselves, as the large cells' many queries would hide them."""
    few = index.groupBy("cell").agg(F.count("*").alias("n"), F.min_by("v", "key").alias("v")).orderBy("n", "cell").limit(SAMPLE_QUERIES).collect()
    common = min(SAMPLE_QUERIES, len(x))
    sample, k = np.concatenate([x[:common], [_vector(bytes(r.v), x.shape[1]) for r in few]]), NEAREST + 1
    width = q.width

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0))] * len(sample)
        for batch in batches:
            cells = batch["cell"].to_numpy()
            scores = sample @ _matrix(batch["v"], width).T
            for i in range(len(sample) if len(cells) else 0):
                top = np.argpartition(-scores[i], min(k, len(cells)) - 1)[:k]
                best[i] = _best(np.concatenate([best[i][0], cells[top]]), np.concatenate([best[i][1], scores[i][top]]), k)
        rows = [(i, c, s) for i, (cells, scores) in enumerate(best) for c, s in zip(cells.tolist(), scores.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query", "cell", "score"])

    rows = index.select("cell", "v").mapInArrow(search, "query long, cell long, score double")
    rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))).filter(F.col("_at") <= k).collect()
    cells: dict[int, list[int]] = {}
    for r in rows:
        cells.setdefault(r["query"], []).append(r.cell)
    need = []
    for i in range(len(sample)):
        met, at = 0, {}
        for cell in q.visits(sample[i], 1 << 60):
            at[cell] = met
            met += int(q.counts[cell])
        need.append(max(at[c] + 1 for c in cells[i]))
    q.enough = max(int(np.quantile(part, RECALL, method="higher")) for part in (need[:common], need[common:]))


def search(q: Quantiser, index: DataFrame, queries: DataFrame) -> DataFrame:
    """``key, ids, scores`` for distinct query vectors ``key, v``: the nearest entries' ids, one more than a result holds."""
    width, k = q.width, NEAREST + 1
    shared = queries.sparkSession.sparkContext.broadcast(q)

    group_of = (np.cumsum(q.counts) - q.counts) // GROUP_ROWS
    grouped = queries.sparkSession.sparkContext.broadcast(group_of)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["group", "key", "cells", "v"], (pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary())
        for batch in batches:
            rows = []
            for key, v in zip(batch["key"].to_pylist(), batch["v"].to_pylist(), strict=True):
                cells = np.sort(np.fromiter(shared.value.visits(_vector(v, width)), np.int64))
                groups, first = np.unique(grouped.value[cells], return_index=True)
                rows += [(g, key, own, v) for g, own in zip(groups.tolist(), np.split(cells, first[1:]), strict=True)]
                if len(rows) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
                    rows = []
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    def blocks(rows: DataFrame, kind: str, most: int, *columns: str) -> DataFrame:
        """A group's rows in blocks of about ``most``, each one row."""
        sizes = rows.groupBy("group").agg(F.ceil(F.count("*") / most).alias("_blocks"))
        rows = rows.join(sizes, "group").withColumn("_block", F.pmod(F.xxhash64("key"), F.col("_blocks")))
        return rows.groupBy("group", "_block").agg(F.collect_list(F.struct("key", *columns, "v")).alias(kind)).select("group", kind)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = pa.array(grouped.value[batch["cell"].to_numpy()], pa.int64())
            yield pa.RecordBatch.from_arrays([group, *(batch[c] for c in ("cell", "key", "ids", "v"))], ["group", "cell", "key", "ids", "v"])

    # A query's vector goes once to each group of cells that it visits, with the cells' numbers.
    visits = written(queries.select("key", "v").mapInArrow(visit, "group long, key string, cells array<long>, v binary"), "visits")
    entries = index.select("cell", "key", "ids", "v").mapInArrow(place, "group long, cell long, key string, ids array<long>, v binary")
    # Most groups are one block of entries; a cell of many is several.
    met = blocks(entries, "entries", 2 * GROUP_ROWS, "cell", "ids").join(blocks(visits, "asked", ASKED_ROWS, "cells"), "group").select("entries", "asked")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(best), pa.string()), pa.array([b[0] for b in best.values()], pa.list_(pa.int64())), pa.array([b[1] for b in best.values()], pa.list_(pa.float64()))], ["key", "ids", "scores"]
            )
            best.clear()
            return out

        def meet(keys: list[str], asked: np.ndarray, own: np.ndarray, flat: np.ndarray, starts: np.ndarray, at: np.ndarray) -> None:
            """The askers of a cell with its entries, which are those at the places ``at`` of the block."""
            lengths = starts[at + 1] - starts[at]
            scores = asked @ own.T
            n = scores.shape[1]
            least = np.partition(scores, n - min(k, n), axis=1)[:, n - min(k, n)]
            for row, key in enumerate(keys):
                held = best.get(key)
                floor = least[row] if held is None or len(held[1]) < k else max(least[row], held[1][-1])
                top = np.flatnonzero(scores[row] >= floor)
                if not len(top):
                    continue
                ids = np.concatenate([flat[starts[t] : starts[t + 1]] for t in at[top]])
                value = np.repeat(scores[row][top], lengths[top])
                best[key] = _best(ids, value, k) if held is None else _best(np.concatenate([held[0], ids]), np.concatenate([held[1], value]), k)

        for batch in batches:
            for entries, asked in zip(batch["entries"], batch["asked"], strict=True):
                entries, asked = entries.values, asked.values
                ids = entries.field("ids")
                starts = ids.offsets.to_numpy() - ids.offsets[0].as_py()
                flat = ids.flatten().to_numpy()
                keys, theirs, ours = asked.field("key").to_pylist(), _matrix(asked.field("v"), width), _matrix(entries.field("v"), width)
                cell = entries.field("cell").to_numpy()
                order = np.argsort(cell, kind="stable")
                cells, first = np.unique(cell[order], return_index=True)
                wanted = asked.field("cells")
                asker = np.repeat(np.arange(len(keys)), np.diff(wanted.offsets.to_numpy()))
                wanted = wanted.flatten().to_numpy()
                by_cell = np.argsort(wanted, kind="stable")
                low, high = (np.searchsorted(wanted[by_cell], cells, side) for side in ("left", "right"))
                for at, i, j in zip(np.split(order, first[1:]), low.tolist(), high.tolist(), strict=True):
                    if i < j:
                        who = asker[by_cell[i:j]]
                        meet([keys[w] for w in who.tolist()], theirs[who], ours[at], flat, starts, at)
                if len(best) >= HELD:
                    yield sent()
        yield sent()

    found = met.mapInArrow(rank, "key string, ids array<long>, scores array<double>")
    pairs = F.flatten(F.collect_list(F.transform(F.arrays_zip("ids", "scores"), lambda x: F.struct((-x["scores"]).alias("s"), x["ids"].alias("id")))))
    merged = found.groupBy("key").agg(F.slice(F.array_sort(pairs), 1, k).alias("found"))
    return merged.select("key", F.transform("found", lambda x: x["id"]).alias("ids"), F.transform("found", lambda x: -x["s"]).alias("scores"))


RESULT = "query_id long, rank int, vec_id long, score double"


def nearest(rows: DataFrame, is_query: Column, *, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest others of each row for which ``is_query`` (over the column ``vec_id``) holds,
    nearest first, ties to the smaller id. Rows without a usable vector or id take no part; repeated rows count once. Without any
    usable vector the result is empty."""
    vectors = written(usable_vectors(rows, id_column, vector), "vectors")
    if vectors.isEmpty():
        return rows.sparkSession.createDataFrame([], RESULT)
    entries = written(_entries(vectors), "entries")
    q, index = build_index(entries, vectors.select(F.length("v")).first()[0] // int(_kind(rows, vector)[-1]))
    asked = vectors.filter(is_query)
    found = search(q, index, asked.groupBy("key").agg(F.first("v").alias("v")))
    out = asked.select(F.col("vec_id").alias("query_id"), "key").join(found, "key")
    others = F.slice(F.filter(F.arrays_zip("ids", "scores"), lambda x: x["ids"] != F.col("query_id")), 1, NEAREST)
    out = out.select("query_id", F.posexplode(others).alias("_at", "_hit"))
    return out.select("query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("_hit.ids").alias("vec_id"), F.col("_hit.scores").alias("score"))
