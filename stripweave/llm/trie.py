"""Prefix tries of conversations as double arrays.

Conversations travel as paths: one digest of 16 bytes and one length for every turn, never the texts. Equal paths are one row
with the number of its conversations. Paths are dealt by ranges of their order, so a shard holds neighbours, however many of
them begin alike. Each shard gives its turns dense ids and packs its trie into BASE and CHECK: the child of node s by turn c
is slot BASE[s] + c, and CHECK of that slot is s. Walks over the two arrays count the members of each node.

Only nodes on the first or the last path of a shard can go on in another one. Their counts are partial; they meet by a digest of
their prefix and are summed up over all shards. All other nodes are final as they leave their shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stripweave.llm.common import written
from stripweave.llm.sharding import CRC_TABLE, crc_sql

#: A shard takes paths until it has so many turns.
SHARD_TURNS = 50_000
LEAST_PARTS, MOST_PARTS = 32, 20_000
#: Ranges are cut by the first 64 turns of paths, so that what Spark samples for the cuts stays small.
RANGE_BYTES = 64 * 16
DIGEST = 16
#: Ids of one path that are joined in one piece.
IDS_EACH = 10_000
NO_ENDS = hashlib.sha256(b"").hexdigest()
ROOT = bytes(DIGEST)
RESULT = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string"
)


def conversation_paths(turns: DataFrame) -> DataFrame:
    """``conv_id, turns``: per conversation its turns in order (null first, then by digest), each as ``digest`` of role and text and
    ``chars`` (code points of the text). Null roles and texts are empty; rows without a conversation take no part."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct(
        F.coalesce(F.col("turn").cast("long"), F.lit(-(2**63))).alias("turn"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
        F.length(text).alias("chars"),
    )
    rows = turns.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    rows = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return rows.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"], t["chars"])).alias("turns"))


def share_beginnings(paths: DataFrame, period: int = 100, most: int = 6) -> DataFrame:
    """Each conversation c as the first h turns of conversation c - c % period and its own turns after its first h, where h is the
    checksum of its number modulo ``most``."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int")
    heads = paths.filter(F.col("conv_id") % period == 0)
    heads = heads.select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    rows = paths.select("conv_id", "turns", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % period).alias("base"))
    rows = rows.join(heads, "base", "left")
    nothing = F.slice("turns", 1, 0)
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return rows.select("conv_id", F.concat(F.slice(F.coalesce("head", nothing), F.lit(1), F.col("h")), own).alias("turns"))


def path_members(members: DataFrame) -> DataFrame:
    """``conv_id, n, ends_sha256`` for each distinct ``key`` of ``members`` (``key, conv_id``): the smallest id, how many there are,
    and the hash of all in order. Ids are sorted and joined in pieces over ranges, so only ready pieces of a frequent key meet,
    and its hash takes them one by one."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids = None, []

        def sent(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        for batch in batches:
            out = []
            for key, conv in zip(batch["key"].to_pylist(), batch["conv_id"].to_pylist(), strict=True):
                if ids and (key != now or len(ids) == IDS_EACH):
                    out.append((now, ids[0], len(ids), ",".join(map(str, ids))))
                    ids = []
                now = key
                ids.append(conv)
            yield sent(out)
        if ids:
            yield sent([(now, ids[0], len(ids), ",".join(map(str, ids)))])

    names = ["key", "conv_id", "n", "ids"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, n, digest = None, None, 0, None

        def sent(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string())
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            return pa.RecordBatch.from_arrays(columns, ["conv_id", "n", "ends_sha256"])

        for batch in batches:
            out = []
            for key, conv, count, ids in zip(*(batch[c].to_pylist() for c in names), strict=True):
                if key != now:
                    if digest:
                        out.append((first, n, digest.hexdigest()))
                    now, first, n, digest = key, conv, 0, hashlib.sha256()
                digest.update((b"," if n else b"") + ids.encode())
                n += count
            yield sent(out)
        if digest:
            yield sent([(first, n, digest.hexdigest())])

    rows = members.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    rows = rows.mapInArrow(pieces, "key binary, conv_id long, n long, ids string")
    rows = rows.repartition("key").sortWithinPartitions("key", "conv_id")
    return rows.mapInArrow(fold, "conv_id long, n long, ends_sha256 string")


FREE = -1


class DoubleArray:
    """A trie over dense ids from 1: slot 0 is the root, ``base[s] + c`` the child of s by c, ``check`` of it s."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray) -> None:
        """Packs the sorted distinct sequences ``codes[starts[i]:starts[i + 1]]``, level by level."""
        self.base, self.check = np.zeros(1024, np.int64), np.full(1024, FREE, np.int64)
        self.check[0], self._top, self._low = 0, 1, 1
        lengths = np.diff(starts)
        state = np.zeros(len(lengths), np.int64)
        for depth in range(int(lengths.max(initial=0))):
            live = np.flatnonzero(lengths > depth)
            s, c = state[live], codes[starts[live] + depth]
            new = np.append(True, (np.diff(s) != 0) | (np.diff(c) != 0))
            state[live] = self._add(s[new], c[new])[np.cumsum(new) - 1]

    def _room(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.append(self.base, np.zeros(more, np.int64))
            self.check = np.append(self.check, np.full(more, FREE, np.int64))

    def _add(self, parents: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The slots of new children; those of one parent follow each other. Families first, then only children fill the holes."""
        cuts = np.append(np.flatnonzero(np.append(True, np.diff(parents) != 0)), len(parents))
        slots, sizes = np.empty(len(parents), np.int64), np.diff(cuts)
        for k in np.flatnonzero(sizes > 1).tolist():
            own = slice(cuts[k], cuts[k + 1])
            slots[own] = self._family(int(parents[own.start]), codes[own])
        single = cuts[:-1][sizes == 1]
        if len(single):
            self._room(self._top + len(single))
            free = np.flatnonzero(self.check[self._low : self._top + len(single)] == FREE)[: len(single)] + self._low
            slots[single], self.check[free] = free, parents[single]
            self.base[parents[single]] = free - codes[single]
            self._low, self._top = int(free[-1]) + 1, max(self._top, int(free[-1]) + 1)
        return slots

    def _family(self, parent: int, codes: np.ndarray) -> np.ndarray:
        """First fit among the first free slots, else behind all."""
        least, span = int(codes.min()), int(codes.max() - codes.min())
        self._room(self._top + span + 1)
        at = np.append(np.flatnonzero(self.check[self._low : self._top] == FREE)[:64] + self._low, self._top)
        fits = (self.check[at[:, None] + (codes - least)] == FREE).all(1)
        slots = int(at[np.argmax(fits)]) + codes - least
        self.base[parent], self.check[slots] = int(slots[0] - codes[0]), parent
        self._top = max(self._top, int(slots.max()) + 1)
        return slots

    def walk(self, codes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Level by level which sequences go on and the slots they reach, by BASE and CHECK alone."""
        lengths = np.diff(starts)
        state = np.zeros(len(lengths), np.int64)
        for depth in range(int(lengths.max(initial=0))):
            live = np.flatnonzero(lengths > depth)
            slots = self.base[state[live]] + codes[starts[live] + depth]
            if (self.check[slots] != state[live]).any():
                raise KeyError("a sequence that the trie does not hold")
            state[live] = slots
            yield live, slots


@dataclass
class Shard:
    """Sorted distinct paths with their lengths of texts, members, smallest ids and hashes of ends."""

    paths: list[bytes]
    chars: list[list[int]]
    n: list[int]
    convs: list[int]
    ends: list[str]

    def rows(self, name: str) -> list[pa.Array]:
        """The shard's nodes in the columns of NODES."""
        ids: dict[bytes, int] = {}
        cut = [p[i : i + DIGEST] for p in self.paths for i in range(0, len(p), DIGEST)]
        codes = np.array([ids.setdefault(t, len(ids) + 1) for t in cut], np.int64)
        starts = np.append(0, np.cumsum([len(p) // DIGEST for p in self.paths]))
        trie, flat = DoubleArray(codes, starts), np.array([c for own in self.chars for c in own], np.int64)
        size = len(trie.check)
        n, depth, chars = (np.zeros(size, np.int64) for _ in range(3))
        conv, last = np.full(size, np.iinfo(np.int64).max), np.zeros(len(self.paths), np.int64)
        members, convs = np.array(self.n), np.array(self.convs)
        n[0], conv[0] = members.sum(), convs.min()
        levels, edges = [np.zeros(1, np.int64)], [[0], [0]]
        for d, (live, slots) in enumerate(trie.walk(codes, starts)):
            np.add.at(n, slots, members[live])
            np.minimum.at(conv, slots, convs[live])
            depth[slots], chars[slots], last[live] = d + 1, flat[starts[live] + d], slots
            levels.append(np.unique(slots))
            for i, path in zip((0, len(self.paths) - 1), edges, strict=True):
                if at := np.flatnonzero(live == i).tolist():
                    path.append(int(slots[at[0]]))
        edge = np.zeros(size, bool)
        edge[edges[0]] = edge[edges[1]] = True
        children = np.zeros(size, np.int64)
        whole = np.concatenate(levels)
        inner = whole[~edge[whole]]
        np.add.at(children, trie.check[inner], 1)
        leaves = np.where((children == 0) & ~edge, 1, 0)
        saved = np.where(edge, 0, (n - 1) * chars)
        for level in reversed(levels[1:]):
            np.add.at(leaves, trie.check[level], leaves[level])
            np.add.at(saved, trie.check[level], saved[level])
        ends = dict(zip(last.tolist(), self.ends, strict=True))
        keys = self._keys(edges)
        parent = trie.check[inner]
        outer = edge[parent].tolist()
        out = [
            pa.nulls(len(inner), pa.string()), pa.nulls(len(inner), pa.binary()),
            pa.array([keys[p] if e else None for p, e in zip(parent.tolist(), outer, strict=True)], pa.binary()),
            pa.array(conv[inner]), pa.array(depth[inner]), pa.array(conv[parent], mask=np.array(outer, bool)),
            pa.array(n[inner]), pa.array(children[inner]), pa.array(leaves[inner]), pa.array(saved[inner]),
            pa.array([ends.get(s, NO_ENDS) for s in inner.tolist()], pa.string()), pa.array(chars[inner]),
        ]
        # The nodes of the two edges, path by path; one that lies on both counts once.
        rows, told = [], set()
        for side, path in enumerate(edges[: 1 if edges[0] == edges[1] else 2]):
            for d, s in enumerate(path):
                count = [0, 0, 0, 0] if s in told else [int(x[s]) for x in (n, children, leaves, saved)]
                told.add(s)
                above = keys[path[d - 1]] if d else None
                rows.append((f"{name}-{side}", keys[s], above, int(conv[s]), d, None, *count, ends.get(s), int(chars[s])))
        return [pa.concat_arrays([a, pa.array([r[i] for r in rows], a.type)]) for i, a in enumerate(out)]

    def _keys(self, edges: list[list[int]]) -> dict[int, bytes]:
        keys = {0: ROOT}
        for own, path in ((self.paths[0], edges[0]), (self.paths[-1], edges[1])):
            key = ROOT
            for d, s in enumerate(path[1:]):
                key = keys[s] = hashlib.md5(key + own[d * DIGEST : (d + 1) * DIGEST]).digest()
        return keys


NODES = (
    "path string, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends_sha256 string, chars long"
)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number, turns, now = TaskContext.get().partitionId(), 0, 0, Shard([], [], [], [], [])
    names = [f.split()[0] for f in NODES.split(", ")]
    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in ("path", "chars", "n", "conv_id", "ends_sha256")), strict=True):
            for column, value in zip((now.paths, now.chars, now.n, now.convs, now.ends), row, strict=True):
                column.append(value)
            turns += len(row[1])
            if turns >= SHARD_TURNS:
                yield pa.RecordBatch.from_arrays(now.rows(f"{part}-{number}"), names)
                number, turns, now = number + 1, 0, Shard([], [], [], [], [])
    if now.paths:
        yield pa.RecordBatch.from_arrays(now.rows(f"{part}-{number}"), names)


def _merged(edges: DataFrame) -> DataFrame:
    """The nodes on shards' edges, each once, with the counts of all shards: ``key`` and the columns of RESULT."""
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    most = [F.max(c).alias(c) for c in ("parent_key", "depth", "ends_sha256", "chars")]
    each = edges.groupBy("key").agg(F.min("path").alias("path"), F.min("conv_id").alias("conv_id"), *sums, *most)
    kids = each.groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("_kids"))
    each = each.join(kids, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("_kids", F.lit(0)))
    each = written(each.drop("_kids"), "edges")
    # A node's own leaf and saving count once, on one of the paths through it, for all nodes above it on that path.
    own = each.select(
        "key", F.col("path").alias("at"), F.when(F.col("n_children") == 0, 1).otherwise(0).alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saving"),
    )
    rows = edges.select("path", "depth", "key").join(own, "key")
    here = F.col("path") == F.col("at")
    below = Window.partitionBy("path").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("key", *(F.sum(F.when(here, F.col(c)).otherwise(0)).over(below).alias(c) for c in ("leaf", "saving")))
    totals = rows.groupBy("key").agg(F.sum("leaf").alias("leaf"), F.sum("saving").alias("saving"))
    parents = each.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    each = each.join(totals, "key").join(parents, "parent_key", "left")
    return each.select(
        "key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("n_leaves") + F.col("leaf")).alias("n_leaves"),
        (F.col("saved_tokens") + F.col("saving")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def prefix_trie(paths: DataFrame) -> DataFrame:
    """One row per distinct prefix of the ``turns`` of ``conv_id, turns`` (see ``conversation_paths``), in the columns of RESULT.

    The root has depth 0 and no parent; conversations without turns end in it. Conversations with equal turns share all nodes.
    Without any conversation there is no node. Other columns are ignored. One conversation's digests are one row.
    """
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    members = paths.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["chars"]).alias("chars"))
    members = written(members.withColumn("key", F.unhex(F.md5("path"))), "members")
    turns = members.agg(F.sum(F.size("chars"))).first()[0]
    parts = min(max((turns or 0) // SHARD_TURNS, LEAST_PARTS), MOST_PARTS)
    distinct = members.select("conv_id", "path", "chars").join(path_members(members), "conv_id")
    distinct = written(distinct, "paths")
    start: Column = F.substring("path", 1, RANGE_BYTES)
    nodes = distinct.repartitionByRange(parts, start).sortWithinPartitions("path").mapInArrow(_shards, NODES)
    nodes = written(nodes, "nodes")
    merged = written(_merged(nodes.filter(F.col("path").isNotNull())), "merged")
    columns = [f.split()[0] for f in RESULT.split(", ")]
    inner = nodes.filter(F.col("path").isNull())
    above = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_above"))
    first = inner.filter(F.col("parent_key").isNotNull()).join(above, "parent_key").withColumn("parent_conv_id", F.col("_above"))
    rest = inner.filter(F.col("parent_key").isNull())
    return merged.select(columns).unionByName(first.select(columns)).unionByName(rest.select(columns))


#: A node's key is its turns' digests one after the other; a node's leaf and saving lie on the path of its smallest member.
ORACLE = f"""
WITH {CRC_TABLE}, t AS (
  SELECT conv_id, coalesce(turn, -9223372036854775808) AS turn, length(coalesce(text, '')) AS chars,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, digest, chars) AS pos FROM t
), c AS (
  SELECT conv_id, {crc_sql("conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t), crc_table
), rebuilt AS (
  SELECT c.conv_id, pos, digest, chars FROM c JOIN own ON own.conv_id = c.conv_id - c.conv_id % 100 AND pos <= h
  UNION ALL SELECT c.conv_id, pos, digest, chars FROM c JOIN own ON own.conv_id = c.conv_id AND pos > h
), p AS (
  SELECT conv_id, row_number() OVER w AS depth, chars, string_agg(digest, '') OVER w AS key FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
  UNION ALL SELECT conv_id, 0, 0, '' FROM c
), nodes AS (
  SELECT key, depth, left(key, 32 * (depth - 1)) AS above, min(conv_id) AS conv_id, count(*) AS n, max(chars) AS chars FROM p GROUP BY ALL
), kids AS (
  SELECT above AS key, count(*) AS kids FROM nodes WHERE depth > 0 GROUP BY 1
), ends AS (
  SELECT key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends
  FROM (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS last FROM p) x WHERE depth = last GROUP BY 1
), sums AS (
  SELECT p.key, count(*) FILTER (kids IS NULL) AS leaves, sum((n - 1) * nodes.chars)::BIGINT AS saved
  FROM nodes LEFT JOIN kids ON kids.key = nodes.key JOIN p ON p.conv_id = nodes.conv_id AND p.depth <= nodes.depth GROUP BY 1
)
SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n AS n_convs, coalesce(kids, 0) AS n_children, leaves AS n_leaves,
  saved AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM nodes v JOIN sums ON sums.key = v.key LEFT JOIN kids ON kids.key = v.key LEFT JOIN ends ON ends.key = v.key
LEFT JOIN nodes u ON v.depth > 0 AND u.key = v.above AND u.depth = v.depth - 1
"""
