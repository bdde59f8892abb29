"""Near-duplicate documents by HyperMinHash.

A document's set of word shingles is hashed once; a shingle's hash names a register and a value, of which the register keeps the
smallest, as its count of leading zeros and the ten bits after the first one (Yu and Weber, 2017). Small sets would leave most of
200 registers empty, and bands of empty registers say little; so a set fills as many registers as it has shingles for (four or more each) and is
dealt out anew, by other hashes, until there are 200. Sets that can be linked are of nearly one size, so they share a dealing. Bands of
registers are the keys under which documents meet. Where they meet, pairs are estimated from their registers, corrected for chance
collisions, and what is near enough is confirmed on the full sets. Documents with equal sets are one class, of which only the
smallest id is compared.

With 40 bands of 5 registers, a pair at similarity 0.8 misses all bands with a chance of about 1.3e-7. The estimate drops a pair that met below six
standard deviations under the threshold: at similarity 0.8 and 200 registers, fewer than 127 equal ones, a chance of 2e-8. Both are less for nearer pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stripweave.llm.common import append_columns, fresh, quoted, written
from stripweave.llm.graph import components
from stripweave.session import ship

BANDS, ROWS, MANTISSA = 40, 5, 10
REGISTERS = BANDS * ROWS
EMPTY = 0xFFFF
#: The chance that two registers with different smallest values agree, from the sketch's paper.
COLLISION = 0.169919 / 2**MANTISSA
TOP = 8
SALTS = np.random.default_rng(20170814).integers(1, 1 << 63, REGISTERS, dtype=np.uint64)
MEMO = 100_000
#: Standard deviations of the estimate below the threshold at which a pair is no longer confirmed. What this drops is lost, so it must be rarer than
#: to miss all bands: at 5 it is ten times as frequent.
MARGIN = 6.0
#: What a task compares at a time: sketches and sets of so many bytes.
CHUNK_BYTES = 8 << 20
#: Keys whose facts are broadcast: at most so many, each with more rows than this.
HOT_KEYS, LEAST_HOT = 20_000, 64
#: The bits of a band's key that name its level.
LEVEL_BITS = 15

_memo: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them (splitmix64's finish)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: str) -> list[bytes]:
    """A-Z lower-cased, cut at space, tab, line feed, vertical tab, form feed and carriage return."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str, size: int) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct shingles; a shorter text's words are one shingle, no words none."""
    own = words(text)
    if not own:
        return np.empty(0, np.uint64)
    if len(_memo) > MEMO:
        _memo.clear()
    for w in set(own).difference(_memo):
        _memo[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(_memo.__getitem__, own), np.uint64, len(own))
    n = min(size, len(own))
    out = np.full(len(own) - n + 1, n, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)]
    return np.unique(_mix(out))


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def level(n: int) -> int:
    """How a set of n shingles is dealt: into 2**level registers at a time, four shingles or more to each; 200 at most."""
    return min(max(0, (n // 4).bit_length() - 1), TOP)


def levels(n: int, percent: int) -> list[int]:
    """A set's own level, and that of the largest set it can be linked with: linked sets share one of theirs."""
    return sorted({level(n), level(n * 100 // percent)}) if n else []


def registers(shingles: np.ndarray, at: int) -> np.ndarray:
    """The sketch of a shingle set at a level: leading zeros and mantissa of each register's smallest value."""
    size = min(1 << at, REGISTERS)
    deals = -(-REGISTERS // size)
    y = _mix(shingles[None, :] ^ SALTS[:deals, None])
    place = ((y >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)) + (np.arange(deals, dtype=np.uint64) * np.uint64(size))[:, None]
    both = np.sort((place << np.uint64(53) | _mix(y ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(11)).ravel())
    place, least = (both >> np.uint64(53)).astype(np.int64), both & np.uint64((1 << 53) - 1)
    first = np.concatenate([[True], place[1:] != place[:-1]]) & (place < REGISTERS)
    place, least = place[first], least[first]
    bits = np.frexp(least.astype(np.float64))[1]
    mantissa = np.where(bits > 11, least >> np.maximum(bits - 11, 0).astype(np.uint64), least << np.maximum(11 - bits, 0).astype(np.uint64)) & np.uint64(1023)
    out = np.full(REGISTERS, EMPTY, np.uint16)
    out[place] = (53 - bits).astype(np.uint16) << 10 | mantissa.astype(np.uint16)
    return out


def band_keys(sketches: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The keys of each sketch's bands, with the level in the last bits."""
    grid = sketches.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = _mix(np.arange(1, BANDS + 1, dtype=np.uint64) + np.asarray(at, np.uint64)[:, None] * np.uint64(64))
    for k in range(ROWS):
        key = _mix(key ^ (grid[:, :, k] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return (key & ~np.uint64(LEVEL_BITS) | np.asarray(at, np.uint64)[:, None]).astype(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard of sketch pairs (rows of a and b), and the registers that either of them fills."""
    filled = ((a != EMPTY) | (b != EMPTY)).sum(1)
    same = ((a == b) & (a != EMPTY)).sum(1) / np.maximum(filled, 1)
    return (same - COLLISION) / (1 - COLLISION), filled


@dataclass(frozen=True)
class Rule:
    """Two sets are linked if PERCENT of their union is common to them."""

    shingle: int = 5
    percent: int = 80


def sketch_documents(docs: DataFrame, rule: Rule, *, text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, set_hash, dealt`` of whole texts (null counts as empty); ``dealt`` has ``level, sketch, bands`` of each level."""

    def run(texts: list[str]) -> list[pa.Array]:
        sets = [shingle_set(t, rule.shingle) for t in texts]
        at = [levels(len(s), rule.percent) for s in sets]
        flat = [(s, v) for s, own in zip(sets, at, strict=True) for v in own]
        sketches = np.array([registers(s, v) for s, v in flat], np.uint16).reshape(-1, REGISTERS)
        keys = band_keys(sketches, np.array([v for _, v in flat], np.int64))
        rows = pa.StructArray.from_arrays([
            pa.array([v for _, v in flat], pa.int32()), pa.array([x.tobytes() for x in sketches], pa.binary()),
            pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel())),
        ], ["level", "sketch", "bands"])
        ends = pa.array(np.concatenate([[0], np.cumsum([len(v) for v in at])]).astype(np.int32))
        return [pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(ends, rows)]

    dealt = T.ArrayType(T.StructType([T.StructField("level", T.IntegerType()), T.StructField("sketch", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]))
    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("set_hash", T.BinaryType()), T.StructField("dealt", dealt)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return append_columns(rows, "text", run, fields).drop("text")


def _cut(rule: Rule, filled: np.ndarray) -> np.ndarray:
    """The estimate from which on a pair may be linked."""
    share = rule.percent / 100
    return share - MARGIN * np.sqrt(share * (1 - share) / np.maximum(filled, 1))


def forest(ids: np.ndarray, component: np.ndarray, sketches: np.ndarray, sets: list[np.ndarray], rule: Rule) -> list[tuple[int, int]]:
    """Links that join the members' components as all links among them would: fewer than members. Pairs already joined are not looked at, the others are
    estimated, and confirmed on the full sets if near enough. Members are taken in their order, those of the largest component last."""
    names, n = np.unique(component, return_counts=True)
    order = np.argsort(component == names[np.argmax(n)], kind="stable")
    ids, component, sketches, sets = ids[order], component[order].copy(), sketches[order], [sets[k] for k in order]
    sizes = np.array([len(x) for x in sets])
    codes = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(sizes)[:-1])
    own, out = np.zeros(int(sizes.sum()), bool), []
    for k in range(len(ids) - 1):
        later = slice(k + 1, None)
        near = np.flatnonzero((component[later] != component[k]) & (100 * np.minimum(sizes[k], sizes[later]) >= rule.percent * np.maximum(sizes[k], sizes[later]))) + k + 1
        if len(near):
            found, filled = estimate(sketches[k][None], sketches[near])
            near = near[found >= _cut(rule, filled)]
        if not len(near):
            continue
        own[codes[k]] = True
        common = np.add.reduceat(own[np.concatenate([codes[j] for j in near])], np.cumsum(sizes[near]) - sizes[near], dtype=np.int64)
        own[codes[k]] = False
        for j in near[100 * common >= rule.percent * (sizes[k] + sizes[near] - common)].tolist():
            if component[j] != component[k]:
                out.append((int(ids[k]), int(ids[j])))
                component[component == component[j]] = component[k]
    return out


def _joining(rows: DataFrame, rule: Rule) -> DataFrame:
    """The links ``a, b`` that join components among the members (``id, component, sketch, shingles``) of each group ``head, level, i, j``. A task holds one group
    at a time, beside the batch that it reads."""
    group = ["head", "level", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def links() -> list[tuple[int, int]]:
            rows = [x for part in held for x in zip(*(part[c].to_pylist() for c in ("id", "component", "sketch", "shingles")), strict=True)]
            held.clear()
            if len(rows) < 2:
                return []
            ids, component, sketches, sets = zip(*rows, strict=True)
            return forest(np.array(ids), np.array(component), np.frombuffer(b"".join(sketches), np.uint16).reshape(-1, REGISTERS), [np.frombuffer(x, np.uint64) for x in sets], rule)

        def sent(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            keys = np.column_stack([batch[c].to_numpy() for c in group])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            pairs = []
            for first, end in zip(cuts, cuts[1:]):
                key = tuple(keys[first].tolist())
                if key != now:
                    pairs += links()
                    now = key
                held.append(batch.slice(first, end - first))
            yield sent(pairs)
        yield sent(links())

    rows = rows.select(*group, "id", "component", "sketch", "shingles").repartition(*group).sortWithinPartitions(*group, "id")
    return rows.mapInArrow(run, "a long, b long")


def _payload(nodes: DataFrame, ids: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """``id, level, sketch, shingles`` of the nodes named by ``ids``. Only their texts are read into sets again. The ids, which grow with the input, are merged
    with the texts at every size, not broadcast while they are few."""

    def sets(texts: list[str]) -> list[pa.Array]:
        found = [shingle_set(t, rule.shingle) for t in texts]
        return [pa.array([_digest(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())]

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids.hint("merge"), "id", "left_semi")
    own = append_columns(rows, "text", sets, [T.StructField("set_hash", T.BinaryType()), T.StructField("shingles", T.BinaryType())])
    own = own.select("id", "set_hash", "shingles").dropDuplicates(["id", "set_hash"])
    return written(nodes.select("id", "set_hash", "level", "sketch").join(own, ["id", "set_hash"]), "payload")


def _looked_up(rows: DataFrame, facts: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with the columns of ``facts``, of which some keys may have very many rows. Those keys' facts, at most ``HOT_KEYS``, are broadcast, so that their rows stay
    where they are; the other keys' rows meet in a shuffle. ``facts`` has ``members``, the number of rows of each key."""
    total = facts.agg(F.sum("members")).first()[0] or 0
    hot = F.col("members") > max(total // HOT_KEYS, LEAST_HOT)
    many = F.broadcast(facts.filter(hot))
    return rows.join(many, on).unionByName(rows.join(many.select(*on), on, "left_anti").join(facts.filter(~hot), on))


def _chunks(size: str) -> Column:
    return F.greatest(F.ceil(F.col(size) / CHUNK_BYTES), F.lit(1)).cast("int")


def _dealt(chunks: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(seed)), chunks).cast("int")


def _all_of(chunks: Column) -> Column:
    return F.sequence(F.lit(0), chunks - 1)


def links(nodes: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """Links ``a, b`` between classes that give the right components.

    Buckets with the same smallest id, their head, are one group: documents that meet in a bucket meet in its head's group, and near copies, which share
    many buckets, are in few groups. Members of a group are compared in one task, up to ``CHUNK_BYTES``; a larger group is dealt into chunks, each with the head
    in it. What is then still apart from its head's component in such a group is dealt into chunks of its own, which meet all chunks of the group. Tasks send
    on only the links that join components, so that what is sent grows with the members, not with the pairs.
    """
    met = nodes.select("id", F.explode("bands").alias("key"))
    heads = written(met.groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("members")).filter(F.col("members") > 1), "heads")
    level = F.col("key").bitwiseAND(LEVEL_BITS).cast("int").alias("level")
    others = _looked_up(met, heads, ["key"]).select("head", level, "id").filter(F.col("id") != F.col("head")).distinct()
    others = written(others, "others")
    groups = others.groupBy("head", "level").agg(F.count("*").alias("members"))
    pairs = others.unionByName(groups.select("head", "level", F.col("head").alias("id")))
    payload = _payload(nodes, pairs.select("id").distinct(), docs, rule)
    sizes = payload.groupBy("id", "level").agg(F.sum(F.length("sketch") + F.length("shingles")).alias("size"))
    members = written(pairs.join(sizes, ["id", "level"]), "members")
    groups = members.groupBy("head", "level").agg(F.sum("size").alias("all"), F.count("*").alias("members"))
    groups = written(groups.withColumn("chunks", _chunks("all")), "groups")
    members = written(_looked_up(members, groups, ["head", "level"]).select("head", "level", "id", "size", "chunks"), "chunked")
    at = F.when(F.col("id") == F.col("head"), _all_of(F.col("chunks"))).otherwise(F.array(_dealt(F.col("chunks"), 1)))
    rows = members.select("head", "level", "id", F.explode(at).alias("i"), F.lit(0).alias("j"), F.col("id").alias("component"))
    first = written(_joining(rows.join(payload, ["id", "level"]), rule), "links")

    large = members.filter(F.col("chunks") > 1)
    if large.isEmpty():
        return first
    joined = written(components(first), "components")
    rows = large.join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    own = rows.filter(F.col("id") == F.col("head")).select("head", "level", F.col("component").alias("main"))
    sums = rows.groupBy("head", "level").agg(F.count("*").alias("members")).join(own, ["head", "level"])
    rows = written(_looked_up(rows, sums, ["head", "level"]).withColumn("apart", F.col("component") != F.col("main")).drop("members"), "apart")
    rest = rows.groupBy("head", "level").agg(F.sum(F.when(F.col("apart"), F.col("size"))).alias("apart_size"), F.count("*").alias("members")).filter(F.col("apart_size") > 0)
    rows = _looked_up(rows, rest.withColumn("rounds", _chunks("apart_size")), ["head", "level"])
    each = rows.select("*", _dealt(F.col("chunks"), 1).alias("i"), F.explode(_all_of(F.col("rounds"))).alias("j"))
    apart = rows.filter("apart").select("*", F.explode(_all_of(F.col("chunks"))).alias("i"), _dealt(F.col("rounds"), 2).alias("j"))
    rows = each.unionByName(apart).select("head", "level", "i", "j", "id", "component").distinct()
    return first.unionByName(_joining(rows.join(payload, ["id", "level"]), rule))


def near_duplicates(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    ``component_id`` is the smallest id reachable over links, the row's own included; ``kept`` marks the rows that carry it. Texts without words and rows without an
    id are linked with nothing; the latter have a null component and are kept. Repeated rows of one id are one document.
    """
    ship(docs.sparkSession)
    rows = written(sketch_documents(docs, rule), "sketches")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    some = rows.filter(linked)
    classes = written(some.groupBy("set_hash").agg(F.min("doc_id").alias("id"), F.count("*").alias("members")), "classes")
    least = classes.select("id", "set_hash")
    nodes = some.select(F.col("doc_id").alias("id"), "set_hash", F.explode("dealt").alias("_d")).select("id", "set_hash", "_d.*").join(least, ["id", "set_hash"], "left_semi")
    nodes = written(nodes.dropDuplicates(["id", "set_hash", "level"]), "nodes")
    # A class's texts have one set, so the text of its smallest id stands for all.
    joined = components(links(nodes, docs, rule))
    named = classes.join(joined, "id", "left").select("set_hash", "members", F.coalesce("component", "id").alias("component"))
    some = _looked_up(some.select("doc_id", "n_shingles", "set_hash"), named, ["set_hash"])
    out = some.select("doc_id", "n_shingles", F.col("component").alias("component_id")).unionByName(rows.filter(~linked).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The documents without those that have a smaller id in their component, with their own columns, whatever their names. Of several
    rows of one id with one set of shingles one stays; rows without an id all stay."""
    ship(docs.sparkSession)
    gone = written(near_duplicates(docs, rule).filter(~F.col("kept")).select("doc_id").distinct(), "gone")
    id_type = docs.schema["doc_id"].dataType
    kept = docs.join(gone.withColumn("doc_id", F.col("doc_id").cast(id_type)), "doc_id", "left_anti")
    kept = kept.select(*(F.col(quoted(c)) for c in docs.columns))
    many = docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").count().filter("count > 1").select("doc_id")
    many = written(many, "repeated")
    if many.isEmpty():
        return kept

    def sets(texts: list[str]) -> list[pa.Array]:
        return [pa.array([_digest(shingle_set(t, rule.shingle)) for t in texts], pa.binary())]

    name = fresh(docs, "set_hash")
    again = append_columns(kept.join(many, "doc_id", "left_semi"), "text", sets, [T.StructField(name, T.BinaryType())])
    return kept.join(many, "doc_id", "left_anti").unionByName(again.dropDuplicates(["doc_id", name]).drop(name))
