"""The prefix trie, whitening and the exact search against brute force, with odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stripweave.llm import topk, trie, whitening

NAN, INF = float("nan"), float("inf")


def plain_trie(turns):
    own = defaultdict(list)
    for c, t, r, x, *_ in turns:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append((-(2**63) if t is None else t, hashlib.md5(f"{len(r)}:{r}{x}".encode()).digest(), len(x), (r, x)))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = own.get(c - c % 100, [])[:h] + v[h:]
    members, kids = defaultdict(list), defaultdict(set)
    for c, v in paths.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
            if d:
                kids[tuple(v[: d - 1])].add(tuple(v[:d]))
    leaves, saved, out = defaultdict(int), defaultdict(int), []
    for k in sorted(members, key=len, reverse=True):
        n = len(members[k])
        leaves[k] += not kids[k]
        saved[k] += (n - 1) * len(k[-1][1]) if k else 0
        if k:
            leaves[k[:-1]] += leaves[k]
            saved[k[:-1]] += saved[k]
        ends = ",".join(map(str, sorted(c for c in members[k] if len(paths[c]) == len(k))))
        above = min(members[k[:-1]]) if k else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(members[k]), len(k), above, n, len(kids[k]), leaves[k], saved[k], digest))
    return sorted(out, key=repr)


def found_trie(df):
    return sorted((tuple(r) for r in trie.prefix_trie(trie.share_beginnings(trie.conversation_paths(df))).collect()), key=repr)


TURNS = "conv_id long, turn long, role string, text string, n_convs long, path string"


def test_prefix_trie(spark):
    pick = random.Random(3)
    turns = []
    for c in range(450):
        if c % 100 == 0 and c >= 300:
            continue  # conversations whose base is absent
        for t in range(pick.choice([1, 2, 3, 5, 9])):
            turns.append((c, t, pick.choice(["user", "assistant"]), pick.choice(["a", "b", "ü五", "", "long " * 50]), 1, "x"))
    turns += [(500 + c, t, "user", f"same {t}", 1, None) for c in range(40) for t in range(7)]  # copies
    turns += [(601, t, "user", f"t{t}", 1, None) for t in range(300)]  # a long one
    turns += [(7, None, None, None, 1, "x"), (7, None, None, None, 1, "x"), (None, 1, "user", "lost", 1, "x"), (650, 0, None, None, 1, "")]
    df = spark.createDataFrame(turns, TURNS)
    assert found_trie(df) == plain_trie(turns)
    assert found_trie(df.limit(0)) == []
    lonely = [(301, 0, "user", "own first turns only", 1, "x")]  # its base is absent, and what is its own is cut off
    assert found_trie(spark.createDataFrame(lonely, TURNS)) == plain_trie(lonely)


def test_double_array_holds_each_prefix_once():
    pick = random.Random(5)
    paths = sorted({tuple(pick.randrange(4) for _ in range(pick.randrange(8))) for _ in range(400)})
    turns = [[hashlib.md5(bytes([x])).digest() for x in p] for p in paths]
    order = sorted(range(len(paths)), key=lambda i: b"".join(turns[i]))
    codes = np.array([paths[i][d] + 1 for i in order for d in range(len(paths[i]))], np.int64)
    starts = np.append(0, np.cumsum([len(paths[i]) for i in order]))
    packed = trie.DoubleArray(codes, starts)
    reached = defaultdict(set)
    for d, (live, slots) in enumerate(packed.walk(codes, starts)):
        for i, s in zip(live.tolist(), slots.tolist()):
            reached[s].add(paths[order[i]][: d + 1])
    assert all(len(p) == 1 for p in reached.values()) and len(reached) == len({p[: d + 1] for p in paths for d in range(len(p))})
    with pytest.raises(KeyError):
        list(packed.walk(np.array([9], np.int64), np.array([0, 1])))


def test_path_members_in_pieces(spark):
    n = trie.IDS_EACH * 2 + 5
    rows = spark.range(n).select(F.lit(b"k").alias("key"), F.col("id").alias("conv_id"))
    rows = rows.unionByName(spark.createDataFrame([(b"a", 5)], "key binary, conv_id long"))
    got = {r.conv_id: (r.n, r.ends_sha256) for r in trie.path_members(rows).collect()}
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got == {0: (n, sha(range(n))), 5: (1, sha([5]))}


@pytest.mark.parametrize("zeros, whole", [(False, False), (True, False), (False, True), (True, True)])
def test_rank_one(zeros, whole):
    pick = np.random.default_rng(4)
    for k in (1, 2, 5, 40):
        d = np.sort(pick.random(k) * 50)
        d = np.floor(d) if whole else d
        d[: k // 2] = 0 if zeros else d[: k // 2]
        q = np.linalg.qr(pick.normal(size=(k, k)))[0]
        for u in (pick.normal(size=k), q[:, 0] * 3, np.zeros(k), pick.normal(size=k) * 1e-9):
            a = q @ np.diag(d) @ q.T + 0.7 * np.outer(u, u)
            values, vectors = whitening.rank_one(d, q, u, 0.7)
            size = max(np.abs(a).max(), 1)
            assert np.allclose(values, np.linalg.eigvalsh(a), rtol=0, atol=1e-12 * size)
            assert np.abs(vectors @ np.diag(values) @ vectors.T - a).max() < 1e-12 * size
            assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12


def test_spectra_merge():
    pick = np.random.default_rng(6)
    x = np.floor(pick.normal(size=(90, 12)) * 20).astype(np.int64) + 1_000_000
    one, parts = whitening.Spectrum(12), [whitening.Spectrum(12) for _ in range(3)]
    one.add(x)
    for s, own in zip(parts, (x[:1], x[1:50], x[50:])):
        s.add(own)
    for s in parts[1:]:
        parts[0].merge(s)
    c = x - x.mean(0)
    for s in (one, parts[0]):
        assert s.n == 90 and s.sums == x.sum(0).tolist()
        assert np.allclose(s.d, np.linalg.eigvalsh(c.T @ c), atol=1e-8)


VECTORS = "vec_id long, embedding array<float>, component string"


def test_whitening(spark):
    pick = np.random.default_rng(8)
    v = pick.normal(size=(200, 20)) * np.linspace(0.1, 1, 20)
    v[:, 3] = 0.5  # a dimension without variance
    rows = [(i, [float(np.float32(c)) for c in r], "x") for i, r in enumerate(v)]
    rows += [(300 + i, rows[0][1], None) for i in range(50)] + [rows[1], (None, rows[2][1], "x")]
    odd = [(900, None, ""), (901, [], ""), (902, [None] * 20, ""), (903, [NAN] * 20, ""), (904, [INF] + [0.0] * 19, ""), (905, [1.0], "")]
    got = whitening.whiten(spark.createDataFrame(rows + odd, VECTORS)).toPandas()
    x = np.floor(64 * np.array([r[1] for r in rows])).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    c = (n * fit - sums) / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1][:16], q[:, ::-1][:, :16]
    assert len(got) == 16 * len(rows) and set(got.n) == {n} and (got.identity_error < 1e-9).all()
    got["vec_id"] = got.vec_id.fillna(-1)
    for i, r in enumerate(rows):
        own = got[got.vec_id == (-1 if r[0] is None else r[0])].drop_duplicates("component").sort_values("component")
        assert set(own.deviation) == {int(((n * x[i] - sums) ** 2).sum())}
        assert np.allclose(np.abs(own.whitened), np.abs(((n * x[i] - sums) / n) @ q / np.sqrt(e)), atol=1e-9)
        assert np.allclose(own.explained, e / np.trace(c.T @ c / n), rtol=1e-9)
    df = spark.createDataFrame(rows, VECTORS)
    assert whitening.whiten(df.limit(0)).collect() == [] and whitening.whiten(df.filter("vec_id >= 300")).collect() == []
    two = whitening.whiten(df.filter("vec_id < 2")).toPandas()  # two vectors have one component
    assert set(two.component) == {1} and np.allclose(np.abs(two.whitened), 1)


def test_deviations_beyond_a_long():
    centre = whitening.Centred(10**9, [10**9 * 5, 3])
    y = centre.deviations(np.array([[5, 0], [5, 3], [2**40, 0]]))
    assert y == [9, (3 * 10**9 - 3) ** 2, None]


def plain_top(rows, k, every):
    rows = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None and not any(c is None or not np.isfinite(c) for c in v)})
    out = []
    for q, a in rows:
        if q % every == 0:
            w = [np.floor(256 * c) for c in a]
            scores = {(-int(sum(x * np.floor(256 * y) for x, y in zip(w, b))), i) for i, b in rows if i != q}
            out += [(q, at + 1, i, -s) for at, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def test_exact_top_k(spark):
    pick = random.Random(1)
    rows = [(i, [pick.choice([0.0, 0.0, 0.25, -0.5, 0.001, 3.0]) for _ in range(9)]) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(400, 460)] + [rows[50]] * 40 + [(0, [1.0, 2.0])]  # ties, repeats, an id with two vectors
    rows += [(1000, None), (1050, [NAN]), (1100, [None, 1.0]), (1150, [INF]), (1200, []), (None, [1.0]), (1250, [0.0] * 9), (1300, [0.5] * 40)]
    df = spark.createDataFrame([(i, v, 1, "s") for i, v in rows], "vec_id long, embedding array<double>, score int, block string")
    got = topk.top_k(topk.sparse_rows(df, 256.0), F.col("vec_id") % 50 == 0, 5)
    assert sorted(tuple(r) for r in got.collect()) == plain_top(rows, 5, 50)
    few = spark.createDataFrame([(0, [1.0]), (1, [1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(topk.sparse_rows(few, 256.0), F.col("vec_id") == 0).collect()] == [(0, 1, 1, 65536)]
    assert topk.top_k(topk.sparse_rows(df.limit(0), 256.0), F.col("vec_id") == 0).collect() == []
    big = spark.createDataFrame([(0, [2**40]), (1, [2**40])], "vec_id long, weights array<long>").withColumn("terms", F.array(F.lit(0)))
    with pytest.raises(Exception, match="may not fit a long"):
        topk.top_k(big, F.col("vec_id") == 0).collect()
