"""Repeated rows, columns of any name, a hot repeated row, very long texts, and the pipeline against a plain version of its rules."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stripweave.llm import bpe, neardup, quality, sharding, toxicity

TEXT = "one two three four five six seven eight nine ten " * 3


def test_one_of_each_repeated_document_stays(spark):
    rows = [(1, TEXT), (1, TEXT), (2, TEXT), (1, TEXT.upper()), (1, "quite another text of some words here"), (None, TEXT), (None, TEXT)]
    rows += [(3, None), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"a.b": F.lit(1), "x`y": F.lit(2), "set_hash": F.lit(3)})
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, (r.text or "").lower()) for r in kept.collect()), key=repr)
    assert got == sorted([(1, TEXT), (1, rows[4][1]), (None, TEXT), (None, TEXT), (3, ""), (4, "")], key=repr)
    assert neardup.keep_one(docs.limit(0)).collect() == []


@pytest.mark.parametrize("keep, label", [(quality.keep_good, "quality"), (toxicity.keep_clean, "toxic")])
def test_columns_of_any_name(spark, keep, label):
    rows = [(i, "word " * 30 if i % 2 else "%% 12 ## " * 30) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"a.b": F.col("doc_id"), "x`y z": F.lit("k"), "c0": F.lit(0), "body": F.lit("b")})
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), (1 - F.col("doc_id") % 2).cast("int").alias("toxic"))
    kept = keep(docs, labels)
    assert kept.columns == docs.columns
    found = kept.collect()
    assert found and all(r["a.b"] == r.doc_id and r["x`y z"] == "k" and r.c0 == 0 and r.body == "b" for r in found)


def test_a_hot_repeated_row_is_numbered_in_runs(spark):
    n = 2 * sharding.RUN + 7
    docs = spark.range(n).select(F.lit(5).cast("long").alias("doc_id"), F.lit("x").alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(6, "y"), (None, None)], "doc_id long, text string"))
    got = sharding.assign_shards(docs, 2).toPandas()
    assert len(got) == n + 2 and (got.doc_id == 5).sum() == n
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))


def test_long_texts_go_piece_by_piece(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    pick = random.Random(2)
    long = " ".join("".join(pick.choice("aeinrstü'1,") for _ in range(pick.randrange(1, 9))) for _ in range(3 * bpe.STEP)) + "<|endoftext|>" + "ß" * 50
    long += " x" * bpe.LONG
    own = bpe.tokenizer(P.path("word_bpe_49k.json"))
    assert len(list(own.pieces(long))) > 5 and max(map(len, own.pieces(long))) < 8 * bpe.LONG
    ids = library.encode(long, add_special_tokens=False).ids
    row = bpe.token_report(spark.createDataFrame([(1, long)], "doc_id long, text string"), "word_bpe_49k.json").first()
    decoded = library.decode(ids, skip_special_tokens=False)
    assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert row.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_pipeline_keeps_what_its_rules_say(spark, tmp_path):
    """What the two classifiers keep is taken from their own scores; groups and packing are worked out in plain Python."""
    import corpus_pipeline

    pick = random.Random(9)
    vocabulary = ["".join(pick.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    rows = []
    for i in range(240):
        text = " ".join(pick.choice(vocabulary) for _ in range(60)) + "."
        text = " ".join(["@@ 11 ## %%"] * 40) if i % 5 == 0 else text + (" vile slur filth" * 4 if i % 7 == 0 else "")
        rows.append((i, text))
    rows += [(1000 + i, rows[i][1]) for i in range(1, 60, 3)]  # copies
    rows += [(2000 + i, rows[i][1].replace(rows[i][1].split()[3], "changed", 1)) for i in range(2, 60, 9)]  # near copies
    rows += [rows[11], rows[11], rows[13], (3000, None), (3001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"a.b": F.lit(1), "lang": F.lit(None).cast("string")})
    labels = spark.createDataFrame([(i, int(i % 5 != 0), int(i % 7 == 0)) for i in range(240)], "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now = {}
    read = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:2]:
        read = stage(spark, read, str(tmp_path))
        now[name] = read.collect()
    clean = {(r.doc_id, r.text) for r in now["toxicity"]}
    by_id = dict(clean)
    parent = {i: i for i in by_id}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = {i: shingles(t or "") for i, t in by_id.items()}
    for a in by_id:
        for b in by_id:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    stay = {i for i in by_id if top(i) == i}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    packed = [i for r in out for i in r.doc_ids]
    assert sorted(packed) == sorted(stay) and len(packed) == len(set(packed))  # no document twice, none lost
    for r in out:
        assert len(r.tokens) == r.n_tokens <= r.bin_length and r.bin_length in (512, 1024, 2048, 4096)
        for i, start in zip(r.doc_ids, r.starts):
            own = [*(by_id[i] or "").split(), "<|end|>"]
            assert r.tokens[start : start + len(own)] == own
