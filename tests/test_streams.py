"""Streams with kept state against their batch twins: split in any way, sent again, with other columns."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stripweave.operators import attempts as A
from stripweave.operators import dialogue as L
from stripweave.operators import stories as T
from stripweave.streaming import learners, state

PLACE = "chapter long, block long"


def run(spark, parts, transform, tmp, name="s"):
    """Each part as one batch of a stream; the folder of changes."""
    for rows in parts:
        rows.write.mode("append").parquet(f"{tmp}/{name}-in")
        stream = transform(spark.readStream.schema(parts[0].schema).parquet(f"{tmp}/{name}-in"))
        learners.keep_changes(stream, f"{tmp}/{name}", f"{tmp}/{name}-at").trigger(once=True).start().awaitTermination(120)
    return f"{tmp}/{name}"


CHAPTERS = "series string, chapter long, sent long, names array<string>, dialogue_count long, has_action boolean"


def test_chapter_memory(spark, tmp_path):
    pick = random.Random(2)
    rows = [("s", c, 1, pick.sample(["Ann", "Bo", "Cy", "Di"], pick.randrange(4)), pick.randrange(50), pick.random() < 0.3) for c in range(45)]
    rows += [("t", c, 1, ["Ann"], 1, False) for c in range(3)]
    pick.shuffle(rows)
    df = spark.createDataFrame(rows, CHAPTERS)
    want = df.select("series", "chapter", F.size("names").cast("long").alias("characters"), "dialogue_count", "has_action")
    kept = sorted(tuple(r) for r in T.retained_chapters(want).select(*want.columns).collect())
    cast = T.series_characters(df.select("series", "chapter", F.explode("names").alias("name")))
    cast = sorted(tuple(r) for r in cast.select("series", "name", "appearances", "first_chapter", "last_seen").collect())
    first, second = spark.createDataFrame(rows[:20], CHAPTERS), spark.createDataFrame(rows[20:], CHAPTERS)
    stale = spark.createDataFrame([("s", 3, 0, ["Nobody"], 999, True)], CHAPTERS)
    path = run(spark, [first, second.unionByName(stale), first], learners.chapter_memory, tmp_path)
    assert sorted(tuple(r) for r in learners.kept_chapters(spark, path).collect()) == kept
    assert sorted(tuple(r) for r in learners.kept_characters(spark, path).collect()) == cast
    # A chapter sent later takes its old place: names it no longer has are taken off.
    new = spark.createDataFrame([("t", 0, 2, ["Bo"], 7, True), ("t", 2, 2, [], 1, False)], CHAPTERS).withColumn("extra", F.lit(1))
    new.write.mode("append").parquet(f"{tmp_path}/s-in")
    stream = learners.chapter_memory(spark.readStream.schema(new.schema).parquet(f"{tmp_path}/s-in"))  # one more column
    learners.keep_changes(stream, path, f"{tmp_path}/s-at").trigger(once=True).start().awaitTermination(120)
    t = {r.chapter: r for r in learners.kept_chapters(spark, path).filter("series = 't'").collect()}
    assert sorted(t) == [0, 1, 2] and (t[0].characters, t[0].dialogue_count, t[0].has_action) == (1, 7, True)
    assert sorted(tuple(r)[1:] for r in learners.kept_characters(spark, path).filter("series = 't'").collect()) == [("Ann", 1, 1, 1), ("Bo", 1, 0, 0)]
    assert len(learners.kept_chapters(spark, path).filter("series = 's'").collect()) == 30
    # A batch done again takes its own place.
    batch = spark.read.parquet(f"{path}/batch=1")
    assert batch.count() > 0
    spark.createDataFrame(batch.collect(), batch.schema).write.mode("overwrite").parquet(f"{path}/batch=1")
    assert len(learners.kept_chapters(spark, path).filter("series = 's'").collect()) == 30
    with pytest.raises(Exception, match="dialogue_count"):  # a missing column is an error, never an empty memory
        learners.chapter_memory(spark.readStream.schema("series string, chapter long, sent long, names array<string>").parquet(f"{tmp_path}/s-in"))


@pytest.mark.parametrize("cuts", [(), (7,), (3, 11)])
def test_identity_stream_is_the_batch_fold(spark, tmp_path, cuts):
    pick = random.Random(4)
    faces = [[pick.random() for _ in range(4)] for _ in range(6)]
    rows = []
    for s in (1, 2):
        for c in range(15):
            for b in range(4):
                face = pick.choice([None, *faces])
                near = face and [x + pick.random() * 0.05 for x in face]
                rows.append((s, c, b, pick.choice([None, None, "Ann", "Bo", "Cy"]), near))
    df = spark.createDataFrame(rows, "series long, chapter long, block long, name_hint string, signature array<double>")
    edges = [-1, *cuts, 100]
    parts = [df.filter((F.col("chapter") > a) & (F.col("chapter") <= b)) for a, b in zip(edges, edges[1:])]
    path = run(spark, parts, learners.identity_stream, tmp_path)
    got = spark.read.parquet(path).drop("batch").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, L.identity_fold(df).collect()))


def _attempts(n=400):
    pick, start = random.Random(6), datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        key = pick.choice("abc")
        ok = pick.random() < 0.4
        rows.append((key, start + timedelta(minutes=7 * i), i, pick.choice(["x", "y", "z"]), ok, not ok and pick.random() < 0.3, pick.random() * 9))
    return rows


ATTEMPTS = "domain string, ts timestamp_ntz, attempt_id long, method string, success boolean, blocked boolean, duration double"


def test_learners_in_batches(spark, tmp_path):
    rows = _attempts()
    df = spark.createDataFrame(rows, ATTEMPTS)
    parts = [df.filter("attempt_id < 150"), df.filter("attempt_id >= 150")]
    path = run(spark, parts, lambda s: learners.attempt_learner(s, ["x", "y", "z"]), tmp_path)
    want = sorted(map(tuple, A.preferred_methods(df, ["x", "y", "z"]).collect()))
    assert sorted(map(tuple, learners.latest_changes(spark, path, ["domain"]).collect())) == want
    arms = df.withColumnRenamed("domain", "arm")
    path = run(spark, [p.withColumnRenamed("domain", "arm") for p in parts], learners.arm_learner, tmp_path, "arms")
    got = {r.arm: r for r in learners.latest_changes(spark, path, ["arm"]).collect()}
    for r in A.arm_stats(arms).collect():
        g = got[r.arm]
        assert (g.requests, g.successes, g.cooling) == (r.requests, r.successes, False) and abs(g.ema - r.ema) < 1e-9
        assert g.cooldown_end.replace(tzinfo=None) == r.cooldown_end


class Held(dict):
    """A map state in memory."""

    updateValue = dict.__setitem__

    def getValue(self, k):
        return self[k]

    def removeKey(self, k):
        del self[k]


def test_frames_of_a_batch_are_read_in_order_bucket_by_bucket():
    rows = pd.DataFrame(_attempts(3000), columns=[f.split()[0] for f in ATTEMPTS.split(", ")])
    mixed = rows.sample(frac=1, random_state=1)
    reader = state.AttemptLearner(["x"])
    reader.pending = Held()
    found = list(reader.in_order(iter([mixed[:700], mixed[700:1500], mixed[1500:]])))
    assert pd.concat(found).attempt_id.tolist() == list(range(3000)) and not reader.pending
    assert max(map(len, found)) <= 9  # seven minutes apart: an hour's rows
    assert pd.concat(reader.in_order(iter([mixed]))).attempt_id.tolist() == list(range(3000))
    assert list(reader.in_order(iter([]))) == []
