"""Steps whose memory, time or shuffle grew faster than their input, or lay in one place: results against plain rules, and what plans must not hold."""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import functions as F

from stripweave.operators import dataset, dedupe, dialogue, sequence

from stripweave.operators.folds import dealt
from stripweave.session import stored
from stripweave.sinks import pictures, writers
from stripweave.sources import files
from stripweave.sources.feeds import ROW_COLUMNS, feed, strip_rows
from stripweave.streaming.state import ChapterMemory, IdentityStream

SUMS = [(1, 0, 300, 2), (1, 719, 75, 1), (1, 733, 9, 1), (2, 5, 12, 3), (3, 800, 7, 7), (None, 4, 100, 1)]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_row_profiles_are_neither_joined_nor_broadcast(spark):
    sums = spark.createDataFrame(SUMS, "strip_id long, y int, v long, n long")
    ids = sums.select("strip_id").distinct().select("strip_id", F.explode(F.sequence(F.lit(0), F.lit(719))).alias("y"))
    plain = ids.join(sums, ["strip_id", "y"], "left").selectExpr("strip_id", "y", *ROW_COLUMNS.split(", "))
    rows = strip_rows(sums)
    assert sorted(map(repr, rows.collect())) == sorted(map(repr, plain.collect()))
    assert "Join" not in plan_of(feed(spark, "/root/testdata/sf0.001", "rows"))


def test_stored_rows_that_compress_well_are_not_broadcast(spark):
    rows = stored(spark.range(20_000).select((F.col("id") % 5).alias("strip_id"), F.lit(250.0).alias("row_mean")))
    joined = rows.join(rows.groupBy("strip_id").agg(F.avg("row_mean").alias("base")), "strip_id")
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 20_000


def test_a_fold_is_dealt_into_parts_of_a_given_number(spark):
    assert dealt(spark.range(10).withColumnRenamed("id", "k"), "k").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_boxes_of_a_crowded_page_meet_kept_ones_only(spark):
    """Forty thousand boxes over each other, all but three of them copies of these: pairs would be hundreds of millions."""
    ids = spark.range(40_000).select(F.lit(1).alias("page"), F.col("id").alias("box_id"), ((F.col("id") % 3) * 60.0).alias("x"), F.lit(0.0).alias("y"), F.lit(100.0).alias("w"), F.lit(50.0).alias("h"), (-F.col("id")).alias("confidence"), F.lit("A word").alias("text"))
    odd = spark.createDataFrame([(None, -1, 0.0, 0.0, 9.0, 9.0, 1, "A word"), (1, -2, None, 0.0, 9.0, 9.0, 1, None), (1, -3, 0.0, 0.0, -1.0, 9.0, 1, None)], ", ".join(" ".join(x) for x in ids.dtypes))
    for keep, best in ((dedupe.box_nms, {0, 1, 2}), (dedupe.text_block_dedupe, {0, 2})):
        found = keep(ids.unionByName(odd), "page")
        kept = {(r.page, r.box_id) for r in found.filter("kept").collect()}
        assert kept == {(None, -1), (1, -2), (1, -3)} | {(1, k) for k in best} and found.count() == 40_003


def test_kept_boxes_are_those_of_brute_force():
    rnd = random.Random(9)
    for most in (0.48, 0.18, 0.0):
        kept, plain = dedupe.KeptBoxes(most), []
        for k in range(700):
            x, y, w, h = rnd.uniform(-90, 300), rnd.uniform(-90, 300), 2 ** rnd.uniform(-2, 7), 2 ** rnd.uniform(-2, 7)
            near = set()
            for n, (a, b, c, d) in enumerate(plain):
                shared = max(0, min(x + w, a + c) - max(x, a)) * max(0, min(y + h, b + d) - max(y, b))
                near |= {n} if shared / max(1.0, w * h + c * d - shared) > most else set()
            assert set(kept.near(x, y, w, h)) == near
            kept.put(x, y, w, h, k)
            plain.append((x, y, w, h))


def test_words_are_grouped_where_their_document_lies(spark):
    words = feed(spark, "/root/testdata/sf0.001", "words")
    plan = dialogue.word_lines(words)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan


class Entries(dict):
    """A map state that counts what is asked of it."""

    calls = 0

    def containsKey(self, key):
        self.calls += 1
        return key in self

    def getValue(self, key):
        self.calls += 1
        return self[key]

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value

    def removeKey(self, key):
        self.calls += 1
        self.pop(key, None)

    def iterator(self):
        return iter(list(self.items()))


def test_chapter_memory_asks_its_state_once_for_a_frame_not_for_each_name():
    states = {}

    class Handle:
        def getMapState(self, name, *_):
            return states.setdefault(name, Entries())

    memory = ChapterMemory(30, 20, 10)
    memory.init(Handle())
    frame = lambda chapters, sent, names: pd.DataFrame({"series": "s", "chapter": chapters, "sent": sent, "names": [names] * len(chapters), "dialogue_count": 1, "has_action": False})
    first = next(memory.handleInputRows(("s",), iter([frame(range(1000), 2, ["Ann", "Bo"]), frame(range(1000, 2000), 2, ["Ann", "Cy"])]), None))
    assert sum(s.calls for s in states.values()) < 300
    kept = first[(first["kind"] == "chapter") & first["kept"]]
    assert sorted(kept["chapter"]) == [*range(10), *range(1980, 2000)]
    second = next(memory.handleInputRows(("s",), iter([frame([0, 1999], 3, ["Cy"]), frame([5], 1, ["Nobody"])]), None))
    cast = {r.name: (r.appearances, r.first_chapter, r.last_seen) for r in second[second["kind"] == "character"].itertuples()}
    assert cast == {"Ann": (1998, 1, 1998), "Bo": (999, 1, 999), "Cy": (1001, 0, 1999)}


def test_candidates_meet_packed_stretches_and_keep_one_row_of_each(spark):
    """pairs of candidates and rows were sorted, and rows of blank paper were sent into few parts."""
    rnd = random.Random(5)
    costs = [(s, y, float(rnd.choice((2, 20, 40))), rnd.choice((0.001, 0.04)), 0.5) for s in (1, 2) for y in range(200)]
    rows = spark.createDataFrame(costs, "strip_id long, y int, row_std double, edge_density double, foreground double").repartition(3, "strip_id")
    wanted = [(1, 70, 60, 140, "a"), (1, 70, 60, 140, "b"), (1, 5, 1, 6, "a"), (2, 199, 130, 260, "a"), (2, 9, 9, 9, "a"), (2, 300, 300, 310, "a"), (3, 5, 1, 9, "a")]
    found = sequence.safe_boundaries(spark.createDataFrame(wanted, "strip_id long, target int, low int, high int, kind string"), rows)

    def cost(c, r):
        return round(0.42 * min(1.0, r[2] / 55) + 0.38 * min(1.0, r[3] / 0.08) + 0.16 * min(1.0, r[4]) + 0.04 * abs(r[1] - c[1]) / (c[3] - c[2]), 12)

    plain = []
    for c in wanted:
        near = [r for r in costs if r[0] == c[0] and c[2] <= r[1] < c[3]]
        plain += [(c[0], c[1], c[4], min((cost(c, r), r[1]) for r in near)[1])] if near else []
    assert sorted(map(tuple, found.collect())) == sorted(plain)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert [x for x in ("MapInArrow", "collect_list", "REPARTITION_BY_NUM") if x not in plan] == []


def test_peaks_of_strips_that_batches_cut_through(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        rows = feed(spark, "/root/testdata/sf0.001", "rows")
        small = sorted(map(tuple, sequence.strip_peaks(rows, [sequence.transitions(), sequence.beats(least=0.1)]).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    both = sorted([(*r[:2], "transition", r[2]) for r in sequence.transition_scores(rows).collect()] + [(*r[:2], "action_beat", r[2]) for r in sequence.action_beats(rows, least=0.1).collect()])
    assert small == both and small


def test_elements_leave_before_a_batch_of_pages_is_read(spark, monkeypatch):
    """all elements of ten thousand pages were held at once."""
    import pyarrow as pa

    from stripweave.sources import pages as source

    sent = []

    class Batches:
        from_pylist = staticmethod(lambda rows, _: sent.append([r["page_id"] for r in rows]))

    class Pages:
        sparkSession = spark
        select = lambda self, *_: self

        def mapInArrow(self, run, _):
            html = ["<p>a</p>" * 900, None, "<p>b</p>" * 900, "<p>c</p>" * 900, "<br>"]
            return list(run(iter([pa.record_batch({"page_id": range(5), "html": [h or "" for h in html]})])))

    monkeypatch.setattr(source.pa, "RecordBatch", Batches)
    source.html_elements(Pages())
    assert [len(s) for s in sent] == [2700, 1] and [k for s in sent for k in dict.fromkeys(s)] == [0, 2, 3, 4]


def test_ranges_and_folds_are_dealt_into_parts_that_follow_their_rows(spark, monkeypatch):
    """their parts were a fixed number, so that one task's memory grew with the table."""
    from stripweave.operators import folds

    monkeypatch.setattr(folds, "ROWS_EACH", 10)
    monkeypatch.setattr(folds.parts_for, "__defaults__", (10,))
    rows = spark.range(200).select((F.col("id") % 2).alias("strip_id"), F.floor(F.col("id") / 2).cast("int").alias("y"), F.lit(1.0).alias("row_mean"), F.lit(1.0).alias("row_std"), F.lit(0.0).alias("edge_density"), F.lit(0.0).alias("foreground"))
    assert folds.parts_for(rows) == 20
    whole = spark.createDataFrame([(0, 0, 100), (1, 0, 50)], "strip_id long, start int, end int")
    cut = sequence.split_long(whole, rows, most=20, target=16, reach=3, margin=4)
    assert cut.rdd.getNumPartitions() >= 20
    spans = sorted(map(tuple, cut.collect()))
    for strip, end in ((0, 100), (1, 50)):
        own = [s for s in spans if s[0] == strip]
        assert own[0][1] == 0 and own[-1][2] == end and all(a[2] == b[1] and a[2] - a[1] <= 20 for a, b in zip(own, own[1:], strict=False))


def test_coefficients_are_made_batch_by_batch(spark):
    """as nested functions every coefficient worked out all sums of its grid anew. Missing grids and values give nulls, longer grids count to their 256th value."""
    rnd = random.Random(5)
    whole = [rnd.uniform(0, 255) for _ in range(256)]
    grids = [(0, whole), (1, None), (2, whole[:255]), (3, whole + [1.0]), (4, [None, *whole[1:]]), (5, [])]
    found = spark.createDataFrame(grids, "k int, grid array<double>").select("k", files.dct8(F.col("grid")).alias("c"))
    assert "lambda" not in plan_of(found)
    got = {r.k: r.c for r in found.collect()}
    wave = lambda u, x: math.sqrt((2 if u else 1) / 16) * math.cos(math.pi * (2 * x + 1) * u / 32)
    plain = [sum(whole[y * 16 + x] * wave(u, y) * wave(v, x) for y in range(16) for x in range(16)) for u in range(8) for v in range(8)]
    assert all(max(abs(a - b) for a, b in zip(got[k], plain, strict=True)) < 1e-9 for k in (0, 3))
    assert all(got[k] == [None] * 64 for k in (1, 2, 4, 5))


def test_pictures_of_one_size_are_worked_on_together(spark, monkeypatch):
    """statistics of small pictures cost hundreds of array calls each; sizes mixed in a batch, and stacks of any length, give the same."""
    rnd = random.Random(6)
    rows = [(f"{k}", w, h, c, rnd.randbytes(w * h * c)) for k, (w, h, c) in enumerate([(16, 16, 1), (7, 30, 3), (16, 16, 1), (16, 16, 3), (1, 1, 1), (7, 30, 1)] * 3)]
    df = spark.createDataFrame(rows, "path string, width int, height int, channels int, data binary").coalesce(1)
    calls = []
    monkeypatch.setattr(files, "_panel_stats", lambda greys, plain=files._panel_stats: calls.append(len(greys)) or plain(greys))

    class Pages:
        sparkSession = spark
        select = lambda self, *_: self
        mapInArrow = lambda self, run, _: list(run(iter(df.toArrow().to_batches())))

    got = {r["path"]: r for b in files.panel_stats(Pages()) for r in b.to_pylist()}
    assert calls == [9, 6, 3] and len(got) == len(rows)
    monkeypatch.setattr(files, "STACK_PIXELS", 1)
    alone = {r["path"]: r for b in files.panel_stats(Pages()) for r in b.to_pylist()}
    assert calls[3:] == [1] * 18 and alone == got
    for path, w, h, c, data in rows:
        grey = files._grey(data, h, w, c)
        assert (got[path]["width"], got[path]["height"], got[path]["mean"], got[path]["std"]) == (w, h, grey.mean(), grey.std())
        assert got[path]["white_ratio"] == (grey > 242).mean() and got[path]["edge_ratio"] == files._edges(grey).mean()
        assert len(got[path]["grid8"]) == 64 and len(got[path]["border_dark"]) == 4 and (h * w != 256 or got[path]["grid16"] == grey.ravel().tolist())


def test_coco_annotations_are_numbered_by_their_images(spark, tmp_path):
    """F16: annotations were joined with images made again for each use, and sorted and numbered one by one; documents were read once more to find their schema."""
    rnd = random.Random(8)
    rows = [(i, a, rnd.randrange(5), rnd.random(), rnd.random(), rnd.random(), rnd.random()) for i in rnd.sample(range(9000), 60) for a in rnd.sample(range(9), rnd.randrange(1, 5))]
    labels = spark.createDataFrame([*rows, (9001, 0, 1, 0.5, 0.5, 0.1, 0.1)], "image_id long, ann_id int, class_id int, cx double, cy double, nw double, nh double")
    split = {i: "ab"[i % 2] for i in {r[0] for r in rows}}
    splits = spark.createDataFrame([*split.items(), (9002, "a")], "image_id long, split string")  # one image without a split, one without labels
    plan = plan_of(dataset.coco_tables(labels, splits)[1])
    assert plan.count("Join ") == 1 and "Range" not in plan and plan.count("Sort") == 0
    images = {s: sorted(i for i in split if split[i] == s) for s in "ab"}
    want = {s: [(images[s].index(i) + 1, c + 1, ((x - w / 2) * 800, (y - h / 2) * 600, w * 800, h * 600)) for i, _, c, x, y, w, h in sorted(r for r in rows if split[r[0]] == s)] for s in "ab"}
    writers.write_coco_json(labels, splits, str(tmp_path / "coco"), images_each=7)
    docs = files.coco_documents(spark, str(tmp_path / "coco")).collect()
    for s in "ab":
        own = [d for d in docs if d.split == s]
        assert 2 < len(own) <= -(-len(images[s]) // 7) and all([c.name for c in d.categories] == list(dataset.CLASSES) for d in own)
        assert sorted((i.id, i.file_name) for d in own for i in d.images) == [(k + 1, f"img_{i}.jpg") for k, i in enumerate(images[s])]
        assert all([x.id for x in d[f]] == sorted(x.id for x in d[f]) for d in own for f in ("images", "annotations"))
        assert all({a.image_id for a in d.annotations} == {i.id for i in d.images} for d in own)
        assert {a.id: (a.image_id, a.category_id, tuple(a.bbox)) for d in own for a in d.annotations} == dict(enumerate(want[s], 1))


def test_profiles_that_nothing_leads_to_are_numbered_and_not_kept():
    """every mention without a name and a face was held, loaded and compared with each batch."""
    p = dialogue.new_profiles()
    told = [p.observe(c, name, face) for c, (name, face) in enumerate([(None, []), ("Ann", []), ("!?", []), (None, [1.0, 0.0]), (None, []), ("Ann", [1.0, 0.0]), (None, [1.0, 0.0])])]
    assert [t[0] for t in told] == ["Character_01", "Character_02", "Character_03", "Character_04", "Character_05", "Character_02", "Character_02"]
    assert [t[2] for t in told] == ["new_visual_profile", "explicit_name", *["new_visual_profile"] * 3, "matched_face", "matched_face"]
    assert list(p.all) == ["Character_02"] and p.display("Character_01") == "Character_01" and p.display("Character_02") == "Ann"
    for _ in range(5000):
        p.observe(9, None, [])
    assert len(p.all) == 1 and p.made == 5005


def test_mentions_of_a_batch_are_few_entries_of_the_state():
    """each chapter of each frame was an entry, so there were nearly as many as rows."""
    rows = pd.DataFrame({"series": 1, "chapter": [k // 2 for k in range(6000)], "block": [k % 2 for k in range(6000)]})
    mixed = rows.sample(frac=1, random_state=1)
    entries = []

    class Held(dict):
        getValue = dict.__getitem__
        removeKey = dict.__delitem__

        def updateValue(self, k, v):
            entries.append(k)
            self[k] = v

    for most, puts in ((2000, 18), (50_000, 0)):
        entries.clear()
        reader = IdentityStream()
        reader.pending, reader.together = Held(), most
        found = pd.concat(reader.in_order(iter([mixed[k : k + 500] for k in range(0, 6000, 500)])))
        assert found.chapter.tolist() == rows.chapter.tolist() and found.block.tolist() == rows.block.tolist()
        assert len(entries) == puts and not reader.pending


def test_files_of_pictures_are_opened_once(spark, tmp_path):
    """the report listed the folder twice and joined files with decoded images, which the statistics listed and decoded again."""
    grey = bytes(range(100))
    rows = [("a/g.png", 10, 10, 1, grey), ("a/s.png", 4, 10, 1, bytes(40)), ("w.webp", 1, 1, 1, b"RIFF"), ("b.jpg", 1, 1, 1, b"no jpeg"), ("n.txt", 1, 1, 1, b"text"), ("e.png.jpg", 1, 1, 1, b"")]
    df = spark.createDataFrame(rows, "path string, width int, height int, channels int, data binary")
    assert pictures.write_pictures(df, str(tmp_path)).count() == 6
    found = files.scanned_images(spark, str(tmp_path))
    assert "Join" not in plan_of(found) and "Join" not in plan_of(files.image_report(spark, str(tmp_path)))
    got = {r.path.rsplit("/", 1)[-1]: (r.problem, r.width, r.height, r.channels, r.data and bytes(r.data)) for r in found.collect()}
    assert got == {"g.png": (None, 10, 10, 1, grey), "s.png": ("too_small", 4, 10, 1, bytes(40)), "w.webp": ("unknown_format", *[None] * 4), "b.jpg": ("unreadable", *[None] * 4)}
