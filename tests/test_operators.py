import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stripweave.operators import attempts, dataset, dedupe, dialogue, elements, panels, sequence, stitching
from stripweave.operators.folds import moving_average, ordered_fold, running_sums
from stripweave.operators.ranking import global_row_number
from stripweave.sinks import pictures, writers
from stripweave.sources import files, subscenes
from stripweave.sources.pages import elements_of, html_elements
from stripweave.streaming import learners


def test_global_row_number_is_a_plain_row_number(spark):
    data = [(k % 3, random.Random(k).randint(0, 99), k) for k in range(200)]
    df = global_row_number(spark.createDataFrame(data, "g int, v int, k int"), F.floor(F.col("v") / 10), ["v", "k"], "n", by=["g"])
    for g in range(3):
        wanted = sorted((v, k) for gg, v, k in data if gg == g)
        assert [(r.v, r.k) for r in df.filter(F.col("g") == g).orderBy("n").collect()] == wanted


def test_running_sums_and_average(spark):
    data = [("a" if k % 2 else "b", k, float(k * 7 % 13)) for k in range(60)]
    df = spark.createDataFrame(data, "g string, t int, v double")
    found = {(r.g, r.t): r.s for r in running_sums(df, ["g"], F.floor(F.col("t") / 8), ["t"], {"s": F.col("v")}).collect()}
    ema = {r.g: r.ema for r in moving_average(df, ["g"], F.floor(F.col("t") / 8), ["t"], F.col("v"), 5.0).collect()}
    for g in "ab":
        total, e = 0.0, 5.0
        for _, t, v in sorted((x for x in data if x[0] == g), key=lambda x: x[1]):
            assert found[g, t] == pytest.approx(total)
            total, e = total + v, 0.3 * v + 0.7 * e
        assert ema[g] == pytest.approx(e)


def test_ordered_fold_empty_and_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (2, 5), (2, 3)], "k long, v int")
    out = ordered_fold(df, "k", ["v"], lambda _: [], lambda s, r: s.append(r.v), lambda k, s: [(k, sum(x * 10**i for i, x in enumerate(s)))], "k long, n long")
    assert [tuple(r) for r in out.collect()] == [(2, 53)]
    assert ordered_fold(df.limit(0), "k", ["v"], lambda _: [], lambda s, r: s.append(r.v), lambda k, s: [(k, 0)], "k long, n long").count() == 0


def test_fold_keeps_a_key_whole_after_a_union(spark):
    """The exchange before a fold stays where both sides of a union are dealt by its key already."""
    a = spark.range(400).select((F.col("id") % 5).alias("page"), F.col("id").alias("box_id"), (F.col("id") * 300).alias("x"), F.lit(0).alias("y"), F.lit(10).alias("w"), F.lit(10).alias("h"), F.lit(9).alias("confidence"))
    twins = a.unionByName(a.withColumn("box_id", F.col("box_id") + 1000).withColumn("confidence", F.lit(8)))
    kept = {r.box_id for r in dedupe.box_nms(twins, "page").filter("kept").collect()}
    assert kept == set(range(400))


def test_near_panels_are_copies_of_accepted_ones_only(spark):
    sizes = [(300, 300), (100, 300), (300, 300), (300, 300), (300, 300)]
    hashes = [0b0, 0b1111_0000, 0b111, 0b1111_0000, None]
    rows = [("c", k, w, h, x) for k, ((w, h), x) in enumerate(zip(sizes, hashes, strict=True))] + [("d", 0, 300, 300, 0), ("d", 1, None, 300, 0), ("d", 2, 300, 300, 0)]
    df = spark.createDataFrame(rows, "chapter string, seq int, width int, height int, hash long")
    found = {(r.chapter, r.seq): r.reason for r in panels.validated_panels(df, F.lit(False)).collect()}
    assert found == {("c", 0): None, ("c", 1): "too_small", ("c", 2): "duplicate", ("c", 3): None, ("c", 4): None, ("d", 0): None, ("d", 1): "unreadable", ("d", 2): "duplicate"}
    assert panels.validated_panels(df.limit(0), F.lit(False)).count() == 0


def test_state_of_a_late_batch_does_not_hide_a_newer_one(spark, tmp_path):
    path = str(tmp_path / "s")
    for number, n in ((2, 5), (1, 3), (2, 4)):  # an older batch comes late, the newer one twice
        writers.save_state(spark.range(n), path, number)
    assert writers.latest_state(spark, path).count() == 4


def test_broken_pages_are_asked_for_again(spark):
    wanted = spark.range(4).select(F.lit("c").alias("chapter"), F.col("id").alias("seq"))
    arrived = spark.createDataFrame([("c", 0, 5000), ("c", 1, 10), ("c", 2, None)], "chapter string, seq long, length int")
    asked = learners.missing_pages(wanted, arrived, valid=F.col("length") >= panels.LEAST_BYTES)
    assert {r.seq for r in asked.collect()} == {1, 2, 3}


def test_splits_are_exact_and_order_free(spark):
    images = spark.range(103).select(F.col("id").alias("image_id"))
    a = dataset.split_images(images, "image_id")
    b = dataset.split_images(images.orderBy(F.desc("image_id")), "image_id")
    assert {r["split"]: r["count"] for r in a.groupBy("split").count().collect()} == {"train": 72, "val": 15, "test": 16}
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    with pytest.raises(ValueError):
        dataset.split_images(images, "image_id", (0.5, 0.1, 0.1))


def test_hash_pairs_are_those_of_brute_force(spark):
    rnd = random.Random(5)
    base = [rnd.getrandbits(63) for _ in range(12)]
    hashes = base + [b ^ (1 << rnd.randrange(63)) for b in base] + [b ^ 7 for b in base] + [b ^ 15 for b in base]
    df = spark.createDataFrame([("c", k, h) for k, h in enumerate(hashes)], "chapter string, seq int, hash long")
    found = {(r.a, r.b) for r in dedupe.hash_pairs(df).collect()}
    assert found == {(a, b) for a in range(len(hashes)) for b in range(a + 1, len(hashes)) if hashes[a] != hashes[b] and bin(hashes[a] ^ hashes[b]).count("1") <= 3}
    kept = {r.seq for r in dedupe.near_hash_dedupe(df).filter("kept").collect()}
    plain = []
    for k, h in enumerate(hashes):
        if all(bin(h ^ hashes[p]).count("1") > 3 for p in plain):
            plain.append(k)
    assert kept == set(plain)


def test_box_nms_matches_the_plain_rule(spark):
    rnd = random.Random(2)
    boxes = [(1, k, float(rnd.randint(0, 200)), float(rnd.randint(0, 200)), float(rnd.randint(20, 120)), float(rnd.randint(20, 120)), rnd.random()) for k in range(60)]
    df = spark.createDataFrame(boxes, "page int, box_id int, x double, y double, w double, h double, confidence double")
    found = {r.box_id for r in dedupe.box_nms(df, "page").filter("kept").collect()}

    def iou(a, b):
        i = max(0, min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2])) * max(0, min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3]))
        return i / max(1, a[4] * a[5] + b[4] * b[5] - i)

    kept = []
    for b in sorted(boxes, key=lambda b: (-b[6], b[3], b[2], b[1])):
        if all(iou(b, k) <= 0.48 for k in kept):
            kept.append(b)
    assert found == {b[1] for b in kept}


def profile(spark, marks, n=120):
    return spark.createDataFrame([(1, y, 100.0 if m else 250.0, 40.0 if m else 2.0, 0.1 if m else 0.001, 0.5 if m else 0.01, 50.0) for y, m in ((y, any(a <= y < b for a, b in marks)) for y in range(n))], "strip_id long, y int, row_mean double, row_std double, edge_density double, foreground double, saturation double")


def test_runs_tile_the_axis(spark):
    rows = profile(spark, [(5, 20), (40, 90)]).withColumn("m", F.col("row_mean") < 200)
    runs = sequence.boolean_runs(rows, "m").unionByName(sequence.boolean_runs(rows.withColumn("m", ~F.col("m")), "m"))
    spans = sorted((r.start, r.end) for r in runs.collect())
    assert spans == [(0, 5), (5, 20), (20, 40), (40, 90), (90, 120)]
    assert [(r.start, r.end) for r in sequence.merge_close(sequence.boolean_runs(rows, "m"), 24).collect()] == [(5, 90)]


def random_rows(spark, strips=4, height=900, seed=3):
    rnd = random.Random(seed)
    rows = [(k, y, rnd.random() * 255, rnd.random() * 60, rnd.random() / 8, rnd.random() / 4, *(rnd.random() for _ in range(6))) for k in range(strips) for y in range(height - 37 * k)]
    names = ("row_mean", "row_std", "edge_density", "foreground", "saturation", "energy", "focus", "white", "ink", "dark")
    return rows, spark.createDataFrame(rows, "strip_id long, y int, " + ", ".join(f"{c} double" for c in names))


def cheapest(strip, target, low, high):
    """The row of [low, high) that costs least to cut at; None where there is no row."""
    low, high = max(1, low), min(len(strip) - 1, high)
    cost = lambda y: round(0.42 * min(1, strip[y][3] / 55) + 0.38 * min(1, strip[y][4] / 0.08) + 0.16 * min(1, strip[y][5]) + 0.04 * abs(y - target) / (high - low), 12)
    return min(range(low, high), key=cost) if high > low else None


def plain_scenes(strip, cuts, least, most, target):
    out, last = [], 0
    for at in [*cuts, None]:
        end = len(strip) if at is None else at
        if at is not None and at - last < least:
            continue
        while end - last > most:
            safe = cheapest(strip, last + target if at is None else min(last + target, end - least), last + least, min(last + most, end - least))
            if safe is None or safe <= last:
                break
            out.append(safe)
            last = safe
        if at is not None and at - last >= least:
            out.append(at)
            last = at
    if out and len(strip) - out[-1] < least:
        out.pop()
    return [0, *out, len(strip)]


def test_scene_cuts_are_those_of_the_plain_walk(spark):
    raw, rows = random_rows(spark)
    for k, marks in enumerate([[], [5, 70, 71, 400, 700, 880], [300, 310, 420, 780]]):
        cuts = spark.createDataFrame([(s, c, 1.0, "gutter") for s in range(4) for c in marks if c < 780], "strip_id long, cut int, strength double, kind string")
        found = sequence.scene_cuts(cuts, rows, least=40, most=150, target=90).collect()
        for s in range(4):
            strip = [r for r in raw if r[0] == s]
            wanted = plain_scenes(strip, [c for c in marks if c < 780], 40, 150, 90)
            got = sorted((r.start, r.end) for r in found if r.strip_id == s)
            assert got == list(zip(wanted, wanted[1:])), (k, s)


def test_long_ranges_are_split_as_by_the_plain_rule(spark):
    raw, rows = random_rows(spark)
    ranges = [(0, 3, 600), (0, 610, 640), (1, 0, 863), (2, 100, 195), (3, 50, 170)]
    found = sequence.split_long(spark.createDataFrame(ranges, "strip_id long, start int, end int"), rows, most=120, target=100, reach=30, margin=25).collect()
    wanted = []
    for s, start, end in ranges:
        strip = [r for r in raw if r[0] == s]
        paper = float(np.percentile([r[2] for r in strip], 88))
        while end - start > 120:
            low, high = max(start + 25, start + 70), min(end - 25, start + 130)
            cut = min(range(low, high), key=lambda y: round(abs(strip[y][2] - paper) / 255 + 3 * strip[y][4], 12)) if high > low else start + 120
            wanted.append((s, start, cut))
            start = cut
        wanted.append((s, start, end))
    assert sorted((r.strip_id, r.start, r.end) for r in found) == sorted(wanted)
    with pytest.raises(ValueError):
        sequence.split_long(rows, rows, target=100, reach=50)


def test_parts_end_at_sections_or_safe_rows(spark):
    raw, rows = random_rows(spark)
    ends = [(0, e) for e in (40, 150, 160, 330, 700, 899)] + [(1, 863)] + [(2, e) for e in range(30, 820, 30)]
    found = sequence.part_cuts(spark.createDataFrame(ends, "strip_id long, y_end int"), rows, most=150, shortest=20, before=20, after=10, margin=30).collect()
    for s in range(4):
        strip = [r for r in raw if r[0] == s]
        total, at, wanted = len(strip), 0, []
        while total - at > 150:
            near = [e for k, e in ends if k == s and 0 < e < total and at + 82 <= e <= at + 150]
            low, high = max(at + 30, at + 130), min(total - 1, at + 160)
            cut = max(near) if near else max(range(low, high), key=lambda y: (round(strip[y][2] / 255 - 2.5 * strip[y][4], 12), -y)) if high > low else at + 150
            wanted.append((at, cut))
            at = cut
        wanted.append((at, total))
        assert sorted((r.start, r.end) for r in found if r.strip_id == s) == wanted


def test_scenes_count_their_bubbles(spark):
    _, rows = random_rows(spark)
    boxes = [(0, "a", 10, 5, 200, 60), (0, "b", 10, 840, 200, 200), (0, "c", 700, 100, 100, 40)]
    scenes = sequence.scene_detection(rows, spark.createDataFrame(boxes, "strip_id long, box_id string, x int, y int, width int, height int"), spacing=30, least=60, most=240, target=120, trim=40).collect()
    own = sorted((r for r in scenes if r.strip_id == 0), key=lambda r: r.start)
    assert own[0].start == 0 and own[-1].end == 900 and all(a.end <= b.start for a, b in zip(own, own[1:]))
    assert sum(r.bubbles for r in own) >= 3 and own[-1].cut_bubbles == 1 and all(0 <= r.bubble_share <= 1 for r in own)
    assert all(r.bubbles == 0 for r in scenes if r.strip_id)


def plain_panels(means, edges, least, gap, padding, margin, most, shortest):
    total = len(means)
    white = max(180.0, min(250.0, float(np.percentile(means, 95))))
    mask = np.convolve(np.array(means) < white, np.ones(3), "same") > 1
    runs, k = [], 0
    while k < total:
        if mask[k]:
            e = next((j for j in range(k, total) if not mask[j]), total)
            if runs and k - runs[-1][1] < gap:
                runs[-1] = (runs[-1][0], e)
            else:
                runs.append((k, e))
            k = e
        k += 1
    out = []
    for a, b in runs:
        a = next((j for j in range(a, min(a + 20, total)) if means[j] <= white - 20), a + 20)
        if b - a < least:
            continue
        m = min(margin, (b - a) // 10)
        top = next((j for j in range(max(0, a - m), min(total - 1, a + m)) if means[j] < white - 10), a)
        end = next((j + 1 for j in range(min(total - 1, b + m), max(0, b - m), -1) if means[j] < white - 10), b)
        top, end = max(0, min(top - padding, a)), min(total, max(end + padding, b))
        if end - top >= least:
            out.append((top, end))
    if len(out) <= 1:
        smooth = np.convolve(edges, np.ones(3) / 3, "same")
        busy, extra, k = smooth > max(0.0005, smooth.mean() * 0.6), [], 0
        while k < total:
            e = k
            while e < total and busy[e]:
                e += 1
            if e - k >= least:
                extra.append((k, e))
            k = max(e, k + 1)
        out = extra or out
    cut = []
    for a, b in out:
        n = max(2, (b - a) // most + 1) if b - a > most else 1
        each = (b - a) // n
        cut += [(a, b)] if n == 1 else [(a + i * each, a + (i + 1) * each) for i in range(n) if each > shortest]
    return cut


def plain_chunks(panels, means, least, most, shortest):
    size, i, start, out = (least + most) // 2, 0, 0, []
    while i < len(panels):
        left = len(panels) - i
        n = left if left <= most else left - least if left - size < least else size
        end = panels[i + n - 1][1]
        nxt = panels[i + n][0] if i + n < len(panels) else end
        cut = end + int(np.argmax(means[end:nxt])) if nxt > end else end
        if cut - start > shortest:
            out.append((start, cut, n))
        start, i = cut, i + n
    return out


def test_panels_and_chunks_are_those_of_the_plain_walk(spark):
    rnd, raw = random.Random(31), []
    for strip in range(6):
        y = 0
        while y < 800:
            n = rnd.choice([3, 9, 30, 80] if strip else [60, 90])
            paper = rnd.random() < 0.45 and strip != 5
            for _ in range(n):
                raw.append((strip, y, 252.0 - rnd.random() if paper else 60 + rnd.random() * (190 if strip == 4 else 120), 10.0, 0.0 if rnd.random() < 0.5 else 0.05, 0.1, *[0.5] * 6))
                y += 1
    names = ("row_mean", "row_std", "edge_density", "foreground", "saturation", "energy", "focus", "white", "ink", "dark")
    rows = spark.createDataFrame(raw, "strip_id long, y int, " + ", ".join(f"{c} double" for c in names))
    rules = {"least": 12, "gap": 4, "padding": 3, "margin": 6, "most": 60, "shortest": 10}
    panels = sequence.webtoon_panels(rows, **rules)
    found = {k: sorted((r.start, r.end) for r in panels.collect() if r.strip_id == k) for k in range(6)}
    chunks = sequence.chunks_by_count(panels, rows, least=2, most=4, shortest=5).collect()
    for k in range(6):
        means, edges = [r[2] for r in raw if r[0] == k], [r[4] for r in raw if r[0] == k]
        assert found[k] == sorted(plain_panels(means, edges, **rules)), k
        assert sorted((r["from"], r["cut"], r["panels"]) for r in chunks if r.strip_id == k) == plain_chunks(found[k], means, 2, 4, 5), k


def test_beats_are_those_of_plain_means(spark):
    raw, rows = random_rows(spark, 1, 700)
    found = {r.y: r.strength for r in sequence.action_beats(rows, width=100, least=0.0).collect()}
    span, gap, window, radius = 48, 9, 17, 12
    values = np.array([[r[k] for k in (2, 3, 4, 5, 6, 7, 8)] for r in raw]) * [s for _, s, _ in sequence.BEATS]
    smooth = np.column_stack([np.convolve(v, np.ones(window) / window, "same") for v in values.T])
    score = {y: round(float(np.abs(smooth[y - span : y - gap].mean(0) - smooth[y + gap : y + span].mean(0)) @ [w for _, _, w in sequence.BEATS]), 8) for y in range(span, 700 - span)}
    least = float(np.percentile(list(score.values()), 94))
    wanted = {y: s for y, s in score.items() if s >= least and s >= max(v for k, v in score.items() if abs(k - y) <= radius)}
    assert found.keys() == wanted.keys() and all(abs(found[y] - wanted[y]) < 1e-7 for y in wanted)


def test_attempts_follow_the_plain_state_machine(spark):
    rnd = random.Random(9)
    methods = ["a", "b", "c"]
    data = [("d%d" % rnd.randrange(4), k, k, rnd.choice(methods), rnd.random() < 0.4, rnd.random() < 0.2) for k in range(300)]
    df = spark.createDataFrame(data, "domain string, ts long, attempt_id long, method string, success boolean, blocked boolean")
    found = {r.domain: (r.best, r.delay, r.attempts) for r in attempts.preferred_methods(df, methods).collect()}
    for d in found:
        s = attempts.new_preference(methods)
        for x in (x for x in data if x[0] == d):
            attempts.learn(s, methods, *x[3:])
        assert found[d] == (s["best"], s["delay"], s["attempts"])


HTML = """<div class="reading-content page"><img class="page" data-src="/p-10.jpg" width="800" height="1200"><img class="page" data-src="/p-9.jpg"><img src="/logo.png"></div>
<select><option value="/c/1">1</option><option value="/c/2">2</option><option value="/c/2/">2</option></select><a rel="next" href="/c/2">n</a>"""


def test_page_images(spark):
    pages = spark.createDataFrame([(1, "https://www.s.example/c/1", HTML), (2, "https://x.example", None), (3, "https://y.example", "<p<<img src=")], "page_id long, url string, html string")
    scored = elements.scored_elements(html_elements(pages), pages)
    assert [(r.seq, r.url) for r in elements.page_images(scored).orderBy("seq").collect()] == [(1, "https://www.s.example/p-9.jpg"), (2, "https://www.s.example/p-10.jpg")]
    assert [(r.domain, r.selector) for r in elements.induce_selector(elements.page_images(scored)).collect()] == [("s.example", "img.page")]
    edges = elements.link_edges(pages)
    assert sorted((r.kind, r.target) for r in edges.collect()) == [("next", "https://www.s.example/c/2"), ("option", "https://www.s.example/c/1"), ("option", "https://www.s.example/c/2")]
    assert elements_of("") == []


def test_links_stop_on_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "source string, target string")
    seeds = spark.createDataFrame([("a",), ("x",)], "url string")
    found = {(r.seed, r.step): (r.url, r.reason) for r in elements.follow_links(edges, seeds, 3).collect()}
    assert found == {("a", 1): ("a", None), ("a", 2): ("b", None), ("a", 3): ("c", None), ("x", 1): (None, "chain too short")}
    assert all(r.reason for r in elements.follow_links(edges, seeds, 4).collect())


def test_identities(spark):
    p = dialogue.new_profiles()
    assert p.observe(1, "Ann", [1.0, 0.0])[0] == "Character_01"
    assert p.observe(1, None, [1.0, 0.01])[0] == "Character_01"
    assert p.observe(2, None, [0.0, 1.0])[0] == "Character_02"
    assert p.observe(3, "ann!", [0.0, 1.0])[0] == "Character_01"  # a name and a face that belong together
    assert len(p.all) == 1 and p.observe(3, None, [0.0, 1.0])[0] == "Character_01"


def test_speakers_meet_profiles_through_chapters(spark):
    blocks = [
        (1, 1, "p1", 1, "dialogue", "Ann", 10, 10), (1, 1, "p1", 2, "dialogue", None, 12, 30), (1, 1, "p2", 1, "dialogue", None, 10, 10), (1, 1, "p2", 2, "sfx", None, 10, 10),
        (1, 1, "p10", 1, "dialogue", "Bo", 10, 10), (1, 2, "p1", 1, "dialogue", None, 10, 10), (1, 2, "p2", 1, "narration", None, 10, 10), (1, 2, "p3", 1, "dialogue", None, 10, 10), (2, 1, "p1", 1, "dialogue", None, 10, 10),
    ]
    df = spark.createDataFrame(blocks, "series long, chapter long, panel string, block long, kind string, name_hint string, x int, y int").withColumns({"w": F.lit(40), "h": F.lit(10), "width": F.lit(800), "height": F.lit(1200)})
    faces = [(1, "p1", 1, [1.0, 0.0]), (1, "p2", 2, [0.0, 1.0]), (2, "p1", 3, [1.0, 0.02]), (2, "p3", 4, [0.05, 1.0])]
    near = spark.createDataFrame(faces, "chapter long, panel string, face long, signature array<double>").withColumns({"x": F.lit(20), "y": F.lit(40), "w": F.lit(60), "h": F.lit(60)})
    found = {(r.series, r.chapter, r.panel, r.block): (r.speaker, r.reason) for r in dialogue.assign_speakers(df, near).collect()}
    assert found[1, 1, "p1", 1] == ("Ann", "explicit_name") and found[1, 1, "p1", 2] == ("Ann", "nearest_known_face")
    assert found[1, 1, "p2", 1] == ("Character_02", "new_visual_profile") and found[1, 1, "p2", 2] == ("SFX", "sound_effect")
    assert found[1, 1, "p10", 1] == ("Bo", "explicit_name_no_face")
    assert found[1, 2, "p1", 1] == ("Ann", "nearest_known_face") and found[1, 2, "p2", 1] == ("Narrator", "caption_or_edge_text") and found[1, 2, "p3", 1] == ("Character_02", "nearest_known_face")
    assert found[2, 1, "p1", 1][1] == "new_visual_profile"  # the other series' face of this chapter and panel is no profile here


def test_dialogue_blocks_in_full(spark):
    words = [(1, 0, 0, 0, 0, 50, 16, 90, k, t) for k, t in enumerate(["Ann:", "hello", "there", "friend"])] + [(2, 0, 0, 0, 0, 50, 16, 60, 0, "Hey")]
    words = spark.createDataFrame([(p, v, n, 60 * k, y, w, h, c, k, t) for p, v, n, x, y, w, h, c, k, t in words], "panel_id long, variant int, line_num int, x int, y int, w int, h int, conf int, pos int, text string")
    other = spark.createDataFrame([(1, "not used", 0, 90, 50, 16, 99.0), (2, "Hey", 0, 0, 50, 16, 99.0), (2, "what is going on here", 0, 100, 200, 16, 40.0), (3, "only engine two saw me", 0, 0, 50, 16, 80.0)], "panel_id long, text string, x int, y int, w int, h int, conf double")
    panels = spark.createDataFrame([(1, 400, 200.0, 0.0, 0.6, False), (3, 100, 50.0, 0.9, 0.0, True)], "panel_id long, height int, mean double, shade_ratio double, light_ratio double, is_dark boolean")
    found = sorted((r.panel_id, r.order, r.text, r.box_style, r.kind) for r in dialogue.dialogue_blocks(words, fallback=other, panels=panels).collect())
    assert [f[0] for f in found] == [1, 2, 2, 3]  # the copy of "Hey" goes, panel 1 is read well enough
    assert found[0][3] == "light_bubble" and found[3][3:] == ("dark_caption", "narration") and found[1][3] == "mixed"



def png(width, height, grey):
    raw = b"".join(b"\0" + bytes([grey(x, y) for x in range(width)]) for y in range(height))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_pictures_from_files(spark, tmp_path):
    for name, level in (("page-2.png", 10), ("page-10.png", 200), ("copy.png", 10), ("tiny.png", 0)):
        size = 5 if name == "tiny.png" else 32
        (tmp_path / name).write_bytes(png(size, size, lambda x, y, level=level: level if x < 16 else 255 - level))
    (tmp_path / "broken.png").write_bytes(b"no image")
    pictures = files.images(spark, str(tmp_path))
    assert pictures.count() == 3
    assert files.row_profiles(pictures).count() == 96
    kept = files.clean_pages(files.panel_stats(pictures)).orderBy("seq").collect()
    assert [r.name for r in kept] == ["copy.png", "page-10.png"]
    assert files.page_files(spark, str(tmp_path)).count() == 5


def test_writers_round_trip(spark, tmp_path):
    boxes = spark.createDataFrame([(i, a, a % 2, 50.0 * a, 50.0, 100.0, 100.0, 800.0, 600.0) for i in range(20) for a in range(3)], "image_id long, ann_id int, class_id int, x double, y double, w double, h double, img_w double, img_h double")
    labels = dataset.dataset_export(boxes)
    writers.write_yolo_labels(labels, str(tmp_path / "y"))
    assert files.yolo_labels(spark, str(tmp_path / "y/labels")).count() == 60
    writers.save_state(labels.limit(5), str(tmp_path / "s"), 2)
    writers.save_state(labels.limit(3), str(tmp_path / "s"), 1)  # an older batch that comes late
    assert writers.latest_state(spark, str(tmp_path / "s")).count() == 5


def test_entry_has_sql_columns():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_signatures_within_reach_are_those_of_all_pairs(spark):
    """Clusters of directions: what the pivots skip is never near enough."""
    pick = np.random.default_rng(3)
    centres = pick.normal(size=(12, 16))
    known = (centres[pick.integers(0, 12, 400)] + pick.normal(size=(400, 16)) * 0.2).astype(float)
    asked = (centres[pick.integers(0, 12, 300)] + pick.normal(size=(300, 16)) * 0.2).astype(float)
    unit = [m / np.sqrt((m * m).sum(1))[:, None] for m in (asked, known)]
    left, right, d, compared = dedupe.nearest_within(*unit, 0.18)
    every = 1 - unit[0] @ unit[1].T
    assert sorted(zip(left.tolist(), right.tolist())) == list(zip(*(x.tolist() for x in np.nonzero(every <= 0.18))))
    assert compared < 0.25 * every.size
    rows = [("s", i, v.tolist()) for i, v in enumerate(asked)] + [("t", 900, [1.0]), ("s", 901, None), ("s", 902, [0.0] * 16)]
    faces = spark.createDataFrame(rows, "series string, face long, signature array<double>")
    profiles = spark.createDataFrame([("s", f"p{i}", v.tolist()) for i, v in enumerate(known)], "series string, profile_id string, signature array<double>")
    got = {r.face: (r.profile_id, r.confidence) for r in dedupe.signature_match(faces, profiles, "series").collect()}
    for i, row in enumerate(every):
        best = int(row.argmin())
        if row[best] <= 0.18:
            assert got[i][0] == f"p{best}" and abs(got[i][1] - (1 - row[best] / 0.18)) < 1e-9
        else:
            assert i not in got
    assert not {900, 901, 902} & set(got) and dedupe.signature_match(faces.limit(0), profiles, "series").collect() == []


def test_seams_of_packed_edges(spark):
    """Every overlap against its definition, with a page too short, one that lacks a row, and a flat one."""
    pick = np.random.default_rng(5)
    pages = {0: pick.random((30, 6)), 1: pick.random((24, 6)), 2: pick.random((5, 6)), 3: np.full((30, 6), 0.5), 4: np.full((30, 6), 0.5), 5: pick.random((30, 6))}
    pages[1][:10] = pages[0][-10:]
    rows = [("s", p, y, len(m), r.tolist(), (r > 0.5).astype(float).tolist()) for p, m in pages.items() for y, r in enumerate(m) if (p, y) != (5, 3)]
    df = spark.createDataFrame(rows, "strip_id string, seq long, y int, height int, vec array<double>, edge_vec array<double>")
    found = {(r.seq, r.k): r for r in dedupe._overlaps(df, 12, 2, 2).collect()}
    want = {}
    for p in range(1, 6):
        for k in range(min(12, len(pages[p]), len(pages[p - 1])), 1, -2):
            if p != 5 or k <= 3:
                want[p, k] = np.abs(pages[p][:k] - pages[p - 1][-k:]).mean()
    assert found.keys() == want.keys() and all(abs(found[k].d - v) < 1e-12 for k, v in want.items())
    best = {r.seq: (r.overlap, r.score) for r in dedupe.seam_overlaps(df, most=12, least=2, step=2).collect()}
    assert best[1][0] == 10 and best[4] == (0, 0.0) and sorted(best) == [1, 2, 3, 4, 5]
    first = {r.seq: r.overlap for r in dedupe.seam_first_fit(df, most=12, least=2, step=2).collect()}
    assert first[1] == 10 and first[4] == 12
    assert dedupe.seam_overlaps(df.limit(0)).collect() == []


def _panel(bands, width=200, paper=255):
    """A picture of bands: rows, or a list of widths of ink with paper of 8 between, of grey 150."""
    rows = []
    for height, parts in bands:
        row = np.full(width, paper if parts else 255 - paper if paper < 128 else paper, np.uint8)
        at = 0
        for w in parts or []:
            row[at : at + w] = 150 if paper == 255 else 20
            at += w + 8
        rows += [row] * height
    return np.array(rows)


def test_scenes_inside_a_panel(spark):
    grid = _panel([(90, [200]), (10, None), (90, [96, 96]), (10, None), (100, [60, 62, 62])])
    want = [("p_s01", 1, 0, 0, 3, 200, 87), ("p_s02_x01", 2, 1, 3, 103, 93, 187), ("p_s02_x02", 2, 2, 107, 103, 197, 187)]
    want += [(f"p_s03_x0{k}", 3, k, a + 3, 203, b - 3, 297) for k, (a, b) in enumerate([(0, 60), (68, 130), (138, 200)], 1)]
    assert subscenes.split_panel("p", grid.astype(float)) == want
    negative = 255 - _panel([(90, [200]), (10, None), (110, [200])]).astype(float)
    negative[negative == 105] = 30
    assert [r[0] for r in subscenes.split_panel("p", negative)] == ["p_s01", "p_s02"]
    assert subscenes.split_panel("p", np.full((300, 200), 150.0)) == []  # no white rows
    assert subscenes.split_panel("p", grid[:150].astype(float)) == []  # too low to be split
    # Bands that are all too short: the stretches rich in edges part the panel.
    noisy = np.full((400, 200), 250.0)
    for top in (20, 220):
        noisy[top : top + 150, ::4] = 0
        noisy[top + 60 : top + 64] = 255
        noisy[top + 62 : top + 64, ::4] = 255
    spread = subscenes._spread(noisy)
    assert len(spread) == 2 and all(abs(a - t) < 12 and abs(b - t - 150) < 12 for (a, b), t in zip(spread, (20, 220)))
    df = spark.createDataFrame([("x/p.png", 200, 300, 1, grid.tobytes())], "path string, width int, height int, channels int, data binary")
    assert [tuple(r)[1:] for r in subscenes.panel_scenes(df).collect()] == want and subscenes.panel_scenes(df.limit(0)).collect() == []


def test_manifests_are_changed_in_place(spark, tmp_path):
    rows = [("a", 0, "x.png", 5, 0, 5), ("a", 1, "y.png", 7, 5, 12), ("b", 0, "z.png", 3, 0, 3)]
    path = str(tmp_path / "m")
    writers.write_manifest(spark.createDataFrame(rows, "strip_id string, index long, source string, height long, y_start long, y_end long"), path)
    first = {f.name: f.read_bytes() for f in (tmp_path / "m" / "change=0").glob("part-*")}
    kind = f"strip_id string, panels array<{writers.RANGE}>"
    for panels in ([("p0", 0, 5)], [("p1", 0, 12)], [("p1", 0, 12)]):  # the last one is done again
        writers.update_manifests(spark, path, spark.createDataFrame([("a", panels), ("none", panels)], kind), 2 if panels[0][0] == "p1" else 1)
    got = {r.strip_id: r for r in writers.manifests(spark, path).collect()}
    assert sorted(got) == ["a", "b"] and [tuple(p) for p in got["a"].panels] == [("p1", 0, 12)] and got["a"].scenes is None
    assert [s.source for s in got["a"].sections] == ["x.png", "y.png"] and got["a"].canvas_height == 12 and got["b"].panels is None
    assert {f.name: f.read_bytes() for f in (tmp_path / "m" / "change=0").glob("part-*")} == first


def test_stitch_chain(spark):
    """Two pages that share rows, one of another width, and a strip of one narrow page."""
    pick = np.random.default_rng(1)
    first, second = pick.random((40, 8)), pick.random((30, 8))
    second[:12] = first[-12:]
    both = {("a", 0): first, ("a", 1): second, ("a", 2): pick.random((20, 8)), ("b", 0): pick.random((25, 8))}
    rows = [(s, p, y, len(m), r.tolist(), (r > 0.5).astype(float).tolist(), float(r.mean() * 255), 0.1) for (s, p), m in both.items() for y, r in enumerate(m)]
    df = spark.createDataFrame(rows[:-2], "strip_id string, seq long, y int, height int, vec array<double>, edge_vec array<double>, row_mean double, edge_density double")
    pages = spark.createDataFrame([("a", 0, 600, 40), ("a", 1, 600, 30), ("a", 2, 1200, 40), ("b", 0, 100, 6)], "strip_id string, seq long, width int, height int")
    limits = {"most": 30, "shortest": 10, "before": 5, "after": 2, "margin": 5}
    number = F.when(F.col("strip_id") == "a", 1).otherwise(2).cast("long")
    pages, df = pages.withColumn("strip_id", number), df.withColumn("strip_id", number)
    docs = {r.strip_id: r for r in stitching.stitch_chain(pages, df, seams={"most": 16, "least": 4, "step": 4}, parts=limits)[2].collect()}
    a, b = docs[1], docs[2]
    assert (a.canvas.width, a.canvas.height, a.format, a.tiles) == (600, 78, "manga", True)
    assert [(s.seq, s.overlap, s.y_start, s.y_end) for s in a.sections] == [(0, 0, 0, 40), (1, 12, 40, 58), (2, 0, 58, 78)]
    assert a.parts[0].y_start == 0 and a.parts[-1].y_end == 78 and all(x.y_end == y.y_start for x, y in zip(a.parts, a.parts[1:]))
    assert (b.canvas.width, b.canvas.height, b.tiles) == (400, 24, True) and len(b.parts) == 1
    assert stitching.stitch_chain(pages.limit(0), df)[2].collect() == []


def test_manifest_of_scenes(spark):
    rows = [("a", 0, 100, "day", False, 2, 0.5, 10.0), ("a", 100, 300, "night", False, 1, 0.7, 30.0), ("a", 300, 350, "night", True, 9, 0.1, 1.0), ("b", 0, 9, "day", True, 1, 0.2, 2.0)]
    df = spark.createDataFrame(rows, "strip_id string, start int, end int, scene_type string, rejected boolean, bubbles long, quality double, contrast double")
    got = {r.strip_id: r.asDict() for r in sequence.scene_manifest(df).collect()}
    assert got["a"] == {"strip_id": "a", "scenes": 3, "kept": 2, "rejected": 1, "night": 1, "bubbles": 3, "quality": 0.6, "contrast": 20.0, "height": 150.0}
    assert got["b"] == {"strip_id": "b", "scenes": 1, "kept": 0, "rejected": 1, "night": 0, "bubbles": 0, "quality": None, "contrast": None, "height": None}
    assert sequence.scene_manifest(df.limit(0)).collect() == []


def test_pictures_are_written_and_read(spark, tmp_path):
    colour = np.arange(12 * 10 * 3, dtype=np.uint8).tobytes()
    rows = [("a/c.png", 12, 10, 3, colour), ("g.png", 10, 10, 1, bytes(range(100))), ("s.png", 4, 10, 1, bytes(40)), ("w.webp", 1, 1, 1, b"RIFF"), ("b.jpg", 1, 1, 1, b"no jpeg")]
    df = spark.createDataFrame(rows, "path string, width int, height int, channels int, data binary")
    assert pictures.write_pictures(df, str(tmp_path)).count() == 5
    got = {r.path.rsplit("/", 1)[-1]: (r.width, r.height, bytes(r.data)) for r in files.images(spark, str(tmp_path)).collect()}
    assert got == {"c.png": (12, 10, colour), "g.png": (10, 10, bytes(range(100)))}
    told = {r.path.rsplit("/", 1)[-1]: r.problem for r in files.image_report(spark, str(tmp_path)).collect()}
    assert told == {"c.png": None, "g.png": None, "s.png": "too_small", "w.webp": "unknown_format", "b.jpg": "unreadable"}
