"""Operators that SQL says badly, against plain versions of their rules."""

import json
import random
import re

import numpy as np
from pyspark.sql import functions as F

from stripweave.functions import urls
from stripweave.operators import attempts, dedupe, dialogue, elements, sequence, stories


def test_streaks_and_densities(spark):
    rnd = random.Random(4)
    data = [(f"d{rnd.randrange(3)}", k, k, rnd.random() < 0.6, rnd.random() / 4) for k in range(200)]
    frame = spark.createDataFrame(data, "domain string, ts long, attempt_id long, good boolean, density double")
    frame = frame.withColumn("ts", F.timestamp_seconds(F.col("ts") * 900))  # four to an hour
    assert attempts.quality_streak_and_density(frame.limit(0)).collect() == []
    found = {r.domain: r for r in attempts.quality_streak_and_density(frame).collect()}
    for d, r in found.items():
        streak, density = 0, 0.5
        for _, _, _, good, x in (x for x in data if x[0] == d):
            streak, density = max(-5, min(10, streak + (1 if good else -1))), 0.3 * x + 0.7 * density
        assert (r.streak, r.clean, r.fast) == (streak, streak > 2, density < 0.1) and abs(r.density - density) < 1e-12


def overlap(a, b):
    inner = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    return inner / max(1, a[2] * a[3] + b[2] * b[3] - inner)


def likeness(a, b):
    a, b = (set(re.findall("[a-z0-9]+", t.lower())) for t in (a, b))
    return len(a & b) / len(a | b) if a and b else 0.0


def test_blocks_of_nearly_one_text_stay_once(spark):
    rnd = random.Random(6)
    words = "one two three four five six seven".split()
    blocks = [(k % 2, k, rnd.randint(0, 300), rnd.randint(0, 300), rnd.randint(50, 200), rnd.randint(20, 160), float(rnd.randint(1, 9)), " ".join(words[: rnd.choice([5, 6, 7])])) for k in range(80)]
    df = spark.createDataFrame(blocks, "page int, box_id int, x int, y int, w int, h int, confidence double, text string")
    found = {r.box_id for r in dedupe.text_block_dedupe(df, "page").filter("kept").collect()}
    kept = []
    for b in sorted(blocks, key=lambda b: (-b[6], b[3], b[2], b[1])):
        if all(k[0] != b[0] or likeness(k[7], b[7]) <= 0.86 or overlap(k[2:6], b[2:6]) <= 0.18 for k in kept):
            kept.append(b)
    assert found == {b[1] for b in kept} and len(found) < 80


def test_new_signatures(spark):
    rnd = np.random.default_rng(2)
    base = rnd.normal(size=(6, 8))
    data = [(k % 2, k, (base[rnd.integers(6)] + rnd.normal(size=8) * 0.15).tolist()) for k in range(90)]
    found = {(r.series, r.face) for r in dedupe.signature_novelty(spark.createDataFrame(data, "series int, face int, signature array<double>"), "series", ["face"], last=5).collect()}
    wanted = set()
    for s in (0, 1):
        held = []
        for _, face, v in (x for x in data if x[0] == s):
            v = np.array(v)
            if all(1 - v @ u / np.linalg.norm(v) / np.linalg.norm(u) > 0.04 for _, u in held):
                held = [*held, (face, v)][-5:]
        wanted |= {(s, f) for f, _ in held}
    assert found == wanted


def test_lines_join_blocks(spark):
    rnd = random.Random(8)
    lines = [(p, 20 * rnd.randint(0, 30), 15 * rnd.randint(0, 60), rnd.randint(30, 200), 16, f"t{p}x{k}", float(rnd.randint(30, 99))) for p in range(4) for k in range(40)]
    found = sorted((r.panel_id, r.text, r.x, r.y, r.w, r.h, r.lines) for r in dialogue.line_blocks(spark.createDataFrame(lines, "panel_id int, x int, y int, w int, h int, text string, conf double")).collect())
    wanted = []
    for p in range(4):
        blocks = []
        for _, x, y, w, h, t, _ in sorted((x for x in lines if x[0] == p), key=lambda x: (x[2], x[1], x[5])):
            b = blocks[-1] if blocks else None
            if b is not None and y - b[3] <= max(24, 0.85 * h):
                shared = max(0, min(x + w, b[2]) - max(x, b[0])) / max(1, min(w, b[2] - b[0]))
                if shared > 0.15 or abs(x + w / 2 - (b[0] + b[2]) / 2) < max(80, 0.7 * w):
                    blocks[-1] = [min(b[0], x), min(b[1], y), max(b[2], x + w), max(b[3], y + h), [*b[4], t]]
                    continue
            blocks.append([x, y, x + w, y + h, [t]])
        wanted += [(p, " ".join(b[4]), b[0], b[1], b[2] - b[0], b[3] - b[1], len(b[4])) for b in blocks]
    assert found == sorted(wanted)


def test_boundaries_keep_their_spacing(spark):
    rnd = random.Random(10)
    cuts = [(s, rnd.randrange(2000), round(rnd.random() * 5, 3), f"k{k:03d}") for s in range(3) for k in range(60)]
    found = sorted((r.strip_id, r.cut, r.strength, r.kind) for r in sequence.dedupe_boundaries(spark.createDataFrame(cuts, "strip_id long, cut int, strength double, kind string"), 90).collect())
    wanted = []
    for s in range(3):
        kept = []
        for c in sorted((c for c in cuts if c[0] == s), key=lambda c: (c[1], c[3])):
            if not kept or c[1] - kept[-1][1] >= 90:
                kept.append(c)
            elif c[2] > kept[-1][2]:
                kept[-1] = c
        wanted += kept
    assert found == sorted(wanted)


def test_sources_and_scores_of_elements(spark):
    cases = [
        ({"data-src": " ", "src": "/a.png"}, "/a.png"), ({"data-src": "data:image/gif;base64,x", "data-original": "/b.jpg", "src": "/c.jpg"}, "/b.jpg"),
        ({"srcset": "/s.jpg 1x, /l.jpg 2x"}, "/l.jpg"), ({"src": ""}, None), ({}, None), ({"data-lazy-src": "/z.webp", "src": "/c.jpg"}, "/z.webp"),
    ]
    df = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(cases)], "k int, attrs map<string,string>")
    assert [r[0] for r in df.orderBy("k").select(urls.pick_src(F.col("attrs"))).collect()] == [w for _, w in cases]
    rows = [
        (["wp-manga", "x"], "", {}, [], 1, 0, 10, 40), (["x"], "Page-3", {"data-src": "a"}, ["Reader"], 6, 5, 10, 20 + 30 + 30 + 10 + 10),
        ([], "", {"data-reader-page-image": "", "data-reader-index": "2", "width": "400", "height": "600"}, [], 2, 9, 10, 80 + 40 + 25), ([], "", {"width": "399", "height": "900"}, [], 0, 0, 0, 0),
    ]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, classes array<string>, id string, attrs map<string,string>, above array<string>, depth int, idx int, total int, wanted int")
    score = urls.element_score("img", *(F.col(c) for c in ("classes", "id", "attrs", "above", "depth", "idx", "total")))
    assert all(r.score == r.wanted for r in df.withColumn("score", score).collect())


def test_selectors_by_priority_and_learned_ones(spark):
    rows = [(1, 0, "img", "a", ["c"], "", [], "u0"), (1, 1, "img", "", ["d"], "box", ["w"], "u1"), (1, 2, "img", "", ["d", "e"], "box", ["w"], "u1"), (2, 0, "img", "", ["z"], "", ["w"], "u3"), (2, 1, "p", "", ["c"], "", [], "u4")]
    df = spark.createDataFrame(rows, "page_id int, idx int, tag string, id string, classes array<string>, parent_id string, parent_classes array<string>, url string")
    fits = lambda s: sorted((r.page_id, r.idx) for r in df.filter(elements.selector_matches(F.lit(s))).collect())
    assert fits("img.d") == [(1, 1), (1, 2)] and fits("#a") == [(1, 0)] and fits(".c") == [(1, 0), (2, 1)] and fits("#box img") == [(1, 1), (1, 2)] and fits(".w img.z") == [(2, 0)]
    found = sorted((r.page_id, r.idx, r["rank"]) for r in elements.selector_priority(df, ["img.none", "img.d", "img"], F.col("url") != "u9").collect())
    assert found == [(1, 1, 1), (1, 2, 1), (2, 0, 2)]
    scored = df.withColumn("domain", F.lit("s")).withColumn("score", F.when(F.col("page_id") == 1, 90 - F.col("idx") * 50).otherwise(10))
    learned = spark.createDataFrame([("s", "img.d", True)], "domain string, selector string, learned boolean")
    assert sorted((r.page_id, r.idx, r.by) for r in elements.probe_selectors(scored, learned, 2).collect()) == [(1, 1, "learned")]
    assert sorted((r.page_id, r.idx, r.by) for r in elements.probe_selectors(scored, learned, 3).collect()) == [(1, 0, "scored")]


def test_digest_and_prompt(spark):
    text = {k: "\n".join(f"[Ann] line {k} {j} with you" for j in range(6)) if k % 5 else "no tags at all" for k in range(1, 26)}
    chapters = spark.createDataFrame([("s", k, t) for k, t in text.items()], "series string, chapter int, text string")
    names = spark.createDataFrame([("s", n, a, f, 25) for n, a, f in (("Ann", 9, 1), ("Bo", 9, 3), ("Cy", 2, 4), ("Di", 1, 5), ("Ed", 1, 2), ("Flo", 1, 7), ("Gus", 1, 8))], "series string, name string, appearances long, first_chapter int, last_seen int")
    summaries = stories.chapter_summary(chapters).withColumn("characters", F.col("chapter") % 3)
    digests = stories.context_digest(names, summaries)
    told = json.loads(digests.first().digest)
    assert told["total_chapters"] == 25 and list(told["main_characters"]) == ["Ann", "Bo", "Cy", "Ed", "Di", "Flo"] and told["main_characters"]["Bo"] == {"app": 9, "first": 3, "last": 25}
    assert told["recent_events"] == [{"ch": k, "key": f"line {k} 0 with you"[:30] + "..."} for k in (23, 24)]
    assert told["series_progression"] == [{"ch": k, "c": k % 3, "act": False} for k in (1, 11, 21)]
    panels = spark.createDataFrame([("s", 2, 0, True), ("s", 2, 1, False), ("s", 2, 2, True)], "series string, chapter int, panel int, has_text boolean")
    prompts = {r.chapter: r.prompt for r in stories.prompts(chapters, digests, stories.token_budget(chapters, 100), names, panels).collect()}
    assert "Panels with text: 2 of 3: 0, 2" in prompts[2] and "Panels with text" not in prompts[3] and "Characters: Ann (9), Bo (9), Cy (2)" in prompts[3] and prompts[2].endswith(text[2]) and "Recent chapters: " in prompts[2]


def test_seams_by_plain_means(spark):
    rnd = np.random.default_rng(14)
    pages, shared = [rnd.random((30, 12)) for _ in range(4)], {1: 9, 2: 0, 3: 12}
    pages[3] = np.full((30, 12), 0.5)  # flat
    for k, n in shared.items():
        if n:
            pages[k][:n] = pages[k - 1][30 - n :] + rnd.normal(size=(n, 12)) * 0.01
    edge = [(p > 0.6).astype(float) for p in pages]
    rows = [(1, k, y, 30, p[y].tolist(), edge[k][y].tolist()) for k, p in enumerate(pages) for y in range(30)]
    df = spark.createDataFrame(rows, "strip_id int, seq int, y int, height int, vec array<double>, edge_vec array<double>")
    found = {r.seq: (r.overlap, r.score) for r in dedupe.seam_overlaps(df, most=15, least=3, step=3).collect()}
    first = {r.seq: r.overlap for r in dedupe.seam_first_fit(df, most=15, least=3, step=3, difference=0.05).collect()}
    for k in (1, 2, 3):
        best, good, fit = (0, 0.0), None, 0
        for n in range(15, 2, -3):
            a, b, ea, eb = pages[k - 1][30 - n :], pages[k][:n], edge[k - 1][30 - n :], edge[k][:n]
            fit = fit or (n if np.abs(a - b).mean() <= 0.05 else 0)
            if a.std() >= 8 / 255 and b.std() >= 8 / 255:
                s = round(0.65 * (1 - np.abs(a - b).mean()) + 0.35 * (1 - np.abs(ea - eb).mean()), 9)
                best = (n, s) if s > best[1] else best
                good = good or ((n, s) if s >= 0.94 else None)
        assert first[k] == fit
        wanted = good or (best if best[1] >= 0.9 else (0, best[1]))
        assert found[k][0] == wanted[0] and abs(found[k][1] - wanted[1]) < 1e-8
    plan = sequence.stitch_plan(df.select("strip_id", "seq", "height").distinct(), dedupe.seam_overlaps(df, most=15, least=3, step=3))
    told = sequence.stitch_manifest(plan).first()
    assert told.tiles and told.canvas_height == 120 - told.overlap_removed and told.sections == 4 and told.overlap_removed >= 9
