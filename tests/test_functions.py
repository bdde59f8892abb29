import re
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from stripweave.functions import geometry as G
from stripweave.functions import text as X
from stripweave.functions import urls as U
from stripweave.functions import vectors as V

NAMES = ["page-10.jpg", "page-9.jpg", "Page_2b", "10.png", "2.png", "007.png", "7.png", ""]


def values(spark, items, f, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(items)], f"k int, v {kind}")
    return [r[0] for r in df.select(f(F.col("v")).alias("x"), "k").orderBy("k").collect()]


def test_natural_key_sorts_as_people_do(spark):
    keys = values(spark, NAMES, X.natural_key)
    plain = [[int(p) if p.isdigit() else p.lower() for p in re.findall(r"[0-9]+|[^0-9]+", n)] for n in NAMES]
    found = [n for _, n in sorted(zip(keys, NAMES), key=lambda t: t[0])]
    wanted = sorted(NAMES, key=lambda n: [(0, f"{p:020d}") if isinstance(p, int) else (1, p) for p in plain[NAMES.index(n)]])
    assert [n.lstrip("0") for n in found] == [n.lstrip("0") for n in wanted]


@pytest.mark.parametrize(("text", "clean"), [("a||b  c", "aIIb c"), ("no!!!!!!", "no!!!"), (' "quoted" ', "quoted"), ("", ""), ("x,,,,,y", "x,,,y")])
def test_clean_text(spark, text, clean):
    assert values(spark, [text], X.clean_text) == [clean]


def test_noise_and_names(spark):
    assert values(spark, ["", "a", "ok", "~~==", "Hello there", None], X.is_noise) == [True, True, False, True, False, True]
    assert values(spark, ["Anna: hello", "one two three four five: hi", "hello", "Bob - yes"], X.name_hint) == ["Anna", None, None, "Bob"]


@pytest.mark.parametrize(("text", "tag"), [("STOP!", "shouting"), ("WOW", "excited"), ("damn!", "angry"), ("go!", "emphatic"), ("why?", "questioning"), ("eh?", "confused"), ("hmm...", "thoughtful"), ("sigh.", "resigned"), ("fine.", "trailing"), ("haha", "happy"), ("weep", "sad"), ("whoa", "surprised"), ("sure", "agreeing"), ("never", "disagreeing"), ("table", None)])
def test_emotions(spark, text, tag):
    assert values(spark, [text], X.emotion) == [tag]


def test_addresses(spark):
    base = "https://h.example/a/b/c?x#y"
    hrefs = ["/r", "//o.example/z", "d/e", "../u", "./v", "https://w.example/q", "?k=1", "../../../x", "a.b"]
    assert values(spark, hrefs, lambda c: U.abs_url(c, F.lit(base))) == [urljoin(base, h) for h in hrefs]
    assert values(spark, ["https://www.a.example:80/x", "a", "http://b.example"], U.domain_strip_www) == ["a.example:80", "", "b.example"]
    assert values(spark, ["x/chapter-12/p3", "x/9/8", "none"], U.chapter_number) == [12, 8, 1]
    assert values(spark, ["https://x/c-007", "https://x/{chapter}"], lambda c: U.expand_template(c, 3)) == [["https://x/c-007", "https://x/c-008", "https://x/c-009"], ["https://x/1", "https://x/2", "https://x/3"]]


def test_page_rules(spark):
    urls = ["https://a/img/1.jpg", "https://a/logo.png", "https://a/x-20x80.jpg", "data:image/png;base64,x", None, ""]
    assert values(spark, urls, U.url_is_page_generic) == [True, False, True, True, False, False]
    assert values(spark, urls, U.url_is_page_theme) == [True, False, False, False, False, False]


def test_boxes(spark):
    box = lambda *v: tuple(map(F.lit, v))
    one = spark.range(1).select(
        G.bbox_iou(box(0.0, 0.0, 10.0, 10.0), box(5.0, 5.0, 10.0, 10.0)).alias("iou"), *G.yolo_box(box(50.0, 50.0, 300.0, 200.0), F.lit(800.0), F.lit(600.0)), G.jaccard_tokens(F.lit("A b"), F.lit("b c"))
    ).first()
    assert one[0] == pytest.approx(25 / 175)
    assert tuple(round(v, 6) for v in one[1:5]) == (0.25, 0.25, 0.375, 0.333333)
    assert one[5] == pytest.approx(1 / 3)


def test_hashes_and_distances(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([], []), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(V.cosine_distance(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0, 999.0, 999.0]
    h = spark.range(1).select(V.avg_hash64(F.array(*(F.lit(float(k)) for k in range(64)))), V.hash_similarity(F.lit(7).cast("long"), F.lit(0).cast("long"))).first()
    assert h[0] == (1 << 32) - 1 and h[1] == pytest.approx(61 / 64)


def test_work_tables_are_cleared(spark):
    from pathlib import Path

    from stripweave.session import clear_work, shared_dir, stored

    assert stored(spark.range(3)).count() == 3
    here = Path(shared_dir(spark).removeprefix("file:"))
    assert any(here.iterdir())
    clear_work(spark)
    assert not here.exists() and here.parent.exists()
    assert stored(spark.range(4)).count() == 4
