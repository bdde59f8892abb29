"""Queries of duplicates and matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stripweave.functions import geometry as G
from stripweave.functions import vectors as V
from stripweave.operators import dedupe as O
from stripweave.plans.registry import greedy_sql, query
from stripweave.plans.texts import _scalar
from stripweave.sources.feeds import feed, read, with_feeds

C = F.col


def _unit() -> Column:
    return F.array_append(F.array_repeat(F.lit(0.125), 63), F.lit(0.125))


_scalar("cosine_distance", "@embeddings", ["vec_id"], lambda: {"d": F.round(V.cosine_distance(C("embedding"), _unit()), 6), "far": V.cosine_distance(C("embedding"), F.array(F.lit(1.0)))},
    "SELECT vec_id, round(1 - list_sum(list_transform(embedding, lambda x: x::DOUBLE * 0.125)) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS d, 999.0::DOUBLE AS far FROM embeddings")
_scalar("avg_hash64", "@embeddings", ["vec_id"], lambda: {"bits": F.bit_count(V.avg_hash64(C("embedding"))), "median_bits": F.bit_count(V.median_hash64(C("embedding"))), "top": V.avg_hash64(C("embedding")) < 0},
    "SELECT vec_id, len(list_filter(embedding, lambda x: x::DOUBLE > a))::INT AS bits, len(list_filter(embedding, lambda x: x::DOUBLE > m))::INT AS median_bits, embedding[1]::DOUBLE > a AS top FROM (SELECT *, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / 64 AS a, list_median(list_transform(embedding, lambda x: x::DOUBLE)) AS m FROM embeddings) e")
_scalar("hash_similarity", "@events", ["event_id"], lambda: {"s": V.hash_similarity(C("event_id"), C("user_id"))}, "SELECT event_id, 1 - bit_count(xor(event_id, user_id)) / 64 AS s FROM events")
_scalar("bbox_iou", "boxes", ["image_id", "ann_id"], lambda: {"iou": F.round(G.bbox_iou(G.box(), (F.lit(100.0), F.lit(100.0), F.lit(200.0), F.lit(200.0))), 9)}, with_feeds(
    "SELECT image_id, ann_id, round(i / greatest(1.0, w * h + 40000 - i), 9) AS iou FROM (SELECT *, greatest(0, least(x + w, 300) - greatest(x, 100)) * greatest(0, least(y + h, 300) - greatest(y, 100)) AS i FROM boxes) b", "boxes"))


@query("jaccard_tokens", with_feeds("""SELECT chapter, block, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0 END, 9) AS j
FROM (SELECT chapter, block, a, coalesce(lead(a) OVER (PARTITION BY chapter ORDER BY block), []) AS b FROM (SELECT *, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS a FROM blocks) x) y""", "blocks"))
def jaccard_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block's text with the next one's."""
    following = F.coalesce(F.lead("text").over(Window.partitionBy("chapter").orderBy("block")), F.lit(""))
    return feed(spark, sf_dir, "blocks").select("chapter", "block", F.round(G.jaccard_tokens(C("text"), following), 9).alias("j"))


#: Pages with hashes of which many differ in a few bits only.
HASHED = "SELECT concat('c', CAST(vec_id % 5 AS STRING)) AS chapter, vec_id AS seq, CAST((vec_id // 40) * 1000003 + (vec_id % 3) AS BIGINT) AS hash FROM embeddings"


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(HASHED.replace("//", "DIV").replace("FROM embeddings", "FROM {e}"), e=read(spark, sf_dir, "embeddings"))


@query("exact_hash_dedupe", f"SELECT chapter, min(seq) AS seq, hash FROM ({HASHED}) h GROUP BY chapter, hash")
def exact_hash_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.exact_hash_dedupe(_hashed(spark, sf_dir))


@query("hash_pairs", f"WITH f AS (SELECT chapter, min(seq) AS seq, hash FROM ({HASHED}) h GROUP BY chapter, hash) SELECT x.chapter, x.seq AS a, y.seq AS b FROM f x JOIN f y ON x.chapter = y.chapter AND x.seq < y.seq AND bit_count(xor(x.hash, y.hash)) <= 3")
def hash_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.hash_pairs(_hashed(spark, sf_dir))


@query("near_hash_dedupe", f"""WITH RECURSIVE h AS ({HASHED}), f AS (SELECT chapter, min(seq) AS seq, hash FROM h GROUP BY 1, 3), ranked AS (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY seq) AS n FROM f),
near AS (SELECT x.chapter, x.seq AS a, y.seq AS b FROM f x JOIN f y ON x.chapter = y.chapter AND x.seq < y.seq AND bit_count(xor(x.hash, y.hash)) <= 3), {greedy_sql("chapter", "seq")}
SELECT h.chapter, h.seq, coalesce(kept, false) AS kept FROM h LEFT JOIN greedy g ON g.chapter = h.chapter AND g.ident = h.seq""")
def near_hash_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.near_hash_dedupe(_hashed(spark, sf_dir))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feed(spark, sf_dir, "boxes").filter("w > 0 AND h > 0").groupBy("image_id", "ann_id").agg(*(F.max(c).alias(c) for c in "xywh"))
    return rows.select((C("image_id") % 500).alias("page"), (C("image_id") * 10 + C("ann_id")).alias("box_id"), *"xywh", (C("image_id") * 7 % 101).alias("confidence"))


#: The area that two boxes share, and their overlap by it.
SHARED = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"
IOU = f"({SHARED}) / greatest(1.0, a.w * a.h + b.w * b.h - ({SHARED}))"
BEST_FIRST = "row_number() OVER (PARTITION BY page ORDER BY confidence DESC, y, x, box_id) AS n"
KEPT_BOXES = "SELECT page, ident AS box_id, kept FROM greedy"


@query("box_nms", with_feeds(f"""WITH RECURSIVE d AS (SELECT image_id, ann_id, max(x) AS x, max(y) AS y, max(w) AS w, max(h) AS h FROM boxes WHERE w > 0 AND h > 0 GROUP BY 1, 2),
p AS (SELECT image_id % 500 AS page, image_id * 10 + ann_id AS box_id, x, y, w, h, image_id * 7 % 101 AS confidence FROM d), ranked AS (SELECT *, {BEST_FIRST} FROM p),
near AS (SELECT a.page, a.box_id AS a, b.box_id AS b FROM ranked a JOIN ranked b ON a.page = b.page AND a.n < b.n AND {IOU} > 0.48), {greedy_sql("page", "box_id")} {KEPT_BOXES}""", "boxes"))
def box_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.box_nms(_boxes(spark, sf_dir), "page")


@query("text_block_dedupe", with_feeds(f"""WITH RECURSIVE o AS (SELECT chapter AS page, chapter * 100 + block AS box_id, x, y, w, h, confidence, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM blocks),
p AS (SELECT * FROM o UNION ALL SELECT page, box_id + 1000000000, x, y, w, h, confidence - 1, t FROM o), ranked AS (SELECT *, {BEST_FIRST} FROM p),
near AS (SELECT a.page, a.box_id AS a, b.box_id AS b FROM ranked a JOIN ranked b ON a.page = b.page AND a.n < b.n AND {IOU} > 0.18 AND len(a.t) > 0 AND len(b.t) > 0
 AND len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) > 0.86), {greedy_sql("page", "box_id")} {KEPT_BOXES}""", "blocks"))
def text_block_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feed(spark, sf_dir, "blocks").select(C("chapter").alias("page"), (C("chapter") * 100 + C("block")).alias("box_id"), *"xywh", "confidence", "text")
    twins = rows.unionByName(rows.withColumn("box_id", C("box_id") + 1_000_000_000).withColumn("confidence", C("confidence") - 1))
    return O.text_block_dedupe(twins, "page")


@query("nearest_face", with_feeds("""SELECT chapter, block, face, score FROM (SELECT b.chapter, b.block, f.face, round(sqrt(pow(b.x + b.w / 2 - f.x - f.w / 2, 2) + pow(b.y + b.h / 2 - f.y - f.h / 2, 2)) * CASE WHEN f.y + f.h / 2 > b.y + b.h / 2 THEN 1.12 ELSE 1 END / sqrt(800.0 * 800 + 1200 * 1200) - least(0.18, f.w * f.h / 960000 * 6), 9) AS score,
row_number() OVER (PARTITION BY b.chapter, b.block ORDER BY round(sqrt(pow(b.x + b.w / 2 - f.x - f.w / 2, 2) + pow(b.y + b.h / 2 - f.y - f.h / 2, 2)) * CASE WHEN f.y + f.h / 2 > b.y + b.h / 2 THEN 1.12 ELSE 1 END / sqrt(800.0 * 800 + 1200 * 1200) - least(0.18, f.w * f.h / 960000 * 6), 12), face) AS r FROM blocks b JOIN faces f ON f.chapter = b.chapter) x WHERE r = 1 AND score <= 0.42""", "blocks", "faces"))
def nearest_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.nearest_face(feed(spark, sf_dir, "blocks"), feed(spark, sf_dir, "faces"), "chapter").withColumn("score", F.round("score", 9))


@query("top_faces", with_feeds("SELECT chapter, face, rank FROM (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY w * h DESC, face) AS rank FROM faces WHERE w * h >= 1920) f WHERE rank <= 8", "faces"))
def top_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.top_faces(feed(spark, sf_dir, "faces"), "chapter", F.lit(960_000)).select("chapter", "face", "rank")


@query("signature_match", with_feeds("""SELECT chapter, face, profile_id, round(1 - d / 0.9, 6) AS confidence FROM (SELECT a.chapter, a.face, p.face AS profile_id, 1 - list_dot_product(a.signature::DOUBLE[], p.signature::DOUBLE[]) / (sqrt(list_dot_product(a.signature::DOUBLE[], a.signature::DOUBLE[])) * sqrt(list_dot_product(p.signature::DOUBLE[], p.signature::DOUBLE[]))) AS d,
row_number() OVER (PARTITION BY a.chapter, a.face ORDER BY list_dot_product(a.signature::DOUBLE[], p.signature::DOUBLE[]) / (sqrt(list_dot_product(a.signature::DOUBLE[], a.signature::DOUBLE[])) * sqrt(list_dot_product(p.signature::DOUBLE[], p.signature::DOUBLE[]))) DESC, p.face) AS r FROM faces a JOIN faces p ON a.chapter = p.chapter AND p.face % 7 = 0 AND a.face % 7 <> 0) x WHERE r = 1 AND d <= 0.9""", "faces"))
def signature_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = feed(spark, sf_dir, "faces")
    known = faces.filter("face % 7 = 0").withColumnRenamed("face", "profile_id")
    return O.signature_match(faces.filter("face % 7 <> 0"), known, "chapter", 0.9).withColumn("confidence", F.round("confidence", 6))


@query("signature_novelty", with_feeds("""WITH RECURSIVE v AS (SELECT chapter, face, signature::DOUBLE[] AS v FROM faces), r AS (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY face) AS n FROM v WHERE list_dot_product(v, v) > 0),
g AS (SELECT chapter, n, [{'face': face, 'v': v}] AS held FROM r WHERE n = 1 UNION ALL
 SELECT r.chapter, r.n, CASE WHEN list_min(list_transform(g.held, lambda h: 1 - list_cosine_similarity(h.v, r.v))) > 0.04 THEN list_append(g.held, {'face': r.face, 'v': r.v})[-16:] ELSE g.held END FROM g JOIN r ON r.chapter = g.chapter AND r.n = g.n + 1)
SELECT chapter, unnest(list_transform(held, lambda h: h.face)) AS face FROM (SELECT chapter, arg_max(held, n) AS held FROM g GROUP BY 1) x""", "faces"))
def signature_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.signature_novelty(feed(spark, sf_dir, "faces"), "chapter", ["face"])


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of 24 rows each, all values brought to 0 to 1; the last four rows of a page are the first four of the next."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x.cast("double") + 0.5))).alias("vec"))
    page = lambda shift: e.select((C("vec_id") % 4).alias("strip_id"), F.floor(C("vec_id") / 80).alias("seq"), (F.floor(C("vec_id") / 4) % 20 + shift).cast("int").alias("y"), "vec")
    rows = page(0).unionByName(page(0).filter("y < 4").select("strip_id", (C("seq") - 1).alias("seq"), (C("y") + 20).alias("y"), "vec").filter("seq >= 0"))
    edges = F.transform("vec", lambda x: F.when(x > 0.6, 1.0).otherwise(0.0))
    return rows.withColumn("height", F.lit(24)).withColumn("edge_vec", edges)


VECTORS = """e AS (SELECT vec_id, list_transform(embedding, lambda x: greatest(0.0, least(1.0, x::DOUBLE + 0.5))) AS vec FROM embeddings),
p AS (SELECT vec_id % 4 AS strip_id, vec_id // 80 AS seq, (vec_id // 4) % 20 AS y, vec FROM e), v AS (SELECT *, list_transform(vec, lambda x: CASE WHEN x > 0.6 THEN 1.0 ELSE 0.0 END::DOUBLE) AS edge FROM (SELECT * FROM p UNION ALL SELECT strip_id, seq - 1, y + 20, vec FROM p WHERE y < 4 AND seq > 0) u),
ks AS (SELECT strip_id, seq, unnest([12, 10, 8, 6, 4, 2]) AS k FROM (SELECT DISTINCT strip_id, seq FROM v) d WHERE EXISTS (SELECT 1 FROM p WHERE p.strip_id = d.strip_id AND p.seq = d.seq - 1)),
m AS (SELECT ks.strip_id, ks.seq, k, count(*) AS n, avg(list_avg(list_transform(list_zip(h.vec, t.vec), lambda z: abs(z[1] - z[2])))) AS d, avg(list_avg(list_transform(list_zip(h.edge, t.edge), lambda z: abs(z[1] - z[2])))) AS de
FROM ks JOIN v h ON h.strip_id = ks.strip_id AND h.seq = ks.seq AND h.y < k JOIN v t ON t.strip_id = ks.strip_id AND t.seq = ks.seq - 1 AND t.y = 24 - k + h.y GROUP BY ALL),
pages AS (SELECT DISTINCT strip_id, seq FROM v WHERE seq > 0)"""


@query("seam_overlap_join", f"""WITH {VECTORS}, s AS (SELECT strip_id, seq, k, round(0.65 * (1 - d) + 0.35 * (1 - de), 9) AS s FROM m WHERE n = k),
b AS (SELECT strip_id, seq, max(k) FILTER (s >= 0.94) AS gk, arg_max(s, k) FILTER (s >= 0.94) AS gs, max(s) AS fs, arg_max(k, s) AS fk FROM s GROUP BY 1, 2)
SELECT strip_id, seq, coalesce(gk, CASE WHEN fs >= 0.9 THEN fk END, 0) AS overlap, coalesce(gs, fs, 0) AS score FROM pages LEFT JOIN b USING (strip_id, seq)""")
def seam_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.seam_overlaps(_vectors(spark, sf_dir), most=12, least=2, step=2)


@query("seam_overlap_first_fit", f"WITH {VECTORS} SELECT strip_id, seq, coalesce(max(k) FILTER (n = k AND round(d, 12) <= 0.04), 0) AS overlap FROM pages LEFT JOIN m USING (strip_id, seq) GROUP BY 1, 2")
def seam_overlap_first_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.seam_first_fit(_vectors(spark, sf_dir), most=12, least=2, step=2)


@query("seam_correlation", f"""WITH {VECTORS}, s AS (SELECT strip_id, seq, corr(a, b) AS seam FROM (SELECT t.strip_id, t.seq, unnest(t.vec) AS a, unnest(h.vec) AS b FROM v t JOIN v h ON h.strip_id = t.strip_id AND h.seq = t.seq + 1 AND h.y = t.y - 18 WHERE t.y >= 18) x GROUP BY 1, 2)
SELECT strip_id, seq, round(seam, 8) AS seam FROM s""")
def seam_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.seam_correlations(_vectors(spark, sf_dir), depth=6).withColumn("seam", F.round("seam", 8))


@query("merge_false_splits", "WITH p AS (SELECT user_id AS strip_id, event_id AS seq, value < 200 AS hit FROM events), g AS (SELECT *, coalesce(sum((NOT hit)::INT) OVER (PARTITION BY strip_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM p), f AS (SELECT *, hit AND row_number() OVER (PARTITION BY strip_id, run ORDER BY seq) % 2 = 1 AS one FROM g) SELECT strip_id, seq, one OR coalesce(lag(one) OVER (PARTITION BY strip_id ORDER BY seq), false) AS merged FROM f")
def merge_false_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(C("user_id").alias("strip_id"), C("event_id").alias("seq"), F.when(C("value") < 200, 0.97).otherwise(0.5).alias("seam"))
    return O.false_splits(rows)
