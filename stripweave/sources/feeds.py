"""The tables that operators read, derived from the shared test tables by arithmetic, each over its whole source.

The SQL is what both engines understand, so that a feed is the same on either side of a comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stripweave.operators.folds import parts
from stripweave.session import stored

#: Fixed value: strips that one task makes rows of.
STRIPS_EACH = 256

FEEDS = {
    "boxes": (
        "lineitem",
        "SELECT l_orderkey AS image_id, l_linenumber AS ann_id, CAST(l_suppkey % 6 AS INT) AS class_id, CAST(l_partkey % 700 AS DOUBLE) AS x, CAST((l_suppkey * 7) % 500 AS DOUBLE) AS y, "
        "l_quantity * 5 - 20 AS w, l_quantity * 4 - 20 AS h, CAST(800 AS DOUBLE) AS img_w, CAST(600 AS DOUBLE) AS img_h FROM lineitem",
    ),
    "attempts": (
        "events",
        "SELECT ts, event_id AS attempt_id, concat('site', CAST(user_id % 20 AS STRING)) AS domain, event_type AS method, concat('arm', CAST(user_id % 7 AS STRING)) AS arm, value < 60 AS success, "
        "event_type = 'error' AS blocked, value AS duration FROM events",
    ),
    "jobs": ("events", "SELECT event_id, ts, user_id AS job_id, event_type AS status, CAST(event_id % 101 AS INT) AS progress, user_id % 10 AS batch_id FROM events"),
    "words": (
        "documents",
        None,
    ),
    "blocks": (
        "conversations",
        "SELECT conv_id % 10 AS series, conv_id AS chapter, concat('p', CAST(turn AS STRING)) AS panel, turn AS block, text, role AS speaker, CAST((turn * 37) % 400 AS INT) AS x, CAST((conv_id * 131 + turn * 97) % 1100 AS INT) AS y, "
        "CAST(120 + (conv_id * 7) % 200 AS INT) AS w, CAST(40 AS INT) AS h, 800 AS width, 1200 AS height, CASE turn % 3 WHEN 0 THEN 'dark_caption' WHEN 1 THEN 'light_bubble' ELSE 'mixed' END AS box_style, "
        "CASE WHEN turn % 4 = 1 THEN concat('Hero ', CAST(conv_id % 7 AS STRING)) END AS name_hint, (conv_id * 31 + turn * 17) % 100 AS confidence, (conv_id + turn) % 3 = 0 AS is_dark FROM conversations",
    ),
    "faces": (
        "embeddings",
        "SELECT vec_id % 100 AS chapter, vec_id AS face, embedding AS signature, CAST((vec_id * 53) % 700 AS INT) AS x, CAST((vec_id * 29) % 1000 AS INT) AS y, CAST(40 + vec_id % 60 AS INT) AS w, CAST(40 + vec_id % 70 AS INT) AS h FROM embeddings",
    ),
    "files": (
        "documents",
        "SELECT source AS series, concat('Chapter_', CAST(doc_id % 25 AS STRING)) AS chapter, concat('page-', CAST(doc_id AS STRING), CASE doc_id % 6 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' WHEN 2 THEN '.webp' WHEN 3 THEN '.avif' WHEN 4 THEN '.txt' ELSE '.jpg' END) AS name, "
        "n_chars AS length, doc_id, CAST(600 + (doc_id * 13) % 900 AS INT) AS width, CAST(300 + (n_chars * 7) % 5000 AS INT) AS height FROM documents",
    ),
    "chapters": ("documents", "SELECT source AS series, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INT) AS chapter, doc_id, text FROM documents"),
    "panels": (
        "part",
        "SELECT p_partkey AS panel_id, concat('c', CAST(p_partkey % 40 AS STRING)) AS chapter, CAST(p_partkey AS INT) AS seq, CAST(60 + (p_partkey * 37) % 1500 AS INT) AS width, CAST(50 + (p_partkey * 91) % (CASE p_partkey % 3 WHEN 0 THEN 4000 WHEN 1 THEN 900 ELSE 300 END) AS INT) AS height, "
        "CAST((p_partkey * 17) % 256 AS DOUBLE) AS mean, CAST((p_partkey * 7) % 90 AS DOUBLE) AS std, CAST((p_partkey * 13) % 101 AS DOUBLE) / 100 AS white_ratio, CAST((p_partkey * 29) % 101 AS DOUBLE) / 100 AS dark_ratio, "
        "CAST((p_partkey * 31) % 101 AS DOUBLE) / 100 AS light_ratio, CAST((p_partkey * 11) % (CASE p_partkey % 4 WHEN 0 THEN 8 ELSE 200 END) AS DOUBLE) / 1000 AS edge_ratio, CAST((p_partkey * 23) % 101 AS DOUBLE) / 100 AS b0, CAST((p_partkey * 41) % 101 AS DOUBLE) / 100 AS b1, "
        "CAST((p_partkey * 19) % 101 AS DOUBLE) / 100 AS ink_ratio, CAST((p_partkey * 59) % 101 AS DOUBLE) / 100 AS bright_ratio, CAST((p_partkey * 61) % 101 AS DOUBLE) / 100 AS black_ratio, CAST((p_partkey * 67) % 101 AS DOUBLE) / 100 AS uniformity, "
        "CAST((p_partkey * 53) % 100 AS DOUBLE) AS border_std, CAST((p_partkey * 71) % 1000 AS DOUBLE) AS centre_variance, CAST((p_partkey * 73) % 700 AS DOUBLE) AS rim_variance, CAST((p_partkey * 79) % 101 AS DOUBLE) / 100 AS light_share, (CAST(floor(p_partkey / 40) AS BIGINT) % 11) * 1000003 + p_partkey % 5 AS hash, "
        "CAST((p_partkey * 43) % 101 AS DOUBLE) / 100 AS b2, CAST((p_partkey * 47) % 101 AS DOUBLE) / 100 AS b3 FROM part",
    ),
    "hour_sums": (
        "events",
        "SELECT user_id AS strip_id, CAST((date_part('day', ts) - 1) * 24 + date_part('hour', ts) AS INT) AS y, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS v, count(*) AS n FROM events GROUP BY 1, 2",
    ),
}

ROW_COLUMNS = (
    "CASE WHEN n IS NULL THEN 250.0E0 ELSE CAST(v % 200 AS DOUBLE) END AS row_mean, "
    "CASE WHEN n IS NULL THEN 2.0E0 ELSE CAST((n * 13 + v) % 60 AS DOUBLE) END AS row_std, "
    "CASE WHEN n IS NULL THEN 0.001E0 ELSE CAST(v % 64 AS DOUBLE) / 512 END AS edge_density, "
    "CASE WHEN n IS NULL THEN 0.01E0 ELSE CAST(v % 32 AS DOUBLE) / 128 END AS foreground, "
    "CASE WHEN n IS NULL THEN 0.01E0 ELSE CAST(v % 256 AS DOUBLE) / 256 END AS saturation, "
    "CASE WHEN n IS NULL THEN 0.01E0 ELSE CAST((v * 7) % 64 AS DOUBLE) / 64 END AS energy, "
    "CASE WHEN n IS NULL THEN 0.5E0 ELSE CAST((v * 11) % 128 AS DOUBLE) / 128 END AS focus, "
    "CASE WHEN n IS NULL THEN 1.0E0 ELSE CAST((v * 5) % 64 AS DOUBLE) / 64 END AS white, "
    "CASE WHEN n IS NULL THEN 0.0E0 ELSE CAST((v * 3) % 64 AS DOUBLE) / 64 END AS ink, "
    "CASE WHEN n IS NULL THEN 0.0E0 ELSE CAST((v * 13) % 64 AS DOUBLE) / 64 END AS dark"
)
#: Row profiles: each user is a strip, each hour of the month a row; hours without events are blank paper.
ROWS_DUCK = f"SELECT s.strip_id, s.y, {ROW_COLUMNS} FROM (SELECT strip_id, CAST(unnest(range(720)) AS INT) AS y FROM (SELECT DISTINCT strip_id FROM hour_sums)) s LEFT JOIN hour_sums h ON s.strip_id = h.strip_id AND s.y = h.y"
#: Recognised words: every word of every document, ten to a line.
WORD_COLUMNS = (
    "doc_id AS panel_id, CAST(pos % 2 AS INT) AS variant, CAST(pos // 10 AS INT) AS line_num, CAST((pos % 10) * 60 AS INT) AS x, CAST((pos // 10) * 20 AS INT) AS y, CAST(50 AS INT) AS w, CAST(16 AS INT) AS h, "
    "(doc_id * 31 + pos * 17) % 100 AS conf, pos, text"
)
WORDS_SPARK = "SELECT " + WORD_COLUMNS.replace("//", "DIV") + " FROM (SELECT doc_id, posexplode(split(text, ' ')) AS (pos, text) FROM documents)"
WORDS_DUCK = "SELECT " + WORD_COLUMNS + " FROM (SELECT doc_id, unnest(l) AS text, unnest(range(len(l))) AS pos FROM (SELECT doc_id, string_split(text, ' ') AS l FROM documents))"
LINES_SPARK = "SELECT doc_id, source, pos, line FROM (SELECT doc_id, source, posexplode(split(text, '\\n')) AS (pos, line) FROM documents)"
LINES_DUCK = "SELECT doc_id, source, pos, line FROM (SELECT doc_id, source, unnest(l) AS line, unnest(range(len(l))) AS pos FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents))"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strip_rows(sums: DataFrame) -> DataFrame:
    """The row profiles of ``hour_sums``. A strip's hours, 720 at most, travel as one array and become rows where they arrive: the table of rows, ten times as long as that of hours,
    is neither joined nor sent, lies dealt by strip, and has as many parts as its strips need. What is joined with rows is sorted: Spark guesses their size by the arrays'."""
    own = F.col("strip_id").isNotNull() & F.col("y").between(0, 719)
    hours = F.collect_list(F.when(own, F.struct("y", "v", "n"))).alias("hours")
    strips = stored(sums.groupBy("strip_id").agg(hours))
    blank = F.array_except(F.sequence(F.lit(0), F.lit(719)), F.transform("hours", lambda h: h["y"]))
    none = F.lit(None).cast("long")
    every = F.concat("hours", F.transform(blank, lambda y: F.struct(y.alias("y"), none.alias("v"), none.alias("n"))))
    dealt = strips.repartition(-(-strips.count() // STRIPS_EACH) or 1, "strip_id")
    return dealt.select("strip_id", F.inline(every)).selectExpr("strip_id", "y", *ROW_COLUMNS.split(", ")).hint("merge")


def feed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "rows":
        return strip_rows(feed(spark, sf_dir, "hour_sums"))
    if name in ("words", "lines"):
        text = WORDS_SPARK if name == "words" else LINES_SPARK
        documents = read(spark, sf_dir, "documents")
        if name == "words":  # texts are dealt by document before they become words: groups of a document's words need no exchange, and a text weighs a twentieth of its words' rows
            documents = documents.select("doc_id", "text").repartition(parts(documents), "doc_id")
        return spark.sql(text.replace("FROM documents", "FROM {documents}"), documents=documents)
    table, text = FEEDS[name]
    return spark.sql(text.replace(f"FROM {table}", "FROM {" + table + "}"), **{table: read(spark, sf_dir, table)})


def with_feeds(sql: str, *names: str) -> str:
    """DuckDB SQL that has the named feeds before it."""
    parts = []
    for name in names:
        if name == "rows":
            parts += [f"hour_sums AS ({FEEDS['hour_sums'][1]})", f"strip_rows AS ({ROWS_DUCK})"]
        else:
            parts.append(f"{name} AS ({ {'words': WORDS_DUCK, 'lines': LINES_DUCK}.get(name) or FEEDS[name][1]})")
    sql = sql.strip()
    start = "WITH RECURSIVE " if sql.upper().startswith("WITH RECURSIVE ") else "WITH "
    rest = ", " + sql[len(start) :] if sql.upper().startswith(start) else " " + sql
    return start + ", ".join(parts) + rest
