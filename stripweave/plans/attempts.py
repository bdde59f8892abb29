"""Queries of the attempt operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stripweave.operators import attempts as O
from stripweave.plans.registry import query
from stripweave.sources.feeds import feed, with_feeds

METHODS = ("view", "click", "purchase", "signup", "error")


@query("domain_success_stats", with_feeds("SELECT domain, method, count(*) AS attempts, count(*) FILTER (success) AS successes, count(*) FILTER (NOT success) AS failures, round(avg(success::INT), 9) AS success_rate FROM attempts GROUP BY 1, 2", "attempts"))
def domain_success_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.domain_success_stats(feed(spark, sf_dir, "attempts"), ["domain", "method"]).withColumn("success_rate", F.round("success_rate", 9))


def _ema_sql(key: str, start: float, where: str) -> str:
    return with_feeds(f"SELECT {key}, round({start} * pow(0.7, count(*)) + sum(0.3 * duration * pow(0.7, r - 1)), 6) AS ema FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ts DESC, attempt_id DESC) AS r FROM attempts WHERE {where}) a GROUP BY {key}", "attempts")


@query("duration_ema", _ema_sql("domain, method", 100.0, "success"))
def duration_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.duration_ema(feed(spark, sf_dir, "attempts"), ["domain", "method"], 100.0, True).withColumn("ema", F.round("ema", 6))


ARM_SQL = """ordered AS (SELECT *, row_number() OVER w AS k, coalesce(sum(success::INT) OVER (PARTITION BY arm ORDER BY ts, attempt_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wins FROM attempts WINDOW w AS (PARTITION BY arm ORDER BY ts, attempt_id)),
bans AS (SELECT *, CASE WHEN success THEN NULL WHEN blocked THEN 3600 WHEN wins = 0 THEN 600 WHEN wins / greatest(k - 1, 1) < 0.2 AND k > 5 THEN 600 END AS pause, row_number() OVER (PARTITION BY arm ORDER BY ts DESC, attempt_id DESC) AS r FROM ordered),
arms AS (SELECT arm, count(*) AS requests, count(*) FILTER (success) AS successes, count(*) FILTER (NOT success) AS failures, avg(success::INT) AS success_rate, max_by(ts, k) FILTER (pause IS NOT NULL) + to_seconds(max_by(pause, k) FILTER (pause IS NOT NULL)) AS cooldown,
 5.0 * pow(0.7, count(*)) + sum(0.3 * duration * pow(0.7, r - 1)) AS ema FROM bans GROUP BY arm)"""


@query("arm_stats", with_feeds(f"WITH {ARM_SQL} SELECT arm, requests, successes, failures, round(success_rate, 9) AS success_rate, strftime(cooldown, '%Y-%m-%d %H:%M:%S') AS cooldown_end, round(ema, 6) AS ema FROM arms", "attempts"))
def arm_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.arm_stats(feed(spark, sf_dir, "attempts"))
    return rows.select("arm", "requests", "successes", "failures", F.round("success_rate", 9).alias("success_rate"), F.date_format("cooldown_end", "yyyy-MM-dd HH:mm:ss").alias("cooldown_end"), F.round("ema", 6).alias("ema"))


@query("ucb_rank", with_feeds(f"WITH {ARM_SQL}, s AS (SELECT *, coalesce(cooldown <= TIMESTAMP '2024-01-30 23:00:00', true) AS free, successes / requests + sqrt(2 * ln(sum(requests) OVER () + 1) / requests) + greatest(0, (5 - ema) * 0.1) AS score FROM arms) SELECT arm, round(score, 6) AS score, CASE WHEN free THEN row_number() OVER (PARTITION BY free ORDER BY score DESC, arm) END AS rank FROM s", "attempts"))
def ucb_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.ucb_rank(O.arm_stats(feed(spark, sf_dir, "attempts")), F.lit("2024-01-30 23:00:00").cast("timestamp_ntz")).select("arm", F.round("score", 6).alias("score"), "rank")


STREAK_SQL = """SELECT domain, streak::INT AS streak, round(density, 9) AS density, streak > 2 AS clean, density < 0.1 AS fast FROM (SELECT domain,
 list_reduce(list_prepend(0, list(CASE WHEN success THEN 1 ELSE -1 END ORDER BY ts, attempt_id)), lambda s, x: greatest(-5, least(10, s + x))) AS streak,
 list_reduce(list_prepend(0.5::DOUBLE, list(duration::DOUBLE / 500 ORDER BY ts, attempt_id)), lambda s, x: 0.7 * s + 0.3 * x) AS density FROM attempts GROUP BY 1) q"""


@query("quality_streak_and_density", with_feeds(STREAK_SQL, "attempts"))
def quality_streak_and_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feed(spark, sf_dir, "attempts").select("domain", "ts", "attempt_id", F.col("success").alias("good"), (F.col("duration") / 500).alias("density"))
    return O.quality_streak_and_density(rows).withColumn("density", F.round("density", 9))


@query("attempt_learner")
def attempt_learner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.preferred_methods(feed(spark, sf_dir, "attempts"), METHODS)


JOBS = "latest AS (SELECT job_id, max_by(status, (ts, event_id)) AS status, max(progress) AS progress, max(batch_id) AS batch_id FROM jobs GROUP BY 1)"


@query("status_feed", with_feeds(f"WITH {JOBS} SELECT job_id, status, progress, batch_id FROM latest", "jobs"))
def status_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.job_status(feed(spark, sf_dir, "jobs"))


@query("batch_outcomes", with_feeds(f"WITH {JOBS} SELECT batch_id, count(*) AS total, count(*) FILTER (status = 'purchase') AS succeeded, count(*) FILTER (status = 'error') AS failed, array_to_string(list_sort(list(DISTINCT status)), ',') AS statuses, round(avg(progress), 9) AS mean_progress FROM latest GROUP BY 1", "jobs"))
def batch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.batch_outcomes(feed(spark, sf_dir, "jobs"), "purchase", "error").withColumn("mean_progress", F.round("mean_progress", 9))


@query("last_n_ring", "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def last_n_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.last_rows(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type"), ["ts", "event_id"])


@query("processing_rates", with_feeds("SELECT chapter, round(coalesce(count(*) FILTER (width > 700) * 100.0 / nullif(count(*), 0), 0), 9) AS valid_percent, round(coalesce(count(*) FILTER (width > 700 AND std > 40) * 100.0 / nullif(count(*) FILTER (width > 700), 0), 0), 9) AS read_percent FROM panels GROUP BY 1", "panels"))
def processing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = F.count_if(F.col("width") > 700)
    rows = feed(spark, sf_dir, "panels").groupBy("chapter").agg(*O.processing_rates(valid, F.count("*"), F.count_if((F.col("width") > 700) & (F.col("std") > 40))))
    return rows.select("chapter", F.round("valid_percent", 9).alias("valid_percent"), F.round("read_percent", 9).alias("read_percent"))
