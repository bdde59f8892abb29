"""Learning from attempts: success by domain and method, arms with cooldowns and their choice by upper confidence bound, preferred
methods, and outcomes of jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stripweave.operators.folds import moving_average, ordered_fold, running_sums

ORDER = ("ts", "attempt_id")


def domain_success_stats(attempts: DataFrame, by: Sequence[str] = ("domain",)) -> DataFrame:
    ok = F.count_if("success")
    return attempts.groupBy(*by).agg(F.count("*").alias("attempts"), ok.alias("successes"), (F.count("*") - ok).alias("failures"), (ok / F.count("*")).alias("success_rate"))


def duration_ema(attempts: DataFrame, by: Sequence[str], start: float, successes_only: bool) -> DataFrame:
    """Moving average of durations, newest weighing 0.3."""
    rows = attempts.filter("success") if successes_only else attempts
    return moving_average(rows, by, F.to_date("ts"), ORDER, F.col("duration"), start)


def arm_stats(attempts: DataFrame, *, blocked_s: int = 3600, failing_s: int = 600, rate: float = 0.2, after: int = 5, start: float = 5.0) -> DataFrame:
    """Per arm: requests, successes, failures, rate, moving average of latency, and the end of the cooldown that its last failing attempt with a reason set: blocked; not one success so far; or a rate so far under ``rate`` after more than ``after`` requests."""
    rows = running_sums(attempts, ["arm"], F.to_date("ts"), ORDER, {"before": F.lit(1), "wins": F.col("success").cast("int")})
    poor = (F.col("wins") / F.greatest(F.col("before"), F.lit(1)) < rate) & (F.col("before") + 1 > after)
    pause = F.when(F.col("success"), None).when(F.col("blocked"), blocked_s).when(F.col("wins") == 0, failing_s).when(poor, failing_s)
    rows = rows.withColumn("_ban", F.when(pause.isNotNull(), F.struct(*ORDER, (F.col("ts") + F.make_dt_interval(secs=pause)).alias("until"))))
    stats = rows.groupBy("arm").agg(F.count("*").alias("requests"), F.count_if("success").alias("successes"), F.count_if(~F.col("success")).alias("failures"), (F.count_if("success") / F.count("*")).alias("success_rate"), F.max("_ban").getField("until").alias("cooldown_end"))
    return stats.join(duration_ema(attempts, ["arm"], start, False), "arm")


def ucb_rank(stats: DataFrame, now: Column) -> DataFrame:
    """Arms out of cooldown by rate + sqrt(2 ln N / n) + speed bonus; an arm never tried comes first. Arms in cooldown have a null rank."""
    total = F.sum("requests").over(Window.partitionBy(F.lit(0))) + 1
    free = F.col("cooldown_end").isNull() | (F.col("cooldown_end") <= now)
    score = F.col("successes") / F.col("requests") + F.sqrt(2 * F.ln(total) / F.col("requests")) + F.greatest(F.lit(0.0), (5 - F.col("ema")) * 0.1)
    rows = stats.withColumn("free", free).withColumn("score", F.when(F.col("requests") > 0, score).otherwise(F.lit(float("inf"))))
    place = F.row_number().over(Window.partitionBy("free").orderBy(F.desc("score"), "arm"))
    return rows.withColumn("rank", F.when(F.col("free"), place))


def clamped_sums(
    rows: DataFrame, by: Sequence[str], bucket: Column, order: Sequence[str], step: Column, low: int, high: int, name: str
) -> DataFrame:
    """``by, name``: each key's steps added up in order from 0, the sum kept in [``low``, ``high``] after each.

    One step turns x to min(h, max(l, x + a)), and so do any number of them: the steps of a bucket are three numbers, and only these
    meet. So a key's rows are spread over as many tasks as it has buckets."""
    lo, hi = F.lit(low), F.lit(high)
    kept = lambda x: F.least(hi, F.greatest(lo, x))
    steps = F.array_sort(F.collect_list(F.struct(*order, step.cast("int").alias("_s"))))
    whole = F.struct(F.lit(0).alias("a"), lo.alias("l"), hi.alias("h"))
    one = lambda f, r: F.struct((f["a"] + r["_s"]).alias("a"), kept(f["l"] + r["_s"]).alias("l"), kept(f["h"] + r["_s"]).alias("h"))
    parts = rows.groupBy(*by, bucket.alias("_bucket")).agg(F.aggregate(steps, whole, one).alias("_f"))
    inner = F.array_sort(F.collect_list(F.struct("_bucket", "_f")))
    apply = lambda x, p: F.least(p["_f"]["h"], F.greatest(p["_f"]["l"], x + p["_f"]["a"]))
    return parts.groupBy(*by).agg(F.aggregate(inner, F.lit(0), apply).alias(name))


def quality_streak_and_density(results: DataFrame, by: Sequence[str] = ("domain",)) -> DataFrame:
    """``by, streak, density, clean, fast``: a streak of good (+1) and bad (-1) results kept in [-5, 10], and the moving average of text
    density. ``results`` has ``ts, attempt_id, good, density``; both are worked out hour by hour."""
    hour = F.date_trunc("hour", F.col("ts"))
    rows = results.filter(F.coalesce(*(F.col(c).cast("string") for c in by)).isNotNull())
    streak = clamped_sums(rows, by, hour, ORDER, F.when(F.col("good"), 1).otherwise(-1), -5, 10, "streak")
    density = moving_average(rows, by, hour, ORDER, F.col("density"), 0.5).withColumnRenamed("ema", "density")
    return streak.join(density, list(by)).withColumns({"clean": F.col("streak") > 2, "fast": F.col("density") < 0.1})


def new_preference(methods: Sequence[str]) -> dict:
    return {"best": methods[0], "delay": 0.5, "wins": {}, "losses": {}, "attempts": 0, "successes": 0}


def learn(state: dict, methods: Sequence[str], method: str, success: bool, blocked: bool) -> None:
    """One attempt: a success makes a method the preferred one if it is the first, or the preferred one has no more wins than losses; a third loss
    of the preferred one moves on to the next method; being blocked adds to the delay."""
    state["attempts"] += 1
    if success:
        state["successes"] += 1
        state["wins"][method] = state["wins"].get(method, 0) + 1
        proven = state["wins"].get(state["best"], 0) > state["losses"].get(state["best"], 0)
        if method == methods[0] or not proven:
            state["best"] = method
        return
    state["losses"][method] = state["losses"].get(method, 0) + 1
    if state["best"] == method and state["losses"][method] > 2 and method in methods[:-1]:
        state["best"] = methods[methods.index(method) + 1]
    if blocked:
        state["delay"] = min(state["delay"] + 1.0, 10.0)


def preferred_methods(attempts: DataFrame, methods: Sequence[str]) -> DataFrame:
    """``domain, best, delay, attempts, successes`` after each domain's attempts in order."""
    methods = list(methods)
    finish = lambda k, s: [(k, s["best"], s["delay"], s["attempts"], s["successes"])]
    step = lambda s, r: learn(s, methods, r.method, bool(r.success), bool(r.blocked))
    return ordered_fold(attempts.select("domain", *ORDER, "method", "success", "blocked"), "domain", list(ORDER), lambda _: new_preference(methods), step, finish, "domain string, best string, delay double, attempts long, successes long")


def job_status(events: DataFrame) -> DataFrame:
    """Latest status and furthest progress of each job."""
    return events.groupBy("job_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max("progress").alias("progress"), F.max("batch_id").alias("batch_id"))


def batch_outcomes(events: DataFrame, done: str, failed: str) -> DataFrame:
    """Per batch: jobs done, failed, all, statuses seen, and the mean progress."""
    return job_status(events).groupBy("batch_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == done).alias("succeeded"), F.count_if(F.col("status") == failed).alias("failed"), F.array_join(F.array_sort(F.collect_set("status")), ",").alias("statuses"), F.avg("progress").alias("mean_progress")
    )


def last_rows(rows: DataFrame, order: Sequence[str], n: int = 100) -> DataFrame:
    """The n last rows: a report of fixed size."""
    return rows.orderBy(*(F.desc(o) for o in order)).limit(n)


def processing_rates(valid: Column, extracted: Column, read: Column) -> list[Column]:
    """Percentages that are 0 where there is nothing to divide by."""
    share = lambda a, b: F.coalesce(F.try_divide(a * 100.0, b), F.lit(0.0))
    return [share(valid, extracted).alias("valid_percent"), share(read, valid).alias("read_percent")]
