"""Ordered work on row profiles of strips: smoothing, runs, cuts, ranges and scenes.

Everything up to candidates is windows and joins; only candidates, a few hundred a strip, go through a fold in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

from stripweave.operators.folds import dealt, ordered_fold, parts, parts_for
from stripweave.session import ship, stored


def _strip() -> WindowSpec:
    return Window.partitionBy("strip_id")


def _by_y() -> WindowSpec:
    return _strip().orderBy("y")


def quiet(std: Column, edge: Column, foreground: Column) -> Column:
    return (std < 10) & (edge < 0.006) & (foreground < 0.045)


def content_rows(rows: DataFrame) -> DataFrame:
    """``content``: rows that differ from the strip's background (its 88th percentile of brightness) or have edges."""
    base = rows.groupBy("strip_id").agg(F.percentile("row_mean", F.lit(0.88)).alias("background"))
    return rows.join(base, "strip_id").withColumn("content", (F.abs(F.col("row_mean") - F.col("background")) > 9) | (F.col("edge_density") > 0.01))


def smoothed(value: str, window: int) -> Column:
    """Centred moving sum over a fixed divisor: rows beyond the ends count as 0. Even windows reach one row further back."""
    return F.sum(value).over(_by_y().rowsBetween(-(window // 2), (window - 1) // 2)) / window


def dilated(mask: Column, reach: int, more_than: int = 0) -> Column:
    """True where more than so many of the rows within reach are."""
    return F.sum(mask.cast("int")).over(_by_y().rowsBetween(-reach, reach)) > more_than


def boolean_runs(rows: DataFrame, mask: str) -> DataFrame:
    """``strip_id, start, end`` (end exclusive) of the runs of rows where the mask holds."""
    on = rows.filter(F.col(mask)).withColumn("_island", F.col("y") - F.row_number().over(_by_y()))
    return on.groupBy("strip_id", "_island").agg(F.min("y").alias("start"), (F.max("y") + 1).alias("end")).drop("_island")


def merge_close(ranges: DataFrame, gap: int = 24) -> DataFrame:
    """Ranges closer than the gap become one."""
    order = _strip().orderBy("start")
    rows = ranges.withColumn("_new", F.coalesce(F.col("start") - F.lag("end").over(order) >= gap, F.lit(True)).cast("int"))
    rows = rows.withColumn("_group", F.sum("_new").over(order))
    return rows.groupBy("strip_id", "_group").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_group")


def in_ranges(rows: DataFrame, ranges: DataFrame, into: int | None = None) -> DataFrame:
    """The rows that lie in ranges which do not overlap, with their range's ``start`` and ``end``: each row takes the last range that began, in one pass over the strip.
    ``into`` is how many parts they are dealt into."""
    marks = ranges.select("strip_id", F.col("start").alias("y"), F.lit(0).alias("_kind"), F.struct("start", "end").alias("_range"))
    both = rows.withColumn("_kind", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    both = both.repartition(into or parts(rows), "strip_id")
    both = both.withColumn("_range", F.last("_range", ignorenulls=True).over(_strip().orderBy("y", "_kind").rowsBetween(Window.unboundedPreceding, 0)))
    inside = both.filter((F.col("_kind") == 1) & (F.col("y") < F.col("_range.end")))
    return inside.withColumns({"start": F.col("_range.start"), "end": F.col("_range.end")}).drop("_kind", "_range")


def range_stats(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Each range's pooled mean and deviation (from the rows' own means and deviations), mean edge density, share of content and of white, inked and dark pixels, and what
    catches the eye. Ranges do not overlap."""
    mean, square = F.avg("row_mean"), F.avg(F.col("row_std") * F.col("row_std") + F.col("row_mean") * F.col("row_mean"))
    return in_ranges(rows, ranges, parts_for(rows)).groupBy("strip_id", "start", "end").agg(
        mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), square - mean * mean)).alias("contrast"), F.avg("edge_density").alias("edge"), F.avg("foreground").alias("content_ratio"),
        F.avg("white").alias("white_ratio"), F.avg("ink").alias("ink_ratio"), F.avg("dark").alias("dark_ratio"), F.avg("energy").alias("energy"),
    )


def content_range_ok(height: Column, white: Column, ink: Column, contrast: Column, edge: Column, least: int = 140) -> Column:
    return (height >= least) & ~(((white > 0.955) & (edge < 0.006)) | ((contrast < 14) & (edge < 0.004)) | ((ink < 0.018) & (edge < 0.0035)))


class Peaks(NamedTuple):
    """Rows that stand out by ``score(y, columns)``, which gives places of a strip's rows and their strength: at least ``least`` and the strip's percentile, and the largest within
    ``radius`` of the places."""

    kind: str
    columns: Sequence[str]
    score: Callable[[np.ndarray, dict[str, np.ndarray]], tuple[np.ndarray, np.ndarray]]
    least: float
    percentile: float
    radius: int

    def places(self, y: np.ndarray, columns: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at, strength = self.score(y, columns)
        if not len(at):
            return at, strength
        ordered, place = np.sort(strength), (len(strength) - 1) * self.percentile
        low, high = int(np.floor(place)), int(np.ceil(place))
        level = ordered[low] if ordered[low] == ordered[high] else (high - place) * ordered[low] + (place - low) * ordered[high]
        edge = np.full(self.radius, -np.inf)
        top = np.lib.stride_tricks.sliding_window_view(np.concatenate([edge, strength, edge]), 2 * self.radius + 1).max(1)
        keep = (strength >= max(self.least, level)) & (strength >= top)
        return at[keep], strength[keep]


def strip_peaks(rows: DataFrame, finders: Sequence[Peaks]) -> DataFrame:
    """``strip_id, y, kind, strength`` of all finders in one pass over sorted rows; the numbers of one strip at a time are in memory. Sliding windows over these columns took
    tens of microseconds a row."""
    ship(rows.sparkSession)
    columns = sorted({c for f in finders for c in f.columns})
    own = [rows.schema[c] for c in ("strip_id", "y")]

    def peaks(strip: pa.Table) -> Iterator[pa.RecordBatch]:
        y, numbers = strip["y"].to_numpy(), {c: strip[c].to_numpy() for c in columns}
        for f in finders:
            at, strength = f.places(y, numbers)
            found = strip.select(["strip_id", "y"]).take(pa.array(at, pa.int64()))
            yield from found.append_column("kind", pa.array([f.kind] * len(at), pa.string())).append_column("strength", pa.array(strength, pa.float64())).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last strip's rows so far
        for batch in batches:
            ids = batch["strip_id"].to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist()] if len(ids) else []
            for start, end in zip(starts, [*starts[1:], len(ids)], strict=True):
                part = batch.slice(start, end - start)
                if held and held[-1]["strip_id"][-1] != part["strip_id"][0]:
                    yield from peaks(pa.Table.from_batches(held))
                    held = []
                held.append(part)
        if held:
            yield from peaks(pa.Table.from_batches(held))

    # Sums skip what is null.
    profile = rows.filter(F.col("y").isNotNull() & F.col("strip_id").isNotNull()).select("strip_id", "y", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns))
    schema = T.StructType([*own, T.StructField("kind", T.StringType()), T.StructField("strength", T.DoubleType())])
    return dealt(profile, "strip_id", into=parts_for(rows)).sortWithinPartitions("strip_id", "y").mapInArrow(run, schema)


def _shifted(x: np.ndarray, places: int, beyond: float = 0.0) -> np.ndarray:
    """What lies so many places on, and a fixed value beyond the ends."""
    out = np.full(len(x), beyond)
    if abs(places) < len(x):
        out[max(0, -places) : len(x) - max(0, places)] = x[max(0, places) : len(x) - max(0, -places)]
    return out


def transitions(window: int = 7, offset: int = 10, least: float = 0.16, percentile: float = 0.96, radius: int = 5) -> Peaks:
    """Rows where the smoothed profile changes most."""
    weights = {"row_mean": 1 / 255, "row_std": 1 / 90, "foreground": 0.9, "edge_density": 5.0}

    def score(y: np.ndarray, columns: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros(max(0, len(y) - 2 * offset))
        for c, w in weights.items():
            smooth = sum(_shifted(columns[c], k) for k in range(-(window // 2), (window - 1) // 2 + 1)) / window
            out = out + np.abs(smooth[2 * offset :] - smooth[: len(out)]) * w
        # Rounded, so that rows of one profile tie whatever the order of summation.
        return np.arange(len(out)) + offset, np.round(out, 9)

    return Peaks("transition", list(weights), score, least, percentile, radius)


def transition_scores(rows: DataFrame, **rules: float) -> DataFrame:
    """``strip_id, y, strength`` of rows where the smoothed profile changes most (``transitions``): above the threshold and the largest within the radius."""
    return strip_peaks(rows, [transitions(**rules)]).drop("kind")


#: The features of an action beat, what each is divided by, and how much its change counts.
BEATS = (("row_mean", 1 / 255, 0.55), ("row_std", 1 / 90, 0.45), ("edge_density", 7.0, 0.70), ("foreground", 1.0, 0.55), ("saturation", 1.0, 0.85), ("energy", 3.0, 1.05), ("focus", 1.0, 1.15))


#: Fixed value: a shorter strip has no beats.
BEAT_ROWS = 420


def beat_span(width: int) -> int:
    """How many rows before and after count towards a beat, for a strip of this width."""
    return max(48, min(150, int(width * 0.45)))


def window_sums(x: np.ndarray, first: int, last: int) -> np.ndarray:
    """The sums over the rows from ``first`` to ``last`` places on, what lies beyond the strip counting as 0: differences of running sums, so that wide frames cost no more than narrow ones."""
    run = np.cumsum(x)
    upto = lambda places: _shifted(run, places, run[-1] if places >= 0 else 0.0)
    return upto(last) - upto(first - 1)


def beats(width: int = 720, least: float = 0.92, percentile: float = 0.94) -> Peaks:
    """Rows where the smoothed profile before and after differ most: the largest within a quarter of the span."""
    span = beat_span(width)
    gap, window, radius = max(8, span // 5), max(9, min(41, (span // 3) | 1)), max(12, span // 4)

    def score(y: np.ndarray, columns: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        total = int(y[-1]) + 1
        at = np.flatnonzero((y >= span) & (y < total - span)) if total >= BEAT_ROWS else np.zeros(0, np.int64)
        out = np.zeros(len(y))
        for c, scale, weight in BEATS:
            smooth = window_sums(columns[c], -(window // 2), (window - 1) // 2) / window * scale
            out = out + np.abs(window_sums(smooth, -span, -gap - 1) - window_sums(smooth, gap, span - 1)) / (span - gap) * weight
        # Rounded, so that rows of one profile tie whatever the order of summation.
        return at, np.round(out[at], 8)

    return Peaks("action_beat", [c for c, _, _ in BEATS], score, least, percentile, radius)


def action_beats(rows: DataFrame, *, width: int = 720, least: float = 0.92, percentile: float = 0.94) -> DataFrame:
    """``strip_id, y, strength`` where the smoothed profile before and after differ most: the threshold or more, and the largest within a
    quarter of the span. Strips of fewer than BEAT_ROWS rows have none."""
    return strip_peaks(rows, [beats(width, least, percentile)]).drop("kind")


def fixed_cost() -> Column:
    """What a row costs to cut at, but for its distance from the target."""
    return 0.42 * F.least(F.lit(1.0), F.col("row_std") / 55) + 0.38 * F.least(F.lit(1.0), F.col("edge_density") / 0.08) + 0.16 * F.least(F.lit(1.0), F.col("foreground"))


def stretches(rows: DataFrame, stretch: int = 64) -> DataFrame:
    """``strip_id, _part, _rows``: the rows of each stretch as one array of ``y`` and fixed cost, in order. Rows that lie dealt by strip are packed where they lie."""
    rows = rows.select("strip_id", F.floor(F.col("y") / stretch).alias("_part"), F.struct("y", fixed_cost().alias("cost")).alias("_row"))
    return rows.groupBy("strip_id", "_part").agg(F.array_sort(F.collect_list("_row")).alias("_rows"))


def safe_boundaries(candidates: DataFrame, rows: DataFrame, stretch: int = 64) -> DataFrame:
    """For each candidate (``strip_id, target, low, high``) the row of [low, high) that costs least to cut at, the first of equals. Candidates meet only the
    stretches that they reach into, each packed in one row, and keep one row of it: pairs of candidates and rows are neither sent nor sorted."""
    reached = F.sequence(F.floor(F.col("low") / stretch), F.floor((F.col("high") - 1) / stretch))
    packed = stretches(rows, stretch).repartition(parts_for(rows), "strip_id", "_part").hint("merge")
    near = candidates.filter(F.col("high") > F.col("low")).withColumn("_part", F.explode(reached)).join(packed, ["strip_id", "_part"])
    kept = [c for c in candidates.columns if c not in ("low", "high")]
    keys = [*kept, "low", "high"]
    near = near.select(*keys, F.col("_rows.y").alias("_ys"), F.col("_rows.cost").alias("_costs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):  # candidates times the rows of a stretch
                batch = whole.slice(k, 2000)
                y, cost = (batch[c].flatten().to_numpy(zero_copy_only=False) for c in ("_ys", "_costs"))
                y, size = y.astype(np.int64), np.diff(batch["_ys"].offsets.to_numpy())
                low, high, target = (np.repeat(batch[c].to_numpy(zero_copy_only=False), size) for c in ("low", "high", "target"))
                # Costs are rounded so that equal ones tie.
                cost = np.where((y >= low) & (y < high), np.round(cost + 0.04 * np.abs(y - target) / np.maximum(1, high - low), 12), np.inf)
                first = np.cumsum(size) - size
                least = np.minimum.reduceat(cost, first)
                place = np.minimum.reduceat(np.where(cost == np.repeat(least, size), y, np.iinfo(np.int64).max), first)
                out = [*(batch[c] for c in keys), pa.array(least), pa.array(place, pa.int64())]
                yield pa.RecordBatch.from_arrays(out, [*keys, "_cost", "_y"]).filter(pa.array(np.isfinite(least)))

    ship(rows.sparkSession)
    own = T.StructType([*(near.schema[c] for c in keys), T.StructField("_cost", T.DoubleType()), T.StructField("_y", T.LongType())])
    best = near.mapInArrow(run, own).groupBy(*keys).agg(F.min(F.struct("_cost", "_y")).alias("_best"))
    return best.select(*kept, F.col("_best._y").cast(rows.schema["y"].dataType).alias("cut"))


def _gutters(rows: DataFrame, least: int) -> DataFrame:
    """The quiet runs, as places to look for cuts in."""
    marked = rows.withColumn("quiet", quiet(F.col("row_std"), F.col("edge_density"), F.col("foreground")))
    runs = boolean_runs(marked, "quiet").withColumn("length", F.col("end") - F.col("start")).filter(F.col("length") >= least)
    height = rows.groupBy("strip_id").agg((F.max("y") + 1).alias("total"))
    target, strength = F.col("start") + F.floor(F.col("length") / 2), 3 + F.least(F.lit(2.0), F.col("length") / 40)
    return _wanted(runs.join(height, "strip_id"), target, F.greatest(F.lit(1), "start"), F.least(F.col("total") - 1, F.col("end")), strength, F.lit("gutter"))


def _wanted(found: DataFrame, target: Column, low: Column, high: Column, strength: Column, kind: Column) -> DataFrame:
    return found.select("strip_id", target.cast("long").alias("target"), low.cast("long").alias("low"), high.cast("long").alias("high"), strength.alias("strength"), kind.alias("kind"))


def _safest(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    return safe_boundaries(wanted, rows).select("strip_id", "cut", "strength", "kind")


def gutter_candidates(rows: DataFrame, least: int = 6) -> DataFrame:
    """``strip_id, cut, strength, kind`` in the quiet runs."""
    return _safest(_gutters(rows, least), rows)


def cut_candidates(rows: DataFrame, *, width: int = 720, beat: float = 0.92) -> DataFrame:
    """``strip_id, cut, strength, kind``: gutters, transitions and action beats of every strip, these at the safest row near them, at least one row off the strip's ends.
    All meet the rows in one join."""
    reach = beat_span(width) // 2
    total = rows.groupBy("strip_id").agg((F.max("y") + 1).alias("_total"))
    found = stored(strip_peaks(rows, [transitions(), beats(width, beat)])).join(total, "strip_id")
    turn = F.col("kind") == "transition"
    either = lambda a, b: F.when(turn, a).otherwise(b)
    low, high = F.col("y") - either(F.lit(36), F.lit(max(36, reach))), F.col("y") + either(F.lit(37), F.lit(max(37, reach + 1)))
    strength = either(1 + F.col("strength"), 1.6 + F.least(F.lit(2.2), F.col("strength")))
    peaks = _wanted(found, F.col("y"), F.greatest(F.lit(1), low), F.least(F.col("_total") - 1, high), strength, F.col("kind"))
    return _safest(_gutters(rows, 6).unionByName(peaks), rows)


def dedupe_boundaries(candidates: DataFrame, spacing: int = 180) -> DataFrame:
    """In order of place; of two closer than the spacing the stronger stays, in the place of the last kept one."""

    def step(kept: list, row: object) -> list[tuple]:
        one = (int(row.cut), float(row.strength), row.kind)
        if kept and one[0] - kept[-1][0] < spacing:
            if one[1] > kept[-1][1]:
                kept[-1] = one
            return []
        out = [(kept[-1][3] if len(kept[-1]) > 3 else row.strip_id, *kept[-1][:3])] if kept else []
        kept[:] = [one]
        return out

    finish = lambda k, kept: [(k, *kept[-1][:3])] if kept else []
    return ordered_fold(candidates.select("strip_id", "cut", "strength", "kind"), "strip_id", ["cut", "kind"], lambda _: [], step, finish, "strip_id long, cut int, strength double, kind string")


def scene_heights(width: int, total: int | None = None) -> tuple[int, int, int]:
    """Least, most and target height of scenes in strips of this width."""
    least = max(180, min(260, int(width * 1.4))) if width < 260 else max(240, min(720, int(width * 0.6)))
    least = least if total is None else min(total, least)
    return least, max(least * 3, max(2200, min(4200, int(width * 3.0)))), max(least * 2, max(1300, min(2600, int(width * 1.75))))


def scene_cuts(candidates: DataFrame, rows: DataFrame, *, least: int = 432, most: int = 2200, target: int = 1300) -> DataFrame:
    """``strip_id, start, end, start_kind, end_kind``: cuts taken greedily so that scenes have the least height. Gaps over the most height are cut at the row near
    the target height that costs least, and a tail under the least height joins the scene before. Rows pass in order; no more than ``most + least`` of
    them are held, as a gap of that height is cut in the same way whatever comes after."""

    def start(_: object) -> dict:
        return {"cuts": [], "previous": 0, "from": 0, "costs": []}

    def guard(state: dict, until: int, target_until: int) -> bool:
        """One cut in the gap before ``until``; false if there is none."""
        previous = state["previous"]
        goal, low, high = min(previous + target, target_until), max(1, previous + least), min(previous + most, until)
        if high <= low:
            return False
        y = np.arange(low, high)
        cost = np.array(state["costs"][low - state["from"] : high - state["from"]]) + 0.04 * np.abs(y - goal) / (high - low)
        found = int(y[np.argmin(np.round(cost, 12))])
        state["cuts"].append((found, "length_guard"))
        state["costs"] = state["costs"][found - state["from"] :]
        state["previous"] = state["from"] = found
        return True

    def step(state: dict, row: object) -> None:
        y = int(row.y)
        if row.is_row:
            state["costs"].append(row.cost)
            if y + 1 - state["previous"] >= most + least:
                guard(state, y, y)
            return
        if y - state["previous"] < least:
            return
        while y - state["previous"] > most and guard(state, y - least, y - least):
            pass
        if y - state["previous"] >= least:
            state["cuts"].append((y, row.kind))
            state["costs"] = state["costs"][y - state["from"] :]
            state["previous"] = state["from"] = y

    def finish(key: object, state: dict) -> list[tuple]:
        total = state["from"] + len(state["costs"])
        while total - state["previous"] > most and guard(state, total - least, total):
            pass
        cuts = [c for c in state["cuts"] if 0 < c[0] < total]
        if cuts and total - cuts[-1][0] < least:
            cuts.pop()
        edges = [(0, "strip_start"), *cuts, (total, "strip_end")]
        return [(key, a, b, ka, kb) for (a, ka), (b, kb) in zip(edges, edges[1:], strict=False)]

    lines = rows.select("strip_id", "y", F.lit(True).alias("is_row"), fixed_cost().alias("cost"), F.lit(None).cast("string").alias("kind"))
    marks = candidates.filter(F.col("cut").isNotNull()).select("strip_id", F.col("cut").cast("int").alias("y"), F.lit(False).alias("is_row"), F.lit(None).cast("double").alias("cost"), "kind")
    return ordered_fold(lines.unionByName(marks), "strip_id", ["y", "is_row", "kind"], start, step, finish, "strip_id long, start int, end int, start_kind string, end_kind string", parts_for(rows))


def trim_quiet_edges(scenes: DataFrame, rows: DataFrame, *, limit: int = 180, least: int = 60) -> DataFrame:
    """Each scene without its quiet rows at both ends, at most ``limit`` of them, never under the least height. Scenes do not overlap."""
    loud = in_ranges(rows.filter(~quiet(F.col("row_std"), F.col("edge_density"), F.col("foreground"))).select("strip_id", "y"), scenes)
    ends = loud.groupBy("strip_id", "start", "end").agg(F.min("y").alias("_first"), F.max("y").alias("_last"))
    out = scenes.join(ends, ["strip_id", "start", "end"], "left")
    top = F.greatest("start", F.least(F.col("start") + limit, F.col("end") - least, F.coalesce("_first", F.col("end"))))
    bottom = F.least("end", F.greatest(F.coalesce(F.col("_last") + 1, F.lit(0)), F.greatest(top + least, F.col("end") - limit) + 1))
    return out.withColumn("_top", top).withColumn("_bottom", bottom).drop("start", "end", "_first", "_last").withColumnsRenamed({"_top": "start", "_bottom": "end"})


def split_long(ranges: DataFrame, rows: DataFrame, *, most: int = 3200, target: int = 2600, reach: int = 500, margin: int = 900) -> DataFrame:
    """Ranges over the most height, cut near the target height where the profile is nearest the background and has least edges, ``margin`` rows off both ends, until
    no part is too long; where the margins leave no room, at the most height. One pass over the rows of long ranges."""
    if margin < 1 or target - reach <= 2 * reach:
        raise ValueError("the stretches that cuts are looked for in must follow each other")
    base = rows.groupBy("strip_id").agg(F.percentile("row_mean", F.lit(0.88)).alias("background"))
    cost = rows.join(base, "strip_id").select("strip_id", "y", F.round(F.abs(F.col("row_mean") - F.col("background")) / 255 + 3 * F.col("edge_density"), 12).alias("cost"))
    long = ranges.filter(F.col("end") - F.col("start") > most).select("strip_id", "start", "end")
    into = parts_for(rows)
    lines = in_ranges(cost, long, into).withColumn("range_key", F.concat_ws(":", "strip_id", "start"))

    def start(_: object) -> dict:
        return {"at": None, "best": None}

    def step(state: dict, row: object) -> list[tuple]:
        if state["at"] is None:
            state["at"] = int(row.start)
        out, end = [], int(row.end)
        while end - state["at"] > most:
            at = state["at"]
            low, high = max(at + margin, at + target - reach), min(end - margin, at + target + reach)
            if high <= low:
                cut = min(at + most, end)
            else:
                if low <= row.y < high and (state["best"] is None or row.cost < state["best"][0]):
                    state["best"] = (row.cost, int(row.y))
                if row.y < high - 1:
                    break
                cut = state["best"][1]
            out.append((row.strip_id, at, cut, end))
            state["at"], state["best"] = cut, None
        state["last"] = (row.strip_id, state["at"], end, end)
        return out

    finish = lambda _, state: [state["last"]]
    parts = ordered_fold(lines, "range_key", ["y"], start, step, finish, "strip_id long, start int, end int, _whole int", into).select("strip_id", "start", "end")
    return ranges.filter(F.col("end") - F.col("start") <= most).select("strip_id", "start", "end").unionByName(parts)


def content_panels(rows: DataFrame, *, reach: int = 2, shortest: int = 80, gap: int = 24, most: int = 3200, target: int = 2600, near: int = 500, margin: int = 900, least: int = 140) -> DataFrame:
    """Content ranges of every strip: content rows, dilated, as runs of ``shortest`` rows or more, close ones merged, long ones split, blank ones dropped. Rows are read four times."""
    marked = content_rows(rows).withColumn("_mask", dilated(F.col("content"), reach))
    runs = boolean_runs(marked, "_mask").filter(F.col("end") - F.col("start") >= shortest)
    ranges = stored(split_long(stored(merge_close(runs, gap)), rows, most=most, target=target, reach=near, margin=margin))
    stats = range_stats(rows, ranges)
    return stats.filter(content_range_ok(F.col("end") - F.col("start"), F.col("white_ratio"), F.col("ink_ratio"), F.col("contrast"), F.col("edge"), least))


def scene_detection(rows: DataFrame, bubbles: DataFrame | None = None, *, width: int = 720, spacing: int = 180, beat: float = 0.92, least: int | None = None, most: int | None = None, target: int | None = None, trim: int = 180) -> DataFrame:
    """Scenes of every strip, trimmed, with their statistics, type, bubbles, frame, and whether they are of use.

    ``bubbles`` (``strip_id, box_id, x, y, width, height``) that reach into a scene are counted with it; ``cut_bubbles`` reach beyond it, and ``bubble_share`` is the share of
    the scene that boxes, a twentieth wider at each side, cover (boxes over each other count twice, up to the whole). Density, detail and quality come from the
    row profile. Blank ranges are left out; ``rejected`` marks scenes of little but dialogue. Rows are read several times: a table, or cheap to make.
    """
    from stripweave.functions.geometry import shape_family
    from stripweave.operators.panels import scene_reject, scene_type

    heights = scene_heights(width)
    least, most, target = (own or default for own, default in zip((least, most, target), heights, strict=True))
    cuts = stored(dedupe_boundaries(cut_candidates(rows, width=width, beat=beat), spacing))
    scenes = stored(trim_quiet_edges(scene_cuts(cuts, rows, least=least, most=most, target=target), rows, limit=trim, least=least))
    stats = range_stats(rows, scenes).filter((F.col("end") - F.col("start") >= least) & ~((F.col("contrast") < 9) & (F.col("edge") < 0.003) & (F.col("content_ratio") < 0.02)))
    stats = stats.join(scenes, ["strip_id", "start", "end"]).withColumn("scene_type", scene_type(F.col("mean"), F.col("dark_ratio")))
    height = F.col("end") - F.col("start")
    if bubbles is None:
        stats = stats.withColumns({"bubbles": F.lit(0).cast("long"), "cut_bubbles": F.lit(0).cast("long"), "bubble_share": F.lit(0.0)})
    else:
        met = overlapping(bubbles, scenes)
        pad = lambda c: F.greatest(F.lit(2), F.least(F.lit(18), F.floor(F.col(c) / 20)))
        across = F.least(F.lit(width), F.col("x") + F.col("width") + pad("width")) - F.greatest(F.lit(0), F.col("x") - pad("width"))
        down = F.least(height, F.col("scene_y") + F.col("height") + pad("height")) - F.greatest(F.lit(0), F.col("scene_y") - pad("height"))
        beyond = (F.col("x") < 0) | (F.col("x") + F.col("width") > width) | (F.col("scene_y") + F.col("height") > height)
        sums = met.groupBy("strip_id", "start", "end").agg(F.count("*").alias("bubbles"), F.count_if(beyond).alias("cut_bubbles"), F.sum(F.greatest(F.lit(0), across) * F.greatest(F.lit(0), down)).alias("_area"))
        stats = stats.join(sums, ["strip_id", "start", "end"], "left").na.fill(0, ["bubbles", "cut_bubbles"])
        stats = stats.withColumn("bubble_share", F.round(F.least(F.lit(1.0), F.coalesce("_area", F.lit(0)) / (height * width)), 4)).drop("_area")
    density = F.least(F.lit(1.0), F.col("energy") * (1 - 0.88 * F.col("bubble_share")) / 0.16)
    quality = F.least(F.lit(1.0), 0.46 + 0.28 * density + 0.16 * F.least(F.lit(1.0), F.col("energy")) + 0.1 * F.least(F.lit(1.0), F.col("contrast") / 72))
    stats = stats.withColumns({"density": F.round(density, 3), "quality": F.round(quality, 3), "shape": shape_family(F.lit(width), height)["name"]})
    return stats.withColumn("rejected", scene_reject(F.col("bubble_share"), F.col("cut_bubbles"), F.col("density"), F.col("quality"), F.lit(1.0)))


def scene_manifest(scenes: DataFrame) -> DataFrame:
    """Per strip: scenes, kept and rejected ones, those at night, bubbles, and averages over the kept ones."""
    kept = ~F.col("rejected")
    mean = lambda c: F.avg(F.when(kept, F.col(c)))
    return scenes.groupBy("strip_id").agg(
        F.count("*").alias("scenes"), F.count_if(kept).alias("kept"), F.count_if(F.col("rejected")).alias("rejected"), F.count_if(kept & (F.col("scene_type") == "night")).alias("night"),
        F.sum(F.when(kept, F.col("bubbles")).otherwise(0)).alias("bubbles"), mean("quality").alias("quality"), mean("contrast").alias("contrast"), F.avg(F.when(kept, F.col("end") - F.col("start"))).alias("height"),
    )


def overlapping(boxes: DataFrame, scenes: DataFrame, bucket: int = 64) -> DataFrame:
    """Boxes (``strip_id, box_id, y, height``) with the scenes they reach into, joined by strip and stretch of rows: ``scene_y`` is the box's place in the scene."""
    spans = lambda low, high: F.explode(F.sequence(F.floor(low / bucket), F.floor((high - 1) / bucket)))
    left = boxes.filter("height > 0").withColumn("_part", spans(F.col("y"), F.col("y") + F.col("height")))
    right = scenes.select("strip_id", "start", "end").withColumn("_part", spans(F.col("start"), F.col("end")))
    met = left.join(right, ["strip_id", "_part"]).filter((F.col("y") < F.col("end")) & (F.col("y") + F.col("height") > F.col("start")))
    # A pair that meets in several stretches is taken in the first of them.
    met = met.filter(F.col("_part") == F.floor(F.greatest("y", "start") / bucket))
    return met.drop("_part").withColumn("scene_y", F.greatest(F.lit(0), F.col("y") - F.col("start")))


def manifest_by_place(cuts: DataFrame, ranges: DataFrame) -> DataFrame:
    """The n-th cut of each strip with its n-th range; a cut without one has nulls."""
    n = lambda rows, *order: rows.withColumn("_n", F.row_number().over(_strip().orderBy(*order)))
    return n(cuts, "name").join(n(ranges, "start"), ["strip_id", "_n"], "left").drop("_n")


def visual_focus(rows: DataFrame, by: Sequence[str], weight: Column, x: Column, default: float) -> DataFrame:
    """Weighted centre of each group; the default where nothing weighs."""
    return rows.groupBy(*by).agg(F.coalesce(F.try_divide(F.sum(weight * x), F.sum(weight)), F.lit(default)).alias("focus"))


def part_cuts(sections: DataFrame, rows: DataFrame, *, most: int = 14_000, share: float = 0.55, shortest: int = 1600, before: int = 900, after: int = 300, margin: int = 1000) -> DataFrame:
    """``strip_id, part, start, end``: parts of at most the given height, each ending at the last section end (``y_end``) between ``share`` and the whole of it, at least
    ``shortest`` rows on; where there is none, at the brightest row with the fewest edges near the limit. Rows pass in order; only the best one is held."""
    shortest = max(shortest, int(most * share))

    def start(_: object) -> dict:
        return {"at": 0, "section": None, "best": None, "part": 0, "total": 0}

    def close(state: dict, key: object, cut: int) -> tuple:
        state["part"] += 1
        out = (key, state["part"], state["at"], cut)
        state.update(at=cut, section=None, best=None)
        return out

    def step(state: dict, row: object) -> list[tuple]:
        y, total = int(row.y), int(row.total)
        state["total"] = total
        if total - state["at"] <= most:
            return []
        ideal = state["at"] + most
        if not row.is_row:
            if state["at"] + shortest <= y <= ideal:
                state["section"] = y
            return []
        if y >= ideal and state["section"] is not None:
            return [close(state, row.strip_id, state["section"])]
        low, high = max(state["at"] + margin, ideal - before), min(total - 1, ideal + after)
        if low <= y < high and (state["best"] is None or row.worth > state["best"][0]):
            state["best"] = (row.worth, y)
        if y >= max(high - 1, ideal) and state["section"] is None:
            return [close(state, row.strip_id, state["best"][1] if high > low else ideal)]
        return []

    def finish(key: object, state: dict) -> list[tuple]:
        out = [close(state, key, state["section"])] if state["total"] - state["at"] > most and state["section"] is not None else []
        return out + ([close(state, key, state["total"])] if state["total"] > state["at"] else [])

    totals = rows.groupBy("strip_id").agg((F.max("y") + 1).alias("total"))
    lines = rows.select("strip_id", "y", F.lit(True).alias("is_row"), F.round(F.col("row_mean") / 255 - 2.5 * F.col("edge_density"), 12).alias("worth"))
    marks = sections.select("strip_id", F.col("y_end").cast("int").alias("y"), F.lit(False).alias("is_row"), F.lit(None).cast("double").alias("worth"))
    both = lines.unionByName(marks).join(totals, "strip_id").filter((F.col("y") > 0) | F.col("is_row"))
    return ordered_fold(both, "strip_id", ["y", "is_row"], start, step, finish, "strip_id long, part int, start int, end int")


def white_level(rows: DataFrame) -> DataFrame:
    """Per strip the brightness above which a row is paper: its 95th percentile, kept in [180, 250]."""
    return rows.groupBy("strip_id").agg(F.greatest(F.lit(180.0), F.least(F.lit(250.0), F.percentile("row_mean", F.lit(0.95)))).alias("paper"))


def webtoon_panels(rows: DataFrame, *, window: int = 3, least: int | None = None, gap: int | None = None, padding: int = 10, margin: int = 50, most: int = 1600, shortest: int = 100) -> DataFrame:
    """``strip_id, start, end, by``: panels between rows of paper.

    Rows darker than paper, smoothed over ``window`` rows, make runs; those closer than ``gap`` are one, their pale beginning goes, and what is at least ``least`` high is refined: both
    ends move to the outermost dark row within a tenth of the height (``margin`` at most), and ``padding`` further out. A strip with at most one panel takes
    the stretches of more edges than .6 of its average instead. Panels over ``most`` are cut into equal parts. ``least`` and ``gap`` follow the strip's height if not given.
    """
    level = white_level(rows)
    heights = rows.groupBy("strip_id").agg((F.max("y") + 1).alias("total"))
    total = F.col("total")
    clip = lambda low, high, c: F.greatest(F.lit(low), F.least(F.lit(high), F.floor(c)))
    tall = (lambda high: clip(120, high, total / 90)) if least is None else (lambda _: F.lit(least))
    near = clip(1, 12, total / 2000) if gap is None else F.lit(gap)
    ahead = clip(20, 120, total / 1000)
    strips = stored(level.join(heights, "strip_id").withColumns({"_tall": tall(600), "_tall2": tall(800), "_near": near, "_ahead": ahead}))
    marked = rows.join(strips, "strip_id").withColumn("_dark", F.col("row_mean") < F.col("paper"))
    marked = marked.withColumn("_mask", dilated(F.col("_dark"), window // 2, window // 3))

    # Close runs become one; each strip has its own least gap.
    order = _strip().orderBy("start")
    runs = boolean_runs(marked, "_mask").join(strips, "strip_id")
    runs = runs.withColumn("_new", F.coalesce(F.col("start") - F.lag("end").over(order) >= F.col("_near"), F.lit(True)).cast("int")).withColumn("_group", F.sum("_new").over(order))
    runs = stored(runs.groupBy("strip_id", "_group").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_group"))

    inked = rows.select("strip_id", "y", "row_mean").join(strips.select("strip_id", "paper"), "strip_id")
    solid = in_ranges(inked.filter(F.col("row_mean") <= F.col("paper") - 20), runs, parts_for(rows)).groupBy("strip_id", "start").agg(F.min("y").alias("_solid"))
    found = runs.join(strips, "strip_id").join(solid, ["strip_id", "start"], "left")
    begin = F.least(F.coalesce("_solid", F.col("start") + F.col("_ahead")), F.col("start") + F.col("_ahead"))
    found = found.withColumn("start", begin).filter(F.col("end") - F.col("start") >= F.col("_tall")).select("strip_id", "start", "end", "total", "_tall")
    reach = F.least(F.lit(margin), F.floor((F.col("end") - F.col("start")) / 10))

    def outermost(name: str, low: Column, high: Column, pick: object) -> DataFrame:
        """The first or last dark row of [low, high) near each panel's end; looked for in the stretches that it reaches into."""
        near = found.select("strip_id", "start", "end", low.alias("low"), high.alias("high")).filter("high > low")
        parts = F.sequence(F.floor(F.col("low") / 64), F.floor((F.col("high") - 1) / 64))
        met = near.withColumn("_part", F.explode(parts)).join(inked.filter(F.col("row_mean") < F.col("paper") - 10).withColumn("_part", F.floor(F.col("y") / 64)), ["strip_id", "_part"])
        return met.filter((F.col("y") >= F.col("low")) & (F.col("y") < F.col("high"))).groupBy("strip_id", "start", "end").agg(pick("y").alias(name))

    first = outermost("_first", F.greatest(F.lit(0), F.col("start") - reach), F.least(total - 1, F.col("start") + reach), F.min)
    last = outermost("_last", F.greatest(F.lit(0), F.col("end") - reach) + 1, F.least(total - 1, F.col("end") + reach) + 1, F.max)
    panels = found.join(first, ["strip_id", "start", "end"], "left").join(last, ["strip_id", "start", "end"], "left")
    top = F.greatest(F.lit(0), F.least(F.coalesce("_first", "start") - padding, F.col("start")))
    bottom = F.least(total, F.greatest(F.coalesce(F.col("_last") + 1, F.col("end")) + padding, F.col("end")))
    panels = panels.select("strip_id", top.alias("start"), bottom.alias("end"), "_tall").filter(F.col("end") - F.col("start") >= F.col("_tall")).select("strip_id", "start", "end", F.lit("paper").alias("by"))
    panels = stored(panels)

    few = strips.join(panels.groupBy("strip_id").agg(F.count("*").alias("_n")), "strip_id", "left").filter(F.coalesce("_n", F.lit(0)) <= 1)
    edges = rows.join(few.select("strip_id", "_tall2"), "strip_id").withColumn("_smooth", smoothed("edge_density", window))
    average = edges.groupBy("strip_id").agg(F.greatest(F.lit(0.0005), 0.6 * F.avg("_smooth")).alias("_least"))
    extra = boolean_runs(edges.join(average, "strip_id").withColumn("_mask", F.col("_smooth") > F.col("_least")), "_mask").join(few.select("strip_id", "_tall2"), "strip_id")
    extra = extra.filter(F.col("end") - F.col("start") >= F.col("_tall2")).select("strip_id", "start", "end", F.lit("edges").alias("by"))
    panels = panels.join(extra.select("strip_id").distinct(), "strip_id", "left_anti").unionByName(extra)

    height = F.col("end") - F.col("start")
    parts = F.when(height > most, F.greatest(F.lit(2), F.floor(height / most) + 1)).otherwise(F.lit(1)).cast("int")
    pieces = panels.withColumn("_parts", parts).withColumn("_each", F.floor(height / F.col("_parts"))).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    own = F.when(F.col("_parts") == 1, F.col("end")).otherwise(F.col("start") + (F.col("_k") + 1) * F.col("_each"))
    pieces = pieces.select("strip_id", (F.col("start") + F.col("_k") * F.col("_each")).alias("start"), own.alias("end"), "by", "_parts")
    return pieces.filter((F.col("_parts") == 1) | (F.col("end") - F.col("start") > shortest)).drop("_parts")


def chunks_by_count(panels: DataFrame, rows: DataFrame, *, least: int = 5, most: int = 10, shortest: int = 50) -> DataFrame:
    """``strip_id, chunk, from, cut, panels``: groups of (least + most) / 2 panels; the last ones take what is left up to ``most``, or the last two share it so that neither is under ``least``. A
    group ends at the whitest row of the gap after it; groups of no more than ``shortest`` rows go."""
    size = max(least, min(most, (least + most) // 2))
    order = _strip().orderBy("start")
    p = panels.withColumn("_i", F.row_number().over(order) - 1).withColumn("_n", F.count("*").over(_strip()))
    enough = max(most + 1, size + least)
    p = p.withColumn("_k", F.when(F.col("_n") < enough, F.lit(0)).otherwise(F.floor((F.col("_n") - enough) / size) + 1))
    p = p.withColumn("_rest", F.col("_n") - F.col("_k") * size)
    inside = F.col("_i") - F.col("_k") * size
    chunk = F.when(inside < 0, F.floor(F.col("_i") / size)).when((F.col("_rest") > most) & (inside >= F.col("_rest") - least), F.col("_k") + 1).otherwise(F.col("_k"))
    g = p.withColumn("chunk", chunk.cast("int")).groupBy("strip_id", "chunk").agg(F.max_by("end", "start").alias("end"), F.min("start").alias("start"), F.count("*").alias("panels"))
    g = g.withColumn("_next", F.lead("start").over(_strip().orderBy("chunk")))
    gaps = g.filter(F.col("_next") > F.col("end")).select("strip_id", F.col("end").alias("start"), F.col("_next").alias("end"))
    cut = in_ranges(rows.select("strip_id", "y", "row_mean"), gaps, parts_for(rows)).groupBy("strip_id", F.col("start").alias("end")).agg(F.max(F.struct("row_mean", (-F.col("y")).alias("_y"))).alias("_b"))
    g = g.join(cut, ["strip_id", "end"], "left").withColumn("cut", F.coalesce(-F.col("_b._y"), F.col("end")))
    g = g.withColumn("from", F.coalesce(F.lag("cut").over(_strip().orderBy("chunk")), F.lit(0)))
    return g.filter(F.col("cut") - F.col("from") > shortest).select("strip_id", "chunk", "from", "cut", "panels")


def subscenes(rows: DataFrame, *, least_gap: int = 4, least: int = 8) -> DataFrame:
    """``strip_id, name, start, end``: a panel's parts between white gaps, named ``_s01`` and so on; a panel without such a gap has none."""
    level = white_level(rows)
    marked = rows.join(level, "strip_id").withColumn("_ink", F.col("row_mean") < F.col("paper") - 5)
    parts = merge_close(boolean_runs(marked, "_ink"), least_gap).filter(F.col("end") - F.col("start") >= least)
    parts = parts.withColumn("_n", F.count("*").over(_strip())).filter(F.col("_n") > 1)
    return parts.select("strip_id", F.format_string("%d_s%02d", F.col("strip_id"), F.row_number().over(_strip().orderBy("start"))).alias("name"), "start", "end")


def stitch_plan(sections: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Where each section lies in its strip once overlaps are taken off: ``strip_id, seq, height, overlap, score, y_start, y_end``.
    The contributions tile the canvas by construction: each starts where the one before ends."""
    rows = sections.join(overlaps.select("strip_id", "seq", "overlap", "score"), ["strip_id", "seq"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0)))
    own = F.col("height") - F.col("overlap")
    end = F.sum(own).over(_strip().orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("strip_id", "seq", "height", "overlap", "score", (end - own).alias("y_start"), end.alias("y_end"))


def stitch_manifest(plan: DataFrame, *, widths: DataFrame | None = None) -> DataFrame:
    """One row per strip: sections, rows taken off, canvas height, format, and whether the sections tile the canvas without gap or overlap."""
    from stripweave.operators.panels import format_detect

    gap = F.col("y_start") != F.coalesce(F.lag("y_end").over(_strip().orderBy("seq")), F.lit(0))
    rows = plan.withColumn("_gap", gap.cast("int"))
    out = rows.groupBy("strip_id").agg(F.count("*").alias("sections"), F.sum("overlap").alias("overlap_removed"), F.max("y_end").alias("canvas_height"), (F.sum("_gap") == 0).alias("tiles"))
    out = out.withColumn("width", F.lit(800)) if widths is None else out.join(widths, "strip_id")
    return out.withColumn("format", format_detect(F.col("width"), F.col("canvas_height")))
