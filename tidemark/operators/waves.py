"""Waves of a close series and what is computed from them.

The segmentation is this library's own contract: zigzag pivots on close (a leg
ends when the price turns back by ``pivot_pct`` percent), then, from the left,
the longest run of two or more legs with a net move within ``range_pct`` over
``range_days`` bars or more becomes one range wave.  A state machine over one
symbol's bars is sequential, so it runs as a grouped pandas function; all the
rest is joins and windows.  Waves: symbol, seq, type (up, down, range),
start_date, end_date, start_val, end_val, pct, point_change, days, total_vol,
vpp, is_open."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.indicators import rounded

WIN_RATES = [w / 10 for w in range(10, 0, -1)]


def pivots(close: list[float], pivot_pct: float) -> list[int]:
    """First bar, turning points and last bar."""
    if not close:
        return []
    share, out = pivot_pct / 100, [0]
    lo = hi = 0
    way = 0
    for i, c in enumerate(close):
        if way >= 0 and c > close[hi]:
            hi = i
        if way <= 0 and c < close[lo]:
            lo = i
        if way >= 0 and c <= close[hi] * (1 - share):
            if hi != out[-1]:
                out.append(hi)
            way, lo = -1, i
        elif way <= 0 and c >= close[lo] * (1 + share):
            if lo != out[-1]:
                out.append(lo)
            way, hi = 1, i
    if out[-1] != len(close) - 1:
        out.append(len(close) - 1)
    return out


def merge_ranges(legs: list[tuple[int, int]], close: list[float], range_pct: float, range_days: int) -> list[tuple[int, int, str]]:
    out, i = [], 0
    while i < len(legs):
        for j in range(len(legs) - 1, i, -1):
            a, b = legs[i][0], legs[j][1]
            if b - a >= range_days and abs(close[b] / close[a] - 1) * 100 <= range_pct:
                out.append((a, b, "range"))
                i = j + 1
                break
        else:
            a, b = legs[i]
            out.append((a, b, "up" if close[b] >= close[a] else "down"))
            i += 1
    return out


def waves(bars: DataFrame, pivot_pct: float = 5.0, range_pct: float = 3.5, range_days: int = 22) -> DataFrame:
    kind = dict(bars.dtypes)["date"]
    schema = f"symbol string, seq int, type string, start_date {kind}, end_date {kind}, start_val double, end_val double, days int, total_vol long, is_open boolean"

    def run(bars: pd.DataFrame) -> pd.DataFrame:
        bars = bars.sort_values("date").reset_index(drop=True)
        close = bars["close"].tolist()
        turns = pivots(close, pivot_pct)
        found = merge_ranges(list(zip(turns, turns[1:], strict=False)), close, range_pct, range_days)
        volume = bars["volume"].fillna(0).cumsum()
        out = [(bars["symbol"][0], k, t, bars["date"][a], bars["date"][b], close[a], close[b], b - a, int(volume[b] - volume[a]), b == len(close) - 1) for k, (a, b, t) in enumerate(found)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return measured(bars.select("symbol", "date", "close", "volume").groupBy("symbol").applyInPandas(run, schema))


def sign_runs(bars: DataFrame) -> DataFrame:
    """Waves by gaps and islands: neighbouring bars that move the same way."""
    w = Window.partitionBy("symbol").orderBy("date")
    way = F.signum(F.col("close") - F.lag("close").over(w))
    steps = bars.withColumn("prev_date", F.lag("date").over(w)).withColumn("prev", F.lag("close").over(w)).withColumn("way", way).where("prev is not null")
    turn = F.when(F.col("way") != F.lag("way").over(w), 1).otherwise(0)
    steps = steps.withColumn("turn", turn).withColumn("seq", F.sum("turn").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    runs = steps.groupBy("symbol", "seq").agg(
        F.when(F.first("way") > 0, "up").when(F.first("way") < 0, "down").otherwise("range").alias("type"),
        F.min("prev_date").alias("start_date"), F.max("date").alias("end_date"), F.min_by("prev", "date").alias("start_val"), F.max_by("close", "date").alias("end_val"),
        F.count("*").cast("int").alias("days"), F.sum("volume").alias("total_vol"),
    )
    return measured(runs.withColumn("is_open", F.col("seq") == F.max("seq").over(Window.partitionBy("symbol"))))


def measured(runs: DataFrame) -> DataFrame:
    points = F.abs(F.col("end_val") - F.col("start_val"))
    return runs.withColumn("pct", rounded((F.col("end_val") / F.col("start_val") - 1) * 100, 2)).withColumn("point_change", points).withColumn("vpp", F.when(points > 0, F.col("total_vol") / points))


def vpp_by_type(waves: DataFrame) -> DataFrame:
    """Unweighted mean of the waves' volume per point, and the ratio of range
    waves to each type."""
    means = waves.groupBy("symbol", "type").agg(F.avg("vpp").alias("vpp"), F.count("*").alias("n_waves"))
    ranges = means.where("type = 'range'").select("symbol", F.col("vpp").alias("range_vpp"))
    return means.join(ranges, "symbol", "left").select("symbol", "type", "n_waves", rounded("vpp", 4).alias("mean_vpp"), rounded(F.col("range_vpp") / F.col("vpp"), 4).alias("range_ratio"))


def wave_statistics(waves: DataFrame) -> DataFrame:
    return waves.groupBy("symbol", "type").agg(
        F.count("*").alias("n_waves"), rounded(F.avg("pct"), 4).alias("mean_pct"), rounded(F.median("pct"), 4).alias("median_pct"), F.min("pct").alias("min_pct"), F.max("pct").alias("max_pct"),
        rounded(F.avg("days"), 4).alias("mean_days"), rounded(F.median("days"), 4).alias("median_days"),
    )


def wave_flow(waves: DataFrame, flows: DataFrame) -> DataFrame:
    """Mean over the waves of a type of their summed daily ``flow``.  ``flows``
    (symbol, date, flow) has a row for every bar, so a wave's sum is the
    difference of two running sums; its first bar belongs to the wave before."""
    running = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    sums = flows.select("symbol", "date", F.sum("flow").over(running).alias("upto"))
    begin, end = (sums.select("symbol", F.col("date").alias(f"{c}_date"), F.col("upto").alias(c)) for c in ("start", "end"))
    rows = waves.join(begin, ["symbol", "start_date"]).join(end, ["symbol", "end_date"])
    return rows.groupBy("symbol", "type").agg(F.count("*").alias("n_waves"), rounded(F.avg(F.col("end") - F.col("start")), 2).alias("mean_flow"))


def ratios(waves: DataFrame) -> DataFrame:
    """Each wave with ratio = |pct| / |pct of the previous wave of its type|."""
    before = F.abs(F.lag("pct").over(Window.partitionBy("symbol", "type").orderBy("seq")))
    return waves.withColumn("prev_pct", before).withColumn("ratio", F.when(before > 0, F.abs("pct") / before))


def symmetry(waves: DataFrame) -> DataFrame:
    rows = ratios(waves).where("ratio is not null")
    near = F.col("ratio").between(0.8, 1.25)
    return rows.groupBy("symbol", "type").agg(F.count("*").alias("n_pairs"), rounded(100 * F.avg("ratio"), 2).alias("mean_ratio_pct"), rounded(100 * F.avg(near.cast("double")), 2).alias("near_pct"))


def exhaustion(waves: DataFrame) -> DataFrame:
    """Of waves with a predecessor of their type and a successor: how many had
    less volume than that predecessor and were followed by another type."""
    rows = waves.withColumn("prev_vol", F.lag("total_vol").over(Window.partitionBy("symbol", "type").orderBy("seq"))).withColumn("next_type", F.lead("type").over(Window.partitionBy("symbol").orderBy("seq"))).where("prev_vol is not null and next_type is not null")
    hit = (F.col("total_vol") < F.col("prev_vol")) & (F.col("next_type") != F.col("type"))
    return rows.groupBy("symbol").agg(F.count("*").alias("n_waves"), F.sum(hit.cast("long")).alias("n_hits"), rounded(100 * F.avg(hit.cast("double")), 2).alias("accuracy"))


def winrate_levels(waves: DataFrame) -> DataFrame:
    """For each symbol's open wave and each win rate w: the ratio at position
    int(n * (1 - w)) of its type's sorted ratios (double arithmetic), the
    target percent, price, and whether the close is there."""
    found = ratios(waves)
    rows = found.where("ratio is not null")
    ordered = rows.select("symbol", "type", "ratio", (F.row_number().over(Window.partitionBy("symbol", "type").orderBy("ratio", "seq")) - 1).alias("at"), F.count("*").over(Window.partitionBy("symbol", "type")).alias("n"))
    levels = F.explode(F.array(*[F.struct(F.lit(w).alias("win_rate"), F.floor(F.col("n") * F.lit(1 - w)).alias("at")) for w in WIN_RATES]))
    groups = ordered.groupBy("symbol", "type").agg(F.max("n").alias("n")).select("symbol", "type", levels.alias("l")).select("symbol", "type", "l.*")
    picked = groups.join(ordered.drop("n"), ["symbol", "type", "at"])
    now = found.where("is_open and prev_pct is not null").select("symbol", "type", "start_val", "end_val", "prev_pct")
    sign = F.when(F.col("type") == "down", -1.0).otherwise(1.0)
    target = rounded(F.col("ratio") * F.col("prev_pct"), 2)
    price = rounded(F.col("start_val") * (1 + sign * F.col("ratio") * F.col("prev_pct") / 100), 2)
    reached = F.when(F.col("type") == "down", F.col("end_val") <= price).otherwise(F.col("end_val") >= price)
    return picked.join(now, ["symbol", "type"]).select("symbol", "type", rounded("win_rate", 1).alias("win_rate"), rounded("ratio", 4).alias("ratio"), target.alias("target_pct"), price.alias("price"), reached.alias("reached"))


def open_wave(waves: DataFrame, bars: DataFrame) -> DataFrame:
    """The open wave: peak, trough, cumulative percent, days, and the targets
    trough * (1 + mean) and (1 + median) of up waves, whether the last close has
    passed them, the ceiling start * (1 + max) and the days left to the longest
    up wave."""
    now = waves.where("is_open").select("symbol", "type", "start_date", "start_val", "end_val", "days")
    inside = bars.join(now, "symbol").where(F.col("date") >= F.col("start_date")).groupBy("symbol").agg(F.max("close").alias("peak"), F.min("close").alias("trough"), F.sum("volume").alias("flow"))
    ups = waves.where("type = 'up' and not is_open").groupBy("symbol").agg(F.avg("pct").alias("mean_up"), F.median("pct").alias("median_up"), F.max("pct").alias("max_up"), F.max("days").alias("max_days"))
    rows = now.join(inside, "symbol").join(ups, "symbol", "left")
    mean, median = (rounded(F.col("trough") * (1 + F.col(c) / 100), 3) for c in ("mean_up", "median_up"))
    return rows.select(
        "symbol", "type", "start_date", "days", "peak", "trough", "flow",
        rounded((F.col("end_val") / F.col("start_val") - 1) * 100, 2).alias("cumulative_pct"),
        rounded((F.col("peak") / F.col("trough") - 1) * 100, 2).alias("peak_pct"),
        mean.alias("mean_target"),
        (F.col("end_val") >= mean).alias("mean_passed"),
        median.alias("median_target"),
        (F.col("end_val") >= median).alias("median_passed"),
        rounded(F.col("start_val") * (1 + F.col("max_up") / 100), 2).alias("ceiling"),
        (F.col("max_days") - F.col("days")).alias("days_left"),
        advice(F.col("type"), F.col("peak") >= F.col("trough") * (1 + F.col("mean_up") / 100)).alias("advice"),
    )


def advice(kind: Column, passed: Column) -> Column:
    return F.when((kind == "up") & passed, "take profit: the mean target has passed").when(kind == "up", "hold: below the mean target").when(kind == "down", "defend: wait for a turn").otherwise("accumulate within the range")


def early_warning(bars: DataFrame, pct: float = 3.0) -> DataFrame:
    """The open leg of a zigzag with a small threshold: state, turning date,
    base price, cumulative percent and days."""
    last = waves(bars, pivot_pct=pct, range_days=2**31 - 1).where("is_open")
    return last.select("symbol", F.col("type").alias("state"), F.col("start_date").alias("turn_date"), F.col("start_val").alias("base_price"), F.col("pct").alias("cumulative_pct"), "days")


def level_index(n: int, win_rate: float) -> int:
    """Position of a win rate among n sorted ratios."""
    return math.floor(n * (1 - win_rate))
