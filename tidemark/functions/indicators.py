"""Indicator columns over bars, all as window expressions of one shuffle by
symbol.  ``i`` is a bar's position in its symbol, ``n`` the number of bars."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

HORIZONS = (1, 3, 5, 10, 20, 60)


def by_date() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("date")


def rounded(x: Column | str, places: int) -> Column:
    """``x`` times 10**places to the nearest whole number, halves away from zero, and
    back, as SQL's ``round`` of a double.  ``F.round`` goes by the decimal digits instead:
    of 0.565, whose hundredfold is just under 56.5, it makes 0.57 and SQL 0.56."""
    value = F.col(x) if isinstance(x, str) else x
    return F.round(value * 10.0**places, 0) / 10.0**places


def positions(bars: DataFrame) -> DataFrame:
    return bars.withColumn("i", F.row_number().over(by_date()) - 1).withColumn("n", F.count("*").over(Window.partitionBy("symbol")))


def rsi(bars: DataFrame, period: int = 14, size: int = 4096) -> DataFrame:
    """Wilder's RSI without a recursion: with weights that grow by p/(p-1) a
    bar, the smoothed averages are two prefix sums whose common decay cancels.
    The weights start anew every ``size`` bars (fewer where they would overflow)
    and the averages at the ends of the blocks are carried forward, so a series
    may have any length."""
    k = F.col("i")
    change = F.col("close") - F.lag("close").over(by_date())
    grow = period / (period - 1) if period > 1 else 1.0
    size = max(period + 1, min(size, int(300 / math.log(grow)))) if grow > 1 else size
    since = F.when(F.col("_b") == 0, k - period).otherwise(k - F.col("_b") * size).cast("double")
    weight = F.lit(1.0 / period) * F.when((F.col("_b") == 0) & (k <= period), 1.0).otherwise(F.pow(F.lit(grow), since))
    running = Window.partitionBy("symbol", "_b").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    before = by_date().rowsBetween(Window.unboundedPreceding, -1)
    rows = positions(bars).withColumn("_up", F.greatest(change, F.lit(0.0))).withColumn("_down", F.greatest(-change, F.lit(0.0))).withColumn("_b", F.floor(k / size))
    rows = rows.withColumn("_up", F.col("_up") * weight).withColumn("_down", F.col("_down") * weight)
    rows = rows.withColumn("_g", F.sum("_up").over(running)).withColumn("_l", F.sum("_down").over(running))
    last = F.pmod(k, F.lit(size)) == size - 1
    for c in ("_g", "_l"):
        ends = F.collect_list(F.when(last, F.col(c) / F.pow(F.lit(grow), since))).over(before)
        rows = rows.withColumn(f"{c}c", F.aggregate(ends, F.lit(0.0), lambda s, x: s * F.lit(grow**-size) + x))
    rows = rows.withColumn("_g", F.col("_g") + F.col("_gc") / grow).withColumn("_l", F.col("_l") + F.col("_lc") / grow)
    value = F.when(F.col("_l") == 0, 100.0).otherwise(F.round(100 * F.col("_g") / (F.col("_g") + F.col("_l")), 2))
    return rows.withColumn("rsi", F.when(k >= period, value)).drop("_b", "_up", "_down", "_g", "_l", "_gc", "_lc")


def rsi_long(bars: DataFrame, period: int = 14) -> DataFrame:
    """The same by the recursion, one symbol a group, for any length."""

    def run(bars: pd.DataFrame) -> pd.DataFrame:
        bars = bars.sort_values("date").reset_index(drop=True)
        change = bars["close"].diff().fillna(0.0)
        out = pd.Series([None] * len(bars), dtype=float)
        sides = []
        for x in (change.clip(lower=0), (-change).clip(lower=0)):
            seeded = x.copy()
            seeded.iloc[: period + 1] = x.iloc[1 : period + 1].mean()
            sides.append(seeded.iloc[period:].ewm(alpha=1 / period, adjust=False).mean())
        if len(bars) > period:
            gain, loss = sides
            out.iloc[period:] = (100 * gain / (gain + loss)).where(loss != 0, 100.0).round(2)
        return bars.assign(rsi=out)

    kinds = ", ".join(f"{c} {t}" for c, t in bars.dtypes)
    return bars.groupBy("symbol").applyInPandas(run, kinds + ", rsi double")


def extremes(bars: DataFrame, width: int = 3, column: str = "close") -> DataFrame:
    """is_peak and is_trough: strictly beyond all neighbours within ``width``;
    a tie disqualifies, a null neighbour is passed over, a null is neither."""
    x = F.col(column)
    before, after = by_date().rowsBetween(-width, -1), by_date().rowsBetween(1, width)
    inside = F.col("i").between(width, F.col("n") - width - 1) & x.isNotNull()
    beyond = lambda a, b: F.coalesce(a > b, F.lit(True))
    peak = inside & beyond(x, F.max(x).over(before)) & beyond(x, F.max(x).over(after))
    trough = inside & beyond(F.min(x).over(before), x) & beyond(F.min(x).over(after), x)
    return bars.withColumn("is_peak", F.coalesce(peak, F.lit(False))).withColumn("is_trough", F.coalesce(trough, F.lit(False)))


def divergence(bars: DataFrame, lookback: int = 20, width: int = 3, min_gap: int | None = None, max_gap: int | None = None) -> DataFrame:
    """signal: 1 where a trough closes lower than the previous trough with a
    higher RSI, -1 the other way round at peaks, else 0.  Without gap bounds the
    previous extreme of the kind counts (two of a kind are always more than
    ``width`` bars apart); with bounds, the last one min_gap..max_gap bars back."""
    rows = extremes(bars, width)
    if min_gap is None and max_gap is None:
        last = by_date().rowsBetween(Window.unboundedPreceding, -1)
    else:
        last = Window.partitionBy("symbol").orderBy("i").rangeBetween(-(max_gap or 2**31 - 1), -(min_gap or 1))
    here = F.struct("close", "rsi")
    rows = rows.withColumn("_t", F.last(F.when(F.col("is_trough"), here), ignorenulls=True).over(last)).withColumn("_p", F.last(F.when(F.col("is_peak"), here), ignorenulls=True).over(last))
    ready = F.col("i") >= lookback
    bull = ready & F.col("is_trough") & (F.col("close") < F.col("_t.close")) & (F.col("rsi") > F.col("_t.rsi"))
    bear = ready & F.col("is_peak") & (F.col("close") > F.col("_p.close")) & (F.col("rsi") < F.col("_p.rsi"))
    return rows.withColumn("signal", F.when(bull, 1).when(bear, -1).otherwise(0)).drop("_t", "_p")


def excursions(rows: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Best and worst move of each signal over the next d bars, in percent of
    the entry close, long form; frames are cut at the end of the series, and
    only a signal on the last bar has none (null)."""
    for d in horizons:
        ahead = by_date().rowsBetween(1, d)
        rows = rows.withColumn(f"_h{d}", F.max("high").over(ahead)).withColumn(f"_l{d}", F.min("low").over(ahead))
    c, buy = F.col("close"), F.col("signal") == 1
    each = []
    for d in horizons:
        up, down = (F.col(f"_h{d}") - c) / c * 100, (F.col(f"_l{d}") - c) / c * 100
        each.append(F.struct(F.lit(d).alias("horizon"), F.round(F.when(buy, up).otherwise(-down), 3).alias("max_profit"), F.round(F.when(buy, down).otherwise(-up), 3).alias("max_drawdown")))
    shown = F.when(F.col("rsi") != 0, F.round("rsi", 1))
    kept = rows.where("signal <> 0").select("symbol", "date", "close", shown.alias("rsi"), "signal", F.explode(F.array(*each)).alias("e"))
    return kept.select("symbol", "date", "close", "rsi", "signal", "e.*")


def change_over(column: str, k: int) -> Column:
    return F.col(column) - F.lag(column, k).over(by_date())


def rolling_sum(column: str, k: int) -> Column:
    return F.sum(column).over(by_date().rowsBetween(1 - k, 0))


def moving_average(column: str, k: int) -> Column:
    return F.avg(column).over(by_date().rowsBetween(1 - k, 0))
