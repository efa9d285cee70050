"""Statistics over long-form signals (symbol, date, signal, horizon,
max_profit, max_drawdown).  All group by small keys with partial aggregation;
medians come from counts of values, so no group is gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def side(signals: DataFrame, which: str = "all") -> DataFrame:
    """which: all, buy or sell."""
    return signals if which == "all" else signals.where(F.col("signal") == {"buy": 1, "sell": -1}[which])


def upper_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(*keys, median): the element at floor(n/2), 0-based, of the sorted values."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    up_to = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy(*keys)
    ranked = counts.withColumn("upto", F.sum("c").over(up_to)).withColumn("n", F.sum("c").over(total))
    return ranked.where(F.col("upto") > F.floor(F.col("n") / 2)).groupBy(*keys).agg(F.min(value).alias("median"))


def winrate(signals: DataFrame) -> DataFrame:
    rows = signals.where("max_profit is not null")
    keys = ["horizon", "signal"]
    main = rows.groupBy(*keys).agg(
        F.count("*").alias("n_signals"),
        F.round(F.avg(F.when(F.col("max_profit") > 0, 100.0).otherwise(0.0)), 4).alias("win_rate"),
        F.round(F.avg("max_profit"), 4).alias("mean_profit"),
        F.round(F.avg("max_drawdown"), 4).alias("mean_drawdown"),
        F.max("max_profit").alias("best_profit"),
        F.min("max_drawdown").alias("worst_drawdown"),
    )
    return main.join(upper_median(rows, keys, "max_profit").withColumnRenamed("median", "median_profit"), keys)


def histogram(signals: DataFrame, metric: str = "max_profit") -> DataFrame:
    """(horizon, bin, n, positive): bins of a fifteenth of the range, 0.2 at
    least (1 where all values are equal); empty bins are left out."""
    rows = signals.where(F.col(metric).isNotNull()).select("horizon", F.col(metric).alias("v"))
    span = rows.groupBy("horizon").agg((F.max("v") - F.min("v")).alias("range"))
    width = F.when(F.col("range") <= 0, 1.0).otherwise(F.greatest(F.lit(0.2), F.col("range") / 15))
    bins = rows.join(span, "horizon").select("horizon", F.round(F.floor(F.col("v") / width) * width, 1).alias("bin"), (F.floor(F.col("v") / width) * width >= 0).alias("positive"))
    return bins.groupBy("horizon", "bin", "positive").agg(F.count("*").alias("n"))


def summary(bars: DataFrame) -> DataFrame:
    """data_range and total_days of each symbol, and the last close."""
    out = bars.groupBy("symbol").agg(F.min("date").cast("string").alias("a"), F.max("date").cast("string").alias("b"), F.count("*").alias("total_days"), F.max_by("close", "date").alias("last_close"))
    return out.select("symbol", F.concat("a", F.lit(" ~ "), "b").alias("data_range"), "total_days", "last_close")
