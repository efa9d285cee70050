"""Bars (symbol, date, open, high, low, close, volume) from raw tables and
files.  Every reader keeps one row per (symbol, date)."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OHLC = ["open", "high", "low", "close"]
#: Daily chart payload: parallel arrays under chart.result[0].
_QUOTE = T.StructType([T.StructField(c, T.ArrayType(T.DoubleType())) for c in OHLC])
PAYLOAD = T.StructType([T.StructField("chart", T.StructType([T.StructField("result", T.ArrayType(T.StructType([
    T.StructField("timestamp", T.ArrayType(T.LongType())),
    T.StructField("indicators", T.StructType([T.StructField("quote", T.ArrayType(_QUOTE))])),
])))]))])


def resample(ticks: DataFrame, symbol: Column, bucket: Column, price: Column, order: list[Column], volume: Column | None = None) -> DataFrame:
    """Bars of ticks: one partial aggregation before the only shuffle."""
    at = F.struct(*order)
    return ticks.groupBy(symbol.alias("symbol"), bucket.alias("date")).agg(
        F.round(F.min_by(price, at), 2).alias("open"), F.round(F.max(price), 2).alias("high"), F.round(F.min(price), 2).alias("low"),
        F.round(F.max_by(price, at), 2).alias("close"), (F.count("*") if volume is None else F.sum(volume)).cast("long").alias("volume"),
    )


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of each event type."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "ts", "event_id", "value")
    return resample(e, F.col("event_type"), F.date_trunc("hour", "ts").cast("timestamp_ntz"), F.col("value"), [F.col("ts"), F.col("event_id")])


def order_bars(spark: SparkSession, sf_dir: str, symbol: str = "o_orderpriority") -> DataFrame:
    """Daily bars of order totals, one symbol for each priority."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return resample(o, F.col(symbol), F.to_date("o_orderdate"), F.col("o_totalprice"), [F.col("o_orderkey")])


def order_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walking index for each priority: 100 plus the running sum of daily
    totals' distances from their mean, in standard deviations."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    daily = o.groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("date")).agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("volume"))
    whole = Window.partitionBy("symbol")
    z = (F.col("total") - F.avg("total").over(whole)) / F.stddev("total").over(whole)
    walk = daily.withColumn("z", z)
    running = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return walk.select("symbol", "date", F.round(100 + F.sum("z").over(running), 2).alias("close"), "volume")


def order_walk(spark: SparkSession, sf_dir: str, first: int = 250) -> DataFrame:
    """Like ``order_index``, but with the mean and deviation of a symbol's ``first``
    days and half the steps, so that the walk ends away from where it began."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    daily = o.groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("date")).agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("volume"))
    by_date, whole = Window.partitionBy("symbol").orderBy("date"), Window.partitionBy("symbol")
    early = F.when(F.row_number().over(by_date) <= first, F.col("total"))
    daily = daily.withColumn("_t", early)
    z = (F.col("total") - F.avg("_t").over(whole)) / F.stddev("_t").over(whole)
    running = by_date.rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("z", z).select("symbol", "date", F.round(100 + F.sum("z").over(running) / 2, 2).alias("close"), "volume")


def unnest_payload(payloads: DataFrame, zone: str = "UTC") -> DataFrame:
    """Bars of (symbol, payload struct): arrays are zipped by position, rows
    with any gap in open, high, low or close go, prices are rounded to 2."""
    result = F.col("payload.chart.result")[0]
    quote = result["indicators"]["quote"][0]
    zipped = F.arrays_zip(result["timestamp"].alias("timestamp"), *[quote[c].alias(c) for c in OHLC])
    rows = payloads.select("symbol", F.inline(zipped))
    rows = rows.select("symbol", F.to_date(F.from_utc_timestamp(F.timestamp_seconds("timestamp"), zone)).alias("date"), *OHLC)
    return drop_gaps(rows).select("symbol", "date", *[F.round(F.col(c), 2).alias(c) for c in OHLC])


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, payload) of JSON files {symbol, chart}."""
    schema = T.StructType([T.StructField("symbol", T.StringType()), *PAYLOAD.fields])
    return spark.read.schema(schema).json(path, multiLine=True).select("symbol", F.struct("chart").alias("payload"))


def drop_gaps(bars: DataFrame) -> DataFrame:
    return bars.na.drop("any", subset=OHLC)


def fresh(bars: DataFrame, as_of: str, days: int = 1) -> DataFrame:
    """(symbol, last_date, is_fresh): the last bar is at most ``days`` old."""
    last = bars.groupBy("symbol").agg(F.max("date").alias("last_date"))
    return last.withColumn("is_fresh", F.datediff(F.lit(as_of).cast("date"), "last_date") <= days)


def one_each(bars: DataFrame) -> DataFrame:
    """One bar for each symbol and date: that with the largest volume (a bar only
    grows), ties by the other columns, so the choice never depends on the order."""
    rest = sorted((c for c in bars.columns if c not in ("symbol", "date")), key=lambda c: (c != "volume", c))
    if not rest:
        return bars.distinct()
    return bars.groupBy("symbol", "date").agg(F.max(F.struct(*rest)).alias("bar")).select("symbol", "date", "bar.*").select(*bars.columns)


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """The union by (symbol, date), one row each; a new row replaces the old one,
    and of several rows of a side ``one_each`` decides."""
    both = one_each(old).withColumn("_load", F.lit(0)).unionByName(one_each(new).withColumn("_load", F.lit(1)))
    rest = [c for c in old.columns if c not in ("symbol", "date")]
    last = both.groupBy("symbol", "date").agg(F.max_by(F.struct(*rest, "_load"), "_load").alias("bar"))
    return last.select(*[c if c in ("symbol", "date") else F.col(f"bar.{c}").alias(c) for c in old.columns])


def write_cache(bars: DataFrame, path: str) -> None:
    bars.repartition("symbol").sortWithinPartitions("symbol", "date").write.mode("overwrite").partitionBy("symbol").parquet(path)


def load_or_refresh(spark: SparkSession, path: str, fetch: Callable[[], DataFrame], as_of: str, days: int = 1) -> DataFrame:
    """The cached bars; where the cache is missing, empty, damaged or has a
    symbol that is not fresh, ``fetch`` is called and its bars are cached anew.

    The freshness test reads the dates of every file, so it also finds damage."""
    try:
        state = fresh(read_cache(spark, path), as_of, days).agg(F.min("is_fresh").alias("f")).first()["f"]
    except (PySparkException, Py4JJavaError):
        state = None
    if not state:
        write_cache(fetch(), path)
    return read_cache(spark, path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
