"""Bar series in blocks, so that one symbol may take many tasks.

``split`` deals bars to blocks by ranges of (symbol, date): a block is at most a
partition's share of the rows, however long its symbol.  Three ways lead from a
block to its neighbours, each over a table of block summaries (one row for a
symbol's block) instead of the bars:

* ``halo``: copies of the few bars before and after a block, for frames of a
  bounded number of bars;
* ``carry``: the last known value of all earlier blocks, for frames without a bound;
* ``rsi``: a linear recurrence, whose earlier blocks come in by one weighted sum.

``local`` shapes such rows so that the window functions of ``indicators`` work
on each block alone.  Columns beside the bars': block, i (a bar's position in
its symbol) and n (the symbol's bars)."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import indicators

BLOCK_ROWS = 200_000
#: Ranges that even a small table is dealt to.
LEAST_PARTS = 16
#: Block summaries (some 50 bytes each) that are broadcast at most; beyond, both sides are shuffled.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see, ``spark.checkpoint.dir``; a session on one
    machine may name none and gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def small(summary: DataFrame, name: str) -> DataFrame:
    """``summary`` stored, and marked for a broadcast if it is counted to be small."""
    summary = stored(summary, name)
    return F.broadcast(summary) if summary.count() <= BROADCAST_ROWS else summary


def in_block() -> Window:
    return Window.partitionBy("symbol", "block").orderBy("date")


def split(bars: DataFrame, rows: int = BLOCK_ROWS, order: tuple[str, ...] = ("symbol", "date")) -> DataFrame:
    """``bars`` with ``block``, of about ``rows`` bars or less, in order of ``order``.
    Ranges are drawn by sampling, so the blocks are stored as they were dealt."""
    parts = max(LEAST_PARTS, -(-bars.count() // rows))
    return stored(bars.repartitionByRange(parts, *order).withColumn("block", F.spark_partition_id().cast("long")), "blocks")


def numbered(blocks: DataFrame) -> DataFrame:
    """With ``i`` and ``n``, from counts of the blocks."""
    counts = blocks.groupBy("symbol", "block").agg(F.count("*").alias("_c"))
    by_block = Window.partitionBy("symbol").orderBy("block")
    sums = counts.select("symbol", "block", (F.sum("_c").over(by_block) - F.col("_c")).alias("_first"), F.sum("_c").over(Window.partitionBy("symbol")).alias("n"))
    rows = blocks.join(small(sums, "counts"), ["symbol", "block"]).withColumn("i", F.row_number().over(in_block()) - 1 + F.col("_first"))
    return stored(rows.drop("_first"), "numbered")


def halo(rows: DataFrame, before: int, after: int) -> DataFrame:
    """``rows`` (numbered) with ``inside`` true, and copies of the ``before`` bars ahead
    of each block and the ``after`` bars behind it, with that block and ``inside``
    false.  Blocks shorter than the halo reach over several neighbours."""
    spans = rows.groupBy("symbol", "block").agg(F.min("i").alias("lo"), F.max("i").alias("hi"))
    home = spans.select("symbol", "block", F.col("lo").alias("from"), F.col("hi").alias("to"))
    near = spans.select("symbol", F.col("block").alias("to_block"), "lo", "hi")
    meet = (F.col("from") <= F.col("hi") + after) & (F.col("to") >= F.col("lo") - before) & (F.col("block") != F.col("to_block"))
    pairs = home.join(near, "symbol").where(meet).select("symbol", "block", "to_block", "lo", "hi")
    copies = rows.join(small(pairs, "halos"), ["symbol", "block"]).where(F.col("i").between(F.col("lo") - before, F.col("hi") + after))
    copies = copies.withColumn("block", F.col("to_block")).select(*rows.columns, F.lit(False).alias("inside"))
    return rows.withColumn("inside", F.lit(True)).unionByName(copies)


def local(rows: DataFrame) -> DataFrame:
    """Each block as a symbol of its own, for functions that work by symbol."""
    return rows.withColumn("symbol", F.struct("symbol", "block"))


def whole(rows: DataFrame) -> DataFrame:
    """The symbols again."""
    return rows.withColumn("symbol", F.col("symbol.symbol"))


def carry(rows: DataFrame, values: dict[str, tuple[Column, Column]], order: str = "i") -> DataFrame:
    """``rows`` with, for each name, the value of the last earlier row of the symbol
    for which the condition holds: values maps names to (condition, value).  Ties
    of ``order`` do not occur within a symbol."""
    last = {k: F.max_by(F.when(c, v), F.when(c, F.col(order))) for k, (c, v) in values.items()}
    ends = rows.groupBy("symbol", "block").agg(*[v.alias(f"_c_{k}") for k, v in last.items()])
    earlier = Window.partitionBy("symbol").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("symbol", "block", *[F.last(f"_c_{k}", ignorenulls=True).over(earlier).alias(f"_c_{k}") for k in last])
    before = Window.partitionBy("symbol", "block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(small(ends, "carried"), ["symbol", "block"])
    for k, (c, v) in values.items():
        out = out.withColumn(k, F.coalesce(F.last(F.when(c, v), ignorenulls=True).over(before), F.col(f"_c_{k}"))).drop(f"_c_{k}")
    return out


def rsi(rows: DataFrame, period: int = 14, size: int = 4096) -> DataFrame:
    """Wilder's RSI of numbered blocks.  An average is a sum of changes with weights
    grow**e, where e counts the bars after the first ``period``; within runs of
    ``size`` bars the weights start anew, and a run takes what lies before it as
    the runs' totals, weighted by their distance.  Those whose weight is under
    e**-40, beyond a double's digits, are left out."""
    grow = period / (period - 1) if period > 1 else math.inf
    size = max(1, min(size, int(300 / math.log(grow))))
    before = F.coalesce(F.lag("close").over(in_block()), F.col("_prev"))
    ends = rows.groupBy("symbol", "block").agg(F.max_by("close", "i").alias("close"))
    ends = ends.select("symbol", "block", F.lag("close").over(Window.partitionBy("symbol").orderBy("block")).alias("_prev"))
    rows = rows.join(small(ends, "ends"), ["symbol", "block"])
    change = F.col("close") - before
    if period == 1:  # the last change alone
        return rows.withColumn("rsi", F.when(F.col("i") >= 1, F.when(change < 0, 0.0).otherwise(100.0))).drop("_prev")
    start = F.min("i").over(Window.partitionBy("symbol", "block"))
    rows = rows.withColumn("_d", F.coalesce(change, F.lit(0.0))).withColumn("_run", F.floor((F.col("i") - start) / size)).drop("_prev")
    run = Window.partitionBy("symbol", "block", "_run")
    power = lambda i: F.greatest(i - period, F.lit(0)).cast("double")
    rows = rows.withColumn("_from", F.min("i").over(run)).withColumn("_e", power(F.col("i")) - power(F.col("_from")))
    for c, x in (("_g", F.greatest("_d", F.lit(0.0))), ("_l", F.greatest(-F.col("_d"), F.lit(0.0)))):
        rows = rows.withColumn(c, F.sum(x * F.pow(F.lit(grow), "_e")).over(run.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    totals = rows.groupBy("symbol", "block", "_run").agg(F.min("_from").alias("_from"), F.max("_g").alias("_g"), F.max("_l").alias("_l"))
    reach = int(40 / math.log(grow)) + period + size
    near = Window.partitionBy("symbol").orderBy("_from").rangeBetween(-reach, -1)
    earlier = F.collect_list(F.struct(power(F.col("_from")).alias("e"), "_g", "_l")).over(near)
    add = lambda c: F.aggregate("_near", F.lit(0.0), lambda s, x: s + x[c] * F.pow(F.lit(grow), x["e"] - power(F.col("_from"))))
    carried = totals.withColumn("_near", earlier).select("symbol", "block", "_run", add("_g").alias("_cg"), add("_l").alias("_cl"))
    rows = rows.join(small(carried, "runs"), ["symbol", "block", "_run"]).withColumn("_g", F.col("_g") + F.col("_cg")).withColumn("_l", F.col("_l") + F.col("_cl"))
    value = F.when(F.col("_l") == 0, 100.0).otherwise(F.round(100 * F.col("_g") / (F.col("_g") + F.col("_l")), 2))
    return rows.withColumn("rsi", F.when(F.col("i") >= period, value)).drop("_d", "_run", "_from", "_e", "_g", "_l", "_cg", "_cl")


def extremes(rows: DataFrame, width: int = 3) -> DataFrame:
    """``indicators.extremes`` of numbered blocks."""
    found = indicators.extremes(local(halo(rows, width, width)), width)
    return whole(found).where("inside").drop("inside")


def divergence(rows: DataFrame, lookback: int = 20, width: int = 3, min_gap: int | None = None, max_gap: int | None = None) -> DataFrame:
    """``indicators.divergence`` of numbered blocks with ``rsi``."""
    rows = stored(extremes(rows, width), "extremes")
    here = F.struct("close", "rsi")
    if min_gap is None and max_gap is None:
        rows = carry(rows, {"_t": (F.col("is_trough"), here), "_p": (F.col("is_peak"), here)})
        return signalled(rows, lookback)
    if max_gap is None:
        raise ValueError("a lower bound needs an upper one, which bounds the halo")
    last = Window.partitionBy("symbol").orderBy("i").rangeBetween(-max_gap, -(min_gap or 1))
    near = local(halo(rows, max_gap, 0))
    for c, kind in (("_t", "is_trough"), ("_p", "is_peak")):
        near = near.withColumn(c, F.last(F.when(F.col(kind), here), ignorenulls=True).over(last))
    return signalled(whole(near).where("inside").drop("inside"), lookback)


def signalled(rows: DataFrame, lookback: int) -> DataFrame:
    ready = F.col("i") >= lookback
    bull = ready & F.col("is_trough") & (F.col("close") < F.col("_t.close")) & (F.col("rsi") > F.col("_t.rsi"))
    bear = ready & F.col("is_peak") & (F.col("close") > F.col("_p.close")) & (F.col("rsi") < F.col("_p.rsi"))
    return rows.withColumn("signal", F.when(bull, 1).when(bear, -1).otherwise(0)).drop("_t", "_p")


def excursions(rows: DataFrame, horizons: tuple[int, ...] = indicators.HORIZONS) -> DataFrame:
    """``indicators.excursions`` of numbered blocks with ``signal``."""
    near = halo(stored(rows, "signals"), 0, max(horizons)).withColumn("signal", F.when(F.col("inside"), F.col("signal")).otherwise(0))
    return whole(indicators.excursions(local(near), horizons))


def signals(bars: DataFrame, rows: int = BLOCK_ROWS, **bounds: int) -> DataFrame:
    """The signal chain, from bars to forward excursions, in blocks of ``rows`` bars."""
    return excursions(divergence(rsi(numbered(split(bars, rows))), **bounds))
