"""The refresh streams against the batch results."""

import datetime
import glob
import os
import random
import shutil

from pyspark.sql import functions as F

from tidemark.functions import indicators
from tidemark.operators import waves
from tidemark.sources.store import BarStore
from tidemark.streaming import refresh

SCHEMA = "symbol string, date timestamp, close double"


def bars_of(spark, n=40):
    return spark.createDataFrame([("a", datetime.datetime(2024, 1, 1) + datetime.timedelta(days=i), float(100 + (i * 7) % 13)) for i in range(n)], SCHEMA)


def files(frames, folder):
    os.makedirs(f"{folder}/in")
    for k, df in enumerate(frames):
        df.coalesce(1).write.parquet(f"{folder}/out{k}")
        shutil.copy(glob.glob(f"{folder}/out{k}/*.parquet")[0], f"{folder}/in/{k}.parquet")
        os.utime(f"{folder}/in/{k}.parquet", (1e9 + k * 100, 1e9 + k * 100))
    return f"{folder}/in"


def test_upsert(spark, tmp_path):
    bars = bars_of(spark)
    later = bars.where("date >= '2024-01-20'").withColumn("close", F.col("close") + 1000)
    source = files([bars.where("date < '2024-01-22'"), later], str(tmp_path))
    refresh.stream_upsert(spark, source, SCHEMA, f"{tmp_path}/t", f"{tmp_path}/c").awaitTermination()
    got = BarStore(spark, f"{tmp_path}/t").read()
    assert got.count() == 40 and got.where("close > 1000").count() == later.count()


def test_upsert_within_a_batch(spark, tmp_path):
    bars = bars_of(spark).withColumn("volume", F.lit(1))
    twice = bars.union(bars.withColumn("close", F.col("close") + 1000).withColumn("volume", F.lit(2)))
    source = files([twice], str(tmp_path))
    refresh.stream_upsert(spark, source, SCHEMA + ", volume int", f"{tmp_path}/t", f"{tmp_path}/c").awaitTermination()
    got = BarStore(spark, f"{tmp_path}/t").read()
    assert got.count() == got.where("close > 1000").count() == 40


def test_rsi(spark, tmp_path):
    bars = bars_of(spark)
    source = files([bars.where("date < '2024-01-21'"), bars.where("date >= '2024-01-21'")], str(tmp_path))
    stream = refresh.streaming_rsi(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source))
    stream.writeStream.format("memory").queryName("rsi_out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = {r["date"]: r["rsi"] for r in spark.table("rsi_out").collect()}
    want = {r["date"]: r["rsi"] for r in indicators.rsi(bars).collect()}
    assert got == want


def test_level_index():
    """Double arithmetic: 15 * (1 - 0.8) is just under 3."""
    assert [waves.level_index(15, w) for w in (1.0, 0.9, 0.8)] == [0, 1, 2]


def test_hourly_bars(spark, tmp_path):
    """Bars of closed hours.  A late tick is left out from the batch after the one
    that moved the watermark past it; before, it still counts."""
    at = lambda *t: datetime.datetime(2024, 1, 1, *t)
    schema = "symbol string, ts timestamp, price double"
    first = spark.createDataFrame([("a", at(9, 5), 3.0), ("a", at(9, 50), 1.0), ("a", at(9, 20), 5.0), ("b", at(9, 1), 7.0), ("a", at(12, 30), 2.0)], schema)
    next_ = spark.createDataFrame([("a", at(12, 10), 6.0), ("a", at(16, 0), 4.0)], schema)
    last = spark.createDataFrame([("a", at(9, 59), 99.0), ("a", at(23, 0), 4.0)], schema)
    stream = refresh.hourly_bars(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(files([first, next_, last], str(tmp_path))))
    stream.writeStream.format("memory").outputMode("append").queryName("hours_out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = {(r["symbol"], r["window"]["start"].hour): (r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in spark.table("hours_out").collect()}
    assert got[("a", 9)] == (3.0, 5.0, 1.0, 1.0, 3) and got[("b", 9)] == (7.0, 7.0, 7.0, 7.0, 1)
    assert got[("a", 12)] == (6.0, 6.0, 2.0, 2.0, 2) and got[("a", 16)][4] == 1


def test_signals(spark, tmp_path):
    """Over batches of uneven length, some shorter than the bars an extreme needs,
    and across a restart, the signals of a batch run over the whole series."""
    rng, rows = random.Random(4), []
    for symbol, n in (("a", 400), ("b", 300), ("c", 5)):
        close = 100.0
        for i in range(n):
            close = round(close + rng.choice([-1, 0, 1]) * rng.random() * 3, 2)
            rows.append((symbol, datetime.datetime(2020, 1, 1) + datetime.timedelta(days=i), close))
    bars = spark.createDataFrame(rows, SCHEMA).cache()
    cuts = [0, 2, 3, 30, 150, 151, 400]
    day = lambda k: datetime.datetime(2020, 1, 1) + datetime.timedelta(days=k)
    parts = [bars.where((F.col("date") >= F.lit(day(a))) & (F.col("date") < F.lit(day(b)))) for a, b in zip(cuts, cuts[1:], strict=False)]
    source = files(parts, str(tmp_path))
    late = [p for p in sorted(glob.glob(f"{source}/*.parquet")) if int(os.path.basename(p)[0]) > 3]
    for p in late:
        shutil.move(p, f"{tmp_path}/{os.path.basename(p)}")
    for turn in range(2):
        stream = refresh.streaming_signals(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source))
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/signals").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        if not turn:
            for p in late:
                shutil.move(f"{tmp_path}/{os.path.basename(p)}", p)
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/signals").select("symbol", "date", "close", "rsi", "signal").collect()))
    want = sorted(map(tuple, indicators.divergence(indicators.rsi(bars)).where("signal <> 0").select("symbol", "date", "close", "rsi", "signal").collect()))
    assert got == want and len(want) > 5 and {w[4] for w in want} == {1, -1}


def test_revised(spark, tmp_path):
    """Bars that come again or late, over batches and a restart: the last row of each
    date is that of a batch run over the final bars."""
    rng = random.Random(9)
    day = lambda k: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=k)
    feed, final = [], {}
    for known in (20, 40, 60, 80):
        batch = {(s, k): float(rng.randint(80, 120)) for s in "ab" for k in range(known - 20, known)}
        batch |= {(s, rng.randrange(max(0, known - 45), known)): float(rng.randint(80, 120)) for s in "ab" for _ in range(4)}
        if known == 40:
            del batch["a", 25]  # comes with the next batch, between known dates
        if known == 60:
            batch["a", 25] = 111.0
        final |= batch
        feed.append(spark.createDataFrame([(s, day(k), c) for (s, k), c in batch.items()], SCHEMA))
    source = files(feed, str(tmp_path))
    store = BarStore(spark, f"{tmp_path}/store")
    late = sorted(glob.glob(f"{source}/*.parquet"))[2:]
    for p in late:
        shutil.move(p, f"{tmp_path}/{os.path.basename(p)}")
    for turn in range(2):
        stream = refresh.streaming_rsi_revised(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source), keep=60)
        stream.writeStream.outputMode("update").foreachBatch(lambda rows, k: store.write(rows, "rsi", k) and None).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        if not turn:
            for p in late:
                shutil.move(f"{tmp_path}/{os.path.basename(p)}", p)
    assert store.read().where("late").count() == 0
    got = {(r["symbol"], r["date"]): (r["close"], r["rsi"]) for r in store.read().collect()}
    bars = spark.createDataFrame([(s, day(k), c) for (s, k), c in final.items()], SCHEMA)
    want = {(r["symbol"], r["date"]): (r["close"], r["rsi"]) for r in indicators.rsi(bars).collect()}
    assert got == want and len(want) == 160


def test_revised_too_late(spark, tmp_path):
    """A bar older than what is held comes out as late; equal bars give nothing."""
    bars = bars_of(spark)
    old = bars.where("date = '2024-01-03'").withColumn("close", F.lit(1.0))
    source = files([bars, bars.where("date > '2024-02-01'"), old], str(tmp_path))
    seen = []
    stream = refresh.streaming_rsi_revised(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source), keep=20)
    stream.writeStream.outputMode("update").foreachBatch(lambda rows, k: seen.append([tuple(r) for r in rows.collect()])).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert len(seen[0]) == 40 and not any(r[4] for r in seen[0])
    assert seen[1:] == [[], [("a", datetime.datetime(2024, 1, 3), 1.0, None, True)]]
