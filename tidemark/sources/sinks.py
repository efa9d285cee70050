"""Sinks: JSON envelope, CSV and fixed-width text report."""

from __future__ import annotations

import csv
import io
import re
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.indicators import rounded


def envelope(signals: DataFrame, summary: DataFrame, future_days: list[int] | None = None, updated: Column | None = None) -> DataFrame:
    """One JSON document per symbol: {symbol, data_range, total_days,
    last_update, future_days, signals}.  ``signals`` is in long form (one row per
    horizon); each signal holds an object of its returns by horizon, null where
    none are known, in order of date.  last_update is ``updated`` as text, if given."""
    known = F.when(F.col("max_profit").isNotNull() | F.col("max_drawdown").isNotNull(), F.struct("max_profit", "max_drawdown"))
    by_horizon = F.array_sort(F.collect_list(F.struct("horizon", known.alias("r"))))
    pairs = F.transform(by_horizon, lambda x: F.struct(x["horizon"].cast("string").alias("key"), x["r"].alias("value")))
    record = signals.groupBy("symbol", "date", "close", "rsi", "signal").agg(F.map_from_entries(pairs).alias("returns"))
    entry = F.struct(F.col("date").cast("string").alias("date"), "close", "rsi", "signal", "returns")

    def order(x: Column, y: Column) -> Column:
        a, b = (F.struct(e["date"], e["signal"]) for e in (x, y))
        return F.when(a < b, F.lit(-1)).when(a > b, F.lit(1)).otherwise(F.lit(0))

    lists = record.groupBy("symbol").agg(F.array_sort(F.collect_list(entry), order).alias("signals"))
    days = F.array(*[F.lit(d) for d in future_days]) if future_days else F.array().cast("array<int>")
    out = summary.join(lists, "symbol", "left").withColumn("signals", F.coalesce("signals", F.array().cast(lists.schema["signals"].dataType)))
    out = out.withColumns({"future_days": days, "last_update": F.lit(None).cast("string") if updated is None else F.date_format(updated, "yyyy-MM-dd HH:mm:ss")})
    document = F.struct("symbol", "data_range", "total_days", "last_update", "future_days", "signals")
    return out.select("symbol", F.to_json(document, {"ignoreNullFields": "false"}).alias("json"))


#: Fixed values of the pattern file: its columns and the words of its cells.
PATTERN_COLUMNS = ["股票代碼", "股票名稱", "週期", "型態分類", "預測方向", "最新日期", "最新收盤", "型態相似度", "當前狀態", "匹配歷史股票", "歷史爆發日期", "歷史參考漲跌幅"]
DIRECTIONS = {"up": "大漲", "down": "大跌"}


def write_csv(df: DataFrame, path: str, order: list[Column], bom: bool = False) -> None:
    """A folder of CSV parts in the given order, each with a header and, with
    ``bom``, a byte order mark.  ``write_one_csv`` makes a single file."""
    rows = df.orderBy(*order)
    if bom:
        rows = rows.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_one_csv(df: DataFrame, path: str, order: list[Column], bom: bool = False) -> None:
    """One CSV file at ``path``: one header, then all rows in the given order (rows
    that it does not tell apart come in any order); ``bom`` puts a byte order mark
    before it, which spreadsheets read UTF-8 by.

    Ranges of the order are sorted and written by as many tasks as there are; then
    their files are put one after the other, a small buffer at a time, into a draft
    that is renamed to ``path``, whatever stood there.  A job that dies before that
    leaves the old file as it was.  Without rows the file is the header alone."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    hadoop = jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    fs = target.getFileSystem(conf)
    target = target.makeQualified(fs.getUri(), fs.getWorkingDirectory())
    work = hadoop.Path(target.getParent(), f".{target.getName()}-{uuid.uuid4().hex}")
    head = io.StringIO()
    csv.writer(head, lineterminator="\n").writerow(df.columns)
    try:
        df.orderBy(*order).write.option("header", False).csv(hadoop.Path(work, "parts").toString())
        places = {}
        for found in fs.listStatus(hadoop.Path(work, "parts")):
            place = re.match(r"part-(\d+)-.*-c(\d+)", found.getPath().getName())
            if place:
                places[int(place[1]), int(place[2])] = found.getPath()
        draft = hadoop.Path(work, "draft")
        out = fs.create(draft)
        try:
            out.write(bytearray(("\ufeff" * bom + head.getvalue()).encode()))
            for _, part in sorted(places.items()):
                source = fs.open(part)
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
                finally:
                    source.close()
        finally:
            out.close()
        over = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        over[0] = hadoop.Options.Rename.OVERWRITE
        hadoop.FileContext.getFileContext(target.toUri(), conf).rename(draft, target, over)
    finally:
        fs.delete(work, True)


def segments(waves: DataFrame) -> DataFrame:
    """The columns of the segments file, after the symbol."""
    return waves.select("symbol", "type", "start_date", "end_date", "start_val", "end_val", "pct", F.round("point_change", 2).alias("point_change"), "days", "total_vol", "vpp")


def pattern_rows(scan: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """The pattern file's twelve text columns.  names: (symbol, name); a symbol
    without one is its own name."""
    rows = scan.withColumn("name", F.col("symbol")) if names is None else scan.join(names, "symbol", "left").withColumn("name", F.coalesce("name", "symbol"))
    ways = F.create_map(*[F.lit(x) for pair in DIRECTIONS.items() for x in pair])
    cells = [
        F.col("symbol"), F.col("name"), F.format_string("%d日", "period"), F.col("pattern"), ways[F.col("direction")], F.col("date").cast("string"), F.col("close").cast("string"),
        F.format_string("%.2f%%", "similarity"), F.col("status"), F.col("match_symbol"), F.col("match_date").cast("string"), F.format_string("%.2f%%", "match_move"),
    ]
    return rows.select(*[c.alias(n) for c, n in zip(cells, PATTERN_COLUMNS, strict=True)])


def wave_report(waves: DataFrame) -> DataFrame:
    """Report lines (symbol, section, value): the open wave, then each type's
    count, mean and median size and mean days.  Medians of an even count often end
    in half a hundredth, so halves are rounded as in SQL."""
    now = waves.where("is_open").select("symbol", F.lit(1).alias("section"), F.format_string("open wave: %-5s since %s (%.2f), now %.2f, %.2f%%, %d days", "type", F.col("start_date").cast("string"), "start_val", "end_val", "pct", "days").alias("value"))
    size = F.abs("pct")
    types = waves.groupBy("symbol", "type").agg(F.count("*").alias("n"), rounded(F.avg(size), 2).alias("mean"), rounded(F.median(size), 2).alias("median"), rounded(F.avg("days"), 1).alias("days"))
    return now.unionByName(types.select("symbol", F.lit(2).alias("section"), F.format_string("%-5s waves: %5d, mean %6.2f%% (median %6.2f%%), %5.1f days", "type", "n", "mean", "median", "days").alias("value")))


def report_lines(df: DataFrame, pattern: str, columns: list[str]) -> DataFrame:
    """Fixed-width lines (value) by a printf pattern, for ``write.text``."""
    return df.select(F.format_string(pattern, *[F.col(c) for c in columns]).alias("value"))
