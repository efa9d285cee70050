"""Every query with its name; the DuckDB SQL of each is in ``oracle``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import blocks
from tidemark.functions import indicators as ind
from tidemark.operators import patterns, pivots, stats, waves
from tidemark.operators import zigzag as zz
from tidemark.operators.asof import asof_join
from tidemark.sources import bars as src
from tidemark.sources import chart, sinks
from tidemark.sources.store import BarStore

Query = Callable[[SparkSession, str], DataFrame]


def order_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ind.excursions(ind.divergence(ind.rsi(src.order_bars(spark, sf_dir))))


def winrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.winrate(order_signals(spark, sf_dir))


def rsi_wilder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ind.rsi(src.event_bars(spark, sf_dir)).select("symbol", "date", "close", "rsi")


def local_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ind.extremes(ind.positions(src.order_bars(spark, sf_dir))).where("is_peak or is_trough").select("symbol", "date", "close", "is_peak", "is_trough")


def divergence_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ind.divergence(ind.rsi(src.order_bars(spark, sf_dir))).where("signal <> 0").select("symbol", "date", "close", "rsi", "signal")


def divergence_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ind.divergence(ind.rsi(src.order_bars(spark, sf_dir)), width=5, min_gap=5, max_gap=60).where("signal <> 0").select("symbol", "date", "close", "rsi", "signal")


def side_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.side(order_signals(spark, sf_dir), "buy").where("horizon = 20 and max_profit is not null").select("symbol", "date", "signal", "max_profit")


def histogram_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(order_signals(spark, sf_dir), "max_drawdown")


def daily_flow(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    """Bars left-joined by date with the day's flow."""
    flow = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.to_date("l_shipdate").alias("date")).agg(F.round(F.sum("l_quantity"), 2).alias("flow"))
    return bars.join(flow, "date", "left").withColumn("flow", F.coalesce("flow", F.lit(0.0)))


def factor_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with the day's flow and its 5 and 20 day sums."""
    rows = daily_flow(spark, sf_dir, src.order_bars(spark, sf_dir))
    return rows.select("symbol", "date", "flow", F.round(ind.rolling_sum("flow", 5), 2).alias("flow_5"), F.round(ind.rolling_sum("flow", 20), 2).alias("flow_20"), F.round(ind.change_over("close", 5), 2).alias("change_5"), F.round(ind.moving_average("close", 20), 4).alias("ma_20"))


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of all orders before 1999, refreshed by bars of the urgent ones."""
    bars = src.order_bars(spark, sf_dir)
    newer = bars.where("date >= date'1998-06-01'").withColumn("close", F.round(F.col("close") + 1, 2))
    return src.upsert(bars.where("date < date'1999-01-01'"), newer).select("symbol", "date", "close")


def upsert_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars kept in a versioned store: a base and two deltas that change later
    bars, then merged into a new base."""
    bars = src.order_bars(spark, sf_dir)
    more = lambda day, x: bars.where(F.col("date") >= F.lit(day).cast("date")).withColumn("close", F.round(F.col("close") + x, 2))
    store = BarStore(spark, f"{blocks.shared_dir(spark)}/bars-{uuid.uuid4().hex}")
    store.write(bars.where("date < date'1999-01-01'"))
    store.write(more("1998-03-01", 1))
    store.write(more("1998-06-01", 2))
    store.compact()
    return store.read().select("symbol", "date", "close")


def factor_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with the last large trades known at their date, of five days at most."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity >= 49").select("l_orderkey", "l_shipdate", "l_extendedprice")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority")
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    trades = joined.groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date("l_shipdate").alias("date")).agg(F.count("*").alias("n_trades"), F.round(F.sum("l_extendedprice"), 2).alias("value"))
    return asof_join(src.order_bars(spark, sf_dir).select("symbol", "date", "close"), trades, ["symbol"], "date", "5 days")


def walk_waves(spark: SparkSession, sf_dir: str, pct: float = 5.0, range_days: int = 22) -> DataFrame:
    """Waves of a walk that does not return to its start, by blocks."""
    return zz.waves_in_blocks(src.order_walk(spark, sf_dir), pct, range_days=range_days)


def json_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars packed into parallel-array payloads (every seventh low is a gap) and
    taken apart again."""
    text = payload_texts(spark, sf_dir)
    return src.unnest_payload(text.select("symbol", F.from_json("json", src.PAYLOAD).alias("payload")))


def chart_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same payloads kept in an archive and asked for through the chart source,
    for the days of five years."""
    texts = payload_texts(spark, sf_dir)
    symbols = [r["symbol"] for r in texts.select("symbol").distinct().orderBy("symbol").collect()]  # five
    kept = chart.archive(texts, f"{blocks.shared_dir(spark)}/payloads-{uuid.uuid4().hex}")
    return chart.read_chart(spark, symbols, kept, first="1990-01-01").where("date >= date'1993-03-01' and date < date'1998-03-01'")


def payload_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, json) of each symbol and year."""
    bars = src.order_bars(spark, sf_dir).withColumn("low", F.when(F.dayofyear("date") % 7 != 0, F.col("low")))
    fields = F.array_sort(F.collect_list(F.struct(F.unix_timestamp(F.col("date").cast("timestamp")).alias("timestamp"), *src.OHLC)))
    packed = bars.groupBy("symbol", F.year("date").alias("y")).agg(fields.alias("r"))
    quote = F.struct(*[F.col(f"r.{c}").alias(c) for c in src.OHLC])
    result = F.struct(F.col("r.timestamp").alias("timestamp"), F.struct(F.array(quote).alias("quote")).alias("indicators"))
    payload = F.struct(F.struct(F.array(result).alias("result")).alias("chart"))
    return packed.select("symbol", F.to_json(payload).alias("json"))


def gap_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = src.order_bars(spark, sf_dir).withColumn("open", F.when(F.dayofmonth("date") != 13, F.col("open")))
    return src.drop_gaps(bars).select("symbol", "date", "open", "close")


def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.fresh(src.order_bars(spark, sf_dir), "2001-08-02")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waves.sign_runs(src.order_index(spark, sf_dir))


def wave_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).select("symbol", "seq", "type", "start_date", "end_date", "start_val", "end_val", "pct", F.round("point_change", 2).alias("point_change"), "days", "total_vol", F.round("vpp", 4).alias("vpp"))


def zigzag(spark: SparkSession, sf_dir: str, pct: float = 5.0) -> DataFrame:
    return waves.waves(src.order_index(spark, sf_dir), pct)


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zigzag's legs, without range waves."""
    return waves.waves(src.order_index(spark, sf_dir), range_days=2**31 - 1)


def index_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = src.order_index(spark, sf_dir)
    return index.select("symbol", "date", F.col("close").alias("open"), F.col("close").alias("high"), F.col("close").alias("low"), "close", "volume")


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = index_bars(spark, sf_dir)
    return patterns.scan(bars, 30).unionByName(patterns.scan(bars, 45))


def resonance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scans(spark, sf_dir)
    return patterns.resonance(found.where("period = 30"), found.where("period = 45"))


def segments_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wave segments written to one ordered CSV file with a byte order mark, and read back."""
    rows = sinks.segments(runs(spark, sf_dir))
    path = f"{blocks.shared_dir(spark)}/segments-{uuid.uuid4().hex}.csv"
    sinks.write_one_csv(rows, path, [F.col("symbol"), F.col("start_date"), F.col("end_date")], bom=True)
    return spark.read.schema(rows.schema).csv(path, header=True)


def window_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = patterns.window_vectors(src.order_bars(spark, sf_dir), 30)
    return shapes.select("symbol", "date", F.round(F.element_at("vec", 1), 4).alias("first"), F.round(F.element_at("vec", -1), 4).alias("last"))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winrate(spark, sf_dir).withColumns({"win_rate": ind.rounded(F.col("win_rate"), 2), "median_profit": ind.rounded(F.col("median_profit"), 3)})
    return sinks.report_lines(found, "%4d | %3d | %8d | %8.2f | %8.3f", ["horizon", "signal", "n_signals", "win_rate", "median_profit"])


def queries() -> dict[str, Query]:
    return {
        "bars_events": lambda s, d: src.event_bars(s, d),
        "bars_orders": lambda s, d: src.order_bars(s, d),
        "index_orders": lambda s, d: src.order_index(s, d),
        "rsi_wilder": rsi_wilder,
        "rsi_recursive": lambda s, d: ind.rsi_long(src.event_bars(s, d)).select("symbol", "date", "close", "rsi"),
        "local_extremes": local_extremes,
        "divergence_v1": divergence_v1,
        "divergence_v2": divergence_v2,
        "forward_excursion": order_signals,
        "side_filter": side_filter,
        "winrate": winrate,
        "histogram": lambda s, d: stats.histogram(order_signals(s, d)).orderBy("horizon", "bin"),
        "histogram_drawdown": histogram_drawdown,
        "series_summary": lambda s, d: stats.summary(src.order_bars(s, d)),
        "factor_join": factor_join,
        "upsert_latest": upsert_latest,
        "json_unnest": json_unnest,
        "chart_read": chart_read,
        "gap_drop": gap_drop,
        "freshness": freshness,
        "wave_runs": wave_runs,
        "vpp_by_type": lambda s, d: waves.vpp_by_type(runs(s, d)),
        "wave_statistics": lambda s, d: waves.wave_statistics(runs(s, d)),
        "wave_symmetry": lambda s, d: waves.symmetry(runs(s, d)),
        "exhaustion": lambda s, d: waves.exhaustion(runs(s, d)),
        "winrate_levels": lambda s, d: waves.winrate_levels(runs(s, d)),
        "waves_zigzag": zigzag,
        "waves_long": lambda s, d: zigzag(s, d, 10.0),
        "zigzag_legs": legs,
        "open_leg": lambda s, d: waves.open_wave(legs(s, d), src.order_index(s, d)),
        "wave_flow": lambda s, d: waves.wave_flow(runs(s, d), daily_flow(s, d, src.order_index(s, d))),
        "wave_segments": lambda s, d: sinks.segments(runs(s, d)),
        "segments_csv": segments_csv,
        "wave_report": lambda s, d: sinks.wave_report(runs(s, d)),
        "walk_index": lambda s, d: src.order_walk(s, d),
        "walk_waves": walk_waves,
        "walk_waves_long": lambda s, d: walk_waves(s, d, 10.0),
        "walk_legs": lambda s, d: walk_waves(s, d, range_days=2**31 - 1),
        "walk_open_wave": lambda s, d: waves.open_wave(walk_waves(s, d), src.order_walk(s, d)),
        "rsi_blocks": lambda s, d: blocks.rsi(blocks.numbered(blocks.split(src.event_bars(s, d)))).select("symbol", "date", "close", "rsi"),
        "signals_blocks": lambda s, d: blocks.signals(src.order_bars(s, d)),
        "signals_v2_blocks": lambda s, d: blocks.signals(src.order_bars(s, d), width=5, min_gap=5, max_gap=60),
        "winrate_blocks": lambda s, d: stats.winrate(blocks.stored(blocks.signals(src.order_bars(s, d)), "signals")),
        "upsert_store": upsert_store,
        "factor_asof": factor_asof,
        "early_warning": lambda s, d: waves.early_warning(src.order_index(s, d)),
        "open_wave": lambda s, d: waves.open_wave(zigzag(s, d), src.order_index(s, d)),
        "window_shape": window_shape,
        "embedding_top1": lambda s, d: patterns.top_cosine(s.read.parquet(f"{d}/embeddings.parquet")),
        "embedding_top1_all": lambda s, d: patterns.nearest(s.read.parquet(f"{d}/embeddings.parquet")),
        "embedding_top1_pruned": lambda s, d: pivots.nearest(s.read.parquet(f"{d}/embeddings.parquet")).select("vec_id", "match_id", "similarity"),
        "pattern_scan": lambda s, d: scans(s, d).select("period", "symbol", "date", "direction", "pattern", "similarity", "match_symbol", "match_date", "match_move", "status").orderBy("period", F.desc("similarity"), "symbol"),
        "pattern_status": lambda s, d: patterns.status_counts(scans(s, d)),
        "pattern_top": lambda s, d: patterns.top_per_list(scans(s, d)).select("period", "direction", "rank", "symbol", "similarity"),
        "resonance": resonance,
        "api_envelope": lambda s, d: sinks.envelope(order_signals(s, d), stats.summary(src.order_bars(s, d)), list(ind.HORIZONS), F.to_timestamp(F.substring_index("data_range", " ~ ", -1))),
        "text_report": report,
    }
