"""Incremental refresh: a file stream whose micro-batches are added to a
bar store, and RSI and divergences that carry their state from batch to batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.store import BarStore


def stream_upsert(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str):
    """Read new parquet bars from ``source`` and add each batch as a delta to the
    ``BarStore`` at ``target``; a later bar replaces an earlier one of its date, and
    a retried batch is added once.  Within a batch, where no order is known, the
    bar with the largest volume stays, ties by the other columns.  Returns the query."""
    store = BarStore(spark, target)

    def merge(batch: DataFrame, number: int) -> None:
        store.write(batch, stream=source, batch=number)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_bars(ticks: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Tumbling hourly bars of a stream (symbol, ts, price) with a watermark."""
    at = F.struct("ts")
    return ticks.withWatermark("ts", delay).groupBy("symbol", F.window("ts", "1 hour")).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count("*").alias("volume"))


def wilder(state: tuple, close: float, period: int) -> tuple[float | None, tuple]:
    """The RSI at a bar and the state (bars, last close, mean gain, mean loss) after it."""
    n, last, up, down = state
    if n:
        gain, loss = max(close - last, 0.0), max(last - close, 0.0)
        if n <= period:
            up, down = up + gain / period, down + loss / period
        else:
            up, down = (up * (period - 1) + gain) / period, (down * (period - 1) + loss) / period
    value = None if n < period else 100.0 if down == 0 else round(100 * up / (up + down), 2)
    return value, (n + 1, float(close), up, down)


START = (0, 0.0, 0.0, 0.0)


def streaming_rsi(bars: DataFrame, period: int = 14) -> DataFrame:
    """(symbol, date, close, rsi) of a stream of bars in date order."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else START
        rows = pd.concat(list(batches)).sort_values("date")
        out = []
        for close in rows["close"]:
            value, now = wilder(now, close, period)
            out.append(value)
        state.update(now)
        yield pd.DataFrame({"symbol": key[0], "date": rows["date"], "close": rows["close"], "rsi": pd.Series(out, index=rows.index, dtype=float)})

    kind = dict(bars.dtypes)["date"]
    return bars.groupBy("symbol").applyInPandasWithState(run, f"symbol string, date {kind}, close double, rsi double", "n long, last double, up double, down double", "append", GroupStateTimeout.NoTimeout)


def streaming_rsi_revised(bars: DataFrame, period: int = 14, keep: int = 256) -> DataFrame:
    """(symbol, date, close, rsi, late) of a stream whose bars may come again or out of
    order: a bar for a known date replaces the one that was there, and the RSI of every
    later date follows.  Of several bars of a date in one batch the one with the largest
    close stays, as no order is known.  A batch gives the rows that are new or have
    changed, so the last row of each date is that of a batch run over the final bars.

    A symbol's state is its last ``keep`` bars and a snapshot of the averages before
    them, so it does not grow; a batch is replayed from the snapshot.  A bar older than
    the snapshot changes values that are no longer held: it comes out with ``late`` and
    no RSI, and the symbol's later values wait for a batch run over the stored bars.
    ``keep`` bounds what a revision may reach back, not the rows of a batch."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    kind = dict(bars.dtypes)["date"]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        *base, dates, closes, values = state.get if state.exists else (*START, [], [], [])
        base, held = tuple(base), dict(zip(dates, zip(closes, values, strict=True), strict=True))
        first = min(held, default=None)
        new: dict = {}
        for batch in batches:
            for date, close in zip(batch["date"], batch["close"], strict=True):
                new[date] = max(float(close), new.get(date, float("-inf")))
        late = {d: c for d, c in new.items() if base[0] and first is not None and d < first}
        merged = {d: c for d, (c, _) in held.items()} | {d: c for d, c in new.items() if d not in late}
        out = [(key[0], d, c, None, True) for d, c in sorted(late.items())]
        now, rows = base, []
        for date in sorted(merged):
            before = now
            value, now = wilder(now, merged[date], period)
            value = float("nan") if value is None else value
            rows.append((before, date, merged[date], value))
            known = held.get(date)
            if known is None or known[0] != merged[date] or not (known[1] == value or (known[1] != known[1] and value != value)):
                out.append((key[0], date, merged[date], None if value != value else value, False))
        rows = rows[-keep:]
        state.update((*rows[0][0], [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows]) if rows else (*base, [], [], []))
        yield pd.DataFrame(out, columns=["symbol", "date", "close", "rsi", "late"]).astype({"rsi": float, "late": bool})

    held = f"n long, last double, up double, down double, dates array<{kind}>, closes array<double>, rsis array<double>"
    return bars.groupBy("symbol").applyInPandasWithState(run, f"symbol string, date {kind}, close double, rsi double, late boolean", held, "update", GroupStateTimeout.NoTimeout)


def streaming_signals(bars: DataFrame, period: int = 14, lookback: int = 20, width: int = 3) -> DataFrame:
    """(symbol, date, close, rsi, signal) of a stream of bars in date order: the
    divergences of ``indicators.divergence``, each ``width`` bars late, when its
    extreme is sure.  A symbol's state is its last 2 * width + 1 bars, the previous
    extremes and the averages of the RSI, so it does not grow."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    kind = dict(bars.dtypes)["date"]
    span = 2 * width + 1
    nan = float("nan")

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.exists:
            *now, dates, closes, values, before = state.get
            now, dates, closes, values, before = tuple(now), list(dates), list(closes), list(values), list(before)
        else:
            now, dates, closes, values, before = START, [], [], [], [nan] * 4  # the last trough's close and RSI, the last peak's
        out = []
        rows = pd.concat(list(batches)).sort_values("date")
        for date, close in zip(rows["date"], rows["close"], strict=True):
            value, now = wilder(now, close, period)
            dates, closes, values = [*dates, date][-span:], [*closes, float(close)][-span:], [*values, nan if value is None else value][-span:]
            if len(closes) < span:
                continue
            c, r, others = closes[width], values[width], closes[:width] + closes[width + 1 :]
            ready = now[0] - 1 - width >= lookback
            if c < min(others):
                if ready and c < before[0] and r > before[1]:
                    out.append((key[0], dates[width], c, r, 1))
                before[:2] = c, r
            elif c > max(others):
                if ready and c > before[2] and r < before[3]:
                    out.append((key[0], dates[width], c, r, -1))
                before[2:] = c, r
        state.update((*now, dates, closes, values, before))
        yield pd.DataFrame(out, columns=["symbol", "date", "close", "rsi", "signal"])

    held = f"n long, last double, up double, down double, dates array<{kind}>, closes array<double>, rsis array<double>, before array<double>"
    return bars.groupBy("symbol").applyInPandasWithState(run, f"symbol string, date {kind}, close double, rsi double, signal int", held, "append", GroupStateTimeout.NoTimeout)
