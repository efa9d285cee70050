"""Series in blocks against the windows over whole symbols, and the as-of join
against a loop: one long symbol, short ones, blocks shorter than a frame."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import blocks, indicators
from tidemark.operators import stats
from tidemark.operators.asof import asof_join


def series(spark, lengths, seed=2):
    rng = random.Random(seed)
    rows = []
    for s, n in lengths.items():
        c = 100.0
        for i in range(n):
            c = max(1.0, round(c + rng.choice([-1, 0, 1]) * rng.random() * 2, 2))
            rows.append((s, i, c, c + 1, c - 1))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "symbol string, date long, close double, high double, low double").repartition(6)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("bounds", [{}, {"width": 5, "min_gap": 5, "max_gap": 60}])
def test_signals(spark, bounds):
    bars = series(spark, {"a": 2500, "b": 90, "c": 3, "d": 1})
    want = indicators.excursions(indicators.divergence(indicators.rsi(bars), **bounds))
    assert len(wanted := rows_of(want)) > 100
    for size in (9, 170):  # shorter than a frame of 60 bars, and longer
        assert rows_of(blocks.signals(bars, size, **bounds)) == wanted
    assert blocks.signals(bars.limit(0)).count() == 0


@pytest.mark.parametrize("period", [1, 2, 14, 700])
def test_rsi_of_one_long_symbol(spark, period):
    """In many blocks, none much larger than asked for, with runs of 500 bars: the
    averages of a long period come from many runs before."""
    n = 60_000
    bars = series(spark, {"a": n, "b": 20})
    dealt = blocks.numbered(blocks.split(bars, 2000))
    sizes = [r["count"] for r in dealt.groupBy("symbol", "block").count().collect()]
    assert len(sizes) > 25 and max(sizes) < 4000
    got = {(r["symbol"], r["date"]): r["rsi"] for r in blocks.rsi(dealt, period, 500).collect()}
    want = {(r["symbol"], r["date"]): r["rsi"] for r in indicators.rsi_long(bars, period).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] is None if k[1] < period else abs(got[k] - v) < 0.011


def test_winrate(spark):
    bars = series(spark, {"a": 1500, "b": 700})
    want = stats.winrate(indicators.excursions(indicators.divergence(indicators.rsi(bars))))
    got = stats.winrate(blocks.stored(blocks.signals(bars, 100), "signals"))
    assert rows_of(got) == rows_of(want)


def test_asof(spark):
    """Most rows of one key, half of those at one instant; ties, null keys and times."""
    rng, day = random.Random(5), lambda i: datetime.date(2024, 1, 1) + datetime.timedelta(days=i)
    key = lambda: rng.choice(["hot"] * 8 + ["b", None])
    left = [(key(), day(40) if rng.random() < 0.5 else day(rng.randrange(90)) if rng.random() < 0.95 else None, i) for i in range(900)]
    left += left[:20]
    right = [(key(), day(3 * rng.randrange(25)) if rng.random() < 0.95 else None, rng.randrange(5), rng.choice([None, 1.5])) for _ in range(200)] + [("hot", day(39), 1, None)] * 300
    a = spark.createDataFrame(left, "k string, at date, order int")
    b = spark.createDataFrame(right, "k string, at date, r int, v double")
    value = lambda r: (r[2], r[3] is not None, r[3] or 0)
    for tolerance in (None, 4):
        want = []
        for k, at, i in left:
            fit = [r for r in right if k is not None and at is not None and r[0] == k and r[1] is not None and r[1] <= at]
            last = max(fit, key=lambda r: (r[1], value(r)), default=None)
            if last is not None and tolerance is not None and (at - last[1]).days > tolerance:
                last = None
            want.append((k, at, i, *(last[2:] if last else (None, None))))
        for size in (50, 10**6):
            got = asof_join(a, b, ["k"], "at", tolerance and f"{tolerance} days", size)
            assert got.columns == ["k", "at", "order", "r", "v"] and rows_of(got) == sorted(want, key=str)
    with_all = asof_join(a.where("k = 'b'"), b.where("k = 'hot'").drop("k"), [], "at")
    assert with_all.where("r is not null").count() == sum(k == "b" and at is not None and at >= min(r[1] for r in right if r[0] == "hot" and r[1]) for k, at, _ in left)
    assert asof_join(a, b.limit(0), ["k"], "at").where("r is null").count() == len(left)
    assert asof_join(a.limit(0), b, ["k"], "at").count() == 0
    with pytest.raises(ValueError):
        asof_join(a, b.withColumn("order", F.lit(1)), ["k"], "at")
