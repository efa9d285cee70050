"""RSI of series longer than doubles hold growing weights for, against the recursion."""

import random

import pytest

from tidemark.functions import indicators


@pytest.mark.parametrize("period", [2, 14])
def test_rsi_any_length(spark, period):
    rng = random.Random(9)
    rows = [(s, i, round(100 + rng.gauss(0, 5), 2)) for s, n in (("a", 12000), ("b", 4097), ("c", 20)) for i in range(n)]
    bars = spark.createDataFrame(rows, "symbol string, date long, close double")
    got = {(r["symbol"], r["date"]): r["rsi"] for r in indicators.rsi(bars, period).collect()}
    want = {(r["symbol"], r["date"]): r["rsi"] for r in indicators.rsi_long(bars, period).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] is None if k[1] < period else abs(got[k] - v) < 0.011
