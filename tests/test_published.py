"""Published figures of down waves: symmetry and win-rate levels."""

import datetime

from tidemark.operators import waves

# Sizes of 16 down waves in order, the last one open.
SIZES = [1.31, 9.1, 4.89, 5.01, 18.44, 6.25, 5.94, 11.24, 13.35, 13.16, 10.96, 19.37, 6.62, 13.27, 16.35, 17.5]
# Win rate, ratio, target percent, price, reached.
LEVELS = [
    (1.0, 0.3389, 5.54, 41254.81, True), (0.9, 0.3418, 5.59, 41234.61, True), (0.8, 0.5374, 8.79, 39837.88, True), (0.7, 0.9504, 15.54, 36888.43, True), (0.6, 1.0245, 16.75, 36359.00, True),
    (0.5, 1.0703, 17.50, 36031.97, False), (0.4, 1.2321, 20.14, 34876.82, False), (0.3, 1.7673, 28.90, 31054.78, False), (0.2, 2.0045, 32.77, 29361.00, False), (0.1, 3.6806, 60.18, 17392.11, False),
]


def test_down_waves(spark):
    day = datetime.date(2026, 1, 1)
    rows = [("x", k, "down", day, day, 43675.12, 36033.29, -p, 1, 1, k == len(SIZES) - 1) for k, p in enumerate(SIZES)]
    df = spark.createDataFrame(rows, "symbol string, seq int, type string, start_date date, end_date date, start_val double, end_val double, pct double, days int, total_vol long, is_open boolean")
    near = waves.symmetry(df).first()
    assert (near["n_pairs"], near["mean_ratio_pct"], near["near_pct"]) == (15, 165.29, 46.67)
    got = sorted((r["win_rate"], r["ratio"], r["target_pct"], r["price"], r["reached"]) for r in waves.winrate_levels(df).collect())
    assert got == sorted(LEVELS)
