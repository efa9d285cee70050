"""The pruned nearest vectors against all pairs, and how much is compared."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import pivots

SCHEMA = "vec_id long, embedding array<double>, id string"


def brute(rows, every):
    """All pairs: the largest cosine to 4 places, then the smaller id."""
    good = [(i, np.array(v, float)) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in good:
        if i % every == 0:
            found = [(-round(float(v @ w / np.sqrt((v @ v) * (w @ w))), 4), j) for j, w in good if j != i]
            if found:
                out[i] = (min(found)[1], -min(found)[0])
    return out


def answers(df):
    return {r["vec_id"]: (r["match_id"], r["similarity"]) for r in df.collect()}


@pytest.mark.parametrize("block", [16, 10_000])
def test_exact(spark, block):
    """Clusters, copies of a query, a group that is a third of all rows, ties, odd vectors."""
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(12, 8))
    rows = [(i, [float(x) for x in np.round(centers[i % 12] + rng.normal(size=8) * 0.05, 3)], "x") for i in range(600)]
    rows += [(1000 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0], "x") for i in range(300)]  # one vector
    rows += [(2000, [2.0, 4.0, -0.0, 0.0, 0.0, 0.0, 0.0, 2.0], "x"), (2005, [1.0, 2.0, -0.0, 0.0, 0.0, 0.0, 0.0, 1.0], "x")]  # its double and its negative zero
    rows += [(3000, None, "x"), (3005, [0.0] * 8, "x"), (3010, [float("nan")] * 8, "x"), (3015, [None] + [1.0] * 7, "x"), (3020, [float("inf")] + [1.0] * 7, "x"), (None, [1.0] * 8, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert answers(pivots.nearest(df, 5, block=block)) == brute(rows, 5)


def test_prunes(spark):
    """In clustered vectors most groups are out of reach; all pairs are 2,000 for each query."""
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(20, 16)) * 3
    rows = [(i, [float(x) for x in centers[i % 20] + rng.normal(size=16) * 0.1], "x") for i in range(2000)]
    got = pivots.nearest(spark.createDataFrame(rows, SCHEMA), 20, block=64)
    assert got.agg(F.sum("n_compared")).first()[0] < 0.25 * 100 * 2000
    assert answers(got) == brute(rows, 20)


def test_small(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pivots.nearest(empty).count() == 0
    assert pivots.nearest(spark.createDataFrame([(20, [1.0, 2.0], "x")], SCHEMA)).count() == 0
    twins = [(20, [1.0, 2.0], "x"), (40, [1.0, 2.0], "x"), (41, [1.0, 2.0], "x")]
    assert answers(pivots.nearest(spark.createDataFrame(twins, SCHEMA))) == {20: (40, 1.0), 40: (20, 1.0)}
    huge = [(20, [1e200, 2e200], "x"), (1, [1e-200, 2e-200], "x"), (2, [1.0, 0.0], "x")]
    assert answers(pivots.nearest(spark.createDataFrame(huge, SCHEMA))) == {20: (1, 1.0)}
    with pytest.raises(ValueError):
        pivots.nearest(spark.createDataFrame([(1, [1.0], "x"), (2, [1.0, 2.0], "x")], SCHEMA))
