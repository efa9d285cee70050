"""Exact nearest vectors by metric pruning.

Cosine orders unit vectors as their distance does, and distances obey the triangle
inequality: with the distances from a query and from a group's members to some pivots,
``|d(query, pivot) - d(member, pivot)|`` bounds from below how near the group may come.
A query first meets the group that it would be put into itself, which gives it a
similarity to beat, and then only those groups whose bound lets them reach it.

Equal vectors are one row throughout, so copies cost nothing; a large group is met in
blocks.  What tasks are given beside rows are the pivots and, for each group and pivot,
the smallest and largest distance: at most GROUPS * PIVOTS pairs of numbers."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.blocks import stored

PIVOTS = 64
GROUPS = 1024
#: Vectors a group has at least on average, and those of one block.
BLOCK = 1024
#: Similarities count by 4 places, so one that is less by under a unit of the last may tie.
SLACK = 1e-4 + 1e-9
SALTS = 8


def doubles(name: str) -> Column:
    """Components as doubles, one zero for both signs, so that equal vectors hash alike."""
    return F.transform(F.transform(name, lambda x: x.cast("double")), lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))


def classes(vectors: DataFrame, every: int) -> DataFrame:
    """(id, second, h1, h2, v, asks) of distinct vectors: the two smallest ids, and
    whether a query is among their rows.  Vectors that are null, of length 0 or hold a
    null or no finite number take no part."""
    rows = vectors.select("vec_id", doubles("embedding").alias("v")).where(F.col("vec_id").isNotNull() & F.forall("v", lambda x: F.abs(x) < float("inf")) & F.exists("v", lambda x: x != 0))
    asks = F.max(F.col("vec_id") % every == 0).alias("asks")
    ids = rows.groupBy("v").agg(F.min("vec_id").alias("id"), F.max("vec_id").alias("top"), F.count("*").alias("n"), asks)
    # The second smallest id counts only where one vector has several ids: a small join.
    several = ids.where("top > id").select("v", F.col("id").alias("_id"))
    second = rows.join(several, "v").where("vec_id > _id").groupBy("v").agg(F.min("vec_id").alias("second"))
    return ids.join(second, "v", "left").select("id", "second", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(7), "v").alias("h2"), "v", "asks")


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that squares neither overflow nor vanish: no digit
    of a cosine changes."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1])


def unit(v: np.ndarray) -> np.ndarray:
    v = scaled(v)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def distances(u: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (u @ pivots.T), 0))


def matrix(lists) -> np.ndarray:
    return np.asarray([np.asarray(x, float) for x in lists]).reshape(len(lists), -1)


def choose(rows: DataFrame, n: int) -> np.ndarray:
    """Up to ``n`` pivots, far from each other, from a sample of 16 * n."""
    sample = unit(matrix([r["v"] for r in rows.orderBy(F.hash("v"), "id").limit(16 * n).select("v").collect()]))
    far, picked = np.full(len(sample), np.inf), [0]
    while len(picked) < min(n, len(sample)):
        far = np.minimum(far, distances(sample, sample[picked[-1:]])[:, 0])
        if far.max() < 1e-6:
            break
        picked.append(int(far.argmax()))
    return sample[picked]


def grouped(rows: DataFrame, pivots: np.ndarray, rings: int) -> DataFrame:
    """``rows`` with their group g: the nearest pivot and, where there are several
    ``rings``, the range of distances to it."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                d = distances(unit(matrix(batch["v"])), pivots)
                yield batch.assign(home=d.argmin(1), near=d.min(1))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    placed = rows.mapInPandas(place, f"{fields}, home int, near double")
    if rings == 1:
        return stored(placed.withColumn("g", F.col("home")).drop("near"), "groups")
    placed = stored(placed, "homes")
    cuts = placed.groupBy("home").agg(F.percentile_approx("near", [k / rings for k in range(1, rings)], 1000).alias("cuts"))
    ring = F.aggregate("cuts", F.lit(0), lambda s, x: s + F.when(F.col("near") > x, 1).otherwise(0))
    return stored(placed.join(F.broadcast(cuts), "home").withColumn("g", F.col("home") * rings + ring).drop("near", "cuts"), "groups")


def limits(rows: DataFrame, pivots: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smallest and largest distance of each group to each pivot, and its rows."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low, high, n = np.full((n_groups, len(pivots)), np.inf), np.full((n_groups, len(pivots)), -np.inf), np.zeros(n_groups, int)
        for batch in batches:
            if len(batch):
                d, g = distances(unit(matrix(batch["v"])), pivots), batch["g"].to_numpy()
                np.minimum.at(low, g, d)
                np.maximum.at(high, g, d)
                n += np.bincount(g, minlength=n_groups)
        for g in np.flatnonzero(n):
            yield pd.DataFrame({"g": g, "p": np.arange(len(pivots)), "low": low[g], "high": high[g], "n": n[g]})

    found = rows.select("v", "g").mapInPandas(measure, "g int, p int, low double, high double, n long")
    low, high, n = np.full((n_groups, len(pivots)), np.inf), np.full((n_groups, len(pivots)), -np.inf), np.zeros(n_groups, int)
    for r in found.groupBy("g", "p").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).collect():  # n_groups * pivots
        low[r["g"], r["p"]], high[r["g"], r["p"]], n[r["g"]] = r["low"], r["high"], r["n"]
    return low, high, n


def nearest(vectors: DataFrame, every: int = 20, pivots: int = PIVOTS, groups: int = GROUPS, block: int = BLOCK) -> DataFrame:
    """(vec_id, match_id, similarity, n_compared): for each query (ids divisible by
    ``every``) the other vector of the largest cosine, to 4 places; ties go to the
    smaller id.  n_compared counts the distinct vectors that the query's was compared
    with, itself included.  The result is exact, whatever the numbers of pivots and
    groups; vectors are of one length, other lengths raise.  A query that is alone
    gives no row, an empty table none."""
    rows = stored(classes(vectors, every), "classes")
    total = rows.count()
    schema = "vec_id long, match_id long, similarity double, n_compared long"
    if total == 0:
        return vectors.sparkSession.createDataFrame([], schema)
    if rows.select(F.size("v").alias("n")).distinct().count() > 1:
        raise ValueError("vectors of several lengths have no distance")
    centers = choose(rows, max(1, min(pivots, total // block)))
    rings = max(1, min(groups // len(centers), math.ceil(total / block / len(centers))))
    n_groups = len(centers) * rings
    rows = grouped(rows, centers, rings)
    low, high, sizes = limits(rows, centers, n_groups)
    n_blocks = np.maximum(-(-sizes // block), 1)

    of = F.array(*[F.lit(int(n)) for n in n_blocks])
    one = rows.withColumn("b", F.pmod(F.xxhash64("v"), of[F.col("g")])).groupBy("g", "b")
    blocks = stored(one.agg(F.collect_list("id").alias("e"), F.flatten(F.collect_list("v")).alias("ev")), "blocks")
    asking = rows.where("asks")
    n_asking = -(-asking.count() // block) or 1
    asking = asking.withColumn("qb", F.pmod(F.xxhash64("v"), F.lit(n_asking))).select("qb", "id", "v", F.col("g").alias("own"))

    def pair(batches: Iterator[pd.DataFrame], every_group: bool) -> Iterator[pd.DataFrame]:
        """A row for each group that some query of a batch must meet, with those queries."""
        for batch in batches:
            if not len(batch):
                continue
            v, own = matrix(batch["v"]), batch["own"].to_numpy()
            must = np.zeros((len(v), n_groups), bool)
            if every_group:
                d, gap = distances(unit(v), centers), np.zeros((len(v), n_groups))
                for p in range(len(centers)):
                    gap = np.maximum(gap, np.maximum(d[:, p, None] - high[None, :, p], low[None, :, p] - d[:, p, None]))
                best = batch["similarity"].fillna(-np.inf).to_numpy()
                # Distances are right to some 1e-8, near 0 to 1e-7.
                must = 1 - np.maximum(gap - 1e-6, 0) ** 2 / 2 >= best[:, None] - SLACK
                must &= sizes[None, :] > 0
                must[np.arange(len(v)), own] = False
            else:
                must[np.arange(len(v)), own] = True
            ids = batch["id"].to_numpy()
            for g in np.flatnonzero(must.any(0)):
                at = must[:, g]
                yield pd.DataFrame({"g": [g], "bs": [list(range(n_blocks[g]))], "q": [ids[at]], "qv": [v[at].ravel()]})

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for q, e, qv, ev in zip(batch["q"], batch["e"], batch["qv"], batch["ev"], strict=True):
                order = np.argsort(e, kind="stable")
                q, e = np.asarray(q), np.asarray(e)[order]
                qv, ev = scaled(np.asarray(qv).reshape(len(q), -1)), scaled(np.asarray(ev).reshape(len(e), -1)[order])
                found = np.round(qv @ ev.T / np.sqrt(np.outer((qv * qv).sum(1), (ev * ev).sum(1))), 4)
                found[q[:, None] == e[None, :]] = -np.inf
                at = found.argmax(1)  # the first, so the smaller id
                best = found[np.arange(len(q)), at]
                yield pd.DataFrame({"id": q, "m": np.where(np.isfinite(best), e[at], -1), "s": best, "n": len(e)})

    def met(asking: DataFrame, every_group: bool) -> DataFrame:
        pairs = asking.mapInPandas(lambda batches: pair(batches, every_group), "g int, bs array<int>, q array<long>, qv array<double>")
        pairs = pairs.withColumn("b", F.explode("bs")).drop("bs")
        return stored(pairs.join(blocks, ["g", "b"]).select("q", "e", "qv", "ev").mapInPandas(meet, "id long, m long, s double, n long"), "met")

    best = F.max(F.when(F.col("s") > -2, F.struct("s", (-F.col("m")).alias("m")))).alias("b")
    first = met(asking, False)
    seen = first.groupBy("id").agg(best)
    second = met(asking.join(seen.select("id", F.col("b.s").alias("similarity")), "id"), True)
    answer = first.unionByName(second).groupBy("id").agg(best, F.sum("n").alias("n_compared"))
    # Rows of one vector: each is the other's match where no smaller id is as near.
    salted = answer.join(rows.select("id", "second", "h1", "h2"), "id").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    v = doubles("embedding")
    members = vectors.where(F.col("vec_id") % every == 0).select("vec_id", F.xxhash64(v).alias("h1"), F.xxhash64(F.lit(7), v).alias("h2"), F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int").alias("salt"))
    twin = F.when(F.col("vec_id") > F.col("id"), F.col("id")).otherwise(F.col("second"))
    other = F.struct(F.lit(1.0).alias("s"), (-twin).alias("m"))
    top = F.greatest(F.col("b"), F.when(twin.isNotNull(), other))
    out = members.distinct().join(salted, ["h1", "h2", "salt"]).withColumn("b", top).where("b is not null")
    return out.select("vec_id", (-F.col("b.m")).alias("match_id"), F.col("b.s").alias("similarity"), "n_compared")
