"""Window shapes, historical matches and scans.  Shape vectors are z-scores of
the last ``size`` closes; similarity is the cosine; both are this library's own
contract.  The top-1 search of a scan is blocked by cluster, so a query meets the
events of its cluster only; ``nearest`` meets all vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOVE = 12.0


def window_vectors(bars: DataFrame, size: int = 30) -> DataFrame:
    """(symbol, date, close, vec): only full windows that are not flat."""
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(1 - size, 0)
    rows = bars.select("symbol", "date", "close", F.collect_list("close").over(w).alias("c"), F.avg("close").over(w).alias("m"), F.stddev_pop("close").over(w).alias("s"))
    return rows.where((F.size("c") == size) & (F.col("s") > 0)).select("symbol", "date", "close", F.transform("c", lambda x: (x - F.col("m")) / F.col("s")).alias("vec"))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def event_library(bars: DataFrame, size: int = 30, ahead: int = 20, move: float = MOVE) -> DataFrame:
    """Windows before a rise or fall of ``move`` percent within ``ahead`` bars."""
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(1, ahead)
    up, down = (F.max("high").over(w) / F.col("close") - 1) * 100, (F.min("low").over(w) / F.col("close") - 1) * 100
    moved = bars.select("symbol", "date", up.alias("up"), down.alias("down"))
    rows = window_vectors(bars, size).join(moved, ["symbol", "date"])
    best = F.when(F.col("up") >= -F.col("down"), F.col("up")).otherwise(F.col("down"))
    return rows.withColumn("move", F.round(best, 2)).where(F.abs("move") >= move).select("symbol", "date", "vec", "move", F.when(F.col("move") > 0, "up").otherwise("down").alias("direction"))


def cluster(events: DataFrame, k: int = 10, seed: int = 42):
    """(model, events with ``cluster``)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=k, seed=seed, featuresCol="x", predictionCol="cluster").fit(events.withColumn("x", array_to_vector("vec")))
    return model, assign(model, events)


def assign(model, rows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return model.transform(rows.withColumn("x", array_to_vector("vec"))).drop("x")


def best_match(current: DataFrame, events: DataFrame) -> DataFrame:
    """The most similar event of the same cluster for each current row; ties go
    to the smaller symbol, then the earlier date."""
    e = events.select("cluster", F.col("symbol").alias("match_symbol"), F.col("date").alias("match_date"), F.col("move").alias("match_move"), "direction", F.col("vec").alias("_v"))
    rows = current.join(e, "cluster").where(F.col("match_date") < F.col("date")).withColumn("similarity", F.round(100 * cosine("vec", "_v"), 2))
    top = Window.partitionBy("symbol", "date").orderBy(F.desc("similarity"), "match_symbol", "match_date")
    return rows.withColumn("_r", F.row_number().over(top)).where("_r = 1").drop("_r", "_v", "vec")


def shape_name(center) -> str:
    """What a cluster's mean window looks like: its trend from the first third
    to the last, and its middle against both."""
    first, middle, last = (float(np.mean(part)) for part in np.array_split(np.asarray(center, float), 3))
    bend = middle - (first + last) / 2
    trend = "rising" if last - first > 0.5 else "falling" if first - last > 0.5 else "level"
    return f"{trend}, " + ("bottom inside" if bend < -0.5 else "top inside" if bend > 0.5 else "straight")


def named(matches: DataFrame, centers: list) -> DataFrame:
    """``pattern``: the shape of the row's cluster and the move that followed its match."""
    shapes = F.create_map(*[x for i, c in enumerate(centers) for x in (F.lit(i), F.lit(shape_name(c)))])
    return matches.withColumn("pattern", F.concat(shapes[F.col("cluster")], F.when(F.col("direction") == "up", " before a rise").otherwise(" before a fall")))


def status(direction: Column, move: Column) -> Column:
    bull = F.when(move >= 8, "launched").when(move.between(-4, 6), "pending").otherwise("weak")
    bear = F.when(move <= -8, "launched").when(move.between(-6, 4), "pending").otherwise("rebound")
    return F.when(direction == "up", bull).otherwise(bear)


def scan(bars: DataFrame, size: int, k: int = 10, recent: int = 5, move: float = MOVE) -> DataFrame:
    """The whole scan for one window size: the latest window of each symbol
    against the event library, with pattern, direction and status."""
    model, events = cluster(event_library(bars, size, move=move), k)
    shapes = window_vectors(bars, size)
    newest = Window.partitionBy("symbol").orderBy(F.desc("date"))
    latest = assign(model, shapes.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r"))
    w = Window.partitionBy("symbol").orderBy("date")
    moved = bars.select("symbol", "date", F.round((F.col("close") / F.lag("close", recent).over(w) - 1) * 100, 2).alias("recent_move"))
    found = named(best_match(latest, events), model.clusterCenters()).join(moved, ["symbol", "date"])
    return found.withColumn("status", status(F.col("direction"), F.col("recent_move"))).withColumn("period", F.lit(size)).drop("cluster")


def resonance(short: DataFrame, long: DataFrame, top: int = 8) -> DataFrame:
    """Symbols pending in both scans with the same direction, best first."""
    a = short.where("status = 'pending'").select("symbol", "direction", F.col("similarity").alias("similarity_short"))
    b = long.where("status = 'pending'").select("symbol", "direction", F.col("similarity").alias("similarity_long"))
    rank = Window.partitionBy("direction").orderBy(F.desc("similarity_short"), "symbol")
    return a.join(b, ["symbol", "direction"]).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top)


def top_per_list(scans: DataFrame, k: int = 5) -> DataFrame:
    rank = Window.partitionBy("period", "direction").orderBy(F.desc("similarity"), "symbol")
    return scans.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def status_counts(scans: DataFrame) -> DataFrame:
    return scans.groupBy("period", "direction", "status").agg(F.count("*").alias("n"))


def top_cosine(vectors: DataFrame, every: int = 20, block: int = 2048) -> DataFrame:
    """(vec_id, match_id, similarity): the nearest other vector of each query
    (ids divisible by ``every``) in its own label block; ``nearest`` searches all.

    A label's queries and vectors are dealt into blocks of about ``block``, and every
    block of queries meets every block of vectors of its label in a task, wherever it
    runs, and keeps one row a query: pairs are never made as rows, and a label of most
    rows is as many tasks as it has blocks.  Ties go to the smaller id.  Null components, and
    those that a shorter vector lacks, count as 0; with a vector that has none there
    is no similarity (null), and it comes after all others; with a zero vector it is
    NaN, which comes first, both as in the query's SQL."""
    rows = vectors.where("vec_id is not null and label is not null").select("vec_id", "label", "embedding")
    width = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    known = F.coalesce(F.exists("embedding", lambda x: x.isNotNull()), F.lit(False))
    part = lambda i: F.coalesce(F.get("embedding", i).cast("double"), F.lit(0.0))
    rows = rows.select("vec_id", "label", known.alias("known"), F.transform(F.sequence(F.lit(0), F.lit(max(width, 1) - 1)), part).alias("v"))
    counts = rows.groupBy("label").agg(F.ceil(F.count("*") / block).cast("int").alias("n"), F.greatest(F.lit(1), F.ceil(F.sum((F.col("vec_id") % every == 0).cast("int")) / block)).cast("int").alias("nq"))
    rows = rows.join(counts, "label").withColumn("h", F.xxhash64("vec_id"))
    held = lambda c: [F.collect_list("vec_id").alias(f"{c}_ids"), F.collect_list("known").alias(f"{c}_known"), F.flatten(F.collect_list("v")).alias(f"{c}_v")]
    e = rows.groupBy("label", F.pmod("h", "n").alias("e")).agg(*held("e"))
    q = rows.where(F.col("vec_id") % every == 0).groupBy("label", F.pmod("h", "nq").alias("q")).agg(F.first("n").alias("n"), *held("q"))
    q = q.withColumn("e", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for q, e, qk, ek, qv, ev in zip(*(batch[c] for c in held_columns), strict=True):
                order = np.argsort(e, kind="stable")
                q, e, ek = np.asarray(q), np.asarray(e)[order], np.asarray(ek, bool)[order]
                qv, ev = np.asarray(qv).reshape(len(q), -1), np.asarray(ev).reshape(len(e), -1)[order]
                with np.errstate(all="ignore"):
                    found = np.round(qv @ ev.T / np.sqrt(np.outer((qv * qv).sum(1), (ev * ev).sum(1))), 4)
                found[np.isnan(found)] = 4  # of a zero vector; the largest, as in SQL
                found[~(np.asarray(qk, bool)[:, None] & ek[None, :])] = -2
                found[q[:, None] == e[None, :]] = -3
                at = found.argmax(1)  # the first, so the smaller id
                out = pd.DataFrame({"vec_id": q, "match_id": e[at], "similarity": found[np.arange(len(q)), at]})
                yield out[out["similarity"] > -3]

    held_columns = ["q_ids", "e_ids", "q_known", "e_known", "q_v", "e_v"]
    kept = q.join(e, ["label", "e"]).select(*held_columns).mapInPandas(best, "vec_id long, match_id long, similarity double")
    top = kept.groupBy("vec_id").agg(F.max(F.struct("similarity", (-F.col("match_id")).alias("m"))).alias("b"))
    similarity = F.when(F.col("b.similarity") == 4, F.lit(float("nan"))).when(F.col("b.similarity") > -2, F.col("b.similarity"))
    return top.select("vec_id", (-F.col("b.m")).alias("match_id"), similarity.alias("similarity"))


def nearest(vectors: DataFrame, every: int = 20, block: int = 1024) -> DataFrame:
    """(vec_id, match_id, similarity): the nearest other vector of each query
    (ids divisible by ``every``) among all vectors, whatever their labels; ties
    go to the smaller id.  Queries and vectors are dealt into blocks of about
    ``block``; every block of queries meets every block of vectors and keeps
    one row a query, so pairs are never shuffled.  Vectors that are null or of
    length 0 have no similarity and match nothing."""
    rows = vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v")).where(F.col("vec_id").isNotNull() & (dot("v", "v") > 0))

    def blocks(side: DataFrame, name: str) -> DataFrame:
        n = -(-side.count() // block) or 1
        return side.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias(name)).agg(F.collect_list("vec_id").alias(f"{name}_ids"), F.flatten(F.collect_list("v")).alias(f"{name}_v"))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for q, e, qv, ev in zip(batch["q_ids"], batch["e_ids"], batch["q_v"], batch["e_v"], strict=True):
                order = np.argsort(e, kind="stable")
                e, ev, qv = np.asarray(e)[order], np.asarray(ev).reshape(len(e), -1)[order], np.asarray(qv).reshape(len(q), -1)
                found = np.round(qv @ ev.T / np.sqrt(np.outer((qv * qv).sum(1), (ev * ev).sum(1))), 4)
                found[np.asarray(q)[:, None] == e[None, :]] = -np.inf
                at = found.argmax(1)  # the first, so the smaller id
                out = pd.DataFrame({"vec_id": q, "match_id": e[at], "similarity": found[np.arange(len(q)), at]})
                yield out[np.isfinite(out["similarity"])]

    pairs = blocks(rows.where(F.col("vec_id") % every == 0), "q").crossJoin(blocks(rows, "e"))
    kept = pairs.select("q_ids", "e_ids", "q_v", "e_v").mapInPandas(best, "vec_id long, match_id long, similarity double")
    top = kept.groupBy("vec_id").agg(F.max(F.struct("similarity", (-F.col("match_id")).alias("m"))).alias("b"))
    return top.select("vec_id", (-F.col("b.m")).alias("match_id"), F.col("b.similarity").alias("similarity"))
