"""Operator 13: hard negatives for contrastive training, by a vector-approximation
file.

Every dimension of the whole-numbered vectors is divided into cells: their edges
are quantiles of a bounded sample (``SAMPLE`` rows, the smallest hashes), and the
least and largest value that each cell holds come from all rows, so bounds are
true.  The file holds a row's cells, a byte a dimension, beside its vector.  For an
anchor a table of (dimension, cell) products gives the least and the largest score
that a row may have; only rows whose bounds allow them among the first of a
window are scored exactly.

Anchors in blocks meet the file in blocks: one partition for two blocks, and
of each anchor at most ``positives`` or (positives x negatives) rows leave it.
First the positives are found, then the negatives in the windows that the
positives' scores set.

Defined results: rows without an id, with a null label, a null or empty vector or
a null or non-finite component take no part.  Repeated rows (id, label and vector
equal) count once.  Of one id with several vectors or labels, all rows are
candidates, each is an anchor of its own, and none is a candidate for another of
its id.  Vectors of different lengths never meet.  Scores are exact below 2**53,
where doubles hold them.  Ties go to the smaller id.  An empty table gives no rows, and an anchor
without positives or a positive without negatives has none; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table

CELLS = 64
SAMPLE = 10_000
#: Rows of the file, and anchors, that meet in a partition, about; and blocks of the file at least.
FILE_ROWS, ANCHOR_ROWS, LEAST_BLOCKS = 100_000, 16_384, 12


def coded(edges: dict[int, np.ndarray]):
    """Adds ``cells``, a byte for each dimension, and ``vec``, the vector as bytes."""

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cells, vecs = [], []
            for x in batch["x"]:
                x = np.asarray(x, np.int64)
                marks = edges.get(len(x), np.zeros((0, len(x)), np.int64))
                cells.append((x[None, :] >= marks).sum(0).astype(np.uint8).tobytes())
                vecs.append(x.astype("<i8").tobytes())
            yield batch.drop(columns="x").assign(cells=cells, vec=vecs)

    return code


def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Least and largest value of each (length, dimension, cell) of a task's rows."""
    low: dict[int, np.ndarray] = {}
    high: dict[int, np.ndarray] = {}
    for batch in batches:
        for d, part in batch.groupby("d"):
            x, c = np.frombuffer(b"".join(part["vec"]), "<i8").reshape(len(part), -1), np.frombuffer(b"".join(part["cells"]), np.uint8).reshape(len(part), -1)
            lo = low.setdefault(d, np.full((d, CELLS), np.iinfo(np.int64).max))
            hi = high.setdefault(d, np.full((d, CELLS), np.iinfo(np.int64).min))
            at = np.broadcast_to(np.arange(d), x.shape)
            np.minimum.at(lo, (at, c), x)
            np.maximum.at(hi, (at, c), x)
    for d in low:
        k, c = np.nonzero(low[d] <= high[d])
        yield pd.DataFrame({"d": d, "k": k, "c": c, "lo": low[d][k, c], "hi": high[d][k, c]})


class Bounds:
    """Least and largest scores of anchors (m, d) with rows given by their cells."""

    def __init__(self, anchors: np.ndarray, low: np.ndarray, high: np.ndarray):
        a, b = anchors[:, :, None] * low, anchors[:, :, None] * high
        self.least, self.most = np.minimum(a, b), np.maximum(a, b)  # (m, d, cells)

    def of(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(self.least), len(cells))
        low, high = np.zeros(shape), np.zeros(shape)
        for k in range(cells.shape[1]):
            low += self.least[:, k, cells[:, k]]
            high += self.most[:, k, cells[:, k]]
        return low, high


class Best:
    """The first ``most`` (score, id) of a window [lo, hi] of scores, higher scores
    first, ties by the smaller id."""

    def __init__(self, most: int, lo: float = -np.inf, hi: float = np.inf):
        self.most, self.lo, self.hi = most, lo, hi
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def floor(self, low: np.ndarray, high: np.ndarray) -> float:
        """A score that the first rows surely reach: the last one kept, or the least
        one of ``most`` rows whose bounds lie inside the window."""
        known = float(self.scores[-1]) if len(self.scores) == self.most else -np.inf
        sure = low[(low >= self.lo) & (high <= self.hi)]
        if len(sure) >= self.most:
            known = max(known, np.partition(sure, len(sure) - self.most)[len(sure) - self.most])
        return max(known, self.lo)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        inside = (scores >= self.lo) & (scores <= self.hi)
        scores, ids = np.concatenate([self.scores, scores[inside]]), np.concatenate([self.ids, ids[inside]])
        if len(scores) > 8 * self.most:  # ties with the last stay in
            keep = scores >= np.partition(scores, len(scores) - self.most)[len(scores) - self.most]
            scores, ids = scores[keep], ids[keep]
        order = np.lexsort((ids, -scores))[: self.most]
        self.scores, self.ids = scores[order], ids[order]


def meeter(tables: dict[int, tuple[np.ndarray, np.ndarray]], most: int, same_label: bool):
    """Rows of a partition: anchors (kind 0; with ``windows``, pairs lo and hi),
    then rows of the file (kind 1).  Gives (anchor, window, id, score): of each
    anchor and window the first ``most`` rows of the same label or of others.
    ``anchor`` is the anchor's number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gathered, anchors, best = [], None, []
        for batch in batches:
            gathered.append(batch[batch["kind"] == 0])
            rows = batch[batch["kind"] == 1]
            if not len(rows):
                continue
            if anchors is None:
                anchors = pd.concat(gathered)
                if not len(anchors):
                    return
                low, high = tables[int(anchors["d"].iloc[0])]
                own = np.frombuffer(b"".join(anchors["vec"]), "<i8").reshape(len(anchors), -1)
                exact = own.astype(float)
                own_ids, own_labels, numbers = anchors["vec_id"].to_numpy(), anchors["label"].to_numpy(), anchors["anchor"].to_numpy()
                best = [[Best(most)] if same_label else [Best(most, *w) for w in np.reshape(ws, (-1, 2))] for ws in anchors["windows"]]
            cells = np.frombuffer(b"".join(rows["cells"]), np.uint8).reshape(len(rows), -1)
            vecs = np.frombuffer(b"".join(rows["vec"]), "<i8").reshape(len(rows), -1)
            ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
            for label in np.unique(own_labels):
                fit = np.flatnonzero(labels == label if same_label else labels != label)
                group = np.flatnonzero(own_labels == label)
                for at in range(0, len(group) if len(fit) else 0, 64):
                    part = group[at : at + 64]
                    least, highest = Bounds(exact[part], low, high).of(cells[fit])
                    for i, a in enumerate(part):
                        for window in best[a]:
                            other = ids[fit] != own_ids[a]
                            maybe = fit[other & (highest[i] >= window.floor(least[i][other], highest[i][other])) & (least[i] <= window.hi)]
                            if len(maybe):
                                window.add(np.rint(vecs[maybe] @ exact[a]).astype(np.int64), ids[maybe])
        out = [(numbers[a], w, i, s) for a, ws in enumerate(best) for w, x in enumerate(ws) for i, s in zip(x.ids.tolist(), x.scores.tolist(), strict=True)]
        yield pd.DataFrame(out, columns=["anchor", "window", "id", "score"])

    return run


def meet(file: DataFrame, anchors: DataFrame, blocks: DataFrame, count: int, tables: dict[int, tuple[np.ndarray, np.ndarray]], most: int, same_label: bool) -> DataFrame:
    """blocks: (d, base, i_n, j_n): for a length of vectors its first partition and
    how many blocks its rows and its anchors have; ``count`` partitions in all."""
    part = (F.col("base") + F.col("i") * F.col("j_n") + F.col("j")).cast("int").alias("part")
    block = lambda n: F.pmod(F.xxhash64("num"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    columns = [part, "kind", "num", "d", "vec_id", "label", "vec", "cells", "windows"]
    rows = file.withColumns({"windows": F.lit(None).cast("array<double>"), "kind": F.lit(1)}).join(F.broadcast(blocks), "d").withColumn("i", block("i_n")).withColumn("j", every("j_n"))
    asked = anchors.withColumn("kind", F.lit(0)).join(F.broadcast(blocks), "d").withColumn("j", block("j_n")).withColumn("i", every("i_n"))
    both = asked.select(*columns).unionByName(rows.select(*columns)).repartitionById(count, F.col("part")).sortWithinPartitions("kind")
    found = both.withColumnRenamed("num", "anchor").drop("part").mapInPandas(meeter(tables, most, same_label), "anchor long, window long, id long, score long")
    first = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most)


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score):
    for each anchor (ids divisible by ``every``) and each of its ``positives`` nearest
    rows of its label, the ``negatives`` highest rows of other labels that score
    ``low`` to ``high`` percent of the positive's score."""
    x = F.col("x")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= np.finfo(float).max)) & (F.size(x) > 0)
    rows = rows.where(F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine, F.lit(False)))
    whole = stored(rows.withColumn("x", F.transform(x, lambda v: F.floor(scale * v))).distinct(), "whole")
    edges: dict[int, list] = {}
    for r in whole.orderBy(F.xxhash64("vec_id", "x")).limit(SAMPLE).select("x").collect():
        edges.setdefault(len(r["x"]), []).append(r["x"])
    marks = {d: np.quantile(np.array(v), np.arange(1, CELLS) / CELLS, axis=0) for d, v in edges.items()}
    kinds = "vec_id long, label long, d int, cells binary, vec binary"
    file = whole.withColumn("d", F.size("x")).mapInPandas(coded(marks), kinds).withColumn("num", F.monotonically_increasing_id())
    file = stored(file, "vector-file")  # numbers are given once
    tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    limits = file.select("d", "vec", "cells").mapInPandas(spans, "d int, k int, c int, lo long, hi long").groupBy("d", "k", "c").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    for r in limits.collect():  # CELLS rows for a dimension at most
        lo, hi = tables.setdefault(r["d"], (np.zeros((r["d"], CELLS)), np.zeros((r["d"], CELLS))))
        lo[r["k"], r["c"]], hi[r["k"], r["c"]] = r["lo"], r["hi"]
    is_anchor = F.col("vec_id") % every == 0
    base, spans_of = 0, []
    for r in file.groupBy("d").agg(F.count("*").alias("n"), F.sum(is_anchor.cast("long")).alias("m")).orderBy("d").collect():  # one row for a length of vectors
        i_n, j_n = min(r["n"], max(LEAST_BLOCKS, -(-r["n"] // FILE_ROWS))), -(-r["m"] // ANCHOR_ROWS)
        if j_n:
            spans_of.append((r["d"], base, i_n, j_n))
            base += i_n * j_n
    spark = vectors.sparkSession
    blocks = spark.createDataFrame(spans_of, "d int, base long, i_n long, j_n long")
    anchors = file.where(is_anchor)
    best = meet(file, anchors.withColumn("windows", F.lit(None).cast("array<double>")), blocks, max(base, 1), tables, positives, True)
    best = stored(best.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("positive_rank")), "positives")
    by_anchor = best.groupBy(F.col("anchor").alias("num")).agg(F.array_sort(F.collect_set("positive_score")).alias("scores"))  # ``positives`` at most
    window = lambda s: F.array(F.ceil(s * low / 100).cast("double"), F.floor(s * high / 100).cast("double"))
    asked = anchors.join(by_anchor, "num").withColumn("windows", F.flatten(F.transform("scores", window))).drop("scores")
    found = meet(file, asked, blocks, max(base, 1), tables, negatives, False)
    scores = by_anchor.select(F.col("num").alias("anchor"), F.posexplode("scores").alias("window", "positive_score"))
    out = found.join(scores, ["anchor", "window"]).join(best, ["anchor", "positive_score"]).join(anchors.select(F.col("num").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved))
