"""Operator 12: importance resampling towards a target distribution.

Every text is a bag of hashed runs of one to three words.  Bucket counts of the
corpus and of the target give each bucket a gain, its log ratio in thousandths; a
document's weight is the sum of the gains of its runs, and the documents with the
highest weight plus Gumbel noise are drawn.

Identical texts are grouped by their full text first, so that a text is read,
counted (times its copies) and weighed once; weights go back to the documents by
the SHA-256 of the text, those of the most repeated texts by a broadcast of under
1,000 rows.  A task leaves ``BUCKETS`` counts at most.  Ranks come from a
division of the scores into ranges with counts, so no task sorts all documents.

Defined results: a null or empty text has no words, weight 0 and still a score;
its noise, like any, comes from the id alone, so repeated rows have equal scores
and each counts and is drawn for itself.  A null id has the noise of an empty id
and comes first among equal scores.  Equal scores and ids go by the number of
features.  An empty table gives no rows, an empty target leaves smoothed gains.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import UPPER, look_up, stored, table

BUCKETS = 10_000
LEAST_WORDS = 20
#: Ranges of scores that documents are ranked in: one for so many documents.
RANGE_ROWS, MOST_RANGES = 100_000, 1_000
#: Digits, letters (lowered) and bytes beyond ASCII make words; the rest divides them.
FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).translate(bytes.maketrans(UPPER.encode(), UPPER.lower().encode()))
#: Texts of fewer characters are counted together.
SHORT = 10_000


def hashed(text: str, buckets: int) -> tuple[int, np.ndarray]:
    """The number of words, and the bucket of each run of one, two or three words,
    by the CRC-32 of the run, which goes on from that of the shorter run."""
    words = text.encode("utf-8", "surrogatepass").translate(FOLD).split()
    spaced = list(map(b" ".__add__, words))
    one = list(map(crc32, words))
    two = list(map(crc32, spaced[1:], one))
    three = list(map(crc32, spaced[2:], two))
    return len(words), np.array(one + two + three, np.int64) % buckets


def counter(buckets: int):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text, n in zip(batch["text"], batch["n"], strict=True):
                total += n * np.bincount(hashed(text, buckets)[1], minlength=buckets) if len(text) > SHORT else 0
            short = [(text, n) for text, n in zip(batch["text"], batch["n"], strict=True) if len(text) <= SHORT]
            for at in range(0, len(short), 256):
                part = [(hashed(text, buckets)[1], n) for text, n in short[at : at + 256]]
                at_once = np.concatenate([x for x, _ in part])
                times = np.repeat([n for _, n in part], [len(x) for x, _ in part])
                total += np.rint(np.bincount(at_once, times, minlength=buckets)).astype(np.int64)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": used, "c": total[used]})

    return count


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket, of texts (text, n)."""
    found = texts.mapInPandas(counter(buckets), "bucket long, c long").groupBy("bucket").agg(F.sum("c").alias("c"))
    out = np.zeros(buckets, np.int64)
    for r in found.collect():  # ``buckets`` rows at most
        out[r["bucket"]] = r["c"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares, rounded down."""
    s, t, k = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log(float(b + 1) * float(s + k) / (float(a + 1) * float(t + k)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigher(gain: np.ndarray):
    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(words, len(b), int(gain[b].sum())) for words, b in (hashed(text, len(gain)) for text in batch["text"])]
            yield pd.concat([batch[["key", "n"]].reset_index(drop=True), pd.DataFrame(rows, columns=["n_words", "n_features", "weight"])], axis=1)

    return weigh


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variate of the id, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, draw: int, total: int) -> DataFrame:
    """``rows`` (stored; score, doc_id, n_features, eligible) with ``rank`` of the
    ``draw`` highest of the eligible rows, null for the others."""
    none = F.lit(None).cast("long")
    if not draw:
        return rows.withColumn("rank", none)
    ranges = min(MOST_RANGES, max(1, total // RANGE_ROWS))
    marks = rows.where("eligible").approxQuantile("score", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)) if ranges > 1 else []
    place = F.aggregate(F.array(*map(F.lit, marks)), F.lit(0), lambda k, m: k + (F.col("score") < m).cast("int")) if marks else F.lit(0)
    placed = rows.withColumn("_range", F.when(F.col("eligible"), place))
    before, first = 0, {}
    for r in sorted(placed.where("eligible").groupBy("_range").agg(F.count("*").alias("n")).collect()):  # ``ranges`` rows at most
        if before < draw:
            first[r["_range"]] = before
        before += r["n"]
    offsets = F.create_map(*[F.lit(x) for pair in first.items() for x in pair])
    inside = Window.partitionBy("_range").orderBy(F.desc("score"), "doc_id", "n_features")
    top = placed.where(F.col("_range") <= max(first)).withColumn("rank", F.row_number().over(inside) + offsets[F.col("_range")])
    top = top.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank").cast("long")))
    return top.unionByName(placed.where(~F.coalesce(F.col("_range") <= max(first), F.lit(False))).withColumn("rank", none)).drop("_range")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, seed: int = 42, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank), one row for every row of ``docs``;
    the drawn ``percent`` of the documents with ``least_words`` words have ranks."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    sha = lambda c: F.unhex(F.sha2(c, 256))
    texts = stored(docs.groupBy(text(text_col).alias("text")).agg(F.count("*").alias("n")), "texts")
    aims = target.groupBy(text(target_col).alias("text")).agg(F.count("*").alias("n"))
    gain = gains(bucket_counts(texts, buckets), bucket_counts(aims, buckets))
    weighed = texts.select("text", "n", sha("text").alias("key")).mapInPandas(weigher(gain), "key binary, n long, n_words long, n_features long, weight long")
    facts = stored(weighed, "weights")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), sha(text(text_col)).alias("key"))
    found = look_up(rows, facts, ["key"]).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("eligible", F.col("n_words") >= least_words)
    found = stored(found.select("doc_id", "n_features", "weight", "score", "eligible"), "scores")
    total = facts.where(F.col("n_words") >= least_words).agg(F.sum("n").alias("n")).first()["n"] or 0
    return ranked(found, percent * total // 100, total).select("doc_id", "n_features", "weight", "score", "rank")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
