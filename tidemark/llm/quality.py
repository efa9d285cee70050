"""Operator 5: document quality by hierarchical empirical Bayes.

1. A logistic regression over text statistics, learned from the labelled
   training rows, gives each document's own evidence.
2. Grouped sums of that evidence over all documents give each host (source)
   and each path under it (host and language) a mean; a mean is shrunk towards
   the level above with a strength found from the spread between the groups
   (method of moments), so sparse sites stay near the global prior.
3. The posterior odds of a document are its evidence, relative to the global
   prior, times the odds of its path.

Defined results: null or empty texts have zero statistics; a null host or path
is a group of its own; null ids are never learned from (held out); with labels
of one value only, or none, the evidence is the global share of label 1 (0.5
without labels); repeated rows count each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import durable, remainder, small_enough, stored, table

STATISTICS = ["log_words", "word_length", "distinct", "symbols", "digits", "upper", "doubled", "lines", "repeated_lines", "longest_word", "enders", "bars"]
SYMBOLS = bytes(set(range(33, 127)) - set(range(48, 58)) - set(range(65, 91)) - set(range(97, 123)) - set(b".,;:'\"()?-"))
UPPER, DIGITS, SPACES = bytes(range(65, 91)), bytes(range(48, 58)), b" \t\n\r"
FOLDS = 5
#: Tasks that the rows of one path are dealt to where paths are too many for a broadcast.
SALTS = 32


def statistics(text: str | None) -> tuple[float, ...]:
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return (0.0,) * len(STATISTICS)
    n, k = len(data), len(words)
    share = lambda which: (n - len(data.translate(None, which))) / n
    lines = [x for x in data.split(b"\n") if x.strip()]
    doubled = sum(a == b for a, b in zip(words, words[1:], strict=False)) / k
    return (
        float(np.log1p(k)), n / k, len(set(words)) / k**0.9, share(SYMBOLS), share(DIGITS), share(UPPER), doubled,
        float(np.log1p(len(lines))), 1 - len(set(lines)) / len(lines), float(np.log1p(max(map(len, words)))), share(b".?"), share(b"|!"),
    )


def with_statistics(docs: DataFrame, text_col: str) -> DataFrame:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([statistics(t) for t in batch], columns=STATISTICS, dtype=float)

    kind = F.pandas_udf(run, ", ".join(f"{s} double" for s in STATISTICS), F.PandasUDFType.SCALAR_ITER)
    return docs.select(*[c for c in docs.columns if c != text_col], kind(F.col(text_col)).alias("s")).select("*", "s.*").drop("s")


def logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    return F.log(p / (1 - p))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def evidence(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` with the probability ``evidence``; learns where ``label`` is set."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    totals = {r[label]: r["n"] for r in rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).collect()}  # two rows
    if len(totals) < 2:
        return rows.withColumn("evidence", F.lit(1.0 if totals.get(1) else 0.0 if totals.get(0) else 0.5))
    terms = STATISTICS + [f"{s}_2" for s in STATISTICS]
    rows = rows.withColumns({f"{s}_2": F.col(s) * F.col(s) for s in STATISTICS})
    train = VectorAssembler(inputCols=terms, outputCol="x").transform(rows.where(F.col(label).isNotNull())).select("x", F.col(label).cast("double").alias("y"))
    model = LogisticRegression(featuresCol="x", labelCol="y", regParam=1e-4, maxIter=60).fit(train)
    z = F.lit(float(model.intercept))
    for name, c in zip(terms, model.coefficients, strict=True):
        z = z + F.col(name) * float(c)
    return rows.withColumn("evidence", sigmoid(z)).drop(*terms)


def shrunk(groups: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, posterior) of groups (*keys, n rows, k sum of their evidence, m the level
    above): group means pulled towards ``m`` with the method-of-moments strength,
    without bounds: groups that differ by no more than chance get ``m`` itself, and
    groups that differ as much as means can keep their own means."""
    spread = groups.agg(F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("m"), 2)).alias("ss"), F.sum("n").alias("n"), F.count("*").alias("g"), F.sum(F.col("n") * F.col("m") * (1 - F.col("m"))).alias("pq")).first()
    weight = F.lit(0.0)  # of a group's own mean: none without spread between groups beyond chance
    if spread["n"]:
        within, n_mean = spread["pq"] / spread["n"], spread["n"] / spread["g"]
        between = spread["ss"] / spread["n"] - within / n_mean
        if between > 0:
            weight = F.col("n") / (F.col("n") + F.lit(float(max(0.0, within / between - 1))))
    return groups.select(*keys, (F.col("m") + weight * (F.col("k") / F.col("n") - F.col("m"))).alias("posterior"))


def quality(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """id, held_out, evidence, host_posterior, path_posterior, score, kept."""
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    held = F.coalesce(remainder(F.col(id_col), FOLDS) == 0, F.lit(True))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_mark"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), held.alias("held_out"))
    known = durable(with_statistics(rows, "text"))
    known = known.join(marks, known["id"] == marks["_id"], "left").withColumn("mark", F.when(~F.col("held_out"), F.col("_mark"))).drop("_id", "_mark")
    found = durable(evidence(known, "mark").select("id", "held_out", "host", "path", "evidence"))
    # All levels come from one table of groups, summed before any shuffle.
    sums = stored(found.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("evidence").alias("k")), "quality-groups")
    total = sums.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    prior = total["k"] / total["n"] if total["n"] else 0.5
    hosts = sums.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("m", F.lit(float(prior)))
    hosts = stored(shrunk(hosts, ["host"]).withColumnRenamed("posterior", "host_posterior"), "quality-hosts")
    under = stored(sums.join(hosts, "host").withColumn("m", F.col("host_posterior")), "quality-groups")
    paths = shrunk(under, ["host", "path"]).withColumnRenamed("posterior", "path_posterior").join(under.select("host", "path", "host_posterior"), ["host", "path"])
    paths = stored(paths, "quality-paths")
    score = sigmoid(logit(F.col("evidence")) - logit(F.lit(prior)) + logit(F.col("path_posterior")))
    if small_enough(paths):
        out = found.join(F.broadcast(paths), ["host", "path"])
    else:  # a path may hold a third of all rows, so its rows are dealt to several tasks
        dealt = found.withColumn("salt", F.pmod(F.xxhash64("id", "evidence"), F.lit(SALTS)).cast("int"))
        out = dealt.join(paths.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "path", "salt"])
    out = out.withColumn("score", score)
    return out.select("id", "held_out", "evidence", "host_posterior", "path_posterior", "score", (F.col("score") >= 0.5).alias("kept"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumnRenamed("id", "doc_id").withColumn("predicted", F.col("kept").cast("int"))
