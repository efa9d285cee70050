"""Operator 1: benchmark decontamination by winnowing, DataFrame functions only.

Of every ``window - k + 1`` consecutive k-grams of words the smallest hash is
kept as a fingerprint, on both sides alike; any span of ``window`` common words
therefore has a common fingerprint (Schleimer, Wilkerson and Aiken, 2003).
Documents that share a fingerprint with an item are candidates; their hits are
extended to exact windows by comparing the words themselves, and every word
inside a window counts.  Items shorter than a window have no full window; they
are fingerprinted by their whole length (at most ``window - 1`` lengths).

Defined results: null or blank texts have no words and no hits; repeated
documents are counted each for itself; items with equal words all count; null
item ids are left out of the item list; other columns are ignored.  An empty
benchmark contaminates nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import durable, lower_ascii, row_key, table

WINDOW, GRAM = 10, 5
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAPS), "")


def winnowed(window: int, gram: int, short: list[int]) -> Column:
    """Fingerprints of the column ``w``; needs ``g``, its k-gram hashes."""
    span = window - gram + 1
    out = f"if(size(w) >= {window}, array_distinct(transform(sequence(1, size(g) - {span - 1}), i -> array_min(slice(g, i, {span})))), array())"
    for m in short:
        out = f"concat({out}, if(size(w) >= {m}, array_distinct(transform(sequence(1, size(w) - {m - 1}), i -> xxhash64(slice(w, i, {m}), {m}))), array()))"
    return F.expr(out)


def fingerprints(rows: DataFrame, keys: list[str], window: int, gram: int, short: list[int]) -> DataFrame:
    """(*keys, fp) of rows (*keys, w)."""
    grams = F.expr(f"if(size(w) >= {window}, transform(sequence(1, size(w) - {gram - 1}), i -> xxhash64(slice(w, i, {gram}))), array())")
    rows = rows.withColumn("g", grams)
    return rows.select(*keys, F.explode(winnowed(window, gram, short)).alias("fp"))


def windows(rows: DataFrame, keys: list[str], lengths: list[int]) -> DataFrame:
    """(*keys, start, len, words) of all runs of each of the given lengths."""
    runs = [f"if(size(w) >= {m}, transform(sequence(1, size(w) - {m - 1}), i -> named_struct('start', i, 'len', {m}, 'words', array_join(slice(w, i, {m}), ' '))), array())" for m in lengths]
    return rows.select(*keys, F.explode(F.expr(f"concat({', '.join(runs)})")).alias("r")).select(*keys, "r.*")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(_k, _h, n_hit, n_items, items): one row for each document with hits;
    ``_k`` and ``_h`` are ``row_key`` of the document."""
    tests = items.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where("size(w) > 0")
    tests = durable(tests.groupBy("w").agg(F.collect_set("item").alias("ids")))
    short = sorted(r[0] for r in tests.where(f"size(w) < {window}").select(F.size("w")).distinct().collect())  # fewer than ``window`` values
    whole = F.expr(f"size(w) >= {window}")
    full, brief = tests.where(whole), tests.where(~whole)
    prints = fingerprints(full, [], window, gram, [])
    if short:
        prints = prints.unionByName(brief.select(F.expr("xxhash64(w, size(w))").alias("fp")))
    prints = durable(prints.distinct())

    read = docs.select(*row_key(docs, id_col, text_col), docs[text_col].alias("text"))
    found = fingerprints(read.select("_k", "_h", words(F.col("text")).alias("w")), ["_k", "_h"], window, gram, short)
    candidates = durable(found.join(prints, "fp", "left_semi").select("_k", "_h").distinct())

    wanted = windows(full, ["ids"], [window])
    if short:
        wanted = wanted.unionByName(brief.select("ids", F.lit(1).alias("start"), F.size("w").alias("len"), F.array_join("w", " ").alias("words")))
    wanted = durable(wanted.groupBy("len", "words").agg(F.array_distinct(F.flatten(F.collect_set("ids"))).alias("ids")))
    # repeated rows are one here; both get the result
    texts = read.join(candidates, ["_k", "_h"], "left_semi").dropDuplicates(["_k", "_h"])
    runs = windows(texts.select("_k", "_h", words(F.col("text")).alias("w")), ["_k", "_h"], [window, *short])
    hits = durable(runs.join(wanted, ["len", "words"]).select("_k", "_h", "start", "len", "ids"))
    covered = hits.select("_k", "_h", F.explode(F.sequence("start", F.col("start") + F.col("len") - 1)).alias("at")).distinct().groupBy("_k", "_h").agg(F.count("*").alias("n_hit"))
    named = hits.select("_k", "_h", F.explode("ids").alias("item")).distinct().groupBy("_k", "_h").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return covered.join(named, ["_k", "_h"], "left").select("_k", "_h", "n_hit", F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    hits = contamination(docs, items)
    rows = docs.select("doc_id", *row_key(docs), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    joined = rows.join(hits, ["_k", "_h"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
