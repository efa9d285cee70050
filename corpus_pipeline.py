"""The corpus pipeline: toxicity, line dedup, MinHash near-dedup, benchmark
decontamination, packing.

Every stage takes (spark, docs, sf_dir), where docs has the columns of
``documents``, works on all rows that the stage before kept, and but for the
last returns those columns again.  ``run`` writes each stage as Parquet under
the shared folder and reads it back as the next one's input.

Defined results: null and empty texts pass every filter and are packed as their
end token; a null id is a document of its own; repeated rows (same id and text)
stay or go together; one id on several texts is several documents; ties between
copies go to the smallest doc_id; an empty table gives no rows; columns beyond
those of ``documents`` are left out, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import row_key, shared_dir, table
from tidemark.llm.decontamination import contamination
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.minhash_dedup import near_duplicates
from tidemark.llm.packing import pack
from tidemark.llm.toxicity import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def counted(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go."""
    return toxicity(docs, table(spark, sf_dir, "labels")).where("score < 0.5").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines repeated across the corpus stay once.  A document that loses all
    its lines this way is wholly contained in others and goes; one that had no
    lines to begin with stays."""
    return counted(dedup_lines(docs.select(*COLUMNS)).where("n_kept > 0 or n_lines = 0"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8 or more)
    the row with the smallest doc_id stays, then that of the smallest text hash."""
    # Rows are named by id and text, so one id on two texts is two documents.
    keyed = docs.select(*COLUMNS, *row_key(docs))
    name = F.xxhash64("_k", "_h")
    found = near_duplicates(keyed.select(name.alias("doc_id"), "text"), width=5, percent=80).select(F.col("id").alias("_n"), F.col("component_id").alias("_c"))
    grouped = keyed.select("_k", "_h", name.alias("_n")).join(found.distinct(), "_n")
    firsts = grouped.groupBy("_c").agg(F.min(F.struct("_k", "_h")).alias("first"))
    lost = grouped.join(firsts, "_c").where(F.struct("_k", "_h") != F.col("first")).select("_k", "_h").distinct()
    return keyed.join(lost, ["_k", "_h"], "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten or more words in a row of a benchmark item, or a
    whole shorter item, go."""
    hits = contamination(docs, table(spark, sf_dir, "benchmark")).select("_k", "_h")
    keyed = docs.select(*COLUMNS, *row_key(docs))
    return keyed.join(hits, ["_k", "_h"], "left_anti").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in packed sequences."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("MinHash near-dedup", drop_copies),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Scores, sketches and token ids have no SQL; tests/llm holds the operators
#: under the stages against brute-force versions, and tests/llm/test_stages.py
#: what the stages for lines, copies and benchmark passages keep.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}/{name.replace(' ', '_')}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
