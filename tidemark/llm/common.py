"""Pieces that several operators share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NO_ID = -(2**63)
#: Rows of a few dozen bytes that are broadcast at most; beyond, both sides of the join are shuffled.
BROADCAST_ROWS = 250_000
#: The same for rows of uneven size, by a sum of their sizes.
BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would also fold É and friends)."""
    return F.translate(text, UPPER, UPPER.lower())


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``, or the one
    given to ``SparkContext.setCheckpointDir``.

    Only a session on one machine (as in tests) may name none and gets one of
    its own; on a cluster that is an error, as executors would not see it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = getattr(shared_dir, "made", None)
    if made is None or not os.path.isdir(made):
        made = shared_dir.made = tempfile.mkdtemp(prefix="spark-")
    return f"file://{made}"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint that outlives any executor."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: for
    rows with texts, which a checkpoint would keep uncompressed."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table written by ``stored`` that nothing reads any more."""
    context = df.sparkSession.sparkContext
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def small_enough(rows: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether the rows may be broadcast; counts one more than allowed at most."""
    return rows.limit(most + 1).count() <= most


def narrow(rows: DataFrame, name: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` (a few ids each) stored, and marked for a broadcast if they are
    counted to be few enough; beyond, joins with them shuffle both sides."""
    rows = stored(rows, name)
    return F.broadcast(rows) if rows.count() <= most else rows


def look_up(rows: DataFrame, facts: DataFrame, key: list[str], share: int = 1000) -> DataFrame:
    """``rows`` with the columns of ``facts``, which has one row for every key and
    its number of rows, n.  Keys of more than a ``share``-th of all rows, so fewer
    than ``share`` keys, are broadcast; the others are joined by a shuffle, in which
    no key is hot.  Null keys match nothing."""
    total = facts.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot = F.broadcast(stored(facts.where(F.col("n") * share > total), "hot"))
    cold = facts.where(F.col("n") * share <= total)
    return rows.join(hot, key).unionByName(rows.join(hot.select(*key), key, "left_anti").join(cold, key))


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, mod n; null for a null id."""
    return F.crc32(doc_id.cast("string")) % n


def row_key(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Two never-null columns, ``_k`` and ``_h``, that name a row by its id and
    its text, so that repeated ids with different texts stay apart."""
    return [
        F.coalesce(df[id_col].cast("long"), F.lit(NO_ID)).alias("_k"),
        F.xxhash64(F.coalesce(df[text_col], F.lit(""))).alias("_h"),
    ]
