"""As-of join: each row of the left table with the last row of the right one, of
its key, at its time or before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import blocks


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, tolerance: str | None = None, rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """All rows of ``left`` with the other columns of ``right``, null without a match
    or where it is older than ``tolerance`` (an interval such as '10 days').

    The union of both is dealt to ranges of (key, time), and the last known row of
    earlier ranges is carried to the later ones, so neither a key nor an instant
    with most of the rows makes a large task, and no rows are paired.  Of right rows
    at one instant that with the largest values counts, column by column.  Null
    keys and times match nothing; repeated left rows stay.  Column names of the
    right table beside ``by`` and ``on`` must not occur in the left one."""
    rest = [c for c in right.columns if c not in (*by, on)]
    if clash := set(rest) & set(left.columns):
        raise ValueError(f"columns in both tables: {sorted(clash)}")
    known = right.where(" and ".join(f"`{c}` is not null" for c in (*by, on))).groupBy(*by, on).agg(F.max(F.struct(*rest)).alias("r"))
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    own = F.struct(*left.columns)
    fields = lambda side, l, r, tie: [key.alias("symbol"), F.col(on).alias("date"), F.lit(side).alias("side"), tie.alias("tie"), l.alias("l"), r.alias("r")]
    kinds = F.struct(F.col(on).alias("at"), "r")
    empty_l, empty_r = (F.lit(None).cast(df.schema["x"].dataType) for df in (left.select(own.alias("x")), known.select(kinds.alias("x"))))
    both = left.select(*fields(1, own, empty_r, F.xxhash64(*left.columns))).unionByName(known.select(*fields(0, empty_l, kinds, F.lit(0).cast("long"))))
    dealt = blocks.split(both, rows, ("symbol", "date", "side", "tie")).withColumn("order", F.struct("date", "side", "tie"))
    found = blocks.carry(dealt, {"last": (F.col("side") == 0, F.col("r"))}, "order").where("side = 1")
    match = F.col("last.r")
    if tolerance is not None:
        match = F.when(F.col("last.at") >= F.col("date") - F.expr(f"INTERVAL {tolerance}"), match)
    return found.withColumn("match", match).select("l.*", *[F.col(f"match.`{c}`").alias(c) for c in rest])
