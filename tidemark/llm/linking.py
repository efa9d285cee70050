"""Near-duplicate linking: from bucket members to connected components.

``link`` takes (key, id) bucket memberships and a ``verify`` function that
confirms candidate pairs exactly.  It never emits all pairs of a bucket:

* first every member meets the centre of its bucket (a star) and its neighbour
  (a chain) - two candidate pairs a row, whatever the bucket size;
* then only buckets that still hold members of different components are looked
  at again, and only pairs from different components are compared: by the
  caller's ``refine``, or with a geometrically growing block of pivots, under
  the caller's condition on their features.  Pairs
  inside one component can add nothing to the result, so no link that matters
  is lost.

Everything is joins and grouped aggregation; state between rounds is cut with
a checkpoint, and nothing is collected but single counts.  Edges and labels that
are counted to be so few that they could be broadcast are followed in one task,
without a shuffle: with many partitions a shuffle of a few rows is many files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_ROWS, durable, stored


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every id in ``edges`` (a, b); label is the smallest id
    reachable.  Alternating large-star and small-star steps (Kiveris et al.,
    2014), each one grouped minimum and one equi-join.

    Self loops and repeated edges are allowed, null ends are dropped; no edges
    give no rows."""
    now = durable(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        now = now.coalesce(1) if state["n"] <= BROADCAST_ROWS else now
        if state["n"] == 0 or state == seen:
            break
        seen = state
        both = now.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = durable(small.select("e.u", "e.v").where("u <> v").distinct())
    ends = F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("label")), F.struct(F.col("v").alias("id"), F.col("v").alias("label")))
    return now.select(F.explode(ends).alias("e")).select("e.id", "e.label").distinct()


def gathered(rows: DataFrame) -> DataFrame:
    """``rows`` (a few ids each) in one task where they are counted to be few."""
    return rows.coalesce(1) if rows.count() <= BROADCAST_ROWS else rows


def extended(found: DataFrame, edges: DataFrame) -> DataFrame:
    """``found`` (id, label) with the components that further ``edges`` (a, b)
    join: only the labels of their ends are followed, not all edges so far."""
    found, edges = gathered(found), gathered(edges)
    a, b = (found.select(F.col("id").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
    ends = edges.join(a, "a", "left").join(b, "b", "left")
    joined = components(ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")))
    new = joined.select(F.col("id").alias("label"), F.col("label").alias("least"))
    old = found.join(new, "label", "left").select("id", F.coalesce("least", "label").alias("label"))
    return durable(old.unionByName(joined.join(found.select("id"), "id", "left_anti")))


def mixed(members: DataFrame, found: DataFrame, least: int) -> DataFrame:
    """(key, id, label) of the buckets of more than ``least`` members that hold
    members of different components."""
    found = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    labelled = members.join(found, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    of_key = Window.partitionBy("key")
    known = labelled.select("key", "id", "label", F.min("label").over(of_key).alias("lo"), F.max("label").over(of_key).alias("hi"), F.count("*").over(of_key).alias("n"))
    return known.where(f"lo <> hi and n > {least}").select("key", "id", "label")


def shared(members: DataFrame) -> DataFrame:
    """The members (key, id) of buckets of two or more, with the bucket's size n."""
    return members.select("key", "id", F.count("*").over(Window.partitionBy("key")).cast("int").alias("n")).where("n > 1")


def stars(members: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of each member (key, id, n) with the centre of its
    bucket and with the member before it.

    The member that meets most others in its buckets is the star's centre: of
    edited copies that is the text that they were made from."""
    rows = members.select("key", "id", F.sum("n").over(Window.partitionBy("id")).alias("weight"))
    by_weight = Window.partitionBy("key").orderBy(F.desc("weight"), "id")
    ranked = rows.select("key", "id", F.first("id").over(by_weight.rowsBetween(Window.unboundedPreceding, 0)).alias("head"), F.lag("id").over(by_weight).alias("before"))
    met = ranked.where("id <> head").select("id", F.explode(F.array("head", "before")).alias("o")).where("id <> o")
    return met.select(F.least("o", "id").alias("a"), F.greatest("o", "id").alias("b")).distinct()


def both_ends(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the features fa and fb of their ends."""
    a, b = (features.select(F.col("id").alias(c), F.col("feature").alias(f"f{c}")) for c in "ab")
    return pairs.join(a, "a").join(b, "b")


def link(
    members: DataFrame,
    verify: Callable[..., DataFrame],
    refine: Callable[[DataFrame, bool], DataFrame] | None = None,
    block: int = 8,
    load: Callable[[DataFrame], DataFrame] | None = None,
    features: DataFrame | None = None,
    plausible: Callable[[Column, Column], Column] | None = None,
    sketch: Callable[[DataFrame], DataFrame] | None = None,
    possible: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """(id, label) of every id that ``verify`` linked to another one.

    members: key long, id long, distinct; read once, only buckets of two or more
    are kept.
    verify: takes distinct candidate pairs (a, b), returns the confirmed ones.
    refine: takes the members (key, id, label) of mixed buckets and returns pairs
    of different labels that may be links: at first (True) the most promising of
    each member and label, then (False) all; without it pivots are used.
    load: takes the ids (id) that may be verified and returns their rows, which
    are written once and handed to every call of ``verify`` as second argument.
    features, plausible: (id, feature) of every id, and a condition on two
    features that every link meets; other pairs are no candidates.
    sketch, possible: the same, but surer: ``sketch`` makes (id, feature) of the rows
    that ``load`` returned; from then on these take the place of the first two.
    """
    members = stored(shared(members), "members")
    pairs = stars(members)
    if plausible is not None:
        pairs = both_ends(pairs, features).where(plausible(F.col("fa"), F.col("fb"))).select("a", "b")
    pairs = stored(pairs, "pairs")
    # Up to three members have all met: the centre with both, and they as neighbours.
    large = members.where("n > 3").select("key", "id")
    if load is None:
        confirm = verify
    else:
        rows_of = load(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(large.select("id")).distinct())

        def confirm(pairs: DataFrame) -> DataFrame:
            return verify(pairs, rows_of)

    if possible is not None:
        features, plausible = stored(sketch(rows_of), "features"), possible
        pairs = stored(both_ends(pairs, features).where(plausible(F.col("fa"), F.col("fb"))).select("a", "b"), "pairs")
    edges = stored(confirm(pairs), "edges")
    found = components(edges)
    if refine is not None:
        for best in (True, False):
            more = refine(mixed(large, found, 3), best).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            more = stored(more, "pairs")
            if not more.isEmpty():
                edges = edges.unionByName(stored(confirm(more), "edges"))
                found = components(edges)
        return found
    done, by_id = 0, Window.partitionBy("key").orderBy("id")
    while True:
        rows = stored(mixed(large, found, done + 1), "members")
        if rows.isEmpty():
            return found
        # Features come in before the buckets meet, which then takes one shuffle by key.
        ranks = rows if features is None else rows.join(features, "id")
        ranks = ranks.withColumn("r", F.row_number().over(by_id))
        pivots = ranks.where(F.col("r").between(done + 1, done + block))
        x, y = pivots.alias("x"), ranks.alias("y")
        meet = (F.col("x.key") == F.col("y.key")) & (F.col("y.r") > F.col("x.r")) & (F.col("x.label") != F.col("y.label"))
        if plausible is not None:
            meet = meet & plausible(F.col("x.feature"), F.col("y.feature"))
        pairs = stored(x.join(y, meet).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct(), "pairs")
        if not pairs.isEmpty():
            edges = stored(confirm(pairs), "edges")
            found = found if edges.isEmpty() else extended(found, edges)
        done, block = done + block, 8 * block
        large = rows.select("key", "id")
