"""Operator 8: fuzzy line dedup, in DataFrame functions only.

A line is lower-cased, its white space runs become one space and its ends are
trimmed.  Its shingles are the ``SHINGLE`` characters that start at every position, spaces
or not; at the end of the line they get shorter, down to half of that, and a
line shorter than that half is its own shingle.  Every character counts.  Its
signature is the bottom-k MinHash of the shingle set: of the hashes of all its
positions those under a bound that leaves about ``KEEP`` of them (all of a short
line's), which are always the smallest ones, whatever the bound.  Bands are
runs of ``RUN`` neighbours among the ``SKETCH`` smallest: of
the smallest hashes of two lines' union each is common with probability J, so
two lines with J = 0.8 fail to share a run of three with a probability
below 0.0005, and J = 0.9 below 0.00001.  Sets of fewer than ``SKETCH`` shingles,
and those that can match them, meet by single hashes instead: with J = 0.8 two
sets share one of their smallest n - 0.8 n + 1 hashes, so no pair is missed; the
size of the larger set is part of the key, as the smaller has at least 0.8 of it.

(With pairs for runs a third of all bands is shared by chance in half a GB of
text, and more in more.)

Positions are exploded and filtered in generated code, and only the hashes
left are grouped by line.  Members of a bucket meet by ``linking``; a pair whose
signatures agree in less than ``PLAUSIBLE`` of their common range (four standard
deviations under J = 0.8) is no candidate.  The lines that are left get a parity
sketch: every distinct shingle flips one of 64 * ``WORDS`` bits, so two sketches
differ in no more bits than the sets differ in shingles, and a pair with too many
can be no link.  The others are confirmed by the exact Jaccard similarity of their
full shingle sets (as 64-bit hashes), components come from
``linking``, and of each component the line that comes first (smallest doc_id,
then position) stays.

Equal lines are one node before anything is banded, so a line with millions of
copies is one row there.

Defined results: blank lines always stay and are never compared; a null or
empty text has no lines to lose; a document that loses every line keeps its
row with the text '' (``n_kept`` 0); repeated rows (same id and text) are
treated alike; other columns pass through untouched, whatever their names, but
for ``n_lines`` and ``n_kept``, which are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_BYTES, BROADCAST_ROWS, discard, row_key, small_enough, stored, table
from tidemark.llm.linking import link

SHINGLE = 8
RUN = 3
SKETCH = 22
KEEP = 30
PERCENT = 80
PLAUSIBLE = 0.45
#: 64-bit words of a parity sketch, a power of two.
WORDS = 16


def normal(line: Column) -> Column:
    """Lower case, white space runs as one space, trimmed.  The regular
    expression runs only over lines that have something to replace."""
    odd = F.contains(line, F.lit("  "))
    for c in "\t\n\x0b\f\r":
        odd = odd | F.contains(line, F.lit(c))
    return F.trim(F.lower(F.when(odd, F.regexp_replace(line, r"\s{2,}|[^\S ]", " ")).otherwise(line)))


def wide(norm: Column) -> Column:
    """Four bytes a character, so that a shingle is found without a walk."""
    return F.encode(norm, "UTF-32")


def starts(u: Column, width: int) -> Column:
    """Byte positions of the shingles in ``wide`` text."""
    least = max(1, width // 2)
    return F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(u) - 4 * least + 1), F.lit(4))


def shingle_at(u: Column, i: Column, width: int) -> Column:
    return F.xxhash64(F.substring(u, i, F.lit(4 * width)))


def shingles(norm: Column, width: int) -> Column:
    """Hashes of the distinct character shingles of a normal line, from every position."""
    # Bound to a lambda, so that the wide text is made once.
    whole = F.transform(F.array(wide(norm)), lambda u: F.transform(starts(u, width), lambda i: shingle_at(u, i, width)))
    return F.array_distinct(F.get(whole, F.lit(0)))


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_k, _h, pos, norm, node) of every line that is not blank; ``node`` is a
    64-bit hash of the normal line."""
    rows = docs.select(*row_key(docs, id_col, text_col), F.posexplode(F.split(docs[text_col], "\n")).alias("pos", "line"))
    rows = rows.where(F.col("line").rlike(r"\S")).select("_k", "_h", "pos", normal(F.col("line")).alias("norm"))
    return rows.withColumn("node", F.xxhash64("norm"))


def texts_of(docs: DataFrame, places: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, norm) for every (node, first) of ``places``: documents meet the
    positions wanted of them, so that no line is shuffled by itself.  Few
    positions are broadcast; else both sides are shuffled."""
    wanted = places.groupBy("first._k", "first._h").agg(F.collect_list(F.struct("first.pos", "node")).alias("wanted"))
    keyed = docs.select(*row_key(docs, id_col, text_col), F.col(text_col).alias("text"))
    if small_enough(places):
        wanted = F.broadcast(wanted)
    found = keyed.join(wanted, ["_k", "_h"]).withColumn("parts", F.split("text", "\n")).select("parts", F.explode("wanted").alias("w"))
    # Repeated rows (same id and text) are one document here.
    return found.select("w.node", normal(F.get("parts", F.col("w.pos"))).alias("norm")).groupBy("node").agg(F.first("norm").alias("norm"))


def band_keys(hashes: Column, sketch: int, percent: int, n: Column | None = None, keep: int = KEEP) -> Column:
    """Keys under which a set of shingles, as its sorted hashes, meets others.
    n: of how many positions those under the bound for ``keep`` are given;
    without it these are all hashes of the set."""
    k = F.size(hashes)
    runs = F.when(k >= RUN, F.transform(F.sequence(F.lit(1), F.least(F.lit(sketch), k) - RUN + 1), lambda i: F.xxhash64(F.slice(hashes, i, RUN)))).otherwise(F.array().cast("array<bigint>"))
    most = largest_small(sketch, percent)

    def singles(head: Column, sizes: Column) -> Column:
        return F.flatten(F.transform(sizes, lambda m: F.transform(head, lambda h: F.xxhash64(F.lit("single"), m, h.cast("long")))))

    head = F.slice(hashes, F.lit(1), k - F.ceil(k * percent / 100).cast("int") + 1)
    single = singles(head, F.sequence(k, F.least(F.floor(k * 100 / percent).cast("int"), F.lit(most))))
    keys = F.when(k > most, runs).when(k >= sketch, F.concat(runs, single)).otherwise(single)
    if n is not None:
        # A part of the hashes may be that of a small set if it is as few as such
        # a set leaves (four standard deviations); it is read as one of any size.
        left = F.lit(float(most * keep)) / n
        either = F.concat(runs, singles(F.slice(hashes, 1, most_heads(sketch, percent)), F.sequence(k, F.lit(most))))
        keys = F.when(n <= keep, keys).when((k > most) | (k > left + 4 * F.sqrt(left) + 2), runs).otherwise(either)
    return F.array_distinct(keys)


def band_rows(signed: DataFrame, sketch: int, percent: int, keep: int) -> DataFrame:
    """(key, id) of all ``band_keys`` of (node, n, hashes).  Runs alone, which is
    what all but small sets have, are hashed in generated code, to the same keys."""
    n, k, left = F.col("n"), F.size("hashes"), F.lit(float(largest_small(sketch, percent) * keep)) / F.greatest(F.col("n"), F.lit(1))
    plain = (k > largest_small(sketch, percent)) | ((n > keep) & (k > left + 4 * F.sqrt(left) + 2))
    signed = signed.withColumn("plain", F.coalesce(plain, F.lit(False)) & (k >= RUN))
    places = signed.where("plain").select("node", "hashes", F.explode(F.sequence(F.lit(0), F.least(F.lit(sketch), k) - RUN)).alias("i"))
    runs = places.select(F.xxhash64(*[F.get("hashes", F.col("i") + j) for j in range(RUN)]).alias("key"), F.col("node").alias("id"))
    others = signed.where("not plain").select(F.explode(band_keys(F.col("hashes"), sketch, percent, n, keep)).alias("key"), F.col("node").alias("id"))
    return runs.unionByName(others)


def largest_small(sketch: int, percent: int) -> int:
    """The largest set that can match one of fewer than ``sketch``."""
    return 100 * (sketch - 1) // percent


def most_heads(sketch: int, percent: int) -> int:
    """Single hashes that a small set is met by at most."""
    return max(m - -(-m * percent // 100) + 1 for m in range(1, largest_small(sketch, percent) + 1))


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, keep: int) -> DataFrame:
    """(node, n, hashes) of every distinct line: n shingle positions, and the
    upper halves of the smallest shingle hashes, about ``keep`` of them, sorted."""
    lines = lines_of(docs, id_col, text_col).select("node", wide(F.col("norm")).alias("u"))
    lines = lines.select("node", "u", F.greatest(F.lit(1), (F.length("u") / 4 - max(1, width // 2) + 1).cast("int")).alias("n"))
    bound = F.when(F.col("n") <= keep, F.lit(2**31 - 1)).otherwise((F.lit(-(2.0**31)) + F.lit(2.0**32 * keep) / F.col("n")).cast("int"))
    places = lines.select("node", "u", "n", bound.alias("bound")).select("node", "u", "n", "bound", F.explode(starts(F.col("u"), width)).alias("i"))
    hashed = places.select("node", "n", "bound", F.shiftright(shingle_at(F.col("u"), F.col("i"), width), 32).cast("int").alias("h")).where("h <= bound")
    return hashed.groupBy("node", "n").agg(F.sort_array(F.collect_set("h")).alias("hashes"))


def parity(lines: DataFrame, width: int) -> DataFrame:
    """(id, feature) of distinct lines (id, norm): feature has the number n of
    their distinct shingles and the words w0, w1, ... of their parity sketch."""
    each = lines.select("id", shingles(F.col("norm"), width).alias("s")).select("id", F.size("s").alias("n"), F.explode("s").alias("h"))
    # The lowest bits name the word, six higher ones the bit that is flipped.
    word, bit = F.col("h").bitwiseAND(WORDS - 1), F.expr("shiftleft(1L, cast(shiftright(h, 32) & 63 as int))")
    flipped = each.select("id", "n", word.alias("word"), bit.alias("bit"))
    sketched = flipped.groupBy("id", "n").agg(*[F.bit_xor(F.when(F.col("word") == i, F.col("bit")).otherwise(F.lit(0))).alias(f"w{i}") for i in range(WORDS)])
    return sketched.select("id", F.struct("n", *[f"w{i}" for i in range(WORDS)]).alias("feature"))


def possible(x: Column, y: Column, percent: int = PERCENT) -> Column:
    """Whether two features of ``parity`` may belong to sets that are alike: sets
    of n and m elements that differ in d are if (100 - percent) * (n + m) >=
    (100 + percent) * d, and d is at least what sizes or sketches differ in."""
    bits = [F.bit_count(x[f"w{i}"].bitwiseXOR(y[f"w{i}"])) for i in range(WORDS)]
    least = F.greatest(F.abs(x["n"] - y["n"]), sum(bits[1:], bits[0]))
    return (100 - percent) * (x["n"] + y["n"]) >= (100 + percent) * least


def cut_after(hashes: Column, n: Column, sketch: int, keep: int) -> Column:
    """What band_keys reads of a part of the hashes."""
    return F.when(n > keep, F.slice(hashes, 1, largest_small(sketch, PERCENT) + 1)).otherwise(hashes)


def keepers(docs: DataFrame, places: DataFrame, id_col: str, text_col: str, width: int = SHINGLE, sketch: int = SKETCH, percent: int = PERCENT, keep: int = KEEP) -> DataFrame:
    """(node, keep) for nodes linked to others: keep (_k, _h, pos) is the one
    occurrence that stays for the whole component.  ``places`` has the first
    occurrence of every node."""
    found = signatures(docs, id_col, text_col, width, keep)
    signed = stored(found.select("node", "n", cut_after(F.col("hashes"), F.col("n"), sketch, keep).alias("hashes")), "line-signatures")
    heads = most_heads(sketch, percent)
    # Long lines of few different shingles leave too little under their bound: their whole sets are made.
    dull = signed.where(f"n > {keep} and size(hashes) < {heads}").select("node")
    whole = texts_of(docs, places.join(dull, "node", "left_semi"), id_col, text_col)
    upper = F.transform(shingles(F.col("norm"), width), lambda h: F.shiftright(h, 32).cast("int"))
    remade = whole.select("node", F.lit(0).alias("n"), F.sort_array(F.array_distinct(upper)).alias("hashes"))
    signed = signed.where(f"n <= {keep} or size(hashes) >= {heads}").unionByName(stored(remade, "line-signatures"))
    members = band_rows(signed, sketch, percent, keep)
    features = signed.select(F.col("node").alias("id"), F.slice("hashes", 1, sketch).alias("feature"))

    def plausible(x: Column, y: Column) -> Column:
        """The smallest hashes of a set that end first are in the other set with
        a probability of J or more each."""
        ends = F.when(F.element_at(x, -1) <= F.element_at(y, -1), F.size(x)).otherwise(F.size(y))
        return (F.least(F.size(x), F.size(y)) < 8) | (F.size(F.array_intersect(x, y)) >= PLAUSIBLE * ends)

    def load(ids: DataFrame) -> DataFrame:
        discard(signed)  # members and first pairs are written by now
        texts = texts_of(docs, places.join(ids.withColumnRenamed("id", "node"), "node", "left_semi"), id_col, text_col)
        return stored(texts.withColumnRenamed("node", "id"), "line-texts")

    def verify(candidates: DataFrame, texts: DataFrame) -> DataFrame:
        # The texts meet, not the sets, which hold a hash for every character; of
        # few pairs only the texts that they name are shuffled.
        if 2 * candidates.count() <= BROADCAST_ROWS:
            ends = candidates.select(F.explode(F.array("a", "b")).alias("id"))
            texts = texts.join(F.broadcast(ends), "id", "left_semi")
        both = candidates.join(texts.select(F.col("id").alias("a"), F.col("norm").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("norm").alias("tb")), "b")
        sets = F.struct(shingles(F.col("ta"), width).alias("a"), shingles(F.col("tb"), width).alias("b"))

        def alike(s: Column) -> Column:
            common = F.size(F.array_intersect(s["a"], s["b"]))
            return (100 + percent) * common >= percent * (F.size(s["a"]) + F.size(s["b"]))

        # Bound to a lambda, so that each set is made once a pair.
        return both.where(F.exists(F.array(sets), alike)).select("a", "b")

    labels = link(members, verify, block=64, load=load, features=features, plausible=plausible, sketch=lambda texts: parity(texts, width), possible=lambda x, y: possible(x, y, percent))
    labelled = stored(places.select("node", "first").join(labels.withColumnRenamed("id", "node"), "node"), "line-components")
    kept = labelled.groupBy("label").agg(F.min("first").alias("keep"))
    return labelled.join(kept, "label").select("node", "keep")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its texts cut to the lines that stay, plus the columns
    n_lines, n_kept (both without blank lines)."""
    lines = stored(lines_of(docs, id_col, text_col).select("_k", "_h", "pos", "node"), "lines")
    first = stored(lines.groupBy("node").agg(F.min(F.struct("_k", "_h", "pos")).alias("first"), F.count("*").alias("n")), "line-places")
    linked = keepers(docs, first, id_col, text_col)
    # Only nodes with copies or with linked lines can lose an occurrence.
    losing = first.join(linked, "node", "left").where("n > 1 or keep is not null").select("node", F.coalesce("keep", "first").alias("keep"))
    lost = lines.join(losing, "node").where(F.struct("_k", "_h", "pos") != F.col("keep"))
    lost = stored(lost.groupBy("_k", "_h").agg(F.collect_set("pos").alias("lost")), "lines-lost")
    # A row's size hangs on how many lines its document loses.
    held = lost.agg(F.sum(40 + 8 * F.size("lost")).alias("bytes")).first()["bytes"] or 0
    lost = F.broadcast(lost) if held <= BROADCAST_BYTES else lost
    # The columns of docs travel in one struct, so their names clash with none.
    keyed = docs.select(*row_key(docs, id_col, text_col), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.col("row").getField(text_col)
    joined = keyed.join(lost, ["_k", "_h"], "left").withColumn("parts", F.split(text, "\n"))
    n_lines = F.coalesce(F.size(F.filter("parts", lambda x: x.rlike(r"\S"))), F.lit(0)).cast("long")
    kept = F.array_join(F.filter("parts", lambda x, i: ~F.array_contains("lost", i)), "\n")
    n_lost = F.when(F.col("lost").isNull(), F.lit(0)).otherwise(F.size("lost"))
    return joined.select(
        *[F.col("row").getField(c).alias(c) for c in docs.columns if c not in (text_col, "n_lines", "n_kept")],
        F.when(F.col("lost").isNull(), text).otherwise(kept).alias(text_col),
        F.when(text.isNull(), F.lit(0)).otherwise(n_lines).cast("long").alias("n_lines"),
        F.when(text.isNull(), F.lit(0)).otherwise(n_lines - n_lost).cast("long").alias("n_kept"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_kept and the text that is left, for every document."""
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_kept", "text")
