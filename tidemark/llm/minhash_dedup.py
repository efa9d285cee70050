"""Operator 3: near-duplicate documents by fast similarity sketching.

Sketch (Dahlgaard, Knudsen and Thorup, 2017): in round i every shingle is
hashed to a bin and a value; a bin keeps its smallest value of the first round
that reached it, and from round t on all shingles go to bin i - t, so that
every one of the t coordinates is filled after 2t rounds at most.  Two sets
agree in a coordinate with probability equal to their Jaccard similarity, with
the concentration of t independent draws, at the cost of about two passes over
the set.  The first ``BANDS * ROWS`` coordinates are banded and members of a
bucket are linked by ``linking.link``; where a bucket stays divided, members
of different components whose whole sketches agree in ``LEAST`` of the
coordinates (four standard deviations under the threshold) meet as well.  Every
candidate pair is confirmed on its full sets.  In a divided bucket only members
outside its largest component seek partners, in blocks of about ``BLOCK`` rows,
first the most alike one of every other component, then, where a bucket is
still divided, all that are left.

Defined results: null or blank text has an empty set and is linked with
nothing; fewer words than a shingle make one shingle of the whole; repeated
rows share their class; a null id is a class of its own (component_id null,
kept true); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import narrow, stored, table
from tidemark.llm.linking import link

BANDS, ROWS = 48, 6
SIZE = 512
BLOCK = 512
MIX = np.uint64(0x9E3779B97F4A7C15)
EMPTY = np.uint64(2**64 - 1)
CHUNK = 256


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: str | None) -> list[bytes]:
    r"""Maximal runs outside space and \t..\r, A-Z lower-cased, nothing else."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Shingler:
    """Texts to sets of 64-bit shingle hashes; remembers the hashes of words."""

    def __init__(self, width: int, most: int = 300_000):
        self.width, self.most, self.known = width, most, {}

    def hashes(self, tokens: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        for w in set(tokens):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = words(text)
        if not tokens:
            return np.empty(0, np.uint64)
        h = self.hashes(tokens)
        k = min(self.width, len(h))
        with np.errstate(over="ignore"):
            out = np.full(len(h) - k + 1, np.uint64(k))
            for j in range(k):
                out = mix(out * MIX + h[j : len(h) - k + 1 + j])
        return np.unique(out)


def sketches(sets: list[np.ndarray], size: int = SIZE) -> np.ndarray:
    """One row of ``size`` filled coordinates for every non-empty set."""
    bits = np.uint64(64 - (size - 1).bit_length())
    out = np.full((len(sets), size), EMPTY, np.uint64)
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    grid = out.reshape(-1)
    with np.errstate(over="ignore"):
        for i in range(2 * size):
            if not len(flat):
                break
            h = mix(flat + MIX * np.uint64(i + 1))
            bins = (h >> bits).astype(np.int64) if i < size else np.full(len(h), i - size)
            value = (h & ((np.uint64(1) << bits) - np.uint64(1))) >> np.uint64(9) | np.uint64(i) << np.uint64(50)
            at = owner * size + bins
            new = grid[at] == EMPTY
            np.minimum.at(grid, at[new], value[new])
            keep = (out == EMPTY).any(axis=1)[owner]
            flat, owner = flat[keep], owner[keep]
    return out


def band_keys(sketch: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    with np.errstate(over="ignore"):
        grouped = sketch[:, : bands * rows].reshape(len(sketch), bands, rows)
        key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * MIX, grouped.shape[:2]).copy()
        for j in range(grouped.shape[2]):
            key = mix(key * MIX + grouped[:, :, j])
    return key.view(np.int64)


def signer(width: int, id_col: str, text_col: str):
    """Rows of (id, h, n_shingles, s1, s2, keys, sketch): s1 and s2 name the set, h the text;
    keys are the band keys as 64-bit, sketch the low bytes of the coordinates."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(width)
        for batch in batches:
            for start in range(0, len(batch), CHUNK):
                part = batch.iloc[start : start + CHUNK]
                sets = [shingle(t) for t in part[text_col]]
                full = [i for i, s in enumerate(sets) if len(s)]
                keys, low = [b""] * len(sets), [b""] * len(sets)
                sketch = sketches([sets[i] for i in full])
                for i, k, s in zip(full, band_keys(sketch), sketch.astype(np.uint8), strict=True):
                    keys[i], low[i] = k.tobytes(), s.tobytes()
                with np.errstate(over="ignore"):
                    s1 = [int(s.sum(dtype=np.uint64).view(np.int64)) for s in sets]
                    s2 = [int(mix(s ^ MIX).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                yield pd.DataFrame({"id": part[id_col].to_numpy(), "h": part["h"].to_numpy(), "n_shingles": [len(s) for s in sets], "s1": s1, "s2": s2, "keys": keys, "sketch": low})

    return sign


def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, id) members of (id, keys)."""
    for batch in batches:
        keys = [np.unique(np.frombuffer(k, np.int64)) for k in batch["keys"]]
        yield pd.DataFrame({"key": np.concatenate(keys), "id": np.repeat(batch["id"].to_numpy(), [len(k) for k in keys])})


def comparer(percent: int, best: bool):
    """Pairs (a, b) of seekers and partners of other labels within a block
    (key, i, j) whose sketches agree enough, each in the first bucket that the
    two share; of one seeker and label only the most alike if ``best``, for
    which no keys are needed."""
    share = percent / 100
    least = share - 4 * (share * (1 - share) / SIZE) ** 0.5

    def pairs(group: pd.DataFrame) -> list[tuple[int, int]]:
        key, seeks = group["key"].iloc[0], group["seeks"].to_numpy(bool)
        ids, labels, minor = (group[c].to_numpy() for c in ("id", "label", "minor"))
        sketch = np.frombuffer(b"".join(group["sketch"]), np.uint8).reshape(len(ids), SIZE)
        keys = None if best else np.frombuffer(b"".join(group["keys"]), np.int64).reshape(len(ids), BANDS)
        partners, out = np.flatnonzero(~seeks), []
        for x in np.flatnonzero(seeks):
            # Two minor members meet once, from the larger id.
            y = partners[(labels[partners] != labels[x]) & (~minor[partners] | (ids[partners] < ids[x]))]
            alike = (sketch[y] == sketch[x]).mean(axis=1)
            y, alike = y[alike >= least], alike[alike >= least]
            if len(y) and best:
                order = np.lexsort((-alike, labels[y]))
                y = y[order[np.unique(labels[y][order], return_index=True)[1]]]
            elif len(y):
                same = keys[y] == keys[x]
                y = y[keys[x][same.argmax(axis=1)] == key]
            out += [(int(ids[x]), int(ids[z])) for z in y]
        return out

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            groups = [g for _, g in batch.groupby(["key", "i", "j"], sort=False)]
            rest = groups.pop()
            yield pd.DataFrame([p for g in groups for p in pairs(g)], columns=["a", "b"], dtype="int64")
        if rest is not None:
            yield pd.DataFrame(pairs(rest), columns=["a", "b"], dtype="int64")

    return compare


def verifier(width: int, percent: int):
    """Of rows (a, b, ta, tb) those with 100 * |A and B| >= percent * |A or B|."""

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(width)
        last, left = None, None
        for batch in batches:
            ok = []
            for a, ta, tb in zip(batch["a"], batch["ta"], batch["tb"], strict=True):
                if a != last:
                    last, left = a, shingle(ta)
                right = shingle(tb)
                lo, hi = sorted((len(left), len(right)))
                if 100 * lo < percent * hi:
                    ok.append(False)
                    continue
                both = len(np.intersect1d(left, right, assume_unique=True))
                ok.append(100 * both >= percent * (lo + hi - both) and lo > 0)
            yield batch.loc[ok, ["a", "b"]]

    return verify


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept), one row for every row of ``docs``.

    Documents with equal sets are one node, named by a 64-bit hash of the set, so
    that thousands of copies cost one signature in the buckets, and an id that
    stands on several texts is in the class of each."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"))
    signed = stored(rows.mapInPandas(signer(width, "id", "text"), "id long, h long, n_shingles long, s1 long, s2 long, keys binary, sketch binary"), "sketches")
    name = F.xxhash64("s1", "s2", "n_shingles")
    firsts = (
        signed.where("n_shingles > 0 and id is not null")
        .groupBy(name.alias("name"))
        .agg(F.min(F.struct("id", "h", "keys", "sketch")).alias("rep"))
        .select(F.col("name").alias("id"), F.col("rep.id").alias("doc"), "rep.h", "rep.keys", "rep.sketch")
    )
    # Read by every round, so it is made once.
    nodes = stored(firsts, "nodes")

    def refine(rows: DataFrame, best: bool) -> DataFrame:
        rows = stored(rows, "mixed")
        labels = rows.groupBy("key", "label").agg(F.count("*").alias("n"))
        shape = labels.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"))
        shape = shape.select("key", F.col("top.label").alias("main"), F.ceil(F.col("n") / BLOCK).alias("is"), F.ceil((F.col("n") - F.col("top.n")) / BLOCK).alias("js"))
        dealt = rows.join(shape, "key").withColumn("minor", F.col("label") != F.col("main"))
        place = lambda blocks, seed: F.pmod(F.xxhash64("id", "key", F.lit(seed)), F.col(blocks))
        # A partner lies in one block i, next to every block j of seekers; a seeker in one block j, next to every i.
        partners = dealt.select("key", "id", "label", "minor", F.lit(False).alias("seeks"), place("is", 1).alias("i"), F.explode(F.expr("sequence(0L, js - 1)")).alias("j"))
        seekers = dealt.where("minor").select("key", "id", "label", "minor", F.lit(True).alias("seeks"), F.explode(F.expr("sequence(0L, `is` - 1)")).alias("i"), place("js", 2).alias("j"))
        known = nodes.select("id", "sketch", F.lit(b"").alias("keys")) if best else nodes.select("id", "sketch", "keys")
        # Only the sketches that are compared move.
        known = known.join(narrow(rows.select("id").distinct(), "mixed-ids"), "id", "left_semi")
        full = partners.unionByName(seekers).join(known, "id").repartition(F.col("key"), F.col("i"), F.col("j")).sortWithinPartitions("key", "i", "j")
        return full.mapInPandas(comparer(percent, best), "a long, b long")

    def verify(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        ends = narrow(nodes.select("id", "doc", "h").join(ends, "id", "left_semi"), "ends")
        held = rows.select(F.col("id").alias("doc"), "h", "text").join(ends, ["doc", "h"])
        texts = stored(held.groupBy("id").agg(F.max("text").alias("text")), "texts")
        both = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
        return both.mapInPandas(verifier(width, percent), "a long, b long")

    members = nodes.select("id", "keys").mapInPandas(unpack, "key long, id long")
    labels = link(members, verify, refine)
    classes = nodes.select("id", "doc").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    firsts = classes.groupBy("label").agg(F.min("doc").alias("component"))
    named = classes.join(firsts, "label").select(F.col("id").alias("name"), "component")
    linked = signed.select("id", "n_shingles", F.when(F.col("id").isNotNull() & (F.col("n_shingles") > 0), name).alias("name"))
    out = linked.join(named, "name", "left")
    component = F.coalesce("component", "id")
    return out.select("id", "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), width=4)
    return found.withColumnRenamed("id", "doc_id")
