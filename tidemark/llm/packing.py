"""Operator 7: sequence packing, shortest pack first over the length histogram.

Documents become token ids, are cut into pieces of at most ``limit`` ids, and
the histogram of piece lengths (``limit`` counts, whatever the corpus size) is
packed on the driver: lengths longest first, each into the packs with the most
room, whole groups of equal packs at a time (Krell et al., 2021).  The result
is a list of packing patterns with counts; every piece then finds its place by
its rank among the pieces of its length.  Ranks come from a two-level count
(length, bucket), so a length that a third of all pieces share is no hot spot.

Defined results: a null or empty text is the end id alone; repeated rows are
packed each for itself; null ids are kept; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import durable, table

LIMIT = 2048
END = 1


def ends_word(c: str) -> bool:
    """Whether a letter or digit is still one at its end once it is normalised, by
    today's Unicode and by that of 2002, so that any library agrees."""
    end = unicodedata.normalize("NFC", c).lower()[-1]
    return all(u.category(x)[0] in "LN" for u in (unicodedata, unicodedata.ucd_3_2_0) for x in (c, end))


def letter_class() -> str:
    """The characters of the basic plane that end a word, as a regex class."""
    fit = [c for c in range(0x10000) if ends_word(chr(c))]
    firsts = [c for c, before in zip(fit, [-2, *fit], strict=False) if c != before + 1]
    lasts = [c for c, after in zip(fit, [*fit[1:], -2], strict=True) if c != after - 1]
    return "[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(firsts, lasts, strict=True)) + "]"


#: A comma or full stop between such a character and white space is a token of
#: its own for the tokenizer, so it may be looked up apart from its word.  Where
#: the letter becomes a letter and a mark, the mark and the comma are one token.
APART = re.compile(rf"[.,](?<={letter_class()}[.,])(?=[ \n]|\Z)")
#: What the cut into chunks relies on: the tokenizer's normalisers, and its words.
NORMALISERS = ["NFC", "Replace", "Lowercase"]
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def check_tokenizer(path: str) -> None:
    """Raises unless the file's tokenizer cuts text as ``WordCache`` expects."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    steps = (spec.get("normalizer") or {}).get("normalizers") or []
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    if [x["type"] for x in steps] != NORMALISERS or cuts[0].get("pattern") != {"Regex": WORDS}:
        raise ValueError(f"{path}: not a word BPE in lower case; packing would give other ids than its tokenizer")


class WordCache:
    """Token ids of texts as little-endian 32-bit bytes.  The tokenizer lowers
    case, drops white space and never joins across it, so ids are looked up by
    chunk; A-Z are lowered first, which meets more known chunks."""

    def __init__(self, path: str, most: int = 800_000):
        from tokenizers import Tokenizer

        check_tokenizer(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.most, self.known = most, {}

    def learn(self, new: list[str]) -> None:
        """Chunks of letters are one word each to the tokenizer, so all of them
        go through it as one text; the others one by one."""
        plain, other = [c for c in new if c.isalpha()], [c for c in new if not c.isalpha()]
        if plain:
            found = self.tokenizer.encode(" ".join(plain), add_special_tokens=False)
            words, data = np.array(found.word_ids), np.array(found.ids, "<u4").tobytes()
            if words[-1] + 1 == len(plain):
                edges = (np.searchsorted(words, np.arange(len(plain) + 1)) * 4).tolist()
                self.known.update(zip(plain, [data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], strict=True))
            else:  # lower case split a letter, as it does with a dotted I
                other = new
        for c, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True):
            self.known[c] = np.array(e.ids, "<u4").tobytes()

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        lower = [(t or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass") for t in texts]
        chunks = [APART.sub(r" \g<0>", t).replace("\n", " ").split(" ") for t in lower]
        if len(self.known) > self.most:
            self.known.clear()
        self.learn(list(set().union(*chunks).difference(self.known)))
        return [b"".join(map(self.known.__getitem__, c)) for c in chunks]


@functools.cache
def word_cache(path: str) -> WordCache:
    """One for each worker process; it lives on from task to task."""
    return WordCache(path)


def cutter(path: str, limit: int, end: int, keep_ids: bool):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of, tail = word_cache(path), np.array([end], "<u4").tobytes()
        for batch in batches:
            out = []
            texts = batch["text"].tolist()
            coded = (ids for a in range(0, len(texts), 64) for ids in ids_of(texts[a : a + 64]))
            for doc_id, ids in zip(batch["doc_id"], coded, strict=True):
                ids += tail
                n = len(ids) // 4
                for start in range(0, n, limit):
                    piece = ids[4 * start : 4 * (start + limit)]
                    row = (doc_id, start, len(piece) // 4, zlib.crc32(piece), n)
                    out.append((*row, np.frombuffer(piece, "<u4").astype(np.int32)) if keep_ids else row)
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: 5 + keep_ids]).astype({"doc_id": "Int64"})

    return cut


def shortest_pack_first(histogram: dict[int, int], limit: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, count) list that holds every length of the histogram."""
    packs: list[tuple[int, int, tuple[int, ...], int]] = []  # heap of (fill, order, pattern, count)
    order = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        opened: list[tuple[int, int, tuple[int, ...], int]] = []
        while left:
            if packs and packs[0][0] + length <= limit:
                fill, _, pattern, count = heapq.heappop(packs)
            else:
                fill, pattern, count = 0, (), left
            used = min(left, count)
            left -= used
            order += 1
            if used < count:
                heapq.heappush(packs, (fill, order, pattern, count - used))
                order += 1
            opened.append((fill + length, order, (*pattern, length), used))
            if not left or not (packs and packs[0][0] + length <= limit):
                for p in opened:  # an opened pack may take the same length again
                    heapq.heappush(packs, p)
                opened = []
    return sorted(((p, n) for _, _, p, n in packs), reverse=True)


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks, first sequence ids and offsets of the runs
    of pieces that the patterns take, in rank order."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    base = 0
    for pattern, count in patterns:
        at = 0
        for length in pattern:
            runs.setdefault(length, []).append((taken.get(length, 0), base, at))
            taken[length] = taken.get(length, 0) + count
            at += length
        base += count
    return {n: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for n, r in runs.items()}


def pack(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, end: int = END, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and with ``keep_ids`` the ids themselves."""
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    check_tokenizer(path)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids
    pieces = durable(rows.mapInPandas(cutter(path, limit, end, keep_ids), schema))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``limit`` rows
    place = places(shortest_pack_first(histogram, limit))

    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    counts = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start")
    ranked = pieces.withColumn("within", F.row_number().over(inside) - 1).join(firsts, ["length", "bucket"]).withColumn("rank", F.col("first") + F.col("within"))

    def seat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths, ranks = batch["length"].to_numpy(), batch["rank"].to_numpy()
            sequence, offset = np.empty(len(batch), np.int64), np.empty(len(batch), np.int64)
            for length in np.unique(lengths):
                at = lengths == length
                first, base, off = place[int(length)]
                run = np.searchsorted(first, ranks[at], side="right") - 1
                sequence[at], offset[at] = base[run] + ranks[at] - first[run], off[run]
            yield batch.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids
    return ranked.select(*columns, "rank").mapInPandas(seat, schema + ", sequence_id long, offset long")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
