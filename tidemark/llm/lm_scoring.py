"""Operator 6: language-model scores by a weighted backoff automaton.

The model is a bigram with a Dirichlet prior around the add-one unigram
(MacKay and Peto, 1995):

    p(w)     = (c(w) + 1) / (N + V + 1)
    p(w | h) = (c(h w) + mu p(w)) / (c(h) + mu)

mu is the one of ``STRENGTHS`` under which the training tokens are likeliest,
each scored by the counts without itself (leave one out).  As an automaton:
each seen word is a state, with an arc for each seen (h, w);
any other word takes the failure arc to the empty state at the weight
mu / (c(h) + mu).  A text starts in the state of the text start; one pass from
left to right carries the state and adds up log10 weights.

The automaton of a corpus outgrows any machine, so it is never gathered.
Texts become blocks of token numbers where they are read, written once, so no
text is shuffled.  A block sends each of its
distinct states and arcs once, as a sorted array of 64-bit hashes with its own
training counts, to the parts that hold them.  A part adds up the counts of all
blocks and answers each block in the order it was asked.  A block thus gets
exactly the slice of the automaton that its texts can walk.  There is a message
for each block and part, so their number grows with the square of the corpus;
blocks and parts of a few million tokens keep it small up to some TB.

Defined results: null and empty texts are the end token alone; null ids are
never learned from (held out); repeated rows count and are scored each for
itself; without training rows every count is 0; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import remainder, stored, table

STRENGTHS = [0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0, 200.0]
BLOCK_CHARS, PART_TOKENS = 4_000_000, 600_000
END = np.uint64(xxhash.xxh64_intdigest(b" end"))
START = np.uint64(xxhash.xxh64_intdigest(b" start"))
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def token_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end after each text, and the texts' lengths."""
    known: dict[bytes, int] = {}
    parts, lengths = [], np.empty(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        parts += [np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), np.array([END])]
        lengths[i] = len(words) + 1
    return np.concatenate(parts) if parts else np.empty(0, np.uint64), lengths


def unigram_keys(tokens: np.ndarray) -> np.ndarray:
    """Keys of single words have the last bit set, those of pairs do not."""
    return tokens | np.uint64(1)


def pair_keys(states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (states * SPREAD) ^ (tokens + (states >> np.uint64(7)))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(29))) & ~np.uint64(1)


def states_before(tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    states = np.empty_like(tokens)
    states[1:] = tokens[:-1]
    states[np.cumsum(lengths) - lengths] = START
    return states


class Walk:
    """The tokens of a block and the keys that its automaton slice needs."""

    def __init__(self, block):
        known = unsqueeze(block.words, np.uint64)
        self.tokens, self.lengths = known[unsqueeze(block.tokens, np.int32)], unsqueeze(block.lengths, np.int64)
        self.states = states_before(self.tokens, self.lengths)
        learns = unsqueeze(block.learns, np.uint8).astype(bool)
        self.learn = learn = np.repeat(learns, self.lengths)
        uni, pair = unigram_keys(self.tokens), pair_keys(self.states, self.tokens)
        self.keys, at = np.unique(np.concatenate([uni, pair, [unigram_keys(START)]]), return_inverse=True)
        n = len(self.tokens)
        self.uni, self.pair, self.start = at[:n], at[n : 2 * n], at[-1]
        self.counts = np.bincount(self.uni[learn], minlength=len(self.keys)) + np.bincount(self.pair[learn], minlength=len(self.keys))
        self.counts[self.start] = int(learns.sum())

    def parts(self, n: int) -> list[slice]:
        """Keys are uniform, so equal ranges of them are equal parts."""
        edges = np.searchsorted(self.keys, np.array([(i << 64) // n for i in range(n)], np.uint64)).tolist() + [len(self.keys)]
        return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def squeeze(x: np.ndarray) -> bytes:
    """Byte planes of an integer array, compressed."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), 1)


def unsqueeze(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).reshape(-1)


def block_row(ids: list, texts: list, learns: list) -> dict:
    tokens, lengths = token_hashes(texts)
    words, codes = np.unique(tokens, return_inverse=True)
    learns = np.array(learns, np.uint8)
    return {
        "block": uuid.uuid4().int >> 65, "ids": ids, "words": squeeze(words), "tokens": squeeze(codes.astype(np.int32)), "lengths": squeeze(lengths),
        "learns": squeeze(learns), "n": int(lengths[learns > 0].sum()),
    }


def training_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(w) of the distinct training words of each block."""
    for batch in batches:
        for block in batch.itertuples():
            words, learns = unsqueeze(block.words, np.uint64), unsqueeze(block.learns, np.uint8)
            own = unsqueeze(block.tokens, np.int32)[np.repeat(learns > 0, unsqueeze(block.lengths, np.int64))]
            yield pd.DataFrame({"w": words[np.bincount(own, minlength=len(words)) > 0].view(np.int64)})


def blocks_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of about ``BLOCK_CHARS`` of text: (block, ids, words, tokens,
    lengths, learns), with the number n of training tokens."""
    ids, texts, learns, size = [], [], [], 0
    for batch in batches:
        for doc_id, text, learn in zip(batch["doc_id"], batch["text"], batch["learn"], strict=True):
            ids.append(None if pd.isna(doc_id) else int(doc_id))
            texts.append(text)
            learns.append(bool(learn))
            size += len(text or "") + 1
            if size >= BLOCK_CHARS:
                yield pd.DataFrame([block_row(ids, texts, learns)])
                ids, texts, learns, size = [], [], [], 0
    if ids:
        yield pd.DataFrame([block_row(ids, texts, learns)])


def language_model_scores(docs: DataFrame, folds: int = 7, held_fold: int = 2, strengths: list[float] = STRENGTHS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    held = F.coalesce(remainder(F.col(id_col), folds) == held_fold, F.lit(True))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (~held).alias("learn"))
    blocks = stored(rows.mapInPandas(blocks_of, "block long, ids array<long>, words binary, tokens binary, lengths binary, learns binary, n long"), "token-blocks")
    size = blocks.agg(F.sum("n").alias("n")).first()
    n_train = size["n"] or 0
    walked = blocks.select("block", "words", "tokens", "lengths", "learns")
    v_train = walked.mapInPandas(training_words, "w long").distinct().count()
    parts = n_train // PART_TOKENS + 1

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block in batch.itertuples():
                walk, out = Walk(block), []
                for part, at in enumerate(walk.parts(parts)):
                    out.append((part, block.block, squeeze(np.diff(walk.keys[at], prepend=np.uint64(0))), squeeze(walk.counts[at].astype(np.int32))))
                yield pd.DataFrame(out, columns=["part", "block", "keys", "counts"])

    def answer(part: pd.DataFrame) -> pd.DataFrame:
        asked = [np.cumsum(unsqueeze(k, np.uint64), dtype=np.uint64) for k in part["keys"]]
        keys, at = np.unique(np.concatenate(asked), return_inverse=True)
        counts = np.concatenate([unsqueeze(c, np.int32) for c in part["counts"]])
        sums = np.bincount(at, weights=counts, minlength=len(keys)).astype(np.int64)
        out, a = [], 0
        for k, block in zip(asked, part["block"], strict=True):
            out.append((block, part["part"].iloc[0], squeeze(sums[at[a : a + len(k)]])))
            a += len(k)
        return pd.DataFrame(out, columns=["block", "part", "sums"])

    answers = walked.mapInPandas(ask, "part long, block long, keys binary, counts binary").groupBy("part").applyInPandas(answer, "block long, part long, sums binary")

    def score(block: pd.DataFrame, slices: pd.DataFrame) -> pd.DataFrame:
        row = next(block.itertuples())
        walk, learns = Walk(row), unsqueeze(row.learns, np.uint8).astype(bool)
        sums = np.concatenate([unsqueeze(s, np.int64) for s in slices.sort_values("part")["sums"]])
        c_word, c_arc = sums[walk.uni], sums[walk.pair]
        c_state = np.empty_like(c_word)
        c_state[1:] = c_word[:-1]
        firsts = np.cumsum(walk.lengths) - walk.lengths
        c_state[firsts] = sums[walk.start]
        add = lambda x: np.add.reduceat(x, firsts)
        p = (c_word + 1) / (n_train + v_train + 1)
        # a seen arc carries its smoothed weight, any other word the failure
        # arc's weight and that of the empty state
        scores = np.stack([add(np.log10((c_arc + mu * p) / (c_state + mu))) for mu in strengths], axis=1)
        own = walk.learn
        left = (c_word[own]) / (n_train + v_train)
        alone = [np.log10((c_arc[own] - 1 + mu * left) / (c_state[own] - 1 + mu)).sum() for mu in strengths]
        return pd.DataFrame(
            {"doc_id": list(row.ids), "held_out": ~learns, "n_tokens": walk.lengths, "n_known": add((c_word > 0).astype(np.int64)), "base_score": add(np.log10(p)), "scores": list(scores), "alone": [alone] + [None] * (len(learns) - 1)}
        ).astype({"doc_id": "Int64"})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, scores array<double>, alone array<double>"
    scored = stored(blocks.select("block", "ids", "words", "tokens", "lengths", "learns").groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(score, schema), "token-scores")
    likely = scored.where("alone is not null").agg(*[F.sum(F.col("alone")[i]).alias(f"s{i}") for i in range(len(strengths))]).first()
    best = max(range(len(strengths)), key=lambda i: likely[i] if likely[i] is not None else 0.0)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", F.col("scores")[best].alias("score"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"))
