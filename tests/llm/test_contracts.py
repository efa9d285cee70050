"""The registered queries of operators without SQL, on small tables with nulls,
empty, very long and repeated texts and columns of clashing names."""

import collections
import hashlib
import math
import re
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import entry

QUERIES = entry.queries()
LONG = " ".join(f"word{i % 700} more, and" for i in range(4000))
TEXTS = [None, "", "Hello hello world", "Hello hello world", "İstanbul naïve ÉCOLE\tx\x0by", LONG, "a b c " * 50, "  \n ", *[f"row {i} of the plain texts number {i % 5}" for i in range(40)]]


def write(spark, folder, texts):
    rows = [(i, t, "en", "s", len(t or ""), "extra", 0.5, 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, toxic string, score double, n_lines int").repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(len(texts))]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "one two three")] if texts else [], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    html = [None, "", f"<html><body><article><p>{'Some plain words, and more of them. ' * 20}</p></article></body></html>"] if texts else []
    spark.createDataFrame([(i, f"https://e.org/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([(1, [1.0, 0.0], 0)] if texts else [], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    return write(spark, str(tmp_path_factory.mktemp("small")), TEXTS)


def rows_of(spark, name, folder):
    return QUERIES[name](spark, folder).collect()


def remainder(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, name, tmp_path):
    assert rows_of(spark, name, write(spark, str(tmp_path), [])) == []


def test_scores_of_words(spark, small):
    """Counts and base score by plain counting; equal texts of one fold score alike."""
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for t in TEXTS]
    train = collections.Counter(w for i, ws in enumerate(tokens) if remainder(i, 7) != 2 for w in ws)
    n, v = sum(train.values()), len(train)
    got = {r["doc_id"]: r for r in rows_of(spark, "op6_lm_scoring", small)}
    assert len(got) == len(TEXTS)
    for i, ws in enumerate(tokens):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (remainder(i, 7) == 2, len(ws), sum(w in train for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((train[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r["score"] < 0
    assert math.isclose(got[2]["score"], got[3]["score"], rel_tol=1e-12)


def test_packing(spark, small):
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    got = rows_of(spark, "op7_packing", small)
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
    for i, t in enumerate(TEXTS):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            part = ids[at : at + r["length"]]
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)))
            at += r["length"]
        assert at == len(ids)
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(sequences) == list(range(len(sequences)))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= math.ceil(sum(r["length"] for r in got) / 2048) + 1


def test_media(spark, small):
    got = {r["doc_id"]: r for r in rows_of(spark, "op9_media", small)}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert [got[2][c] for c in ("media_bytes", "media_sha256", "feature")] == [got[3][c] for c in ("media_bytes", "media_sha256", "feature")]


def test_toxicity(spark, small):
    got = {r["doc_id"]: r for r in rows_of(spark, "op4_toxicity", small)}
    assert sorted(got) == list(range(len(TEXTS)))
    for i, r in got.items():
        assert r["held_out"] == (remainder(i, 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    assert got[2]["score"] == got[3]["score"]


def test_quality(spark, small):
    assert sorted(r["doc_id"] for r in rows_of(spark, "op5_quality", small)) == list(range(len(TEXTS)))


def test_pages(spark, small):
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in rows_of(spark, "op2_html_extract", small)}
    text = ("Some plain words, and more of them. " * 20).strip()
    assert got == {0: ("", 0), 1: ("", 0), 2: (text, len(text))}
