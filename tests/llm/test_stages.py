"""What stages of the pipeline keep and drop, with nulls, copies and hits."""

import hashlib

import corpus_pipeline
from tidemark.llm import decontamination


def test_stages(spark, tmp_path):
    item = "one two three four five six seven eight nine ten eleven"
    long = "the quick brown fox jumps over the lazy dog near the old river bank"
    texts = [None, "", long, long.upper(), f"{long}\nits own line", f"so: {item}!", "kept for itself", "one two three"]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = lambda stage: {r["doc_id"]: r for r in stage(spark, docs, str(tmp_path)).collect()}

    lines = kept(corpus_pipeline.drop_lines)
    assert set(lines) == {0, 1, 2, 4, 5, 6, 7}  # 3 is wholly in 2
    assert lines[4]["text"] == "its own line" and lines[4]["n_chars"] == 12 and lines[0]["text"] is None
    assert set(kept(corpus_pipeline.drop_copies)) == {0, 1, 2, 4, 5, 6, 7}
    assert set(kept(corpus_pipeline.drop_contaminated)) == {0, 1, 2, 3, 4, 6, 7}
    rows = decontamination.op1_decontamination(spark, str(tmp_path)).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == {i: (len((t or "").split()), 11 * (i == 5), int(i == 5), sha("1" if i == 5 else ""), i == 5) for i, t in enumerate(texts)}


def test_copies_of_repeated_ids(spark, tmp_path):
    a, b = "the quick brown fox jumps over the lazy dog near the old river bank", "seven other words that stand only in here and nowhere else at all"
    rows = [(5, a), (5, b), (7, b), (3, None), (None, "x y"), (9, ""), (8, a.upper())]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "extra") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, id string")
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.drop_copies(spark, docs, str(tmp_path)).where("text is not null").collect())
    assert kept == [(0, "x y"), (5, b), (5, a), (9, "")] or kept == [(0, "x y"), (5, a), (5, b), (9, "")]
    assert corpus_pipeline.drop_copies(spark, docs.limit(0), str(tmp_path)).count() == 0
