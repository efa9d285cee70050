"""Small fixtures: nulls, empty and repeated rows, empty tables, clashing
columns; each operator against a brute-force version or an exact round trip."""

import base64
import hashlib
import io
import math
import random
import re
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, decontamination, html_extract, line_dedup, linking, lm_scoring, media, minhash_dedup, packing, quality, toxicity, warc_zip

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, node string, id string"


def docs_of(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", 1, "k", "n", "x") for i, t in zip(ids, texts)], DOCS)


def random_texts(n, seed, vocabulary=40, lines=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    out = ["\n".join(" ".join(rng.choices(words, k=rng.randint(0, 14))) for _ in range(lines)) for _ in range(n)]
    for _ in range(n // 3):
        t = rng.choice(out).split(" ")
        t[rng.randrange(len(t))] = "edit"
        out.append(" ".join(t))
    return out + [None, "", "   ", out[0], "x" * 20000, "one"]


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5)]
    want = {i: r for i, r in enumerate(roots(400, pairs))}
    got = {r["id"]: r["label"] for r in linking.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got.get(i, i) == r for i, r in want.items())
    assert linking.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_edges_are_followed_in_one_task(spark):
    """Every task that writes or shuffles makes files, so a few edges over many partitions filled the disk and the driver."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60, 2)], "a long, b long").repartition(16)
    found = linking.components(edges)
    assert found.rdd.getNumPartitions() == 1
    more = linking.extended(found, spark.createDataFrame([(1, 2), (59, 100)], "a long, b long").repartition(16))
    assert {r["id"]: r["label"] for r in more.collect()} == {i: 0 if i < 4 else i - i % 2 for i in range(60)} | {100: 58}
    assert "Exchange" not in linking.gathered(edges).groupBy("a").count()._jdf.queryExecution().executedPlan().toString().split("Coalesce")[0]


def test_members_of_shared_buckets(spark):
    rows = [(1, 10), (1, 11), (2, 10), (3, 10), (3, 11), (3, 12), (3, 13)]
    members = linking.shared(spark.createDataFrame(rows, "key long, id long"))
    assert sorted(map(tuple, members.collect())) == [(1, 10, 2), (1, 11, 2)] + [(3, i, 4) for i in (10, 11, 12, 13)]
    # 10 and 11 meet most others; of these the smaller one is the centre.
    assert sorted(map(tuple, linking.stars(members).collect())) == [(10, 11), (10, 12), (10, 13), (11, 12), (12, 13)]


@pytest.mark.parametrize("seed", [1, 2])
def test_minhash(spark, seed):
    texts = random_texts(60, seed, lines=1)
    got = minhash_dedup.near_duplicates(docs_of(spark, texts), width=3).collect()
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set())
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = roots(len(texts), pairs)
    assert {r["id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(s), want[i], want[i] == i) for i, s in enumerate(sets)}
    assert minhash_dedup.near_duplicates(docs_of(spark, ["a b c d e", "a b c d e"], [None, None])).where("kept and component_id is null").count() == 2
    assert minhash_dedup.near_duplicates(docs_of(spark, [])).count() == 0


def test_minhash_of_one_id_on_two_texts(spark):
    """Each text is in its own class, whichever text is larger."""
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "xy")
    for one, two in ((a, b), (b, a)):
        rows = [(7, one), (7, two), (2, f"{two} z"), (9, one), (3, "some other words that stand alone here")]
        got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
        assert sorted((r["id"], r["component_id"], r["kept"]) for r in got) == [(2, 2, True), (3, 3, True), (7, 2, False), (7, 7, True), (9, 7, False)]


def test_sketch_agreement():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 900).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 100).astype(np.uint64)])
    s = minhash_dedup.sketches([a, b, a[:1]])
    assert not (s == minhash_dedup.EMPTY).any()
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.08


def test_line_dedup(spark):
    texts = random_texts(40, 5)
    texts += ["The quick brown fox jumps over the lazy dog near the old river bank at noon today again", "the quick brown fox jumps over the lazy dog near the old river bank at noon today", None]
    got = line_dedup.dedup_lines(docs_of(spark, texts))
    assert set(got.columns) >= {"doc_id", "key", "node", "id", "n_lines", "n_kept"}
    lines = [(i, p, line.lower().strip(" \t\r")) for i, t in enumerate(texts) for p, line in enumerate((t or "").split("\n")) if line.strip(" \t\r")]
    sets = [{line[i : i + 8] for i in range(max(len(line) - 3, 1))} for line in (re.sub(r"[ \t\n\x0B\f\r]+", " ", x[2]) for x in lines)]
    pairs = [(a, b) for a in range(len(lines)) for b in range(a) if lines[a][2] == lines[b][2] or 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want: dict[int, int] = {}
    for k, r in enumerate(roots(len(lines), pairs)):
        want[lines[k][0]] = want.get(lines[k][0], 0) + (r == k)
    # repeated rows of one id and text count as one; ids differ here
    assert {r["doc_id"]: r["n_kept"] for r in got.collect()} == {i: want.get(i, 0) for i in range(len(texts))}
    assert line_dedup.dedup_lines(docs_of(spark, [])).count() == 0


def line_sets(lines, width=8):
    return [{x[i : i + width] for i in range(max(1, len(x) - width // 2 + 1))} for x in lines]


def test_line_dedup_reads_whole_lines(spark):
    lines = ["https://example.com/alpha", "https://example.org/omega", "invoice 2024-000000017 paid", "invoice 2024-000000018 paid", "andththwhes.", "andththwhwh."]
    lines += ["這是第一行沒有空格的文字內容", "這是第一行沒有空格卻不同的句子", "ab", "abc", "😀😁😂🤣😃😄😅😆😉😊", "😀😁😂🤣😃😄😅😆😉😋"]
    long = "".join(random.Random(4).choices("abcdef0123456789", k=120))
    lines += [long, long[:60] + "_" + long[61:]]  # one character of 120: a near copy
    sets = line_sets(lines)
    pairs = [(a, b) for a in range(len(lines)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert pairs == [(len(lines) - 1, len(lines) - 2)]
    got = {r["doc_id"]: r["n_kept"] for r in line_dedup.dedup_lines(docs_of(spark, lines)).collect()}
    assert got == {i: int(i < len(lines) - 1) for i in range(len(lines))}
    hashed = spark.createDataFrame([(x,) for x in lines], "x string").select(F.size(line_dedup.shingles(F.col("x"), 8)).alias("n")).collect()
    assert [r["n"] for r in hashed] == [len(s) for s in sets]


def test_line_dedup_recall(spark):
    rng = random.Random(8)
    line = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    short = [line(7) for _ in range(60)]  # 4 shingles inside 5: J = 0.8
    lines = [x for s in short for x in (s, "_" + s)] + ["the quick brown fox jumps", "The  quick\tbrown   fox jumps "]
    got = {r["doc_id"]: r["n_kept"] for r in line_dedup.dedup_lines(docs_of(spark, lines)).collect()}
    assert got == {i: 1 - i % 2 for i in range(len(lines))}
    sets = []
    for size in [*range(1, 25)] * 20 + [60] * 4000:
        a = [rng.getrandbits(62) for _ in range(size)]
        cut = rng.randint(0, size - math.ceil(0.8 * size))  # both sides together keep J >= 0.8
        b = a[cut:] + [rng.getrandbits(62) for _ in range(int((size - cut) / 0.8 - size))]
        assert 10 * len({*a} & {*b}) >= 8 * len({*a} | {*b})
        sets.append((sorted(a), sorted(b)))
    keys = spark.createDataFrame(sets, "a array<bigint>, b array<bigint>").select(F.size("a").alias("n"), *[line_dedup.band_keys(F.col(c), line_dedup.SKETCH, 80).alias(c) for c in "ab"])
    missed = [r["n"] for r in keys.where(~F.arrays_overlap("a", "b")).collect()]
    assert set(missed) <= {60} and len(missed) <= 0.0005 * 4000


def test_line_dedup_band_rows(spark):
    """The keys made in generated code are those of ``band_keys``, for sets of every size and for whole and partial ones."""
    rng = random.Random(21)
    sets = [(i, n, sorted(rng.sample(range(-(2**31), 2**31), k))) for i, (n, k) in enumerate([(n, k) for k in range(1, 45) for n in (0, k, 30, 31, 60, 300, 5000)])]
    signed = spark.createDataFrame(sets, "node long, n int, hashes array<int>")
    got = {(r["key"], r["id"]) for r in line_dedup.band_rows(signed, line_dedup.SKETCH, 80, line_dedup.KEEP).collect()}
    keys = signed.select("node", F.explode(line_dedup.band_keys(F.col("hashes"), line_dedup.SKETCH, 80, F.col("n"))).alias("key"))
    assert got == {(r["key"], r["node"]) for r in keys.collect()} and len({i for _, i in got}) == len(sets)


def test_line_dedup_parity_sketch(spark):
    """No pair that is alike is ruled out, also of long lines with repeats; most others are."""
    rng = random.Random(15)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 6)))
    lines = ["", "ab", "aaaaaaaaaaaaaaaaaaaa"]
    for size in (3, 10, 40, 120, 600):
        base = [word() for _ in range(size)]
        for share in (0, 0.01, 0.02, 0.03, 0.05, 0.1, 0.3):
            lines += [" ".join(word() if rng.random() < share else w for w in base), " ".join(base[: int(size * (1 - share))] * 2)]
    sets = line_sets(lines)
    pairs = [(a, b) for a in range(len(lines)) for b in range(a)]
    texts = spark.createDataFrame(list(enumerate(lines)), "id long, norm string")
    met = linking.both_ends(spark.createDataFrame(pairs, "a long, b long"), line_dedup.parity(texts, 8))
    left = {(r["a"], r["b"]) for r in met.where(line_dedup.possible(F.col("fa"), F.col("fb"))).collect()}
    alike = {(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    far = {(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) < 60 * len(sets[a] | sets[b]) and max(a, b) < len(lines) - 14}
    assert len(alike) > 20 and alike <= left and not far & left


def test_decontamination(spark):
    rng = random.Random(7)
    vocabulary = ["alpha", "beta", "gamma", "É", "don"]
    item_texts = [" ".join(rng.choices(vocabulary, k=k)) for k in (10, 12, 25, 3, 9)] + [None, "", "...", "A1 b2"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(30)] + [f"x {t}, y" for t in item_texts if t] + [None, "", "a1-B2"]
    items = spark.createDataFrame(list(enumerate(item_texts)), "item_id long, text string")
    got = {r["_k"]: (r["n_hit"], r["n_items"], r["items"]) for r in decontamination.contamination(docs_of(spark, texts), items).collect()}
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    for d, t in enumerate(texts):
        w, hit, found = split(t), set(), set()
        for i, x in enumerate(item_texts):
            v = split(x)
            for a in range(max(1, len(v) - 9) if v else 0):
                g = v[a : a + 10]
                for b in range(len(w) - len(g) + 1):
                    if w[b : b + len(g)] == g:
                        hit |= set(range(b, b + len(g)))
                        found.add(str(i))
        assert got.get(d, (0, 0, [])) == (len(hit), len(found), sorted(found))
    assert decontamination.contamination(docs_of(spark, texts), items.limit(0)).count() == 0


def test_packing(spark):
    texts = random_texts(20, 9) + ["I'll go, don't stop. 'S <|endoftext|> É"]
    rows = packing.pack(docs_of(spark, texts), limit=64, keep_ids=True).collect()
    cache = packing.WordCache(packing.public_tokenizers.path("word_bpe_49k.json"))
    whole: dict[int, list[int]] = {}
    used: dict[int, list[tuple[int, int]]] = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == len(whole.setdefault(r["doc_id"], []))
        whole[r["doc_id"]] += r["ids"]
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
    for i, t in enumerate(texts):
        assert whole[i] == [*cache.tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
    for s in used.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(docs_of(spark, [])).count() == 0


def test_toxicity(spark):
    rng = random.Random(11)
    clean = [f"word{i}" for i in range(99)]
    words = ["clean" + chr(97 + i % 26) + chr(97 + i // 26) for i in range(99)]
    toxic = [rng.random() < 0.3 for _ in range(400)]
    texts = [" ".join(rng.sample(words, 12) + (["stupid"] if t else [])) for t in toxic]
    labels = spark.createDataFrame([(i, int(t)) for i, t in enumerate(toxic)] + [(None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs_of(spark, [*texts, None, "you stupld person", *clean[:1]], [*range(400), 900, 901, None]), labels).collect()
    score = {r["doc_id"]: r["score"] for r in got}
    assert all((score[i] >= 0.5) == t for i, t in enumerate(toxic))
    assert score[900] < 0.5 <= score[901] and score[None] < 0.5
    clash = toxicity.toxicity(docs_of(spark, texts).withColumns({"toxic": F.lit(1), "n1": F.lit("x")}), labels).collect()
    assert all((r["score"] >= 0.5) == toxic[r["doc_id"]] and r["n1"] == "x" for r in clash)
    assert toxicity.toxicity(docs_of(spark, texts), labels.limit(0)).where("score = 0").count() == 400
    near = toxicity.Trie(["idiot"]).near
    assert [near(w) for w in ("idiot", "idiiot", "idot", "idiut", "idoit")] == [("idiot", 0), ("idiot", 1), ("idiot", 1), ("idiot", 1), None]


def test_toxicity_at_size(spark, monkeypatch):
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(rng.choices(letters, k=7)) for _ in range(300)]
    # one term in 12 of 3,000 toxic rows: fewer than one row in 200
    texts = [" ".join(rng.sample(words, 8)) for _ in range(9000)]
    texts = [f"{t} {'wazzock' if i < 12 else 'stupid'}" if i < 3000 else t for i, t in enumerate(texts)]
    docs, labels = docs_of(spark, texts), spark.createDataFrame([(i, int(i < 3000)) for i in range(9000)], "doc_id long, toxic int")
    train = toxicity.training(docs, labels, folds=10**9).cache()
    assert set(toxicity.induce(train, 3000, 6000)[0]) == {"stupid", "wazzock"}
    monkeypatch.setattr(toxicity, "FIT_ROWS", 50)
    assert set(toxicity.induce(train, 3000, 6000)[0]) == {"stupid", "wazzock"}


def test_toxicity_inner_signs():
    matcher = toxicity.Matcher(["idiot", "stupid", "damn"], [])
    found = lambda t: [(m, c, q) for m, c, q in matcher(t)]
    assert [m for m, _, _ in found("an id1ot, st*pid d*mn! damm dog")] == ["idiot/1", "stupid/1", "damn/1", "damn/1"]
    assert found("a idiot@home b2b") == [("idiot/0", ["a", "home", "b", "b"], False)]


def test_quality(spark):
    rng = random.Random(2)
    good = [rng.random() < 0.6 for _ in range(300)]
    texts = ["some plain words of a text here and there." if g else "%%% *** ### $$$ %%% junk|junk !!!" for g in good]
    labels = spark.createDataFrame([(i, int(g)) for i, g in enumerate(good)], "doc_id long, quality int")
    got = {r["id"]: r for r in quality.quality(docs_of(spark, [*texts, None], [*range(300), None]), labels).collect()}
    assert all(got[i]["kept"] == g for i, g in enumerate(good)) and 0 <= got[None]["score"] <= 1
    assert quality.quality(docs_of(spark, []), labels).count() == 0


def test_shrinkage_by_hand(spark):
    """Group means pulled to the level above; no spread beyond chance gives that level
    itself, groups of only 0 and only 1 keep their means.  Ties, repeated rows and a
    group of a third of all rows are rows like any other."""

    def by_hand(groups, m):
        n = sum(map(len, groups.values()))
        within = m * (1 - m)
        between = sum(len(g) * (sum(g) / len(g) - m) ** 2 for g in groups.values()) / n - within / (n / len(groups))
        if between <= 0:
            return {k: m for k in groups}
        strength = max(0.0, within / between - 1)
        return {k: (sum(g) + strength * m) / (len(g) + strength) for k, g in groups.items()}

    mixed = {"a": [0.9] * 40, "b": [0.2] * 5, "c": [0.6], "d": [0.5, 0.1, 0.5, 0.5]}
    chance = {"a": [0.5, 0.6] * 20, "b": [0.55] * 40}
    apart = {"a": [0.0] * 30, "b": [1.0] * 30}
    for groups in (mixed, chance, apart):
        m = sum(map(sum, groups.values())) / sum(map(len, groups.values()))
        rows = spark.createDataFrame([(k, len(g), float(sum(g)), m) for k, g in groups.items()], "host string, n long, k double, m double")
        got = {r["host"]: r["posterior"] for r in quality.shrunk(rows, ["host"]).collect()}
        want = by_hand(groups, m)
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)
    assert got["a"] < 0.001 and got["b"] > 0.999
    assert quality.shrunk(rows.limit(0), ["host"]).count() == 0


def test_quality_levels(spark, monkeypatch):
    """Posteriors of hosts and paths from the evidence by hand, with null hosts,
    repeated rows, clashing names and one host of most rows; the same rows where
    paths are too many for a broadcast."""
    rng = random.Random(3)
    rows = [(i, "plain words of a text." if rng.random() < 0.6 else "%%% *** ### |!", None if i % 11 == 0 else "big" if i % 3 else f"h{i % 5}", "xy"[i % 2], 0.5, 1) for i in range(240)]
    rows += rows[:3]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, evidence double, n int")
    labels = spark.createDataFrame([(i, int("%" not in r[1])) for i, r in enumerate(rows[:240])], "doc_id long, quality int")
    got = quality.quality(docs, labels).collect()
    assert len(got) == 243
    of, ev = {r[0]: (r[2] or "", r[3]) for r in rows}, [(r["id"], r["evidence"]) for r in got]

    def level(keys, above):
        groups = {}
        for i, e in ev:
            groups.setdefault(keys(i), []).append(e)
        m = {k: above(k) for k in groups}
        n = len(ev)
        within = sum(len(g) * m[k] * (1 - m[k]) for k, g in groups.items()) / n
        between = sum(len(g) * (sum(g) / len(g) - m[k]) ** 2 for k, g in groups.items()) / n - within / (n / len(groups))
        s = max(0.0, within / between - 1) if between > 0 else math.inf
        return {k: m[k] if s == math.inf else (sum(g) + s * m[k]) / (len(g) + s) for k, g in groups.items()}

    prior = sum(e for _, e in ev) / len(ev)
    hosts = level(lambda i: of[i][0], lambda _: prior)
    paths = level(lambda i: of[i], lambda k: hosts[k[0]])
    for r in got:
        assert math.isclose(r["host_posterior"], hosts[of[r["id"]][0]], abs_tol=1e-9) and math.isclose(r["path_posterior"], paths[of[r["id"]]], abs_tol=1e-9)
    monkeypatch.setattr(quality, "small_enough", lambda df: False)
    key = lambda r: (r["id"], round(r["score"], 9))
    assert sorted(map(key, quality.quality(docs, labels).collect())) == sorted(map(key, got))


def test_language_model(spark):
    texts = random_texts(30, 13)
    got = {r["doc_id"]: r for r in lm_scoring.language_model_scores(docs_of(spark, texts)).collect()}
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), None] for t in texts]
    learns = [zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(texts))]
    one, two, starts = {}, {}, sum(learns)
    for w, learn in zip(tokens, learns):
        for h, x in zip([0, *w], w) if learn else ():
            one[x], two[h, x] = one.get(x, 0) + 1, two.get((h, x), 0) + 1
    n, v = sum(one.values()), len(one)
    before = lambda h: starts if h == 0 else one.get(h, 0)
    p = lambda x: (one.get(x, 0) + 1) / (n + v + 1)
    # each training token by the counts without itself
    alone = lambda mu: sum(math.log10((two[h, x] - 1 + mu * one[x] / (n + v)) / (before(h) - 1 + mu)) for w, learn in zip(tokens, learns) if learn for h, x in zip([0, *w], w))
    mu = max(lm_scoring.STRENGTHS, key=alone)
    for i, w in enumerate(tokens):
        score = sum(math.log10((two.get((h, x), 0) + mu * p(x)) / (before(h) + mu)) for h, x in zip([0, *w], w))
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(w), sum(x in one for x in w), n, not learns[i])
        assert math.isclose(r["score"], score, abs_tol=1e-6) and math.isclose(r["base_score"], sum(math.log10(p(x)) for x in w), abs_tol=1e-6)
    again = lm_scoring.language_model_scores(docs_of(spark, ["a b", "a b", None, "c"], [3, 3, None, 5])).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in again) == [(0, 1), (3, 3), (3, 3), (5, 2)]
    assert lm_scoring.language_model_scores(docs_of(spark, [])).count() == 0


def test_media(spark):
    texts = random_texts(10, 17)
    rows = media.media_columns(docs_of(spark, texts), keep_media=True).collect()
    for r in rows:
        n, payload = media.payload_of(texts[r["doc_id"]])
        assert media.load(bytes(r["media"]))[0] == payload and (r["n_bytes"], r["payload_bytes"]) == (n, len(payload)) and len(payload) % 576 == 0
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["media_sha256"] == hashlib.sha256(bytes(r["media"])).hexdigest()
        assert len(r["tensor"]) == 320 and all(s["start"] < s["stop"] for s in r["spans"])
    assert media.tensor_array([r["tensor"] for r in rows]).type.shape == [16, 20]
    x = np.sin(np.arange(4000) * 0.05).astype(np.float32)
    y = media.resample(x, 3, 2)
    at = np.arange(1500, 4500) * 0.05 * 2 / 3  # a sine of the same length, some samples late, as loud
    waves = np.stack([np.sin(at), np.cos(at)], 1)
    fit, *_ = np.linalg.lstsq(waves, y[1500:4500], rcond=None)
    assert abs(np.hypot(*fit) - 1) < 0.02 and abs(waves @ fit - y[1500:4500]).max() < 0.02
    assert media.spans_of(np.array([0, 1, 0.2, -1, 1, 0.0]), 0.5, -0.5) == [(1, 3), (4, 6)]


def test_warc(spark, tmp_path):
    pages = [(1, "http://a/", "<p>x</p>"), (2, None, "<p>x</p>"), (5, "u\r\nX: y", None), (3, "b", ""), (9, "c", "É" * 3000), (None, "d", "<p>x</p>")]
    df = spark.createDataFrame([(*p, "k") for p in pages], "page_id long, url string, html string, sha string")
    folder = f"file://{tmp_path}"
    got = {r["page_id"]: r for r in warc_zip.read_packages(warc_zip.write_packages(df, folder), folder).collect()}
    for i, _, h in pages:
        data = (h or "").encode()
        assert got[i]["payload_bytes"] == len(data) and got[i]["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
    assert {i: r["refers_to"] for i, r in got.items()} == {1: 2, 2: None, 5: None, 3: 5, 9: None, None: None}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z, z.open("m", "w", force_zip64=True) as m:
        m.write(b"abc")
    out.size = lambda: len(out.getvalue())
    reader = warc_zip.PackageReader(out)
    assert reader.read(reader.start("m"), reader.members["m"][1]) == b"abc"


def test_html(spark):
    page = """<html><body><header>Site</header><div class="cookie-notice">We use cookies, ok</div><div id="content"><h1>T&eacute;</h1>
    <div class="post"><p>First  long paragraph, with commas, and more text.<p>Second &lt;b&gt;, with <a href=q>link</a> end.</div>
    <div id="comments"><p>Nice, thanks, really.</p></div></div><aside>rel</aside><form><p>sign up, now</p></form><footer>c</footer>"""
    rows = html_extract.extract(spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "plain & text")], "page_id long, url string, html string")).collect()
    text = {r["page_id"]: r["text"] for r in rows}
    assert text == {1: "Té\nFirst long paragraph, with commas, and more text.\nSecond <b>, with link end.", 2: "", 3: "", 4: "plain & text"}


def test_remainder(spark):
    row = spark.range(20).select("id", common.remainder(F.col("id"), 5).alias("r")).collect()
    assert all(r["r"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in row)


PARAGRAPH = "<p>A real paragraph, with commas, and some more words to be long enough.</p>"


def test_html_names_only_propose(spark):
    text = re.sub("<[^>]*>", "", PARAGRAPH)
    second = PARAGRAPH.replace("real", "second")
    pages = {
        1: f'<div class="layout with-sidebar">{PARAGRAPH}{PARAGRAPH}</div>',
        2: f'<section class="legal">{PARAGRAPH}{PARAGRAPH}</section>',
        3: f"<article>{PARAGRAPH}{PARAGRAPH}</article><article>{second}{second}</article>",
        4: "<div>" * 20000 + PARAGRAPH + "</div>" * 20000,
        5: "<a b=\"x" * 8000,
        6: f"<article>{PARAGRAPH}<p><math><mi>x</mi>=2</math></p></article><footer>{second * 9}</footer>",
        7: f'<div id="main">{PARAGRAPH}{PARAGRAPH}</div><div id="comments">{second * 9}</div>',
        8: f"<form><div>{PARAGRAPH}{PARAGRAPH}<input></div></form>",
    }
    want = {1: [text] * 2, 2: [text] * 2, 3: [text] * 2 + [text.replace("real", "second")] * 2, 4: [text], 5: [], 6: [text, "x=2"], 7: [text] * 2, 8: [text] * 2}
    rows = spark.createDataFrame([(i, "u", h, "x") for i, h in pages.items()] + [(1, "u", pages[1], "y")], "page_id long, url string, html string, text string")
    got = html_extract.extract(rows).collect()
    assert len(got) == 9 and all(r["text"] == "\n".join(want[r["page_id"]]) and r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.extract(rows.limit(0)).count() == 0


def test_line_dedup_clashing_names(spark):
    docs = spark.createDataFrame([(1, "one line of text\none line of text", 7, "h", 9, [0]), (1, "one line of text\none line of text", 7, "h", 9, [0]), (2, None, 8, "g", 9, None)], "doc_id long, text string, _k long, _h string, n_lines int, lost array<int>")
    got = line_dedup.dedup_lines(docs)
    assert sorted(got.columns) == sorted([*docs.columns, "n_kept"])
    assert [tuple(r) for r in got.select("doc_id", "text", "_k", "_h", "n_lines", "n_kept", "lost").orderBy("doc_id").collect()] == [(1, "one line of text", 7, "h", 2, 1, [0])] * 2 + [(2, None, 8, "g", 0, 0, None)]


def test_warc_copies_and_empty(spark, tmp_path):
    pages = [(i, "u", "<p>x</p>" if i % 3 else None, "k") for i in range(1, 31)] + [(30, "u", None, "k")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, sha string").repartition(5)
    folder = f"file://{tmp_path}"
    got = sorted((r["page_id"], r["refers_to"], r["record_type"]) for r in warc_zip.read_packages(warc_zip.write_packages(df, folder), folder).select("page_id", F.coalesce("refers_to", F.lit(0)).alias("refers_to"), "record_type").collect())
    want = sorted((i, 0 if i in (29, 30) else 29 if i % 3 else 30, "response" if i in (29, 30) else "revisit") for i, *_ in pages)
    assert got == want
    assert warc_zip.read_packages(warc_zip.write_packages(df.limit(0), folder), folder).count() == 0


def test_matches_of_whole_texts():
    """Every match, with its context and quotes, against a search of each word; words
    far from all terms never walk the trie."""
    tox = toxicity

    class Walked(dict):
        n = 0

        def items(self):
            Walked.n += 1
            return super().items()

    trie = tox.Trie(["idiot", "moron"])
    trie.root = Walked(trie.root)
    for far in ("carrot", "unfit", "idiotical", "mot"):
        assert trie.near(far) is None
    assert Walked.n == 0
    assert trie.near("idot") == ("idiot", 1)

    rng = random.Random(4)
    terms, stems = ["idiot", "moron", "sot", "stupid", "dümmer"], ["troll", "scum"]
    bits = ["idiot", "id1ot", "idiots", "idot", "xidiot", "st*pid", "so7", "so", "trolling", "scums", "Dümmer", "dumer", "²moron", "mor_on", "a1idiot", "big+moron", "fine", "day", "12", "x_y", "élan"]
    gaps = [" ", ", ", "\n", '"', "'", "(", "-", " ", "—", "”", "."]
    matcher = tox.Matcher(terms, stems, most=30)
    plain = tox.Matcher(terms, stems)
    for k in range(400):
        text = "".join(rng.choice(bits) + rng.choice(gaps) for _ in range(rng.randrange(12)))
        lower, places = text.lower(), []
        for m in tox.WIDE.finditer(lower):
            places += [m] if m[0].isalpha() or plain.word(m[0]) else list(tox.WORD.finditer(lower, *m.span()))
        words = [m[0] for m in places]
        want = []
        for i, m in enumerate(places):
            if term := plain.word(m[0]):
                a, b = m.span()
                around = words[max(0, i - tox.SPAN) : i] + words[i + 1 : i + 1 + tox.SPAN]
                want.append((term, around, any(c in tox.QUOTES for c in lower[max(0, a - 1) : a] + lower[b : b + 1])))
        assert matcher(text) == want, text
    assert matcher(None) == []
