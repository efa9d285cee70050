"""Operators 11 to 13 against brute force: copies, dense groups, nulls, ties,
repeated rows and ids, several lengths, clashing names, empty tables."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm.embedding_dedup import near_embeddings
from tidemark.llm.hard_negatives import hard_negatives
from tidemark.llm.resampling import resample
from tidemark.llm.small_world import Graph, levels

NAN = float("nan")


def vectors(spark, rows):
    """With columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.withColumns({c: F.lit("x") for c in ("n", "v", "id", "shard", "node", "name", "part", "num", "d", "windows")})


def groups(rng, count, size, width=8):
    out = []
    for _ in range(count):
        centre = rng.normal(size=width)
        out += [(centre + 0.25 * rng.normal(size=width)).astype("f4").tolist() for _ in range(size)]
    return out


def odd_vectors():
    rng = np.random.default_rng(4)
    found = groups(rng, 12, 25)
    found += [found[3]] * 20 + [[2 * x for x in found[3]]] + [[1.0, 0.0], [1.0, 0.0, 0.0], [3.0, 0.1, 0.0], [0.0] * 8, [1.0, None], [NAN, 1.0], [float("inf"), 1.0], [], None]
    rows = [(i, v, i % 4) for i, v in enumerate(found)]
    return rows + [rows[5], (5, found[100], 1), (None, found[3], 1), (900, found[8], None)]


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def test_near_embeddings(spark):
    rows = odd_vectors()
    sure = [(k, np.array(v, float)) for k, (i, v, _) in enumerate(rows) if i is not None and usable(v) and any(v)]
    links = {k: [j for j, b in sure if j != k and len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= 0.9] for k, a in sure}
    label = {k: rows[k][0] for k in links}
    for _ in range(len(rows)):
        label = {k: min([label[k], *(label[j] for j in links[k])]) for k in links}
    want = sorted(((i, len(links.get(k, [])), label.get(k, i)) for k, (i, _, _) in enumerate(rows)), key=str)
    df = vectors(spark, rows)
    for most in (400_000, 40):
        got = near_embeddings(df, shard_rows=most).collect()
        assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == want
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert max(len(x) for x in links.values()) > 40
    assert near_embeddings(df.limit(0)).count() == 0


def test_graph_recall():
    """All nodes are found, those of islands of alike vectors too."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(1500, 32)), *(rng.normal(size=(1, 32)) + 0.05 * rng.normal(size=(60, 32)) for _ in range(10))])
    units = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    graph = Graph(units, levels(len(units)))
    q, e = graph.within(units, 0.9, 32)
    found, there = np.zeros((len(units), len(units)), bool), units @ units.T >= 0.9
    found[q, e] = True
    assert (found <= there).all() and found.sum() >= 0.999 * there.sum() and len(q) == found.sum()


def test_graph_backward():
    """A node of a dense group that no other links to is found by its own links."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(2000, 32)), rng.normal(size=(1, 32)) + 0.1 * rng.normal(size=(200, 32))])
    units = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    graph = Graph(units, levels(len(units)))
    for layer in graph.layers:
        layer[layer == 2100] = -1
    q, e = graph.within(units[2000:2100], 0.9, 32)
    assert (e == 2100).sum() == (units[2000:2100] @ units[2100] >= 0.9).sum() == 100


def test_cells(spark, monkeypatch):
    """A class is searched for in a few of many shards, none of which is large, and
    no link is lost: of pairs, of groups, of one group larger than a shard."""
    from tidemark.llm import embedding_dedup

    rng = np.random.default_rng(8)
    found = rng.normal(size=(1500, 32)).tolist() + groups(rng, 20, 40, 32)
    found += (rng.normal(size=32) + 0.1 * rng.normal(size=(200, 32))).tolist()
    found += (np.array(found[:100]) + 0.2 * rng.normal(size=(100, 32))).tolist()
    x = np.array(found, "f4").astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    link = x @ x.T >= 0.9
    label = np.arange(len(x))
    for _ in range(20):
        label = np.where(link, label[None], len(x)).min(1)
    want = [(i, int(n) - 1, int(k)) for i, (n, k) in enumerate(zip(link.sum(1), label, strict=True))]
    calls = []

    def spy(df, count, part, order):
        calls.append((df, part))
        return by_part(df, count, part, order)

    by_part = embedding_dedup.by_part
    monkeypatch.setattr(embedding_dedup, "by_part", spy)
    df = spark.createDataFrame(list(enumerate(np.array(found, "f4").tolist())), "vec_id long, embedding array<float>")
    got = near_embeddings(df, shard_rows=100).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == want
    sizes = [r["count"] for r in calls[0][0].groupBy(calls[0][1]).count().collect()]
    asked = calls[-1][0].where("kind = 1").count()
    assert len(sizes) > 25 and max(sizes) < 200 and asked < 0.3 * len(sizes) * len(found)


def test_hard_negatives(spark):
    rows = odd_vectors() + [(100, odd_vectors()[3][1], 2), (200, odd_vectors()[30][1], 3)]
    fit = sorted({(i, tuple(math.floor(256 * x) for x in map(float, np.array(v, "f4"))), k) for i, v, k in rows if i is not None and k is not None and usable(v)})
    want = []
    for a in (r for r in fit if r[0] % 100 == 0):
        score = [(-sum(x * y for x, y in zip(a[1], r[1], strict=True)), r[0], r[2] == a[2]) for r in fit if r[0] != a[0] and len(r[1]) == len(a[1])]
        for ps, p, _ in sorted(x for x in score if x[2])[:5]:
            inside = sorted(x for x in score if not x[2] and 30 * -ps <= 100 * -x[0] <= 90 * -ps)[:10]
            want += [(a[0], p, rank, n, -ps, -ns) for rank, (ns, n, _) in enumerate(inside, 1)]
    got = [tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in hard_negatives(vectors(spark, rows)).collect()]
    assert len(want) > 50 and sorted(got) == sorted(want)
    assert hard_negatives(vectors(spark, rows).limit(0)).count() == 0


def brute_resample(docs, target, percent=5, seed=42):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    s, t = np.zeros(10000), np.zeros(10000)
    for texts, counts in ((docs, s), (target, t)):
        for _, text in texts:
            for b in features(text)[1]:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + 10000) / ((s[b] + 1) * (t.sum() + 10000)))) for b in range(10000)]
    out = []
    for i, text in docs:
        n, f = features(text)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= 20))
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    rank = {}
    for k, r in enumerate(fit[: percent * len(fit) // 100], 1):
        rank.setdefault(r, []).append(k)
    return sorted(((*r[:4], rank[r].pop() if rank.get(r) else None) for r in out), key=str)


def test_resample(spark):
    rng = random.Random(3)
    words = ["Alpha", "beta's", "Ünï", "δελτα", "x9", "  \n", "don't", "İz", "-", "gamma", "東京", "a"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    same = text(60)
    docs = [(i, text(rng.choice([0, 3, 15, 30, 80]))) for i in range(120)] + [(i, same) for i in range(120, 200)]
    docs += [(300, None), (301, ""), (None, text(50)), (None, text(50)), (302, "w " * 40_000), (150, same), (5, same), (5, text(40))]
    target = [(1, text(30)), (2, None), (3, "alpha gamma " * 20)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("n", "key", "score", "rank", "weight", "bucket")})
    aim = spark.createDataFrame(target, "item_id long, text string")
    for percent in (5, 50):
        got = sorted((tuple(r) for r in resample(df, aim, percent).collect()), key=str)
        assert got == brute_resample(docs, target, percent)
    assert resample(df.limit(0), aim).count() == 0
    assert resample(df, aim.limit(0)).count() == len(docs)


def test_ranges(spark, monkeypatch):
    """Ranks do not depend on the number of ranges."""
    from tidemark.llm import resampling

    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("word " * 25).alias("text"))
    want = sorted(tuple(r) for r in resample(docs, docs.limit(3), 50).where("rank is not null").collect())
    monkeypatch.setattr(resampling, "RANGE_ROWS", 100)
    got = sorted(tuple(r) for r in resample(docs, docs.limit(3), 50).where("rank is not null").collect())
    assert got == want and sorted(r[4] for r in got) == list(range(1, 1501))
