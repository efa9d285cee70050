"""What pattern scans are made of, on fixed rows against plain loops: the event
library, matches within a cluster, status, lists, counts and resonance."""

import datetime
import random

from pyspark.sql import functions as F

from tidemark.operators import patterns

SCANS = "period int, symbol string, direction string, status string, similarity double"


def fixed_scans(rng):
    return [(p, f"s{i:02d}", rng.choice(["up", "down"]), rng.choice(["pending", "pending", "launched", "weak"]), rng.choice([99.5, 99.7, 99.9])) for p in (30, 45) for i in range(40)]


def test_status(spark):
    moves = [-9.0, -8.0, -7.99, -6.0, -5.0, -4.0, 0.0, 4.0, 4.01, 6.0, 7.0, 8.0, 9.0]
    rows = spark.createDataFrame([(d, m) for d in ("up", "down") for m in moves], "d string, m double")
    got = {(r["d"], r["m"]): r["s"] for r in rows.withColumn("s", patterns.status(F.col("d"), F.col("m"))).collect()}
    for m in moves:
        assert got["up", m] == ("launched" if m >= 8 else "pending" if -4 <= m <= 6 else "weak")
        assert got["down", m] == ("launched" if m <= -8 else "pending" if -6 <= m <= 4 else "rebound")


def test_lists_and_counts(spark):
    rows = fixed_scans(random.Random(3))
    scans = spark.createDataFrame(rows, SCANS).repartition(5)
    want, counts = set(), {}
    for p in (30, 45):
        for d in ("up", "down"):
            best = sorted((r for r in rows if r[0] == p and r[2] == d), key=lambda r: (-r[4], r[1]))[:5]
            want |= {(p, d, k, r[1]) for k, r in enumerate(best, 1)}
    for r in rows:
        counts[(r[0], r[2], r[3])] = counts.get((r[0], r[2], r[3]), 0) + 1
    assert {(r["period"], r["direction"], r["rank"], r["symbol"]) for r in patterns.top_per_list(scans).collect()} == want
    assert {(r["period"], r["direction"], r["status"]): r["n"] for r in patterns.status_counts(scans).collect()} == counts


def test_resonance(spark):
    rows = fixed_scans(random.Random(7))
    scans = spark.createDataFrame(rows, SCANS)
    short, long = ({(r[1], r[2]): r[4] for r in rows if r[0] == p and r[3] == "pending"} for p in (30, 45))
    want = set()
    for d in ("up", "down"):
        both = sorted((k for k in short if k in long and k[1] == d), key=lambda k: (-short[k], k[0]))[:8]
        want |= {(s, d, k, short[s, d], long[s, d]) for k, (s, _) in enumerate(both, 1)}
    got = patterns.resonance(scans.where("period = 30"), scans.where("period = 45"))
    assert {(r["symbol"], r["direction"], r["rank"], r["similarity_short"], r["similarity_long"]) for r in got.collect()} == want and len(want) > 4


def series(n=90):
    rng, out = random.Random(11), []
    for s in ("a", "b"):
        close = 50.0
        for i in range(n):
            close = round(close * (1 + rng.gauss(0, 0.04)), 2)
            out.append((s, datetime.date(2023, 1, 1) + datetime.timedelta(days=i), close, round(close * 1.02, 2), round(close * 0.97, 2)))
    return out


def test_event_library(spark):
    rows, size, ahead = series(), 10, 6
    want = {}
    for s in ("a", "b"):
        own = [r for r in rows if r[0] == s]
        for i in range(size - 1, len(own) - 1):
            next_ = own[i + 1 : i + 1 + ahead]
            up, down = (max(r[3] for r in next_) / own[i][2] - 1) * 100, (min(r[4] for r in next_) / own[i][2] - 1) * 100
            move = round(up if up >= -down else down, 2)
            if abs(move) >= 12:
                c = [r[2] for r in own[i + 1 - size : i + 1]]
                mean = sum(c) / size
                dev = (sum((x - mean) ** 2 for x in c) / size) ** 0.5
                want[s, own[i][1]] = (move, "up" if move > 0 else "down", [(x - mean) / dev for x in c])
    bars = spark.createDataFrame(rows, "symbol string, date date, close double, high double, low double")
    got = {(r["symbol"], r["date"]): r for r in patterns.event_library(bars, size, ahead).collect()}
    assert got.keys() == want.keys() and len(want) > 10
    for k, (move, direction, vec) in want.items():
        assert abs(got[k]["move"] - move) < 0.011 and got[k]["direction"] == direction
        assert max(abs(x - y) for x, y in zip(got[k]["vec"], vec, strict=True)) < 1e-9


def test_best_match(spark):
    """The most similar earlier event of the row's own cluster, ties to the smaller
    symbol, then the earlier date; none without such an event."""
    rng, day = random.Random(2), lambda i: datetime.date(2023, 1, 1) + datetime.timedelta(days=i)
    vec = lambda: [float(rng.randrange(-3, 4)) or 1.0 for _ in range(4)]
    events = [(rng.randrange(3), f"e{i % 9}", day(i), vec(), float(i), "up") for i in range(60)]
    events += [(c, "d0", d, v, m, w) for c, _, d, v, m, w in events[:20]]
    current = [(rng.randrange(4), f"c{i}", day(rng.randrange(70)), 1.0, vec()) for i in range(25)]
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    want = {}
    for c, s, d, _, v in current:
        fit = [(-round(100 * cosine(v, e[3]), 2), e[1], e[2]) for e in events if e[0] == c and e[2] < d]
        if fit:
            want[s] = min(fit)
    e = spark.createDataFrame(events, "cluster int, symbol string, date date, vec array<double>, move double, direction string")
    c = spark.createDataFrame(current, "cluster int, symbol string, date date, close double, vec array<double>")
    got = {r["symbol"]: (-r["similarity"], r["match_symbol"], r["match_date"]) for r in patterns.best_match(c, e).collect()}
    assert got == want and 10 < len(want) < 25
