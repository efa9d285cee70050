"""The versioned store: later bars win, a writer that dies leaves the old version,
only stale symbols are fetched."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.sources import bars as src
from tidemark.sources.store import BarStore

SCHEMA = "symbol string, date date, close double, volume long"
DAY = lambda i: datetime.date(2024, 1, i)


def bars(spark, rows):
    return spark.createDataFrame([(s, DAY(d), c, v) for s, d, c, v in rows], SCHEMA)


def held(store, version=None):
    return sorted(((r["symbol"], r["date"].day, r["close"], r["volume"]) for r in store.read(version).collect()), key=str)


def test_versions(spark, tmp_path):
    store = BarStore(spark, f"{tmp_path}/s", most_deltas=2)
    with pytest.raises(FileNotFoundError):
        store.read()
    store.write(bars(spark, [("a", 1, 1.0, 5), ("a", 2, 2.0, 5), ("b", 1, 3.0, 5)]))
    # Twice in one delta: the larger volume, then the larger close.
    store.write(bars(spark, [("a", 2, 7.0, 6), ("a", 2, 9.0, 4), ("a", 2, 8.0, 6), ("c", 1, 1.0, None)]))
    store.write(bars(spark, [("a", 2, 2.5, 1)]))
    assert held(store, 1) == [("a", 1, 1.0, 5), ("a", 2, 2.0, 5), ("b", 1, 3.0, 5)]
    last = held(store)
    assert ("a", 2, 8.0, 6) in held(store, 2) and ("a", 2, 2.5, 1) in last
    assert len(store.manifest()["parts"]) == 3
    store.write(bars(spark, [("d", 1, 4.0, 1)]))  # the third delta: merged into a base
    assert len(store.manifest()["parts"]) == 1 and store.read().count() == len(last) + 1
    assert store.versions() == [1, 2, 3, 4]
    gone = store.vacuum(keep=2)
    assert store.versions() == [3, 4] and store.read(3).count() == len(last) and len(gone) == 1  # the delta that was merged at once
    assert len(store.vacuum(keep=1)) == 3 and store.read().count() == len(last) + 1


def test_death_before_the_swap(spark, tmp_path, monkeypatch):
    store = BarStore(spark, f"{tmp_path}/s")
    store.write(bars(spark, [("a", 1, 1.0, 5)]))

    def die(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(BarStore, "commit", die)
        with pytest.raises(RuntimeError):
            store.write(bars(spark, [("a", 1, 2.0, 5)]))
    again = BarStore(spark, f"{tmp_path}/s")
    assert held(again) == [("a", 1, 1.0, 5)] and again.versions() == [1]
    again.write(bars(spark, [("a", 1, 2.0, 5)]))
    assert held(again) == [("a", 1, 2.0, 5)]
    assert len(again.vacuum()) == 1  # what the dead job left


def test_two_writers(spark, tmp_path, monkeypatch):
    """The second one to commit a version fails, and the first one's stays."""
    one, two = BarStore(spark, f"{tmp_path}/s"), BarStore(spark, f"{tmp_path}/s")
    one.write(bars(spark, [("a", 1, 1.0, 5)]))
    monkeypatch.setattr(two, "versions", lambda: [])
    with pytest.raises(Exception, match="exist"):
        two.write(bars(spark, [("b", 1, 1.0, 5)]))
    assert held(one) == [("a", 1, 1.0, 5)]


def test_streams_write_a_batch_once(spark, tmp_path):
    store = BarStore(spark, f"{tmp_path}/s")
    for batch, close in ((0, 1.0), (1, 2.0), (1, 3.0), (0, 4.0)):
        store.write(bars(spark, [("a", 1, close, 5)]), stream="x", batch=batch)
    assert held(store) == [("a", 1, 2.0, 5)] and store.versions() == [1, 2]


def test_refresh(spark, tmp_path):
    store, asked = BarStore(spark, f"{tmp_path}/s"), []

    def fetch(stale):
        asked.append({r["symbol"]: r["last_date"] and r["last_date"].day for r in stale.collect()})
        return stale.select("symbol").crossJoin(bars(spark, [("", d, 10.0 * len(asked) + d, 1) for d in (1, 2, 3, 4)]).drop("symbol"))

    symbols = spark.createDataFrame([("a",), ("b",), ("c",)], "symbol string")
    store.write(bars(spark, [("a", 2, 1.0, 5), ("a", 1, 1.0, 5), ("b", 4, 1.0, 5)]))
    assert store.refresh(symbols, fetch, "2024-01-05") == 2
    assert asked == [{"a": 2, "c": None}]
    got = {(s, d): c for s, d, c, _ in held(store)}
    assert got[("a", 1)] == 1.0 and got[("a", 2)] == 12.0 and got[("a", 4)] == 14.0 and got[("b", 4)] == 1.0 and got[("c", 1)] == 11.0
    assert store.refresh(symbols, fetch, "2024-01-05") == 2 and len(asked) == 1
    empty = BarStore(spark, f"{tmp_path}/t")
    empty.refresh(symbols.limit(1), fetch, "2024-01-05")
    assert asked[1] == {"a": None} and empty.read().count() == 4


def test_upsert_is_ordered(spark):
    """Several new bars of a date: the choice does not hang on the partitions."""
    old = bars(spark, [("a", 1, 1.0, 1)])
    new = bars(spark, [("a", 1, c, v) for c, v in ((2.0, 1), (7.0, 3), (6.0, 3), (9.0, None))] * 5)
    for parts in (1, 3, 8):
        assert [r["close"] for r in src.upsert(old, new.repartition(parts, F.rand(parts))).collect()] == [7.0]
