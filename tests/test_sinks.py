"""The JSON envelope against plain Python, with null horizons and no signals."""

import json

import duckdb
from pyspark.sql import functions as F

from tidemark.plans import oracle
from tidemark.sources import bars, sinks


def test_envelope(spark):
    rows = [("a", "2024-01-03", 10.0, 31.5, 1, 20, 5.0, -1.0), ("a", "2024-01-03", 10.0, 31.5, 1, 5, 2.0, -0.5), ("a", "2024-01-01", 9.0, None, -1, 5, None, None)]
    signals = spark.createDataFrame(rows, "symbol string, date string, close double, rsi double, signal int, horizon int, max_profit double, max_drawdown double")
    summary = spark.createDataFrame([("a", "x ~ y", 3), ("b", "x ~ z", 1)], "symbol string, data_range string, total_days int")
    got = {r["symbol"]: json.loads(r["json"]) for r in sinks.envelope(signals, summary, [5, 20], F.lit("2024-02-01").cast("timestamp")).collect()}
    entries = [
        {"date": "2024-01-01", "close": 9.0, "rsi": None, "signal": -1, "returns": {"5": None}},
        {"date": "2024-01-03", "close": 10.0, "rsi": 31.5, "signal": 1, "returns": {"5": {"max_profit": 2.0, "max_drawdown": -0.5}, "20": {"max_profit": 5.0, "max_drawdown": -1.0}}},
    ]
    shared = {"last_update": "2024-02-01 00:00:00", "future_days": [5, 20]}
    assert got == {"a": {"symbol": "a", "data_range": "x ~ y", "total_days": 3, **shared, "signals": entries}, "b": {"symbol": "b", "data_range": "x ~ z", "total_days": 1, **shared, "signals": []}}


def test_csv_files(spark, tmp_path):
    rows = [("a", 30, "level, straight", "up", "2024-01-03", 10.0, 99.5, "pending", "b", "2020-01-02", 12.345), ("c", 30, "level, straight", "down", "2024-01-03", 9.0, 99.75, "weak", "b", "2020-01-02", -8.0)]
    scan = spark.createDataFrame(rows, "symbol string, period int, pattern string, direction string, date string, close double, similarity double, status string, match_symbol string, match_date string, match_move double")
    names = spark.createDataFrame([("a", "Alpha")], "symbol string, name string")
    out = sinks.pattern_rows(scan, names)
    sinks.write_csv(out.coalesce(1), f"{tmp_path}/p", [F.desc(sinks.PATTERN_COLUMNS[7])], bom=True)
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "p").glob("*.csv")))
    assert raw.startswith(b"\xef\xbb\xbf")
    lines = raw.decode("utf-8-sig").splitlines()
    assert lines[0].split(",") == sinks.PATTERN_COLUMNS
    assert lines[1:] == ['c,c,30日,"level, straight",大跌,2024-01-03,9.0,99.75%,weak,b,2020-01-02,-8.00%', 'a,Alpha,30日,"level, straight",大漲,2024-01-03,10.0,99.50%,pending,b,2020-01-02,12.35%']


def test_cache(spark, tmp_path):
    calls = []

    def fetch(last="2024-01-05"):
        calls.append(last)
        return spark.createDataFrame([("a", "2024-01-01", 1.0), ("a", last, 2.0), ("b", last, 3.0)], "symbol string, date string, close double").withColumn("date", F.col("date").cast("date"))

    path = f"{tmp_path}/cache"
    load = lambda day: bars.load_or_refresh(spark, path, fetch, day)
    assert load("2024-01-05").count() == 3 and len(calls) == 1  # no cache
    assert load("2024-01-06").count() == 3 and len(calls) == 1  # fresh
    assert load("2024-01-08").count() == 3 and len(calls) == 2  # stale
    for file in (tmp_path / "cache").rglob("*.parquet"):
        file.write_bytes(b"not a table")
    assert load("2024-01-05").count() == 3 and len(calls) == 3  # damaged


PATTERN = "symbol string, period int, pattern string, direction string, date string, close double, similarity double, status string, match_symbol string, match_date string, match_move double"


def test_one_csv(spark, tmp_path):
    """The twelve columns in one file, byte for byte, from many tasks; again over the
    old file; a job that fails leaves the old file; no rows leave the header."""
    rows = [(f"s{k:04}", 30, 'level, "straight"' if k % 7 == 0 else None, "up", "2024-01-03", 10.0, float(k % 50), "pending", "b", "2020-01-02", k / 8) for k in range(4000)]
    scan = spark.createDataFrame(rows, PATTERN).repartition(8)
    out = sinks.pattern_rows(scan)
    path = tmp_path / "p.csv"
    order = [F.desc(F.regexp_replace(sinks.PATTERN_COLUMNS[7], "%", "").cast("double")), F.col(sinks.PATTERN_COLUMNS[0])]
    path.write_text("old")
    sinks.write_one_csv(out, f"file://{path}", order, bom=True)
    quoted = lambda k: '"level, \\"straight\\""' if k % 7 == 0 else ""
    lines = [f"s{k:04},s{k:04},30日,{quoted(k)},大漲,2024-01-03,10.0,{float(k % 50):.2f}%,pending,b,2020-01-02,{sinks_move(k)}%" for k in sorted(range(4000), key=lambda k: (-(k % 50), k))]
    assert path.read_bytes() == ("﻿" + "\n".join([",".join(sinks.PATTERN_COLUMNS), *lines]) + "\n").encode()
    assert out.orderBy(*order).rdd.getNumPartitions() > 1 or spark.conf.get("spark.sql.adaptive.enabled") == "true"
    try:
        sinks.write_one_csv(out.withColumn(sinks.PATTERN_COLUMNS[1], F.raise_error(F.lit("stop")).cast("string")), f"file://{path}", order)
        raise AssertionError("no error")
    except Exception as error:
        assert "stop" in str(error)
    assert len(path.read_bytes().splitlines()) == 4001
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["p.csv"]
    sinks.write_one_csv(out.where("false"), f"file://{path}", order)
    assert path.read_text() == ",".join(sinks.PATTERN_COLUMNS) + "\n"


def sinks_move(k):
    from decimal import ROUND_HALF_UP, Decimal

    return Decimal(k / 8).quantize(Decimal("0.01"), ROUND_HALF_UP)


def test_wave_report_halves(spark):
    """Medians and means that end in half a hundredth, against the query's SQL."""
    rows = [(f"s{k:03}", i, kind, "2024-01-01", 100.0, 101.0, sign * (k + i) / 100, 1 + k % 7 * i, i == 1 and sign > 0) for k in range(300) for kind, sign in (("up", 1), ("down", -1)) for i in (0, 1)]
    columns = ["symbol", "seq", "type", "start_date", "start_val", "end_val", "pct", "days", "is_open"]
    waves = spark.createDataFrame(rows, "symbol string, seq int, type string, start_date string, start_val double, end_val double, pct double, days int, is_open boolean")
    con = duckdb.connect()
    con.register("rows", waves.toPandas())
    con.execute(f"CREATE TABLE waves AS SELECT {', '.join(columns)} FROM rows")
    sql = oracle.oracle_sql()["wave_report"].replace(f"{oracle.RUNS}, ", "")
    got = sorted(tuple(r) for r in sinks.wave_report(waves).collect())
    assert got == sorted(con.execute(sql).fetchall()) and len(got) == 900
