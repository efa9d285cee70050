"""The chart reader over transports of the test's own."""

import datetime as dt
import json
import time
from urllib.error import HTTPError, URLError
from urllib.parse import parse_qs, unquote, urlsplit

import pytest
from pyspark.sql import functions as F

from tidemark.sources import chart
from tidemark.sources.store import BarStore

DAY = 86_400
START = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp())
HOSTS = json.dumps(["https://first", "https://second"])


def service(log=None, broken=(), error=HTTPError):
    """A transport that knows 60 days of ^A and B/C; it notes each request in a folder."""

    def ask(url):
        parts = urlsplit(url)
        symbol, asked = unquote(parts.path.rpartition("/")[2]), parse_qs(parts.query)
        low, high = int(asked["period1"][0]), int(asked["period2"][0])
        if log:
            with open(f"{log}/{time.time_ns()}.json", "w") as out:
                json.dump([parts.netloc, symbol, low, high], out)
        if parts.netloc in broken:
            raise error(url, 500, "down", None, None) if error is HTTPError else error("no route")
        at = [START + k * DAY + 3600 for k in range(60) if low <= START + k * DAY + 3600 < high]
        price = [None if (t // DAY) % 10 == 0 else round((t // DAY) % 97 + 0.126, 3) for t in at]
        return json.dumps({"chart": {"result": [{"timestamp": at, "indicators": {"quote": [{"open": price, "high": price, "low": price, "close": price}]}}]}}).encode()

    return ask


def asked(folder):
    return sorted(tuple(json.loads(p.read_text())) for p in folder.glob("*.json"))


def days(first, until):
    """The days the service has prices of."""
    return [first + dt.timedelta(days=k) for k in range((until - first).days) if ((START // DAY) + (first - dt.date(2024, 1, 1)).days + k) % 10]


def test_pushed_filters(spark, tmp_path):
    found = chart.read_chart(spark, ["^A", "B/C", "^A"], service(str(tmp_path)), hosts=HOSTS, first="2024-01-01", until="2024-03-01")
    got = found.where("symbol = 'B/C' and date >= date'2024-01-10' and date <= date'2024-01-20'").collect()
    first, until = dt.date(2024, 1, 10), dt.date(2024, 1, 21)
    assert sorted(r["date"] for r in got) == days(first, until)
    assert all(r["close"] == round((START // DAY + (r["date"] - dt.date(2024, 1, 1)).days) % 97 + 0.13, 2) for r in got)
    assert {r[1:] for r in asked(tmp_path)} == {("B/C", START + 9 * DAY, START + 20 * DAY)}


def test_partitions(spark):
    found = chart.read_chart(spark, ["^A", "B/C", "^A"], service(), hosts=HOSTS, first="2024-01-01", until="2024-03-01")
    assert found.rdd.getNumPartitions() == 2
    assert found.groupBy("symbol").count().count() == 2 and found.count() == 2 * len(days(dt.date(2024, 1, 1), dt.date(2024, 3, 1)))
    assert found.where("date < date'2023-01-01'").count() == 0


def test_failover(spark, tmp_path):
    """The second host only after an HTTP error of the first; other errors are raised."""
    options = {"hosts": HOSTS, "first": "2024-01-01", "until": "2024-01-05"}
    assert chart.read_chart(spark, ["^A"], service(str(tmp_path), ["first"]), **options).count() == len(days(dt.date(2024, 1, 1), dt.date(2024, 1, 5)))
    assert {r[0] for r in asked(tmp_path)} == {"first", "second"}
    at = dt.date(2024, 1, 1), dt.date(2024, 1, 5), "UTC", json.loads(HOSTS)
    with pytest.raises(HTTPError):
        chart.request("^A", *at, service(broken=["first", "second"]))
    with pytest.raises(URLError):
        chart.request("^A", *at, service(broken=["first"], error=URLError))


def test_defaults(spark, tmp_path):
    """Ten years and a month up to today where no days are named."""
    chart.read_chart(spark, ["^A"], service(str(tmp_path)), hosts=HOSTS).count()
    low, high = asked(tmp_path)[0][2:]
    assert (high - low) // DAY == 3680 and abs(high - time.time()) < 2 * DAY


def test_gaps_in_payloads():
    assert chart.flat({"chart": {"result": None}}) == [] and chart.flat({}) == []
    quote = {"open": [1.0, 2.0], "high": [1.0], "low": [1.0, 2.0], "close": [1.0, 2.0]}
    assert chart.flat({"chart": {"result": [{"timestamp": [5, 6], "indicators": {"quote": [quote]}}]}}) == [(5, 1.0, 1.0, 1.0, 1.0), (6, 2.0, None, 2.0, 2.0)]


def test_archive(spark, tmp_path):
    """An archive answers as the service did; an unknown symbol is a 404."""
    ask = service()
    payload = ask(f"https://first/v8/finance/chart/%5EA?period1={START}&period2={START + 60 * DAY}").decode()
    kept = chart.archive(spark.createDataFrame([("^A", payload)], "symbol string, json string"), f"file://{tmp_path}/kept")
    options = {"hosts": HOSTS, "first": "2024-01-15", "until": "2024-02-01"}
    want = chart.read_chart(spark, ["^A"], ask, **options).orderBy("date").collect()
    assert chart.read_chart(spark, ["^A"], kept, **options).orderBy("date").collect() == want and want
    with pytest.raises(HTTPError):
        kept(f"https://first/v8/finance/chart/Z?period1={START}&period2={START + 1}")


def test_refresh(spark, tmp_path):
    """A store asks for stale symbols alone, from their last date on."""
    log = tmp_path / "log"
    log.mkdir()
    symbols = spark.createDataFrame([("^A",), ("B/C",)], "symbol string")
    store = BarStore(spark, f"file://{tmp_path}/store")
    store.refresh(symbols.where("symbol = '^A'"), chart.chart_fetch(dt.date(2024, 1, 20), service(str(log)), hosts=["https://first"]), "2024-01-19")
    assert {(r[1], r[2]) for r in asked(log)} == {("^A", START - (3680 - 19) * DAY)}
    for p in log.glob("*"):
        p.unlink()
    store.refresh(symbols, chart.chart_fetch(dt.date(2024, 2, 1), service(str(log)), hosts=["https://first"]), "2024-01-31")
    last = max(days(dt.date(2024, 1, 1), dt.date(2024, 1, 20)))
    assert {(r[1], r[2]) for r in asked(log)} == {("^A", START + (last - dt.date(2024, 1, 1)).days * DAY), ("B/C", START - (3680 - 31) * DAY)}
    got = store.read().groupBy("symbol").agg(F.count("*").alias("n"), F.countDistinct("date").alias("d")).collect()
    assert {(r["symbol"], r["n"], r["d"]) for r in got} == {(s, n, n) for s in ("^A", "B/C") for n in [len(days(dt.date(2024, 1, 1), dt.date(2024, 2, 1)))]}
