"""Daily bars from a chart service: ``ChartSource``, a data source with a partition
for each symbol, and ``chart_fetch``, which asks for the stale symbols of a bar store.

How a request travels is a parameter, ``transport``: a function of a URL that gives
the answer's bytes and raises ``HTTPError`` where the service answers with an error.
Only then the next host is asked; any other error (no route, a time-out, an answer
that is no payload) fails the task, which Spark tries again."""

from __future__ import annotations

import datetime as dt
import glob
import hashlib
import json
import re
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from itertools import zip_longest
from urllib.error import HTTPError
from zoneinfo import ZoneInfo

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tidemark.sources import bars as src

#: Fixed values of the service: its hosts, in the order they are asked, and the path below.
HOSTS = ["https://query1.finance.yahoo.com", "https://query2.finance.yahoo.com"]
CHART = "/v8/finance/chart/"
AGENT = "Mozilla/5.0"
SCHEMA = "symbol string, date date, open double, high double, low double, close double"
_ARROW = pa.schema([("symbol", pa.string()), ("date", pa.date32()), *[(c, pa.float64()) for c in src.OHLC]])
Transport = Callable[[str], bytes]


def http(url: str, timeout: float = 30.0) -> bytes:
    request = urllib.request.Request(url, headers={"User-Agent": AGENT})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return answer.read()


class Archive:
    """A transport that answers from payloads kept in a folder (see ``archive``), so
    that days fetched once can be read again without the service.  An unknown symbol
    is a 404.  The folder is a path or file: URL that every executor sees."""

    def __init__(self, folder: str):
        self.folder = re.sub("^file:/+", "/", folder)

    def __call__(self, url: str) -> bytes:
        parts = urllib.parse.urlsplit(url)
        symbol = urllib.parse.unquote(parts.path.rpartition("/")[2])
        asked = urllib.parse.parse_qs(parts.query)
        low, high = int(asked["period1"][0]), int(asked["period2"][0])
        files = sorted(glob.glob(f"{glob.escape(self.folder)}/key={key(symbol)}/*.txt"))
        if not files:
            raise HTTPError(url, 404, "no such symbol", None, None)
        rows = []
        for name in files:
            with open(name, encoding="utf-8") as lines:
                rows += [row for line in lines for row in flat(json.loads(line)) if low <= row[0] < high]
        columns = list(zip(*sorted(rows, key=lambda r: r[0]), strict=True)) or [()] * (1 + len(src.OHLC))
        quote = dict(zip(src.OHLC, columns[1:], strict=True))
        return json.dumps({"chart": {"result": [{"timestamp": columns[0], "indicators": {"quote": [quote]}}]}}).encode()


def key(symbol: str) -> str:
    return hashlib.sha256(symbol.encode()).hexdigest()


def archive(payloads: DataFrame, folder: str) -> Archive:
    """Write (symbol, json) rows of payloads, several a symbol at will, for an ``Archive``."""
    payloads.select(F.sha2("symbol", 256).alias("key"), "json").write.partitionBy("key").text(folder)
    return Archive(folder)


def flat(payload: dict) -> list[tuple]:
    """(timestamp, open, high, low, close) of a payload; short arrays are filled with nulls."""
    rows = []
    for result in (payload.get("chart") or {}).get("result") or []:
        quote = ((result.get("indicators") or {}).get("quote") or [{}])[0] or {}
        rows += zip_longest(result.get("timestamp") or [], *[quote.get(c) or [] for c in src.OHLC])
    return [row for row in rows if row[0] is not None]


def seconds(day: dt.date, zone: str) -> int:
    return int(dt.datetime(day.year, day.month, day.day, tzinfo=ZoneInfo(zone)).timestamp())


def request(symbol: str, first: dt.date, until: dt.date, zone: str, hosts: Iterable[str], transport: Transport) -> list[tuple]:
    """(symbol, date, open, high, low, close) of the days from ``first`` on and before
    ``until``, as the first host that does not answer with an HTTP error gives them."""
    query = urllib.parse.urlencode({"period1": seconds(first, zone), "period2": seconds(until, zone), "interval": "1d", "includeAdjustedClose": "true"})
    error: HTTPError | None = None
    for host in hosts:
        try:
            answer = transport(f"{host}{CHART}{urllib.parse.quote(symbol, safe='')}?{query}")
        except HTTPError as failed:
            error = failed
            continue
        where = ZoneInfo(zone)
        return [(symbol, dt.datetime.fromtimestamp(at, where).date(), *[None if x is None else float(x) for x in prices]) for at, *prices in flat(json.loads(answer))]
    raise error or ValueError("no hosts")


def earliest(until: dt.date, years: int) -> dt.date:
    """The first day asked for where none is named: ``years`` and a month back."""
    return until - dt.timedelta(days=years * 365 + 30)


class Days(InputPartition):
    def __init__(self, symbol: str, first: dt.date, until: dt.date):
        self.symbol, self.first, self.until = symbol, first, until


class ChartReader(DataSourceReader):
    def __init__(self, options: dict, transport: Transport):
        self.transport = transport
        self.symbols = list(dict.fromkeys(json.loads(options["symbols"])))
        self.zone = options.get("zone", "UTC")
        self.hosts = json.loads(options["hosts"]) if "hosts" in options else HOSTS
        # Without an end, today is asked for too.
        self.until = dt.date.fromisoformat(options["until"]) if "until" in options else dt.datetime.now(ZoneInfo(self.zone)).date() + dt.timedelta(days=1)
        self.first = dt.date.fromisoformat(options["first"]) if "first" in options else earliest(self.until, int(options.get("years", "10")))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Symbols and days outside the filters are not asked for.  Spark tests the
        rows again, so an answer with more days than asked for does no harm."""
        day = dt.timedelta(days=1)
        for f in filters:
            if isinstance(f, (EqualTo, EqualNullSafe, In)) and f.attribute == ("symbol",):
                wanted = set(f.value if isinstance(f, In) else [f.value])
                self.symbols = [s for s in self.symbols if s in wanted]
            elif getattr(f, "attribute", None) == ("date",) and isinstance(getattr(f, "value", None), dt.date):
                if isinstance(f, (EqualTo, EqualNullSafe, GreaterThanOrEqual, GreaterThan)):
                    self.first = max(self.first, f.value + day if isinstance(f, GreaterThan) else f.value)
                if isinstance(f, (EqualTo, EqualNullSafe, LessThanOrEqual, LessThan)):
                    self.until = min(self.until, f.value if isinstance(f, LessThan) else f.value + day)
            yield f

    def partitions(self) -> list[InputPartition]:
        if self.first >= self.until:
            return []
        return [Days(s, self.first, self.until) for s in self.symbols]

    def read(self, partition: Days | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are none
            return
        rows = request(partition.symbol, partition.first, partition.until, self.zone, self.hosts, self.transport)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


def chart_source(transport: Transport = http) -> type[DataSource]:
    """The source "chart" over a transport.  Options: symbols (a JSON list), first and
    until (ISO dates, until not included), years (10), zone, hosts (a JSON list)."""

    class ChartSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return "chart"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return ChartReader(self.options, transport)

    return ChartSource


def rounded(rows: DataFrame) -> DataFrame:
    """Rows without gaps, prices to 2 places."""
    return src.drop_gaps(rows).select("symbol", "date", *[F.round(c, 2).alias(c) for c in src.OHLC])


def read_chart(spark: SparkSession, symbols: list[str], transport: Transport = http, **options: str) -> DataFrame:
    """Bars (symbol, date, open, high, low, close), a request for each symbol, sent
    when the rows are read.  Filters on symbol and date narrow the requests."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(chart_source(transport))
    return rounded(spark.read.format("chart").options(symbols=json.dumps(symbols), **options).load())


def chart_fetch(until: dt.date, transport: Transport = http, zone: str = "UTC", hosts: list[str] | None = None, years: int = 10) -> Callable[[DataFrame], DataFrame]:
    """What ``BarStore.refresh`` takes: from (symbol, last_date) the bars of each symbol
    from its last date on and before ``until``.  Symbols stay in Spark, dealt to tasks."""

    def fetch(stale: DataFrame) -> DataFrame:
        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for symbol, last in zip(batch["symbol"], batch["last_date"], strict=True):
                    first = earliest(until, years) if pd.isna(last) else last
                    rows = request(symbol, first, until, zone, hosts or HOSTS, transport) if first < until else []
                    yield pd.DataFrame(rows, columns=_ARROW.names).astype({c: float for c in src.OHLC})

        return rounded(stale.select("symbol", F.col("last_date").cast("date")).repartition("symbol").mapInPandas(ask, SCHEMA))

    return fetch
