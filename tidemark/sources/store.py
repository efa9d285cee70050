"""A versioned table of bars: one base, deltas over it, and a manifest for each
version.  A writer adds files and then one manifest, by a rename that fails if the
version is there; readers take the last manifest.  So a job that dies between the
two leaves the old version as it was, and no reader sees half a version."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import bars as src

#: Deltas over the base before they are merged into a new one.
MOST_DELTAS = 8


class BarStore:
    """Bars (symbol, date, ...) under ``path``, one row for each symbol and date."""

    def __init__(self, spark: SparkSession, path: str, most_deltas: int = MOST_DELTAS):
        self.spark, self.path, self.most = spark, path.rstrip("/"), most_deltas
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._fs = self._path(self.path).getFileSystem(self._conf)

    # manifests

    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> dict | None:
        """{parts: folders from the base on, streams: the last batch of each stream}."""
        known = self.versions()
        if not known:
            return None
        name = f"{self.path}/manifests/{known[-1] if version is None else version:020d}.json"
        return json.loads(self.spark.read.text(name, wholetext=True).first()["value"])

    def commit(self, parts: list[str], streams: dict[str, int]) -> int:
        """Make ``parts`` the next version; fails if another writer was first."""
        version = (self.versions() or [0])[-1] + 1
        text = json.dumps({"parts": parts, "streams": streams})
        draft = self._path(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf).rename(draft, self._path(f"{self.path}/manifests/{version:020d}.json"), none)
        return version

    # rows

    def read(self, version: int | None = None) -> DataFrame:
        found = self.manifest(version)
        if found is None:
            raise FileNotFoundError(f"no version of {self.path}")
        return self._merged(found["parts"])

    def _merged(self, parts: list[str]) -> DataFrame:
        first, *later = (self.spark.read.parquet(f"{self.path}/{p}") for p in parts)
        if not later:
            return first
        both = first.withColumn("_load", F.lit(0))
        for k, delta in enumerate(later, 1):
            both = both.unionByName(delta.withColumn("_load", F.lit(k)))
        rest = [c for c in first.columns if c not in ("symbol", "date")]
        last = both.groupBy("symbol", "date").agg(F.max_by(F.struct(*rest), "_load").alias("bar"))
        return last.select(*[c if c in ("symbol", "date") else F.col(f"bar.{c}").alias(c) for c in first.columns])

    def _write(self, bars: DataFrame, kind: str) -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        # In order of (symbol, date), so that files and row groups can be passed over by their limits.
        parts = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        bars.repartitionByRange(parts, "symbol", "date").sortWithinPartitions("symbol", "date").write.parquet(f"{self.path}/{name}")
        return name

    def write(self, bars: DataFrame, stream: str | None = None, batch: int = 0) -> int:
        """Add bars as a delta; of several bars of one symbol and date in it the one
        with the largest volume stays, as in ``sources.bars.one_each``.  A batch of
        a stream that a version holds already is passed over.  Gives the version."""
        now = self.manifest() or {"parts": [], "streams": {}}
        if stream is not None and now["streams"].get(stream, -1) >= batch:
            return self.versions()[-1]
        parts = [*now["parts"], self._write(src.one_each(bars), "delta" if now["parts"] else "base")]
        if len(parts) > self.most + 1:
            parts = [self._write(self._merged(parts), "base")]
        return self.commit(parts, now["streams"] | ({} if stream is None else {stream: batch}))

    def compact(self) -> int:
        """Merge the deltas into a new base."""
        now = self.manifest()
        return self.commit([self._write(self._merged(now["parts"]), "base")], now["streams"])

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete all but the last ``keep`` versions and what none of those reads;
        also what jobs that died have left.  Not while another job writes."""
        known = self.versions()
        used = {p for v in known[-keep:] for p in self.manifest(v)["parts"]}
        for v in known[:-keep]:
            self._fs.delete(self._path(f"{self.path}/manifests/{v:020d}.json"), False)
        gone = [n for n in (s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))) if n.startswith(("base-", "delta-")) and n not in used]
        for name in gone:
            self._fs.delete(self._path(f"{self.path}/{name}"), True)
        return gone

    # refresh

    def stale(self, symbols: DataFrame, as_of: str, days: int = 1) -> DataFrame:
        """(symbol, last_date) of the wanted symbols whose last bar is more than
        ``days`` old; null where there is none."""
        wanted = symbols.select("symbol").distinct()
        if self.manifest() is None:
            return wanted.withColumn("last_date", F.lit(None).cast("date"))
        last = src.fresh(self.read(), as_of, days)
        return wanted.join(last, "symbol", "left").where(~F.coalesce("is_fresh", F.lit(False))).select("symbol", "last_date")

    def refresh(self, symbols: DataFrame, fetch: Callable[[DataFrame], DataFrame], as_of: str, days: int = 1) -> int:
        """Bring the symbols up to date: ``fetch`` takes the stale ones (symbol,
        last_date) and gives their bars from that date on, all of them where it is
        null.  The bar of the last date itself replaces the one that is there, as it
        may have been written before the day was over.  Fresh symbols are not
        fetched, and without stale ones nothing is written."""
        stale = self.stale(symbols, as_of, days)
        if stale.isEmpty():
            return self.versions()[-1] if self.versions() else 0
        got = fetch(stale)
        newer = got.join(stale, "symbol").where("last_date is null or date >= last_date").select(*got.columns)
        return self.write(newer)
