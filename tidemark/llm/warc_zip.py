"""Operator 10: WARC records in ZIP packages, written and range-read back.

Writing: pages are dealt to tasks by payload digest; each task streams records,
one gzip member each, into ZIP packages of about ``PACKAGE_BYTES`` of payload
under the shared folder.  A package has two stored members, the archive and an
index with the place of each record.  Reading: the end of the package leads to
the (ZIP64) central directory, that to the two members; the index then gives
the ranges to read, and no package is unpacked.

Of pages with equal payloads the one with the largest page_id is written as a
response, the others as revisits of it without the payload.

Defined results: null html is an empty payload; a null page_id is always a
response and never revisited; repeated rows are each written (equal ids with
equal payloads are all responses); a null url is left out of the record; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import durable, shared_dir, table

PACKAGE_BYTES = 64_000_000
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


class PackageWriter:
    def __init__(self, folder: str):
        self.system, path = fs.FileSystem.from_uri(folder)
        self.path = f"{path}/{uuid.uuid4().hex}.wacz"
        self.sink = self.system.open_output_stream(self.path)
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(ARCHIVE, "w", force_zip64=True)
        self.at, self.payload, self.index = 0, 0, []

    def add(self, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> None:
        data = gzip.compress(record(page_id, url, payload, refers_to), 1, mtime=0)
        self.member.write(data)
        self.index.append(json.dumps({"page_id": page_id, "offset": self.at, "length": len(data)}))
        self.at += len(data)
        self.payload += len(payload)

    def close(self) -> tuple[str, int]:
        self.member.close()
        self.zip.writestr(INDEX, "\n".join(self.index))
        self.zip.close()
        self.sink.close()
        return self.path, len(self.index)


def write_packages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """(path, records) of the packages written; checkpointed, so that the paths
    are those of the attempts that ended well."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.encode(F.coalesce(html_col, F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    owners = rows.where(F.length("payload") >= least).groupBy("sha").agg(F.max("page_id").alias("owner"))
    joined = rows.join(owners, "sha", "left").select("page_id", "url", "payload", F.when(F.col("owner") != F.col("page_id"), F.col("owner")).alias("refers_to"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, package = [], None
        for batch in batches:
            for page_id, url, payload, refers_to in zip(batch["page_id"], batch["url"], batch["payload"], batch["refers_to"], strict=True):
                package = package or PackageWriter(folder)
                package.add(None if pd.isna(page_id) else int(page_id), url, bytes(payload), None if pd.isna(refers_to) else int(refers_to))
                if package.payload >= PACKAGE_BYTES:
                    out.append(package.close())
                    package = None
        if package:
            out.append(package.close())
        yield pd.DataFrame(out, columns=["path", "records"])

    return durable(joined.mapInPandas(write, "path string, records long"))


class PackageReader:
    """A ZIP package's stored members, found without reading the rest."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        tail = self.read(max(0, size - 66_000), min(size, 66_000))
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack("<H", tail[end + 10 : end + 12])[0], *struct.unpack("<II", tail[end + 12 : end + 20])
        if (locator := tail.rfind(b"PK\x06\x07", 0, end)) >= 0 and (count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF):
            end64 = self.read(struct.unpack("<Q", tail[locator + 8 : locator + 16])[0], 56)
            length, start = struct.unpack("<QQ", end64[40:56])
        self.members: dict[str, tuple[int, int]] = {}
        directory, at = self.read(start, length), 0
        while directory[at : at + 4] == b"PK\x01\x02":
            method, packed, full, n_name, n_extra, n_comment, offset = *struct.unpack("<H", directory[at + 10 : at + 12]), *struct.unpack("<II", directory[at + 20 : at + 28]), *struct.unpack("<HHH", directory[at + 28 : at + 34]), *struct.unpack("<I", directory[at + 42 : at + 46])
            name = directory[at + 46 : at + 46 + n_name].decode()
            extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
            while len(extra) >= 4:
                kind, n = struct.unpack("<HH", extra[:4])
                if kind == 1:  # ZIP64: only the fields that did not fit, in this order
                    wide = list(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                    full = wide.pop(0) if full == 0xFFFFFFFF else full
                    packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                    offset = wide.pop(0) if offset == 0xFFFFFFFF else offset
                extra = extra[4 + n :]
            if method == 0:
                self.members[name] = (offset, packed)
            at += 46 + n_name + n_extra + n_comment

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def start(self, name: str) -> int:
        """Where a member's bytes begin: behind its own header."""
        offset = self.members[name][0]
        n_name, n_extra = struct.unpack("<HH", self.read(offset + 26, 4))
        return offset + 30 + n_name + n_extra

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        """(WARC headers, block) of each record, by the ranges of the index."""
        index = self.read(self.start(INDEX), self.members[INDEX][1]).decode().splitlines()
        first = self.start(ARCHIVE)
        for line in index:
            place = json.loads(line)
            data = zlib.decompress(self.read(first + place["offset"], place["length"]), 31)
            head, _, rest = data.partition(b"\r\n\r\n")
            headers = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
            yield headers, rest[: int(headers["Content-Length"])]


def read_packages(packages: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of packages (path): page_id, url, record_type, refers_to,
    payload_digest, payload_bytes, and the payload (null for revisits)."""

    def number(urn: str | None) -> int | None:
        return int(urn[10:-1]) if urn and urn[10:-1] else None

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch["path"]:
                out = []
                with system.open_input_file(path) as file:
                    for headers, block in PackageReader(file).records():
                        http, _, payload = block.partition(b"\r\n\r\n")
                        told = next(int(x[15:]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length:"))
                        revisit = headers["WARC-Type"] == "revisit"
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if not revisit and (base32_sha1(payload) != digest or len(payload) != told):
                            raise ValueError(f"{path}: the record of {headers['WARC-Record-ID']} is damaged")
                        out.append((number(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), headers["WARC-Type"], number(headers.get("WARC-Refers-To")), digest, told, payload if payloads and not revisit else None))
                yield pd.DataFrame(out, columns=["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]).astype({"page_id": "Int64", "refers_to": "Int64"})

    schema = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
    # A number that is named is not coalesced: each package is a task of its own.
    return packages.select("path").repartition(max(1, packages.count())).mapInPandas(read, schema)


def op10_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark).rstrip('/')}/packages-{uuid.uuid4().hex}"
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path)
    packages = write_packages(table(spark, sf_dir, "pages"), folder)
    return read_packages(packages, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
