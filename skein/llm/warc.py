"""WARC files as a Spark data source (``format("warc")``), written and read by tasks.

Writing: every task writes one file of its own name and announces it on commit; the driver then writes a list of the
committed files, so files of lost or repeated attempts are never read. With each file goes an index with the offset
of a record at every ``SPLIT_BYTES`` (option ``splitBytes``), which lets readers split it exactly.

A payload is stored with ``Content-Encoding: gzip`` inside its record, so headers stay readable and a skipped payload is
neither read nor unpacked; digest and length are those of the payload itself.

Reading: the list (or, without one, every ``*.warc``) is planned into partitions of neighbouring splits. Equality, IN and
null tests on ``record_type``, ``record_id``, ``refers_to``, ``target_uri`` and ``payload_digest`` are taken over from
Spark's filters; headers are parsed first, and records that fail them, as well as payloads no column asks for, are
skipped by seeking. Ask for fewer columns with ``.schema(...)``.

Defined results: a null payload is empty; a null URL leaves its header out and reads back as null, a revisit's payload as
null; line breaks in header values are written as %0D and %0A; repeated rows give repeated records; an empty table gives
a folder without records. Of rows with equal payloads and equal, largest id all are responses; rows without an id
refer to the largest id, and are responses if there is none. Further columns of ``pages`` are ignored.
"""

from __future__ import annotations

import base64
import gzip
import io
import json
import os
import uuid
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition,
                                    IsNotNull, IsNull, WriterCommitMessage)

from skein.session import cut_lineage

SCHEMA = ("record_id string, record_type string, target_uri string, refers_to string, payload_digest string, "
          "payload_bytes bigint, payload binary")
FIELDS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri",
          "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest", "payload_bytes": "x-payload-length"}
TESTED = ("record_type", "record_id", "refers_to", "target_uri", "payload_digest")
LIST, SPLIT_BYTES = "_committed.json", 16 << 20
FILE_BYTES = 256 << 20  # of payload for every file written
PARTITION_BYTES, OPEN_BYTES = 32 << 20, 1 << 20  # what a task reads at most, and what opening a file counts for


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """Any file system Arrow knows by URI; plain paths are local."""
    if "://" not in path and path.startswith("file:"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


@dataclass
class Splits(InputPartition):
    """(file, start, end) of what one task reads."""

    parts: list


@dataclass
class Written(WriterCommitMessage):
    file: str
    splits: list


def record(row, date: str) -> bytes:
    """One record with CRLF lines; a revisit carries its HTTP header only. A bare hexadecimal SHA-1 is written as base32."""
    revisit = row["record_type"] == "revisit"
    body = b"" if revisit else gzip.compress(row["payload"] or b"", 1, mtime=0)
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Encoding: gzip\r\n"
             f"Content-Length: {len(body)}\r\n\r\n").encode() + body
    digest = row["payload_digest"]
    if digest and ":" not in digest:
        digest = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    head = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", date),
            ("WARC-Target-URI", row["target_uri"]), ("WARC-Payload-Digest", digest),
            ("WARC-Refers-To", row["refers_to"]), ("X-Payload-Length", str(row["payload_bytes"])),
            ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    if revisit:
        head.insert(1, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    lines = [f"{k}: {str(v)}".replace("\r", "%0D").replace("\n", "%0A") for k, v in head if v is not None]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


class WarcWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool, date: str, split_bytes: int):
        self.path, self.overwrite, self.date, self.split_bytes = path, overwrite, date, split_bytes

    def write(self, iterator):
        files, root = opened(self.path)
        files.create_dir(root, recursive=True)
        name, at, splits = f"{uuid.uuid4().hex}.warc", 0, [0]
        with files.open_output_stream(f"{root}/{name}", compression=None) as out:
            for row in iterator:
                data = record(row, self.date)
                if at - splits[-1] >= self.split_bytes:
                    splits.append(at)
                out.write(data)
                at += len(data)
        return Written(name, [*splits, at])

    def commit(self, messages):
        files, root = opened(self.path)
        files.create_dir(root, recursive=True)
        target = f"{root}/{LIST}"
        old = {}
        if not self.overwrite and files.get_file_info(target).type == pafs.FileType.File:
            with files.open_input_stream(target) as f:
                old = json.loads(f.read())
        with files.open_output_stream(target, compression=None) as out:
            out.write(json.dumps(old | {m.file: m.splits for m in messages if m}).encode())

    def abort(self, messages):
        files, root = opened(self.path)
        for m in messages:
            if m:
                files.delete_file(f"{root}/{m.file}")


def past_blanks(f) -> int:
    """Go to the next record, whose offset is returned."""
    at = f.tell()
    while f.readline() in (b"\r\n", b"\n"):
        at = f.tell()
    return f.seek(at)


def header_lines(f) -> dict[str, str] | None:
    """Fields of the next header; None at the end of the file."""
    line = f.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record at {f.tell()}: {line[:40]!r}")
    out = {}
    while (line := f.readline()) not in (b"\r\n", b"\n", b""):
        k, _, v = line.decode("utf-8", "replace").partition(":")
        out[k.strip().lower()] = v.strip()
    return out


class WarcReader(DataSourceReader):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names, self.tests = path, names, []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In, IsNull, IsNotNull)) and len(f.attribute) == 1 else None
            if column in TESTED and isinstance(f, (EqualTo, In)):
                self.tests.append((column, {f.value} if isinstance(f, EqualTo) else set(f.value)))
            elif column in TESTED:
                self.tests.append((column, isinstance(f, IsNull)))
            else:
                yield f

    def partitions(self):
        files, root = opened(self.path)
        listed = f"{root}/{LIST}"
        if files.get_file_info(listed).type == pafs.FileType.File:
            with files.open_input_stream(listed) as f:
                found = json.loads(f.read())
        else:
            found = {os.path.basename(x.path): [0, x.size] for x in files.get_file_info(pafs.FileSelector(root))
                     if x.path.endswith(".warc")}
        out, size = [Splits([])], 0
        for name, at in sorted(found.items()):
            for a, b in zip(at, at[1:]):
                if out[-1].parts and size + b - a > PARTITION_BYTES:
                    out.append(Splits([]))
                    size = 0
                if a < b:
                    out[-1].parts.append((f"{root}/{name}", a, b))
                    size += b - a + OPEN_BYTES
        return out

    def _fits(self, head: dict) -> bool:
        for column, wanted in self.tests:
            value = head.get(FIELDS[column])
            if (value is None) != wanted if isinstance(wanted, bool) else value is None or value not in wanted:
                return False
        return True

    def read(self, partition):
        files, _ = opened(self.path)
        for name, start, stop in partition.parts:
            with files.open_input_file(name) as raw:
                f = io.BufferedReader(raw, 1 << 20)
                f.seek(start)
                while past_blanks(f) < stop and (head := header_lines(f)) is not None:
                    end = f.tell() + int(head["content-length"])
                    if self._fits(head):
                        yield tuple(self._value(n, head, f, end) for n in self.names)
                    f.seek(end)

    @staticmethod
    def _value(name, head, f, end):
        if name == "payload":
            if head.get("warc-type") == "revisit":
                return None
            packed = False
            if head.get("content-type", "").startswith("application/http"):
                while f.tell() < end and (line := f.readline()) not in (b"\r\n", b"\n"):
                    packed |= line.lower().replace(b" ", b"").strip() == b"content-encoding:gzip"
            body = f.read(end - f.tell())
            return gzip.decompress(body) if packed else body
        value = head.get(FIELDS[name])
        return int(value) if name == "payload_bytes" and value is not None else value


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        unknown = set(schema.names) - {*FIELDS, "payload"}
        if unknown:
            raise ValueError(f"a WARC record has no field {sorted(unknown)}")
        names = schema.names
        if "payload" in names and names[-1] != "payload":
            raise ValueError("payload has to be the last column: headers are read first")
        return WarcReader(self.options["path"], names)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"], overwrite, self.options.get("date", "2000-01-01T00:00:00Z"),
                          int(self.options.get("splitBytes", SPLIT_BYTES)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
            least_bytes: int = 0) -> DataFrame:
    """Rows for the writer: of equal payloads of at least ``least_bytes`` the page with the largest id is the response.

    Largest ids are gathered by digest without the payloads; the payloads are joined to them by a shuffle that
    adaptive execution can split at a digest that many pages share.
    """
    body = F.coalesce(F.encode(html, "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(page_id).alias("_id"), F.col(url).alias("target_uri"), body.alias("payload"))
    rows = rows.withColumn("_sha1", F.sha1("payload"))
    last = cut_lineage(rows.groupBy("_sha1").agg(F.max("_id").alias("_last"), F.sum(F.length("payload")).alias("_bytes")))
    total = last.agg(F.sum("_bytes")).first()[0] or 0
    tasks = max(pages.sparkSession.sparkContext.defaultParallelism, -(-total // FILE_BYTES))
    joined = rows.join(last.drop("_bytes"), "_sha1").coalesce(tasks)  # a file per task, of no more than a few hundred MB
    size = F.length("payload").cast("bigint")
    response = (size < least_bytes) | F.col("_last").isNull() | F.coalesce(F.col("_id") == F.col("_last"), F.lit(False))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    return joined.select(
        F.coalesce(urn("_id"), F.lit("<urn:page:>")).alias("record_id"),
        F.when(response, "response").otherwise("revisit").alias("record_type"), "target_uri",
        F.when(~response, urn("_last")).alias("refers_to"), F.col("_sha1").alias("payload_digest"),
        size.alias("payload_bytes"), F.when(response, F.col("payload")).alias("payload"))


def write(rows: DataFrame, path: str, mode: str = "overwrite", split_bytes: int = SPLIT_BYTES) -> None:
    register(rows.sparkSession)
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    rows.select(*columns).write.format("warc").mode(mode).option("splitBytes", split_bytes).save(path)


def read(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """Records of a folder; name fewer columns in ``schema`` to skip the rest unread."""
    register(spark)
    return spark.read.format("warc").schema(schema).load(path)
