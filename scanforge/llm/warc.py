"""Op 4 - WARC archives as a PySpark Python data source.

Writing: one gzip member per record, whose header says how long the member is (the skip-length field), rolled over to a
new file at ``roll`` bytes.  Files have names of their own for each task attempt and only those of attempts that
succeeded enter the manifest on commit, so a lost executor or a repeated task leaves no half or double records.

Reading: the manifest's files are planned as partitions, large files cut at record offsets that the manifest keeps.
Equality and IN predicates on record type and header columns are pushed down: of each member only the headers are
inflated first, and a record that fails the predicates, or a scan with ``payload=false``, skips the rest of the member
by its length without reading it.  Files of other writers are read too: gzip members with any header fields, with one
record or many, and archives that are not compressed, where the length of a block is what is skipped.

Defined results: null and empty payloads are records with no block; header values lose line breaks; a null id is
written as an empty one; repeated rows are records of their own; an empty table gives archives without records.  Of
``pages`` only page_id, url and html are read, so no name clashes.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from .common import new_path, pin

SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_length long, payload binary"
#: Header names of the format, and one extension for the length of a payload that a revisit leaves out.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "payload_length": "X-Payload-Length"}
COLUMNS = {v.lower(): k for k, v in HEADERS.items()}
MANIFEST = "_records.json"
CUT = 16 << 20
HEAD = 1 << 16


def at(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and path.startswith("file:"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def member(head: bytes, payload: bytes, level: int) -> bytes:
    """One gzip member with its skip lengths."""
    block = head + payload + b"\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(block) + z.flush()
    size = 10 + 2 + 12 + len(body) + 8
    skip = struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, size, len(block)) if max(size, len(block)) < 1 << 32 else b""
    return b"\x1f\x8b\x08" + (b"\x04" if skip else b"\x00") + bytes(4) + b"\x00\xff" + skip + body + struct.pack("<II", zlib.crc32(block), len(block) & 0xFFFFFFFF)


def clean(value: object) -> str:
    return "" if value is None else str(value).replace("\r", " ").replace("\n", " ")


def header(row: dict, length: int) -> bytes:
    lines = ["WARC/1.1"] + [f"{name}: {clean(row[col])}" for col, name in HEADERS.items() if row[col] is not None]
    return ("\r\n".join([*lines, "Content-Type: application/octet-stream", f"Content-Length: {length}"]) + "\r\n\r\n").encode("utf-8")


@dataclass
class Wrote(WriterCommitMessage):
    files: list


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.roll, self.level = options["path"], int(options.get("roll", 64 << 20)), int(options.get("level", 1))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        store, top = at(self.path)
        store.create_dir(top, recursive=True)
        files, out, n, marks = [], None, 0, [0]
        for batch in iterator:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if out is None or n >= self.roll:
                    if out is not None:
                        out.close()
                        files.append([name, n, marks])
                    name, n, marks = f"part-{uuid.uuid4().hex}.warc.gz", 0, [0]
                    out = store.open_output_stream(f"{top}/{name}", compression=None)
                payload = row["payload"] or b""
                block = member(header(row, len(payload)), payload, self.level)
                if n - marks[-1] >= CUT:
                    marks.append(n)
                out.write(block)
                n += len(block)
        if out is not None:
            out.close()
            files.append([name, n, marks])
        return Wrote(files)

    def commit(self, messages: list) -> None:
        store, top = at(self.path)
        store.create_dir(top, recursive=True)
        with store.open_output_stream(f"{top}/{MANIFEST}") as f:
            f.write(json.dumps([x for m in messages if m is not None for x in m.files]).encode())

    def abort(self, messages: list) -> None:
        store, top = at(self.path)
        for m in messages:
            for name, _, _ in m.files if m is not None else []:
                store.delete_file(f"{top}/{name}")


@dataclass
class Part(InputPartition):
    file: str
    low: int
    high: int


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() != "false"
        self.wanted: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            col = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if col in HEADERS and col != "payload_length":
                values = f.value if isinstance(f, In) else (f.value,)
                self.wanted.append((col, frozenset(values)))
            else:
                yield f

    def partitions(self) -> list[Part]:
        store, top = at(self.path)
        info = store.get_file_info(f"{top}/{MANIFEST}")
        if info.type == fs.FileType.File:
            with store.open_input_stream(f"{top}/{MANIFEST}") as f:
                files = json.loads(f.read())
        else:
            found = store.get_file_info(fs.FileSelector(top))
            files = [[x.base_name, x.size, [0]] for x in found if x.base_name.endswith((".warc", ".warc.gz"))]
        return [Part(name, low, high) for name, n, marks in files for low, high in zip(marks, [*marks[1:], n])] or [Part("", 0, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        names = [*HEADERS, "payload"]
        held: list[tuple] = []
        size = 0
        for row in self.records(part) if part.file else ():
            held.append(row)
            size += len(row[-1] or b"")
            if len(held) >= 2000 or size >= 16 << 20:
                yield batch(names, held)
                held, size = [], 0
        if held:
            yield batch(names, held)

    def records(self, part: Part) -> Iterator[tuple]:
        store, top = at(self.path)
        with store.open_input_file(f"{top}/{part.file}") as f:
            place = part.low
            while place < part.high:
                f.seek(place)
                source = Member(f, place) if f.read(2) == b"\x1f\x8b" else Plain(f, place, part.high)
                while (fields := source.header()) is not None:
                    row = {COLUMNS[k]: v for k, v in fields.items() if k in COLUMNS}
                    good = all(row.get(col) in values for col, values in self.wanted)
                    length = int(fields.get("content-length", 0))
                    payload = None
                    if good and self.payload:
                        payload = source.take(length)
                    if good:
                        yield (*(row.get(c) if c != "payload_length" else int(row[c]) if c in row else length for c in HEADERS), payload)
                    if source.whole:
                        break  # the rest of the member is skipped unread
                    source.skip(0 if payload is not None else length)
                place = source.stop()


class Stream:
    """Records one after the other in a stream of bytes."""

    whole: int | None = None

    def __init__(self, f, place: int):
        self.f, self.place, self.held = f, place, b""

    def more(self) -> bytes:
        """The next bytes; none at the end."""
        raise NotImplementedError

    def header(self) -> dict[str, str] | None:
        """Fields of the next record, None if there is none."""
        self.held = self.held.lstrip(b"\r\n")
        while b"\r\n\r\n" not in self.held:
            got = self.more()
            if not got:
                if self.held.strip():
                    raise ValueError(f"broken record in the member at {self.place}")
                return None
            self.held = (self.held + got).lstrip(b"\r\n")
        head, _, self.held = self.held.partition(b"\r\n\r\n")
        fields: dict[str, str] = {}
        for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        return fields

    def take(self, length: int) -> bytes:
        parts, n = [self.held], len(self.held)
        while n < length and (got := self.more()):
            parts.append(got)
            n += len(got)
        if n < length:
            raise ValueError(f"record in the member at {self.place} ends early")
        whole = b"".join(parts)
        self.held = whole[length:]
        return whole[:length]

    def skip(self, length: int) -> None:
        while length > len(self.held):
            length -= len(self.held)
            self.held = self.more()
            if not self.held:
                return
        self.held = self.held[length:]


class Member(Stream):
    """A gzip member, inflated as it is asked for; ``whole`` is its length if its header says so."""

    def __init__(self, f, place: int):
        super().__init__(f, place)
        f.seek(place)
        self.raw = f.read(HEAD)
        flags, body = self.raw[3], 10
        if flags & 4:
            extra = struct.unpack_from("<H", self.raw, body)[0]
            low, stop = body + 2, body + 2 + extra
            while low + 4 <= stop:
                size = struct.unpack_from("<H", self.raw, low + 2)[0]
                if self.raw[low : low + 2] == b"sl" and size == 8:
                    self.whole = struct.unpack_from("<I", self.raw, low + 4)[0]
                low += 4 + size
            body = stop
        for flag in (8, 16):  # a file name, a comment
            if flags & flag:
                body = self.raw.index(b"\0", body) + 1
        body += 2 * bool(flags & 2)
        self.z, self.raw = zlib.decompressobj(-15), self.raw[body:]
        self.first = True

    def more(self) -> bytes:
        """At first only what holds a header."""
        out, most = b"", 4096 if self.first else 1 << 20
        while not out and not self.z.eof:
            if not self.raw:
                self.raw = self.f.read(HEAD if self.first else 1 << 20)
                if not self.raw:
                    raise ValueError(f"the member at {self.place} ends early")
            out = self.z.decompress(self.raw, most)
            self.raw = self.z.unconsumed_tail
        self.first = False
        return out

    def stop(self) -> int:
        if self.whole:
            return self.place + self.whole
        while not self.z.eof:
            self.more()
        return self.f.tell() - len(self.z.unused_data) + 8


class Plain(Stream):
    """Records without compression, up to ``high``; blocks that are not wanted are not read."""

    def __init__(self, f, place: int, high: int):
        super().__init__(f, place)
        f.seek(place)
        self.high = high

    def more(self) -> bytes:
        return self.f.read(max(0, min(HEAD, self.high - self.f.tell())))

    def skip(self, length: int) -> None:
        if length > len(self.held):
            self.f.seek(min(self.high, self.f.tell() + length - len(self.held)))
            self.held = b""
        else:
            self.held = self.held[length:]

    def stop(self) -> int:
        return self.high


def batch(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64() if c == "payload_length" else pa.binary() if c == "payload" else pa.string() for c in names]
    return pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*rows), kinds)], names=names)


class WarcSource(DataSource):
    """``spark.read.format("warc").option("path", folder)``; ``payload=false`` reads headers only."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def records(pages: DataFrame, least: int = 100) -> DataFrame:
    """One record a page (columns page_id, url, html); equal payloads of ``least`` bytes or more become revisits.

    Every row whose page_id is the smallest of its payload is a response, so repeated rows of it are too."""
    raw = F.coalesce("html", F.lit("")).cast("binary")
    own = pages.select("page_id", F.col("url").alias("target_uri"), F.sha2(raw, 256).alias("digest"), F.length(raw).cast("long").alias("payload_length"), raw.alias("payload"))
    # only payloads that stand more than once, as a table of its own: a join with it can split a very common page
    same = own.where(F.col("payload_length") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    first = pin(same.where("n > 1").select("digest", "first"), "repeated")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return own.join(first.hint("merge"), "digest", "left").select(
        F.col("page_id").cast("string").alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.when(again, F.col("first").cast("string")).alias("refers_to"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        "payload_length",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def write_archive(found: DataFrame, path: str) -> None:
    register(found.sparkSession)
    found.write.format("warc").option("path", path).mode("append").save()


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the archives, then describe each record from what the archives hold.

    Responses are read with their payloads, whose length and digest are made anew; revisits by their headers alone."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archive(records(pages), path)
    full = read_archive(spark, path).where("record_type = 'response'")
    full = full.withColumn("payload_length", F.length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    heads = read_archive(spark, path, payload=False).where("record_type = 'revisit'").withColumn("payload_digest", F.substring_index("payload_digest", ":", -1))
    return full.unionByName(heads).select(
        F.col("record_id").cast("long").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )
