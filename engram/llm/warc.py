"""WARC archives as a Python data source: spark.read.format("warc") and df.write.format("warc").

A record is a gzip member of its own. Its extra field "sl" holds the member's length, so that a reader that doesn't want
a payload goes on to the next record after the headers without inflating the rest. Files without it, and plain ones, are read too.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from engram.llm.shared import shared_dir

#: Columns that come from a header of their own. All headers are in the map headers, by lower-case name.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", payload_bytes bigint, headers map<string,string>, payload binary"
#: Lists of the files that jobs have committed.
COMMITTED = re.compile(r"_committed(-[0-9a-f]+)?\.json$")
#: The profile of a revisit whose payload is that of another record, and the headers that hold numbers of pages.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE, FIRST_PAGE = "x-page-id", "x-refers-to-page-id"
CHUNK = 1 << 16


def member(data: bytes) -> bytes:
    """A gzip member with its own length in the extra field."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    whole = 10 + 2 + 4 + 8 + len(body) + 8
    extra = b"sl" + struct.pack("<HQ", 8, whole)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + tail


def record(headers: dict[str, str], payload: bytes) -> bytes:
    clean = lambda v: str(v).replace("\r", "%0D").replace("\n", "%0A")
    lines = "".join(f"{k}: {clean(v)}\r\n" for k, v in headers.items() if v is not None)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"


class _Source:
    """A file read forward through a small buffer."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.buffer = file, b""

    def fill(self, n: int) -> bool:
        while len(self.buffer) < n and (more := self.file.read(max(CHUNK, n - len(self.buffer)))):
            self.buffer += more
        return len(self.buffer) >= n

    def take(self, n: int) -> bytes:
        self.fill(n)
        got, self.buffer = self.buffer[:n], self.buffer[n:]
        return got

    def skip(self, n: int) -> None:
        inside = min(n, len(self.buffer))
        self.buffer = self.buffer[inside:]
        if n > inside:
            self.file.seek(self.file.tell() + n - inside)


class _Inflated:
    """The bytes of one gzip member, as far as asked for."""

    def __init__(self, source: _Source):
        self.source, self.zip, self.buffer, self.read = source, zlib.decompressobj(31), b"", 0

    def fill(self, n: int) -> bool:
        while len(self.buffer) < n and not self.zip.eof:
            if not self.source.buffer and not self.source.fill(1):
                break
            data, self.source.buffer = self.source.buffer, b""
            self.buffer += self.zip.decompress(data, max(CHUNK, n - len(self.buffer)))
            self.source.buffer = self.zip.unused_data or self.zip.unconsumed_tail
            self.read += len(data) - len(self.source.buffer)
        return len(self.buffer) >= n

    def take(self, n: int) -> bytes:
        self.fill(n)
        got, self.buffer = self.buffer[:n], self.buffer[n:]
        return got

    def close(self, length: int | None) -> None:
        """To the next member: at once if its length is known."""
        if length is not None and not self.zip.eof:
            self.source.skip(length - self.read)
            return
        while not self.zip.eof and (self.source.buffer or self.source.fill(1)):
            self.fill(len(self.buffer) + CHUNK)
            self.buffer = b""


def _head(reader) -> dict[str, str] | None:
    n = 512
    while (end := reader.buffer.find(b"\r\n\r\n")) < 0:
        if not reader.fill(n):
            end = reader.buffer.find(b"\r\n\r\n")
            break
        n = 2 * len(reader.buffer)
    if end < 0:
        return None
    lines = reader.take(end + 4).decode("utf-8", "replace").strip().split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def records(file: pa.NativeFile, wanted, payloads: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, payload) of the records whose headers are wanted. Only those payloads are inflated, and only with payloads."""
    source = _Source(file)
    while True:
        while source.fill(2) and source.buffer[:2] in (b"\r\n", b"\n\n"):
            source.take(2)
        if not source.fill(4):
            return
        if source.buffer[:2] == b"\x1f\x8b":
            length = None
            if source.buffer[3] & 4 and source.fill(24) and source.buffer[12:14] == b"sl":
                length = struct.unpack("<Q", source.buffer[16:24])[0]
            one = _Inflated(source)
            if (head := _head(one)) is None:
                return
            keep = wanted(head)
            body = one.take(int(head.get("content-length", 0))) if keep and payloads else None
            one.close(length)
        else:
            if (head := _head(source)) is None:
                return
            keep, n = wanted(head), int(head.get("content-length", 0))
            body = source.take(n) if keep and payloads else source.skip(n)
        if keep:
            yield head, body


@dataclass
class WarcFile(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.payloads, self.where = options["path"], options.get("payloads", "true") == "true", []

    def pushFilters(self, filters: list[Filter]):
        """Equality and IN on columns that are headers, or on headers[name], are judged before a payload is touched.

        A null among the values fits no record, and a record without the header fits no value, as in SQL.
        """
        for f in filters:
            header = HEADERS.get(f.attribute[0]) if len(f.attribute) == 1 else f.attribute[1] if f.attribute[0] == "headers" else None
            if header and isinstance(f, (EqualTo, In)):
                values = [f.value] if isinstance(f, EqualTo) else f.value
                self.where.append((header, {v for v in values if v is not None}))
            else:
                yield f

    def partitions(self) -> list[WarcFile]:
        fs, path = pafs.FileSystem.from_uri(self.path)
        if fs.get_file_info(path).type == pafs.FileType.File:
            return [WarcFile(path)]
        found = fs.get_file_info(pafs.FileSelector(path))
        lists = sorted(x.path for x in found if COMMITTED.match(x.base_name))
        if lists:
            return [WarcFile(f"{path}/{x}") for name in lists for x in json.loads(fs.open_input_stream(name).readall())] or [WarcFile("")]
        return [WarcFile(x.path) for x in sorted(found, key=lambda x: -x.size) if x.path.endswith((".warc", ".warc.gz"))] or [WarcFile("")]

    def read(self, partition: WarcFile):
        if not partition.path:
            return
        fs, _ = pafs.FileSystem.from_uri(self.path)
        wanted = lambda head: all(head.get(k) in values for k, values in self.where)
        with fs.open_input_file(partition.path) as f:
            for head, body in records(f, wanted, self.payloads):
                n = head.get("warc-payload-length", head.get("content-length"))
                yield (*(head.get(h) for h in HEADERS.values()), int(n) if n else None, head, body)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Files get unique names and count from the moment the driver commits the list of those of the tasks that won.

    Each job has a list of its own, so writers to one folder don't wait for or hide one another. An overwrite takes away
    the lists that were there when it began, after its own is in place, and then their files. A task that fails takes its files away.
    """

    def __init__(self, options: dict[str, str], overwrite: bool = False):
        self.path, self.limit, self.before = options["path"], int(options.get("maxFileBytes", 1 << 28)), []
        if overwrite:
            fs, path = pafs.FileSystem.from_uri(self.path)
            self.before = [x.base_name for x in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if COMMITTED.match(x.base_name)]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, path = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(path)
        files, out = [], None
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None or out.tell() >= self.limit:
                        if out is not None:
                            out.close()
                        files.append(f"{uuid.uuid4().hex}.warc.gz")
                        out = fs.open_output_stream(f"{path}/{files[-1]}", compression=None)
                    headers = {"WARC-Type": row["record_type"], "WARC-Record-ID": row["record_id"], "WARC-Date": row["date"], "WARC-Target-URI": row["target_uri"], "WARC-Refers-To": row["refers_to"], "WARC-Payload-Digest": row["payload_digest"]}
                    if row["record_type"] == "revisit":
                        headers["WARC-Profile"] = PROFILE
                    if row["payload_bytes"] is not None:
                        headers["WARC-Payload-Length"] = row["payload_bytes"]
                    own = {k.lower() for k in headers} | {"content-length"}
                    headers |= {k: v for k, v in row["headers"] or [] if k.lower() not in own}
                    out.write(member(record(headers, row["payload"] or b"")))
            if out is not None:
                out.close()
        except BaseException:
            if out is not None:
                out.close()
            for x in files:
                fs.delete_file(f"{path}/{x}")
            raise
        return Written(files)

    def commit(self, messages) -> None:
        fs, path = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(path)
        name = f"_committed-{uuid.uuid4().hex}.json"
        with fs.open_output_stream(f"{path}/{name}.tmp") as f:
            f.write(json.dumps([x for m in messages if m for x in m.files]).encode())
        fs.move(f"{path}/{name}.tmp", f"{path}/{name}")
        lists = {x: json.loads(fs.open_input_stream(f"{path}/{x}").readall()) for x in self.before}
        for x in lists:
            fs.delete_file(f"{path}/{x}")
        for x in [x for files in lists.values() for x in files]:
            fs.delete_file(f"{path}/{x}")

    def abort(self, messages) -> None:
        fs, path = pafs.FileSystem.from_uri(self.path)
        for x in [x for m in messages if m for x in m.files]:
            fs.delete_file(f"{path}/{x}")


class WarcDataSource(DataSource):
    """Options: path, a URI that pyarrow opens; payloads "false" to leave payloads null; maxFileBytes of written files."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payloads", str(payloads).lower()).load(path)


def archive_pages(pages: DataFrame, path: str | None = None, date: str = "2024-01-01T00:00:00Z", min_payload: int = 100, salts: int = 16) -> str:
    """Writes a record for each row of pages (page_id, url, html) and returns the folder.

    Of pages with equal payloads of min_payload bytes or more, the one with the smallest id is a response, the others
    are revisits, which have no payload and refer to it. Smaller ones are all responses. Null html: an empty payload.
    Null url: no target. A null id refers to others but isn't referred to. Rows with the smallest id repeated are all
    responses, and the revisits refer to the one with the smallest url. Empty table: an archive without records.

    Record ids are UUIDs: of a response that others refer to made of its id, url and digest, so that revisits in other tasks
    know it (only rows repeated in all three share it), else random. The pages' numbers are in headers of their own.

    Equal payloads are found by SHA-256, over ids and digests summed before the shuffle; the join deals each digest out to
    as many tasks as salts, so a payload of a third of the pages is in many. Payloads are shuffled once, with that join:
    to leave them where they are, each task would need the repeated digests, and no bound is known for those.
    """
    spark = pages.sparkSession
    path = path or shared_dir(spark, "warc")
    register(spark)
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("n", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    firsts = rows.where(F.col("n") >= min_payload).groupBy("digest").agg(first.alias("first"), F.count("*").alias("same")).where("same > 1").drop("same")
    firsts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(firsts, ["digest", "salt"], "left")
    known = F.col("first.page_id").isNotNull()
    revisit = known & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    urn = lambda uuid: F.concat(F.lit("<urn:uuid:"), uuid, F.lit(">"))
    made = urn(F.regexp_replace(F.md5(F.to_json(F.struct("first.page_id", "first.url", "digest"))), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
    referred = known & F.col("page_id").eqNullSafe(F.col("first.page_id")) & F.col("url").eqNullSafe(F.col("first.url"))
    numbers = F.map_filter(F.create_map(F.lit(PAGE), F.col("page_id").cast("string"), F.lit(FIRST_PAGE), F.when(revisit, F.col("first.page_id").cast("string"))), lambda k, v: v.isNotNull())
    out = rows.select(
        F.when(referred, made).otherwise(urn(F.expr("uuid()"))).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"), F.lit(date).alias("date"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"), F.when(revisit, made).alias("refers_to"), F.col("n").alias("payload_bytes"),
        numbers.alias("headers"), F.when(~revisit, F.col("payload")).alias("payload"),
    )
    out.write.format("warc").mode("append").save(path)
    return path
