"""WARC archives by a deterministic sharded writer.

Records are sorted by (page_id, url, payload digest) and dealt by ranges of that key into shards. Where a shard begins depends on the sizes of all
records before it in key order, not on how the table happens to be split: sizes are summed range by range, ranges are shifted by those
before, and the first key of each shard comes to the driver (at most `MOST_SHARDS` keys). A shard is written by one task that streams over its
sorted rows, one gzip member a record, and begins a new file once the current one has `roll_bytes` compressed bytes. So the same
pages give the same files, byte for byte, on any number of executors and however often a task is tried again.

Equal payloads of at least `LEAST_PAYLOAD` bytes are stored once: the record of the smallest key holds the payload, the others are revisits that
name it. Keys alone are compared for that; what a shard's task is told about its revisits travels to it as rows of their own, sorted in
front of the records that they are about, so payloads move once, by range, and a payload that a third of all pages share makes no task
larger.

A file is written under a temporary name and renamed when it is whole; a second attempt finds it there or makes the same file. The manifest, a table
with a row for each file, is written by Spark in the same job and renamed last: that is the commit. Readers know files from the manifest only.

Archives are WARC 1.1: `warcinfo`, `response` and `revisit` records with regenerated headers, block and payload digests (SHA-256), and
WARC-Page-ID and WARC-Refers-To-Page-ID beside the standard fields. Executors write by pyarrow's file systems (local or mounted paths, S3,
GCS, HDFS with its client library).

Defined cases: null html is an empty payload; a null url has no WARC-Target-URI; control characters and spaces in a url are percent-encoded; rows
without page_id come last and have no WARC-Page-ID; of rows that agree in page_id, url and payload, the first is as its payload's role
says and the others revisit it; an empty table gives a manifest without files; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.session import cut, release

LEAST_PAYLOAD = 100
#: Bytes of records a shard has at least, and how many shards there are at most, so that their first keys fit the driver.
SHARD_BYTES = 1 << 25
MOST_SHARDS = 16_384
#: Compressed bytes after which a file is closed.
ROLL_BYTES = 1 << 27
#: Bytes a record's headers count beside its payload.
HEADER_BYTES = 700
LEVEL = 4
DATE = "1970-01-01T00:00:00Z"
#: Payload bytes a reader's batch holds, and bytes it takes from a file at once.
BATCH_BYTES = 1 << 23
CHUNK = 1 << 20

# Names of the WARC 1.1 format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "file string, shard int, roll int, records long, responses long, bytes long, sha256 string"
RECORDS = "file string, record_offset long, record_type string, record_id string, page_id string, url string, date string, payload_digest string, payload_bytes long, refers_to_id string, refers_to string, fault string"


def located(folder: str) -> tuple[arrow_fs.FileSystem, str]:
    """pyarrow's file system and path of a folder's URI or absolute path."""
    return arrow_fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


def record_id(*parts: object) -> str:
    """The same id for the same parts."""
    return uuid.UUID(bytes=hashlib.sha256("\0".join(map(repr, parts)).encode()).digest()[:16]).urn


def plain_uri(url: str) -> str:
    return "".join([c if c > " " and c != "\x7f" else quote(c) for c in url])


def packed(fields: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    """A record as a gzip member."""
    head = [VERSION, *[f"{name}: {value}" for name, value in fields], f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}", "", ""]
    press = zlib.compressobj(level, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(head).encode()) + press.compress(block) + press.compress(b"\r\n\r\n") + press.flush()


def page_record(page_id: object, url: str | None, digest: str, payload: bytes, nth: int, first: tuple | None, *, date: str, level: int) -> bytes:
    """The record of a page; `first` is (page_id, url) of the record that holds the payload, if that is another."""
    fields = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", f"<{record_id(page_id, url, digest, nth)}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", plain_uri(url)))
    if page_id is not None:
        fields.append(("WARC-Page-ID", quote(str(page_id))))
    fields.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if first is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{record_id(*first, digest, 0)}>")]
        if first[1] is not None:
            fields.append(("WARC-Refers-To-Target-URI", plain_uri(first[1])))
        if first[0] is not None:
            fields.append(("WARC-Refers-To-Page-ID", quote(str(first[0]))))
    fields.append(("Content-Type", "application/http; msgtype=response"))
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return packed(fields, head + payload if first is None else head, level)


class Roll:
    """One archive file, under a temporary name until it is whole."""

    def __init__(self, folder: str, shard: int, roll: int, *, date: str, level: int):
        self.fs, self.base = located(folder)
        self.shard, self.roll = shard, roll
        self.name = f"part-{shard:05d}-{roll:05d}.warc.gz"
        self.beside = f"{self.base}/_temporary/{self.name}.{uuid.uuid4().hex}"
        self.stream = self.fs.open_output_stream(self.beside)
        self.size, self.records, self.responses, self.sum = 0, 0, 0, hashlib.sha256()
        fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{record_id('file', self.name)}>"), ("WARC-Date", date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")]
        self.put(packed(fields, b"software: tidemill\r\nformat: WARC File Format 1.1\r\n", level))

    def put(self, member: bytes) -> None:
        self.stream.write(member)
        self.sum.update(member)
        self.size += len(member)

    def close(self) -> tuple:
        self.stream.close()
        target = f"{self.base}/{self.name}"
        if self.fs.get_file_info(target).type == arrow_fs.FileType.NotFound:
            self.fs.move(self.beside, target)
        else:  # another attempt was first, with the same bytes
            self.fs.delete_file(self.beside)
        return self.name, self.shard, self.roll, self.records, self.responses, self.size, self.sum.hexdigest()


def key_columns() -> list[Column]:
    """The order of records: rows without page_id last, without url before others of their page."""
    return [F.col("page_id").asc_nulls_last(), F.col("url").asc_nulls_first(), F.col("digest").asc()]


def first_of(condition: Column | None = None) -> Column:
    """The least key of a group, as page_id and url."""
    return F.min(F.struct(F.col("page_id").isNull().alias("a"), F.col("page_id"), F.col("url").isNotNull().alias("b"), F.col("url")))


def revisits(keys: DataFrame, least: int) -> DataFrame:
    """page_id, url, digest of records whose payload another record holds, and to_id, to_url of that."""
    own = keys.filter(F.col("n") >= least)
    shared = own.groupBy("digest").agg(first_of().alias("first"), F.count("*").alias("times")).filter("times > 1").select("digest", "first")
    other = ~(F.col("page_id").eqNullSafe(F.col("first.page_id")) & F.col("url").eqNullSafe(F.col("first.url")))
    return own.join(shared, "digest").filter(other).select("page_id", "url", "digest", F.col("first.page_id").alias("to_id"), F.col("first.url").alias("to_url")).distinct()


def shard_starts(keys: DataFrame, shard_bytes: int, most_shards: int) -> list[tuple]:
    """The least keys of the shards after the first, by the sizes of all records before. `keys` come dealt by ranges (_pid)."""
    weight = F.col("n") + HEADER_BYTES
    ranges = keys.groupBy("_pid").agg(F.sum(weight).alias("bytes"))
    total = ranges.agg(F.sum("bytes")).first()[0] or 0
    wanted = max(shard_bytes, -(-total // most_shards))
    shifts = ranges.select("_pid", F.coalesce(F.sum("bytes").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("_pid").orderBy(*key_columns()).rowsBetween(Window.unboundedPreceding, -1)
    placed = keys.join(F.broadcast(shifts), "_pid").withColumn("at", F.col("before") + F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    least = F.min(F.struct(F.col("page_id").isNull().alias("a"), "page_id", F.col("url").isNotNull().alias("b"), "url", "digest"))
    starts = placed.groupBy(F.floor(F.col("at") / wanted).alias("shard")).agg(least.alias("key")).orderBy("shard")
    return [tuple(r["key"]) for r in starts.collect()][1:]


def shard_of(starts: list[tuple]) -> Callable[[DataFrame], DataFrame]:
    """Adds the shard of each row."""

    def numbered(ids: pa.Array, urls: pa.Array, digests: pa.Array) -> pa.Array:
        keys = zip(ids.to_pylist(), urls.to_pylist(), digests.to_pylist(), strict=True)
        return pa.array([bisect.bisect_right(starts, (i is None, i, u is not None, u, d)) for i, u, d in keys], pa.int32())

    numbered.__annotations__ = {"ids": pa.Array, "urls": pa.Array, "digests": pa.Array, "return": pa.Array}
    own = F.arrow_udf(numbered, "int")
    return lambda rows: rows.withColumn("shard", own("page_id", "url", "digest") if starts else F.lit(0))


def write_archives(pages: DataFrame, folder: str, *, least: int = LEAST_PAYLOAD, shard_bytes: int = SHARD_BYTES, most_shards: int = MOST_SHARDS, roll_bytes: int = ROLL_BYTES, level: int = LEVEL, date: str = DATE) -> DataFrame:
    """Writes `pages` (page_id, url, html) as WARC files into `folder`, which must have no manifest yet; returns the manifest."""
    spark = pages.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(target):
        raise FileExistsError(f"{folder} has a manifest already")
    files.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{folder}/_temporary"))
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    own = pages.select("page_id", F.col("url").cast("string").alias("url"), payload).withColumn("digest", F.sha2("html", 256))
    # the sample for the ranges takes page_id and url alone
    keys = own.select("page_id", "url", "digest", F.octet_length("html").cast("long").alias("n")).repartitionByRange(*key_columns()[:2])
    keys = cut(keys.withColumn("_pid", F.spark_partition_id()), "warc-keys")
    starts = shard_starts(keys, shard_bytes, most_shards)
    told = revisits(keys, least).select("page_id", "url", "digest", F.lit(0).alias("kind"), "to_id", "to_url", F.lit(None).cast("string").alias("html"))
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = own.select("page_id", "url", "digest", F.lit(1).alias("kind"), F.lit(None).cast(kind).alias("to_id"), F.lit(None).cast("string").alias("to_url"), "html")
    dealt = shard_of(starts)(rows.unionByName(told)).repartition(len(starts) + 1, "shard").sortWithinPartitions("shard", *key_columns(), "kind")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last, role, nth = None, None, None, 0
        done = []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            bodies = batch.column(6).cast(pa.large_binary() if pa.types.is_large_string(batch.column(6).type) else pa.binary())
            for k, (shard, page_id, url, digest, told_row, first) in enumerate(zip(*columns[:5], columns[5], strict=True)):
                key = (shard, page_id, url, digest)
                if key != last:
                    last, role, nth = key, None, 0
                if told_row == 0:
                    role = (first["to_id"], first["to_url"])
                    continue
                body = bodies[k].as_py()
                if current and current.shard != shard:
                    done.append(current.close())
                    current = None
                if current and current.size >= roll_bytes:
                    done.append(current.close())
                    current = Roll(folder, shard, current.roll + 1, date=date, level=level)
                current = current or Roll(folder, shard, 0, date=date, level=level)
                holder = role or ((page_id, url) if nth and len(body) >= least else None)
                current.put(page_record(page_id, url, digest, body, nth, holder, date=date, level=level))
                current.records += 1
                current.responses += holder is None
                nth += 1
        if current:
            done.append(current.close())
        columns = list(zip(*done, strict=True)) or [[]] * 7
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["file", "shard", "roll", "records", "responses", "bytes", "sha256"])

    sent = dealt.select("shard", "page_id", "url", "digest", "kind", F.struct("to_id", "to_url").alias("to"), "html")
    beside = f"{folder}/_temporary/manifest-{uuid.uuid4().hex}"
    sent.mapInArrow(written, MANIFEST).write.parquet(beside)
    if not files.rename(jvm.org.apache.hadoop.fs.Path(beside), target):
        raise FileExistsError(f"{folder} was given a manifest by another writer")
    files.delete(jvm.org.apache.hadoop.fs.Path(f"{folder}/_temporary"), True)
    release(keys)
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


class Source:
    """The records of an archive file, one after the other: (offset, header fields, block)."""

    def __init__(self, stream: io.RawIOBase):
        self.stream, self.waiting, self.at, self.begins = stream, b"", 0, 0

    def members(self) -> Iterator[tuple[int, bytes]]:
        while True:
            press, parts, begins = zlib.decompressobj(31), [], self.at
            while not press.eof:
                data = self.waiting or self.stream.read(CHUNK)
                if not data:
                    if parts:
                        raise ValueError(f"the record at byte {begins} is cut off")
                    return
                parts.append(press.decompress(data))
                self.waiting = press.unused_data
                self.at += len(data) - len(self.waiting)
            yield begins, b"".join(parts)

    def records(self) -> Iterator[tuple[int, dict[str, str], bytes]]:
        for begins, raw in self.members():
            end = raw.index(b"\r\n\r\n")
            lines = raw[:end].decode().split("\r\n")
            if lines[0] != VERSION:
                raise ValueError(f"no {VERSION} record at byte {begins}")
            fields = dict(line.split(": ", 1) for line in lines[1:])
            yield begins, fields, raw[end + 4 : end + 4 + int(fields["Content-Length"])]


def described(name: str, begins: int, fields: dict[str, str], block: bytes) -> tuple:
    """A record's row and its payload; `fault` says what of it isn't as its headers say."""
    head, _, payload = block.partition(b"\r\n\r\n")
    stored = fields["WARC-Type"] == "response"
    told = int(re.search(rb"(?im)^content-length: *(\d+)", head)[1])
    digest = hashlib.sha256(payload).hexdigest() if stored else fields["WARC-Payload-Digest"].removeprefix("sha256:")
    fault = None
    if "sha256:" + hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"]:
        fault = "block digest"
    elif "sha256:" + digest != fields["WARC-Payload-Digest"]:
        fault = "payload digest"
    elif stored and len(payload) != told:
        fault = "payload length"
    ids = [unquote(fields[f]) if f in fields else None for f in ("WARC-Page-ID", "WARC-Refers-To-Page-ID")]
    return (name, begins, fields["WARC-Type"], fields["WARC-Record-ID"].strip("<>"), ids[0], fields.get("WARC-Target-URI"), fields["WARC-Date"], digest, len(payload) if stored else told, fields.get("WARC-Refers-To", "").strip("<>") or None, ids[1], fault), payload if stored else None


def read_archives(spark: SparkSession, folder: str, *, with_payload: bool = False) -> DataFrame:
    """The response and revisit records of the files in the manifest, checked against their digests; `payload` is null for revisits."""
    manifest = read_manifest(spark, folder)
    names = [part.split(" ")[0] for part in RECORDS.split(", ")] + ["payload"] * with_payload
    kinds = [pa.int64() if " long" in part else pa.string() for part in RECORDS.split(", ")] + [pa.binary()] * with_payload

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for name in batch.column(0).to_pylist():
                files, base = located(folder)
                rows, held = [], 0
                with files.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for begins, fields, block in Source(stream).records():
                        if fields["WARC-Type"] not in ("response", "revisit"):
                            continue
                        row, payload = described(name, begins, fields, block)
                        rows.append((*row, payload)[: len(kinds)])
                        held += 400 + len(payload or b"") * with_payload
                        if held >= BATCH_BYTES:
                            yield batch_of(rows)
                            rows, held = [], 0
                yield batch_of(rows)

    # a task for each file, as far as the number of cores goes on
    tasks = max(1, manifest.count())
    return manifest.select("file").repartition(tasks, "file").mapInArrow(read, RECORDS + ", payload binary" * with_payload)


def resolved(records: DataFrame) -> DataFrame:
    """`records`, read with payloads, whose revisits have the payload of the record that they name."""
    held = records.filter("record_type = 'response'").select(F.col("record_id").alias("_id"), F.col("payload").alias("_payload"))
    named = records.join(held, F.col("refers_to_id") == F.col("_id"), "left")
    return named.withColumn("payload", F.coalesce("payload", "_payload")).drop("_id", "_payload")
