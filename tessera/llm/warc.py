"""A deterministic sharded WARC writer, and a reader.

Records are range-sorted by id and payload digest into shards of about equal bytes, however many these are. Their
boundaries come from a hash sample in which large records are likelier, so they don't depend on how the input is
partitioned. A task writes a shard's records one gzip member each, with headers and digests made afresh, and rolls to
the next file once the compressed size reaches a limit. A file is written under a temporary name of its own attempt
and renamed when whole, in place of one that an earlier attempt has left; attempts that repeat write the same bytes.
The manifest, renamed into place last, lists the files that count; the reader reads those. What lost attempts have
left under temporary names is deleted after that.

Of records with equal payloads of at least `min_revisit` bytes the one with the smallest id is a response and the
others are revisits of it, with the full payload's size and digest in their headers.

Edge cases: a null payload is empty; a null URL has no target header; null ids sort last, and of equal ids the first
row is the response; repeated rows are written each; an empty table gives an empty archive and manifest.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import discard, new_path, running_sum, store, tidy

SHARD_BYTES = 64 << 20
"""Payload bytes a shard aims at."""
ROLL_BYTES = 16 << 20
"""Compressed bytes after which a file ends."""
SAMPLE = 16
"""Sampled records a shard, about; one boundary of them reaches the driver and each task (24 bytes a shard)."""
MAX_TASKS = 100_000
"""Tasks that write; of more shards, neighbours share a task and are written one after another."""
UNIT = 1 << 20
DATE = "1970-01-01T00:00:00Z"
CHUNK = 1 << 20
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

MANIFEST = "file string, shard long, roll long, records long, bytes long, sha256 string"
RECORDS = "id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def open_fs(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def clean(value: str) -> str:
    """A header value without control characters, which would end the header."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, ordinal: int, date: str = DATE) -> bytes:
    """One uncompressed WARC record."""
    digest = base32_sha1(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    name = lambda i, n=0: f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{i}:{digest}:{n}')}>"
    head = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": name(page, ordinal), "WARC-Date": date,
        "WARC-Target-URI": None if url is None else clean(url), "WARC-Payload-Digest": f"sha1:{digest}", "WARC-Block-Digest": f"sha1:{base32_sha1(block)}",
        "WARC-Refers-To": name(refers_to) if revisit else None, "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None,
        "X-Page-ID": page, "X-Payload-Length": len(payload), "X-Refers-To-Page-ID": refers_to if revisit else None,
        "Content-Type": "application/http; msgtype=response", "Content-Length": len(block),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


class Roller:
    """Writes records of one shard into files that end once they reach the roll size."""

    def __init__(self, folder: str, roll_bytes: int):
        self.fs, self.folder = open_fs(folder)
        self.roll_bytes, self.out, self.attempt = roll_bytes, None, uuid.uuid4().hex

    def start(self, shard: int, roll: int) -> None:
        self.shard, self.roll, self.records, self.bytes, self.sha = shard, roll, 0, 0, hashlib.sha256()
        self.name = f"part-{shard:05d}-{roll:05d}.warc.gz"
        self.temporary = f"{self.folder}/_temporary.{self.name}.{self.attempt}"
        self.out = self.fs.open_output_stream(self.temporary, compression=None)

    def write(self, raw: bytes) -> None:
        member = gzip.compress(raw, 6, mtime=0)
        self.out.write(member)
        self.sha.update(member)
        self.records += 1
        self.bytes += len(member)

    def finish(self) -> tuple:
        self.out.close()
        self.out = None
        final = f"{self.folder}/{self.name}"
        if self.fs.get_file_info(final).is_file:
            self.fs.delete_file(final)
        self.fs.move(self.temporary, final)
        return (self.name, self.shard, self.roll, self.records, self.bytes, self.sha.hexdigest())

    def put(self, shard: int, raw: bytes) -> Iterator[tuple]:
        if self.out and (self.shard != shard or self.bytes >= self.roll_bytes):
            roll = self.roll + 1 if self.shard == shard else 0
            yield self.finish()
            self.start(shard, roll)
        elif not self.out:
            self.start(shard, 0)
        self.write(raw)


def _write(batches: Iterator[pa.RecordBatch], folder: str, roll_bytes: int) -> Iterator[pa.RecordBatch]:
    files, roller, ordinal, before = [], Roller(folder, roll_bytes), 0, None
    for b in tidy(batches):
        for shard, page, url, payload, digest, first, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            same = before == (page, digest)
            ordinal = ordinal + 1 if same else 0
            before = (page, digest)
            revisit = n is not None and (page != first or same)
            files += roller.put(shard, record(page, url, payload, first, revisit, ordinal))
    if roller.out:
        files.append(roller.finish())
    names = [c.split()[0] for c in MANIFEST.split(", ")]
    yield pa.record_batch([pa.array(c, pa.string() if k in ("file", "sha256") else pa.int64()) for k, c in zip_longest(names, zip(*files, strict=True), fillvalue=())], names=names)


def shard_bounds(records: DataFrame, shard_bytes: int) -> list[tuple[bool, int, int]]:
    """Ascending (id is null, id, salt) at which shards but the first begin. records: (id, salt, bytes).

    A record of b bytes is drawn with probability SAMPLE * b / shard_bytes, by its hash, and stands for shard_bytes /
    SAMPLE bytes, or for its own if these are more. Weights are whole numbers and sums exact, so reruns agree.
    """
    weight = F.greatest(F.lit(UNIT), (F.col("bytes") * SAMPLE * UNIT / shard_bytes).cast("long"))
    draw = F.pmod(F.xxhash64("id", "salt"), F.lit(UNIT)) * shard_bytes < F.col("bytes") * SAMPLE * UNIT
    drawn = records.filter(draw).groupBy("id", "salt").agg(F.sum(weight).alias("w"))
    summed = running_sum(drawn, [F.col("id").asc_nulls_last(), F.col("salt")], "w", "upto")
    shard = F.floor((F.col("upto") - F.col("w")) / (SAMPLE * UNIT))
    key = F.struct(F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).alias("id"), "salt")
    return [tuple(r["key"]) for r in summed.groupBy(shard.alias("shard")).agg(F.min(key).alias("key")).orderBy("shard").collect()][1:]


def shard_of(spark: SparkSession, bounds: list[tuple[bool, int, int]]):
    """A function of the columns id and salt: the number of bounds at or below them."""
    sent = spark.sparkContext.broadcast(bounds)

    @F.arrow_udf("long")
    def place(ids: pa.Array, salts: pa.Array) -> pa.Array:
        return pa.array([bisect_right(sent.value, (i is None, i or 0, s)) for i, s in zip(ids.to_pylist(), salts.to_pylist(), strict=True)], pa.int64())

    return place


def write_archive(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html", shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, min_revisit: int = 0) -> DataFrame:
    """Write pages into `folder`, which all executors share; returns the manifest."""
    spark = pages.sparkSession
    raw = F.coalesce(F.encode(F.col(payload), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).alias("url"), raw.alias("payload")).withColumn("digest", F.sha1("payload"))
    groups = rows.filter(F.length("payload") >= min_revisit).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    groups = store(groups, "revisits")
    salt = F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")
    bounds = shard_bounds(rows.select("id", salt.alias("salt"), F.length("payload").cast("long").alias("bytes")), shard_bytes)
    shards = len(bounds) + 1
    tasks = min(shards, MAX_TASKS)
    place = shard_of(spark, bounds) if bounds else lambda *_: F.lit(0).cast("long")
    dealt = rows.join(groups, "digest", "left").withColumn("shard", place(F.col("id"), salt)).select("shard", "id", "url", "payload", "digest", "first", "n")
    order = ("shard", F.col("id").asc_nulls_last(), "digest", F.col("url").asc_nulls_last())
    dealt = dealt.repartitionById(tasks, F.floor(F.col("shard") * tasks / shards).cast("int")).sortWithinPartitions(*order)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(f"{folder}/{p}")
    at(".").getFileSystem(conf).mkdirs(jvm.org.apache.hadoop.fs.Path(folder))
    dealt.mapInArrow(lambda it: _write(it, folder, roll_bytes), MANIFEST).write.parquet(f"{folder}/_manifest.tmp")
    if not at("_manifest").getFileSystem(conf).rename(at("_manifest.tmp"), at("_manifest")):
        raise OSError(f"can't commit {folder}")
    for left in at(".").getFileSystem(conf).globStatus(at("_temporary.*")) or ():
        left.getPath().getFileSystem(conf).delete(left.getPath(), False)
    discard(groups)
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def members(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The uncompressed members of a gzip file."""
    z, parts = zlib.decompressobj(31), []
    for chunk in chunks:
        while chunk:
            parts.append(z.decompress(chunk))
            chunk = z.unused_data
            if z.eof:
                yield b"".join(parts)
                z, parts = zlib.decompressobj(31), []
            elif chunk:
                raise ValueError("a gzip member is damaged")
    if any(parts):
        raise ValueError("a gzip member is cut short")


def parse(raw: bytes) -> tuple:
    """(id, url, payload bytes, payload digest, record type, refers to, payload or None) of a record; checks its digests."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError(f"a record is damaged: {fields.get('WARC-Record-ID')}")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else None
    if payload is not None and (base32_sha1(payload) != digest or len(payload) != int(fields["X-Payload-Length"])):
        raise ValueError(f"a payload is damaged: {fields['WARC-Record-ID']}")
    number = lambda k: int(fields[k]) if k in fields else None
    return (number("X-Page-ID"), fields.get("WARC-Target-URI"), number("X-Payload-Length"), digest, fields["WARC-Type"], number("X-Refers-To-Page-ID"), payload)


def _read(batches: Iterator[pa.RecordBatch], folder: str, payloads: bool) -> Iterator[pa.RecordBatch]:
    fs, base = open_fs(folder)
    kinds = {"id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
    kinds = kinds if payloads else {k: v for k, v in kinds.items() if k != "payload"}

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, v) for v, c in zip(kinds.values(), zip(*rows, strict=True))], names=list(kinds))

    for b in batches:
        for name, records in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            rows, n, held = [], 0, 0
            with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                for raw in members(iter(lambda f=f: f.read(CHUNK), b"")):
                    rows.append(parse(raw)[: len(kinds)])
                    n, held = n + 1, held + len(raw)
                    if held > CHUNK * 16:
                        yield batch(rows)
                        rows, held = [], 0
            if n != records:
                raise ValueError(f"{name} has {n} records, its manifest {records}")
            if rows:
                yield batch(rows)


def read_archive(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """The records of an archive's files, by its manifest. payload is null for revisits."""
    files = manifest(spark, folder).select("file", "records")
    n = max(1, min(files.count(), 10_000))
    return files.repartition(n, "file").mapInArrow(lambda it: _read(it, folder, payloads), RECORDS + ", payload binary" * payloads)


def op6_sharded_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archive(spark, folder).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
