"""Deterministic sharded WARC writer and its reader.

Writing: records are range-partitioned and sorted by (key, url, digest) with bounds drawn from a hash sample of the
keys, so the same table gives the same shards whatever its partitioning. Each task writes its range as gzip members and
rolls to a new file when the compressed size is reached. Files are written under temporary names and renamed to their
final ones, which a repeated task replaces by the same bytes; the list of files is a manifest, written aside and renamed
last. A reader follows the manifest alone, so files of a failed run are never seen.

Headers (ids, lengths, digests) are made anew from the payload, and the reader checks the payload against them. Equal
payloads are stored once: the record with the smallest key is the response, the others revisit it.

Defined cases: a null payload is empty, and empty payloads are equal payloads; a null key sorts first, is written as an
empty header and read back as null, and is the response only where no other record has that payload; a null url is
written as an empty target; repeated rows become records of their own, one of which is the response; an empty table
gives an archive without files; other columns are ignored; a payload larger than a file gets a file of its own.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skuflow.session import materialize

#: Record layout of WARC 1.1 and the profile of revisit records.
VERSION = "WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SAMPLE = 20
SHARD_BYTES = 16 << 20
MANIFEST = "manifest.parquet"
_FILES = "file string, shard int, part int, records long, bytes long, sha1 string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(key: int | None, url: str, payload: bytes, digest: str, refers: int | None, is_revisit: bool, date: str, copy: int) -> bytes:
    """One record with regenerated headers; a revisit carries the length of its payload but not the payload."""
    body = b"" if is_revisit else payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{key}\n{url}\n{digest}\n{copy}")
    lines = [
        VERSION,
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(body)}",
        f"X-Record-Key: {'' if key is None else key}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if is_revisit:
        lines += [f"WARC-Profile: {REVISIT}", f"X-Refers-To-Key: {'' if refers is None else refers}"]
    lines += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder named as for Spark; tasks use it, so it must be shared."""
    if folder.startswith("file:") and not folder.startswith("file://"):
        folder = folder.replace("file:", "file://", 1)
    return fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)


class _Roller:
    """Files of one shard: opened under a temporary name, renamed when full."""

    def __init__(self, folder: str, shard: int, limit: int):
        self.files, self.root = open_folder(folder)
        self.shard, self.limit, self.part, self.done = shard, limit, 0, []
        self.data, self.records = io.BytesIO(), 0

    def add(self, member: bytes) -> None:
        if self.records and self.data.tell() + len(member) > self.limit:
            self.close()
        self.data.write(member)
        self.records += 1

    def close(self) -> None:
        if not self.records:
            return
        body = self.data.getvalue()
        name = f"part-{self.shard:06d}-{self.part:06d}.warc.gz"
        temporary = f"{self.root}/.{name}.{uuid.uuid4().hex}.tmp"
        with self.files.open_output_stream(temporary, compression=None) as out:
            out.write(body)
        self.files.move(temporary, f"{self.root}/{name}")
        self.done.append((name, self.shard, self.part, self.records, len(body), hashlib.sha1(body).hexdigest()))
        self.data, self.records, self.part = io.BytesIO(), 0, self.part + 1


def _write(folder: str, limit: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, last, copy = None, None, 0
        done: list[tuple] = []
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("shard", "key", "url", "hex", "front", "n", "first")), strict=True)
            payloads = batch.column("payload")
            for i, (shard, key, url, hexed, front, n, first) in enumerate(rows):
                if roller is None or roller.shard != shard:
                    if roller is not None:
                        roller.close()
                        done += roller.done
                    roller = _Roller(folder, shard, limit)
                copy = copy + 1 if (key, url, hexed) == last else 0
                last = (key, url, hexed)
                payload = payloads[i].as_py().encode()
                digest = base64.b32encode(bytes.fromhex(hexed)).decode()
                target = "".join(c for c in url or "" if c >= " ")  # a header is one line
                is_revisit = n is not None and not (front and copy == 0)
                roller.add(gzip.compress(record(key, target, payload, digest, first, is_revisit, date, copy), 6, mtime=0))
        if roller is not None:
            roller.close()
            done += roller.done
        if done:
            names = ("file", "shard", "part", "records", "bytes", "sha1")
            types = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)

    return run


def _shard_of(place: Column, cuts: Column, n: int) -> Column:
    """How many of the ``n`` sorted cuts are at or below ``place``, by binary search."""
    steps = [1 << b for b in reversed(range(n.bit_length()))]

    def step(low: Column, size: Column) -> Column:
        return F.when((low + size <= n) & (F.get(cuts, low + size - 1) <= place), low + size).otherwise(low)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step) if n else F.lit(0)


def write_archive(pages: DataFrame, folder: str, shards: int | None = None, limit: int = 32 << 20, date: str = "2000-01-01T00:00:00Z", key: str = "page_id", url: str = "url", payload: str = "html") -> str:
    """Write one record per row below ``folder`` (shared, new or of an earlier run); returns the folder.

    ``shards`` is the number of ranges (default: one per SHARD_BYTES of payload, but the session's shuffle partitions at
    least). The driver sees their bounds, taken from a sample of about SAMPLE keys per range.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    rows = rows.withColumn("hex", F.sha1(F.col("payload").cast("binary")))
    keys = materialize(rows.select("key", "url", "hex", F.octet_length("payload").cast("long").alias("size")), "warc-keys")
    n, total = keys.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_BYTES))

    place = F.struct(F.coalesce("key", F.lit(-(1 << 63))).alias("k"), F.coalesce("url", F.lit("")).alias("u"), F.col("hex").alias("h"))
    every = max(1, n // (SAMPLE * shards))
    picked = keys.where(F.pmod(F.xxhash64("key", "url", "hex"), F.lit(every)) == 0).select(place.alias("p")).distinct()
    ordered = [tuple(r["p"]) for r in picked.orderBy("p").collect()]
    cuts = sorted({ordered[len(ordered) * i // shards] for i in range(1, shards)}) if ordered else []
    bounds = spark.createDataFrame([(cuts,)], "cuts array<struct<k: long, u: string, h: string>>")

    shared = keys.groupBy("hex").agg(F.count("*").alias("n"), F.min(F.struct(F.col("key").isNull().alias("none"), "key", "url")).alias("f")).where("n > 1")
    shared = materialize(shared.select("hex", "n", F.col("f.key").alias("first"), F.col("f.url").alias("first_url")), "warc-shared")
    marked = (
        rows.join(shared, "hex", "left")
        .crossJoin(F.broadcast(bounds))  # one row
        .withColumn("shard", _shard_of(place, F.col("cuts"), len(cuts)))
        .withColumn("front", F.col("key").eqNullSafe(F.col("first")) & F.col("url").eqNullSafe(F.col("first_url")))
        .select("shard", "key", "url", "hex", "payload", "n", "first", "front")
    )
    dealt = marked.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "key", "url", "hex")
    files, root = open_folder(folder)
    files.create_dir(root, recursive=True)
    aside = f"{folder}/_manifest-{uuid.uuid4().hex}"
    dealt.mapInArrow(_write(folder, limit, date), _FILES).write.parquet(aside)
    _replace(spark, aside, f"{folder}/{MANIFEST}")
    return folder


def _replace(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder; the manifest of an earlier run is taken away first, so that no mixture is ever read."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    store.delete(path(target), True)
    if not store.rename(path(source), path(target)):
        raise OSError(f"cannot rename {source} to {target}")


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record; the block digest and length are checked."""
    while first := stream.readline():
        if first.strip().decode() != VERSION:
            raise ValueError(f"not a record: {first[:40]!r}")
        headers: dict[str, str] = {}
        while line := stream.readline().decode().rstrip("\r\n"):
            name, _, value = line.partition(": ")
            headers[name] = value
        block = stream.read(int(headers["Content-Length"]))
        if headers["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}" or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"damaged record {headers.get('WARC-Record-ID')}")
        yield headers, block


def _number(text: str) -> int | None:
    return int(text) if text else None


def _read(folder: str, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = open_folder(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with files.open_input_stream(f"{root}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    rows: list[tuple] = []
                    held = 0
                    for h, block in parse(stream):
                        kind = h["WARC-Type"]
                        if kind == "response" and (h["WARC-Payload-Digest"] != h["WARC-Block-Digest"] or int(h["X-Payload-Length"]) != len(block)):
                            raise ValueError(f"payload of {h['WARC-Record-ID']} does not agree with its headers")
                        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        refers = _number(h.get("X-Refers-To-Key", ""))
                        text = block.decode() if payloads and kind == "response" else None
                        rows.append((_number(h["X-Record-Key"]), h["WARC-Target-URI"], int(h["X-Payload-Length"]), digest, kind, refers, h["WARC-Record-ID"], name, text))
                        held += len(block) if payloads else 200
                        if held > 1 << 23:
                            yield _batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows)

    return run


_RECORDS = "key long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, file string, payload string"
_TYPES = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in _RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=names)


def read_archive(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """One row per record of the files in the manifest; files are dealt to tasks by name and read as streams."""
    manifest = spark.read.schema(_FILES).parquet(f"{folder}/{MANIFEST}")
    n = manifest.count()
    return manifest.select("file").repartition(max(1, n), "file").mapInArrow(_read(folder, payloads), _RECORDS)
