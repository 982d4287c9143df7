"""Deterministic sharded WARC writer and its reader (operator 8).

Rows are dealt to shards by ranges of the page id.  The ranges come from an exact
histogram of bytes over id buckets; buckets that hold more than a shard are split again,
down to a single id, so that no outlier or cluster of ids swells a shard, and rows of one
id beyond a shard's bytes are dealt by a hash of their content, equal ones by a number too.  The same table always
gives the same shards, and no sampling or attempt number shows in a file.  Within a shard
records are sorted by id, each is its own gzip member, and a file ends when its compressed
size reaches a bound.  Headers, record ids and digests are regenerated from the rows.

A task writes under a temporary name of its own attempt and reports the file in a
manifest.  After all tasks have ended, the files named in the manifest move to their
final names (a move that is repeated finds its work done), what lost attempts left is
deleted, and a marker is written last.  Files are opened through Arrow's file systems
(local, HDFS, object stores), so the folder must be one that all executors share.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pick, written
from .simhash import shuffles_dropped

#: Parameters: bytes of payload in a shard, compressed bytes that end a file, bytes of
#: files a reading task takes at most (one file at least), payloads from how many bytes on
#: may be revisits, bits by which an id bucket is split, most groups of buckets that are
#: dealt to shards apart, most rows of the bucket table that are broadcast, equal rows of one
#: id that a task numbers at once, the records' date.
SHARD_BYTES, FILE_BYTES, READ_BYTES, REVISIT_BYTES, SPLIT_BITS, GROUPS, BROADCAST_ROWS, EQUAL_AT_ONCE, DATE = 32 << 20, 8 << 20, 16 << 20, 0, 8, 256, 1_000_000, 1024, "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "shard int, seq bigint, temp string, name string, bytes bigint, records bigint, sha256 string"
_REPORT = pa.schema([("shard", pa.int32()), ("seq", pa.int64()), ("temp", pa.string()), ("name", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()), ("sha256", pa.string())])
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, order: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}:{order}')}>"


def record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers.items()), f"WARC-Block-Digest: sha1:{sha1_base32(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip header without a time: equal input, equal bytes
    return z.compress(data) + z.flush()


def page_record(page_id: int | None, url: str | None, html: str | None, refers_to: int | None, revisit: bool, date: str) -> bytes:
    payload = (html or "").encode()
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or f"urn:page:{page_id}")
    headers = {
        "WARC-Record-ID": record_id(page_id), "WARC-Date": date, "WARC-Target-URI": target,
        "WARC-Payload-Digest": f"sha1:{sha1_base32(payload)}", "Content-Type": "application/http; msgtype=response",
        "X-Page-Id": "" if page_id is None else str(page_id), "X-Payload-Length": str(len(payload)),
    }
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        return record("response", headers, http + payload)
    headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to), "X-Refers-To-Page": str(refers_to)}
    return record("revisit", headers, http)


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system and path for a Hadoop URI."""
    scheme, found, rest = uri.partition(":")
    if not found or "/" in scheme:
        return fs.FileSystem.from_uri("file://" + uri)
    if scheme == "file":
        return fs.FileSystem.from_uri("file:///" + rest.lstrip("/"))
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + rest)


class _File:
    def __init__(self, folder: str, shard: int, seq: int) -> None:
        self.name = f"part-{shard:06d}-{seq:05d}.warc.gz"
        self.temp = f"_temporary/{uuid.uuid4().hex}-{self.name}"
        self.key, self.size, self.records, self.sha = (shard, seq), 0, 0, hashlib.sha256()
        system, path = _opened(f"{folder}/{self.temp}")
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.stream = system.open_output_stream(path, compression=None)
        self.add(record("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(_SPACE, self.name)}>", "WARC-Date": DATE, "WARC-Filename": self.name, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))

    def add(self, data: bytes) -> None:
        member = _member(data)
        self.stream.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.records += 1

    def close(self) -> dict:
        self.stream.close()
        return dict(zip(("shard", "seq"), self.key)) | {"temp": self.temp, "name": self.name, "bytes": self.size, "records": self.records - 1, "sha256": self.sha.hexdigest()}


def _writer(folder: str, file_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict] = []
        out: _File | None = None
        for batch in batches:
            for shard, page_id, url, html, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                if out and (out.key[0] != shard or out.size >= file_bytes):
                    done.append(out.close())
                    seq = out.key[1] + 1 if out.key[0] == shard else 0
                    out = _File(folder, shard, seq)
                out = out or _File(folder, shard, 0)
                out.add(page_record(page_id, url, html, refers_to, revisit, date))
        if out:
            done.append(out.close())
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=_REPORT)

    return run


def _mover(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _opened(folder)
        for batch in batches:
            for x in batch.to_pylist():
                if system.get_file_info(f"{path}/{x['temp']}").type != fs.FileType.NotFound:
                    system.move(f"{path}/{x['temp']}", f"{path}/{x['name']}")
                elif system.get_file_info(f"{path}/{x['name']}").size != x["bytes"]:
                    raise OSError(f"{x['name']} is neither under its temporary nor its final name")
            yield batch

    return run


def resolved(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """``page_id, url, html, size, refers_to, revisit``: of equal payloads the largest id is the response."""
    rows = pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", F.octet_length(F.coalesce("html", F.lit(""))).cast("bigint").alias("size"), F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("sha"))
    equal = written(rows.where(F.col("size") >= least).groupBy("sha", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select(F.col("sha").alias("s"), F.col("size").alias("z"), "first"), "equal-payloads")
    revisit = F.coalesce(F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("first"))), F.lit(False))
    return rows.join(equal, (F.col("sha") == F.col("s")) & (F.col("size") == F.col("z")), "left").select("page_id", "url", "html", "size", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def _bucket(level: int, bits: int) -> Column:
    """The id's bucket at a level: its leading bits, of ``bits`` in all; ids are counted from the least one."""
    return F.shiftrightunsigned("_offset", max(0, bits - level * SPLIT_BITS))


def _buckets(sizes: DataFrame, bits: int, first: int, shard_bytes: int) -> DataFrame:
    """``level, bucket, bytes``: disjoint id buckets of at most a shard's bytes, or of one id."""
    spark = sizes.sparkSession
    level, done = first, []
    rest = sizes
    while True:
        counted = written(rest.groupBy(F.lit(level).alias("level"), _bucket(level, bits).alias("bucket")).agg(F.sum("size").alias("bytes")), "buckets")
        last = level * SPLIT_BITS >= bits
        done.append(counted if last else counted.where(F.col("bytes") <= shard_bytes))
        heavy = counted.where(F.col("bytes") > shard_bytes).select(F.col("bucket").alias("_heavy"))
        n = 0 if last else heavy.count()
        if not n:
            break
        rest = rest.join(F.broadcast(heavy) if n <= BROADCAST_ROWS else heavy, _bucket(level, bits) == F.col("_heavy"), "left_semi")
        level += 1
    return written(functools.reduce(DataFrame.unionByName, done), "all-buckets") if len(done) > 1 else done[0]


def _shards(rows: DataFrame, sizes: DataFrame, shard_bytes: int) -> tuple[DataFrame, int]:
    """Adds ``shard``.  ``sizes``: page_id and size of the same rows; a null id counts as the least one.

    Buckets are dealt to shards by their running sum of bytes, in GROUPS groups apart;
    only a number per group and the levels in use reach the driver.
    """
    low, high, total = sizes.agg(F.min("page_id"), F.max("page_id"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if low is None:
        low = high = 0
    offset = (F.coalesce("page_id", F.lit(low)).cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")).cast("decimal(20,0)")
    bits = max(1, (high - low).bit_length())
    # unsigned 64 bits in a long: what lies beyond 2^63 is shifted as its two's complement
    offset = F.when(offset >= F.lit(str(1 << 63)).cast("decimal(20,0)"), offset - F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(offset).cast("bigint")
    first = max(1, min(-(-bits // SPLIT_BITS), -(-(4 * (total // shard_bytes + 1) - 1).bit_length() // SPLIT_BITS)))
    buckets = _buckets(sizes.withColumn("_offset", offset).select("_offset", "size"), bits, first, shard_bytes)
    # where a bucket begins, as a number that orders buckets of all levels
    shift = F.greatest(F.lit(0), F.lit(bits) - F.col("level") * SPLIT_BITS)
    begins = F.call_function("shiftleft", F.col("bucket"), shift)
    # about eight shards to a group, so that few shards are left half full
    groups = min(GROUPS, max(1, total // (8 * shard_bytes)))
    group = F.shiftrightunsigned(begins, max(0, bits - groups.bit_length() + 1)) if groups > 1 else F.lit(0).cast("bigint")
    order = Window.partitionBy("group").orderBy("begins")
    before = F.coalesce(F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = F.greatest(F.lit(1), F.ceil(F.col("bytes") / F.lit(shard_bytes))).cast("int")
    # a bucket of one id with more bytes takes as many shards as they fill
    dealt = buckets.withColumn("begins", begins).withColumn("group", group).withColumn("parts", parts).withColumn("before", before)
    dealt = written(dealt.select("level", "bucket", "group", "parts", F.floor(F.col("before") / F.lit(shard_bytes)).cast("int").alias("local")), "shards")
    widths = dealt.groupBy("group").agg(F.max(F.col("local") + F.col("parts")).alias("n")).collect()  # at most GROUPS rows
    starts, n = {}, 0
    for r in sorted(widths, key=lambda r: r["group"]):
        starts[r["group"]] = n
        n += r["n"]
    if not starts:
        return rows.withColumn("shard", F.lit(0)), 1
    table = rows.sparkSession.createDataFrame(list(starts.items()), "group bigint, start int")
    levels = [r["level"] for r in dealt.select("level").distinct().collect()]  # at most eight
    dealt = dealt.join(F.broadcast(table), "group").select(F.col("level").alias("_level"), F.col("bucket").alias("_bucket"), (F.col("start") + F.col("local")).alias("_start"), F.col("parts").alias("_parts"))
    small = dealt.count() <= BROADCAST_ROWS
    placed = rows.withColumn("_offset", offset)
    shard = F.lit(None).cast("int")
    parts = F.lit(None).cast("int")
    for k in sorted(levels):
        mine = dealt.where(F.col("_level") == k).drop("_level").withColumnsRenamed({"_start": f"_start{k}", "_parts": f"_parts{k}"})
        placed = placed.join(F.broadcast(mine) if small else mine, _bucket(k, bits) == F.col("_bucket"), "left").drop("_bucket")
        shard, parts = F.coalesce(shard, F.col(f"_start{k}")), F.coalesce(parts, F.col(f"_parts{k}"))
    placed = placed.withColumn("shard", shard).withColumn("_parts", parts).drop("_offset", *[f"_{x}{k}" for k in levels for x in ("start", "parts")])
    if not dealt.where("_parts > 1").limit(1).count():
        return placed.drop("_parts"), n
    heavy = _apart(placed.where("_parts > 1"), rows.columns)
    return placed.where("_parts = 1").drop("_parts").unionByName(heavy), n


def _apart(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ids with more than a shard's bytes, dealt by a hash of their content; rows that repeat are counted, numbered and dealt by their number too.

    They are the same whatever their number, so the files don't depend on who got which.
    The numbers of one row are made by many tasks.
    """
    counted = rows.groupBy(*columns, "shard", "_parts").agg(F.count("*").alias("_n"))
    blocks = counted.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, F.lit(EQUAL_AT_ONCE).cast("bigint")))).repartition("page_id", "_block", F.xxhash64("url", "html"))
    numbered = blocks.withColumn("_k", F.explode(F.sequence("_block", F.least(F.col("_n"), F.col("_block") + EQUAL_AT_ONCE) - 1)))
    content = F.pmod(F.xxhash64("url", "html") + F.col("_k"), F.col("_parts")).cast("int")
    return numbered.withColumn("shard", F.col("shard") + content).select(*columns, "shard")


def write(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, least: int = REVISIT_BYTES, date: str = DATE) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC files under ``folder``; returns the manifest.

    A null html is an empty payload, a null url becomes a urn of the id; a row with a null
    id is dealt like the least id and revisits the group's response if there is one.
    Rows that repeat the largest id of their group are responses all.  Other columns are
    dropped.  An empty table gives an empty manifest.  ``folder`` must be new.
    """
    spark = pages.sparkSession
    sizes = pick(pages, "page_id", "html").select(F.col("page_id").cast("bigint").alias("page_id"), F.octet_length(F.coalesce("html", F.lit(""))).cast("bigint").alias("size"))
    dealt, n = _shards(resolved(pages, least), sizes, shard_bytes)
    dealt = dealt.select("shard", "page_id", "url", "html", "refers_to", "revisit").repartitionById(n, F.col("shard"))
    dealt = dealt.sortWithinPartitions("shard", "page_id", "url", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    with shuffles_dropped(spark):  # the payloads' shuffle goes when the files are written
        manifest = written(dealt.mapInArrow(_writer(folder, file_bytes, date), _MANIFEST), "manifest")
    # a number of partitions is kept as it is; by column, so few bytes would fall into one task
    moved = manifest.repartition(_tasks(manifest)).mapInArrow(_mover(folder), _MANIFEST)
    moved.write.parquet(f"{folder}/_manifest")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.delete(path(f"{folder}/_temporary"), True)
    system.create(path(f"{folder}/_COMMITTED"), True).close()
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/_manifest")


def _tasks(manifest: DataFrame) -> int:
    files, size = manifest.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    return max(1, min(files, max(manifest.sparkSession.sparkContext.defaultParallelism, size // READ_BYTES)))


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records (headers, block) of a file of gzip members, one member in memory at a time."""
    z, held = zlib.decompressobj(31), bytearray()
    data = stream.read(1 << 16)
    while data:
        held += z.decompress(data)
        data = z.unused_data
        if z.eof:
            head, _, rest = bytes(held).partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
            block = rest[: int(headers["Content-Length"])]
            if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
                raise ValueError("a record does not end where its length says")
            if headers["WARC-Block-Digest"] != f"sha1:{sha1_base32(block)}":
                raise ValueError("a block does not match its digest")
            yield headers, block
            z, held = zlib.decompressobj(31), bytearray()
        data = data or stream.read(1 << 16)
    if held:
        raise ValueError("a file ends inside a record")


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _opened(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                out = []
                with system.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for h, block in parse(stream):
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        digest, size = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"])
                        if h["WARC-Type"] == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if sha1_base32(payload) != digest or len(payload) != size:
                                raise ValueError("a payload does not match its digest")
                        out.append({"page_id": int(h["X-Page-Id"]) if h["X-Page-Id"] else None, "url": h["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest, "record_type": h["WARC-Type"], "refers_to": int(h["X-Refers-To-Page"]) if "X-Refers-To-Page" in h else None})
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=_READ)

    return run


_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the files that the manifest names, every digest verified.

    Raises for a folder whose writing has not been committed.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    if not path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path(f"{folder}/_COMMITTED")):
        raise ValueError(f"{folder} holds no committed archive")
    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/_manifest")
    return manifest.select("name").repartition(_tasks(manifest)).mapInArrow(_reader(folder), "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
