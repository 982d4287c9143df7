"""SimHash near-duplicates by meet-in-the-middle ball hashing (operator 4).

Two fingerprints within four bits of each other have a 64-bit string within two bits of
both.  So every distinct fingerprint emits the 2,081 variants within two bits, the
variants are shuffled, and fingerprints that meet at a variant are linked.  All that meet
at one variant are within four bits of each other (triangle inequality), so linking each
to the next in order keeps their connection with one link less than there are rows:
large groups cost no pairs.  Links are deduplicated and verified, then joined to
components.

Equal fingerprints are one node from the start, so a group of exact copies emits once.
The variants are dealt in passes, by three bits of the variant, and each pass's shuffle
files go before the next begins: the disk holds an eighth of the variants at a time.  They
travel packed, a row per bucket of variants, as variant and place of its mask in the ball.
"""

from __future__ import annotations

import contextlib
import gc
from collections.abc import Iterator, Sequence
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import done_with, field, map_texts, new_folder, steps, written
from .components import components

#: Parameters: words in a shingle, bits within which fingerprints link, passes as bits of the variant.
SHINGLE, RADIUS, PASS_BITS = 4, 4, 3
#: Parameters: fingerprints whose variants are packed at once, variants that a group holds about.
FINGERPRINTS_PER_STEP, VARIANTS_PER_BUCKET = 4096, 1 << 19
_AT_ONCE = 1 << 16
_HASH = xxhash.xxh64_intdigest


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``size`` words, repeats included, A-Z lowered.

    Words are what lies between blanks, tabs and line ends; fewer words than ``size``
    make one shingle, none make no shingle.
    """
    words = (text or "").encode().lower().split()  # bytes: ASCII alone is lowered and split
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([_HASH(joined, 42)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = len(words) - size + 1
    return np.fromiter([_HASH(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[size - 1 :].tolist())], np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes; 0 for none."""
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), _AT_ONCE):
        part = hashes[lo : lo + _AT_ONCE].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, ids: Sequence[str] = ("doc_id",), text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """``ids, fp`` per row, fp as a signed long; no shuffle."""

    def run(texts: list) -> list:
        found = np.array([majority(shingle_hashes(t, size)) for t in texts], np.uint64)
        return [found.view(np.int64).tolist()]

    return map_texts(docs, ids, text_col, run, [field("fp", "long")])


def ball(radius: int, bits: int = 64) -> list[int]:
    """All strings of at most ``radius`` set bits, as signed longs."""
    out = [sum(1 << k for k in c) for n in range(radius + 1) for c in combinations(range(bits), n)]
    return [v - (1 << 64) if v >> 63 else v for v in out]


def _emit(batches: Iterator[pa.RecordBatch], every: np.ndarray, k: int, pass_bits: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Variants of fingerprints, packed: a row per bucket and step with the variants and the places of their masks."""
    masks, low, shift = every.view(np.uint64), np.uint64((1 << pass_bits) - 1), np.uint64(33)
    for batch in steps(batches, FINGERPRINTS_PER_STEP):
        fp = batch.column(0).to_numpy().view(np.uint64)
        parts, places = [], []
        for b in range(1 << pass_bits):  # the masks that bring these low bits to the pass's
            of, at = fp[fp & low == b], np.flatnonzero(masks & low == b ^ k).astype(np.uint16)
            parts.append((of[:, None] ^ masks[at]).ravel())
            places.append(np.tile(at, len(of)))
        v, mask = np.concatenate(parts), np.concatenate(places)
        mixed = (v ^ v >> shift) * np.uint64(0xFF51AFD7ED558CCD)
        bucket = ((mixed >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
        v, mask, bucket = v[order], mask[order], bucket[order]
        cuts = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(v)] if len(v) else np.zeros(1, np.int64)
        ends = cuts.astype(np.int32)
        packed = [pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(ends * w.itemsize), pa.py_buffer(w)]) for w in (v, mask)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), *packed], names=["bucket", "v", "m"])


def _meet(table: pa.Table, every: np.ndarray) -> pa.Table:
    """Links from each fingerprint of a bucket's variants to the next of the same variant."""
    v, m = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in table.column(c)]) for c, t in (("v", np.uint64), ("m", np.uint16)))
    order = np.argsort(v)
    v = v[order]
    same = v[1:] == v[:-1]
    kept = np.r_[False, same] | np.r_[same, False]  # most variants are met by one fingerprint alone
    v, f = v[kept], (v ^ every.view(np.uint64)[m[order]])[kept]
    order = np.lexsort((f, v))
    v, f = v[order], f[order].view(np.int64)
    at = np.flatnonzero(v[1:] == v[:-1])
    links = np.unique(np.stack([f[at], f[at + 1]], axis=1), axis=0)
    return pa.table({"a": pa.array(links[:, 0], pa.int64()), "b": pa.array(links[:, 1], pa.int64())})


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, shuffle files go with the query that made them, where Spark offers that."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)
        gc.collect()


def ball_links(nodes: DataFrame, radius: int = RADIUS, pass_bits: int = PASS_BITS) -> DataFrame:
    """Links ``a, b`` that connect all distinct ``fp`` of ``nodes`` within ``radius`` bits.

    Not all pairs: fingerprints that meet at a variant are linked as a chain.
    """
    spark = nodes.sparkSession
    if radius % 2:
        raise ValueError("an even radius is needed: both ends go half the way")
    every = np.array(ball(radius // 2), np.int64)
    n = nodes.count()
    buckets = max(1, n * len(every) // (VARIANTS_PER_BUCKET << pass_bits))
    spread = max(spark.sparkContext.defaultParallelism, n // (1 << 16))
    folder = new_folder(spark, "ball")
    with shuffles_dropped(spark):
        for k in range(1 << pass_bits):
            emitted = nodes.select("fp").repartition(spread).mapInArrow(partial(_emit, every=every, k=k, pass_bits=pass_bits, buckets=buckets), "bucket int, v binary, m binary")
            emitted.groupBy("bucket").applyInArrow(lambda table: _meet(table, every), "a bigint, b bigint").write.mode("append").parquet(folder)
    links = spark.read.schema("a bigint, b bigint").parquet(folder).distinct()
    return links.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def clusters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, radius: int = RADIUS, also: Sequence[str] = ()) -> DataFrame:
    """``id, also, fp, root, component_id`` per row; ``root`` tells components apart, also where ids repeat."""
    found = written(fingerprints(docs, [id_col, *also], text_col, size), "fingerprints")
    nodes = written(found.groupBy("fp").agg(F.min(id_col).alias("least")), "nodes")
    roots = components(ball_links(nodes.select("fp"), radius))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    classes = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # written, so that the join with all rows has plain exchanges on both sides, which Spark splits at a hot key
    named = written(rooted.join(classes, "root").select(F.col("fp").alias("f"), "root", "component_id"), "classes")
    done_with(nodes, rooted)
    return found.join(named, found["fp"] == named["f"], "left").select(id_col, *also, "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``id, fingerprint, component_id`` per row: the smallest id reachable over links of ``radius`` bits.

    A null text counts as empty: fingerprint zero, linked like any other.  Repeated rows
    stay and share a component; a null id never is a component's smallest unless all are
    null.  Other columns are dropped.  An empty table gives an empty table.
    """
    out = clusters(docs, id_col, text_col, size, radius)
    return out.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
