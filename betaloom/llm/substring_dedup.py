"""Exact substring dedup over prefix-partitioned suffix trees (operator 10).

The suffixes are those that start at a document's words.  Only internal nodes at depth 50
or more matter: their leaves are places whose next 50 words are equal.  Prefixes of
variable length split the suffixes into groups, each small enough for one task.

A suffix goes by a 16-word prefix inside its first 50 words: of the 35 that start there
the one that hashes lowest.  Equal 50-word suffixes choose alike, and neighbouring
suffixes mostly share the place they choose, so a run of them travels as one piece of
text, 50 words and one more for each further suffix, instead of 50 words each.

Prefixes that lie in one document alone can't have a node that removes a word; their
suffixes are dropped.  The rest is counted by prefix.  A prefix whose group fits into
memory gets its subtree: the group's suffixes are sorted by their words down to depth 50
(ranks of three words, of nine, of 27, of 50), neighbours that are equal to that depth
are the leaves of one deep internal node, and leaves in larger documents than the node's
smallest remove the words they cover; leaves side by side make the maximal repeat.  A
prefix whose group does not fit is lengthened to the full 50 words.  Then each prefix is
a deep node itself and there is no subtree to hold: its smallest document is aggregated
before the shuffle, and joined back to the leaves by a join that Spark splits where it is
hot.  So a passage that stands in a third of all rows is no group in one task.

Whole copies of a word sequence are settled first, by digest, without any suffix.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import done_with, field, map_texts, pick, row_key, steps, written
from .piece_bpe import Memo
from .simhash import shuffles_dropped

#: Parameters: words of a suffix that matter (node depth), words of a short prefix, most
#: words of a group that becomes a subtree, words of groups that are sorted at once, most
#: long prefixes that are broadcast.  A group and what is sorted with it stay below 2^21.
WINDOW, PREFIX, GROUP_WORDS, SORTED_WORDS, BROADCAST_ROWS = 50, 16, 1 << 20, 1 << 18, 1_000_000
_BASE = 0x9E3779B97F4A7C15 | 1
_word = Memo(lambda w: xxhash.xxh3_64_intdigest(w), 200_000)  # type: ignore[arg-type, return-value]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # bytes: blanks, tabs and line ends of ASCII alone


def digest_of(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def prefix_hashes(words: list[bytes], size: int) -> np.ndarray:
    """A rolling hash, mixed, of each run of ``size`` words."""
    n = len(words)
    h = np.fromiter([_word[w] for w in words], np.uint64, n)
    with np.errstate(over="ignore"):
        up, down = np.full(n, np.uint64(_BASE)), np.full(n, np.uint64(pow(_BASE, -1, 1 << 64)))
        up[0] = down[0] = 1
        up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(h * down, dtype=np.uint64, out=sums[1:])
        out = (sums[size:] - sums[:-size]) * up[: n - size + 1]  # as if each run began at power 0
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out


def representatives(words: list[bytes], window: int, prefix: int) -> np.ndarray:
    """Per window start the hash of its representative prefix."""
    hashes = prefix_hashes(words, prefix)
    span = window - prefix + 1
    out = np.empty(len(words) - window + 1, np.uint64)
    for lo in range(0, len(out), 1 << 16):
        part = np.lib.stride_tricks.sliding_window_view(hashes[lo : lo + (1 << 16) + span - 1], span)[: len(out) - lo]
        out[lo : lo + len(part)] = part.min(axis=1)
    return out


def _scan(docs: DataFrame, window: int, prefix: int) -> DataFrame:
    def run(texts: list) -> list:
        n, sha, hashes = [], [], []
        for t in texts:
            words = words_of(t)
            n.append(len(words))
            sha.append(digest_of(words))
            hashes.append(np.unique(representatives(words, window, prefix)).view(np.int64).tolist() if len(words) >= window else [])
        return [n, sha, hashes]

    return map_texts(docs, ["doc_id", "row_key"], "text", run, [field("n_words", "long"), field("all_sha256", "string"), field("prefixes", "array<bigint>")])


def _pieces(window: int, prefix: int, fields: list[str]):
    """Runs of suffixes that share a prefix, as ``doc_id, row_key, h, at, size, words``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, 64):
            docs, hs, ats, sizes, texts = [], [], [], [], []
            for doc, (text, repeated) in enumerate(zip(step.column(2).to_pylist(), step.column(3).to_pylist())):
                words = words_of(text)
                reps = representatives(words, window, prefix).view(np.int64)
                at = np.flatnonzero(np.isin(reps, np.array(repeated, np.int64)))
                if not len(at):
                    continue
                new = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(reps[at]) != 0)])
                # a run in repetitive text can be long: it is cut like any other
                place = np.arange(len(at))
                new |= (place - np.maximum.accumulate(np.where(new, place, 0))) % (window - prefix + 1) == 0
                begins = at[new]
                counts = np.diff(np.concatenate([np.flatnonzero(new), [len(at)]]))
                docs += [doc] * len(begins)
                hs += reps[begins].tolist()
                ats += begins.tolist()
                sizes += (counts + window - 1).tolist()
                texts += [b" ".join(words[a : a + n + window - 1]) for a, n in zip(begins.tolist(), counts.tolist())]
            if docs:
                of = pa.array(docs, pa.int32())
                yield pa.RecordBatch.from_arrays([step.column(0).take(of), step.column(1).take(of), pa.array(hs, pa.int64()), pa.array(ats, pa.int64()), pa.array(sizes, pa.int64()), pa.array([t.decode() for t in texts], pa.string())], names=fields)

    return run


def deep_ranks(names: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """Ranks of the suffixes at ``starts`` by their first ``window`` words; equal to that depth, equal rank.

    ``names`` numbers the words, below 2^21 like their places.
    """

    def sorted_by(*parts: np.ndarray) -> np.ndarray:
        key = parts[0]
        for p in parts[1:]:
            key = key << np.int64(21) | p
        return np.unique(key, return_inverse=True)[1]

    ranks, depth = names, 1
    while 3 * depth < window:
        # towards the end suffixes are cut off: those are shorter than any start needs
        ranks = np.concatenate([ranks, np.zeros(2 * depth, np.int64)])
        ranks = sorted_by(ranks[: -2 * depth], ranks[depth:-depth], ranks[2 * depth :])
        depth *= 3
    offsets = (0, window - depth) if 2 * depth >= window else (0, depth, window - depth)
    return sorted_by(*(ranks[starts + k] for k in offsets))


def subtree_repeats(docs: np.ndarray, sizes: np.ndarray, words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, first, last) of each run of suffixes that lie below a deep node with a smaller document.

    ``docs`` and ``sizes`` per piece: its document as a number in order, its words, which
    follow each other in ``words``.  First and last are places in the piece.
    """
    numbers: dict[bytes, int] = {}
    names = np.fromiter([numbers.setdefault(w, len(numbers)) for w in words], np.int64, len(words))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    counts = sizes - window + 1
    piece = np.repeat(np.arange(len(sizes)), counts)
    within = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
    node = deep_ranks(names, offsets[piece] + within, window)
    least = np.full(node.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, node, docs[piece])
    at = np.flatnonzero(docs[piece] > least[node])
    if not len(at):
        return at, at, at
    new = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(piece[at]) != 0)])
    ends = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])
    return piece[at][new], within[at][new], within[at][ends]


def _subtrees(window: int, sorted_words: int, fields: list[str]):
    """Over pieces in the order of their prefix: words that go, as ``doc_id, row_key, begin, end``."""

    def removed(held: pa.Table) -> pa.RecordBatch:
        sizes = held.column("size").to_numpy()
        words = b" ".join(held.column("words").cast(pa.binary()).to_pylist()).split()
        ids = held.column("doc_id").to_numpy()
        piece, first, last = subtree_repeats(np.unique(ids, return_inverse=True)[1], sizes, words, window)
        at = held.column("at").to_numpy()[piece]
        mine = held.select(["doc_id", "row_key"]).take(pa.array(piece)).combine_chunks()
        columns = [(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c) for c in mine.columns]
        return pa.RecordBatch.from_arrays([*columns, pa.array(at + first), pa.array(at + last + window)], names=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for step in steps(batches, 4096):
            h = step.column(2).to_numpy()
            # where a group begins: what is held before it is complete
            borders = np.flatnonzero(np.concatenate([[not held or h[0] != held[-1].column(2)[-1].as_py()], h[1:] != h[:-1]]))
            upto = np.concatenate([[0], np.cumsum(step.column(4).to_numpy())])
            begun = 0
            for k in borders.tolist():
                if n + upto[k] - upto[begun] >= sorted_words:
                    if k > begun:
                        held.append(step.slice(begun, k - begun))
                    yield removed(pa.Table.from_batches(held))
                    held, n, begun = [], 0, k
            held.append(step.slice(begun))
            n += int(upto[-1] - upto[begun])
        if held:
            yield removed(pa.Table.from_batches(held))

    return run


def _spelled(window: int, fields: list[str]):
    """Each suffix of the pieces by a digest of its ``window`` words: ``doc_id, row_key, at, k1, k2``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, 256):
            of, ats, digests = [], [], []
            for k, (at, text) in enumerate(zip(step.column(3).to_pylist(), step.column(5).to_pylist())):
                words = words_of(text)
                n = len(words) - window + 1
                of += [k] * n
                ats += range(at, at + n)
                digests += [hashlib.blake2b(b" ".join(words[j : j + window]), digest_size=16).digest() for j in range(n)]
            keys = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            mine = pa.array(of, pa.int32())
            yield pa.RecordBatch.from_arrays([step.column(0).take(mine), step.column(1).take(mine), pa.array(ats, pa.int64()), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy())], names=fields)

    return run


def remaining(words: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    """Words that no span covers."""
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.array(spans, np.int64)
    np.add.at(cover, at[:, 0], 1)
    np.add.at(cover, at[:, 1], -1)
    return [w for w, c in zip(words, np.cumsum(cover[:-1]).tolist()) if not c]


def _removed(fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, 64):
            found = []
            for text, spans in zip(step.column(2).to_pylist(), step.column(3).to_pylist()):
                words = words_of(text)
                left = remaining(words, [(x["begin"], x["end"]) for x in spans])
                found.append((len(words) - len(left), digest_of(left), b" ".join(left).decode()))
            n, sha, kept = zip(*found)
            yield pa.RecordBatch.from_arrays([step.column(0), step.column(1), pa.array(n, pa.int64()), pa.array(sha), pa.array(kept)], names=fields)

    return run


def _mapped(df: DataFrame, make, *fields: T.StructField) -> DataFrame:
    """``doc_id, row_key`` and ``fields`` made from the batches of ``df``."""
    schema = T.StructType([df.schema["doc_id"], df.schema["row_key"], *fields])
    return df.mapInArrow(make([f.name for f in schema.fields]), schema)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, prefix: int = PREFIX, group_words: int = GROUP_WORDS) -> tuple[DataFrame, DataFrame]:
    """(one row per document with what is known without suffixes, documents that lose some of their words)."""
    keyed = pick(docs, (id_col, "doc_id"), (text_col, "text")).select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row_key"), "text")
    same = lambda d, k: (F.col("doc_id") == F.col(d)) & (F.col("row_key") == F.col(k))
    with shuffles_dropped(docs.sparkSession):
        scanned = written(_scan(keyed, window, prefix), "scanned")
        able = scanned.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))
        copied = written(able.groupBy("all_sha256").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select(F.col("all_sha256").alias("copied_sha256"), "first"), "copied")
        marked = scanned.join(copied, F.col("all_sha256") == F.col("copied_sha256"), "left")
        known = written(marked.select("doc_id", "row_key", "n_words", "all_sha256", (F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)) & (F.col("n_words") >= window)).alias("is_copy"), "prefixes"), "known")
        done_with(scanned, copied)
        short = known.where(F.col("doc_id").isNotNull() & ~F.col("is_copy")).select("doc_id", "row_key", F.explode("prefixes").alias("h"))
        shared = written(short.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select(F.col("h").alias("shared")), "shared")
        hopeful = written(short.join(shared, F.col("h") == F.col("shared")).groupBy("doc_id", "row_key").agg(F.collect_set("h").alias("hs")), "hopeful")
        # rows that repeat are one text from here on
        texts = written(keyed.join(hopeful.select(F.col("doc_id").alias("d"), F.col("row_key").alias("k"), "hs"), same("d", "k")).select("doc_id", "row_key", "text", "hs").dropDuplicates(["doc_id", "row_key"]), "texts")
        done_with(shared, hopeful)
        pieces = written(_mapped(texts, lambda names: _pieces(window, prefix, names), field("h", "long"), field("at", "long"), field("size", "long"), field("words", "string")), "pieces")
        groups = pieces.groupBy(F.col("h").alias("g")).agg(F.sum("size").alias("group_size"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
        long = written(groups.where(F.col("group_size") > group_words).select("g"), "long-prefixes")
        beyond = F.broadcast(long) if long.count() <= BROADCAST_ROWS else long
        small = pieces.join(beyond, F.col("h") == F.col("g"), "left_anti").repartition("h").sortWithinPartitions("h")
        begin_end = field("begin", "long"), field("end", "long")
        spans = [_mapped(small, lambda names: _subtrees(window, SORTED_WORDS, names), *begin_end)]
        made = [texts, pieces, long]
        if not long.isEmpty():
            leaves = written(_mapped(pieces.join(beyond, F.col("h") == F.col("g"), "left_semi"), lambda names: _spelled(window, names), field("at", "long"), field("k1", "long"), field("k2", "long")), "leaves")
            nodes = written(leaves.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select(F.col("k1").alias("n1"), F.col("k2").alias("n2"), "first"), "nodes")
            below = leaves.join(nodes, (F.col("k1") == F.col("n1")) & (F.col("k2") == F.col("n2"))).where("doc_id > first")
            spans.append(below.select("doc_id", "row_key", F.col("at").alias("begin"), (F.col("at") + window).alias("end")))
            made += [leaves, nodes]
        places = written(functools.reduce(DataFrame.unionByName, spans).groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("begin", "end")).alias("spans")), "places")
        lost = texts.select("doc_id", "row_key", "text").join(places.select(F.col("doc_id").alias("d"), F.col("row_key").alias("k"), "spans"), same("d", "k")).select("doc_id", "row_key", "text", "spans")
        lost = written(_mapped(lost, _removed, field("n_removed", "long"), field("kept_sha256", "string"), field("kept", "string")), "lost")
        done_with(*made, places)
    return known.drop("prefixes"), lost


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, prefix: int = PREFIX, group_words: int = GROUP_WORDS) -> DataFrame:
    """``id, n_words, n_removed, kept_sha256`` per row.

    A word goes if a window of ``window`` words that covers it also starts in a document
    with a smaller id; windows are judged on the input.  Ids are numbers or strings.  A
    null text has no words; a row with a null id neither removes nor loses words; rows
    with equal ids don't remove from each other, and repeated rows get equal results.
    Other columns are dropped.  An empty table gives an empty table.
    """
    known, lost = repeats(docs, id_col, text_col, window, prefix, group_words)
    few = lost.select(F.col("doc_id").alias("d"), F.col("row_key").alias("k"), "n_removed", "kept_sha256")
    out = known.join(few, (F.col("doc_id") == F.col("d")) & (F.col("row_key") == F.col("k")), "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        F.col("doc_id").alias(id_col), "n_words",
        F.when(F.col("is_copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(F.col("is_copy"), nothing).otherwise(F.coalesce("kept_sha256", "all_sha256")).alias("kept_sha256"),
    )


def oracle(window: int = WINDOW) -> str:
    """The contract in DuckDB's SQL, by all windows spelled out."""
    return f"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
g AS (SELECT r, doc_id, words, unnest(range(len(words) - {window - 1})) AS p FROM w WHERE len(words) >= {window}),
k AS (SELECT r, doc_id, p, sha256(array_to_string(words[p + 1 : p + {window}], ' ')) AS h FROM g),
m AS (SELECT h, min(doc_id) AS first FROM k GROUP BY 1),
x AS (SELECT k.r, k.p FROM k JOIN m USING (h) WHERE k.doc_id > m.first),
c AS (SELECT DISTINCT r, p + o AS i FROM x, (SELECT unnest(range({window})) AS o)),
l AS (SELECT r, unnest(words) AS word, unnest(range(len(words))) AS i FROM w),
kept AS (SELECT l.r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM l ANTI JOIN c USING (r, i) GROUP BY 1)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (r)"""
