"""Alignment of two tokenizers' tokens and corpus-wide counts of the pairs (operator 12).

Two encodings of one text are cut into groups at the byte offsets where tokens of both end;
within a group every token of one is linked to every token of the other.  A pair of ids is
packed into one 64-bit key, and its count is the number of documents that hold it linked.

1. Each row is encoded by both vocabularies and keeps its different keys with their links.
   The tokens of many rows are laid end to end and aligned by array operations at once.
2. Per partition ``np.unique`` counts the keys of bounded runs of rows; the partial counts
   are sorted globally by ranges of keys, and neighbouring equal keys are summed.
3. Each range becomes a shard in the shared folder, sorted keys and their counts, named by a
   manifest.  Tasks map the shards into memory and look the keys of their rows up by
   ``searchsorted``.  Only the best count of each id of the first vocabulary is broadcast:
   as many numbers as that vocabulary has entries.

Long texts are encoded in pieces that begin at a blank after another character, where
neither vocabulary merges across; memory is a multiple of a piece.  A row's keys beyond
``PART_KEYS`` go to further rows of the intermediate table, and groups with many pairs are
multiplied out in blocks of ids, so no step holds all pairs of such a text.  Rows of the
intermediate table carry a number of their own, which stays as written.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import Backtracking, Classes
from .common import done_with, drop_folder, enter, field, map_texts, new_folder, on_leave, pick, steps, written
from .piece_bpe import Memo
from .token_counts import _byte_characters
from .warc import _opened

BYTE_VOCABULARY, PIECE_MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pre-tokens kept in a worker (a memo holds at most twice that), keys in a row of the
#: intermediate table, pairs from which a group is multiplied out apart, keys counted at once,
#: rows of a batch, characters aligned at once and of a piece of a long text, shards held in
#: memory where the shared folder can't be mapped.
MEMO_TOKENS, PART_KEYS, LARGE, KEYS_AT_ONCE, ROWS_AT_ONCE, CHARS_AT_ONCE, HELD = 60_000, 1 << 17, 4096, 1 << 21, 256, 1 << 20, 4
_B = 32  # bits of the second id in a key
_NONE = np.empty(0, np.int64)


class ByteTokens:
    """Ids of a byte-level BPE file; special strings are ordinary text.

    Where every token encodes alone as itself and ids rise with the ranks of the merges, the
    ranks alone give the same merges, and ``tiktoken`` is asked for texts of characters whose
    classes are the same in any version of Unicode.  Other texts, and those with very long
    words, go through the backtracking encoder.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split, model = spec["pre_tokenizer"], spec["model"]
        if spec["normalizer"] or model["type"] != "BPE" or model["ignore_merges"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            raise ValueError("only byte-level BPE without a normalizer or prefix space is supported")
        self.bpe = Backtracking(model["vocab"], model["merges"])
        self.classes = Classes(Tokenizer.from_file(path).pre_tokenizer)
        r = self.classes.ranges
        letters, numbers, white = r["L"], r["N"], r["W"]
        self.pattern = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{white}{letters}{numbers}]+|[{white}]+(?![^{white}])|[{white}]+")
        self.own = re.compile(f"[^\\u0000-\\u017f]|[^{white}]{{2000}}|[{white}]{{200}}")
        back = {c: b for b, c in _byte_characters().items()}
        self.bytes = {i: bytes([back[c] for c in s]) for s, i in model["vocab"].items() if all(c in back for c in s)}
        self.known = Memo(lambda p: tuple(self.bpe.encode(self.bpe.word(p))), MEMO_TOKENS)
        self.ranks = None
        made = sorted((self.bpe.rank[i], i) for i in self.bytes)
        if len(self.bpe.ids) == len(self.bytes) and all(x[1] < y[1] for x, y in zip(made, made[1:]) if x[0] >= 0):
            import tiktoken

            self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in self.bytes.items()}, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.ranks is not None and not self.own.search(text):
            return self.ranks.encode_to_numpy(text, disallowed_special=())
        return np.array([i for p in self.classes.pieces_of(self.pattern, text) for i in self.known[p]], np.int64)


class Aligned:
    """Texts laid end to end: their tokens ``a`` and ``b``, and of each group its end in both."""

    def __init__(self, a: Sequence[np.ndarray], b: Sequence[np.ndarray], lengths_a: np.ndarray, lengths_b: np.ndarray) -> None:
        self.a, self.b = (np.concatenate([_NONE, *x]).astype(np.int64) for x in (a, b))
        ends_a, ends_b = np.cumsum(lengths_a[self.a]), np.cumsum(lengths_b[self.b])
        at = np.searchsorted(ends_b, ends_a)
        both = np.flatnonzero(ends_b[at] == ends_a) if len(at) else at
        self.end_a, self.end_b = both + 1, at[both] + 1
        self.n_a, self.n_b = np.diff(self.end_a, prepend=0), np.diff(self.end_b, prepend=0)
        self.tokens_a, self.tokens_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
        # a text ends with a group, so the groups of text t are those up to upto[t]
        self.upto = np.searchsorted(self.end_a, np.cumsum(self.tokens_a), "right")

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums of the groups' values by text."""
        return np.diff(np.concatenate([[0], np.cumsum(values)])[self.upto], prepend=0)

    def pairs(self, small: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Group and key of every pair in the groups chosen."""
        group = np.flatnonzero(small)
        many = (self.n_a * self.n_b)[group]
        which = np.repeat(group, many)
        k = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        i, j = np.divmod(k, self.n_b[which])
        return which, self.a[(self.end_a - self.n_a)[which] + i] << _B | self.b[(self.end_b - self.n_b)[which] + j]

    def shown(self) -> list[bytes]:
        """Per text its groups as ``a1,a2|b1;a3|b2,b3``: numbers and marks gathered from one table."""
        buffer, offsets = _numerals(int(max(self.a.max(initial=0), self.b.max(initial=0))).bit_length())
        out = np.empty(len(self.a) + len(self.b), np.int64)
        start_b = self.end_b - self.n_b
        place_a, place_b = np.arange(len(self.a)) + np.repeat(start_b, self.n_a), np.arange(len(self.b)) + np.repeat(self.end_a, self.n_b)
        out[place_a], out[place_b] = self.a * 3, self.b * 3
        out[place_a[self.end_a - 1]] += 1
        out[place_b[self.end_b - 1]] += 2
        lengths = offsets[out + 1] - offsets[out]
        ends = np.cumsum(lengths)
        data = buffer[np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[out] - (ends - lengths), lengths)].tobytes()
        last = np.concatenate([[0], ends])[np.cumsum(self.tokens_a + self.tokens_b)].tolist()
        return [data[lo : hi - 1] for lo, hi in zip([0, *last], last)]


@functools.lru_cache(maxsize=2)
def _numerals(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal numbers below ``2**bits``, each with a comma, a bar and a semicolon behind, and where each begins."""
    parts = [b"%d%c" % (i, c) for i in range(1 << bits) for c in b",|;"]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


class Aligner:
    def __init__(self, first: str, second: str) -> None:
        import sentencepiece

        self.a, self.b = ByteTokens(first), sentencepiece.SentencePieceProcessor(model_file=second)
        n = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        if any("\u2581" in p.lstrip("\u2581") for p in pieces):
            raise ValueError("the model has pieces that go on after a blank")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]
        self.lengths_a = np.array([len(self.a.bytes.get(i, b"")) for i in range(max(self.a.bytes) + 1)])
        self.lengths_b = np.array([len(x) for x in self.bytes_b])
        # bits of the ids in a key that holds a text's number too
        self.bits_a, self.bits_b = max(self.a.bytes).bit_length(), n.bit_length()
        self.cut = re.compile("(?<=[^" + re.escape("".join(c for c in map(chr, range(0x3001)) if self.a.classes.kind(c) == "W")) + "]) ")

    def pieces(self, text: str) -> list[str]:
        """A text in pieces of about CHARS_AT_ONCE characters, each but the first without the blank it begins at."""
        out, at = [], 0
        while len(text) - at > CHARS_AT_ONCE and (m := self.cut.search(text, at + CHARS_AT_ONCE)):
            out.append(text[at : m.start()])
            at = m.end()
        return [*out, text[at:]]

    def encoded(self, pieces: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Both encodings of each piece; none where the tokens' bytes are not those of the piece and the blank before it."""
        a, b = [self.a.ids(" " + p) for p in pieces], self.b.encode(pieces, num_threads=1)
        spelt = self.bytes_b
        for k, p in enumerate(pieces):
            want = (" " + p).encode()
            # tokens of the first are bytes of the text as they come, so only their number can differ
            if p and b"".join([spelt[i] for i in b[k]]) == want and self.lengths_a[a[k]].sum() == len(want):
                b[k] = np.array(b[k], np.int64)
            else:
                a[k] = b[k] = _NONE
        return a, b

    def aligned(self, pieces: list[str]) -> Aligned:
        return Aligned(*self.encoded(pieces), self.lengths_a, self.lengths_b)

    def groups(self, text: str | None) -> list[tuple[list[int], list[int]]]:
        """The groups of a text, each the ids of both in order; none if the tokens don't spell the text."""
        out: list = []
        for piece in self.pieces(text or ""):
            x = self.aligned([piece])
            if piece and not len(x.a):
                return []
            out += [(x.a[i - m : i].tolist(), x.b[j - n : j].tolist()) for i, j, m, n in zip(x.end_a.tolist(), x.end_b.tolist(), x.n_a.tolist(), x.n_b.tolist())]
        return out

    def rows(self, texts: list[str | None]) -> Iterator[tuple[int, tuple, str, Iterator]]:
        """Per text, in order: its place, counts of tokens, groups and links, digest of the groups, and its different keys with their links in bounded parts."""
        held: list[str] = []
        size = lo = 0
        for k, text in enumerate(texts):
            text = text or ""
            if held and size + len(text) > CHARS_AT_ONCE:
                yield from self._together(lo, held)
                held, size = [], 0
            if len(text) > CHARS_AT_ONCE:
                yield k, *self._long(text)
                lo = k + 1
                continue
            lo = lo if held else k
            held.append(text)
            size += len(text)
        if held:
            yield from self._together(lo, held)

    def _together(self, lo: int, texts: list[str]) -> Iterator[tuple[int, tuple, str, Iterator]]:
        x = self.aligned(texts)
        many = x.n_a * x.n_b
        counts = zip(x.tokens_a.tolist(), x.tokens_b.tolist(), x.per_text(np.ones(len(many), np.int64)).tolist(), x.per_text(many).tolist())
        which, keys = x.pairs(many <= LARGE)
        owner = np.searchsorted(x.upto, which, "right")
        mask = (1 << _B) - 1
        packed, links = np.unique((owner << self.bits_a | keys >> _B) << self.bits_b | keys & mask, return_counts=True)
        cuts = np.searchsorted(packed, np.arange(len(texts) + 1) << (self.bits_a + self.bits_b))
        keys = (packed >> self.bits_b & ((1 << self.bits_a) - 1)) << _B | packed & ((1 << self.bits_b) - 1)
        large = self._large(x, np.flatnonzero(many > LARGE))
        for k, (n, shown) in enumerate(zip(counts, x.shown())):
            mine = keys[cuts[k] : cuts[k + 1]], links[cuts[k] : cuts[k + 1]]
            parts = multiplied(*mine, large[k]) if k in large else sliced(*mine)
            yield lo + k, n, hashlib.sha256(shown).hexdigest() if n[0] else "", parts

    def _large(self, x: Aligned, found: np.ndarray) -> dict[int, list]:
        out: dict[int, list] = {}
        for g in found.tolist():
            i, j = x.end_a[g], x.end_b[g]
            out.setdefault(int(np.searchsorted(x.upto, g, "right")), []).append((*np.unique(x.a[i - x.n_a[g] : i], return_counts=True), *np.unique(x.b[j - x.n_b[g] : j], return_counts=True)))
        return out

    def _long(self, text: str) -> tuple[tuple, str, Iterator]:
        total, digest, large = np.zeros(4, np.int64), hashlib.sha256(), []
        keys = links = np.empty(0, np.int64)
        for k, piece in enumerate(self.pieces(text)):
            x = self.aligned([piece])
            if piece and not len(x.a):
                return (0, 0, 0, 0), "", sliced(keys[:0], links[:0])
            many = x.n_a * x.n_b
            total += [len(x.a), len(x.b), len(many), many.sum()]
            if piece:
                digest.update((b";" if k else b"") + x.shown()[0])
            found, n = np.unique(x.pairs(many <= LARGE)[1], return_counts=True)
            keys, links = summed(np.concatenate([keys, found]), np.concatenate([links, n]))
            large += self._large(x, np.flatnonzero(many > LARGE)).get(0, [])
        return tuple(total.tolist()), digest.hexdigest(), multiplied(keys, links, large) if large else sliced(keys, links)


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys and the sums of their values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(values[order], starts)


def sliced(keys: np.ndarray, links: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for lo in range(0, max(1, len(keys)), PART_KEYS):
        yield keys[lo : lo + PART_KEYS], links[lo : lo + PART_KEYS]


def multiplied(keys: np.ndarray, links: np.ndarray, large: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Parts with the pairs of large groups too, in blocks of ids of the first vocabulary: each key comes once."""
    ids, weights = summed(np.concatenate([keys >> _B, *(g[0] for g in large)]), np.concatenate([np.ones(len(keys), np.int64), *(np.full(len(g[0]), len(g[2])) for g in large)]))
    block = (np.cumsum(weights) - 1) // PART_KEYS
    for lo, hi in zip(s := np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])), [*s[1:], len(ids)]):
        first, last = ids[lo], ids[hi - 1]
        k0, k1 = np.searchsorted(keys, [first << _B, last + 1 << _B])
        parts = [(keys[k0:k1], links[k0:k1])]
        for a, na, b, nb in large:
            i, j = np.searchsorted(a, [first, last + 1])
            parts.append(((a[i:j, None] << _B | b[None, :]).ravel(), (na[i:j, None] * nb[None, :]).ravel()))
        yield from sliced(*summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])))


@functools.lru_cache(maxsize=1)
def load(first: str, second: str) -> Aligner:
    """One per worker process; workers keep it from task to task."""
    return Aligner(first, second)


on_leave(__name__, load.cache_clear)


def _paths(first: str | None, second: str | None) -> tuple[str, str]:
    return first or public_tokenizers.path(BYTE_VOCABULARY), second or public_tokenizers.path(PIECE_MODEL)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: str | None = None, second: str | None = None) -> DataFrame:
    """``id, groups array<struct<a array<int>, b array<int>>>`` per row: the alignment itself.  No shuffle.

    Rows stay as they are; null and empty texts, and those that the tokens don't spell, have no groups.
    """
    paths = _paths(first, second)

    def run(texts: list) -> list:
        aligner = load(*paths)
        return [[[{"a": a, "b": b} for a, b in aligner.groups(t)] for t in texts]]

    return map_texts(docs, [id_col], text_col, run, [field("groups", "array<struct<a:array<int>,b:array<int>>>")])


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def _linked(docs: DataFrame, id_col: str, text_col: str, paths: tuple[str, str]) -> DataFrame:
    """``_id, row, n_a, n_b, n_groups, n_links, groups_sha256, keys, links``; a row's further parts hold keys and links alone."""
    source = pick(docs, (id_col, "_id"), (text_col, "_text"))
    kind = source.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, row bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, keys array<bigint>, links array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(__name__)
        aligner = load(*paths)
        row = TaskContext.get().partitionId() << 40
        for step in steps(batches, ROWS_AT_ONCE):
            out: list[tuple] = []
            held, at = 0, []
            for k, counts, digest, parts in aligner.rows(step.column(1).to_pylist()):
                for keys, links in parts:
                    out.append((row, *(counts if counts else (None,) * 4), digest, keys, links))
                    at.append(k)
                    counts = digest = None
                    held += len(keys)
                    if held >= KEYS_AT_ONCE // 2:
                        yield _rows(step, at, out)
                        out, at, held = [], [], 0
                row += 1
            if out:
                yield _rows(step, at, out)

    return source.mapInArrow(run, schema)


def _rows(step: pa.RecordBatch, at: list[int], out: list[tuple]) -> pa.RecordBatch:
    *plain, keys, links = zip(*out)
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x), pa.int64())) for x in (keys, links)]
    kinds = [pa.int64()] * 5 + [pa.string()]
    return pa.RecordBatch.from_arrays([step.column(0).take(pa.array(at)), *(pa.array(p, k) for p, k in zip(plain, kinds)), *lists], names=["_id", "row", *_NUMBERS, "groups_sha256", "keys", "links"])


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of keys over bounded runs of rows."""
    held, n = [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        for lo in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[lo : lo + (1 << 16)]), pa.array(counts[lo : lo + (1 << 16)].astype(np.int64))], names=["key", "n"])

    for batch in batches:
        values = batch.column(0).flatten().to_numpy()
        held.append(values)
        n += len(values)
        if n >= KEYS_AT_ONCE:
            yield from flush()
            held, n = [], 0
    if n:
        yield from flush()


_REPORT = "name string, keys bigint, first bigint, last bigint, a bigint, best bigint"
_ARROW = pa.schema([("name", pa.string()), ("keys", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("a", pa.int64()), ("best", pa.int64())])


def _sharder(folder: str):
    """Sums runs of equal keys of one sorted range into a shard; reports it, and the best count of each first id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = uuid.uuid4().hex
        system, path = _opened(folder)
        streams: list = []
        n, first, last, open_key, open_count = 0, None, None, None, 0
        best: dict[int, int] = {}

        def put(keys: np.ndarray, counts: np.ndarray) -> None:
            nonlocal n, first, last
            if not len(keys):
                return
            if not streams:
                system.create_dir(path, recursive=True)
                streams.extend(system.open_output_stream(f"{path}/{name}.{x}", compression=None) for x in ("keys", "counts"))
            streams[0].write(keys.astype("<i8").tobytes())
            streams[1].write(counts.astype("<i8").tobytes())
            first = int(keys[0]) if first is None else first
            last, n = int(keys[-1]), n + len(keys)
            a = keys >> _B
            starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            for x, c in zip(a[starts].tolist(), np.maximum.reduceat(counts, starts).tolist()):
                best[x] = max(best.get(x, 0), c)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, counts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if open_key is not None:  # the last key of the batch before may go on
                keys, counts = np.concatenate([[open_key], keys]), np.concatenate([[open_count], counts])
            keys, counts = summed(keys, counts)
            open_key, open_count = int(keys[-1]), int(counts[-1])
            put(keys[:-1], counts[:-1])
        if open_key is not None:
            put(np.array([open_key], np.int64), np.array([open_count], np.int64))
            for s in streams:
                s.close()
            rows = [{"name": name, "keys": n, "first": first, "last": last}, *({"a": a, "best": c} for a, c in best.items())]
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return run


class Shards:
    """Lookup of keys in sorted count shards."""

    def __init__(self, folder: str, manifest: list[tuple[str, int, int]]) -> None:
        """manifest: name, number of keys and first key, in order of keys."""
        self.folder, self.manifest = folder, manifest
        self.firsts = np.array([m[2] for m in manifest], np.int64)
        system, self.path = _opened(folder)
        self.local = isinstance(system, fs.LocalFileSystem)
        self.opened: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _open(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self.opened:
            name = self.manifest[k][0]
            if self.local:
                self.opened[k] = tuple(np.memmap(f"{self.path}/{name}.{x}", "<i8", "r") for x in ("keys", "counts"))
            else:  # a store without files: a few shards in memory at a time
                if len(self.opened) >= HELD:
                    self.opened.pop(next(iter(self.opened)))
                system, path = _opened(self.folder)
                found = []
                for x in ("keys", "counts"):
                    with system.open_input_file(f"{path}/{name}.{x}") as f:
                        found.append(np.frombuffer(f.read(), "<i8"))
                self.opened[k] = tuple(found)
        return self.opened[k]

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The count of each key; every key must be in a shard."""
        wanted, back = np.unique(keys, return_inverse=True)
        out = np.empty(len(wanted), np.int64)
        cuts = [*np.searchsorted(wanted, self.firsts), len(wanted)]
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            if lo < hi:
                have, count = self._open(k)
                at = np.searchsorted(have, wanted[lo:hi])
                if at[-1] >= len(have) or not np.array_equal(have[at], wanted[lo:hi]):
                    raise ValueError("a key is in no shard")
                out[lo:hi] = count[at]
        return out[back]


def _scorer(folder: str, manifest: list, best):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(folder, manifest)
        tops = best.value
        for step in steps(batches, ROWS_AT_ONCE):
            sizes = np.diff(step.column(1).offsets.to_numpy())
            keys, links = step.column(1).flatten().to_numpy(), step.column(2).flatten().to_numpy()
            owner = np.repeat(np.arange(len(sizes)), sizes)
            n_best, total = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            if len(keys):
                counts = shards.counts(keys)
                starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                n_best[owner[starts]] = np.add.reduceat(np.where(counts == tops[keys >> _B], links, 0), starts)
                total[owner[starts]] = np.add.reduceat(links * counts, starts)
            yield pa.RecordBatch.from_arrays([step.column(0), pa.array(n_best), pa.array(total)], names=["row", "n_best", "count_sum"])

    return run


def count_shards(linked: DataFrame, folder: str) -> DataFrame:
    """Write the count shards of a table with ``keys`` (each row's different keys); returns the report written beside them."""
    partial = written(linked.select("keys").mapInArrow(_partial, "key bigint, n bigint"), "pair-counts")
    report = written(partial.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(_sharder(folder), _REPORT), "pair-shards")
    done_with(partial)
    return report


def pair_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: str | None = None, second: str | None = None) -> DataFrame:
    """``a, b, documents``: every pair of ids that some row links, and how many rows do."""
    linked = written(_linked(docs, id_col, text_col, _paths(first, second)).select("keys"), "pairs")
    folder = new_folder(docs.sparkSession, "shards")
    report = count_shards(linked, folder)
    done_with(linked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, n, lowest in zip(*(c.to_pylist() for c in batch.columns)):
                keys, counts = Shards(folder, [(name, n, lowest)])._open(0)
                for lo in range(0, n, 1 << 16):
                    k = np.asarray(keys[lo : lo + (1 << 16)])
                    yield pa.RecordBatch.from_arrays([pa.array(k >> _B), pa.array(k & ((1 << _B) - 1)), pa.array(np.asarray(counts[lo : lo + (1 << 16)]))], names=["a", "b", "documents"])

    return report.where("name is not null").select("name", "keys", "first").mapInArrow(run, "a bigint, b bigint, documents bigint")


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: str | None = None, second: str | None = None) -> DataFrame:
    """``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` per row.

    ``first`` is a byte-level BPE file (special strings are ordinary text), ``second`` a
    SentencePiece BPE model; the first encodes a blank and the text.  Every row is a document
    of its own for the counts, repeated rows and null ids too.  Null and empty texts, and those
    that the tokens don't spell byte by byte, have zeros and an empty digest.  Other columns
    are dropped; an empty table gives an empty table.
    """
    spark: SparkSession = docs.sparkSession
    paths = _paths(first, second)
    linked = written(_linked(docs, id_col, text_col, paths), "linked")
    folder = new_folder(spark, "shards")
    report = count_shards(linked, folder)
    manifest = sorted(((r["name"], r["keys"], r["first"]) for r in report.where("name is not null").select("name", "keys", "first").collect()), key=lambda m: m[2])  # a row a shard
    tops = report.where("a is not null").groupBy("a").agg(F.max("best").alias("best")).collect()  # at most the first vocabulary
    best = np.zeros(max((r["a"] for r in tops), default=0) + 1, np.int64)
    for r in tops:
        best[r["a"]] = r["best"]
    scored = linked.select("row", "keys", "links").mapInArrow(_scorer(folder, manifest, spark.sparkContext.broadcast(best)), "row bigint, n_best bigint, count_sum bigint")
    scored = written(scored, "scores")
    done_with(report)
    drop_folder(spark, folder)
    parts = scored.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    heads = linked.where("n_a is not null").drop("keys", "links")
    return heads.join(parts, "row").select(F.col("_id").alias(id_col), *_NUMBERS, "n_best", "count_sum", "groups_sha256")
