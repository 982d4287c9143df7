"""Token counts by the whole-token shortcut (operator 3).

Byte-level BPE cuts a text into pre-tokens by a pattern and merges each alone.  Offline,
once per vocabulary and before any task, merging every vocabulary string proves which of
them encode alone as exactly one token; the set is shipped to the workers.  A pre-token
found in it counts one and is never merged; only the rest is, and a bounded memo keeps the
counts of the rest.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterable

import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field, map_texts, on_leave
from .piece_bpe import Memo

VOCABULARY = "byte_bpe_50k.json"
MEMO_COUNTS = 150_000

# The published split pattern of byte-level BPE, with white space by its
# Unicode property, as the library has it.
_SPACE = r"\p{White_Space}"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|{_SPACE}+(?!\P{{White_Space}})|{_SPACE}+"


def _narrow() -> re.Pattern:
    """The same pattern for texts below U+0250, with the classes spelled out, for the faster engine."""
    low = [chr(i) for i in range(0x250)]
    letters, numbers, spaces = (_ranges([c for c in low if regex.match(k, c)]) for k in (r"\p{L}", r"\p{N}", _SPACE))
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+")


def _ranges(chars: list[str]) -> str:
    out, k = [], 0
    while k < len(chars):
        j = k
        while j + 1 < len(chars) and ord(chars[j + 1]) == ord(chars[j]) + 1:
            j += 1
        out.append(f"\\u{ord(chars[k]):04x}-\\u{ord(chars[j]):04x}")
        k = j + 1
    return "".join(out)


def _byte_characters() -> dict[int, str]:
    """The published byte-to-character table: printable Latin-1 bytes stand for themselves, others for U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class ByteBPE:
    """Counts tokens of a byte-level BPE file of the ``tokenizers`` library."""

    def __init__(self, path: str, whole: frozenset[str] | None = None) -> None:
        """``whole``: the proven set where it is known already."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["normalizer"] or spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only byte-level BPE without a normalizer or prefix space is supported")
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ranks = {(a, b): k for k, (a, b) in enumerate(merges)}
        self.letters = _byte_characters()
        self.table = {b: self.letters[b] for b in range(256)}
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.ignore = spec["model"].get("ignore_merges", False)
        self.vocabulary = spec["model"]["vocab"]
        self.whole = self._prove() if whole is None else whole
        self.counts = Memo(self._count, MEMO_COUNTS)
        self.wide, self.narrow, self.beyond = regex.compile(PATTERN), _narrow(), re.compile("[^\\u0000-\\u024f]")

    def _prove(self) -> frozenset[str]:
        """Texts of the vocabulary strings that merge to one token when alone."""
        back = {c: b for b, c in self.letters.items()}
        out = []
        for shown in self.vocabulary:
            if self.ignore or len(self.merge(shown)) == 1:
                try:
                    out.append(bytes(back[c] for c in shown).decode())
                except (UnicodeDecodeError, KeyError):  # no text of its own
                    continue
        return frozenset(out)

    def merge(self, shown: str) -> list[str]:
        """Lowest rank first, then leftmost.  Long pre-tokens go through a heap: n log n for any input."""
        parts, ranks = list(shown), self.ranks
        if len(parts) > 200:
            return self._merge_long(parts)
        while len(parts) > 1:
            found = [ranks.get(p, _NONE) for p in zip(parts, parts[1:])]
            best = min(found)
            if best == _NONE:
                break
            at = found.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        n, ranks = len(parts), self.ranks
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(ranks[p], k, *p) for k, p in enumerate(zip(parts, parts[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = after[k] if alive[k] else n
            if j >= n or parts[k] != a or parts[j] != b:
                continue
            parts[k], alive[j], after[k] = a + b, False, after[j]
            if after[j] < n:
                before[after[j]] = k
                if (r := ranks.get((parts[k], parts[after[k]]))) is not None:
                    heapq.heappush(heap, (r, k, parts[k], parts[after[k]]))
            if before[k] >= 0 and (r := ranks.get((parts[before[k]], parts[k]))) is not None:
                heapq.heappush(heap, (r, before[k], parts[before[k]], parts[k]))
        return [p for p, x in zip(parts, alive) if x]

    def _count(self, piece: str) -> int:
        return len(self.merge(piece.encode().decode("latin-1").translate(self.table)))

    def pre_tokens(self, text: str) -> list[str]:
        return (self.wide if self.beyond.search(text) else self.narrow).findall(text)

    def count(self, text: str) -> int:
        if self.added and "<" in text:  # added strings are one token each, cut out before all else
            spans = self.added.split(text)
            return sum(map(self._plain, spans)) + len(spans) - 1
        return self._plain(text)

    def _plain(self, text: str) -> int:
        whole, counts = self.whole, self.counts
        return sum([1 if p in whole else counts[p] for p in self.pre_tokens(text)])


_NONE = 1 << 60


@functools.lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    """One per process and file."""
    return ByteBPE(path)


_loaded: dict[str, ByteBPE] = {}
on_leave(__name__, _loaded.clear)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, limit: int = 1024) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` per row, one pass, no shuffle.

    Counts equal the library's for the file, without begin or end tokens; an added
    special string inside a text is one token, as by the library's default.  A null text
    counts as empty (0, 0, false); rows stay as they are, repeated ones and null ids too;
    other columns are dropped; an empty table gives an empty table.  ``vocabulary`` is a
    path that driver and executors can open.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    proven = docs.sparkSession.sparkContext.broadcast(load(path).whole)  # part of the vocabulary, a fixed file

    def run(texts: Iterable) -> list:
        if path not in _loaded:  # workers keep it from task to task
            _loaded[path] = ByteBPE(path, proven.value)
        bpe = _loaded[path]
        whole = [t or "" for t in texts]
        return [[len(t.encode()) for t in whole], [bpe.count(t) for t in whole]]

    out = map_texts(docs, [id_col], text_col, run, [field("n_bytes", "long"), field("n_tokens", "long")])
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
