"""Byte-pair encoding by backtracking, and decoding by an offset table (operator 13).

The merges of a vocabulary have an order, and a token is always made after its parts.  So
merging goes through the ranks upwards, from the left among equals, and whether two tokens
stay apart can be told from the two alone: going back from both, last merge first, the pair
that faces the boundary must never have had a merge that came before the one that ended its
state.  A sequence of tokens is the exact encoding of its string as soon as all neighbouring
pairs stay apart, and each prefix of a string has one encoding.

The encoder takes the longest token at a place (from an Aho-Corasick automaton's matches),
looks the pair up in the table of compatible pairs, tries the next shorter token that is a
prefix of it where they don't fit, and goes back a token where none fits.  A place from which
it went back is never entered again, so the work is linear in the text for any input.

Decoding gathers token strings from one buffer by a table of offsets.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import struct
from collections.abc import Iterable, Sequence

import ahocorasick
import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame

from .common import field, map_texts, on_leave
from .piece_bpe import Memo
from .token_counts import _byte_characters, _ranges

VOCABULARY = "word_bpe_49k.json"
#: Words and token pairs kept in a worker; a memo of words holds at most twice that (see Memo).
MEMO_WORDS, MEMO_PAIRS = 200_000, 1_000_000
_WIDE = 20  # bits of a token id in a pair's key
_NEVER = 1 << 60


class Backtracking:
    """Encoder of one word at a time: strings over bytes, the last one of a word marked if the vocabulary has a suffix for it.

    Inside, a byte is the character of its number, a marked one that of its number plus 256.
    """

    def __init__(self, vocabulary: dict[str, int], merges: Sequence, suffix: str = "") -> None:
        self.suffix = suffix
        back = {c: chr(b) for b, c in _byte_characters().items()}

        def inner(shown: str) -> str | None:
            marked = bool(suffix) and shown.endswith(suffix) and shown != suffix
            try:
                out = "".join([back[c] for c in (shown.removesuffix(suffix) if marked else shown)])
            except KeyError:
                return None
            return out[:-1] + chr(ord(out[-1]) + 256) if marked else out

        strings = {i: s for shown, i in vocabulary.items() if (s := inner(shown))}
        if max(strings) >> _WIDE:
            raise ValueError("the vocabulary is too large for the keys of pairs")
        by_string = {s: i for i, s in strings.items()}
        n = max(strings) + 1
        # of each token that encodes alone as itself: the rank of its last merge (letters: -1) and its two parts
        self.rank, self.left, self.right, self.joins = [_NEVER] * n, [0] * n, [0] * n, {}
        for i, s in strings.items():
            if len(s) == 1:
                self.rank[i] = -1
        pairs = []
        for r, m in enumerate(merges):
            a, b = (by_string.get(inner(x)) for x in (m.split(" ") if isinstance(m, str) else m))
            pairs.append((r, a, b, by_string[strings[a] + strings[b]]))
            self.joins[a << _WIDE | b] = r
        made: dict[int, int] = {}
        for r, _, _, whole in pairs:
            made.setdefault(whole, r)
        if any(made.get(a, -1) >= r or made.get(b, -1) >= r for r, a, b, _ in pairs):
            raise ValueError("a merge comes before its parts are made")
        for r, a, b, whole in pairs:
            if self.rank[whole] == _NEVER and self.rank[a] < r and self.rank[b] < r and self.apart(a, b, r):
                self.rank[whole], self.left[whole], self.right[whole] = r, a, b
        self.ids = {s: i for i, s in strings.items() if self.rank[i] < _NEVER}
        self.length = [len(strings.get(i, "")) for i in range(n)]
        self.shorter = [-1] * n  # the longest token that is a prefix of this one
        self.automaton = ahocorasick.Automaton()
        for s, i in self.ids.items():
            self.automaton.add_word(s, i)
            self.shorter[i] = next((self.ids[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in self.ids), -1)
        self.automaton.make_automaton()
        self.table: dict[int, bool] = {}

    def apart(self, a: int, b: int, limit: int = _NEVER) -> bool:
        """Whether ``a`` and ``b``, side by side, stay two tokens through all merges of a rank below ``limit``."""
        rank, joins = self.rank, self.joins
        while joins.get(a << _WIDE | b, _NEVER) >= limit:
            # of equal tokens the left one is made first, so the right one is taken apart first
            if rank[a] > rank[b]:
                limit, a = rank[a], self.right[a]
            elif rank[b] >= 0:
                limit, b = rank[b] + 1, self.left[b]
            else:
                return True
        return False

    def _apart(self, key: int) -> bool:
        known = self.apart(key >> _WIDE, key & ((1 << _WIDE) - 1))
        if len(self.table) >= MEMO_PAIRS:
            self.table.clear()
        self.table[key] = known
        return known

    def word(self, text: str) -> str:
        s = text.encode().decode("latin-1")
        return s[:-1] + chr(ord(s[-1]) + 256) if self.suffix else s

    def encode(self, word: str) -> list[int]:
        """Ids of a word as :meth:`word` gives it."""
        if not word:
            return []
        known = self.ids.get(word)
        if known is not None:
            return [known]
        n, length, shorter, table = len(word), self.length, self.shorter, self.table
        longest = [-1] * n
        for end, token in self.automaton.iter(word):  # ends rise, so the longest token of a start comes last
            longest[end + 1 - length[token]] = token
        out: list[int] = []
        closed = bytearray(n + 1)
        at, token = 0, longest[0]
        while at < n:
            end = at + length[token]
            if not closed[end]:
                if not out:
                    fits = True
                else:
                    key = out[-1] << _WIDE | token
                    fits = table.get(key)
                    if fits is None:
                        fits = self._apart(key)
                if fits:
                    out.append(token)
                    at = end
                    token = longest[at] if at < n else -1
                    continue
            token = shorter[token]
            while token < 0:
                closed[at] = 1
                token = out.pop()
                at -= length[token]
                token = shorter[token]
        return out


class Classes(dict):
    """For ``str.translate``: characters beyond ASCII as one that stands for their class.

    The class of a character (letter, number, white space, other) is asked of the file's own
    pre-tokenizer, once per character, so that it holds for the library's version of Unicode.
    """

    def __init__(self, pre_tokenizer) -> None:
        super().__init__((c, chr(c)) for c in range(128))
        self.pieces = lambda s: len(pre_tokenizer.pre_tokenize_str(s))
        self.drops_white = not self.pieces(" ")
        low = {k: [c for c in map(chr, range(0x180)) if self.kind(c) == k] for k in "LNWO"}
        self.stands = {k: next(c for c in v if c > "\x7f") for k, v in low.items()}
        self.ranges = {k: _ranges(v) for k, v in low.items()}

    def kind(self, c: str) -> str:
        if self.drops_white and not self.pieces(c):
            return "W"
        if self.pieces("a" + c) == 1:
            return "L"
        if self.pieces("!" + c) == 1:
            return "O"
        return "N" if self.drops_white or self.pieces("1" + c) == 1 else "W"

    def __missing__(self, code: int) -> str:
        self[code] = self.stands[self.kind(chr(code))]
        return self[code]

    def pieces_of(self, pattern: re.Pattern, text: str) -> list[str]:
        """Matches of a pattern that is spelled out for characters below U+0180."""
        return [text[m.start() : m.end()] for m in pattern.finditer(text.translate(self))]


class WordBPE:
    """A word-end BPE file of the ``tokenizers`` library: lower-cased words, split by the published pattern."""

    # Fixed value: the published split pattern of this kind of vocabulary.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or model["ignore_merges"] or split["pattern"].get("Regex") != self.PATTERN or steps != ["NFC", "Replace", "Lowercase"] or spec["decoder"]:
            raise ValueError("only word-end BPE of lower-cased words is supported")
        library = Tokenizer.from_file(path)
        self.normalize, self.classes = library.normalizer.normalize_str, Classes(library.pre_tokenizer)
        r = self.classes.ranges
        self.pattern = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{r['L']}]+|[{r['N']}]|[^{r['W']}{r['L']}{r['N']}]+")
        # below U+0180 nothing composes and lower case stays below, but for U+0130
        self.beyond = re.compile("[^\\u0000-\\u012f\\u0131-\\u017f]")
        self.bpe = Backtracking(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        shown = dict(sorted({i: s for s, i in (model["vocab"] | self.added).items()}.items()))
        parts = [(shown.get(i, "") + " ").encode() for i in range(max(shown) + 1)]
        self.buffer = np.frombuffer(b"".join(parts), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        self.known = Memo(self._word, MEMO_WORDS)

    def _word(self, word: str) -> bytes:
        """Ids of a word as little-endian 32-bit numbers."""
        if word in self.added:  # words hold no added string: the text has been cut at them
            ids = [self.added[word]]
        else:
            ids = self.bpe.encode(self.bpe.word(word))
        return struct.pack(f"<{len(ids)}I", *ids)

    def words(self, text: str) -> list[str]:
        """Words and added strings of the text, in order; each is encoded alone."""
        if self.specials is None or "<" not in text:
            return self._plain(text)
        out: list[str] = []
        for k, part in enumerate(self.specials.split(text)):  # odd places hold the added strings
            out += [part] if k % 2 else self._plain(part)
        return out

    def _plain(self, text: str) -> list[str]:
        if self.beyond.search(text):
            return self.classes.pieces_of(self.pattern, self.normalize(text))
        return self.pattern.findall(text.lower())

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.words(text))), "<u4")

    def decode(self, ids: Iterable[int]) -> str:
        """The strings of the tokens, joined by blanks, as the library does for a file without decoder."""
        return self.decoded(ids).decode()

    def decoded(self, ids: Iterable[int]) -> bytes:
        """:meth:`decode` in UTF-8: one gather from the buffer of all strings."""
        ids = np.asarray(list(ids) if not isinstance(ids, np.ndarray) else ids, np.int64)
        if not len(ids):
            return b""
        starts, lengths = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)
        return self.buffer[at[:-1]].tobytes()


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordBPE:
    """One per worker process and file; workers keep it from task to task."""
    return WordBPE(path)


on_leave(__name__, load.cache_clear)


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Per row its ids and the text decoded from them: ``id, ids array<int>, decoded string``.

    Ids equal the library's without begin or end tokens; an added special string inside a
    text is one token.  A null text counts as empty: no ids, empty text.  Rows stay as they
    are, repeated ones and null ids too; other columns are dropped; an empty table gives an
    empty table.  ``vocabulary`` is a path that every executor can open.  No shuffle.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(texts: list) -> list:
        bpe = load(path)
        ids = [bpe.encode(t or "") for t in texts]
        return [[i.tolist() for i in ids], [bpe.decode(i) for i in ids]]

    return map_texts(docs, [id_col], text_col, run, [field("ids", "array<int>"), field("decoded", "string")])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256`` per row: :func:`encode_decode` as digests, ids as little-endian 32-bit numbers.

    Nulls, repeats, other columns and empty tables are handled alike.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(texts: list) -> list:
        bpe = load(path)
        counts, ids, decoded = [], [], []
        for t in texts:
            got = bpe.encode(t or "")
            counts.append(len(got))
            ids.append(hashlib.sha256(got.tobytes()).hexdigest())
            decoded.append(hashlib.sha256(bpe.decoded(got)).hexdigest())
        return [counts, ids, decoded]

    return map_texts(docs, [id_col], text_col, run, [field("n_tokens", "long"), field("ids_sha256", "string"), field("decoded_sha256", "string")])
