"""SentencePiece BPE, encoded by a prefix table and decoded (operator 9).

An encoding by merges has two properties that the table rests on.  Every run of
neighbouring tokens of an encoding is the encoding of its own string; and a
sequence is the encoding of its string as soon as all neighbouring pairs are.
(Up to the first merge across a boundary, the two tokens beside it go through the
states they go through alone, since merges are taken by priority and, among equals,
from the left; so the same merge would happen in the pair alone.)

So each prefix of a text has one last token: of the vocabulary strings that end
there, the only one that is compatible with the last token of the prefix before it.
An automaton over the vocabulary gives the strings that end at each place, a memo of
pair tests (``merge`` over the two strings joined) tells which is compatible, and
ids are recovered backwards.  The work is linear in the text for any input.

A text is first cut where no merge can cross: between two characters that stand side
by side in no vocabulary string.  What lies between two cuts is encoded on its own,
so a bounded memo of such chunks answers most of a corpus.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterable

import ahocorasick
import public_tokenizers
from pyspark.sql import DataFrame

from .common import field, map_texts, on_leave

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Chunks and token pairs kept in a worker's memos; a memo holds at most twice that (see Memo).
MEMO_CHUNKS, MEMO_PAIRS, MEMO_LENGTH = 60_000, 200_000, 64
#: Chunks kept by the digests, whose worker holds nothing beside them; a pipeline does not use this memo.
SHOWN_CHUNKS = 240_000
_RUNS = re.compile(r"▁*[^\W\d_]+|▁+|(?:(?!▁)[\W\d_])+")
_OTHER = 1 << 21  # ids from here on stand for characters outside the vocabulary


class Memo(dict):
    """Values of a function by string; holds the last ``size`` to ``2 * size`` keys asked for.

    When it is full, its content becomes the older half and what that held before goes;
    frequent keys return from there.  Keys over MEMO_LENGTH characters aren't kept.
    """

    def __init__(self, function: Callable[[str], tuple], size: int) -> None:
        super().__init__()
        self.function, self.size, self.older = function, size, {}

    def __missing__(self, key: str) -> tuple:
        value = self.older.get(key)
        if value is None:
            value = self.function(key)
            if len(key) > MEMO_LENGTH:
                return value
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class PieceBPE:
    """Encoder and decoder over the strings and scores of a BPE model with byte fallback."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str]) -> None:
        """kinds: per id ``normal``, ``byte``, ``control`` or ``unknown``."""
        self.pieces, self.kinds = pieces, kinds
        self.ids = {p: i for i, p in enumerate(pieces) if kinds[i] == "normal"}
        self.scores = {p: scores[i] for p, i in self.ids.items()}
        self.bytes = [pieces.index(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.bytes)}
        self.joined = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.surfaces = [p.replace(SPACE, " ") if kinds[i] == "normal" else " ⁇ " if kinds[i] == "unknown" else "" for i, p in enumerate(pieces)]
        # an entry of a prefix table is a token and its length, in as many bits as the longest string needs
        self.shift = max(5, max(map(len, self.ids)).bit_length())
        self.mask, self.wide = (1 << self.shift) - 1, 22 + self.shift  # tokens take 22 bits at most
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, i << self.shift | len(p))
        self.automaton.make_automaton()
        self.backwards: dict = {}  # the same strings as a trie read from their ends
        for p, i in self.ids.items():
            node = self.backwards
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = i << self.shift | len(p)
        self.prefixes = Memo(self._last, MEMO_CHUNKS)
        self.shared = list(range(len(pieces)))  # one object per id in all memos
        self.pairs: dict[int, bool] = {}
        self.parts = Memo(self._uncut, MEMO_CHUNKS // 2)
        self.whole = Memo(self.chunk_ids, MEMO_CHUNKS)

    @classmethod
    def from_file(cls, path: str) -> PieceBPE:
        import sentencepiece

        s = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(s.get_piece_size())
        kinds = ["byte" if s.is_byte(i) else "control" if s.is_control(i) or s.is_unused(i) else "unknown" if s.is_unknown(i) else "normal" for i in n]
        return cls([s.id_to_piece(i) for i in n], [s.get_score(i) for i in n], kinds)

    def merge(self, text: str) -> list[str]:
        """The plain definition, for short strings: best score first, then leftmost."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, 0
            for k in range(len(parts) - 1):
                s = scores.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _string(self, entry: int) -> str:
        token = entry >> self.shift
        return chr(token - _OTHER) if token >= _OTHER else self.pieces[token]

    def _compatible(self, left: int, right: int) -> bool:
        """Both as entries of a prefix table; left: 0 at the start of a chunk."""
        want = [self._string(right)] if not left else [self._string(left), self._string(right)]
        known = self.merge("".join(want)) == want
        if len(self.pairs) >= MEMO_PAIRS:
            self.pairs.clear()
        self.pairs[left << self.wide | right] = known
        return known

    def _last(self, prefix: str) -> int:
        """Entry of a prefix, worked out from shorter ones and kept; prefixes are shared by many words."""
        node, ends = self.backwards, []
        for c in reversed(prefix):
            node = node.get(c)
            if node is None:
                break
            if "" in node:
                ends.append(node[""])
        pairs, kept, mask = self.pairs, self.prefixes, self.mask
        for entry in reversed(ends):
            shorter = prefix[: -(entry & mask)]
            left = kept[shorter] if shorter else 0
            fits = pairs.get(left << self.wide | entry)
            if fits or fits is None and self._compatible(left, entry):
                return entry
        return _OTHER + ord(prefix[-1]) << self.shift | 1

    def _table(self, chunk: str) -> list[int]:
        """The tokens of a chunk: its prefix table, read backwards.

        An entry holds the last token of a prefix and, in its lowest bits, that
        token's length.  Long chunks fill the table forwards in one pass over the
        automaton's matches; short ones ask for the prefixes they need.
        """
        out, k, shift, mask = [], len(chunk), self.shift, self.mask
        if k <= MEMO_LENGTH:
            while k:
                entry = self.prefixes[chunk[:k]]
                out.append(entry >> shift)
                k -= entry & mask
            out.reverse()
            return out
        pairs, last = self.pairs, [0] * (k + 1)
        done = 0
        for end, entry in self.automaton.iter(chunk):
            for j in range(done + 1, end + 1):  # prefixes that end in a character outside the vocabulary
                last[j] = last[j] or _OTHER + ord(chunk[j - 1]) << shift | 1
            done = end
            if not last[end + 1]:
                left = last[end + 1 - (entry & mask)]
                fits = pairs.get(left << self.wide | entry)
                if fits or fits is None and self._compatible(left, entry):
                    last[end + 1] = entry
        for j in range(done + 1, k + 1):
            last[j] = last[j] or _OTHER + ord(chunk[j - 1]) << shift | 1
        while k:
            entry = last[k]
            out.append(entry >> shift)
            k -= entry & mask
        out.reverse()
        return out

    def _uncut(self, chunk: str) -> tuple[int, ...]:
        tokens = self._table(chunk)
        if max(tokens) < _OTHER:
            return tuple([self.shared[t] for t in tokens])
        out: list[int] = []
        for token in tokens:
            if token >= _OTHER:
                out += [self.bytes[b] for b in chr(token - _OTHER).encode()]
            else:
                out.append(token)
        return tuple(out)

    def _cut(self, text: str) -> list[str]:
        """The text in parts, cut where letters meet others if no string spans the place."""
        if text.lstrip(SPACE).isalpha():
            return [text]
        parts: list[str] = []
        for run in _RUNS.findall(text):
            if parts and parts[-1][-1] + run[0] in self.joined:
                parts[-1] += run
            else:
                parts.append(run)
        return parts

    def chunk_ids(self, chunk: str) -> tuple[int, ...]:
        """Ids of a chunk as :meth:`split` gives them (blanks not yet replaced)."""
        parts = self._cut(chunk.replace(" ", SPACE))
        if len(parts) == 1:
            return self._uncut(parts[0])
        return tuple([i for part in parts for i in self.parts[part]])

    @functools.cached_property
    def _pattern(self) -> re.Pattern:
        # a line feed or the end of a word is a cut if no string of the vocabulary spans it
        cuts_words = all(SPACE not in p.lstrip(SPACE) for p in self.ids)
        feed = "\n" if not any("\n" in p for p in self.joined) else ""
        if not cuts_words:
            return re.compile("(?s).+")
        return re.compile(f" *[^ {feed}]+| +" + (f"|{feed}" if feed else ""))

    def split(self, text: str) -> list[str]:
        """Chunks of the text with its dummy blank in front; nothing merges across them."""
        return self._pattern.findall(" " + text.replace(SPACE, " ")) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for chunk in self.split(text) for i in self.whole[chunk]]

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids: bytes joined to characters (each faulty byte U+FFFD), blanks back, the first piece's dummy blank off."""
        ids = list(ids)
        first = next((i for i in ids if self.kinds[i] != "control"), None)
        text = self._surface(ids)
        return text[1:] if first is not None and self.kinds[first] == "normal" and text.startswith(" ") else text

    def _surface(self, ids: Iterable[int]) -> str:
        surfaces, byte_of = self.surfaces, self.byte_of
        if byte_of.keys().isdisjoint(ids):
            return "".join([surfaces[i] for i in ids])
        out: list[str] = []
        held = bytearray()
        for i in ids:
            if i in byte_of:
                held.append(byte_of[i])
                continue
            if held:
                out.append(_characters(bytes(held)))
                held.clear()
            out.append(surfaces[i])
        if held:
            out.append(_characters(bytes(held)))
        return "".join(out)


def _characters(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        pass
    out, k = [], 0
    while k < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[k : k + n].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            n = 1
        k += n
    return "".join(out)


@functools.lru_cache(maxsize=2)
def load(path: str) -> PieceBPE:
    """One per worker process and file; workers keep it from task to task."""
    return PieceBPE.from_file(path)


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """Per row its ids and the text decoded from them: ``id, ids array<int>, decoded string``.

    A null text counts as empty: no ids, empty text.  Rows stay as they are, repeated
    ones and null ids too; other columns are dropped; an empty table gives an empty
    table.  ``model`` is a path that every executor can open (the tokenizer package is
    installed on each).
    """
    path = model or public_tokenizers.path(MODEL)

    def run(texts: list) -> list:
        bpe = load(path)
        ids = [bpe.encode(t or "") for t in texts]
        return [ids, [bpe.decode(i) for i in ids]]

    return map_texts(docs, [id_col], text_col, run, [field("ids", "array<int>"), field("decoded", "string")])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256`` per row: :func:`encode_decode` as digests; the ids are never shipped.

    Nulls, repeats, other columns and empty tables are handled alike.
    """
    path = model or public_tokenizers.path(MODEL)

    def run(texts: list) -> list:
        bpe = load(path)
        shown = _shown(path)
        counts, ids, decoded = [], [], []
        for t in texts:
            got = [shown[c] for c in bpe.split(t or "")]
            counts.append(sum([x[0] for x in got]))
            ids.append(hashlib.sha256(",".join([x[1] for x in got]).encode()).hexdigest())
            text = "".join([x[2] for x in got])
            decoded.append(hashlib.sha256(text.removeprefix(" ").encode()).hexdigest())
        return [counts, ids, decoded]

    return map_texts(docs, [id_col], text_col, run, [field("n_tokens", "long"), field("ids_sha256", "string"), field("decoded_sha256", "string")])


@functools.lru_cache(maxsize=2)
def _shown(path: str) -> Memo:
    """Per chunk: number of ids, ids as text, text decoded from the ids.

    Chunks hold whole characters, so what is decoded chunk by chunk joins to the
    decoding of all ids.
    """
    bpe = load(path)

    def show(chunk: str) -> tuple[int, str, str]:
        ids = bpe.chunk_ids(chunk)
        return len(ids), ",".join(map(str, ids)), bpe._surface(ids)

    return Memo(show, SHOWN_CHUNKS)


on_leave(__name__, lambda: (load.cache_clear(), _shown.cache_clear()))
