"""Secret scans (operator 5): keywords, then anchored patterns, then checksums.

One Aho-Corasick pass over the ASCII-lowered text finds keywords.  Only at a keyword is
the pattern of its kind tried, anchored there; a match inside the previous match of its
kind is passed over, which gives exactly the leftmost non-overlapping matches, since
every match starts with one of the kind's keywords.  Long hexadecimal runs have no
keyword; of every 24 neighbouring characters of such a run one has a place divisible
by 24, so only those places are looked at and a hit there is widened both ways.

Beyond the base kinds, spans are added whose own structure proves them: tokens that
embed a CRC-32 in base 62, signed web tokens whose header decodes, and private key blocks
whose body decodes to a key's outer structure.

Every kind's work is linear in the text: what a failed try has read is not read again by
the tries that start inside it.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import re
import zlib
from collections.abc import Callable

import ahocorasick
from pyspark.sql import DataFrame

from .common import field, map_texts

# The base kinds, in their order, and the published token formats.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CHECKED_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
KINDS = ("assign", "access", "hex", "checked", "webtoken", "keyblock")
BASE_KINDS = KINDS[:3]
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def embedded_checksum(token: str) -> bool:
    """The last six characters are the CRC-32 of the part between prefix and them, in base 62."""
    body, check = token[4:-6], token[-6:]
    value, digits = zlib.crc32(body.encode()), ""
    while value:
        value, d = divmod(value, 62)
        digits = DIGITS[d] + digits
    return digits.rjust(6, "0") == check


def decodable_header(token: str) -> bool:
    """Three dotted parts, the first of which is a JSON object with an algorithm."""
    head = token.split(".")[0]
    try:
        found = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, RecursionError):  # brackets nested thousands deep aren't a header either
        return False
    return isinstance(found, dict) and "alg" in found


def key_structure(block: str) -> bool:
    """The body between the marks is base 64 of a DER sequence or of an OpenSSH key, or is said to be encrypted."""
    body = block.split("KEY-----", 1)[1].rpartition("-----END")[0].replace("\\n", "\n")
    lines = body.split("\n")
    if any(":" in x for x in lines):
        return any(x.startswith("Proc-Type: 4,ENCRYPTED") for x in lines)
    try:
        data = base64.b64decode("".join(body.split()), validate=True)
    except ValueError:
        return False
    return len(data) >= 16 and (data[0] == 0x30 or data.startswith(b"openssh-key-v1\0"))


class _Kind:
    def __init__(self, pattern: str, words: tuple[str, ...], accept: Callable[[re.Match], bool], flags: int = 0) -> None:
        self.words, self.accept, self.match = words, accept, re.compile(pattern, re.ASCII | flags).match


_ANCHORED = {
    "assign": _Kind(ASSIGN.replace("(password|passwd|secret|token|api_?key)", "((?i:password|passwd|secret|token|api_?key))"), ASSIGN_WORDS, lambda m: len(m[2]) >= ASSIGN_LEAST),
    "access": _Kind(ACCESS, ("akia",), lambda m: len(m[0]) >= ACCESS_LEAST),
    "checked": _Kind(r"(?:gh[pousr]|npm)_[A-Za-z0-9]{36}(?![A-Za-z0-9])", CHECKED_PREFIXES, lambda m: embedded_checksum(m[0])),
    "webtoken": _Kind(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", ("eyj",), lambda m: decodable_header(m[0])),
    "keyblock": _Kind(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?!-----)[\x20-\x7E\s])*-----END [A-Z ]*PRIVATE KEY-----", ("-----begin ",), lambda m: key_structure(m[0])),
}
#: The first part of a web token: where the try at its start fails, all later starts in it fail.
_first_part = re.compile(r"[A-Za-z0-9_-]+").match
_HEX = frozenset("0123456789abcdef")


@functools.cache
def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, k in _ANCHORED.items():
        for word in k.words:
            out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


def _hex_runs(text: str) -> list[tuple[int, int]]:
    out, n, end, digits = [], len(text), 0, _HEX
    sampled = text[HEX_LEAST - 1 :: HEX_LEAST]
    for k, c in enumerate(sampled):
        if c not in digits:
            continue
        lo = hi = k * HEX_LEAST + HEX_LEAST - 1
        if lo < end:
            continue
        while lo > end and text[lo - 1] in digits:
            lo -= 1
        while hi < n and text[hi] in digits:
            hi += 1
        end = hi
        if hi - lo >= HEX_LEAST:
            out.append((lo, hi))
    return out


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """All spans ``(kind, start, end)`` in code points, by start, then by the order of KINDS."""
    lowered = text.encode().lower().decode()  # ASCII only: places stay
    hits: dict[str, list[int]] = {}
    for end, (kind, n) in _automaton().iter(lowered):
        hits.setdefault(kind, []).append(end - n + 1)
    out = []
    for kind, starts in hits.items():
        k, over, dead = _ANCHORED[kind], 0, 0
        for start in sorted(set(starts)):
            if start < over or start < dead:
                continue
            if m := k.match(text, start):
                over = m.end()
                if k.accept(m):
                    out.append((kind, start, over))
            elif kind == "webtoken":
                dead = _first_part(text, start).end()
    out += [("hex", lo, hi) for lo, hi in _hex_runs(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``id, spans array<struct<kind, start, end>>``; a null text counts as empty.

    Rows stay as they are, repeated ones too; other columns are dropped; an empty table gives
    an empty table; no shuffle.
    """

    def run(texts: list) -> list:
        return [[[dict(zip(("kind", "start", "end"), s)) for s in find_spans(t or "")] for t in texts]]

    return map_texts(docs, [id_col], text_col, run, [field("spans", "array<struct<kind:string,start:bigint,end:bigint>>")])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_assign, n_access, n_hex, base_sha256, spans`` per row, in the order of :func:`find_spans`.

    A null text counts as empty: counts of 0, the digest of nothing, no spans.  Rows stay
    as they are, repeated ones too, null ids too; other columns are dropped; an empty
    table gives an empty table; no shuffle.
    """

    def shown(spans: list) -> str:
        return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)

    def run(texts: list) -> list:
        found = [find_spans(t or "") for t in texts]
        counts = [[sum(s[0] == k for s in f) for f in found] for k in BASE_KINDS]
        base = [hashlib.sha256(shown([s for s in f if s[0] in BASE_KINDS]).encode()).hexdigest() for f in found]
        return [*counts, base, [shown(f) for f in found]]

    return map_texts(docs, [id_col], text_col, run, [field("n_assign", "long"), field("n_access", "long"), field("n_hex", "long"), field("base_sha256", "string"), field("spans", "string")])


def redact(text: str | None, mark: str = "[REDACTED]") -> str | None:
    """The text with every span, overlapping ones joined, replaced; null stays null."""
    if text is None:
        return None
    out, at = [], 0
    for _, start, end in find_spans(text):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text
