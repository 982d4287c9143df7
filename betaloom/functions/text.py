"""Text functions as column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def normalize(text: Column) -> Column:
    """Lower-case words: cut where lower meets upper case, letters meet digits, and at other characters."""
    x = F.regexp_replace(F.trim(text), r"([a-z])([A-Z])", "$1 $2")
    x = F.regexp_replace(x, r"[_\-/]+", " ")
    x = F.regexp_replace(F.regexp_replace(x, r"([0-9])([^0-9])", "$1 $2"), r"([^0-9])([0-9])", "$1 $2")
    x = F.regexp_replace(x, r"[^a-zA-Z0-9\s]+", " ")
    return F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))


def features(text: Column) -> Column:
    """``struct<raw, norm, tokens, nums, words>``."""
    norm = normalize(text)
    tokens = F.filter(F.split(norm, " "), lambda t: t != "")
    number = lambda t: t.rlike("^[0-9]+$")
    return F.struct(text.alias("raw"), norm.alias("norm"), tokens.alias("tokens"), F.filter(tokens, number).alias("nums"), F.filter(tokens, lambda t: ~number(t)).alias("words"))


def jaccard(a: Column, b: Column) -> Column:
    """Of distinct elements; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def number_match(a: Column, b: Column) -> Column:
    """1 if neither has numbers, 0.6 if one has, else their Jaccard similarity."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.6)).otherwise(jaccard(a, b))


def count_penalty(a: Column, b: Column, gamma: float = 2.0) -> Column:
    """exp(-gamma |a - b| / max(a, b)); 1 if both are 0."""
    return F.when(F.greatest(a, b) == 0, F.lit(1.0)).otherwise(F.exp(-F.lit(gamma) * F.abs(a - b) / F.greatest(a, b)))


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of many pairs, by bit-parallel rows of all pairs at once.

    Pairs whose shorter string is over 64 characters take rows of any width, one by one.
    """
    out = np.zeros(len(a), np.int64)
    short, long = zip(*((x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b))) if len(a) else ((), ())
    small = np.array([0 < len(x) <= 64 for x in short], bool)
    for k in np.flatnonzero(~small):
        out[k] = _lcs(short[k], long[k])
    chosen = np.flatnonzero(small)
    for lo in range(0, len(chosen), 4096):
        at = chosen[lo : lo + 4096]
        x, y = _codes([short[k] for k in at], 64), _codes([long[k] for k in at])
        row = np.full(len(at), ~np.uint64(0))
        for c in y.T:
            hit = np.packbits((x == c[:, None]) & (c[:, None] > 0), axis=1, bitorder="little").view(np.uint64)[:, 0]
            met = row & hit
            row = (row + met) | (row & ~hit)
        used = np.array([len(short[k]) for k in at], np.uint64)
        mask = ~np.uint64(0) >> (np.uint64(64) - used)
        out[at] = np.bitwise_count(~row & mask)
    return out


def lcs_with(texts: list[str]) -> Callable[[str], np.ndarray]:
    """Of texts of one length: gives their longest common subsequences with a text; common ends are gone through once."""
    order = sorted(range(len(texts)), key=lambda k: texts[k][::-1])
    x = _codes([texts[k][::-1] for k in order]) if texts and texts[0] else np.zeros((len(texts), 0), np.uint32)
    letters, x = np.unique(x, return_inverse=True)
    x = x.reshape(len(texts), -1)
    steps, new, before = [], np.arange(len(texts)) == 0, np.zeros(len(texts), np.int64)
    for c in x.T:
        new = new | np.r_[False, c[1:] != c[:-1]]
        steps.append((before[new] if new.sum() != before[-1] + 1 else None, c[new]))
        before = np.cumsum(new) - 1
    back = np.empty(len(texts), np.int64)
    back[order] = before

    def run(text: str) -> np.ndarray:
        if len(text) > 64:
            return lcs_lengths([text] * len(texts), texts)
        masks = np.array([sum(1 << k for k, t in enumerate(reversed(text)) if ord(t) + 1 == v) for v in letters.tolist()], np.uint64)
        row = np.full(1, ~np.uint64(0))
        for parent, c in steps:
            if parent is not None:
                row = row[parent]
            hit = masks[c]
            met = row & hit
            row = (row + met) | (row & ~hit)
        mask = (1 << len(text)) - 1
        return np.bitwise_count(~row & np.uint64(mask)).astype(np.int64)[back]

    return run


def _codes(texts: list[str], width: int | None = None) -> np.ndarray:
    """Characters plus one, a row a text; what is beyond a text is 0."""
    width = width or max(map(len, texts))
    out = np.zeros((len(texts), width), np.uint32)
    for k, t in enumerate(texts):
        out[k, : len(t)] = np.frombuffer(t.encode("utf-32-le"), np.uint32) + 1
    return out


def _lcs(a: str, b: str) -> int:
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & masks.get(c, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def token_sort_similarity(a: Column, b: Column) -> Column:
    """2 LCS / (both lengths) of the sorted tokens joined by a blank, 1 if both are empty; in Arrow batches."""
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        sizes = x.str.len().to_numpy() + y.str.len().to_numpy()
        return pd.Series(np.where(sizes == 0, 1.0, 2 * lcs_lengths(x.tolist(), y.tolist()) / np.maximum(sizes, 1)))

    joined = lambda t: F.array_join(F.array_sort(t), " ")
    return run(joined(a), joined(b))


# Patterns of sensitive text and their marks, applied in this order.
SENSITIVE = (
    (r"(sk-ant-[a-zA-Z0-9_-]{10,})", "sk-ant-<REDACTED>"),
    (r"\b(sk-(?!ant-|<)[a-zA-Z0-9_-]{10,})", "sk-<REDACTED>"),
    (r"([\p{L}\p{N}_.-]+@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+)", "<EMAIL_REDACTED>"),
)


def redact(text: Column) -> Column:
    """Sensitive text replaced by marks.

    A pattern is tried only where its fixed part occurs.  An address is tried once a run
    of its characters, at the run's start or after the match before: elsewhere in the run
    it can't begin, and trying it would be quadratic.
    """
    runs = r"(?:\G|(?<![\p{L}\p{N}_.-]))"
    for (pattern, mark), part in zip(SENSITIVE, ("sk-ant-", "sk-", "@")):
        anchored = runs + pattern.replace(r"_.-]+@", r"_.-]++@") if part == "@" else pattern
        text = F.when(text.contains(part), F.regexp_replace(text, anchored, mark)).otherwise(text)
    return text


def truncate(text: Column, length: int = 200, mark: str = "...<truncated>") -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit(mark))).otherwise(text)


def accessions(text: Column, prefix: str = "GSE") -> Column:
    """All matches of the prefix and digits, as written."""
    return F.regexp_extract_all(text, F.lit(f"(?i)({prefix}[0-9]+)"), 1)


def append_list(text: Column, values: Column, title: str = "Datasets of Interest") -> Column:
    return F.when(F.size(values) > 0, F.concat(text, F.lit(f"\n{title}: "), F.array_join(values, ", "))).otherwise(text)


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _pairs(values: Column) -> Column:
    """``key: value`` strings as structs; the part after a second colon is lost."""
    parts = F.transform(F.filter(values, lambda v: v.contains(":")), lambda v: F.split(v, ":"))
    return F.transform(parts, lambda p: F.struct(F.trim(p[0]).alias("key"), F.trim(p[1]).alias("value")))


def _last(pairs: Column) -> Column:
    """Of equal keys the last."""
    return named(pairs, lambda x: F.filter(x, lambda p, i: ~F.exists(F.slice(x, i + 2, F.size(x)), lambda q: q["key"] == p["key"])))


def key_values(values: Column) -> Column:
    """``key: value`` strings to a map: the part after a second colon is lost, the last of equal keys wins."""
    # keep the last of equal keys by hand: duplicate keys are an error by Spark's default
    return F.map_from_entries(_last(_pairs(values)))


def value_of_key(values: Column, key: str) -> Column:
    """The value of the first key of :func:`key_values` that equals ``key`` but for case."""
    alike = F.filter(_pairs(values), lambda e: F.lower(e["key"]) == key.lower())
    return F.get(_last(alike), F.lit(0))["value"]


def json_object(text: Column, path: str) -> Column:
    """A path of the JSON text, or of its first brace-to-brace span if the text isn't JSON."""
    return F.coalesce(F.get_json_object(text, path), F.get_json_object(F.regexp_extract(text, r"(?s)\{.*\}", 0), path))


def slugify(text: Column) -> Column:
    """ASCII letters by compatibility decomposition, words joined by dashes; Spark has no normalizer, so in Arrow batches."""
    @F.pandas_udf(StringType())
    def run(x: pd.Series) -> pd.Series:
        def one(v: str | None) -> str | None:
            if v is None:
                return None
            v = unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode().lower()
            return re.sub(r"[-\s]+", "-", re.sub(r"[^\w\s-]", "", v)).strip("-_")

        return x.map(one)

    return run(text)


def numeric_like(text: Column) -> Column:
    """Number in a shown text: currency, percent, accounting negatives, thousands and K/M/B/T; null otherwise."""
    x = F.regexp_replace(F.trim(text), r"[$€£¥,\s]", "")
    negative = x.rlike(r"^\(.*\)$")
    x = F.regexp_replace(x, r"[()]", "")
    unit = F.upper(F.regexp_extract(x, r"([KMBTkmbt])$", 1))
    factor = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).when(unit == "T", 1e12).otherwise(1.0)
    number = F.regexp_replace(x, r"[KMBTkmbt%]$", "").try_cast("double")
    return F.when(negative, -number).otherwise(number) * factor
