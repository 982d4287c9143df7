"""Quality rules by tokeniser fertility (operator 7).

A public vocabulary that knows a language encodes its words in few tokens, rarely falls
back to bytes and uses many different tokens; junk does the opposite.  Per text the
operator measures characters per token, the share of byte-fallback tokens and the
entropy of its tokens, and rejects what lies outside the bands of the text's main script.
The bands are calibrated on the whole table: quartiles of each script's texts, widened by
a multiple of the distance between them.  Entropy is taken over blocks of as many tokens
as TOKENS, as a share of what as many different tokens would have, so that it means the
same for texts of any length.
Beside these stand plain counts: symbols, repeated lines, repeated word windows.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import field, map_texts, on_leave, written
from .piece_bpe import MODEL

#: Scripts with bands of their own; all others share OTHER.
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "CJK", "HIRAGANA", "KATAKANA", "HANGUL", "ARABIC", "HEBREW", "DEVANAGARI", "BENGALI", "TAMIL", "THAI", "ARMENIAN", "GEORGIAN", "ETHIOPIC")
#: Parameters: a band reaches this many quartile distances beyond the quartiles; the least
#: distance of characters per token as a share of the median, of byte share and of entropy
#: share; tokens of a block.
FENCE, LEAST_SPREAD, TOKENS = 2.0, (0.05, 0.02, 0.02), 128
SYMBOLS = "#*$%&|<>"
WINDOW = 5

_SYMBOLS = re.compile("[" + re.escape(SYMBOLS) + "]")
_WORDS = re.compile("[^\\x20\\x09-\\x0D]+")


def repeated_words(words: list[str]) -> int:
    """Words that lie in a window of five words which the text holds twice or more, the first included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    # equal windows have equal sums; where all sums differ, as in most texts, so do all windows
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    with np.errstate(over="ignore"):
        sums = np.sort(sum(codes[k : k + n] * np.uint64(2 * k + 3) ** np.uint64(9) for k in range(WINDOW)))
    if (sums[1:] != sums[:-1]).all():
        return 0
    windows = list(zip(*(words[k:] for k in range(WINDOW))))
    counts = Counter(windows)
    covered, upto = 0, 0
    for k, w in enumerate(windows):
        if counts[w] > 1:
            covered += k + WINDOW - max(k, upto)
            upto = k + WINDOW
    return covered


def repeated_lines(text: str) -> int:
    seen: set[str] = set()
    out = 0
    for line in text.split("\n"):
        if line in seen:
            out += 1
        elif _WORDS.search(line):
            seen.add(line)
    return out


@functools.cache
def _scripts() -> np.ndarray:
    """Per code point: its letter's place in SCRIPTS, that of OTHER after them, or one more for what is no letter."""
    place = {k: i for i, k in enumerate(SCRIPTS)}
    names = ((c.isalpha(), unicodedata.name(c, "").split(" ")[0]) for c in map(chr, range(0x110000)))
    return np.fromiter((place.get(name, len(SCRIPTS)) if letter else len(SCRIPTS) + 1 for letter, name in names), np.uint8, 0x110000)


def main_script(text: str) -> str:
    """Script of most letters, every one counted; the first in name among equals; OTHER without letters."""
    counts = np.bincount(_scripts()[np.frombuffer(text.encode("utf-32-le"), "<u4")], minlength=len(SCRIPTS) + 2)[:-1]
    return min((-n, k) for n, k in zip(counts.tolist(), (*SCRIPTS, "OTHER")))[1] if counts.any() else "OTHER"


@functools.lru_cache(maxsize=2)
def _library(path: str) -> tuple:
    """The encoder of a model file, and per id whether it stands for a byte; one per worker process."""
    import sentencepiece

    encoder = sentencepiece.SentencePieceProcessor(model_file=path)
    return encoder, np.array([encoder.is_byte(i) for i in range(encoder.get_piece_size())])


on_leave(__name__, lambda: _library.cache_clear())


def fertility(text: str, path: str) -> tuple[float, float, float]:
    """Characters per token, byte-fallback share, entropy of the tokens as a share of the largest possible.

    A text without tokens measures 0 in all three.
    """
    encoder, byte = _library(path)
    ids = encoder.encode(text)
    n = len(ids)
    if not n:
        return 0.0, 0.0, 0.0
    # line feeds are bytes in this vocabulary and say nothing about the language
    fallback = max(0, int(byte[np.array(ids)].sum()) - text.count("\n"))
    blocks = max(1, round(n / TOKENS))
    size = -(-n // blocks)
    share = sum(_evenness(ids[lo : lo + size]) for lo in range(0, n, size)) / -(-n // size)
    return len(text) / n, fallback / n, share


def _evenness(ids: list[int]) -> float:
    n = len(ids)
    if n < 2:
        return 1.0
    top = _LOG[n] if n < len(_LOG) else math.log2(n)
    repeated = [v for v in Counter(ids).values() if v > 1]
    return 1.0 - sum([v * math.log2(v) for v in repeated]) / n / top


_LOG = [math.log2(max(1, k)) for k in range(2 * TOKENS)]


def bands(measured: DataFrame, fence: float = FENCE) -> DataFrame:
    """``band_script, least_chars, most_chars, most_bytes, least_entropy`` per main script, from all rows that pass the base rule.

    A row per script that occurs, so at most as many as SCRIPTS and one.
    """
    found = _quartiles(measured.where("not base_failed")).withColumnRenamed("script", "band_script")
    low, middle, high = ({c: F.col(c)[k] for c in _MEASURES} for k in range(3))
    per_token, bytes_, entropy = _MEASURES
    width = {c: fence * F.greatest(high[c] - low[c], F.lit(least) * (middle[c] if c == per_token else F.lit(1.0))) for c, least in zip(_MEASURES, LEAST_SPREAD)}
    return found.select(
        "band_script", (low[per_token] - width[per_token]).alias("least_chars"), (high[per_token] + width[per_token]).alias("most_chars"),
        (high[bytes_] + width[bytes_]).alias("most_bytes"), (low[entropy] - width[entropy]).alias("least_entropy"),
    )


def _quartiles(rows: DataFrame) -> DataFrame:
    """``script`` and, per measure, the array of its exact quartiles: the values at rank ceil(n q), whatever the partitions.

    Approximate ones, a thousandth of the ranks to either side, bound each quartile.  Only
    values between two bounds are sorted, counted by value before they are shuffled; those
    below are counted.
    """
    each = rows.select("script", F.posexplode(F.array(*_MEASURES)).alias("measure", "v"))
    shares = F.array(*map(F.lit, _QUARTILES))
    around = F.percentile_approx("v", F.array(*[F.lit(q + e) for q in _QUARTILES for e in (-0.001, 0.001)]), 10_000)
    bounds = each.groupBy("script", "measure").agg(F.count("*").alias("n"), around.alias("around"))
    bounds = bounds.select(F.col("script").alias("s"), F.col("measure").alias("m"), "n", F.posexplode(F.transform(shares, lambda q, k: F.struct(F.element_at("around", 2 * k + 1).alias("low"), F.element_at("around", 2 * k + 2).alias("high"), F.greatest(F.lit(1.0), F.ceil(F.col("n") * q)).alias("rank")))).alias("k", "b")).select("s", "m", "k", "b.*")
    bounds = F.broadcast(written(bounds, "bounds"))  # nine rows a script
    near = each.join(bounds, (F.col("script") == F.col("s")) & (F.col("measure") == F.col("m")) & (F.col("v") <= F.col("high")))
    counted = near.groupBy("script", "measure", "k", "rank", F.when(F.col("v") >= F.col("low"), F.col("v")).alias("v")).agg(F.count("*").alias("c"))
    # a null stands for all smaller values and comes first
    upto = F.sum("c").over(Window.partitionBy("script", "measure", "k").orderBy(F.col("v").asc_nulls_first()))
    at = counted.withColumn("upto", upto).where((F.col("upto") - F.col("c") < F.col("rank")) & (F.col("rank") <= F.col("upto")))
    value = lambda m: F.array(*[F.max(F.when((F.col("measure") == m) & (F.col("k") == k), F.col("v"))) for k in range(len(_QUARTILES))])
    return at.groupBy("script").agg(*[value(m).alias(c) for m, c in enumerate(_MEASURES)])


_QUARTILES = (0.25, 0.5, 0.75)
_MEASURES = ("chars_per_token", "byte_share", "token_entropy")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """``id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, script``, and the three measures, per row; one pass, no shuffle."""
    path = model or public_tokenizers.path(MODEL)

    def one(text: str) -> tuple:
        words = _WORDS.findall(text)
        n, repeats = len(words), repeated_words(words)
        return n, sum(map(len, words)), len(_SYMBOLS.findall(text)), repeated_lines(text), repeats, n < 10 or 100 * repeats > 20 * n, main_script(text), *fertility(text, path)

    names = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("script", "string"), *((c, "double") for c in _MEASURES)]

    def run(texts: list) -> list:
        return list(zip(*(one(t or "") for t in texts))) if texts else [[] for _ in names]

    return map_texts(docs, [id_col], text_col, run, [field(*x) for x in names])


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, fence: float = FENCE) -> DataFrame:
    """Counts, verdict and measures per row.

    ``id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    script, chars_per_token, byte_share, token_entropy``.  ``kept`` is false where the base
    rule fails (a null or empty text has no words and fails) and where a measure lies
    outside the band of the text's main script; a script none of whose texts passes the
    base rule has no band.  Rows stay as they are, repeated ones and null ids too; other
    columns are dropped; an empty table gives an empty table.
    """
    measured = written(measure(docs, id_col, text_col, model), "measures")
    limits = F.broadcast(written(bands(measured, fence), "bands"))  # a row per script
    inside = F.col("chars_per_token").between(F.col("least_chars"), F.col("most_chars")) & (F.col("byte_share") <= F.col("most_bytes")) & (F.col("token_entropy") >= F.col("least_entropy"))
    out = measured.join(limits, F.col("script") == F.col("band_script"), "left")
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(True))
    return out.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "script", *_MEASURES)
