"""Language identification by Kneser-Ney character models (operator 1).

Texts are lowered to letters, with one blank for each run of anything else.  Per language
an interpolated Kneser-Ney model of four characters is built from counted four-grams:
continuation counts below the highest order, one absolute discount per order.  All
languages share one set of sorted hash arrays: per order the n-grams that any language
has seen, with a row of log-probabilities, and the contexts, with a row of back-off
weights.  A position of a text costs one binary search where its four-gram is known.

The language with the lowest cross-entropy per character wins.  Its limit is calibrated on
held-back texts by their median and median absolute deviation, which a few mislabelled or
tiny texts don't move, and tells texts of no learned language.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import enter, field, map_texts, pick, steps, written

#: Parameters of the fit, which looks at a bounded sample of labelled rows: most texts per
#: language, most characters of all languages together (two texts of each stay in any case),
#: share of the sample held back for calibration, languages that share a table.
TRAIN_TEXTS, TRAIN_CHARACTERS, CALIBRATE, LANGUAGES_TOGETHER = 2000, 1 << 25, 0.1, 8
#: Parameters of the verdict: robust deviations above the median that are still accepted,
#: least deviation in nats, sharpness of the score.
DEVIATIONS, LEAST_DEVIATION, SHARPNESS = 8.0, 0.05, 8.0
ORDER = 4
#: Parameter: what is added to the limit, over the root of the number of characters, since short texts vary more.
SHORT = 4.0
UNDETERMINED = "und"
_BLANK = 32
_MIX = np.uint64(0x9E3779B97F4A7C15)
_AT_ONCE = 1 << 18  # four-grams looked up at once, times the languages of one table


@functools.cache
def _letters() -> np.ndarray:
    """Per code point: its lower-case letter as 16 bits (letters beyond them share a private zone), or a blank."""
    out = np.full(0x110000, _BLANK, np.uint16)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            k = ord(c.lower()[0])
            out[i] = k if k < 0x10000 else 0xE000 + k % 0x1000
    return out


def letters_of(text: str) -> np.ndarray:
    """Letters and single blanks, without blanks at the ends."""
    codes = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    blank = codes == _BLANK
    codes = codes[~(blank & np.concatenate([[True], blank[:-1]]))] if len(codes) else codes
    return codes[:-1] if len(codes) and codes[-1] == _BLANK else codes


def grams_of(codes: np.ndarray) -> np.ndarray:
    """Four-grams that end at each letter or blank and at the final blank, 16 bits a character."""
    a = np.concatenate([np.full(ORDER - 1, _BLANK, np.uint64), codes.astype(np.uint64), np.full(1, _BLANK, np.uint64)])
    return a[:-3] << np.uint64(48) | a[1:-2] << np.uint64(32) | a[2:-1] << np.uint64(16) | a[3:]


class Predicting:
    """What a model of one table and one of many have in common: ``languages``, ``limits`` and cross-entropies."""

    languages: list[str]
    limits: np.ndarray

    def cross_entropies(self, codes: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def predict(self, text: str | None) -> tuple[str, float, float | None, bool]:
        """Language, score from 0 to 1, cross-entropy, whether it is rejected."""
        codes = letters_of(text or "")
        if not len(codes) or not self.languages:
            return UNDETERMINED, 0.0, None, True
        h = self.cross_entropies(codes)
        best = int(h.argmin())
        score = 1.0 / float(np.exp(np.minimum(SHARPNESS * (h[best] - h), 0.0)).sum())
        return self.languages[best], score, float(h[best]), bool(h[best] > self.limits[best] + SHORT / math.sqrt(len(codes)))


class Models(Predicting):
    """Any number of languages, a table for every few of them; a text meets one table at a time."""

    def __init__(self, tables: list[Model]) -> None:
        self.tables = tables
        self.languages = [k for t in tables for k in t.languages]
        self.limits = np.full(len(self.languages), np.inf)

    def cross_entropies(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([t.cross_entropies(codes) for t in self.tables])


@dataclass
class Model(Predicting):
    """``keys[k]``/``logs[k]`` per order: sorted hashes and rows of log-probabilities per language; contexts alike."""

    languages: list[str]
    keys: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    unknown: np.ndarray
    limits: np.ndarray

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for part in (self.keys, self.logs, self.contexts, self.weights) for a in part)

    def _total(self, order: int, grams: np.ndarray) -> np.ndarray:
        """Sum of log-probabilities per language."""
        at, hit = _find(self.keys[order], grams)
        out = self.logs[order][at[hit]].sum(axis=0, dtype=np.float64)
        rest = grams[~hit]
        if not len(rest):
            return out
        if order == 1:
            return out + len(rest) * self.unknown
        at, hit = _find(self.contexts[order], rest >> np.uint64(16))
        out += self.weights[order][at[hit]].sum(axis=0, dtype=np.float64)
        return out + self._total(order - 1, rest & np.uint64((1 << 16 * (order - 1)) - 1))

    def cross_entropies(self, codes: np.ndarray) -> np.ndarray:
        """Nats per character under each language."""
        grams = grams_of(codes)
        total = sum((self._total(ORDER, grams[lo : lo + _AT_ONCE]) for lo in range(0, len(grams), _AT_ONCE)), np.zeros(len(self.languages)))
        return -total / len(grams)


def _mixed(grams: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return grams * _MIX


def _find(keys: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wanted = _mixed(grams)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _discount(counts: np.ndarray) -> float:
    one, two = int((counts == 1).sum()), int((counts == 2).sum())
    return one / (one + 2 * two) if one else 0.5


def build_all(counted: dict[str, tuple[np.ndarray, np.ndarray]]) -> Models:
    """Models of all languages, as :func:`build` makes them together, in tables of a few."""
    languages = sorted(counted)
    letters = len(np.unique(np.concatenate([np.unique(counted[k][0] & np.uint64(0xFFFF)) for k in languages] or [np.empty(0, np.uint64)])))
    groups = [languages[lo : lo + LANGUAGES_TOGETHER] for lo in range(0, len(languages), LANGUAGES_TOGETHER)]
    return Models([build({k: counted[k] for k in group}, letters) for group in groups])


def build(counted: dict[str, tuple[np.ndarray, np.ndarray]], letters: int | None = None) -> Model:
    """Model of languages, each given as distinct four-grams and their counts; ``letters``: how many all languages have together."""
    languages = sorted(counted)
    levels: list[dict[int, tuple[np.ndarray, np.ndarray]]] = []  # per language and order: grams and (continuation) counts
    for language in languages:
        grams, counts = counted[language]
        own = {ORDER: (grams, counts)}
        for order in range(ORDER - 1, 0, -1):
            own[order] = np.unique(own[order + 1][0] & np.uint64((1 << 16 * order) - 1), return_counts=True)
        levels.append(own)
    none = np.empty(0, np.uint64)
    union = {k: np.unique(np.concatenate([own[k][0] for own in levels] or [none])) for k in range(1, ORDER + 1)}
    size, n = (letters or len(union[1])) + 1, len(languages)
    below, unknown = None, np.zeros(n)
    keys, logs, contexts, weights = [none], [np.empty((0, n), np.float32)], [none], [np.empty((0, n), np.float32)]
    for order in range(1, ORDER + 1):
        grams = union[order]
        context = grams >> np.uint64(16)
        heads, head_of = np.unique(context, return_inverse=True)
        p, back = np.zeros((len(grams), n)), np.ones((len(heads), n))
        for j, own in enumerate(levels):
            own_grams, own_counts = own[order]
            d = _discount(own_counts)
            place = np.searchsorted(grams, own_grams)
            totals, kinds = np.zeros(len(heads)), np.zeros(len(heads))
            np.add.at(totals, head_of[place], own_counts)
            np.add.at(kinds, head_of[place], 1)
            seen = totals > 0
            back[seen, j] = d * kinds[seen] / totals[seen]
            p[place, j] = np.maximum(own_counts - d, 0) / totals[head_of[place]]
            lower = np.full(len(grams), 1 / size) if order == 1 else below[np.searchsorted(union[order - 1], grams & np.uint64((1 << 16 * (order - 1)) - 1)), j]
            p[:, j] += back[head_of, j] * lower
            if order == 1:
                unknown[j] = math.log(back[0, j] / size)
        below = p
        for table, values, out_keys, out_values in ((grams, p, keys, logs), (heads, back, contexts, weights)):
            mixed = _mixed(table)
            by = np.argsort(mixed)
            out_keys.append(mixed[by])
            out_values.append(np.log(values[by]).astype(np.float32))
    return Model(languages, keys, logs, contexts, weights, unknown, np.full(n, np.inf))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enter(__name__)
    for step in steps(batches):
        texts: dict[str, list[np.ndarray]] = {}
        for language, text in zip(step.column(0).to_pylist(), step.column(1).to_pylist()):
            texts.setdefault(language, []).append(grams_of(letters_of(text)))
        for language, parts in texts.items():
            grams, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))], names=["language", "gram", "n"])


def held_out(doc_id: Column) -> Column:
    """Documents kept from learning: remainder 1 of CRC-32 of the id as text; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def sampled(rows: DataFrame, texts: int = TRAIN_TEXTS, characters: int = TRAIN_CHARACTERS) -> DataFrame:
    """``language, text, place, held`` from ``id, text, language``: at most ``texts`` different rows of each language.

    Rows are drawn by a hash of id and text, so rows with one id, or none, are drawn apart,
    and rows that repeat count as one.  ``place`` numbers a language's rows in the order
    they are drawn; the last share of them is held back.  The number of different rows is
    estimated by a sketch in the counting pass, only to draw few more than are needed.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("key", F.xxhash64("id", "text"))
    sizes = keyed.groupBy("language").agg(F.count("*").alias("n"), F.approx_count_distinct("key").alias("kinds")).collect()  # a row a language
    if not sizes:
        return spark.createDataFrame([], "language string, text string, place int, held boolean")
    shares = spark.createDataFrame([(r["language"], min(1.0, 2 * texts / r["kinds"])) for r in sizes], "language string, share double")
    dice = F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    drawn = keyed.withColumn("dice", dice).join(F.broadcast(shares), "language").where("dice < share")
    different = drawn.groupBy("language", "key").agg(F.min("dice").alias("dice"), F.min(F.length("text")).alias("length"))
    # at most about twice ``texts`` rows a language are in one window
    order = Window.partitionBy("language").orderBy("dice", "key")
    ranked = different.withColumn("place", F.row_number().over(order)).withColumn("upto", F.sum("length").over(order))
    chosen = ranked.where((F.col("place") <= texts) & ((F.col("upto") <= characters // len(sizes)) | (F.col("place") <= 2)))
    of = Window.partitionBy("language")
    size = F.count("*").over(of)
    chosen = chosen.withColumn("held", (F.col("place") > size - F.floor(size * CALIBRATE)) & (size * CALIBRATE >= 2)).select(F.col("language").alias("l"), F.col("key").alias("k"), "place", "held")
    chosen = written(chosen, "sample")  # at most ``texts`` rows a language
    return drawn.join(chosen, (F.col("language") == F.col("l")) & (F.col("key") == F.col("k"))).select("language", "key", "text", "place", "held").dropDuplicates(["language", "key"]).drop("key")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", texts: int = TRAIN_TEXTS) -> Models:
    """Learn from rows with text and language.

    Of each language at most ``texts`` different rows are learned from, whole (see
    :func:`sampled`; null and repeated ids are no matter).  Their four-grams and counts
    come to the driver, at most about TRAIN_CHARACTERS of them.  Every language is learned,
    however many there are; LANGUAGES_TOGETHER of them share a table.  A language with fewer than 20
    texts holds none back; its limit is the largest of the others', or none.  Without any
    labelled row nothing is learned.
    """
    spark = docs.sparkSession
    rows = pick(docs, (id_col, "id"), (text_col, "text"), (lang_col, "language")).where("text is not null and language is not null")
    sample = written(sampled(rows, texts), "sampled")
    counted = sample.where("not held").select("language", "text").mapInArrow(_counts, "language string, gram bigint, n bigint").groupBy("language", "gram").agg(F.sum("n").alias("n")).toArrow()
    grams, n = counted.column("gram").to_numpy().view(np.uint64), counted.column("n").to_numpy()
    if not len(grams):
        return build_all({})
    of = counted.column("language").combine_chunks().dictionary_encode()
    codes, names = of.indices.to_numpy(), of.dictionary.to_pylist()
    found = {}
    for j, name in enumerate(names):
        mine = codes == j
        by = np.argsort(grams[mine])
        found[name] = (grams[mine][by], n[mine][by])
    model = build_all(found)
    shipped, langid_name = spark.sparkContext.broadcast(model), __name__

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(langid_name)
        m = shipped.value
        place = {k: j for j, k in enumerate(m.languages)}
        for step in steps(batches):
            out = [(k, float(m.cross_entropies(c)[place[k]])) for k, t in zip(step.column(0).to_pylist(), step.column(1).to_pylist()) if k in place and len(c := letters_of(t))]
            if out:
                yield pa.RecordBatch.from_pylist([{"language": k, "h": h} for k, h in out])

    held = sample.where("held").select("language", "text").mapInArrow(measure, "language string, h double")
    middle = held.groupBy("language").agg(F.median("h").alias("middle"))  # at most ``texts`` rows a language
    spread = held.join(F.broadcast(middle), "language").groupBy("language").agg(F.first("middle").alias("middle"), F.median(F.abs(F.col("h") - F.col("middle"))).alias("mad"))
    for r in spread.collect():
        model.limits[model.languages.index(r["language"])] = r["middle"] + DEVIATIONS * max(1.4826 * r["mad"], LEAST_DEVIATION)
    known = np.isfinite(model.limits)
    if known.any():
        model.limits[~known] = model.limits[known].max()
    shipped.unpersist()
    return model


def classify(docs: DataFrame, model: Predicting, ids: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``ids, lang_pred, score, cross_entropy, rejected`` per row; no shuffle.

    Only the text is looked at.  ``und`` (score 0, rejected) is for a null text, one
    without letters, and any text if nothing was learned.  A rejected text keeps its
    nearest language in ``lang_pred``.  Repeated rows get equal results; ties go to the
    first language in order; other columns are dropped.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list) -> list:
        return list(zip(*map(shipped.value.predict, texts)))

    return map_texts(docs, list(ids), text_col, run, [field("lang_pred", "string"), field("score", "double"), field("cross_entropy", "double"), field("rejected", "boolean")])


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", texts: int = TRAIN_TEXTS) -> DataFrame:
    """``id, held_out, lang_pred, score, cross_entropy, rejected`` per row.

    Learns from the labelled rows that aren't held out, then classifies every row (see
    :func:`train` and :func:`classify`); an empty table gives an empty table.
    """
    labelled = pick(docs, id_col, text_col, lang_col).where(~held_out(F.col(id_col)))
    model = train(labelled, id_col, text_col, lang_col, texts)
    out = classify(docs, model, (id_col,), text_col)
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")

