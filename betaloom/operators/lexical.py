"""Lexical matching of identifiers: the best of one label set for each of another.

The score of two labels depends on their tokens alone, so labels are put together by their
sorted tokens, each such class is matched once, and labels are joined back.

The search for the best is exact without forming all pairs.  Classes are listed under their
numbers, words and pairs of neighbouring characters.  First each class asks for the rarest
of its own; the best score found is its floor.  A better partner must then reach the floor,
which says how many numbers or pairs of characters it shares, so that asking for as many of
the rarest as leave no way around finds it (a prefix filter), or how far its length may be.
What no list can tell, such as labels that share nothing, meets by length alone: a task then
holds a part of one side and hands on the best of it, so that no such pair is shuffled.  Built-in
functions bound each candidate; the similarity of characters is computed where the bound
reaches the floor.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import discard, written

#: Parameters of the score: weights of token similarity, words and numbers.
TOKENS, WORDS, NUMBERS = 0.45, 0.10, 0.45
#: Parameters: rarest tokens and pairs of characters that are asked for first, similarity from
#: which pairs of characters are asked for, at most so many right labels meet all left ones,
#: left labels of a task.
FIRST_TOKENS, FIRST_GRAMS, GRAMS_FROM, CELL, LEFTS = 2, 2, 0.88, 20_000, 10_000
_EPS = 1e-9


def score(a: Column, b: Column, penalty: bool = True, gamma: float = 1.0) -> Column:
    """Of two feature structs."""
    out = TOKENS * T.token_sort_similarity(a["tokens"], b["tokens"]) + WORDS * T.jaccard(a["words"], b["words"]) + NUMBERS * T.number_match(a["nums"], b["nums"])
    return out * T.count_penalty(F.size(a["tokens"]), F.size(b["tokens"]), gamma) if penalty else out


def classes(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """``label, s`` of the distinct known labels, and per ``s`` (the sorted tokens) the features all its labels share.

    ``grams`` are the pairs of neighbouring characters of ``s``, equal ones numbered.
    """
    known = df.select(F.col(column).alias("label")).where(F.col(column).isNotNull()).distinct()
    tokens = F.filter(F.split(T.normalize(F.col("label")), " "), lambda t: t != "")
    labels = known.select("label", F.array_join(F.array_sort(tokens), " ").alias("s"))
    split = labels.select("s").distinct().withColumn("tokens", F.filter(F.split("s", " "), lambda t: t != ""))
    number = lambda t: t.rlike("^[0-9]+$")
    pairs = F.when(F.length("s") > 1, F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substr(F.col("s"), i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    numbered = F.transform("pairs", lambda g, i: F.concat(g, F.size(F.filter(F.slice("pairs", 1, i + 1), lambda h: h == g)).cast("string")))
    out = split.select("s", "tokens", F.array_distinct(F.filter("tokens", number)).alias("nums"), F.array_distinct(F.filter("tokens", lambda t: ~number(t))).alias("words"), pairs.alias("pairs"))
    return labels, out.select("s", F.struct("s", "tokens", "nums", "words").alias("f"), F.length("s").alias("size"), (F.size("nums") > 0).alias("numbered"), numbered.alias("grams"))


def _asked(left: DataFrame, right: DataFrame, elements: Column, take: Column) -> DataFrame:
    """``a, b``: classes of the right that hold one of the ``take`` rarest elements of a class of the left."""
    theirs = right.select(F.col("s").alias("b"), F.explode(elements).alias("e"))
    common = theirs.groupBy("e").agg(F.count("*").alias("_n"))
    mine = left.where(take > 0).select(F.col("s").alias("a"), take.alias("_take"), F.explode(elements).alias("e")).join(common, "e", "left")
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.coalesce("_n", F.lit(0)), "e"))
    rarest = mine.withColumn("_rank", rank).where((F.col("_rank") <= F.col("_take")) & F.col("_n").isNotNull()).select("a", "e")
    return rarest.join(theirs, "e").select("a", "b")


def _bounded(pairs: DataFrame, left: DataFrame, right: DataFrame, penalty: bool, gamma: float) -> DataFrame:
    """Candidate pairs, each once, with features, floor and the most they can score."""
    x = left.select(F.col("s").alias("a"), F.col("f").alias("fa"), *(["floor"] if "floor" in left.columns else [F.lit(0.0).alias("floor")]))
    y = right.select(F.col("s").alias("b"), F.col("f").alias("fb"))
    both = pairs.distinct().join(x, "a").join(y, "b")
    return both.where(most(F.col("fa"), F.col("fb"), penalty, gamma) >= F.col("floor") - _EPS)


def most(fa: Column, fb: Column, penalty: bool = True, gamma: float = 1.0) -> Column:
    """What two feature structs can score at most, given their lengths, words and numbers."""
    sizes = [F.length(f["s"]) for f in (fa, fb)]
    ceiling = F.coalesce(F.try_divide(2 * F.least(*sizes), sizes[0] + sizes[1]), F.lit(1.0))
    out = TOKENS * ceiling + WORDS * T.jaccard(fa["words"], fb["words"]) + NUMBERS * T.number_match(fa["nums"], fb["nums"])
    return out * T.count_penalty(F.size(fa["tokens"]), F.size(fb["tokens"]), gamma) if penalty else out


def _top(scored: DataFrame) -> DataFrame:
    """Per ``a`` the best score and, among equals, the first label."""
    return scored.groupBy("a").agg(F.min(F.struct((-F.col("score")).alias("s"), "first")).alias("m")).select("a", F.col("m.first").alias("first"), (-F.col("m.s")).alias("score"))


def _first_round(x: DataFrame, y: DataFrame) -> DataFrame:
    tokens = F.concat(F.transform(F.col("f.nums"), lambda t: F.concat(F.lit("n"), t)), F.transform(F.col("f.words"), lambda t: F.concat(F.lit("w"), t)))
    same = x.select(F.col("s").alias("a")).join(y.select(F.col("s").alias("b")), F.col("a") == F.col("b"))
    return same.unionByName(_asked(x, y, tokens, F.lit(FIRST_TOKENS))).unionByName(_asked(x, y, F.col("grams"), F.lit(FIRST_GRAMS)))


def _second_round(x: DataFrame, y: DataFrame, penalty: bool, gamma: float) -> DataFrame:
    """All pairs that can reach the floor of their left class; see the module's text.

    Of two labels with numbers that share none the numbers add nothing, where one has some
    they add 0.6, where neither has any they add all.  The words add at most all, or half
    where fewer than half of them are shared.
    """
    floor, size, words, nums = F.col("floor") - _EPS, F.col("size"), F.col("f.words"), F.col("f.nums")
    left_over = lambda elements, share: F.size(elements) - F.greatest(F.lit(1), F.ceil(share * F.size(elements) - _EPS)).cast("int") + 1
    share = (floor - TOKENS - WORDS) / NUMBERS
    found = _asked(x, y.where("numbered"), nums, F.when(F.col("numbered") & (share <= 1), left_over(nums, share)).otherwise(0))
    plain = ~F.col("numbered")
    found = found.unionByName(_asked(x.where(plain), y.where(plain), words, left_over(words, F.lit(0.5))))
    # what similarity of characters is needed, for right classes with and without numbers
    need = {
        True: (floor - WORDS - F.when(F.col("numbered"), 0.0).otherwise(0.6 * NUMBERS)) / TOKENS,
        False: (floor - F.when(F.col("numbered"), WORDS + 0.6 * NUMBERS).otherwise(WORDS / 2 + NUMBERS)) / TOKENS,
    }
    longest, shortest = y.agg(F.coalesce(F.max("size"), F.lit(0)), F.coalesce(F.min("size"), F.lit(0))).first()
    for numbered, theta in need.items():
        theirs = y.where(F.col("numbered") == F.lit(numbered))
        # 3 LCS - both lengths - 1 pairs of neighbours stay at least
        stay = F.ceil((1.5 * theta - 1) * 2 * size / (2 - theta) - 1 - _EPS).cast("int")
        by_grams = (theta >= GRAMS_FROM) & (stay >= 1)
        found = found.unionByName(_asked(x.where(theta <= 1), theirs, F.col("grams"), F.when(by_grams, size - 1 - stay + 1).otherwise(0)))
        low = F.when(theta > 0, F.ceil(size * theta / (2 - theta) - 1e-6)).otherwise(0)
        high = F.when(theta > 0, F.floor(size * (2 - theta) / F.greatest(theta, F.lit(1e-3)) + 1e-6)).otherwise(longest)
        low, high = F.greatest(low.cast("int"), F.lit(shortest)), F.least(high.cast("int"), F.lit(longest))
        n = F.size(F.col("f.tokens"))
        numbers = F.when(F.col("numbered"), 0.0 if numbered else 0.6).otherwise(0.6 if numbered else 1.0)
        mine = x.where((theta <= 1) & ~by_grams & (low <= high)).select(F.col("s").alias("a"), size.alias("_size"), n.alias("_n"), floor.alias("_floor"), (WORDS + NUMBERS * numbers).alias("_rest"), F.explode(F.sequence(low, high)).alias("size"))
        found = found.unionByName(_nearest(mine, theirs.withColumn("_m", n), x, numbered, penalty, gamma))
    return found


def _nearest(mine: DataFrame, theirs: DataFrame, x: DataFrame, numbered: bool, penalty: bool, gamma: float) -> DataFrame:
    """``a, b``: of those that meet by length, per left class and part of the right the best one, numbers taken as not shared.

    Pairs that share numbers score more than that, and the lists of numbers find them.  A task
    meets LEFTS left classes with one part of at most CELL right ones of one length.
    """
    part = F.pmod(F.xxhash64("s"), F.greatest(F.lit(1), F.ceil(F.col("_all") / CELL)).cast("int")).alias("part")
    sizes = theirs.groupBy("size", "_m").agg(F.count("*").alias("_all"))
    # lengths and numbers of tokens alone leave out most of those that meet
    ceiling = F.coalesce(F.try_divide(2 * F.least("_size", "size"), F.col("_size") + F.col("size")), F.lit(1.0))
    factor = T.count_penalty(F.col("_n"), F.col("_m"), gamma) if penalty else F.lit(1.0)
    asks = mine.join(F.broadcast(sizes), "size").where((TOKENS * ceiling + F.col("_rest")) * factor >= F.col("_floor"))
    counts = asks.groupBy("size", "_m").agg(F.max("_all").alias("_all"), F.greatest(F.lit(1), F.ceil(F.count("*") / LEFTS)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("a"), F.col("blocks"))
    asks = asks.drop("_all").join(F.broadcast(counts), ["size", "_m"]).withColumn("block", block).withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col("_all") / CELL)).cast("int") - 1)))
    asks = asks.join(x.select(F.col("s").alias("a"), F.col("f.words").alias("words"), (F.col("numbered")).alias("numbered")), "a").select("size", "_m", "block", "part", "a", "words", "numbered", "_n", "_floor")
    met = theirs.join(F.broadcast(counts), ["size", "_m"]).select("size", "_m", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("blocks") - 1).cast("long"))).alias("block"), part, F.col("s").alias("b"), "first", F.col("f.words").alias("words"))
    keys = ["size", "_m", "block", "part"]
    asks, met = (df.select(*[F.col(c).alias(f"{side}_{c}") for c in keys], *[c for c in df.columns if c not in keys]) for df, side in ((asks, "left"), (met, "right")))

    def best_of(lefts: pd.DataFrame, rights: pd.DataFrame) -> pd.DataFrame:
        if not len(lefts) or not len(rights):
            return pd.DataFrame({"a": [], "b": []}, dtype=object)
        rights = rights.sort_values("first", ignore_index=True)
        names, size, m = rights["b"].tolist(), int(rights["right_size"].iloc[0]), int(rights["right__m"].iloc[0])
        sets: dict[frozenset, int] = {}
        kind = np.array([sets.setdefault(frozenset(w), len(sets)) for w in rights["words"]])
        lcs = T.lcs_with(names)
        out: list[tuple[str, str]] = []
        for a, words, has, n, floor in zip(lefts["a"], lefts["words"], lefts["numbered"], lefts["_n"], lefts["_floor"]):
            w = frozenset(words)
            shared = np.array([len(w & v) / len(w | v) if w or v else 1.0 for v in sets])
            similar = 2 * lcs(a) / (len(a) + size) if len(a) + size else np.ones(len(names))
            numbers = 0.6 if has != numbered else 0.0 if numbered else 1.0
            value = TOKENS * similar + WORDS * shared[kind] + NUMBERS * numbers
            if penalty and max(n, m):
                value = value * np.exp(-gamma * abs(n - m) / max(n, m))
            at = int(np.argmax(value >= value.max() - 1e-12))  # the first label among equals
            if value[at] >= floor - _EPS:
                out.append((a, names[at]))
        return pd.DataFrame(out, columns=["a", "b"], dtype=object)

    return asks.groupBy(*[f"left_{c}" for c in keys]).cogroup(met.groupBy(*[f"right_{c}" for c in keys])).applyInPandas(best_of, "a string, b string")


def scores(left: DataFrame, right: DataFrame, a: str, b: str, penalty: bool = True) -> DataFrame:
    """``a, b, score`` for every pair of distinct labels, for a right side of at most CELL labels, which every left label meets.

    More raise: there :func:`best`, or candidates from an index, take the place of all pairs.
    """
    x, y = (df.select(F.col(c).alias(n)).where(F.col(n).isNotNull()).distinct().select(n, T.features(F.col(n)).alias(f"f{n}")) for df, c, n in ((left, a, "a"), (right, b, "b")))
    small = [r["b"] for r in y.select("b").limit(CELL + 1).collect()]
    if len(small) > CELL:
        raise ValueError(f"more than {CELL} right labels")
    listed = x.withColumn("b", F.explode(F.array(*map(F.lit, sorted(small))) if small else F.array().cast("array<string>")))
    return listed.withColumn("fb", T.features(F.col("b"))).select("a", "b", score(F.col("fa"), F.col("fb"), penalty).alias("score"))


def best(left: DataFrame, right: DataFrame, a: str, b: str, penalty: bool = True, gamma: float = 1.0) -> DataFrame:
    """``a, b, score``: per left label its best right label, the first in order among equals.

    Null labels match nothing; a left label has no row only if the right side has none.
    """
    labels, x = classes(left, a)
    names, y = classes(right, b)
    y = y.join(names.groupBy("s").agg(F.min("label").alias("first")), "s")
    x, y = written(x, "left-classes"), written(y, "right-classes")
    firsts = y.select(F.col("s").alias("b"), "first")
    rate = lambda pairs, on: _bounded(pairs, on, y, penalty, gamma).select("a", "b", score(F.col("fa"), F.col("fb"), penalty, gamma).alias("score")).join(firsts, "b").select("a", "first", "score")
    known = written(_top(rate(_first_round(x, y), x)), "floors")
    floored = written(x.join(known.select(F.col("a").alias("s"), F.col("score").alias("floor")), "s", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0))), "floored")
    better = _top(rate(_second_round(floored, y, penalty, gamma), floored))
    top = written(_top(known.unionByName(better)), "best")
    discard(x, y, known, floored)
    return labels.join(top, F.col("s") == F.col("a")).select(F.col("label").alias("a"), F.col("first").alias("b"), "score")


def best_field(candidates: DataFrame, targets: DataFrame, field: str, value: str, target: str, excluded: tuple[str, ...] = ("artifact", "relation", "platform_id")) -> DataFrame:
    """The field whose values come closest to a target, the first in order of name among equals. One row."""
    wanted = candidates.where(~F.col(field).isin(*excluded))
    top = best(wanted, targets, value, target)
    by = wanted.select(F.col(field).alias("field"), F.col(value).alias("a")).distinct().join(top, "a").groupBy("field").agg(F.max("score").alias("score"))
    return by.orderBy(F.desc("score"), "field").limit(1)


def subject_map(samples: DataFrame, subjects: DataFrame, sample: str, candidate: str, subject: str) -> DataFrame:
    """``sample, subject, matched, score``: each sample's best candidate and the subject nearest to it."""
    top = best(samples, subjects, candidate, subject, penalty=False)
    joined = samples.select(F.col(sample).alias("sample"), F.col(candidate).alias("a")).distinct().join(top, "a")
    chosen = joined.groupBy("sample").agg(F.max_by(F.struct(F.col("a").alias("subject"), F.col("b").alias("matched"), "score"), F.struct("score", F.col("a"))).alias("m")).select("sample", "m.*")
    again = best(chosen, subjects, "subject", subject).select(F.col("a").alias("subject"), F.col("b").alias("nearest"))
    return chosen.join(again, "subject").select("sample", "subject", F.col("nearest").alias("matched"), "score")
