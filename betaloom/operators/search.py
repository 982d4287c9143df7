"""Search of terms by their words: an inverted index of words and pairs of words with BM25 weights, exact top k.

A term has one text or more (its label and synonyms) and scores as its best one.  The index
is a table of (gram, text, weight), so a search is a join and a sum.

Frequent grams have long lists and say little.  A search first meets the lists of the other
grams only, and adds what the frequent ones give to the texts it found.  A text that was not
found can get no more than the best that the label's frequent grams give; where that could
reach the label's k-th score, the label is searched again with all its grams.  So the
result is that of all lists.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Parameters: BM25's saturation and length share; texts from which a gram counts as frequent.
K1, B, FREQUENT = 1.2, 0.75, 10_000


def grams(text: Column) -> Column:
    """Words (letters and digits of ASCII, lowered) and pairs of neighbouring words."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), "")
    pairs = F.transform(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda w, i: F.concat_ws(" ", F.get(words, i), w))
    return F.concat(words, pairs)


@dataclass
class Index:
    """``postings``: gram, text number, weight; ``known``: per gram its number of texts and best weight; ``terms``: of each text number in order.

    Terms with one text share its number and postings, but count as so many texts.
    """

    postings: DataFrame
    known: DataFrame
    terms: DataFrame


def index(terms: DataFrame, term: str, text: str, k1: float = K1, b: float = B) -> Index:
    """Of a table with a row per term and text; a null term or a text without words is left out, repeated rows count once."""
    pairs = terms.select(F.col(term).alias("term"), F.col(text).alias("text")).where("term is not null and text is not null").distinct()
    pairs = written(pairs.select(F.xxhash64("text").alias("doc"), "term", "text"), "terms")
    rows = pairs.groupBy("doc", "text").agg(F.count("*").alias("n")).withColumn("g", grams(F.col("text"))).where(F.size("g") > 0)
    rows = written(rows.select("doc", "n", F.size("g").alias("length"), "g"), "texts")
    totals = rows.agg(F.sum("n").alias("texts"), (F.sum(F.col("n") * F.col("length")) / F.sum("n")).alias("mean"))  # one row
    counts = rows.select("doc", "n", "length", F.explode("g").alias("gram")).groupBy("doc", "n", "length", "gram").agg(F.count("*").alias("tf"))
    frequency = counts.groupBy("gram").agg(F.sum("n").alias("df"))
    weighed = counts.join(frequency, "gram").join(F.broadcast(totals), F.lit(True))
    rare = F.log(1 + (F.col("texts") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = rare * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    postings = written(weighed.select("gram", "doc", weight.alias("weight"), "df"), "postings")
    known = written(postings.groupBy("gram").agg(F.max("df").alias("df"), F.count("*").alias("different"), F.max("weight").alias("most")), "grams")
    return Index(postings.drop("df"), known, pairs.select("doc", "term"))


def search(labels: DataFrame, label: str, over: Index, k: int = 5, frequent: int = FREQUENT) -> DataFrame:
    """``label, rank, term, score``: the k best terms of each distinct label, the first in order among equals (to nine digits).

    Labels that share no gram with any term have no rows.  Labels with the same known grams
    are searched once.
    """
    asked = labels.select(F.col(label).alias("name")).where("name is not null").distinct().select("name", F.explode(F.array_distinct(grams(F.col("name")))).alias("gram")).join(over.known.select("gram"), "gram")
    named = written(asked.groupBy("name").agg(F.array_join(F.sort_array(F.collect_list("gram")), ",").alias("label")), "labels")
    asked = named.select("label").distinct().select("label", F.explode(F.split("label", ",")).alias("gram")).join(over.known, "gram")
    asked = written(asked.withColumn("common", F.col("different") > frequent), "asked")
    found = written(_searched(asked, over, k, frequent), "found")
    return named.join(found, "label").select(F.col("name").alias("label"), "rank", "term", "score")


def _searched(asked: DataFrame, over: Index, k: int, frequent: int) -> DataFrame:
    listed = _first_terms(over.terms, k)
    if not over.known.where(F.col("different") > frequent).limit(1).count():
        return _best(_summed(asked, over.postings), listed, k)
    often = over.postings.join(over.known.where(F.col("different") > frequent).select("gram"), "gram", "left_semi")
    first = _summed(asked.where(~F.col("common")), over.postings)
    more = first.select("label", "doc").join(asked.where("common").select("label", "gram"), "label").join(often.select("gram", "doc", "weight"), ["gram", "doc"]).groupBy("label", "doc").agg(F.sum("weight").alias("more"))
    found = _best(first.join(more, ["label", "doc"], "left").withColumn("score", F.col("score") + F.coalesce("more", F.lit(0.0))), listed, k)
    reach = asked.where("common").groupBy("label").agg(F.sum("most").alias("reach"))
    last = found.where(F.col("rank") == k).select("label", F.col("score").alias("last"))
    open_ = written(reach.join(last, "label", "left").where(F.col("last").isNull() | (F.col("reach") >= F.col("last") - 1e-9)).select("label"), "open")
    again = _best(_summed(asked.join(open_, "label", "left_semi"), over.postings), listed, k)
    return found.join(open_, "label", "left_anti").unionByName(again)


def _summed(asked: DataFrame, postings: DataFrame) -> DataFrame:
    return asked.select("label", "gram").join(postings, "gram").groupBy("label", "doc").agg(F.sum("weight").alias("score"))


def _first_terms(terms: DataFrame, k: int) -> DataFrame:
    """The first k terms of each text: later ones have k before them wherever this text is their best."""
    rank = F.row_number().over(Window.partitionBy("doc").orderBy("term"))
    return written(terms.withColumn("rank", rank).where(F.col("rank") <= k).select("doc", "term"), "first-terms")


def _best(scored: DataFrame, listed: DataFrame, k: int) -> DataFrame:
    """The k best terms; Spark keeps k rows a label before it shuffles."""
    terms = scored.join(listed, "doc").groupBy("label", "term").agg(F.round(F.max("score"), 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "term"))
    return terms.withColumn("rank", rank).where(F.col("rank") <= k).select("label", "rank", "term", "score")
