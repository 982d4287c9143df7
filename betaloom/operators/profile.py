"""Profiles and summaries of metadata tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coverage(df: DataFrame, fields: Sequence[str], order: str, examples: int = 10) -> DataFrame:
    """Per field: present, missing, parse_rate (0 if empty), unique_values and the first examples by ``order``.

    One aggregation counts all fields; the examples are the first of each field, so no list
    of all values is made.
    """
    stacked = df.select(order, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields])).alias("s")).select(order, "s.field", "s.v")
    counts = stacked.groupBy("field").agg(F.count("v").alias("present"), F.count_if(F.col("v").isNull()).alias("missing"), F.count_distinct("v").alias("unique_values"))
    out = counts.withColumn("parse_rate", F.coalesce(F.try_divide("present", F.col("present") + F.col("missing")), F.lit(0.0)))
    # Spark keeps ``examples`` rows a field before it shuffles
    rank = F.row_number().over(Window.partitionBy("field").orderBy("o", "v"))
    shown = stacked.where(F.col("v").isNotNull()).select(F.col(order).alias("o"), "field", "v").withColumn("rank", rank).where(F.col("rank") <= examples)
    lists = shown.groupBy("field").agg(F.transform(F.sort_array(F.collect_list(F.struct("o", "v"))), lambda s: s["v"]).alias("examples"))
    return out.join(lists, "field", "left").select("field", "present", "missing", "parse_rate", "unique_values", F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


# The fields of a sample that a summary covers.
SUMMARY_FIELDS = ("Disease_Status", "Condition", "Tissue", "Cell_Type", "Sex", "Platform", "age")


def metadata_summary(df: DataFrame, order: str, fields: Sequence[str] = SUMMARY_FIELDS, examples: int = 10) -> DataFrame:
    """:func:`coverage` of the fields beside ``n_samples``; all zero for an empty table."""
    n = df.agg(F.count("*").alias("n_samples"))
    named = df.sparkSession.createDataFrame([(f,) for f in fields], "field string").join(F.broadcast(n))  # n is one row
    found = coverage(df, fields, order, examples)
    zero = lambda c, kind: F.coalesce(c, F.lit(0)).cast(kind).alias(c)
    return named.join(found, "field", "left").select("field", "n_samples", zero("present", "bigint"), zero("missing", "bigint"), zero("parse_rate", "double"), zero("unique_values", "bigint"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def parse_rates(summary: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """``field, parse_rate`` of the wanted fields, 0 where one is unknown."""
    named = summary.sparkSession.createDataFrame([(f,) for f in wanted], "field string")
    return named.join(summary.select("field", "parse_rate"), "field", "left").select("field", F.coalesce("parse_rate", F.lit(0.0)).alias("parse_rate"))


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Share of each known value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("total")).alias("share"))  # total is one row


def dataset_summary(df: DataFrame, dataset: str, age: str, condition: str, sex: str, platform: str) -> DataFrame:
    """Per dataset: count, age range, conditions by frequency, shares of sexes, first platform.

    Values are counted before they are listed, so a list is as long as its distinct values.
    """
    base = df.groupBy(dataset).agg(F.count("*").alias("n_samples"), F.min(age).alias("lo"), F.max(age).alias("hi"), F.min(platform).alias("platform"))

    def listed(column: str, name: str, shares: bool):
        counts = df.where(F.col(column).isNotNull()).groupBy(dataset, F.col(column).cast("string").alias("v")).agg(F.count("*").alias("n"))
        pairs = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "v")))
        if not shares:
            return counts.groupBy(dataset).agg(F.array_join(F.transform(pairs, lambda p: p["v"]), ", ").alias(name))
        whole = counts.groupBy(dataset).agg(pairs.alias("p"), F.sum("n").alias("t"))
        return whole.select(dataset, F.array_join(F.transform("p", lambda p: F.concat(p["v"], F.lit(" ("), F.format_string("%.1f", F.bround(-p["k"] * 100 / F.col("t"), 1)), F.lit("%)"))), ", ").alias(name))

    out = base.join(listed(condition, "conditions", False), dataset, "left").join(listed(sex, "sexes", True), dataset, "left")
    ages = F.when(F.col("lo").isNull(), F.lit("N/A")).otherwise(F.format_string("%.2f-%.2f", F.col("lo").cast("double"), F.col("hi").cast("double")))
    return out.select(dataset, "n_samples", ages.alias("ages"), "conditions", "sexes", "platform")


def labels(df: DataFrame, column: str, control: str | None = None) -> DataFrame:
    """Distinct known labels as text, without the control label."""
    out = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("label")).distinct()
    return out.where(F.lower("label") != control.lower()) if control else out


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows by a digest of seed and key: the same rows each time."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def examples(df: DataFrame, keys: Sequence[str], value: str, n: int = 5, seed: int = 0) -> DataFrame:
    """``keys, place, value``: ``n`` different known values per ``keys``, drawn by a digest of seed, keys and value.

    The same values each time, on any partitions.  Tasks keep the ``n`` smallest digests of
    each key and these are merged, so a key with most rows costs no more than the others.
    """
    different = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("string").alias("value")).distinct()
    dice = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], "value"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_dice", "value"))
    return different.withColumn("_dice", dice).withColumn("place", place).where(F.col("place") <= n).select(*keys, "place", "value")
