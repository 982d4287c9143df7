"""Joins of matrices, metadata and predictions, and the set operations on their keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_sample(values: DataFrame, subjects: DataFrame, subject: str, mapped: str, sample: str) -> DataFrame:
    """Values keyed by subject, keyed anew by sample: inner on ``subject`` = ``mapped``.

    A subject may stand for several samples and a sample for several subjects; what has no
    partner drops out.
    """
    named = subjects.select(F.col(mapped).alias("_subject"), F.col(sample).alias("_sample"))
    return values.join(named, F.col(subject) == F.col("_subject")).drop("_subject", subject).withColumnRenamed("_sample", sample)


def with_metadata(values: DataFrame, metadata: DataFrame, key: str, other: str | None = None) -> DataFrame:
    """Metadata of each row by its sample; rows without metadata drop out."""
    other = other or key
    renamed = metadata.withColumnRenamed(other, "_key")
    return values.join(renamed, F.col(key) == F.col("_key")).drop("_key")


def with_predictions(rows: DataFrame, predictions: DataFrame, on: Sequence[str]) -> DataFrame:
    """All rows, with predictions where all of ``on`` are equal; null keys are equal."""
    renamed = predictions.withColumnsRenamed({c: f"_{c}" for c in on})
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(renamed, same, "left").drop(*[f"_{c}" for c in on])


def merged(parts: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Results of several models beside each other, for samples that all of them have.

    ``on`` is a key of each part, its first column known and null others equal; parts have no
    other column in common.  Parts are joined one after the other, sorted by key: no task keeps
    a table of keys, and parts that are dealt by the key already aren't shuffled again.
    """
    columns = [c for part in parts for c in part.columns if c not in on]
    if len(columns) != len(set(columns)):
        raise ValueError("two parts have a column in common")
    out = parts[0].where(F.col(on[0]).isNotNull())
    for part in parts[1:]:
        other = part.withColumnsRenamed({c: f"_{c}" for c in on}).hint("merge")
        same = F.col(on[0]) == F.col(f"_{on[0]}")
        for c in on[1:]:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        out = out.join(other, same).drop(*[f"_{c}" for c in on])
    return out.select(*on, *columns)


def done(rows: DataFrame, artifacts: DataFrame, key: str) -> DataFrame:
    return rows.join(artifacts.select(key), key, "left_semi")


def pending(rows: DataFrame, artifacts: DataFrame, key: str) -> DataFrame:
    return rows.join(artifacts.select(key), key, "left_anti")


def in_both(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of both; the semi join needs no row of ``b`` twice."""
    return a.select(key).join(b.select(key), key, "left_semi").distinct()


def in_first_only(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).join(b.select(key), key, "left_anti").distinct()


def in_either(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct known keys of one or both."""
    return a.select(key).unionByName(b.select(key)).where(F.col(key).isNotNull()).distinct()
