"""Value types of a matrix: detection and conversion between beta and M values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def type_share(long: DataFrame, value: str = "value") -> DataFrame:
    """``share`` of known cells in [0, 1] and ``data_type``: beta above 0.95, else m. One row; share null without cells."""
    inside = F.count_if(F.col(value).between(0, 1))
    share = F.try_divide(inside, F.count(value))
    return long.agg(share.alias("share")).select("share", F.when(F.col("share") > 0.95, "beta").otherwise("m").alias("data_type"))


def beta_to_m(beta: Column, low: float | None = None, high: float | None = None) -> Column:
    """log2(b / (1 - b)); null at 1 and, as no number results, at 0 and outside (0, 1)."""
    if low is not None:
        beta = F.greatest(beta, F.lit(low))
    if high is not None:
        beta = F.least(beta, F.lit(high))
    inside = (beta > 0) & (beta < 1)
    return F.when(inside, F.log2(F.try_divide(beta, 1 - beta)))


def m_to_beta(m: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(2.0), -m))


def convert(long: DataFrame, source: str, target: str, value: str = "value", low: float | None = None, high: float | None = None) -> DataFrame:
    if source == target:
        return long
    if (source, target) == ("m", "beta"):
        return long.withColumn(value, m_to_beta(F.col(value)))
    if (source, target) == ("beta", "m"):
        return long.withColumn(value, beta_to_m(F.col(value), low, high))
    raise ValueError(f"no conversion from {source!r} to {target!r}")
