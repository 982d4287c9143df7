"""Upper tail of Student's t by the continued fraction of the incomplete beta function."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def tail(t: float, df: float) -> float:
    """P(T > t)."""
    if math.isnan(t) or math.isnan(df) or df <= 0:
        return math.nan
    half = 0.5 * _regularized(df / 2, 0.5, df / (df + t * t))
    return half if t >= 0 else 1 - half


def _regularized(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _fraction(a, b, x) / a
    return 1 - front * _fraction(b, a, 1 - x) / b


def _fraction(a: float, b: float, x: float) -> float:
    """Lentz's evaluation."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + n * d, 1 + n / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def upper_tail(t: Column, df: Column) -> Column:
    """As a column, in Arrow batches; null where a side is null."""
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([tail(x, y) for x, y in zip(np.asarray(a, float), np.asarray(b, float))])

    return F.when(t.isNotNull() & df.isNotNull(), run(t.cast("double"), df.cast("double")))
