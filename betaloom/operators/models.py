"""Linear and PCA-based models over a long matrix."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# Names of the models; their weights are inputs.
MODEL_NAMES = (
    "altumage", "dunedinpace", "dnamic", "dnamphenoage", "grimage", "grimage2", "horvath2013", "hannum", "intrinclock", "pcgrimage", "pchannum",
    "pchorvath2013", "pcphenoage", "pcskinandblood", "skinandblood", "systemsage", "systemsageblood", "corticalage", "pcbrainage", "systemsagebrain",
    "systemsageheart", "systemsagehormone", "systemsageimmune", "systemsageinflammation", "systemsagekidney", "systemsageliver", "systemsagelung",
    "systemsagemetabolic", "systemsagemusculoskeletal", "zhangblup", "zhangen", "zhangmortality",
)
#: Models that need the sex of every sample.
NEED_SEX = ("grimage", "grimage2", "pcgrimage")


def usable(models: Sequence[str], metadata: DataFrame, sex: str = "Sex") -> list[str]:
    """Without the models that need sex if a sample has none; one aggregate decides."""
    unknown = set(models) - set(MODEL_NAMES)
    if unknown:
        raise ValueError(f"unknown models: {sorted(unknown)}")
    incomplete = metadata.agg(F.coalesce(F.bool_or(F.col(sex).isNull()), F.lit(False))).first()[0]
    return sorted((m for m in models if not (incomplete and m in NEED_SEX)), key=str.lower)


def adult_link(x: Column, adult: float = 20.0) -> Column:
    """Inverse of the age transform: exponential below zero, linear above."""
    return F.when(x < 0, (1 + adult) * F.exp(x) - 1).otherwise((1 + adult) * x + adult)


def predict(long: DataFrame, coefficients: DataFrame, models: DataFrame) -> DataFrame:
    """``accession, sample_id, model, predicted`` of complete inputs.

    coefficients: ``model, probe, weight``; models: ``model, intercept, link`` with link
    ``adult_age`` or ``identity``.  All models are scored in one join and one
    aggregation; a model with two weights for a probe counts their sum.
    """
    names = sorted({r["model"] for r in models.select("model").distinct().collect()})  # a name a model
    if not names:
        return long.sparkSession.createDataFrame([], f"accession {long.schema['accession'].dataType.simpleString()}, sample_id {long.schema['sample_id'].dataType.simpleString()}, model string, predicted double")
    # a column of weights a model, so that a cell stays one row however many models there are
    weights = [F.sum(F.when(F.col("model") == m, F.col("weight"))).alias(f"_w{k}") for k, m in enumerate(names)]
    met = long.join(coefficients.groupBy("probe").agg(*weights), "probe").groupBy("accession", "sample_id")
    totals = met.agg(*[F.sum(F.col("value") * F.col(f"_w{k}")).alias(f"_x{k}") for k in range(len(names))], *[F.count(f"_w{k}").alias(f"_n{k}") for k in range(len(names))])
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"_x{k}").alias("x"), F.col(f"_n{k}").alias("n")) for k, m in enumerate(names)]))
    sums = totals.select("accession", "sample_id", each.alias("s")).select("accession", "sample_id", "s.model", "s.x", "s.n").where("n > 0").drop("n")
    scored = sums.join(models, "model").withColumn("x", F.col("x") + F.col("intercept"))
    return scored.select("accession", "sample_id", "model", F.when(F.col("link") == "adult_age", adult_link(F.col("x"))).otherwise(F.col("x")).alias("predicted"))


def fold_pca(spark: SparkSession, name: str, probes: Sequence, rotation: np.ndarray, center: np.ndarray, weights: np.ndarray, intercept: float) -> tuple[DataFrame, DataFrame]:
    """((x - c) R) b + a as one weight per probe, so that both kinds share one kernel."""
    w = rotation @ weights
    rows = [(name, p, float(v)) for p, v in zip(probes, w)]
    kind = "bigint" if all(isinstance(p, int) for p in probes) else "string"
    return spark.createDataFrame(rows, f"model string, probe {kind}, weight double"), spark.createDataFrame([(name, float(intercept - center @ w), "identity")], "model string, intercept double, link string")


def acceleration(predictions: DataFrame, keys: Sequence[str], predicted: str = "predicted", age: str = "age", paced: Sequence[str] = ("dunedinpace",), model: str | None = None) -> DataFrame:
    """``accel``: residual of predicted ~ 1 + age per ``keys``; null without both; paced models copy the prediction."""
    both = F.col(predicted).isNotNull() & F.col(age).isNotNull()
    y, x = F.when(both, F.col(predicted)), F.when(both, F.col(age))
    fits = predictions.groupBy(*keys).agg(F.regr_slope(y, x).alias("_slope"), F.regr_intercept(y, x).alias("_at"))
    out = predictions.join(fits, list(keys))
    residual = F.when(both, F.col(predicted) - (F.col("_at") + F.col("_slope") * F.col(age)))
    if model:
        residual = F.when(F.lower(F.col(model)).isin(*paced), F.col(predicted)).otherwise(residual)
    return out.withColumn("accel", residual).drop("_slope", "_at")
