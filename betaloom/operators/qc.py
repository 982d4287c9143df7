"""Quality control of a long matrix.

Missing cells may be absent rows, so denominators come from the probe and sample
dimensions, never from the cells alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = ["accession", "sample_id"]


def dimensions(long: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(samples, probes per accession)."""
    return long.select(*SAMPLE).distinct(), long.select("accession", "probe").distinct()


def sample_profile(long: DataFrame, samples: DataFrame, probes: DataFrame) -> DataFrame:
    """``missing`` share and ``largest`` value per sample, in one aggregation."""
    n = probes.groupBy("accession").agg(F.count("*").alias("n_probes"))
    held = long.groupBy(*SAMPLE).agg(F.count("value").alias("known"), F.max("value").alias("largest"))
    out = samples.join(held, SAMPLE, "left").join(n, "accession")
    return out.select(*SAMPLE, (1 - F.coalesce("known", F.lit(0)) / F.col("n_probes")).alias("missing"), "largest")


def keep_samples(profile: DataFrame, missing: float | None = 0.1, largest: float | None = 0.96) -> DataFrame:
    """``kept`` per sample: missing share at most, largest value strictly above; a sample without values goes."""
    ok = F.lit(True)
    if missing is not None:
        ok = ok & (F.col("missing") <= missing + 1e-12)
    if largest is not None:
        ok = ok & F.coalesce(F.col("largest") > largest, F.lit(False))
    return profile.withColumn("kept", ok)


def probe_profile(long: DataFrame, samples: DataFrame, probes: DataFrame, cutoff: float = 0.2) -> DataFrame:
    """``missing`` share and ``kept`` per probe over the given samples."""
    n = samples.groupBy("accession").agg(F.count("*").alias("n_samples"))
    held = long.join(samples.select(*SAMPLE), SAMPLE, "left_semi").groupBy("accession", "probe").agg(F.count("value").alias("known"))
    out = probes.join(held, ["accession", "probe"], "left").join(n, "accession")
    share = 1 - F.coalesce("known", F.lit(0)) / F.col("n_samples")
    return out.select("accession", "probe", share.alias("missing"), (share <= cutoff + 1e-12).alias("kept"))


def mean_correlations(long: DataFrame) -> DataFrame:
    """Per sample the mean Pearson correlation with the accession's other samples.

    With rows centred and scaled to length one, the sum over all partners is the product
    with the sum of all rows, so two aggregations replace the table of pairs:
    (z . S - 1) / (n - 1).  Cells must be complete.  A constant sample has no
    correlation: ``constant`` marks it, and its accession's means are null, as are those
    of a single sample.
    """
    stats = long.groupBy(*SAMPLE).agg(F.avg("value").alias("mu"), F.sqrt(F.sum(F.col("value") * F.col("value")) - F.count("value") * F.avg("value") * F.avg("value")).alias("norm"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    stats = stats.withColumn("constant", F.col("lo") == F.col("hi")).drop("lo", "hi")
    per = stats.groupBy("accession").agg(F.count("*").alias("n"), F.bool_or("constant").alias("any_constant"))
    z = long.join(stats, SAMPLE).select(*SAMPLE, "probe", F.when(~F.col("constant"), F.try_divide(F.col("value") - F.col("mu"), "norm")).alias("z"))
    total = z.groupBy("accession", "probe").agg(F.sum("z").alias("s"))
    dots = z.join(total, ["accession", "probe"]).groupBy(*SAMPLE).agg(F.sum(F.col("z") * F.col("s")).alias("dot"))
    out = stats.select(*SAMPLE, "constant").join(dots, SAMPLE).join(per, "accession")
    mean = F.when(~F.col("any_constant") & (F.col("n") > 1), (F.col("dot") - 1) / (F.col("n") - 1))
    return out.select(*SAMPLE, mean.alias("mean_correlation"), "constant")


def keep_correlated(correlations: DataFrame, cutoff: float = 0.9) -> DataFrame:
    """``kept``: mean strictly above the cutoff; all of an accession without means (see ``note``)."""
    known = F.col("mean_correlation").isNotNull()
    return correlations.select("*", (~known | (F.col("mean_correlation") > cutoff)).alias("kept"), F.when(~known, "correlations undefined; nothing removed").alias("note"))


def removed(profile: DataFrame, ids: list[str]) -> DataFrame:
    return profile.where(~F.col("kept")).select(*ids)


def summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per accession: samples before and after, probes after."""
    b = before.groupBy("accession").agg(F.count_distinct("sample_id").alias("samples_before"))
    a = after.groupBy("accession").agg(F.count_distinct("sample_id").alias("samples_after"), F.count_distinct("probe").alias("probes_after"))
    return b.join(a, "accession", "left").select("accession", "samples_before", F.coalesce("samples_after", F.lit(0)).cast("bigint").alias("samples_after"), F.coalesce("probes_after", F.lit(0)).cast("bigint").alias("probes_after"))
