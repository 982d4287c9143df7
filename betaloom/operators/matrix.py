"""Sample-by-probe matrices in long form: ``accession, sample_id, probe, value``; a missing cell is a null or no row.

One Spark column per probe would break planning at the width of real arrays (10^5 to
10^6 probes); in long form a matrix is an ordinary table that is partitioned by keys.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean(value: Column) -> Column:
    """NaN as null: Spark counts NaN as the largest value, which no rule here wants."""
    return F.when(~F.isnan(value), value)


def from_arrays(df: DataFrame, sample: str, values: str, accession: str | None = None) -> DataFrame:
    """Dense rows (one array per sample) to long form; probes are 0-based places."""
    key = F.col(accession).cast("string") if accession else F.lit("all")
    long = df.select(key.alias("accession"), F.col(sample).alias("sample_id"), F.posexplode(values).alias("probe", "value"))
    return long.select("accession", "sample_id", F.col("probe").cast("bigint").alias("probe"), clean(F.col("value").cast("double")).alias("value"))


def to_arrays(long: DataFrame) -> DataFrame:
    """Long form to one array per sample, ordered by probe; a sample's probes bound the array."""
    cells = F.sort_array(F.collect_list(F.struct("probe", "value")))
    return long.groupBy("accession", "sample_id").agg(F.transform(cells, lambda c: c["value"]).alias("values"))


def from_wide(df: DataFrame, sample: str, probes: Iterable[str]) -> DataFrame:
    """Wide to long."""
    return df.unpivot([sample], list(probes), "probe", "value").withColumn("value", clean(F.col("value").cast("double")))


def to_wide(long: DataFrame, sample: str = "sample_id", probes: Iterable | None = None) -> DataFrame:
    """Long to wide, for small probe sets: the full outer merge of the samples' tables."""
    return long.groupBy(sample).pivot("probe", list(probes) if probes is not None else None).agg(F.first("value", ignorenulls=True))


def transpose(long: DataFrame) -> DataFrame:
    """In long form a renaming."""
    return long.withColumnsRenamed({"sample_id": "probe", "probe": "sample_id"})


def union(*parts: DataFrame) -> DataFrame:
    """Row concatenation; columns that a part lacks become null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def with_probe_prefix(long: DataFrame, prefix: str = "cg", probe: str = "probe") -> DataFrame:
    return long.where(F.lower(F.col(probe)).startswith(prefix.lower()))


def orientation(labels: DataFrame, axis: str = "axis", label: str = "label", mark: str = "cg") -> DataFrame:
    """Which axis holds the probes: more labels that contain the mark; a tie is neither. One row."""
    hit = F.lower(F.col(label)).contains(mark)
    counts = labels.agg(F.count_if((F.col(axis) == "columns") & hit).alias("in_columns"), F.count_if((F.col(axis) == "rows") & hit).alias("in_rows"))
    return counts.select("in_columns", "in_rows", (F.col("in_columns") > F.col("in_rows")).alias("columns"), (F.col("in_rows") > F.col("in_columns")).alias("rows"))


def common_probes(batches: DataFrame, platform: str, probe: str) -> DataFrame:
    """Probes that every platform has; aggregated to distinct pairs before the count."""
    n = batches.select(platform).distinct().agg(F.count("*").alias("n"))
    shared = batches.select(platform, probe).distinct().groupBy(probe).agg(F.count("*").alias("k"))
    return shared.join(F.broadcast(n), F.col("k") == F.col("n")).select(probe)  # n is one row


def align(long: DataFrame, samples: DataFrame, wanted: DataFrame) -> DataFrame:
    """Cells of the wanted probes for every sample, null where there is none; other probes drop out.

    ``wanted`` is a model's probe list: one row's array, exploded beside each sample, so
    samples times probes is the size of the result.
    """
    listed = wanted.agg(F.collect_set("probe").alias("_probes"))
    grid = samples.select("accession", "sample_id").distinct().join(F.broadcast(listed)).select("accession", "sample_id", F.explode("_probes").alias("probe"))
    return grid.join(long, ["accession", "sample_id", "probe"], "left")


def align_kept(long: DataFrame, samples: DataFrame, probes: DataFrame) -> DataFrame:
    """Every kept sample times every kept probe of its accession, null where there is no cell."""
    grid = samples.join(probes, "accession")
    return grid.join(long, ["accession", "sample_id", "probe"], "left").select("accession", "sample_id", "probe", "value")


def detection_filter(df: DataFrame, detection: str | None = None, cutoff: float = 0.05, inclusive: bool = True) -> DataFrame:
    """Rows whose detection p-value passes; without such a column all rows."""
    if detection is None:
        detection = next((c for c in df.columns if "detection" in c.lower()), None)
        if detection is None:
            return df
    p = clean(F.col(detection).cast("double"))
    return df.where(p <= cutoff if inclusive else p < cutoff)


def detection_mask(pairs: DataFrame, keys: list[str], value: str = "value", detection: str = "detection", cutoff: float = 0.05) -> DataFrame:
    """Value kept where its p-value is under the cutoff, else null.

    Where detection equals the values in a whole column pair (``keys``), it is no p-value
    and nothing is masked.
    """
    v, p = clean(F.col(value).cast("double")), clean(F.col(detection).cast("double"))
    same = pairs.groupBy(*keys).agg(F.bool_and(v.eqNullSafe(p)).alias("_same"))
    out = pairs.join(same, keys)
    return out.withColumn(value, F.when(F.col("_same") | (p < cutoff), v)).drop("_same")
