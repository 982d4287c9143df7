"""Decisions about studies, rules and runs as filters and joins on small tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()


def active_accessions(steps: DataFrame, accession: str = "accession", status: str = "status") -> DataFrame:
    """Accessions in work: upper case, neither failed nor resolved, each once."""
    return steps.where(~F.col(status).isin("failed", "resolved")).select(F.upper(accession).alias("accession")).distinct()


def work_queue(accessions: DataFrame, n: int = 5, accession: str = "accession") -> DataFrame:
    """The smallest first."""
    return accessions.orderBy(accession).limit(n)


def split_control(df: DataFrame, column: str, control: str) -> tuple[DataFrame, DataFrame]:
    """(control rows, distinct other values)."""
    other = df.where(F.col(column).isNotNull() & (F.col(column) != control)).select(column).distinct()
    return df.where(F.col(column) == control), other


def large_enough(df: DataFrame, group: str, control: Column, least: int = 10) -> DataFrame:
    """Groups with at least ``least`` rows on both sides."""
    n = df.groupBy(group).agg(F.count_if(control).alias("n_control"), F.count_if(~control).alias("n_other"))
    return n.where((F.col("n_control") >= least) & (F.col("n_other") >= least))


def not_allowed(rules: DataFrame, allowed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rules whose keys are outside the closed domain."""
    return rules.join(allowed.select(*keys).distinct(), list(keys), "left_anti")


def inconsistent_results(results: DataFrame) -> DataFrame:
    """failed exactly with an error, success only with an artifact."""
    failed, good = F.col("status") == "failed", F.col("status") == "success"
    return results.where((failed != F.col("error").isNotNull()) | (good & F.col("artifact").isNull()))


def invalid_accessions(df: DataFrame, accession: str, prefix: str = "GSE") -> DataFrame:
    return df.where(~F.coalesce(F.upper(F.trim(F.col(accession).cast("string"))).startswith(prefix), F.lit(False)))


def set_status(steps: DataFrame, when: Column, status: str, at: Column) -> DataFrame:
    """Status of the chosen steps; a final one also ends the step."""
    out = steps.withColumn("status", F.when(when, F.lit(status)).otherwise(F.col("status")))
    ended = F.lit(status in ("completed", "failed", "canceled"))
    return out.withColumn("finished_at", F.when(when & ended, at).otherwise(F.col("finished_at")))


def reviewed(requests: DataFrame, decisions: DataFrame, key: str, order: str, decision: str = "decision") -> DataFrame:
    """Every request with its last decision, the largest among equals of ``order``; ``pending`` without one."""
    last = decisions.groupBy(F.col(key).alias("_k")).agg(F.max(F.struct(order, decision))[decision].alias("_d"))
    return requests.join(last, F.col(key) == F.col("_k"), "left").withColumn(decision, F.coalesce("_d", F.lit("pending"))).drop("_k", "_d")


def new_artifacts(now: DataFrame, before: DataFrame, path: str = "path") -> DataFrame:
    return now.join(before.select(path).distinct(), path, "left_anti")


def without_file(names: DataFrame, paths: DataFrame, name: str, path: str, ending: str = ".pt") -> DataFrame:
    """Names for which no path ends in the lower-cased name and the ending; the last part of a path is the join key."""
    have = paths.select(F.element_at(F.split(F.lower(path), "/"), -1).alias("_f")).distinct()
    return names.join(have, F.concat(F.lower(name), F.lit(ending)) == F.col("_f"), "left_anti")


def state_summary(steps: DataFrame, accession: str = "accession", prerequisites: dict[str, str] | None = None) -> DataFrame:
    """``step=status`` list per accession and whether each route is legal."""
    pairs = F.array_sort(F.collect_list(F.concat("step", F.lit("="), "status")))
    out = steps.groupBy(accession).agg(pairs.alias("p"))
    columns = [F.col(accession), F.array_join("p", ", ").alias("steps")]
    for route, step in (prerequisites or {}).items():
        columns.append(F.when(F.array_contains("p", f"{step}=completed"), "LEGAL").otherwise("ILLEGAL").alias(route))
    return out.select(*columns)


def progress(done: Column, total: Column) -> Column:
    return F.format_string("%d of %d datasets", done, total)


def download_status(results: DataFrame) -> DataFrame:
    """One row: success if none failed, failed if all did, else partial."""
    failed, n = F.count_if(F.col("status") == "failed"), F.count("*")
    return results.agg(F.when(failed == 0, "success").when(failed == n, "failed").otherwise("partial").alias("batch_status"), n.alias("n"), failed.alias("n_failed"))
