"""Artifacts, steps and contracts: the bookkeeping of runs as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DONE = ("completed", "failed", "canceled")


def keep_one(df: DataFrame, keys: Sequence[str], order: str, last: bool = True) -> DataFrame:
    """The last (or first) row per key; ``order`` breaks all ties. An aggregate, so hot keys shrink before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    pick = (F.max_by if last else F.min_by)(F.struct(*rest), F.col(order))
    return df.groupBy(*keys).agg(pick.alias("s")).select(*[F.col(c) if c in keys else F.col("s")[c].alias(c) for c in df.columns])


def content_digest(df: DataFrame) -> DataFrame:
    """Order-insensitive digest of a table's rows. One row."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    part = lambda k: F.conv(F.substring(row, k, 8), 16, 10).cast("bigint")
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(part(1)), F.lit(0)).alias("d1"), F.coalesce(F.sum(part(9)), F.lit(0)).alias("d2"))


def composite_id(values: Column) -> Column:
    return F.sha2(F.array_join(F.sort_array(values), ""), 256)


def prefer(artifacts: DataFrame, accession: str, kind: str, order: Sequence[str]) -> DataFrame:
    """Per accession the artifact of the most preferred kind."""
    rank = F.array_position(F.array(*[F.lit(k) for k in order]), F.col(kind))
    ranked = artifacts.where(rank > 0).withColumn("_rank", rank)
    return keep_one(ranked, [accession], "_rank", last=False).drop("_rank")


def status_counts(steps: DataFrame, keys: Sequence[str], status: str = "status") -> DataFrame:
    is_ = lambda *names: F.count_if(F.col(status).isin(*names))
    return steps.groupBy(*keys).agg(is_("completed").alias("completed"), is_("not_started").alias("not_started"), is_("not_started", "running").alias("in_progress"), is_("failed").alias("failed"), is_("canceled").alias("canceled"), F.bool_and(F.col(status).isin(*DONE)).alias("all_done"))


def batch_status(results: DataFrame, keys: Sequence[str], ok: Column) -> DataFrame:
    good, n = F.count_if(ok), F.count("*")
    return results.groupBy(*keys).agg(F.when(good == n, "success").when(good == 0, "failed").otherwise("partial").alias("status"), good.alias("n_ok"), n.alias("n"))


def missing_prerequisites(accessions: DataFrame, steps: DataFrame, prerequisite: str, accession: str = "accession") -> DataFrame:
    done = steps.where((F.col("step") == prerequisite) & (F.col("status") == "completed")).select(F.col(accession).alias("_a"))
    return accessions.join(done, F.col(accession) == F.col("_a"), "left_anti")


def propagate_failures(steps: DataFrame, failed: DataFrame, step: str, downstream: Sequence[str]) -> DataFrame:
    """A failed accession's step fails, its downstream steps are canceled."""
    bad = failed.select(F.col("accession").alias("_a")).distinct()
    out = steps.join(bad, F.col("accession") == F.col("_a"), "left")
    hit = F.col("_a").isNotNull()
    status = F.when(hit & (F.col("step") == step), "failed").when(hit & F.col("step").isin(*downstream), "canceled").otherwise(F.col("status"))
    return out.withColumn("status", status).drop("_a")


def pending(names: DataFrame, made: DataFrame, name: str, path: str, suffix: str = "_proc") -> DataFrame:
    """Files without a processed twin."""
    return names.join(made.select(F.col(path).alias("_p")), F.concat(F.col(name), F.lit(suffix)) == F.col("_p"), "left_anti")


def urls_containing(urls: DataFrame, names: Sequence[str], url: str) -> DataFrame:
    """URLs that contain a chosen name; the choice is a short list of parameters."""
    if not names:
        return urls.limit(0)
    hit = F.lit(False)
    for n in names:
        hit = hit | F.col(url).contains(n)
    return urls.where(hit)


def is_methylation(title: Column, platform: Column, known: Sequence[str] = ()) -> Column:
    """A part of the title names methylation, or the platform is a known one."""
    named = F.exists(F.split(title, ","), lambda x: F.lower(x).contains("methy"))
    return F.coalesce(named, F.lit(False)) | F.coalesce(platform.isin(*known) if known else F.lit(False), F.lit(False))


# Categories of errors by the exception's type, subclasses before their bases; the messages are our own.
ERRORS = (
    ("http_error", ("HTTPError",), "The server answered with an error; a later attempt may succeed."),
    ("network_error", ("URLError", "timeout", "gaierror", "ConnectionResetError", "TimeoutError", "SSLError"), "No connection could be made; look at the network and its filters."),
    ("ftp_error", ("error_reply", "error_temp", "error_perm", "error_proto"), "The file server refused the transfer; try another time or network."),
    ("filesystem_error", ("PermissionError", "FileNotFoundError", "OSError"), "Files could not be written; look at rights and free space."),
    ("corrupt_geo_record", ("BadGzipFile", "EOFError", "ValueError", "KeyError"), "The record is damaged or has an unknown layout."),
    ("geo_parse_error", ("RuntimeError",), "The record could not be read."),
)
NO_SPACE = 28


def error_class(kind: Column, errno: Column) -> Column:
    """``struct<category, user_message>`` of an error's type name and number."""
    full = F.struct(F.lit("disk_full").alias("category"), F.lit("The disk is too full for this download.").alias("user_message"))
    out = F.when(kind.isin("PermissionError", "FileNotFoundError", "OSError") & (errno == NO_SPACE), full)
    for category, kinds, message in ERRORS:
        out = out.when(kind.isin(*kinds), F.struct(F.lit(category).alias("category"), F.lit(message).alias("user_message")))
    return out.otherwise(F.struct(F.lit("unknown_error").alias("category"), F.lit("The download failed for an unknown reason.").alias("user_message")))


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows that break a check, with its name; a null condition counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))
    return df.withColumn("violation", F.explode(broken))


def developer_message(kind: Column, message: Column, step: Column) -> Column:
    """What a log should say of an error: its step, type and text."""
    return F.concat_ws(" ", F.concat(F.lit("["), step, F.lit("]")), F.concat(kind, F.lit(":")), F.coalesce(message, F.lit("no text")))


def register_files(spark: SparkSession, pattern: str, recorded: Column | None = None) -> DataFrame:
    """``path, bytes, sha256, recorded_at`` of each file that matches, by Spark's own reader; UTC time."""
    files = spark.read.format("binaryFile").load(pattern)
    when = recorded if recorded is not None else F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), when.alias("recorded_at"))


def run_id(started: Column, key: Column) -> Column:
    """Time to the second and eight hexadecimal digits, which follow from the key."""
    return F.concat(F.date_format(started, "yyyyMMdd'T'HHmmss"), F.lit("-"), F.substring(F.sha2(key.cast("string"), 256), 1, 8))


def natural_key(value: Column) -> Column:
    """Sort key of shown text: numbers in it compare as numbers, case doesn't count, nulls last by ``asc_nulls_last``."""
    parts = F.regexp_extract_all(F.lower(value), F.lit(r"([0-9]+|[^0-9]+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, 20, "0")).otherwise(p)), "")
