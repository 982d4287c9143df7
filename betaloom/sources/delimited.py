"""Supplementary matrices in delimited text: header, delimiter, probe column and column pairs are found, the rest is Spark's."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matrix import clean, detection_mask
from .shared import written

DELIMITERS = ("\t", ",", " ")
HEADER_LINES, LIGHT_ROWS, LIGHT_ROWS_WIDE, WIDE = 20, 2000, 20, 5000


def delimiter(line: str) -> str:
    """Tab, then comma, then blank."""
    for d in DELIMITERS:
        if d in line:
            return d
    raise ValueError("no delimiter in the header")


def header(spark: SparkSession, path: str) -> tuple[str, str]:
    """(header line, delimiter): the first line that is neither blank nor a comment, within the first 20."""
    for r in spark.read.text(path).limit(HEADER_LINES).collect():
        if r.value.strip() and not r.value.lstrip().startswith("#"):
            return r.value, delimiter(r.value)
    raise ValueError(f"no header within {HEADER_LINES} lines of {path}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, names lowered and stripped; plain or gzip; ``#`` lines skipped."""
    line, d = header(spark, path)
    raw = spark.read.csv(path, sep=d, header=True, comment="#", quote='"')
    return raw.toDF(*[(c or "").strip().strip('"').lower() for c in line.split(d)])


def light(df: DataFrame) -> DataFrame:
    return df.limit(LIGHT_ROWS_WIDE if len(df.columns) >= WIDE else LIGHT_ROWS)


def probe_column(df: DataFrame, share: float = 0.9, first: int = 5, prefix: str = "cg") -> str:
    """The first of the leading columns whose known values carry the prefix, as written, for the most part; one aggregation."""
    names = df.columns[:first]
    shares = df.agg(*[F.avg(F.col(f"`{c}`").startswith(prefix).cast("int")).alias(f"s{k}") for k, c in enumerate(names)]).first()
    for k, c in enumerate(names):
        if shares[k] is not None and shares[k] > share:
            return c
    raise ValueError("no column holds probe ids")


def platform_probe_column(df: DataFrame, share: float = 0.9, prefix: str = "cg") -> str:
    """The first column of a platform table whose known values carry the prefix in either case, for at least ``share``."""
    shares = df.agg(*[F.avg(F.lower(F.col(f"`{c}`").cast("string")).startswith(prefix).cast("int")).alias(f"s{k}") for k, c in enumerate(df.columns)]).first()
    for k, c in enumerate(df.columns):
        if shares[k] is not None and shares[k] >= share:
            return c
    raise ValueError("no column holds probe ids")


def columns_like(columns: list[str], pattern: str) -> tuple[list[str], list[str]]:
    """(matching, missing), case not counted."""
    hit = [c for c in columns if re.search(pattern, c, re.IGNORECASE)]
    return hit, [c for c in columns if c not in hit]


def unchanged(columns: list[str], old: tuple[str, str], new: tuple[str, str]) -> bool:
    """Whether two attempts at the (value, detection) patterns choose the same columns."""
    return all(columns_like(columns, a) == columns_like(columns, b) for a, b in zip(old, new))


def has_detection(n_columns: int, n_rows: int) -> bool:
    """More rows than columns: samples have pairs of columns and probes are rows."""
    return n_columns < n_rows


def pair_columns(spark: SparkSession, values: list[str], detections: list[str]) -> dict[str, str]:
    """Each value column's best detection column by lexical score; both lists are one header."""
    from ..operators.lexical import best

    a, b = (spark.createDataFrame([(c,) for c in names], "c string") for names in (values, detections))
    return {r["a"]: r["b"] for r in best(a, b, "c", "c").collect()}


def pairs_by_position(columns: list[str], value_pattern: str, detection_pattern: str) -> dict[str, str]:
    """The n-th value column with the n-th detection column; as many of one as of the other."""
    detections = columns_like(columns, detection_pattern)[0]
    values = [c for c in columns_like(columns, value_pattern)[0] if c not in detections]
    if len(values) != len(detections):
        raise ValueError(f"{len(values)} value columns, {len(detections)} detection columns")
    return dict(zip(values, detections))


def to_long(df: DataFrame, probe: str, values: list[str], detections: dict[str, str] | None = None, accession: str = "all", cutoff: float = 0.05) -> DataFrame:
    """Columns to ``accession, sample_id, probe, value``; with detections cells at or above the cutoff are null."""
    number = lambda c: clean(F.col(f"`{c}`").try_cast("double"))
    cells = F.array(*[F.struct(F.lit(c).alias("sample_id"), number(c).alias("value"), (number(detections[c]) if detections else F.lit(None).cast("double")).alias("detection")) for c in values])
    long = df.where(F.col(f"`{probe}`").isNotNull()).select(F.lit(accession).alias("accession"), F.col(f"`{probe}`").alias("probe"), F.inline(cells))
    if detections:
        long = detection_mask(long, ["accession", "sample_id"], cutoff=cutoff)
    return long.select("accession", "sample_id", "probe", "value")


def _fields(line: Column, d: str) -> Column:
    """A line's fields; quoted ones may hold the delimiter, a doubled quote stands for one."""
    e = re.escape(d)
    quoted = F.regexp_extract_all(F.concat(F.lit(d), line), F.lit(f'{e}("(?:[^"]++|"")*+"|[^{e}]*)'), 1)
    bare = F.transform(quoted, lambda v: F.when(v.rlike(r'(?s)^".*"$'), F.replace(F.substr(v, F.lit(2), F.length(v) - 2), F.lit('""'), F.lit('"'))).otherwise(v))
    return F.when(line.contains('"'), bare).otherwise(F.split(line, e, -1))


def lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, str]:
    """(lines of data as ``value``, one row with the header as ``line``, delimiter); the header may be of any width.

    The header is the first line of the first file that is neither blank nor a comment; files
    may repeat it.
    """
    text = spark.read.text(path)
    first = text.where("_metadata.file_block_start = 0").select(F.col("_metadata.file_path").alias("file"), "value").withColumn("n", F.monotonically_increasing_id())
    counts = (F.trim("value") != "") & ~F.ltrim("value").startswith("#")
    heads = first.groupBy("file").agg(F.min("n").alias("least"), F.min(F.when(counts, F.col("n"))).alias("n"), F.min_by(F.when(counts, F.col("value")), F.when(counts, F.col("n"))).alias("line"))
    head = written(heads.orderBy("file").limit(1), "header")
    found = head.select((F.col("n") - F.col("least")).alias("at"), *[F.contains("line", F.lit(d)).alias(f"d{k}") for k, d in enumerate(DELIMITERS)]).first()
    if found is None or found["at"] is None or found["at"] >= HEADER_LINES:
        raise ValueError(f"no header within {HEADER_LINES} lines of {path}")
    d = delimiter("".join(d for k, d in enumerate(DELIMITERS) if found[f"d{k}"]))
    head = head.select("line")
    data = text.where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    return data.join(F.broadcast(head), F.col("value") != F.col("line")).select("value"), head, d


def _columns(head: DataFrame, d: str, probe: int, value_pattern: str, detection_pattern: str | None) -> DataFrame:
    """One row, ``columns array<struct<sample_id, v, d>>``: names of value columns, their places and those of their detections."""
    from ..operators.lexical import best

    clean_name = lambda c: F.lower(F.btrim(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit('"')))
    named = F.transform(_fields(F.col("line"), d), lambda c, k: F.struct(clean_name(c).alias("name"), k.alias("k")))
    others = head.select(F.filter(named, lambda c: c["k"] != probe).alias("c"))
    like = lambda c, pattern: c["name"].rlike("(?iu)" + pattern)
    is_detection = (lambda c: like(c, detection_pattern)) if detection_pattern else (lambda c: F.lit(False))
    split = others.select(F.filter("c", is_detection).alias("detections"), F.filter("c", lambda c: ~is_detection(c)).alias("rest"))
    split = split.withColumn("chosen", F.filter("rest", lambda c: like(c, value_pattern)))
    split = split.select("detections", F.when(F.size("chosen") > 0, F.col("chosen")).otherwise(F.col("rest")).alias("chosen"))
    if not detection_pattern or not split.where(F.size("detections") > 0).count():
        return split.select(F.transform("chosen", lambda c: F.struct(c["name"].alias("sample_id"), c["k"].alias("v"), F.lit(None).cast("int").alias("d"))).alias("columns"))
    values, detections = (split.select(F.inline(c)) for c in ("chosen", "detections"))
    pairs = best(values, detections, "name", "name").select("a", "b")
    places = detections.groupBy(F.col("name").alias("b")).agg(F.min("k").alias("d"))
    paired = values.join(pairs, F.col("name") == F.col("a")).join(places, "b")
    return paired.agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "name", "d"))), lambda c: F.struct(c["name"].alias("sample_id"), c["k"].alias("v"), c["d"].alias("d"))).alias("columns"))


def format_matrix(spark: SparkSession, path: str, value_pattern: str = "beta", detection_pattern: str | None = "detection|pval", accession: str = "all") -> DataFrame:
    """The whole way from a file to the long matrix; the probe column is judged by all rows.

    A file has a column or two per sample, which may be too many for a table's columns: lines
    are cut into arrays, and the header is an array beside them.
    """
    data, head, d = lines(spark, path)
    n = head.select(F.least(F.lit(5), F.size(_fields(F.col("line"), d)))).first()[0]
    fields = data.select(_fields(F.col("value"), d).alias("f"))
    leading = fields.select(*[F.nullif(F.get("f", F.lit(k)), F.lit("")).alias(f"c{k}") for k in range(n)])
    probe = int(probe_column(leading)[1:])
    columns = written(_columns(head, d, probe, value_pattern, detection_pattern), "columns")
    number = lambda k: clean(F.get("f", k).try_cast("double"))
    cells = F.transform("columns", lambda c: F.struct(c["sample_id"].alias("sample_id"), number(c["v"]).alias("value"), number(c["d"]).alias("detection")))
    keyed = fields.select(F.nullif(F.get("f", F.lit(probe)), F.lit("")).alias("probe"), "f").where("probe is not null")
    long = keyed.join(F.broadcast(columns)).select(F.lit(accession).alias("accession"), "probe", F.inline(cells))
    if columns.where(F.exists("columns", lambda c: c["d"].isNotNull())).count():
        long = detection_mask(long, ["accession", "sample_id"])
    return long.select("accession", "sample_id", "probe", "value")
