"""Other sources and sinks: uploads, tables, artifacts."""

from __future__ import annotations

import csv
import gzip
import io
from base64 import b64decode
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of the accession column, most preferred first.
ACCESSION_COLUMNS = ("accession_code", "accession", "accessions", "gse", "geo_accession")


def accessions_from_uploads(files: Iterable[Mapping[str, str]]) -> list[str]:
    """Accessions of uploaded tables (name, base64 content), in order, once each; unreadable files are skipped.

    An upload is one request's body, so this runs on the driver.
    """
    out: dict[str, None] = {}
    for f in files:
        name = f.get("name", "").lower()
        try:
            data = b64decode(f["content"], validate=True)
            if name.endswith(".gz"):
                data, name = gzip.decompress(data), name[:-3]
        except (ValueError, OSError, EOFError, KeyError):
            continue
        try:
            text = data.decode("utf-8-sig")
        except UnicodeDecodeError:
            text = data.decode("latin-1")
        rows = csv.DictReader(io.StringIO(text), delimiter="\t" if name.endswith((".tsv", ".txt")) else ",")
        by_name = {(c or "").strip().lower(): c for c in rows.fieldnames or []}
        column = next((by_name[c] for c in ACCESSION_COLUMNS if c in by_name), None)
        if column is None:
            continue
        for r in rows:
            v = (r.get(column) or "").strip()
            if v.upper().startswith("GSE"):
                out.setdefault(v)
    return list(out)


def accessions_table(df: DataFrame, order: str) -> DataFrame:
    """The same over a table: values of the most preferred column that carry the prefix, by first place."""
    by_name = {c.lower(): c for c in df.columns}
    column = next((by_name[c] for c in ACCESSION_COLUMNS if c in by_name), None)
    if column is None:
        raise ValueError(f"none of {ACCESSION_COLUMNS} is a column")
    v = F.trim(F.col(column).cast("string"))
    return df.where(F.upper(v).startswith("GSE")).groupBy(v.alias("accession")).agg(F.min(order).alias("first"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Kept if it exists, unless overwriting is asked for."""
    df.write.mode("overwrite" if overwrite else "ignore").csv(path, header=True)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def write_json(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """A JSON object a line; kept if it exists, unless overwriting is asked for."""
    df.write.mode("overwrite" if overwrite else "ignore").json(path)


def read_first(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """The first table that exists, such as the matrix after quality control, else the one before it; raises without any."""
    tried = list(paths)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in tried:
        if hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop(path)):
            return spark.read.parquet(path)
    raise FileNotFoundError(f"none of {tried} exists")


#: Parameters: rows of a page and bytes of a row group, the units that a reader skips.
PAGE_ROWS, GROUP_BYTES = 4096, 16 << 20


def write_matrix(long: DataFrame, path: str, page_rows: int = PAGE_ROWS, group_bytes: int = GROUP_BYTES) -> None:
    """Parquet with zstd, dealt by accession so that one study is read alone, and in order of probes within it.

    A model needs some hundred probes of hundreds of thousands.  In order, a probe's cells lie
    in few pages, whose least and largest probe the file's index holds, and ranges of probes
    lie in different files; so :func:`read_matrix` reads a small part.
    """
    placed = long.repartitionByRange("accession", "probe").sortWithinPartitions("accession", "probe")
    writer = placed.write.mode("overwrite").option("compression", "zstd").option("parquet.page.row.count.limit", str(page_rows)).option("parquet.block.size", str(group_bytes))
    writer.partitionBy("accession").parquet(path)


def read_matrix(spark: SparkSession, path: str, probes: Iterable | None = None, accessions: Iterable[str] | None = None) -> DataFrame:
    """The matrix, or its cells of some probes and accessions; a probe list is pushed into the files whatever its length."""
    out = spark.read.parquet(path)
    if accessions is not None:
        out = out.where(F.col("accession").isin(*accessions))
    if probes is not None:
        # Spark pushes lists of up to ten values as they are, and of longer ones the bounds alone
        wanted = sorted(set(probes))
        parts = [F.col("probe").isin(*wanted[k : k + 10]) for k in range(0, len(wanted), 10)]
        while len(parts) > 1:  # in pairs, so that the condition is not deep
            parts = [a | b for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) // 2 * 2 :]
        out = out.where(parts[0] if parts else F.lit(False))
    return out


def https(url):
    """ftp links over https, without query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, "^ftp://", "https://"), r"[?#].*$", "")


def threads_ending(df: DataFrame, column: str, ending: str) -> DataFrame:
    """Distinct values with an ending; the filter is pushed to the scan."""
    return df.where(F.col(column).endswith(ending)).select(column).distinct()
