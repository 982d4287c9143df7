"""SOFT family files: sections per sample, metadata lines and a probe table each.

A SOFT file is ordered: a line belongs to the last section header above it.  Files are split
like any text, and no task reads a whole one: each split scans its own lines and leaves open
what lies above its first header; one row per split says what it hands on (its last header,
the tables it leaves open), those are summed up over the splits of a file, and joined back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to ``file, block, line`` the place of a line in its split, the header above it and the tables open, both counted from the split's start."""
    at, header, depth, n = None, None, 0, 0
    for batch in batches:
        # a task may hold several splits, one after the other
        blocks = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        cuts = [k for k in range(len(blocks)) if k == 0 or blocks[k] != blocks[k - 1]]
        for lo, hi in zip(cuts, [*cuts[1:], len(blocks)]):
            if blocks[lo] != at:
                at, header, depth, n = blocks[lo], None, 0, 0
            part = batch.slice(lo, hi - lo)
            line = part.column(2)
            head = pc.starts_with(line, "^").to_numpy(zero_copy_only=False)
            begin, end = (pc.match_substring_regex(line, f"(?i)^!\\w+_table_{w}").to_numpy(zero_copy_only=False).astype(int) for w in ("begin", "end"))
            above = np.maximum.accumulate(np.where(head, np.arange(len(head)), -1))
            lines = line.to_pylist()
            headers = [header if k < 0 else lines[k] for k in above.tolist()]
            open_ = depth + np.cumsum(begin - end)
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(np.arange(n, n + len(lines), dtype=np.int64)), line, pa.array(headers, pa.string()), pa.array(open_.astype(np.int64))], names=_SCANNED)
            header, depth, n = headers[-1], int(open_[-1]), n + len(lines)


_SCANNED = ["file", "block", "n", "line", "header", "open"]


def scan(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, n, line, header, open`` of every line, as far as its own split tells; ``block`` is where the split begins."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    return raw.mapInArrow(_scan, "file string, block bigint, n bigint, line string, header string, open bigint")


def carries(scanned: DataFrame) -> DataFrame:
    """``file, block, above, before``: per split the last header and the open tables of all splits before it; one row a split."""
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = scanned.groupBy("file", "block").agg(F.max_by("header", "n").alias("header"), F.max_by("open", "n").alias("open"))
    return last.select("file", "block", F.last("header", ignorenulls=True).over(order).alias("above"), F.coalesce(F.sum("open").over(order), F.lit(0)).alias("before"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, kind, name, line_no, line, in_table``: every line with the section it stands in.

    ``line_no`` rises through a file: the bytes before its split, then its place in the split.
    Lines above the first header have an empty kind and name.  A compressed file is one split.
    """
    scanned = scan(spark, path)
    handed = carries(scanned).select(F.col("file").alias("_f"), F.col("block").alias("_b"), "above", "before")
    # a split has at least as many bytes as lines, so numbers of splits don't meet
    out = scanned.join(handed, (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b")))
    section = F.coalesce("header", "above")
    return out.select("file", F.coalesce(F.regexp_extract(section, r"^\^(\w+)", 1), F.lit("")).alias("kind"), F.coalesce(F.trim(F.regexp_extract(section, r"=\s*(.*)$", 1)), F.lit("")).alias("name"), (F.col("block") + F.col("n")).alias("line_no"), "line", (F.col("open") + F.col("before") > 0).alias("in_table"))


def sample_metadata(read: DataFrame) -> DataFrame:
    """``name, fields map<string, array<string>>`` per sample, values in order."""
    meta = read.where((F.upper("kind") == "SAMPLE") & F.col("line").startswith("!") & ~F.lower("line").rlike("_table_(begin|end)"))
    pairs = meta.select("file", "name", "line_no", F.regexp_replace(F.trim(F.regexp_extract("line", r"^!(?:Sample_)?([^=]+?)\s*=", 1)), "", "").alias("key"), F.trim(F.regexp_extract("line", r"^[^=]*=\s*(.*)$", 1)).alias("value"))
    fields = pairs.groupBy("file", "name", "key").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "value"))), lambda s: s["value"]).alias("values"))
    return fields.groupBy("file", "name").agg(F.map_from_entries(F.collect_list(F.struct("key", "values"))).alias("fields"))


def dataset_metadata(read: DataFrame) -> DataFrame:
    """Title, summary and design (first values, empty by default) and all supplementary entries per file."""
    meta = read.where((F.upper("kind") == "SERIES") & F.col("line").startswith("!"))
    pairs = meta.select("file", "line_no", F.trim(F.regexp_extract("line", r"^!(?:Series_)?([^=]+?)\s*=", 1)).alias("key"), F.trim(F.regexp_extract("line", r"^[^=]*=\s*(.*)$", 1)).alias("value"))
    first = lambda k: F.coalesce(F.min_by(F.when(F.col("key") == k, F.col("value")), F.when(F.col("key") == k, F.col("line_no"))), F.lit("")).alias(k)
    return pairs.groupBy("file").agg(first("title"), first("summary"), first("overall_design"), F.sort_array(F.collect_list(F.when(F.lower("key").contains("supplement"), F.col("value")))).alias("supplementary"))


def platforms(read: DataFrame) -> DataFrame:
    """Platform id per series line and title per platform line, the text after the first ``=``."""
    value = F.trim(F.regexp_extract("line", r"^[^=]*=\s*(.*)$", 1))
    ids = read.where(F.col("line").startswith("!Series_platform_id")).select("file", F.lit("id").alias("what"), value.alias("value"))
    return ids.unionByName(read.where(F.col("line").startswith("!Platform_title")).select("file", F.lit("title").alias("what"), value.alias("value")))


def probe_tables(read: DataFrame, cutoff: float = 0.05) -> DataFrame:
    """``file, sample_id, probe, value`` of samples' tables; rows that fail detection are left out.

    The table's header names ID_REF, VALUE and maybe a detection column.
    """
    rows = read.where((F.upper("kind") == "SAMPLE") & F.col("in_table") & ~F.col("line").startswith("!") & ~F.col("line").startswith("#"))
    cells = rows.select("file", F.col("name").alias("sample_id"), "line_no", F.split("line", "\t").alias("c"))
    heads = cells.where(F.upper(F.col("c")[0]) == "ID_REF").groupBy("file", "sample_id").agg(F.min_by("c", "line_no").alias("h"))
    body = cells.where(F.upper(F.col("c")[0]) != "ID_REF").join(heads, ["file", "sample_id"])
    upper = F.transform("h", lambda x: F.upper(x))
    at = F.array_position(upper, "VALUE").cast("int")
    detection = F.array_position(F.transform(upper, lambda x: x.contains("DETECTION")), F.lit(True)).cast("int")
    value = F.try_element_at("c", F.when(at > 0, at).otherwise(F.lit(2))).try_cast("double")
    p = F.when(detection > 0, F.try_element_at("c", F.when(detection > 0, detection).otherwise(F.lit(1))).try_cast("double"))
    out = body.select("file", "sample_id", F.col("c")[0].alias("probe"), F.when(~F.isnan(value), value).alias("value"), (detection == 0).alias("all"), p.alias("p"))
    return out.where(F.col("all") | (F.col("p") <= cutoff)).select("file", "sample_id", "probe", "value")
