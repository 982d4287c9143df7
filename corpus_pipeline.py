"""A corpus pipeline of five stages over ``documents``.

Each stage takes all that the one before kept; its result is written as Parquet in the
shared folder and read again.  Stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from betaloom.llm import decontamination, langid, piece_bpe, secret_scan, simhash
from betaloom.llm.common import enter, pick, read_table, row_key, steps, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay; rejected ones, and those without letters, go.

    The models learn from the labelled documents of this stage's input by the rule of
    operator 1.  Where no document has a label nothing is known of any language, and all
    stay.  Rows that repeat stay or go together.
    """
    docs = pick(docs, *COLUMNS)
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    if not model.languages:
        return docs
    shipped = spark.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(langid.__name__)
        for step in steps(batches):
            wanted = [not shipped.value.predict(t)[3] for t in step.column(1).to_pylist()]
            yield step.filter(pa.array(wanted, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component one document stays: that with the smallest id (one with an id before one without).

    Among rows with that id the text that hashes lowest stays, and among rows with that
    text the smallest lang, source and n_chars.  Null and empty texts are one component.
    """
    docs = pick(docs, *COLUMNS)
    keyed = docs.select("doc_id", "text", row_key(F.col("doc_id"), F.col("text")).alias("row_key"))
    found = simhash.clusters(keyed, also=["row_key"])
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("d"), F.col("row_key").alias("k"))).alias("first"))
    first = written(first.select("first.d", "first.k").distinct(), "kept")
    joined = docs.withColumn("row_key", row_key(F.col("doc_id"), F.col("text"))).join(first, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_key") == F.col("k")), "left_semi")
    one = joined.groupBy("doc_id", "row_key").agg(F.first("text").alias("text"), F.min(F.struct("lang", "source", "n_chars")).alias("rest"))
    return one.select("doc_id", "text", "rest.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; rows that repeat go together, and null texts stay."""
    return decontamination.decontaminate(pick(docs, *COLUMNS), read_table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; every secret is replaced by a mark, and n_chars follows the text (a null text keeps its n_chars)."""
    docs = pick(docs, *COLUMNS)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(secret_scan.__name__)
        for step in steps(batches):
            texts = pa.array([secret_scan.redact(t) for t in step.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([step.column(0), texts, *step.columns[2:]], schema=step.schema)

    out = docs.mapInArrow(clean, docs.schema)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its columns but the text, its ids and the digest of the text decoded from them; a null text counts as empty."""
    docs = pick(docs, *COLUMNS)
    coded = docs.select("doc_id", "lang", "source", "n_chars", "text")
    schema = T.StructType([*coded.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    path = piece_bpe.public_tokenizers.path(piece_bpe.MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(piece_bpe.__name__)
        bpe = piece_bpe.load(path)
        for step in steps(batches, 128):
            ids = [bpe.encode(t or "") for t in step.column(4).to_pylist()]
            arrays = [pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(i) for i in ids], pa.string())]
            yield pa.RecordBatch.from_arrays([*step.columns[:4], *arrays], names=[f.name for f in schema.fields])

    out = coded.mapInArrow(run, schema)
    return out.select("doc_id", "lang", "source", "n_chars", "ids", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination_stage),
    ("secret_scan", secrets),
    ("sentencepiece", encode),
]

#: Models, fingerprints and encodings can't be expressed in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
