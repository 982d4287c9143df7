"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts handled at once inside a Python worker; bounds the memory of one step.
TEXTS_PER_STEP = 512


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, through Spark's own reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *columns: str | tuple[str, str]) -> DataFrame:
    """Exactly these columns, matched by exact spelling; ``(name, alias)`` renames.

    Other columns are dropped first, so that names which differ in case only, or
    repeat, or equal a column that an operator adds, can't make a reference ambiguous.
    """
    names = df.columns
    plain = df.toDF(*[f"_{i}" for i in range(len(names))])
    out = []
    for item in columns:
        name, alias = item if isinstance(item, tuple) else (item, item)
        if name not in names:
            raise ValueError(f"column {name!r} is missing; there are {names}")
        out.append(F.col(f"_{names.index(name)}").alias(alias))
    return plain.select(*out)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset and all runs in one process (tests) a temporary folder takes
    its place; on a cluster executors would write to their own disks, so that raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="betaloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_ours: list[tuple[SparkSession, str]] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own inside the shared one; it goes when the driver's process ends."""
    path = f"{shared_folder(spark)}/betaloom/{name}-{uuid.uuid4().hex}"
    if not _ours:
        atexit.register(_drop_all)
    _ours.append((spark, path))
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder made by :func:`new_folder`, through Hadoop's file systems."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    _ours[:] = [x for x in _ours if x[1] != path]


def _drop_all() -> None:
    for spark, path in list(_ours):
        try:
            drop_folder(spark, path)
        except Exception:  # the session may have ended before
            continue


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again.

    A lost executor then costs the running stage alone, not what was computed before.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def done_with(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` that nothing reads any more."""
    for df in tables:
        drop_folder(df.sparkSession, df._written_to)


def row_key(id_column: Column, text: Column) -> Column:
    """Tells rows with one id and different texts apart; joins use it beside the id."""
    return F.xxhash64(id_column, text)


def steps(batches: Iterable[pa.RecordBatch], size: int = TEXTS_PER_STEP) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of a bounded number of rows."""
    for batch in batches:
        for lo in range(0, batch.num_rows, size):
            yield batch.slice(lo, size)


_owner: list[str] = [""]
_releases: list[tuple[str, Callable[[], None]]] = []


def on_leave(owner: str, release: Callable[[], None]) -> None:
    """Register what frees an operator's memos in a worker process."""
    _releases.append((owner, release))


def enter(owner: str) -> None:
    """A worker process lives on from task to task; it keeps the memos of one operator at a time."""
    if _owner[0] != owner:
        for name, release in _releases:
            if name != owner:
                release()
        _owner[0] = owner
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # not every C library can
            ctypes.CDLL(None).malloc_trim(0)


def map_texts(df: DataFrame, ids: Sequence[str], text: str, per_step: Callable[[list], list], fields: list[T.StructField]) -> DataFrame:
    """``ids`` and, computed from the texts of each step, ``fields``; no shuffle.

    ``per_step`` takes a list of texts (None for null) and returns one list per field.
    """
    source = pick(df, *ids, (text, "_text"))
    schema = T.StructType([*source.schema.fields[:-1], *fields])
    return source.mapInArrow(_Mapped(per_step, schema, len(ids)), schema)


class _Mapped:
    def __init__(self, per_step: Callable[[list], list], schema: T.StructType, n_ids: int) -> None:
        self.per_step, self.schema, self.n_ids = per_step, schema, n_ids

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        enter(self.per_step.__module__)
        gc.disable()  # memos of many small tuples make full collections long; nothing here makes cycles
        names = [f.name for f in self.schema.fields]
        kinds = [to_arrow_type(f.dataType) for f in self.schema.fields[self.n_ids :]]
        for step in steps(batches):
            made = self.per_step(step.column(self.n_ids).to_pylist())
            yield pa.RecordBatch.from_arrays([*step.columns[: self.n_ids], *(pa.array(v, type=k) for v, k in zip(made, kinds, strict=True))], names=names)


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(kind) if "<" in kind else _KINDS[kind](), True)


_KINDS = {"long": T.LongType, "string": T.StringType, "double": T.DoubleType, "boolean": T.BooleanType, "binary": T.BinaryType}
