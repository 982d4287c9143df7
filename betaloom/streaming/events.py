"""The provenance event log as a stream: files of JSON lines in, profiles and latest artifacts out."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "event string, timestamp timestamp, run_id string, subgraph string, thread_id string, path string, kind string, step string, status string, message string"

# The event types.
EVENT_TYPES = (
    "RunStarted", "InputLoaded", "PromptRendered", "LLMRequestStarted", "LLMResponseReceived", "LLMTokenUsage", "RetrievalQueryIssued", "RetrievalCandidatesReturned",
    "HarmonizationMappingProposed", "ValidationCompleted", "ArtifactWritten", "WarningRaised", "RetryScheduled", "RetriesExhausted", "ErrorRaised", "RunCompleted",
)


#: Spark's own formats end at milliseconds, which would make events tie that don't.
_MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def append(events: DataFrame, path: str) -> None:
    events.write.mode("append").options(**_MICROS).json(path)


def write_by_thread(events: DataFrame, path: str) -> None:
    """A folder of JSON lines for each thread, so that one thread's log is read alone."""
    events.write.mode("append").partitionBy("thread_id").options(**_MICROS).json(path)


def read_threads(spark: SparkSession, path: str, *threads: str) -> DataFrame:
    """Logs of the named threads, or of all; folders of others aren't opened."""
    log = spark.read.schema(SCHEMA).json(path)
    return log.where(F.col("thread_id").isin(*threads)) if threads else log


def in_order(events: DataFrame, *ties: str) -> DataFrame:
    """By time, then by ``ties``; files have no order of their own in Spark."""
    return events.orderBy("timestamp", *ties)


def stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).json(path)


def profile(events: DataFrame, run: str = "run_id", event: str = "event", time: str = "timestamp") -> DataFrame:
    """Per run and type: how many, first and last; the same on a stream and on a table."""
    return events.groupBy(run, event).agg(F.count("*").alias("n"), F.min(time).alias("first_at"), F.max(time).alias("last_at"))


def token_usage(message, *paths: str):
    """The first of several paths of a JSON message that is there, as a number."""
    return F.coalesce(*[F.get_json_object(message, p) for p in paths]).try_cast("bigint")


#: Deltas that are read beside a base before they are folded into a new one.
COMPACT_AFTER = 8


class LatestState:
    """Latest event per (path, kind) as a folder of deltas over a base.

    A batch writes the latest events of its own keys only, so its cost doesn't grow with the
    state.  After ``compact_after`` batches the deltas are folded into a new base and older
    files go.  What counts is named by a small file ``CURRENT``, written last: a batch or a
    compaction that was cut short left nothing that counts, and a batch that is repeated finds
    its number there and changes nothing.  A named file that is gone is an error.
    """

    def __init__(self, spark: SparkSession, path: str, compact_after: int = COMPACT_AFTER) -> None:
        self.spark, self.path, self.compact_after = spark, path.rstrip("/"), compact_after
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> dict:
        """``base`` (name or None), ``deltas`` (names in order) and ``batch``, the last one that counts."""
        versions = sorted(self._versions())
        if not versions:
            return {"base": None, "deltas": [], "batch": -1}
        text = self.spark.read.text(f"{self.path}/CURRENT/{versions[-1]:020d}").first()[0]  # one line
        return json.loads(text)

    def _versions(self) -> list[int]:
        folder = self._path(f"{self.path}/CURRENT")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return [int(n) for n in names if n.isdigit()]

    def _commit(self, state: dict) -> None:
        """Written under another name and renamed, so that it is there wholly or not at all."""
        versions = self._versions()
        number = max(versions, default=-1) + 1
        temp = self._path(f"{self.path}/CURRENT/.{number}-{uuid.uuid4().hex}")
        out = self._fs.create(temp, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not self._fs.rename(temp, self._path(f"{self.path}/CURRENT/{number:020d}")):
            raise OSError("another writer has committed this state")
        for old in versions:
            self._fs.delete(self._path(f"{self.path}/CURRENT/{old:020d}"), False)

    def _read(self, names: list[str]) -> DataFrame:
        for n in names:
            if not self._fs.exists(self._path(f"{self.path}/{n}/_SUCCESS")):
                raise FileNotFoundError(f"{self.path}/{n} is named by the state and is gone")
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/{n}" for n in names]) if names else self.spark.createDataFrame([], SCHEMA)

    def read(self) -> DataFrame:
        """The latest event of every key."""
        now = self.current()
        return latest(self._read(([now["base"]] if now["base"] else []) + now["deltas"]))

    def add(self, batch: DataFrame, batch_id: int) -> None:
        now = self.current()
        if batch_id <= now["batch"]:
            return
        name = f"delta-{batch_id:012d}-{uuid.uuid4().hex}"
        latest(batch).write.parquet(f"{self.path}/{name}")
        now = now | {"deltas": [*now["deltas"], name], "batch": batch_id}
        self._commit(now)
        if len(now["deltas"]) >= self.compact_after:
            self.compact()

    def compact(self) -> None:
        """Fold the deltas into a new base; files that no longer count go."""
        now = self.current()
        name = f"base-{max(now['batch'], 0):012d}-{uuid.uuid4().hex}"
        self.read().write.parquet(f"{self.path}/{name}")
        self._commit({"base": name, "deltas": [], "batch": now["batch"]})
        for f in self._fs.listStatus(self._path(self.path)):
            if f.getPath().getName() not in (name, "CURRENT"):
                self._fs.delete(f.getPath(), True)


def latest(events: DataFrame) -> DataFrame:
    """The latest event per (path, kind), the largest of all fields among equals; events without a path drop out."""
    rest = [c for c in events.columns if c not in ("path", "kind")]
    top = events.where("path is not null").groupBy("path", "kind").agg(F.max(F.struct("timestamp", *[c for c in rest if c != "timestamp"])).alias("s"))
    return top.select(*[F.col(c) if c in ("path", "kind") else F.col("s")[c].alias(c) for c in events.columns])


def fold_latest(events: DataFrame, path: str, checkpoint: str, compact_after: int = COMPACT_AFTER) -> StreamingQuery:
    """Keep :class:`LatestState` at ``path`` up to date with a stream."""

    def fold(batch: DataFrame, batch_id: int) -> None:
        LatestState(batch.sparkSession, path, compact_after).add(batch, batch_id)

    return events.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
