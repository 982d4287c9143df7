"""Runs that go on where they were cut short: each step's result is named by what it was made of.

A step's name, parameters and inputs have a digest; its result lies in a folder of that name,
and counts once Spark has written the folder's success marker and it has got its final name.
A later run that asks for the same step reads the folder; other parameters or changed files
have another digest and are worked out anew.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession


class Ledger:
    """Results of steps below ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.made: list[str] = []
        self.found: list[str] = []

    def files(self, path: str) -> str:
        """Digest of names, sizes and times of the files at a path or pattern: it changes when they do."""
        root = self._path(path)
        system = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        rows = []
        for top in system.globStatus(root) or []:
            left = [top]
            while left:
                f = left.pop()
                if f.isDirectory():
                    left += list(system.listStatus(f.getPath()))
                elif not f.getPath().getName().startswith(("_", ".")):
                    rows.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
        if not rows:
            raise FileNotFoundError(path)
        return _digest(sorted(rows))

    def step(self, name: str, build: Callable[[], DataFrame], inputs: Mapping[str, str], **parameters: object) -> DataFrame:
        """The step's result, read if it is there, else made by ``build`` and written.

        ``inputs`` names digests: of files (:meth:`files`) or of steps before (:meth:`digest`).
        """
        digest = self.digest(name, inputs, **parameters)
        folder = f"{self.path}/{name}-{digest}"
        if self._fs.exists(self._path(f"{folder}/_SUCCESS")):
            self.found.append(name)
        else:
            temp = f"{self.path}/.{name}-{uuid.uuid4().hex}"
            build().write.parquet(temp)
            self._fs.delete(self._path(folder), True)  # what a lost run left without its marker
            if not self._fs.rename(self._path(temp), self._path(folder)) and not self._fs.exists(self._path(f"{folder}/_SUCCESS")):
                raise OSError(f"{folder} could not be put in place")
            self.made.append(name)
        return self.spark.read.parquet(folder)

    @staticmethod
    def digest(name: str, inputs: Mapping[str, str], **parameters: object) -> str:
        return _digest([name, dict(inputs), parameters])


def _digest(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()[:32]
