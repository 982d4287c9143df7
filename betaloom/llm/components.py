"""Connected components of a graph that is given as a table of links.

Alternating large-star and small-star rounds (Kiveris and others, 2014): each round
hooks neighbours to the smallest node seen, so that every component becomes a star in
logarithmically many rounds.  Minima are aggregated before the shuffle; they are written
before they are joined, so that both sides of the join are plain exchanges, which Spark
splits where one node holds many links.  Nothing but two numbers a round reaches the
driver, and each round cuts its lineage by a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_folder, new_folder


def _write(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _minima(pairs: DataFrame) -> DataFrame:
    """Per u the least of itself and its partners."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("mu"), F.least("u", "m").alias("m"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for each node that has a link; root is the component's smallest node.

    Links may repeat, run both ways or from a node to itself; nulls are dropped.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    edges, path = _write(edges, "links")
    mark = None
    while True:
        old = [path]
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, at = _write(_minima(both), "least")
        old.append(at)
        large, at = _write(both.join(least, F.col("u") == F.col("mu")).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        old.append(at)
        least, at = _write(_minima(large), "least")
        old.append(at)
        hooked = large.join(least, F.col("u") == F.col("mu"))
        small = hooked.select("u", F.col("m").alias("v")).unionByName(hooked.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        edges, path = _write(small, "links")
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 31) - 1)))).first())
        for at in old:
            drop_folder(edges.sparkSession, at)
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
