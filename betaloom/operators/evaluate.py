"""Error metrics and group tests of predictions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.student import upper_tail
from ..sources.shared import written


def metrics(rows: DataFrame, keys: Sequence[str], error_on: str = "accel", predicted: str = "predicted", accel: str = "accel", age: str = "age", least: int = 2) -> DataFrame:
    """Mean and median absolute error and Pearson's r per ``keys``, in one aggregation.

    ``error_on='accel'`` compares the residual with age, ``'prediction'`` the prediction.
    Groups under ``least`` complete rows drop out; r is null where a side is constant.
    """
    side = accel if error_on == "accel" else predicted
    full = rows.where(F.col(side).isNotNull() & F.col(age).isNotNull())
    error = F.abs(F.col(side) - F.col(age))
    full = full.select(*keys, F.col(side).alias("_side"), F.col(age).alias("_age"), error.alias("_error"))
    around = F.percentile_approx("_error", F.array(F.lit(0.499), F.lit(0.501)), 10_000)  # two of 10,000 ranks off at most
    grouped = full.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_error").alias("mae"), around.alias("_around"), F.covar_pop("_side", "_age").alias("c"), F.stddev_pop("_side").alias("s1"), F.stddev_pop("_age").alias("s2"))
    grouped = grouped.where(F.col("n") >= least)
    r = F.try_divide("c", F.col("s1") * F.col("s2"))
    return grouped.join(_medians(full, grouped, keys), list(keys)).select(*keys, "n", "mae", "medae", r.alias("pearson_r"))


def _medians(rows: DataFrame, grouped: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact median of ``_error`` per key between the values ``_around`` it.

    Only values between them are sorted, counted by value before the shuffle; those below
    are counted.  So a key with most rows, such as the pooled one, sorts few of them.
    """
    marked = rows.join(grouped.select(*keys, "n", "_around"), list(keys))
    low, high = F.col("_around")[0], F.col("_around")[1]
    counted = marked.where(F.col("_error") <= high).groupBy(*keys, "n", F.when(F.col("_error") >= low, F.col("_error")).alias("_v")).agg(F.count("*").alias("_k"))
    # nulls, which stand for all smaller values, come first
    upto = F.sum("_k").over(Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first()))
    ranked = counted.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_k"))
    at = lambda rank: F.max(F.when((F.col("_before") <= rank) & (rank < F.col("_upto")), F.col("_v")))
    first, second = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    return ranked.groupBy(*keys).agg(((at(first) + at(second)) / 2).alias("medae"))


def squared_errors(rows: DataFrame, keys: Sequence[str], predicted: str = "predicted", age: str = "age") -> DataFrame:
    """``n, mse, r2`` per ``keys`` of complete rows: mean squared error, and 1 - residual over total sum of squares (null for constant ages)."""
    full = rows.where(F.col(predicted).isNotNull() & F.col(age).isNotNull())
    square = F.pow(F.col(predicted) - F.col(age), F.lit(2))
    return full.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(square).alias("mse"), (1 - F.try_divide(F.avg(square), F.var_pop(age))).alias("r2"))


def overall_and_by_dataset(rows: DataFrame, dataset: str, model: str, **kw) -> DataFrame:
    """Pooled rows (dataset ``overall``) before the datasets'; one scan expanded into both groupings."""
    both = rows.withColumn("_d", F.explode(F.array(F.lit("overall"), F.col(dataset).cast("string"))))
    out = metrics(both, ["_d", model], **kw)
    return out.withColumnRenamed("_d", dataset)


def welch(rows: DataFrame, keys: Sequence[str], value: str, is_control: str, least: int = 2) -> DataFrame:
    """One-sided Welch statistic mean(other) > mean(control) per ``keys``: ``t, df``, null under ``least`` a side."""
    control = F.when(F.col(is_control), F.col(value))
    other = F.when(~F.col(is_control), F.col(value))
    g = rows.groupBy(*keys).agg(*[f(c).alias(f"{n}{k}") for k, c in (("c", control), ("o", other)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    a, b = F.try_divide("vo", "no"), F.try_divide("vc", "nc")
    ok = (F.col("no") >= least) & (F.col("nc") >= least)
    t = F.when(ok, F.try_divide(F.col("mo") - F.col("mc"), F.sqrt(a + b)))
    df = F.when(ok, F.try_divide(F.pow(a + b, F.lit(2)), F.try_divide(a * a, F.col("no") - 1) + F.try_divide(b * b, F.col("nc") - 1)))
    return g.select(*keys, F.col("no").alias("n_other"), F.col("nc").alias("n_control"), t.alias("t"), df.alias("df"))


def one_sample(rows: DataFrame, keys: Sequence[str], value: str, least: int = 2) -> DataFrame:
    """One-sided statistic mean > 0 per ``keys``."""
    g = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    return g.select(*keys, "n", F.when(F.col("n") >= least, F.try_divide("m", F.sqrt(F.try_divide("v", "n")))).alias("t"), F.when(F.col("n") >= least, F.col("n") - 1).cast("double").alias("df"))


def with_p(tested: DataFrame) -> DataFrame:
    """Adds ``p``, the upper tail of Student's t."""
    return tested.withColumn("p", upper_tail(F.col("t"), F.col("df")))


#: Parameters of the permutation test: different values in a chunk, permutations in a block.
CHUNK, PERMUTATIONS_AT_ONCE = 1 << 14, 50


def permutation(rows: DataFrame, keys: Sequence[str], value: str, is_control: str, permutations: int = 1000, least: int = 10, chunk: int = CHUNK) -> DataFrame:
    """Labels permuted without replacement: ``t, p, n_valid`` per ``keys``, ``p = (count(t* >= t) + 1) / (valid + 1)``.

    Groups under ``least`` a side drop out.  No task holds a group: its values, counted when
    equal, are dealt to chunks.  How many of the controls a permutation draws from each chunk
    is a multivariate hypergeometric draw from the chunks' sizes, seeded by group and
    permutation, so that every task draws the same; which ones, each chunk draws by itself.
    Together that is a draw of all labels without replacement.  Chunks and blocks of
    permutations are rows, and the sums of the chunks are added up.  Results don't depend on
    partitions.  A t* within 1e-9 of t counts as equal.
    """
    known = rows.where(F.col(value).isNotNull() & F.col(is_control).isNotNull()).select(*[F.col(k).alias(f"_{n}") for n, k in enumerate(keys)], F.col(value).cast("double").alias("_v"), F.col(is_control).alias("_c"))
    key = F.to_json(F.struct(*[F.col(f"_{n}") for n in range(len(keys))]), {"ignoreNullFields": "false"})
    known = known.withColumn("_key", key)
    counted = written(known.groupBy("_key", "_v").agg(F.count_if("_c").alias("_nc"), F.count("*").alias("_n")), "values")
    groups = known.groupBy("_key").agg(*[F.first(f"_{n}").alias(f"_{n}") for n in range(len(keys))], F.avg("_v").alias("_mean"))
    sizes = counted.groupBy("_key").agg(F.sum("_n").alias("n"), F.sum("_nc").alias("nc"), F.ceil(F.count("*") / F.lit(chunk)).cast("int").alias("chunks"))
    sizes = written(sizes.where((F.col("nc") >= least) & (F.col("n") - F.col("nc") >= least)).join(groups, "_key"), "groups")
    placed = counted.join(sizes.select("_key", "chunks", "_mean"), "_key").withColumn("_chunk", F.pmod(F.xxhash64("_v"), F.col("chunks")).cast("int")).withColumn("_x", F.col("_v") - F.col("_mean"))
    lists = F.sort_array(F.collect_list(F.struct("_x", "_n")))
    chunks = written(placed.groupBy("_key", "_chunk").agg(lists.alias("l"), F.sum("_n").alias("size")), "chunks")
    shares = chunks.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("_chunk", "size"))).alias("s"))  # a number a chunk
    starts = F.explode(F.sequence(F.lit(0), F.lit(permutations - 1), F.lit(PERMUTATIONS_AT_ONCE)))
    work = chunks.join(shares, "_key").join(sizes.select("_key", "nc"), "_key").select("_key", "_chunk", starts.alias("start"), "nc", F.transform("s", lambda x: x["_chunk"]).alias("places"), F.transform("s", lambda x: x["size"]).alias("sizes"), F.transform("l", lambda x: x["_x"]).alias("x"), F.transform("l", lambda x: x["_n"]).alias("times"))
    # a chunk and a block of permutations is a task's unit of work
    dealt = work.repartition("_key", "_chunk", "start")
    drawn = dealt.mapInPandas(_drawer(permutations), "_key string, permutation int, s double, q double").groupBy("_key", "permutation").agg(F.sum("s").alias("s"), F.sum("q").alias("q"))
    x, nc = F.col("_x"), F.col("_nc")
    totals = placed.groupBy("_key").agg(F.sum(x * F.col("_n")).alias("total"), F.sum(x * x * F.col("_n")).alias("squares"), F.sum(x * nc).alias("s"), F.sum(x * x * nc).alias("q"))
    known_t = sizes.join(totals, "_key").withColumn("t", _t(F.col("s"), F.col("q"))).drop("s", "q")
    each = known_t.select("_key", "n", "nc", "total", "squares", "t").join(drawn, "_key").withColumn("u", _t(F.col("s"), F.col("q")))
    above = each.groupBy("_key").agg(F.count_if(F.col("u") >= F.col("t") - 1e-9).alias("above"), F.count("u").cast("bigint").alias("n_valid"))
    out = known_t.join(above, "_key").select(*[F.col(f"_{n}").alias(k) for n, k in enumerate(keys)], "t", ((F.col("above") + 1) / (F.col("n_valid") + 1)).alias("p"), "n_valid")
    return out


def _t(s: Column, q: Column) -> Column:
    """Welch's t of the others against the controls, from the controls' sums, those of all (``total, squares``) and the sizes; null without variance."""
    n, nc = F.col("n"), F.col("nc")
    no, so, qo = n - nc, F.col("total") - s, F.col("squares") - q
    noise = 1e-12 * F.col("squares")
    a, b = (F.when(x - y * y / k > noise, (x - y * y / k) / ((k - 1) * k)).otherwise(0.0) for x, y, k in ((qo, so, no), (q, s, nc)))
    return F.try_divide(so / no - s / nc, F.sqrt(a + b))


def _drawer(permutations: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, chunk, start, nc, places, sizes, x, times in batch.itertuples(index=False):
                x, times, sizes = np.asarray(x, float), np.asarray(times, np.int64), np.asarray(sizes, np.int64)
                mine = list(places).index(chunk)
                numbers = range(start, min(start + PERMUTATIONS_AT_ONCE, permutations))
                chosen = np.array([_seeded(key, k).multivariate_hypergeometric(sizes, nc, method="marginals")[mine] for k in numbers])
                s, q = np.empty(len(numbers)), np.empty(len(numbers))
                for k, (number, m) in enumerate(zip(numbers, chosen)):
                    rng = _seeded(key, number, chunk)
                    if times.max() == 1:
                        taken = x[np.argpartition(rng.random(len(x)), m - 1)[:m]] if m else x[:0]
                        s[k], q[k] = taken.sum(), (taken**2).sum()
                    else:
                        n = rng.multivariate_hypergeometric(times, m, method="marginals")
                        s[k], q[k] = (x * n).sum(), (x * x * n).sum()
                yield pd.DataFrame({"_key": pd.Series([key] * len(s), dtype=object), "permutation": np.array(numbers, np.int32), "s": s, "q": q})

    return run


def _seeded(*parts: object) -> np.random.Generator:
    return np.random.default_rng(list(hashlib.sha256(repr(parts).encode()).digest()))
