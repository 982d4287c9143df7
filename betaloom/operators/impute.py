"""Imputation of a long matrix whose missing cells are null rows (see ``matrix.align`` to add absent ones)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import discard, written

#: Registry of simple imputers: value column to an aggregate.
IMPUTERS: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "median": F.median,
    "most_frequent": lambda v: F.mode(v, True),  # the smallest of the most frequent
}


def simple(long: DataFrame, strategy: str = "mean", keys: tuple[str, ...] = ("accession", "probe"), constant: float | None = None) -> DataFrame:
    """Null cells take their group's statistic; ``keys`` may name a stratum."""
    if strategy == "constant":
        return long.withColumn("value", F.coalesce("value", F.lit(float(constant or 0.0))))
    statistics = long.groupBy(*keys).agg(IMPUTERS[strategy](F.col("value")).alias("_fill"))
    return long.join(statistics, list(keys), "left").withColumn("value", F.coalesce("value", "_fill")).drop("_fill")


def from_reference(long: DataFrame, reference: DataFrame, strategy: str = "mean", keys: tuple[str, ...] = ("probe",)) -> DataFrame:
    """Statistics of a reference matrix fill the target's null cells."""
    statistics = reference.groupBy(*keys).agg(IMPUTERS[strategy](F.col("value")).alias("_fill"))
    return long.join(statistics, list(keys), "left").withColumn("value", F.coalesce("value", "_fill")).drop("_fill")


def cascade(long: DataFrame, default: DataFrame | None = None, user: DataFrame | None = None) -> DataFrame:
    """Model input: a null cell takes its probe's mean, else the user's, else the default reference (``probe, value``).

    A cell that still is null makes the query fail.
    """
    means = long.groupBy("probe").agg(F.avg("value").alias("_mean"))
    out = long.join(means, "probe", "left")
    fills = [F.col("value"), F.col("_mean")]
    for name, reference in (("_user", user), ("_default", default)):
        if reference is not None:
            out = out.join(reference.select("probe", F.col("value").alias(name)), "probe", "left")
            fills.append(F.col(name))
    filled = F.coalesce(*fills)
    sure = F.when(filled.isNull(), F.raise_error(F.lit("no imputation reference for a probe without values")).cast("double")).otherwise(filled)
    return out.withColumn("value", sure).select(*long.columns)


def window_mean(long: DataFrame) -> DataFrame:
    """The mean imputer as a window, where the matrix is already dealt by probe."""
    return long.withColumn("value", F.coalesce("value", F.avg("value").over(Window.partitionBy("accession", "probe"))))


#: Parameters of the neighbours' imputer: samples in a block of distances, values in a task's
#: piece of a matrix, neighbours that are listed for each sample.
BLOCK, CELLS, NEAREST = 128, 1 << 22, 64
#: Parameters: blocks of samples that a group is dealt to at least, distances a task holds at once.
SPREAD, AT_ONCE = 16, 1 << 20


def knn(dense: DataFrame, values: str = "values", neighbours: int = 5, weights: str = "uniform", group: str = "accession", sample: str = "sample_id", block: int = BLOCK, cells: int = CELLS, nearest: int = NEAREST) -> DataFrame:
    """k nearest samples over the features both know, distances scaled to all features.

    ``dense`` has one array per sample, all of one length in a group; (group, sample) is a
    key.  Donors must know the feature; equally near ones come in order of sample; where there
    is none the feature's mean fills in.

    No task holds a group: samples are dealt to blocks and features to pieces.  Where a block
    with all its features fits a task, a task meets one block with as many samples as fit and
    keeps each sample's ``nearest`` ones, so that no table of pairs is made.  Wider matrices add
    up the squares of two blocks over one piece, and the sums of the pieces give distances.
    Cells are filled piece by piece from the nearest; cells that find fewer than k donors among
    them ask all samples that know the feature.
    """
    if weights not in ("uniform", "distance"):
        raise ValueError("weights are uniform or distance")
    rows = written(_rows(dense, values, group, sample, block, cells), "rows")
    narrow = F.col("features") <= cells // block
    whole, tiles = rows.where(narrow), _pieces(rows)
    distances = written(_distances(_pieces(rows.where(~narrow))), "distances")
    lists = written(_nearest(distances, nearest).unionByName(_lists(whole, nearest, block, cells)), "nearest")
    filled = written(_fill(tiles, lists, neighbours, weights, nearest), "filled-tiles")
    found = _late(_pieces(rows.where(~narrow)), filled, distances).unionByName(_late_whole(whole, filled, neighbours, block, cells))
    late = _settled(filled, found, neighbours, weights)
    parts = filled.groupBy("g", "i").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("piece", "part"))), lambda p: p["part"])).alias("_values"))
    more = late.groupBy("g", "i").agg(F.map_from_entries(F.collect_list(F.struct("f", "value"))).alias("_late"))
    done = written(parts.join(more, ["g", "i"], "left").select("g", "i", F.transform("_values", lambda v, k: F.coalesce(v, F.try_element_at("_late", k + 1))).alias("_filled")), "imputed")
    discard(rows, distances, lists, filled)
    same = F.col(group).eqNullSafe(F.col("g")) & F.col(sample).eqNullSafe(F.col("i"))
    return dense.join(done, same).select(*[F.col("_filled").alias(c) if c == values else F.col(c) for c in dense.columns])


def _rows(dense: DataFrame, values: str, group: str, sample: str, block: int, cells: int) -> DataFrame:
    """``g, i, n, features, width, blocks, x``: a sample's values, NaN as null, with the size of its group."""
    sizes = dense.groupBy(group).agg(F.count("*").alias("n"), F.max(F.size(values)).alias("features"))
    named = sizes.select(F.col(group).alias("g"), "n", "features")
    rows = dense.join(named, F.col(group).eqNullSafe(F.col("g")))
    width = F.greatest(F.lit(1), F.least(F.col("features"), F.floor(F.lit(cells) / F.col("n")).cast("int")))
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    return rows.select("g", F.col(sample).alias("i"), "n", "features", width.alias("width"), blocks.alias("blocks"), F.transform(values, lambda v: F.when(~F.isnan(v), v.cast("double"))).alias("x"))


def _pieces(rows: DataFrame) -> DataFrame:
    """``g, i, n, features, block, blocks, piece, width, part``: a sample's values of one piece of the features."""
    pieces = rows.withColumn("block", F.pmod(F.xxhash64("i"), F.col("blocks")).cast("int")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("features") / F.col("width")).cast("int") - 1))))
    return pieces.withColumn("part", F.slice("x", F.col("piece") * F.col("width") + 1, F.col("width"))).drop("x")


def _tiles(dense: DataFrame, values: str, group: str, sample: str, block: int, cells: int) -> DataFrame:
    return _pieces(_rows(dense, values, group, sample, block, cells))


def _met(rows: DataFrame, asking: DataFrame, block: int, cells: int) -> DataFrame:
    """Samples that ask, by block ``p``, and those they meet, as many as fit a task, by ``q``; both with all their values."""
    size = F.greatest(F.lit(block), F.least(F.lit(32 * block), F.ceil(F.col("n") / SPREAD)))
    blocks, parts = (F.greatest(F.lit(1), F.ceil(c).cast("int")) for c in (F.col("n") / size, F.col("n") * F.col("features") / F.lit(cells)))
    mine = asking.withColumn("p", F.pmod(F.xxhash64("i"), blocks).cast("int"))
    theirs = rows.withColumn("q", F.pmod(F.xxhash64("i", F.lit(1)), parts).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), blocks - 1)))
    if asking is not rows:
        some = mine.select(F.col("g").alias("h"), F.col("p").alias("o")).distinct()
        theirs = theirs.join(some, F.col("g").eqNullSafe(F.col("h")) & (F.col("p") == F.col("o")), "left_semi")
    mine = mine.withColumn("q", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("asks", F.lit(True))
    kept = ["g", "p", "q", "asks", "i", "x", *[c for c in asking.columns if c == "late"]]
    return mine.select(*kept).unionByName(theirs.withColumn("asks", F.lit(False)).select(*[c for c in kept if c != "late"]), allowMissingColumns=True)


def _blocks_of_distances(pdf: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray]]:
    """Of samples that ask, a bounded number at a time: they, all they meet in order, the values of these, distances (inf if unknown)."""
    mine, theirs = pdf[pdf["asks"]].reset_index(drop=True), pdf[~pdf["asks"]].sort_values("i", ignore_index=True)
    if not len(mine) or not len(theirs):
        return
    y = _matrix(theirs["x"])
    known, b = (~np.isnan(y)).astype(float), np.nan_to_num(y)
    right, at = np.hstack([known, b**2]), {i: k for k, i in enumerate(theirs["i"])}
    for lo in range(0, len(mine), step := max(1, AT_ONCE // len(theirs))):
        some = mine.iloc[lo : lo + step]
        x = _matrix(some["x"])
        k, a = (~np.isnan(x)).astype(float), np.nan_to_num(x)
        d = np.hstack([a**2, k]) @ right.T
        least = 1e-13 * d  # what rounding leaves of equal samples
        d -= 2 * a @ b.T
        d[d < least] = 0
        with np.errstate(divide="ignore", invalid="ignore"):
            both = k @ known.T
            d = np.round(np.sqrt(d * (x.shape[1] / both)), 12)
        d[both == 0] = np.inf
        for r, i in enumerate(some["i"]):
            if i in at:
                d[r, at[i]] = np.inf
        yield some, theirs, y, d


def _lists(rows: DataFrame, nearest: int, block: int, cells: int) -> DataFrame:
    """``g, i, donors array<struct<d, j>>``: the nearest samples of each, in order."""
    kind = rows.schema["g"].dataType.simpleString(), rows.schema["i"].dataType.simpleString()

    def near(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for mine, theirs, _, d in _blocks_of_distances(pdf):
            ids = theirs["i"].to_numpy()
            last = np.partition(d, nearest - 1, axis=1)[:, nearest - 1] if nearest < d.shape[1] else np.full(len(d), np.inf)
            for i, row, limit in zip(mine["i"], d, last):
                c = np.flatnonzero((row <= limit) & np.isfinite(row))
                c = c[np.argsort(row[c], kind="stable")[:nearest]]  # in order of sample among equals
                out.append((key[0], i, row[c], ids[c]))
        return pd.DataFrame({n: pd.Series([r[k] for r in out], dtype=object) for k, n in enumerate(("g", "i", "d", "j"))})

    found = _met(rows, rows, block, cells).groupBy("g", "p", "q").applyInPandas(near, f"g {kind[0]}, i {kind[1]}, d array<double>, j array<{kind[1]}>")
    each = F.flatten(F.collect_list(F.transform(F.arrays_zip("d", "j"), lambda x: F.struct(x["d"].alias("d"), x["j"].alias("j")))))
    return found.groupBy("g", "i").agg(F.slice(F.sort_array(each), 1, nearest).alias("donors")).where(F.size("donors") > 0)


def _matrix(parts) -> np.ndarray:
    return np.array([np.asarray(p, dtype=float) for p in parts]).reshape(len(parts), -1)


def _distances(tiles: DataFrame) -> DataFrame:
    """``g, i, j, d`` for both orders of every pair of samples that know a feature in common."""
    kind = tiles.schema["g"].dataType.simpleString(), tiles.schema["i"].dataType.simpleString()
    # a block meets each block once; the pair's task has the rows of both
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = tiles.withColumn("o", other).select("g", "piece", F.least("block", "o").alias("p"), F.greatest("block", "o").alias("q"), "block", "i", "part")

    def products(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        g, _, p, q = key
        pdf = pdf.sort_values("i", ignore_index=True)
        sides = [pdf[pdf["block"] == k] for k in (p, q)]
        x, y = (_matrix(s["part"].tolist()) for s in sides)
        known = [(~np.isnan(m)).astype(float) for m in (x, y)]
        a, b = np.nan_to_num(x), np.nan_to_num(y)
        squares_a, squares_b = (a**2) @ known[1].T, known[0] @ (b**2).T
        squares = squares_a + squares_b - 2 * a @ b.T
        squares[squares < 1e-13 * (squares_a + squares_b)] = 0  # what rounding leaves of equal samples
        both = known[0] @ known[1].T
        keep = np.argwhere((both > 0) & (np.triu(np.ones(both.shape, bool), 1) if p == q else True))
        left, right = (side["i"].astype(object).to_numpy()[at] for side, at in zip(sides, keep.T))
        at = tuple(keep.T)
        return pd.DataFrame({"g": pd.Series([g] * len(keep), dtype=object), "i": left, "j": right, "squares": squares[at], "both": both[at].astype(np.int64)})

    partial = met.groupBy("g", "piece", "p", "q").applyInPandas(products, f"g {kind[0]}, i {kind[1]}, j {kind[1]}, squares double, both bigint")
    sums = partial.groupBy("g", "i", "j").agg(F.sum("squares").alias("squares"), F.sum("both").alias("both"))
    features = tiles.groupBy(F.col("g").alias("h")).agg(F.max("features").alias("features"))
    d = sums.join(features, F.col("g").eqNullSafe(F.col("h"))).withColumn("d", F.sqrt(F.col("squares") * F.col("features") / F.col("both")))
    ends = F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return d.select("g", ends.alias("e"), "d").select("g", "e.i", "e.j", "d")


def _nearest(distances: DataFrame, nearest: int) -> DataFrame:
    """``g, i, donors array<struct<d, j>>``: the nearest samples of each, in order."""
    rank = F.row_number().over(Window.partitionBy("g", "i").orderBy("d", "j"))
    return distances.withColumn("_rank", rank).where(F.col("_rank") <= nearest).groupBy("g", "i").agg(F.sort_array(F.collect_list(F.struct("d", "j"))).alias("donors"))


def _fill(tiles: DataFrame, lists: DataFrame, neighbours: int, weights: str, nearest: int) -> DataFrame:
    """``g, i, piece, part, late array<struct<f, mean>>``: cells filled from the listed donors; what they don't settle is late."""
    kind = tiles.schema["g"].dataType.simpleString(), tiles.schema["i"].dataType.simpleString()
    pieces = tiles.select("g", "piece").distinct().select(F.col("g").alias("h"), F.col("piece").alias("q"))
    wanted = lists.join(pieces, F.col("g").eqNullSafe(F.col("h"))).select("h", "q", "i", F.transform("donors", lambda x: x["j"]).alias("j"), F.transform("donors", lambda x: x["d"]).alias("d"))

    def fill(rows: pd.DataFrame, donors: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(rows["part"].tolist())
        known, out = ~np.isnan(x), x.copy()
        place = {i: k for k, i in enumerate(rows["i"])}
        near = {i: (j, d) for i, j, d in zip(donors["i"], donors["j"], donors["d"])}
        count = known.sum(0)
        means = np.where(count > 0, np.nansum(x, 0) / np.maximum(count, 1), np.nan)
        late: list[list] = []
        for k, (i, piece, width) in enumerate(zip(rows["i"], rows["piece"], rows["width"])):
            missing = np.flatnonzero(~known[k])
            j, d = near.get(i, ((), ()))
            out[k, missing], open_ = _from_donors(x, known, missing, [place[v] for v in j], np.asarray(d, float), neighbours, weights, means)
            late.append([{"f": int(piece * width + f + 1), "mean": None if np.isnan(means[f]) else float(means[f])} for f in missing[open_]] if len(j) >= nearest else [])
            if late[-1]:
                out[k, missing[open_]] = np.nan
        return pd.DataFrame({"g": rows["g"].astype(object), "i": rows["i"].astype(object), "piece": rows["piece"], "part": [[None if np.isnan(v) else float(v) for v in r] for r in out], "late": late})

    schema = f"g {kind[0]}, i {kind[1]}, piece int, part array<double>, late array<struct<f int, mean double>>"
    return tiles.groupBy("g", "piece").cogroup(wanted.groupBy("h", "q")).applyInPandas(fill, schema)


def _from_donors(x: np.ndarray, known: np.ndarray, missing: np.ndarray, rows: list[int], d: np.ndarray, neighbours: int, weights: str, means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of one sample's missing features, and which of them have fewer donors than wanted."""
    if not rows or not len(missing):
        return means[missing], np.full(len(missing), True)
    has = known[np.ix_(rows, missing)]
    used = has & (np.cumsum(has, 0) <= neighbours)
    w = used.astype(float)
    if weights == "distance":
        exact = (used & (d == 0)[:, None]).any(0)
        with np.errstate(divide="ignore"):
            w = np.where(exact, used & (d == 0)[:, None], np.where(used, 1 / np.where(d == 0, np.inf, d)[:, None], 0.0))
    total = w.sum(0)
    value = (w * np.nan_to_num(x[np.ix_(rows, missing)])).sum(0) / np.where(total > 0, total, 1)
    return np.where(total > 0, value, means[missing]), used.sum(0) < neighbours


def _late_cells(filled: DataFrame) -> DataFrame:
    return filled.select("g", "i", "piece", F.explode("late").alias("c")).select("g", "i", "piece", "c.f", "c.mean")


def _late(tiles: DataFrame, filled: DataFrame, distances: DataFrame) -> DataFrame:
    """``g, i, f, d, j, v``: all samples that know a late cell's feature; few do, or the near ones would."""
    late = _late_cells(filled)
    pieces = late.select(F.col("g").alias("h"), F.col("piece").alias("q")).distinct()
    mine = tiles.join(pieces, F.col("g").eqNullSafe(F.col("h")) & (F.col("piece") == F.col("q")), "left_semi")
    known = mine.select("g", "piece", "width", F.col("i").alias("j"), F.posexplode("part").alias("k", "v")).where("v is not null")
    known = known.select(F.col("g").alias("h"), (F.col("piece") * F.col("width") + F.col("k") + 1).cast("int").alias("e"), "j", "v")
    pairs = late.join(known, F.col("g").eqNullSafe(F.col("h")) & (F.col("f") == F.col("e"))).select("g", "i", "f", "j", "v")
    far = distances.select(F.col("g").alias("h"), F.col("i").alias("a"), F.col("j").alias("b"), "d")
    return pairs.join(far, F.col("g").eqNullSafe(F.col("h")) & (F.col("i") == F.col("a")) & (F.col("j") == F.col("b"))).select("g", "i", "f", "d", "j", "v")


def _late_whole(rows: DataFrame, filled: DataFrame, neighbours: int, block: int, cells: int) -> DataFrame:
    """``g, i, f, d, j, v``: the donors of late cells, asked of all samples once more, the nearest of each task."""
    kind = rows.schema["g"].dataType.simpleString(), rows.schema["i"].dataType.simpleString()
    late = _late_cells(filled).groupBy(F.col("g").alias("h"), F.col("i").alias("a")).agg(F.collect_list("f").alias("late"))
    asking = rows.join(late, F.col("g").eqNullSafe(F.col("h")) & F.col("i").eqNullSafe(F.col("a"))).drop("h", "a")

    def far(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for mine, theirs, y, d in _blocks_of_distances(pdf):
            ids = theirs["i"].to_numpy()
            for i, features, row in zip(mine["i"], mine["late"], d):
                order = np.argsort(row, kind="stable")[: np.isfinite(row).sum()]
                for f in features:
                    c = order[~np.isnan(y[order, f - 1])][:neighbours]
                    out += zip([key[0]] * len(c), [i] * len(c), [int(f)] * len(c), row[c].tolist(), ids[c].tolist(), y[c, f - 1].tolist())
        return pd.DataFrame({n: pd.Series([r[k] for r in out], dtype=object) for k, n in enumerate(("g", "i", "f", "d", "j", "v"))})

    met = _met(rows, asking, block, cells)
    return met.groupBy("g", "p", "q").applyInPandas(far, f"g {kind[0]}, i {kind[1]}, f int, d double, j {kind[1]}, v double")


def _settled(filled: DataFrame, found: DataFrame, neighbours: int, weights: str) -> DataFrame:
    """``g, i, f, value`` of the late cells from their nearest donors, else the feature's mean."""
    rank = F.row_number().over(Window.partitionBy("g", "i", "f").orderBy("d", "j"))
    zero = F.min("d").over(Window.partitionBy("g", "i", "f")) == 0
    w = F.lit(1.0) if weights == "uniform" else F.when(zero, (F.col("d") == 0).cast("double")).otherwise(1 / F.col("d"))
    top = found.withColumn("_rank", rank).withColumn("w", w).where(F.col("_rank") <= neighbours)
    given = top.groupBy("g", "i", "f").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("value"))
    same = F.col("g").eqNullSafe(F.col("h")) & (F.col("i") == F.col("a")) & (F.col("f") == F.col("e"))
    return _late_cells(filled).join(given.withColumnsRenamed({"g": "h", "i": "a", "f": "e"}), same, "left").select("g", "i", "f", F.coalesce("value", "mean").alias("value"))
