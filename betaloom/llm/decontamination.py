"""Benchmark decontamination by SimHash of item-sized windows (operator 6).

DataFrame functions only.  Words are runs of letters and digits, lowered; shingles are
five words.  For each length n of a benchmark item, the windows of n words of a document
are fingerprinted, 64 bits by majority over their shingle hashes.  Eight blocks of eight
bits index the items: an item is stored under every value within two bits of each of its
blocks, so by the pigeonhole principle a window within 23 bits of an item meets it at one
block at least.  Which items a window is held against comes from that index alone.  What
meets is held against the radius, then the exact weighted shingle similarity (sum of
minima over sum of maxima of the counts) decides.

Not fingerprinted are windows that can't be similar to any item of their length: those in
which too few places hold a shingle of any such item.  A similarity of s between A and B
shingles takes s (A + B) / (1 + s) shingles in common.  All other windows are, at every
start.  Windows with the same shingles, in one document or in many, are fingerprinted and
verified once.

Items of fewer than five words are one shingle of as many words, and are found where it
stands.
"""

from __future__ import annotations

import functools
import json
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, row_key, written

#: Parameters: words of a shingle, least similarity, bits of the radius, blocks of the
#: fingerprint, most rows of the shingle index that are broadcast (about 64 MB), starts of
#: windows and hashes of cut windows that a row holds at most (about).
SHINGLE, SIMILARITY, RADIUS, BLOCKS, BROADCAST_ROWS, STARTS_AT_ONCE, VALUES_AT_ONCE = 5, 0.8, 23, 8, 2_000_000, 1 << 16, 1 << 18


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingle_hashes(column: str, size: int = SHINGLE) -> Column:
    """Hashes of each run of ``size`` words, by place; null where there are fewer words.

    Explode it with the outer forms: from the plain ones Spark infers a filter on the
    array's size, pushes it below the projection and splits the text anew per element.
    """
    each = F.transform(F.sequence(F.lit(1), F.size(column) - (size - 1)), lambda i: F.xxhash64(*[F.element_at(column, i + k) for k in range(size)]))
    return F.when(F.size(column) >= size, each)


def fingerprint(rows: DataFrame, keys: list[str], hashes: str) -> DataFrame:
    """``keys, fp``: the majority bits over the array ``hashes``, counts as weights."""
    bits = rows.select(*keys, F.explode(hashes).alias("h"))
    counts = bits.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(1))).alias(f"b{k}") for k in range(64)])
    # folded over an array: 64 conditions side by side make a method too long for generated code
    powers = F.array(*[F.lit(1 << k if k < 63 else -(1 << 63)).cast("bigint") for k in range(64)])
    bits = F.zip_with(F.array(*[F.col(f"b{k}") for k in range(64)]), powers, lambda b, p: F.when(2 * b > F.col("n"), p).otherwise(F.lit(0).cast("bigint")))
    return counts.select(*keys, F.aggregate(bits, F.lit(0).cast("bigint"), lambda s, x: s.bitwiseOR(x)).alias("fp"))


def _block(fp: str, k: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, k * width).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def _near(radius: int, width: int) -> list[int]:
    return [sum(1 << k for k in c) for n in range(radius + 1) for c in combinations(range(width), n)]


def _blocks(df: DataFrame, near: list[int]) -> DataFrame:
    """A row per block and value within reach of it."""
    width = 64 // BLOCKS
    values = df.withColumn("pairs", F.array(*[F.struct(F.lit(k).alias("block"), _block("fp", k, width).alias("value")) for k in range(BLOCKS)])).select("*", F.inline("pairs")).drop("pairs")
    if near == [0]:
        return values
    table = F.from_json(F.lit(json.dumps(near)), "array<int>")
    return values.select("*", F.explode(table).alias("e")).withColumn("value", F.col("value").bitwiseXOR(F.col("e"))).drop("e")


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast behind a check of the size; beyond it Spark's joins shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _hopeful_starts(places: str, length: str, total: str) -> Column:
    """Starts, from 0, of the windows of ``length`` shingles that hold enough of the sorted ``places``; ``total`` shingles in all.

    For the i-th place as the first one inside, a start lies after the place before it and
    late enough for the window to reach the last one needed.
    """
    longest = F.least(F.col(length), F.col(total))
    needed = F.ceil((F.col(length) + longest) * (SIMILARITY / (1 + SIMILARITY)) - 1e-9).cast("int")
    place = lambda i: F.element_at(places, i)
    first = lambda i: F.greatest(place(i + needed - 1) - longest, F.when(i > 1, place(F.greatest(i - 1, F.lit(1)))).otherwise(F.lit(-1))) + 1
    last = lambda i: F.least(place(i), F.col(total) - longest)
    inside = F.filter(F.sequence(F.lit(1), F.size(places) - needed + 1), lambda i: F.greatest(first(i), F.lit(0)) <= last(i))
    return F.when(F.size(places) >= needed, F.flatten(F.transform(inside, lambda i: F.sequence(F.greatest(first(i), F.lit(0)), last(i)))))


def _in_batches(rows: DataFrame, value: Column, order: list, weight: Column, most: int) -> DataFrame:
    """``doc_id, row_key, batch``: a document's values in arrays of about ``most`` in weight each, so that no row grows with a text's windows."""
    running = F.sum("_w").over(Window.partitionBy("doc_id", "row_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = rows.withColumn("_w", weight.cast("bigint")).withColumn("_b", F.floor((running - F.col("_w")) / F.lit(most)))
    return placed.select("doc_id", "row_key", "_b", value.alias("_v")).groupBy("doc_id", "row_key", "_b").agg(F.collect_list("_v").alias("batch")).drop("_b")


def _short_items(keyed: DataFrame, short: DataFrame) -> DataFrame:
    """``doc_id, row_key, item_id, similarity, start`` for items of fewer than five words: where their words stand."""
    found = []
    for m in [r["m"] for r in short.select("m").distinct().collect()]:  # at most four sizes
        mine = short.where(F.col("m") == m).select("item_id", F.element_at(shingle_hashes("w", m), 1).alias("ih"))
        every = keyed.select("doc_id", "row_key", words(F.col("text")).alias("w")).select("doc_id", "row_key", F.posexplode_outer(shingle_hashes("w", m)).alias("at", "h"))
        firsts = every.join(_small(mine.select("ih").distinct(), mine.count()), F.col("h") == F.col("ih")).groupBy("doc_id", "row_key", "h").agg(F.min("at").alias("start"))
        found.append(firsts.join(mine, F.col("h") == F.col("ih")).select("doc_id", "row_key", "item_id", F.lit(1.0).alias("similarity"), "start"))
    return functools.reduce(DataFrame.unionByName, found) if found else None


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``id, row_key, item, similarity, start_word``: per document and item the best window of at least 0.8.

    Ties go to the first window.  Null and empty texts are in no pair, as documents or as
    items.  A null id is an id of its own; rows that repeat give one pair; other columns
    are dropped; without documents or items there are no pairs.
    """
    wanted = pick(items, (item_col, "item_id"), (item_text, "text")).select("item_id", words(F.col("text")).alias("w")).select("item_id", "w", F.size("w").alias("m")).where("m > 0").distinct()
    wanted = written(wanted, "all-items")
    short = wanted.where(F.col("m") < SHINGLE)
    wanted = wanted.where(F.col("m") >= SHINGLE).select("item_id", (F.col("m") - (SHINGLE - 1)).alias("length"), shingle_hashes("w").alias("item_hashes"))
    wanted = written(wanted.withColumn("item", F.xxhash64("item_id", "item_hashes")), "items")
    n_places = wanted.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    places = wanted.select("length", F.explode("item_hashes").alias("ih")).distinct()

    keyed = pick(docs, (id_col, "doc_id"), (text_col, "text")).select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row_key"), "text")
    hashed = keyed.select("doc_id", "row_key", words(F.col("text")).alias("w")).select("doc_id", "row_key", shingle_hashes("w").alias("hashes"))
    every = hashed.select("doc_id", "row_key", F.size("hashes").alias("total"), F.posexplode_outer("hashes").alias("at", "h"))
    hits = every.join(_small(places, n_places), F.col("h") == F.col("ih"))
    # the places that hold a shingle of any item of a length; a set, so that repeated rows change nothing
    shared = hits.groupBy("doc_id", "row_key", "length", "total").agg(F.array_sort(F.collect_set("at")).alias("places"))
    starts = shared.withColumn("starts", _hopeful_starts("places", "length", "total")).where(F.size("starts") > 0).select("doc_id", "row_key", "length", "starts")
    pieces = F.transform(F.sequence(F.lit(0), F.size("starts") - 1, F.lit(STARTS_AT_ONCE)), lambda k: F.slice("starts", k + 1, F.lit(STARTS_AT_ONCE)))
    pieces = starts.select("doc_id", "row_key", "length", F.explode(pieces).alias("starts"))
    hopeful = written(_in_batches(pieces, F.struct("length", "starts"), ["length", F.element_at("starts", 1)], F.size("starts"), STARTS_AT_ONCE), "hopeful")

    named = hopeful.withColumnsRenamed({"doc_id": "d", "row_key": "k"})
    read = keyed.join(named, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_key") == F.col("k"))).select("doc_id", "row_key", "batch", words(F.col("text")).alias("w"))
    read = read.select("doc_id", "row_key", "batch", shingle_hashes("w").alias("hashes"))
    # windows are named first, and of a batch only the different ones are cut out, a bounded number of values in a row
    each = F.flatten(F.transform("batch", lambda x: F.transform(x["starts"], lambda s: F.struct(F.xxhash64(x["length"], F.slice("hashes", s + 1, x["length"])).alias("window"), s.alias("start"), x["length"].alias("length")))))
    read = read.select("doc_id", "row_key", "hashes", F.array_sort(each).alias("each"))
    different_ones = F.filter("each", lambda x, n: (n == 0) | (x["window"] != F.get(F.col("each"), n - 1)["window"]))
    read = read.select("doc_id", "row_key", "hashes", different_ones.alias("each"))
    step = F.greatest(F.lit(1), F.floor(F.lit(VALUES_AT_ONCE) / F.array_max(F.transform("each", lambda x: x["length"]))).cast("int"))
    parts = read.select("doc_id", "row_key", "hashes", F.explode(F.transform(F.sequence(F.lit(0), F.size("each") - 1, step), lambda n: F.slice("each", n + 1, step))).alias("part"))
    windows = parts.select("doc_id", "row_key", F.inline(F.transform("part", lambda x: F.struct(x["window"].alias("window"), x["start"].alias("start"), x["length"].alias("length"), F.slice("hashes", x["start"] + 1, x["length"]).alias("window_hashes")))))
    firsts = windows.groupBy("doc_id", "row_key", "window").agg(F.min("start").alias("start"), F.first("window_hashes").alias("window_hashes"), F.first("length").alias("length"))
    firsts = written(firsts, "windows")
    different = written(firsts.dropDuplicates(["window"]).select("window", "length", "window_hashes"), "different-windows")

    prints = fingerprint(different, ["window", "length"], "window_hashes")
    item_prints = written(fingerprint(wanted, ["item", "length"], "item_hashes"), "item-prints")
    near = _near(RADIUS // BLOCKS, 64 // BLOCKS)
    index = _blocks(item_prints, near).select("item", F.col("length").alias("il"), F.col("fp").alias("item_fp"), F.col("block").alias("ib"), F.col("value").alias("iv")).distinct()
    met = _blocks(prints, [0]).join(_small(index, item_prints.count() * BLOCKS * len(near)), (F.col("length") == F.col("il")) & (F.col("block") == F.col("ib")) & (F.col("value") == F.col("iv")))
    pairs = written(met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS).select("window", "item").distinct(), "pairs")

    of_windows = different.select("window", F.size("window_hashes").alias("window_size"), F.explode("window_hashes").alias("h")).groupBy("window", "window_size", "h").agg(F.count("*").alias("n"))
    of_items = wanted.select("item", "item_id", F.col("length").alias("item_size"), F.explode("item_hashes").alias("ih")).groupBy("item", "item_id", "item_size", "ih").agg(F.count("*").alias("item_n")).withColumnRenamed("item", "i")
    both = pairs.join(of_windows, "window").join(_small(of_items, n_places), (F.col("item") == F.col("i")) & (F.col("h") == F.col("ih")))
    least = both.groupBy("window", "item", "item_id", "window_size", "item_size").agg(F.sum(F.least("n", "item_n")).alias("least"))
    sure = written(least.withColumn("similarity", F.col("least") / (F.col("window_size") + F.col("item_size") - F.col("least"))).where(F.col("similarity") >= SIMILARITY).select(F.col("window").alias("sure_window"), "item_id", "similarity"), "sure")

    found = firsts.select("doc_id", "row_key", "window", "start").join(sure, F.col("window") == F.col("sure_window")).select("doc_id", "row_key", "item_id", "similarity", "start")
    brief = _short_items(keyed, short)
    found = found.unionByName(brief) if brief is not None else found
    best = found.groupBy("doc_id", "row_key", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("b"))
    return best.select(F.col("doc_id").alias(id_col), "row_key", F.col("item_id").alias(item_col), F.round("b.similarity", 6).alias("similarity"), (-F.col("b.s")).cast("bigint").alias("start_word"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item.

    Rows that repeat go or stay together, columns may clash in name, and a table without
    rows stays one.
    """
    found = written(leaks(docs, items, id_col, text_col).select(F.col(id_col).alias("_leak_id"), F.col("row_key").alias("_leak_key")).distinct(), "leaks")
    names = docs.columns
    plain = docs.toDF(*[f"_{i}" for i in range(len(names))])
    own, text = F.col(f"_{names.index(id_col)}"), F.col(f"_{names.index(text_col)}")
    return plain.join(found, own.eqNullSafe(F.col("_leak_id")) & (row_key(own, text) == F.col("_leak_key")), "left_anti").toDF(*names)
