"""Lexical matching against all pairs, medians of hot keys, joins, and files."""

from __future__ import annotations

import hashlib
import random
import statistics
import time

import pytest
from pyspark.sql import functions as F

from betaloom.functions import text as T
from betaloom.operators import catalog, evaluate, joins, lexical, matrix
from betaloom.sources import files, shared


def test_best_is_the_best_of_all_pairs(spark):
    rng = random.Random(1)
    label = lambda: "_".join(rng.choice(["beta", "Sample", "rep", "1", "22", "ctrl", "b7", "x"]) for _ in range(rng.randint(0, 4)))
    a, b = ([label() for _ in range(60)] for _ in range(2))
    left, right = (spark.createDataFrame([(x,) for x in v + [None]], "n string") for v in (a, b))
    for penalty in (True, False):
        every = lexical.scores(left, right, "n", "n", penalty).collect()
        want: dict = {}
        for r in every:
            if r.a not in want or (-r.score, r.b) < want[r.a]:
                want[r.a] = (-r.score, r.b)
        got = {r.a: (-r.score, r.b) for r in lexical.best(left, right, "n", "n", penalty).collect()}
        assert got == want and len(got) == len(set(a))


@pytest.mark.parametrize("seed", [0, 1])
def test_best_is_exact_where_labels_share_little(spark, seed):
    """Labels without numbers, with one side's numbers only, with none in common, and empty ones."""
    rng = random.Random(seed)
    words = ["control", "kontrol", "controls", "x", "signal", "signals", "GSM", "beta", "pval", "7", "77", "8b", "é", ""]
    label = lambda: rng.choice(["_", " ", ""]).join(rng.choice(words) for _ in range(rng.randint(0, 5)))
    a, b = [label() for _ in range(80)], [label() for _ in range(60)]
    if seed:
        b = [x for x in b if not any(c.isdigit() for c in x)]
    left, right = (spark.createDataFrame([(x,) for x in v], "n string") for v in (a, b))
    for penalty in (True, False):
        want: dict = {}
        for r in lexical.scores(left, right, "n", "n", penalty).collect():
            if r.a not in want or (-r.score, r.b) < want[r.a]:
                want[r.a] = (-r.score, r.b)
        assert {r.a: (-r.score, r.b) for r in lexical.best(left, right, "n", "n", penalty).collect()} == want
    assert lexical.best(left, right.limit(0), "n", "n").count() == 0


def test_few_pairs_meet(spark):
    """2,000 labels a side that are told apart by a number: 4 million pairs, of which a small part is scored."""
    rng = random.Random(4)
    names = [f"{rng.choice(['lung', 'liver', 'blood', 'skin'])}_{k * 7919 % 100_003}" for k in range(2000)]
    left, right = (spark.createDataFrame([(f"{x}_{end}",) for x in names], "n string") for end in ("beta", "detection"))
    (_, x), (_, y) = lexical.classes(left, "n"), lexical.classes(right, "n")
    x, y = (shared.written(df, "t") for df in (x, y))
    first = lexical._first_round(x, y).distinct().count()
    top = lexical.best(left, right, "n", "n").select("a", "b").collect()
    assert all(r.a.rsplit("_", 1)[0] == r.b.rsplit("_", 1)[0] for r in top) and len(top) == len(set(names))
    floor = lexical.best(left, right, "n", "n").select(F.col("a").alias("n"), "score")
    floored = x.join(lexical.classes(floor, "n")[0].join(floor, F.col("label") == F.col("n")).groupBy("s").agg(F.min("score").alias("floor")), "s")
    second = lexical._second_round(floored, y, True, 1.0).distinct().count()
    assert first < 400_000 and second < 400_000


def test_common_subsequences_of_many_pairs():
    rng = random.Random(6)
    a, b = (["".join(rng.choice("abcé 😀") for _ in range(rng.randint(0, 90))) for _ in range(400)] for _ in range(2))

    def plain(x: str, y: str) -> int:
        row = [0] * (len(y) + 1)
        for c in x:
            before = 0
            for k, d in enumerate(y, 1):
                before, row[k] = row[k], before + 1 if c == d else max(row[k], row[k - 1])
        return row[-1]

    assert T.lcs_lengths(a, b).tolist() == [plain(x, y) for x, y in zip(a, b)] and T.lcs_lengths([], []).tolist() == []


def test_medians_are_exact(spark):
    rng = random.Random(2)
    rows = [("a", rng.choice([0.0, 1.0, rng.random()]), 0.0) for _ in range(20_001)] + [("b", float(k), 0.0) for k in range(4)] + [("c", 5.0, 0.0)] * 3 + [("d", 1.0, 0.0)] + [("e", None, 1.0)] * 5
    got = {r.k: r.medae for r in evaluate.metrics(spark.createDataFrame(rows, "k string, predicted double, age double"), ["k"], "prediction").collect()}
    assert got == {k: statistics.median(v for x, v, _ in rows if x == k) for k in "abc"}


def test_align_fills_missing_probes(spark):
    long = spark.createDataFrame([("s", 1, "p", 0.5), ("s", 2, "q", 0.25), ("s", 1, "x", 9.0)], "accession string, sample_id int, probe string, value double")
    wanted = spark.createDataFrame([("p",), ("q",), ("p",)], "probe string")
    got = {(r.sample_id, r.probe): r.value for r in matrix.align(long, long, wanted).collect()}
    assert got == {(1, "p"): 0.5, (1, "q"): None, (2, "p"): None, (2, "q"): 0.25}


def test_addresses_are_redacted_in_linear_time(spark):
    rows = ["x a.b@c.de, f-g@h.i.-j@k.lm", "sk-ant-abcdefghijkl sk-abcdefghijkl", "no@thing", "a@b.c@d.e", None, "é.ü@ö.ä"]
    want = ["x <EMAIL_REDACTED>, <EMAIL_REDACTED><EMAIL_REDACTED>", "sk-ant-<REDACTED> sk-<REDACTED>", "no@thing", "<EMAIL_REDACTED>@d.e", None, "<EMAIL_REDACTED>"]
    got = [r.t for r in spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string").select("k", T.redact(F.col("t")).alias("t")).orderBy("k").collect()]
    plain = [None if t is None else spark.range(1).select(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lit(t), *T.SENSITIVE[0]), *T.SENSITIVE[1]), *T.SENSITIVE[2])).first()[0] for t in rows]
    assert got == plain == want
    start = time.time()
    spark.createDataFrame([("a" * 200_000 + " @",)], "t string").select(F.length(T.redact(F.col("t")))).collect()
    assert time.time() - start < 10


def test_null_keys_are_equal_in_prediction_joins(spark):
    a, b = (spark.createDataFrame([(None, k), ("x", k)], f"g string, {n} int") for n, k in (("v", 1), ("w", 2)))
    assert {(r.g, r.v, r.w) for r in joins.with_predictions(a, b, ["g"]).collect()} == {(None, 1, 2), ("x", 1, 2)}


def test_files_are_registered_and_the_first_is_read(spark):
    path = shared.folder(spark, "t")
    spark.createDataFrame([("abc",)], "value string").coalesce(1).write.text(path)
    r = catalog.register_files(spark, path + "/*.txt").first()
    assert r.bytes == 4 and r.sha256 == hashlib.sha256(b"abc\n").hexdigest() and r.recorded_at is not None
    with pytest.raises(FileNotFoundError):
        files.read_first(spark, [path + "-no", path + "-none"])


def test_labels_that_meet_by_length_alone_are_not_shuffled_in_pairs(spark, monkeypatch):
    left = spark.range(400).select(F.format_string("Customer#%09d", F.col("id") + 1000).alias("v"))
    right = spark.range(300).select(F.format_string("Supplier#%09d", "id").alias("v"))
    monkeypatch.setattr(lexical, "CELL", 100)
    seen, bounded = [], lexical._bounded
    monkeypatch.setattr(lexical, "_bounded", lambda pairs, *rest: (seen.append(pairs.count()), bounded(pairs, *rest))[1])
    got = {r.a: (r.b, round(r.score, 9)) for r in lexical.best(left, right, "v", "v").collect()}
    assert max(seen) < 400 * 20, seen  # of 120,000 pairs
    monkeypatch.setattr(lexical, "CELL", 20_000)
    every = lexical.scores(left, right, "v", "v").withColumn("score", F.round("score", 9))
    want = {r.a: (r.m["b"], -r.m["s"]) for r in every.groupBy("a").agg(F.min(F.struct((-F.col("score")).alias("s"), "b")).alias("m")).collect()}
    assert got == want
    rng = random.Random(2)
    texts = list({"".join(rng.choices("ab 0é", k=7)) for _ in range(60)})
    assert all(T.lcs_with(texts)(a).tolist() == T.lcs_lengths([a] * len(texts), texts).tolist() for a in ["", "ab0", "0é a" * 16, "ab 0" * 20])
