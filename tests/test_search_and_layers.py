"""Term search, layered models, examples per key, and the pruned matrix."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from betaloom.operators import joins, layers, profile, search
from betaloom.sources import files, shared


def plain_search(terms: list, labels: list, k: int) -> dict:
    def grams(t: str | None) -> list[str]:
        w = [x for x in re.split("[^a-z0-9]+", (t or "").lower()) if x]
        return w + [f"{a} {b}" for a, b in zip(w, w[1:])]

    docs = [(i, grams(t)) for i, t in sorted(set(terms), key=str) if i is not None and grams(t)]
    mean = sum(len(g) for _, g in docs) / len(docs)
    df = Counter(g for _, d in docs for g in set(d))
    out = {}
    for label in set(labels):
        best: dict = defaultdict(float)
        for i, d in docs:
            tf = Counter(d)
            hits = [g for g in set(grams(label)) if g in tf]
            if hits:
                score = sum(math.log(1 + (len(docs) - df[g] + 0.5) / (df[g] + 0.5)) * tf[g] * 2.2 / (tf[g] + 1.2 * (0.25 + 0.75 * len(d) / mean)) for g in hits)
                best[i] = max(best[i], score)
        if best:
            out[label] = [(i, round(v, 6)) for i, v in sorted(best.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]]
    return out


@pytest.mark.parametrize("frequent", [10_000, 25, 3])
def test_search_equals_the_plain_version(spark, frequent):
    """With lists that count as frequent from 25 and from 3 texts on too."""
    rng = random.Random(4)
    words = ["lung", "cell", "disease", "of", "the", "left", "right", "upper", "lobe", "cancer", "blood", "B", "T-cell", "4", "é"]
    text = lambda n: " ".join(rng.choices(words, weights=[9, 8, 8, 7, 7, 3, 3, 2, 2, 2, 1, 1, 1, 1, 1], k=rng.randint(0, n)))
    terms = [(rng.randint(0, 40), text(5)) for _ in range(80)] + [(None, "lung"), (7, None)]
    labels = [text(4) for _ in range(30)] + ["nothing here", "the of", "the"]
    over = search.index(spark.createDataFrame(terms, "id int, text string"), "id", "text")
    got: dict = defaultdict(list)
    for r in search.search(spark.createDataFrame([(x,) for x in [*labels, None]], "label string"), "label", over, 4, frequent).orderBy("label", "rank").collect():
        got[r.label].append((r.term, round(r.score, 6)))
    assert got == plain_search(terms, labels, 4)


def test_equal_texts_and_labels_are_searched_once(spark, monkeypatch):
    terms = [(f"t{k:03d}", ["large blue ring", "small blue ring", "small bolt"][k % 3]) for k in range(90)]
    labels = [f"{size} large ring" for size in range(100, 160)] + ["bolt"]
    seen, summed = [], search._summed
    monkeypatch.setattr(search, "_summed", lambda *a: (seen.append(summed(*a).count()), summed(*a))[1])
    over = search.index(spark.createDataFrame(terms, "id string, text string"), "id", "text")
    got: dict = defaultdict(list)
    for r in search.search(spark.createDataFrame([(x,) for x in labels], "label string"), "label", over, 4).orderBy("label", "rank").collect():
        got[r.label].append((r.term, round(r.score, 6)))
    assert got == plain_search(terms, labels, 4)
    assert sum(seen) == 3, seen  # pairs of a class of labels and a text; 3,630 of labels and terms


def test_layers_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(9, 30))
    x[2, 3] = np.nan
    long = spark.createDataFrame([("a" if s < 6 else None, s, f"p{p}", None if np.isnan(x[s, p]) else float(x[s, p])) for s in range(9) for p in range(30)], "accession string, sample_id int, probe string, value double").repartition(3)
    shapes = {"deep": ([30, 4, 3, 2], ["selu", "sigmoid", "identity"]), "flat": ([30, 1], ["tanh"])}
    w, b, want = [], [], {}
    for name, (sizes, functions) in shapes.items():
        y = np.nan_to_num(x)
        for k, f in enumerate(functions):
            m, c = rng.normal(size=(sizes[k], sizes[k + 1])), rng.normal(size=sizes[k + 1])
            w += [(name, k, f"p{i}" if k == 0 else str(i), str(j), float(m[i, j])) for i in range(sizes[k]) for j in range(sizes[k + 1])]
            b += [(name, k, str(j), float(c[j]), f) for j in range(sizes[k + 1])]
            z = y @ m + c
            y = {"selu": 1.0507009873554805 * np.where(z > 0, z, 1.6732632423543772 * (np.exp(np.minimum(z, 0)) - 1)), "sigmoid": 1 / (1 + np.exp(-z)), "identity": z, "tanh": np.tanh(z)}[f]
        want |= {(name, s, str(j)): y[s, j] for s in range(9) for j in range(y.shape[1])}
    weights = spark.createDataFrame(w, "model string, layer int, source string, target string, weight double")
    biases = spark.createDataFrame(b, "model string, layer int, target string, bias double, activation string")
    got = {(r.model, r.sample_id, r.unit): r.predicted for r in layers.predict(long.where("sample_id < 6"), weights, biases, 2, 5).collect()}
    assert got == pytest.approx({k: v for k, v in want.items() if k[1] < 6})
    with pytest.raises(Exception, match="unknown activation"):
        layers.predict(long, weights, biases.withColumn("activation", F.lit("odd")), 2, 2).collect()


def test_examples_are_the_same_on_any_partitions(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), (F.col("id") % 41).alias("v")).unionByName(spark.createDataFrame([(9, None), (9, 4), (None, 1)], "k bigint, v bigint"))
    a, b = (sorted(map(tuple, profile.examples(df.repartition(n), ["k"], "v", 4).collect()), key=str) for n in (1, 7))
    assert a == b and Counter(r[0] for r in a) == {0: 4, 1: 4, 2: 4, 9: 1, None: 1}


def test_merged_keeps_samples_of_all_models(spark):
    parts = [spark.createDataFrame([(s, None if s == 3 else float(k * 10 + s)) for s in range(k, 5)], f"s int, m{k} double") for k in range(3)]
    got = {tuple(r) for r in joins.merged(parts, ["s"]).select("s", "m0", "m1", "m2").collect()}
    assert got == {(2, 2.0, 12.0, 22.0), (3, None, None, None), (4, 4.0, 14.0, 24.0)}
    with pytest.raises(ValueError, match="in common"):
        joins.merged([parts[0], parts[0]], ["s"])


def test_merged_keeps_no_table_of_keys(spark):
    parts = [spark.createDataFrame([("a", None, k + 1), ("a", 2, k + 2), (None, 1, k), *([("b", 1, k)] if k else [])], f"s string, t int, m{k} int") for k in range(2)]
    out = joins.merged(parts, ["s", "t"])
    assert {tuple(r) for r in out.collect()} == {("a", None, 1, 2), ("a", 2, 2, 3)}
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_a_models_probes_read_a_small_part(spark):
    long = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("accession"), (F.col("id") % 50).alias("sample_id"), F.format_string("cg%06d", F.floor(F.col("id") / 50)).alias("probe"), F.rand(1).alias("value"))
    path = shared.folder(spark, "matrix")
    files.write_matrix(long, path, page_rows=500, group_bytes=1 << 16)
    probes = [f"cg{k:06d}" for k in range(0, 400)][::8] + ["cg003999"]
    part = files.read_matrix(spark, path, probes, ["a"])
    rows = part.collect()
    assert len(rows) == 51 * 25 and {r.probe for r in rows} == set(probes)
    leaves = part._jdf.queryExecution().executedPlan().collectLeaves()
    read = leaves.apply(0).metrics().apply("numOutputRows").value()
    assert 51 * 25 <= read < 100_000 / 4, read  # of the accession's 100,000 cells
    assert files.read_matrix(spark, path, []).count() == 0 and files.read_matrix(spark, path).count() == 200_000
