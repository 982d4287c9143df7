"""Work that is cut into blocks, against the plain version that holds all at once."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest

from betaloom.operators import evaluate, impute

DENSE = "accession string, sample_id int, extra string, values array<double>"


def plain_knn(rows: list, k: int, weights: str) -> dict:
    """Neighbours by direct differences, all samples of a group at once."""
    out = {}
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: r[1])
        x = np.array([[np.nan if v is None else v for v in r[3]] for r in mine], float)
        d = np.full((len(x), len(x)), np.nan)
        for i, j in itertools.permutations(range(len(x)), 2):
            both = ~np.isnan(x[i]) & ~np.isnan(x[j])
            if both.any():
                d[i, j] = math.sqrt(((x[i] - x[j])[both] ** 2).sum() * x.shape[1] / both.sum())
        for i, r in enumerate(mine):
            filled = []
            for f in range(x.shape[1]):
                donors = [j for j in range(len(x)) if not np.isnan(x[j, f]) and not np.isnan(d[i, j])]
                donors = sorted(donors, key=lambda j: (round(d[i, j], 9), j))[:k]
                if not np.isnan(x[i, f]):
                    filled.append(x[i, f])
                elif donors:
                    exact = [j for j in donors if d[i, j] == 0]
                    w = [1.0] * len(donors) if weights == "uniform" else [float(j in exact) for j in donors] if exact else [1 / d[i, j] for j in donors]
                    filled.append(sum(a * x[j, f] for a, j in zip(w, donors)) / sum(w))
                else:
                    column = x[:, f][~np.isnan(x[:, f])]
                    filled.append(column.mean() if len(column) else None)
            out[g, r[1]] = filled
    return out


@pytest.mark.parametrize(("weights", "block", "cells", "nearest"), [("uniform", 128, 1 << 22, 64), ("uniform", 4, 60, 3), ("distance", 5, 40, 6)])
def test_neighbours_equal_the_dense_version(spark, weights, block, cells, nearest):
    rng = random.Random(3)
    rows = []
    for g, n, p in (("a", 23, 9), ("b", 6, 5), ("c", 1, 4)):
        for k in range(n):
            values = [None if rng.random() < 0.3 or (f == 2 and k > 4) else round(rng.gauss(0, 1), 3) for f in range(p)]
            rows.append((g, k, f"x{k}", values))
    rows.append(("a", 23, "copy", rows[3][3][:1] + [None] + rows[3][3][2:]))  # equal to another where both are known
    rows += [("d", k, None, [None, float("nan"), 1.0 if k else None]) for k in range(3)]
    df = spark.createDataFrame(rows, DENSE).repartition(3)
    got = impute.knn(df, neighbours=3, weights=weights, block=block, cells=cells, nearest=nearest)
    assert got.columns == df.columns
    want = plain_knn([(g, i, e, [None if v is None or v != v else v for v in x]) for g, i, e, x in rows], 3, weights)
    found = {(r.accession, r.sample_id): r["values"] for r in got.collect()}
    assert found.keys() == want.keys()
    for key, values in want.items():
        assert [v is None for v in found[key]] == [v is None for v in values], key
        assert [v for v in found[key] if v is not None] == pytest.approx([v for v in values if v is not None], abs=1e-9), key


def test_neighbours_make_no_table_of_pairs(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [("one", k, None, [None if v < -1 else float(v) for v in rng.normal(size=6)]) for k in range(300)]
    keep, counts = impute.written, {}

    def counted(df, name):
        out = keep(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(impute, "written", counted)
    got = {r.sample_id: r["values"] for r in impute.knn(spark.createDataFrame(rows, DENSE), neighbours=3, block=20, cells=600, nearest=8).collect()}
    assert max(counts.values()) <= 300 * 6, counts  # pairs would be 90,000
    want = plain_knn([(*r[:3], r[3]) for r in rows], 3, "uniform")
    assert all(got[k] == pytest.approx(want["one", k], abs=1e-9) for k in got) and len(got) == 300


def test_one_study_is_spread_over_tasks(spark):
    rng = np.random.default_rng(1)
    rows = [("one", k, None, [None if v < -1 else float(v) for v in rng.normal(size=40)]) for k in range(60)]
    tiles = impute._tiles(spark.createDataFrame(rows, DENSE), "values", "accession", "sample_id", 20, 600)
    keys = {(r.block, r.piece) for r in tiles.select("block", "piece").collect()}
    assert len({b for b, _ in keys}) == 3 and len({p for _, p in keys}) == 4
    assert tiles.selectExpr("max(size(part))").first()[0] == 10


def exact_p(values: list[float], control: list[bool]) -> float:
    """Share of all choices of controls whose t reaches the observed one."""
    x, n_c = np.array(values), sum(control)

    def t(chosen: tuple) -> float:
        c = np.isin(np.arange(len(x)), chosen)
        return (x[~c].mean() - x[c].mean()) / math.sqrt(x[~c].var(ddof=1) / (~c).sum() + x[c].var(ddof=1) / c.sum())

    observed = t(tuple(k for k, c in enumerate(control) if c))
    return float(np.mean([t(c) >= observed - 1e-9 for c in itertools.combinations(range(len(x)), n_c)]))


@pytest.mark.parametrize("chunk", [1 << 14, 3])
def test_permutations_come_near_all_choices(spark, chunk):
    rng = random.Random(5)
    groups = {"even": [round(rng.gauss(0, 1), 2) for _ in range(12)], "shifted": [round(rng.gauss(k >= 5, 1), 2) for k in range(12)], "ties": [float(k // 3) for k in range(12)]}
    rows = [(g, v, k < 5) for g, x in groups.items() for k, v in enumerate(x)] + [("few", 1.0, True), ("few", 2.0, False), ("even", None, True), (None, 1.0, True)]
    df = spark.createDataFrame(rows, "g string, x double, c boolean")
    n = 2000
    got = {r.g: r for r in evaluate.permutation(df, ["g"], "x", "c", n, least=3, chunk=chunk).collect()}
    assert set(got) == set(groups)
    for g, x in groups.items():
        p = exact_p(x, [k < 5 for k in range(12)])
        assert got[g].n_valid == n and abs(got[g].p - p) < 4 * math.sqrt(max(p * (1 - p), 1e-3) / n) + 1 / n, (g, got[g].p, p)
    again = {r.g: r.p for r in evaluate.permutation(df.repartition(7), ["g"], "x", "c", n, least=3, chunk=chunk).collect()}
    assert again == {g: r.p for g, r in got.items()}


def test_a_large_group_is_dealt_to_chunks(spark):
    df = spark.range(200_000).selectExpr("1 AS g", "CASE WHEN id % 3 = 0 THEN 0.0 ELSE sin(id) END AS x", "id % 2 = 0 AS c")
    r = evaluate.permutation(df, ["g"], "x", "c", 200, chunk=1 << 14).collect()
    assert len(r) == 1 and r[0].n_valid == 200 and 0 < r[0].p <= 1
    same = evaluate.welch(df, ["g"], "x", "c").first()
    assert r[0].t == pytest.approx(same.t, rel=1e-9)
