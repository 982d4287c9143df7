"""Hand-computed cases."""

from __future__ import annotations

import gzip
import math
from base64 import b64encode

import pytest
from pyspark.sql import functions as F

from betaloom.functions import student
from betaloom.functions import text as T
from betaloom.operators import catalog, convert, evaluate, harmonize, impute, lexical, matrix, models, profile, qc, rules
from betaloom.plans import pipelines
from betaloom.plans.config import QcConfig
from betaloom.sources import delimited, files, soft
from betaloom.streaming import events

LONG = "accession string, sample_id string, probe string, value double"


def cells(spark, rows):
    return spark.createDataFrame([("a", *r) for r in rows], LONG)


def values(df, *keys):
    return {tuple(r[k] for k in keys[:-1]): r[keys[-1]] for r in df.collect()}


def test_model_input_takes_user_reference_before_default(spark):
    long = cells(spark, [("s1", "c1", 0.5), ("s1", "c2", None), ("s1", "c3", 0.8), ("s2", "c1", 0.6), ("s2", "c2", None), ("s2", "c3", 0.9)])
    default = spark.createDataFrame([("c1", 0.55), ("c2", 0.70), ("c3", 0.85)], "probe string, value double")
    got = values(impute.cascade(long, default), "sample_id", "probe", "value")
    assert got["s1", "c2"] == 0.70 and got["s1", "c1"] == 0.5
    user = spark.createDataFrame([("c2", 0.8)], "probe string, value double")
    assert values(impute.cascade(long, default, user), "sample_id", "probe", "value")["s1", "c2"] == 0.8
    with pytest.raises(Exception, match="no imputation reference"):
        impute.cascade(long).collect()


def test_sample_missingness_counts_samples_without_rows(spark):
    long = cells(spark, [("s1", f"p{k}", 1.0) for k in range(4)] + [("s2", f"p{k}", 1.0) for k in range(3)])
    samples = spark.createDataFrame([("a", s) for s in ("s1", "s2", "s3")], "accession string, sample_id string")
    _, probes = qc.dimensions(long)
    got = values(qc.keep_samples(qc.sample_profile(long, samples, probes), 0.25, None).select("sample_id", F.struct("missing", "kept").alias("x")), "sample_id", "x")
    assert [tuple(got[(s,)]) for s in ("s1", "s2", "s3")] == [(0.0, True), (0.25, True), (1.0, False)]


def test_probe_missingness_and_mean(spark):
    long = cells(spark, [(f"s{k}", "p1", v) for k, v in enumerate((1.0, 2.0, 3.0, None))] + [(f"s{k}", "p2", v) for k, v in enumerate((None, None, None, 4.0))])
    samples, _ = qc.dimensions(long)
    probes = spark.createDataFrame([("a", p) for p in ("p1", "p2", "p3")], "accession string, probe string")
    got = values(qc.probe_profile(long, samples, probes, 0.25).select("probe", F.struct("missing", "kept").alias("x")), "probe", "x")
    assert [tuple(got[(p,)]) for p in ("p1", "p2", "p3")] == [(0.25, True), (0.75, False), (1.0, False)]
    for strategy in ("mean", "median"):
        assert values(impute.simple(long, strategy), "sample_id", "probe", "value")["s3", "p1"] == 2.0


def test_largest_value_is_strict(spark):
    long = cells(spark, [("s1", "p", 0.96), ("s2", "p", 0.9601), ("s3", "p", None)])
    got = values(qc.keep_samples(qc.sample_profile(long, *qc.dimensions(long)), None, 0.96), "sample_id", "missing", "largest", "kept")
    assert {k[0]: v for k, v in got.items()} == {"s1": False, "s2": True, "s3": False}


def test_types_and_conversion(spark):
    assert convert.type_share(cells(spark, [("s", str(k), v) for k, v in enumerate((0.0, 0.5, 1.0, None))])).first()["data_type"] == "beta"
    assert convert.type_share(cells(spark, [("s", str(k), 0.5 if k else 2.0) for k in range(20)])).first()["data_type"] == "m"
    r = spark.range(1).select(*[convert.m_to_beta(F.lit(x)).alias(n) for x, n in ((0.0, "a"), (1.0, "b"), (-1.0, "c"))], *[convert.beta_to_m(F.lit(x)).alias(n) for x, n in ((0.5, "d"), (0.8, "e"), (0.2, "f"), (1.0, "g"), (0.0, "h"))]).first()
    assert [r.a, round(r.b, 9), round(r.c, 9)] == [0.5, round(2 / 3, 9), round(1 / 3, 9)]
    assert r.d == 0 and abs(r.e - 2) < 1e-9 and abs(r.f + 2) < 1e-9 and r.g is None and r.h is None


def test_mean_correlation(spark):
    rows = [(s, str(k), float(v)) for s, vs in (("a", (1, 2, 3)), ("b", (2, 4, 6)), ("c", (3, 2, 1))) for k, v in enumerate(vs)]
    got = values(qc.keep_correlated(qc.mean_correlations(cells(spark, rows)), -0.5), "sample_id", "mean_correlation", "constant", "note", "kept")
    assert {k[0]: (round(k[1], 9) + 0.0, v) for k, v in got.items()} == {"a": (0.0, True), "b": (0.0, True), "c": (-1.0, False)}
    flat = rows + [("d", str(k), 1.0) for k in range(3)]
    assert all(r.kept and r.note for r in qc.keep_correlated(qc.mean_correlations(cells(spark, flat))).collect())
    assert qc.mean_correlations(cells(spark, [])).count() == 0


def test_coverage(spark):
    df = spark.createDataFrame([(1, 45.0, "Male"), (2, None, None), (3, 60.0, "Female"), (4, None, "Male")], "id int, age double, sex string")
    got = {r.field: r for r in profile.coverage(df, ["age", "sex"], "id").collect()}
    assert (got["age"].present, got["age"].missing, got["sex"].unique_values, got["sex"].examples) == (2, 2, 2, ["Male", "Female", "Male"])
    empty = {r.field: r for r in profile.coverage(df.limit(0), ["age"], "id").collect()}
    assert not empty or empty["age"].parse_rate == 0


def test_extraction_rules(spark):
    df = spark.createDataFrame([(["age: 45 years", "Sex: F", "note: a:b"], ["s1", "s2"])], "ch array<string>, title array<string>")
    case = lambda c, **k: tuple(df.select(*rules.apply(F.col(c), rules.Rule("x", field=c, **k))).first())
    assert case("ch", key="AGE", pattern=r"(\d+)") == ("45", "45 years")
    assert case("ch", key="note", pattern="(.*)") == ("a", "a")
    assert case("ch", key="tissue", pattern="(.*)") == (None, None)
    assert case("ch", key="age", pattern="(x)") == (None, "45 years")
    assert case("title", pattern=r"s(\d)") == ("2", "s2")
    assert rules.has_alternation("(ab|cd)e") and not rules.has_alternation(r"[a|b]\|")
    with pytest.raises(ValueError):
        rules.Rule("x", confidence=2)


def test_rules_read_a_value_once(spark):
    df = spark.createDataFrame([(1, {"ch": ["a: 1", "A: 2", None, "a: 3", "b: x"]}), (2, {"ch": []}), (3, None), (4, {"ch": ["a: ?"]})], "gsm int, fields map<string,array<string>>")
    found = rules.extract(df, {"age": rules.Rule("age", field="ch", key="a", pattern="([0-9]+)"), "sex": rules.Rule("sex", field="ch", pattern="b: (.)"), "tissue": rules.Rule("tissue", constant="c")})
    got = {r.gsm: (r.age, r.sex, r.tissue, [tuple(f) for f in r.failures]) for r in found.collect()}
    assert got == {1: (2.0, "x", "c", []), 2: (None, None, "c", []), 3: (None, None, "c", []), 4: (None, None, "c", [("sex", "a: ?")])}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1  # each use cut the texts anew before


def test_label_maps(spark):
    guesses = spark.createDataFrame([("unknown_label", "unmatched"), ("missing_label", "nothing")], "source_label string, target_label string")
    selections = spark.createDataFrame([("some_other", "DOID:1234", "mondo", 1)], "source_label string, target_label string, ontology string, seq int")
    got = {r.source_label: (r.target, r.kind) for r in harmonize.final_map(guesses, selections).collect()}
    assert got == {"unknown_label": ("unknown_label", "best_guess"), "missing_label": ("missing_label", "best_guess")}
    assert harmonize.tissue_groups(spark).count() == 29


def test_lexical(spark):
    f = spark.range(1).select(T.features(F.lit("Sample1_Beta-B2")).alias("f")).first().f
    assert (f.norm, f.tokens, f.nums, f.words) == ("sample 1 beta b 2", ["sample", "1", "beta", "b", "2"], ["1", "2"], ["sample", "beta", "b"])
    array = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    r = spark.range(1).select(
        T.jaccard(array("a", "b"), array("b", "c")).alias("a"), T.jaccard(array(), array()).alias("b"), T.number_match(array("1"), array()).alias("c"),
        T.number_match(array("1", "2"), array("2")).alias("d"), T.count_penalty(F.lit(2), F.lit(4), 1.0).alias("e"),
    ).first()
    assert (round(r.a, 9), r.b, r.c, r.d, round(r.e, 6)) == (round(1 / 3, 9), 1.0, 0.6, 0.5, 0.606531)
    assert T.lcs_lengths(["abc", "ab", ""], ["abd", "ba", ""]).tolist() == [2, 1, 0]
    names = spark.createDataFrame([("Sample 1",), ("Sample 2",)], "n string")
    best = {r.a: (r.b, r.score) for r in lexical.best(names, names, "n", "n").collect()}
    assert best == {"Sample 1": ("Sample 1", 1.0), "Sample 2": ("Sample 2", 1.0)}


def test_acceleration_and_metrics(spark):
    rows = spark.createDataFrame([("d", "m", 1.0, 2.0), ("d", "m", 2.0, 3.5), ("d", "m", 3.0, 6.0), ("d", "m", None, 6.0), ("d", "dunedinpace", 1.0, 2.0)], "dataset string, model string, age double, predicted double")
    full = models.acceleration(rows, ["dataset", "model"], model="model")
    got = {(r.model, r.age): r.accel for r in full.collect()}
    assert [round(got["m", a], 9) for a in (1.0, 2.0, 3.0)] == [round(x, 9) for x in (1 / 6, -1 / 3, 1 / 6)] and got["m", None] is None and got["dunedinpace", 1.0] == 2.0
    a = {r.model: r for r in evaluate.metrics(full, ["model"]).collect()}["m"]
    b = {r.model: r for r in evaluate.metrics(full, ["model"], error_on="prediction").collect()}["m"]
    assert (round(a.mae, 9), round(a.medae, 9), round(b.mae, 9), b.medae) == (2.0, round(7 / 3, 9), round(11 / 6, 9), 1.5)


def test_group_statistics(spark):
    rows = spark.createDataFrame([("g", v, False) for v in (3.0, 5.0, 7.0)] + [("g", v, True) for v in (1.0, 2.0, 3.0)] + [("h", 1.0, False)], "g string, x double, control boolean")
    got = {r.g: r for r in evaluate.with_p(evaluate.welch(rows, ["g"], "x", "control")).collect()}
    assert round(got["g"].t, 6) == 2.32379 and round(got["g"].df, 6) == 2.941176 and got["h"].t is None and got["h"].p is None
    one = evaluate.one_sample(rows.where("g = 'g' and not control"), ["g"], "x").first()
    assert round(one.t, 6) == 4.330127 and one.df == 2
    assert student.tail(0, 7) == 0.5 and abs(student.tail(1, 1) - 0.25) < 1e-12 and abs(student.tail(1.959964, 1e7) - 0.025) < 1e-6
    many = spark.createDataFrame([("g", float(k % 7) + (3 if k % 2 else 0), k % 2 == 0) for k in range(60)], "g string, x double, control boolean")
    p = evaluate.permutation(many, ["g"], "x", "control", 200).first()
    assert 1 / 201 <= p.p <= 1 and p.n_valid == 200 and p.p < 0.05


def test_links(spark):
    got = spark.range(1).select(*[F.round(models.adult_link(F.lit(x)), 6).alias(n) for x, n in ((0.0, "a"), (1.0, "b"), (-1.0, "c"))]).first()
    assert tuple(got) == (20.0, 41.0, round(21 / math.e - 1, 6))
    meta = spark.createDataFrame([("Male",), (None,)], "Sex string")
    assert models.usable(["grimage", "hannum"], meta) == ["hannum"]


def test_text(spark):
    text = "key sk-ant-abcdefghij1234 and sk-abcdefghijkl to me.x@site.org"
    r = spark.range(1).select(T.redact(F.lit(text)).alias("a"), T.truncate(F.lit("x" * 500)).alias("b"), T.accessions(F.lit("gse12 and GSE7")).alias("c"), T.append_list(F.lit("q"), F.array(F.lit("a"), F.lit("b"))).alias("d"), T.json_object(F.lit('so: {"k": 3} end'), "$.k").alias("e"), T.slugify(F.lit("Été à  Paris!")).alias("f"), T.numeric_like(F.lit("($1,200.5K)")).alias("g")).first()
    assert r.a == "key sk-ant-<REDACTED> and sk-<REDACTED> to <EMAIL_REDACTED>"
    assert len(r.b) == 214 and r.c == ["gse12", "GSE7"] and r.d == "q\nDatasets of Interest: a, b" and r.e == "3" and r.f == "ete-a-paris" and r.g == -1200500.0


def test_uploads():
    enc = lambda b: b64encode(b).decode()
    got = files.accessions_from_uploads([
        {"name": "a.csv", "content": enc(b"x,GSE\n1,GSE1\n2,other\n3,gse2\n")}, {"name": "b.tsv.gz", "content": enc(gzip.compress(b"Accession\tz\nGSE1\t1\nGSE3\t2\n"))},
        {"name": "c.csv", "content": "!!"}, {"name": "d.csv.gz", "content": enc(b"no gzip")},
    ])
    assert got == ["GSE1", "gse2", "GSE3"]


def test_delimited_matrix_of_more_columns_than_a_table_has(spark, tmp_path):
    folder = tmp_path / "wide"
    folder.mkdir()
    n = 21_000  # the CSV reader ends at 20,480
    head = "ID_REF," + ",".join(f'"S{k}, Beta"' if k == 7 else f"S{k}_Beta" for k in range(n))
    line = lambda p: f'"cg{p}",' + ",".join('"0.5"' if k == 3 else "" if k == 5 else str((k + p) % 10 / 10) for k in range(n))
    (folder / "part-0.csv").write_text("# note\n" + head + "\n" + line(1) + "\n")
    (folder / "part-1.csv").write_text(head + "\n" + line(2) + "\n\n" + "cg3,0.25\n")
    got = values(delimited.format_matrix(spark, str(folder)), "probe", "sample_id", "value")
    assert len(got) == 3 * n and got["cg1", "s3_beta"] == 0.5 and got["cg1", "s5_beta"] is None and got["cg2", "s20999_beta"] == 0.1 and got["cg2", "s7, beta"] == 0.9
    assert got["cg3", "s0_beta"] == 0.25 and got["cg3", "s1_beta"] is None
    (tmp_path / "empty.csv").write_text("# a\n" * 20 + head)
    with pytest.raises(ValueError, match="no header"):
        delimited.format_matrix(spark, str(tmp_path / "empty.csv"))


def test_delimited_matrix(spark, tmp_path):
    path = tmp_path / "m.txt.gz"
    rows = "\n".join(f"cg{k:03d}\t0.{k % 9 + 1}\t{0.01 if k % 2 else 0.2}\t0.5\t0.5" for k in range(20))
    path.write_bytes(gzip.compress(b"# note\nID_REF\tS1_Beta\tS1_Detection_Pval\tS2_Beta\tS2_Detection_Pval\n" + rows.encode()))
    got = values(delimited.format_matrix(spark, str(path)), "sample_id", "probe", "value")
    assert got["s1_beta", "cg001"] == 0.2 and got["s1_beta", "cg002"] is None and got["s2_beta", "cg002"] == 0.5 and len(got) == 40
    with pytest.raises(ValueError):
        delimited.delimiter("abc")
    assert delimited.unchanged(["a_beta", "b"], ("beta", "x"), ("a_b", "y"))


def test_soft_file(spark, tmp_path):
    path = tmp_path / "f.soft"
    path.write_text("^SERIES = GSE1\n!Series_title = T\n!Series_platform_id = GPL5\n!Series_supplementary_file = u\n^SAMPLE = GSM1\n!Sample_title = s1\n!Sample_characteristics_ch1 = age: 3\n!Sample_characteristics_ch1 = sex: F\n!sample_table_begin\nID_REF\tVALUE\tDetection Pval\ncg1\t0.5\t0.01\ncg2\t0.6\t0.5\n!sample_table_end\n^SAMPLE = GSM2\n!Sample_title = s2\n!sample_table_begin\nID_REF\tVALUE\ncg1\t0.7\n!sample_table_end\n")
    read = soft.lines(spark, str(path))
    meta = {r.name: r.fields for r in soft.sample_metadata(read).collect()}
    assert meta["GSM1"]["characteristics_ch1"] == ["age: 3", "sex: F"] and meta["GSM2"]["title"] == ["s2"]
    assert soft.dataset_metadata(read).first().title == "T" and soft.platforms(read).first().value == "GPL5"
    assert values(soft.probe_tables(read), "sample_id", "probe", "value") == {("GSM1", "cg1"): 0.5, ("GSM2", "cg1"): 0.7}


def test_events_stream(spark, tmp_path):
    rows = [("ArtifactWritten", "2024-01-01T00:00:00", "r", "p1", "k"), ("ArtifactWritten", "2024-01-02T00:00:00", "r", "p1", "k"), ("RunCompleted", "2024-01-03T00:00:00", "r", None, None)]
    df = spark.createDataFrame(rows, "event string, timestamp string, run_id string, path string, kind string")
    events.append(df, str(tmp_path / "log"))
    for _ in range(2):
        events.fold_latest(events.stream(spark, str(tmp_path / "log")), str(tmp_path / "latest"), str(tmp_path / "check")).awaitTermination()
        events.append(spark.createDataFrame([("ArtifactWritten", "2024-02-01T00:00:00", "r", "p2", "k")], df.schema), str(tmp_path / "log"))
    latest = events.LatestState(spark, str(tmp_path / "latest")).read()
    assert {(r.path, r.timestamp.isoformat()) for r in latest.collect()} == {("p1", "2024-01-02T00:00:00"), ("p2", "2024-02-01T00:00:00")}
    assert {r.event: r.n for r in events.profile(df).collect()} == {"ArtifactWritten": 2, "RunCompleted": 1}


def test_config(tmp_path):
    assert QcConfig.from_text("sample_missing: ${M}\nother: 1 # x\nimputer: median", {"M": "0.3"}) == QcConfig(sample_missing=0.3, imputer="median")
    with pytest.raises(KeyError):
        QcConfig.from_text("largest: ${NONE}", {})
    with pytest.raises(ValueError):
        QcConfig.from_text("just text", {})
    with pytest.raises(ValueError):
        QcConfig(sample_missing=2)
    assert QcConfig.from_file(str(tmp_path / "none.yml")) is None


def test_catalog(spark):
    steps = spark.createDataFrame([("A", "download", "running"), ("A", "qc", "not_started"), ("B", "qc", "completed")], "accession string, step string, status string")
    failed = spark.createDataFrame([("A",)], "accession string")
    got = {(r.accession, r.step): r.status for r in catalog.propagate_failures(steps, failed, "download", ["qc"]).collect()}
    assert got == {("A", "download"): "failed", ("A", "qc"): "canceled", ("B", "qc"): "completed"}
    kinds = spark.createDataFrame([("a", "HTTPError", None), ("b", "OSError", 28), ("c", "Strange", None)], "i string, k string, e int")
    assert {r.i: r.c.category for r in kinds.select("i", catalog.error_class(F.col("k"), F.col("e")).alias("c")).collect()} == {"a": "http_error", "b": "disk_full", "c": "unknown_error"}
    names = spark.createDataFrame([("s10",), ("S2",), (None,)], "n string").orderBy(catalog.natural_key(F.col("n")).asc_nulls_last())
    assert [r.n for r in names.collect()] == ["S2", "s10", None]
    titles = spark.createDataFrame([("Array, methylation 450k", "x"), ("other", "GPL1"), (None, None)], "t string, g string")
    assert [r.m for r in titles.select(catalog.is_methylation(F.col("t"), F.col("g"), ["GPL1"]).alias("m")).collect()] == [True, True, False]


def test_whole_benchmark(spark):
    rows = [(d, "m", 20.0 + k, 21.0 + k + (k % 3), "Control" if k % 2 else "Case") for d in ("x", "y") for k in range(20)]
    df = spark.createDataFrame(rows, "dataset string, model string, age double, predicted double, status string")
    got = {r.dataset: r.n for r in pipelines.benchmark(df, "dataset", "model", "status", "Control").collect()}
    assert got == {"overall": 20, "x": 10, "y": 10}
    assert pipelines.benchmark(df, "dataset", "model", "status", "none").count() == 0


def test_align_and_shapes(spark):
    long = cells(spark, [("s1", "p1", 1.0), ("s2", "p2", 2.0), ("s2", "p9", 3.0)])
    wanted = spark.createDataFrame([("p1",), ("p2",)], "probe string")
    assert values(matrix.align(long, long, wanted), "sample_id", "probe", "value") == {("s1", "p1"): 1.0, ("s1", "p2"): None, ("s2", "p1"): None, ("s2", "p2"): 2.0}
    wide = matrix.to_wide(long)
    assert wide.columns == ["sample_id", "p1", "p2", "p9"] and matrix.from_wide(wide, "sample_id", ["p1", "p2"]).count() == 4
    assert matrix.detection_filter(long).count() == 3


def test_event_log_keeps_microseconds(spark, tmp_path):
    rows = spark.sql("SELECT 'ArtifactWritten' AS event, id AS thread_id, timestamp_ntz '2024-01-01 00:00:00.000001' AS timestamp, 'p' AS path FROM VALUES ('a'), ('b') AS t(id)")
    late = spark.sql("SELECT 'ArtifactWritten' AS event, 'a' AS thread_id, timestamp '2024-01-01 00:00:00.000002' AS timestamp, 'q' AS path")
    for write, name in ((events.append, "all"), (events.write_by_thread, "threads")):
        write(rows, str(tmp_path / name))
        write(late, str(tmp_path / name))
        got = events.in_order(events.read_threads(spark, str(tmp_path / name), "a")).collect()
        assert [(r.path, r.timestamp.microsecond) for r in got] == [("p", 1), ("q", 2)]
    assert events.read_threads(spark, str(tmp_path / "threads")).count() == 3


def test_pairs_by_position_need_partners():
    assert delimited.pairs_by_position(["id", "A Value", "A Pval", "B Value", "B Pval"], "value", "pval") == {"A Value": "A Pval", "B Value": "B Pval"}
    with pytest.raises(ValueError):
        delimited.pairs_by_position(["A Value", "B Value", "A Pval"], "value", "pval")


def test_platform_probe_column_takes_the_first_at_nine_tenths(spark):
    table = spark.createDataFrame([(f"x{k}", f"CG{k}" if k else "ch1", f"cg{k}") for k in range(10)], "a string, b string, c string")
    assert delimited.platform_probe_column(table) == "b"
    with pytest.raises(ValueError):
        delimited.platform_probe_column(table.select("a"))
    with pytest.raises(ValueError):
        delimited.platform_probe_column(table.limit(0))


def test_reviewed_takes_the_last_decision_and_ties_by_its_name(spark):
    requests = spark.createDataFrame([("r1",), ("r2",), (None,)], "id string")
    decisions = spark.createDataFrame([("r1", 1, "reject"), ("r1", 2, "accept"), ("r1", 2, "edit"), (None, 1, "accept")], "id string, seq int, decision string")
    from betaloom.operators import control

    assert values(control.reviewed(requests, decisions, "id", "seq"), "id", "decision") == {("r1",): "edit", ("r2",): "pending", (None,): "pending"}
