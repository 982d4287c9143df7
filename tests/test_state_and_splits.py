"""Files read in splits, state kept by batches, and runs that go on."""

from __future__ import annotations

import datetime
import os

import pytest
from pyspark.sql import functions as F

from betaloom.plans import pipelines
from betaloom.plans.config import QcConfig
from betaloom.plans.ledger import Ledger
from betaloom.sources import soft
from betaloom.streaming import events


def soft_text(samples: int, probes: int) -> str:
    out = ["above all", "^SERIES = GSE1", "!Series_title = t", "!Series_supplementary_file = f.gz"]
    for k in range(samples):
        out += [f"^SAMPLE = GSM{k}", f"!Sample_title = s{k}", "!Sample_characteristics_ch1 = age: 4", "!sample_table_begin", "ID_REF\tVALUE"]
        out += [f"cg{p:05d}\t{(k * 31 + p) % 97 / 97:.4f}" for p in range(probes)] + ["!Sample_Table_End"]
    return "\n".join(out) + "\n"


def plain_sections(text: str) -> list[tuple]:
    out, kind, name, depth = [], "", "", 0
    for line in text.splitlines():
        if line.startswith("^"):
            kind, _, name = line[1:].partition(" = ")
        low = line.lower()
        depth += (low.startswith("!") and low.split(" ")[0].endswith("_table_begin")) - (low.startswith("!") and low.split(" ")[0].endswith("_table_end"))
        out.append((kind, name, line, depth > 0))
    return out


@pytest.mark.parametrize("size", ["300", "1000", "100000000"])
def test_soft_lines_over_splits(spark, tmp_path, size):
    texts = {"a": soft_text(5, 60), "b": soft_text(1, 3), "c": "no section\n"}
    for name, text in texts.items():
        (tmp_path / f"{name}.soft").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        scanned = soft.scan(spark, str(tmp_path / "*.soft"))
        most = scanned.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        splits = scanned.where(F.col("file").endswith("a.soft")).select("block").distinct().count()
        read = soft.lines(spark, str(tmp_path / "*.soft")).collect()
        cells = soft.probe_tables(soft.lines(spark, str(tmp_path / "*.soft"))).count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    if size == "1000":
        assert splits >= 4 and most < 200  # of 345 lines
    for name, text in texts.items():
        mine = sorted((r for r in read if r.file.endswith(f"{name}.soft")), key=lambda r: r.line_no)
        assert len({r.line_no for r in mine}) == len(mine)
        assert [(r.kind, r["name"], r.line, r.in_table) for r in mine] == plain_sections(text)
    assert cells == 5 * 60 + 3


def event(k: int, path: str | None, status: str) -> tuple:
    return ("ArtifactWritten", datetime.datetime(2024, 1, 1) + datetime.timedelta(microseconds=k), "r", None, "t", path, "csv", "s", status, None)


def size_of(path: str) -> int:
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files if f.endswith(".parquet"))


def test_state_grows_by_its_batches_only(spark, tmp_path):
    state = events.LatestState(spark, str(tmp_path / "s"), compact_after=100)
    state.add(spark.createDataFrame([event(k, f"p{k}", "x" * 20) for k in range(5000)], events.SCHEMA).coalesce(1), 0)
    whole = size_of(str(tmp_path / "s"))
    for b in range(1, 5):
        state.add(spark.createDataFrame([event(10_000 + b, f"p{b}", f"b{b}"), event(1, None, "no path")], events.SCHEMA).coalesce(1), b)
    assert size_of(str(tmp_path / "s")) - whole < whole / 5
    got = {r.path: r.status for r in state.read().collect()}
    assert len(got) == 5000 and [got[f"p{b}"] for b in range(6)] == ["x" * 20, "b1", "b2", "b3", "b4", "x" * 20]
    state.compact()
    assert {r.path: r.status for r in state.read().collect()} == got
    assert sorted(n.split("-")[0] for n in os.listdir(tmp_path / "s")) == ["CURRENT", "base"]


def test_a_batch_that_is_repeated_changes_nothing(spark, tmp_path):
    state = events.LatestState(spark, str(tmp_path / "s"), compact_after=2)
    batches = [spark.createDataFrame([event(b, "p", f"b{b}"), event(b, f"q{b}", "q")], events.SCHEMA) for b in range(5)]
    for b, batch in enumerate(batches):
        state.add(batch, b)
        before = state.current()
        state.add(batches[0], b)
        state.add(batch, max(0, b - 1))
        assert state.current() == before
    assert {r.path: r.status for r in state.read().collect()} == {"p": "b4"} | {f"q{b}": "q" for b in range(5)}
    os.rename(tmp_path / "s" / state.current()["base"], tmp_path / "gone")
    with pytest.raises(FileNotFoundError, match="is gone"):
        state.read()


def test_a_run_goes_on_where_it_stopped(spark, tmp_path):
    rows = [("a", s, p, 0.1 + (s * 7 + p * 3) % 11 / 20) for s in range(6) for p in range(8)]
    data = str(tmp_path / "m")
    spark.createDataFrame(rows, "accession string, sample_id int, probe int, value double").write.parquet(data)
    config = QcConfig(correlation=-1.0)

    def run(config: QcConfig) -> tuple[Ledger, set]:
        ledger = Ledger(spark, str(tmp_path / "ledger"))
        out = pipelines.quality_control(spark.read.parquet(data), config, None, ledger, {"matrix": ledger.files(data)})
        return ledger, {(r.sample_id, r.probe, round(r.value, 9)) for r in out.clean.collect()}

    want = {(r.sample_id, r.probe, round(r.value, 9)) for r in pipelines.quality_control(spark.read.parquet(data), config).clean.collect()}
    first, got = run(config)
    assert first.made == ["type", "kept-samples", "filled", "correlations"] and got == want
    # a run killed in the last step: its folder is there without the marker
    folder = next(n for n in os.listdir(tmp_path / "ledger") if n.startswith("correlations-"))
    os.remove(tmp_path / "ledger" / folder / "_SUCCESS")
    again, got = run(config)
    assert again.found == ["type", "kept-samples", "filled"] and again.made == ["correlations"] and got == want
    # another parameter: only what depends on it
    other, _ = run(QcConfig(correlation=-1.0, imputer="median"))
    assert other.found == ["type", "kept-samples"] and other.made == ["filled", "correlations"]
    # another file: all of it
    spark.createDataFrame(rows[:1], "accession string, sample_id int, probe int, value double").write.mode("append").parquet(data)
    assert run(config)[0].found == []
    with pytest.raises(ValueError, match="digests"):
        pipelines.quality_control(spark.read.parquet(data), config, None, first)


def test_small_predicates(spark):
    """Detection columns, unchanged patterns, empty data, order of events, progress, whole values."""
    from betaloom.operators import control, rules
    from betaloom.sources import delimited

    assert delimited.has_detection(10, 1000) and not delimited.has_detection(1000, 10)
    columns = ["ID", "a.beta", "a.pval", "b.beta", "b.pval"]
    assert delimited.unchanged(columns, ("beta", "pval"), ("BETA$", "p.al")) and not delimited.unchanged(columns, ("beta", "pval"), ("a.beta", "pval"))
    df = spark.createDataFrame([event(3, "p", "x"), event(1, "q", "y"), event(3, "o", "z")], events.SCHEMA)
    assert [r.path for r in events.in_order(df, "path").collect()] == ["q", "o", "p"]
    assert control.is_empty(df.limit(0)) and not control.is_empty(df)
    assert spark.range(1).select(control.progress(F.lit(2), F.lit(5)).alias("t")).first().t == "2 of 5 datasets"
