"""Every operator and stage on the same awkward tables: nulls, empty and long texts, repeats, clashing names, no rows."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline as pipeline
from betaloom.llm import alignment, byte_bpe, decontamination, fill_in_middle, langid, licenses, piece_bpe, quality, secret_scan, simhash, substring_dedup, token_counts, warc
from betaloom.llm.common import new_folder

PLAIN = "The permission is hereby granted free of charge to any person who reads this text with token = abcdef123456 in it."
LONG = " ".join(f"word{k % 9973} and text" for k in range(70_000))  # over a megabyte
ROWS = [
    (1, None, "en", "s", None, "x", "y"), (1, "", "en", "s", 0, "x", "y"), (2, PLAIN, None, None, None, "x", "y"), (2, PLAIN, None, None, None, "x", "y"),
    (None, PLAIN, "en", "s", 1, None, None), (None, PLAIN, "en", "s", 1, None, None), (3, " \n\t ", "en", "s", 3, "x", "y"), (3, LONG, "en", "s", 1, "x", "y"), (4, "é漢😀", "fr", "s", 3, "x", "y"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, TEXT string, DOC_ID string"
D = "/root/testdata/sf0.001"


def _warc(spark, df):
    folder = new_folder(spark, "warc")
    warc.write(df.toDF("page_id", "html", "url", "source", "n_chars", "HTML", "URL"), folder)
    return warc.read(spark, folder)


ONE_ROW_EACH = {
    "op1": lambda spark, df: langid.identify(df), "op2": lambda spark, df: licenses.scan(df), "op3": lambda spark, df: token_counts.count_tokens(df),
    "op4": lambda spark, df: simhash.near_duplicates(df), "op5": lambda spark, df: secret_scan.digests(df), "op7": lambda spark, df: quality.quality(df),
    "op8": _warc, "op9": lambda spark, df: piece_bpe.digests(df), "op10": lambda spark, df: substring_dedup.dedup(df),
    "op11": lambda spark, df: fill_in_middle.transform(df), "op12": lambda spark, df: alignment.align(df), "op13": lambda spark, df: byte_bpe.digests(df),
}


@pytest.mark.parametrize("name", ONE_ROW_EACH)
def test_operators(spark, name):
    df = spark.createDataFrame(ROWS, SCHEMA)
    out = ONE_ROW_EACH[name](spark, df)
    rows = out.collect()
    ids = Counter(r[0] for r in rows)
    assert ids == Counter(r[0] for r in ROWS)
    for i in (2, None):  # rows that repeat have equal results
        assert len({tuple(r) for r in rows if r[0] == i}) == 1
    none = ONE_ROW_EACH[name](spark, df.limit(0))
    assert none.columns == out.columns and none.count() == 0


def test_decontamination(spark):
    items = spark.createDataFrame([(1, PLAIN), (1, PLAIN), (2, None), (3, ""), (4, LONG)], "item_id bigint, text string")
    df = spark.createDataFrame(ROWS, SCHEMA)
    found = Counter((r.doc_id, r.item_id) for r in decontamination.leaks(df, items).collect())
    assert found == {(2, 1): 1, (None, 1): 1, (3, 4): 1}
    left = decontamination.decontaminate(df, items)
    assert left.columns == df.columns and Counter(r[0] for r in left.collect()) == {1: 2, 3: 1, 4: 1}
    assert decontamination.leaks(df.limit(0), items).count() == 0 and decontamination.leaks(df, items.limit(0)).count() == 0
    assert decontamination.decontaminate(df.limit(0), items).count() == 0 and decontamination.decontaminate(df, items.limit(0)).count() == len(ROWS)


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stages(spark, name):
    stage = dict(pipeline.STAGES)[name]
    df = spark.createDataFrame(ROWS, SCHEMA)
    out = stage(spark, df, D)
    kept = Counter(r[0] for r in out.collect())
    # without letters: rejected; null and empty texts are one component of SimHash, and so are the copies
    want = {"language_id": {2: 2, None: 2, 3: 1, 4: 1}, "near_dedup": {1: 1, 2: 1, 3: 1, 4: 1}}.get(name, {1: 2, 2: 2, None: 2, 3: 2, 4: 1})
    assert kept == want
    none = stage(spark, df.limit(0), D)
    assert none.columns == out.columns and none.count() == 0
