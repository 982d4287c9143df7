"""The pipeline's stages, each against a plain version on a small fixture; and the package without this subpackage."""

from __future__ import annotations

import hashlib
import shutil
import subprocess
import sys
from pathlib import Path

import public_tokenizers

import corpus_pipeline as pipeline
from betaloom.llm import secret_scan

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ROOT = Path(__file__).resolve().parents[2]


def test_stages(spark, tmp_path):
    import sentencepiece

    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120).collect()
    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").first()
    rows = [tuple(r) for r in base] + [(900, base[0].text, "fr", "s", 1), (901, None, None, None, None), (902, "", "en", "s", 0), (903, base[1].text + " " + item.text, "en", "s", 1), (904, "token = abcdef0123456789 " + " ".join(base[2].text.split()[::-1]), "en", "s", 1), (905, base[3].text, "en", "s", 1), (905, base[3].text, "en", "s", 1), (906, "12345", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    d = "/root/testdata/sf0.001"

    kept = {}
    for name, stage in pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()} if "text" in docs.columns else {}
        out = stage(spark, docs, d)
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = (before, docs)
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == list(pipeline.COLUMNS)
    ids = lambda name: {r.doc_id for r in kept[name][1].select("doc_id").collect()}
    assert {901, 902, 906} & ids("language_id") == set() and len(ids("language_id")) >= 124
    assert 900 not in ids("near_dedup") and kept["near_dedup"][1].count() == len(ids("near_dedup")) and 0 in ids("near_dedup")
    assert 903 not in ids("decontamination") and 904 in ids("decontamination")
    for r in kept["secret_scan"][1].collect():
        before = kept["secret_scan"][0][r.doc_id]
        assert r.text == secret_scan.redact(before) and r.n_chars == len(r.text)
        assert ("[REDACTED]" in r.text) == bool(secret_scan.find_spans(before))
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in kept["sentencepiece"][1].collect():
        want = library.encode(kept["sentencepiece"][0][r.doc_id])
        assert r.ids == want and r.n_tokens == len(want) and r.decoded_sha256 == hashlib.sha256(library.decode(want).encode()).hexdigest()


def test_the_rest_works_without_this_subpackage(tmp_path):
    def run(gone: tuple[str, ...], code: str, name: str) -> None:
        folder = tmp_path / name
        shutil.copytree(ROOT, folder, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", *gone))
        subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, check=True, timeout=120)

    core = "n = e.queries(); assert 'qc_pipeline' in n and 'qc_pipeline' in e.oracle_sql() and not any(k.startswith('op1') or k == 'pipeline' for k in n), n"
    run(("llm", "corpus_pipeline.py"), "import __spark_entry__ as e; " + core, "both")
    run(("llm",), "import __spark_entry__ as e; " + core, "folders")
    run((), "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; " + core, "library")


def test_two_texts_of_one_id_in_two_components_both_stay(spark):
    a, b = "first words of a text that is not like the other one", "something else altogether stands here with no word in common"
    rows = [(5, a, "en", "s", 1), (5, b, "en", "s", 1), (7, a, "en", "s", 1), (5, a, "de", "r", 1), (None, b, "en", "s", 1), (None, "lonely " * 9, None, None, None)]
    out = pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCUMENTS), "").collect()
    assert sorted(map(tuple, out), key=str) == sorted([(5, a, "de", "r", 1), (5, b, "en", "s", 1), (None, "lonely " * 9, None, None, None)], key=str)


def test_without_labels_all_documents_stay(spark):
    rows = [(1, "a text", None, "s", 1), (2, None, None, None, None)]
    assert pipeline.language_id(spark, spark.createDataFrame(rows, DOCUMENTS), "").count() == 2
