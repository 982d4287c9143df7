"""Fill-in-the-middle, alignment of two tokenizers and backtracking BPE, against the libraries and plain definitions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest

from betaloom.llm import alignment, byte_bpe, fill_in_middle
from betaloom.llm.token_counts import _byte_characters

PIECES = ["a", "b", "the", "é", " ", "  ", "\n", "漢", "😀", "▁", ".", "1", "Ü", "́", "'s", "'", "½", "²", "\x1c", "\x85", "!", "<|endoftext|>", "<|startoftext|>", "ǅ", "\x00", "<s>", "aaaa", "\t", "\r", ");", "\xa0", "　", "Σ", "İ", "ſ", "ning", "Һ"]


def texts(n: int, seed: int = 5) -> list[str]:
    rng = random.Random(seed)
    anything = [chr(rng.choice([rng.randrange(0x20, 0x3000), rng.randrange(0x3000, 0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(600)]
    odd = ["", " ", "  a", "\n", "a" * 5000, " " * 300 + "x", "ab" * 3000, "!" * 900, "\r\n" * 40, "12345 0x1F!!! ..."]
    return odd + ["".join(rng.choice(PIECES if k % 3 else anything) for _ in range(rng.randint(1, 30))) for k in range(n)]


@pytest.fixture(scope="module")
def documents(spark):
    return [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]


# ---- backtracking BPE


def test_word_bpe_equals_the_library(documents):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(byte_bpe.VOCABULARY)
    library, own = Tokenizer.from_file(path), byte_bpe.load(path)
    for t in texts(3000) + documents:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t).tolist() == ids, repr(t[:80])
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_any_word_merges_as_defined():
    """On a small vocabulary of its own: every string over two letters up to a length, against the plain merges."""
    rng = random.Random(7)
    for trial in range(30):
        vocabulary, merges = {"a": 0, "b": 1}, []
        while len(merges) < 12:
            x, y = rng.choice(list(vocabulary)), rng.choice(list(vocabulary))
            if x + y not in vocabulary:
                vocabulary[x + y] = len(vocabulary)
                merges.append(f"{x} {y}")
        bpe = byte_bpe.Backtracking(vocabulary, merges)
        for n in range(1, 11):
            for bits in range(0, 1 << n, 1 if n < 9 else 7):
                word = format(bits, f"0{n}b").translate({48: "a", 49: "b"})
                parts = list(word)
                for x, y in (m.split(" ") for m in merges):  # ranks upwards, each from the left
                    k = 0
                    while k < len(parts) - 1:
                        if parts[k] == x and parts[k + 1] == y:
                            parts[k : k + 2] = [x + y]
                        k += 1
                assert bpe.encode(word) == [vocabulary[p] for p in parts], (trial, merges, word)


def test_word_bpe_digests(spark, documents):
    rows = [(k, t) for k, t in enumerate(texts(60) + documents[:30])] + [(900, None)]
    own = byte_bpe.load(public_tokenizers.path(byte_bpe.VOCABULARY))
    got = {r.doc_id: r for r in byte_bpe.digests(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    whole = {r.doc_id: r for r in byte_bpe.encode_decode(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for k, t in rows:
        ids = own.encode(t or "").tolist()
        assert whole[k].ids == ids and whole[k].decoded == own.decode(ids)
        assert got[k].n_tokens == len(ids) and got[k].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(own.decode(ids).encode()).hexdigest()


# ---- fill in the middle


def plain_cut(doc_id: int | None, text: str | None) -> tuple:
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in fill_in_middle.MARKS):
        return len(units), "plain", None, None, text
    lo, hi = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_equals_the_plain_version(spark, documents):
    rng = random.Random(9)
    rows = [(k, "".join(rng.choice(["a", "\n", "é😀\n", "<", "S>", "<S", "P", ">", "<M", "\r\n", " x"]) for _ in range(rng.randint(0, 25)))) for k in range(400)]
    rows += [(1000 + k, t) for k, t in enumerate(documents[:40])] + [(5, None), (5, ""), (5, "x\ny"), (None, "p\nq\nr"), (None, "p\nq\nr"), (7, "x\n" * 200_000), (8, "\n"), (9, "no feed")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    made = fill_in_middle.transform(df)
    got = made.withColumn("back", fill_in_middle.restore(made["form"], made["output"])).collect()
    want = [(d, *plain_cut(d, t), t or "") for d, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_parameters(spark):
    df = spark.createDataFrame([(k, f"alpha {k}. beta. gamma") for k in range(50)], "doc_id bigint, text string")
    words = {r.doc_id: r for r in fill_in_middle.transform(df, unit="[^ ]* |[^ ]+", percent=40, spm_percent=0, marks=("[p]", "[s]", "[m]")).collect()}
    assert {r.form for r in words.values()} == {"plain", "psm"} and all(r.n == 4 for r in words.values())
    with pytest.raises(ValueError, match="overlap"):
        fill_in_middle.transform(df, marks=("<P>", "><", "<M>"))
    with pytest.raises(Exception, match="leaves a gap"):
        fill_in_middle.transform(df, unit="[a-z]+").collect()


def test_fill_in_middle_sql(spark):
    d = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}'")
    want = con.sql(fill_in_middle.oracle()).fetchall()
    assert sorted(tuple(r) for r in fill_in_middle.digests(spark.read.parquet(d)).collect()) == sorted(want)


# ---- alignment


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path(alignment.BYTE_VOCABULARY))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.PIECE_MODEL))


def plain_groups(text: str | None, libraries) -> list:
    if not text:
        return []
    first, second = libraries
    back = {c: b for b, c in _byte_characters().items()}
    a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
    sides = [(a, [bytes([back[c] for c in first.id_to_token(i)]) for i in a]), (b, [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b])]
    if any(b"".join(s) != (" " + text).encode() for _, s in sides):
        return []
    ends = [np.cumsum([len(x) for x in s]).tolist() for _, s in sides]
    both, out = set(ends[0]) & set(ends[1]), {}
    for side, (ids, _) in enumerate(sides):
        for i, e in zip(ids, ends[side]):
            out.setdefault(min(x for x in both if x >= e) if len(both) < 50 else next(x for x in range(e, ends[0][-1] + 1) if x in both), ([], []))[side].append(i)
    return [out[e] for e in sorted(out)]


def test_groups_equal_the_plain_version(documents, libraries):
    aligner = alignment.load(*alignment._paths(None, None))
    for t in texts(1500, 8) + documents[:60]:
        assert aligner.groups(t) == plain_groups(t, libraries), repr(t[:80])


def test_rows_in_pieces_and_blocks(documents, libraries, monkeypatch):
    """Small bounds: texts in several pieces, groups multiplied out apart, keys in several parts."""
    for name, value in (("CHARS_AT_ONCE", 700), ("LARGE", 3), ("PART_KEYS", 40)):
        monkeypatch.setattr(alignment, name, value)
    batch = [None, "", *texts(300, 3), *documents[:30], "x▁y", "▁" * 50 + "a b", "word " * 500 + "▁"]
    for (k, counts, digest, parts), text in zip(alignment.load(*alignment._paths(None, None)).rows(batch), batch, strict=True):
        groups = plain_groups(text, libraries)
        want, got = Counter(x << 32 | y for a, b in groups for x in a for y in b), {}
        for keys, links in parts:
            assert got.keys().isdisjoint(keys.tolist())
            got |= dict(zip(keys.tolist(), links.tolist()))
        assert batch[k] is text and got == want
        assert counts == (sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), want.total())
        assert digest == (hashlib.sha256(";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups).encode()).hexdigest() if groups else "")


@pytest.mark.parametrize("part", [1 << 17, 60])
def test_alignment_equals_brute_force(spark, documents, libraries, monkeypatch, part):
    monkeypatch.setattr(alignment, "PART_KEYS", part)
    rows = [(k, t) for k, t in enumerate(documents[:50] + texts(80, 4))] + [(3, documents[3]), (None, documents[5]), (700, None), (701, "a▁b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    groups = [plain_groups(t, libraries) for _, t in rows]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    counts = Counter(p for n in links for p in n)
    top: dict = {}
    for (a, _), n in counts.items():
        top[a] = max(top.get(a, 0), n)
    want = [
        (d, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), n.total(), sum(v for p, v in n.items() if counts[p] == top[p[0]]), sum(counts[p] * v for p, v in n.items()))
        for (d, _), g, n in zip(rows, groups, links)
    ]
    got = alignment.align(df)
    assert sorted((tuple(r)[:7] for r in got.collect()), key=str) == sorted(want, key=str)
    assert {(r.a, r.b): r.documents for r in alignment.pair_counts(df).collect()} == counts
    shown = {r.doc_id: [(x.a, x.b) for x in r.groups] for r in alignment.groups(df.where("doc_id >= 50")).collect()}
    assert shown == {d: g for (d, _), g in zip(rows, groups) if d and d >= 50}


def test_shards_without_files(tmp_path):
    """A store that can't be mapped gives the same counts; a key in no shard is an error."""
    keys, counts = np.arange(0, 1000, 7, dtype="<i8"), np.arange(143, dtype="<i8")
    manifest = []
    for k, lo in enumerate(range(0, 143, 50)):
        for name, x in (("keys", keys), ("counts", counts)):
            x[lo : lo + 50].tofile(tmp_path / f"{k}.{name}")
        manifest.append((str(k), len(keys[lo : lo + 50]), int(keys[lo])))
    wanted = np.array([994, 0, 7, 350, 0])
    for local in (True, False):
        shards = alignment.Shards(f"file://{tmp_path}", manifest)
        shards.local = local
        assert shards.counts(wanted).tolist() == [142, 0, 1, 50, 0]
        with pytest.raises(ValueError, match="no shard"):
            shards.counts(np.array([3]))
