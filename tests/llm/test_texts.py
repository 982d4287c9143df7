"""Operators that look at one text at a time, against the libraries and plain definitions."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest

from betaloom.llm import piece_bpe, quality, secret_scan, token_counts

PIECES = ["a", "b", "the", "é", " ", "  ", "\n", "漢", "😀", "▁", ".", "1", "Ü", "́", "'s", "'", "½", "²", "\x1c", "\x85", "!", "<|endoftext|>", "ǅ", "\x00", "<s>", "aaaa", "\t"]
ODD = ["", " ", "  a", "a  b   c", "\n", "▁", "▁▁▁▁", "<s></s>", "\x00x", "é😀漢字", "﻿x", "a" * 5000, " " * 300 + "x", "ab" * 3000, "12345 0x1F!!! ..."]


def texts(n: int) -> list[str]:
    rng = random.Random(5)
    return ODD + ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def documents(spark):
    return [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]


def test_sentencepiece_equals_the_library(documents):
    import sentencepiece

    path = public_tokenizers.path(piece_bpe.MODEL)
    library, own, shown = sentencepiece.SentencePieceProcessor(model_file=path), piece_bpe.load(path), piece_bpe._shown(path)
    for t in texts(1500) + documents:
        ids = library.encode(t)
        assert own.encode(t) == ids, repr(t[:80])
        assert own.decode(ids) == library.decode(ids)
        assert "".join(shown[c][2] for c in own.split(t)).removeprefix(" ") == library.decode(ids)


def test_decoding_of_any_ids():
    import sentencepiece

    path = public_tokenizers.path(piece_bpe.MODEL)
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), piece_bpe.load(path)
    rng = random.Random(1)
    for _ in range(500):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randint(1, 8))]
        assert own.decode(ids) == library.decode(ids), ids


def test_token_counts_equal_the_library(documents):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(token_counts.VOCABULARY)
    library, own = Tokenizer.from_file(path), token_counts.load(path)
    for t in texts(1500) + documents:
        assert own.count(t) == len(library.encode(t, add_special_tokens=False).ids), repr(t[:80])


def test_whole_tokens_are_single(documents):
    own = token_counts.load(public_tokenizers.path(token_counts.VOCABULARY))
    assert all(len(own.merge(w.encode().decode("latin-1").translate(own.table))) == 1 for w in random.Random(2).sample(sorted(own.whole), 500))
    long = own.letters[97] * 1000
    assert own._merge_long(list(long)) == own.merge(long) and "".join(own.merge(long)) == long


def base_secrets(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", m.start(), m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))


def test_base_secrets_equal_plain_patterns(documents):
    rng = random.Random(3)
    parts = ["PassWord", "token", "api_key", "apikey", " = ", ":", "'", '"', "AKIA", "ABCD1234EFGH5678", "0123456789ab", "cdef", "é", "secret", "x", "İ", "ſ", " ", "token=token=abcdefg"]
    for t in ["".join(rng.choice(parts) for _ in range(rng.randint(1, 15))) for _ in range(3000)] + documents + [""]:
        assert [s for s in secret_scan.find_spans(t) if s[0] in secret_scan.BASE_KINDS] == base_secrets(t), t


def test_secrets_with_checksums():
    body = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    value, digits = zlib.crc32(body.encode()), ""
    while value:
        value, d = divmod(value, 62)
        digits = secret_scan.DIGITS[d] + digits
    good = f"ghp_{body}{digits.rjust(6, '0')}"
    assert ("checked", 2, 2 + len(good)) in secret_scan.find_spans(f"x {good}.")
    assert not secret_scan.find_spans(f"x ghp_{body}000000.")
    web = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.c2ln"
    assert secret_scan.find_spans(web)[0] == ("webtoken", 0, len(web)) and not secret_scan.find_spans("eyJxx.yy.zz")
    assert secret_scan.redact(f"a {good} b") == "a [REDACTED] b" and secret_scan.redact(None) is None and secret_scan.redact("plain") == "plain"


def test_repeated_words_and_lines():
    rng = random.Random(4)
    for _ in range(300):
        w = [rng.choice("ab") for _ in range(rng.randint(0, 30))]
        counts = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if counts[tuple(w[k : k + 5])] > 1 for j in range(5)}
        assert quality.repeated_words(w) == len(covered)
    assert quality.repeated_lines("a\nb\na\n \n \n\na") == 2


def plain_quality(rows: list, fence: float) -> list:
    """The whole query by plain code: counts, measures by the library's ids, exact quartiles, verdicts."""
    import math

    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(piece_bpe.MODEL))
    out = []
    for d, t in rows:
        t = t or ""
        w = re.findall("[^\\x20\\x09-\\x0D]+", t)
        counts = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        again = {k + j for k in range(len(w) - 4) if counts[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = t.split("\n")
        dup = sum(bool(re.search("[^\\x20\\x09-\\x0D]", x)) and x in lines[:k] for k, x in enumerate(lines))
        ids = library.encode(t)
        n = len(ids)
        size = -(-n // max(1, round(n / quality.TOKENS))) if n else 1
        blocks = [ids[lo : lo + size] for lo in range(0, n, size)]
        even = [-sum(v / len(b) * math.log2(v / len(b)) for v in Counter(b).values()) / math.log2(len(b)) if len(b) > 1 else 1.0 for b in blocks]
        fallback = max(0, sum(library.is_byte(i) for i in ids) - t.count("\n"))
        m = (len(t) / n, fallback / n, sum(even) / len(even)) if n else (0.0, 0.0, 0.0)
        out.append([d, len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), dup, len(again), len(w) < 10 or 100 * len(again) > 20 * len(w), quality.main_script(t), m])
    limits = {}
    for script in {r[7] for r in out}:
        mine = [r[8] for r in out if r[7] == script and not r[6]]
        if mine:
            q = [[sorted(c)[max(1, math.ceil(len(c) * p)) - 1] for p in (0.25, 0.5, 0.75)] for c in zip(*mine)]
            width = [fence * max(q[k][2] - q[k][0], least * (q[0][1] if k == 0 else 1)) for k, least in enumerate(quality.LEAST_SPREAD)]
            limits[script] = (q[0][0] - width[0], q[0][2] + width[0], q[1][2] + width[1], q[2][0] - width[2])
    for r in out:
        b = limits.get(r[7])
        r.append(not r[6] and (b is None or (b[0] <= r[8][0] <= b[1] and r[8][1] <= b[2] and r[8][2] >= b[3])))
    return sorted([(*r[:7], r[9]) for r in out], key=str)


def test_quality_equals_the_plain_version(spark):
    rng = random.Random(6)
    base = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    junk = [(900 + k, " ".join(rng.choice(["☃☂★☆♜♞♛♚", "¤¬§¶þð", "⎋⎌⏎⏏"]) for _ in range(25)) + " aé b c d e f g h") for k in range(5)]
    rows = base + junk + [(1000, None), (1000, ""), (None, base[0][1]), (1001, "漢字仮名交じり文の試験です。" * 3 + " " + " ".join("一二三四五六七八九十百千")), (1002, base[1][1]), (1002, base[1][1]), (1003, "x y\n" * 200_000), (1004, "Ж" * 12)]
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = quality.quality(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).select(*names).collect()
    want = plain_quality(rows[:-2] + rows[-1:], quality.FENCE)  # its lines are compared pair by pair
    assert sorted((tuple(r) for r in got if r.doc_id != 1003), key=str) == want
    assert next(r for r in got if r.doc_id == 1003).base_failed
    verdict = {r[0]: (r[6], r[7]) for r in want}
    assert all(verdict[d] == (False, False) for d, _ in junk)
    assert sum(r[7] for r in want) > 0.8 * sum(not r[6] for r in want)


def test_quartiles_are_exact_whatever_the_partitions(spark):
    import math

    rng = random.Random(8)
    rows = [("LATIN", False, rng.gauss(3, 1), rng.choice([0.0, 0.0, rng.random()]), float(k % 7)) for k in range(50_000)] + [("GREEK", False, 1.0, 2.0, 3.0), ("GREEK", False, 2.0, 2.0, 4.0), ("THAI", True, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "script string, base_failed boolean, chars_per_token double, byte_share double, token_entropy double")
    found = []
    for parts in (1, 13):
        got = {r.script: tuple(tuple(r[c]) for c in quality._MEASURES) for r in quality._quartiles(df.where("not base_failed").repartition(parts, "chars_per_token")).collect()}
        found.append(got)
    assert found[0] == found[1] and set(found[0]) == {"LATIN", "GREEK"}
    for script, measures in found[0].items():
        for k, quartiles in enumerate(measures):
            v = sorted(r[2 + k] for r in rows if r[0] == script)
            assert quartiles == tuple(v[max(1, math.ceil(len(v) * q)) - 1] for q in (0.25, 0.5, 0.75))


def test_main_script_counts_every_letter():
    table = list("١٢٣٤ " * 12_000)
    table[12_345] = table[45_678] = "a"
    assert quality.main_script("".join(table)) == "LATIN"
    assert quality.main_script(("a" + "漢" * 96 + " é ") * 400) == "CJK"
    assert quality.main_script("١٢ ☃") == "OTHER" and quality.main_script("ab漢字文") == "CJK"


def test_per_row_operators_keep_rows(spark):
    rows = [(1, None, "n"), (1, "", "n"), (None, "token = abcdef123", "x"), (7, "é" * 100_000, "y"), (7, "é" * 100_000, "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, TEXT string")  # a name that differs in case only
    for f in (token_counts.count_tokens, secret_scan.digests, quality.quality, piece_bpe.digests, piece_bpe.encode_decode, secret_scan.scan):
        assert f(df).count() == 5 and f(df.limit(0)).count() == 0, f
