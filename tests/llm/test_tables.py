"""Operators over whole tables, against brute force on small ones."""

from __future__ import annotations

import base64
import hashlib
import os
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from betaloom.llm import components, decontamination, langid, licenses, simhash, substring_dedup, warc
from betaloom.llm.common import new_folder, pick

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string"
TEN = "one two three four five six seven eight nine ten"


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]


def mutated(rng: random.Random, text: str, edits: int) -> str:
    w = text.split(" ")
    for _ in range(edits):
        w[rng.randrange(len(w))] = "zz"
    return " ".join(w)


# ---- SimHash


def brute_components(rows: list, fps: list[int], radius: int) -> list:
    least = list(range(len(rows)))

    def find(k: int) -> int:
        while least[k] != k:
            k = least[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                least[find(i)] = find(j)
    ids: dict[int, list] = {}
    for k, (d, _) in enumerate(rows):
        ids.setdefault(find(k), []).append(d)
    return [min((x for x in ids[find(k)] if x is not None), default=None) for k in range(len(rows))]


def plain_fingerprint(text: str | None) -> int:
    import xxhash

    w = re.findall("[^\\x20\\x09-\\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(spark, documents):
    rng = random.Random(1)
    rows = list(documents[:120]) + [(1000 + k, mutated(rng, documents[k % 40][1], k % 5)) for k in range(80)]
    rows += [(2000, None), (2001, ""), (2002, " \n"), (None, "lonely text of its own"), (2003, "É ab"), (2003, "É ab"), (None, documents[0][1])]
    fps = [plain_fingerprint(t) for _, t in rows]
    want = sorted(zip((d for d, _ in rows), (format(f, "016x") for f in fps), brute_components(rows, fps, 4)), key=str)
    got = sorted((tuple(r) for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(3)).collect()), key=str)
    assert got == want


def test_ball_links_connect_all_within_the_radius(spark):
    rng = random.Random(2)
    centres = [rng.getrandbits(64) for _ in range(5)]
    fps = {c ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 6))) for c in centres for _ in range(30)}
    rows = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    roots = {r.node: r.root for r in components.components(simhash.ball_links(spark.createDataFrame(rows, "fp bigint"))).collect()}
    want = brute_components([(f, None) for (f,) in rows], [f & (1 << 64) - 1 for (f,) in rows], 4)
    assert [roots.get(f, f) for (f,) in rows] == want


def test_variants_travel_packed():
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute

    every = np.array(simhash.ball(2), np.int64)
    fps = np.array([5, 6, -9], np.int64)
    links = set()
    for k in range(8):
        rows = list(simhash._emit(iter([pa.record_batch({"fp": fps})]), every, k, 3, 4))
        assert sum(r.num_rows for r in rows) <= 4  # a row per bucket, not per variant
        assert sum(len(x.as_buffer()) for r in rows for x in r.column(1)) % 8 == 0
        table = pa.Table.from_batches(rows)
        for bucket in set(table["bucket"].to_pylist()):
            got = simhash._meet(table.filter(pa.compute.equal(table["bucket"], bucket)), every)
            links |= set(zip(got["a"].to_pylist(), got["b"].to_pylist()))
    assert links == {(5, 6)}  # -9 is far from both


def test_components_of_chains_and_hubs(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(200, 200), (None, 1), (3, 2), (2, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(61)} | {k: 100 for k in range(100, 160)}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# ---- substring dedup


def brute_removed(rows: list, window: int) -> list:
    first: dict[tuple, int] = {}
    for d, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if d is not None:
                first[key] = min(first.get(key, d), d)
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - window + 1):
            if d is not None and first[tuple(w[k : k + window])] < d:
                gone.update(range(k, k + window))
        left = [x for k, x in enumerate(w) if k not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(left)).hexdigest()))
    return out


def test_substring_dedup_equals_brute_force(spark, documents):
    rng = random.Random(3)
    base = [" ".join(rng.choice("a b c dd eé f".split()) for _ in range(200)) for _ in range(3)]
    rows = list(documents)
    for k in range(60):
        w, at = rng.choice(base).split(), rng.randint(0, 150)
        rows.append((rng.choice([None, 5000 + k, 5000 + k // 2]), " ".join(w[at : at + rng.randint(20, 90)] + ["x"] + rng.choice(base).split()[: rng.randint(0, 80)])))
    rows += [(9000, None), (9001, ""), (9002, base[0]), (9002, base[0]), (9003, " \n" + base[0].replace(" ", "\t ")), (9004, "same " * 500), (9005, "same " * 500 + "end")]
    want = sorted(brute_removed(rows, 50), key=str)
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    for group_words in (substring_dedup.GROUP_WORDS, 3000, 0):  # subtrees alone, both, long prefixes alone
        got = sorted((tuple(r) for r in substring_dedup.dedup(df, group_words=group_words).collect()), key=str)
        assert got == want, group_words


def test_substring_dedup_of_string_ids_and_repeated_rows(spark):
    rng = random.Random(9)
    text = " ".join(str(rng.randrange(50)) for _ in range(120))
    rows = [("b", text)] * 30 + [("a", "x " + text), (None, text), ("c", text + " y"), ("c", None)]
    got = substring_dedup.dedup(spark.createDataFrame(rows, "key string, text string"), id_col="key").collect()
    n = Counter((r.key, r.n_words, r.n_removed) for r in got)
    assert n == {("b", 120, 120): 30, ("a", 121, 0): 1, (None, 120, 0): 1, ("c", 121, 120): 1, ("c", 0, 0): 1}


def test_deep_ranks_are_equal_for_equal_words():
    import numpy as np

    rng = random.Random(10)
    for window in (3, 4, 5, 9, 10, 27, 50, 54):
        names = np.array([rng.randrange(2) for _ in range(300)] + [1] * 60 + [0] * 60, np.int64)
        starts = np.arange(len(names) - window + 1)
        ranks = substring_dedup.deep_ranks(names, starts, window)
        keys = [tuple(names[k : k + window]) for k in starts]
        assert [sorted(set(keys)).index(k) for k in keys] == ranks.tolist()


def test_substring_sql_equals_brute_force(documents):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    assert sorted(con.execute(substring_dedup.oracle()).fetchall()) == sorted(brute_removed(documents, 50))


def test_equal_windows_choose_equal_prefixes():
    rng = random.Random(4)
    words = [rng.choice("abcdefgh").encode() for _ in range(400)]
    a, b = substring_dedup.representatives(words, 50, 16), substring_dedup.representatives(words[37:] + [b"x"] * 9, 50, 16)
    assert (a[37:] == b[: len(a) - 37]).all()


# ---- licenses


def test_licenses_equal_sql(spark, tmp_path):
    notice = licenses.NOTICES[0][0]
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(9001, notice + " the software is the software and" * 20), (9002, "run the software now " * 15), (9003, "the software is the software and " * 20 + notice.replace("free of charge", "free")), (9004, "the software " * 400)]
    rows += [(9010 + k, " x ".join(" ".join(n.split()[k % 3 : -1 - k]) for n, _ in licenses.NOTICES)) for k in range(6)] + [(9100, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    got = licenses.scan(spark.read.parquet(str(tmp_path / "d")))
    assert sorted(tuple(r) for r in got.collect()) == sorted(con.execute(licenses.oracle()).fetchall())


def test_licenses_of_long_texts_take_linear_time(spark):
    import time

    took = []
    for n in (20_000, 20_000, 160_000):  # the first run compiles
        start = time.time()
        assert licenses.scan(spark.createDataFrame([(1, "lorem ipsum dolor " * (n // 3))], DOCS)).first().n_words == n // 3 * 3
        took.append(time.time() - start)
    assert took[2] < 8 * took[1] + 5


def test_license_cases(spark):
    notice = licenses.NOTICES[0][0]
    rows = [(1, "The MIT License, x mit license; GNU general\npublic license"), (2, None), (None, "cc-by"), (3, "apache license"), (3, "apache license"), (4, "per " + notice.replace("free of charge", "free") + " end"), (5, "mİt license K MIT"), (6, "cc by nc"), (7, "apache"), (8, notice[:60])]
    got = {(r.doc_id, r.n_words): r for r in licenses.scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert (got[1, 10].n_base, got[1, 10].first_word, got[1, 10].last_word, got[1, 10].base_labels) == (3, 1, 6, "gpl,mit")
    assert (got[2, 0].n_base, got[2, 0].first_word, got[2, 0].labels, got[2, 0].score) == (0, None, "", 0.0)
    assert got[None, 2].base_labels == "cc-by" and got[3, 2].n_base == 1 and got[6, 3].labels == "cc-by,cc-by-nc"
    assert got[4, 49].labels == "mit" and got[4, 49].base_labels == "" and 0.9 < got[4, 49].score < 1
    assert not any(r.labels for k, r in got.items() if k[0] in (5, 7, 8))


def test_notices_among_frequent_words(spark):
    notice = licenses.NOTICES[0][0]
    rows = [(1, notice + " the software is the software and" * 20), (2, "run the software now " * 15), (3, "the software is the software and " * 20 + notice.replace("free of charge", "free")), (4, "the software " * 400)]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1] == ("mit", 1.0) and got[2] == got[4] == ("", 0.0) and got[3][0] == "mit" and 0.9 < got[3][1] < 1


# ---- decontamination


def brute_leaks(docs: list, items: list) -> dict:
    words = lambda t: [x for x in re.split(r"[^\w]|_", (t or "").lower()) if x]
    want: dict = {}
    for i, t in items:
        m = len(words(t))
        size = min(5, m)
        shingles = lambda w: [tuple(w[k : k + size]) for k in range(len(w) - size + 1)]  # noqa: B023, E731
        c = Counter(shingles(words(t))) if m else Counter()
        for d, x in docs:
            s = shingles(words(x))
            if not c or not set(s) & set(c):
                continue
            for k in range(max(1, len(s) + size - m)):
                a = Counter(s[k : k + m - size + 1])
                low = sum((a & c).values())
                v = low / (sum(a.values()) + sum(c.values()) - low)
                if v >= 0.8 and v > want.get((d, i), (0, 0))[0]:
                    want[d, i] = (v, k)
    return want


def test_decontamination_finds_moved_padded_and_repeated_items(spark):
    rng = random.Random(12)
    item = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    items = [(k, " ".join(item(rng.choice((5, 8, 12, 40, 100, 300))))) for k in range(40)]
    docs = []
    for k, t in items:
        w = t.split()
        half = len(w) // 2
        noise = [f"n{rng.randrange(5000)}" for _ in range(400)]
        docs += [(10 * k, " ".join(noise[:200] + w[half:] + w[:half] + noise[200:])), (10 * k + 1, " ".join(noise[:9] + w[:half] + noise[20:21] + w[half:] + noise[9:20]))]
        docs += [(10 * k + 2, " ".join(w[: -len(w) // 10 or None])), (10 * k + 3, " ".join((w + noise[:3]) * 30)), (10 * k + 4, " ".join(noise))]
    want = brute_leaks(docs, items)
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in decontamination.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == {k: (round(v, 6), s) for k, (v, s) in want.items()} and len(want) > 60


def test_decontamination_equals_brute_force(spark, documents):
    rng = random.Random(5)
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()] + [(900, None), (901, "too short"), (902, TEN), (903, "nine"), (904, " ,"), (905, "not anywhere here")]
    docs = list(documents[:100])
    for k in range(40):
        w = rng.choice(items[:40])[1].split()
        for _ in range(rng.randint(0, 3)):
            j, what = rng.randrange(len(w)), rng.random()
            w[j : j + 1] = ["zz"] if what < 0.4 else [w[j], "yy"] if what < 0.7 else []
        docs.append((1000 + k, " ".join(["alpha beta gamma"] * rng.randint(0, 4) + w + ["the tail"] * rng.randint(0, 4)).upper()))
    docs += [(None, items[0][1]), (1700, None), (1700, ""), (1800, items[1][1]), (1800, items[1][1]), (1900, TEN.replace(" ", ", ")), (1950, "it is Too, short and too short")]
    want = brute_leaks(docs, items)
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in decontamination.leaks(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == {k: (round(v, 6), s) for k, (v, s) in want.items()} and len(want) > 10 and (1950, 901) in want and (1900, 903) in want
    kept = decontamination.decontaminate(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id bigint, text string"))
    assert kept.count() == sum(1 for d, t in docs if not any(x == d for x, _ in want) or not t)


def test_decontamination_finds_the_best_of_all_windows(spark):
    item = [f"w{k}" for k in range(67)]
    edited = ["x1", "x2", *item[2:34], "y1", "y2", "y3", *item[34:66], "x3"]
    long = [f"v{k}" for k in range(150)]
    other = [*["z"] * 5, *long[5:75], *[f"y{k}" for k in range(9)], *long[75:145], *["z"] * 5]
    docs = [(k, " ".join([*["pre"] * n, *w, *["post"] * n])) for k, (w, n) in enumerate([(edited, 0), (edited, 9), (other, 7), (item[20:], 0), (item * 3, 2)])]
    want = {}
    for i, w in enumerate((item, long)):
        c = Counter(zip(*(w[k:] for k in range(5))))
        for d, t in docs:
            s = list(zip(*(t.split()[k:] for k in range(5))))
            for k in range(max(1, len(s) - len(w) + 5)):
                low = (Counter(s[k : k + len(w) - 4]) & c).total()
                v = low / (len(s[k : k + len(w) - 4]) + len(w) - 4 - low)
                if v >= 0.8 and v > want.get((d, i), (0, 0))[0]:
                    want[d, i] = (v, k)
    items = spark.createDataFrame([(0, " ".join(item)), (1, " ".join(long))], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in decontamination.leaks(spark.createDataFrame(docs, DOCS), items).collect()}
    assert got == {k: (round(v, 6), s) for k, (v, s) in want.items()} and {(0, 0), (1, 0), (2, 1)} <= set(got)


def test_decontamination_of_long_texts_that_repeat_an_item(spark, monkeypatch):
    """A text of 2 MB that holds one item of 1,000 words 300 times, in a heap of 3 GB; and small bounds of a row."""
    rng = random.Random(3)
    item = [f"word{rng.randrange(10**4)}" for _ in range(1000)]
    for times in (40, 300):
        docs = spark.createDataFrame([(1, " ".join(item * times)), (2, "nothing of it " * 50)], DOCS)
        got = [tuple(r) for r in decontamination.leaks(docs, spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")).drop("row_key").collect()]
        assert got == [(1, 7, 1.0, 0)]
    monkeypatch.setattr(decontamination, "STARTS_AT_ONCE", 7)
    monkeypatch.setattr(decontamination, "VALUES_AT_ONCE", 30)
    short = [(k, " ".join(rng.choice(["a b c d e", "f g h i j k", "x"]) for _ in range(60))) for k in range(8)] + [(3, "a b c d e f g h i j k " * 9)]
    items = [(0, "a b c d e f g h i j k a b c d e"), (1, "f g h i j k x x a b c d e"), (2, "x x x x x x x x")]
    want = brute_leaks(short, items)
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in decontamination.leaks(spark.createDataFrame(short, DOCS), spark.createDataFrame(items, "item_id bigint, text string")).groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", -F.col("start_word"))).alias("b")).select("doc_id", "item_id", "b.similarity", (-F.col("b.col2")).alias("start_word")).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: round(v[0], 6) for k, v in want.items()} and len(want) > 5


# ---- WARC


def test_warc_round_trip(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url", "html").collect()]
    rows += [(5000, "u", "x"), (5001, "u 2\r\n", "x"), (5002, None, None), (5003, "é", ""), (None, "n", "x"), (None, "n", "lonely"), (5001, "z", "x"), (6000, "u", "é\r\n\r\nWARC/1.1"), (6001, "u", "long" * 100_000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    folders = [new_folder(spark, "warc") for _ in range(2)]
    made = [warc.write(df.repartition(n), f, shard_bytes=1 << 20, file_bytes=20_000) for n, f in zip((3, 5), folders)]
    assert sorted((r.name, r.sha256) for r in made[0].collect()) == sorted((r.name, r.sha256) for r in made[1].collect()) and made[0].count() > 2
    assert not os.path.exists(folders[0].removeprefix("file://") + "/_temporary") and os.path.exists(folders[0].removeprefix("file://") + "/_COMMITTED")
    n, best = Counter(h or "" for _, _, h in rows), {}
    for p, _, h in rows:
        if p is not None:
            best[h or ""] = max(best.get(h or "", -1), p)
    want = []
    for p, _, h in rows:
        h = h or ""
        again = n[h] > 1 and h in best and (p is None or p < best[h])
        want.append((p, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "revisit" if again else "response", best[h] if again else None))
    got = warc.read(spark, folders[0]).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    empty = new_folder(spark, "warc")
    assert warc.write(df.limit(0), empty).count() == 0 and warc.read(spark, empty).count() == 0


def test_warc_shards_are_balanced_for_any_ids(spark):
    rng = random.Random(8)
    body = lambda k: f"{k} " + "".join(rng.choice("abcdef") for _ in range(1000))
    cases = {
        "outlier": [*range(600), 1 << 60], "extremes": [-(1 << 63), *range(600), (1 << 63) - 1], "one id": [7] * 600,
        "no id": [None] * 600, "two clusters": [*range(300), *range(1 << 40, (1 << 40) + 300)], "one row": [3],
    }
    for name, ids in cases.items():
        rows = [(i, f"u{k}", body(k)) for k, i in enumerate(ids)]
        folder = new_folder(spark, "warc")
        with pytest.raises(ValueError):
            warc.read(spark, folder)
        made = warc.write(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3), folder, shard_bytes=100_000, file_bytes=10_000).collect()
        by_shard = Counter()
        for r in made:
            by_shard[r.shard] += r.records
        assert sum(by_shard.values()) == len(ids) and max(by_shard.values()) <= 250 and (len(ids) == 1 or len(by_shard) >= 4), (name, by_shard)
        got = warc.read(spark, folder)
        assert sorted((r.page_id for r in got.collect()), key=str) == sorted(ids, key=str)
        assert got.rdd.getNumPartitions() == min(len(made), spark.sparkContext.defaultParallelism)


def test_warc_reader_finds_damage(spark):
    import io

    good = warc._member(warc.page_record(1, "u", "text", None, False, warc.DATE))
    assert next(warc.parse(io.BytesIO(good)))[0]["X-Page-Id"] == "1"
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(good[:-12])))
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(warc._member(warc.page_record(1, "u", "text", None, False, warc.DATE).replace(b"text\r\n", b"tixt\r\n")))))


# ---- language identification


def kneser_ney(texts: list[str]):
    """The textbook recursion over strings."""
    tops = Counter(g for t in texts for g in ("".join(map(chr, (x >> 48 & 65535, x >> 32 & 65535, x >> 16 & 65535, x & 65535))) for x in map(int, langid.grams_of(langid.letters_of(t)))))
    counts = {4: tops}
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discount = {}
    for k, c in counts.items():
        one, two = (sum(v == n for v in c.values()) for n in (1, 2))
        discount[k] = one / (one + 2 * two) if one else 0.5

    def p(g: str, size: int) -> float:
        k = len(g)
        if k == 0:
            return 1 / size
        total, kinds = (f(v for x, v in counts[k].items() if x[:-1] == g[:-1]) for f in (sum, lambda z: sum(1 for _ in z)))
        if not total:
            return p(g[1:], size)
        return max(counts[k][g] - discount[k], 0) / total + discount[k] * kinds / total * p(g[1:], size)

    return p, counts


def test_model_equals_the_textbook():
    import math

    import numpy as np

    texts = {"x": ["the cat sat on the mat", "a cat and a hat"], "y": ["le chat est sur la table", "un chat noir"]}
    counted = {k: np.unique(np.concatenate([langid.grams_of(langid.letters_of(t)) for t in v]), return_counts=True) for k, v in texts.items()}
    model = langid.build(counted)
    size = len(model.keys[1]) + 1
    for text in ("the chat", "zzz qq", "a"):
        codes = langid.letters_of(text)
        grams = ["".join(map(chr, (x >> 48 & 65535, x >> 32 & 65535, x >> 16 & 65535, x & 65535))) for x in map(int, langid.grams_of(codes))]
        for j, k in enumerate(model.languages):
            p, _ = kneser_ney(texts[k])
            assert math.isclose(-sum(math.log(p(g, size)) for g in grams) / len(grams), model.cross_entropies(codes)[j], rel_tol=1e-4)
    p, counts = kneser_ney(texts["x"])
    alphabet = {g for k in texts for g in kneser_ney(texts[k])[1][1]}
    assert math.isclose(sum(p("he" + c, size) for c in alphabet) + p("he\0", size), 1, rel_tol=1e-9)


def test_language_accuracy_and_rejection(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs)
    held = got.where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98
    assert got.where("rejected").count() <= 5
    model = langid.train(docs)
    odd = spark.createDataFrame([(1, None), (2, "123 !"), (3, "Это русский текст для проверки языка"), (4, docs.first().text), (4, docs.first().text), (None, "漢字" * 50)], DOCS)
    r = {(x.doc_id, x.lang_pred == "und", x.rejected) for x in langid.classify(odd, model).collect()}
    assert r == {(1, True, True), (2, True, True), (3, False, True), (4, False, False), (None, False, True)}
    nothing = langid.identify(spark.createDataFrame([(1, "text", None)], "doc_id bigint, text string, lang string")).first()
    assert (nothing.lang_pred, nothing.score, nothing.rejected) == ("und", 0.0, True)


# ---- common


def test_pick_survives_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", "b")], "doc_id bigint, text string, TEXT string")
    assert pick(df, "doc_id", ("TEXT", "t")).first() == (1, "b")
    with pytest.raises(ValueError):
        pick(df, "none")


def test_every_language_is_learned(spark):
    """200 languages of their own syllables, more than a table holds; all are told apart."""
    rng = random.Random(9)
    consonants, vowels = "bcdfghjklmnpqrstvwxz", "aeiouyäöüàéèñç"
    rows, asked = [], []
    for k in range(200):
        syllables = [rng.choice(consonants) + rng.choice(vowels) + rng.choice(consonants) for _ in range(12)]
        text = lambda n, syllables=syllables: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))
        rows += [(1000 * k + j, text(60), f"l{k:03d}") for j in range(3)]
        asked.append((k, text(40)))
    model = langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert len(model.languages) == 200 and len(model.tables) == 25
    got = {r.doc_id: r.lang_pred for r in langid.classify(spark.createDataFrame(asked, DOCS), model).collect()}
    assert got == {k: f"l{k:03d}" for k in range(200)}


def test_tables_of_a_few_languages_equal_one_of_all():
    rng = random.Random(2)
    counted = {}
    for k in range(19):
        letters = rng.sample("abcdefghijklmnopqrstuvwxyzäöüß", 15)
        counted[f"l{k:02d}"] = tuple(langid.np.unique(langid.grams_of(langid.letters_of("".join(rng.choice([*letters, " "]) for _ in range(400)))), return_counts=True))
    one, many = langid.build(counted), langid.build_all(counted)
    assert many.languages == one.languages and len(many.tables) == 3
    for t in ("abc def", "zz", "qwertz uiop", "é"):
        codes = langid.letters_of(t)
        assert many.cross_entropies(codes) == pytest.approx(one.cross_entropies(codes), rel=1e-6)


def test_equal_rows_of_one_id_are_spread(spark):
    rows = [(5, "u", "x" * 1000)] * 3000 + [(5, "u", "y" * 1000), (6, "v", "z"), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(6)
    folder = [new_folder(spark, "warc") for _ in range(2)]
    first = warc.write(df, folder[0], shard_bytes=100_000)
    per_shard = first.groupBy("shard").agg(F.sum("records").alias("n"))
    assert per_shard.agg(F.sum("n")).first()[0] == len(rows) and per_shard.agg(F.max("n")).first()[0] < 400
    again = warc.write(df.repartition(3), folder[1], shard_bytes=100_000)
    assert sorted(map(tuple, first.select("name", "bytes", "sha256").collect())) == sorted(map(tuple, again.select("name", "bytes", "sha256").collect()))
    assert Counter(r.page_id for r in warc.read(spark, folder[0]).collect()) == Counter(r[0] for r in rows)
