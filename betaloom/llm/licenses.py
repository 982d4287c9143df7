"""License scans by diagonal voting (operator 2).

Every rolling two-word gram of every text is hashed and joined to the positions of the
license templates.  A hit votes for its diagonal (place in the text minus place in the
template); a template that stands in a text gathers votes on one diagonal, or, with words
put in or left out, on neighbouring ones, which are merged.  A hit counts only if its
words equal the template's.  In each merged run every span of bounded length that begins
at a hit is verified by the number of different template grams in it.

Phrases are templates that must be complete on one diagonal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pick, row_key, written

# The base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Parameter: further phrases, complete on one diagonal.
PHRASES = (
    ("lesser general public license", "lgpl"), ("affero general public license", "agpl"), ("mozilla public license", "mpl"),
    ("bsd license", "bsd"), ("isc license", "isc"), ("eclipse public license", "epl"), ("cc by nc", "cc-by-nc"), ("cc by sa", "cc-by-sa"),
    ("cc by nd", "cc-by-nd"), ("creative commons attribution", "cc-by"), ("creative commons zero", "cc0"),
)

#: Parameter: notices, found with gaps and changes.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mpl"),
    ("this work is licensed under the creative commons attribution 4 0 international license to view a copy of this license visit", "cc-by"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)

#: Parameters: diagonals this near are merged; least share of a notice's grams in a span;
#: most length of a span, in lengths of its notice.
NEAR, COVERED, STRETCH = 3, 0.6, 1.5

_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text):
    """Words of the text with A-Z lowered: runs of letters, digits and all beyond ASCII.

    ``lower`` also turns the Kelvin sign into an ASCII letter; it is set aside before.
    """
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\ue000"))
    return F.array_remove(F.split(F.lower(plain), _BETWEEN), "")


def templates(spark: SparkSession) -> DataFrame:
    """A row per template gram: ``t, kind, label, grams, t_at, g1, g2, h``; its size is fixed by the lists above."""
    rows, t = [], 0
    for kind, texts in (("base", BASE), ("phrase", PHRASES), ("notice", NOTICES)):
        for text, label in texts:
            w = text.split()
            rows += [(t, kind, label, len(w) - 1, k, w[k], w[k + 1]) for k in range(len(w) - 1)]
            t += 1
    return spark.createDataFrame(rows, "t int, kind string, label string, grams int, t_at int, g1 string, g2 string").withColumn("h", F.xxhash64("g1", "g2"))


def matches(rows: DataFrame) -> DataFrame:
    """From ``doc_id, row_key, words``: accepted spans ``doc_id, row_key, kind, label, start, end, share``."""
    known = templates(rows.sparkSession).drop("h")
    hashes = [r["h"] for r in templates(rows.sparkSession).select("h").distinct().collect()]  # of the fixed lists
    # hits are found inside the text's array, so that no row of a gram carries the words
    gram = lambda i: F.xxhash64(F.element_at("words", i), F.element_at("words", i + 1))
    at = F.filter(F.when(F.size("words") > 1, F.sequence(F.lit(1), F.size("words") - 1)), lambda i: gram(i).isin(hashes))
    hit = F.transform(at, lambda i: F.struct((i - 1).alias("at"), F.element_at("words", i).alias("g1"), F.element_at("words", i + 1).alias("g2")))
    hits = rows.select("doc_id", "row_key", F.inline(hit)).join(F.broadcast(known), ["g1", "g2"])  # the words themselves are compared
    votes = hits.groupBy("doc_id", "row_key", "t", "kind", "label", "grams", (F.col("at") - F.col("t_at")).alias("diagonal")).agg(F.collect_set("at").alias("places")).withColumn("votes", F.size("places"))
    votes = written(votes.where("kind = 'notice' or votes = grams"), "votes")  # read for phrases and for notices
    whole = votes.where("kind <> 'notice' and votes = grams").select("doc_id", "row_key", "kind", "label", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("grams") + 1).alias("end"), F.lit(1.0).alias("share"))
    # a text's diagonals of one template are at most as many as its words
    order = Window.partitionBy("doc_id", "row_key", "t").orderBy("diagonal")
    notices = votes.where("kind = 'notice'").withColumn("new", (F.col("diagonal") - F.coalesce(F.lag("diagonal").over(order), F.lit(-(1 << 30))) > NEAR).cast("int"))
    run = ["doc_id", "row_key", "t", "label", "grams", "run"]
    # the votes of a run are at least its different grams, so nothing is lost here
    enough = notices.withColumn("run", F.sum("new").over(order)).withColumn("most", F.sum("votes").over(Window.partitionBy(*run))).where(F.col("most") >= COVERED * F.col("grams"))
    # places scaled, so that one frame fits all notices: a span's hits are under ``reach`` words apart
    reach = F.floor(STRETCH * (F.col("grams") + 1)) - 1
    placed_hits = enough.select(*run, "diagonal", F.explode("places").alias("at")).withColumn("scaled", (F.col("at") * 1_000_000 / reach).cast("bigint"))
    frame = Window.partitionBy(*run).orderBy("scaled").rangeBetween(0, 999_999)
    tried = placed_hits.select(*run, (-F.col("at")).alias("before"), F.size(F.collect_set(F.col("at") - F.col("diagonal")).over(frame)).alias("covered"), (F.max("at").over(frame) + 2).alias("end"))
    best = tried.groupBy(*run).agg(F.max(F.struct("covered", "before", "end")).alias("b")).withColumn("share", F.col("b.covered") / F.col("grams"))
    spans = best.where(F.col("share") >= COVERED).select("doc_id", "row_key", F.lit("notice").alias("kind"), "label", (-F.col("b.before")).alias("start"), F.col("b.end").alias("end"), "share")
    return whole.unionByName(spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_words, n_base, first_word, last_word, base_labels, labels, score`` per row.

    ``n_base`` counts the places of base phrases, between ``first_word`` and ``last_word``
    (null without any); ``score`` is the largest share of a template found, 0 for none.
    A null text has no words.  Rows that repeat get equal results; null ids are kept;
    other columns are dropped; an empty table gives an empty table.
    """
    keyed = pick(docs, (id_col, "doc_id"), (text_col, "text")).select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row_key"), words(F.col("text")).alias("words"))
    found = matches(keyed)
    base = F.col("kind") == "base"
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    # one span a place: repeated rows vote together and count once
    by_row = written(found.groupBy("doc_id", "row_key").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"), joined(F.col("label")).alias("labels"), F.max("share").alias("score"),
    ), "license-spans")
    by_row = by_row.withColumnsRenamed({"doc_id": "d", "row_key": "k"})
    rows = keyed.select("doc_id", "row_key", F.size("words").cast("bigint").alias("n_words"))
    out = rows.join(by_row, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_key") == F.col("k")), "left")
    return out.select(
        F.col("doc_id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"), F.col("first_word").cast("bigint").alias("first_word"), F.col("last_word").cast("bigint").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"),
    )


def oracle() -> str:
    """The whole method in DuckDB's SQL: the same grams, votes and spans by joins on the words themselves."""
    rows, t = [], 0
    for kind, texts in (("base", BASE), ("phrase", PHRASES), ("notice", NOTICES)):
        for text, label in texts:
            w = text.split()
            rows += [f"({t},'{kind}','{label}',{len(w) - 1},{k},'{w[k]}','{w[k + 1]}')" for k in range(len(w) - 1)]
            t += 1
    az = "".join(map(chr, range(65, 91)))
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{az}', '{az.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
tpl(t, kind, label, grams, t_at, g1, g2) AS (VALUES {", ".join(rows)}),
g AS (SELECT doc_id, unnest(range(len(words) - 1)) AS pos, words FROM w WHERE len(words) > 1),
gg AS (SELECT doc_id, pos, words[pos + 1] AS g1, words[pos + 2] AS g2 FROM g),
hits AS (SELECT DISTINCT doc_id, t, kind, label, grams, pos, t_at, pos - t_at AS diagonal FROM gg JOIN tpl USING (g1, g2)),
votes AS (SELECT doc_id, t, kind, label, grams, diagonal, count(*) AS votes FROM hits GROUP BY ALL),
whole AS (SELECT doc_id, kind, label, diagonal AS start, 1.0::DOUBLE AS share FROM votes WHERE kind <> 'notice' AND votes = grams),
steps AS (SELECT *, (diagonal - coalesce(lag(diagonal) OVER (PARTITION BY doc_id, t ORDER BY diagonal), -{1 << 30}) > {NEAR})::INT AS new FROM votes WHERE kind = 'notice'),
runs AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, t ORDER BY diagonal) AS run FROM steps),
heavy AS (SELECT *, sum(votes) OVER (PARTITION BY doc_id, t, run) AS most FROM runs),
placed AS (SELECT h.doc_id, h.t, h.label, h.grams, r.run, h.pos, h.t_at FROM hits h JOIN heavy r USING (doc_id, t, diagonal) WHERE r.most >= {COVERED} * h.grams),
tried AS (SELECT a.doc_id, a.t, a.label, a.grams, a.run, a.pos AS start, count(DISTINCT b.t_at) AS covered
  FROM (SELECT DISTINCT doc_id, t, label, grams, run, pos FROM placed) a JOIN placed b ON a.doc_id = b.doc_id AND a.t = b.t AND a.run = b.run AND b.pos >= a.pos AND b.pos - a.pos < floor({STRETCH} * (a.grams + 1)) - 1 GROUP BY ALL),
best AS (SELECT doc_id, t, run, label, grams, max(covered) AS covered, arg_max(start, (covered, -start)) AS start FROM tried GROUP BY ALL),
found AS (SELECT * FROM whole UNION ALL SELECT doc_id, 'notice', label, start, covered / grams::DOUBLE FROM best WHERE covered >= {COVERED} * grams),
r AS (SELECT doc_id, count(*) FILTER (kind = 'base') AS n_base, min(start) FILTER (kind = 'base') AS first_word, max(start) FILTER (kind = 'base') AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (kind = 'base'), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM found GROUP BY doc_id)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0.0), 6)::DOUBLE AS score
FROM w LEFT JOIN r USING (doc_id)"""
