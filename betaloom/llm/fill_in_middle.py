"""Fill-in-the-middle transformation by relational units (operator 11), in DataFrame functions only.

A text is cut into units by a pattern.  The lengths of the units become rows, a running sum
per document turns them into the offset at which each unit ends, and cut requests (document,
ordinal of a unit) are joined to them; the two offsets of a document then cut its text by
``substring``.  Only lengths are exploded and sorted, texts are not; rows that repeat share
their units.  Cuts and forms come from a digest of the seed and the id, so they are the same
in every run and on any number of partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, row_key, written

#: Parameters: the pattern of a unit, the seed, percent of texts that are transformed and of
#: those in the form suffix-prefix-middle, the marks of prefix, suffix and middle.
LINES, SEED, PERCENT, SPM_PERCENT, MARKS = "[^\\n]*\\n|[^\\n]+", "7", 100, 50, ("<P>", "<S>", "<M>")


def draws(id_column: Column, seed: str = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers per id, from SHA-256; a null id counts as an empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)]


def _checked(marks: tuple[str, str, str]) -> None:
    """Marks can be found again in any text without them only if none begins inside another or where one ends."""
    for a in marks:
        for b in marks:
            if not a or a != b and a in b or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"the marks {a!r} and {b!r} overlap")


def offsets(keyed: DataFrame, requests: DataFrame) -> DataFrame:
    """``_id, _key, ordinal, offset``: where units end.

    ``keyed`` holds ``_id, _key, lengths`` once per document, ``requests`` the ordinals asked
    for (from 1).  One shuffle of unit lengths, by document.
    """
    units = keyed.select("_id", "_key", F.posexplode("lengths").alias("_at", "_length"))
    running = Window.partitionBy("_id", "_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = units.select(F.col("_id").alias("_i"), F.col("_key").alias("_k"), (F.col("_at") + 1).alias("_n"), F.sum("_length").over(running).alias("offset"))
    meet = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_k")) & (F.col("ordinal") == F.col("_n"))
    return requests.join(ends, meet).select("_id", "_key", "ordinal", "offset")


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = LINES, seed: str = SEED, percent: int = PERCENT, spm_percent: int = SPM_PERCENT, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """``id, n, form, prefix_chars, middle_chars, output`` per row.

    The prefix ends after the smaller of two drawn numbers of units, the middle after the
    larger, the suffix is the rest.  ``form`` is plain (the text as it is, no lengths) for empty
    texts, those that hold a mark and those not drawn, else psm or spm.  A null text counts as
    empty.  Rows stay as they are: repeated rows have equal results, rows of one id and
    different texts are cut each by its own units, null ids draw like an empty id.  Other
    columns are dropped; an empty table gives an empty table.  ``unit`` must cover any text
    without gaps; one that leaves a gap ends the job.
    """
    _checked(marks)
    text = F.coalesce("_text", F.lit(""))
    rows = pick(docs, (id_col, "_id"), (text_col, "_text")).select("_id", text.alias("_text")).withColumn("_key", row_key(F.col("_id"), F.col("_text")))
    h1, h2, h3, h4 = draws(F.col("_id"), seed)
    lengths = F.transform(F.regexp_extract_all("_text", F.lit(unit), F.lit(0)), F.length)
    whole = F.aggregate("lengths", F.lit(0), lambda a, b: a + b) == F.length("_text")
    plain = (F.col("_text") == "") | (h3 % 100 >= percent)
    for m in marks:
        plain |= F.contains("_text", F.lit(m))
    form = F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    counted = rows.select("_id", "_key", "_text", lengths.alias("lengths"), form.alias("form")).select(
        "_id", "_key", "form", F.when(whole, F.col("lengths")).otherwise(F.raise_error(F.lit("the unit pattern leaves a gap"))).alias("lengths")
    )
    keyed = written(counted.groupBy("_id", "_key").agg(F.first("form").alias("form"), F.first("lengths").alias("lengths")), "units")
    n = F.size("lengths").cast("bigint")
    cuts = keyed.select("_id", "_key", "form", n.alias("n"), *(F.when(F.col("form") != "plain", h % (n + 1)).alias(c) for c, h in (("a", h1), ("b", h2))))
    asked = cuts.where("form <> 'plain'").select("_id", "_key", F.explode(F.array_distinct(F.array("a", "b"))).alias("ordinal")).where("ordinal > 0")
    found = offsets(keyed.where("form <> 'plain'"), asked).groupBy("_id", "_key").agg(F.min("offset").alias("low"), F.max("offset").alias("high"))
    cut = cuts.join(found.select(F.col("_id").alias("_i"), F.col("_key").alias("_k"), "low", "high"), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_k")), "left")
    # a cut after 0 units asked for no unit; where both cuts do, nothing was found
    high = F.when(F.col("form") != "plain", F.coalesce("high", F.lit(0)))
    low = F.when(F.col("form") != "plain", F.when(F.least("a", "b") == 0, F.lit(0)).otherwise(F.col("low")))
    cut = cut.select(F.col("_id").alias("_i"), F.col("_key").alias("_k"), "n", "form", low.cast("bigint").alias("prefix_chars"), (high - low).cast("bigint").alias("middle_chars"))
    joined = rows.join(cut, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_k")), "left")
    p, m = F.col("prefix_chars").cast("int"), F.col("middle_chars").cast("int")
    t = F.col("_text")
    prefix, middle, suffix = F.substring(t, F.lit(1), p), F.substring(t, p + 1, m), F.substring(t, p + m + 1, F.length(t))
    first, second, third = map(F.lit, marks)
    output = F.when(F.col("form") == "psm", F.concat(first, prefix, second, suffix, third, middle)).when(F.col("form") == "spm", F.concat(second, suffix, first, prefix, third, middle)).otherwise(t)
    return joined.select(F.col("_id").alias(id_col), "n", "form", "prefix_chars", "middle_chars", output.alias("output"))


def restore(form: Column, output: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that :func:`transform` made ``output`` of, from the output and its form alone."""
    _checked(marks)
    p, s, m = marks

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        b, c = F.locate(second, output), F.locate(m, output)
        return F.substring(output, F.lit(len(first) + 1), b - len(first) - 1), F.substring(output, b + len(second), c - b - len(second)), F.substring(output, c + len(m), F.length(output))

    psm, spm = parts(p, s), parts(s, p)
    return F.when(form == "psm", F.concat(psm[0], psm[2], psm[1])).when(form == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(output)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`transform` with its output, and the text restored from it, as digests; rows and nulls as there."""
    sha = [F.sha2(c.cast("binary"), 256) for c in (F.col("output"), restore(F.col("form"), F.col("output")))]
    return transform(docs, id_col, text_col).select(id_col, "n", "form", "prefix_chars", "middle_chars", sha[0].alias("output_sha256"), sha[1].alias("restored_sha256"))


def oracle() -> str:
    """DuckDB SQL for :func:`digests` over ``documents``."""
    h = [f"('0x' || substr(d, {1 + 8 * k}, 8))::UBIGINT::BIGINT" for k in range(4)]
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
u AS (SELECT doc_id, x, {h[0]} AS h1, {h[1]} AS h2, {h[2]} AS h3, {h[3]} AS h4,
        list_transform(regexp_extract_all(x, '[^\\n]*\\n|[^\\n]+'), lambda c: length(c)) AS l FROM t),
k AS (SELECT *, len(l)::BIGINT AS n, CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 100 THEN 'plain'
        WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
c AS (SELECT *, CASE WHEN form <> 'plain' THEN coalesce(list_sum(l[1:least(h1 % (n + 1), h2 % (n + 1))]), 0)::BIGINT END AS p,
        CASE WHEN form <> 'plain' THEN coalesce(list_sum(l[1:greatest(h1 % (n + 1), h2 % (n + 1))]), 0)::BIGINT END AS e FROM k),
o AS (SELECT *, CASE form WHEN 'psm' THEN '<P>' || substring(x, 1, p) || '<S>' || substring(x, e + 1) || '<M>' || substring(x, p + 1, e - p)
        WHEN 'spm' THEN '<S>' || substring(x, e + 1) || '<P>' || substring(x, 1, p) || '<M>' || substring(x, p + 1, e - p) ELSE x END AS out FROM c)
SELECT doc_id, n, form, p AS prefix_chars, e - p AS middle_chars, sha256(out) AS output_sha256, sha256(x) AS restored_sha256 FROM o"""
