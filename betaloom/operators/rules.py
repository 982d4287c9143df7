"""Metadata extraction by declared rules."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import key_values, named, value_of_key

CONCEPTS = ("subject_id", "age", "tissue", "cell_type", "condition", "sex", "disease_status", "platform")


@dataclass(frozen=True)
class Rule:
    """How one concept is read: a pattern over a field (or over one key of it), or a constant."""

    concept: str
    status: str = "resolved"
    field: str | None = None
    key: str | None = None
    pattern: str | None = None
    group: int = 1
    constant: str | None = None
    control: str | None = None
    confidence: float = 1.0

    def __post_init__(self) -> None:
        if self.status not in ("resolved", "missing", "error"):
            raise ValueError(f"unknown status {self.status!r}")
        if not 0 <= self.confidence <= 1 or self.group not in (0, 1):
            raise ValueError("confidence is from 0 to 1, group 0 or 1")


def whole_value(rule: Rule) -> Rule:
    """Disease status takes the whole value, whatever pattern was proposed."""
    return Rule(**{**rule.__dict__, "pattern": r"([\s\S]*)", "group": 1})


def _read(values: Column, rule: Rule) -> Column:
    """``struct<got, raw>`` of :func:`apply`; each part is computed once."""
    pattern = "(?i)" + (rule.pattern or "")
    take = lambda v: F.when(v.rlike(pattern), F.regexp_extract(v, pattern, rule.group))
    if rule.key is not None:
        return named(value_of_key(values, rule.key), lambda v: F.struct(take(v).alias("got"), v.alias("raw")))
    last = lambda v: F.get(v, F.size(v) - 1)
    return named(values, lambda x: F.struct(take(last(F.filter(x, lambda v: v.rlike(pattern)))).alias("got"), last(x).alias("raw")))


def apply(values: Column, rule: Rule) -> tuple[Column, Column]:
    """(extracted, raw) from an array of strings.

    With a key: the value of the first ``key: value`` whose key equals it but for case.
    Without: the last value that matches, and the last value as raw.  Null, not empty,
    where nothing matches.
    """
    read = _read(values, rule)
    return read["got"], read["raw"]


def value(fields: Column, rule: Rule) -> Column:
    """``struct<got, raw>``: nulls for missing or failed rules, the constant of a constant rule."""
    none = F.lit(None).cast("string")
    if rule.status != "resolved":
        return F.struct(none.alias("got"), none.alias("raw"))
    if rule.constant is not None:
        return F.struct(F.lit(rule.constant).alias("got"), none.alias("raw"))
    return _read(F.element_at(fields, rule.field), rule)


def extract(samples: DataFrame, rules: Mapping[str, Rule], fields: str = "fields", sample: str = "gsm") -> DataFrame:
    """One column per concept, age as a number, and ``failures array<struct<concept, raw>>``; one pass over the samples.

    Age fails only where the raw value has a digit.
    """
    read = samples.select(F.col(sample), *[value(F.col(fields), rule).alias(f"_{k}") for k, rule in enumerate(rules.values())])
    columns, failures = [F.col(sample)], []
    for k, concept in enumerate(rules):
        got, raw = F.col(f"_{k}.got"), F.col(f"_{k}.raw")
        failed = raw.isNotNull() & got.isNull()
        if concept == "age":
            number = got.try_cast("double")
            got = F.when(~F.isnan(number), number)
            failed = raw.isNotNull() & got.isNull() & raw.rlike("[0-9]")
        columns.append(got.alias(concept))
        failures.append(F.when(failed, F.struct(F.lit(concept).alias("concept"), raw.alias("raw"))))
    return read.select(*columns, F.array_compact(F.array(*failures)).alias("failures"))


def failures(extracted: DataFrame) -> DataFrame:
    """Distinct raw values that no rule could read, sorted, per concept."""
    return extracted.select(F.explode("failures").alias("f")).groupBy("f.concept").agg(F.sort_array(F.collect_set("f.raw")).alias("examples"))


def keys(samples: DataFrame, values: str) -> DataFrame:
    """Distinct keys of ``key: value`` strings."""
    return samples.select(F.explode(F.map_keys(key_values(F.col(values)))).alias("key")).distinct()


def overfitted(rules: DataFrame) -> DataFrame:
    """Resolved rules whose pattern holds their own key's name."""
    return rules.where((F.col("status") == "resolved") & F.lower("pattern").contains(F.lower("key_name")))


def poorly_parsed(rules: DataFrame, coverage: DataFrame) -> DataFrame:
    """Resolved rules that parse some values but not all, with failures to show."""
    return rules.join(coverage, "concept").where((F.col("status") == "resolved") & (F.col("parse_rate") > 0) & (F.col("parse_rate") < 1) & (F.size("failures") > 0))


def accepted(rules: DataFrame, least: float = 0.6) -> DataFrame:
    """Per accession whether all rules are settled with enough confidence."""
    ok = F.col("status").isin("resolved", "missing") & (F.col("confidence") > least)
    return rules.groupBy("accession").agg(F.bool_and(ok).alias("accepted"))


def has_alternation(pattern: str) -> bool:
    """Whether a regular expression holds an alternation at any depth."""
    import re._parser as parser

    def walk(node: object) -> bool:
        if isinstance(node, parser.SubPattern):
            return any(walk(x) for x in node.data)
        if isinstance(node, (list, tuple)):
            return any(getattr(x, "name", "") == "BRANCH" or walk(x) for x in node)
        return False

    # a common prefix is factored out and single characters become a class: keep alternatives apart first
    return walk(parser.parse(pattern)) or "|" in re_outside_classes(pattern)


def re_outside_classes(pattern: str) -> str:
    """The pattern without escaped characters and character classes."""
    import re

    return re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", "", pattern)
