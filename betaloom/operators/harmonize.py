"""Label maps: guesses, selections, groups, and their application to metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN = "Unknown/Other"

# High-level tissue groups with the ids and labels of their ontology terms.
TISSUE_GROUPS = (
    ("Adipose", "UBERON:0001013", "adipose tissue"), ("Adrenal Gland", "UBERON:0002369", "adrenal gland"), ("Artery", "UBERON:0001637", "artery"),
    ("Brain", "UBERON:0000955", "brain"), ("Breast", "UBERON:0000310", "breast"), ("Cervix", "UBERON:0000002", "uterine cervix"),
    ("Colon", "UBERON:0001155", "colon"), ("Esophagus", "UBERON:0001043", "esophagus"), ("Fallopian Tube", "UBERON:0003889", "fallopian tube"),
    ("Heart", "UBERON:0000948", "heart"), ("Kidney", "UBERON:0002113", "kidney"), ("Liver", "UBERON:0002107", "liver"), ("Lung", "UBERON:0002048", "lung"),
    ("Oral Gland", "UBERON:0010047", "oral gland"), ("Skeletal Muscle", "UBERON:0014892", "skeletal muscle organ, vertebrate"), ("Nerve", "UBERON:0001021", "nerve"),
    ("Ovary", "UBERON:0000992", "ovary"), ("Pancreas", "UBERON:0001264", "pancreas"), ("Pituitary Gland", "UBERON:0000007", "pituitary gland"),
    ("Prostate Gland", "UBERON:0002367", "prostate gland"), ("Skin", "UBERON:0002097", "skin of body"), ("Small Intestine", "UBERON:0002108", "small intestine"),
    ("Spleen", "UBERON:0002106", "spleen"), ("Stomach", "UBERON:0000945", "stomach"), ("Testis", "UBERON:0000473", "testis"),
    ("Thyroid Gland", "UBERON:0002046", "thyroid gland"), ("Uterus", "UBERON:0006834", "uterus"), ("Vagina", "UBERON:0000996", "vagina"), ("Blood", "UBERON:0000178", "blood"),
)


def tissue_groups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TISSUE_GROUPS), "tissue_group string, term_id string, term_label string")


def first_of(df: DataFrame, key: str, order: str, descending: bool = False) -> DataFrame:
    """One row per key, the first (or last) by ``order``, aggregated before the shuffle."""
    rest = [c for c in df.columns if c != key]
    pick = (F.max_by if descending else F.min_by)(F.struct(*rest), F.col(order))
    return df.groupBy(key).agg(pick.alias("s")).select(key, *[F.col("s")[c].alias(c) for c in rest])


def apply_map(df: DataFrame, column: str, labels: DataFrame, source: str = "source_label", target: str = "target_label", order: str = "seq") -> DataFrame:
    """Labels replaced by the map's target, the last of equal sources; unmapped ones stay."""
    last = first_of(labels.select(source, target, order), source, order, descending=True).select(F.col(source).alias("_s"), F.col(target).alias("_t"))
    return df.join(last, F.col(column) == F.col("_s"), "left").withColumn(column, F.coalesce("_t", column)).drop("_s", "_t")


def final_map(guesses: DataFrame, selections: DataFrame) -> DataFrame:
    """Raw label to harmonized label: guess to ontology candidate to selection.

    guesses: ``source_label, target_label``; selections: ``source_label, target_label,
    ontology, seq``.  Where no selection fits, the label itself is the best guess.
    """
    chosen = first_of(selections.select("source_label", "target_label", "ontology", "seq"), "source_label", "seq").select(F.col("source_label").alias("_g"), F.col("target_label").alias("_t"), F.col("ontology").alias("_o"))
    out = guesses.join(chosen, F.col("target_label") == F.col("_g"), "left")
    fits = F.col("_t").isNotNull()
    return out.select("source_label", F.when(fits, F.col("_t")).otherwise(F.col("source_label")).alias("target"), F.when(fits, F.col("_o")).otherwise(F.lit("best_guess")).alias("kind"))


def with_groups(mapping: DataFrame, groups: DataFrame, missing: str = "") -> DataFrame:
    """Adds the group of the harmonized label, the first by ``seq``."""
    first = first_of(groups.select("source_label", "target_label", "seq"), "source_label", "seq").select(F.col("source_label").alias("_s"), F.col("target_label").alias("_t"))
    return mapping.join(first, F.col("target") == F.col("_s"), "left").withColumn("group_label", F.coalesce("_t", F.lit(missing))).drop("_s", "_t")


def combine(maps: dict[str, DataFrame]) -> DataFrame:
    """Maps of all concepts in one table, keyed by concept, so that equal labels of two concepts don't collide."""
    out = None
    for concept, df in maps.items():
        part = df.withColumn("concept", F.lit(concept))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no maps")
    return out


def rewrite(metadata: DataFrame, maps: DataFrame | None, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """Metadata with each (concept, column) mapped; without maps as it is."""
    out = metadata
    if maps is not None:
        for concept, column in columns:
            out = apply_map(out, column, maps.where(F.col("concept") == concept))
    return out


def female(df: DataFrame, sex: str = "Sex") -> DataFrame:
    return df.withColumn("female", F.coalesce((F.col(sex) == "Female").cast("int"), F.lit(0)))


def sex_label(sex: str):
    low = F.lower(F.trim(F.col(sex)))
    return F.when(low.isin("f", "female", "woman"), "Female").when(low.isin("m", "male", "man"), "Male").otherwise(UNKNOWN)


def unmapped(labels: DataFrame, mapping: DataFrame, label: str = "label") -> DataFrame:
    return labels.join(mapping, F.col(label) == F.col("source_label"), "left_anti")


def ontology_top(labels: DataFrame, terms: DataFrame, k: int = 5, label: str = "label", term: str = "term", text: str = "text") -> DataFrame:
    """``label, rank, term, score``: the k best terms per label among terms with one or more texts each (label, synonyms), by their words."""
    from .search import index, search

    return search(labels, label, index(terms, term, text), k)
