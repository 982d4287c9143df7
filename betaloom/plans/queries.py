"""Queries over the synthetic tables, each with the SQL that must give the same rows.

The tables are stand-ins: ``embeddings`` for a matrix of measurements (label as study),
``lineitem`` for predictions and p-values, ``orders``/``customer`` for metadata and
labels, ``events`` for the event log, ``conversations`` for messages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog, control, convert, evaluate, harmonize, impute, joins, layers, lexical, matrix, models, profile, qc, rules, threads
from ..sources import delimited, files, shared, soft
from ..streaming import events as event_log
from . import pipelines
from .config import QcConfig

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _cells(spark: SparkSession, d: str, masked: bool = False) -> DataFrame:
    long = matrix.from_arrays(_table(spark, d, "embeddings"), "vec_id", "embedding", "label")
    return long.withColumn("value", F.when((F.col("sample_id") * 31 + F.col("probe") * 17) % 13 != 0, F.col("value"))) if masked else long


_CELLS = "SELECT label::VARCHAR AS accession, vec_id AS sample_id, unnest(range(len(embedding))) AS probe, unnest(embedding)::DOUBLE AS value FROM embeddings"
_MASKED = f"SELECT accession, sample_id, probe, CASE WHEN (sample_id*31 + probe*17) % 13 <> 0 THEN value END AS value FROM ({_CELLS})"


# ---- values and quality control


@query(f"WITH c AS ({_CELLS}), s AS (SELECT count(*) FILTER (value BETWEEN 0 AND 1) / count(value) AS share FROM c) SELECT round(share, 9) AS share, CASE WHEN share > 0.95 THEN 'beta' ELSE 'm' END AS data_type FROM s")
def detect_type(spark, d):
    return convert.type_share(_cells(spark, d)).withColumn("share", F.round("share", 9))


@query(f"SELECT sample_id, probe, round(1 / (1 + pow(2.0, -value)), 6) AS beta FROM ({_CELLS})")
def m_to_beta(spark, d):
    return _cells(spark, d).select("sample_id", "probe", F.round(convert.m_to_beta(F.col("value")), 6).alias("beta"))


@query(f"SELECT sample_id, probe, round(log2(least(greatest(value, 0.001), 0.999) / (1 - least(greatest(value, 0.001), 0.999))), 6) AS m FROM ({_CELLS})")
def beta_to_m(spark, d):
    return _cells(spark, d).select("sample_id", "probe", F.round(convert.beta_to_m(F.col("value"), 0.001, 0.999), 6).alias("m"))


_SAMPLES = f"WITH c AS ({_MASKED}), n AS (SELECT accession, count(DISTINCT probe) AS n FROM c GROUP BY 1), s AS (SELECT accession, sample_id, 1 - count(value) / any_value(n) AS missing, max(value) AS largest FROM c JOIN n USING (accession) GROUP BY 1, 2)"


@query(_SAMPLES + " SELECT accession, sample_id, round(missing, 9) AS missing, missing <= 0.075 + 1e-12 AS kept FROM s")
def sample_missing(spark, d):
    long = _cells(spark, d, True)
    return qc.keep_samples(qc.sample_profile(long, *qc.dimensions(long)), 0.075, None).select("accession", "sample_id", F.round("missing", 9).alias("missing"), "kept")


@query(_SAMPLES + " SELECT accession, sample_id, round(largest, 9) AS largest, coalesce(largest > 0.3, false) AS kept FROM s")
def max_filter(spark, d):
    long = _cells(spark, d, True)
    return qc.keep_samples(qc.sample_profile(long, *qc.dimensions(long)), None, 0.3).select("accession", "sample_id", F.round("largest", 9).alias("largest"), "kept")


@query(f"WITH c AS ({_MASKED}), n AS (SELECT accession, count(DISTINCT sample_id) AS n FROM c GROUP BY 1), p AS (SELECT accession, probe, 1 - count(value) / any_value(n) AS missing FROM c JOIN n USING (accession) GROUP BY 1, 2) SELECT accession, probe, round(missing, 9) AS missing, missing <= 0.08 + 1e-12 AS kept FROM p")
def probe_missing(spark, d):
    long = _cells(spark, d, True)
    return qc.probe_profile(long, *qc.dimensions(long), 0.08).select("accession", "probe", F.round("missing", 9).alias("missing"), "kept")


@query(_SAMPLES + " SELECT accession, sample_id FROM s WHERE NOT missing <= 0.075 + 1e-12")
def removed_ids(spark, d):
    long = _cells(spark, d, True)
    return qc.removed(qc.keep_samples(qc.sample_profile(long, *qc.dimensions(long)), 0.075, None), qc.SAMPLE)


def _filled(fill: str, keys: str = "accession, probe") -> str:
    return f"WITH c AS ({_MASKED}), f AS (SELECT {keys}, {fill} AS fill FROM c GROUP BY {keys}) SELECT c.accession, sample_id, probe, round(coalesce(value, fill), 6) AS value FROM c JOIN f USING ({keys})"


@query(_filled("avg(value)"))
def impute_mean(spark, d):
    return impute.simple(_cells(spark, d, True)).select("accession", "sample_id", "probe", F.round("value", 6).alias("value"))


@query(_filled("median(value)"))
def impute_median(spark, d):
    return impute.simple(_cells(spark, d, True), "median").select("accession", "sample_id", "probe", F.round("value", 6).alias("value"))


@query(f"WITH c AS (SELECT accession, sample_id, probe, round(value, 1) AS value FROM ({_MASKED})), k AS (SELECT accession, probe, value, count(*) AS n FROM c WHERE value IS NOT NULL GROUP BY ALL), f AS (SELECT accession, probe, arg_min(value, (-n, value)) AS fill FROM k GROUP BY 1, 2) SELECT c.accession, sample_id, probe, round(coalesce(value, fill), 6) + 0.0 AS value FROM c LEFT JOIN f USING (accession, probe)")
def impute_most_frequent(spark, d):
    long = _cells(spark, d, True).withColumn("value", F.round("value", 1) + 0.0)
    return impute.simple(long, "most_frequent").select("accession", "sample_id", "probe", (F.round("value", 6) + 0.0).alias("value"))


@query(f"SELECT accession, sample_id, probe, round(coalesce(value, 0.5), 6) AS value FROM ({_MASKED})")
def impute_constant(spark, d):
    return impute.simple(_cells(spark, d, True), "constant", constant=0.5).select("accession", "sample_id", "probe", F.round("value", 6).alias("value"))


@query(f"WITH c AS (SELECT *, sample_id % 2 AS stratum FROM ({_MASKED})), f AS (SELECT stratum, probe, avg(value) AS fill FROM c GROUP BY 1, 2) SELECT stratum, sample_id, probe, round(coalesce(value, fill), 6) AS value FROM c JOIN f USING (stratum, probe)")
def impute_stratified(spark, d):
    long = _cells(spark, d, True).withColumn("stratum", F.col("sample_id") % 2)
    return impute.simple(long, keys=("stratum", "probe")).select("stratum", "sample_id", "probe", F.round("value", 6).alias("value"))


@query(f"WITH c AS ({_MASKED}), f AS (SELECT probe, avg(value) AS fill FROM c WHERE accession = '0' GROUP BY 1) SELECT accession, sample_id, probe, round(coalesce(value, fill), 6) AS value FROM c JOIN f USING (probe) WHERE accession <> '0'")
def impute_reference(spark, d):
    long = _cells(spark, d, True)
    out = impute.from_reference(long.where("accession <> '0'"), long.where("accession = '0'"))
    return out.select("accession", "sample_id", "probe", F.round("value", 6).alias("value"))


@query(f"""WITH c AS ({_MASKED}), k AS (SELECT * FROM c WHERE value IS NOT NULL), p AS (SELECT accession, count(DISTINCT probe) AS p FROM c GROUP BY 1),
d AS (SELECT a.accession, a.sample_id AS i, b.sample_id AS j, round(sqrt(sum(pow(a.value - b.value, 2)) * any_value(p) / count(*)), 12) AS d FROM k a JOIN k b ON a.accession = b.accession AND a.probe = b.probe AND a.sample_id <> b.sample_id JOIN p ON p.accession = a.accession GROUP BY 1, 2, 3),
r AS (SELECT c.accession, c.sample_id, c.probe, k.value FROM c JOIN k USING (accession, probe) JOIN d ON d.accession = c.accession AND d.i = c.sample_id AND d.j = k.sample_id WHERE c.value IS NULL QUALIFY row_number() OVER (PARTITION BY c.accession, c.sample_id, c.probe ORDER BY d.d, d.j) <= 5),
f AS (SELECT accession, sample_id, probe, avg(value) AS near FROM r GROUP BY 1, 2, 3), m AS (SELECT accession, probe, avg(value) AS mean FROM k GROUP BY 1, 2)
SELECT c.accession, c.sample_id, c.probe, round(coalesce(value, near, mean), 6) AS value FROM c LEFT JOIN f USING (accession, sample_id, probe) LEFT JOIN m USING (accession, probe)""")
def impute_knn(spark, d):
    filled = impute.knn(matrix.to_arrays(_cells(spark, d, True)))
    return filled.select("accession", "sample_id", F.posexplode("values").alias("probe", "value")).select("accession", "sample_id", F.col("probe").cast("bigint").alias("probe"), F.round("value", 6).alias("value"))


@query(f"""WITH c AS ({_CELLS}), p AS (SELECT a.accession, a.sample_id, corr(a.value, b.value) AS r FROM c a JOIN c b ON a.accession = b.accession AND a.probe = b.probe AND a.sample_id <> b.sample_id GROUP BY a.accession, a.sample_id, b.sample_id)
SELECT accession, sample_id, round(avg(r), 6) AS mean_correlation, round(avg(r), 6) > 0.05 AS kept FROM p GROUP BY 1, 2""")
def interarray_correlation(spark, d):
    found = qc.mean_correlations(_cells(spark, d)).withColumn("mean_correlation", F.round("mean_correlation", 6))
    return qc.keep_correlated(found, 0.05).select("accession", "sample_id", "mean_correlation", "kept")


_QC = QcConfig(sample_missing=0.08, probe_missing=0.09, largest=0.5, correlation=-0.01)


@query(f"""WITH c AS (SELECT accession, sample_id, probe, 1 / (1 + pow(2.0, -value)) AS value FROM ({_MASKED})),
np AS (SELECT accession, count(DISTINCT probe) AS n FROM c GROUP BY 1),
s AS (SELECT accession, sample_id FROM c JOIN np USING (accession) GROUP BY accession, sample_id HAVING 1 - count(value) / any_value(n) <= 0.08 + 1e-12 AND max(value) > 0.5),
ns AS (SELECT accession, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT accession, probe FROM c SEMI JOIN s USING (accession, sample_id) JOIN ns USING (accession) GROUP BY accession, probe HAVING 1 - count(value) / any_value(n) <= 0.09 + 1e-12),
k AS (SELECT c.* FROM c SEMI JOIN s USING (accession, sample_id)), k2 AS (SELECT k.* FROM k SEMI JOIN p USING (accession, probe)),
f AS (SELECT accession, sample_id, probe, coalesce(value, avg(value) OVER (PARTITION BY accession, probe)) AS value FROM k2),
r AS (SELECT a.accession, a.sample_id, corr(a.value, b.value) AS r FROM f a JOIN f b ON a.accession = b.accession AND a.probe = b.probe AND a.sample_id <> b.sample_id GROUP BY a.accession, a.sample_id, b.sample_id),
g AS (SELECT accession, sample_id FROM r GROUP BY 1, 2 HAVING avg(r) > -0.01)
SELECT accession, sample_id, count(*) AS n_probes, round(sum(value), 6) AS total FROM f SEMI JOIN g USING (accession, sample_id) GROUP BY 1, 2""")
def qc_pipeline(spark, d):
    found = pipelines.quality_control(_cells(spark, d, True), _QC, "m")
    return found.clean.groupBy("accession", "sample_id").agg(F.count("*").alias("n_probes"), F.round(F.sum("value"), 6).alias("total"))


@query(f"WITH c AS ({_MASKED}), a AS (SELECT * FROM c WHERE sample_id % 3 > 0 AND probe < 40 AND accession <> '3') SELECT b.accession, b.n AS samples_before, coalesce(a.n, 0) AS samples_after, coalesce(a.p, 0) AS probes_after FROM (SELECT accession, count(DISTINCT sample_id) AS n FROM c GROUP BY 1) b LEFT JOIN (SELECT accession, count(DISTINCT sample_id) AS n, count(DISTINCT probe) AS p FROM a GROUP BY 1) a USING (accession)")
def qc_summary(spark, d):
    long = _cells(spark, d, True)
    return qc.summary(long, long.where("sample_id % 3 > 0 and probe < 40 and accession <> '3'"))


# ---- models and metrics


def _coefficients(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    c = spark.range(64).select(F.lit("m1").alias("model"), F.col("id").alias("probe"), ((F.col("id") % 7 - 3) / 10).alias("weight"))
    return c.unionByName(c.select(F.lit("m2").alias("model"), "probe", (-F.col("weight") / 2).alias("weight"))), spark.createDataFrame([("m1", 0.1, "adult_age"), ("m2", 30.0, "identity")], "model string, intercept double, link string")


@query(f"""WITH c AS ({_CELLS}), x AS (SELECT accession, sample_id, sum(value * (probe % 7 - 3) / 10) AS s FROM c GROUP BY 1, 2), y AS (SELECT *, s + 0.1 AS a, -s / 2 + 30 AS b FROM x)
SELECT accession, sample_id, 'm1' AS model, round(CASE WHEN a < 0 THEN 21 * exp(a) - 1 ELSE 21 * a + 20 END, 6) AS predicted FROM y UNION ALL SELECT accession, sample_id, 'm2', round(b, 6) FROM y""")
def linear_models(spark, d):
    return models.predict(_cells(spark, d), *_coefficients(spark)).withColumn("predicted", F.round("predicted", 6))


@query(f"WITH c AS ({_CELLS}) SELECT accession, sample_id, 'pca' AS model, round(sum((value - 0.01) * ((probe % 5 - 2) * 0.5 + (probe % 3 - 1) * 2.0)) + 40, 6) AS predicted FROM c GROUP BY 1, 2")
def pca_model(spark, d):
    import numpy as np

    p = np.arange(64)
    folded = models.fold_pca(spark, "pca", p.tolist(), np.stack([p % 5 - 2, p % 3 - 1], axis=1).astype(float), np.full(64, 0.01), np.array([0.5, 2.0]), 40.0)
    return models.predict(_cells(spark, d), *folded).withColumn("predicted", F.round("predicted", 6))


@query(f"WITH c AS (SELECT accession, sample_id, probe, CASE WHEN probe > 1 THEN value END AS value FROM ({_MASKED})), m AS (SELECT probe, avg(value) AS mean FROM c GROUP BY 1) SELECT accession, sample_id, c.probe, round(coalesce(value, mean, CASE WHEN c.probe = 0 THEN 0.25 END, 0.75), 6) AS value FROM c JOIN m ON c.probe = m.probe")
def model_input(spark, d):
    long = _cells(spark, d, True).withColumn("value", F.when(F.col("probe") > 1, F.col("value")))
    default = spark.createDataFrame([(0, 0.75), (1, 0.75)], "probe bigint, value double")
    user = spark.createDataFrame([(0, 0.25)], "probe bigint, value double")
    return impute.cascade(long, default, user).withColumn("value", F.round("value", 6))


_AGED = "SELECT l_returnflag AS dataset, l_linestatus AS model, l_extendedprice AS predicted, l_quantity AS age, l_orderkey, l_linenumber, l_shipdate, l_discount FROM lineitem"


def _aged(spark, d):
    return _table(spark, d, "lineitem").select(F.col("l_returnflag").alias("dataset"), F.col("l_linestatus").alias("model"), F.col("l_extendedprice").alias("predicted"), F.col("l_quantity").alias("age"), "l_orderkey", "l_linenumber", "l_discount")


_ACCEL = f"a AS ({_AGED}), f AS (SELECT dataset, model, regr_slope(predicted, age) AS s, regr_intercept(predicted, age) AS i FROM a GROUP BY 1, 2), r AS (SELECT a.*, predicted - (i + s * age) AS accel FROM a JOIN f USING (dataset, model))"


@query(f"WITH {_ACCEL} SELECT dataset, model, l_orderkey, l_linenumber, round(accel, 3) AS accel FROM r")
def age_acceleration(spark, d):
    return models.acceleration(_aged(spark, d), ["dataset", "model"]).select("dataset", "model", "l_orderkey", "l_linenumber", F.round("accel", 3).alias("accel"))


def _metrics(error_on: str):
    def run(spark, d):
        rows = models.acceleration(_aged(spark, d), ["dataset", "model"]).where("l_discount < 0.05")
        out = evaluate.overall_and_by_dataset(rows, "dataset", "model", error_on=error_on)
        return out.select("dataset", "model", "n", F.round("mae", 3).alias("mae"), F.round("medae", 3).alias("medae"), (F.round("pearson_r", 5) + 0.0).alias("pearson_r"))

    return run


def _metrics_sql(side: str) -> str:
    return f"WITH {_ACCEL}, h AS (SELECT * FROM r WHERE l_discount < 0.05) SELECT coalesce(dataset, 'overall') AS dataset, model, count(*) AS n, round(avg(abs({side} - age)), 3) AS mae, round(median(abs({side} - age)), 3) AS medae, round(corr({side}, age), 5) + 0.0 AS pearson_r FROM h GROUP BY GROUPING SETS ((dataset, model), (model)) HAVING count(*) >= 2"


@query(_metrics_sql("accel"))
def model_metrics(spark, d):
    return _metrics("accel")(spark, d)


@query(_metrics_sql("predicted"))
def model_metrics_of_predictions(spark, d):
    return _metrics("prediction")(spark, d)


@query("""WITH g AS (SELECT l_returnflag AS dataset, count(*) FILTER (l_linestatus <> 'O') AS no, count(*) FILTER (l_linestatus = 'O') AS nc, avg(l_extendedprice) FILTER (l_linestatus <> 'O') AS mo, avg(l_extendedprice) FILTER (l_linestatus = 'O') AS mc, var_samp(l_extendedprice) FILTER (l_linestatus <> 'O') / count(*) FILTER (l_linestatus <> 'O') AS a, var_samp(l_extendedprice) FILTER (l_linestatus = 'O') / count(*) FILTER (l_linestatus = 'O') AS b FROM lineitem GROUP BY 1)
SELECT dataset, no AS n_other, nc AS n_control, CASE WHEN no >= 2 AND nc >= 2 THEN round((mo - mc) / sqrt(a + b), 6) END AS t, CASE WHEN no >= 2 AND nc >= 2 THEN round(pow(a + b, 2) / (a * a / (no - 1) + b * b / (nc - 1)), 3) END AS df FROM g""")
def welch_statistic(spark, d):
    rows = _table(spark, d, "lineitem").select(F.col("l_returnflag").alias("dataset"), "l_extendedprice", (F.col("l_linestatus") == "O").alias("control"))
    return evaluate.welch(rows, ["dataset"], "l_extendedprice", "control").select("dataset", "n_other", "n_control", F.round("t", 6).alias("t"), F.round("df", 3).alias("df"))


@query("SELECT l_returnflag AS dataset, count(*) AS n, round(avg(l_discount - 0.05) / sqrt(var_samp(l_discount - 0.05) / count(*)), 6) AS t, (count(*) - 1)::DOUBLE AS df FROM lineitem GROUP BY 1")
def one_sample_statistic(spark, d):
    rows = _table(spark, d, "lineitem").select(F.col("l_returnflag").alias("dataset"), (F.col("l_discount") - 0.05).alias("x"))
    return evaluate.one_sample(rows, ["dataset"], "x").withColumn("t", F.round("t", 6))


# the tail as 1/2 minus Simpson's rule over the density from 0 to |t|, in 2000 steps
@query("""WITH g AS (SELECT l_returnflag AS dataset, count(*) FILTER (l_linestatus <> 'O') AS no, count(*) FILTER (l_linestatus = 'O') AS nc, avg(l_extendedprice) FILTER (l_linestatus <> 'O') AS mo, avg(l_extendedprice) FILTER (l_linestatus = 'O') AS mc, var_samp(l_extendedprice) FILTER (l_linestatus <> 'O') / count(*) FILTER (l_linestatus <> 'O') AS a, var_samp(l_extendedprice) FILTER (l_linestatus = 'O') / count(*) FILTER (l_linestatus = 'O') AS b FROM lineitem GROUP BY 1),
t AS (SELECT dataset, no, nc, CASE WHEN no >= 2 AND nc >= 2 THEN (mo - mc) / sqrt(a + b) END AS t, CASE WHEN no >= 2 AND nc >= 2 THEN pow(a + b, 2) / (a * a / (no - 1) + b * b / (nc - 1)) END AS df FROM g),
i AS (SELECT dataset, sum((CASE WHEN k = 0 OR k = 2000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * pow(1 + pow(t * k / 2000, 2) / df, -(df + 1) / 2)) * abs(t) / 6000 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi() * df) AS area FROM t, range(2001) x(k) WHERE t IS NOT NULL GROUP BY dataset, t, df)
SELECT t.dataset, no AS n_other, nc AS n_control, round(t, 6) AS t, round(df, 3) AS df, round(CASE WHEN t >= 0 THEN 0.5 - area ELSE 0.5 + area END, 6) AS p FROM t LEFT JOIN i ON i.dataset = t.dataset""")
def welch_p_values(spark, d):
    rows = _table(spark, d, "lineitem").select(F.col("l_returnflag").alias("dataset"), "l_extendedprice", (F.col("l_linestatus") == "O").alias("control"))
    return evaluate.with_p(evaluate.welch(rows, ["dataset"], "l_extendedprice", "control")).select("dataset", "n_other", "n_control", F.round("t", 6).alias("t"), F.round("df", 3).alias("df"), F.round("p", 6).alias("p"))


@query()
def permutation_test(spark, d):
    rows = _table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), "c_acctbal", (F.col("c_nationkey") % 2 == 0).alias("control"))
    return evaluate.permutation(rows, ["segment"], "c_acctbal", "control", 200)


# ---- ingest


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_tax <= 0.05")
def detection_filter(spark, d):
    return matrix.detection_filter(_table(spark, d, "lineitem"), "l_tax").select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("WITH s AS (SELECT l_returnflag AS f, bool_and(l_discount = l_tax) AS same FROM lineitem GROUP BY 1) SELECT l_orderkey, l_linenumber, CASE WHEN same OR l_tax < 0.05 THEN l_discount END AS value FROM lineitem JOIN s ON l_returnflag = f")
def detection_mask(spark, d):
    return matrix.detection_mask(_table(spark, d, "lineitem"), ["l_returnflag"], "l_discount", "l_tax").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("value"))


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE 'la%'")
def probe_prefix(spark, d):
    return matrix.with_probe_prefix(_table(spark, d, "part"), "La", "p_name").select("p_partkey", "p_name")


@query("SELECT c AS in_columns, r AS in_rows, c > r AS columns, r > c AS rows FROM (SELECT count(*) FILTER (lower(p_brand) LIKE '%1%') AS c, count(*) FILTER (lower(p_name) LIKE '%1%') AS r FROM part)")
def orientation(spark, d):
    p = _table(spark, d, "part")
    labels = p.select(F.lit("columns").alias("axis"), F.col("p_brand").alias("label")).unionByName(p.select(F.lit("rows").alias("axis"), F.col("p_name").alias("label")))
    return matrix.orientation(labels, mark="1")


@query("SELECT user_id, round(sum(value) FILTER (event_type = 'click'), 6) AS click, round(sum(value) FILTER (event_type = 'view'), 6) AS view FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def matrix_union(spark, d):
    e = _table(spark, d, "events").where(F.col("event_type").isin("click", "view"))
    long = e.groupBy("user_id", F.col("event_type").alias("probe")).agg(F.round(F.sum("value"), 6).alias("value"))
    return matrix.to_wide(long, "user_id", ["click", "view"])


@query("SELECT o_orderkey AS id, o_totalprice::DOUBLE AS a, NULL::DOUBLE AS b FROM orders UNION ALL SELECT c_custkey, NULL, c_acctbal FROM customer")
def row_concat(spark, d):
    return matrix.union(_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("a")), _table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("b")))


@query("SELECT l_partkey FROM (SELECT DISTINCT l_partkey, l_returnflag FROM lineitem) GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT l_returnflag) FROM lineitem)")
def common_probes(spark, d):
    return matrix.common_probes(_table(spark, d, "lineitem"), "l_returnflag", "l_partkey")


# ---- joins and maps


@query("SELECT o_orderkey, o_totalprice, c_name, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey")
def inner_align(spark, d):
    return joins.with_metadata(_table(spark, d, "orders"), _table(spark, d, "customer"), "o_custkey", "c_custkey").select("o_orderkey", "o_totalprice", "c_name", "c_acctbal")


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def anti_pending(spark, d):
    return joins.pending(_table(spark, d, "documents").select("doc_id"), _table(spark, d, "labels"), "doc_id")


@query("SELECT doc_id, lang FROM documents SEMI JOIN labels USING (doc_id)")
def semi_done(spark, d):
    return joins.done(_table(spark, d, "documents").select("doc_id", "lang"), _table(spark, d, "labels"), "doc_id")


_LABELS = [("BUILDING", "construction", 1), ("BUILDING", "building", 2), ("MACHINERY", "machines", 3), ("none", "nothing", 4)]
_LABELS_SQL = "(VALUES ('BUILDING', 'construction', 1), ('BUILDING', 'building', 2), ('MACHINERY', 'machines', 3), ('none', 'nothing', 4)) m(source_label, target_label, seq)"
_GROUPS = [("building", "hard", 1), ("building", "soft", 2), ("machines", "hard", 3)]
_GROUPS_SQL = "(VALUES ('building', 'hard', 1), ('building', 'soft', 2), ('machines', 'hard', 3)) g(source_label, target_label, seq)"
_MAP = "source_label string, target_label string, seq int"


@query(f"WITH m AS (SELECT source_label, arg_max(target_label, seq) AS t FROM {_LABELS_SQL} GROUP BY 1) SELECT c_custkey, coalesce(t, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN m ON c_mktsegment = source_label")
def label_map(spark, d):
    return harmonize.apply_map(_table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", spark.createDataFrame(_LABELS, _MAP))


@query(f"WITH s AS (SELECT DISTINCT c_mktsegment FROM customer), m AS (SELECT source_label, arg_min(target_label, seq) AS t FROM {_LABELS_SQL} GROUP BY 1), f AS (SELECT c_mktsegment AS source_label, coalesce(t, c_mktsegment) AS target, CASE WHEN t IS NULL THEN 'best_guess' ELSE 'mondo' END AS kind FROM s LEFT JOIN m ON c_mktsegment = m.source_label), g AS (SELECT source_label AS s, arg_min(target_label, seq) AS t FROM {_GROUPS_SQL} GROUP BY 1) SELECT source_label, target, kind, coalesce(t, '') AS group_label FROM f LEFT JOIN g ON target = s")
def final_and_group_map(spark, d):
    guesses = _table(spark, d, "customer").select(F.col("c_mktsegment").alias("source_label"), F.col("c_mktsegment").alias("target_label")).distinct()
    final = harmonize.final_map(guesses, spark.createDataFrame(_LABELS, _MAP).withColumn("ontology", F.lit("mondo")))
    return harmonize.with_groups(final, spark.createDataFrame(_GROUPS, _MAP))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Female' ELSE 'Unknown/Other' END AS sex, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS female FROM orders")
def sex_labels(spark, d):
    o = _table(spark, d, "orders").select("o_orderkey", harmonize.sex_label("o_orderstatus").alias("sex"))
    return harmonize.female(o, "sex")


@query("SELECT DISTINCT o_orderpriority AS label FROM orders WHERE lower(o_orderpriority) <> '1-urgent'")
def distinct_labels(spark, d):
    return profile.labels(_table(spark, d, "orders"), "o_orderpriority", "1-URGENT")


# ---- metadata


@query("SELECT event_id, regexp_extract(props, '\"k\": *([0-9]+)', 1) AS k, CASE WHEN regexp_matches(props, '\"k\": *([0-9])9') THEN regexp_extract(props, '\"k\": *([0-9])9', 1) END AS tens FROM events")
def extraction_rule(spark, d):
    rule = rules.Rule("k", field="props", pattern='"k": *([0-9])9')
    e = _table(spark, d, "events")
    got, _ = rules.apply(F.array("props"), rule)
    return e.select("event_id", F.regexp_extract("props", '"k": *([0-9]+)', 1).alias("k"), got.alias("tens"))


@query("SELECT event_id, try_cast(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS age, event_type AS condition, 'constant' AS tissue FROM events")
def extract_metadata(spark, d):
    samples = _table(spark, d, "events").select(F.col("event_id"), F.create_map(F.lit("ch"), F.array(F.concat(F.lit("Age: "), F.regexp_replace("props", "[{}\": k]", "")), F.concat(F.lit("kind: "), "event_type"))).alias("fields"))
    found = rules.extract(samples, {"age": rules.Rule("age", field="ch", key="age", pattern="([0-9]+)"), "condition": rules.Rule("condition", field="ch", key="KIND", pattern="(.*)"), "tissue": rules.Rule("tissue", constant="constant")}, sample="event_id")
    return found.drop("failures")


@query("SELECT event_id, event_type AS kind, user_id::VARCHAR AS usr FROM events")
def key_value_parse(spark, d):
    e = _table(spark, d, "events").select("event_id", F.array(F.lit("no colon"), F.concat(F.lit("kind : x"),), F.concat(F.lit("kind:"), "event_type", F.lit(" :rest")), F.concat(F.lit(" user: "), F.col("user_id").cast("string"))).alias("v"))
    m = T.key_values(F.col("v"))
    return e.select("event_id", F.element_at(m, "kind").alias("kind"), F.element_at(m, "user").alias("usr"))


@query("""WITH j AS (SELECT doc_id, lang, quality::VARCHAR AS quality, toxic::VARCHAR AS toxic FROM documents LEFT JOIN labels USING (doc_id)),
u AS (SELECT doc_id, unnest(['lang', 'quality', 'toxic']) AS field, unnest([lang, quality, toxic]) AS v FROM j)
SELECT field, count(v) AS present, count(*) - count(v) AS missing, round(count(v) / count(*), 9) AS parse_rate, count(DISTINCT v) AS unique_values, array_to_string((list(v ORDER BY doc_id) FILTER (v IS NOT NULL))[1:10], ',') AS examples FROM u GROUP BY 1""")
def field_coverage(spark, d):
    j = _table(spark, d, "documents").select("doc_id", "lang").join(_table(spark, d, "labels"), "doc_id", "left")
    out = profile.coverage(j, ["lang", "quality", "toxic"], "doc_id")
    return out.withColumns({"parse_rate": F.round("parse_rate", 9), "examples": F.array_join("examples", ",")})


@query("SELECT c_mktsegment AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM customer), 9) AS share FROM customer GROUP BY 1")
def value_shares(spark, d):
    return profile.value_shares(_table(spark, d, "customer"), "c_mktsegment").withColumn("share", F.round("share", 9))


@query("""WITH b AS (SELECT c_nationkey, count(*) AS n_samples, printf('%.2f-%.2f', min(c_acctbal), max(c_acctbal)) AS ages, min(c_name) AS platform FROM customer GROUP BY 1),
c AS (SELECT c_nationkey, c_mktsegment AS v, count(*) AS n FROM customer GROUP BY 1, 2),
l AS (SELECT c_nationkey, string_agg(v, ', ' ORDER BY n DESC, v) AS conditions FROM c GROUP BY 1),
x AS (SELECT c_nationkey, (c_custkey % 2)::VARCHAR AS v, count(*) AS n FROM customer GROUP BY 1, 2),
s AS (SELECT c_nationkey, string_agg(v || printf(' (%.1f%%)', n * 100.0 / t), ', ' ORDER BY n DESC, v) AS sexes FROM (SELECT *, sum(n) OVER (PARTITION BY c_nationkey) AS t FROM x) GROUP BY 1)
SELECT c_nationkey, n_samples, ages, conditions, sexes, platform FROM b JOIN l USING (c_nationkey) JOIN s USING (c_nationkey)""")
def dataset_summary(spark, d):
    c = _table(spark, d, "customer").withColumn("sex", F.col("c_custkey") % 2)
    return profile.dataset_summary(c, "c_nationkey", "c_acctbal", "c_mktsegment", "sex", "c_name")


@query("SELECT accession, bool_and(status IN ('resolved', 'missing') AND confidence > 0.6) AS accepted FROM (SELECT user_id AS accession, CASE WHEN event_type = 'error' THEN 'error' ELSE 'resolved' END AS status, CASE WHEN value < 3 THEN 0.5 ELSE 0.9 END AS confidence FROM events) GROUP BY 1")
def protocol_accepted(spark, d):
    e = _table(spark, d, "events").select(F.col("user_id").alias("accession"), F.when(F.col("event_type") == "error", "error").otherwise("resolved").alias("status"), F.when(F.col("value") < 3, 0.5).otherwise(0.9).alias("confidence"))
    return rules.accepted(e)


# ---- text


@query(r"""WITH a AS (SELECT p_partkey, trim(p_name || ' ' || p_type || p_size::VARCHAR) AS s FROM part), b AS (SELECT p_partkey, regexp_replace(regexp_replace(s, '([a-z])([A-Z])', '\1 \2', 'g'), '[_\-/]+', ' ', 'g') AS s FROM a),
c AS (SELECT p_partkey, regexp_replace(regexp_replace(s, '([0-9])([^0-9])', '\1 \2', 'g'), '([^0-9])([0-9])', '\1 \2', 'g') AS s FROM b), e AS (SELECT p_partkey, lower(trim(regexp_replace(regexp_replace(s, '[^a-zA-Z0-9\s]+', ' ', 'g'), '\s+', ' ', 'g'))) AS norm FROM c)
SELECT p_partkey, norm, len(string_split(norm, ' ')) AS n_tokens, array_to_string(list_filter(string_split(norm, ' '), lambda t: regexp_full_match(t, '[0-9]+')), ' ') AS nums FROM e""")
def lexical_features(spark, d):
    f = T.features(F.concat(F.col("p_name"), F.lit(" "), F.col("p_type"), F.col("p_size").cast("string")))
    return _table(spark, d, "part").select("p_partkey", f.alias("f")).select("p_partkey", "f.norm", F.size("f.tokens").cast("bigint").alias("n_tokens"), F.array_join("f.nums", " ").alias("nums"))


@query("""WITH t AS (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_type), ' ')) AS b FROM part)
SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard, round(exp(-abs(len(a) - len(b)) / greatest(len(a), len(b))), 6) AS penalty FROM t""")
def lexical_parts(spark, d):
    a, b = (F.array_distinct(F.split(F.lower(c), " ")) for c in ("p_name", "p_type"))
    return _table(spark, d, "part").select("p_partkey", F.round(T.jaccard(a, b), 6).alias("jaccard"), F.round(T.count_penalty(F.size(a), F.size(b), 1.0), 6).alias("penalty"))

# The lexical score in SQL: sorted tokens, their longest common subsequence row by row, words and numbers.
def _match_sql(left: str, right: str, penalty: bool = True) -> str:
    """``a, b, score`` for every pair; ``left`` and ``right`` are queries with a column ``v``."""
    norm = "regexp_replace(regexp_replace(v, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[_\\-/]+', ' ', 'g')"
    norm = f"regexp_replace(regexp_replace({norm}, '([0-9])([^0-9])', '\\1 \\2', 'g'), '([^0-9])([0-9])', '\\1 \\2', 'g')"
    norm = f"lower(trim(regexp_replace(regexp_replace({norm}, '[^a-zA-Z0-9\\s]+', ' ', 'g'), '\\s+', ' ', 'g')))"
    side = lambda name, q: f"{name} AS (SELECT v, list_sort(list_filter(string_split({norm}, ' '), lambda t: t <> '')) AS t FROM (SELECT DISTINCT v FROM ({q}) WHERE v IS NOT NULL))"
    part = lambda x, y: f"CASE WHEN len(list_distinct(list_concat({x}, {y}))) = 0 THEN 1.0 ELSE len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y}))) END"
    factor = "CASE WHEN greatest(len(ta), len(tb)) = 0 THEN 1.0 ELSE exp(-abs(len(ta) - len(tb)) / greatest(len(ta), len(tb))) END" if penalty else "1.0"
    return f"""{side("l", left)}, {side("r", right)},
p AS (SELECT l.v AS a, r.v AS b, l.t AS ta, r.t AS tb, array_to_string(l.t, ' ') AS sa, array_to_string(r.t, ' ') AS sb FROM l, r),
n AS (SELECT DISTINCT sa, sb FROM p),
w AS (SELECT sa, sb, 0 AS k, list_transform(range(0, length(sa) + 1), lambda i: 0::BIGINT) AS row FROM n
  UNION ALL SELECT sa, sb, k + 1, list_transform(range(1, length(sa) + 2), lambda i: list_max(list_transform(range(1, i + 1), lambda j:
    CASE WHEN j > 1 AND sa[j - 1] = sb[k + 1] THEN row[j - 1] + 1 ELSE row[j] END))) FROM w WHERE k < length(sb)),
c AS (SELECT sa, sb, row[-1] AS lcs FROM w WHERE k = length(sb)),
f AS (SELECT *, list_filter(ta, lambda t: regexp_matches(t, '^[0-9]+$')) AS na, list_filter(tb, lambda t: regexp_matches(t, '^[0-9]+$')) AS nb,
  list_filter(ta, lambda t: NOT regexp_matches(t, '^[0-9]+$')) AS wa, list_filter(tb, lambda t: NOT regexp_matches(t, '^[0-9]+$')) AS wb FROM p JOIN c USING (sa, sb)),
s AS (SELECT a, b, round((0.45 * CASE WHEN length(sa) + length(sb) = 0 THEN 1.0 ELSE 2 * lcs / (length(sa) + length(sb)) END + 0.10 * ({part("wa", "wb")})
  + 0.45 * CASE WHEN len(na) = 0 AND len(nb) = 0 THEN 1.0 WHEN len(na) = 0 OR len(nb) = 0 THEN 0.6 ELSE {part("na", "nb")} END) * {factor}, 9) AS score FROM f)"""


def _best_sql(left: str, right: str, names: str = "a, b, score") -> str:
    return f"WITH RECURSIVE {_match_sql(left, right)} SELECT {names} FROM (SELECT a, b, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) = 1)"


@query(_best_sql("SELECT s_name AS v FROM supplier", "SELECT n_name AS v FROM nation"))
def best_match(spark, d):
    return lexical.best(_table(spark, d, "supplier"), _table(spark, d, "nation"), "s_name", "n_name").withColumn("score", F.round("score", 6))


# the candidate with the highest score, the last in order among equals, and then the subject nearest to it
@query(f"""WITH RECURSIVE {_match_sql("SELECT n_name AS v FROM nation UNION ALL SELECT 'sample_' || n_nationkey FROM nation", "SELECT lower(n_name) AS v FROM nation", penalty=False)},
one AS (SELECT a, b, score FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) = 1),
m AS (SELECT n_nationkey AS sample, unnest([n_name, 'sample_' || n_nationkey]) AS a FROM nation),
top AS (SELECT sample, a AS subject, score FROM m JOIN one USING (a) QUALIFY row_number() OVER (PARTITION BY sample ORDER BY score DESC, a DESC) = 1)
SELECT sample, subject, lower(n_name) AS matched, round(score, 6) AS score FROM top JOIN nation ON n_nationkey = sample""")
def subject_map(spark, d):
    n = _table(spark, d, "nation").select("n_nationkey", "n_name", F.concat(F.lit("sample_"), F.col("n_nationkey").cast("string")).alias("alt"))
    samples = n.select("n_nationkey", F.explode(F.array("n_name", "alt")).alias("candidate"))
    return lexical.subject_map(samples, n.select(F.lower("n_name").alias("subject")), "n_nationkey", "candidate", "subject").withColumn("score", F.round("score", 6))


# labels with numbers on both sides
@query(_best_sql("SELECT c_name AS v FROM customer", "SELECT s_name AS v FROM supplier"))
def best_partner(spark, d):
    return lexical.best(_table(spark, d, "customer"), _table(spark, d, "supplier"), "c_name", "s_name").withColumn("score", F.round("score", 6))


@query(r"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, 'sk-ant-[a-zA-Z0-9_-]{10,}', 'sk-ant-<REDACTED>', 'g'), '\bsk-[a-zA-Z0-9_-]{10,}', 'sk-<REDACTED>', 'g'), '[\p{L}\p{N}_.-]+@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+', '<EMAIL_REDACTED>', 'g')) AS digest FROM documents")
def redact(spark, d):
    return _table(spark, d, "documents").select("doc_id", F.sha2(T.redact(F.col("text")), 256).alias("digest"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN text[1:200] || '...<truncated>' ELSE text END AS preview FROM documents")
def truncate(spark, d):
    return _table(spark, d, "documents").select("doc_id", T.truncate(F.col("text")).alias("preview"))


@query("SELECT page_id, array_to_string(regexp_extract_all(url, '(?i)(com/[0-9]+|en/[0-9]+)'), ',') AS found FROM pages")
def accessions_in_text(spark, d):
    return _table(spark, d, "pages").select("page_id", F.array_join(T.accessions(F.col("url"), "(?:com/|en/)"), ",").alias("found"))


@query("SELECT DISTINCT url FROM pages WHERE url LIKE '%5'")
def thread_list(spark, d):
    return files.threads_ending(_table(spark, d, "pages"), "url", "5")


@query("SELECT page_id, url FROM pages WHERE url LIKE '%example.org%' OR url LIKE '%/fr/%'")
def url_selection(spark, d):
    return catalog.urls_containing(_table(spark, d, "pages"), ["example.org", "/fr/"], "url").select("page_id", "url")


# ---- operations


@query("SELECT event_id, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def artifact_latest(spark, d):
    return catalog.keep_one(_table(spark, d, "events").select("event_id", "user_id", "event_type", "value"), ["user_id", "event_type"], "event_id")


@query("SELECT event_id, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def artifact_first(spark, d):
    return catalog.keep_one(_table(spark, d, "events").select("event_id", "user_id", "event_type", "value"), ["user_id", "event_type"], "event_id", last=False)


_STATUS = "CASE event_type WHEN 'click' THEN 'completed' WHEN 'purchase' THEN 'running' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'not_started' ELSE 'canceled' END"


@query(f"WITH s AS (SELECT user_id, {_STATUS} AS status FROM events) SELECT user_id, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'not_started') AS not_started, count(*) FILTER (status IN ('not_started', 'running')) AS in_progress, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'canceled') AS canceled, bool_and(status IN ('completed', 'failed', 'canceled')) AS all_done FROM s GROUP BY 1")
def status_counts(spark, d):
    return catalog.status_counts(_table(spark, d, "events").select("user_id", F.expr(_STATUS).alias("status")), ["user_id"])


@query("SELECT user_id, CASE WHEN count(*) FILTER (value > 20) = count(*) THEN 'success' WHEN count(*) FILTER (value > 20) = 0 THEN 'failed' ELSE 'partial' END AS status, count(*) FILTER (value > 20) AS n_ok, count(*) AS n FROM events GROUP BY 1")
def batch_status(spark, d):
    return catalog.batch_status(_table(spark, d, "events"), ["user_id"], F.col("value") > 20)


@query("SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def missing_prerequisites(spark, d):
    steps = _table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit("download").alias("step"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"))
    return catalog.missing_prerequisites(_table(spark, d, "customer").select("c_custkey").distinct(), steps, "download", "c_custkey")


@query("SELECT conv_id, sha256(string_agg(text, '' ORDER BY turn)) AS digest, string_agg(text, '' ORDER BY turn)[1:200] AS preview FROM conversations GROUP BY 1")
def message_hash(spark, d):
    return threads.digests(_table(spark, d, "conversations"), "conv_id", "turn", "text")


@query("SELECT conv_id, arg_max(text, turn) AS latest FROM conversations WHERE role = 'user' GROUP BY 1")
def latest_user_text(spark, d):
    return threads.latest_text(_table(spark, d, "conversations"), "conv_id", "turn", "text", "role")


@query("SELECT conv_id, arg_max(text, turn) AS last_message, (conv_id::VARCHAR)[1:8] || '...' AS title, count(*) FILTER (role <> 'system') AS n_messages FROM conversations GROUP BY 1")
def thread_titles(spark, d):
    return threads.titles(_table(spark, d, "conversations"), "conv_id", "turn", "text", "role")


@query("SELECT user_id, event_type, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY 1, 2")
def event_profile(spark, d):
    from ..streaming.events import profile as event_counts

    return event_counts(_table(spark, d, "events"), "user_id", "event_type", "ts")


@query("SELECT event_id, v AS violation FROM (SELECT event_id, unnest([CASE WHEN NOT value BETWEEN 0 AND 50 THEN 'value_range' END, CASE WHEN event_type = 'error' THEN 'no_error' END]) AS v FROM events) WHERE v IS NOT NULL")
def contract_violations(spark, d):
    return catalog.violations(_table(spark, d, "events"), {"value_range": F.col("value").between(0, 50), "no_error": F.col("event_type") != "error"}).select("event_id", "violation")


@query("SELECT o_orderkey, CASE WHEN bad AND o_orderpriority = '1-URGENT' THEN 'failed' WHEN bad AND o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 'canceled' ELSE o_orderstatus END AS status FROM (SELECT *, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AS bad FROM orders)")
def failure_propagation(spark, d):
    steps = _table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("accession"), F.col("o_orderpriority").alias("step"), F.col("o_orderstatus").alias("status"))
    failed = _table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("accession"))
    return catalog.propagate_failures(steps, failed, "1-URGENT", ["2-HIGH", "3-MEDIUM"]).select("o_orderkey", "status")


@query("WITH r AS (SELECT sha256(to_json({'n_name': n_name, 'n_nationkey': n_nationkey, 'n_regionkey': n_regionkey})) AS h FROM nation) SELECT count(*) AS n_rows, sum(('0x' || h[1:8])::BIGINT)::BIGINT AS d1, sum(('0x' || h[9:16])::BIGINT)::BIGINT AS d2 FROM r")
def table_digest(spark, d):
    return catalog.content_digest(_table(spark, d, "nation"))


@query("SELECT c_custkey, c_name FROM customer ORDER BY md5('0:' || c_custkey::VARCHAR), c_custkey LIMIT 10")
def deterministic_sample(spark, d):
    return profile.sample_rows(_table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", 10)


# ---- decisions


@query("SELECT DISTINCT upper(o_orderpriority) AS accession FROM orders WHERE o_orderstatus NOT IN ('F', 'failed', 'resolved')")
def active_accessions(spark, d):
    return control.active_accessions(_table(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderpriority").alias("accession"), F.col("o_orderstatus").alias("status")))


@query("SELECT s_suppkey, s_name FROM supplier ORDER BY s_name, s_suppkey LIMIT 5")
def work_queue(spark, d):
    return control.work_queue(_table(spark, d, "supplier").select("s_suppkey", "s_name"), 5, "s_name")


@query("SELECT DISTINCT o_orderstatus FROM orders WHERE o_orderstatus <> 'F'")
def target_groups(spark, d):
    return control.split_control(_table(spark, d, "orders"), "o_orderstatus", "F")[1]


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS n_control, count(*) FILTER (o_orderstatus <> 'F') AS n_other FROM orders GROUP BY 1 HAVING n_control >= 10 AND n_other >= 10")
def group_size_guard(spark, d):
    return control.large_enough(_table(spark, d, "orders"), "o_orderpriority", F.col("o_orderstatus") == "F")


@query("SELECT event_id, event_type FROM events WHERE event_type NOT IN (SELECT event_type FROM events WHERE event_id < 3)")
def allowed_keys(spark, d):
    e = _table(spark, d, "events")
    return control.not_allowed(e.select("event_id", "event_type"), e.where("event_id < 3"), ["event_type"]).select("event_id", "event_type")


@query("WITH r AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'success' ELSE 'skipped' END AS status, CASE WHEN value > 20 THEN 'e' END AS error, CASE WHEN user_id % 2 = 0 THEN 'a' END AS artifact FROM events) SELECT event_id, status FROM r WHERE (status = 'failed') <> (error IS NOT NULL) OR (status = 'success' AND artifact IS NULL)")
def inconsistent_results(spark, d):
    r = _table(spark, d, "events").select("event_id", F.expr("CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'success' ELSE 'skipped' END").alias("status"), F.expr("CASE WHEN value > 20 THEN 'e' END").alias("error"), F.expr("CASE WHEN user_id % 2 = 0 THEN 'a' END").alias("artifact"))
    return control.inconsistent_results(r).select("event_id", "status")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority NOT LIKE '1%'")
def invalid_accessions(spark, d):
    return control.invalid_accessions(_table(spark, d, "orders"), "o_orderpriority", "1").select("o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'completed' ELSE o_orderstatus END AS status, CASE WHEN o_totalprice > 200000 THEN o_orderdate END AS finished_at FROM orders")
def step_update(spark, d):
    steps = _table(spark, d, "orders").withColumn("status", F.col("o_orderstatus")).withColumn("finished_at", F.lit(None).cast("timestamp_ntz"))
    return control.set_status(steps, F.col("o_totalprice") > 200000, "completed", F.col("o_orderdate").cast("timestamp_ntz")).select("o_orderkey", "status", "finished_at")


@query("SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def new_artifacts(spark, d):
    p = _table(spark, d, "pages").select("page_id", "url")
    return control.new_artifacts(p, p.where("page_id % 3 = 0"), "url")


@query("SELECT n_name FROM nation WHERE lower(n_name) || '.pt' NOT IN (SELECT lower(n_name) || '.pt' FROM nation WHERE n_nationkey % 2 = 0)")
def models_to_fetch(spark, d):
    n = _table(spark, d, "nation")
    return control.without_file(n.select("n_name"), n.where("n_nationkey % 2 = 0").select(F.concat(F.lit("/m/"), F.lower("n_name"), F.lit(".pt")).alias("path")), "n_name", "path")


@query("SELECT s_name FROM supplier WHERE s_name || '_proc' NOT IN (SELECT s_name || '_proc' FROM supplier WHERE s_suppkey % 4 = 0)")
def unformatted_files(spark, d):
    s = _table(spark, d, "supplier")
    return catalog.pending(s.select("s_name"), s.where("s_suppkey % 4 = 0").select(F.concat("s_name", F.lit("_proc")).alias("path")), "s_name", "path")


@query("WITH s AS (SELECT DISTINCT user_id, event_type AS step, CASE WHEN user_id % 2 = 0 THEN 'completed' ELSE 'running' END AS status FROM events), p AS (SELECT user_id, list_sort(list(step || '=' || status)) AS p FROM s GROUP BY 1) SELECT user_id, array_to_string(p, ', ') AS steps, CASE WHEN list_contains(p, 'click=completed') THEN 'LEGAL' ELSE 'ILLEGAL' END AS qc FROM p")
def state_summary(spark, d):
    steps = _table(spark, d, "events").select("user_id", F.col("event_type").alias("step"), F.when(F.col("user_id") % 2 == 0, "completed").otherwise("running").alias("status")).distinct()
    return control.state_summary(steps, "user_id", {"qc": "click"})


@query("SELECT 'partial' AS batch_status, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_failed FROM events")
def download_status(spark, d):
    return control.download_status(_table(spark, d, "events").select(F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status")))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS tokens FROM events")
def token_usage(spark, d):
    from ..streaming.events import token_usage as usage

    return _table(spark, d, "events").select("event_id", usage(F.col("props"), "$.usage.total", "$.k").alias("tokens"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_in_text(spark, d):
    return _table(spark, d, "events").select("event_id", T.json_object(F.concat(F.lit("answer: "), "props", F.lit(" .")), "$.k").alias("k"))


@query("SELECT o_custkey, sha256(string_agg(DISTINCT o_orderpriority, '' ORDER BY o_orderpriority)) AS id FROM orders GROUP BY 1")
def composite_ids(spark, d):
    return _table(spark, d, "orders").groupBy("o_custkey").agg(catalog.composite_id(F.collect_set("o_orderpriority")).alias("id"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN -1200500.0 WHEN 1 THEN 45.5 WHEN 2 THEN 1234.0 ELSE NULL END::DOUBLE AS number FROM customer")
def numeric_like(spark, d):
    shown = F.element_at(F.array(F.lit("($1,200.5K)"), F.lit("45.5%"), F.lit("€ 1,234"), F.lit("n/a")), (F.col("c_custkey") % 4 + 1).cast("int"))
    return _table(spark, d, "customer").select("c_custkey", T.numeric_like(shown).alias("number"))


@query("SELECT user_id, arg_min(event_type, (CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 END, event_id)) AS kind FROM events WHERE event_type IN ('view', 'click') GROUP BY 1")
def preferred_artifact(spark, d):
    first = catalog.keep_one(_table(spark, d, "events").where("event_type in ('view', 'click')").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id", last=False)
    return catalog.prefer(first, "user_id", "event_type", ["view", "click"]).select("user_id", F.col("event_type").alias("kind"))


@query("SELECT p_partkey FROM part WHERE list_contains(list_transform(string_split(p_type, ','), lambda x: contains(lower(x), 'eco')), true) OR p_brand IN ('Brand#13')")
def platform_predicate(spark, d):
    p = _table(spark, d, "part").withColumn("title", F.regexp_replace("p_type", "(?i)eco", "methy"))
    return p.where(catalog.is_methylation(F.col("title"), F.col("p_brand"), ["Brand#13"])).select("p_partkey")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'http_error' WHEN 'view' THEN CASE WHEN user_id % 2 = 0 THEN 'disk_full' ELSE 'filesystem_error' END WHEN 'error' THEN 'geo_parse_error' ELSE 'unknown_error' END AS category FROM events")
def error_classes(spark, d):
    kind = F.expr("CASE event_type WHEN 'click' THEN 'HTTPError' WHEN 'view' THEN 'OSError' WHEN 'error' THEN 'RuntimeError' ELSE 'Other' END")
    return _table(spark, d, "events").select("event_id", catalog.error_class(kind, F.when(F.col("user_id") % 2 == 0, 28).otherwise(2))["category"].alias("category"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '^http://', 'https://'), '[?#].*$', '') AS link FROM pages")
def https_links(spark, d):
    return _table(spark, d, "pages").select("page_id", files.https(F.regexp_replace("url", "^http://", "ftp://")).alias("link"))


@query("SELECT l_partkey AS probe FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def probe_intersection(spark, d):
    li = _table(spark, d, "lineitem")
    li = li.withColumnRenamed("l_partkey", "probe")
    return joins.in_both(li.where("l_returnflag = 'A'"), li.where("l_returnflag = 'R'"), "probe")


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def column_difference(spark, d):
    o = _table(spark, d, "orders")
    return joins.in_first_only(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "o_custkey")


@query("SELECT 'gse' || o_custkey::VARCHAR AS accession, min(o_orderkey) AS first FROM orders GROUP BY 1")
def uploaded_accessions(spark, d):
    return files.accessions_table(_table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("gse"), "o_custkey").alias("GSE")), "o_orderkey")


@query("SELECT DISTINCT o_orderpriority AS key_name, 'x' || o_orderpriority AS pattern FROM orders WHERE o_orderpriority LIKE '%H%'")
def overfitted_rules(spark, d):
    r = _table(spark, d, "orders").select(F.col("o_orderpriority").alias("key_name"), F.concat(F.lit("x"), "o_orderpriority").alias("pattern"), F.when(F.col("o_orderpriority").contains("H"), "resolved").otherwise("missing").alias("status")).distinct()
    return rules.overfitted(r).select("key_name", "pattern")


@query("SELECT doc_id, lang, quality FROM documents LEFT JOIN labels USING (doc_id)")
def left_predictions(spark, d):
    return joins.with_predictions(_table(spark, d, "documents").select("doc_id", "lang"), _table(spark, d, "labels").select("doc_id", "quality"), ["doc_id"])


@query(f"""WITH RECURSIVE {_match_sql("SELECT n_name AS v FROM nation UNION ALL SELECT n_nationkey::VARCHAR FROM nation", "SELECT lower(n_name) AS v FROM nation")},
o AS (SELECT CASE WHEN regexp_matches(a, '^[0-9]+$') THEN 'number' ELSE 'name' END AS field, score FROM s)
SELECT field, round(max(score), 6) AS score FROM o GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""")
def best_subject_field(spark, d):
    n = _table(spark, d, "nation")
    candidates = n.select(F.lit("name").alias("field"), F.col("n_name").alias("v")).unionByName(n.select(F.lit("relation").alias("field"), F.lower("n_name").alias("v"))).unionByName(n.select(F.lit("number").alias("field"), F.col("n_nationkey").cast("string").alias("v")))
    return lexical.best_field(candidates, n.select(F.lower("n_name").alias("t")), "field", "v", "t").withColumn("score", F.round("score", 6))


# what a user asked first as the label, items with their texts as the terms
_BM25 = r"""WITH t AS (SELECT DISTINCT {term} AS term, {text} AS text FROM {terms}),
w AS (SELECT term, text, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM t),
g AS (SELECT term, text, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) > 0),
n AS (SELECT count(*) AS texts, avg(len(g)) AS mean FROM g), u AS (SELECT term, text, len(g) AS length, unnest(g) AS gram FROM g),
c AS (SELECT term, text, length, gram, count(*) AS tf FROM u GROUP BY 1, 2, 3, 4), f AS (SELECT gram, count(*) AS df FROM c GROUP BY 1),
p AS (SELECT term, text, gram, ln(1 + (texts - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)) AS weight FROM c JOIN f USING (gram), n),
l AS (SELECT DISTINCT {label} AS label FROM {labels}), lw AS (SELECT label, list_filter(regexp_split_to_array(lower(label), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM l),
q AS (SELECT label, unnest(list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))) AS gram FROM lw),
s AS (SELECT label, term, text, sum(weight) AS score FROM q JOIN p USING (gram) GROUP BY 1, 2, 3), b AS (SELECT label, term, round(max(score), 9) AS score FROM s GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, term) AS rank FROM b)
SELECT label, rank, term, round(score, 6) AS score FROM r WHERE rank <= 5"""


@query(_BM25.format(term="item_id", text="text", terms="benchmark", label="text", labels="conversations WHERE turn = 0"))
def ontology_candidates(spark, d):
    labels = _table(spark, d, "conversations").where("turn = 0").select(F.col("text").alias("label"))
    terms = _table(spark, d, "benchmark").select(F.col("item_id").alias("term"), "text")
    return harmonize.ontology_top(labels, terms).withColumn("score", F.round("score", 6))


@query(_BM25.format(term="p_brand", text="p_name || ' ' || p_type", terms="part", label="lower(p_type) || ' ' || p_size || ' ' || p_name", labels="part"))
def terms_with_synonyms(spark, d):
    p = _table(spark, d, "part")
    terms = p.select(F.col("p_brand").alias("term"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    labels = p.select(F.concat_ws(" ", F.lower("p_type"), F.col("p_size").cast("string"), "p_name").alias("label"))
    return harmonize.ontology_top(labels, terms).withColumn("score", F.round("score", 6))


@query(r"SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[^\w\s-]', '', 'g'), '[-\s]+', '-', 'g'), '-_') AS slug FROM part")
def slugs(spark, d):
    return _table(spark, d, "part").select("p_partkey", T.slugify(F.col("p_name")).alias("slug"))


@query("SELECT p_partkey, p_brand, lower(regexp_extract(p_brand, '^[^0-9]*')) || lpad(regexp_extract(p_brand, '[0-9]+$'), 20, '0') AS sort_key FROM part")
def table_sort(spark, d):
    keyed = _table(spark, d, "part").select("p_partkey", "p_brand", catalog.natural_key(F.col("p_brand")).alias("sort_key"))
    return keyed.orderBy(F.col("sort_key").asc_nulls_last(), "p_partkey")


# ---- joins of results, ingest of files


@query("SELECT o_orderkey, c_acctbal AS value FROM customer JOIN orders ON c_custkey = o_custkey")
def rekeyed_by_subject(spark, d):
    values = _table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("value"))
    return joins.by_sample(values, _table(spark, d, "orders"), "c_custkey", "o_custkey", "o_orderkey").select("o_orderkey", "value")


@query("WITH p AS (SELECT l_orderkey, sum(l_quantity) AS a FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), q AS (SELECT l_orderkey, sum(l_quantity) AS b FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT l_orderkey, a, b FROM p JOIN q USING (l_orderkey)")
def merged_predictions(spark, d):
    li = _table(spark, d, "lineitem")
    parts = [li.where(F.col("l_returnflag") == flag).select("l_orderkey", "l_quantity").repartition("l_orderkey").groupBy("l_orderkey").agg(F.sum("l_quantity").alias(name)) for flag, name in (("A", "a"), ("R", "b"))]
    return joins.merged(parts, ["l_orderkey"])


@query("SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
def key_union(spark, d):
    return joins.in_either(_table(spark, d, "orders").select(F.col("o_custkey").alias("k")), _table(spark, d, "customer").select(F.col("c_custkey").alias("k")), "k")


@query("SELECT l_returnflag AS dataset, count(*) AS n, round(avg(pow(l_quantity - l_discount * 100, 2)), 6) AS mse, round(1 - avg(pow(l_quantity - l_discount * 100, 2)) / var_pop(l_discount * 100), 6) AS r2 FROM lineitem GROUP BY 1")
def squared_errors(spark, d):
    rows = _table(spark, d, "lineitem").select(F.col("l_returnflag").alias("dataset"), F.col("l_quantity").alias("predicted"), (F.col("l_discount") * 100).alias("age"))
    return evaluate.squared_errors(rows, ["dataset"]).select("dataset", "n", F.round("mse", 6).alias("mse"), F.round("r2", 6).alias("r2"))


@query("SELECT f AS field, count(*) AS n_samples, count(v) AS present, count(*) - count(v) AS missing, count(v) / count(*) AS parse_rate, count(DISTINCT v) AS unique_values FROM (SELECT unnest(['quality', 'toxic']) AS f, unnest([quality, toxic]) AS v FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1")
def metadata_summary(spark, d):
    rows = joins.with_predictions(_table(spark, d, "documents").select("doc_id"), _table(spark, d, "labels"), ["doc_id"])
    return profile.metadata_summary(rows, "doc_id", ["quality", "toxic"]).drop("examples")


@query("SELECT event_id, strftime(ts, '%Y%m%dT%H%M%S') || '-' || sha256(event_id::VARCHAR)[1:8] AS run FROM events")
def run_ids(spark, d):
    return _table(spark, d, "events").select("event_id", catalog.run_id(F.col("ts"), F.col("event_id")).alias("run"))


@query("SELECT event_id, '[' || event_type || '] OSError: ' || props AS message FROM events")
def developer_messages(spark, d):
    return _table(spark, d, "events").select("event_id", catalog.developer_message(F.lit("OSError"), F.col("props"), F.col("event_type")).alias("message"))


@query(f"SELECT 'study' AS accession, 's' || lpad(sample_id::VARCHAR, 8, '0') || '_beta' AS sample_id, 'cg' || lpad(probe::VARCHAR, 4, '0') AS probe, value FROM ({_CELLS})")
def delimited_ingest(spark, d):
    """The matrix written as a delimited file with a comment and a header, found out and read back."""
    cells = _cells(spark, d)
    names = cells.select(F.format_string("s%08d_Beta", "sample_id").alias("n")).distinct()
    head = names.agg(F.concat(F.lit("ID_REF\t"), F.array_join(F.array_sort(F.collect_list("n")), "\t")).alias("value"), F.lit(-1).alias("o"))
    row = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sample_id", "value"))), lambda x: x["value"].cast("string")), "\t")
    rows = cells.groupBy("probe").agg(row.alias("r")).select(F.concat(F.format_string("cg%04d", "probe"), F.lit("\t"), "r").alias("value"), F.col("probe").alias("o"))
    comment = spark.createDataFrame([("# processed values", -2)], "value string, o int")
    path = shared.folder(spark, "delimited")
    comment.unionByName(head).unionByName(rows).repartitionByRange("o").sortWithinPartitions("o").select("value").write.text(path)
    return delimited.format_matrix(spark, path, accession="study", detection_pattern=None)


def _soft_file(spark, d):
    n = _table(spark, d, "customer")
    lines = [
        F.concat(F.lit("^SAMPLE = GSM"), "c_custkey"), F.concat(F.lit("!Sample_title = "), "c_name"), F.concat(F.lit("!Sample_characteristics_ch1 = age: "), "c_nationkey"), F.concat(F.lit("!Sample_characteristics_ch1 = segment: "), "c_mktsegment"),
        F.lit("!sample_table_begin"), F.lit("ID_REF\tVALUE\tDetection Pval"), F.concat(F.lit("cg1\t"), (F.col("c_nationkey") / 100).cast("string"), F.lit("\t0.01")), F.concat(F.lit("cg2\t"), (F.col("c_custkey") / 10).cast("string"), F.lit("\t"), F.when(F.col("c_nationkey") > 12, "0.2").otherwise("0.05")), F.lit("!sample_table_end"),
    ]
    path = shared.folder(spark, "soft")
    n.coalesce(1).sortWithinPartitions("c_custkey").select(F.explode(F.array(*lines)).alias("value")).write.text(path)
    return soft.lines(spark, path)


@query("SELECT 'GSM' || c_custkey::VARCHAR AS sample_id, 'cg1' AS probe, c_nationkey / 100 AS value FROM customer UNION ALL SELECT 'GSM' || c_custkey::VARCHAR, 'cg2', c_custkey / 10 FROM customer WHERE c_nationkey <= 12")
def soft_probe_tables(spark, d):
    return soft.probe_tables(_soft_file(spark, d)).select("sample_id", "probe", "value")


@query("SELECT 'GSM' || c_custkey::VARCHAR AS name, c_name AS title, 'age: ' || c_nationkey::VARCHAR || '|segment: ' || c_mktsegment AS characteristics FROM customer")
def soft_metadata(spark, d):
    fields = soft.sample_metadata(_soft_file(spark, d))
    return fields.select("name", F.col("fields")["title"][0].alias("title"), F.array_join(F.col("fields")["characteristics_ch1"], "|").alias("characteristics"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def csv_round_trip(spark, d):
    path = shared.folder(spark, "csv")
    files.write_csv(_table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    return files.read_csv(spark, path, "c_custkey bigint, c_name string, c_acctbal double")


@query("SELECT p_partkey, p_name, p_size FROM part")
def json_round_trip(spark, d):
    path = shared.folder(spark, "json")
    files.write_json(_table(spark, d, "part").select("p_partkey", "p_name", "p_size"), path)
    return spark.read.schema("p_partkey bigint, p_name string, p_size int").json(path)


@query(_CELLS)
def matrix_round_trip(spark, d):
    path = shared.folder(spark, "matrix")
    files.write_matrix(_cells(spark, d), path)
    read = files.read_first(spark, [path + "-after-control", path])
    return read.select(F.col("accession").cast("string").alias("accession"), "sample_id", "probe", "value")


@query("SELECT 'all' AS accession, 'A Value' AS sample_id, c_custkey::VARCHAR AS probe, c_nationkey::DOUBLE AS value FROM customer WHERE c_nationkey % 10 < 5 UNION ALL SELECT 'all', 'B Value', c_custkey::VARCHAR, c_custkey::DOUBLE FROM customer WHERE c_custkey % 10 < 5")
def positional_pairs(spark, d):
    shown = lambda k, name: [F.col(k).cast("string").alias(f"{name} Value"), (F.col(k) % 10 / 100).cast("string").alias(f"{name} Detection_Pval")]
    wide = _table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("ID"), *shown("c_nationkey", "A"), *shown("c_custkey", "B"))
    pairs = delimited.pairs_by_position(wide.columns, "value", "detection")
    return delimited.to_long(wide, "ID", list(pairs), pairs).where("value is not null")


@query("SELECT 'CG' || p_partkey::VARCHAR AS probe FROM part")
def platform_probes(spark, d):
    table = _table(spark, d, "part").select("p_name", "p_size", F.concat(F.lit("CG"), "p_partkey").alias("ID"))
    return table.select(F.col(delimited.platform_probe_column(table)).alias("probe"))


# ---- rules, reviews and logs


@query("SELECT n_name AS concept FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey % 3 = 0 AND n_nationkey BETWEEN 1 AND 23")
def poorly_parsed(spark, d):
    n = _table(spark, d, "nation")
    status = n.select(F.col("n_name").alias("concept"), F.when(F.col("n_nationkey") % 2 == 0, "resolved").otherwise("missing").alias("status"))
    failed = F.when(F.col("n_nationkey") % 3 == 0, F.array("n_name")).otherwise(F.array().cast("array<string>"))
    coverage = n.select(F.col("n_name").alias("concept"), (F.col("n_nationkey") / 24).alias("parse_rate"), failed.alias("failures"))
    return rules.poorly_parsed(status, coverage).select("concept")


@query("SELECT DISTINCT lower(c_mktsegment) AS key FROM customer")
def discovered_keys(spark, d):
    values = F.array(F.concat(F.lower("c_mktsegment"), F.lit(": "), "c_name"), F.lit("no pair"))
    return rules.keys(_table(spark, d, "customer").select(values.alias("values")), "values")


@query("SELECT p_brand AS concept, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS examples FROM part WHERE p_size < 10 GROUP BY 1")
def failure_examples(spark, d):
    failed = F.when(F.col("p_size") < 10, F.struct(F.col("p_brand").alias("concept"), F.col("p_type").alias("raw")))
    found = rules.failures(_table(spark, d, "part").select(F.array_compact(F.array(failed)).alias("failures")))
    return found.select("concept", F.array_join("examples", "|").alias("examples"))


@query("SELECT o_orderkey AS review_id, coalesce(arg_max(l_returnflag, (l_partkey, l_returnflag)), 'pending') AS decision FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag <> 'N') ON l_orderkey = o_orderkey GROUP BY 1")
def review_decisions(spark, d):
    decisions = _table(spark, d, "lineitem").where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("review_id"), "l_partkey", F.col("l_returnflag").alias("decision"))
    return control.reviewed(_table(spark, d, "orders").select(F.col("o_orderkey").alias("review_id")), decisions, "review_id", "l_partkey")


@query("SELECT event_type AS thread_id, ts AS timestamp, event_id::VARCHAR AS run_id FROM events WHERE event_type IN ('click', 'error')")
def thread_logs(spark, d):
    path = shared.folder(spark, "threads")
    event_log.write_by_thread(_table(spark, d, "events").select(F.col("event_type").alias("thread_id"), F.col("ts").alias("timestamp"), F.col("event_id").cast("string").alias("run_id")), path)
    return event_log.in_order(event_log.read_threads(spark, path, "click", "error"), "run_id").select("thread_id", "timestamp", "run_id")


# ---- samples, layers and lookups


@query("""WITH v AS (SELECT DISTINCT user_id, event_type, event_id::VARCHAR AS value FROM events), m AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY md5('0:' || user_id || ':' || event_type || ':' || value), value) AS place FROM v)
SELECT user_id, event_type, place, value FROM m WHERE place <= 3""")
def examples_per_key(spark, d):
    return profile.examples(_table(spark, d, "events"), ["user_id", "event_type"], "event_id", 3)


_LAYER = "SELECT 'net' AS model, 0 AS layer, p::VARCHAR AS source, u::VARCHAR AS target, ((p * 7 + u * 13) % 11 - 5) / 10.0 AS weight FROM range(64) a(p), range(5) b(u)"


@query(f"""WITH c AS ({_CELLS}), w AS ({_LAYER}),
h AS (SELECT accession, sample_id, target, sum(value * weight) + (target::INT - 2) / 10.0 AS x FROM c JOIN w ON probe::VARCHAR = source GROUP BY 1, 2, 3),
a AS (SELECT accession, sample_id, target::INT AS u, greatest(x, 0.0) AS y FROM h)
SELECT accession, sample_id, 'net' AS model, o::VARCHAR AS unit, round(tanh(sum(y * ((u * 3 + o) % 4 - 1.5)) + 0.1), 6) AS predicted FROM a, range(2) r(o) GROUP BY accession, sample_id, o""")
def layered_model(spark, d):
    one = lambda n, name: spark.range(n).select(F.col("id").alias(name))
    first = one(64, "p").join(one(5, "u"), F.lit(True)).select(F.lit(0).alias("layer"), F.col("p").cast("string").alias("source"), F.col("u").cast("string").alias("target"), (((F.col("p") * 7 + F.col("u") * 13) % 11 - 5) / 10.0).alias("weight"))
    second = one(5, "u").join(one(2, "o"), F.lit(True)).select(F.lit(1).alias("layer"), F.col("u").cast("string").alias("source"), F.col("o").cast("string").alias("target"), ((F.col("u") * 3 + F.col("o")) % 4 - 1.5).alias("weight"))
    biases = one(5, "u").select(F.lit(0).alias("layer"), F.col("u").cast("string").alias("target"), ((F.col("u") - 2) / 10.0).alias("bias"), F.lit("relu").alias("activation"))
    biases = biases.unionByName(one(2, "o").select(F.lit(1).alias("layer"), F.col("o").cast("string").alias("target"), F.lit(0.1).alias("bias"), F.lit("tanh").alias("activation")))
    named = lambda df: df.withColumn("model", F.lit("net"))
    return layers.predict(_cells(spark, d), named(first.unionByName(second)), named(biases), 4, 4).withColumn("predicted", F.round("predicted", 6))


@query(f"""WITH c AS ({_CELLS}), s AS (SELECT DISTINCT accession, sample_id FROM c), w AS (SELECT unnest(range(58, 70)) AS probe)
SELECT s.accession, s.sample_id, w.probe, round(value, 6) AS value FROM s CROSS JOIN w LEFT JOIN c ON c.accession = s.accession AND c.sample_id = s.sample_id AND c.probe = w.probe""")
def aligned_to_model(spark, d):
    long = _cells(spark, d)
    return matrix.align(long, long, spark.range(58, 70).select(F.col("id").alias("probe"))).select("accession", "sample_id", "probe", F.round("value", 6).alias("value"))


@query("SELECT * FROM nation")
def first_readable(spark, d):
    return files.read_first(spark, [f"{d}/no-such-table.parquet", f"{d}/nation.parquet", f"{d}/region.parquet"])


@query("""SELECT 'quality' AS field, round(count(quality) / count(*), 9) AS parse_rate FROM documents LEFT JOIN labels USING (doc_id)
UNION ALL SELECT 'lang', round(count(lang) / count(*), 9) FROM documents UNION ALL SELECT 'absent', 0.0""")
def parse_rates(spark, d):
    j = _table(spark, d, "documents").select("doc_id", "lang").join(_table(spark, d, "labels"), "doc_id", "left")
    return profile.parse_rates(profile.coverage(j, ["lang", "quality", "toxic"], "doc_id"), ["quality", "lang", "absent"]).withColumn("parse_rate", F.round("parse_rate", 9))


@query("""WITH t AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'building' WHEN 'MACHINERY' THEN 'machines' ELSE c_mktsegment END AS segment, CASE c_nationkey % 3 WHEN 0 THEN 'zero' WHEN 1 THEN 'BUILDING' ELSE '2' END AS third FROM customer)
SELECT c_custkey, segment, third FROM t""")
def combined_maps(spark, d):
    maps = {
        "segment": spark.createDataFrame(_LABELS, _MAP),
        "third": spark.createDataFrame([("0", "zero", 1), ("1", "BUILDING", 2)], _MAP),  # a target that is a source of the other concept
    }
    c = _table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), (F.col("c_nationkey") % 3).cast("string").alias("third"))
    return harmonize.rewrite(c, harmonize.combine(maps), [("segment", "segment"), ("third", "third")])


@query("""WITH g AS (SELECT * FROM (VALUES ('BUILDING', 'Brain'), ('MACHINERY', 'Heart')) v(source_label, target)) SELECT DISTINCT c_mktsegment AS label FROM customer WHERE c_mktsegment NOT IN (SELECT source_label FROM g)""")
def unmapped_labels(spark, d):
    labels = profile.labels(_table(spark, d, "customer"), "c_mktsegment")
    return harmonize.unmapped(labels, spark.createDataFrame([("BUILDING", "Brain"), ("MACHINERY", "Heart")], "source_label string, target string"))
