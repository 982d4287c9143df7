"""Models of dense layers over a long matrix, from tables of weights.

``weights``: model, layer, source, target, weight; ``biases``: model, layer, target, bias,
activation.  The sources of layer 0 are probes, those of later layers the targets (as text)
of the layer before.  The first layer, which has nearly all weights, is a product of blocks:
samples are dealt to blocks and probes to pieces, a task multiplies one by the other, and the
partial sums of the pieces are added up.  Later layers have as many inputs as the layer before
has units, so a join and a sum do.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parameters: blocks of samples and pieces of probes that the first layer is dealt to.
SAMPLE_BLOCKS, PROBE_PIECES = 64, 64
ACTIVATIONS = ("identity", "relu", "selu", "tanh", "sigmoid")


def activate(x: Column, name: Column) -> Column:
    """A layer's function by its name; an unknown one makes the query fail."""
    scale, alpha = 1.0507009873554805, 1.6732632423543772  # fixed values of the published SELU
    # exp is held below its overflow, which no branch that uses it reaches
    small = F.exp(F.least(x, F.lit(0.0)))
    return (
        F.when(name == "identity", x).when(name == "relu", F.greatest(x, F.lit(0.0))).when(name == "selu", scale * F.when(x > 0, x).otherwise(alpha * (small - 1)))
        .when(name == "tanh", F.tanh(x)).when(name == "sigmoid", 1 / (1 + F.exp(-x)))
        .otherwise(F.raise_error(F.concat(F.lit("unknown activation "), name)).cast("double"))
    )


def _first(long: DataFrame, weights: DataFrame, blocks: int, pieces: int) -> DataFrame:
    """``model, accession, sample_id, target, x``: partial sums of the first layer, a row a piece of probes."""
    probe = F.col("probe").cast("string")
    cells = long.select("accession", "sample_id", probe.alias("probe"), "value", F.pmod(F.xxhash64("accession", "sample_id"), F.lit(blocks)).alias("block"), F.pmod(F.xxhash64(probe), F.lit(pieces)).alias("piece"))
    cells = cells.join(weights.select(F.col("source").alias("probe")).distinct(), "probe", "left_semi").where("value is not null")
    source = F.col("source")
    spread = weights.select("model", "source", "target", "weight", F.pmod(F.xxhash64(source), F.lit(pieces)).alias("piece"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"))
    kinds = [long.schema[c].dataType.simpleString() for c in ("accession", "sample_id")]
    schema = f"model string, accession {kinds[0]}, sample_id {kinds[1]}, target string, x double"

    def product(values: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
        if not len(values) or not len(w):
            return pd.DataFrame(columns=["model", "accession", "sample_id", "target", "x"])
        probes, column = np.unique(w["source"].astype(str), return_inverse=True)
        units = w.groupby(["model", "target"], sort=True).ngroup().to_numpy()
        names = w[["model", "target"]].assign(u=units).drop_duplicates("u").sort_values("u")
        dense = np.zeros((len(probes), len(names)))
        np.add.at(dense, (column, units), w["weight"].to_numpy(float))
        rows = values.groupby(["accession", "sample_id"], sort=True, dropna=False).ngroup().to_numpy()
        samples = values[["accession", "sample_id"]].assign(r=rows).drop_duplicates("r").sort_values("r")
        x = np.zeros((len(samples), len(probes)))
        np.add.at(x, (rows, np.searchsorted(probes, values["probe"].astype(str))), values["value"].to_numpy(float))
        out = x @ dense
        r, u = (k.ravel() for k in np.indices(out.shape))
        pick = lambda df, c, at: df[c].astype(object).to_numpy()[at]
        return pd.DataFrame({"model": pick(names, "model", u), "accession": pick(samples, "accession", r), "sample_id": pick(samples, "sample_id", r), "target": pick(names, "target", u), "x": out.ravel()})

    return cells.groupBy("block", "piece").cogroup(spread.groupBy("block", "piece")).applyInPandas(product, schema)


def predict(long: DataFrame, weights: DataFrame, biases: DataFrame, blocks: int = SAMPLE_BLOCKS, pieces: int = PROBE_PIECES) -> DataFrame:
    """``accession, sample_id, model, unit, predicted``: the last layer's units of every model and sample.

    Inputs are complete (see ``impute.cascade``): a missing or null cell counts as 0.  A unit
    without weights that reach it gives its bias through its activation.  Samples without any
    cell have no rows.  All models, of any depths, are worked out together, a layer at a time.
    """
    depth = biases.agg(F.max("layer")).first()[0]
    if depth is None:
        raise ValueError("no layers")
    samples = long.select("accession", "sample_id").distinct()
    weights = weights.select("model", "layer", F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"), "weight")
    biases = biases.select("model", "layer", F.col("target").cast("string").alias("target"), "bias", "activation")
    last = biases.groupBy("model").agg(F.max("layer").alias("depth"))
    done, values = [], None
    for layer in range(depth + 1):
        w = weights.where(F.col("layer") == layer).drop("layer")
        if layer == 0:
            sums = _first(long, w, blocks, pieces)
        else:
            sums = values.join(w.withColumnRenamed("target", "next"), (values["model"] == w["model"]) & (F.col("target") == F.col("source"))).select(values["model"], "accession", "sample_id", F.col("next").alias("target"), (F.col("y") * F.col("weight")).alias("x"))
        sums = sums.groupBy("model", "accession", "sample_id", "target").agg(F.sum("x").alias("x"))
        units = samples.join(biases.where(F.col("layer") == layer).drop("layer"), F.lit(True))  # the size of the layer's result
        met = units.join(sums, ["model", "accession", "sample_id", "target"], "left")
        values = met.select("model", "accession", "sample_id", "target", activate(F.coalesce("x", F.lit(0.0)) + F.col("bias"), F.col("activation")).alias("y"))
        ends = values.join(last.where(F.col("depth") == layer).select("model"), "model", "left_semi")
        done.append(ends)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("accession", "sample_id", "model", F.col("target").alias("unit"), F.col("y").alias("predicted"))
