"""Stump ensembles as tables: scoring, attribution, import from model files."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.exprs import ratio

STUMP_SCHEMA = ("horizon string, tree_id int, feature string, threshold double, default_left boolean, "
                "w_left double, w_right double, h_left double, h_right double")


def stumps_from_json(spark: SparkSession, documents: dict[str, str]) -> tuple[DataFrame, dict[str, float]]:
    """Depth-one trees of boosted-tree JSON documents (text per horizon) as a table, and base scores.

    Single-leaf trees become stumps whose two sides carry the same weight. Model files
    are small; only their text passes through the driver.
    """
    rows, base = [], {}
    for horizon, text in documents.items():
        learner = json.loads(text)["learner"]
        names = learner["feature_names"]
        base[horizon] = float(str(learner["learner_model_param"]["base_score"]).strip("[]"))
        for tree in learner["gradient_booster"]["model"]["trees"]:
            left, right = tree["left_children"][0], tree["right_children"][0]
            if left == -1:
                leaf = float(tree["split_conditions"][0])
                rows.append((horizon, int(tree["id"]), names[0], 0.0, True, leaf, leaf, 1.0, 1.0))
                continue
            if len(tree["left_children"]) != 3:
                raise ValueError("only trees of depth one are supported")
            cond, hess = tree["split_conditions"], tree["sum_hessian"]
            rows.append((horizon, int(tree["id"]), names[tree["split_indices"][0]], float(cond[0]),
                         bool(tree["default_left"][0]), float(cond[left]), float(cond[right]),
                         float(hess[left]), float(hess[right])))
    return spark.createDataFrame(rows, STUMP_SCHEMA), base


def leaf_values(panel: DataFrame, stumps: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    """One row per (row, stump): the leaf weight reached. Values compare as float32; a missing
    value takes the default side. The stump table is a model, so it is small next to the panel."""
    long = panel.select(*ids, *[F.col(c).cast("double").alias(c) for c in features]).unpivot(
        list(ids), list(features), "feature", "_x")
    j = long.join(stumps, "feature")
    x = F.col("_x").cast("float")
    left = F.when(F.col("_x").isNull(), F.col("default_left")).otherwise(x < F.col("threshold").cast("float"))
    return j.withColumn("leaf", F.when(left, F.col("w_left")).otherwise(F.col("w_right")))


def compiled(stumps: DataFrame) -> DataFrame:
    """The whole ensemble as one row: per horizon a map from feature to its stumps.

    A model file bounds its size, so this single row is what gets broadcast.
    """
    mean = ratio(F.col("w_left") * F.col("h_left") + F.col("w_right") * F.col("h_right"), F.col("h_left") + F.col("h_right"), 0.0)
    leaf = F.struct(F.col("threshold").cast("float").alias("t"), F.col("default_left").alias("d"), F.col("w_left").alias("l"),
                    F.col("w_right").alias("r"), mean.alias("m"))
    per = stumps.groupBy("horizon", "feature").agg(F.collect_list(leaf).alias("s"))
    hz = per.groupBy("horizon").agg(F.map_from_entries(F.collect_list(F.struct("feature", "s"))).alias("f"))
    return hz.agg(F.collect_list(F.struct("horizon", "f")).alias("_model"))


def _leaf_sum(h: Column, feature: str, centred: bool) -> Column:
    """Sum of the leaves one feature's value reaches, less their means if ``centred``."""
    x = F.col(feature).cast("double").cast("float")
    def one(acc: Column, s: Column) -> Column:
        left = F.when(x.isNull(), s["d"]).otherwise(x < s["t"])
        v = F.when(left, s["l"]).otherwise(s["r"])
        return acc + (v - s["m"] if centred else v)
    return F.coalesce(F.aggregate(F.try_element_at(h["f"], F.lit(feature)), F.lit(0.0), one), F.lit(0.0))


def score_stumps(panel: DataFrame, stumps: DataFrame, ids: Sequence[str], features: Sequence[str],
                 base: dict[str, float] | None = None) -> DataFrame:
    """Base plus the sum of leaves per row and horizon, row by row without a shuffle."""
    def total(h: Column) -> Column:
        out = F.lit(0.0)
        for f in features:
            out = out + _leaf_sum(h, f, False)
        return F.struct(h["horizon"].alias("horizon"), out.alias("s"))
    d = panel.crossJoin(F.broadcast(compiled(stumps))).select(*ids, F.explode(F.transform("_model", total)).alias("_h"))
    return d.select(*ids, F.col("_h.horizon").alias("horizon"), F.col("_h.s").alias("_sum")).select(
        *ids, "horizon", (F.col("_sum") + _base(base)).alias("score"))


def add_predictions(panel: DataFrame, stumps: DataFrame, features: Sequence[str], base: dict[str, float] | None = None,
                    horizons=("1d", "3d", "5d"), prefix="pred_") -> DataFrame:
    """M18 as columns: one prediction per horizon beside the panel row (0 without a model)."""
    d = panel.crossJoin(F.broadcast(compiled(stumps)))
    def at(hz: str) -> Column:
        h = F.get(F.filter("_model", lambda m: m["horizon"] == hz), F.lit(0))
        out = F.lit(float((base or {}).get(hz, 0.0)))
        for f in features:
            out = out + _leaf_sum(h, f, False)
        return F.when(h.isNotNull(), out).otherwise(0.0)
    return d.withColumns({f"{prefix}{hz}": at(hz) for hz in horizons}).drop("_model")


def _base(base: dict[str, float] | None):
    if not base:
        return F.lit(0.0)
    m = F.create_map(*[F.lit(x) for kv in base.items() for x in kv])
    return F.coalesce(F.try_element_at(m, F.col("horizon")), F.lit(0.0))


def attributions(panel: DataFrame, stumps: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Additive attribution of depth-one trees: leaf minus hessian-weighted mean leaf, per
    feature the model uses."""
    def per(h: Column) -> Column:
        cells = F.array(*[
            F.when(F.try_element_at(h["f"], F.lit(f)).isNotNull(), F.struct(
                h["horizon"].alias("horizon"), F.lit(f).alias("feature"), _leaf_sum(h, f, True).alias("attribution")))
            for f in features])
        return F.filter(cells, lambda c: c.isNotNull())
    d = panel.crossJoin(F.broadcast(compiled(stumps))).select(*ids, F.explode(F.flatten(F.transform("_model", per))).alias("_c"))
    return d.select(*ids, "_c.horizon", "_c.feature", "_c.attribution")


def expected_value(stumps: DataFrame, base: dict[str, float] | None = None) -> DataFrame:
    mean = ratio(F.col("w_left") * F.col("h_left") + F.col("w_right") * F.col("h_right"), F.col("h_left") + F.col("h_right"), 0.0)
    return stumps.groupBy("horizon").agg(F.sum(mean).alias("_m")).select("horizon", (F.col("_m") + _base(base)).alias("expected"))


def family_shares(attr: DataFrame, families: dict[str, Sequence[str]], ids: Sequence[str]) -> DataFrame:
    """Attribution per feature family and its share of the total magnitude."""
    m = F.create_map(*[F.lit(x) for fam, fs in families.items() for f in fs for x in (f, fam)])
    g = attr.withColumn("family", F.coalesce(F.try_element_at(m, F.col("feature")), F.lit("other"))).groupBy(
        *ids, "horizon", "family").agg(F.sum("attribution").alias("attribution"))
    tot = g.groupBy(*ids, "horizon").agg(F.sum(F.abs("attribution")).alias("_t"))
    return g.join(tot, [*ids, "horizon"]).select(
        *ids, "horizon", "family", "attribution", ratio(F.abs("attribution") * 100.0, F.col("_t"), 0.0).alias("share_pct"))


def mean_abs_attribution(attr: DataFrame) -> DataFrame:
    return attr.groupBy("horizon", "feature").agg(F.avg(F.abs("attribution")).alias("mean_abs"))
