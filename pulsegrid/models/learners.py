"""Model studies on the batched booster (stumps, walk-forward, shuffles with refit, learning curves) and logistic models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.models import boosting
from pulsegrid.session import settle


def train_horizon(panel: DataFrame, features: Sequence[str], target: str, *, val_start: str, test_start: str, gate=5,
                  count="post_count_1d", weight="sample_weight", time="date", n_trees=1000, patience=50, horizon="5d") -> DataFrame:
    """Stumps with pseudo-Huber loss. A scout on rows before the validation period stops when the validation IC
    no longer rises; the model is refitted on all training rows with that many trees and judged per period.

    Rows per period: ``period, n_trees, n, ic, accuracy, positive, mean, spread, stumps``.
    """
    v, t = F.lit(val_start).cast("date"), F.lit(test_start).cast("date")
    rows = panel.where(F.col(count) >= gate)
    groups = {"pre": F.col(time) < v, "val": (F.col(time) >= v) & (F.col(time) < t), "train": F.col(time) < t, "test": F.col(time) >= t}
    fit = {"fit": horizon, "train": "train", "judge": {k: k for k in ("train", "val", "test")}, "scout": ["pre", "val", patience],
           "n_trees": n_trees, "features": list(features), "params": boosting.STUMPS | boosting.HORIZONS[horizon]}
    report = boosting.study(rows, features, target, groups, [fit], weight if weight in panel.columns else None)
    return report.withColumnRenamed("role", "period").withColumnRenamed("fit", "horizon")


def year_windows(panel: DataFrame, target: str, *, time="date", width=3) -> list[tuple[tuple[int, ...], tuple[int]]]:
    """Every window of ``width`` years with labelled rows and the year that follows it."""
    years = sorted(r[0] for r in panel.where(F.col(target).isNotNull()).select(F.year(time)).distinct().collect())
    return [(tuple(years[i - width:i]), (years[i],)) for i in range(width, len(years))]


def walk_forward_ics(panel: DataFrame, sets: dict[str, Sequence[str]], windows: Sequence[tuple[Sequence[int], Sequence[int]]],
                     target: str, *, time="date", n_trees=500, depth=4, min_train=100, min_test=30, params: dict | None = None) -> DataFrame:
    """IC of every feature set in every window, all fits in one plan. ICs are null where a side has too few rows."""
    y, features = F.year(time), list(dict.fromkeys(f for s in sets.values() for f in s if f in panel.columns))
    groups, fits = {}, []
    for i, (train_years, test_years) in enumerate(windows, 1):
        groups |= {f"train {i}": y.isin(list(train_years)), f"test {i}": y.isin(list(test_years))}
        for name, wanted in sets.items():
            avail = [f for f in wanted if f in panel.columns]
            if avail:
                fits.append({"fit": f"{i} {name}", "train": f"train {i}", "judge": {"train": f"train {i}", "test": f"test {i}"}, "n_trees": n_trees,
                             "features": avail, "params": (params or boosting.TREES) | {"depth": depth}})
    done = boosting.study(panel, features, target, groups, fits)
    key = [F.split("fit", " ", 2)[0].cast("int").alias("window"), F.split("fit", " ", 2)[1].alias("feature_set")]
    per = done.groupBy(*key).agg(*(F.max(F.when(F.col("role") == r, F.col(c))).alias(a) for r, c, a in (
        ("train", "n", "n_train"), ("test", "n", "n"), ("train", "ic", "train_ic"), ("test", "ic", "ic"))))
    enough = (F.col("n_train") >= min_train) & (F.col("n") >= min_test)
    return per.withColumn("ic", F.when(enough, F.col("ic")))


def refit_permutation(train: DataFrame, test: DataFrame, features: Sequence[str], shuffled: Sequence[str], target: str,
                      row_id: str, *, n=100, n_trees=500, depth=4, min_n=20) -> DataFrame:
    """IC on the test rows of models refitted on shuffled columns, which move together; all refits in one plan.

    ``row_id`` numbers the training rows 1..N. A replicate's shuffle is a keyed bijection of the positions.
    """
    ics = refit_ics(train, test, features, shuffled, target, row_id, n=n, n_trees=n_trees, depth=depth, min_n=min_n)
    real = F.max(F.when(F.col("replicate") == 0, F.col("ic")))
    null = F.col("replicate") > 0
    one = ics.crossJoin(F.broadcast(ics.agg(real.alias("real_ic")))).where(null)  # one row
    return one.agg(
        F.max("real_ic").alias("real_ic"), F.avg("ic").alias("perm_ic_mean"), F.stddev_pop("ic").alias("perm_ic_std"),
        F.avg((F.col("ic") >= F.col("real_ic")).cast("double")).alias("p_value"), F.count("*").alias("n_permutations"),
    ).withColumns({"stage_a_pass": F.col("p_value") < 0.10, "stage_b_pass": F.col("p_value") < 0.05})


def refit_ics(train: DataFrame, test: DataFrame, features: Sequence[str], shuffled: Sequence[str], target: str,
              row_id: str, *, n=100, n_trees=500, depth=4, min_n=20, params: dict | None = None) -> DataFrame:
    """``replicate, ic`` of the model (0) and of ``n`` refits on shuffled columns."""
    features = list(features)
    bins = boosting.bins_for(len(features))
    cut = lambda d, **only: boosting.code(features, edges, bins, **only)
    train = settle(train.where(F.col(target).isNotNull()).select(F.col(row_id).alias("_at"), target, *features), "train")
    total = train.count()
    edges = boosting.bin_edges(train, features, bins)
    y = F.col(target).cast("double").alias("target")
    rows = train.select((F.col("_at") - 1).alias("at"), cut(train, only=[f for f in features if f not in shuffled]).alias("kept"), cut(train, only=list(shuffled)).alias("moved"), y)
    real = train.select(F.lit("real").alias("group"), cut(train).alias("cell"), y)
    judged = test.where(F.col(target).isNotNull()).select(F.lit("test").alias("group"), cut(test).alias("cell"), y)
    every = real.unionByName(judged).unionByName(boosting.shuffled_cells(rows, total, n))
    cells = settle(boosting.cell_table(every, "target"), "cells")
    names = ["real", *(f"replicate {b}" for b in range(1, n + 1))]
    fits = [{"fit": g, "train": g, "judge": {"test": "test"}, "n_trees": n_trees, "features": features, "params": (params or boosting.TREES) | {"depth": depth}} for g in names]
    done = boosting.fit_all(cells, fits, features, bins, edges)
    number = F.when(F.col("fit") == "real", 0).otherwise(F.substring("fit", 11, 10).cast("int"))
    return settle(done.select(number.alias("replicate"), F.when(F.col("n") >= min_n, F.col("ic")).alias("ic")), "refits")


def _in_time_order(rows: DataFrame, time: str, ids: Sequence[str]) -> tuple[DataFrame, int]:
    """Rows numbered by time (ties by the other ids), and how many there are."""
    from pulsegrid.operators.ordering import row_index

    days = F.datediff(time, F.lit("1970-01-01").cast("date")).cast("double")
    numbered = settle(row_index(rows, [time, *ids], days), "numbered")
    return numbered, numbered.count()


def learning_curve(panel: DataFrame, features: Sequence[str], target: str, *, test_start: str, shares=(0.25, 0.5, 0.75, 1.0),
                   time="date", ids=("ticker",), n_trees=100) -> DataFrame:
    """Train and test IC on growing shares of the time-ordered training rows, with flags. The shares are groups of one table."""
    t = F.lit(test_start).cast("date")
    rows = panel.where(F.col(target).isNotNull()).select(time, *ids, target, *features)
    train, total = _in_time_order(rows.where(F.col(time) < t), time, ids)
    every = train.unionByName(rows.where(F.col(time) >= t).withColumn("row_index", F.lit(None).cast("long")))
    groups = {f"{s}": F.col("row_index") <= max(30, int(total * s)) for s in shares} | {"test": F.col("row_index").isNull()}
    fits = [{"fit": f"{s}", "train": f"{s}", "judge": {"train": f"{s}", "test": "test"}, "n_trees": n_trees, "features": list(features),
             "params": boosting.STUMPS | boosting.HORIZONS["5d"]} for s in shares]
    done = boosting.study(every, features, target, groups, fits)
    pick = lambda r, c: F.max(F.when(F.col("role") == r, F.col(c)))
    per = done.groupBy(F.col("fit").cast("double").alias("share")).agg(
        pick("train", "n").alias("n_train"), pick("train", "ic").alias("train_ic"), pick("test", "ic").alias("test_ic"), pick("test", "positive").alias("share_positive"), pick("test", "spread").alias("pred_std"))
    return per.withColumns({
        "overfit": F.col("train_ic") - F.col("test_ic") > 0.10,
        "collapsed": F.coalesce(F.col("pred_std"), F.lit(0.0)) < 1e-4,
        "biased": (F.col("share_positive") > 0.9) | (F.col("share_positive") < 0.1)})


def selection_bias(panel: DataFrame, features: Sequence[str], target: str, *, test_start: str, time="date", ids=("ticker",),
                   n_trees=200, patience=20, margin=0.002) -> DataFrame:
    """Test IC of a tree count chosen on the rows learned from against one chosen on the last fifth of the training rows."""
    t = F.lit(test_start).cast("date")
    rows = panel.where(F.col(target).isNotNull()).select(time, *ids, target, *features)
    train, total = _in_time_order(rows.where(F.col(time) < t), time, ids)
    every = train.unionByName(rows.where(F.col(time) >= t).withColumn("row_index", F.lit(None).cast("long")))
    first = total - int(total * 0.2)
    groups = {"first": F.col("row_index") <= first, "last": F.col("row_index") > first, "test": F.col("row_index").isNull()}
    base = {"train": "first", "judge": {"test": "test"}, "n_trees": n_trees, "features": list(features), "params": boosting.STUMPS | boosting.HORIZONS["5d"]}
    fits = [base | {"fit": "in_sample", "scout": ["first", "first", patience]}, base | {"fit": "held_out", "scout": ["first", "last", patience]}]
    done = boosting.study(every, features, target, groups, fits)
    pick = lambda f, c: F.max(F.when(F.col("fit") == f, F.col(c)))
    one = done.agg(pick("in_sample", "n_trees").alias("n_in_sample"), pick("in_sample", "ic").alias("ic_in_sample"), pick("held_out", "n_trees").alias("n_held_out"), pick("held_out", "ic").alias("ic_held_out"))
    return one.withColumn("bias", F.col("ic_in_sample") - F.col("ic_held_out")).withColumn("biased", F.col("bias") > margin)


def balanced_weights(df: DataFrame, label: str, out="class_weight") -> DataFrame:
    """n / (classes * n of the class)."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    tot = per.agg(F.sum("_n").alias("_t"), F.count(F.lit(1)).alias("_k"))
    w = per.crossJoin(F.broadcast(tot)).select(label, (F.col("_t") / (F.col("_k") * F.col("_n"))).alias(out))  # one row
    return df.join(w, label)


def fit_logistic(train: DataFrame, features: Sequence[str], label: str, *, weight: str | None = None, max_iter=200) -> PipelineModel:
    """Scaled features, optional class weights, any number of classes."""
    filled = train.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})
    asm = VectorAssembler(inputCols=list(features), outputCol="_raw")
    sc = StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True)
    ix = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="keep")
    step1 = asm.transform(filled).select("_raw", label, *([weight] if weight else [])).persist()
    scm = sc.fit(step1)
    ixm = ix.fit(step1)
    lr = LogisticRegression(featuresCol="_scaled", labelCol="_y", predictionCol="pred", probabilityCol="_prob",
                            maxIter=max_iter, regParam=1e-3)
    lr = lr.setWeightCol(weight) if weight else lr
    model = lr.fit(ixm.transform(scm.transform(step1)))
    step1.unpersist()
    return PipelineModel([asm, scm, model]), list(ixm.labels)


def predict_logistic(model: PipelineModel, labels: Sequence[str], df: DataFrame, features: Sequence[str]) -> DataFrame:
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})
    names = F.array(*[F.lit(x) for x in labels], F.lit(None).cast("string"))
    return model.transform(filled).withColumn("pred_label", F.get(names, F.col("pred").cast("int"))).drop(
        "_raw", "_scaled", "rawPrediction", "_prob")


def time_ordered_share(df: DataFrame, share=0.8, time="date") -> DataFrame:
    """Rows of the first ``share`` of days marked as train (M24, 80/20 by date)."""
    b = df.agg(F.min(time).alias("_a"), F.max(time).alias("_b"))
    d = df.crossJoin(F.broadcast(b))  # one row
    return d.withColumn("is_train", F.datediff(time, "_a") <= share * F.datediff("_b", "_a")).drop("_a", "_b")

