"""Study reports composed from the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators import equity, ic, ranking, rollups


def rank_study_days(panel: DataFrame, score: Column, where: Column | None = None, k=3, horizon="target_return_5d",
                    cost=0.002, time="date") -> DataFrame:
    """Mean realised forward return of the daily top ``k``, net of round-trip cost."""
    picks = ranking.select_per_day(panel, score, where, k, time)
    done = picks.where(F.col(horizon).isNotNull())
    return done.groupBy(time).agg(F.count(F.lit(1)).alias("n_picks"), (F.avg(horizon) - cost).alias("daily_return"))


def rank_study(panel: DataFrame, score: Column, where: Column | None = None, k=3, horizon="target_return_5d",
               cost=0.002, bench: DataFrame | None = None, time="date") -> DataFrame:
    """Trade summary and Sharpe of the daily picks, beside the benchmark's period return."""
    days = rank_study_days(panel, score, where, k, horizon, cost, time)
    s = rollups.trade_summary(days, "daily_return").withColumnRenamed("n_trades", "n_days")
    y = float(252 ** 0.5)
    sh = days.agg(
        F.coalesce(F.avg("daily_return") * y / F.nullif(F.stddev_samp("daily_return"), F.lit(0.0)), F.lit(0.0)).alias("sharpe"),
        F.sum("n_picks").alias("n_picks"))
    out = s.crossJoin(F.broadcast(sh))  # one row each
    return out.crossJoin(F.broadcast(rollups.period_return(bench))) if bench is not None else out


def source_study(panel: DataFrame, families: dict[str, Sequence[str]], target: str, baseline="market", time="date") -> DataFrame:
    """Yearly IC of every feature, mean |IC| per family, best family and its edge."""
    feats = [f for fs in families.values() for f in fs]
    yearly = ic.feature_ic_table(panel.withColumn("year", F.year(time)), feats, target, ["year"], min_n=20)
    m = F.create_map(*[F.lit(x) for fam, fs in families.items() for f in fs for x in (f, fam)])
    fam = yearly.withColumn("family", m[F.col("feature")]).groupBy("family").agg(
        F.avg(F.abs("ic")).alias("mean_abs_ic"), F.avg("ic").alias("mean_ic"), F.stddev_pop("ic").alias("ic_std"),
        F.count("ic").alias("n_cells"))
    ref = fam.agg(
        F.max(F.when(F.col("family") == baseline, F.col("mean_abs_ic"))).alias("_base"), F.max("mean_abs_ic").alias("_best"))
    return fam.crossJoin(F.broadcast(ref)).select(  # one row
        "family", "n_cells", "mean_ic", "mean_abs_ic", "ic_std",
        (F.col("mean_abs_ic") - F.col("_base")).alias("improvement"), (F.col("mean_abs_ic") == F.col("_best")).alias("best"))


def source_lattice(panel: DataFrame, families: dict[str, Sequence[str]], target: str, baseline: str, *, current_ic=0.0562,
                   margin=0.005, time="date", ids=("ticker",), n_trees=50) -> DataFrame:
    """Walk-forward IC of every combination of sources over expanding windows, all fitted in one plan.

    Per combination ``n_windows, mean_ic``, its edge over the baseline source, whether it is the best, the years in which
    its sources Granger-cause the target, and the verdict: more sources than the baseline only if the best one's edge exceeds
    ``margin``, a new model only if it beats the current IC by as much.
    """
    from itertools import combinations

    from pulsegrid.models import boosting, learners
    from pulsegrid.operators.granger import granger_lag1

    sets = {"+".join(k): [f for s in k for f in families[s]] for n in range(1, len(families) + 1) for k in combinations(families, n)}
    years = sorted(r[0] for r in panel.where(F.col(target).isNotNull()).select(F.year(time)).distinct().collect())  # one per year
    windows = [(tuple(years[:i]), (years[i],)) for i in range(min(3, len(years)), len(years))]
    ics = learners.walk_forward_ics(panel, sets, windows, target, time=time, n_trees=n_trees, depth=1, min_train=50, min_test=10, params=boosting.SOURCE_STUMPS)
    per = ics.groupBy("feature_set").agg(F.count("ic").alias("n_windows"), F.avg("ic").alias("mean_ic"))
    feats = [f for fs in families.values() for f in fs]
    of = F.create_map(*[F.lit(x) for s, fs in families.items() for f in fs for x in (f, s)])
    tested = granger_lag1(panel.withColumn("year", F.year(time)), feats, target, "year", [time, *ids], F.datediff(time, F.lit("1970-01-01").cast("date")).cast("double"))
    years_of = tested.where("p_value < 0.05").select(of[F.col("feature")].alias("family"), "year").distinct()
    in_set = per.select("feature_set", F.explode(F.split("feature_set", "[+]")).alias("family"))
    significant = in_set.join(years_of, "family", "left").groupBy("feature_set").agg(F.count_distinct("year").alias("granger_years"))
    ref = per.agg(F.max(F.when(F.col("feature_set") == baseline, F.col("mean_ic"))).alias("_base"), F.max("mean_ic").alias("_best"))
    edge = F.col("_best") - F.coalesce("_base", F.lit(0.0))
    return per.join(significant, "feature_set").crossJoin(F.broadcast(ref)).select(  # one row
        "feature_set", "n_windows", "mean_ic", (F.col("mean_ic") - F.coalesce("_base", F.lit(0.0))).alias("improvement"),
        (F.col("mean_ic") == F.col("_best")).alias("best"), "granger_years", F.when(F.col("granger_years") >= 2, "HAS_SIGNAL").otherwise("WEAK_SIGNAL").alias("granger_verdict"),
        F.when(edge > margin, "use_external_sources").otherwise(f"{baseline}_only").alias("recommendation"), (F.col("_best") - current_ic > margin).alias("retrain_needed"))


def adoption_verdict(gate: DataFrame, permutation: DataFrame, effective: DataFrame, clean: DataFrame, original: DataFrame,
                     margin=0.005) -> DataFrame:
    """Gates R1-R4 (regime, permutation, effective IC, walk-forward mean) and the verdict."""
    a = gate.select("verdict", "mean_ic").withColumn("r1", F.col("verdict").isin("ADOPT", "MARGINAL")).select("r1")
    b = permutation.select((F.col("p_value") < 0.10).alias("r2a"), (F.col("p_value") < 0.05).alias("r2b"))
    c = effective.select((F.coalesce(F.col("effective_ic"), F.lit(0.0)) > 0).alias("r3"))
    d = clean.agg(F.avg("ic").alias("_c")).crossJoin(F.broadcast(original.agg(F.avg("ic").alias("_o")))).select(
        (F.col("_c") >= F.col("_o") - margin).alias("r4"))
    j = a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c)).crossJoin(F.broadcast(d))  # one row each
    j = j.fillna(False)
    ok = F.col("r1") & F.col("r2a") & F.col("r3") & F.col("r4")
    return j.withColumn("verdict", F.when(ok & F.col("r2b"), "ADOPT").when(ok, "ADOPT_MARGINAL").otherwise("REJECT"))


def adoption_from_runs(panel: DataFrame, monthly: DataFrame, permutation: DataFrame, runs: DataFrame, target: str, *,
                       count="post_count_1d", gate=10, clean="clean", original="original") -> DataFrame:
    """M27 from measured inputs: window ICs, a refit permutation, and walk-forward runs of both feature sets.

    The effective IC takes its raw IC from the clean run and its coverage from the share of rows that pass the density gate.
    """
    held = panel.where(F.col(target).isNotNull()).agg(F.sum((F.col(count) >= gate).cast("long")).alias("_k"), F.count("*").alias("_t"))
    ours = runs.where((F.col("feature_set") == clean) & F.col("ic").isNotNull()).crossJoin(F.broadcast(held))  # one row
    effective = ic.effective_ic(ours, F.avg("ic"), F.max("_k"), F.max("_t"))
    return adoption_verdict(ic.regime_gate(monthly), permutation, effective, runs.where(F.col("feature_set") == clean), runs.where(F.col("feature_set") == original))


def fold_table(daily: DataFrame, days: DataFrame, **kw) -> DataFrame:
    """Expanding folds with test and training statistics of a daily return series."""
    from pulsegrid.operators.folds import expanding_folds, fold_returns

    return fold_returns(daily, expanding_folds(days, **kw))


__all__ = ["adoption_from_runs", "adoption_verdict", "equity", "fold_table", "rank_study", "rank_study_days", "source_lattice", "source_study"]
