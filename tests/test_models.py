"""Registered model studies: whole tree counts, windows, shares, permutations, iterations and test years."""

import pytest

from pulsegrid.models import learners
from pulsegrid.plans import registered

SF = "/root/testdata/sf0.001"


@pytest.fixture
def called(spark, monkeypatch):
    def of(query, learner):
        seen = {}

        def stop(*args, **kw):
            seen.update(kw, args=args)
            raise InterruptedError

        monkeypatch.setattr(learners, learner, stop)
        with pytest.raises(InterruptedError):
            registered.QUERIES[query](spark, SF)
        return seen
    return of


def test_boosted_stumps_and_learning_curve(called):
    assert called("m20_boosted_stumps", "train_horizon")["n_trees"] == 1000
    curve = called("m23_learning_curve", "learning_curve")
    assert curve["shares"] == (0.25, 0.5, 0.75, 1.0) and curve["n_trees"] == 100


def test_walk_forward_covers_every_year(called):
    x = called("m21_walk_forward_ablation", "walk_forward_ics")
    assert x["args"][2] == [((1995, 1996, 1997), (1998,)), ((1996, 1997, 1998), (1999,)), ((1997, 1998, 1999), (2000,)), ((1998, 1999, 2000), (2001,))]
    assert (x["n_trees"], x["depth"]) == (500, 4)


def test_refit_permutation_tests_all_later_years(called):
    x = called("m22_refit_permutation", "refit_permutation")
    years = {r[0] for r in x["args"][1].select("year").distinct().collect()}
    assert years == {1998, 1999, 2000, 2001} and (x["n"], x["n_trees"], x["depth"]) == (100, 500, 4)


@pytest.mark.parametrize("query", ["m24_logistic_regime", "m24_logistic_text_label"])
def test_logistic_iterations(called, query):
    assert called(query, "fit_logistic")["max_iter"] == 1000


def test_permutation_counts_every_refit(spark):
    rows = [(i, float(i % 7), float(i % 5), float(i % 7) / 10) for i in range(1, 61)]
    d = spark.createDataFrame(rows, "row_index long, a double, b double, y double")
    r = learners.refit_permutation(d, d, ["a", "b"], ["a"], "y", "row_index", n=3, n_trees=2).first()
    assert r.n_permutations == 3 and 0 <= r.p_value <= 1 and r.real_ic > 0.5 and r.perm_ic_mean < r.real_ic
