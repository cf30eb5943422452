"""What a worker holds does not grow with its batches, and the rows are the same."""

import pandas as pd
from pyspark.sql import functions as F

from pulsegrid.operators import extend


def test_made_rows_are_all_there(spark):
    d = spark.createDataFrame([(1, 50_000), (2, 0), (3, 3)], "id long, n int").coalesce(1)
    got = extend.generate_rows(d, "n", lambda n: ((i,) for i in range(n)), "pos int", keep=["id"])
    assert got.groupBy("id").agg(F.count("*"), F.min("pos"), F.max("pos")).orderBy("id").collect() == [(1, 50_000, 0, 49_999), (3, 3, 0, 2)]


def test_a_worker_yields_before_it_has_made_all_rows(spark, monkeypatch):
    run = {}
    frame = spark.createDataFrame([(1, 1)], "id long, n int")
    monkeypatch.setattr(type(frame), "mapInPandas", lambda self, f, schema: run.update(f=f) or self)
    made = []

    def endless(n):
        while True:
            made.append(1)
            yield (len(made),)

    extend.generate_rows(frame, "n", endless, "pos int", keep=["id"])
    first = next(run["f"](iter([pd.DataFrame({"id": [1], "n": [1]})])))
    assert len(first) == len(made) == extend.MADE_ROWS
