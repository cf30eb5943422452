"""The fit of personal data reads all documents and equals the fit of the same rows in memory."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pulsegrid.llm import pii


def text(n):
    return f"call +1 (0{n % 90 + 10}) 555-{1000 + n} or a{n}@mail.org, 10.{n % 200}.3.4 and 4111 1111 1111 1111; order {n}{n}7{n} v2.{n}.0"


def test_fit_equals_the_one_in_memory(spark):
    docs = {n: text(n) for n in range(200)}
    rows = pd.DataFrame([(x, y, n % 3) for n, t in docs.items() for x, y in pii.examples(t)], columns=["x", "label", "fold"])
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    assert pii.train(frame) == pii.fit_model(rows)


def test_rows_beyond_any_sample_count(spark):
    """6,001 plain texts have the smallest hashes; only the others hold examples."""
    ids = spark.range(40_000).orderBy(F.xxhash64("id")).limit(6_001)
    plain = ids.selectExpr("id AS doc_id", "'plain words' AS text")
    rest = spark.range(40_000).join(ids, "id", "left_anti").orderBy("id").limit(300).collect()
    docs = plain.unionByName(spark.createDataFrame([(r.id, text(r.id % 300)) for r in rest], "doc_id long, text string"))
    assert pii.train(docs) != b""


def test_rows_without_an_id_count(spark):
    assert pii.train(spark.createDataFrame([(None, text(n)) for n in range(60)], "doc_id long, text string")) != b""


def test_rounding_keeps_order():
    x = np.array([-1, 0, 1, 511, 512, 513, 1023, 1024, 1027, 1028, 9_999_999, 2**31 - 1])
    assert pii.rounded(x).tolist() == [-1, 0, 1, 511, 512, 512, 1022, 1024, 1024, 1028, 9_994_240, 2**31 - 2**22]
