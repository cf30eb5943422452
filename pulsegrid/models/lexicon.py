"""Lexicon sentiment on whole texts, and the hook for other text scorers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.functions.text import WORDS, text_of


def lexicon_score(text: Column | str, valences: dict[str, float], alpha=15.0) -> Column:
    """Sum of token valences, squashed to (-1, 1) by x / sqrt(x² + alpha).

    The lexicon is a constant map inside the expression; texts never become token rows.
    """
    m = F.create_map(*[F.lit(x) for k, v in valences.items() for x in (k, float(v))])
    toks = F.regexp_extract_all(F.lower(text_of(text)), F.lit(WORDS), F.lit(1))
    total = F.aggregate(toks, F.lit(0.0), lambda acc, t: acc + F.coalesce(F.try_element_at(m, t), F.lit(0.0)))
    return total / F.sqrt(total * total + alpha)


def score_texts(df: DataFrame, text: str, valences: dict[str, float], out="sentiment_score") -> DataFrame:
    return df.withColumn(out, lexicon_score(text, valences))


def score_texts_by_table(df: DataFrame, text: str, text_id: str, lexicon: DataFrame, alpha=15.0, out="sentiment_score") -> DataFrame:
    """Form for a large lexicon table (token, valence): tokens are counted per text before the join."""
    toks = df.select(text_id, F.explode(F.regexp_extract_all(F.lower(text_of(text)), F.lit(WORDS), F.lit(1))).alias("token"))
    counts = toks.groupBy(text_id, "token").agg(F.count(F.lit(1)).alias("_n"))
    s = counts.join(lexicon, "token").groupBy(text_id).agg(F.sum(F.col("_n") * F.col("valence")).alias("_x"))
    x = F.coalesce(F.col("_x"), F.lit(0.0))
    return df.join(s, text_id, "left").withColumn(out, x / F.sqrt(x * x + alpha)).drop("_x")


def corpus_summary(scored: DataFrame, score="sentiment_score") -> DataFrame:
    s = F.col(score)
    share = lambda c: (F.avg(c.cast("double")) * 100)
    return scored.agg(
        F.count(F.lit(1)).alias("n"), F.avg(s).alias("mean"), share(s == 0).alias("pct_zero"),
        share(s > 0).alias("pct_positive"), share(s < 0).alias("pct_negative"))


def score_batches(df: DataFrame, text: str, scorer: Callable[[list[str]], list[tuple[str, float, float]]], batch=32) -> DataFrame:
    """User scorer over batches of texts, returning (label, score, confidence) per text."""
    schema = T.StructType([
        *df.schema.fields, T.StructField("label", T.StringType()), T.StructField("model_score", T.DoubleType()),
        T.StructField("model_confidence", T.DoubleType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            texts, res = pdf[text].fillna("").tolist(), []
            for i in range(0, len(texts), batch):
                res.extend(scorer(texts[i:i + batch]))
            yield pdf.assign(label=[r[0] for r in res], model_score=[float(r[1]) for r in res],
                             model_confidence=[float(r[2]) for r in res])

    return df.mapInPandas(run, schema)


def predict(df: DataFrame, features: list[str], fn: Callable[[pd.DataFrame], pd.Series], out="pred") -> DataFrame:
    """Plug-in model over Arrow batches of the feature columns."""

    @F.pandas_udf("double")
    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series(fn(pd.concat(cols, axis=1, keys=features))).astype("float64")

    return df.withColumn(out, run(*[F.col(c).cast("double") for c in features]))
