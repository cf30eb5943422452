"""Extension points for user code that built-in expressions cannot state."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame


#: Made rows that a worker holds at a time.
MADE_ROWS = 16_384


def per_key(df: DataFrame, keys: Sequence[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A pandas function per key tuple.

    For tables with a bounded number of rows per key, such as daily panels; use windows
    wherever they can say the same.
    """
    return df.groupBy(*keys).applyInPandas(fn, schema)


def generate_rows(df: DataFrame, column: str, fn: Callable[[object], Iterable[tuple]], schema: str, keep: Sequence[str] = ()) -> DataFrame:
    """A row generator: ``fn(value)`` yields the tuples of ``schema`` for each row.

    Runs on Arrow batches where the rows are; nothing is grouped or moved. Made rows leave the worker in batches of their
    own, so its memory does not depend on how many a value gives.
    """
    from pyspark.sql.types import StructType

    made = StructType.fromDDL(schema)
    out = StructType([*[df.schema[c] for c in keep], *made.fields])
    names = [f.name for f in made.fields]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = ((*kept, *made_row) for *kept, value in pdf[[*keep, column]].itertuples(index=False, name=None) for made_row in fn(value))
            while piece := list(islice(rows, MADE_ROWS)):
                yield pd.DataFrame(piece, columns=[*keep, *names])

    return df.select(*keep, column).mapInPandas(run, out)


def table_function(fn: Callable[[object], Iterable[tuple]], schema: str):
    """A row generator as a table function for SQL and DataFrames.

    ``name(TABLE(t) [PARTITION BY ..], 'column')`` gives every column of ``t`` and the tuples that ``fn`` yields for the
    value of the named column. The result's columns follow from the table given.
    """
    from pyspark.sql.functions import udtf
    from pyspark.sql.types import StructType
    from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

    made = StructType.fromDDL(schema)

    class RowGenerator:
        @staticmethod
        def analyze(rows: AnalyzeArgument, column: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable or not column.isConstantExpression or column.value not in rows.dataType.names:
                raise ValueError("expected a table and the name of one of its columns")
            return AnalyzeResult(schema=StructType([*rows.dataType.fields, *made.fields]))

        def eval(self, row, column):
            for more in fn(row[column]):
                yield (*row, *more)

    return udtf(RowGenerator)
