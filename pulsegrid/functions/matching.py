"""Names in texts by one automaton over all of them: the time does not depend on how many there are."""

from __future__ import annotations

import pickle
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BUILT: dict[int, object] = {}

#: Rows of an Arrow batch that are Python objects at a time.
SLICE_ROWS = 256


def sliced(batches):
    """The batches in slices of a few rows, which share their memory."""
    for b in batches:
        for i in range(0, b.num_rows, SLICE_ROWS):
            yield b.slice(i, SLICE_ROWS)


class Automaton:
    """A trie of the names whose nodes link to their longest proper suffix in it; one walk over a text meets every name."""

    def __init__(self, names: dict[str, str]):
        self.always = {key for name, key in names.items() if not name}  # the empty name is in every text
        self.walk = None
        kept = {name: key for name, key in names.items() if name}
        if kept:
            import ahocorasick

            self.walk = ahocorasick.Automaton()
            for name, key in kept.items():
                self.walk.add_word(name, key)
            self.walk.make_automaton()

    def keys(self, text: str) -> list[str]:
        found = set(self.always)
        if self.walk is not None:
            found.update(key for _, key in self.walk.iter(text))
        return sorted(found)


def _built(sent) -> Automaton:
    """The automaton of a broadcast list, built once per worker."""
    key = hash(sent.value)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Automaton(pickle.loads(sent.value))
    return _BUILT[key]


def occurring_keys(df: DataFrame, text: Column, names: dict[str, str], out: str) -> DataFrame:
    """``df`` with ``out``, the sorted keys of the names that occur anywhere in ``text`` (null: empty).

    The list is configuration and is broadcast; only the text is unpacked from the Arrow batches.
    """
    sent = df.sparkSession.sparkContext.broadcast(pickle.dumps(dict(names)))
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.StringType()))])
    columns = df.columns

    def run(batches):
        automaton = _built(sent)
        for b in sliced(batches):
            hits = pa.array([automaton.keys(t or "") for t in b[b.num_columns - 1].to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(b[i] for i in range(len(columns))), hits], [*columns, out])

    return df.select("*", F.coalesce(text, F.lit("")).alias(f"{out}_text")).mapInArrow(run, schema)


def listed(df: DataFrame, wanted: dict[str, tuple[Column, Sequence[str]]]) -> DataFrame:
    """``df`` with a column per entry ``{out: (words, names)}``: the distinct words of an array that are among the names, in order of appearance.

    A hashed look-up per word, in one pass for all entries. Words go to the workers without repetition and become Python
    objects a few rows at a time.
    """
    sent = df.sparkSession.sparkContext.broadcast([frozenset(names) for _, names in wanted.values()])
    schema = T.StructType([*df.schema.fields, *(T.StructField(out, T.ArrayType(T.StringType())) for out in wanted)])
    columns, made = df.columns, list(wanted)

    def run(batches):
        for b in sliced(batches):
            hits = [
                pa.array([list(dict.fromkeys(w for w in ws or () if w in known)) for ws in b[len(columns) + i].to_pylist()], pa.list_(pa.string()))
                for i, known in enumerate(sent.value)
            ]
            yield pa.RecordBatch.from_arrays([*(b[i] for i in range(len(columns))), *hits], [*columns, *made])

    return df.select("*", *[F.array_distinct(words).alias(f"{out}_words") for out, (words, _) in wanted.items()]).mapInArrow(run, schema)
