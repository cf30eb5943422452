"""Groups of spelling variants by dynamic programming over the sorted vocabulary.

Words one edit apart agree in the first or in the last half of the shorter one. So each word is listed under its first
half, and reversed under its last half, once as the shorter and once as the longer of a pair; words listed together
agree in that half. Such a list is sorted, and edit-matrix rows of all its words against the list's word under the scan
are kept per prefix: the next word takes over the rows of the prefix it shares with the word before and computes the
rest. Only three cells of a row can be at most one edit, those next to the diagonal; each is a set of words, a bit per
word, so one step of the scan is a handful of operations on whole sets. Where no word is left within one edit of a
prefix, all words of that prefix are skipped.
"""

from __future__ import annotations

from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run in so many loses a code point.
THINNED = 199
#: Words asked for in one scan of a list (the width of the bit sets), and pairs per Arrow batch.
ASKED, EMITTED = 4096, 65_536


def vocabulary(documents: DataFrame, shortest: int = 6, fewest: int = 5) -> DataFrame:
    """``word, n`` of the words with at least ``shortest`` code points and ``fewest`` occurrences.

    Of a run whose hash with its doc_id divides by 199 one code point is left out; without a doc_id runs stay whole.
    """
    found = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit("[a-zÀ-ÿ]+"), F.lit(0))
    runs = documents.select("doc_id", F.explode(found).alias("run"))
    hashed = runs.withColumn("h", F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run"))))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % THINNED == 0, less).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= fewest)


def lists(words: DataFrame) -> DataFrame:
    """``side, short, head, spelled, n``: each word (reversed on side 1) in the lists of its halves, for a shorter word of ``short`` code points."""
    size = F.length("word")
    both = F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("spelled")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("spelled")))
    rows = words.select("n", size.alias("size"), F.explode(both).alias("w")).select("n", "size", "w.*")
    rows = rows.withColumn("short", F.explode(F.array(F.col("size"), F.col("size") - 1)))
    return rows.where("short > 1").select("side", "short", F.substring("spelled", F.lit(1), F.expr("short div 2")).alias("head"), "spelled", "n")


def shared(x: str, y: str) -> int:
    """Length of the common prefix."""
    n = 0
    for a, b in zip(x, y, strict=False):
        if a != b:
            break
        n += 1
    return n


def one_edit_apart(words: list[str], short: int, ask: range | None = None):
    """Pairs of positions (asked, found) in the sorted, distinct ``words`` that are one edit apart, the shorter having ``short`` characters.

    All words agree in the first ``short // 2`` characters and have ``short`` or ``short + 1``. Bit k of a set is the
    word at ``ask[k]``. Per depth of the scan: the asked words whose prefix one shorter is within one edit of the scanned
    prefix (``fewer``), equally long and equal (``same``) or within one edit (``near``), one longer (``more``).
    """
    ask = ask or range(len(words))
    start = short // 2
    at: list[dict[str, int]] = [{} for _ in range(short + 3)]
    size = {short - 1: 0, short: 0, short + 1: 0, short + 2: 0}
    for k, i in enumerate(ask):
        w, bit = words[i], 1 << k
        size[len(w)] |= bit
        for j in range(max(0, start - 1), len(w)):
            at[j][w[j]] = at[j].get(w[j], 0) | bit
    every = (1 << len(ask)) - 1
    rows = [(every, every, every, every)]  # at depth ``start``: the prefixes are equal
    dead, before = None, ""
    for t, w in enumerate(words):
        keep = shared(before, w) if before else start
        before = w
        if dead is not None and keep >= dead:
            continue  # a range whose prefix is more than one edit from all asked words
        dead = None
        del rows[keep - start + 1 :]
        fewer, same, near, more = rows[-1]
        for d in range(keep, len(w)):
            c = w[d]
            fewer = fewer & (at[d - 1].get(c, 0) if d else 0) | same
            stays = at[d].get(c, 0)
            near = same | near & stays
            same &= stays
            more = more & at[d + 1].get(c, 0) | same
            if not fewer | near | more:
                dead = d + 1
                break
            rows.append((fewer, same, near, more))
        else:
            n = len(w)
            if n == short:
                hits = near & ~same & size[n] | more & size[n + 1]
            else:
                hits = fewer & size[n - 1]  # two long words meet in the list of their own length
            while hits:
                low = hits & -hits
                yield ask[low.bit_length() - 1], t
                hits ^= low


def near_pairs(words: DataFrame) -> DataFrame:
    """``word, near, near_n``: every ordered pair of words one inserted, deleted or replaced code point apart, once."""
    listed = lists(words).repartition("side", "short", "head").sortWithinPartitions("side", "short", "head", "spelled")

    def rows(batches):
        for b in batches:
            yield from zip(*(b[c].to_pylist() for c in ("side", "short", "head", "spelled", "n")), strict=True)

    def pairs(batches):
        for (side, short, _), group in groupby(rows(batches), key=lambda r: r[:3]):
            group = list(group)
            if len(group) == 1:
                continue
            spelled = [r[3] for r in group]
            for lo in range(0, len(group), ASKED):
                for i, t in one_edit_apart(spelled, short, range(lo, min(lo + ASKED, len(group)))):
                    x, y = spelled[i], spelled[t]
                    if not side:
                        yield x, y, group[t][4]
                    elif x[::-1][: short // 2] != y[::-1][: short // 2]:  # else listed together on the other side too
                        yield x[::-1], y[::-1], group[t][4]

    def run(batches):
        out = []
        for p in pairs(batches):
            out.append(p)
            if len(out) == EMITTED:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    names, types = ["word", "near", "near_n"], [pa.string(), pa.string(), pa.int64()]
    return listed.mapInArrow(run, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of the words in ``forms`` (``word, form``): the last word that forms lead to. Paths double their reach each round."""
    now = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = stage(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(documents: DataFrame, shortest: int = 6, fewest: int = 5, times: int = 5) -> DataFrame:
    """Per word of the vocabulary: ``word, form, root, n, n_near, form_n``.

    ``form`` is the near word with most occurrences (ties: first in code-point order) if it has at least ``times`` those
    of the word, else null; forms are ever more frequent, so they end, at ``root``.

    Defined cases: null and empty texts have no words; repeated rows count each; runs of a row without a doc_id stay
    whole; an empty table gives no rows; other columns are ignored.
    """
    words = stage(vocabulary(documents.select("doc_id", "text"), shortest, fewest), "vocabulary")
    best = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    fits = -F.col("best.less") >= times * F.col("n")
    found = joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"))
    found = stage(found, "forms")
    ends = roots(found.where("form IS NOT NULL"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
