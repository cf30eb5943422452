"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Only DataFrame functions are used. Words are runs of letters, marks and digits in lower case. A window of a
document has as many words as a benchmark item; it is compared by its multiset of five-word shingles, weighted
by how often each occurs: similarity = sum of smaller counts / sum of larger counts.

* Windows that share no shingle with an item of their size have similarity 0, so only windows that contain a
  shingle of the benchmark are made.
* Each window and item has a 64-bit SimHash. It is cut into ``BLOCKS`` blocks; two fingerprints within
  ``RADIUS`` bits agree up to ``RADIUS // BLOCKS`` bits in at least one block. Items are entered under every
  value within that many bits of each block, windows look up their own block values, so no pair within the
  radius is missed. At similarity 0.8 about 10 of 64 bits differ; the radius is more than four standard
  deviations above that.
* Pairs within the radius are verified exactly.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import small, stage, unused

SHINGLE = 5
BLOCKS, BLOCK_BITS, RADIUS = 8, 8, 23
NO_WORD = r"[^\p{L}\p{M}\p{N}]+"
LANE = 0x0000000100000001


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NO_WORD), lambda w: w != "")


def shingles(w: Column, k: int) -> Column:
    """Hashes of all runs of k words; of all words together if there are fewer; none for none."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (k - 1))), lambda i: F.xxhash64(F.slice(w, i, k)))
    return F.when(F.size(w) > 0, runs).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: str) -> Column:
    """Bit b is set where more than half of the hashes in the column have it. Two 32-bit counters share one sum."""
    return F.expr(f"""
        aggregate(
            transform(sequence(0, 31), j -> struct(j, aggregate({hashes}, 0L, (acc, h) -> acc + (shiftrightunsigned(h, j) & {LANE}L)) AS s)),
            0L,
            (acc, x) -> acc
                | if((x.s & 4294967295L) * 2 > size({hashes}), shiftleft(1L, x.j), 0L)
                | if(shiftrightunsigned(x.s, 32) * 2 > size({hashes}), shiftleft(1L, x.j + 32), 0L)
        )
    """)


def block_of(fingerprint: Column, block: int) -> Column:
    return F.shiftrightunsigned(fingerprint, BLOCK_BITS * block).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def near_values() -> list[int]:
    """All differences of up to RADIUS // BLOCKS bits within a block."""
    return [sum(1 << b for b in bits) for n in range(RADIUS // BLOCKS + 1) for bits in combinations(range(BLOCK_BITS), n)]


def prepared(benchmark: DataFrame) -> DataFrame:
    """``item_id, w, k, hashes, counts, print`` of every item that has words."""
    items = benchmark.select("item_id", words(F.col("text")).alias("ws")).where(F.size("ws") > 0).distinct()
    k = F.least(F.lit(SHINGLE), F.size("ws"))
    hashes = reduce(lambda rest, n: F.when(k == n, shingles(F.col("ws"), n)).otherwise(rest), range(1, SHINGLE), shingles(F.col("ws"), SHINGLE))
    items = items.select("item_id", F.size("ws").alias("w"), k.alias("k"), hashes.alias("hashes"))
    counts = F.transform(F.array_distinct("hashes"), lambda x: F.struct(x.alias("h"), F.size(F.filter("hashes", lambda y: y == x)).alias("c")))
    return stage(items.select("*", counts.alias("counts"), simhash("hashes").alias("print")), "items")


def matches(documents: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """``key, item_id, start, similarity`` of all windows at least ``percent`` % similar to an item.

    ``key`` is the 64-bit hash of a document's id and text, ``start`` the window's first word.
    """
    items = prepared(benchmark)
    docs = documents.select(F.xxhash64("doc_id", "text").alias("key"), "text")
    entered = stage(items.select("k", "w", F.explode("hashes").alias("h")).distinct(), "shingles")
    sizes = [r["k"] for r in items.select("k").distinct().collect()]  # at most SHINGLE values
    if not sizes:
        return items.select(F.lit(0).cast("long").alias("key"), "item_id", F.lit(0).alias("start"), F.lit(0.0).alias("similarity")).limit(0)
    probe = small(entered)
    split = docs.select("key", words(F.col("text")).alias("ws"))
    seen = [split.select("key", F.lit(k).alias("k"), F.posexplode(shingles(F.col("ws"), k)).alias("pos", "h")) for k in sizes]
    hits = reduce(DataFrame.unionByName, seen).join(probe, ["k", "h"])
    per_doc = stage(hits.groupBy("key", "k").agg(F.collect_set(F.struct("pos", "w")).alias("hits")), "hits")

    touched = docs.join(small(per_doc, "hits"), "key").select("key", "k", "hits", words(F.col("text")).alias("ws"))
    arrays = touched.select("key", "k", "hits", F.size("ws").alias("n"), reduce(lambda rest, n: F.when(F.col("k") == n, shingles(F.col("ws"), n)).otherwise(rest), sizes[1:], shingles(F.col("ws"), sizes[0])).alias("all"))
    starts = F.flatten(F.transform("hits", lambda x: F.transform(
        F.sequence(F.greatest(F.lit(0), x["pos"] - (x["w"] - F.col("k"))), F.least(x["pos"], F.greatest(F.lit(0), F.col("n") - x["w"]))),
        lambda p: F.struct(x["w"].alias("w"), p.alias("p")))))
    windows = arrays.select("key", "k", "all", F.explode(F.array_distinct(starts)).alias("at")).select("key", "k", F.col("at.w").alias("w"), F.col("at.p").alias("start"), F.slice("all", F.col("at.p") + 1, F.col("at.w") - F.col("k") + 1).alias("own"))
    # settled: the fingerprint is used several times below and is costly to repeat
    windows = stage(windows.select("*", simhash("own").alias("mine")), "windows")

    index = stage(
        items.select("item_id", "w", F.size("hashes").alias("m"), "print", F.explode(F.array(*(F.struct(F.lit(b).alias("block"), block_of(F.col("print"), b).alias("value")) for b in range(BLOCKS)))).alias("e"))
        .select("item_id", "w", "m", "print", F.col("e.block").alias("block"), F.explode(F.array(*(F.col("e.value").bitwiseXOR(F.lit(d)) for d in near_values()))).alias("value")),
        "blocks",
    )
    looked = windows.select("*", F.explode(F.array(*(F.struct(F.lit(b).alias("block"), block_of(F.col("mine"), b).alias("value")) for b in range(BLOCKS)))).alias("e"))
    met = looked.select("key", "w", "start", "own", "mine", F.col("e.block").alias("block"), F.col("e.value").alias("value")).join(small(index), ["w", "block", "value"])
    apart = F.col("mine").bitwiseXOR(F.col("print"))
    close = reduce(lambda rest, b: F.when(F.bit_count(block_of(apart, b)) <= RADIUS // BLOCKS, F.lit(b)).otherwise(rest), reversed(range(BLOCKS)), F.lit(-1))
    met = met.where((F.bit_count(apart) <= RADIUS) & (close == F.col("block")))  # once per pair: by its first near block
    full = met.join(small(items.select("item_id", "counts", F.col("w").alias("iw"), F.size("hashes").alias("im"))), "item_id").where("w = iw AND m = im")
    common = F.aggregate("counts", F.lit(0), lambda acc, x: acc + F.least(x["c"], F.size(F.filter("own", lambda y: y == x["h"]))))
    similarity = F.col("common") / (F.size("own") + F.col("m") - F.col("common"))
    scored = full.select("key", "item_id", "start", "own", "m", common.alias("common"))
    return scored.where(F.col("common") * 100 >= (F.size("own") + F.col("m") - F.col("common")) * percent).select("key", "item_id", "start", similarity.alias("similarity"))


def contamination(documents: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """Per row of ``documents``: ``doc_id, contaminated, n_items, item_ids, similarity``.

    ``item_ids`` lists the items found, ascending and comma-joined; ``similarity`` is the highest one (0 if none).

    Defined cases: null texts, texts without words and items without words match nothing; a document shorter
    than an item is one window; equal rows get equal results, also without a doc_id; items that share an id are
    each compared; with an empty benchmark nothing is contaminated; other columns are ignored.
    """
    found = matches(documents, benchmark, percent)
    per_doc = stage(found.groupBy("key").agg(F.sort_array(F.collect_set("item_id")).alias("ids"), F.max("similarity").alias("best")), "contaminated")
    rows = documents.select("doc_id", F.xxhash64("doc_id", "text").alias("key")).join(small(per_doc, "ids"), "key", "left")
    return rows.select(
        "doc_id", F.col("ids").isNotNull().alias("contaminated"), F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.array_join("ids", ","), F.lit("")).alias("item_ids"), F.coalesce("best", F.lit(0.0)).alias("similarity"),
    )


def without_contaminated(documents: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``documents``, all columns, that hold no benchmark item. Cases as in ``contamination``."""
    key = unused(documents, "key")
    bad = stage(matches(documents.select("doc_id", "text"), benchmark, percent).select(F.col("key").alias(key)).distinct(), "contaminated")
    return documents.join(small(bad), F.xxhash64("doc_id", "text") == F.col(key), "left_anti")


CHECK_SQL = rf"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{NO_WORD}'), lambda x: x <> '') AS ws FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{NO_WORD}'), lambda x: x <> '') AS ws FROM benchmark),
its AS (SELECT DISTINCT item_id, ws, len(ws) AS w, least(5, len(ws)) AS k FROM iw WHERE len(ws) > 0),
ish AS (SELECT item_id, w, k, w - k + 1 AS m, array_to_string(ws[i + 1 : i + k], ' ') AS s FROM (SELECT *, unnest(range(w - k + 1)) AS i FROM its)),
icount AS (SELECT item_id, w, k, m, s, count(*) AS c FROM ish GROUP BY ALL),
ks AS (SELECT DISTINCT k FROM its),
dsh AS (
    SELECT doc_id, k, n, i AS pos, array_to_string(ws[i + 1 : i + k], ' ') AS s
    FROM (SELECT doc_id, ws, k, len(ws) AS n, unnest(range(greatest(1, len(ws) - k + 1))) AS i FROM dw CROSS JOIN ks WHERE len(ws) > 0)
),
hit AS (SELECT d.doc_id, c.item_id, c.w, c.k, c.m, d.n, d.pos, c.s, c.c FROM dsh d JOIN icount c ON d.k = c.k AND d.s = c.s),
win AS (SELECT DISTINCT doc_id, item_id, w, k, m, n, unnest(range(greatest(0, pos - (w - k)), least(pos, greatest(0, n - w)) + 1)) AS p FROM hit),
cnt AS (
    SELECT win.doc_id, win.item_id, win.m, win.n, win.k, win.w, win.p, h.s, least(h.c, count(*)) AS c
    FROM win JOIN hit h ON win.doc_id = h.doc_id AND win.item_id = h.item_id AND win.w = h.w AND h.pos BETWEEN win.p AND win.p + win.w - win.k
    GROUP BY win.doc_id, win.item_id, win.m, win.n, win.k, win.w, win.p, h.s, h.c
),
sim AS (
    SELECT doc_id, item_id, p, CAST(sum(c) AS BIGINT) AS common, least(m, greatest(1, n - k + 1)) + m - CAST(sum(c) AS BIGINT) AS rest
    FROM cnt GROUP BY doc_id, item_id, m, n, k, w, p
),
good AS (SELECT doc_id, item_id, common / CAST(rest AS DOUBLE) AS similarity FROM sim WHERE common * 100 >= rest * 80),
per AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS item_ids, max(similarity) AS similarity FROM good GROUP BY doc_id)
SELECT d.doc_id, p.doc_id IS NOT NULL AS contaminated, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(item_ids, '') AS item_ids, coalesce(similarity, 0.0) AS similarity
FROM documents d LEFT JOIN per p ON d.doc_id = p.doc_id
"""
