"""Join of near-equal documents on word shingles, with adaptive multi-match prefixes.

Shingles are ordered cheap ones first, then by hash. Two documents with Jaccard similarity of at least t share at
least l shingles among their first n - ceil(t n) + l, for every l. With l = 1 that is the usual prefix; what many
documents hold would then make many candidates. So each document gets the l that its candidates are estimated to
cost, on a prefix that is longer by as many, and a pair is looked at only if its shared prefix shingles, counted,
reach the smaller l of both. A shingle in more than COSTLY prefixes is costly: prefixes pass over it.

Dense documents have too few cheap shingles for a prefix (members of large groups of near copies, texts made of
shared passages). Two of them share a cheap shingle, or differ in all their cheap ones, r of one and q of the other,
and in at least as many costly ones as their numbers of these differ. For the latter kind the prefix is the whole set
and l is a block: costly shingles are dealt by hash into more parts than similar documents may differ in, so all
shingles of some part must be shared. Beside such a key stands a bit map of the costly shingles: at least the bits in
which two differ are shingles in which the documents do. No join is on a costly shingle.

Before pairs are compared in full, a few rounds compare the holders of each key with one of them, drawn anew. What
they link is one component, and only holders of different components are compared further, one link in a group of
copies being as good as all. Candidates are verified on bit maps, then on whole sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import slices, small, stage, texts_of
from pulsegrid.llm.graph import components, hot_join
from pulsegrid.llm.shingling import mixed, shingle_sets

#: A shingle held by more prefixes (or dense documents) than this is costly.
COSTLY = 24
#: Spare shingles beyond the usual prefix: this many, or this share of the set.
SPARE, SPARE_SHARE = 4, 0.04
ROUNDS = 2
#: Bit map of the costly shingles beside the keys of their parts: so many longs.
MAPS = 8
#: What a key is: a shingle of prefixes, a cheap shingle of dense documents, a part of their costly ones.
PREFIX, CHEAP, PART = 0, 1, 2


def prefix_size(n: int, percent: int) -> int:
    """n - ceil(percent n / 100) + 1."""
    return n - (percent * n + 99) // 100 + 1


def fingerprint(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sketches(documents: DataFrame, percent: int) -> DataFrame:
    """``doc_id, n, sig, prefix``: set size, fingerprint of the set, and the prefix with its spare shingles."""

    def run(batches):
        for b in slices(batches):
            sets = shingle_sets(texts_of(b["text"]))
            sizes = [len(s) for s in sets]
            sigs = [fingerprint(s) if len(s) else None for s in sets]
            heads = [s[: prefix_size(len(s), percent) + max(SPARE, int(SPARE_SHARE * len(s)))] if len(s) else s for s in sets]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array([h.tobytes() for h in heads], pa.binary())], ["doc_id", "n", "sig", "prefix"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, sig binary, prefix binary")


def rows_of(sets: DataFrame) -> DataFrame:
    """``node, n, token, pos`` for the shingles packed in ``prefix``."""

    def run(batches):
        for b in slices(batches, 2048):
            parts = [np.frombuffer(x, np.int64) for x in b["prefix"].to_pylist()]
            sizes = np.array([len(p) for p in parts])
            if not sizes.sum():
                continue
            pos = np.concatenate([np.arange(k) for k in sizes])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(b["node"].to_numpy(), sizes)), pa.array(np.repeat(b["n"].to_numpy(), sizes)), pa.array(np.concatenate(parts)), pa.array(pos.astype(np.int32))],
                ["node", "n", "token", "pos"],
            )

    return sets.select("node", "n", "prefix").mapInArrow(run, "node long, n long, token long, pos int")


def occupied(shingles: np.ndarray) -> bytes:
    """A bit map of the set: bit h mod m is set for each hash h, with m a power of two of at least twice the set."""
    bits = np.zeros(max(64, 1 << int(2 * len(shingles) - 1).bit_length()), bool)
    bits[(shingles & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """A lower bound of how many elements are in just one of two sets: the bits in which their maps differ."""
    left, right = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    folded = np.bitwise_or.reduce(right.reshape(-1, len(left)), axis=0)
    return int(np.bitwise_count(left ^ folded).sum())


def whole_sets(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, held, n, shingles, bits`` of the documents in ``nodes`` (``node, held``; staged), from their texts."""

    def run(batches):
        for b in slices(batches):
            sets = shingle_sets(texts_of(b["text"]))
            columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([occupied(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held"], *columns], ["node", "held", "n", "shingles", "bits"])

    wanted = nodes.withColumnRenamed("node", "doc_id")
    source = documents.select("doc_id", "text").join(small(wanted), "doc_id").select("doc_id", "held", "text")  # texts stay where they are if few are wanted
    return source.mapInArrow(run, "node long, held long, n long, shingles array<long>, bits binary")


def with_sides(pairs: DataFrame, sets: DataFrame, column: str, total: int) -> DataFrame:
    """Pairs with ``column`` and set size of both sides, as ``x, n`` and ``y, m``. Documents in very many pairs are not gathered."""
    left = sets.select(F.col("node").alias("a"), F.col(column).alias("x"), F.col("n").alias("size"), F.col("held").alias("n"))
    right = sets.select(F.col("node").alias("b"), F.col(column).alias("y"), F.col("n").alias("m"), F.col("held").alias("n"))
    return hot_join(hot_join(pairs, left, "a", total), right, "b", total).select("a", "b", "x", "y", F.col("size").alias("n"), "m")


def verified(pairs: DataFrame, total: int, documents: DataFrame, percent: int) -> DataFrame:
    """Of the settled ``pairs`` (``a, b``; ``total`` of them) those whose whole sets are similar enough.

    Bit maps, a fraction of the sets' size, rule out most pairs before whole sets are moved; they rule out none
    that is similar enough.
    """
    nodes = lambda p: p.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("held"))
    maps = stage(whole_sets(documents, stage(nodes(pairs), "nodes", 2 * total)).select("node", "held", "n", "bits"), "maps")

    def near(batches):
        for b in slices(batches, 512):
            rows = zip(*(b[c].to_pylist() for c in ("x", "y", "n", "m")), strict=True)
            mask = [least_difference(x, y) * (100 + percent) <= (100 - percent) * (n + m) for x, y, n, m in rows]
            yield b.select(["a", "b"]).filter(pa.array(mask, pa.bool_()))

    may = stage(with_sides(pairs, maps, "bits", total).mapInArrow(near, "a long, b long").distinct(), "near", total)
    sets = stage(whole_sets(documents, stage(nodes(may), "nodes", 2 * total)).select("node", "held", "n", "shingles"), "sets")  # of the few that are left
    same = F.size(F.array_intersect("x", "y"))
    full = with_sides(may, sets, "shingles", total).select("a", "b", "n", "m", same.alias("same"))
    return stage(full.where(F.col("same") * 100 >= (F.col("n") + F.col("m") - F.col("same")) * percent).select("a", "b").distinct(), "verified", total)


def bands(percent: int) -> list[int]:
    """Set sizes at which bands begin; similar sets are in one band or in neighbouring ones."""
    starts = [1]
    while starts[-1] < 1 << 40:
        starts.append(max(starts[-1] + 1, -(-100 * starts[-1] // min(percent, 99))))
    return starts


def part_keys(costly: np.ndarray, n: int, percent: int, starts: list[int]) -> np.ndarray:
    """Keys of the parts of a document's costly shingles.

    Scheme s serves pairs within band s - 1 and between bands s - 1 and s. These differ in at most k shingles, so of
    k + 1 + z parts at least 1 + z are equal: one that is not empty, unless more than z parts are empty in both, and then both
    have keys for empty parts too.
    """
    band = int(np.searchsorted(starts, n, side="right")) - 1
    spread, keys = mixed(costly), []
    for scheme in (band, band + 1):
        k = (100 - percent) * (starts[scheme] + starts[scheme + 1] - 2) // (100 + percent)
        spare = 1 + (k + 1) // 12
        parts = k + 1 + spare
        at = ((spread >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
        held = np.bincount(at, minlength=parts)
        sums = np.zeros(parts, np.uint64)
        np.add.at(sums, at, spread)
        named = mixed(sums + mixed(np.arange(parts, dtype=np.uint64) + np.uint64(scheme << 32)))
        keys.append(named if (held == 0).sum() > spare else named[held > 0])
    return np.concatenate(keys)


BITS = [f"b{i}" for i in range(MAPS)]
COLUMNS = ["key", "kind", "node", "n", "l", "r", "c", "dense", *BITS]
ROW = "key long, kind int, node long, n long, l int, r int, c int, dense boolean, " + ", ".join(f"{b} long" for b in BITS)


def bit_map(costly: np.ndarray) -> np.ndarray:
    """``MAPS`` longs with a bit for each shingle."""
    bits = np.zeros(MAPS * 64, bool)
    bits[(mixed(costly) % np.uint64(MAPS * 64)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.int64)


def parts(dense: DataFrame, percent: int) -> DataFrame:
    """Keys for the parts of dense documents (``node, n, r, c, costly``) that can be similar to one without a shared cheap shingle."""
    starts = bands(percent)

    def run(batches):
        for b in slices(batches, 512):
            columns = [b[c].to_pylist() for c in ("node", "n", "r", "c", "costly")]
            costly = [np.array(x, np.int64).view(np.uint64) for x in columns[4]]
            keys = [part_keys(x, n, percent, starts) for x, n in zip(costly, columns[1], strict=True)]
            sizes = [len(k) for k in keys]
            if not sum(sizes):
                continue
            maps = np.repeat(np.array([bit_map(x) for x in costly]), sizes, axis=0)
            node, n, r, c = (np.repeat(np.array(x), sizes) for x in columns[:4])
            key = np.concatenate(keys).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(np.full(len(key), PART, np.int32)), pa.array(node), pa.array(n), pa.array(np.ones(len(key), np.int32)), pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(np.ones(len(key), bool)), *(pa.array(m) for m in maps.T.copy())],
                COLUMNS,
            )

    able = dense.where(F.col("r") * (100 + percent) <= (100 - percent) * (F.col("n") + F.floor(F.col("n") * 100 / percent)))
    return able.select("node", "n", "r", "c", "costly").mapInArrow(run, ROW)


def key_rows(reps: DataFrame, documents: DataFrame, percent: int) -> DataFrame:
    """All keys of all documents (``ROW``): similar documents share one of a kind that counts for them."""
    rows = rows_of(reps)
    held = stage(rows.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").withColumn("df", F.col("n")), "held")
    total = held.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shared = stage(hot_join(rows.withColumnRenamed("n", "size"), held, "token", total).withColumnRenamed("size", "n"), "shared")
    need = F.col("n") - F.floor((F.lit(percent) * F.col("n") + 99) / 100) + 1  # as prefix_size
    spare = F.greatest(F.lit(SPARE), F.floor(F.lit(SPARE_SHARE) * F.col("n")).cast("int"))
    limit = F.least(need + spare, F.col("n"))
    # every costly shingle before a position pushes the end of the prefix back by one
    end = lambda extra: F.aggregate("spots", (need + extra).cast("int"), lambda e, p: F.when(p < e, e + 1).otherwise(e))
    cost = F.sum(F.when((F.col("df") <= COSTLY) & (F.col("pos") < need), F.col("df") - 1).otherwise(0))
    spots = shared.groupBy("node", "n").agg(F.sort_array(F.collect_list(F.when(F.col("df") > COSTLY, F.col("pos")))).alias("spots"), cost.alias("cost"))  # at most one prefix of one document
    spots = spots.withColumn("extra", F.least(F.ceil(F.col("cost") / need), spare).cast("int"))
    fits = end(F.col("extra")) <= limit
    ends = spots.select("node", F.when(fits, end(F.col("extra"))).otherwise(end(F.lit(0))).alias("end"), F.when(fits, F.col("extra") + 1).otherwise(1).alias("l"), (end(F.lit(0)) > limit).alias("dense"))
    ends = stage(ends, "ends")
    light = shared.where(F.col("df") <= COSTLY).join(ends.where("NOT dense"), "node").where(F.col("pos") < F.col("end"))
    zero, no, yes = F.lit(0), F.lit(False), F.lit(True)
    light = stage(light.select("token", "node", "n", "l"), "light")
    # dense documents: whole sets, and how many dense documents hold each shingle
    whole = stage(whole_sets(documents, stage(ends.where("dense").select("node", F.lit(1).cast("long").alias("held")), "nodes")).select("node", "n", F.xxhash64("shingles").alias("set"), F.posexplode("shingles").alias("pos", "token")), "dense")
    passed = held.where(F.col("df") > COSTLY).select("token", zero.alias("one"), yes.alias("passed"))
    among = whole.select("token", F.lit(1).alias("one"), no.alias("passed")).unionByName(passed).groupBy("token").agg(F.sum("one").alias("n"), F.max("passed").alias("passed"))
    among = stage(among.where("n > 0").select("token", "n", F.col("n").alias("df"), "passed"), "among")
    count = among.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranked = stage(hot_join(whole.withColumnRenamed("n", "size"), among, "token", count).withColumnRenamed("size", "n"), "ranked")
    dear = F.col("df") > COSTLY
    per = ranked.groupBy("node", "n", "set").agg(  # of one document's shingles; rows of repeated documents count once
        F.sort_array(F.collect_set(F.when(~F.col("passed"), F.col("pos")))).alias("ahead"), F.collect_set(F.when(dear, F.col("token"))).alias("costly"),
    )
    per = per.withColumn("c", F.size("costly")).withColumn("r", (F.col("n") - F.col("c")).cast("int"))
    per = stage(per.withColumn("last", F.when(F.size("ahead") > need, F.get("ahead", (need - 1).cast("int"))).otherwise(F.lit(2**31 - 1))), "per")
    first = ranked.where("NOT passed").join(per.select("node", "set", "last"), ["node", "set"]).where(F.col("pos") <= F.col("last")).select("token", "node", "n")
    first = first.join(light.select("token").distinct(), "token", "left_semi")
    cheap = ranked.where(~dear & (F.col("df") > 1)).join(per.select("node", "set", "r", "c"), ["node", "set"])
    key = lambda kind: F.xxhash64(F.lit(kind), "token").alias("key")
    one, blank = F.lit(1), [F.lit(0).cast("long").alias(b) for b in BITS]
    found = (
        light.select(key(PREFIX), F.lit(PREFIX).alias("kind"), "node", "n", "l", zero.alias("r"), zero.alias("c"), no.alias("dense"), *blank)
        .unionByName(first.select(key(PREFIX), F.lit(PREFIX).alias("kind"), "node", "n", one.alias("l"), zero.alias("r"), zero.alias("c"), yes.alias("dense"), *blank))
        .unionByName(cheap.select(key(CHEAP), F.lit(CHEAP).alias("kind"), "node", "n", one.alias("l"), "r", "c", yes.alias("dense"), *blank))
        .unionByName(parts(per, percent))
    )
    return stage(found, "keys")


def apart(left: Sequence[str], right: Sequence[str]) -> Column:
    """Bits in which two bit maps differ."""
    return sum((F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(left, right, strict=True)), F.lit(0))


def may_be_similar(percent: int, n: str, m: str, kind: str, r: str, q: str, c: str, e: str, dense: str, other: str) -> Column:
    """Whether sizes allow it, and whether the kind of key counts for the pair."""
    n, m, kind, r, q, c, e = map(F.col, (n, m, kind, r, q, c, e))
    sizes = (F.least(n, m) * 100 >= F.greatest(n, m) * percent)
    counts = F.when(kind == PREFIX, ~(F.col(dense) & F.col(other))).when(kind == PART, (r + q + F.abs(c - e)) * (100 + percent) <= (100 - percent) * (n + m)).otherwise(True)
    return sizes & counts


def labelled(rows: DataFrame, label: DataFrame | None) -> DataFrame:
    if label is None:
        return rows.withColumn("comp", F.col("node"))
    return rows.join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def spread(rows: DataFrame, turn: int, total: int) -> DataFrame:
    """Per key with holders of several components ``n``, their number, and one drawn holder (``top_*``).

    A light holder is drawn before a dense one; at first a dense one with few cheap shingles, which is near the middle of its group.
    """
    rank = F.struct("dense", F.when(F.lit(turn == 0), F.col("r")).otherwise(0), F.xxhash64("node", F.lit(turn)))
    held = ["node", "n", "comp", "dense", "r", "c", *BITS]
    found = rows.groupBy("key").agg(
        F.min_by(F.struct(*held), rank).alias("top"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("dense").alias("all_dense"), F.min("kind").alias("of"), F.count("*").alias("n"))
    kept = found.where(f"lo <> hi AND NOT (of = {PREFIX} AND all_dense)")
    return stage(kept.select("key", "n", *(F.col(f"top.{c}").alias(f"top_{c}") for c in held)), "spread", total)


def open_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (``a, b``) of different components that share as many keys as they must. ``rows`` are key rows with ``comp``."""
    sides = [[F.col(c).alias(new) for c, new in zip(["node", "n", "l", "r", "c", "dense", "comp"], names, strict=True)] for names in (["a", "n", "l", "r", "c", "dense", "comp"], ["b", "m", "k", "q", "e", "other", "theirs"])]
    test = may_be_similar(percent, "n", "m", "kind", "r", "q", "c", "e", "dense", "other") & (F.col("comp") != F.col("theirs"))

    def met(kind: int, left: Column) -> DataFrame:
        of = rows.where(F.col("kind") == kind)
        return of.where(left).select("key", "kind", *sides[0]).join(of.select("key", "kind", *sides[1]), ["key", "kind"]).where(test)

    # prefixes: at most COSTLY light holders a key, with each other and with the dense holders
    prefix = met(PREFIX, ~F.col("dense")).where("other OR a < b")
    enough = prefix.groupBy("a", "b").agg(F.count("*").alias("shared"), F.least(F.min("l"), F.min("k")).alias("asked")).where("shared >= asked").select("a", "b")
    cheap = met(CHEAP, F.lit(True)).where("a < b").select("a", "b")
    # parts: first which sizes and counts of cheap and costly shingles go together, then the documents that have them
    some = rows.where(F.col("kind") == PART).withColumnRenamed("n", "size")
    profile = some.groupBy("key", "kind", "size", "r", "c").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    mine = profile.select("key", "kind", F.col("size").alias("n"), "r", "c", "lo", "hi", F.lit(True).alias("dense"))
    others = profile.select("key", "kind", F.col("size").alias("m"), F.col("r").alias("q"), F.col("c").alias("e"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.lit(True).alias("other"))
    ordered = F.struct("n", "r", "c") <= F.struct("m", "q", "e")
    fit = mine.join(others, ["key", "kind"]).where(ordered & (F.least("lo", "lo2") < F.greatest("hi", "hi2")) & may_be_similar(percent, "n", "m", "kind", "r", "q", "c", "e", "dense", "other"))
    fit = stage(fit.select("key", "n", "r", "c", "m", "q", "e"), "profiles")
    ours, theirs = (some.select("key", *(F.col(c).alias(x) for c, x in zip(["node", "size", "r", "c", "comp", *BITS], names, strict=True))) for names in (["a", "n", "r", "c", "comp", *BITS], ["b", "m", "q", "e", "theirs", *(f"o{b}" for b in BITS)]))
    near = (F.col("r") + F.col("q") + apart(BITS, [f"o{b}" for b in BITS])) * (100 + percent) <= (100 - percent) * (F.col("n") + F.col("m"))
    # the condition is part of the join, so that pairs which it rules out are never rows
    left = fit.join(ours, ["key", "n", "r", "c"])
    part = left.join(theirs, ["key", "m", "q", "e"]).where((F.col("comp") != F.col("theirs")) & near).select("a", "b")
    return enough.unionByName(cheap).unionByName(part).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_links(reps: DataFrame, documents: DataFrame, percent: int) -> DataFrame:
    """Links (``a, b``) that join all documents connected by similar pairs."""
    rows = key_rows(reps, documents, percent)
    total = max(1, rows.count())
    links, rows = None, labelled(rows, None)
    for turn in range(ROUNDS + 1):
        keys = spread(rows, turn, total)
        left = hot_join(rows.withColumnRenamed("n", "size"), keys, "key", total)  # a key within one component is done with
        if turn == ROUNDS:
            pairs = open_pairs(stage(left.withColumnRenamed("size", "n").select(*COLUMNS, "comp"), "open", total), percent)
        else:
            near = (F.col("kind") != PART) | ((F.col("r") + F.col("top_r") + apart(BITS, [f"top_{b}" for b in BITS])) * (100 + percent) <= (100 - percent) * (F.col("size") + F.col("top_n")))
            met = left.where((F.col("comp") != F.col("top_comp")) & may_be_similar(percent, "size", "top_n", "kind", "r", "top_r", "c", "top_c", "dense", "top_dense") & near)
            pairs = met.select(F.col("node").alias("a"), F.col("top_node").alias("b")).distinct()
        pairs = stage(pairs, "pairs", total if turn < ROUNDS else None)
        tried = pairs.count()
        if tried:
            found = verified(pairs, tried, documents, percent)
            links = found if links is None else stage(links.unionByName(found), "found")
        if turn < ROUNDS:
            label = stage(components(links, total).withColumnRenamed("component", "comp"), "labels", total) if tried else None
            kept = left.withColumnRenamed("size", "n").select(*COLUMNS, "comp")
            rows = stage(labelled(kept.drop("comp"), label) if tried else kept, "open", total)
    return links if links is not None else documents.sparkSession.createDataFrame([], "a long, b long")


def near_duplicates(documents: DataFrame, percent: int = 80) -> DataFrame:
    """Per row of ``documents``: ``doc_id, n_shingles, component_id`` under links of at least ``percent`` % similarity.

    Equal sets are folded into one document before anything else, so copies cost one row each. ``component_id`` is
    the smallest doc_id that links reach.

    Defined cases: null texts and texts without words have no shingles and no links; rows that share a doc_id count
    as linked with each other; rows without a doc_id take the component of equal sets or of none (null), and are not
    compared otherwise; an empty table gives no rows; other columns are ignored.
    """
    documents = documents.select("doc_id", "text")
    sets = stage(sketches(documents, percent), "sketches")
    # one row per distinct set; its node is the smallest doc_id
    reps = stage(sets.where("sig IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("prefix").alias("prefix")), "reps")
    known = reps.where("node IS NOT NULL")
    links = similar_links(known, documents, percent)
    classes = sets.where("sig IS NOT NULL").join(reps.select("sig", "node"), "sig").where("doc_id <> node")
    repeated = sets.groupBy("doc_id").agg(F.countDistinct("sig").alias("k")).where("k > 1").select("doc_id")
    own = classes.join(repeated, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    label = stage(components(links.unionByName(own)), "components")
    of_set = stage(reps.join(label, "node", "left").select("sig", F.coalesce("component", "node").alias("set_component")), "classes")
    return sets.join(of_set, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("set_component", "doc_id").alias("component_id"))
