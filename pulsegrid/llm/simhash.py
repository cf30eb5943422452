"""Near-duplicate documents: SimHash fingerprints that meet at anchor points of a covering code.

The anchors are the words of a linear code of 64 bits; every fingerprint x lies at some distance r(x) from its
nearest anchor, its home, and r(x) is at most the covering radius of the code. Take two fingerprints that differ
in at most t bits, x being the one that lies nearer to its home. Then y is at most r(x) + t <= r(y) + t away from
the home of x. So each fingerprint is copied to every anchor within its own r + t, which the covering radius plus
the threshold bounds, and at each anchor the fingerprints at home there are compared with all that came.

Only distinct fingerprints travel, as packs of 8 bytes each. At an anchor, what is found near is taken out and
searched from in turn, so a large cluster costs its size times what lies around it, and gives one link per member.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import slices, stage, texts_of
from pulsegrid.llm.graph import components, hot_join
from pulsegrid.llm.shingling import mixed

WORDS, SEED, BITS = 4, 42, 64
#: Fewest and most bits of the code; between them, about 2^CELL_BITS fingerprints have their home at an anchor.
FEWEST, MOST, CELL_BITS = 8, 16, 5
#: Fingerprints copied to anchors at once, rows of the distance matrix at once, and shingles hashed at once.
PACKED, TILE, HASHED = 65_536, 4_194_304, 65_536
#: Fingerprints at home at one anchor that one task holds; with more, the anchor is split.
HOMES = 1 << 20
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str) -> int:
    """SimHash of the 4-word shingles of a text, repeats included; 0 without words."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    shingles = max(1, len(words) - WORDS + 1)
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, shingles, HASHED):
        part = words[lo : lo + HASHED + WORDS - 1]
        joined = map(b" ".join, zip(*(part[j:] for j in range(WORDS)), strict=False)) if shingles > 1 or len(words) == WORDS else [b" ".join(part)]
        hashes = np.fromiter(map(xxh64_intdigest, joined, repeat(SEED)), np.dtype("<u8"))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > shingles, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    """Per row of ``documents``: ``doc_id, fp`` (64 bits as a signed number)."""

    def run(batches):
        for b in slices(batches):
            found = np.array([fingerprint(t) for t in texts_of(b["text"])], np.uint64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def anchors(bits: int) -> np.ndarray:
    """The 2^bits words of a linear code: all sums of ``bits`` fixed, scrambled generators."""
    words = np.zeros(1, np.uint64)
    for g in mixed(np.arange(1, bits + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)):
        words = np.concatenate([words, words ^ g])
    return words


def code_bits(distinct: int) -> int:
    """Bits of the code for a number of distinct fingerprints. Any choice gives the same links; this one keeps cells small."""
    return min(MOST, max(FEWEST, max(distinct, 1).bit_length() - CELL_BITS))


def near_anchors(fps: np.ndarray, code: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions in ``fps``, anchors they are copied to, and whether the anchor is their home."""
    who, where, home = [], [], []
    step = max(1, TILE // len(code))
    for lo in range(0, len(fps), step):
        apart = np.bitwise_count(fps[lo : lo + step, None] ^ code)
        nearest = apart.argmin(1)
        reach = apart[np.arange(len(apart)), nearest] + np.uint8(threshold)
        i, a = np.nonzero(apart <= reach[:, None])
        who.append(i + lo)
        where.append(a)
        home.append(a == nearest[i])
    return np.concatenate(who), np.concatenate(where), np.concatenate(home)


def packs(distinct: DataFrame, bits: int, threshold: int) -> DataFrame:
    """``anchor, kind, n, fps``: fingerprints at home at an anchor (kind 0) and others copied to it (kind 1), packed."""

    def run(batches):
        code = anchors(bits)
        for b in batches:
            fps = b["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(fps), PACKED):
                part = fps[lo : lo + PACKED]
                who, where, home = near_anchors(part, code, threshold)
                cell = where * 2 + ~home
                order = np.argsort(cell, kind="stable")
                cell, values = cell[order], part[who[order]]
                first = np.flatnonzero(np.diff(cell, prepend=-1))
                ends = np.append(first[1:], len(cell))
                offsets = np.append(first, len(cell)).astype(np.int32) * 8
                data = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])
                columns = [pa.array((cell[first] // 2).astype(np.int32)), pa.array((cell[first] % 2).astype(np.int32)), pa.array((ends - first).astype(np.int64)), data]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "kind", "n", "fps"])

    return distinct.select("fp").mapInArrow(run, "anchor int, kind int, n long, fps binary")


def linked(homes: np.ndarray, others: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (members, their smallest member) that join all fingerprints near a home, or near one found so."""
    rest, waiting = np.concatenate([homes, others]), len(homes)
    left, right = [], []
    while waiting:
        found, frontier = [rest[:1]], rest[:1]
        rest, waiting = rest[1:], waiting - 1
        while len(frontier) and len(rest):
            step = max(1, TILE // 8 // len(rest))
            ask, frontier = frontier[:step], frontier[step:]
            near = (np.bitwise_count(ask[:, None] ^ rest) <= threshold).any(0)
            if near.any():
                fresh = rest[near]
                waiting -= int(near[:waiting].sum())
                rest = rest[~near]
                found.append(fresh)
                frontier = np.concatenate([frontier, fresh])
        if len(found) > 1:
            group = np.concatenate(found).view(np.int64)
            left.append(group)
            right.append(np.full(len(group), group.min()))
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = np.concatenate(left), np.concatenate(right)
    return a[a != b], b[a != b]


def compared(cells: DataFrame, threshold: int) -> DataFrame:
    """Links ``a, b`` at each cell (``anchor, part``); its rows come homes first and are read in bounded chunks."""

    def run(batches):
        key, homes, others, size, held = None, [], [], 0, 0

        def flush():
            if homes and (others or size == 0):
                a, b = linked(np.concatenate(homes), np.concatenate([*others, np.empty(0, np.uint64)]), threshold)
                for lo in range(0, len(a), PACKED):
                    yield pa.RecordBatch.from_arrays([pa.array(a[lo : lo + PACKED]), pa.array(b[lo : lo + PACKED])], ["a", "b"])

        for batch in batches:
            for anchor, part, kind, fps in zip(*(batch[c].to_pylist() for c in ("anchor", "part", "kind", "fps")), strict=True):
                if key != (anchor, part):
                    yield from flush()
                    key, homes, others, size, held = (anchor, part), [], [], 0, 0
                values = np.frombuffer(fps, np.uint64)
                if kind == 0:
                    homes.append(values)
                    held += len(values)
                elif homes:  # nobody at home: nothing to compare with
                    others.append(values)
                    size += len(values)
                    if size >= max(held, HOMES):
                        yield from flush()
                        others, size = [], 1  # the homes were compared with each other
        yield from flush()

    return cells.mapInArrow(run, "a long, b long")


def similar_links(distinct: DataFrame, bits: int, threshold: int, homes: int = HOMES) -> DataFrame:
    """Links ``a, b`` that connect all distinct fingerprints within ``threshold`` bits; anchors with many homes are split."""
    packed = stage(packs(distinct, bits, threshold), "packs")
    sizes = packed.where("kind = 0").groupBy("anchor").agg(F.sum("n").alias("held"))
    split = sizes.where(F.col("held") > homes).select("anchor", F.ceil(F.col("held") / homes).cast("int").alias("parts"))
    known = packed.join(F.broadcast(split), "anchor", "left")  # at most one row per anchor, 2^MOST
    own = F.pmod(F.xxhash64("fps"), F.col("parts")).cast("int")
    one = known.where("parts IS NULL").select("anchor", F.lit(0).alias("part"), "kind", "fps")
    several = known.where("parts IS NOT NULL").withColumn("own", own).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    several = several.withColumn("kind", F.when((F.col("kind") == 0) & (F.col("part") == F.col("own")), 0).otherwise(1))
    cells = one.unionByName(several.select("anchor", "part", "kind", "fps")).repartition("anchor", "part").sortWithinPartitions("anchor", "part", "kind")
    return compared(cells, threshold).distinct()


def near_duplicates(documents: DataFrame, threshold: int = 4) -> DataFrame:
    """Per row of ``documents``: ``doc_id, fingerprint, component_id`` under links of at most ``threshold`` differing bits.

    Words are runs of other characters than blank and 09 to 0D, A to Z in lower case; shingles are four words,
    repeats count. ``component_id`` is the smallest doc_id that links reach, the row's own included.

    Defined cases: null and empty texts and texts without words have fingerprint 0, linked like any other; with fewer
    than four words the whole sequence is one shingle; rows that share a doc_id are documents of their own; rows
    without a doc_id take part and are null only where no row of their component has an id; an empty table gives no
    rows; other columns are ignored.
    """
    rows = stage(fingerprints(documents), "fingerprints")
    reps = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    distinct, total = reps.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    links = similar_links(reps, code_bits(distinct), threshold)
    label = stage(components(links).select(F.col("node").alias("fp"), F.col("component").alias("root")), "labels")
    named = stage(reps.join(label, "fp", "left").select("fp", "n", "first", F.coalesce("root", "fp").alias("root")), "named")
    tops = stage(named.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n")), "tops")
    of_fp = stage(hot_join(named.withColumnRenamed("n", "copies"), tops, "root", distinct).select("fp", F.col("copies").alias("n"), "component_id"), "components")
    found = hot_join(rows, of_fp, "fp", total)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
