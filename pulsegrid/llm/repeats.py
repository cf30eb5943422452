"""Removal of repeated byte strings, by column-wise suffix order of many segments.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else too.

* Every window of ``length`` bytes has an anchor, its smallest k-gram hash (leftmost on ties). Equal windows have
  equal anchors at equal offsets, so windows whose anchor occurs once are done with.
* The windows of an anchor are cut into blocks of ``BLOCK`` neighbouring offsets. All windows of a block share a
  core of ``length - BLOCK + 1`` bytes; equal windows have equal cores. What is left of a block is its segment:
  the core's fingerprint and up to ``BLOCK - 1`` bytes on either side. Equal segments are counted as one.
* Anchors that recur at equal, short steps lie in a periodic stretch. They are kept as one run, and its windows give one
  segment with a number, so a text of one repeated letter costs no more than others.
* Segments with equal cores are compared column by column, from the right: each round inserts one symbol per
  segment, updating the sorted order of the suffixes that start in this column (the column's part of the
  collection's Burrows-Wheeler transform) and the common prefix of neighbours. The core is one symbol. Columns lie
  in a sequential file below the shared folder, and a round holds one column. Windows are aligned by their anchors, so suffixes of
  one round are all that need comparing. A window is repeated where a neighbour shares ``length`` bytes.
* A core with more surroundings than one task orders at once is narrowed: one half of its windows covers all bytes
  of a half block to the left of the core, the other half those to the right, so each half gets a longer core that splits it, and
  blocks of half the size are ordered in the same way, down to single windows, which are all core.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import shared_uri, slices, small, stage, width
from pulsegrid.llm.graph import hot_join
from pulsegrid.llm.shingling import BATCH_BYTES, mixed, powers
from pulsegrid.llm.warc import create, opened

LENGTH, GRAM, BLOCK = 400, 32, 64
#: Segments of one core that one task orders together at most, and segments ordered (or cut) at once.
GROUP, CHUNK = 16_384, 16_384
_U = np.uint64
_POS = 26  # bits of a position within a batch
PIECE = 1 << 22


def data_of(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every run of w values."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def anchors(docs: list[bytes], length: int) -> list[tuple[np.ndarray, ...]]:
    """Per document: anchor hash, its position, and the first and last start of the windows it anchors."""
    empty = tuple(np.empty(0, np.int64) for _ in range(4))
    out = [empty] * len(docs)
    long = [i for i, d in enumerate(docs) if len(d) >= length]
    part: list[int] = []
    for i in long:
        if len(docs[i]) >= PIECE + length:  # by overlapping pieces; a run that a border cuts becomes two
            found = [anchors([docs[i][at : at + PIECE + length - 1]], length)[0] for at in range(0, len(docs[i]) - length + 1, PIECE)]
            shifted = [(h, *(x + at * PIECE for x in rest)) for at, (h, *rest) in enumerate(found)]
            out[i] = tuple(map(np.concatenate, zip(*shifted, strict=True)))
            continue
        if part and sum(len(docs[j]) for j in part) + len(docs[i]) >= BATCH_BYTES:
            anchored(docs, part, length, out)
            part = []
        part.append(i)
    if part:
        anchored(docs, part, length, out)
    return out


def anchored(docs: list[bytes], part: list[int], length: int, out: list) -> None:
    raw = np.frombuffer(b"".join(docs[i] for i in part), np.uint8)
    k = min(GRAM, length)
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, _U)
    np.cumsum((raw.astype(_U) + _U(1)) * up[:-1], out=total[1:])
    grams = mixed((total[k:] - total[:-k]) * down[: len(raw) - k + 1])
    places = np.arange(len(grams), dtype=_U)
    ranked = (grams & ~_U((1 << _POS) - 1)) | places
    anchor = (sliding_min(ranked, length - k + 1) & _U((1 << _POS) - 1)).astype(np.int64)
    at = 0
    for i in part:
        own = anchor[at : at + len(docs[i]) - length + 1]
        first = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
        last = np.append(first[1:], len(own)) - 1
        out[i] = grams[own[first]].view(np.int64), own[first] - at, first, last
        at += len(docs[i])


def folded(h: np.ndarray, pos: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchors with ``step`` and ``times``: neighbours of equal hash, all moved on by the same step, which their grams span, are one run."""
    if not len(h):
        return (*(np.empty(0, np.int64) for _ in range(6)),)
    step = np.diff(pos, prepend=pos[0])
    goes_on = np.zeros(len(h), bool)
    goes_on[1:] = (h[1:] == h[:-1]) & (step[1:] <= min(GRAM, length)) & (np.diff(lo) == step[1:]) & (np.diff(hi) == step[1:])
    goes_on[2:] &= ~goes_on[1:-1] | (step[2:] == step[1:-1])
    first = np.flatnonzero(~goes_on)
    times = np.diff(np.append(first, len(h)))
    return h[first], pos[first], lo[first], hi[first], np.where(times > 1, step[np.minimum(first + 1, len(h) - 1)], 0), times


FIELDS = ("h", "pos", "lo", "hi", "step", "times")


def scanned(documents: DataFrame, length: int) -> DataFrame:
    """``row`` (a digest of id and text) and the anchors of each document that has any."""

    def run(batches):
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in FIELDS]))
        for b in slices(batches):
            found = [folded(*f, length) for f in anchors(data_of(b["text"]), length)]
            sizes = np.array([len(f[0]) for f in found])
            values = pa.StructArray.from_arrays([pa.array(np.concatenate([f[j] for f in found])) for j in range(len(FIELDS))], names=FIELDS)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values).cast(kind)
            held = pa.array(sizes > 0)
            yield pa.RecordBatch.from_arrays([b["row"].filter(held), lists.filter(held)], ["row", "anchors"])

    return documents.mapInArrow(run, f"row binary, anchors array<struct<{', '.join(f'{c}: bigint' for c in FIELDS)}>>")


def digest(*parts: bytes) -> bytes:
    h = hashlib.blake2b(digest_size=16)
    for p in parts:
        h.update(len(p).to_bytes(4, "little"))
        h.update(p)
    return h.digest()


def placed(span: dict, data: bytes, length: int) -> list[tuple[int, int, int, int, int]]:
    """Windows of a run of anchors as ``pos, lo, hi, step, times``: those that lie in its periodic stretch once, others one by one."""
    pos, lo, hi, step, times = (span[c] for c in FIELDS[1:])
    if times == 1:
        return [(pos, lo, hi, 0, 1)]
    end = pos + (times - 1) * step + min(GRAM, length)  # the bytes from pos to here repeat at every step
    if data[pos : end - step] != data[pos + step : end]:  # grams of equal hash only
        return [(pos + i * step, lo + i * step, hi + i * step, 0, 1) for i in range(times)]
    first = max(0, -(-(pos - lo) // step))  # from here on windows start in the stretch
    after = max(first, min(times, (end - length - hi) // step + 1))
    alone = [(pos + i * step, lo + i * step, hi + i * step, 0, 1) for i in (*range(min(first, times)), *range(after, times))]
    return alone + ([(pos + first * step, lo + first * step, hi + first * step, step, after - first)] if after > first else [])


SEGMENT = "core binary, before binary, after binary, lo int, hi int, segment binary"


def segments(suspects: DataFrame, length: int) -> DataFrame:
    """``row, start, step, times`` and ``SEGMENT`` of every block of windows under a repeated anchor.

    Window ``start + x`` belongs to the block for lo <= x <= hi; ``before`` and ``after`` are the bytes around the
    core that these windows cover. The same segment stands at ``times`` places, ``step`` bytes apart.
    """
    names = ("row", "start", "step", "times", "core", "before", "after", "lo", "hi", "segment")
    kinds = pa.schema([("row", pa.binary()), *((c, pa.int64()) for c in names[1:4]), *((c, pa.binary()) for c in names[4:7]), ("lo", pa.int32()), ("hi", pa.int32()), ("segment", pa.binary())])

    def run(batches):
        for b in slices(batches, 128):
            out: dict[str, list] = {c: [] for c in names}
            for row, data, spans in zip(b["row"].to_pylist(), data_of(b["text"]), b["spans"].to_pylist(), strict=True):
                for pos, first, last, step, times in (p for span in spans for p in placed(span, data, length)):
                    for block in range((pos - last) // BLOCK, (pos - first) // BLOCK + 1):
                        start = pos - block * BLOCK - (BLOCK - 1)
                        lo, hi = max(first - start, 0), min(last - start, BLOCK - 1)
                        core = digest(data[start + BLOCK - 1 : start + length], block.to_bytes(4, "little"))
                        before, after = data[start + lo : start + BLOCK - 1], data[start + length : start + length + hi]
                        for column, value in zip(out.values(), (row, start, step, times, core, before, after, lo, hi, digest(core, before, after)), strict=True):
                            column.append(value)
                if len(out["row"]) >= CHUNK:
                    yield pa.RecordBatch.from_pydict(out, kinds)
                    out = {c: [] for c in names}
            if out["row"]:
                yield pa.RecordBatch.from_pydict(out, kinds)

    return suspects.mapInArrow(run, f"row binary, start long, step long, times long, {SEGMENT}")


def narrowed(kinds: DataFrame, block: int) -> DataFrame:
    """Both halves of segments of ``block`` windows: ``parent``, ``shift`` of the half within it, ``n`` and ``SEGMENT`` for half the block."""
    half = block // 2
    names = ("parent", "shift", "n", "core", "before", "after", "lo", "hi", "segment")
    schema = pa.schema([("parent", pa.binary()), ("shift", pa.int32()), ("n", pa.int64()), *((c, pa.binary()) for c in names[3:6]), ("lo", pa.int32()), ("hi", pa.int32()), ("segment", pa.binary())])

    def run(batches):
        for b in slices(batches, 1024):
            out: dict[str, list] = {c: [] for c in names}
            for parent, core, before, after, lo, hi, n in zip(*(b[c].to_pylist() for c in ("segment", "core", "before", "after", "lo", "hi", "n")), strict=True):
                if lo < half:  # windows that hold the last ``half`` bytes before the core
                    cut_at = half - 1 - lo
                    put = (digest(core, b"<", before[cut_at:]), before[:cut_at], after[: min(hi, half - 1)], lo, min(hi, half - 1))
                    for column, value in zip(out.values(), (parent, 0, n, *put, digest(*put[:3])), strict=True):
                        column.append(value)
                if hi >= half:  # windows that hold the first ``half`` bytes after it
                    put = (digest(core, b">", after[:half]), before[max(lo, half) - lo :], after[half:], max(lo, half) - half, hi - half)
                    for column, value in zip(out.values(), (parent, half, n, *put, digest(*put[:3])), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_pydict(out, schema)

    return kinds.mapInArrow(run, f"parent binary, shift int, n long, {SEGMENT}")


def insert_column(order: np.ndarray, common: np.ndarray, symbols: np.ndarray, weight: int) -> tuple[np.ndarray, np.ndarray]:
    """Put one symbol before each suffix. ``common[i]`` is the common prefix of the suffixes at places i - 1 and i."""
    at = np.argsort(symbols[order], kind="stable")
    put = order[at]
    same = symbols[put[1:]] == symbols[put[:-1]]
    out = np.zeros(len(order), np.int32)
    if same.any():
        pairs = np.stack([at[:-1][same] + 1, at[1:][same] + 1], axis=1).ravel()
        out[1:][same] = weight + np.minimum.reduceat(np.append(common, 0), pairs)[::2]
    return put, out


def repeated_windows(core: np.ndarray, before: list[bytes], after: list[bytes], length: int, folder: str, block: int = BLOCK) -> np.ndarray:
    """Segments x ``block``: which windows another segment of the collection has too. Rounds go from right to left."""
    n, side = len(core), block - 1
    left, right = np.full((side, n), 256, np.uint16), np.full((side, n), 256, np.uint16)  # 256: beyond the covered bytes
    for i, (x, y) in enumerate(zip(before, after, strict=True)):
        left[side - len(x) :, i] = np.frombuffer(x, np.uint8)
        right[: len(y), i] = np.frombuffer(y, np.uint8)
    order, common = np.arange(n), np.zeros(n, np.int32)
    hit = np.zeros((n, block), bool)

    def mark(x: int) -> None:
        near = common >= length
        hit[order, x] = near | np.append(near[1:], False)

    name = f"{folder}/{uuid.uuid4().hex}"
    with create(name) as columns:
        for c in (*right[::-1], *left[::-1]):
            columns.write(c.tobytes())
    del left, right
    system, path = opened(name)
    with system.open_input_stream(path) as columns:
        for _ in range(side):
            order, common = insert_column(order, common, np.frombuffer(columns.read(2 * n), np.uint16), 1)
        order, common = insert_column(order, common, core, length - side)
        mark(side)
        for x in range(side - 1, -1, -1):
            order, common = insert_column(order, common, np.frombuffer(columns.read(2 * n), np.uint16), 1)
            mark(x)
    system.delete_file(path)
    return hit


def compared(groups: DataFrame, length: int, folder: str, block: int) -> DataFrame:
    """``segment, runs`` of repeated windows, for segments of ``block`` windows dealt and sorted by core."""

    def work(held: list[tuple]) -> pa.RecordBatch:
        number = {c: i for i, c in enumerate(dict.fromkeys(h[1] for h in held))}
        hit = repeated_windows(np.array([number[h[1]] for h in held], np.int64), [h[2] for h in held], [h[3] for h in held], length, folder, block)
        lo, hi = np.array([h[4] for h in held])[:, None], np.array([h[5] for h in held])[:, None]
        x = np.arange(block)[None, :]
        hit &= (x >= lo) & (x <= hi)
        runs = [runs_of(row) for row in hit]
        found = [i for i, r in enumerate(runs) if r]
        return pa.RecordBatch.from_pydict({"segment": [held[i][0] for i in found], "runs": [runs[i] for i in found]}, pa.schema([("segment", pa.binary()), ("runs", pa.list_(pa.list_(pa.int32())))]))

    def run(batches):
        held: list[tuple] = []
        for b in slices(batches, 1024):
            for row in zip(*(b[c].to_pylist() for c in ("segment", "core", "before", "after", "lo", "hi")), strict=True):
                if len(held) >= CHUNK and held[-1][1] != row[1]:
                    yield work(held)
                    held = []
                held.append(row)
        if held:
            yield work(held)

    return groups.mapInArrow(run, "segment binary, runs array<array<int>>")


def runs_of(row: np.ndarray) -> list[list[int]]:
    """First and last index of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], row, [False]]).astype(np.int8)))
    return [[int(a), int(b) - 1] for a, b in zip(edges[::2], edges[1::2], strict=True)]


def kinds_of(rows: DataFrame, n) -> DataFrame:
    """One row per distinct segment, ``n`` how many there are."""
    return rows.groupBy("segment").agg(F.sum(n).alias("n"), *(F.first(c).alias(c) for c in ("core", "before", "after", "lo", "hi")))


def repeated_runs(kinds: DataFrame, length: int, folder: str, block: int = BLOCK) -> DataFrame:
    """``segment, runs``: the windows (first and last ``x`` of each run) that distinct segments (staged, ``n`` of each) repeat."""
    whole = kinds.where("n > 1").select("segment", F.array(F.array("lo", "hi")).alias("runs"))  # these are repeated throughout
    if block == 1:
        return whole  # equal cores are equal windows
    groups = stage(kinds.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").withColumn("kinds", F.col("n")), "groups")
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    several = hot_join(kinds.withColumnRenamed("n", "held"), groups, "core", total).withColumnRenamed("held", "n")
    ordered = several.where(F.col("kinds") <= GROUP).repartition(width(kinds.sparkSession), "core").sortWithinPartitions("core")
    runs = compared(ordered, length, folder, block)
    if not groups.where(F.col("kinds") > GROUP).isEmpty():
        halves = stage(narrowed(several.where(F.col("kinds") > GROUP), block), "halves")
        found = repeated_runs(stage(kinds_of(halves, "n"), "kinds"), length, folder, block // 2)
        moved = F.transform("runs", lambda r: F.transform(r, lambda x: x + F.col("shift")))
        runs = runs.unionByName(halves.select("parent", "shift", "segment").join(found, "segment").select(F.col("parent").alias("segment"), moved.alias("runs")))
    alone = kinds.where("n = 1").select("segment").join(stage(runs, "runs"), "segment")
    return stage(alone.unionByName(whole), "repeated")


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """The maximal runs of bytes that spans cover."""
    runs: list[list[int]] = []
    for lo, hi in sorted(spans):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], hi)
        else:
            runs.append([lo, hi])
    return runs


def cut(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """``data`` without the bytes of the spans, and the maximal removed runs."""
    runs, kept, at = merged(spans), [], 0
    for lo, hi in runs:
        kept.append(data[at:lo])
        at = hi
    return b"".join([*kept, data[at:]]), [(lo, hi) for lo, hi in runs]


def with_rows(documents: DataFrame) -> DataFrame:
    """``row, doc_id, text``; ``row`` is a digest of id and text."""
    return documents.select("doc_id", "text").withColumn("row", F.unhex(F.md5(F.concat_ws("\x01", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("text")))))


def repeated_spans(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """``row, spans`` of the documents with repeats (``with_rows``): their maximal runs of repeated bytes."""
    rows = stage(scanned(documents, length), "rows")
    spots = rows.select("row", F.explode("anchors").alias("a")).select("row", "a.*")
    # settled, so that both sides of the join below are plain exchanges, which Spark can split where an anchor is hot
    twice = stage(spots.groupBy("h").agg(F.sum("times").alias("n")).where("n > 1").select("h"), "anchors")
    listed = spots.join(twice, "h").groupBy("row").agg(F.collect_set(F.struct(*FIELDS)).alias("spans"))
    suspects = documents.join(listed, "row").select("row", "text", "spans")

    found = stage(segments(suspects, length), "segments")
    hits = repeated_runs(stage(kinds_of(found, "times"), "kinds"), length, shared_uri(documents.sparkSession, "columns"))
    reach = (F.col("times") - 1) * F.col("step")  # places of a run are nearer to each other than windows are long
    def whole_runs(batches):
        kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        for b in batches:
            runs = [[{"lo": lo, "hi": hi} for lo, hi in merged([(s["lo"], s["hi"]) for s in spans])] for spans in b["spans"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["row"], pa.array(runs, kind)], ["row", "spans"])

    covered = (
        found.select("row", "start", reach.alias("reach"), "segment").join(hits, "segment").select("row", "start", "reach", F.explode("runs").alias("r"))
        .select("row", F.struct((F.col("start") + F.get("r", F.lit(0))).alias("lo"), (F.col("start") + F.col("reach") + F.get("r", F.lit(1)) + length).alias("hi")).alias("s"))
        .groupBy("row").agg(F.collect_set("s").alias("spans"))
    )
    return covered.mapInArrow(whole_runs, "row binary, spans array<struct<lo: bigint, hi: bigint>>")


def remove_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row of ``documents``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, text``.

    ``spans`` are the maximal removed runs as ``[first, end)`` in bytes, ``kept_sha256`` is over the remaining bytes, and
    ``text`` is these as text: a code point that loses some of its bytes is left out of it, but not out of the digest.

    Defined cases: a null text is empty; texts shorter than ``length`` bytes keep everything; equal rows are separate
    documents that repeat each other; a missing doc_id is a value like others; an empty table gives no rows; other
    columns are ignored.
    """
    docs = with_rows(documents)
    spans = stage(repeated_spans(docs, length), "spans")
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "text")
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in names[1:4]), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.list_(pa.int64()))), ("text", pa.string())])

    def run(batches):
        for b in slices(batches, 128):
            data = data_of(b["text"])
            done = [cut(d, [(s["lo"], s["hi"]) for s in spans or ()]) for d, spans in zip(data, b["spans"].to_pylist(), strict=True)]
            columns = (
                b["doc_id"].to_pylist(), [len(d) for d in data], [sum(hi - lo for lo, hi in r) for _, r in done], [len(r) for _, r in done],
                [hashlib.sha256(k).hexdigest() for k, _ in done], [[list(x) for x in r] for _, r in done], [k.decode("utf-8", "ignore") for k, _ in done],
            )
            yield pa.RecordBatch.from_pydict(dict(zip(names, columns, strict=True)), schema)

    given = docs.join(small(spans, "spans"), "row", "left").select("doc_id", "text", "spans")  # texts stay where they are if few have repeats
    return given.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>, text string")
