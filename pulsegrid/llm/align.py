"""Alignment of two tokenizers over the same texts by merge-path partitioning.

Both token sequences of a text end at byte offsets; merging the two sorted lists of ends walks over all overlaps
of A and B tokens. The walk has one step per end, so a diagonal i + j = d cuts it into work done and work left, and
a binary search on the diagonal finds where. Diagonals at equal distances cut the walk into independent pieces of
equal work, whatever the lengths of texts and tokens. A piece gives its overlaps; an A end whose equal B end comes
first in the next piece is met there, and groups that reach over a boundary are stitched by the cuts before and after.

Texts of a task lie one behind the other: their ends are common ends, so one walk serves them all. Counts over the
corpus: distinct id pairs are first listed once per block of documents, with the number of documents that hold
them; those rows are summed, joined back per block, and meet the block's documents, packed as positions in the list.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections import defaultdict
from itertools import chain, count
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import slices, stage, texts_of

#: Default vocabulary files; the paths are parameters of every function.
A_PATH, B_PATH = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: The usual splitting pattern of byte-level vocabularies, and the word mark of piece vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MARK = "▁"
#: Letters up to here are letters in every version of the Unicode tables.
LATER = re.compile("[^\x00-ɏ]")
LONG_RUN = re.compile(r"\S{5000}|\s{5000}")
#: Ends merged per piece, bytes of text encoded at once, listed pairs per block, and links of a group beyond which ids are counted first.
WORK, TEXT_BYTES, BLOCK_PAIRS, LARGE = 65_536, 1 << 21, 1 << 21, 4096
#: Words whose ids a worker keeps, and their greatest length.
KEPT_WORDS, KEPT_LENGTH = 400_000, 48


class ByteVocabulary:
    """Byte-level BPE from a tokenizer file: ids of texts, and the bytes of every id."""

    def __init__(self, file: bytes):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_str(file.decode())
        self.slow.encode_special_tokens = True  # their strings in a text are ordinary text
        spec = json.loads(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes shown as themselves; the rest follow from 256 on
        shown = {chr(c): c for c in plain} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in plain)}
        extra = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        size = max([*vocab.values(), *extra.values()]) + 1
        self.bytes = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(map(shown.__getitem__, token)) if token not in extra else token.encode()
        for token, i in extra.items():
            self.bytes[i] = token.encode()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        order = [vocab[x + y] for x, y in pairs]
        pre = spec.get("pre_tokenizer") or {}
        self.usual = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.fast = None
        if self.usual and all(x < y for x, y in zip(order, order[1:], strict=False)):  # merged in the order of ids: ranks say the same
            import tiktoken

            ranks = {self.bytes[i]: i for t, i in vocab.items() if t not in extra}
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast is None or LATER.search(text) or LONG_RUN.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


class PieceVocabulary:
    """A SentencePiece model: ids of texts, and the bytes of every id."""

    def __init__(self, file: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_proto=file)
        every = range(self.model.vocab_size())
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(file)
        plain = spec.normalizer_spec
        self.by_word = (  # every word has a mark before it, and no piece goes on beyond a word
            plain.escape_whitespaces and plain.add_dummy_prefix and not (plain.precompiled_charsmap or plain.remove_extra_whitespaces)
            and not any(MARK in self.model.id_to_piece(i).lstrip(MARK) for i in every)
        )
        self.bytes = [
            bytes([int(self.model.id_to_piece(i)[3:5], 16)]) if self.model.is_byte(i) else self.model.id_to_piece(i).replace(MARK, " ").encode() for i in every
        ]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)


class Aligner:
    """Both vocabularies, with what alignment needs of them as arrays."""

    def __init__(self, a_file: bytes, b_file: bytes):
        self.a, self.b = ByteVocabulary(a_file), PieceVocabulary(b_file)
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in v.bytes], np.int64) for v in (self.a, self.b))
        self.span = len(self.b.bytes)  # an id pair is a * span + b
        self.names = max(len(self.a.bytes), self.span)
        self.by_word = self.a.usual and self.b.by_word
        self.known: dict[str, bytes] = {}  # the first words met, which most texts are made of
        self.written = [str(i).encode() + end for end in (b",", b"|", b";") for i in range(self.names)]

    def tokens(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of a text in both; none where either does not spell space and text."""
        if not text:
            return [], []
        raw = (" " + text).encode("utf-8", "surrogatepass")
        b = self.b.encode(text)
        if b"".join(map(self.b.bytes.__getitem__, b)) != raw:
            return [], []
        a = self.a.encode(" " + text)
        return (a, b) if b"".join(map(self.a.bytes.__getitem__, a)) == raw else ([], [])


    def words_of(self, text: str) -> list:
        """What can be encoded on its own, in order: words between single spaces, which no token of either side crosses, else the whole text, as a tuple."""
        if self.by_word and text and "  " not in text and MARK not in text and text[0] != " " != text[-1]:
            return text.split(" ")
        return [(text,)]

    def learn(self, words: list[str]) -> list[bytes]:
        """Of each word with the space before it: how many ids A has, these, and those of B, as int32 bytes; empty for a word not spelled by both."""
        a, b = [self.a.encode(" " + w) for w in words], self.b.model.encode(words)
        raw = [(" " + w).encode("utf-8", "surrogatepass") for w in words]
        spelled = []
        for ids, sizes, spell in ((a, self.a_sizes, self.a.bytes), (b, self.b_sizes, self.b.bytes)):
            flat = list(chain.from_iterable(ids))
            ends = np.append(0, np.cumsum(sizes[np.array(flat, np.int64)]))[np.append(0, np.cumsum([len(i) for i in ids])).astype(np.int64)]
            spelled.append((np.diff(ends) == [len(r) for r in raw]).all() and b"".join(map(spell.__getitem__, flat)) == b"".join(raw))
        fine = all(spelled)  # all words at once, else one by one
        return [
            array("i", [len(x), *x, *y]).tobytes() if fine or b"".join(map(self.a.bytes.__getitem__, x)) == r == b"".join(map(self.b.bytes.__getitem__, y)) else b""
            for x, y, r in zip(a, b, raw, strict=True)
        ]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """Ids of all texts in A and in B, one text behind the other, and how many each text has."""
        cut = [self.words_of(t) for t in texts]
        place: dict = defaultdict(count().__next__)
        order = np.fromiter(map(place.__getitem__, chain.from_iterable(cut)), np.int64)
        units = list(place)
        found = list(map(self.known.get, units))
        new = [k for k, f in enumerate(found) if f is None and isinstance(units[k], str)]
        for k, f in zip(new, self.learn([units[k] for k in new]) if new else [], strict=True):
            found[k] = f
            if len(units[k]) <= KEPT_LENGTH and len(self.known) < KEPT_WORDS:
                self.known[units[k]] = f
        if b"" in found:  # such a text is tried as a whole
            odd = {u for u, f in zip(units, found, strict=True) if f == b""}
            fixed = [t if odd.isdisjoint(c) else None for t, c in zip(texts, cut, strict=True)]
            parts = [self.encode([t]) if t is not None else self._whole(w) for t, w in zip(fixed, texts, strict=True)]
            return tuple(np.concatenate([p[k] for p in parts]) for k in range(4))
        for k, f in enumerate(found):
            if f is None:
                a, b = self.tokens(units[k][0])
                found[k] = array("i", [len(a), *a, *b]).tobytes()
        pool = np.frombuffer(b"".join(found), np.int32).astype(np.int64)
        sizes = np.fromiter(map(len, found), np.int64) // 4
        starts = np.cumsum(sizes) - sizes
        n_a = pool[starts]
        ends = np.append(0, np.cumsum([len(c) for c in cut])).astype(np.int64)
        out = []
        for first, size in ((starts + 1, n_a), (starts + 1 + n_a, sizes - 1 - n_a)):
            of = size[order]
            out.append((pool[np.repeat(first[order], of) + runs(of)], np.diff(np.append(0, np.cumsum(of))[ends])))
        return out[0][0], out[1][0], out[0][1], out[1][1]

    def _whole(self, text: str) -> tuple[np.ndarray, ...]:
        a, b = self.tokens(text)
        return np.array(a, np.int64), np.array(b, np.int64), np.array([len(a)]), np.array([len(b)])


def diagonals(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of the first ``at`` steps of merging the sorted ``a`` and ``b`` (``a`` first on ties) take from ``a``: binary searches on all diagonals at once."""
    low, high = np.maximum(0, at - len(b)), np.minimum(at, len(a))
    while (low < high).any():
        mid = (low + high) // 2
        more = (low < high) & (a[np.minimum(mid, len(a) - 1)] <= b[np.clip(at - mid - 1, 0, len(b) - 1)])
        low, high = np.where(more, mid + 1, low), np.where(more | (low >= high), high, mid)
    return low


def overlaps(a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping tokens (positions in A, in B) of one piece, in order: those met at its A ends and at its B ends."""
    at_a = j0 + np.searchsorted(b[j0:j1], a[i0:i1])  # the B token that holds the last byte of each A token
    at_b = i0 + np.searchsorted(a[i0:i1], b[j0:j1])
    alone = np.ones(j1 - j0, bool)  # B ends that are no A end as well, else the overlap is there already
    inside = at_b < i1
    alone[inside] = a[at_b[inside]] != b[j0:j1][inside]
    if i0 and j0 < j1 and a[i0 - 1] == b[j0]:
        alone[0] = False  # met by the piece before
    i, j = np.concatenate([np.arange(i0, i1), at_b[alone]]), np.concatenate([at_a, np.arange(j0, j1)[alone]])
    order = np.lexsort((j, i))
    return i[order], j[order]


def pieces(a: np.ndarray, b: np.ndarray, work: int = WORK):
    """The overlaps of every piece of ``work`` steps."""
    total = len(a) + len(b)
    at = np.append(np.arange(0, total, work), total)
    i = diagonals(a, b, at)
    j = at - i
    for k in range(len(at) - 1):
        yield overlaps(a, b, i[k], i[k + 1], j[k], j[k + 1])


def cuts(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """Positions in A and in B of the tokens that end where the other ends too; they close the groups, across pieces."""
    found = [(i[(same := a[i] == b[np.minimum(j, len(b) - 1)])], j[same]) for i, j in pieces(a, b, work)] if len(a) and len(b) else []
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def runs(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. within each of consecutive runs of the given sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class Aligned:
    """Groups and linked id pairs of some texts.

    Per text ``n_a, n_b, n_groups, n_links, groups`` (written out) and ``held``, its number of distinct pairs;
    ``pairs`` (sorted within each text) and ``weights``, how many links have the pair, text by text.
    """

    def __init__(self, aligner: Aligner, texts: list[str], work: int = WORK):
        a, b, self.n_a, self.n_b = aligner.encode(texts)
        last_a, last_b = cuts(np.cumsum(aligner.a_sizes[a]), np.cumsum(aligner.b_sizes[b]), work)
        p, q = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        text = np.searchsorted(np.cumsum(self.n_a), last_a, side="right")
        self.n_groups = np.bincount(text, minlength=len(texts)).astype(np.int64)
        self.n_links = np.zeros(len(texts), np.int64)
        np.add.at(self.n_links, text, p * q)
        self._write(aligner, a, b, last_a, last_b, p, q)
        self._pair(aligner, a, b, last_a - p + 1, last_b - q + 1, p, q, text)

    def _write(self, aligner, a, b, last_a, last_b, p, q):
        """A and B ids of a group stand together: each id's place is its own position and what the other side has before it."""
        end_a, end_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        end_a[last_a], end_b[last_b] = 1, 2
        flat = np.empty(len(a) + len(b), np.int64)
        flat[np.arange(len(a)) + np.repeat(last_b - q + 1, p)] = a + end_a * aligner.names
        flat[np.arange(len(b)) + np.repeat(last_a + 1, q)] = b + end_b * aligner.names
        words = list(map(aligner.written.__getitem__, flat.tolist()))
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        self.groups = [b"".join(words[lo:hi])[:-1] for lo, hi in zip([0, *ends], ends, strict=False)]

    def _pair(self, aligner, a, b, first_a, first_b, p, q, text):
        whole = len(aligner.a.bytes) * aligner.span
        few = p * q <= LARGE
        keys, weights = [], []
        fa, fb, fp, fq, ft = (x[few] for x in (first_a, first_b, p, q, text))
        size = fp * fq
        k = runs(size)
        width = np.repeat(fq, size)
        i, j = np.repeat(fa, size) + k // width, np.repeat(fb, size) + k % width
        keys.append(np.repeat(ft, size) * whole + a[i] * aligner.span + b[j])
        weights.append(np.ones(len(k), np.int64))
        for g in np.flatnonzero(~few).tolist():  # long stretches without a common end: each id once, with its number
            x, m = np.unique(a[first_a[g] : first_a[g] + p[g]], return_counts=True)
            y, n = np.unique(b[first_b[g] : first_b[g] + q[g]], return_counts=True)
            keys.append((text[g] * whole + x[:, None] * aligner.span + y).ravel())
            weights.append((m[:, None] * n).ravel())
        key, weight = np.concatenate(keys), np.concatenate(weights)
        order = np.argsort(key, kind="stable")
        key, weight = key[order], weight[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.pairs = key[first] % whole
        self.weights = np.add.reduceat(weight, first) if len(first) else weight
        self.held = np.bincount(key[first] // whole, minlength=len(self.n_a)).astype(np.int64)


_LOADED: dict[tuple[bytes, bytes], Aligner] = {}


def loaded(a_file: bytes, b_file: bytes) -> Aligner:
    """The vocabularies, kept by the worker from task to task."""
    key = (hashlib.sha256(a_file).digest(), hashlib.sha256(b_file).digest())
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Aligner(a_file, b_file)
    return _LOADED[key]


def files(documents: DataFrame, a_path: str, b_path: str):
    """Both vocabulary files (a few megabytes), read by the driver and broadcast."""
    return documents.sparkSession.sparkContext.broadcast((Path(a_path).read_bytes(), Path(b_path).read_bytes()))


def bounded(batches):
    """``doc_ids, texts`` of a bounded number of bytes; a longer text stands alone."""
    ids, texts, size = [], [], 0
    for b in slices(batches, 512):
        for i, t in zip(b["doc_id"].to_pylist(), texts_of(b["text"]), strict=True):
            if texts and size + len(t) > TEXT_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(t)
            size += len(t)
    if texts:
        yield ids, texts


def align(documents: DataFrame, a_path: str = A_PATH, b_path: str = B_PATH) -> DataFrame:
    """Per row of ``documents``: ``doc_id, n_a, n_b, n_groups, n_links, groups``; ``groups`` as ``a1,a2|b1;a3|b2,b3``. Cases as in ``alignment``."""
    given = files(documents, a_path, b_path)

    def run(batches):
        aligner = loaded(*given.value)
        for ids, texts in bounded(batches):
            x = Aligned(aligner, texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, (x.n_a, x.n_b, x.n_groups, x.n_links)), pa.array([g.decode() for g in x.groups])], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string")


PACKED = pa.schema(
    [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("steps", pa.list_(pa.int32())), ("weights", pa.list_(pa.int64()))]
)


def packed(ids, parts, listed) -> bytes:
    """The documents of a block as one compressed Arrow batch; pairs as steps between their places in the block's list."""
    held = np.concatenate([x.held for x in parts])
    offsets = np.append(0, np.cumsum(held))
    steps = np.diff(listed, prepend=0).astype(np.int32)
    starts = offsets[:-1][held > 0]
    steps[starts] = listed[starts]
    place = pa.array(offsets.astype(np.int32))
    per = [pa.array(np.concatenate([getattr(x, c) for x in parts])) for c in ("n_a", "n_b", "n_groups", "n_links")]
    digests = [hashlib.sha256(g).hexdigest() if g else "" for x in parts for g in x.groups]
    weights = np.concatenate([x.weights for x in parts])
    batch = pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), *per, pa.array(digests, pa.string()), pa.ListArray.from_arrays(place, pa.array(steps)), pa.ListArray.from_arrays(place, pa.array(weights))], schema=PACKED
    )
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, PACKED, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


BLOCKS = "block long, pair long, holders long, documents binary"


def blocks(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per block one row ``block, documents`` and one row ``block, pair, holders`` for every id pair its documents hold."""
    given = files(documents, a_path, b_path)

    def run(batches):
        aligner = loaded(*given.value)
        block = TaskContext.get().partitionId() << 32

        def closed(ids, parts):
            pairs, listed, holders = np.unique(np.concatenate([x.pairs for x in parts]), return_inverse=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([packed(ids, parts, listed)], pa.binary())], names)
            for lo in range(0, len(pairs), WORK):
                n = min(WORK, len(pairs) - lo)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(pairs[lo : lo + n]), pa.array(holders[lo : lo + n].astype(np.int64)), pa.nulls(n, pa.binary())], names)

        names = ["block", "pair", "holders", "documents"]
        every, parts, size = [], [], 0
        for ids, texts in bounded(batches):
            parts.append(Aligned(aligner, texts))
            every += ids
            size += len(parts[-1].pairs) + len(ids)
            if size >= BLOCK_PAIRS:
                yield from closed(every, parts)
                every, parts, size, block = [], [], 0, block + 1
        if parts:
            yield from closed(every, parts)

    return documents.select("doc_id", "text").mapInArrow(run, BLOCKS)


def pair_counts(found: DataFrame, span: int) -> DataFrame:
    """``pair, n, best``: documents that hold the id pair linked, and whether none of its A id's pairs is in more."""
    counts = stage(found.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("holders").alias("n")), "pairs")
    a = F.expr(f"pair div {span}").alias("a")
    top = counts.groupBy(a).agg(F.max("n").alias("top"))  # one row per A id at most: bounded by the vocabulary
    return counts.withColumn("a", a).join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def scored(key, answers: pa.Table, block: pa.Table) -> pa.Table:
    """The documents of a block with what the corpus-wide counts of their pairs say."""
    order = np.argsort(answers["pair"].to_numpy())
    n, best = answers["n"].to_numpy()[order], answers["best"].to_numpy(zero_copy_only=False)[order]
    docs = pa.ipc.open_stream(block["documents"][0].as_buffer()).read_all().combine_chunks()
    steps, weights = (docs[c].combine_chunks().flatten().to_numpy() for c in ("steps", "weights"))
    held = docs["steps"].combine_chunks().value_lengths().to_numpy()
    ends = np.cumsum(held)
    total = np.cumsum(steps, dtype=np.int64)
    starts = np.minimum(ends - held, max(0, len(steps) - 1))
    place = total - np.repeat((total[starts] - steps[starts]) if len(steps) else np.zeros(len(held), np.int64), held)
    add = lambda x: np.diff(np.append(0, np.cumsum(x))[np.append(0, ends)])
    columns = {c: docs[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    columns |= {"n_best": pa.array(add(weights * best[place])), "count_sum": pa.array(add(weights * n[place])), "groups_sha256": docs["groups_sha256"]}
    return pa.table(columns)


def alignment(documents: DataFrame, a_path: str = A_PATH, b_path: str = B_PATH) -> DataFrame:
    """Per row of ``documents``: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    A encodes space and text, B the text (it adds the space). Links are all pairs of an A and a B token in one group; a
    pair of ids counts in how many rows of ``documents`` it is linked. ``n_best`` are the links whose pair is in as many as
    any pair of its A id, ``count_sum`` adds the counts of all links.

    Defined cases: texts null, empty or not spelled by both have zeros and an empty digest; repeated rows count each;
    null ids stay null; an empty table gives no rows; other columns are ignored.
    """
    span = PieceVocabulary(Path(b_path).read_bytes()).model.vocab_size()
    found = stage(blocks(documents, a_path, b_path), "blocks")
    counts = stage(pair_counts(found, span), "counts")
    answers = found.where("pair IS NOT NULL").select("block", "pair").join(counts, "pair").groupBy("block")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    held = found.where("documents IS NOT NULL").select(F.col("block").alias("of"), "documents").groupBy("of")
    return answers.cogroup(held).applyInArrow(scored, schema)
