"""SentencePiece encoding and decoding with shared-prefix Viterbi.

A normalised text is cut into marked words (a run of word marks and what follows up to the next mark); no
piece reaches across that cut. The distinct words of a batch are sorted, which walks their trie depth first:
the forward column of a word starts from the columns it shares with the word before it. A column holds, for
one prefix, the best last piece and its score. In a unigram model the score is the sum of piece scores. In a
BPE model a step from piece to piece is allowed only if merging leaves the two apart, which leaves exactly one
path, the one that merging gives. Backward pointers give the ids.
"""

from __future__ import annotations

import re
from array import array
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pulsegrid.llm.common import slices, texts_of

MARK = "▁"
#: Default vocabulary file; the path is a parameter of every function.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
CACHED_WORDS, CACHED_LENGTH, CACHED_PAIRS = 200_000, 64, 300_000
WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
UNIGRAM, BPE = 1, 2


class Endings:
    """Which pieces end at each position of a text: a trie of the pieces with links to the longest suffix in it."""

    def __init__(self, ids: dict[str, int]):
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[tuple[tuple[int, int], ...]] = [()]
        own = {}
        for piece, i in ids.items():
            at = 0
            for c in piece:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.ends.append(())
                at = self.next[at][c]
            own[at] = (i, len(piece))
        self.suffix = [0] * len(self.next)
        level = [0]
        while level:
            below = []
            for at in level:
                for c, to in self.next[at].items():
                    self.suffix[to] = self.step(self.suffix[at], c) if at else 0
                    self.ends[to] = ((own[to],) if to in own else ()) + self.ends[self.suffix[to]]
                    below.append(to)
            level = below

    def step(self, at: int, c: str) -> int:
        while at and c not in self.next[at]:
            at = self.suffix[at]
        return self.next[at].get(c, 0)


class Pieces:
    """Encoder and decoder over the piece table of one model file."""

    def __init__(self, model: bytes, kind: int | None = None):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        self.kind = kind or proto.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        spec = proto.normalizer_spec
        plain = spec.escape_whitespaces and not (spec.precompiled_charsmap or spec.remove_extra_whitespaces)
        mark = MARK if spec.add_dummy_prefix else ""
        table = sentencepiece.SentencePieceProcessor(model_proto=model)
        every = range(table.vocab_size())
        self.normalise = (lambda t: mark + t.replace(" ", MARK)) if plain else table.normalize
        self.special = {i for i in every if table.is_control(i) or table.is_unknown(i) or table.is_unused(i)}
        self.byte_ids = {int(table.id_to_piece(i)[3:5], 16): i for i in every if table.is_byte(i)}
        self.unknown = table.unk_id()
        self.ids = {table.id_to_piece(i): i for i in every if i not in self.special and not table.is_byte(i)}
        self.scores = {p: table.get_score(i) for p, i in self.ids.items()}
        self.whole = any(MARK in p.lstrip(MARK) for p in self.ids)  # a piece crosses words: the text is one word
        self.unknown_score = min(self.scores.values(), default=0.0) - 10.0
        self.surface = [b"" if i in self.special else table.id_to_piece(i).replace(MARK, " ").encode() for i in every]
        for value, i in self.byte_ids.items():
            self.surface[i] = bytes([value])
        if self.unknown >= 0:
            self.surface[self.unknown] = " ⁇ ".encode()
        self.prefix = self.normalise("a").startswith(MARK)
        self.lead = MARK if plain and mark else ""
        self.values = {i: self.scores[p] for p, i in self.ids.items()}
        self.sizes = {i: len(p) for p, i in self.ids.items()}
        self.endings = Endings(self.ids)
        self.names = {i: p for p, i in self.ids.items()}
        self.apart: dict[int, bool] = {}  # may one piece follow another in a merged text?
        self.known: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by repeated merging: the best-scored pair first, leftmost on ties."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, before: int, i: int) -> bool:
        """BPE: may piece ``i`` follow piece ``before`` (-1: an unknown character, -2: the start of the word)?"""
        if len(self.apart) >= CACHED_PAIRS:
            self.apart.clear()
        left, right = self.names.get(before, ""), self.names[i]
        known = self.apart[(before + 2 << 32) + i] = self.merged(left + right) == [*([left] if left else []), right]
        return known

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids (as int32 bytes) of distinct words, in one depth-first walk over their trie.

        ``last`` and ``score`` are the forward columns of the current word's prefixes, ``node`` the place in the
        automaton of pieces, which knows all pieces that end at a position.
        """
        out: dict[str, bytes] = {}
        merging, known, values, sizes = self.kind == BPE, self.apart, self.values, self.sizes
        step, ends = self.endings.step, self.endings.ends
        last, score, node, before = [-2], [0.0], [0], ""
        for word in sorted(words):
            shared = 0
            limit = min(len(word), len(before))
            while shared < limit and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], score[shared + 1 :], node[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                at = step(node[-1], word[end - 1])
                node.append(at)
                best, top = -1, score[end - 1] + self.unknown_score
                for i, n in ends[at]:  # longest first
                    if merging:
                        fit = known.get((last[end - n] + 2 << 32) + i)
                        if self.fits(last[end - n], i) if fit is None else fit:
                            best = i
                            break
                    elif (total := score[end - n] + values[i]) > top:
                        best, top = i, total
                last.append(best)
                score.append(0.0 if merging else top)
            path, end = [], len(word)
            while end:
                i = last[end]
                if i >= 0:
                    path.append(i)
                    end -= sizes[i]
                else:
                    path += reversed([self.byte_ids[x] for x in word[end - 1].encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown])
                    end -= 1
            path.reverse()
            out[word] = array("i", path).tobytes()
            before = word
        return out

    def words(self, text: str) -> list[str]:
        """The marked words of a text, each without the mark that all of them begin with (``lead``)."""
        if not text:
            return []
        if self.lead and not self.whole and "  " not in text and MARK not in text and text[0] != " " != text[-1]:
            return text.split(" ")
        marked = self.normalise(text)
        return [w[len(self.lead) :] for w in ([marked] if self.whole else WORDS.findall(marked))]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Words seen before keep their ids, up to a fixed number of words."""
        cut = [self.words(t) for t in texts]
        every = set().union(*cut)
        new = every - self.known.keys()
        if len(self.known) + len(new) > CACHED_WORDS:
            self.known.clear()
            new = every
        n = len(self.lead)
        fresh = {w[n:]: x for w, x in self.encode_words([self.lead + w for w in new]).items()}
        short = {w: x for w, x in fresh.items() if len(w) <= CACHED_LENGTH}
        self.known |= short
        get = (self.known if len(short) == len(fresh) else self.known | fresh).__getitem__
        return [np.frombuffer(b"".join(map(get, words)), np.int32) for words in cut]

    def decode(self, ids: list[int]) -> str:
        """The text of a sequence of ids; bytes that are no UTF-8 become replacement characters."""
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_LOADED: dict[bytes, Pieces] = {}


def loaded(model: bytes) -> Pieces:
    """The encoder of a model, kept by the worker from task to task."""
    if model not in _LOADED:
        _LOADED.clear()
        _LOADED[model] = Pieces(model)
    return _LOADED[model]


def read_model(path: str) -> bytes:
    return Path(path).read_bytes()


def encode(documents: DataFrame, model_path: str = MODEL_PATH, text: str = "text") -> DataFrame:
    """Per row of ``documents``: ``doc_id, n_tokens, token_ids``.

    Defined cases: null and empty texts have no tokens; characters outside the vocabulary become byte pieces;
    repeated rows repeat; an empty table gives no rows; other columns are ignored. The model file (about half a
    megabyte) is read once by the driver and sent along with the function.
    """
    model = read_model(model_path)

    def run(batches):
        pieces = loaded(model)
        for b in slices(batches, 1024):
            ids = pieces.encode(texts_of(b[text]))
            sizes = np.array([len(x) for x in ids], np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*ids, np.empty(0, np.int32)]), pa.int32()))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(sizes), lists], ["doc_id", "n_tokens", "token_ids"])

    return documents.select("doc_id", text).mapInArrow(run, "doc_id long, n_tokens long, token_ids array<int>")


def decode(tokens: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """Per row of ``tokens`` (``doc_id, token_ids``): ``doc_id, text``. Null ids decode as an empty text."""
    model = read_model(model_path)

    def run(batches):
        pieces = loaded(model)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([pieces.decode(x or []) for x in b["token_ids"].to_pylist()])], ["doc_id", "text"])

    return tokens.select("doc_id", "token_ids").mapInArrow(run, "doc_id long, text string")


def encode_and_check(documents: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """``encode`` plus ``round_trip``: whether decoding the ids gives the text back. Cases as in ``encode``.

    A text that holds the word mark itself comes back with a space in its place, so it does not round-trip.
    """
    model = read_model(model_path)

    def run(batches):
        pieces = loaded(model)
        for b in slices(batches, 1024):
            texts = texts_of(b["text"])
            ids = pieces.encode(texts)
            same = [pieces.decode(x.tolist()) == t for x, t in zip(ids, texts, strict=True)]
            sizes = np.array([len(x) for x in ids], np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*ids, np.empty(0, np.int32)]), pa.int32()))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(sizes), lists, pa.array(same)], ["doc_id", "n_tokens", "token_ids", "round_trip"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, token_ids array<int>, round_trip boolean")
