"""Sets of hashed word shingles, computed for many texts at once."""

from __future__ import annotations

import numpy as np

WORDS_PER_SHINGLE = 5
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes hashed at once (a longer text is hashed alone), and powers that a worker keeps.
BATCH_BYTES, KEPT_POWERS = 1 << 20, (1 << 20) + 4096
#: The same for sets of shingles: temporary arrays are tens of times as large.
SET_BYTES = 1 << 18
_powers = [np.ones(1, _U), np.ones(1, _U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2^64."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    fresh = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        steps = np.full(max(n, KEPT_POWERS), base, _U)
        steps[0] = 1
        fresh.append(np.multiply.accumulate(steps))
    if n <= KEPT_POWERS:
        _powers[:] = fresh
    return fresh[0][:n], fresh[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text and the number of words per text.

    A to Z count as lower case; words are runs of bytes other than blank and 09 to 0D.
    """
    raw = np.frombuffer(b" ".join([*texts, b" "]), np.uint8)
    raw = raw + (((raw >= 65) & (raw <= 90)) * np.uint8(32))
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, _U)
    np.cumsum((raw.astype(_U) + _U(1)) * up[:-1], out=total[1:])
    hashes = mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))
    limits = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(starts, np.concatenate([[0], limits])))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than a shingle make one, no words none."""
    out, part, size = [], [], 0
    for raw in (t.encode("utf-8", "surrogatepass") for t in texts):
        if part and size + len(raw) >= SET_BYTES:
            out += _sets(part)
            part, size = [], 0
        part.append(raw)
        size += len(raw) + 1
    return out + _sets(part) if part else out


def _sets(texts: list[bytes]) -> list[np.ndarray]:
    hashes, counts = word_hashes(texts)
    k = WORDS_PER_SHINGLE
    rolled = np.zeros(max(0, len(hashes) - k + 1), _U)
    for j in range(k):
        rolled += mixed(hashes[j : len(hashes) - k + 1 + j] + _U((j + 1) * 0xA24BAED4963EE407 % 2**64))
    rolled = mixed(rolled)
    out, at = [], 0
    for n in counts.tolist():
        if n >= k:
            out.append(np.unique(rolled[at : at + n - k + 1]))
        elif n:
            few = sum((mixed(hashes[at + j : at + j + 1] + _U((j + 1) * 0xA24BAED4963EE407 % 2**64)) for j in range(n)), np.zeros(1, _U))
            out.append(mixed(few + _U(n)))
        else:
            out.append(np.empty(0, _U))
        at += n
    return out
