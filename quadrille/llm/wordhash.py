"""64-bit hashes of the words of many texts at once, without a Python step per word.

Words are cut at ASCII white space. A word's hash is a polynomial of random values of its bytes, read
from one running sum over all bytes: (sum at its end - sum at its start) / base^start, modulo 2^64.
"""

from __future__ import annotations

import numpy as np

CHUNK = 1 << 20  # bytes hashed at a time; a longer word enlarges its chunk

_BASE = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20240229)
EXACT = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = EXACT.copy()
_LOWER[65:91] = EXACT[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64 bits without visible order."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(max(n, CHUNK + 1), base, dtype=np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def span_hashes(a: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hashes of stretches of a byte array."""
    up, down = _power(len(a) + 1)
    run = np.zeros(len(a) + 1, dtype=np.uint64)
    np.cumsum(table[a] * up[: len(a)], out=run[1:])
    return mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of stretches, one stretch after the other."""
    ends = np.cumsum(counts, dtype=np.int64)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def same_spans(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, some: np.ndarray, which: np.ndarray) -> bool:
    """Whether stretches that are taken as one (``which`` of ``some``) have one length and the same eight bytes at their begin."""
    padded = np.append(raw, np.zeros(8, np.uint8))
    head = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[starts]).view("<u8").ravel()
    spare = np.maximum(8 - sizes, 0).astype(np.uint64) * np.uint64(8)
    head = (head << spare) >> spare
    return bool((sizes == sizes[some][which]).all() and (head == head[some][which]).all())


def _hash_chunk(a: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words of a byte array; it may begin and end inside white space, not in a word."""
    word = ~_SPACE[a]
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    return starts, ends, span_hashes(a, starts, ends, table)


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts in UTF-8 with a space behind each, and where each begins and the last ends. Null is empty."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    return np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8), np.cumsum([0, *[len(r) + 1 for r in raw]])


def words_of(buffer: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of all words of a buffer that ends in white space; with ``lower`` A-Z count as a-z."""
    table = _LOWER if lower else EXACT
    starts, ends, hashes, at = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)], 0
    while at < len(buffer):
        end = min(at + CHUNK, len(buffer))
        if end < len(buffer):
            gaps = np.flatnonzero(_SPACE[buffer[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:  # one word fills the chunk: on to its end
                while end < len(buffer) and not _SPACE[buffer[end]]:
                    end += 1
        s, e, h = _hash_chunk(buffer[at:end], table)
        starts.append(s + at), ends.append(e + at), hashes.append(h)
        at = end
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def word_hashes(texts: list[str | None], lower: bool) -> list[np.ndarray]:
    """For each text the hashes of its words in order; with ``lower`` A-Z count as a-z. Null is empty."""
    buffer, offsets = joined(texts)
    starts, _, every = words_of(buffer, lower)
    where = np.searchsorted(starts, offsets)
    return [every[where[i] : where[i + 1]] for i in range(len(texts))]


def rolled(w: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words; empty when there are fewer."""
    h = np.full(max(len(w) - width + 1, 0), width, dtype=np.uint64)
    for i in range(width):
        h = h * np.uint64(_BASE) + w[i : i + len(h)]
    return mix(h)
