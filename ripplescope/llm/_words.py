"""Words of texts as 64-bit hashes, computed for many texts at once.

Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased. A word's hash is a polynomial
of its bytes modulo 2^64, taken from prefix sums, and then mixed; different words of a corpus of n words
share a hash with probability of about n^2 / 2^65.
"""
from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes hashed at once; temporaries take about 50 times as much, at any length of text.
BLOCK = 1 << 18


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse for the places in a block."""
    out = []
    for base in (_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64))):
        steps = np.full(BLOCK + 1, base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


_POWER, _INVERSE = _powers()


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and the number of words of each text.

    The texts are gone through in blocks of bytes; a word that goes on in the next block is carried over.
    """
    raw = [t.encode() for t in texts]
    stops = np.cumsum([len(r) + 1 for r in raw])
    data = np.frombuffer((b"\n".join(raw) + b"\n").lower(), np.uint8)
    del raw
    hashes, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    held = began = size = 0  # hash, start and length of the word carried over
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[part], [True])).view(np.int8)))
        start, end = edge[0::2], edge[1::2]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part + np.uint64(1)) * _POWER[: len(part)], out=sums[1:])
        found = (sums[end] - sums[start]) * _INVERSE[start]
        length = (end - start).astype(np.uint64)
        place = start + at
        if size:
            if len(start) and start[0] == 0:
                found[0] = np.uint64((held + int(found[0]) * pow(int(_BASE), size, 1 << 64)) & 0xFFFFFFFFFFFFFFFF)
                length[0] += np.uint64(size)
                place[0] = began
            else:
                found, length, place = (np.concatenate(([x], y)).astype(y.dtype) for x, y in ((np.uint64(held), found), (np.uint64(size), length), (began, place)))
            size = 0
        if len(end) and end[-1] == len(part) and at + len(part) < len(data):
            held, began, size = int(found[-1]), int(place[-1]), int(length[-1])
            found, length, place = found[:-1], length[:-1], place[:-1]
        hashes.append(mix(found + length))
        starts.append(place)
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(starts), stops), prepend=0)
