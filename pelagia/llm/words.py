"""Words and shingles of whole texts, hashed in numpy for a batch of texts at once."""

from __future__ import annotations

import numpy as np

from pelagia.llm.common import mix64

_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
#: Multipliers of the words of a shingle, by place.
PLACE = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
BASE = 0x5851F42D4C957F2D
UNBASE = pow(BASE, -1, 1 << 64)
#: ASCII white space, the only bytes between words.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _POWERS[base] = have = np.multiply.accumulate(have)
    return have[:n]


def chunked(texts: list[bytes], limit: int = 1 << 21):
    """Slices of the list of about ``limit`` bytes, so that numpy's temporaries stay small."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, k
            start, size = k, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text, end to end, and the number of words of each text.

    A word is a run of bytes other than ASCII white space, with A-Z lower-cased.
    """
    raw = LOWER[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
    blank = BLANK[raw]
    edge = np.diff(np.concatenate([[True], blank]).astype(np.int8))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE[raw] * powers(BASE, len(raw)), out=total[1:])
    h = mix64((total[last] - total[first]) * powers(UNBASE, len(raw))[first] + (last - first).astype(np.uint64))
    ends = np.cumsum([len(t) + 1 for t in texts])
    n = np.searchsorted(first, ends)
    return h, np.diff(np.concatenate([[0], n]))


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``width``-word shingles of each text.

    A text with fewer words has its whole sequence as its one shingle; one
    without words has the empty set.
    """
    out: list[np.ndarray] = []
    for a, b in chunked(texts):
        h, n = word_hashes(texts[a:b])
        places = max(1, len(h) - width + 1)
        whole = np.zeros(places, np.uint64)
        for k in range(min(width, len(h))):
            part = h[k : k + places]
            whole[: len(part)] += mix64(part * PLACE[k])
        at = 0
        for words in n.tolist():
            if words >= width:
                out.append(np.unique(mix64(whole[at : at + words - width + 1])))
            elif words:
                out.append(mix64((mix64(h[at : at + words] * PLACE[:words]).sum(keepdims=True) + np.uint64(words)) * PLACE[width]))
            else:
                out.append(np.zeros(0, np.uint64))
            at += words
    return out
