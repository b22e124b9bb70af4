"""Shingle sets, MinHash samples and odd sketches of texts, over Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from cosmolake.llm._shared import mix, slices, span_hash, word_spans

WORDS = 5
BANDS, ROWS = 28, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 256
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9FB21C651E98DF25)


def _constants(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_XOR, _ODD = _constants(SAMPLES, 1), _constants(SAMPLES, 2) | np.uint64(1)
_PLACE = _constants(SAMPLES, 3)
_BAND = _constants(BANDS, 4)


def sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Of each text: the sorted distinct 64-bit hashes of its 5-word shingles (A-Z lower-cased).

    With fewer words the whole sequence is one shingle; without words the set is empty.
    """
    for raw, off in slices(texts):
        raw = _LOWER[raw]
        start, end, doc = word_spans(raw, off)
        h = span_hash(raw, start, end)
        first = np.searchsorted(doc, np.arange(len(off)))
        g = np.zeros(max(0, len(h) - WORDS + 1), np.uint64)
        for k in range(WORDS):
            g = g * _BASE + h[k : k + len(g)]
        g = mix(g)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= WORDS:
                yield np.unique(g[a : b - WORDS + 1])
            elif b > a:
                v = np.full(1, b - a, np.uint64)
                for x in h[a:b]:
                    v = v * _BASE + x
                yield mix(v ^ _BASE)
            else:
                yield h[:0]


def samples(s: np.ndarray) -> np.ndarray:
    """MinHash samples of a set that isn't empty; long sets go piece by piece."""
    low = None
    for k in range(0, len(s), 2048):
        x = ((s[k : k + 2048, None] ^ _XOR) * _ODD).min(axis=0)
        low = x if low is None else np.minimum(low, x)
    return low


def bands(sig: np.ndarray) -> np.ndarray:
    """A key for each band of samples."""
    v = _BAND.copy()
    for row in sig.reshape(BANDS, ROWS).T:
        v = mix(v * _BASE + row)
    return v


def odd_sketch(sig: np.ndarray) -> np.ndarray:
    """Samples folded into a parity bitmap: each toggles one bit, so that common samples cancel in an XOR."""
    bit = (mix(sig ^ _PLACE) % np.uint64(SKETCH_BITS)).astype(np.int64)
    odd = np.bincount(bit, minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def identity(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    a = int(s.sum(dtype=np.uint64)) if len(s) else 0
    b = int(np.bitwise_xor.reduce(mix(s + _BASE))) if len(s) else 0
    return int(np.uint64(a).view(np.int64)), int(np.uint64(b).view(np.int64))
