"""What several operators of this subpackage share: shared folders, hashes over Arrow text, exact components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cosmolake.operators.rounds import folder as shared_dir
from cosmolake.operators.rounds import min_labels, stored

__all__ = ["ARROW_ROWS", "SPACE", "bounded", "components", "fresh", "mix", "released", "releasing", "shared_dir", "slices", "span_hash", "stored", "text_bytes", "word_spans"]


ARROW_ROWS = 2_000


def bounded(spark: SparkSession) -> None:
    """Hold Arrow batches to ``ARROW_ROWS`` rows in this session: texts can be long, and a worker holds a batch and what it makes of it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def released() -> None:
    """Give the memory that this process has freed back to the system. A Python worker outlives its task, and an executor's later stages need the room."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


@contextmanager
def releasing() -> Iterator[None]:
    """Around a task's batches: :func:`released` when they end."""
    try:
        yield
    finally:
        released()


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """A column name for each stem that ``df`` lacks, whatever the case of its own names."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name = f"_{stem}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array in one buffer and the n+1 offsets into it (nulls count as empty)."""
    col = col.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    buf = col.buffers()[2]
    raw = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


SLICE_BYTES = 1 << 19


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """:func:`text_bytes` of consecutive stretches of at most ``most`` bytes (one text at least), to bound the arrays made of them."""
    raw, off = text_bytes(texts)
    a = 0
    while a < len(off) - 1:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, side="right")) - 1)
        yield raw[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


_ODD = 0x9E3779B97F4A7C15
_INV = pow(_ODD, -1, 1 << 64)
_POW: dict[str, np.ndarray] = {}


def _powers(n: int, base: int, name: str) -> np.ndarray:
    have = _POW.get(name)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        p = np.full(size, base, np.uint64)
        p[0] = 1
        np.multiply.accumulate(p, out=p)
        _POW[name] = have = p
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (murmur3's), elementwise and out of place."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def span_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans that depend on nothing but the spans' bytes.

    A polynomial prefix sum modulo 2**64 gives every span in two look-ups; the
    odd base has an inverse, so a span's value doesn't depend on its place.
    """
    n = len(raw)
    if not len(start):
        return np.zeros(0, np.uint64)
    sub = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(raw.astype(np.uint64) + np.uint64(0x51ED270B)) * _powers(n, _ODD, "odd"), out=sub[1:])
    h = (sub[end] - sub[start]) * _powers(n + 1, _INV, "inv")[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the words ``[^\\x20\\x09-\\x0D]+`` of all texts in the buffer."""
    inside = ~SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = off[1:-1]
    cut = cut[cut < len(raw)]
    first[cut] |= inside[cut]
    start = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = cut[cut > 0] - 1
    last[before] |= inside[before]
    end = np.flatnonzero(last) + 1
    doc = np.searchsorted(off, start, side="right") - 1
    return start, end, doc


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable, for every node on an edge."""
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    e = stored(e, "edges")
    return min_labels(e.select(F.col("a").alias("node")).union(e.select("b")), e).withColumnRenamed("label", "root")
