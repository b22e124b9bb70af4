"""Byte-level BPE encoding and decoding.

``encode`` turns texts into token ids and ``decode`` ids into bytes. Each
pre-token is merged with a segment tree over its byte positions: a leaf holds
the rank of the pair that starts at its live position, every inner node the
leftmost least rank below it, and a merge updates the merged position, the
swallowed one and the live neighbour on the left, each in O(log n).
Pre-tokens are looked up in a task's bounded memo, so merging runs once
per distinct pre-token and not once per occurrence.

Nulls count as empty texts and give no ids. Texts are whole, of any length.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cosmolake.llm._shared import fresh, released

INF = 1 << 60
FAN = 8  #: Children of a node of the segment tree.
TOGETHER = 5000  #: Pieces whose trees stand side by side.
ROWS = 1_000  #: Texts whose chunks are held at once.
MEMO = 800_000  #: Entries of a task's memo; the oldest half goes beyond that, which changes no result.


@lru_cache(2)
def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file (base64 token, rank)."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token: the leftmost pair of least rank is merged until no pair has a rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    get = ranks.get
    # A leaf holds rank * n + position of the pair that starts there, so the least value is the leftmost least rank.
    leaves = [INF if (r := get(piece[i : i + 2])) is None else r * n + i for i in range(n - 1)]
    leaves.append(INF)
    tree = [leaves]
    while len(tree[-1]) > FAN:
        below = tree[-1]
        tree.append([min(below[k : k + FAN]) for k in range(0, len(below), FAN)])
    upper, root = tree[1:], tree[-1]
    end = list(range(1, n + 1))  # end of the token that starts here
    begin = list(range(n))  # start of the token that ends just before position + 1
    low = min(root)
    while low < INF:
        i = low % n
        j = end[i]
        stop = end[j]
        end[i] = stop
        begin[stop - 1] = i
        leaves[j] = INF
        leaves[i] = INF if stop >= n or (r := get(piece[i : end[stop]])) is None else r * n + i
        changed = [i, j]
        if i:
            h = begin[i - 1]
            leaves[h] = INF if (r := get(piece[h:stop])) is None else r * n + h
            changed.append(h)
        if upper:
            for k in changed:
                below = leaves
                for level in upper:
                    k //= FAN
                    least = min(below[FAN * k : FAN * k + FAN])
                    if level[k] == least:
                        break
                    level[k] = least
                    below = level
        low = min(root)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Pairs:
    """Ranks of token pairs in sorted arrays: two tokens merge if their bytes together are a token, whose rank is its id."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.base = max(ranks.values(), default=0) + 1
        found = [(ranks[t[:k]] * self.base + ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        found.sort()
        self.keys = np.array([k for k, _ in found] or [-1], np.int64)
        self.rank = np.array([r for _, r in found] or [0], np.int64)
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)

    def find(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, -1 where they don't merge."""
        key = x * self.base + y
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], -1)


def merge_many(pieces: list[bytes], pairs: Pairs) -> list[tuple[int, ...]]:
    """:func:`merge_bytes` of many pieces of at most ``FAN**2`` bytes that aren't tokens themselves."""
    return [_ids(b) for b in _merged(pieces, pairs)]


def _packed(ids: Iterable[int]) -> bytes:
    return np.fromiter(ids, np.int32).tobytes()


def _ids(packed: bytes) -> tuple[int, ...]:
    return tuple(np.frombuffer(packed, np.int32).tolist())


def _merged(pieces: list[bytes], pairs: Pairs) -> list[bytes]:
    """Packed ids of pieces as in :func:`merge_many`: their trees side by side, one merge of each a step."""
    lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
    n, width = len(pieces), -(-int(lens.max()) // FAN) * FAN
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    place = np.arange(width)
    inside = place < lens[:, None]
    token = np.full((n, width + 1), -1, np.int64)
    token[:, :-1][inside] = pairs.single[raw]
    end = np.tile(np.arange(1, width + 2), (n, 1))  # end of the token that starts here
    begin = np.tile(np.arange(-1, width), (n, 1))  # start of the token that ends here
    leaf = np.full((n, width), INF, np.int64)  # rank * width + position: the least is the leftmost least rank
    pair = place < lens[:, None] - 1
    r = pairs.find(token[:, :-1][pair], token[:, 1:][pair])
    leaf[pair] = np.where(r < 0, INF, r * width + np.broadcast_to(place, pair.shape)[pair])
    block = leaf.reshape(n, -1, FAN).min(axis=2)
    row = np.arange(n)
    low = block.min(axis=1)
    while len(row := row[low[row] < INF]):
        merged, i = np.divmod(low[row], width)
        j = end[row, i]
        stop = end[row, j]
        token[row, i], end[row, i], begin[row, stop] = merged, stop, i
        h = begin[row, i]
        r = pairs.find(merged, token[row, stop])
        leaf[row, j] = INF
        leaf[row, i] = np.where((r < 0) | (stop >= lens[row]), INF, r * width + i)
        left = h >= 0
        r = pairs.find(token[row[left], h[left]], merged[left])
        leaf[row[left], h[left]] = np.where(r < 0, INF, r * width + h[left])
        for k in (i, j, h):
            b = np.maximum(k, 0) // FAN
            block[row, b] = leaf.reshape(n, -1, FAN)[row, b].min(axis=1)
        low[row] = block[row].min(axis=1)
    # Live starts are those that the chain of ends reaches.
    live = np.zeros((n, width + 1), bool)
    live[:, 0] = True
    for k in range(width):
        at = np.flatnonzero(live[:, k] & (k < lens))
        live[at, end[at, k]] = True
    live[:, :-1] &= inside
    live[:, -1] = False
    flat, cut = token[live].astype(np.int32).tobytes(), (4 * np.cumsum(live.sum(axis=1))).tolist()
    return [flat[a:b] for a, b in zip([0, *cut[:-1]], cut, strict=True)]


class _Known(dict):
    """Packed ids of pre-tokens, and of chunks whose ends are sure to be pre-token ends.

    Two generations of half the bound each: when one is full it becomes the
    old one, from which what is still in use comes back.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        super().__init__()
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.old: dict[str, bytes] = {}
        self.pairs = Pairs(ranks)
        self.complete = bool((self.pairs.single >= 0).all())

    def learn(self, found: set[str]) -> None:
        """Merge the unknown short pre-tokens among these chunks together, by length, and keep them."""
        by: dict[int, list[str]] = defaultdict(list)
        ranks, old = self.ranks, self.old
        new = {c for c in found if c not in self and c not in old}
        for c in {x for c in new for x in self.find(c)}:
            if c in self or c in old:
                continue
            raw = c.encode()
            if raw in ranks:
                self[c] = _packed((ranks[raw],))
            elif self.complete and len(raw) <= FAN * FAN:
                by[-(-len(raw) // FAN)].append(c)
        for group in by.values():
            for k in range(0, len(group), TOGETHER):
                part = group[k : k + TOGETHER]
                self.bound()
                self.update(zip(part, _merged([c.encode() for c in part], self.pairs), strict=True))

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            found = self.find(chunk)
            if len(found) == 1:
                ids = _packed(merge_bytes(chunk.encode(), self.ranks))
            else:
                ids = b"".join(map(self.__getitem__, found))
        if len(chunk) <= 256:
            self.bound()
            self[chunk] = ids
        return ids

    def bound(self) -> None:
        if len(self) >= MEMO // 2:
            self.old = dict(self)
            self.clear()


class _Memo:
    """A worker's memo: the ids of a chunk by ``[]``, those of many at once by ``packed``."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.known = _Known(ranks, pattern)

    def __getitem__(self, chunk: str) -> tuple[int, ...]:
        return _ids(self.known[chunk])

    def packed(self, cut: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.known.__getitem__, cut)), np.int32)

    def forget(self) -> None:
        self.known.clear()
        self.known.old = {}


@lru_cache(2)
def _memo(path: str, pattern: str) -> _Memo:
    return _Memo(load_ranks(path), pattern)


def chunks(text: str) -> list[str]:
    """``text`` cut where every pre-token ends for certain.

    A blank before a non-blank always opens a pre-token of the GPT family's
    patterns, and a line feed between two non-blanks is one by itself. Where
    blanks or feeds adjoin, the text is cut before the last blank only.
    """
    out: list[str] = []
    add = out.append
    hold = ""  # a stretch that has to stay together
    for n, line in enumerate(text.split("\n")):
        parts = line.split(" ")
        first = parts[0]
        if n:
            if not first or first[0].isspace() or hold and hold[-1].isspace():
                hold += "\n" + first
            else:
                if hold:
                    add(hold)
                add("\n")
                hold = first
        else:
            hold = first
        for p in parts[1:]:
            if p and not p[0].isspace():
                if hold:
                    add(hold)
                hold = " " + p
            else:
                hold += " " + p
    if hold:
        add(hold)
    return out


def encode_text(text: str, path: str, pattern: str) -> list[int]:
    """Ids of one text, without special tokens."""
    return _memo(path, pattern).packed(chunks(text)).tolist()


def encode(df: DataFrame, text: str, path: str, pattern: str, out: str = "ids") -> DataFrame:
    """``df`` with ``out`` (array<int>): the ids of column ``text`` by the ranks in ``path``.

    ``pattern`` is a pre-token pattern of the GPT family: a blank may lead a
    pre-token, other white space stands apart. Column ``out`` of ``df`` is
    replaced. Empty and null texts give an empty array.
    """

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with _forgetting(path, pattern):
            for texts in batches:
                yield _list_array(_encoded(texts, path, pattern))

    return df.withColumn(out, run(F.col(text)))


@contextmanager
def _forgetting(path: str, pattern: str) -> Iterator[None]:
    """Empty the memo when a task ends, and give its memory back: its worker lives on and may serve other stages."""
    try:
        yield
    finally:
        _memo(path, pattern).forget()
        released()


def _encoded(texts: pa.Array, path: str, pattern: str) -> list[np.ndarray]:
    memo, out = _memo(path, pattern), []
    for k in range(0, len(texts), ROWS):
        cut = [chunks(t.as_py() or "") for t in texts[k : k + ROWS]]
        memo.known.learn(set(chain.from_iterable(cut)))
        out += map(memo.packed, cut)
    return out


def _list_array(parts: list[np.ndarray]) -> pa.ListArray:
    off = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=off[1:])
    return pa.ListArray.from_arrays(off, np.concatenate(parts) if parts else np.zeros(0, np.int32))


@lru_cache(2)
def _table(path: str) -> dict[int, bytes]:
    return {r: t for t, r in load_ranks(path).items()}


def decode(df: DataFrame, ids: str, path: str, out: str = "decoded") -> DataFrame:
    """``df`` with ``out`` (binary): the bytes that the ids stand for. A null array gives no bytes; an unknown id raises."""

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        look = _table(path).__getitem__
        for arrays in batches:
            off, flat = arrays.offsets.to_numpy(), arrays.values.to_numpy(zero_copy_only=False).tolist()
            nulls = arrays.is_null().to_numpy(zero_copy_only=False)
            yield pa.array([b"" if nulls[k] else b"".join(map(look, flat[off[k] : off[k + 1]])) for k in range(len(arrays))], pa.binary())

    return df.withColumn(out, run(F.col(ids)))


def encode_decode(df: DataFrame, text: str, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """:func:`encode` and then :func:`decode` of its ids, in one worker a task instead of two."""

    @F.arrow_udf("struct<ids:array<int>,decoded:binary>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        look = _table(path).__getitem__
        with _forgetting(path, pattern):
            for texts in batches:
                parts = _encoded(texts, path, pattern)
                raw = pa.array([b"".join(map(look, p.tolist())) for p in parts], pa.binary())
                yield pa.StructArray.from_arrays([_list_array(parts), raw], ["ids", "decoded"])

    (both,) = fresh(df, "both")
    x = df.withColumn(both, run(F.col(text)))
    return x.withColumns({ids: F.col(both)["ids"], decoded: F.col(both)["decoded"]}).drop(both)


def ids_text(ids: str) -> Column:
    """Decimal ids joined by commas."""
    return F.array_join(F.col(ids).cast("array<string>"), ",")
