"""Language identification with interpolated Kneser-Ney character models.

Counting: every labelled text is cut into words, words into character
``ORDER``-grams over the padded word; Spark sums the grams of a language over
the whole corpus. Fitting: lower orders take continuation counts, every order
its own discount, and the lowest falls back on the uniform distribution. Each
order's probabilities lie in sorted arrays of 64-bit gram hashes, and for each
gram the languages that have it with their values; a sorted array of contexts
holds the weights of backing off in the same way. So the model grows with the
pairs of gram and language that were seen, not with their product. Scoring:
the language of least cross-entropy a character wins, and the prediction is
marked as rejected if its value is above the middle between what that model
gives its own language and what it gives the nearest other one. Those values
come from a tenth of the texts (by hash) and a model of the others.

Words are runs of letters, lower-cased. Null texts and texts without a letter
have no prediction. The model is made of all counted grams of every language,
rare ones too; ``max_grams`` of :func:`train` is off unless a caller sets it.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cosmolake.llm._shared import mix, stored

ORDER = 4
FLUSH = 200_000  #: Distinct words that a counting task holds.
MEMO = 300_000  #: Words whose scores a worker keeps; it starts afresh beyond that, which changes no result.
HELD = 10  #: One text in so many calibrates the limits.
CELLS = 1 << 21  #: Windows times languages that are worked on at once.
SHARPNESS = 12.0
PAD, END = "\x02", "\x03"
_WORD = re.compile(r"[^\W\d_]+")
_PRIME = np.uint64(0x100000001B3)


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(counted: dict[str, int], order: int) -> Counter:
    """``order``-grams of padded words, weighted; each ends at a letter or at the word's end."""
    out: dict[str, int] = defaultdict(int)
    pad = PAD * (order - 1)
    for w, n in counted.items():
        p = pad + w + END
        for i in range(len(w) + 1):
            out[p[i : i + order]] += n
    return out


def count(df: DataFrame, text: str, lang: str, order: int = ORDER) -> DataFrame:
    """(lang, gram, n, held) over all rows of ``df`` with a text and a language; ``held`` is the part of ``n`` that calibrates."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, bool], Counter] = defaultdict(Counter)

        def flushed() -> Iterator[pa.RecordBatch]:
            for (name, aside), c in seen.items():
                g = grams(c, order)
                n = pa.array(g.values(), pa.int64())
                yield pa.record_batch([pa.array([name] * len(g), pa.string()), pa.array(g.keys(), pa.string()), n, n if aside else pa.array([0] * len(g), pa.int64())], ["lang", "gram", "n", "held"])
            seen.clear()

        for b in batches:
            for t, *key in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                c = seen[tuple(key)]
                c.update(words(t.as_py()))
                if len(c) > FLUSH // max(1, len(seen)):
                    yield from flushed()
        yield from flushed()

    rows = df.select(F.col(text).alias("text"), F.col(lang).alias("lang"), (F.pmod(F.xxhash64(F.col(text)), F.lit(HELD)) == 0).alias("aside")).where("text is not null and lang is not null")
    return rows.mapInArrow(task, "lang string, gram string, n long, held long").groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("held").alias("held"))


@dataclass
class Pairs:
    """Values of (hash, language) pairs: sorted distinct hashes, where the languages of each start, the languages and the values."""

    keys: np.ndarray
    starts: np.ndarray
    langs: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, langs: np.ndarray, values: np.ndarray) -> Pairs:
        by = np.lexsort((langs, keys))
        keys, first = np.unique(keys[by], return_index=True)
        return cls(keys, np.append(first, len(by)).astype(np.int64), langs[by].astype(np.int32), values[by].astype(np.float32))

    def add(self, total: np.ndarray, left: np.ndarray, rows: np.ndarray, h: np.ndarray, close: bool) -> None:
        """Add the values of hashes ``h`` to these rows of ``total`` where ``left`` says so; with ``close`` no more comes there."""
        at = np.minimum(np.searchsorted(self.keys, h), max(0, len(self.keys) - 1))
        hit = self.keys[at] == h if len(self.keys) else np.zeros(len(h), bool)
        at, rows = at[hit], rows[hit]
        n = self.starts[at + 1] - self.starts[at]
        flat = np.repeat(self.starts[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        r, k = np.repeat(rows, n), self.langs[flat]
        use = left[r, k]
        r, k = r[use], k[use]
        total[r, k] += self.values[flat[use]]
        if close:
            left[r, k] = False


@dataclass
class Model:
    """By order: log probabilities of (gram, language) pairs, and log weights of backing off of (context, language) pairs."""

    langs: list[str]
    order: int = ORDER
    logp: list[Pairs] = field(default_factory=list)
    weight: list[Pairs] = field(default_factory=list)
    floor: float = -12.0
    limit: np.ndarray | None = None

    @property
    def grams(self) -> list[np.ndarray]:
        """Hashes of the distinct grams of each order."""
        return [x.keys for x in self.logp]


def fold(codes: np.ndarray) -> np.ndarray:
    """Hashes of the rows of a matrix of code points."""
    h = np.full(len(codes), 0xCBF29CE484222325, np.uint64)
    for k in range(codes.shape[1]):
        h = (h ^ codes[:, k].astype(np.uint64)) * _PRIME
        h ^= h >> np.uint64(29)
    return mix(h)


def _codes(rows: list[str], width: int) -> np.ndarray:
    return np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32).reshape(-1, width)


def _pair(h: np.ndarray, lang: np.ndarray) -> np.ndarray:
    return mix(h ^ mix(lang.astype(np.uint64) + np.uint64(1)))


def fit(rows: list[tuple[str, str, int]], order: int = ORDER) -> Model:
    """The model of (lang, gram, n) rows; grams are ``order`` long. Its limits are those of the rows themselves."""
    langs = sorted({r[0] for r in rows})
    column = {x: k for k, x in enumerate(langs)}
    lang, codes, n = np.array([column[r[0]] for r in rows], np.int64), _codes([r[1] for r in rows], order), np.array([r[2] for r in rows], np.int64)
    model = fitted(langs, lang, codes, n)
    cross = cross_entropies(model, lang, codes, n)
    model.limit = limits(cross, cross)
    return model


def fitted(langs: list[str], lang: np.ndarray, codes: np.ndarray, n: np.ndarray) -> Model:
    """The model of counts ``n`` of (language number, gram) pairs, without limits; ``codes`` has a row of code points for each gram."""
    order, wide = codes.shape[1], len(langs)
    model = Model(langs, order)
    levels = [(lang, codes, n)]
    for _ in range(order - 1):  # continuation counts: distinct grams that end so
        lang, codes, _ = levels[0]
        _, first, kinds = np.unique(_pair(fold(codes[:, 1:]), lang), return_index=True, return_counts=True)
        levels.insert(0, (lang[first], codes[first, 1:], kinds))
    alphabet = max(2, len(np.unique(levels[0][1])) + 1)
    model.floor = -float(np.log(alphabet))
    below: tuple[np.ndarray, np.ndarray] | None = None
    for lang, codes, n in levels:
        ones, twos = (np.bincount(lang[n == c], minlength=wide) for c in (1, 2))
        discount = np.clip(np.where(ones + twos > 0, ones / np.maximum(ones + 2 * twos, 1), 0.5), 0.05, 0.95)
        head = fold(codes[:, :-1])
        _, first, at = np.unique(_pair(head, lang), return_index=True, return_inverse=True)
        total, kinds = np.bincount(at, n, minlength=len(first)), np.bincount(at, minlength=len(first))
        back = discount[lang[first]] * kinds / np.maximum(total, 1)
        h = fold(codes)
        lower = 1.0 / alphabet
        if below is not None:  # every suffix of a gram is there
            lower = below[1][np.searchsorted(below[0], _pair(fold(codes[:, 1:]), lang))]
        p = np.maximum(n - discount[lang], 0) / np.maximum(total[at], 1) + back[at] * lower
        model.logp.append(Pairs.of(h, lang, np.log(p)))
        model.weight.append(Pairs.of(head[first], lang[first], np.log(back)))
        key = _pair(h, lang)
        by = np.argsort(key)
        below = key[by], p[by]
    return model


def window_scores(model: Model, window: np.ndarray) -> np.ndarray:
    """Log probability of the last character of each row of code points, under each language."""
    total = np.zeros((len(window), len(model.langs)))
    left = np.ones(total.shape, bool)
    rows = np.arange(len(window))
    for k in range(model.order - 1, -1, -1):
        g = window[rows, model.order - 1 - k :]
        model.logp[k].add(total, left, rows, fold(g), close=True)
        some = left[rows].any(axis=1)
        rows, g = rows[some], g[some]
        if not len(rows):
            break
        model.weight[k].add(total, left, rows, fold(g[:, :-1]), close=False)
    return total + model.floor * left


def cross_entropies(model: Model, lang: np.ndarray, codes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Mean negative log probability a character; row: language of the text (NaN where it has none), column: model."""
    wide = len(model.langs)
    sums, total = np.zeros((wide, wide)), np.bincount(lang, n, minlength=wide)
    step = max(1, CELLS // max(1, wide))
    for a in range(0, len(n), step):
        part = slice(a, a + step)
        np.add.at(sums, lang[part], -window_scores(model, codes[part]) * n[part, None])
    with np.errstate(invalid="ignore"):
        return sums / np.where(total > 0, total, np.nan)[:, None]


def limits(cross: np.ndarray, other: np.ndarray) -> np.ndarray:
    """For each model the middle between its own language and the nearest other one; where ``cross`` lacks a language, ``other`` stands in."""
    cross = np.where(np.isnan(cross), other, cross)
    own = np.diag(cross)
    near = np.where(np.eye(len(cross), dtype=bool), np.inf, cross).min(axis=0, initial=np.inf)
    return np.where(np.isfinite(near), (own + near) / 2, 2 * own)


def train(df: DataFrame, text: str, lang: str, order: int = ORDER, max_grams: int | None = None) -> Model:
    """Count all labelled rows in Spark and fit on every gram; with ``max_grams``, no more than so many rows, the most frequent, reach the driver."""
    counts = stored(count(df, text, lang, order), "grams")
    if max_grams is not None:
        hist = {r["b"]: r["c"] for r in counts.groupBy(F.floor(F.log2("n")).alias("b")).agg(F.count("*").alias("c")).collect()}
        left, least = 0, 1
        for b in sorted(hist, reverse=True):
            left += hist[b]
            if left > max_grams:
                least = 1 << (b + 1)
                break
        counts = counts.where(F.col("n") >= least)
    rows = counts.toArrow()
    langs = sorted(set(rows["lang"].unique().to_pylist()))
    place = {x: k for k, x in enumerate(langs)}
    parts = [(np.zeros(0, np.int64), np.zeros((0, order), np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for b in rows.to_batches(max_chunksize=100_000):
        name = b.column("lang").dictionary_encode()
        which = np.array([place[x] for x in name.dictionary.to_pylist()], np.int64)
        parts.append((which[name.indices.to_numpy()], _codes(b.column("gram").to_pylist(), order), b.column("n").to_numpy(), b.column("held").to_numpy()))
    del rows
    at, codes, n, held = (np.concatenate(x) for x in zip(*parts, strict=True))
    by = np.lexsort((at, fold(codes)))  # a fixed order, whatever order the tasks ended in
    at, codes, n, held = at[by], codes[by], n[by], held[by]
    model = fitted(langs, at, codes, n)
    if langs:
        rest, aside = n > held, held > 0
        some = fitted(langs, at[rest], codes[rest], (n - held)[rest])
        apart = cross_entropies(some, at[aside], codes[aside], held[aside])
        apart[:, np.bincount(at[rest], minlength=len(langs)) == 0] = np.nan
        model.limit = limits(apart, cross_entropies(model, at, codes, n))
    return model


def word_scores(model: Model, batch: list[str]) -> np.ndarray:
    """Log probability of each word (its end included) under each language."""
    pad = PAD * (model.order - 1)
    codes = np.frombuffer("".join(pad + w + END for w in batch).encode("utf-32-le"), np.uint32)
    lens = np.fromiter((len(w) + 1 for w in batch), np.int64, len(batch))
    ends = np.cumsum(lens)
    out, step = [], max(1, CELLS // len(model.langs))
    word = np.repeat(np.arange(len(batch)), lens)
    at = np.arange(ends[-1]) + (model.order - 1) * (word + 1)
    for a in range(0, len(at), step):
        window = codes[at[a : a + step, None] - np.arange(model.order - 1, -1, -1)]
        out.append(window_scores(model, window))
    return np.add.reduceat(np.concatenate(out), np.concatenate([[0], ends[:-1]]))


class _Scorer:
    def __init__(self, model: Model) -> None:
        self.model, self.seen = model, {}
        self.table = np.zeros((1 << 12, len(model.langs) + 1))

    def rows(self, found: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(found) if w not in self.seen]
        if new:
            if len(self.seen) + len(new) > MEMO:
                self.seen.clear()
                new = list(dict.fromkeys(found))
            base = len(self.seen)
            if base + len(new) > len(self.table):
                more = np.zeros((2 * (base + len(new)), self.table.shape[1]))
                more[:base] = self.table[:base]
                self.table = more
            self.table[base : base + len(new), :-1] = word_scores(self.model, new)
            self.table[base : base + len(new), -1] = [len(w) + 1 if any(map(str.isalpha, w)) else 0 for w in new]
            self.seen.update(zip(new, range(base, base + len(new)), strict=True))
        return self.table[np.fromiter(map(self.seen.__getitem__, found), np.int64, len(found))]

    def text(self, text: str) -> np.ndarray:
        """Summed log probabilities by language, and the characters that they are of."""
        found, total = words(text), np.zeros(self.table.shape[1])
        for k in range(0, len(found), 100_000):
            total += self.rows(found[k : k + 100_000]).sum(axis=0)
        return total


RESULT = "struct<lang:string,score:double,cross_entropy:double,rejected:boolean>"
_TYPE = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("cross_entropy", pa.float64()), ("rejected", pa.bool_())])


def predict(df: DataFrame, text: str, model: Model, out: str = "lang_id") -> DataFrame:
    """``df`` with ``out``: the language (``und`` without a letter), its share of a softmax over negative cross-entropies, that cross-entropy, and whether it is rejected."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        scorer = _Scorer(m) if m.langs else None
        for texts in batches:
            rows = []
            for t in texts:
                s = t.as_py()
                total = scorer.text(s) if s and scorer else None
                if total is None or not total[-1]:
                    rows.append({"lang": "und", "score": 0.0, "cross_entropy": None, "rejected": True})
                    continue
                ce = -total[:-1] / total[-1]
                k = int(ce.argmin())
                share = 1 / np.exp(np.minimum(SHARPNESS * (ce[k] - ce), 0)).sum()
                rows.append({"lang": m.langs[k], "score": float(share), "cross_entropy": float(ce[k]), "rejected": bool(ce[k] > m.limit[k])})
            yield pa.array(rows, _TYPE)

    return df.withColumn(out, run(F.col(text)))
