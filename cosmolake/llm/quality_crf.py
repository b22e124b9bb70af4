"""Document quality from a linear-chain conditional random field over lines.

Every line with a word is a position of the chain, labelled good or bad. Node
features describe the line and its two neighbours (letter classes, repeated
words, repeated lines, word lengths); edge potentials tie neighbouring labels.
A document's quality is the mean of the forward-backward marginals for
"good", weighted by the lines' lengths in bytes.

Training takes a bounded sample of labelled documents: the first ``MAX_DOCS``
by a hash of doc_id, of these as many whole ones as have ``MAX_LINES`` lines
together; one that doesn't fit is passed over. Their lines inherit the
document's label. Scoring runs over whole texts. Texts that are null, empty or without a word score 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cosmolake.llm._shared import SPACE, mix, releasing, slices, span_hash, stored, word_spans

MAX_DOCS = 6_000  #: Bound of the training sample, in documents.
MAX_LINES = 300_000  #: Bound of the training sample, in lines of all its documents.
ROUNDS, RATE, RIDGE = 250, 0.08, 2e-3


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER = _class(bytes(range(65, 91)))
_LOWER = _class(bytes(range(97, 123)))
_DIGIT = _class(b"0123456789")
_SYMBOL = _class(b"#*$%&|<>{}[]\\^~=_/@+")
_LOUD = _class(b"!?")
_HIGH = _class(bytes(range(128, 256)))
N_LINE = 11
N_FEATURES = 3 * N_LINE + 1


@dataclass(frozen=True)
class Model:
    """Node weights and the 2 x 2 edge potentials (rows: label before; 0 bad, 1 good)."""

    weights: np.ndarray
    edge: np.ndarray


def line_features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line with a word, the lines' byte lengths, and the n+1 offsets of the texts into the lines."""
    n = len(off) - 1
    cut = np.unique(np.concatenate([np.flatnonzero(raw == 10) + 1, off[:-1], off[1:]]))
    cut = cut[cut <= len(raw)]
    start, end = cut[:-1], cut[1:]
    ws, we, _ = word_spans(raw, off)
    line_of = np.searchsorted(start, ws, side="right") - 1
    words = np.bincount(line_of, minlength=len(start)).astype(np.float64)
    keep = words > 0
    new = np.cumsum(keep) - 1
    line_of, start, end, words = new[line_of], start[keep], end[keep], words[keep]
    m = len(start)
    doc = np.searchsorted(off, start, side="right") - 1
    first = np.searchsorted(doc, np.arange(n + 1))
    if not m:
        return np.zeros((0, N_FEATURES)), np.zeros(0), first

    def count(mask: np.ndarray) -> np.ndarray:
        c = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(mask[raw], out=c[1:])
        return (c[end] - c[start]).astype(np.float64)

    ink = (end - start) - count(SPACE)
    h = span_hash(raw, ws, we)
    again = np.zeros(len(ws))
    again[1:] = (h[1:] == h[:-1]) & (line_of[1:] == line_of[:-1])
    key = np.sort((line_of.astype(np.uint64) << np.uint64(36)) | (h >> np.uint64(28)))
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    distinct = np.bincount((key[fresh] >> np.uint64(36)).astype(np.int64), minlength=m)
    whole = mix(span_hash(raw, start, end - (raw[end - 1] == 10)) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(whole, kind="stable")
    same = np.zeros(m)
    same[order[1:]] = whole[order[1:]] == whole[order[:-1]]
    letters = count(_UPPER) + count(_LOWER) + count(_HIGH)
    symbols = count(_SYMBOL) / ink
    x = np.empty((m, N_LINE))
    x[:, 0] = np.minimum(1, symbols * 4)
    x[:, 1] = symbols
    x[:, 2] = count(_UPPER) / np.maximum(letters, 1)
    x[:, 3] = count(_DIGIT) / ink
    x[:, 4] = np.minimum(1, count(_LOUD) / ink * 8)
    x[:, 5] = np.bincount(line_of, again, minlength=m) / words
    x[:, 6] = 1 - distinct / words
    x[:, 7] = same
    x[:, 8] = np.minimum(1, ink / words / 20)
    x[:, 9] = np.minimum(1, np.log1p(words) / 8)
    x[:, 10] = letters / ink
    full = np.zeros((m, N_FEATURES))
    full[:, :N_LINE] = x
    inner = doc[1:] == doc[:-1]
    full[1:, N_LINE : 2 * N_LINE] = x[:-1] * inner[:, None]
    full[:-1, 2 * N_LINE : 3 * N_LINE] = x[1:] * inner[:, None]
    full[:, -1] = 1
    return full, (end - start).astype(np.float64), first


def _step(a: np.ndarray, e00: float, e01: float, e10: float, e11: float) -> np.ndarray:
    """Log odds of the next label from the log odds of this one."""
    return np.logaddexp(e01, a + e11) - np.logaddexp(e00, a + e10)


def messages(u: np.ndarray, first: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward log odds (node included) and backward log odds (node excluded) of every position of every chain."""
    alpha, beta = u.copy(), np.zeros_like(u)
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    lens, lo = n[order], first[:-1][order]
    hi = first[1:][order] - 1
    (e00, e01), (e10, e11) = edge.tolist()
    top = int(lens[0]) if len(lens) else 0
    active = np.searchsorted(-lens, -np.arange(top), side="left")  # chains longer than t
    for t in range(1, top):
        k = active[t]
        i = lo[:k] + t
        alpha[i] += _step(alpha[i - 1], e00, e01, e10, e11)
        i = hi[:k] - t
        beta[i] = _step(u[i + 1] + beta[i + 1], e00, e10, e01, e11)
    return alpha, beta


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def marginals(model: Model, x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """P(good) of every line."""
    alpha, beta = messages(x @ model.weights, first, model.edge)
    return _sigmoid(alpha + beta)


def fit(x: np.ndarray, y: np.ndarray, first: np.ndarray) -> Model:
    """Penalised maximum likelihood by Adam; each chain counts once, however long it is."""
    n = np.diff(first)
    chain = np.repeat(np.arange(len(n)), n)
    share = 1.0 / np.maximum(n, 1)[chain] / max(1, (n > 0).sum())
    inner = np.flatnonzero(chain[1:] == chain[:-1])
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    both = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            both[a, b] = share[inner][(y[inner] == a) & (y[inner + 1] == b)].sum()
    for t in range(1, ROUNDS + 1):
        w, edge = theta[:-4], theta[-4:].reshape(2, 2)
        u = x @ w
        alpha, beta = messages(u, first, edge)
        p = _sigmoid(alpha + beta)
        grad = np.empty_like(theta)
        grad[:-4] = x.T @ ((p - y) * share)
        after = u[inner + 1] + beta[inner + 1]
        joint = np.stack([np.zeros(len(inner)) + edge[0, 0], after + edge[0, 1], alpha[inner] + edge[1, 0], alpha[inner] + after + edge[1, 1]])
        joint = np.exp(joint - joint.max(axis=0)) if len(inner) else joint
        joint /= joint.sum(axis=0)
        grad[-4:] = joint @ share[inner] - both.ravel()
        grad += RIDGE * theta
        grad[-5] -= RIDGE * theta[-5]
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad**2
        theta = theta - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return Model(theta[:-4], theta[-4:].reshape(2, 2))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_lines: int = MAX_LINES) -> Model:
    """Fit on at most ``max_docs`` rows of ``labels`` (doc_id, quality 0/1), the first by a hash of doc_id, and ``max_lines`` lines.

    Rows with a null in either column are left out; of several labels of one
    document the least counts, of several texts the smallest. Only line
    features reach the driver.
    """
    picked = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .groupBy("doc_id").agg(F.min("quality").alias("_y"))
        .orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(max_docs)
    )
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("_y").alias("_y"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[bytes] = []
            lines: list[int] = []
            for raw, off in slices(b.column(1)):
                x, _, first = line_features(raw, off)
                flat = np.ascontiguousarray(x, np.float32)
                out += [flat[first[k] : first[k + 1]].tobytes() for k in range(len(off) - 1)]
                lines += np.diff(first).tolist()
            yield pa.record_batch([b.column(0).cast(pa.int64()), pa.array(lines, pa.int64()), pa.array(out, pa.binary()), b.column(2).cast(pa.int32())], ["doc_id", "n", "x", "y"])

    rows = stored(sample.mapInArrow(features, "doc_id long, n long, x binary, y int").where("n > 0"), "lines")
    fits, held = [], 0
    for r in sorted(rows.select("doc_id", "n", F.xxhash64(F.col("doc_id").cast("string")).alias("h")).collect(), key=lambda r: (r["h"], r["doc_id"])):
        if held + r["n"] <= max_lines:  # at most max_docs rows, each three numbers
            held += r["n"]
            fits.append(r["doc_id"])
    if not fits:
        return Model(np.zeros(N_FEATURES), np.zeros((2, 2)))
    got = rows.where(F.col("doc_id").isin(fits)).select("doc_id", "x", "y").toArrow().sort_by("doc_id")
    parts = [np.frombuffer(v.as_buffer(), np.float32).reshape(-1, N_FEATURES) for v in got["x"]]
    n = np.array([len(p) for p in parts])
    y = got["y"].to_numpy().astype(np.float64)
    return fit(np.concatenate(parts).astype(np.float64), np.repeat(y, n), np.concatenate([[0], np.cumsum(n)]))


def score(df: DataFrame, text: str, model: Model, out: str = "score") -> DataFrame:
    """``df`` with ``out`` (double, 0 to 1): the length-weighted share of good lines; 0 where no line has a word."""

    @F.arrow_udf("double")
    def quality(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with releasing():
            for texts in batches:
                out = [np.zeros(0)]
                for raw, off in slices(texts):
                    x, size, first = line_features(raw, off)
                    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
                    good = np.bincount(doc, marginals(model, x, first) * size, minlength=len(off) - 1)
                    out.append(good / np.maximum(np.bincount(doc, size, minlength=len(off) - 1), 1))
                yield pa.array(np.concatenate(out))

    return df.withColumn(out, quality(F.col(text)))
