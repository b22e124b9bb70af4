"""Personal data: exact patterns, then a skip-chain conditional random field over mentions.

The base patterns give e-mail addresses, IPv4 addresses, card numbers and
telephone numbers, each kind leftmost and non-overlapping. Mentions are these
matches and looser look-alikes (numbers with other separators, addresses
spelt with "at" and "dot", bare local parts with an "@"). A document's
mentions form a graph: a chain in text order, and a skip edge from each
mention to the one before it with the same or a similar key (the same digits,
the same last seven digits, the same address or local part). Node potentials
come from the mention's shape, edge potentials are tables of label pairs. Both are
fitted together on a bounded sample: base matches are observed, look-alikes
linked with none are targets without a label, those linked with one stay
hidden, for nobody says what they are. What a hidden repetition looks like is
shown by disguised twins: each base match stands once more, rewritten so that
no pattern sees it, linked with the original, and its label is a target to be
predicted from the link. Expectations, with and without the targets, are
loopy sum-product marginals. In use base matches are observed, messages pass
along both kinds of edges, and an unobserved mention becomes a span if a
linked mention carries the label and its marginal reaches ``ACCEPT``. Base
spans stay.

The sample is the first ``MAX_TRAIN`` doc_ids by hash, of these as many whole
documents as hold ``MAX_TRAIN_MENTIONS`` mentions together; of rows with one
doc_id the smallest text trains. Nulls count as empty texts. Every scan is linear in the text's length.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cosmolake.llm._shared import stored

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
ACCEPT = 0.9
MAX_TRAIN = 5_000  #: Bound of the training sample, in documents.
MAX_TRAIN_MENTIONS = 50_000  #: Bound of the training sample, in mentions of all its documents; one that doesn't fit is passed over.
PASSES, DAMP = 12, 0.5
STEPS, RATE, RIDGE = 120, 0.1, 1e-3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_NUMBER = re.compile(r"(?<![0-9A-Za-z])[+(]?[0-9](?:[ ()./_-]{0,2}[0-9])++(?![A-Za-z])")
_AT = re.compile(r"[^\s@<>\"'(),;:]{1,64}+@[^\s@<>\"'(),;:]{1,255}+")
_SPELT = re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}+ ?[(\[{]? ?at ?[)\]}]? ?[\w-]{1,63}+(?: ?[(\[{]? ?dot ?[)\]}]? ?[\w-]{1,63}+)++", re.ASCII)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base matches, by start and then kind as listed; code points, end exclusive."""
    out: list[tuple[int, int, str]] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))
    if _ANY.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                out.append((*m.span(), "ip"))
        for m in _CARD.finditer(text):
            d = _digits(m.group())
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((*m.span(), "card"))
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m.group())) <= 15:
                out.append((*m.span(), "phone"))
    out.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return out


@dataclass(frozen=True)
class Mention:
    start: int
    end: int
    text: str
    label: int  #: Of the base match, 0 for a look-alike.


def mentions(text: str, base: list[tuple[int, int, str]]) -> list[Mention]:
    """Base matches and look-alikes that don't touch them, in text order."""
    out = [Mention(s, e, text[s:e], LABELS.index(k)) for s, e, k in base]
    taken = sorted((s, e) for s, e, _ in base)
    found = []
    if _ANY.search(text):
        found = [m.span() for m in _NUMBER.finditer(text) if sum("0" <= c <= "9" for c in m.group()) >= 7]
        if "@" in text:
            found += [m.span() for m in _AT.finditer(text)]
    if " dot " in text or "dot]" in text or "dot)" in text or "dot}" in text:
        found += [m.span() for m in _SPELT.finditer(text)]
    last, k = -1, 0
    for s, e in sorted(found):
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if s < last or k < len(taken) and taken[k][0] < e:
            continue
        while e > s and text[e - 1] in ".-_/":
            e -= 1
        out.append(Mention(s, e, text[s:e], 0))
        last = e
    out.sort(key=lambda m: (m.start, m.label))
    return out


def keys(m: Mention) -> list[str]:
    """What a mention shares with others that mean the same or something similar."""
    s = m.text.lower()
    if "@" in s or re.search(r"\bat\b", s):
        s = re.sub(r" ?[(\[{]? ?\bat\b ?[)\]}]? ?", "@", s) if "@" not in s else s
        s = re.sub(r" ?[(\[{]? ?\bdot\b ?[)\]}]? ?", ".", s)
        local = s.partition("@")[0]
        return [f"a:{s}"] + ([f"l:{local}"] if len(local) >= 5 else [])
    d = _digits(s)
    if s.count(".") == 3 and all(p.isdigit() and len(p) <= 3 for p in s.split(".")):
        return [f"i:{s}"]
    return [f"d:{d}"] + ([f"t:{d[-7:]}"] if len(d) <= 15 else [])


N_NODE = 12


def node(m: Mention) -> list[float]:
    s, d = m.text, _digits(m.text)
    return [
        1.0, "@" in s, s.count(".") == 3 and len(d) <= 12 and "@" not in s, s[:1] == "+", 14 <= len(d) <= 19, 10 <= len(d) <= 15,
        14 <= len(d) <= 19 and luhn(d), len(d) < 10, "(" in s, s.isdigit(), any(c.isalpha() for c in s), len(s) > 40,
    ]


def edges(found: list[Mention]) -> list[tuple[int, int, bool]]:
    """(i, j, skip): neighbours in the text, and each mention with the last one before it by each of its keys."""
    out = {(k - 1, k): False for k in range(1, len(found))}
    last: dict[str, int] = {}
    for k, m in enumerate(found):
        for key in keys(m):
            if key in last:
                out[last[key], k] = True
            last[key] = k
    return [(i, j, skip) for (i, j), skip in out.items()]


@dataclass(frozen=True)
class Model:
    nodes: np.ndarray  #: Features by labels.
    chain: np.ndarray  #: Log potentials of neighbouring labels.
    skip: np.ndarray  #: Log potentials of linked labels.


def disguises(m: Mention) -> list[str]:
    """A base match rewritten so that no pattern sees it: other separators, spelt signs, a number without its country code."""
    d, kind = _digits(m.text), LABELS[m.label]
    if kind == "email":
        local, _, domain = m.text.partition("@")
        out = [f"{local} at {domain.replace('.', ' dot ')}", f"{local}(at){domain.partition('.')[0]}(dot){domain.partition('.')[2]}"]
    elif kind == "card":
        out = [".".join(d[k : k + 4] for k in range(0, len(d), 4)), "/".join(d[k : k + 4] for k in range(0, len(d), 4))]
    elif kind == "phone":
        out = [m.text.lstrip("+"), d, f"{d[-10:-7]}-{d[-7:-4]}-{d[-4:]}", f"({d[-10:-7]}) {d[-7:-4]}.{d[-4:]}"]
    else:
        out = []
    return [s for s in out if not base_spans(s) and set(keys(Mention(0, len(s), s, 0))) & set(keys(m))]


Row = tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, bool]]]


def example(found: list[Mention]) -> Row:
    """(features, observed labels, targets, edges) of one document; a target is a label, -1 where there is none. Twins follow the mentions."""
    es = edges(found)
    y = [m.label for m in found]
    t = [0 if not m.label else -1 for m in found]
    for i, j, skip in es:
        if skip and (y[i] or y[j]):
            t[i] = t[j] = -1
    x = [node(m) for m in found]
    for k, m in enumerate(found):
        for text in disguises(m) if m.label else ():
            es.append((k, len(x), True))
            x.append(node(Mention(0, len(text), text, 0)))
            y.append(0)
            t.append(m.label)
    return np.array(x, float).reshape(-1, N_NODE), np.array(y), np.array(t), es


def _targets(x: np.ndarray, y: np.ndarray, es: list[tuple[int, int, bool]]) -> Row:
    t = np.where(y > 0, -1, 0)
    for i, j, skip in es:
        if skip and (y[i] or y[j]):
            t[i] = t[j] = -1
    return x, y, t, es


class Field:
    """Graphs side by side: their nodes, and their edges in both directions."""

    def __init__(self, rows: list[Row]) -> None:
        n, at = len(LABELS), np.concatenate([[0], np.cumsum([len(r[1]) for r in rows])]).astype(int)
        self.x = np.concatenate([r[0] for r in rows]) if rows else np.zeros((0, N_NODE))
        self.y = np.concatenate([r[1] for r in rows]).astype(int) if rows else np.zeros(0, int)
        self.t = np.concatenate([r[2] for r in rows]).astype(int) if rows else np.zeros(0, int)
        e = np.array([(i + a, j + a, s) for r, a in zip(rows, at, strict=False) for i, j, s in r[3]], int).reshape(-1, 3)
        self.i, self.j = np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]])
        self.skip = e[:, 2].astype(bool)
        m = len(e)
        self.back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
        self.zero = np.zeros((2 * m, n))
        self.kinds = [np.flatnonzero(self.skip), np.flatnonzero(~self.skip), m + np.flatnonzero(self.skip), m + np.flatnonzero(~self.skip)]
        self.order = np.argsort(self.j, kind="stable")
        self.ends, self.starts = np.unique(self.j[self.order], return_index=True)

    def belief(self, unary: np.ndarray, msg: np.ndarray) -> np.ndarray:
        out = unary.copy()
        if len(msg):
            out[self.ends] += np.add.reduceat(msg[self.order], self.starts)
        return out

    def run(self, model: Model, held: np.ndarray, msg: np.ndarray | None = None, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Node marginals, pair marginals of each edge, and the messages; labels above -1 in ``held`` are fixed. Loopy sum-product in logs."""
        unary = self.x @ model.nodes
        seen = held >= 0
        unary[seen] = -50.0
        unary[seen, held[seen]] = 0.0
        m = len(self.skip)
        msg = self.zero if msg is None else msg
        tables = [np.exp(t) for t in (model.skip, model.chain, model.skip.T, model.chain.T)]
        for _ in range(passes if m else 0):
            belief = self.belief(unary, msg)
            out = belief[self.i] - msg[self.back]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            new = np.empty_like(msg)
            for rows, table in zip(self.kinds, tables, strict=True):
                new[rows] = out[rows] @ table
            new = np.log(new)
            new -= new.max(axis=1, keepdims=True)
            msg = DAMP * msg + (1 - DAMP) * new
        belief = self.belief(unary, msg)
        z = np.exp(belief - belief.max(axis=1, keepdims=True)) if len(belief) else belief
        i, j = self.i[:m], self.j[:m]
        both = (belief[i] - msg[m:])[:, :, None] + (belief[j] - msg[:m])[:, None, :] + np.where(self.skip[:, None, None], model.skip, model.chain)
        both = np.exp(both - both.max(axis=(1, 2), keepdims=True)) if m else both
        return z / z.sum(axis=1, keepdims=True), both / both.sum(axis=(1, 2), keepdims=True), msg


def fit(rows: list[tuple]) -> Model:
    """Weights of nodes and label pairs that raise the likelihood of the targets given what is observed.

    ``rows`` are those of :func:`example`, or (features, labels, edges) of
    documents without twins. The gradient is the difference of two loopy
    expectations, with the targets fixed and free. Pair tables are symmetric
    and start from agreement along skip edges and indifference along the chain.
    """
    n = len(LABELS)
    rows = [r if len(r) == 4 else _targets(*r) for r in rows]
    alone = [(x[y > 0], np.zeros((y > 0).sum(), int), y[y > 0], []) for x, y, _, _ in rows]  # what the shape of a base match says by itself
    g = Field([*rows, *alone])
    first = [np.zeros((N_NODE, n)), np.zeros((n, n)), 6.0 * np.eye(n) - 2.0]
    theta = [t.copy() for t in first]
    seen = np.where(g.y > 0, g.y, -1)
    fixed = np.where(g.t >= 0, g.t, seen)
    total = max(1, int((g.t >= 0).sum()))
    free_msg = held_msg = None
    mean, square = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    loose = seen < 0
    for step in range(1, STEPS + 1 if (g.t >= 0).any() else 1):
        model = Model(*theta)
        p, pp, free_msg = g.run(model, seen, free_msg, 4)
        q, qq, held_msg = g.run(model, fixed, held_msg, 4)
        pair = lambda at: (at.sum(axis=0) + at.sum(axis=0).T) / 2 / total
        grads = [g.x[loose].T @ (q - p)[loose] / total, pair((qq - pp)[~g.skip]), pair((qq - pp)[g.skip])]
        for k, gr in enumerate(grads):
            gr = gr - RIDGE * (theta[k] - first[k])
            mean[k] = 0.9 * mean[k] + 0.1 * gr
            square[k] = 0.99 * square[k] + 0.01 * gr**2
            theta[k] = theta[k] + RATE * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-9)
        theta[1] = np.clip(theta[1], -0.5, 0.5)
        theta[2] = np.clip(theta[2], -8, 8)
    return Model(*theta)


def marginals(model: Model, x: np.ndarray, y: np.ndarray, es: list[tuple[int, int, bool]]) -> np.ndarray:
    """Loopy sum-product marginals; labels above 0 are observed."""
    y = np.asarray(y)
    return Field([(x, y, y, es)]).run(model, np.where(y > 0, y, -1))[0]


def added_spans(model: Model, found: list[Mention]) -> list[tuple[int, int, str]]:
    """Look-alikes that the field labels."""
    if len(found) < 2 or all(m.label for m in found) or not any(m.label for m in found):
        return []
    es = edges(found)
    linked: dict[int, set[int]] = defaultdict(set)
    for i, j, skip in es:
        if skip:
            linked[i].add(j)
            linked[j].add(i)
    if not linked:
        return []
    p = marginals(model, np.array([node(m) for m in found], float), np.array([m.label for m in found]), es)
    best = p.argmax(axis=1)
    out = []
    for k, m in enumerate(found):
        label = int(best[k])
        if not m.label and label and p[k, label] >= ACCEPT and any(best[h] == label for h in linked[k]):
            out.append((m.start, m.end, LABELS[label]))
    return out


def train(docs: DataFrame, max_docs: int = MAX_TRAIN, max_mentions: int = MAX_TRAIN_MENTIONS) -> Model:
    """Fit on the mentions of at most ``max_docs`` documents, the first by a hash of doc_id, that hold at most ``max_mentions`` together."""
    picked = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(max_docs)
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, xs, ys, ts, es = [], [], [], [], []
            for doc_id, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = t.as_py() or ""
                found = mentions(text, base_spans(text))
                if found:
                    x, y, goal, links = example(found)
                    ids.append(doc_id)
                    xs.append(x.astype(np.float32).tobytes())
                    ys.append(y)
                    ts.append(goal)
                    es.append([int(v) for e in links for v in e])
            whole = pa.list_(pa.int32())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(xs, pa.binary()), *(pa.array(c, whole) for c in (ys, ts, es))], ["doc_id", "x", "y", "t", "e"])

    rows = stored(sample.mapInArrow(task, "doc_id long, x binary, y array<int>, t array<int>, e array<int>"), "mentions")
    fits, held = [], 0
    for r in sorted(rows.select("doc_id", F.size("y").alias("n"), F.xxhash64(F.col("doc_id").cast("string")).alias("h")).collect(), key=lambda r: (r["h"], r["doc_id"])):
        if held + r["n"] <= max_mentions:  # at most max_docs rows, each three numbers
            held += r["n"]
            fits.append(r["doc_id"])
    got = rows.where(F.col("doc_id").isin(fits)).toArrow().sort_by("doc_id")
    return fit([
        (np.frombuffer(x, np.float32).reshape(-1, N_NODE).astype(float), np.array(y), np.array(t), [(a, b, bool(c)) for a, b, c in zip(e[::3], e[1::3], e[2::3], strict=True)])
        for x, y, t, e in zip(*(got[c].to_pylist() for c in "xyte"), strict=True)
    ])


SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def find(df: DataFrame, text: str, model: Model, out: str = "spans") -> DataFrame:
    """``df`` with ``out``: all spans of each whole text, by start and then kind as listed."""

    @F.arrow_udf(SPANS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = []
            for t in texts:
                text = t.as_py() or ""
                base = base_spans(text)
                more = added_spans(model, mentions(text, base)) if base else []
                both = [(*s, True) for s in base] + [(*s, False) for s in more]
                both.sort(key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
                rows.append([{"kind": k, "start": s, "end": e, "base": b} for s, e, k, b in both])
            yield pa.array(rows, _SPAN)

    return df.withColumn(out, run(F.col(text)))
