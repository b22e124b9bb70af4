from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from cosmolake.llm import quality_crf as q
from cosmolake.llm._shared import text_bytes


def brute_marginals(u, edge):
    """By summing over all labellings."""
    n = len(u)
    weight = {}
    for code in range(2**n):
        y = [(code >> k) & 1 for k in range(n)]
        weight[tuple(y)] = np.exp(sum(u[k] * y[k] for k in range(n)) + sum(edge[y[k], y[k + 1]] for k in range(n - 1)))
    z = sum(weight.values())
    return np.array([sum(w for y, w in weight.items() if y[k]) / z for k in range(n)])


def test_marginals_equal_enumeration():
    r = np.random.default_rng(1)
    lens = [3, 0, 6, 1]
    first = np.concatenate([[0], np.cumsum(lens)])
    u, edge = r.normal(size=sum(lens)), r.normal(size=(2, 2))
    a, b = q.messages(u, first, edge)
    got = 1 / (1 + np.exp(-(a + b)))
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        if hi > lo:
            assert np.allclose(got[lo:hi], brute_marginals(u[lo:hi], edge))


def test_features_do_not_depend_on_neighbouring_texts():
    texts = ["one two two\nthree\n\nthree", "", "A!! B!! C", None, "é ## 12"]
    whole, _, first = q.line_features(*text_bytes(pa.array(texts, pa.string())))
    for k, t in enumerate(texts):
        own, _, _ = q.line_features(*text_bytes(pa.array([t], pa.string())))
        assert np.allclose(own, whole[first[k] : first[k + 1]])


def _docs(spark, n=240):
    r = random.Random(5)
    rows = []
    for k in range(n):
        words = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8))) for _ in range(40)]
        bad = k % 3 == 0
        lines = [" ".join(w + (r.choice(["%%%", "***", "###"]) if bad else "") for w in words[i : i + 10]) for i in range(0, 40, 10)]
        rows.append((k, "\n".join(lines), int(not bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_held_out_accuracy(spark):
    docs = _docs(spark)
    model = q.train(docs, docs.where("doc_id % 4 <> 0").select("doc_id", "quality"))
    got = q.score(docs, "text", model).where("doc_id % 4 = 0").collect()
    assert all((r["score"] >= 0.7) == bool(r["quality"]) for r in got)


def test_edge_cases(spark):
    docs = _docs(spark)
    model = q.train(docs, docs.select("doc_id", "quality"))
    odd = spark.createDataFrame([(1, None, 9), (2, "", 9), (2, "", 9), (3, " \n\t", 9), (4, "x " * 100_000, 9), (None, "fine words here", 9)], "doc_id long, text string, score int")
    got = {r["doc_id"]: r["score"] for r in q.score(odd, "text", model).collect()}
    assert got[1] == got[2] == got[3] == 0 and all(0 <= v <= 1 for v in got.values())
    assert q.score(odd.limit(0), "text", model).count() == 0


def test_training_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string, quality int")
    model = q.train(none, none.select("doc_id", "quality"))
    assert q.score(_docs(spark, 3), "text", model).count() == 3


def slow_features(text):
    """Features of each line with a word, line by line from the definitions; neighbours' lie beside them."""
    import re

    own, sizes, seen = [], [], set()
    lines = text.split("\n")
    for k, line in enumerate(lines):
        raw = line.encode()
        words = [w for w in re.split(rb"[\x20\x09-\x0d]+", raw) if w]
        if not words:
            continue
        ink = sum(map(len, words))
        share = lambda chars, raw=raw: sum(c in chars for c in raw)
        symbols = share(b"#*$%&|<>{}[]\\^~=_/@+") / ink
        upper, letters = share(range(65, 91)), share(range(65, 91)) + share(range(97, 123)) + share(range(128, 256))
        own.append([
            min(1, symbols * 4), symbols, upper / max(letters, 1), share(range(48, 58)) / ink, min(1, share(b"!?") / ink * 8),
            sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words), 1 - len(set(words)) / len(words), line in seen,
            min(1, ink / len(words) / 20), min(1, np.log1p(len(words)) / 8), letters / ink,
        ])
        seen.add(line)
        sizes.append(len(raw) + (k < len(lines) - 1))
    zero = [0.0] * q.N_LINE
    full = [x + (own[k - 1] if k else zero) + (own[k + 1] if k + 1 < len(own) else zero) + [1.0] for k, x in enumerate(own)]
    return np.array(full, float).reshape(-1, q.N_FEATURES), np.array(sizes, float)


def test_scores_equal_a_slow_version(spark):
    r = random.Random(8)
    words = ["the", "cat", "CAT", "12", "é#", "%%%", "!?", "a", "a", "longword" * 4, "\t", ""]
    texts = ["", "one", "x\nx\nx", " \n\n y"] + ["\n".join(" ".join(r.choice(words) for _ in range(r.randint(0, 6))) for _ in range(r.randint(1, 8))) for _ in range(60)]
    rng = np.random.default_rng(4)
    model = q.Model(rng.normal(size=q.N_FEATURES), rng.normal(size=(2, 2)))
    got = {r["doc_id"]: r["score"] for r in q.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "text", model).collect()}
    for k, t in enumerate(texts):
        x, size = slow_features(t)
        want = float(brute_marginals(x @ model.weights, model.edge) @ size / size.sum()) if len(x) else 0.0
        assert abs(got[k] - want) < 1e-9, repr(t)


def test_training_bounds(spark):
    docs = _docs(spark, 40).union(spark.createDataFrame([(999, "good words here\n" * 5_000, 1)], "doc_id long, text string, quality int"))
    labels = docs.select("doc_id", "quality")
    few = q.train(docs, labels, max_lines=40)
    assert np.isfinite(few.weights).all() and not np.allclose(few.weights, q.train(docs, labels).weights)
    assert (q.train(docs, labels, max_lines=0).weights == 0).all()
    twice = q.train(docs.union(docs), labels)
    assert np.allclose(twice.weights, q.train(docs, labels).weights)  # repeated rows train once
