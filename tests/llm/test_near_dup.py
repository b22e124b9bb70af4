from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from cosmolake.llm import near_dup, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, percent):
    s = [shingle_set(t) for _, t in rows]
    up = {d: d for d, _ in rows if d is not None}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for i in range(len(rows)):
        for j in range(i):
            c = len(s[i] & s[j])
            if s[i] and s[j] and None not in (rows[i][0], rows[j][0]) and 100 * c >= percent * len(s[i] | s[j]):
                a, b = root(rows[i][0]), root(rows[j][0])
                up[max(a, b)] = min(a, b)
    return sorted((d, len(s[k]), root(d)) for k, (d, _) in enumerate(rows) if d is not None)


def corpus(seed, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, bases = [], [[r.choice(vocabulary) for _ in range(r.choice([30, 120, 300]))] for _ in range(8)]
    for k in range(n):
        words = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 2, 3, 5, 9])):
            at = r.randrange(len(words))
            kind = r.random()
            if kind < 0.6:
                words[at] = r.choice(vocabulary)
            elif kind < 0.8:
                del words[at]
            else:
                words.insert(at, r.choice(vocabulary))
        rows.append((1000 - 3 * k, " ".join(w.upper() if r.random() < 0.1 else w for w in words)))
    return rows


@pytest.mark.parametrize("percent", [80, 85])
def test_components_equal_brute_force(spark, percent):
    rows = corpus(percent)
    df = spark.createDataFrame([(*r, 3, 4) for r in rows], "doc_id long, text string, node int, bands int")
    got = near_dup.groups(df, percent=percent).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute(rows, percent)


def test_links_between_members_of_one_leader(spark):
    """A chain of texts, each near the next and far from the leader: links that no leader sees."""
    r = random.Random(1)
    words = [f"v{k}" for k in range(200)]
    rows, at = [], list(words)
    for k in range(24):
        rows.append((k, " ".join(at)))
        at[(7 * k) % 200] = f"n{k}_{r.random()}"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dup.groups(df, percent=85).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute(rows, 85)


def test_edge_cases(spark):
    rows = [(5, None), (6, ""), (7, " \n\t"), (8, "one two"), (3, "One TWO"), (9, "one two three"), (10, "a b c d e"), (10, "a b c d e"), (11, "z " * 60_000), (12, "z " * 60_000 + "z"), (13, "p q r s t"), (13, "k l m n o"), (2, "k l m n o")]
    df = spark.createDataFrame([*rows, (None, "one two")], "doc_id long, text string")
    got = sorted(tuple(r) for r in near_dup.groups(df, percent=85).select("doc_id", "n_shingles", "component_id").where("doc_id is not null").collect())
    assert got == brute(rows, 85)
    assert near_dup.groups(df.limit(0)).count() == 0
    kept = [r["doc_id"] for r in near_dup.kept_docs(df.where("doc_id is not null"), percent=85).collect()]
    assert sorted(kept) == [2, 3, 5, 6, 7, 9, 10, 10, 11]


def test_odd_sketch_estimates_similarity():
    r = np.random.default_rng(3)
    base = np.unique(r.integers(0, 2**63, 800).astype(np.uint64))
    near, far = base.copy(), base.copy()
    near[:30] = r.integers(0, 2**63, 30)
    far[:500] = r.integers(0, 2**63, 500)
    count = lambda a, b: int(np.bitwise_count(shingles.odd_sketch(shingles.samples(a)) ^ shingles.odd_sketch(shingles.samples(b))).sum())
    assert count(base, base) == 0 and count(base, near) <= near_dup.least_odd(85) < count(base, far)


def test_samples_do_not_depend_on_pieces():
    s = np.unique(np.random.default_rng(0).integers(0, 2**63, 6000).astype(np.uint64))
    whole = ((s[:, None] ^ shingles._XOR) * shingles._ODD).min(axis=0)
    assert (shingles.samples(s) == whole).all()


def test_sets_do_not_depend_on_slices():
    texts = [" ".join(f"w{(k * j) % 17}" for j in range(30)) for k in range(50)]
    one = list(shingles.sets(pa.array(texts)))
    for k, t in enumerate(texts):
        assert (next(shingles.sets(pa.array([t]))) == one[k]).all() and len(one[k]) == len(shingle_set(t))


def test_clashing_columns(spark):
    names = ["_gone", "node", "root", "a", "b"]
    df = spark.createDataFrame([(k, "one two three four five six", *names) for k in (1, 2)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = near_dup.kept_docs(df).collect()
    assert [r["doc_id"] for r in got] == [1] and all(r[n] == n for r in got for n in names)


@pytest.mark.parametrize("limit", [0, 400_000])
def test_shuffled_joins_give_the_same(spark, monkeypatch, limit):
    from cosmolake.operators import rounds

    monkeypatch.setattr(near_dup, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(rounds, "BROADCAST_ROWS", limit)
    rows = corpus(11, 40)
    got = near_dup.groups(spark.createDataFrame(rows, "doc_id long, text string"), percent=80).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute(rows, 80)
