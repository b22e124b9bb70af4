from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from cosmolake.llm import langid

WORDS = {"en": ["the", "thing", "this", "and", "hand", "shining"], "de": ["der", "die", "das", "und", "schön", "über"], "fr": ["le", "la", "élève", "même", "château", "où"]}


def _texts(n=60):
    r = random.Random(2)
    return [(k, " ".join(r.choice(WORDS[lang]) for _ in range(12)), lang) for k in range(n) for lang in WORDS]


def slow_probability(counts: Counter, context: str, c: str, order: int, alphabet: int) -> float:
    """Interpolated Kneser-Ney as in the books, from the highest order's counts."""
    levels = [None] * (order + 1)
    levels[order] = counts
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def p(k: int, ctx: str) -> float:
        if k == 0:
            return 1 / alphabet
        t = levels[k]
        n1, n2 = sum(v == 1 for v in t.values()), sum(v == 2 for v in t.values())
        d = min(0.95, max(0.05, n1 / max(n1 + 2 * n2, 1))) if n1 + n2 else 0.5
        total = sum(v for g, v in t.items() if g[:-1] == ctx)
        kinds = sum(1 for g in t if g[:-1] == ctx)
        lower = p(k - 1, ctx[1:])
        return lower if not total else max(t.get(ctx + c, 0) - d, 0) / total + d * kinds / total * lower

    return p(order, context)


def test_probabilities_equal_the_definition():
    counted = Counter({"abc": 3, "abd": 2, "bca": 1, "cab": 4, "a": 2})
    g = langid.grams(counted, 3)
    model = langid.fit([("x", k, n) for k, n in g.items()], 3)
    alphabet = len({k[-1] for k in g}) + 1
    for word in ("abc", "cab", "bab", "dd", "zab"):
        padded = langid.PAD * 2 + word + langid.END
        want = sum(math.log(slow_probability(Counter(g), padded[i : i + 2], padded[i + 2], 3, alphabet)) for i in range(len(word) + 1))
        assert np.allclose(langid.word_scores(model, [word])[0, 0], want)


def test_a_context_sums_to_one():
    g = langid.grams(Counter({"abca": 5, "bcab": 2, "acb": 1}), 3)
    model = langid.fit([("x", k, n) for k, n in g.items()], 3)
    letters = sorted({k[-1] for k in g})
    known = [c for c in letters]
    alphabet = len(letters) + 1
    total = sum(slow_probability(Counter(g), "ab", c, 3, alphabet) for c in known) + slow_probability(Counter(g), "ab", "?", 3, alphabet)
    assert total == pytest.approx(1)
    assert len(model.grams[2]) == len(g)


def test_held_out_accuracy_and_edge_cases(spark):
    docs = spark.createDataFrame([(*r, 0.5) for r in _texts()], "doc_id long, text string, lang string, score double")
    model = langid.train(docs.where("doc_id % 3 <> 0"), "text", "lang")
    got = langid.predict(docs.where("doc_id % 3 = 0"), "text", model).collect()
    assert all(r["lang_id"]["lang"] == r["lang"] for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 ²½ !!"), (4, "the " * 50_000), (5, "the thing"), (5, "the thing"), (6, "qqqq zzzz xxxx")], "doc_id long, text string")
    out = [(r["doc_id"], r["lang_id"]) for r in langid.predict(odd, "text", model).collect()]
    by = dict(out)
    assert by[1]["lang"] == by[2]["lang"] == by[3]["lang"] == "und" and by[4]["lang"] == by[5]["lang"] == "en" and len(out) == 7
    assert by[6]["rejected"] and not by[5]["rejected"] and all(0 <= v["score"] <= 1 for _, v in out)


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.train(none, "text", "lang")
    got = langid.predict(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), "text", model).collect()
    assert got[0]["lang_id"]["lang"] == "und"


def test_small_memo_and_bound(spark, monkeypatch):
    monkeypatch.setattr(langid, "MEMO", 5)
    rows = [(lang, g, n) for lang, words in WORDS.items() for g, n in langid.grams(Counter(words), 4).items()]
    s = langid._Scorer(langid.fit(rows))
    text = " ".join(w for words in WORDS.values() for w in words)
    assert np.allclose(s.text(text), langid._Scorer(langid.fit(rows)).text(text))
    docs = spark.createDataFrame(_texts(), "doc_id long, text string, lang string")
    assert sum(len(x) for x in langid.train(docs, "text", "lang", max_grams=20).grams[3:]) <= 20


def test_every_counted_gram_reaches_the_model(spark):
    rare = "zyx wvu tsr"
    many = spark.range(900_000).selectExpr("concat(char(97 + id % 26), char(97 + id div 26 % 26), char(97 + id div 676 % 26), char(97 + id div 17576 % 26), ' ', char(97 + id % 26), char(97 + id div 26 % 26), char(97 + id div 676 % 26), char(97 + id div 17576 % 26)) as text", "concat('l', id div 456976) as lang")
    df = many.unionByName(spark.createDataFrame([(rare, "rare")], "text string, lang string"))
    model = langid.train(df, "text", "lang")
    want = langid.count(df, "text", "lang").select("gram").distinct().count()
    assert want > 456_976 and len(model.grams[3]) == want and "rare" in model.langs


def test_predictions_equal_brute_force(spark):
    """Language, share and cross-entropy from the definition, letter by letter; several languages share grams."""
    r = random.Random(7)
    learn = _texts(6) + [(900, "the das le qa", "en"), (901, "", "fr"), (902, None, "fr"), (903, "xx", None)]
    model = langid.train(spark.createDataFrame(learn, "doc_id long, text string, lang string"), "text", "lang")
    langs = sorted(WORDS)
    counts = {x: langid.grams(Counter(w for _, t, lang in learn if lang == x and t for w in langid.words(t)), 4) for x in langs}
    alphabet = len({g[-1] for c in counts.values() for g in c}) + 1
    letters = "thedasunrläqé"
    texts = ["The thing", "Über und!", "élève 12 la", "Qa das the"] + [" ".join("".join(r.choice(letters) for _ in range(r.randint(1, 5))) for _ in range(3)) for _ in range(12)]
    got = langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "text", model).collect()
    for row in got:
        ce = []
        for x in langs:
            total = size = 0
            for w in langid.words(row["text"]):
                padded = langid.PAD * 3 + w + langid.END
                total += sum(math.log(slow_probability(counts[x], padded[i : i + 3], padded[i + 3], 4, alphabet)) for i in range(len(w) + 1))
                size += len(w) + 1
            ce.append(-total / size)
        best = min(range(3), key=ce.__getitem__)
        share = 1 / sum(math.exp(langid.SHARPNESS * (ce[best] - c)) for c in ce)
        assert row["lang_id"]["lang"] == langs[best]
        assert row["lang_id"]["cross_entropy"] == pytest.approx(ce[best], rel=1e-5) and row["lang_id"]["score"] == pytest.approx(share, rel=1e-3)


def test_work_in_small_pieces_changes_nothing(monkeypatch):
    rows = [(lang, g, n) for lang, words in WORDS.items() for g, n in langid.grams(Counter(words), 4).items()]
    whole = langid.fit(rows)
    want = langid.word_scores(whole, WORDS["en"] + WORDS["fr"])
    monkeypatch.setattr(langid, "CELLS", 1)
    assert np.array_equal(langid.word_scores(whole, WORDS["en"] + WORDS["fr"]), want)
    assert np.allclose(langid.fit(rows).limit, whole.limit)


def test_limits_come_from_texts_set_aside(spark):
    docs = spark.createDataFrame(_texts(), "doc_id long, text string, lang string")
    n = langid.count(docs, "text", "lang").agg({"n": "sum", "held": "sum"}).collect()[0]
    assert 0 < n["sum(held)"] < n["sum(n)"] / 3
    model = langid.train(docs, "text", "lang")
    assert np.isfinite(model.limit).all() and len(model.limit) == 3
