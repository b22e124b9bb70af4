from __future__ import annotations

import hashlib
import random
import re

import numpy as np

from cosmolake.llm import op3_skip_chain, pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text: str):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(*m.span(), "email") for m in EMAIL.finditer(text)]
    out += [(*m.span(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(*m.span(), "card") for m in CARD.finditer(text) if 14 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    out += [(*m.span(), "phone") for m in PHONE.finditer(text) if 10 <= len(digits(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_equal_the_patterns():
    r = random.Random(3)
    parts = [*"0123456789.@+-() ab", "1.2.3.4", "a@b.c", "4111111111111111", "+1 (415) 555-1234", "..", "é", "256.1.1.1"]
    for _ in range(20_000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 22)))
        assert pii.base_spans(text) == brute(text), repr(text)


def test_scans_stay_linear():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "@" * 100_000, "a@" * 100_000, "+1(" * 50_000, "at " * 50_000 + " dot "):
        pii.mentions(text, pii.base_spans(text))


def _model() -> pii.Model:
    texts = ["call +1 (415) 555-1234 or bob.smith@example.com", "10.0.0.1 and 4111 1111 1111 1111", "number 1234567 and 99999999999", "+1 (415) 555-1234 then 415-555-1234"] * 20
    rows = []
    for t in texts:
        m = pii.mentions(t, pii.base_spans(t))
        rows.append((np.array([pii.node(x) for x in m], float), np.array([x.label for x in m]), pii.edges(m)))
    return pii.fit(rows)


def test_field_extends_labels_along_skip_edges_only():
    model = _model()
    text = "Reach bob.smith@ex.com, that is bob.smith at ex dot com. Order 7777.1111.2222.3333 ships."
    base = pii.base_spans(text)
    more = pii.added_spans(model, pii.mentions(text, base))
    assert [text[s:e] for s, e, _ in more] == ["bob.smith at ex dot com"]
    assert pii.added_spans(model, pii.mentions("Order 7777.1111.2222.3333", [])) == []


def test_marginals_follow_evidence():
    m = pii.mentions("+1 (415) 555-1234 x 415-555-1234", pii.base_spans("+1 (415) 555-1234 x 415-555-1234"))
    p = pii.marginals(_model(), np.array([pii.node(x) for x in m], float), np.array([x.label for x in m]), pii.edges(m))
    assert np.allclose(p.sum(axis=1), 1)
    assert p[0, pii.LABELS.index("phone")] > 0.99


def test_query_edge_cases(spark):
    texts = [None, "", "plain words", "a@b.co", "a@b.co", "x" * 100_000 + " 10.0.0.1", "é a@b.co 🎉 10.0.0.1"]
    docs = spark.createDataFrame([(k % 6, t, "s", 1) for k, t in enumerate(texts)], "doc_id long, text string, spans string, n_email int")
    got = op3_skip_chain.digests(docs, pii.train(docs)).collect()
    want = []
    for k, t in enumerate(texts):
        b = brute(t or "")
        joined = ",".join(f"{kind}:{s}:{e}" for s, e, kind in b)
        want.append((k % 6, *(sum(x[2] == kind for x in b) for kind in pii.KINDS), hashlib.sha256(joined.encode()).hexdigest(), joined, 0))
    assert sorted(map(tuple, got)) == sorted(want)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert op3_skip_chain.digests(docs, pii.train(docs)).count() == 0


def test_marginals_equal_enumeration():
    """Exact on a tree; close on graphs with loops."""
    import itertools

    r = np.random.default_rng(2)
    for es, tolerance in (([(0, 1, False), (1, 2, True), (1, 3, False)], 1e-4), ([(0, 1, False), (1, 2, False), (0, 2, True)], 0.08), ([(0, 1, False), (1, 2, False), (2, 3, True), (0, 3, True)], 0.08)):
        n = max(max(e[:2]) for e in es) + 1
        pair = r.normal(size=(2, 5, 5)) * 0.5
        model = pii.Model(r.normal(size=(pii.N_NODE, 5)) * 0.3, pair[0] + pair[0].T, pair[1] + pair[1].T)
        x, y = r.random((n, pii.N_NODE)), np.array([2] + [0] * (n - 1))
        want = np.zeros((n, 5))
        for labels in itertools.product(range(5), repeat=n):
            if labels[0] == 2:
                score = sum((x[k] @ model.nodes)[labels[k]] for k in range(1, n)) + sum((model.skip if s else model.chain)[labels[i], labels[j]] for i, j, s in es)
                for k in range(n):
                    want[k, labels[k]] += np.exp(score)
        want /= want.sum(axis=1, keepdims=True)
        got = pii.Field([(x, y, y, es)]).run(model, np.where(y > 0, y, -1), passes=60)[0]
        assert np.abs(got - want).max() < tolerance


def test_linked_look_alikes_in_training_do_not_unteach():
    r = random.Random(5)

    def phone():
        a, b, c = r.randint(200, 999), r.randint(200, 999), r.randint(1000, 9999)
        return f"+1 ({a}) {b}-{c}", f"{a}-{b}-{c}"

    def mail():
        name = f"{r.choice(['anna', 'robert', 'sabine'])}{r.randint(10, 999)}"
        return f"{name}@mail.org", f"{name} at mail dot org"

    plain = [f"call {phone()[0]} or write {mail()[0]} or order {r.randint(10**8, 10**9)} now" for _ in range(60)]
    plain += [f"ids {r.randint(10**7, 10**10)} ship {r.randint(100, 999)}-{r.randint(100, 999)}-{r.randint(1000, 9999)}" for _ in range(20)]
    for linked in (0, 10, 100):
        texts = list(plain)
        for _ in range(linked):
            p, m = phone(), mail()
            texts.append(f"first {p[0]} then {m[0]} later {p[1]} again {m[1]} end")
        model = pii.fit([pii.example(pii.mentions(t, pii.base_spans(t))) for t in texts])
        hit = wrong = 0
        for _ in range(50):
            p, m, other = phone(), mail(), phone()[1]
            text = f"first {p[0]} then {m[0]} later {p[1]} again {m[1]} order {other} end"
            got = {text[s:e] for s, e, _ in pii.added_spans(model, pii.mentions(text, pii.base_spans(text)))}
            hit += len(got & {p[1], m[1]})
            wrong += len(got - {p[1], m[1]})
        assert hit >= 95 and wrong == 0


def test_training_bounds(spark):
    docs = spark.createDataFrame([(k, f"call +1 415 555 {k:04d} and a{k}@b.org") for k in range(30)] + [(99, "+1 415 555 1234 " * 2_000)], "doc_id long, text string")
    assert np.isfinite(pii.train(docs, max_mentions=100).nodes).all()
    assert np.isfinite(pii.train(docs, max_docs=3, max_mentions=1).skip).all()
