from __future__ import annotations

import random
import re
from collections import Counter

from cosmolake.llm import line_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    wins = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = Counter(wins)
    covered = {i + k for i, w in enumerate(wins) if many[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_base_counts_equal_brute_force(spark):
    r = random.Random(4)
    texts = [None, "", "\n\n", " \t ", "a b c d e a b c d e", "x " * 5000, "a" * 100_000, "é#*\nß|\né#*\n"]
    texts += [" ".join(r.choice(["a", "b", "c", "#", "\n", "\t", "\x1c"]) for _ in range(r.randint(0, 40))) for _ in range(200)]
    df = spark.createDataFrame([(k, t, 7) for k, t in enumerate(texts)], "doc_id long, text string, n_extra int")
    got = {x["doc_id"]: tuple(x[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for x in line_rules.base_counts(df).collect()}
    for k, t in enumerate(texts):
        assert got[k] == brute(t), repr(t)


def _corpus():
    own = lambda k: f"line {chr(97 + k % 26)}{chr(97 + k // 26)} of its own with ten more words to keep it in"
    rows = [(k, f"Read more, page {k}\n{own(k)}", "h") for k in range(60)]
    rows += [(100 + k, "  read MORE, page 7  \nread more, page 9\nread more, page 11\nonly three words", "h") for k in range(3)]
    rows += [(200, "read more, page 1\n" + own(3), "other"), (300, None, None), (301, "", "h"), (302, "few words", None), (200, "read more, page 1\n" + own(3), "other")]
    return rows


def test_frequency_counts_documents_of_a_host(spark):
    df = spark.createDataFrame([(*r, 1) for r in _corpus()], "doc_id long, text string, source string, kept int").drop("kept")
    got = line_rules.rules(df, min_docs=10, share=0.02).collect()
    assert len(got) == len(_corpus())
    by = {r["doc_id"]: r for r in got}
    assert by[5]["kept"] and by[5]["n_lost_lines"] == 1
    assert all(not by[100 + k]["kept"] and by[100 + k]["n_lost_lines"] == 3 for k in range(3))  # depleted
    assert by[200]["n_lost_lines"] == 0 and by[200]["kept"]
    assert not by[300]["kept"] and not by[301]["kept"] and not by[302]["kept"]


def test_cleaned_texts(spark):
    df = spark.createDataFrame(_corpus(), "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in line_rules.cleaned(df, min_docs=10).collect()}
    assert got[101] == "only three words" and got[5].startswith("line ") and got[300] is None and got[301] == ""
    assert "read more" in got[200]


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    df = spark.createDataFrame(_corpus(), "doc_id long, text string, source string")
    a = sorted(map(str, line_rules.rules(df).collect()))
    monkeypatch.setattr(line_rules, "BROADCAST_ROWS", 0)
    assert sorted(map(str, line_rules.rules(df).collect())) == a


def test_empty_table(spark):
    assert line_rules.rules(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_repeated_rows_are_one_document(spark):
    own = lambda k: f"line {chr(97 + k)} of its own with ten more words to keep it in"
    rows = [(1, f"shared line\n{own(0)}", "h")] * 12 + [(2, f"shared line\n{own(1)}", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r["n_lost_lines"] for r in line_rules.rules(df).collect()} == {0}
    rows += [(10 + k, f"shared line\n{own(2 + k)}", "h") for k in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert [r["_docs"] for r in line_rules.frequent_lines(df).collect()] == [11]
    assert {r["n_lost_lines"] for r in line_rules.rules(df).collect()} == {1}
    loose = spark.createDataFrame([(None, "shared line\nx", "h")] * 12 + [(None, f"shared line\n{own(3)}", "h")], "doc_id long, text string, source string")
    assert line_rules.frequent_lines(loose).count() == 0


def test_clashing_columns(spark):
    names = ["_d", "_t", "_ht", "_gone", "_words", "_lines", "_wins", "_host", "_h"]
    df = spark.createDataFrame([(*r, *names) for r in _corpus()], "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    for got in (line_rules.cleaned(df).collect(), line_rules.base_counts(df).collect()):
        assert all(r[n] == n for r in got for n in names) and len(got) == len(_corpus())
    assert line_rules.rules(df).count() == len(_corpus())
