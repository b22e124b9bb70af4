from __future__ import annotations

import random
import re

from cosmolake.llm import line_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, min_words):
    """Deletes every line in a maximal run of at least min_words that stands earlier; runs are compared pair by pair."""
    docs = [(d, t, [(i, x.strip(" "), len(WORD.findall(x))) for i, x in enumerate(t.split("\n")) if WORD.search(x)]) for d, t in sorted(rows)]
    flat = [(n, k, line, w) for n, (_, _, ls) in enumerate(docs) for k, (_, line, w) in enumerate(ls)]
    gone = {n: set() for n in range(len(docs))}
    for a, (n, k, line, _) in enumerate(flat):
        for b in range(a):
            m, j, other, _ = flat[b]
            if other != line:
                continue
            length = total = 0
            mine, theirs = docs[n][2], docs[m][2]
            while k + length < len(mine) and j + length < len(theirs) and mine[k + length][1] == theirs[j + length][1]:
                total += mine[k + length][2]
                length += 1
            if total >= min_words:
                gone[n].update(range(mine[k][0], mine[k + length - 1][0] + 1))
    return sorted((d, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[n]), len(gone[n])) for n, (d, t, _) in enumerate(docs))


def run(spark, rows, min_words):
    df = spark.createDataFrame([(*r, 5, "k") for r in rows], "doc_id long, text string, n_lines int, _gone string").drop("n_lines")
    return sorted((r["doc_id"], r["text"], r["n_removed"]) for r in line_dedup.dedup(df.drop("_gone"), min_words=min_words).collect())


def test_equals_pairwise_runs(spark):
    r = random.Random(9)
    rows, k = [], 0
    for group in range(12):
        for _ in range(4):
            lines = [r.choice(["a", "b c", "d e f", "", " ", "g h i j k", f"u{group}"]) for _ in range(r.randint(0, 9))]
            rows.append((k, "\n".join(lines)))
            k += 1
    for min_words in (3, 6, 10):
        assert run(spark, rows, min_words) == brute(rows, min_words)


def test_runs_come_from_different_earlier_places(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(20)) for x in "abc")
    rows = [(1, f"{a}\n{b}\n{c}"), (2, f"x\n{a}\n{b}"), (3, f"{b}\n{c}\nend"), (4, f"{a}\n{b}\n{c}\nlast"), (5, f"{c}\n{b}")]
    got = {d: (t, n) for d, t, n in run(spark, rows, 40)}
    assert got[1][1] == 0 and got[2] == ("x", 2) and got[3] == ("end", 2) and got[4] == ("last", 3) and got[5][1] == 0


def test_edge_cases(spark):
    long = "\n".join(f"w{k} " * 30 for k in range(500))
    rows = [(1, None), (2, ""), (3, long), (4, long), (4, long), (5, "\n\n"), (None, long), (6, "same line\n" * 40)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    got = line_dedup.dedup(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["text"] is None and by[1][0]["n_lines"] == 0 and by[2][0]["text"] == "" and by[5][0]["text"] == "\n\n"
    assert by[None][0]["n_removed"] == 0 and by[3][0]["text"] == "" and [r["text"] for r in by[4]] == ["", ""]  # a null key sorts first
    assert line_dedup.dedup(df.limit(0)).count() == 0


def test_clashing_columns(spark):
    long = "\n".join(f"w{k} " * 30 for k in range(5))
    names = ["_gd", "_gt", "_t", "_left", "_gone", "_d", "_i"]
    df = spark.createDataFrame([(1, long, *names), (2, long, *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = line_dedup.dedup(df).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {1: long, 2: ""} and all(r[n] == n for r in got for n in names)


def test_matches_hang_on_fingerprints(spark):
    """Windows meet by fingerprint and by the lines on both sides of it, not by a hash of the whole."""
    a = "\n".join(f"w{k} " * 6 for k in range(12))
    df = spark.createDataFrame([(1, a), (2, "x y\n" + a + "\nz")], "doc_id long, text string")
    w = line_dedup.windows(line_dedup.line_rows(df, "doc_id", "text"), 20).collect()
    assert not {"_k", "_m"} & set(w[0].asDict())
    lines = {r["_i"]: r["_h"] for r in line_dedup.line_rows(df.where("doc_id = 1"), "doc_id", "text").collect()}
    for r in w:
        if r["_d"] == 1:
            inside = [lines[k] for k in range(r["_from"], r["_to"] + 1)]
            assert r["_from"] <= r["_at"] <= r["_to"] and lines[r["_at"]] == r["_fp"] == min(inside)
    one = {(r["_kind"], r["_fp"], r["_l"], r["_r"]) for r in w if r["_d"] == 1}
    assert one <= {(r["_kind"], r["_fp"], r["_l"], r["_r"]) for r in w if r["_d"] == 2}
