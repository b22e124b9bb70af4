from __future__ import annotations

from cosmolake.llm import decontaminate as d

ITEM = "A farmer named Alice has 12 boxes that weigh 3 kg each and then buys 12 more boxes from Bob. How many boxes does Alice have in the end?"


def held(spark, texts, items=((1, ITEM),)):
    docs = spark.createDataFrame([(k, t, "i") for k, t in enumerate(texts)], "doc_id long, text string, items string").drop("items")
    bench = spark.createDataFrame(list(items), "item_id long, text string")
    return {r["doc_id"]: r["items"] for r in d.decontaminate(docs, bench).collect()}


def test_copies_and_new_parameters(spark):
    changed = ITEM.replace("12", "40").replace("Alice", "Carol").replace("3 kg", "9 kg").replace("Bob", "Dan")
    inconsistent = ITEM.replace("12 boxes", "40 boxes").replace("12 more", "41 more")
    texts = [f"Intro words here. {ITEM} And after.", f"x {changed} y", f"x {inconsistent} y", "nothing of the kind " * 10, ITEM.upper(), "; ".join(ITEM.split(" "))]
    got = held(spark, texts)
    assert got[0] == [1] and got[1] == [1]
    assert got[2] == [] and got[3] == []


def test_partial_and_short_items(spark):
    tail = " ".join(ITEM.split()[-16:])
    got = held(spark, [f"see {tail} ok", "see one two three four five six seven now", " ".join(ITEM.split()[:9])], [(1, ITEM), (2, "one two three four five six seven"), (3, "too short"), (4, None), (5, "")])
    assert got[0] == [1] and got[1] == [2] and got[2] == []


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    texts = [f"a {ITEM}", "b", f"c {ITEM}"]
    a = held(spark, texts)
    monkeypatch.setattr(d, "BROADCAST_ROWS", 0)
    assert held(spark, texts) == a


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, f"x {ITEM}"), (3, f"x {ITEM}"), (None, ITEM), (4, "w " * 50_000), (5, f"{ITEM} {ITEM}")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, ITEM), (7, ITEM), (8, ITEM)], "item_id long, text string")
    got = sorted(((r["doc_id"], r["items"]) for r in d.decontaminate(docs, bench).collect()), key=repr)
    assert got == sorted([(1, []), (2, []), (3, [7, 8]), (3, [7, 8]), (None, [7, 8]), (4, []), (5, [7, 8])], key=repr)
    assert d.decontaminate(docs, bench.limit(0)).where("size(items) > 0").count() == 0
    assert d.decontaminate(docs.limit(0), bench).count() == 0


DENSE = ["If 3 kg cost 5 dollars and 7 kg cost 12 dollars, how much do 9 kg cost?", "A train travels 60 km in 2 hours and 90 km in 3 hours. How far in 5 hours?", "What is 12 plus 30 minus 7?", "12 45 67 3 8 99 20 31 7 54"]


def test_exact_copies_of_items_rich_in_slots(spark):
    items = [*enumerate(DENSE)]
    got = held(spark, [*DENSE, *(f"As they say so {t} And more." for t in DENSE), "What is 13 plus 31 minus 8?", DENSE[0].replace("12", "14").replace("3", "4"), "13 46 68 4 9 98 21 32 8 55"], items)
    for k in range(len(DENSE)):
        assert got[k] == [k] and got[len(DENSE) + k] == [k]
    assert got[8] == [] and got[9] == [0] and got[10] == []


NAMES = ["Alice has 3 red apples and buys 4 more, how many in all?", "Alice has 3 apples. Alice buys 4 more apples. How many apples does she have now?"]


def test_names_that_open_a_sentence(spark):
    changed = [t.replace("Alice", "Tom").replace("3", "5").replace("4", "6") for t in NAMES]
    mixed = NAMES[1].replace("Alice buys", "Carol buys")
    got = held(spark, [*changed, f"First. {changed[0]}", f"so {changed[1]}", changed[1].replace(". How", ", how"), mixed], [*enumerate(NAMES)])
    assert [got[k] for k in range(6)] == [[0], [1], [0], [1], [1], []]


def test_items_of_many_lengths(spark):
    items = [(1, ITEM), (2, "one two three four five six"), (3, "seven eight nine ten eleven"), (4, "red blue"), (5, "w1 w2 w3 w4 w5 w6 w7 w8 w9")]
    texts = [t for _, t in items] + [f"pre {t} post" for _, t in items] + ["one two three four five", "blue red", "nine ten eleven", "; ".join(t for _, t in items)]
    got = held(spark, texts, items)
    for k in range(5):
        assert k + 1 in got[k] and k + 1 in got[5 + k]
    assert got[10] == got[11] == got[12] == [] and got[13] == [1, 2, 3, 4, 5]


def test_clashing_columns(spark):
    names = ["_d", "_t", "_ht", "_items", "_w", "_text"]
    docs = spark.createDataFrame([(1, f"so {ITEM}", *names), (2, "clean words", *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = {r["doc_id"]: r for r in d.decontaminate(docs, spark.createDataFrame([(7, ITEM)], "item_id long, text string")).collect()}
    assert got[1]["items"] == [7] and got[2]["items"] == [] and all(r[n] == n for r in got.values() for n in names)
