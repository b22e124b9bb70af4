from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from cosmolake.llm import bpe, op9_byte_bpe

PATH = public_tokenizers.path(op9_byte_bpe.FILE)
ALPHABET = ["a", "b", " ", "  ", "\n", "\t", "é", "ß", "1", "23", "'s", "'", "!", " ", "　", "\x1c", "\x85", "中", "🎉", "\r\n", "ll", "A", "​", "\x00", "the", "ing"]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def test_random_texts_encode_as_the_library_does(reference):
    r = random.Random(7)
    for _ in range(4000):
        text = "".join(r.choice(ALPHABET) for _ in range(r.randint(0, 30)))
        assert bpe.encode_text(text, PATH, public_tokenizers.PATTERN) == reference.encode_ordinary(text), repr(text)


@pytest.mark.parametrize("text", ["", " ", "\n\n", "a" * 5000, "é" * 3000, " " * 3000, "ab " * 2000, "!?" * 3000, "<|endoftext|>"])
def test_long_and_odd_texts(reference, text):
    assert bpe.encode_text(text, PATH, public_tokenizers.PATTERN) == reference.encode_ordinary(text)


def test_trees_side_by_side_merge_as_one_does():
    ranks = bpe.load_ranks(PATH)
    r = random.Random(11)
    pieces = ["".join(r.choice("theingéßand 中🎉123!?") for _ in range(r.randint(2, 20))).encode()[:64] for _ in range(3000)]
    pieces = [p for p in pieces if p not in ranks]
    assert bpe.merge_many(pieces, bpe.Pairs(ranks)) == [tuple(bpe.merge_bytes(p, ranks)) for p in pieces]


def test_memo_generations_change_nothing(reference, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 8)
    memo = bpe._Memo(bpe.load_ranks(PATH), public_tokenizers.PATTERN)
    text = " ".join(f"word{k % 13}, next{k % 7}" for k in range(300))
    assert [i for c in bpe.chunks(text) for i in memo[c]] == reference.encode_ordinary(text)


def test_query_digests_and_edge_cases(spark, reference):
    texts = [None, "", "Hello world", "Hello world", "x" * 100_000, "Ünï\n\ncode  🎉"]
    rows = [(k % 5, t, "de", 1) for k, t in enumerate(texts)]
    got = op9_byte_bpe.digests(spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int")).collect()
    want = []
    for d, t, *_ in rows:
        ids = reference.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got)) == sorted(want)


def test_separate_operators_give_the_same(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate([None, "", "Hello world", "é 🎉"])], "doc_id long, text string")
    two = bpe.decode(bpe.encode(df, "text", PATH, public_tokenizers.PATTERN), "ids", PATH)
    one = bpe.encode_decode(df, "text", PATH, public_tokenizers.PATTERN)
    assert two.columns == one.columns and sorted(map(str, two.collect())) == sorted(map(str, one.collect()))


def test_empty_table(spark):
    assert op9_byte_bpe.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "Hello world", "kept")], "doc_id long, text string, _both string")
    r = bpe.encode_decode(df, "text", PATH, public_tokenizers.PATTERN).collect()[0]
    assert r["_both"] == "kept" and bytes(r["decoded"]) == b"Hello world"


def test_a_worker_gives_its_memory_back():
    import subprocess
    import sys

    code = """
import random, re, sys
import pyarrow as pa, public_tokenizers
from cosmolake.llm import bpe
def held():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) // 1024
path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
bpe._memo(path, pattern)
r, start = random.Random(3), held()
with bpe._forgetting(path, pattern):
    for _ in range(4):
        texts = pa.array([" ".join("".join(r.choices("abcdefghijklmnop", k=9)) for _ in range(100)) for _ in range(1000)])
        parts = bpe._encoded(texts, path, pattern)
    top = held()
    del texts, parts
print(top - start, held() - start)
"""
    top, rest = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert rest < 85 and rest < 0.7 * top, (top, rest)  # MB beyond those before the task
