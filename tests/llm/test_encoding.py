"""Encoding and token counts against the tokenizer libraries."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from skeinworks.llm import bpe, token_budget


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.TOKENIZER)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_merges_like_the_library(library):
    own = bpe.ByteBPE()
    drawn = random.Random(0)
    texts = ["", " ", "a" * 5000, "ab" * 3000, "<|endoftext|> x", "don't  stop\n\n now", "é́ 😀🧪 温度91℃", "x" * 100 + "y" * 99, "​  z"]
    texts += ["".join(drawn.choice("abcdeABC éß\n 12.,'’tsdлж温") for _ in range(drawn.randrange(1, 300))) for _ in range(300)]
    for t in texts:
        assert own.encode(t) == library(t), t[:40]


def test_queue_finds_the_lowest_rank():
    q = bpe.RankQueue(50_000)
    for rank in (49_999, 64, 63, 4096, 5):
        q.push(rank, rank)
        q.push(rank, rank - 1)
    found = []
    while (r := q.first()) >= 0:
        found.append(r)
        assert q.take(r) == [r - 1, r]
    assert found == [5, 63, 64, 4096, 49_999] and q.first() == -1


def test_corpus(spark, make, library):
    long = "The quick brown fox. " * 60_000
    rows = [(1, "Hello world"), (2, ""), (3, None), (4, " \n"), (5, long), (5, "twice"), (None, "no id")]
    got = {(r["doc_id"], len(r["ids"])): list(r["ids"]) for r in bpe.encode_corpus(make.documents(rows)).collect()}
    assert got == {(i, len(library(t or ""))): library(t or "") for i, t in rows}
    assert bpe.encode_corpus(make.documents([])).count() == 0


def test_round_trip_of_the_documents(spark, folder):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.TOKENIZER)
    df = spark.read.parquet(f"{folder}/documents.parquet")
    rows = bpe.encode_corpus(df).join(df.select("doc_id", "text"), "doc_id").collect()
    assert rows and all(t.decode(list(r["ids"]), skip_special_tokens=False) == (r["text"] or "") for r in rows)


def test_budget(spark, make):
    import datetime as dt

    later = dt.datetime(2031, 2, 1)
    traj = [
        (1, "a", "Bench-World ", "train", "g", [(0, "Goal", "one two"), (1, "Think", None), (1, "think ", "three")]),
        (1, "a", "benchworld", "train", "g", [(0, "Goal", "one two"), (1, "Think", None), (1, "think ", "three")], later),
        (2, "b", None, None, None, None),
        (3, "c", "benchworld", "x", "g", []),
        (None, "d", "benchworld", "x", "g", [(0, "Goal", "one two")]),
        (None, "d", "benchworld", "x", "g", [(0, None, "")]),
    ]
    docs = [(1, "one two", "S", "EN-gb", "tide lab"), (2, None, None, None, None), (3, "one two", "s", "eng", "tidelab"), (3, " ", "s", "deu", "")]
    out = token_budget.token_budget(make.trajectories(traj), make.documents(docs)).collect()
    cell = {(r["part"], r["source"], r["lang"], r["env"], r["block_type"]): (r["records"], r["tokens"]) for r in out}
    assert cell["trajectories", None, None, "benchworld", "goal"] == (2, 4)
    assert cell["trajectories", None, None, "benchworld", "think"] == (2, 1)
    assert cell["trajectories", None, None, "(all)", "(all)"] == (5, 5)
    assert cell["documents", "s", "en", "tidelab", None] == (2, 4)
    assert cell["documents", "unknown", "unknown", "unknown", None] == (1, 0)
    assert cell["documents", "(all)", "(all)", "(all)", None] == (4, 5)
    assert len(cell) == len(out)
    empty = token_budget.token_budget(make.trajectories([]), make.documents([]))
    assert empty.filter(F.col("tokens") > 0).count() == 0


def test_counts_are_those_of_the_encoding(spark, folder):
    df = spark.read.parquet(f"{folder}/documents.parquet")
    counted = token_budget.document_counts(df).select("doc_id", "tokens")
    assert counted.join(bpe.encode_corpus(df), "doc_id").filter(F.col("tokens") != F.size("ids")).count() == 0


def test_cache_in_two_halves(monkeypatch):
    """A cache that overflows all the time gives the same ids."""
    from skeinworks.llm import bpe

    texts = [f"word{i % 37} other{i % 11} naïve {i}" for i in range(200)]
    want = [bpe.ByteBPE(bpe.TOKENIZER).encode(t) for t in texts]
    monkeypatch.setattr(bpe, "CACHE", 8)
    small = bpe.ByteBPE(bpe.TOKENIZER)
    assert [small.encode(t) for t in texts] == want and len(small.known) <= 8 and len(small.older) <= 8
