"""Term frequencies against a count in Python and against SQL."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from skeinworks.functions.words import WORD
from skeinworks.llm import queries, terms


def test_against_python(spark, make):
    drawn = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    rows, later = [], dt.datetime(2032, 1, 1)
    for no in drawn.sample(range(-9000, 30_000), 500):
        blocks = [(0, "Goal", " ".join(drawn.choices(words, weights=range(1, 61), k=drawn.randrange(8)))), (1, "Odd", None), (2, "Think", "The the")]
        rows.append((no, "x", None, None, None, blocks))
        if drawn.random() < 0.1:
            rows.append((no, "x", None, None, None, blocks, later))
    rows += [(None, "x", None, None, None, [(0, "Goal", "lost")]), (5, "x", None, None, None, None), (6, "x", None, None, None, [(0, "Goal", "alone İ")])]
    occurrences, records, seen = Counter(), Counter(), set()
    for no, *_, blocks in [r[:6] for r in rows]:
        if no is None or no in seen:
            continue
        seen.add(no)
        found = [w for b in blocks or [] for w in WORD.findall((b[2] or "").lower())]
        occurrences.update(found)
        records.update(set(found))
    vocab = spark.createDataFrame([("the", 4), ("absent", 5), ("absent", 6), (None, 7)], "token string, id int")
    got = terms.marked_terms(make.trajectories(rows), vocab).collect()
    mark = lambda n: "rare" if n < 3 else "common" if n > 0.5 * len(seen) else None
    want = {w: (occurrences[w], records[w], mark(records[w])) for w in {*occurrences, "absent"}}
    assert {r["term"]: (r["occurrences"], r["records"], r["mark"]) for r in got} == want and len(got) == len(want)


def test_containers():
    for ids in ([0], [5, 9, 4095], [*range(0, terms.BUCKET, 3)], [*range(terms.BUCKET)]):
        assert list(terms.unpacked(*terms.packed(ids))) == ids
    assert [terms.packed([*range(k)])[1] for k in (terms.BUCKET // 16, terms.BUCKET // 16 + 1)] == [False, True]


def test_postings_of_two_loads_are_merged(spark, make):
    rows = [(i, "x", None, None, None, [(0, "Goal", "a b" if i % 2 else "a")]) for i in range(700)]
    texts = F.col("blocks.text")
    first, second = (terms.term_postings(make.trajectories(part), "traj_no", texts) for part in (rows[:350], rows[350:]))
    both = terms.merge_postings(first.unionByName(second))
    assert both.filter("term = 'a'").count() == 1
    got = {r["term"]: (r["occurrences"], r["records"]) for r in terms.term_frequencies(both).collect()}
    assert got == {None: (0, 700), "a": (700, 700), "b": (350, 350)}


def test_same_as_sql(spark, folder):
    c = duckdb.connect()
    for t in ("trajectories", "vocab", "pack_sizes"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    for name, sql in queries.oracle_sql().items():
        ours = queries.queries()[name](spark, folder)
        theirs = c.execute(sql).df()[ours.columns]
        key = lambda r: tuple(str(x) for x in r)
        assert sorted(map(key, (tuple(r) for r in ours.collect()))) == sorted(map(key, (tuple(None if x is None or x != x else x for x in r) for r in theirs.itertuples(index=False, name=None)))), name


def test_empty(spark, make):
    vocab = spark.createDataFrame([], "token string, id int")
    assert terms.marked_terms(make.trajectories([]), vocab).count() == 0
