"""Balanced mixing: shares, limits on repeats, totals of the flight."""

from __future__ import annotations

import random

import pytest

from skeinworks.llm import mixing


def test_flight_keeps_both_totals():
    drawn = random.Random(0)
    sizes = [float(drawn.randrange(1, 500)) for _ in range(5000)]
    prob = [drawn.random() for _ in sizes]
    units, tokens = sum(prob), sum(p * s for p, s in zip(prob, sizes))
    mixing.flight(prob, sizes, [*range(5000)], 0)
    assert sum(1e-9 < p < 1 - 1e-9 for p in prob) <= 2
    assert sum(prob) == pytest.approx(units, abs=1e-5) and sum(p * s for p, s in zip(prob, sizes)) == pytest.approx(tokens, rel=1e-6)
    mixing.landing(prob, sizes)
    assert set(prob) <= {0.0, 1.0} and abs(sum(p * s for p, s in zip(prob, sizes)) - tokens) < 1000


def selection(ids, seed):
    prob = [0.3] * len(ids)
    mixing.flight(prob, [float(1 + i % 7) for i in range(len(ids))], ids, seed)
    return prob


def test_inclusion_frequencies():
    """Over 200 seeds every unit is taken as often as its probability says: within four standard errors, and 0.3 on the whole."""
    taken = [0.0] * 60
    for seed in range(200):
        for i, p in enumerate(selection([*range(60)], seed)):
            taken[i] += p / 200
    error = (0.3 * 0.7 / 200) ** 0.5
    assert all(abs(t - 0.3) < 4 * error for t in taken) and abs(sum(taken) / 60 - 0.3) < 1e-6


def test_blocks_are_independent():
    """Blocks alike in sizes and probabilities choose differently, and another seed chooses anew."""
    together = sum(a * b for seed in range(100) for a, b in zip(selection([*range(60)], seed), selection([*range(100, 160)], seed))) / 6000
    assert abs(together - 0.09) < 0.03
    assert selection([*range(60)], 1) != selection([*range(60)], 2) and selection([*range(60)], 1) == selection([*range(60)], 1)


def test_seeds(spark, make):
    targets = spark.createDataFrame(TARGETS, "source_name string, target_share double, max_repeats int")
    one, two = (mixing.mix(make.documents(corpus(random.Random(1))), targets, seed=s)[0].collect() for s in (0, 1))
    assert {r["doc_id"] for r in one} != {r["doc_id"] for r in two}


TARGETS = [("big", 0.5, 1), ("small", 0.3, 3), ("Tiny ", 0.1, 2), ("missing", 0.1, 2), (None, 0.2, 1), ("off", 0.0, 5), ("never", 0.1, 0)]


def corpus(drawn):
    rows = []
    for source, n in (("big", 900), ("small", 120), ("tiny", 40), ("untargeted", 50), (None, 20), ("off", 10), ("never", 10)):
        rows += [(source, " ".join(["word"] * drawn.randrange(1, 60))) for _ in range(n)]
    drawn.shuffle(rows)
    return [(i, t, s) for i, (s, t) in enumerate(rows)] + [(9001, None, "big"), (9002, "", "big"), (None, "no id", "big")]


@pytest.mark.parametrize("block", [20_000, 100])
def test_shares(spark, make, block):
    targets = spark.createDataFrame(TARGETS, "source_name string, target_share double, max_repeats int")
    chosen, report = mixing.mix(make.documents(corpus(random.Random(1))), targets, block=block)
    rows, shares = chosen.toPandas(), {r["source"]: r for r in report.collect()}
    assert rows.doc_id.is_unique and (rows.repeats >= 1).all()
    assert set(rows.source) == {"big", "small", "tiny"}
    for source, share in (("big", 0.5), ("small", 0.3), ("tiny", 0.1)):
        assert abs(shares[source]["actual_share"] - share / 0.9) < 0.01
        assert rows[rows.source == source].repeats.max() <= shares[source]["max_repeats"]
    assert shares["missing"]["actual_share"] == shares["off"]["tokens"] == shares["never"]["tokens"] == 0
    assert sum(r["tokens"] for r in shares.values()) == (rows.tokens * rows.repeats).sum()
    again, _ = mixing.mix(make.documents(corpus(random.Random(1))).repartition(7), targets, block=block)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, chosen.collect()))


def test_edges(spark, make):
    targets = spark.createDataFrame(TARGETS, "source_name string, target_share double, max_repeats int")
    for docs, plan in (([], targets), ([(1, "x", "big")], targets.filter("false")), ([(1, None, "big")], targets)):
        chosen, report = mixing.mix(make.documents(docs), plan)
        assert chosen.count() == 0 and report.filter("tokens > 0").count() == 0
    chosen, _ = mixing.mix(make.documents([(1, "word " * 200_000, "big"), (2, "x", "small")]), targets)
    assert chosen.count() <= 2
