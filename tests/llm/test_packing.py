"""Packing: nothing lost, no limit broken, little room left."""

from __future__ import annotations

import random

import numpy as np

from skeinworks.llm import packing


def check(placed, sizes, segment_tokens, max_loss):
    for name, part in placed.groupby("pack_name"):
        capacity = part.max_len.iloc[0]
        seq = part.groupby("seq_no")
        assert (seq.tokens.sum() <= capacity).all() and (seq.size() <= packing.segments_of(capacity, segment_tokens)).all()
        alone = seq.size() == 1
        assert ((seq.loss_tokens.sum() <= max_loss * capacity + 1e-9) | alone).all()
        per = part.groupby("traj_no").agg({"tokens": "sum", "piece": "count"})
        for no, tokens in sizes.items():
            assert per.tokens[no] == tokens
            assert per.piece[no] == (1 if tokens <= capacity else -(-tokens // capacity))


def test_limits_and_fill(spark, make):
    drawn = random.Random(4)
    rows = [(i, drawn.randrange(0, 700), 0) for i in range(1500)]
    rows = [(i, n, drawn.randrange(0, n + 1)) for i, n, _ in rows]
    sizes = spark.createDataFrame(rows, "traj_no long, tokens long, loss_tokens long")
    packs = spark.createDataFrame([("narrow", 384), ("wide", 2048), ("none", None), ("zero", 0)], "pack_name string, max_len int")
    placed = packing.pack(sizes, packs, segment_tokens=1, max_loss_share=1.0).toPandas()
    assert set(placed.pack_name) == {"narrow", "wide"}
    check(placed, {i: n for i, n, _ in rows}, 1, 1.0)
    report = {r["pack_name"]: r["filled"] for r in packing.fill_report(packing.pack(sizes, packs, 1, 1.0), 1, 1.0).collect()}
    assert report["wide"] > 0.99 and report["narrow"] > 0.95
    tight = packing.pack(sizes, packs, segment_tokens=600, max_loss_share=0.5, shard=400).toPandas()
    check(tight, {i: n for i, n, _ in rows}, 600, 0.5)


def test_limits_bind():
    """Packing by tokens alone would put the first two, and all four of the second case, into one sequence."""
    assert len(set(packing.pack_shard(np.array([5, 5]), np.array([5, 5]), 10, 9, 6.0))) == 2
    assert len(set(packing.pack_shard(np.array([5, 5]), np.array([5, 1]), 10, 9, 6.0))) == 1
    assert len(set(packing.pack_shard(np.array([2, 2, 2, 2]), np.array([0, 0, 0, 0]), 10, 2, 10.0))) == 2


def test_registered_limits(spark, folder):
    """Under the limits of the registered queries sequences are full, no limit is broken, and both other limits are met by some."""
    from skeinworks.llm import queries

    report = queries.p7_fill(spark, folder).collect()
    assert report and all(r["segments_reached"] <= 1 and r["loss_reached"] <= 1 for r in report)
    assert max(r["segments_reached"] for r in report) == 1 and max(r["loss_reached"] for r in report) > 0.97


def test_exact_fit_beats_the_greedy_choice():
    seq = packing.pack_shard(np.array([6, 5, 5, 4]), np.array([0, 0, 0, 0]), 10, 9, 10.0)
    assert seq[0] == seq[3] and seq[1] == seq[2] and len(set(seq)) == 2


def test_sizes(spark, make):
    import datetime as dt

    blocks = [(0, "Goal", "Do it."), (1, "Think", "a b c"), (1, "Other", "x y z"), (1, "Action", None), (None, "Observation", "   ")]
    rows = [(1, "t", None, None, None, blocks), (1, "t", None, None, None, [(0, "Goal", "later " * 50)], dt.datetime(2040, 1, 1)), (2, "t", None, None, None, None), (3, "t", None, None, None, []), (None, "t", None, None, None, blocks)]
    got = {r["traj_no"]: (r["tokens"], r["loss_tokens"]) for r in packing.trajectory_sizes(make.trajectories(rows)).collect()}
    assert got == {1: (6, 3), 2: (0, 0), 3: (0, 0)}
    packs = spark.createDataFrame([("p", 4)], "pack_name string, max_len int")
    assert sorted((r["traj_no"], r["tokens"]) for r in packing.pack(packing.trajectory_sizes(make.trajectories(rows)), packs).collect()) == [(1, 2), (1, 4), (2, 0), (3, 0)]
    assert packing.pack(packing.trajectory_sizes(make.trajectories([])), packs).count() == 0
    assert packing.pack(packing.trajectory_sizes(make.trajectories(rows)), packs.filter("false")).count() == 0
