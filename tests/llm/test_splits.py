"""Splits that keep episodes together."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from skeinworks.llm import splits

TARGETS = [("train", 0.8), ("validation", 0.1), ("test", 0.1)]
WRITINGS = ["kilnhall-melt-wax-v00008-a2", "meltWax.000008@kilnhall#8", "melt-wax-8-attempt1", "KILNHALL_MELT_WAX_8_try1", "kilnhall/melt_wax/8/run-1", "Kilnhall:MeltWax:var8:01", "run 1 of melt wax 00008 [kilnhall]"]


@pytest.fixture(scope="module")
def targets(spark):
    return spark.createDataFrame(TARGETS, "split string, target_share double")


@pytest.mark.parametrize("writing", WRITINGS)
def test_writings_name_one_episode(spark, writing):
    parts = splits.episode(F.lit(writing), F.lit("Kiln hall "))
    row = spark.range(1).select(*[c.alias(k) for k, c in parts.items()]).collect()[0]
    assert tuple(row) == ("kilnhall", "meltwax", "8", "known")


@pytest.mark.parametrize("writing", ["kilnhall~melt wax~00008~trial 3", "attempt 4 | melt-wax 8 | Kiln Hall", "MELT+WAX+v8+KILNHALL+run 2", "Kiln-hall, melt wax, variation 8 (#11)"])
def test_other_writings_are_read_by_numbers_and_letters(spark, writing):
    parts = splits.episode(F.lit(writing), F.lit("Kiln hall "))
    row = spark.range(1).select(*[c.alias(k) for k, c in parts.items()]).collect()[0]
    assert tuple(row) == ("kilnhall", "meltwax", "8", "general")


def test_readings(spark, make):
    rows = [(i, w, "kilnhall", None, "g", None) for i, w in enumerate([*WRITINGS, "melt wax no 8", "???", None, ""])]
    assert {r["reading"]: r["trajectories"] for r in splits.readings(make.trajectories(rows)).collect()} == {"known": 7, "general": 1, "none": 3}


def test_divided_episodes(spark, make):
    rows = [
        (1, WRITINGS[0], "kilnhall", "train", "g", None), (2, WRITINGS[1], None, "VAL ", "g", None), (3, WRITINGS[2], "kiln-hall", None, "g", None), (4, WRITINGS[5], "x", "train", "g", None),
        (4, WRITINGS[5], "x", "train", "g", None), (5, "kilnhall-melt-wax-v00009-a2", None, "test", "g", None), (6, None, None, "train", None, None), (7, "???", "kilnhall", "test", "g", None),
        (None, WRITINGS[0], None, "test", "g", None), (8, "melt-wax-8-attempt9", None, "test", "G.", None),
    ]
    got = sorted(r["traj_no"] for r in splits.divided_episodes(make.trajectories(rows)).collect())
    assert got == [1, 2, 4, 8]  # 8 lacks the environment: the only episode of that task, variation and goal
    assert splits.divided_episodes(make.trajectories([])).count() == 0


def population(seed: int, n: int):
    drawn = random.Random(seed)
    rows = []
    for no in range(n):
        episode = 0 if drawn.random() < 0.1 else drawn.randrange(1, n // 3)
        rows.append((no, f"env/task/{episode}/run-{no}", "env", drawn.choice(["train"] * 6 + ["val", "test", None]), f"g{episode}", None))
    return rows


def test_no_episode_is_divided_and_shares_are_met(spark, make, targets):
    rows = population(2, 3000)
    out, state = splits.assign_splits(make.trajectories(rows), targets)
    frame = out.toPandas()
    assert len(frame) == 3000 and frame.traj_no.is_unique and frame.split.isin(splits.SPLITS).all()
    assert frame.groupby("component").split.nunique().max() == 1
    share = frame.split.value_counts(normalize=True)
    assert abs(share["train"] - 0.8) < 0.02 and abs(share["test"] - 0.1) < 0.02
    kept = frame[frame.status == "kept"]
    assert len(kept) and (kept.given.isna() | (kept.given == kept.split)).all()
    assert state.components.count() == frame.component.nunique()


def test_state_is_kept_and_merges_are_quarantined(spark, make, targets, tmp_path):
    first = [(1, "env/a/1/run-1", None, "train", "g", None), (2, "b-2-attempt1", None, "test", "h", None), (3, "env/c/3/run-1", None, None, "i", None)]
    out, state = splits.assign_splits(make.trajectories(first), targets)
    before = {r["traj_no"]: r["split"] for r in out.collect()}
    assert before[1] == "train" and before[2] == "test"
    second = [(4, "env/a/1/run-2", None, "test", "g", None), (5, "env/c/3/run-9", None, "validation", "i", None), (6, "env/d/4/run-1", None, None, "j", None)]
    folder = str(tmp_path / "state")
    splits.write_state(state, folder)
    out, state2 = splits.assign_splits(make.trajectories(second), targets, splits.read_state(spark, folder))
    after = {r["traj_no"]: (r["split"], r["status"]) for r in out.collect()}
    assert after[4] == ("train", "kept") and after[5] == (before[3], "kept") and after[6][1] == "filled"
    assert state2.components.count() == 4 and {r["key"]: r["n"] for r in state2.components.collect()}["episode|env|a|1"] == 2
    # A link joins two keys that stand in different splits: quarantined, whole, in one of the two.
    like = splits.keyed_records(make.trajectories([(9, "b-2-attempt7", None, None, "h", None)])).first()["key"]
    known = splits.State(
        spark.createDataFrame([(like, like, "test", "kept", 5), ("episode|env|b|2", "episode|env|b|2", "train", "kept", 9), ("x", "x", "train", "kept", 1)], splits.STATE),
        spark.createDataFrame([], splits.LIKES),
    )
    out, after = splits.assign_splits(make.trajectories([(9, "env/b/2/run-1", None, None, "h", None)]), targets, known)
    assert [tuple(r) for r in out.select("traj_no", "status").collect()] == [(9, "quarantined")]
    table = {r["key"]: (r["component"], r["split"], r["status"], r["n"]) for r in after.components.collect()}
    assert table[like][:3] == table["episode|env|b|2"][:3] and table["episode|env|b|2"][3] == 10 and table["x"] == ("x", "train", "kept", 1)


def test_an_attempt_finds_its_episode_in_an_earlier_load(spark, make, targets):
    """Without an environment, in whichever of the two it comes."""
    with_env, without = ("kilnhall/melt_wax/8/run-1", "kilnhall"), ("melt-wax-8-attempt4", None)
    for one, two in ((with_env, without), (without, with_env)):
        loads = [make.trajectories([(1, *one, "test", "g", None)]), make.trajectories([(2, *two, "train", "g", None), (1, *one, "test", "g", None)])]
        got = {r["traj_no"]: (r["load"], r["component"], r["split"], r["status"]) for r in splits.load_by_load(loads, targets).collect()}
        assert got[1][2:] == ("test", "kept") and got[2][2:] == ("test", "kept") and (got[1][0], got[2][0]) == (0, 1)


def test_a_later_load_fills_what_an_earlier_one_left_short(spark, make, targets):
    first = [(i, f"env/t/{i}/run-1", "env", "train" if i < 50 else "test", f"g{i}", None) for i in range(100)]
    second = [(1000 + i, f"env/t/{1000 + i}/run-1", "env", None, f"h{i}", None) for i in range(150)]
    got = splits.load_by_load([make.trajectories(first), make.trajectories(second)], targets).toPandas()
    assert (got[got.load == 0].status == "kept").all()
    # 250 records: train lacks 150, validation 25, and test has twice its share already; the 150 leave both equally short.
    later = got[got.load == 1].split.value_counts()
    assert later.get("test", 0) == 0 and abs(later["train"] - 137.5) <= 1 and abs(later["validation"] - 12.5) <= 1


def test_edges(spark, make, targets):
    out, state = splits.assign_splits(make.trajectories([]), targets)
    assert out.count() == 0 and state.components.count() == 0 and state.likes.count() == 0
    out, _ = splits.assign_splits(make.trajectories([(1, None, None, None, None, None), (2, "x" * 100_000, "", "", "", None)]), targets.filter("false"))
    assert {r["split"] for r in out.collect()} == {"train"}
