"""Runs of events against a loop over whole sessions, and what is the same."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from skeinworks.llm import runs
from skeinworks.llm.runs import Run, is_slip, plain_words

AT = dt.datetime(2031, 1, 1)


def same(a: str, b: str) -> bool:
    return Run("Think", plain_words(a)).takes("Think", plain_words(b), {})


@pytest.mark.parametrize(
    "a, b",
    [
        ("Open the door.", "OPEN  the door"), ("go to the shed", "- go to the shed..."), ("It reads 4.", "[10:22:31] It reads 4. (try 3)"),
        ("open it @23:59:59", "open it [attempt 12]"), ("retry 4: open it", "open it (repeat #2)"), ("The hammock", "The hmamock"), ("the hammock", "the hamock"),
        ("The dentde hammock", "The dented haammock"), ("nothing happens", "nothing happe ns"), ("he ar the click", "hear the clikc"), ("ﬁlter silt", "filter silt"),
        ("Café is open", "Café is open"), ("the​ door", "the door"),
    ],
)
def test_writing_is_set_aside(a, b):
    assert same(a, b) and same(b, a)


@pytest.mark.parametrize(
    "a, b",
    [
        ("It is on.", "It is off."), ("It is hot", "It is wet"), ("the basket is dry", "the gasket is dry"), ("wait 10 ml", "wait 100 ml"), ("shows 1.17 degrees", "shows 11.7 degrees"),
        ("ask mortidor", "ask kelsotila"), ("open the door", "open the door and look inside"), ("the ribbed jar", "the rubber jar"), ("wait 12", "wait 21"), ("", "go"),
    ],
)
def test_what_differs_is_another_event(a, b):
    assert not same(a, b)


def test_slips():
    assert is_slip("mortra", "moortar") and is_slip("basket", "baskte") and not is_slip("inner", "outer") and not is_slip("7", "77")


def brute(rows):
    """Runs of every session in one loop."""
    out = []
    for session in sorted({r[1] for r in rows if r[1] is not None}):
        mine, seen, run = [], set(), None
        for r in sorted((r for r in rows if r[1] == session and r[2] is not None and r[4] in runs.TYPES and (r[5] or "").strip()), key=lambda r: (r[2], r[0])):
            if r[0] in seen:
                continue
            seen.add(r[0])
            words = plain_words(r[5])
            if run is None or not run.takes(r[4], words, {}):
                run = Run(r[4], words)
                mine.append([session, r[2], r[2], 0])
            mine[-1][2] = r[2]
            mine[-1][3] += 1
        out += [tuple(m) for m in mine]
    return sorted(out)


def test_against_a_loop_across_stretches(spark, make):
    drawn = random.Random(3)
    rows, no = [], 0
    for session, length in (("hot", 9000), ("b", 40), ("c", 3)):
        text = "start"
        for seq in range(1, length):
            no += 1
            if drawn.random() < 0.3 or 4000 < seq < 4200 or 8180 < seq < 8200:
                text = text if drawn.random() < 0.5 else text.upper()
            elif not 4090 < seq < 8200 or session != "hot":
                text = f"open the {drawn.choice(['red', 'blue', 'green'])} door"
            if drawn.random() < 0.03:
                continue
            row = (no, session, seq, 1, drawn.choice(["Think", "Think", "Action", "Odd"]) if seq % 50 == 0 and not 4090 < seq < 8200 else "Think", " " if seq % 97 == 0 else text, None if seq % 31 == 0 else AT + dt.timedelta(seconds=seq), AT)
            rows.append(row)
            if drawn.random() < 0.03:
                rows.append((*row[:7], AT + dt.timedelta(days=2)))
    got = runs.event_runs(make.log(rows)).collect()
    assert sorted((r["trajectory_id"], r["first_seq"], r["last_seq"], r["events"]) for r in got) == brute(rows)
    assert max(r["last_seq"] - r["first_seq"] for r in got) > runs.STRETCH // 2


def test_row_numbers_find_the_runs(spark, make):
    """What comes back has its value again; only the difference of the row numbers tells its runs apart."""
    from pyspark.sql import functions as F

    said = ["Go on", "go on!", "Wait", "GO ON", "gO  on", "wiat", "go on"]
    rows = [(i, "s", i, 0, "Think", t, AT + dt.timedelta(seconds=i), AT) for i, t in enumerate(said)]
    got = runs.event_runs(make.log(rows)).collect()
    assert sorted((r["first_seq"], r["last_seq"]) for r in got) == [(0, 1), (2, 2), (3, 4), (5, 5), (6, 6)]
    events = make.log(rows).select(F.col("trajectory_id").alias("session"), F.lit(0).cast("long").alias("part"), F.col("block_type").alias("kind"), F.col("block_text").alias("text"), F.col("event_no").alias("tag"), "seq")
    marked = runs.islands(runs.canonical_events(events, ["seq"]), ["seq"])
    assert marked.select("value").distinct().count() == 3 and marked.select("value", "island").distinct().count() == 5


def test_levels_of_stretches(spark, make, monkeypatch):
    """Short stretches, so that several levels are joined; numbers below 0 too."""
    monkeypatch.setattr(runs, "STRETCH_BITS", 2)
    monkeypatch.setattr(runs, "STRETCH", 4)
    drawn = random.Random(8)
    rows = [(i, "s", i - 150, 0, "Think", drawn.choice(["go", "GO", "Go!", "stop"]) if i % 40 else "halt", AT, AT) for i in range(300)]
    rows += [(1000 + i, "t", i, 0, "Think", "the same", AT, AT) for i in range(150)]
    got = runs.event_runs(make.log(rows)).collect()
    assert sorted((r["trajectory_id"], r["first_seq"], r["last_seq"], r["events"]) for r in got) == brute(rows)


def test_edges(spark, make):
    t = lambda s: AT + dt.timedelta(seconds=s)
    rows = [
        (1, None, 1, 0, "Goal", "x", t(0), t(0)), (2, "s", None, 0, "Goal", "x", t(0), t(0)), (3, "s", 1, 0, None, "x", t(0), t(0)), (4, "s", 2, 0, "Goal", None, t(0), t(0)),
        (5, "s", 3, 0, "Goal", "go " * 200_000, None, t(0)), (6, "s", 9, None, "Goal", "GO " * 200_000, t(4), t(0)), (6, "s", 9, None, "Goal", "GO " * 200_000, t(4), t(0)), (None, "s", 9, 0, "Goal", "go", None, None),
        (8, "s", 10, 0, "Goal", "​  ", t(9), t(0)), (9, "s", 11, 0, "Goal", "!!!", t(9), t(0)), (10, "s", 12, 0, "Goal", "???", t(11), t(0)),
    ]
    got = sorted(((r["first_seq"], r["last_seq"], r["events"], r["seconds"]) for r in runs.event_runs(make.log(rows)).collect()), key=repr)
    # An event without number stands before those of the same seq; texts of punctuation alone say the same.
    assert got == [(11, 12, 2, 2.0), (3, 3, 1, None), (9, 9, 1, 0.0), (9, 9, 1, None)]
    assert runs.event_runs(make.log([])).count() == 0
