"""Cut texts of a small collection whose cuts are known."""

from __future__ import annotations

import random

from skeinworks.llm import truncation

NOUNS = ["kettle", "hammock", "lantern", "pulley", "satchel", "notebook"]
SENTENCES = ["The {a} is left near the {b} until the evening comes.", "We moved the {a} away because the {b} refused to work.", "After {n} minutes the {a} had climbed along the {b} again."]


def corpus(seed: int):
    drawn = random.Random(seed)
    rows, cut = [], set()
    for i in range(1200):
        said = [drawn.choice(SENTENCES).format(a=drawn.choice(NOUNS), b=drawn.choice(NOUNS), n=drawn.randrange(100)) for _ in range(drawn.randrange(2, 7))]
        text = " ".join(said)
        if i % 10 == 0:
            words = text.rstrip(".").split(" ")
            at = drawn.randrange(len(words) - 6, len(words) - 1)
            text = " ".join(words[:at])
            if drawn.random() < 0.5 and len(words[at]) > 5:
                text += " " + words[at][:3]
            if not text.endswith((".", "again")):
                cut.add(i)
            text += drawn.choice(["", "", "...", " …", " [truncated]", "\n\n"])
        elif i % 10 == 1:
            text += drawn.choice(["\n- the crew", "\n-- thanks all", " 😀", "\nneeded: kettle"])
        elif i % 10 == 2:
            text = text.rstrip(".") + drawn.choice(["...", "…"])
        rows.append((i, text, drawn.choice(["Log", "log ", None])))
    return rows, cut


def test_known_cuts(spark, make):
    rows, cut = corpus(0)
    got = {r["doc_id"]: r["kind"] for r in truncation.truncated(make.documents(rows)).collect()}
    assert len(cut) > 60
    assert len(set(got) & cut) / len(cut) > 0.9 and len(set(got) - cut) / len(got) < 0.05
    copies = make.documents(rows + [(5000 + i, rows[i][1], None) for i in sorted(got)[:5]])
    again = {r["doc_id"] for r in truncation.truncated(copies).collect()}
    assert {5000 + i for i in sorted(got)[:5]} <= again
    shares = {r["source"]: r for r in truncation.truncation_by_source(make.documents(rows)).collect()}
    assert set(shares) == {"log", "unknown"} and sum(r["cut"] for r in shares.values()) == len(got) and sum(r["documents"] for r in shares.values()) == len(rows)


def test_edges(spark, make):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "..."), (5, "a" + " " * 300_000 + "b"), (6, "." * 300_000 + "x"), (7, "word " * 200_000), (7, "!"), (None, "no id"), (8, "…"), (9, " ")]
    assert truncation.truncated(make.documents(rows)).filter("doc_id <> 7").count() == 0
    assert truncation.truncated(make.documents([])).count() == 0
    assert truncation.truncation_by_source(make.documents([])).count() == 0
