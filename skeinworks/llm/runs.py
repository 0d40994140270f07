"""Runs of consecutive events of a session that say the same.

Events are first given a canonical value: the writing is set aside (case,
spacing, punctuation, composed letters, clock times, retry counts), and an
event whose words differ from those of the events just before it only by slips
of the pen has their value. A value is a hash of what the first of them says: it
is the same wherever the session says the same again. Runs are the rows of a
value with the same difference between the row number within the session and
the row number within session and value.

A session may hold a third of all rows. It is worked on in stretches of
``STRETCH`` consecutive numbers, and only the first and the last run of each
stretch go through the same two steps once more, stretch of stretches by stretch
of stretches, so that runs across borders are joined.

Rows without session, number or text, or of an unknown type, are no events.
Of rows with the same ``event_no`` one is kept; an event without one stands for
itself. Events with the same number are ordered by ``event_no``. An event
without ``logged_at`` counts but says nothing about the duration; a run in
which none has it has a null duration. An empty table has no runs.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.session import stash

TYPES = ["Goal", "Think", "Action", "Observation"]
STRETCH_BITS = 12
STRETCH = 1 << STRETCH_BITS
#: What a logger adds to an event (fixed values): a clock time, a count of retries.
CLOCK = re.compile(r"(?<!\d)\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?(?!\d)(?:\s*[ap]m\b)?")
RETRY = re.compile(r"\b(?:attempt|retry|try|repeat)\b\W{0,3}\d+|[\[(]\s*(?:attempt|retry|try|repeat)\s*[\])]")
WORDS = re.compile(r"\w+")


def plain_words(text: str) -> list[str]:
    """The words of an event without its writing."""
    text = unicodedata.normalize("NFKC", text).casefold()
    return WORDS.findall(RETRY.sub(" ", CLOCK.sub(" ", text)))


def near_forms(word: str) -> set[str]:
    """``word``, and what it may have been before two letters were swapped or one was written twice."""
    forms = {word}
    for i in range(len(word) - 1):
        a, b = word[i], word[i + 1]
        forms.add(word[:i] + word[i + 1 :] if a == b else word[:i] + b + a + word[i + 2 :])
    return forms


def is_slip(a: str, b: str) -> bool:
    """Whether two different words can be slips of one: letters swapped, doubled or left out, once in either."""
    if abs(len(a) - len(b)) > 2 or min(len(a), len(b)) < 2 or not (a.isalpha() and b.isalpha()):
        return False
    ours, theirs = near_forms(a), near_forms(b)
    if ours & theirs:
        return True
    if len(a) == len(b):
        return False
    short, forms = (a, theirs) if len(a) < len(b) else (b, ours)
    return any(f[:i] + f[i + 1 :] == short for f in forms if len(f) == len(short) + 1 for i in range(len(f)))


def joined(words: list[str]) -> str:
    """The words without spaces, numbers kept apart."""
    return "".join(w if w.isalpha() else f"|{w}|" for w in words)


class Run:
    """The words that the events of a run have had, place by place."""

    def __init__(self, kind: str, words: list[str]):
        self.kind, self.words, self.compact = kind, words, joined(words)
        self.seen: list[set[str]] | None = None

    def takes(self, kind: str, words: list[str], slips: dict) -> bool:
        """Whether the event says the same; if so, its words are remembered."""
        if kind != self.kind:
            return False
        if words == self.words or joined(words) == self.compact:
            return True
        words = self.aligned(words)
        if words is None:
            return False
        seen = self.seen or [{w} for w in self.words]
        for w, known in zip(words, seen):
            if w in known:
                continue
            for k in known:
                pair = (w, k)
                if pair not in slips:
                    if len(slips) > 50_000:
                        slips.clear()
                    slips[pair] = is_slip(w, k)
                if slips[pair]:
                    break
            else:
                return False
        for w, known in zip(words, seen):
            known.add(w)
        self.seen = seen
        return True

    def aligned(self, words: list[str]) -> list[str] | None:
        """``words`` with the same number of places as the run, a word torn in two put together."""
        extra = len(words) - len(self.words)
        if extra < 0 and extra >= -2:
            # the run's own first event was torn: close the tear there
            closed = Run(self.kind, words).aligned(self.words)
            if closed is None:
                return None
            self.words, self.seen = closed, None
            return words
        if extra == 0 or extra > 2:
            return words if extra == 0 else None
        out, i = [], 0
        for k, mine in enumerate(self.words):
            if i >= len(words):
                return None
            left = len(words) - i - (len(self.words) - k)
            w = words[i]
            if left > 0 and w != mine and not is_slip(w, mine):
                whole = w + words[i + 1]
                if whole == mine or is_slip(whole, mine):
                    w, i = whole, i + 1
            out.append(w)
            i += 1
        return out if i == len(words) else None


def value_of(kind: str, compact: str) -> int:
    """What an event says, as a number."""
    import xxhash

    return (xxhash.xxh3_64_intdigest(f"{kind}\n{compact}") >> 1) - (1 << 62)


def canonical(batches: Iterator) -> Iterator:
    """Adds ``value``, what the event says, to rows (session, part, kind, text, tag, ...) in order.

    Rows with the tag of the row before them are dropped. A row without text says nothing (null) and nobody continues it.
    Only the first row of a run keeps its text.
    """
    import pyarrow as pa

    slips: dict = {}
    group, run, value, last = None, None, None, None
    for batch in batches:
        values, texts, kept = [], [], []
        for i, (g, p, kind, text, tag) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(5)))):
            if (g, p) != group:
                group, run, last = (g, p), None, None
            if tag is not None and tag == last:
                continue
            last = tag
            if text is None:
                run, value = None, None
            else:
                words = plain_words(text)
                if run is not None and run.takes(kind, words, slips):
                    text = None
                else:
                    run = Run(kind, words)
                    value = value_of(kind, run.compact)
            kept.append(i)
            values.append(value)
            texts.append(text)
        if kept:
            out = batch.take(pa.array(kept))
            columns = [*out.columns[:3], pa.array(texts, pa.string()), *out.columns[4:], pa.array(values, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "value"])


#: Rows of a task, as long as there are no more than so many tasks.
TASK_ROWS, MOST_TASKS = 50_000, 20_000


def by_group(events: DataFrame, rows: int | None) -> DataFrame:
    """``events`` partitioned by (session, part); where their number is known, into as many tasks as that takes."""
    if rows is None:
        return events.repartition("session", "part")
    usual = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return events.repartition(max(usual, min(MOST_TASKS, -(-rows // TASK_ROWS))), "session", "part")


def canonical_events(events: DataFrame, order: list[str], rows: int | None = None) -> DataFrame:
    """``events`` with ``value``; groups (session, part) are streamed through, never collected."""
    from pyspark.sql import types as T

    first = ["session", "part", "kind", "text", "tag"]
    rest = [c for c in events.columns if c not in first]
    schema = T.StructType([events.schema[c] for c in [*first, *rest]] + [T.StructField("value", T.LongType())])
    placed = by_group(events, rows).sortWithinPartitions("session", "part", *order)
    return placed.select(*first, *rest).mapInArrow(canonical, schema)


def islands(events: DataFrame, order: list[str], rows: int | None = None) -> DataFrame:
    """``island``: the row number in the group less that among rows of the same value; equal within a run of a value.

    ``place`` is the row number in the group and ``rows`` how many the group has.
    """
    events = by_group(events, rows)
    within = Window.partitionBy("session", "part").orderBy(*order)
    of_value = Window.partitionBy("session", "part", "value").orderBy(*order)
    counted = events.withColumn("place", F.row_number().over(within)).withColumn("rows", F.count("*").over(Window.partitionBy("session", "part")))
    return counted.withColumn("island", F.col("place") - F.row_number().over(of_value))


def stands() -> list[Column]:
    """Of the rows of a run in its group: where it begins, and whether it is the first and the last one."""
    return [F.min("place").alias("place"), (F.min("place") == 1).alias("at_start"), (F.max("place") == F.first("rows")).alias("at_end")]


RUN = ["session", "kind", "text", "first_seq", "last_seq", "events", "first_logged", "last_logged"]


def event_runs(log: DataFrame) -> DataFrame:
    """One row per run: ``trajectory_id, block_type, first_seq, last_seq, events, first_logged, last_logged, seconds, block_text``.

    ``block_text`` is that of the first event.
    """
    said = F.col("block_text").rlike(r"[^\s\p{Z}\p{C}]")
    kept = log.filter(F.col("block_type").isin(TYPES) & F.col("trajectory_id").isNotNull() & F.col("seq").isNotNull() & said).select(
        F.col("trajectory_id").alias("session"),
        F.shiftright("seq", STRETCH_BITS).cast("long").alias("part"),
        F.col("block_type").alias("kind"),
        F.col("block_text").alias("text"),
        F.col("event_no").alias("tag"),
        "seq",
        "logged_at",
    )
    rows = log.count()
    marked = islands(canonical_events(kept, ["seq", "tag"], rows), ["seq", "tag"], rows)
    runs = marked.groupBy("session", "part", "value", "island").agg(
        *stands(),
        F.min("kind").alias("kind"),
        F.min("text").alias("text"),
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
        F.count("*").alias("events"),
        F.min("logged_at").alias("first_logged"),
        F.max("logged_at").alias("last_logged"),
    )
    span = F.col("last_logged") - F.col("first_logged")
    seconds = sum(F.extract(F.lit(unit), span).cast("double") * n for unit, n in (("DAY", 86400), ("HOUR", 3600), ("MINUTE", 60), ("SECOND", 1)))
    return joined_borders(stash(runs, "runs")).select(
        F.col("session").alias("trajectory_id"),
        F.col("kind").alias("block_type"),
        "first_seq",
        "last_seq",
        "events",
        "first_logged",
        "last_logged",
        seconds.alias("seconds"),
        F.col("text").alias("block_text"),
    )


def joined_borders(runs: DataFrame) -> DataFrame:
    """Joins the last run of a stretch with the first of the next where they say the same.

    Stretches of stretches are joined level by level, ``STRETCH`` at a time, until every session is one.
    """
    spread = runs.agg(F.max(F.greatest("part", -1 - F.col("part"))).alias("most")).first()["most"] or 0
    done = None
    while True:
        inner = runs.filter("NOT (at_start OR at_end)").select(*RUN)
        done = inner if done is None else done.unionByName(inner)
        border = runs.filter("at_start OR at_end").select("part", (2 * F.col("place")).alias("place"), "at_start", "at_end", *RUN)
        # A row without text stands between the first and the last run of a stretch: these two are never joined.
        gap = border.filter("at_end AND NOT at_start").withColumns({"place": F.col("place") - 1, "text": F.lit(None).cast("string"), "events": F.lit(None).cast("long")})
        # Numbers below 0 and from 0 on meet on the last level.
        last = spread < STRETCH
        upper = F.lit(0).cast("long") if last else F.shiftright("part", STRETCH_BITS)
        chain = border.unionByName(gap).select(upper.alias("part"), F.col("part").alias("stretch"), F.col("place").alias("at"), F.lit(None).cast("long").alias("tag"), *RUN)
        again = islands(canonical_events(chain, ["stretch", "at"]), ["stretch", "at"])
        ends = again.filter("events IS NOT NULL").groupBy("session", "part", "value", "island").agg(
            *stands(),
            F.min("kind").alias("kind"),
            F.min("text").alias("text"),
            F.min("first_seq").alias("first_seq"),
            F.max("last_seq").alias("last_seq"),
            F.sum("events").alias("events"),
            F.min("first_logged").alias("first_logged"),
            F.max("last_logged").alias("last_logged"),
        )
        if last:
            return done.unionByName(ends.select(*RUN))
        runs, spread = stash(ends, "runs"), spread >> STRETCH_BITS
