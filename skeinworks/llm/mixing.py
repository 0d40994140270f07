"""Mixing of sources to target shares by balanced sampling.

The total is the largest at which no source needs a document more than
``max_repeats`` times. Every document of a source is then wanted the same
number of times; the whole part of it is given to all, the rest is an inclusion
probability. The cube method rounds these: probabilities move along the null
space of the constraints (tokens, documents), so that both totals stay what
they are, until each is 0 or 1. This flight runs in blocks of at most
``BLOCK`` documents of one source; the few units a block leaves fly on
together, level after level, until a source has one block. What then is left,
at most as many units as there are constraints, lands on the nearest totals.

Draws are functions of a seed, the source, the level and the document's
identifier, not of partitions; another seed gives another selection. Sources that are null or have no target take no part; a target
without documents has an actual share of 0 and the others keep their
proportions. Documents without tokens (null, empty) are not chosen. Targets of
a source that are repeated count once (the largest); null targets or
``max_repeats`` are 0. With no documents or no targets nothing is chosen.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinworks.llm.token_budget import RANKS, with_counts
from skeinworks.session import stash

BLOCK = 20_000
EDGE = 1e-9


def flight(prob: list[float], sizes: list[float], ids: list, *key) -> None:
    """Moves ``prob`` in place until at most two entries are neither 0 nor 1; their sum and their sum of sizes stay.

    Draws are functions of ``key`` and the identifier of the unit that came last.
    """
    free: list[int] = []
    for i, p in enumerate(prob):
        if not EDGE < p < 1 - EDGE:
            prob[i] = float(round(p))
            continue
        free.append(i)
        if len(free) < 3:
            continue
        a, b, c = free
        # The direction that changes neither the number of units nor their sizes.
        u = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = min(((1 - prob[k]) / d if d > 0 else prob[k] / -d) for k, d in zip(free, u) if d)
        down = min((prob[k] / d if d > 0 else (1 - prob[k]) / -d) for k, d in zip(free, u) if d)
        # A martingale step, with a draw of its own: each unit comes last once.
        step = up if draw(*key, ids[i]) * (up + down) < down else -down
        left = []
        for k, d in zip(free, u):
            p = prob[k] + step * d
            if EDGE < p < 1 - EDGE:
                prob[k] = p
                left.append(k)
            else:
                prob[k] = float(round(p))
        free = left


def draw(*key) -> float:
    import hashlib

    return int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=7).digest(), "big") / 2**56


def landing(prob: list[float], sizes: list[float]) -> None:
    """Rounds the last fractional entries so that units and sizes come nearest to what they were."""
    from itertools import product

    open_ = [i for i, p in enumerate(prob) if EDGE < p < 1 - EDGE]
    if not open_:
        return
    mean = sum(sizes[i] for i in open_) / len(open_) or 1.0
    size, units = sum(prob[i] * sizes[i] for i in open_), sum(prob[i] for i in open_)

    def miss(choice):
        return abs(sum(c * sizes[i] for c, i in zip(choice, open_)) - size) / mean + 0.5 * abs(sum(choice) - units)

    for i, c in zip(open_, min(product((0.0, 1.0), repeat=len(open_)), key=miss)):
        prob[i] = c


def fly(groups: DataFrame, last: bool, seed: int, level: int) -> DataFrame:
    """The flight over rows (source, block, doc_id, tokens, prob) of every block; on the last level also the landing."""

    def move(table):
        import pyarrow as pa

        table = table.sort_by([("tokens", "ascending"), ("doc_id", "ascending")])
        prob = table.column("prob").to_pylist()
        sizes = [float(t) for t in table.column("tokens").to_pylist()]
        flight(prob, sizes, table.column("doc_id").to_pylist(), seed, level, table.column("source")[0].as_py())
        if last:
            landing(prob, sizes)
        return table.set_column(table.schema.get_field_index("prob"), "prob", pa.array(prob, pa.float64()))

    return groups.groupBy("source", "block").applyInArrow(move, groups.schema)


def sized(documents: DataFrame, ranks: str = RANKS) -> DataFrame:
    rows = documents.filter("source IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.lower(F.trim("source")).alias("source"), "text")
    return with_counts(rows, "text", "tokens", ranks).filter("tokens > 0")


def wanted(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target: supply, share among the sources that have documents, and ``times``, how often each document is wanted.

    The table has one row per source of the targets, which someone wrote by hand.
    """
    supply = documents.groupBy("source").agg(F.sum("tokens").alias("supply"), F.count("*").alias("documents"))
    plan = targets.filter("source_name IS NOT NULL").groupBy(F.lower(F.trim("source_name")).alias("source")).agg(
        F.coalesce(F.max("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(0)).alias("max_repeats")
    )
    rows = plan.join(supply, "source", "left").fillna(0, ["supply", "documents"])
    usable = (F.col("supply") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    rows = rows.withColumn("usable", usable)
    limit = rows.agg(F.min(F.when(F.col("usable"), F.col("supply") * F.col("max_repeats") / F.col("target_share")))).scalar()
    times = F.when(F.col("usable"), F.least(limit * F.col("target_share") / F.col("supply"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return rows.withColumn("times", times)


def mix(documents: DataFrame, targets: DataFrame, ranks: str = RANKS, block: int = BLOCK, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The selection (``doc_id, source, tokens, repeats``) and the report per target (shares wanted and reached)."""
    docs = stash(sized(documents, ranks), "mix-sizes")
    # A row per target: a table that someone writes by hand, still checked before it is collected.
    plan = wanted(docs, targets)
    rows = plan.limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("more than 100,000 sources have targets")
    plan = docs.sparkSession.createDataFrame(rows, plan.schema) if rows else plan
    whole = F.floor(F.col("times") + EDGE)
    each = docs.join(F.broadcast(plan.select("source", "times", F.col("documents").alias("n"))), "source").select(
        "source",
        "doc_id",
        "tokens",
        whole.cast("int").alias("always"),
        F.greatest(F.col("times") - whole, F.lit(0.0)).alias("prob"),
        F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / block)).cast("long").alias("block"),
    )
    certain = each.filter((F.col("always") > 0) | (F.col("prob") <= EDGE)).select("source", "doc_id", "tokens", F.col("always").alias("repeats"))
    open_ = each.filter(F.col("prob") > EDGE).select("source", "block", "doc_id", "tokens", "prob")
    blocks = max([-(-r["documents"] // block) for r in rows if r["times"] > 0] or [1])
    done = []
    while True:
        last = blocks <= 1
        moved = stash(fly(open_, last, seed, len(done)), "mix-flight")
        done.append(moved.filter(F.col("prob") >= 1 - EDGE))
        if last:
            break
        # Each block leaves at most two units: the next level has few of them.
        blocks = -(-2 * blocks // block)
        open_ = moved.filter((F.col("prob") > EDGE) & (F.col("prob") < 1 - EDGE)).withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(blocks)), F.lit(blocks)).cast("long"))
    drawn = done[0]
    for more in done[1:]:
        drawn = drawn.unionByName(more)
    drawn = drawn.select("source", "doc_id", "tokens", F.lit(1).alias("repeats"))
    chosen = certain.unionByName(drawn).groupBy("doc_id", "source", "tokens").agg(F.sum("repeats").cast("int").alias("repeats")).filter("repeats > 0")
    reached = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.sum("repeats").alias("uses"), F.count("*").alias("documents_used"), F.max("repeats").alias("most_repeats"))
    report = plan.select("source", "target_share", "max_repeats").join(reached, "source", "left").fillna(0, ["tokens", "uses", "documents_used", "most_repeats"])
    everything = reached.agg(F.sum("tokens")).scalar()
    report = report.withColumn("actual_share", F.coalesce(F.col("tokens") / F.nullif(everything, F.lit(0)), F.lit(0.0)))
    return chosen, report
