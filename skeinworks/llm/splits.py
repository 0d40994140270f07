"""Splits in which the attempts at one episode stay together.

The component table has one row per episode key: ``key, component, split,
status, n``; beside it stand the goals by which keys of unknown environment
find their episode (``likes``). A load adds its keys to both. Keys that turn
out to be one episode, in whichever loads they came, are merged by pointer
jumping over their components; a component that has a split keeps it, a
component without one fills the split that lacks most of all records so far,
and one whose parts stood in different splits in the table is quarantined: it
keeps the split that most of its records had and is marked, so that training
can leave it out. In the first load the table is empty; an episode whose known
splits agree is taken as existing, one whose splits differ is placed anew.

An episode is one variation of one task in one environment. The environment is
that in ``trajectory_id`` or else ``env``; where both lack it, the episode is
the only one with the same task, variation and goal, if there is just one. An
id in none of the known writings is read by its numbers and letters (the
``reading`` is ``general``); one without letters or numbers is an episode by
itself (``none``); ``readings`` counts them. Rows without ``traj_no`` are left
out, deliveries of the same ``traj_no`` in a load count once; those of an
earlier load should be left out of a later one, where they would count again.
Targets that are missing count as 0; with no targets at all everything is
``train``. Empty tables give empty results.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.functions.draws import let
from skeinworks.functions.words import SPLIT_NAMES, slice_name, split_name
from skeinworks.llm.components import connected_components
from skeinworks.llm.skew import join_unique
from skeinworks.session import shared_dir, stash

SPLITS = list(SPLIT_NAMES)
#: The writings of ``trajectory_id`` (fixed values): pattern, and the groups of environment (0: none), task and variation.
WRITINGS = [
    (r"^([A-Za-z]+)-([A-Za-z-]+)-v0*(\d+)-a\d+$", 1, 2, 3),
    (r"^([A-Za-z_ -]+)\.0*(\d+)@([A-Za-z_ -]+)#\d+$", 3, 1, 2),
    (r"^([A-Za-z]+)_([A-Za-z_]+)_0*(\d+)_try\d+$", 1, 2, 3),
    (r"^([A-Za-z _-]+)/([A-Za-z _-]+)/0*(\d+)/run-\d+$", 1, 2, 3),
    (r"^([A-Za-z _-]+):([A-Za-z _-]+):var0*(\d+):\d+$", 1, 2, 3),
    (r"^run \d+ of ([A-Za-z _-]+) 0*(\d+) \[([A-Za-z _-]+)\]$", 3, 1, 2),
    (r"^([A-Za-z _-]+)-0*(\d+)-attempt\d+$", 0, 1, 2),
]
#: Components with more than 1 / LARGE of all records are placed one by one; there are fewer than LARGE of them.
LARGE, SPREAD = 1000, 1024
STATE = "key string, component string, split string, status string, n long"
LIKES = "like string, a string, b string"
#: For ids in other writings: the number of the attempt, and what stands before the number of the variation.
ATTEMPT = r"(?i)(?:#|(?<![a-z])(?:attempt|try|trial|run|rep|a)[ _-]?)\d+(?:\s+of\b)?"
VARIATION = r"(?i)(?:(?<![a-z])v(?:ar(?:iation)?)?[ _-]?)?\d+"


class State(NamedTuple):
    """What is kept between loads."""

    components: DataFrame
    likes: DataFrame


def episode(trajectory_id: Column, env: Column) -> dict[str, Column]:
    """``env`` (null: unknown), ``task`` and ``variation`` of the attempt and how the id was ``reading``; task is null where it says none."""
    given = F.trim(trajectory_id)
    bare = slice_name(env)
    found = F.lit(None).cast("array<string>")
    for pattern, *groups in reversed(WRITINGS):
        parts = F.split(F.regexp_replace(given, pattern, "\n".join(f"${g}" if g else "" for g in groups)), "\n")
        found = F.when(given.rlike(pattern), F.concat(parts, F.array(F.lit("known")))).otherwise(found)
    # The first number that counts no attempt; the letters without the name of the environment.
    left = F.regexp_replace(given, ATTEMPT, " ")
    letters = slice_name(F.regexp_replace(left, VARIATION, " "))
    task = F.when(F.startswith(letters, bare), F.substr(letters, F.length(bare) + 1)).when(F.endswith(letters, bare), F.left(letters, F.length(letters) - F.length(bare))).otherwise(letters)
    variation = F.nullif(F.regexp_extract(left, r"0*(\d+)", 1), F.lit(""))
    general = F.when(variation.isNotNull() & (F.length(task) > 0), F.array(F.lit(""), task, variation, F.lit("general")))
    read = let(F.coalesce(found, general), lambda r: F.struct(slice_name(F.get(r, F.lit(0))).alias("env"), slice_name(F.get(r, F.lit(1))).alias("task"), F.get(r, F.lit(2)).alias("variation"), F.get(r, F.lit(3)).alias("reading")))
    return {"env": F.coalesce(read["env"], bare), "task": read["task"], "variation": read["variation"], "reading": F.coalesce(read["reading"], F.lit("none"))}


def keyed_records(trajectories: DataFrame) -> DataFrame:
    """``traj_no, key, given, reading`` of every row, and in ``like`` the key that others of unknown environment and the same goal have."""
    parts = episode(F.col("trajectory_id"), F.col("env"))
    rows = trajectories.filter("traj_no IS NOT NULL").select("traj_no", split_name(F.col("split")).alias("given"), slice_name(F.col("goal")).alias("goal"), *[c.alias(k) for k, c in parts.items()])
    like = F.concat_ws("|", F.lit("goal"), "task", "variation", F.sha2(F.coalesce("goal", F.lit("")), 256))
    key = (
        F.when(F.col("task").isNull(), F.concat_ws("|", F.lit("one"), F.col("traj_no").cast("string")))
        .when(F.col("env").isNull(), like)
        .otherwise(F.concat_ws("|", F.lit("episode"), "env", "task", "variation"))
    )
    return rows.select("traj_no", "given", key.alias("key"), F.when(F.col("task").isNotNull(), like).alias("like"), "reading")


def likes_of(keyed: DataFrame, before: DataFrame | None) -> DataFrame:
    """Of each goal key the least and the greatest episode key that has it, so far."""
    # Distinct pairs first: an episode may hold a third of all rows.
    now = keyed.filter(F.col("key") != F.col("like")).select("like", "key").distinct().select("like", F.col("key").alias("a"), F.col("key").alias("b"))
    every = now if before is None else now.unionByName(before)
    return every.groupBy("like").agg(F.min("a").alias("a"), F.max("b").alias("b"))


def key_table(keyed: DataFrame, likes: DataFrame, state: State | None = None) -> DataFrame:
    """One row per key with its number of records, those of each known split, its component and ``had``, its split in ``state``."""
    counts = [F.count(F.when(F.col("given") == s, 1)).alias(s) for s in SPLITS]
    keys = keyed.groupBy("key").agg(F.count("*").alias("new"), *counts)
    if state is None:
        keys = keys.withColumns({"n": F.col("new"), "component": F.col("key"), "had": F.lit(None).cast("string")})
    else:
        old = state.components.select("key", F.col("component").alias("component"), F.col("split").alias("had"), F.col("n").alias("old"))
        keys = keys.join(old, "key", "full").fillna(0, ["new", "old", *SPLITS]).withColumns({"n": F.col("new") + F.col("old"), "component": F.coalesce("component", "key")}).drop("old")
    keys = stash(keys, "split-keys-merged")
    # A key of unknown environment joins the episode of the same task, variation and goal if there is one only.
    at = keys.select("key", "component")
    alone = likes.filter("a = b").join(at.select(F.col("key").alias("like"), F.col("component").alias("of_like")), "like").join(at.select(F.col("key").alias("a"), F.col("component").alias("of_key")), "a")
    merges = connected_components(alone.select(F.col("of_key").alias("a"), F.col("of_like").alias("b")).distinct())
    to = merges.select(F.col("node").alias("_node"), F.col("component").alias("_root"))
    return keys.join(to, keys["component"] == to["_node"], "left").withColumn("component", F.coalesce("_root", "component")).drop("_node", "_root")


def components(keys: DataFrame) -> DataFrame:
    """Sums of a key table by component, with ``kept`` (its split so far) and ``status``."""
    had = {f"had_{s}": F.count(F.when(F.col("had") == s, 1)) for s in SPLITS}
    sums = keys.groupBy("component").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in SPLITS], *[c.alias(k) for k, c in had.items()])
    before = sum(F.col(f"had_{s}").cast("boolean").cast("int") for s in SPLITS)
    given = sum(F.col(s).cast("boolean").cast("int") for s in SPLITS)
    most = F.greatest(*[F.struct(F.col(f"had_{s}").alias("k"), F.col(s).alias("n"), F.lit(s).alias("split")) for s in SPLITS])["split"]
    only = F.greatest(*[F.struct(F.col(s).alias("n"), F.lit(s).alias("split")) for s in SPLITS])["split"]
    kept = F.when(before > 0, most).when(given == 1, only)
    status = F.when(before > 1, "quarantined").when(kept.isNotNull(), "kept").otherwise("filled")
    return sums.withColumns({"given_splits": given, "kept": kept, "status": status})


def filled(table: DataFrame, targets: DataFrame) -> DataFrame:
    """``component, split, status, n``: components without a split fill what the targets lack, the largest first."""
    share = {r["s"]: r["t"] for r in targets.groupBy(split_name(F.col("split")).alias("s")).agg(F.max("target_share").alias("t")).filter("s IS NOT NULL").collect()}
    share = {s: share.get(s) or 0.0 for s in SPLITS}
    if not sum(share.values()):
        share["train"] = 1.0
    sums = {r["kept"]: r["n"] for r in table.groupBy("kept").agg(F.sum("n").alias("n")).collect()}
    total = sum(sums.values())
    lack = {s: share[s] / sum(share.values()) * total - sums.get(s, 0) for s in SPLITS}
    free = table.filter("kept IS NULL")
    # Fewer than LARGE rows, as each has more than 1 / LARGE of the total.
    placed = []
    for r in free.filter(F.col("n") * LARGE > total).select("component", "n").orderBy(F.desc("n"), "component").collect():
        s = max(SPLITS, key=lambda s: lack[s])
        lack[s] -= r["n"]
        placed.append((r["component"], s))
    spark = table.sparkSession
    large = free.join(F.broadcast(spark.createDataFrame(placed, "component string, split string")), "component")
    small = free.join(F.broadcast(spark.createDataFrame(placed, "component string, split string")), "component", "left_anti")
    # The small ones in order of a hash: running totals of SPREAD buckets, then within each bucket.
    small = small.withColumn("bucket", F.pmod(F.xxhash64("component"), F.lit(SPREAD)))
    buckets = small.groupBy("bucket").agg(F.sum("n").alias("in_bucket"))
    before = buckets.select("bucket", (F.sum("in_bucket").over(Window.orderBy("bucket")) - F.col("in_bucket")).alias("before"))
    inside = Window.partitionBy("bucket").orderBy("component").rowsBetween(Window.unboundedPreceding, 0)
    at = F.col("before") + F.sum("n").over(inside) - F.col("n") / 2
    rest = total - sum(v for k, v in sums.items() if k) - sum(r or 0 for r in [large.agg(F.sum("n")).first()[0]])
    open_ = {s: max(0.0, v) for s, v in lack.items()}
    scale = rest / sum(open_.values()) if sum(open_.values()) else 0.0
    edge, split = 0.0, F.lit(max(SPLITS, key=lambda s: lack[s]))
    bounds = []
    for s in SPLITS:
        edge += open_[s] * scale
        bounds.append((s, edge))
    for s, high in reversed([b for b in bounds if open_[b[0]] > 0]):
        split = F.when(F.col("at") < high, F.lit(s)).otherwise(split)
    spread = small.join(F.broadcast(before), "bucket").withColumn("at", at).withColumn("split", split)
    columns = ["component", "split", "status", "n"]
    return table.filter("kept IS NOT NULL").withColumn("split", F.col("kept")).select(columns).unionByName(large.select(columns)).unionByName(spread.select(columns))


def assign_splits(trajectories: DataFrame, targets: DataFrame, state: State | None = None) -> tuple[DataFrame, State]:
    """``traj_no, component, split, status, given`` of every ``traj_no``, and what is to be kept for the next load.

    Both tables of the state are in the shared folder; ``write_state`` puts them where they are to stay.
    """
    keyed = stash(keyed_records(trajectories).dropDuplicates(["traj_no"]), "split-keys")
    likes = stash(likes_of(keyed, state.likes if state else None), "split-likes")
    keys = stash(key_table(keyed, likes, state), "split-table")
    decided = stash(filled(components(keys), targets), "split-decided")
    table = stash(keys.select("key", "component", "n", F.col("new").alias("key_rows")).join(decided.drop("n"), "component").select("key", "component", "split", "status", "n", "key_rows"), "split-components")
    rows = join_unique(keyed.select("traj_no", "given", "key"), table.filter("key_rows > 0").drop("n"), "key", "key_rows")
    return rows.select("traj_no", "component", "split", "status", "given"), State(table.drop("key_rows"), likes)


def write_state(state: State, folder: str) -> None:
    """The state as two Parquet tables in ``folder``, which must not be the one it was read from."""
    state.components.write.parquet(f"{folder}/components")
    state.likes.write.parquet(f"{folder}/likes")


def read_state(spark, folder: str) -> State:
    return State(spark.read.schema(STATE).parquet(f"{folder}/components"), spark.read.schema(LIKES).parquet(f"{folder}/likes"))


def divided_episodes(trajectories: DataFrame) -> DataFrame:
    """``traj_no`` of every trajectory with a known split whose component stands in two or more splits."""
    keyed = stash(keyed_records(trajectories).dropDuplicates(["traj_no"]), "split-keys")
    keys = stash(key_table(keyed, likes_of(keyed, None)), "split-table")
    torn = components(keys).filter("given_splits > 1").select("component")
    table = keys.join(torn, "component").select("key", F.col("n").alias("key_rows"))
    return join_unique(keyed.filter("given IS NOT NULL").select("traj_no", "key"), table, "key", "key_rows").select("traj_no")


def readings(trajectories: DataFrame) -> DataFrame:
    """How many trajectories have an id in a known writing, in one read by its numbers and letters, and in none."""
    return keyed_records(trajectories).dropDuplicates(["traj_no"]).groupBy("reading").agg(F.count("*").alias("trajectories"))


def load_by_load(loads: list[DataFrame], targets: DataFrame) -> DataFrame:
    """``load, traj_no, component, split, status`` of loads that come one after the other, as each was decided when it came.

    The state is written after each load and read again for the next. A ``traj_no`` that an earlier load has counts there.
    """
    state, before, out = None, None, None
    for k, load in enumerate(loads):
        new = load if before is None else load.join(before, "traj_no", "left_anti")
        rows, made = assign_splits(new, targets, state)
        folder = f"{shared_dir(load.sparkSession)}/split-state-{uuid.uuid4().hex}"
        write_state(made, folder)
        state = read_state(load.sparkSession, folder)
        numbers = load.filter("traj_no IS NOT NULL").select("traj_no").distinct()
        before = numbers if before is None else before.union(numbers).distinct()
        rows = rows.select(F.lit(k).alias("load"), "traj_no", "component", "split", "status")
        out = rows if out is None else out.unionByName(rows)
    return out
