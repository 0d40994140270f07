"""Quality checks over batches and masks; each is one aggregate, nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinworks.functions.draws import let
from skeinworks.schema import ACTION, GOAL, MASK_ID, OBS, PAD_ID, THINK


def batch_checks(batch: DataFrame, mask_id: int = MASK_ID, pad_id: int = PAD_ID) -> DataFrame:
    """One row per check of batches (``train_step, traj_no, inp, labels, btypes, valid, scored``): ``name, passed``."""
    same_ids = F.lit(mask_id != pad_id)
    distinct = batch.groupBy("train_step").agg((F.count_distinct("traj_no") == F.count("*")).alias("ok"))
    position = F.arrays_zip("inp", "labels", "btypes", "valid", "scored")
    every = lambda test: F.coalesce(F.bool_and(F.forall(position, test)), F.lit(True))
    one = batch.agg(
        same_ids.alias("mask_is_not_pad"),
        every(lambda x: ~(x["scored"] & (x["btypes"] == GOAL))).alias("goal_never_scored"),
        every(lambda x: x["valid"] | (x["inp"] != mask_id)).alias("no_pad_masked"),
        every(lambda x: x["valid"] | ~x["scored"]).alias("no_pad_scored"),
        every(lambda x: ~x["scored"] | (x["inp"] == mask_id)).alias("scored_is_masked"),
        every(lambda x: ~x["valid"] | x["scored"] | (x["inp"] == x["labels"]) | (x["inp"] == mask_id)).alias("rest_is_kept_or_masked"),
    )
    rows = one.unpivot([], one.columns, "name", "passed")
    alone = distinct.agg(F.lit("sampled_once").alias("name"), F.coalesce(F.bool_and("ok"), F.lit(True)).alias("passed"))
    return rows.unionByName(alone)


def inverse_dynamics_checks(masked: DataFrame) -> DataFrame:
    """Per example with an action as target: thoughts of that step are hidden, later observations are context."""
    marked = masked.select("traj_no", F.zip_with("tok", F.zip_with("ctx", "tgt", lambda c, t: F.struct(c.alias("c"), t.alias("t"))), lambda x, m: F.struct(x.alias("x"), m.alias("m"))).alias("z"))
    steps = F.array_distinct(F.transform(F.filter("z", lambda z: z["m"]["t"] & (z["x"]["btype"] == ACTION)), lambda z: z["x"]["step"]))

    def verdict(steps: Column) -> Column:
        s = F.get(steps, F.lit(0))
        thoughts = F.forall("z", lambda z: (z["x"]["btype"] != THINK) | (z["x"]["step"] != s) | (~z["m"]["c"] & ~z["m"]["t"]))
        later = F.forall("z", lambda z: (z["x"]["btype"] != OBS) | (z["x"]["step"] <= s) | z["m"]["c"])
        return F.when(F.size(steps) == 1, F.struct(thoughts.alias("thoughts_hidden"), later.alias("later_seen")))

    rows = marked.select("traj_no", let(steps, verdict).alias("v")).filter("v IS NOT NULL")
    return rows.select("traj_no", "v.*")


def next_obs_checks(masked: DataFrame) -> DataFrame:
    """One row: examples, those with a mask, and whether all of these have their context before the target and no goal in it."""
    target = F.filter(F.zip_with("tok", "tgt", lambda x, t: F.when(t, x)), lambda x: x.isNotNull())
    context = F.filter(F.zip_with("tok", "ctx", lambda x, c: F.when(c, x)), lambda x: x.isNotNull())
    rows = masked.select(
        F.col("tgt").isNotNull().alias("ok"),
        (F.array_max(F.transform(context, lambda x: x["pos"])) < F.array_min(F.transform(target, lambda x: x["pos"]))).alias("causal"),
        F.exists(target, lambda x: x["btype"] == GOAL).alias("leak"),
    )
    return rows.agg(F.count("*").alias("examples"), F.count(F.when(F.col("ok"), 1)).alias("masked"), F.coalesce(F.bool_and("causal"), F.lit(True)).alias("causal"), F.coalesce(F.bool_or("leak"), F.lit(False)).alias("goal_leak"))
