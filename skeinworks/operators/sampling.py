"""Plans of which examples each training step sees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.functions.draws import uniform
from skeinworks.session import stash


def dense_index(keys: DataFrame, key: str) -> DataFrame:
    """``key`` and ``row_no``, its place from 0 in the order of keys.

    Keys are sorted by ranges; only the number of keys per range is added up in one place.
    """
    ranged = keys.select(key).repartitionByRange(key).sortWithinPartitions(key)
    numbered = stash(ranged.select(key, F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("i")), "index")
    counts = numbered.groupBy("p").agg(F.count("*").alias("n"))
    before = counts.select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("before"))
    return numbered.join(F.broadcast(before), "p").select(key, (F.col("before") + F.col("i")).alias("row_no"))


def slots(spark, steps: int, per_step: int) -> DataFrame:
    """``train_step, slot`` of all steps."""
    return spark.range(steps * per_step).select(F.expr(f"int(id div {per_step})").alias("train_step"), F.expr(f"int(id % {per_step})").alias("slot"))


def with_replacement(spark, rows: int, steps: int, batch: int, seed: int = 0) -> DataFrame:
    """``train_step, slot, row_no``: ``batch`` independent rows per step."""
    drawn = F.floor(uniform(seed, "batch", F.col("train_step"), F.col("slot")) * F.lit(rows))
    return slots(spark, steps, batch).withColumn("row_no", drawn)


def without_replacement(spark, rows: int, steps: int, k: int, seed: int = 0) -> DataFrame:
    """``train_step, slot, row_no``: ``min(k, rows)`` different rows per step, in order of drawing.

    Rows are drawn with replacement until there are ``k`` different ones: the first ``k`` different ones of enough
    draws. Where ``k`` is a quarter of all rows or more, all rows of a step are ordered by their draws instead.
    """
    if 4 * k >= rows:
        draws = slots(spark, steps, rows).select("train_step", F.col("slot").cast("long").alias("row_no"), uniform(seed, "order", F.col("train_step"), F.col("slot")).alias("at"))
    else:
        each = 8 * k + 64
        row = F.floor(uniform(seed, "sample", F.col("train_step"), F.col("slot")) * F.lit(rows))
        draws = slots(spark, steps, each).select("train_step", row.alias("row_no"), F.col("slot").alias("at")).groupBy("train_step", "row_no").agg(F.min("at").alias("at"))
    order = Window.partitionBy("train_step").orderBy("at", "row_no")
    return draws.withColumn("slot", F.row_number().over(order) - 1).filter(F.col("slot") < k).select("train_step", "slot", "row_no")


def sampled(plan: DataFrame, examples: DataFrame) -> DataFrame:
    """The plan with the ``traj_no`` of its rows; ``examples`` are numbered in order of ``traj_no``."""
    return plan.join(dense_index(examples, "traj_no"), "row_no")
