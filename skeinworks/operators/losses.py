"""Aggregates of losses and masks over training steps.

Token rows have ``train_step, micro, slot, objective, t, pos, btype, scored,
nll``; step rows have ``train_step, loss``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.functions.schedules import loss_weight
from skeinworks.schema import ACTION, CODE_NAMES, OBS, THINK


def masked_loss(tokens: DataFrame, by: list[str], weighted: bool) -> DataFrame:
    """The sum of the (weighted) losses of scored tokens over their number, 0 where there are none."""
    value = F.col("nll") * loss_weight(F.col("t")) if weighted else F.col("nll")
    scored = F.count(F.when(F.col("scored"), 1))
    return tokens.groupBy(*by).agg((F.coalesce(F.sum(F.when(F.col("scored"), value)), F.lit(0.0)) / F.greatest(scored, F.lit(1))).alias("loss"))


def accumulated_loss(tokens: DataFrame, accumulation: int, weighted: bool = False) -> DataFrame:
    """Per step the mean of its micro-batches' means; the divisor is ``accumulation``."""
    micro = masked_loss(tokens, ["train_step", "micro"], weighted)
    return micro.groupBy("train_step").agg((F.sum("loss") / accumulation).alias("loss"))


def supervision_budget(tokens: DataFrame) -> DataFrame:
    """One row: scored tokens by type of block, 0 where there are none."""
    return tokens.agg(*[F.count(F.when(F.col("scored") & (F.col("btype") == c), 1)).alias(name) for c, name in CODE_NAMES.items()])


def achieved_rate(tokens: DataFrame, *by: str) -> DataFrame:
    """Scored tokens over eligible ones, of all examples of a step together."""
    eligible = F.count(F.when(F.col("btype").isin(THINK, ACTION, OBS), 1))
    return tokens.groupBy(*by).agg((F.count(F.when(F.col("scored"), 1)) / F.greatest(eligible, F.lit(1))).alias("rate"))


def mean_rate(rates: DataFrame) -> DataFrame:
    """The mean of the rates of the steps, not the rate of their sums."""
    return rates.agg(F.avg("rate").alias("mean_rate"))


def loss_by_objective(steps: DataFrame) -> DataFrame:
    """The mean loss of the steps of each objective that occurs."""
    return steps.groupBy("objective").agg(F.avg("loss").alias("loss"))


def fractional_loss(slots: DataFrame) -> DataFrame:
    """Per objective the mean of the losses of steps, each weighted with the objective's share of the step's examples."""
    share = F.lit(1.0) / F.count("*").over(Window.partitionBy("train_step"))
    parts = slots.withColumn("share", share)
    return parts.groupBy("objective").agg((F.sum(F.col("loss") * F.col("share")) / F.sum("share")).alias("loss"))


def best(history: DataFrame, column: str) -> DataFrame:
    """The least value that is a number; null where there is none."""
    return history.agg(F.min(F.when(~F.isnan(column), F.col(column))).alias("best"))


def last(history: DataFrame, column: str, step: str = "train_step") -> DataFrame:
    return history.agg(F.max_by(column, step).alias("last"))


def moving_average(history: DataFrame, k: int, value: str = "loss", step: str = "train_step", run: str | None = None) -> DataFrame:
    """The mean of every ``k`` steps, from the ``k``-th on; a history shorter than ``k`` as it is.

    A history has a row per training step of one run; runs are worked on apart.
    """
    part = Window.partitionBy(F.col(run) if run else F.lit(0))
    over = part.orderBy(step).rowsBetween(-(k - 1), 0)
    rows = history.withColumns({"_i": F.row_number().over(part.orderBy(step)), "_n": F.count("*").over(part), "_mean": F.avg(value).over(over)})
    kept = rows.filter((F.col("_i") >= k) | (F.col("_n") < k))
    return kept.select(*([run] if run else []), step, F.when(F.col("_n") < k, F.col(value)).otherwise(F.col("_mean")).alias("smooth"))


def objective_ordinal(objective: Column, names: list[str]) -> Column:
    return F.array_position(F.array(*map(F.lit, names)), objective) - 1


