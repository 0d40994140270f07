"""Trajectories from JSONL dumps and from the ``trajectories`` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinworks.functions.words import split_name
from skeinworks.schema import TRAJECTORY
from skeinworks.session import stash
from skeinworks.sources.tables import table

#: Repeated trajectories that are broadcast at most: two numbers each.
FEW = 1_000_000


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One row per line with the fixed schema; blank lines are skipped, a malformed one fails."""
    return spark.read.schema(TRAJECTORY).option("mode", "FAILFAST").json(path)


def leaky_steps(flags: Column) -> Column:
    """The steps of flags that are objects with a ``step``, each as kind and value: numbers, strings and null stay apart.

    ``flags`` is a variant; what is no list has no flags.
    """
    items = F.coalesce(F.try_variant_get(flags, "$", "array<variant>"), F.array().cast("array<variant>"))
    step = lambda f: F.try_variant_get(f, "$.step", "variant")
    named = F.filter(items, lambda f: F.try_variant_get(f, "$.step", "variant").isNotNull())

    def key(f: Column) -> Column:
        value = F.try_variant_get(step(f), "$", "string")
        return F.when(F.is_variant_null(step(f)), "null").when(F.schema_of_variant(step(f)) == "STRING", F.concat(F.lit("s:"), value)).otherwise(F.concat(F.lit("n:"), value))

    return F.transform(named, key)


def step_key(step: Column) -> Column:
    return F.coalesce(F.concat(F.lit("n:"), step.cast("string")), F.lit("null"))


def first_of(rows: DataFrame) -> DataFrame:
    """The first delivery of every ``traj_no`` by sorting whole rows."""
    first = Window.partitionBy("traj_no").orderBy("loaded_at")
    return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def delivered_once(rows: DataFrame, most: int = FEW) -> DataFrame:
    """The first delivery of every ``traj_no``; rows without one are left out.

    Only numbers and times are shuffled to find what was delivered repeatedly. Up to ``most`` such trajectories are
    broadcast with the time to keep; beyond, whole rows are sorted. Deliveries that cannot be told apart by their time
    alone are sorted, too.
    """
    rows = rows.filter("traj_no IS NOT NULL")
    at = rows.select("traj_no", "loaded_at").groupBy("traj_no").agg(F.count("*").alias("n"), F.count("loaded_at").alias("dated"), F.min("loaded_at").alias("_first"), F.max("loaded_at").alias("last"))
    # A missing time comes before all others.
    undated = F.col("n") - F.col("dated")
    tied = (undated > 1) | (F.col("n") > 2) | ((undated == 0) & (F.col("_first") == F.col("last")))
    first = F.when(undated == 0, F.col("_first"))
    repeated = stash(at.filter("n > 1").select("traj_no", first.alias("_first"), tied.alias("_tied")), "repeated")
    known = repeated.agg(F.count("*").alias("n"), F.count(F.when(F.col("_tied"), 1)).alias("tied")).first()
    if known["n"] > most:
        return first_of(rows)
    if not known["n"]:
        return rows
    marked = rows.join(F.broadcast(repeated), "traj_no", "left")
    once = marked.filter(F.col("_tied").isNull() | (~F.col("_tied") & F.col("loaded_at").eqNullSafe(F.col("_first")))).drop("_first", "_tied")
    if not known["tied"]:
        return once
    return once.unionByName(first_of(marked.filter("_tied").drop("_first", "_tied")))


def load_trajectories(spark: SparkSession, folder: str) -> DataFrame:
    """``traj_no, split, blocks (step, type, text), leaky`` of every trajectory; ``metadata`` is not read.

    ``split`` is the canonical name or null.
    """
    return shaped(delivered_once(table(spark, folder, "trajectories")))


def shaped(rows: DataFrame) -> DataFrame:
    """The columns of ``load_trajectories`` from rows of the table, or of a dump, where ``leakage_flags`` is a variant."""
    text = isinstance(rows.schema["leakage_flags"].dataType, T.StringType)
    flags = F.try_parse_json("leakage_flags") if text else F.col("leakage_flags")
    return rows.select(
        "traj_no",
        split_name(F.col("split")).alias("split"),
        F.arrays_zip(F.col("blocks.step").alias("step"), F.col("blocks.type").alias("type"), F.col("blocks.text").alias("text")).alias("blocks"),
        leaky_steps(flags).alias("leaky"),
    )
