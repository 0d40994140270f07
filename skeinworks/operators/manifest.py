"""Totals of a data set, and its manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinworks.functions.words import word_tokens


def split_totals(trajectories: DataFrame) -> DataFrame:
    """Per split: trajectories and word tokens of all their blocks."""
    tokens = F.aggregate(F.coalesce(F.transform("blocks", lambda b: F.coalesce(F.size(word_tokens(b["text"])), F.lit(0))), F.array().cast("array<int>")), F.lit(0).cast("long"), lambda a, n: a + F.greatest(n, F.lit(0)))
    return trajectories.groupBy("split").agg(F.count("*").alias("trajectories"), F.sum(tokens).alias("tokens"))


def block_totals(trajectories: DataFrame) -> DataFrame:
    return trajectories.select(F.explode("blocks.type").alias("type")).groupBy("type").agg(F.count("*").alias("blocks"))


def flag_totals(flags: DataFrame, column: str = "leakage_flags") -> DataFrame:
    """Per type of flag their number (null for flags that are no objects or have none); ``column`` is JSON text."""
    items = F.try_variant_get(F.try_parse_json(column), "$", "array<variant>")
    kinds = flags.select(F.explode(items).alias("f")).select(F.try_variant_get("f", "$.type", "string").alias("type"))
    return kinds.groupBy("type").agg(F.count("*").alias("flags"))


def flagged_totals(flags: DataFrame, column: str = "leakage_flags") -> DataFrame:
    """One row: records with flags, and all flags."""
    n = F.size(F.coalesce(F.try_variant_get(F.try_parse_json(column), "$", "array<variant>"), F.array().cast("array<variant>")))
    return flags.agg(F.count(F.when(n > 0, 1)).alias("records_flagged"), F.coalesce(F.sum(n), F.lit(0)).alias("total_flags"))


def manifest(trajectories: DataFrame, flags: DataFrame) -> DataFrame:
    """One row of maps and structs: blocks by type, flags, tokens and trajectories by split; a missing name is ``unknown``."""

    def entries(df: DataFrame, key: str, *values: str) -> DataFrame:
        pair = lambda v: F.struct(F.coalesce(key, F.lit("unknown")).alias("k"), F.col(v).alias("v"))
        return df.agg(*[F.map_from_entries(F.array_sort(F.collect_list(pair(v)))).alias(v) for v in values])

    # Each part is a single row, taken in as a scalar subquery.
    splits = entries(split_totals(trajectories), "split", "tokens", "trajectories")
    audit = F.struct(
        entries(flag_totals(flags), "type", "flags").scalar().alias("flags_by_type"),
        flagged_totals(flags).select("records_flagged").scalar().alias("records_flagged"),
        flagged_totals(flags).select("total_flags").scalar().alias("total_flags"),
    )
    return entries(block_totals(trajectories), "type", "blocks").select(
        F.col("blocks").alias("block_type_counts"),
        audit.alias("leakage_audit"),
        splits.select("tokens").scalar().alias("token_counts"),
        splits.select("trajectories").scalar().alias("trajectory_counts"),
    )
