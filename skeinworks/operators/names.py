"""Names of the parts of a model: lists, leaves, selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space, Unicode's too, at either end.
AROUND = r"^[\s\p{Z}\x{0B}\x{85}\x{1c}-\x{1f}]++|[\s\p{Z}\x{0B}\x{85}\x{1c}-\x{1f}]+$"


def parsed_list(text: Column) -> Column:
    """The entries of a comma-separated list, without white space around them and empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda s: F.regexp_replace(s, AROUND, "")), lambda s: s != "")


def leaf_names(names: DataFrame, column: str, keep: list[str], leave: list[str]) -> DataFrame:
    """``leaf``, sorted: the distinct last segments of dotted names that hold a word of ``keep``.

    Where none does, those that hold no word of ``leave``.
    """
    leaf = F.element_at(F.split(column, r"\."), -1)
    leaves = names.filter(F.col(column).isNotNull()).select(leaf.alias("leaf")).distinct()
    holds = lambda words: F.lower("leaf").rlike("|".join(words)) if words else F.lit(False)
    some = leaves.agg(F.coalesce(F.bool_or(holds(keep)), F.lit(False))).scalar()
    return leaves.filter(F.when(some, holds(keep)).otherwise(~holds(leave))).orderBy("leaf")
