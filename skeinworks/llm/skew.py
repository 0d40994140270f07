"""Joins that a hot key cannot slow down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than 1 / HOT of the rows is hot: there are fewer than HOT of them, however large the data.
HOT = 64


def join_unique(rows: DataFrame, keyed: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` joined with ``keyed``, which has each ``key`` once and in ``count`` its number of rows.

    Rows of hot keys meet a broadcast of at most ``HOT`` rows where they are; only the others are shuffled.
    Null keys match nothing.
    """
    total = keyed.agg(F.sum(count)).scalar()
    hot = keyed.filter(F.col(count) * HOT > total)
    marked = rows.join(F.broadcast(hot.select(key, F.lit(True).alias("_hot"))), key, "left")
    here = marked.filter("_hot").drop("_hot").join(F.broadcast(hot), key)
    there = marked.filter("_hot IS NULL").drop("_hot").join(keyed, key)
    return here.unionByName(there)
