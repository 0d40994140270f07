"""Components and skew-safe joins, edges included."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinworks.llm.components import connected_components
from skeinworks.llm.skew import join_unique


def test_components_of_a_long_path_and_a_star(spark):
    path = [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(60)]
    star = [("s000", f"s{i:03d}") for i in range(1, 40)]
    odd = [("x", "x"), (None, "p000"), ("s005", "s001")]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(path + star + odd, "a string, b string")).collect()}
    assert {got[f"p{i:03d}"] for i in range(61)} == {"p000"} and {got[f"s{i:03d}"] for i in range(40)} == {"s000"}
    assert "x" not in got and len(got) == 101
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_skew_safe_join(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 700, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 200)).alias("key"), "id")
    rows = rows.unionByName(spark.createDataFrame([(None, -1)], "key string, id long"))
    keyed = rows.groupBy("key").agg(F.count("*").alias("n")).filter("key IS NOT NULL").withColumn("v", F.length("key"))
    out = join_unique(rows, keyed, "key", "n")
    assert out.count() == 1000 and out.select("id").distinct().count() == 1000
