"""Trajectories as they arrive: the row-local operators over a stream of JSONL files.

Blocks, examples and masks need no state, so the batch operators run on a
stream as they are. Deliveries of the same trajectory within the watermark
count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinworks.functions.words import split_name
from skeinworks.operators.examples import all_examples
from skeinworks.operators.masks import with_mask_v2
from skeinworks.schema import CODE_NAMES, TRAJECTORY
from skeinworks.sources.trajectories import leaky_steps

ARRIVING = T.StructType([T.StructField("traj_no", T.LongType()), T.StructField("loaded_at", T.TimestampType()), *TRAJECTORY.fields])


def arriving(spark: SparkSession, folder: str, delay: str = "7 days", files_per_batch: int = 100) -> DataFrame:
    """``traj_no, split, blocks, leaky`` of every trajectory of the JSONL files that appear in ``folder``, each once within ``delay``."""
    lines = spark.readStream.schema(ARRIVING).option("mode", "FAILFAST").option("maxFilesPerTrigger", files_per_batch).json(folder)
    once = lines.filter("traj_no IS NOT NULL").withWatermark("loaded_at", delay).dropDuplicatesWithinWatermark(["traj_no"])
    blocks = F.arrays_zip(F.col("blocks.step").alias("step"), F.col("blocks.type").alias("type"), F.col("blocks.text").alias("text"))
    return once.select("traj_no", "loaded_at", split_name(F.col("split")).alias("split"), blocks.alias("blocks"), leaky_steps(F.col("leakage_flags")).alias("leaky"))


def arriving_examples(rows: DataFrame) -> DataFrame:
    return all_examples(rows)


def running_budget(examples: DataFrame, objective: str, rate: Column, seed: int = 0) -> DataFrame:
    """Scored tokens by type of block under ``objective``, over all that has arrived."""
    masked = with_mask_v2(examples.filter("n > 0"), objective, rate, seed).filter("tgt IS NOT NULL")
    pairs = F.zip_with("tok", "tgt", lambda t, b: F.struct(t["btype"].alias("btype"), b.alias("scored")))

    def scored(code: int) -> Column:
        return F.size(F.filter(pairs, lambda x: x["scored"] & (x["btype"] == code))).cast("long")

    per = masked.select("split", *[scored(code).alias(name) for code, name in CODE_NAMES.items()])
    return per.groupBy("split").agg(F.count("*").alias("trajectories"), *[F.sum(name).alias(name) for name in CODE_NAMES.values()])
