"""Queries over the operators for training corpora, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinworks.llm import bpe, mixing, overlap, packing, runs, splits, terms, token_budget, truncation
from skeinworks.llm.sql import ORACLES
from skeinworks.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return splits.divided_episodes(table(spark, folder, "trajectories"))


def p1_splits(spark: SparkSession, folder: str) -> DataFrame:
    rows, _ = splits.assign_splits(table(spark, folder, "trajectories"), table(spark, folder, "split_targets"))
    return rows.select("traj_no", "component", "split", "status")


def p1_together(spark: SparkSession, folder: str) -> DataFrame:
    """Trajectories, their episodes, and how many of these the assigned splits divide."""
    rows = p1_splits(spark, folder).groupBy("component").agg(F.count("*").alias("n"), F.count_distinct("split").alias("splits"))
    return rows.agg(F.sum("n").alias("trajectories"), F.count("*").alias("episodes"), F.count(F.when(F.col("splits") > 1, 1)).alias("divided"))


def p1_readings(spark: SparkSession, folder: str) -> DataFrame:
    return splits.readings(table(spark, folder, "trajectories"))


def in_two_loads(rows: DataFrame) -> list[DataFrame]:
    """What arrived in the first half of the time, and the rest."""
    seconds = F.unix_timestamp(F.col("loaded_at").cast("timestamp"))
    half = rows.agg(((F.min(seconds) + F.max(seconds)) / 2).alias("half")).first()["half"] or 0
    early = F.coalesce(seconds <= half, F.lit(True))
    return [rows.filter(early), rows.filter(~early)]


def p1_incremental(spark: SparkSession, folder: str) -> DataFrame:
    return splits.load_by_load(in_two_loads(table(spark, folder, "trajectories")), table(spark, folder, "split_targets"))


def p3_token_budget(spark: SparkSession, folder: str) -> DataFrame:
    return token_budget.token_budget(table(spark, folder, "trajectories"), table(spark, folder, "documents"))


def p3_record_tokens(spark: SparkSession, folder: str) -> DataFrame:
    one = token_budget.trajectory_counts(table(spark, folder, "trajectories"))
    total = F.aggregate(F.coalesce("counts", F.array().cast("array<long>")), F.lit(0).cast("long"), lambda a, b: a + b)
    one = one.select(F.lit("trajectories").alias("part"), F.col("traj_no").alias("record"), total.alias("tokens"))
    two = token_budget.document_counts(table(spark, folder, "documents")).select(F.lit("documents").alias("part"), F.col("doc_id").alias("record"), "tokens")
    return one.unionByName(two)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_terms(spark, folder).filter("mark IS NOT NULL").select("term", "mark")


def p4_terms(spark: SparkSession, folder: str) -> DataFrame:
    return terms.marked_terms(table(spark, folder, "trajectories"), table(spark, folder, "vocab"))


def p4_merged(spark: SparkSession, folder: str) -> DataFrame:
    """The same terms from two loads, what arrived in the first half of the time and the rest, merged."""
    loads = in_two_loads(table(spark, folder, "trajectories"))
    return terms.marked(terms.merged_loads(loads), table(spark, folder, "vocab"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_runs(spark, folder).filter("events > 1").select("trajectory_id", "first_seq", "last_seq")


def p5_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.event_runs(table(spark, folder, "block_log"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = overlap.overlapping_pairs(table(spark, folder, "trajectories"))
    return pairs.select(F.least("train_no", "eval_no").alias("traj_no_a"), F.greatest("train_no", "eval_no").alias("traj_no_b")).distinct()


def p6_classes(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.class_of_each(table(spark, folder, "trajectories"))


def p6_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.overlaps_by_slice(table(spark, folder, "trajectories"))


def p7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(packing.trajectory_sizes(table(spark, folder, "trajectories")), table(spark, folder, "pack_sizes"))


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(p7_packing(spark, folder))


def p7_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Per capacity what must come out whatever the packing: trajectories, tokens, pieces, divided trajectories, sequences above the capacity."""
    placed = p7_packing(spark, folder)
    over = placed.groupBy("pack_name", "seq_no").agg((F.sum("tokens") > F.first("max_len")).alias("over")).groupBy("pack_name").agg(F.count(F.when(F.col("over"), 1)).alias("above_capacity"))
    each = placed.groupBy("pack_name", "traj_no").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"))
    sums = each.groupBy("pack_name").agg(F.count("*").alias("trajectories"), F.sum("tokens").alias("tokens"), F.sum("pieces").alias("pieces"), F.count(F.when(F.col("pieces") > 1, 1)).alias("divided"))
    return sums.join(over, "pack_name")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, folder, "documents"))


def p9_selection(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncated(table(spark, folder, "documents")).select("doc_id")


def p10_by_source(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncation_by_source(table(spark, folder, "documents"))


QUERIES: list[Callable[[SparkSession, str], DataFrame]] = [
    p1_found, p1_splits, p1_together, p1_readings, p1_incremental, p3_token_budget, p3_record_tokens, p4_found, p4_terms, p4_merged, p5_found, p5_runs, p6_found, p6_classes, p6_overlaps,
    p7_packing, p7_fill, p7_kept, p8_ids, p9_selection, p9_shares, p10_found, p10_by_source,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
