"""Whole-document JSON, text files, vocabulary and metrics sinks, and logs read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A line of progress: step and named values.
LOG_STEP = r"\[step\s+(\d+)/(\d+)\]"


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """One row: the JSON document as a map of its top-level keys to their text."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("document"))


def read_texts(spark: SparkSession, glob: str) -> DataFrame:
    """``path`` and ``text`` of every file, whole."""
    return spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def matching_keys(document: Column, words: list[str] = ["mask", "token_id"]) -> Column:
    """The entries of a map whose key holds one of ``words``, whatever its case."""
    return F.map_filter(document, lambda k, v: F.lower(k).rlike("|".join(words)))


def class_names(texts: DataFrame, pattern: str = r"class (\w+)") -> DataFrame:
    """Distinct first groups of ``pattern`` in all files, sorted."""
    found = texts.select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("name"))
    return found.distinct().orderBy("name")


def vocabulary_json(vocabulary: DataFrame) -> DataFrame:
    """One row ``json``: ``{"stoi": {token: id, ...}}`` in order of ids. The vocabulary is bounded by ``max_vocab``."""
    entries = F.array_sort(F.collect_list(F.struct("id", "token")))
    pairs = F.transform(entries, lambda e: F.struct(e["token"], e["id"]))
    return vocabulary.agg(F.to_json(F.struct(F.map_from_entries(pairs).alias("stoi"))).alias("json"))


def write_vocabulary(vocabulary: DataFrame, path: str) -> None:
    vocabulary_json(vocabulary).coalesce(1).write.mode("overwrite").text(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    document = spark.read.text(path, wholetext=True).select(F.from_json("value", "stoi map<string,int>").alias("d"))
    return document.select(F.explode("d.stoi").alias("token", "id"))


def write_metrics(metrics: DataFrame, path: str) -> None:
    """The single row of ``metrics`` as an indented JSON document."""
    metrics.select(F.to_json(F.struct(*metrics.columns), {"pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def progress_lines(history: DataFrame, steps: int) -> DataFrame:
    """One line of progress per validated step."""
    text = F.format_string(f"[step %4d/{steps}] train=%.3f val=%.3f", "step", "loss", "val_loss")
    return history.filter("val_loss IS NOT NULL").select("step", text.alias("line"))


def read_progress(spark: SparkSession, glob: str) -> DataFrame:
    """``path, step, steps, loss, val_loss, mask_rate, val_nextobs`` of the lines of progress in logs; other lines are skipped."""
    lines = spark.read.text(glob).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line")).filter(F.col("line").rlike(LOG_STEP))

    def value(name: str) -> Column:
        return F.nullif(F.regexp_extract("line", rf"\b{name}=(nan|[-+0-9.eE]+)", 1), F.lit("")).cast("double")

    return lines.select(
        "path",
        F.regexp_extract("line", LOG_STEP, 1).cast("int").alias("step"),
        F.regexp_extract("line", LOG_STEP, 2).cast("int").alias("steps"),
        value("train").alias("loss"),
        value("val").alias("val_loss"),
        value("rate").alias("mask_rate"),
        value("nextobs").alias("val_nextobs"),
    )
