"""Exact token counts per record, and their totals over cubes of slices.

The tokenizer is read once per Python worker and encodes whole Arrow batches;
counts are kept per record, and only cells (slice, count) are shuffled: cubes
are built from the sums of the finest cells, never from records.

Slices have one spelling; a missing one is ``unknown``. Null and blank texts
have the tokens they have (none, or those of the blanks). A ``traj_no`` counts
once, by its first delivery; rows without a ``traj_no`` cannot be told apart
and count each. Cells of the cube that take all values of a slice hold
``(all)`` there.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinworks.functions.words import language, slice_name
from skeinworks.llm.bpe import PRETOKEN

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"

_LOADED: dict[str, object] = {}


def counter(path: str):
    """``encode_ordinary`` of the vocabulary at ``path``, read once per worker."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("corpus", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return _LOADED[path]


def with_counts(rows: DataFrame, text: str, to: str, ranks: str = RANKS) -> DataFrame:
    """``rows`` with column ``text`` (a string or an array of strings) replaced by ``to``, its tokens (a long or an array of longs)."""
    from pyspark.sql import types as T

    nested = isinstance(rows.schema[text].dataType, T.ArrayType)
    keep = [c for c in rows.columns if c != text]
    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField(to, T.ArrayType(T.LongType()) if nested else T.LongType())])

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode = counter(ranks)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            column = batch.column(at)
            texts = column.flatten() if nested else column
            # One call per text: the tokenizer's own batches hand each text to a thread, which takes four times as long.
            n = pa.array([len(encode(t)) if t else 0 for t in texts.to_pylist()], pa.int64())
            if nested:
                lengths = column.value_lengths().fill_null(0)
                offsets = pa.array([0, *lengths.to_numpy(zero_copy_only=False).cumsum().tolist()], pa.int32())
                n = pa.ListArray.from_arrays(offsets, n)
            yield pa.record_batch([batch.column(batch.schema.get_field_index(c)) for c in keep] + [n], names=[*keep, to])

    return rows.mapInArrow(count, schema)


def named(value: Column) -> Column:
    return F.coalesce(value, F.lit("unknown"))


def trajectory_counts(trajectories: DataFrame, ranks: str = RANKS) -> DataFrame:
    """``traj_no``, ``env``, ``types`` and ``counts`` (aligned arrays, one entry per block), each ``traj_no`` once.

    Counting comes before the removal of second deliveries, so that the texts are never shuffled.
    """
    rows = trajectories.select(
        "traj_no",
        "loaded_at",
        named(slice_name(F.col("env"))).alias("env"),
        F.transform("blocks.type", lambda t: named(slice_name(t))).alias("types"),
        F.col("blocks.text").alias("texts"),
    )
    known = with_counts(rows.filter("traj_no IS NOT NULL"), "texts", "counts", ranks).groupBy("traj_no").agg(F.min_by(F.struct("env", "types", "counts"), "loaded_at").alias("r"), F.first(F.struct("env", "types", "counts")).alias("any"))
    known = known.select("traj_no", F.coalesce("r", "any").alias("r")).select("traj_no", "r.*")
    unknown = with_counts(rows.filter("traj_no IS NULL"), "texts", "counts", ranks)
    return known.unionByName(unknown.select("traj_no", "env", "types", "counts"))


def document_counts(documents: DataFrame, ranks: str = RANKS) -> DataFrame:
    """``doc_id``, ``source``, ``lang``, ``env`` and ``tokens`` of every row."""
    rows = documents.select(
        "doc_id",
        named(F.lower(F.trim("source"))).alias("source"),
        named(language(F.col("lang"))).alias("lang"),
        named(slice_name(F.col("env"))).alias("env"),
        "text",
    )
    return with_counts(rows, "text", "tokens", ranks)


def cube_of(cells: DataFrame, slices: list[str]) -> DataFrame:
    """Totals of ``records`` and ``tokens`` over every combination of ``slices``, from the finest cells."""
    sums = cells.cube(*slices).agg(F.sum("records").alias("records"), F.sum("tokens").alias("tokens"), *[F.grouping(s).alias(f"g_{s}") for s in slices])
    labels = [F.when(F.col(f"g_{s}") == 1, F.lit("(all)")).otherwise(F.col(s)).alias(s) for s in slices]
    return sums.select(*labels, "records", "tokens")


def token_budget(trajectories: DataFrame, documents: DataFrame, ranks: str = RANKS) -> DataFrame:
    """Totals over the cubes env x block type and source x language x env.

    ``records`` counts blocks in the first cube and documents in the second; a slice that a table does not have is null.
    """
    by_type = (
        trajectory_counts(trajectories, ranks)
        .select("env", F.explode(F.arrays_zip("types", "counts")).alias("b"))
        .groupBy("env", F.col("b.types").alias("block_type"))
        .agg(F.count("*").alias("records"), F.sum("b.counts").alias("tokens"))
    )
    by_source = document_counts(documents, ranks).groupBy("source", "lang", "env").agg(F.count("*").alias("records"), F.sum("tokens").alias("tokens"))
    first = cube_of(by_type, ["env", "block_type"]).withColumn("part", F.lit("trajectories"))
    second = cube_of(by_source, ["source", "lang", "env"]).withColumn("part", F.lit("documents"))
    order = ["part", "source", "lang", "env", "block_type", "records", "tokens"]
    return first.unionByName(second, allowMissingColumns=True).select(*order)
