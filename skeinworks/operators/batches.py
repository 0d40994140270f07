"""Corruption of masked examples, padding, and batches.

``tok`` must have ``id``. Columns that come out are arrays of equal length per
example: ``inp``, ``labels``, ``btypes``, ``valid``, ``scored``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.functions.draws import let, uniform
from skeinworks.schema import MASK_ID, PAD, PAD_ID


def _laid_out(rows: DataFrame, mask_id: int, columns: list[str]) -> DataFrame:
    """``inp`` from ``scored`` and the masks: the mask id on what is scored or hidden."""
    hidden = F.zip_with("ctx", "tgt", lambda c, t: ~c & ~t)
    covered = F.zip_with("scored", hidden, lambda s, h: s | h)
    inp = F.zip_with("tok", covered, lambda t, b: F.when(b, F.lit(mask_id)).otherwise(t["id"]))
    return rows.select(
        *columns,
        inp.alias("inp"),
        F.transform("tok", lambda t: t["id"]).alias("labels"),
        F.transform("tok", lambda t: t["btype"]).alias("btypes"),
        F.transform("tok", lambda t: F.lit(True)).alias("valid"),
        "scored",
    )


def corrupted_v1(rows: DataFrame, t: Column, seed: int = 0, mask_id: int = MASK_ID, salt: Column | None = None) -> DataFrame:
    """Each target is scored with probability ``t``, at least one (that with the least draw); the others stay visible."""
    keys = [salt] if salt is not None else []
    draw = lambda p: uniform(seed, "corrupt", F.col("traj_no"), *keys, p)
    drawn = F.filter(F.zip_with("tok", "tgt", lambda x, b: F.when(b, F.struct(draw(x["pos"]).alias("u"), x["pos"].alias("pos")))), lambda s: s.isNotNull())
    hit = lambda x, b, s: b & ((draw(x["pos"]) < s["t"]) | ((s["least"]["u"] >= s["t"]) & (x["pos"] == s["least"]["pos"])))
    scored = let(F.struct(t.alias("t"), F.array_min(drawn).alias("least")), lambda s: F.zip_with("tok", "tgt", lambda x, b: F.coalesce(hit(x, b, s), F.lit(False))))
    return _laid_out(rows.withColumn("scored", scored), mask_id, rows.columns)


def corrupted_v2(rows: DataFrame, mask_id: int = MASK_ID) -> DataFrame:
    """Every target is scored."""
    columns = rows.columns
    return _laid_out(rows.withColumn("scored", F.col("tgt")), mask_id, columns)


def padded(rows: DataFrame, width: Column, pad_id: int = PAD_ID) -> DataFrame:
    """All arrays at ``width`` entries."""
    fill = {"inp": F.lit(pad_id), "labels": F.lit(pad_id), "btypes": F.lit(PAD), "valid": F.lit(False), "scored": F.lit(False)}
    rows = rows.withColumn("_w", width)
    grown = {c: F.slice(F.concat(c, F.array_repeat(v, (F.col("_w") - F.size(c)).cast("int"))), F.lit(1), F.col("_w")) for c, v in fill.items()}
    return rows.withColumns(grown).drop("_w")


def padded_to_longest(rows: DataFrame, max_len: int, by: str = "train_step", pad_id: int = PAD_ID) -> DataFrame:
    """Arrays at the length of the longest example of their step, ``max_len`` at most."""
    longest = F.max(F.size("inp")).over(Window.partitionBy(by))
    return padded(rows.withColumn("pad_to", F.least(longest, F.lit(max_len))), F.col("pad_to"), pad_id)


def preview(rows: DataFrame, length: int = 60) -> DataFrame:
    """The first ``length`` tokens, what is scored shown as a mask."""
    shown = F.zip_with("tok", "scored", lambda t, s: F.when(s, F.lit("[MASK]")).otherwise(t["token"]))
    return rows.select("traj_no", F.array_join(F.slice(shown, 1, length), " ").alias("preview"))
