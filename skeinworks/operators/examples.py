"""From blocks to aligned per-token arrays.

An example has ``tok``: per token its ``pos``, ``token``, ``btype`` (code of the
block's type), ``step`` (-1 where missing) and ``bidx`` (number of its block
among those that gave tokens). Everything is local to a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinworks.functions.draws import computed
from skeinworks.functions.words import word_tokens
from skeinworks.schema import BLOCK_CODES, THINK
from skeinworks.sources.trajectories import step_key


def type_code(name: Column) -> Column:
    """The code of a block type; null where it is not known."""
    code = F.lit(None).cast("int")
    for known, c in BLOCK_CODES.items():
        code = F.when(name == known, F.lit(c)).otherwise(code)
    return code


def is_leaky(block: Column, leaky: Column) -> Column:
    """Whether the block is a thought of a step that a flag names."""
    return (type_code(block["type"]) == THINK) & F.array_contains(leaky, step_key(block["step"]))


Tokenizer = Callable[[Column], Column]


def byte_tokens(text: Column) -> Column:
    """A tokenizer without a vocabulary: the bytes of the text in UTF-8, two hexadecimal digits each; null stays null."""
    return F.filter(F.split(F.hex(F.encode(text, "utf-8")), "(?<=\\G..)"), lambda b: b != "")


def kept_blocks(drop_leaky_think: bool = True, tokenizer: Tokenizer = word_tokens) -> Column:
    """Blocks of a known type with tokens, thoughts at leaked steps left out."""
    known = F.filter("blocks", lambda b: type_code(b["type"]).isNotNull())
    if drop_leaky_think:
        known = F.filter(known, lambda b: ~is_leaky(b, F.col("leaky")))
    coded = F.transform(known, lambda b: F.struct(type_code(b["type"]).alias("btype"), F.coalesce(b["step"], F.lit(-1)).alias("step"), tokenizer(b["text"]).alias("tokens")))
    return F.filter(coded, lambda b: F.size(b["tokens"]) > 0)


def flattened(blocks: Column) -> Column:
    """The tokens of kept blocks; the number of a block counts only those that are there."""
    of_block = lambda b, i: F.transform(b["tokens"], lambda t: F.struct(t.alias("token"), b["btype"].alias("btype"), b["step"].alias("step"), i.alias("bidx")))
    flat = F.flatten(F.transform(blocks, of_block))
    return F.transform(flat, lambda t, p: F.struct(p.alias("pos"), t["token"].alias("token"), t["btype"].alias("btype"), t["step"].alias("step"), t["bidx"].alias("bidx")))


def all_examples(trajectories: DataFrame, drop_leaky_think: bool = True, tokenizer: Tokenizer = word_tokens) -> DataFrame:
    """``traj_no, split, tok, n`` of every trajectory, those without tokens included (``n`` = 0).

    ``tokenizer`` gives the tokens of a text column as an array of strings: words, bytes, or pieces of an external
    tokenizer (a pandas function).
    """
    rows = trajectories.select("traj_no", "split", computed(F.coalesce(flattened(kept_blocks(drop_leaky_think, tokenizer)), F.array()), "tok"))
    return rows.withColumn("n", F.size("tok"))


def lengths(trajectories: DataFrame, drop_leaky_think: bool = True, tokenizer: Tokenizer = word_tokens) -> DataFrame:
    """``traj_no, split, n`` of every example, without its tokens."""
    n = F.aggregate(kept_blocks(drop_leaky_think, tokenizer), F.lit(0), lambda a, b: a + F.size(b["tokens"]))
    return trajectories.select("traj_no", "split", computed(F.coalesce(n, F.lit(0)), "n"))


def truncated(examples: DataFrame, max_len: int) -> DataFrame:
    """The first ``max_len`` tokens of every example that has any; may cut within a block."""
    rows = examples.filter("n > 0").withColumn("tok", F.slice("tok", 1, max_len))
    return rows.withColumn("n", F.least("n", F.lit(max_len)))


def not_overlong(examples: DataFrame, max_len: int) -> DataFrame:
    """Examples of 1 to ``max_len`` tokens."""
    return examples.filter((F.col("n") > 0) & (F.col("n") <= max_len))


def dropped(examples: DataFrame, max_len: int) -> DataFrame:
    """Per split: how many ``not_overlong`` keeps, and how many it drops (empty ones count as dropped)."""
    kept = (F.col("n") > 0) & (F.col("n") <= max_len)
    return examples.groupBy("split").agg(F.count(F.when(kept, 1)).alias("kept"), F.count(F.when(~kept, 1)).alias("dropped"))


def token_rows(examples: DataFrame, *keep: str) -> DataFrame:
    """One row per token."""
    return examples.select("traj_no", *keep, F.inline("tok"))
