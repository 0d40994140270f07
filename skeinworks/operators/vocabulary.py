"""Token frequencies, vocabularies ranked by them, and encoding."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinworks.functions.words import word_tokens
from skeinworks.schema import N_SPECIAL, UNK_ID

#: Tokens of a vocabulary that is sent to every worker, at most.
MOST = 1_000_000


def corpus_tokens(trajectories: DataFrame) -> DataFrame:
    """``traj_no, block_no, pos, token`` of all blocks, before any filter."""
    blocks = trajectories.select("traj_no", F.posexplode("blocks").alias("block_no", "b")).filter("b.text IS NOT NULL")
    return blocks.select("traj_no", "block_no", F.posexplode(word_tokens(F.col("b.text"))).alias("pos", "token"))


def token_frequency(tokens: DataFrame) -> DataFrame:
    """``token, n`` and where it occurs first."""
    return tokens.groupBy("token").agg(F.count("*").alias("n"), F.min(F.struct("traj_no", "block_no", "pos")).alias("first"))


def ranked_vocabulary(tokens: DataFrame, max_vocab: int = 16000) -> DataFrame:
    """``token, id``: the most frequent tokens, of equally frequent ones those that occur first; ids from ``N_SPECIAL`` on.

    The sort takes the top ``max_vocab`` per partition and merges them; ids are numbered over that bounded rest.
    """
    top = token_frequency(tokens).orderBy(F.desc("n"), "first").limit(max_vocab - N_SPECIAL)
    listed = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first", "token"))).alias("v"))
    return listed.select(F.posexplode("v").alias("i", "e")).select(F.col("e.token").alias("token"), (F.col("i") + N_SPECIAL).alias("id"))


def with_ids(examples: DataFrame, vocabulary: DataFrame, unk_id: int = UNK_ID, most: int = MOST) -> DataFrame:
    """Adds ``id`` to the tokens of every example; tokens that the vocabulary lacks have ``unk_id``.

    A vocabulary of up to ``most`` tokens is sent to every worker, which looks up the tokens of whole batches; nothing
    is shuffled. A larger one is joined. Of a token that is listed twice the least id holds, null tokens are none.
    """
    listed = vocabulary.filter("token IS NOT NULL").groupBy("token").agg(F.min("id").alias("id"))
    entries = listed.limit(most + 1).collect()
    if len(entries) > most:
        return joined_ids(examples, listed, unk_id)
    words, ids = [r["token"] for r in entries], [r["id"] for r in entries]
    token = examples.schema["tok"].dataType.elementType
    fields = [f for f in token.fields if f.name != "id"] + [T.StructField("id", T.IntegerType())]
    schema = T.StructType([T.StructField("tok", T.ArrayType(T.StructType(fields))) if f.name == "tok" else f for f in examples.schema.fields])

    def look_up(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        known, codes = pa.array(words, pa.string()), pa.array(ids, pa.int32())
        for batch in batches:
            at = batch.schema.get_field_index("tok")
            lists = batch.column(at)
            items = lists.flatten()
            parts = {f.name: items.field(f.name) for f in token.fields}
            parts["id"] = pc.fill_null(codes.take(pc.index_in(parts["token"].cast(pa.string()), known)), pa.scalar(unk_id, pa.int32()))
            lengths = pc.fill_null(pc.list_value_length(lists), 0)
            offsets = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(lengths).cast(pa.int32())])
            inner = pa.StructArray.from_arrays([parts[f.name] for f in fields], names=[f.name for f in fields])
            coded = pa.ListArray.from_arrays(offsets, inner, mask=lists.is_null())
            columns = [coded if k == at else batch.column(k) for k in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return examples.mapInArrow(look_up, schema)


def joined_ids(examples: DataFrame, listed: DataFrame, unk_id: int) -> DataFrame:
    """``with_ids`` by a join of the tokens; ``listed`` has each token once."""
    rest = [c for c in examples.columns if c not in ("traj_no", "tok")]
    fields = [f"t.{f.name}" for f in examples.schema["tok"].dataType.elementType.fields if f.name != "id"]
    flat = examples.withColumn("_row", F.monotonically_increasing_id()).select("_row", "traj_no", *rest, F.explode_outer("tok").alias("t"))
    coded = flat.join(listed, flat["t.token"] == listed["token"], "left")
    tok = F.struct(*fields, F.coalesce("id", F.lit(unk_id)).cast("int").alias("id"))
    rows = coded.groupBy("_row").agg(*[F.first(c).alias(c) for c in ["traj_no", *rest]], F.array_sort(F.collect_list(F.when(F.col("t").isNotNull(), tok))).alias("tok"))
    return rows.select(*examples.columns)
