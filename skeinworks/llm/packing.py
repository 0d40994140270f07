"""Packing of trajectories into sequences of fixed capacity.

A trajectory is a vector: word tokens, one segment, loss-bearing tokens (those
of Think and Action blocks). Sequences are filled one after the other: the next
trajectory is the one whose vector has the largest dot product with what is
left in the sequence, among those that fit in every dimension; where one or two
trajectories fill the tokens that are left exactly, they go first. Limits are
the capacity in tokens, a segment for every ``SEGMENT_TOKENS`` of it (two at
least) and ``LOSS_SHARE`` of it in loss-bearing tokens; a trajectory or rest that
has more of these than that gets a sequence of its own. Only a
trajectory above the capacity is divided: into full sequences of its own, and a
rest that is packed like any other.

The work is divided by a hash of the trajectory into shards of about ``SHARD``
rows, each packed by itself: one open sequence per shard is all that this
costs. Sequence numbers are the shard's number times 2^32 plus a running
number; an order of capacities is not assumed.

A trajectory without tokens (null or empty blocks, blank texts) is a vector of
no tokens and takes one segment. Rows without ``traj_no`` are left out; of
several deliveries the first counts. Capacities that are null or below 1 are
left out, repeated names are packed each. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinworks.functions.words import WORD
from skeinworks.session import stash

SIZED, LOSS = ["Goal", "Think", "Action", "Observation"], ["Think", "Action"]
SHARD = 50_000
#: Tokens of capacity for each segment, and the share of it that may bear loss.
SEGMENT_TOKENS, LOSS_SHARE = 192, 0.65
PLACED = "pack_name string, max_len int, traj_no long, piece int, seq_no long, tokens long, loss_tokens long"


def count_words(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    find = WORD.findall
    for batch in batches:
        counts = []
        for k in (2, 3):
            column = batch.column(k)
            each = np.fromiter((len(find(t.lower())) if t else 0 for t in column.to_pylist()), np.int64, len(column))
            counts.append(pa.array(each))
        yield pa.record_batch([batch.column(0), batch.column(1), counts[0], counts[1]], names=["traj_no", "loaded_at", "other", "loss_tokens"])


def trajectory_sizes(trajectories: DataFrame) -> DataFrame:
    """``traj_no, tokens, loss_tokens``, each ``traj_no`` once; texts are counted where they are read, only numbers are shuffled."""

    def text(types: list[str]):
        blocks = F.arrays_zip(F.col("blocks.type").alias("type"), F.col("blocks.text").alias("text"))
        kept = F.filter(blocks, lambda b: b["type"].isin(types) & b["text"].isNotNull())
        return F.array_join(F.transform(kept, lambda b: b["text"]), "\n")

    rows = trajectories.filter("traj_no IS NOT NULL").select("traj_no", "loaded_at", text([t for t in SIZED if t not in LOSS]).alias("other"), text(LOSS).alias("loss_tokens"))
    kind = trajectories.schema["loaded_at"].dataType
    schema = T.StructType([T.StructField("traj_no", T.LongType()), T.StructField("loaded_at", kind), T.StructField("other", T.LongType()), T.StructField("loss_tokens", T.LongType())])
    counted = rows.mapInArrow(count_words, schema)
    one = F.min(F.struct("loaded_at", (F.col("other") + F.col("loss_tokens")).alias("tokens"), "loss_tokens")).alias("r")
    return counted.groupBy("traj_no").agg(one).select("traj_no", "r.tokens", "r.loss_tokens")


class Shelf:
    """Items by number of tokens, those of a number in order of their loss-bearing tokens."""

    def __init__(self, capacity: int, tokens, loss):
        import numpy as np

        self.capacity = capacity
        self.items: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        for i in np.lexsort((np.arange(len(tokens)), loss, tokens)):
            self.items[tokens[i]].append((int(loss[i]), int(i)))
        self.top = np.array([x[-1][0] if x else -1 for x in self.items], np.float64)
        self.sizes = np.arange(capacity + 1, dtype=np.float64)
        self.left = len(tokens)

    def take(self, size: int, loss_room: float) -> tuple[int, int, int] | None:
        """The item of ``size`` with the most loss-bearing tokens that fits."""
        from bisect import bisect_right

        at = self.items[size]
        k = bisect_right(at, (loss_room, 1 << 62)) - 1
        if k < 0:
            return None
        loss, i = at.pop(k)
        self.top[size] = at[-1][0] if at else -1
        self.left -= 1
        return size, loss, i


def pack_shard(tokens, loss, capacity: int, max_segments: int, max_loss: float) -> list[int]:
    """The sequence of every item; no item is above the capacity."""
    import numpy as np

    shelf, out, seq = Shelf(capacity, tokens, loss), [0] * len(tokens), -1
    while shelf.left:
        seq += 1
        room, segments, loss_room = capacity, max_segments, max_loss
        got = []
        while shelf.left and segments > 0:
            there = shelf.top[: room + 1] >= 0
            if not there.any():
                break
            plan: list[int] = []
            if there[room]:
                plan = [room]
            elif segments > 1 and room > 1:
                half = room // 2
                pairs = np.flatnonzero(there[1 : half + 1] & there[room - 1 : room - half - 1 : -1]) + 1
                if len(pairs):
                    plan = [room - int(pairs[0]), int(pairs[0])]
            if not plan:
                # The dot product with what is left, over the best item of each size.
                best = shelf.top[: room + 1]
                score = np.where(there, shelf.sizes[: room + 1] * room / capacity**2 + segments / max_segments**2 + np.minimum(best, loss_room) * loss_room / max_loss**2, -1.0)
                plan = [int(np.argmax(score))]
            taken = None
            for size in plan:
                item = shelf.take(size, loss_room) if size <= room and segments > 0 else None
                if item is not None:
                    taken = item
                    got.append(item)
                    room, segments, loss_room = room - size, segments - 1, loss_room - item[1]
            if taken is None:
                # The limit on loss-bearing tokens binds: the largest size of which one fits.
                for size in np.flatnonzero(there)[::-1]:
                    taken = shelf.take(int(size), loss_room)
                    if taken:
                        got.append(taken)
                        room, segments, loss_room = room - taken[0], segments - 1, loss_room - taken[1]
                        break
                else:
                    break
        if not got:
            # Nothing fits an empty sequence but for its loss-bearing tokens: it gets one of its own.
            size = int(np.flatnonzero(shelf.top >= 0)[-1])
            got.append(shelf.take(size, float("inf")))
        for _, _, i in got:
            out[i] = seq
    return out


def segments_of(capacity: int, segment_tokens: int = SEGMENT_TOKENS) -> int:
    """How many segments a sequence may have."""
    return max(2, capacity // segment_tokens)


def pack(sizes: DataFrame, packs: DataFrame, segment_tokens: int = SEGMENT_TOKENS, max_loss_share: float = LOSS_SHARE, shard: int = SHARD) -> DataFrame:
    """Rows of ``PLACED``: one per trajectory and capacity, more only for a trajectory above the capacity.

    The full sequences of a trajectory above the capacity are not held to the limit on loss-bearing tokens: nothing can be moved.
    """
    # A row per capacity: a table that someone writes by hand, still checked.
    rows = packs.filter("max_len >= 1 AND pack_name IS NOT NULL").select("pack_name", F.col("max_len").cast("int")).limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1,000 capacities")
    sizes = stash(sizes.select("traj_no", "tokens", "loss_tokens"), "sizes")
    n = sizes.count() if rows else 0
    shards = max(1, -(-n // shard))
    each = F.array(*[F.struct(F.lit(k).alias("pack"), F.lit(r[0]).alias("pack_name"), F.lit(r[1]).alias("max_len")) for k, r in enumerate(rows)])
    items = sizes.select("traj_no", "tokens", "loss_tokens", F.pmod(F.xxhash64("traj_no"), F.lit(shards)).cast("long").alias("shard"))
    if not rows:
        return items.sparkSession.createDataFrame([], PLACED)
    items = items.select("*", F.explode(each).alias("p")).select("traj_no", "tokens", "loss_tokens", "shard", "p.*")

    def place(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by("traj_no")
        name, capacity, number = table.column("pack_name")[0].as_py(), table.column("max_len")[0].as_py(), table.column("shard")[0].as_py()
        ids, tokens, loss = (table.column(c).to_numpy() for c in ("traj_no", "tokens", "loss_tokens"))
        full = np.where(tokens > capacity, tokens // capacity, 0)
        rest = tokens - full * capacity
        rest_loss = np.where(full > 0, loss - full * capacity * loss // np.maximum(tokens, 1), loss)
        rest_loss = np.clip(rest_loss, 0, rest)
        packed = np.flatnonzero((full == 0) | (rest > 0))
        seq = np.array(pack_shard(rest[packed], rest_loss[packed], capacity, segments_of(capacity, segment_tokens), max_loss_share * capacity), np.int64)
        last = int(seq.max()) + 1 if len(seq) else 0
        whole = np.repeat(np.arange(len(ids)), full)
        first = np.cumsum(full) - full
        piece = np.arange(len(whole)) - np.repeat(first, full)
        whole_loss = (piece + 1) * capacity * loss[whole] // np.maximum(tokens[whole], 1) - piece * capacity * loss[whole] // np.maximum(tokens[whole], 1)
        rows = np.concatenate([packed, whole])
        return pa.table(
            {
                "pack_name": pa.array([name] * len(rows), pa.string()),
                "max_len": pa.array(np.full(len(rows), capacity), pa.int32()),
                "traj_no": pa.array(ids[rows], pa.int64()),
                "piece": pa.array(np.concatenate([full[packed], piece]), pa.int32()),
                "seq_no": pa.array((number << 32) + np.concatenate([seq, last + np.arange(len(whole))]), pa.int64()),
                "tokens": pa.array(np.concatenate([rest[packed], np.full(len(whole), capacity)]), pa.int64()),
                "loss_tokens": pa.array(np.concatenate([rest_loss[packed], whole_loss]), pa.int64()),
            }
        )

    return items.groupBy("pack", "shard").applyInArrow(place, PLACED)


def fill_report(placed: DataFrame, segment_tokens: int = SEGMENT_TOKENS, max_loss_share: float = LOSS_SHARE) -> DataFrame:
    """Per capacity: sequences, tokens, the share of the room that they fill, and what part of the other limits the fullest reach.

    ``loss_reached`` is over sequences of two or more segments: one alone may be above the limit.
    """
    limit = F.greatest(F.lit(2), F.floor(F.col("max_len") / segment_tokens))
    sequences = placed.groupBy("pack_name", "max_len", "seq_no").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("segments"), F.sum("loss_tokens").alias("loss_tokens"))
    sums = sequences.groupBy("pack_name", "max_len").agg(
        F.count("*").alias("sequences"),
        F.sum("tokens").alias("tokens"),
        F.max("tokens").alias("fullest"),
        F.max("segments").alias("most_segments"),
        F.coalesce(F.max(F.when(F.col("segments") > 1, F.col("loss_tokens"))), F.lit(0)).alias("most_loss"),
        F.count(F.when(F.col("segments") >= limit, 1)).alias("at_segments"),
    )
    return sums.withColumns(
        {
            "filled": F.col("tokens") / (F.col("sequences") * F.col("max_len")),
            "segments_reached": F.col("most_segments") / limit,
            "loss_reached": F.col("most_loss") / (F.col("max_len") * max_loss_share),
        }
    )
