"""How often every term occurs, and in how many records, from compressed bitmaps.

The layout is vertical: a posting is (term, bucket, container, occurrences),
where the container holds the identifiers of the records of one bucket of
``BUCKET`` consecutive identifiers: the two-byte offsets themselves while they
take less room, a bitmap beyond. Records are shuffled once, by bucket and one
of ``PARTS`` parts of it, so that a task meets all deliveries of a record and no
bucket is a single task; it makes the postings of its part. The parts of a term
and bucket, and those of several loads, are merged by the union of their
containers (``merge_postings``). A term that a third of all records hold is
spread over as many postings as there are buckets; those of different buckets
are disjoint, so that the cardinality of their union is the sum of theirs.

Texts that are null or blank hold no term. Rows without an identifier are no
records. Of several deliveries of an identifier the first by ``order`` counts.
An empty table has no postings.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinworks.functions.words import WORD
from skeinworks.session import stash

#: Identifiers of a bucket; a bitmap of them takes BUCKET / 8 bytes.
BITS = 16
BUCKET = 1 << BITS
#: Parts of a bucket, which are worked on apart.
PARTS = 16
#: Records of a task, as long as there are no more than so many tasks.
TASK_ROWS, MOST_TASKS = 4096, 20_000
POSTINGS = "term string, bucket long, container binary, dense boolean, occurrences long"


def packed(offsets):
    """The container of sorted offsets, and whether it is a bitmap."""
    import numpy as np

    if 2 * len(offsets) <= BUCKET // 8:
        return np.asarray(offsets, "<u2").tobytes(), False
    bits = np.zeros(BUCKET, np.uint8)
    bits[np.asarray(offsets)] = 1
    return np.packbits(bits, bitorder="little").tobytes(), True


def unpacked(container: bytes, dense: bool):
    import numpy as np

    if dense:
        return np.flatnonzero(np.unpackbits(np.frombuffer(container, np.uint8), bitorder="little"))
    return np.frombuffer(container, "<u2")


def postings_of_rows(batches: Iterator) -> Iterator:
    """Postings of rows (bucket, part, id, texts) that come sorted, for each part of a bucket."""
    import pyarrow as pa

    held: dict[str, list] = {}
    records: list[int] = []
    at, bucket = None, None

    def flush():
        out = [(None, *packed(records), 0)] if records else []
        out += [(term, *packed(p[1:]), p[0]) for term, p in held.items()]
        terms, containers, dense, counts = zip(*out) if out else ((), (), (), ())
        for i in range(0, len(out), 20_000):
            j = slice(i, i + 20_000)
            yield pa.record_batch(
                [pa.array(terms[j], pa.string()), pa.array([bucket] * len(terms[j]), pa.int64()), pa.array(containers[j], pa.binary()), pa.array(dense[j], pa.bool_()), pa.array(counts[j], pa.int64())],
                names=["term", "bucket", "container", "dense", "occurrences"],
            )

    for batch in batches:
        for b, p, i, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if (b, p) != at:
                yield from flush()
                held, records, at, bucket = {}, [], (b, p), b
            offset = i & (BUCKET - 1)
            if records and records[-1] == offset:
                continue  # a later delivery
            records.append(offset)
            counts: dict[str, int] = {}
            for w in WORD.findall(text.lower()) if text else ():
                counts[w] = counts.get(w, 0) + 1
            for w, n in counts.items():
                posting = held.get(w)
                if posting is None:
                    held[w] = [n, offset]
                else:
                    posting[0] += n
                    posting.append(offset)
    yield from flush()


def term_postings(rows: DataFrame, identifier: str, texts: Column, order: str | None = None) -> DataFrame:
    """Postings of the word tokens of ``texts`` (an array of strings); those with a null term hold all records."""
    number = F.col(identifier).cast("long")
    kept = rows.filter(F.col(identifier).isNotNull()).select(
        F.shiftright(number, BITS).alias("bucket"),
        F.pmod(F.xxhash64(number), F.lit(PARTS)).cast("int").alias("part"),
        number.alias("id"),
        F.array_join(texts, "\n").alias("text"),
        *([F.col(order).alias("arrival")] if order else []),
    )
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, -(-rows.count() // TASK_ROWS)))
    sorted_rows = kept.repartition(tasks, "bucket", "part").sortWithinPartitions("bucket", "part", "id", *(["arrival"] if order else []))
    return merge_postings(sorted_rows.select("bucket", "part", "id", "text").mapInArrow(postings_of_rows, POSTINGS))


def merge_postings(postings: DataFrame) -> DataFrame:
    """The union of postings of parts, or of several loads of different records: one row per term and bucket."""

    def union(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for term, bucket, parts, n in zip(*(c.to_pylist() for c in batch.columns)):
                if len(parts) == 1:
                    out.append((term, bucket, parts[0]["container"], parts[0]["dense"], n))
                    continue
                ids = np.unique(np.concatenate([unpacked(p["container"], p["dense"]) for p in parts]))
                out.append((term, bucket, *packed(ids), n))
            if out:
                columns = list(zip(*out))
                kinds = [pa.string(), pa.int64(), pa.binary(), pa.bool_(), pa.int64()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["term", "bucket", "container", "dense", "occurrences"])

    grouped = postings.groupBy("term", "bucket").agg(F.collect_list(F.struct("container", "dense")).alias("parts"), F.sum("occurrences").alias("n"))
    return grouped.mapInArrow(union, POSTINGS)


def cardinality(container: Column, dense: Column) -> Column:
    return F.when(dense, F.bitmap_count(container)).otherwise((F.octet_length(container) / 2).cast("long"))


def term_frequencies(postings: DataFrame) -> DataFrame:
    """``term``, ``occurrences`` and ``records`` (document frequency); the row with a null term has the number of all records."""
    return postings.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum(cardinality(F.col("container"), F.col("dense"))).alias("records"))


def marked_terms(trajectories: DataFrame, vocabulary: DataFrame, rare_below: int = 3, common_above: float = 0.5) -> DataFrame:
    """Every word token of ``blocks.text`` and every ``token`` of the vocabulary with its frequencies and mark.

    ``rare``: held by fewer than ``rare_below`` trajectories; ``common``: by more than the share ``common_above`` of
    all; else null. Null tokens of the vocabulary are no terms, repeated ones are one.
    """
    return marked(term_postings(trajectories, "traj_no", F.col("blocks.text"), "loaded_at"), vocabulary, rare_below, common_above)


def merged_loads(loads: list[DataFrame]) -> DataFrame:
    """The postings of all ``loads``, each made by itself and merged; a ``traj_no`` that an earlier load has counts there."""
    postings, before = None, None
    for load in loads:
        new = load if before is None else load.join(before, "traj_no", "left_anti")
        made = stash(term_postings(new, "traj_no", F.col("blocks.text"), "loaded_at"), "postings")
        postings = made if postings is None else merge_postings(postings.unionByName(made))
        numbers = load.select("traj_no").distinct()
        before = numbers if before is None else before.union(numbers).distinct()
    return postings


def marked(postings: DataFrame, vocabulary: DataFrame, rare_below: int = 3, common_above: float = 0.5) -> DataFrame:
    """Terms of ``postings`` and of the vocabulary with their frequencies and mark, as in ``marked_terms``."""
    found = term_frequencies(postings)
    listed = vocabulary.filter("token IS NOT NULL").select(F.col("token").alias("term"), F.lit(0).cast("long").alias("occurrences"), F.lit(0).cast("long").alias("records"))
    every = found.unionByName(listed).groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    every = stash(every, "terms")
    # The row with the null term is one number: all records.
    all_records = every.filter("term IS NULL").agg(F.coalesce(F.max("records"), F.lit(0))).scalar()
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > all_records * common_above, "common")
    return every.filter("term IS NOT NULL").select("term", "occurrences", "records", mark.alias("mark"))
