"""Encoding of a corpus by a public byte-level BPE.

``encode`` merges by a hierarchical-bitmap rank queue: every rank of a merge
has a bucket of positions in a linked list of symbols, a bitmap of three levels
of 64-bit words tells which buckets hold anything, find-first-set on it picks
the next rank, and positions that an earlier merge changed are skipped. Its
cost grows with the length of a pre-token as n log n, not as its square.

Null and empty texts have the empty list of ids. Texts are encoded whole,
strings of special tokens in them as ordinary text. A ``doc_id`` that repeats
or is null keeps its own row; other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: How a byte-level BPE of this kind cuts a text before merging (fixed value).
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Ids of short pre-tokens are kept up to this many; the memory of a worker is bounded, results do not depend on it.
CACHE, CACHED_CHARS = 100_000, 48


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class RankQueue:
    """Buckets of positions by rank, and the bitmap of those that are not empty."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def first(self) -> int:
        """The lowest rank in the queue, -1 where it is empty."""
        if not self.top:
            return -1
        a = (self.top & -self.top).bit_length() - 1
        word = self.mid[a]
        b = a << 6 | (word & -word).bit_length() - 1
        word = self.low[b]
        return b << 6 | (word & -word).bit_length() - 1

    def take(self, rank: int) -> list[int]:
        """The positions of a rank from left to right; its bucket is empty then."""
        b, a = rank >> 6, rank >> 12
        self.low[b] &= ~(1 << (rank & 63))
        if not self.low[b]:
            self.mid[a] &= ~(1 << (b & 63))
            if not self.mid[a]:
                self.top &= ~(1 << a)
        return sorted(self.buckets.pop(rank))


class ByteBPE:
    """A byte-level BPE read from its vocabulary file."""

    def __init__(self, path: str = TOKENIZER):
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, stands = model["vocab"], byte_alphabet()
        self.of_byte = [0] * 256
        for char, byte in stands.items():
            self.of_byte[byte] = vocab[char]
        self.merges: list[tuple[int, int, int]] = []
        self.rank: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.merges.append((vocab[a], vocab[b], vocab[a + b]))
            self.rank.setdefault(vocab[a] << 20 | vocab[b], rank)
        self.cut = regex.compile(PRETOKEN).findall
        self.queue = RankQueue(len(self.merges))
        self.known: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}

    def merge(self, symbols: list[int]) -> list[int]:
        n, rank, queue = len(symbols), self.rank.get, self.queue
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        for i in range(n - 1):
            r = rank(symbols[i] << 20 | symbols[i + 1])
            if r is not None:
                queue.push(r, i)
        while (lowest := queue.first()) >= 0:
            left, right, both = self.merges[lowest]
            for i in queue.take(lowest):
                j = after[i]
                if symbols[i] != left or j >= n or symbols[j] != right:
                    continue  # an earlier merge took one of the two
                k, h = after[j], before[i]
                symbols[i], symbols[j], after[i] = both, -1, k
                if k < n:
                    before[k] = i
                    r = rank(both << 20 | symbols[k])
                    if r is not None:
                        queue.push(r, i)
                if h >= 0:
                    r = rank(symbols[h] << 20 | both)
                    if r is not None:
                        queue.push(r, h)
        return [s for s in symbols if s >= 0]

    def piece(self, text: str) -> list[int]:
        of = self.of_byte
        return self.merge([of[b] for b in text.encode("utf-8")])

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        known, add = self.known, ids.extend
        for piece in self.cut(text or ""):
            got = known.get(piece)
            if got is None:
                got = self.older.get(piece) or self.piece(piece)
                if len(piece) <= CACHED_CHARS:
                    if len(known) >= CACHE:
                        # What is still in use comes back from the older half.
                        self.older, self.known = known, {}
                        known = self.known
                    known[piece] = got
            add(got)
        return ids


_LOADED: dict[str, ByteBPE] = {}


def loaded(path: str) -> ByteBPE:
    """The tokenizer of this Python worker, read once."""
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def encode_corpus(documents: DataFrame, tokenizer: str = TOKENIZER, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column`` and ``ids`` (array of int) of every row, without special tokens; no shuffle."""

    def encode(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        bpe = loaded(tokenizer)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                rows = [bpe.encode(t) for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(rows) + 1, np.int32)
                np.cumsum([len(r) for r in rows], out=offsets[1:])
                flat = np.fromiter((i for r in rows for i in r), np.int32, int(offsets[-1]))
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[id_column, "ids"])

    kind = documents.schema[id_column].dataType.simpleString()
    return documents.select(id_column, text_column).mapInArrow(encode, f"`{id_column}` {kind}, ids array<int>")
