"""Packed token-id matrices: best-fit-decreasing by a segment tree over free capacities.

Each task tokenises its rows and packs them in shards of about ``shard_tokens`` tokens, so memory is bounded,
nothing is shuffled and a lost task is redone from its own input. A shard's open sequences are found by their
free capacity: the tree gives the least capacity that still holds a piece. Overlong documents are cut into
pieces of the capacity, without loss.

A row of the result is a sequence: its ids as one row of a fixed-width matrix (``<u2`` or ``<u4``, padded with
``pad_id``), the cumulative segment lengths from 0, the places where positions restart, and the document and
piece of each segment. Written as Parquet by ``write_packed``.

Defined results: null text is the end id alone; every row is packed, repeats included; an empty table gives no
sequences; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import materialize, sliced, texts_of
from weftline.llm.tokens import word_tokenizer


class CapacityTree:
    """Counts of open bins by free capacity 0..capacity, with search for the least capacity of at least x."""

    def __init__(self, capacity: int):
        self.size = 1
        while self.size <= capacity:
            self.size *= 2
        self.count = [0] * (2 * self.size)

    def add(self, free: int, n: int = 1) -> None:
        at = free + self.size
        while at:
            self.count[at] += n
            at //= 2

    def least(self, x: int) -> int:
        """The least free capacity >= x that some bin has, or -1."""
        at = x + self.size
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at //= 2
            if at <= 1:
                return -1
            at += 1
            while at < self.size:
                at *= 2
                if not self.count[at]:
                    at += 1
        return at - self.size


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of places in ``lengths``; the longest first, ties in order."""
    tree, bins, by_free = CapacityTree(capacity), [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        free = tree.least(lengths[i])
        if free < 0:
            at, free = len(bins), capacity
            bins.append([])
        else:
            at = by_free[free].pop()
            tree.add(free, -1)
        bins[at].append(i)
        by_free.setdefault(free - lengths[i], []).append(at)
        tree.add(free - lengths[i])
    return bins


def packed_sequences(
    docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 49407, pad_id: int = 49407,
    vocab_size: int = 49408, shard_tokens: int = 1 << 21, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """sequence_id, n_tokens, ids (binary matrix row), cu_seqlens, position_resets, doc_ids, pieces."""
    kind = np.dtype("<u2" if vocab_size <= 1 << 16 else "<u4")

    def shard(held: list[tuple[int | None, int, np.ndarray]], first: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        bins = best_fit_decreasing([len(x) for _, _, x in held], capacity)
        for low in range(0, len(bins), 256):
            part = bins[low : low + 256]
            matrix = np.full((len(part), capacity), pad_id, dtype=kind)
            cumulative = []
            for row, own in zip(matrix, part, strict=True):
                ends = np.cumsum([0, *(len(held[i][2]) for i in own)])
                cumulative.append(ends.tolist())
                row[: ends[-1]] = np.concatenate([held[i][2] for i in own])
            yield pa.RecordBatch.from_pydict({
                "sequence_id": pa.array(range(first + low, first + low + len(part)), pa.int64()),
                "n_tokens": pa.array([c[-1] for c in cumulative], pa.int32()),
                "ids": pa.array([r.tobytes() for r in matrix], pa.binary()),
                "cu_seqlens": pa.array(cumulative, pa.list_(pa.int32())),
                "position_resets": pa.array([c[:-1] for c in cumulative], pa.list_(pa.int32())),
                "doc_ids": pa.array([[held[i][0] for i in own] for own in part], pa.list_(id_type)),
                "pieces": pa.array([[held[i][1] for i in own] for own in part], pa.list_(pa.int32())),
            })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, first = word_tokenizer(tokenizer_path), TaskContext.get().partitionId() << 32
        held, total, id_type = [], 0, pa.int64()
        for batch in sliced(batches, "text", 1 << 20):
            id_type = batch.column("doc_id").type
            for doc, packed in zip(batch.column("doc_id").to_pylist(), coder.encode(texts_of(batch, "text")), strict=True):
                ids = np.append(np.frombuffer(packed, dtype="<u4").astype(kind), kind.type(end_id))
                for k, low in enumerate(range(0, len(ids), capacity)):
                    held.append((doc, k, ids[low : low + capacity]))
                    total += len(held[-1][2])
                    if total >= shard_tokens:
                        for out in shard(held, first, id_type):
                            first += out.num_rows
                            yield out
                        held, total = [], 0
        coder.forget()
        if held:
            yield from shard(held, first, id_type)

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(
        run,
        f"sequence_id long, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<{id_kind}>, pieces array<int>",
    )


def write_packed(docs: DataFrame, tokenizer_path: str, path: str | None = None, **params) -> DataFrame:
    """Write the sequences as Parquet, to ``path`` or a new table in the shared folder, and read them back."""
    out = packed_sequences(docs, tokenizer_path, **params)
    if path is None:
        return materialize(out, "packed-ids")
    out.write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)
