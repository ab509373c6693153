"""Best-fit packing by exact complements, planned on the histogram of lengths.

A piece's place depends on its length alone, so the plan is made from counts of the lengths 1..capacity, a
bounded table whatever the corpus. For each length, longest first, the gap to the capacity is filled exactly by
a single length, a pair or a triple of lengths whose sums are indexed as bit sets, as often as the counts allow.
What is left goes by best fit, longest first, bins of equal gap taken together. Pieces find their place by
their rank within the length: per-bucket counts give each bucket's first rank, so no group of equal lengths
meets in one task.

Defined results: null text is one piece, the end id alone; empty tables give no rows; rows that repeat are
packed each; extra columns are ignored; only documents longer than the capacity are cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import materialize, sliced, texts_of
from weftline.llm.tokens import word_tokenizer


class Stock:
    """How many pieces of each length are left, and bit sets of the sums of one, two and three of them."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.index()

    def index(self) -> None:
        lengths = np.flatnonzero(self.left).tolist()
        room = (1 << (self.capacity + 1)) - 1
        self.single = sum(1 << x for x in lengths)
        self.pair = self.triple = 0
        for x in lengths:
            self.pair |= self.single << x & room
        for x in lengths:
            self.triple |= self.pair << x & room

    def has(self, combo: tuple[int, ...]) -> bool:
        return all(self.left[x] >= combo.count(x) for x in set(combo))

    def fill(self, first: int, gap: int) -> tuple[int, ...] | None:
        """Lengths in stock besides ``first`` that sum to ``gap``: one, else two, else three."""
        if self.single >> gap & 1 and self.has((first, gap)):
            return (gap,)
        if self.pair >> gap & 1 and (two := self._two((first,), gap)):
            return two
        if self.triple >> gap & 1:
            lengths = np.flatnonzero(self.left[:gap])
            for x in lengths[::-1].tolist():
                if self.pair >> (gap - x) & 1 and self.has((first, x)) and (two := self._two((first, x), gap - x)):
                    return (x, *two)
        return None

    def _two(self, taken: tuple[int, ...], gap: int) -> tuple[int, int] | None:
        free = self.left.copy()
        for x in taken:
            free[x] -= 1
        some = free[1:gap] > 0
        for x in (np.flatnonzero(some & some[::-1])[::-1] + 1).tolist():
            if 2 * x != gap or free[x] >= 2:
                return (x, gap - x)
        return None

    def take(self, combo: tuple[int, ...], times: int) -> None:
        for x in combo:
            self.left[x] -= times


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence in order, number of such sequences), using every piece once."""
    stock, out = Stock(counts, capacity), []
    if stock.left[capacity]:
        out.append(((capacity,), int(stock.left[capacity])))
        stock.left[capacity] = 0
    stock.index()
    for length in range(capacity - 1, 0, -1):
        while stock.left[length]:
            combo = stock.fill(length, capacity - length)
            if combo is None:
                break
            combo = (length, *combo)
            times = min(int(stock.left[x]) // combo.count(x) for x in set(combo))
            stock.take(combo, times)
            out.append((combo, times))
            if any(not stock.left[x] for x in combo):
                stock.index()
    open_bins: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]  # by gap
    filled = np.zeros(capacity + 1, dtype=bool)
    for length in np.flatnonzero(stock.left)[::-1].tolist():
        left = int(stock.left[length])
        while left:
            fits = np.flatnonzero(filled[length:])
            if len(fits):
                gap = length + int(fits[0])
                combo, n = open_bins[gap].pop()
                filled[gap] = bool(open_bins[gap])
                used = min(n, left)
                if n > used:
                    open_bins[gap].append((combo, n - used))
                    filled[gap] = True
            else:
                combo, gap = (), capacity
                per_bin = capacity // length
                used = left if per_bin == 1 else -(-left // per_bin)
                if per_bin > 1:  # bins of this length alone, whole ones at once
                    whole = left // per_bin
                    if whole:
                        rest = capacity - per_bin * length
                        open_bins[rest].append(((length,) * per_bin, whole))
                        filled[rest] = True
                        left -= whole * per_bin
                        continue
                    used = 1
            open_bins[gap - length].append(((*combo, length), used))
            filled[gap - length] = True
            left -= used
    out += [group for groups in open_bins for group in groups]
    return out


def intervals(packing: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, offset) sorted by rank; a rank's place follows from its row."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for combo, times in packing:
        offset = 0
        for length in combo:
            rank = used.get(length, 0)
            rows.setdefault(length, []).append((rank, sequence, offset))
            used[length] = rank + times
            offset += length
        sequence += times
    return {length: np.array(x, dtype=np.int64) for length, x in rows.items()}


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Documents with their end id, cut at capacity: doc_id, piece, start, length, ids_crc32, and ids (binary, little-endian unsigned 32-bit) if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = word_tokenizer(tokenizer_path), np.array([end_id], dtype="<u4").tobytes()
        for batch in sliced(batches, "text", 1 << 20):
            at, piece, ids = [], [], []
            for i, packed in enumerate(coder.encode(texts_of(batch, "text"))):
                packed += end
                for k, low in enumerate(range(0, len(packed), 4 * capacity)):
                    at.append(i)
                    piece.append(k)
                    ids.append(packed[low : low + 4 * capacity])
            piece = np.array(piece, dtype=np.int32)
            columns = {
                "doc_id": batch.column("doc_id").take(pa.array(at, pa.int64())),
                "piece": pa.array(piece),
                "start": pa.array(piece.astype(np.int64) * capacity),
                "length": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(x) for x in ids], pa.int64()),
            }
            if with_ids:
                columns["ids"] = pa.array(ids, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)
        coder.forget()

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def pack(pieces: DataFrame, capacity: int, rows_per_bucket: int = 20_000) -> DataFrame:
    """``pieces`` (doc_id, piece, length and others; a materialised table) with sequence_id and offset."""
    total = pieces.count()
    buckets = max(1, -(-total // rows_per_bucket))
    dealt = pieces.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("length", "__bucket").count()
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("count")).collect()}  # at most capacity rows
    table = pieces.sparkSession.sparkContext.broadcast(intervals(plan(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn("__first", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = Window.partitionBy("length", "__bucket").orderBy("doc_id", "piece")
    ranked = dealt.withColumn("__rank", F.row_number().over(within)).join(firsts, ["length", "__bucket"])
    ranked = ranked.withColumn("__rank", F.col("__rank") + F.col("__first") - 1).drop("__bucket", "__first")
    names = [*ranked.columns[:-1], "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = table.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "__rank"))
            sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for x in np.unique(length).tolist():
                own = np.flatnonzero(length == x)
                rows = places[x]
                row = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1]
                sequence[own] = row[:, 1] + rank[own] - row[:, 0]
                offset[own] = row[:, 2]
            kept = [batch.column(i) for i in range(len(names) - 2)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema.fields[:-1]) + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)


def best_fit_packing(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = tokenized_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, with_ids=False)
    return pack(materialize(pieces, "pieces"), capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
