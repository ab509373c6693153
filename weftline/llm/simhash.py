"""SimHash fingerprints and near-dedup by BK-trees.

Texts are lower-cased (A-Z only) and split on ASCII white space; the XXH64 (seed 42) of every 3-word shingle,
repeats included, votes on 64 bits. Fingerprints that differ in at most three bits are linked.

Search: of four blocks of 16 bits, at most three can hold a difference, so linked fingerprints agree in full on
one block. Distinct fingerprints are dealt out by each block; each of the 4 * 65536 shards has its own BK-tree
(children keyed by their distance to the parent, only edges within the radius followed). A shard hands on a
spanning forest of its links, not its pairs. A shard of more than ``bucket_limit`` members is dealt out again by a
quarter more of its free bits, until it fits: with 9 free bits it must. Trees are built where their shard lies:
broadcast, they would have to pass through the driver and grow with the corpus. Components come from star rounds
over the links.

Defined results: null and wordless texts have fingerprint zero, linked like any other; one row per input row;
null doc_ids never name a component unless it has no other; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import connected_components, join_by_skewed_key, materialize, sliced, texts_of

RADIUS = 3
_BLOCKS = (16, 16, 16, 16)


def fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint of UTF-8 bytes."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < 3:
        votes = np.array([digest(b" ".join(words), 42)], dtype="<u8")
    else:
        flat = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = zip(starts[:-2].tolist(), ends[2:].tolist(), strict=True)
        votes = np.fromiter([digest(flat[a:z], 42) for a, z in spans], dtype="<u8", count=len(words) - 2)
    counts = np.zeros(64, dtype=np.int64)
    for low in range(0, len(votes), 1 << 15):
        part = votes[low : low + (1 << 15)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    on = np.packbits(2 * counts > len(votes), bitorder="little")
    return int(on.view("<u8")[0])


class BKTree:
    """Unsigned integers under Hamming distance; a child hangs from its parent by the distance between them."""

    __slots__ = ("children", "radius", "values")

    def __init__(self, radius: int = RADIUS):
        self.radius = radius
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, value: int) -> list[int]:
        """Places, in order of adding, of the values within the radius."""
        if not self.values:
            return []
        found, stack, radius = [], [0], self.radius
        values, children = self.values, self.children
        while stack:
            at = stack.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            for edge, child in children[at].items():
                if d - radius <= edge <= d + radius:
                    stack.append(child)
        return found

    def add(self, value: int) -> None:
        at, values, children = 0, self.values, self.children
        values.append(value)
        children.append({})
        new = len(values) - 1
        while new:
            d = (values[at] ^ value).bit_count()
            if d not in children[at]:
                children[at][d] = new
                return
            at = children[at][d]


def forest(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links within the radius that join the values' components, no more than one fewer than the values."""
    if len(values) == 2:
        return [(values[0], values[1])] if (values[0] ^ values[1]).bit_count() <= radius else []
    tree, parent, out = BKTree(radius), list(range(len(values))), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, value in enumerate(values):
        for j in tree.near(value):
            if (a := root(i)) != (b := root(j)):
                parent[a] = b
                out.append((value, values[j]))
        tree.add(value)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            values = np.array([fingerprint(t) for t in texts_of(batch, "text", as_bytes=True)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fp long")


def block_masks(radius: int = RADIUS) -> list[int]:
    """Bit masks of every choice of len(_BLOCKS) - radius blocks."""
    blocks, low = [], 0
    for width in _BLOCKS:
        blocks.append(((1 << width) - 1) << low)
        low += width
    return [sum(c) for c in combinations(blocks, len(blocks) - radius)]


def finer_masks(mask: int, parts: int = RADIUS + 1) -> list[int]:
    """``mask`` with one of ``parts`` equal shares of its free bits added: links agree on one share at least."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [len(free) * k // parts for k in range(parts + 1)]
    return [mask | sum(1 << i for i in free[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct_fps: DataFrame, bucket_limit: int = 512) -> DataFrame:
    """(a, b) links that connect all fingerprints within the radius; the input has one column fp without repeats."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (mask, key). kind 0: a link a, b; kind 1: a member b, with mask a, of a bucket too large."""

        def emit(kind: int, a: list[int], b: list[int]) -> pa.RecordBatch:
            signed = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (a, b)]
            arrays = [pa.array([kind] * len(a), pa.int32()), *signed]
            return pa.RecordBatch.from_arrays(arrays, ["kind", "a", "b"])

        held_key, held, passed = None, [], False  # the open bucket; passed: it has outgrown the limit
        for batch in batches:
            mask, key, fp = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("mask", "key", "fp"))
            if not len(fp):
                continue
            cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            starts = np.concatenate(([0], cuts))
            stops = np.concatenate((cuts, [len(fp)]))
            out: list[tuple[int, int]] = []
            again: list[tuple[int, int]] = []
            # single-member buckets strictly inside the batch need no work
            busy = np.flatnonzero((stops - starts > 1) | (np.arange(len(starts)) == 0) | (np.arange(len(starts)) == len(starts) - 1))
            for s in busy.tolist():
                a, z = int(starts[s]), int(stops[s])
                here = (int(mask[a]), int(key[a]))
                if here != held_key:
                    if len(held) > 1 and not passed:
                        out += forest(held)
                    held_key, held, passed = here, [], False
                held += fp[a:z].tolist()
                if passed or len(held) > bucket_limit:
                    again += [(here[0], v) for v in held]
                    held, passed = [], True
            if out:
                yield emit(0, *map(list, zip(*out, strict=True)))
            if again:
                yield emit(1, *map(list, zip(*again, strict=True)))
        if len(held) > 1 and not passed:
            found = forest(held)
            if found:
                yield emit(0, *map(list, zip(*found, strict=True)))

    def dealt(rows: DataFrame) -> DataFrame:
        keyed = rows.select("mask", F.expr("mask & fp").alias("key"), "fp")
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ordered = keyed.repartition(n, "mask", "key").sortWithinPartitions("mask", "key")
        return materialize(ordered.mapInArrow(scan, "kind int, a long, b long"), "bk-links")

    masks = F.array(*[F.lit(_signed(m)) for m in block_masks()])
    done = dealt(distinct_fps.select(F.explode(masks).alias("mask"), "fp"))
    found = done.where("kind = 0")
    while True:
        large = done.where("kind = 1")
        outgrown = [r[0] for r in large.select("a").distinct().collect()]  # masks: 4, four times more each turn
        if not outgrown:
            return found.select("a", "b")
        finer = F.create_map(
            *[x for m in outgrown for x in (F.lit(m), F.array(*[F.lit(_signed(f)) for f in finer_masks(m % (1 << 64))]))]
        )
        done = dealt(large.select(F.explode(finer[F.col("a")]).alias("mask"), F.col("b").alias("fp")).distinct())
        found = found.unionByName(done.where("kind = 0"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable)."""
    rows = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    groups = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fp-groups")
    roots = connected_components(links(groups.select("fp")), "a", "b", "simhash-cc")
    named = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    named = materialize(named, "fp-roots")
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = join_by_skewed_key(named, least, "root").select("fp", "component_id")
    return join_by_skewed_key(rows, by_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose doc_id names its component, and rows without doc_id in components without any.

    A repeated doc_id is one document: its rows stay or go together.
    """
    found = simhash_components(docs, id_col, text_col)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__keep")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["__keep"]), "left_semi")
