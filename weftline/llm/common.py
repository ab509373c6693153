"""Shared helpers: tables in the shared folder, bounded text batches, skew-safe joins, components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

_local_dir: list[str] = []
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only where that is unset on a local master (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_dir:
        _local_dir.append(tempfile.mkdtemp(prefix="weftline-"))
        atexit.register(shutil.rmtree, _local_dir[0], ignore_errors=True)
    return f"file://{_local_dir[0]}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cut lineage that outlives executors.

    The files stay as long as plans may read them: until ``discard_tables`` or the end of the shared folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard_tables(spark: SparkSession) -> int:
    """Remove the tables that this driver has written so far; call it once results are stored. How many there were."""
    n = len(_written)
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def quoted(name: str) -> Column:
    """The column of that very name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(taken: list[str], name: str) -> str:
    """``name``, with underscores before it until no column has it (case ignored)."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name = f"_{name}"
    return name


def first_by_hash(rows: DataFrame, group: str, key: str, most: int) -> DataFrame:
    """About the ``most`` rows of each group that are least by a hash of ``key``, never more: (group, key), for joins.

    Groups are counted on the map side; rows whose hash lies beyond a bound that about ``most`` and a half rows of their
    group are under never leave it, so what a group sends to one task has a size that does not grow with the group.
    """
    share = F.least(F.lit(1.0), (1.5 * most + 50) / F.col("__n"))
    counts = rows.groupBy(group).agg(F.count("*").alias("__n"))
    hashed = rows.select(group, key).withColumn("__h", F.xxhash64(key))
    near = hashed.join(F.broadcast(counts.select(group, (share * float(1 << 63)).alias("__bound"))), group)
    near = near.where(F.abs(F.col("__h").cast("double")) <= F.col("__bound"))
    least = Window.partitionBy(group).orderBy("__h", key)
    return near.withColumn("__r", F.row_number().over(least)).where(F.col("__r") <= most).select(group, key)


def texts_of(batch: pa.RecordBatch, column: str, as_bytes: bool = False) -> list:
    """Values of a string column, null as empty."""
    values = batch.column(column)
    if as_bytes:
        return [v or b"" for v in values.cast(pa.binary()).to_pylist()]
    return [v or "" for v in values.to_pylist()]


def sliced(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the text in a slice stays near ``max_bytes`` (one longer text makes a slice of its own).

    Cycles are not searched for while batches pass: the operators make none, and millions of strings.
    """
    searching = gc.isenabled()
    gc.disable()
    try:
        yield from _cut(batches, column, max_bytes)
    finally:
        if searching:
            gc.enable()
        give_back()


def give_back() -> None:
    """Return free memory to the system when a task ends: the worker may stay idle beside others."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def _cut(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > max_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if len(sizes) > start:
            yield batch.slice(start)


def join_by_skewed_key(left: DataFrame, right: DataFrame, key: str, share: float = 0.005) -> DataFrame:
    """Left join where a few values of ``key`` may hold much of ``left``; ``right`` has unique keys.

    Keys that hold more than ``share`` of the rows, at most ``1/share`` of them, are broadcast with their
    rows of ``right``; the others are shuffled. ``left`` should be a materialised table: it is read twice.
    """
    total = left.count()
    bound = max(1000, int(total * share))
    hot = left.groupBy(key).count().where(F.col("count") > bound).select(key)
    hot_rows = [r[0] for r in hot.limit(int(1 / share) + 1).collect()]
    if not hot_rows:
        return left.join(right, key, "left")
    is_hot = F.col(key).isin(hot_rows)
    columns = [c for c in right.columns if c != key]
    hot_side = left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, "left")
    cold_side = left.where(~is_hot | F.col(key).isNull()).join(right.where(~is_hot), key, "left")
    order = [*left.columns, *columns]
    return hot_side.select(order).unionByName(cold_side.select(order))


def local_forest(links: DataFrame, window: int = 500_000) -> DataFrame:
    """Edges u > v that join what the links (columns a, b) of a task join: each node to the least of its local component.

    Links are taken in windows, so a task holds one window; what windows and tasks share is joined by later rounds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]))
            if sum(x.shape[1] for x in held) >= window:
                yield forest(np.concatenate(held, axis=1))
                held = []
        if held:
            yield forest(np.concatenate(held, axis=1))

    def forest(pairs: np.ndarray) -> pa.RecordBatch:
        nodes, flat = np.unique(pairs, return_inverse=True)
        a, b = flat.reshape(pairs.shape)
        least = np.arange(len(nodes))
        while True:  # hook the larger root to the smaller, then halve the paths
            x, y = least[a], least[b]
            open_ = x != y
            if not open_.any():
                break
            np.minimum.at(least, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
            while (least[least] != least).any():
                least = least[least]
        moved = np.flatnonzero(least != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[least[moved]])], ["u", "v"])

    return links.mapInArrow(run, "u long, v long")


def connected_components(links: DataFrame, a: str, b: str, label: str = "cc") -> DataFrame:
    """Components of an undirected graph of long ids as (node, root), root the least node; nodes without links are absent.

    Distributed union-find: each task joins its own links first; then, in alternating large-star and small-star rounds,
    each node points its larger neighbours, then its smaller ones, at the least neighbour, until no edge changes. A
    round's edges are written to the shared folder, and counted and hashed while they are written.
    """
    pairs = links.where(F.col(a) != F.col(b)).select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    edges, state = _written_edges(local_forest(pairs).distinct(), label)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u"))
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v"))
        before = state
        edges, state = _written_edges(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), label)
        if before == state:
            break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _written_edges(edges: DataFrame, label: str) -> tuple[DataFrame, tuple]:
    """The edges as a table in the shared folder, with their count and an order-free hash."""
    seen = Observation()
    counted = edges.observe(seen, F.count("*").alias("n"), F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0)).alias("h"))
    table = materialize(counted, label)
    return table, (seen.get["n"], seen.get["h"])
