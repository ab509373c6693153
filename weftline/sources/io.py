"""Readers and writers: Parquet, CSV with metadata lines, JSON lines, JDBC ranges, ontology text, graph CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_any(spark: SparkSession, path: str, columns: list[str] | None = None, schema: str | None = None) -> DataFrame:
    """By suffix: parquet, orc, csv, tsv, json or jsonl; only ``columns`` if given. Lines that begin with # are metadata."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read.schema(schema) if schema else spark.read
    if kind in ("csv", "tsv"):
        frame = reader.option("header", True).option("comment", "#").option("sep", "\t" if kind == "tsv" else ",").csv(path)
    elif kind in ("json", "jsonl"):
        frame = reader.json(path)
    else:
        frame = (reader.orc if kind == "orc" else reader.parquet)(path)
    return frame.select(*columns) if columns else frame


def write_table(frame: DataFrame, path: str, overwrite: bool = False, compression: str = "snappy", partition_by: list[str] | None = None) -> None:
    """Parquet; fails if the path exists and isn't to be overwritten."""
    writer = frame.write.mode("overwrite" if overwrite else "errorifexists").option("compression", compression)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_jdbc(spark: SparkSession, url: str, query: str, column: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A query read in ranges of an integer column."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=f"({query}) q", partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.options(**options).load()


def read_ontology(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, parents, subsets) of the terms of an OBO file, one block of lines each."""
    blocks = spark.read.option("lineSep", "\n\n").text(path).where(F.trim("value").startswith("[Term]"))
    many = lambda tag: F.regexp_extract_all("value", F.lit(rf"(?m)^{tag}: ([^\s!]+)"), 1)
    return blocks.select(F.regexp_extract("value", r"(?m)^id: (\S+)", 1).alias("id"), F.regexp_extract("value", r"(?m)^name: (.+)$", 1).alias("name"), many("is_a").alias("parents"), many("subset").alias("subsets"))


def graph_csv(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as CSV for graph loaders; rows with null ids fail the export."""
    bad = nodes.where("node_id is null").isEmpty() and edges.where("source_id is null or target_id is null").isEmpty()
    if not bad:
        raise ValueError("null ids")
    nodes.withColumnsRenamed({"node_id": ":ID", "label": ":LABEL"}).write.mode("overwrite").option("header", True).csv(f"{path}/nodes")
    edges.withColumnsRenamed({"source_id": ":START_ID", "target_id": ":END_ID", "edge_type": ":TYPE"}).write.mode("overwrite").option("header", True).csv(f"{path}/edges")


def unfinished(shards: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Shards that no finished output covers, for restarts."""
    return shards.join(done.select(keys).distinct(), keys, "left_anti")


def table_fingerprint(frame: DataFrame) -> DataFrame:
    """One row: rows and an order-free hash, to tell whether a table changed."""
    return frame.agg(F.count("*").alias("n_rows"), F.bit_xor(F.xxhash64(*frame.columns)).alias("fingerprint"))


def write_csv(frame: DataFrame, path: str, metadata: dict[str, str]) -> None:
    """CSV parts under ``path``, each begun by ``# key: value`` lines that ``read_any`` passes over."""
    head = [f"# {k}: {v}" for k, v in metadata.items()]
    cells = [F.when(F.col(c).isNull(), "").otherwise(F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))) for c in frame.columns]
    lines = frame.select(F.concat_ws(",", *cells).alias("value"))
    first = "\n".join([*head, ",".join(frame.columns)])

    def run(batches):
        import pyarrow as pa

        begun = False
        for batch in batches:
            if not begun and batch.num_rows:
                begun = True
                yield pa.RecordBatch.from_arrays([pa.array([first], batch.schema.field(0).type)], schema=batch.schema)
            yield batch

    lines.mapInArrow(run, "value string").write.mode("overwrite").text(path)


def rewrite_portable(spark: SparkSession, source: str, target: str, rows_per_file: int = 1_000_000) -> None:
    """Parquet with plain options (version 1 pages, snappy, bounded files) and a CSV twin, in ``target``/parquet and /csv."""
    frame = spark.read.parquet(source)
    plain = frame.write.mode("overwrite").option("compression", "snappy").option("parquet.writer.version", "v1").option("parquet.enable.dictionary", "false")
    plain.option("maxRecordsPerFile", rows_per_file).parquet(f"{target}/parquet")
    frame.write.mode("overwrite").option("header", True).option("maxRecordsPerFile", rows_per_file).csv(f"{target}/csv")


def _files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern in whatever store Spark reads, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(str(f.getPath()) for f in found or [])


def discover(spark: SparkSession, base: str, patterns: list[str]) -> str | None:
    """The first path of the first pattern that matches any."""
    for pattern in patterns:
        if found := _files(spark, f"{base.rstrip('/')}/{pattern}"):
            return found[0]
    return None


def discover_all(spark: SparkSession, base: str, wanted: dict[str, list[str]]) -> dict[str, str | None]:
    return {name: discover(spark, base, patterns) for name, patterns in wanted.items()}


def inventory(spark: SparkSession, base: str, signatures: dict[str, set[str]], patterns: tuple[str, ...] = ("*.parquet", "*.csv", "*.tsv", "*.json")) -> DataFrame:
    """(path, columns, kinds): tables below ``base`` with the signatures (sets of columns) that theirs cover; only schemas are read."""
    rows = []
    for pattern in patterns:
        for path in _files(spark, f"{base.rstrip('/')}/{pattern}"):
            columns = read_any(spark, path).columns
            low = {c.lower() for c in columns}
            rows.append((path, columns, sorted(k for k, need in signatures.items() if need <= low)))
    return spark.createDataFrame(rows, "path string, columns array<string>, kinds array<string>")


def best_source(found: DataFrame, kind: str, priority: list[str]) -> str | None:
    """The path of a kind whose name holds the first of ``priority`` that any does; the first by name of equal ones."""
    place = F.lit(len(priority))
    for i, part in reversed(list(enumerate(priority))):
        place = F.when(F.contains("path", F.lit(part)), i).otherwise(place)
    row = found.where(F.array_contains("kinds", kind)).withColumn("place", place).orderBy("place", "path").first()
    return row["path"] if row else None


def counts_by_kind(spark: SparkSession, path: str, key: str, kind: str) -> DataFrame:
    """By key: rows of each kind in a large CSV, a column a kind."""
    return read_any(spark, path).groupBy(key).pivot(kind).count().na.fill(0)


def emit_measures(rows: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """A row for each measure that is given: keys, measure, value as text; none to as many as there are measures."""
    given = F.array(*[F.struct(F.lit(m).alias("measure"), F.trim(F.col(m).cast("string")).alias("value")) for m in measures])
    return rows.select(*keys, F.explode(given).alias("m")).select(*keys, "m.*").where("value IS NOT NULL AND value <> ''")


def read_matrix(spark: SparkSession, path: str, top: int | None = None, skip: int = 2) -> DataFrame:
    """(gene, column, value) of a tab-separated matrix after ``skip`` lines (two id columns, then values), positive values, the ``top`` of each gene."""
    from pyspark.sql import Window

    lines = spark.read.option("wholetext", False).text(path)
    head = [r[0] for r in lines.limit(skip + 1).collect()][skip].split("\t")
    cells = F.split("value", "\t")
    rows = lines.where((F.size(cells) == len(head)) & (cells[0] != head[0])).select(cells[0].alias("gene"), F.posexplode(F.slice(cells, 3, len(head) - 2)).alias("at", "text"))
    names = F.array(*[F.lit(h) for h in head[2:]])
    out = rows.select("gene", F.element_at(names, F.col("at") + 1).alias("column"), F.col("text").try_cast("double").alias("value")).where("value > 0 AND NOT isnan(value)")
    if top is None:
        return out
    place = F.row_number().over(Window.partitionBy("gene").orderBy(F.desc("value"), "column"))
    return out.withColumn("__r", place).where(F.col("__r") <= top).drop("__r")


def read_hierarchy(spark: SparkSession, path: str, prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """(child, parent) edges of a tab-separated file of parent and child, ids with the prefix, and the roots."""
    pairs = spark.read.option("sep", "\t").schema("parent string, child string").csv(path)
    edges = pairs.where(F.col("parent").startswith(prefix) & F.col("child").startswith(prefix)).select("child", "parent").distinct()
    return edges, edges.select(F.col("parent").alias("node")).distinct().join(edges.select(F.col("child").alias("node")), "node", "left_anti")


def parsed(frame: DataFrame, mapping: dict[str, str], source: str) -> DataFrame:
    """The columns that a dataset is known by under the names of the schema (new: old), and where rows come from; absent ones null."""
    low = {c.lower(): c for c in frame.columns}
    picked = [(F.col(low[old.lower()]) if old.lower() in low else F.lit(None).cast("string")).alias(new) for new, old in mapping.items()]
    return frame.select(*picked, F.lit(source).alias("source"))


def recipes(parts: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """(recipe, item) of tables (frame with recipe, column, form): form "commas", or "list" for JSON or quoted lists; trimmed, lower case, distinct."""
    from weftline.functions.texts import list_literal

    out = None
    for frame, column, form in parts:
        items = F.split(F.col(column), ",") if form == "commas" else list_literal(F.col(column))
        own = frame.select(F.col("recipe").cast("string").alias("recipe"), F.explode(items).alias("item")).withColumn("item", F.lower(F.trim("item"))).where("item <> ''")
        out = own if out is None else out.unionByName(own)
    return out.distinct()


def write_index(frame: DataFrame, path: str) -> None:
    """JSON lines, one object a row, nulls left out."""
    frame.write.mode("overwrite").json(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both, those of ``new`` in place of those with the same keys; a key once."""
    fresh = new.dropDuplicates(keys)
    return old.join(fresh.select(keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def write_shards(frame: DataFrame, path: str, shard: str) -> int:
    """Append the shards of ``frame`` that ``path`` does not hold whole yet; how many were written.

    A shard is whole when the marker table beside it lists it: markers are written after the data, so a run that died
    leaves no marker, and its rows of that shard are written over.
    """
    spark = frame.sparkSession
    markers = f"{path.rstrip('/')}-done"
    done = spark.read.parquet(markers) if _files(spark, f"{markers}/*.parquet") else None
    kind = frame.schema[shard].dataType.simpleString()
    todo = frame.select(shard).distinct()
    todo = unfinished(todo, done, [shard]) if done is not None else todo
    names = [r[0] for r in todo.collect()]
    if names:
        rest = frame.where(F.col(shard).isin(names))
        rest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(shard).parquet(path)
        spark.createDataFrame([(n,) for n in names], f"{shard} {kind}").coalesce(1).write.mode("append").parquet(markers)
    return len(names)


def manifest(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """(name, n_rows, fingerprint) of tables by path: what a rerun compares."""
    out = None
    for name, path in sorted(tables.items()):
        own = table_fingerprint(read_any(spark, path)).select(F.lit(name).alias("name"), "n_rows", "fingerprint")
        out = own if out is None else out.unionByName(own)
    return out


def changed(before: DataFrame, now: DataFrame) -> DataFrame:
    """(name, reason) of tables that are new, gone or different: nothing to do where it is empty."""
    both = before.select("name", F.col("fingerprint").alias("f"), F.col("n_rows").alias("n")).join(now, "name", "full")
    reason = F.when(F.col("n").isNull(), "new").when(F.col("n_rows").isNull(), "gone").when((F.col("n") != F.col("n_rows")) | (F.col("f") != F.col("fingerprint")), "different")
    return both.select("name", reason.alias("reason")).where("reason IS NOT NULL")
