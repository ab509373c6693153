"""Readers and writers on small files."""

from pyspark.sql import functions as F

from weftline.sources import io


def test_csv_with_metadata_round_trip(spark, tmp_path):
    frame = spark.createDataFrame([(1, 'say "x", y', None), (2, "plain", 0.5)], "a int, b string, c double").coalesce(1)
    io.write_csv(frame, str(tmp_path / "t.csv"), {"source": "here", "version": "1"})
    text = next((tmp_path / "t.csv").glob("part-*")).read_text()
    assert text.startswith("# source: here\n# version: 1\na,b,c\n")
    rows = io.read_any(spark, str(tmp_path / "t.csv"), schema="a int, b string, c double").orderBy("a").collect()
    assert rows[1]["c"] == 0.5 and rows[0]["c"] is None and rows[0]["a"] == 1


def test_json_lines_and_index(spark, tmp_path):
    io.write_index(spark.createDataFrame([(1, ["a", "b"])], "k int, v array<string>"), str(tmp_path / "i.json"))
    assert io.read_any(spark, str(tmp_path / "i.json")).first()["v"] == ["a", "b"]


def test_portable_rewrite(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    io.rewrite_portable(spark, str(tmp_path / "in"), str(tmp_path / "out"), 4)
    assert spark.read.parquet(str(tmp_path / "out/parquet")).count() == 10
    assert spark.read.option("header", True).csv(str(tmp_path / "out/csv")).count() == 10


def test_discovery_and_best_source(spark, tmp_path):
    (tmp_path / "b_compounds.csv").write_text("compound_id,name\n1,x\n")
    (tmp_path / "a_genes.csv").write_text("gene_symbol,compound_id\ng,1\n")
    (tmp_path / "z_genes_v2.csv").write_text("gene_symbol,compound_id\ng,1\n")
    assert io.discover(spark, str(tmp_path), ["none*", "*compounds*"]).endswith("b_compounds.csv")
    assert io.discover_all(spark, str(tmp_path), {"x": ["none*"], "y": ["*.csv"]})["x"] is None
    found = io.inventory(spark, str(tmp_path), {"gene": {"gene_symbol"}, "compound": {"compound_id"}})
    assert {r["path"].rsplit("/", 1)[1]: r["kinds"] for r in found.collect()}["b_compounds.csv"] == ["compound"]
    assert io.best_source(found, "gene", ["v2", "genes"]).endswith("z_genes_v2.csv") and io.best_source(found, "none", []) is None


def test_counts_measures_and_matrix(spark, tmp_path):
    (tmp_path / "c.csv").write_text("food,source_type\n1,Compound\n1,Compound\n1,Nutrient\n2,Nutrient\n")
    rows = {r["food"]: (r["Compound"], r["Nutrient"]) for r in io.counts_by_kind(spark, str(tmp_path / "c.csv"), "food", "source_type").collect()}
    assert rows == {"1": (2, 1), "2": (0, 1)}
    wide = spark.createDataFrame([("a", "5", None, " "), ("b", None, None, None), ("c", "1", "2", "3")], "k string, ki string, kd string, ic string")
    got = sorted(tuple(r) for r in io.emit_measures(wide, ["k"], ["ki", "kd", "ic"]).collect())
    assert got == [("a", "ki", "5"), ("c", "ic", "3"), ("c", "kd", "2"), ("c", "ki", "1")]
    (tmp_path / "m.gct").write_text("#1.2\n2\t3\nName\tDescription\tliver\tbrain\tgut\ng1\tx\t5\t0\t7\ng2\ty\t1\t1\tnan\n")
    got = sorted(tuple(r) for r in io.read_matrix(spark, str(tmp_path / "m.gct"), top=1).collect())
    assert got == [("g1", "gut", 7.0), ("g2", "brain", 1.0)]


def test_hierarchy_file_and_parsers(spark, tmp_path):
    (tmp_path / "h.txt").write_text("R-HSA-1\tR-HSA-2\nR-HSA-2\tR-HSA-3\nR-MMU-1\tR-MMU-2\n")
    edges, roots = io.read_hierarchy(spark, str(tmp_path / "h.txt"), "R-HSA-")
    assert edges.count() == 2 and [r[0] for r in roots.collect()] == ["R-HSA-1"]
    usda = spark.createDataFrame([(1, "salt")], "FDC_ID int, description string")
    row = io.parsed(usda, {"food_id": "fdc_id", "name": "description", "group": "category"}, "usda").first()
    assert row.asDict() == {"food_id": 1, "name": "salt", "group": None, "source": "usda"}


def test_recipes_of_several_forms(spark):
    a = spark.createDataFrame([(1, "Salt, pepper ,,salt")], "recipe int, line string")
    b = spark.createDataFrame([(2, '["Egg", "milk"]'), (3, "['rice']"), (4, None)], "recipe int, items string")
    got = sorted(tuple(r) for r in io.recipes([(a, "line", "commas"), (b, "items", "list")]).collect())
    assert got == [("1", "pepper"), ("1", "salt"), ("2", "egg"), ("2", "milk"), ("3", "rice")]


def test_upserts_shards_and_manifests(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "d")], "k int, v string")
    assert sorted(tuple(r) for r in io.upsert(old, new, ["k"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    path = str(tmp_path / "shards")
    rows = spark.range(30).withColumn("shard", (F.col("id") % 3).cast("int"))
    assert io.write_shards(rows.where("shard < 2"), path, "shard") == 2
    assert io.write_shards(rows, path, "shard") == 1 and io.write_shards(rows, path, "shard") == 0
    assert spark.read.parquet(path).count() == 30
    io.write_table(old, str(tmp_path / "t.parquet"))
    before = spark.createDataFrame(io.manifest(spark, {"t": str(tmp_path / "t.parquet")}).collect(), "name string, n_rows long, fingerprint long")
    assert io.changed(before, io.manifest(spark, {"t": str(tmp_path / "t.parquet")})).isEmpty()
    io.write_table(new, str(tmp_path / "t.parquet"), overwrite=True)
    assert [tuple(r) for r in io.changed(before, io.manifest(spark, {"t": str(tmp_path / "t.parquet")})).collect()] == [("t", "different")]
