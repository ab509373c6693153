"""Operators on small fixtures with values worked out by hand or by plain Python."""

import math
import time
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import columns as C
from weftline.functions import texts
from weftline.operators import basket, evidence, graph, profiles, similarity, stats
from weftline.sources import io
from weftline.streaming.pairs import windowed_counts


def test_hypergeometric_tail_equals_exact_integers():
    for pool, marked, drawn in ((100, 2, 2), (30, 12, 7), (9, 9, 4), (50, 3, 48)):
        for k in range(drawn + 2):
            exact = sum(math.comb(marked, x) * math.comb(pool - marked, drawn - x) for x in range(max(k, 0), min(marked, drawn) + 1) if 0 <= drawn - x <= pool - marked) / math.comb(pool, drawn)
            assert stats.hypergeometric_tail(k, pool, marked, drawn) == pytest.approx(exact, abs=1e-12)


def test_enrichment_of_two_targets(spark):
    sets = [("P35354", "A"), ("P35354", "B"), ("P12345", "A"), ("P12345", "C"), ("Q67890", "B")] + [(f"g{i}", "rest") for i in range(97)]
    members = spark.createDataFrame([("q", "P35354"), ("q", "P12345"), ("none", "ABSENT")], "entity string, gene string")
    rows = {r["pathway"]: r for r in profiles.enrichment(members, spark.createDataFrame(sets, "gene string, pathway string"), "entity", "gene", "pathway").collect()}
    assert rows["A"]["p"] == pytest.approx(1 / 4950) and rows["A"]["fold"] == pytest.approx(50) and set(rows) == {"A", "B", "C"}
    assert rows["A"]["q"] == pytest.approx(3 / 4950)


def test_t_distribution():
    assert stats.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert stats.t_two_sided(12.706, 1) == pytest.approx(0.05, abs=1e-4)
    assert stats.t_two_sided(0, 5) == 1.0 and stats.t_two_sided(1.96, 1e6) == pytest.approx(0.05, abs=1e-3)


def test_normal_p(spark):
    row = spark.createDataFrame([(1.959964,), (0.0,)], "z double").select(stats.normal_p(F.col("z")).alias("p")).collect()
    assert row[0]["p"] == pytest.approx(0.05, abs=1e-6) and row[1]["p"] == 1.0


def test_bh_is_monotone_and_null_is_one(spark):
    rows = stats.benjamini_hochberg(spark.createDataFrame([(1, 0.001), (2, 0.04), (3, 0.03), (4, None)], "id int, p double"), "p", ["id"]).orderBy("id").collect()
    assert [round(r["q"], 6) for r in rows] == [0.004, 0.053333, 0.053333, 1.0]


def test_isotonic():
    assert stats.isotonic([(1, 1, 1), (2, 3, 1), (3, 2, 1), (4, 5, 2)]) == [(1, 1), (2, 2.5), (3, 2.5), (4, 5)]


def test_pathway_permutation_reaches_a_thousandth(spark):
    sets = spark.createDataFrame([(i, "strong" if i < 5 else "weak" if i < 10 else "rest") for i in range(200)], "g int, p string")
    members = spark.createDataFrame([("e", i, 1.0) for i in range(5)] + [("e", i, 0.0) for i in range(5, 10)] + [("e", 20, 1.0)], "e string, g int, w double")
    rows = {r["p"]: r for r in stats.pathway_permutation_p(members, sets.withColumnRenamed("p", "path"), "e", "g", "path", "w").withColumnRenamed("p", "value").withColumnRenamed("path", "p").collect()}
    assert rows["strong"]["value"] == 0.001 and rows["strong"]["observed"] == 5.0 and rows["weak"]["value"] == 1.0 and set(rows) == {"strong", "weak"}


def test_pathway_permutation_costs_what_the_own_genes_do(spark):
    reps, size = 20_000, 400
    for n, k, seen in ((40, 12, 3), (90, 30, 9), (150, 12, 5)):  # ones: the sum over k places is hypergeometric; the last by whole shuffles
        tail = sum(math.comb(n, x) * math.comb(size - n, k - x) for x in range(seen, k + 1)) / math.comb(size, k)
        flat, starts = np.concatenate([np.arange(k), np.arange(n - k, n)]), np.array([0, k])
        got = stats._shuffled_hits(np.random.default_rng(1), np.ones(n), size, flat, starts, np.array([seen, seen]), reps) / reps
        assert got == pytest.approx([tail, tail], abs=5 * math.sqrt(tail / reps))
    w = np.arange(8.0)  # which weights land where: the mean of a place's weight is that of all
    hits = stats._shuffled_hits(np.random.default_rng(2), w, 64, np.arange(8), np.arange(8), np.full(8, 7.0), 64_000)
    assert hits == pytest.approx(np.full(8, 1000), abs=160)

    sets = spark.range(2_000_000).select(F.col("id").alias("g"), (F.col("id") % 4).cast("string").alias("path"))
    members = spark.range(160).select((F.col("id") % 8).alias("e"), F.col("id").alias("g"), F.lit(1.0).alias("w"))
    began = time.perf_counter()
    rows = stats.pathway_permutation_p(members, sets, "e", "g", "path", "w").collect()
    assert time.perf_counter() - began < 60  # 8 x 999 shuffles of two million weights took minutes
    assert len(rows) == 8 and {(r["overlap"], r["observed"], r["p"]) for r in rows} == {(20, 20.0, 0.001)}


@pytest.mark.parametrize(("ic", "cg", "shared", "passes"), [(60_000, 56, 32, True), (1000, 0, 5, True), (50_000, 88, 0, False), (1980, 480, 20, True), (50_000, 0, 30, True)])
def test_overlap_gate(spark, ic, cg, shared, passes):
    a = spark.range(ic + shared).select(F.col("id").alias("k"))
    b = spark.range(shared).select(F.col("id").alias("k")).unionByName(spark.range(10**6, 10**6 + cg).select(F.col("id").alias("k")))
    row = evidence.key_overlap(a, b, "k").first()
    assert row["n_overlap"] == shared and row["passes"] is passes


def test_noisy_or_clips_and_takes_one(spark):
    frame = spark.createDataFrame([("a", 0.5), ("a", 0.5), ("b", 1.0), ("b", 0.2), ("c", 7.0), ("d", None)], "k string, w double")
    assert dict(frame.groupBy("k").agg(evidence.noisy_or(F.col("w"))).collect()) == {"a": 0.75, "b": 1.0, "c": 1.0, "d": 0.0}


def test_triplets_count_repeats_once(spark):
    rows = [(b, i) for b in range(4) for i in "xyz"] + [(0, "x"), (9, "w")]
    items = basket.distinct_items(spark.createDataFrame(rows, "b int, i string"), "b", "i")
    (row,) = basket.triplets(items, 2).collect()
    assert row["support"] == 4 and row["lift"] == pytest.approx(4 * 25 / 64)


def test_tanimoto_and_ties(spark):
    bits = spark.createDataFrame([(1, [1, 1, 0, 1, 0]), (2, [1, 0, 1, 1, 0]), (3, [0] * 5)], "id int, vec array<int>")
    rows = similarity.top_neighbours(bits, bits, 2, bits=True, block=1).orderBy("query", "rank").collect()
    assert [(r["query"], r["neighbour"], r["similarity"]) for r in rows[:2]] == [(1, 2, 0.5), (1, 3, 0.0)]


def test_pagerank_and_walk_equal_matrices(spark):
    edges = [(0, 1), (0, 2), (1, 2), (2, 0), (3, 2), (2, 4)]
    m = np.zeros((5, 5))
    for a, b in edges:
        m[b, a] = 1 / sum(x == a for x, _ in edges)
    m[:, 4] = 0.2
    r = np.full(5, 0.2)
    for _ in range(10):
        r = 0.15 / 5 + 0.85 * m @ r
    got = dict(graph.pagerank(spark.createDataFrame(edges, "u int, v int"), "u", "v").collect())
    assert [got[i] for i in range(5)] == pytest.approx(r.tolist())

    a = np.array([[1, 1, 0], [0, 1, 1]], dtype=float)  # left by right
    across, back = a / a.sum(1, keepdims=True), (a / a.sum(0)).T
    x = s = np.array([1.0, 0.0])
    for _ in range(12):
        x = 0.8 * (x @ across @ back) + 0.2 * s
    links = spark.createDataFrame([(i, j) for i in range(2) for j in range(3) if a[i, j]], "l int, r int")
    walk = graph.random_walk(links, "l", "r", spark.createDataFrame([("s", 0)], "seed string, l int"))
    got = {r["r"]: r["score"] for r in walk.collect()}
    assert [got.get(j, 0.0) for j in range(3)] == pytest.approx((x @ across).tolist())


def test_pagerank_needs_few_rounds(spark, monkeypatch):
    rng = np.random.default_rng(8)
    edges = {(int(a), int(b)) for a, b in zip(rng.integers(0, 60, 500), rng.integers(0, 75, 500), strict=True)}  # 60 to 74 have no links of their own
    edges |= {(0, i) for i in range(75)}
    m = np.full((75, 75), 1 / 75)
    for a in {a for a, _ in edges}:
        m[:, a] = [((a, b) in edges) / sum(x == a for x, _ in edges) for b in range(75)]
    r = np.linalg.solve(np.eye(75) - 0.85 * m, np.full(75, 0.15 / 75))
    cuts, cut = [], graph.cut
    monkeypatch.setattr(graph, "FAN", 8)  # node 0 has its links in several lists
    monkeypatch.setattr(graph, "cut", lambda f: cuts.append(1) or cut(f))
    got = dict(graph.pagerank(spark.createDataFrame(sorted(edges), "u int, v int"), "u", "v", tol=1e-6).collect())
    assert sum(abs(got[i] - r[i]) for i in range(75)) < 5e-7 and len(cuts) <= 3 + 2 * 20


def test_pagerank_and_walk_converge(spark):
    pairs = [(0, i) for i in range(1, 5)] + [(i, i + 4) for i in range(1, 5)]
    m = np.zeros((9, 9))
    for a, b in pairs:
        m[a, b] = m[b, a] = 1
    r = np.linalg.solve(np.eye(9) - 0.85 * m / m.sum(0), np.full(9, 0.15 / 9))
    links = graph.both_ways(spark.createDataFrame(pairs, "u int, v int"))
    got = dict(graph.pagerank(links, "u", "v", tol=1e-6).collect())
    assert [got[i] for i in range(9)] == pytest.approx(r.tolist(), abs=1e-6)

    n = 24
    a = np.eye(n) + np.eye(n, k=1)
    a[-1, 0] = 1  # a ring: the far side is twelve steps away
    across, back = a / a.sum(1, keepdims=True), (a / a.sum(0)).T
    x = s = np.eye(n)[0]
    for _ in range(50):
        x = 0.8 * (x @ across @ back) + 0.2 * s
    links = spark.createDataFrame([(i, j) for i in range(n) for j in range(n) if a[i, j]], "l int, r int")
    walk = graph.random_walk(links, "l", "r", spark.createDataFrame([("s", 0)], "seed string, l int"), times=50, tol=1e-6)
    got = {w["r"]: w["score"] for w in walk.collect()}
    assert [got.get(j, 0.0) for j in range(n)] == pytest.approx((x @ across).tolist(), abs=1e-5)


def test_laplacian_equals_matrix(spark):
    w = np.array([[1, 0.5, 0], [0.5, 1, 0.2], [0, 0.2, 1]])
    x = np.array([1.0, 0.0, 4.0])
    for _ in range(2):
        x = x - 0.2 * (np.diag(w.sum(1)) - w) @ x
    similar = spark.createDataFrame([(i, j, float(w[i, j])) for i in range(3) for j in range(3) if i != j and w[i, j]], "a int, b int, weight double")
    got = dict(graph.laplacian_smooth(spark.createDataFrame([(0, 1.0), (1, 0.0), (2, 4.0)], "node int, score double"), similar).collect())
    assert [got[i] for i in range(3)] == pytest.approx(x.tolist())


def test_components_of_random_graph(spark):
    rng = np.random.default_rng(3)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 60, (35, 2))]
    root = list(range(60))
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = dict(graph.components(graph.undirected(spark.createDataFrame(edges, "a int, b int"), "a", "b")).collect())
    assert all(got[n] == root[n] for n in got) and len(got) == len({n for a, b in edges if a != b for n in (a, b)})


def test_components_of_a_long_path(spark):
    path = [0, *range(100, 0, -1)]
    links = spark.createDataFrame(list(zip(path, path[1:], strict=False)), "a int, b int")
    got = dict(graph.components(graph.undirected(links, "a", "b")).collect())
    assert got == dict.fromkeys(path, 0)


def test_names_units_and_bands(spark):
    row = spark.range(1).select(
        C.canonical_id(F.lit(" 42 "), "ING_", digits=6), C.canonical_id(F.lit("ING_7"), "ING_", digits=6), C.canonical_id(F.lit("a b!c"), "GENE_"),
        texts.singular_last(F.lit("red berries")), texts.singular_last(F.lit("dishes")), texts.singular_token(F.lit("leaves")), C.affinity_nm(F.lit(">1,200.5")), C.affinity_nm(F.lit("x")),
        C.similarity_band(F.lit(1.0)), C.tier(F.lit(0.1)), C.interpolated(F.lit(0.45), [(0.3, 0.1), (0.6, 0.4)]), texts.lipid_like(F.lit("CE(18:1)")) & ~texts.lipid_like(F.lit("cer(1)")) & ~texts.lipid_like(F.lit("pc(1)")),
    ).first()
    assert list(row[:10]) == ["ING_000042", "ING_7", "GENE_a_bc", "red berry", "dish", "leaf", 1200.5, None, 0.9, "withheld"]
    assert row[10] == pytest.approx(0.25) and row[11]


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("# source: here\na,b\n1,x\n")
    (tmp_path / "o.obo").write_text("format: 1\n\n[Term]\nid: G:1\nname: one\nis_a: G:2 ! two\nsubset: slim\n\n[Term]\nid: G:2\nname: two\n")
    assert io.read_any(spark, str(tmp_path / "t.csv"), ["b"]).collect()[0][0] == "x"
    terms = {r["id"]: r for r in io.read_ontology(spark, str(tmp_path / "o.obo")).collect()}
    assert terms["G:1"]["parents"] == ["G:2"] and terms["G:1"]["subsets"] == ["slim"] and terms["G:2"]["parents"] == []
    io.write_table(spark.range(3), str(tmp_path / "out.parquet"))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        io.write_table(spark.range(3), str(tmp_path / "out.parquet"))
    assert io.table_fingerprint(io.read_any(spark, str(tmp_path / "out.parquet"))).first() == io.table_fingerprint(spark.range(3)).first()
    with pytest.raises(ValueError, match="null ids"):
        io.graph_csv(spark.createDataFrame([(None, "x")], "node_id string, label string"), spark.createDataFrame([], "source_id string, target_id string, edge_type string"), str(tmp_path / "g"))


def test_stream_equals_table(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    query.processAllAvailable()
    query.stop()
    clean = lambda frame: sorted((str(r["start"]), r["event_type"], r["n"]) for r in frame.collect())
    assert clean(spark.table("counts")) == clean(windowed_counts(events))


def test_pair_tables_are_symmetric_in_their_sides(spark):
    rows = [(b, i) for b, own in enumerate(["abc", "ab", "bc", "d"]) for i in own]
    items = basket.distinct_items(spark.createDataFrame(rows, "b int, i string"), "b", "i")
    for r in basket.pair_scores(items).collect():
        assert r["item_a"] < r["item_b"] and 0 < r["jaccard"] <= r["overlap"] <= 1
    assert basket.pair_counts(items).count() == len({p for own in ["abc", "ab", "bc"] for p in combinations(own, 2)})
