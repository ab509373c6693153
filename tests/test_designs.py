"""Statistics, graphs and resolution against plain Python and numpy."""

import itertools
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import designs, graph, identity, mediation, models, profiles, similarity, stats, surface, themes
from weftline.plans import catalogue


def test_t_and_normal_tails_equal_tables(spark):
    known = [(2.0, 10.0, 0.07338803), (12.706, 1.0, 0.05000080), (0.0, 5.0, 1.0), (-2.228, 10.0, 0.05001177)]
    rows = spark.createDataFrame([(t, df) for t, df, _ in known] + [(None, 3.0), (1.0, 0.0)], "t double, df double")
    got = [r[0] for r in rows.select(stats.t_p(F.col("t"), F.col("df"))).collect()]
    assert got[:4] == pytest.approx([p for *_, p in known], abs=1e-6) and got[4] is None and got[5] is None
    z = [0.0, 1.0, -2.5, None]
    both = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(stats.normal_p(F.col("z"))).collect()]
    assert both[:3] == pytest.approx([math.erfc(abs(x) / math.sqrt(2)) for x in z[:3]]) and both[3] is None
    up = spark.createDataFrame([(1.0,), (-1.0,)], "z double").select(stats.normal_tail(F.col("z"), 1)).collect()
    assert sum(r[0] for r in up) == pytest.approx(1)


def test_hypergeometric_column_takes_nulls_and_repeats(spark):
    rows = spark.createDataFrame([(2, 100, 2, 2), (2, 100, 2, 2), (None, 5, 2, 2)], "k long, pool long, marked long, drawn long")
    got = [r[0] for r in rows.select(stats.hypergeometric_p(*[F.col(c) for c in rows.columns])).collect()]
    assert got[0] == got[1] == pytest.approx(1 / 4950) and got[2] is None


def test_q_values_by_ranges_equal_numpy(spark):
    rng = np.random.default_rng(2)
    p = [*np.round(rng.random(500) ** 2, 3).tolist(), None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i long, p double")
    got = {r["i"]: r["q"] for r in stats.benjamini_hochberg(rows, "p", ["i"]).collect()}
    flat = np.array([1.0 if x is None else x for x in p])
    order = np.lexsort((np.arange(len(p)), flat))
    ratio = flat[order] * len(p) / np.arange(1, len(p) + 1)
    q = np.minimum(1, np.minimum.accumulate(ratio[::-1])[::-1])
    assert [got[i] for i in order.tolist()] == pytest.approx(q.tolist())
    assert stats.benjamini_hochberg(rows.limit(0), "p", ["i"]).collect() == []


def test_ranks_and_quantiles_by_ranges(spark):
    rng = np.random.default_rng(4)
    rows = [(g, float(x)) for g, n in (("a", 301), ("b", 4), ("c", 1)) for x in np.round(rng.normal(size=n), 2)]
    frame = spark.createDataFrame([*rows, ("a", None)], "g string, x double")
    got = {r["g"]: (r["p1"], r["p5"], r["p9"]) for r in stats.quantiles(frame, ["g"], "x", [0.1, 0.5, 0.99], ["p1", "p5", "p9"]).collect()}
    for g in "abc":
        assert got[g] == pytest.approx(np.percentile([x for k, x in rows if k == g], [10, 50, 99]).tolist())
    placed = stats.ranked(spark.createDataFrame([(x,) for _, x in rows], "x double"), ["x"]).select("x", "__rank", "__n").collect()
    assert sorted(r["__rank"] for r in placed) == list(range(1, len(rows) + 1)) and {r["__n"] for r in placed} == {len(rows)}
    assert [r["x"] for r in sorted(placed, key=lambda r: r["__rank"])] == sorted(x for _, x in rows)


def test_regression_equals_numpy(spark):
    rng = np.random.default_rng(6)
    rows = [("g", float(a), float(b), float(1 + 2 * a - b + 3 * a * b + rng.normal()), float(a * b)) for a, b in rng.integers(0, 2, (200, 2))]
    got = designs.regression(spark.createDataFrame(rows, "g string, a double, b double, y double, ab double"), ["g"], ["a", "b"], "y", "ab").first()
    x = np.array([[1, a, b, ab] for _, a, b, _, ab in rows])
    y = np.array([r[3] for r in rows])
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ y
    e = y - x @ beta
    h = np.einsum("ij,jk,ik->i", x, inverse, x)
    hc3 = inverse @ (x.T * (e / (1 - h)) ** 2) @ x @ inverse
    assert got["beta"] == pytest.approx(beta[3]) and got["se"] == pytest.approx(math.sqrt(e @ e / 196 * inverse[3, 3])) and got["se_hc3"] == pytest.approx(math.sqrt(hc3[3, 3]))
    assert got["p"] == pytest.approx(stats.t_two_sided(got["t"], 196)) and got["n"] == 200


def test_paired_design_finds_a_shift(spark):
    rng = np.random.default_rng(0)
    rows = [tuple(float(x) for x in r) for r in rng.normal(size=(100, 4)) + np.array([0.5, 0, 0, 0]) * 2]
    got = designs.paired_did(spark.createDataFrame(rows, "ab double, a double, b double, none double").withColumn("g", F.lit(1)), ["g"], "ab", "a", "b", "none").first()
    assert got["p"] <= 0.05 and got["n"] == 100


def test_greedy_matching_equals_a_plain_loop(spark):
    rng = np.random.default_rng(1)
    groups = ["ab", "a", "b", "none"]
    rows = [("s", i, groups[int(rng.integers(4))], float(rng.integers(9)), float(rng.integers(9))) for i in range(120)]
    got = sorted(tuple(r) for r in designs.matched(spark.createDataFrame(rows, "s string, k long, g string, x double, y double"), ["s"], "k", "g", ["x", "y"], near=10).collect())
    pool, used, expected = [r for r in rows if r[2] != "ab"], set(), []
    for _, k, g, x, y in rows:
        if g == "ab":
            near = sorted(pool, key=lambda r: ((r[3] - x) ** 2 + (r[4] - y) ** 2, r[1]))[:10]
            found = [next((r[1] for r in near if r[2] == w and r[1] not in used), None) for w in groups[1:]]
            if None not in found:
                used.update(found)
                expected.append(("s", k, *found))
    assert got == sorted(expected) and expected


def test_shuffles_keep_margins_and_bootstrap_brackets(spark):
    rng = np.random.default_rng(3)
    rows = [("g", i, int(a), int(b), float(rng.normal() + 4 * a * b)) for i, (a, b) in enumerate(rng.integers(0, 2, (400, 2)))]
    frame = spark.createDataFrame(rows, "g string, i long, a int, b int, y double")
    null = designs.null_did(frame, ["g"], "a", "b", "y", "i", 5).first()
    assert null["n"] == 400 and abs(null["did"]) < 2
    boot = designs.bootstrap_did(frame, ["g"], "a", "b", "y", 200).first()
    assert boot["low"] < boot["did"] < boot["high"] and boot["p"] == pytest.approx(2 / 201) and boot["stability"] == 1
    assert designs.bootstrap_did(frame, ["g"], "a", "b", "y", 200).first() == boot


def test_split_keeps_groups_whole_and_skips(spark):
    groups = spark.createDataFrame([("a", 6), ("b", 5), ("c", 3), ("d", 1), ("e", 1)], "g string, n long")
    assert dict(designs.greedy_split(groups, "g", "n", 0.65).select("g", "split").collect()) == {"a": "train", "b": "test", "c": "train", "d": "train", "e": "test"}


def test_bins_gate_and_relaxation(spark):
    rows = spark.createDataFrame([(float(i),) for i in range(80)] + [(None,)], "x double")
    assert dict(designs.quantile_bins(rows, "x", 8).groupBy("bin").count().collect()) == {-1: 1, 0: 20, 1: 10, 2: 10, 3: 10, 4: 10, 5: 20}
    flat = spark.createDataFrame([(1.0,)] * 5, "x double")
    assert designs.quantile_bins(flat, "x", 8).select("bin").distinct().collect()[0][0] == 0
    pairs = spark.range(10)
    assert {r["rule"] for r in designs.relaxed(pairs, F.col("id") > 8, F.col("id") > 5, 3).collect()} == {"relaxed"}


def test_calibration_and_logistic():
    assert designs.scaled([(0.3, 0.2), (0.5, 0.6), (0.7, 0.4)], 0.8, 0.4) == [(0.3, 0.1), (0.5, 0.25), (0.7, 0.25)]
    slope, at = designs.logistic([(x, 1 / (1 + math.exp(-(3 * x - 1))), 10.0) for x in (0.1, 0.4, 0.7, 0.9)])
    assert (slope, at) == pytest.approx((3, -1), abs=1e-4)


def mediation_rows(spark, targets):
    atlas = spark.createDataFrame([("ING_A", "ING_B", "CAT_cat1", 0.1)], "a string, b string, category string, did double")
    edges = [("INT_AB", "ING_A", "HAS_INGREDIENT"), ("INT_AB", "CAT_cat1", "AFFECTS"), ("ING_A", "CMP_1", "HAS_COMPOUND"), ("ING_B", "CMP_1", "HAS_COMPOUND"), ("CMP_1", "GENE_X", "TARGETS")]
    table = None if targets is None else spark.createDataFrame(targets, "compound string, target string")
    return mediation.features(atlas, spark.createDataFrame(edges, "source_id string, target_id string, edge_type string"), targets=table).collect()


@pytest.mark.parametrize("targets", [None, [], [("CMP_1", "T1"), ("CMP_1", "T2")]])
def test_mediation_features_of_one_pair(spark, targets):
    (row,) = mediation_rows(spark, targets)
    assert (row["shared_compounds"], row["shared_genes"], row["shared_pathways"]) == (1, 1, 0) and row["mediation_confidence"] == pytest.approx(0.3)
    assert (row["target_count"], row["target_overlap"]) == ((2, 2) if targets else (0, 0))


def test_mediation_falls_back_to_the_category(spark):
    atlas = spark.createDataFrame([("A", "B", "C")], "a string, b string, category string")
    edges = spark.createDataFrame([("A", "c", "HAS_COMPOUND"), ("P1", "C", "MAPS_TO_CATEGORY"), ("P2", "C", "MAPS_TO_CATEGORY")], "source_id string, target_id string, edge_type string")
    row = mediation.features(atlas, edges).first()
    assert row["shared_pathways"] == 2 and row["mediated_path_score"] == 2 and row["mediation_confidence"] == pytest.approx(0.4)


def test_text_ids_and_chains(spark):
    links = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y")], "p string, q string")
    assert dict(graph.components(graph.undirected(links, "p", "q")).collect()) == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    chain = spark.createDataFrame([(f"n{i:02d}", f"n{i - 1:02d}") for i in range(1, 31)], "c string, p string")
    paths = {r["node"]: r["path"] for r in graph.ancestor_paths(chain, "c", "p").collect()}
    assert len(paths) == 31 and len(paths["n30"]) == 31 and paths["n30"][-1] == "n00"
    slim = spark.createDataFrame([("n10", 0), ("n20", 1)], "node string, priority int")
    got = dict(graph.nearest_slim(graph.ancestor_paths(chain, "c", "p"), slim).collect())
    assert got["n25"] == "n20" and got["n12"] == "n10" and got["n05"] == "n02" and got["n01"] == "n01"


def test_betweenness_eigenvector_and_labels(spark):
    path = graph.undirected(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "p string, q string"), "p", "q")
    assert dict(graph.betweenness(path).collect()) == pytest.approx({"a": 0, "b": 2 / 3, "c": 2 / 3, "d": 0})
    star = spark.createDataFrame([(0, i) for i in range(1, 5)] + [(1, 2)], "u int, v int")
    m = np.zeros((5, 5))
    for u, v in [(0, 1), (0, 2), (0, 3), (0, 4), (1, 2)]:
        m[u, v] = m[v, u] = 1
    values, vectors = np.linalg.eigh(m)
    got = dict(graph.eigenvector(star, 1e-9).collect())
    assert [got[i] for i in range(5)] == pytest.approx(np.abs(vectors[:, values.argmax()]).tolist(), abs=1e-5)
    two = [(a, b) for lot in ((0, 1, 2, 3), (10, 11, 12, 13)) for a, b in itertools.combinations(lot, 2)] + [(3, 10)]
    labels = dict(graph.label_propagation(spark.createDataFrame(two, "u int, v int")).collect())
    assert {labels[i] for i in range(4)} == {0} and len({labels[i] for i in range(10, 14)}) == 1


def test_walks_follow_edges_and_metrics_equal_plain_python(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 0), (0, 2)], "u int, v int")
    near = {(u, v) for a, b in [(0, 1), (1, 2), (2, 3), (3, 0), (0, 2)] for u, v in ((a, b), (b, a))}
    walks = similarity.random_walks(edges, 6, 2).collect()
    assert len(walks) == 8 and all(len(w["path"]) == 6 and all(e in near for e in itertools.pairwise(w["path"])) for w in walks)
    rng = np.random.default_rng(9)
    rows = [(int(rng.integers(5)), i, float(s), int(rng.random() < s)) for i, s in enumerate(rng.permutation(60) / 60)]
    got = similarity.link_metrics(spark.createDataFrame(rows, "source int, target int, score double, truth int"), (1,)).first()
    pos, neg = [r[2] for r in rows if r[3]], [r[2] for r in rows if not r[3]]
    assert got["roc_auc"] == pytest.approx(np.mean([p > n for p in pos for n in neg]))
    ordered = [r[3] for r in sorted(rows, key=lambda r: -r[2])]
    assert got["average_precision"] == pytest.approx(np.mean([sum(ordered[: i + 1]) / (i + 1) for i, t in enumerate(ordered) if t]))
    assert got["hits_at_1"] == pytest.approx(np.mean([max((r[2], r[3]) for r in rows if r[0] == s)[1] for s in {r[0] for r in rows}]))


def test_neighbours_of_null_vectors_and_blocks(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(99, None), (98, [0.0] * 6)]
    frame = spark.createDataFrame(rows, "id long, vec array<double>")
    got = similarity.top_neighbours(frame, frame, 3, block=7, query_block=5).orderBy("query", "rank").collect()
    assert {r["query"] for r in got} == {*range(40), 98}
    for i in range(40):
        sim = x @ x[i] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[i])
        sim[i] = -9
        best = [j for j in np.argsort(-sim, kind="stable").tolist() if sim[j] > 0][:3]
        assert [r["neighbour"] for r in got if r["query"] == i][: len(best)] == best


def test_resolution_and_links(spark):
    names = spark.createDataFrame([("Turmeric",), ("turmeric root",), ("Black Pepper",)], "name string")
    q = spark.createDataFrame([("Turmeric",), ("TURMERIC",), ("pepper",), ("ab",), ("zzz",)], "query string")
    got = {r["query"]: (r["found"], r["level"]) for r in surface.resolve(q, names).collect()}
    assert got == {"Turmeric": ("Turmeric", "exact"), "TURMERIC": ("Turmeric", "case"), "pepper": ("Black Pepper", "part"), "ab": (None, None), "zzz": (None, None)}
    rng = np.random.default_rng(12)
    words = ["".join(rng.choice(list("abc"), rng.integers(1, 9))) for _ in range(150)]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = list(itertools.accumulate(zip(row, row[1:], b, strict=False), lambda left, t: min(left + 1, t[1] + 1, t[0] + (x != t[2])), initial=i))
        return row[-1]

    left, right = sorted(set(words[:75])), sorted(set(words[75:]))
    got = {r["name"]: (r["best"], r["ratio"]) for r in identity.best_link(spark.createDataFrame([(w,) for w in left], "name string"), spark.createDataFrame([(w,) for w in right], "name string"), 0.6).collect()}
    for w in left:
        ratio, best = min((-(1 - edits(w, r) / max(len(w), len(r))), r) for r in right)
        assert (w in got) == (-ratio >= 0.6)
        if w in got:
            assert got[w] == (best, pytest.approx(-ratio))


def test_normal_enrichment_and_null_share(spark):
    members = spark.createDataFrame([("e", f"g{i}", 0.5, i % 2 == 0) for i in range(6)], "entity string, gene string, confidence double, measured boolean")
    sets = spark.createDataFrame([(f"g{i}", "p" if i < 4 else "q") for i in range(20)], "gene string, pathway string")
    row = profiles.weighted_enrichment(members, sets).where("pathway = 'p'").first()
    mu, var = 3.0 * 4 / 20, 4 * 0.25 + 3.0 * 4 / 20 * (1 - 4 / 20)
    assert row["p_normal"] == pytest.approx(0.5 * math.erfc((2.0 - mu) / math.sqrt(var) / math.sqrt(2)))
    assert [d["gene"] for d in row["drivers"]] == ["g0", "g1", "g2", "g3"] and row["n_measured"] == 2
    null = profiles.null_calibration(members, sets, 0.1, 3, 1).first()
    assert null["entities"] == 1 and 0 <= null["share_significant"] <= 1


def test_models_on_clear_cases(spark):
    rng = np.random.default_rng(5)
    cloud = [(float(c + rng.normal() / 20), float(c + rng.normal() / 20)) for c in (0, 5, 10) for _ in range(20)]
    rows = {r["k"]: r for r in models.cluster_choice(spark.createDataFrame(cloud, "x double, y double"), ["x", "y"], range(2, 6)).collect()}
    assert rows[3]["chosen"] and rows[3]["verdict"] == "clear" and sum(r["chosen"] for r in rows.values()) == 1
    xs = [(i, float(x), float(z), 3.0 if x > 0.5 else 0.0) for i, (x, z) in enumerate(rng.random((300, 2)))]
    got = dict(models.boosted_regression(spark.createDataFrame(xs, "i long, x double, z double, y double"), "i", ["x", "z"], "y").collect())
    assert got["r2"] > 0.8 and got["importance_x"] > got["importance_z"]
    items = spark.createDataFrame([(i, [f"w{j}" for j in rng.integers(0, 9, 4)]) for i in range(30)], "i long, items array<string>")
    v = np.array([r["vector"] for r in models.hashed_embedding(items, "i", "items", 32, 3).collect()])
    assert v.shape == (30, 3) and np.allclose(v.mean(axis=0), 0, atol=1e-9) and np.allclose(v.std(axis=0, ddof=1), 1)


def test_grid_sample_and_mediation_bootstrap(spark):
    rows = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(60)], "i long, c string")
    got = designs.grid_sample(rows, ["c"], "i", 4, 20, 1).collect()
    assert len(got) == 20 and sum(r["how"] == "grid" for r in got) == 12 and len({r["i"] for r in got}) == 20
    assert {r["i"] for r in designs.grid_sample(rows, ["c"], "i", 4, 20, 1).collect()} == {r["i"] for r in got}
    assert designs.grid_sample(rows, ["c"], "i", 4, 5, 1).count() == 12
    rng = np.random.default_rng(2)
    x = rng.normal(size=400)
    m = 2 * x + rng.normal(size=400)
    y = 3 * m + x + rng.normal(size=400)
    table = spark.createDataFrame([("g", i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, m, y, strict=True))] + [("h", 1, 1.0, 1.0, 1.0)], "g string, i long, x double, m double, y double")
    got = {r["g"]: r for r in designs.mediation_bootstrap(table, ["g"], "i", "x", "m", "y", 100).collect()}
    assert got["g"]["low"] < 6 < got["g"]["high"] and abs(got["g"]["indirect"] - 6) < 1 and got["g"]["p"] == 0
    assert "h" not in got or got["h"]["indirect"] is None


def test_distances_of_a_path(spark):
    path = graph.undirected(spark.createDataFrame([("a", "b"), ("b", "c")], "p string, q string"), "p", "q")
    row = graph.distances(path).first()
    assert row["mean_distance"] == pytest.approx(8 / 6) and row["diameter"] == 2 and row["n_pairs"] == 6


def test_type_cosines_meet_all_pairs_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(themes, "BLOCK", 8)  # many blocks, some empty
    rng = np.random.default_rng(4)
    rows = [(e, k, d, float(rng.normal())) for e in range(40) for k in ([0, 1] if e == 7 else [None] if e == 9 else [e % 3]) for d in rng.choice(900, 400, replace=False).tolist()]
    rows += [(41, 0, -1, 1.0), (42, 1, None, 1.0), (43, 1, -2, 0.0)]  # dimensions of its own, none, and no norm
    own, norm = {}, {}
    for e, k, d, v in rows:
        norm[e, k] = norm.get((e, k), 0.0) + v * v
        if d is not None:
            own.setdefault(e, {}).setdefault(d, []).append(v)
    expected = {"within": [], "across": []}
    for (a, k), x in norm.items():
        for (b, m), y in norm.items():
            if a < b and x and y:
                dot = sum(sum(v) * sum(own[b][d]) for d, v in own.get(a, {}).items() if d in own.get(b, {}))
                expected["within" if k is not None and k == m else "across"].append(dot / math.sqrt(x * y))
    frame = spark.createDataFrame(rows, "e int, k int, d int, v double")
    got = {r["scope"]: tuple(r)[1:] for r in themes.type_cosines(frame, "e", "k", "d", "v").collect()}
    assert set(got) == set(expected)
    for scope, c in expected.items():
        assert got[scope] == pytest.approx((len(c), sum(c) / len(c), min(c), max(c)))


def test_expanded_edges_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(identity, "BLOCK", 3)
    rng = np.random.default_rng(5)
    parts = [(i, "ab"[i % 2], None if i == 4 else i % 3) for i in range(30)] + [(6, "a", 0), (7, "a", 0), (7, "a", 0), (None, "a", 0)]  # a row twice, a key in two groups
    edges = [(int(c), int(g)) for c, g in rng.integers(0, [33, 12], (150, 2))] + [(3, 5)] * 3 + [(None, 1), (2, None), (2, None), (40, None)]
    found = {}
    for c, g in edges:
        found.setdefault((c, g), []).append("direct")
    for p, *x in parts:
        for q, *y in parts:
            if None not in (p, q, *x, *y) and x == y and p != q:
                for c, g in edges:
                    if c == q:
                        found.setdefault((p, g), []).append("by name")
    got = {(r["compound"], r["gene"]): (r["sources"], r["n_sources"], r["support"]) for r in identity.expanded(spark.createDataFrame(edges, "compound long, gene long"), spark.createDataFrame(parts, "compound long, name string, brand long"), ["name", "brand"]).collect()}
    assert got == {k: ("|".join(sorted(set(v))), len(set(v)), len(v)) for k, v in found.items()}


def test_expanded_edges_are_not_grouped_again(spark, sf_dir):
    plan = catalogue.QUERIES["expanded_edges"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    first = plan.split("\n:- ")[1].split("\n+- ")[0]  # the pairs, of which there are most
    assert plan.startswith("Union") and "Generate explode" in first and "Aggregate" not in first.split("Generate explode(genes")[0]


def test_nearest_rows_equal_a_full_sort():
    rng = np.random.default_rng(6)
    x = np.column_stack([rng.integers(0, 7, 4000) * 100.0, rng.integers(0, 900, 4000).astype(float)])  # many ties
    x[::97, 1], x[5, 0], x[6, 0] = np.nan, np.inf, -np.inf
    pool = np.flatnonzero(rng.random(4000) < 0.7)
    for few in (pool, pool[:30]):
        nearest = designs._nearest(x, few, 50)
        for point in x[:300]:
            assert nearest(point).tolist() == few[np.argsort(((x[few] - point) ** 2).sum(axis=1), kind="stable")[:50]].tolist()
    big = np.column_stack([rng.integers(1, 8, 600_000) * 100.0, rng.integers(0, 900_000, 600_000).astype(float)])
    began, nearest = time.perf_counter(), designs._nearest(big, np.arange(600_000), 50)
    for point in big[:5000]:
        nearest(point)
    assert time.perf_counter() - began < 30  # full sorts took minutes


def test_greedy_matching_uses_up_a_pool(spark):
    rng = np.random.default_rng(2)
    rows = [("st"[i % 2], i, ["ab", "a", "b", "none", "other"][int(rng.choice(5, p=[0.4, 0.35, 0.08, 0.12, 0.05]))], float(rng.integers(9)), float(rng.integers(40))) for i in range(900)]
    rows = [(*r[:3], None if r[1] % 50 == 7 else r[3], r[4]) for r in rows] + [("only treated", 901, "ab", 1.0, 1.0), ("only treated", 902, "a", 1.0, 1.0)]
    got = sorted(tuple(r) for r in designs.matched(spark.createDataFrame(rows, "s string, k long, g string, x double, y double"), ["s"], "k", "g", ["x", "y"]).collect())
    expected = []
    for s in "st":
        free = {g: [r for r in rows if r[0] == s and r[2] == g] for g in ("a", "b", "none")}
        treated = [r for r in rows if r[0] == s and r[2] == "ab"]
        n = min(map(len, (treated, *free.values())))
        for _, k, _, x, y in treated[:n]:
            picks = [min(pool, key=lambda r: (None in (x, r[3]), 0 if None in (x, r[3]) else (r[3] - x) ** 2 + (r[4] - y) ** 2, r[1])) for pool in free.values()]
            for pool, pick in zip(free.values(), picks, strict=True):
                pool.remove(pick)
            expected.append((s, k, *(pick[1] for pick in picks)))
        assert len(free["b"]) == 0 and n > 20  # with a bound of 50 near rows some of b stayed free
    assert got == sorted(expected)


@pytest.mark.parametrize("kinds", [1, 3, 1000])
def test_nearest_free_rows_equal_a_full_search(kinds):
    rng = np.random.default_rng(kinds)
    x = rng.integers(0, kinds, (600, 3)).astype(float)
    for value, share in ((np.nan, 0.02), (np.inf, 0.02), (-np.inf, 0.02), (1e300, 0.05)):
        x[rng.random(x.shape) < share] = value
    pool = list(range(0, 600, 2))
    with np.errstate(invalid="ignore", over="ignore"):
        free = designs._Free(x, np.array(pool))
        for point in x[rng.permutation(600)[: len(pool)]]:
            d = ((x[pool] - point) ** 2).sum(axis=1)
            assert free.take(point) == pool.pop(int(np.argsort(d, kind="stable")[0]))
    alike, began = designs._Free(np.zeros((100_000, 2)), np.arange(100_000)), time.perf_counter()
    assert [alike.take(np.zeros(2)) for _ in range(10_000)] == list(range(10_000)) and time.perf_counter() - began < 30
