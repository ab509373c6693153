"""The pipeline against the same stages done by brute force."""

from collections import defaultdict

import corpus_pipeline
import numpy as np
from test_corpus_operators import brute_components, brute_fingerprint, brute_line_dedup

from weftline.llm import langid, toxicity
from weftline.llm.queries import id_crc


def test_pipeline_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 120")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, docs, sf_dir)
    assert kept.columns == columns and kept.count() == docs.count()
    clean = stages["toxicity"](spark, kept, sf_dir)
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    left = {r["doc_id"] for r in clean.collect()}
    unharmed = [d in left for d, t in labels.items() if t == 0 and d < 120]
    assert sum(unharmed) >= 0.8 * len(unharmed)  # the smallest table labels too few documents to learn from
    rows = sorted((r["doc_id"], r["text"]) for r in clean.collect())
    lined = stages["line_dedup"](spark, clean, sf_dir)
    got = sorted((r["doc_id"], r["text"], r["n_chars"]) for r in lined.collect())
    expected = brute_line_dedup(rows)
    assert got == [(d, t, len(t)) for (d, _), t in zip(rows, expected, strict=True)]
    near = sorted(r["doc_id"] for r in stages["simhash_near_dedup"](spark, lined, sf_dir).collect())
    assert near == sorted(set(brute_components([brute_fingerprint(t) for t in expected], [d for d, _ in rows])))


def test_run_packs_what_is_left(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert rows and all(sum(x for _, x in own) <= 4096 for own in places.values())


def test_documents_without_a_letter_go(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.train(docs, id_crc() % 3 != 1)
    odd = spark.createDataFrame([(1, "123 456 !!", "en"), (2, None, "en"), (3, "the thing", "en")], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in langid.identify(odd, model).orderBy("doc_id").collect()] == ["und", "und", "en"]
    assert np.isclose(toxicity.fit([], []).bias, np.log(1e-9 / (1 + 1e-9)))


def odd_documents(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns whose names the stages use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, Lang_Pred string, toxicity double, kept string, fp long, c0 string, `a.b` int, __keep int"
    long = "the quick brown fox\n" * 3000
    texts = ["the cat and the dog", "the cat and the dog", None, "", " \n ", "12 34", "日本語 テスト", "idiot moron the", long, "der hund und die katze"]
    rows = [(i, t, "en" if t and t.isascii() else None, "s", len(t or ""), 0.5, "x", 0.9, "k", 7, "c", 1, 2) for i, t in enumerate(texts)]
    rows += [rows[0], rows[8], (None, "the cat and the dog", None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, schema)


def test_stages_take_odd_clashing_and_empty_tables(spark, tmp_path):
    docs = odd_documents(spark)
    spark.createDataFrame([(7, 0, 1), (0, 1, 0), (9, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            rows = stage(spark, table, f"file://{tmp_path}")
            got = rows.collect()
            if name != "best_fit_packing":
                assert rows.columns == docs.columns and rows.schema.simpleString() == docs.schema.simpleString()
            if table is not docs:
                assert got == []
            elif name == "language_id":
                assert {r["doc_id"] for r in got} >= {0, 1, 8} and not {r["doc_id"] for r in got} & {2, 3, 4, 5}
                assert sum(r["doc_id"] == 0 for r in got) == 2  # repeated rows stay repeated
            elif name == "line_dedup":
                assert len(got) == docs.count()
                text = {r["doc_id"]: r["text"] for r in got}
                assert text[0] == "the cat and the dog" and text[1] == "" and text[2] is None and text[8].count("fox") == 1
            elif name == "simhash_near_dedup":
                assert 0 in {r["doc_id"] for r in got} and 1 not in {r["doc_id"] for r in got}
            elif name == "best_fit_packing":
                assert len({(r["doc_id"], r["piece"]) for r in got}) >= 10
            else:
                assert 0 in {r["doc_id"] for r in got}


def test_texts_of_which_nothing_is_known_go(spark, tmp_path):
    rows = [(i, "the cat and the dog", "en") for i in range(12)] + [(100, "一丁丂", None)]
    kept = corpus_pipeline.language_id(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), str(tmp_path))
    assert {r["doc_id"] for r in kept.collect()} == set(range(12))
