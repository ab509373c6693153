"""Corpus operators against brute force, exact round trips and held-out labels."""

import base64
import hashlib
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weftline.llm import best_fit, bpe, common, exact_dedup, jpeg, langid, licenses, line_dedup, packed_ids, queries, simhash, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")

LONG = "lorem ipsum dolor sit amet " * 4000
ODD = ["", " ", "\n\n", "  a  b ", "a \n\n b's  IT's", "x\x1c y", "é́ K İ ΣΑΣ. ½. ⅷ. a½.", "日本語 テスト 😀 😀😀", "a\xa0b\x85c", "<|endoftext|> x", "z" * 3000, LONG]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, keep_id string"


def frame(spark, texts, first=0):
    rows = [(first + i, t, "en", "s", len(t or ""), 0.5, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def odd_frame(spark):
    """Nulls in every column, repeated rows, odd and long texts, extra columns whose names clash."""
    docs = frame(spark, [*ODD, None])
    extra = spark.createDataFrame([(None, None, None, None, None, None, None), (None, "a b c d", "en", None, 1, None, None), (2, "\n\n", "en", "s", 2, 0.5, "clash"), (2, "\n\n", "en", "s", 2, 0.5, "clash")], SCHEMA)
    return docs.unionByName(extra)


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_every_query_takes_odd_and_empty_tables(spark, tmp_path, name):
    for at, docs in (("odd", odd_frame(spark)), ("empty", odd_frame(spark).limit(0))):
        path = f"file://{tmp_path}/{at}"
        docs.write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([(1, 0, 0), (None, None, None), (3, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        rows = queries.QUERIES[name](spark, path).collect()
        if at == "empty":
            assert rows == []
        elif name not in ("op4_best_fit_packing", "op5_packed_ids"):
            assert len(rows) == docs.count()


def test_byte_bpe_equals_tiktoken_and_round_trips(spark, sf_dir):
    tiktoken = pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = documents(spark, sf_dir).select("doc_id", "text").unionByName(odd_frame(spark).select("doc_id", "text"))
    for text, ids, decoded in docs.join(bpe.bpe_round_trip(docs.dropDuplicates(["doc_id"]), path, public_tokenizers.PATTERN), "doc_id").where("doc_id > 20").select("text", "token_ids", "decoded").collect():
        assert np.frombuffer(ids, dtype="<u4").tolist() == known.encode_ordinary(text)
        assert decoded == text.encode()
    coder = bpe.ByteBPE(path, public_tokenizers.PATTERN)
    for text in ODD:
        ids = coder.encode([text])[0]
        assert np.frombuffer(ids, dtype="<u4").tolist() == known.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(5000)]
    hashed = bpe.MinimalPerfectHash(keys)
    assert sorted(hashed(keys).tolist()) == list(range(5000))
    assert [hashed.one(k) for k in keys[:500]] == hashed(keys[:500]).tolist()


def brute_line_components(texts, threshold=line_dedup.THRESHOLD):
    lines = sorted({line_dedup.normal_line(x) for t in texts for x in (t or "").split("\n")} - {""})
    width = line_dedup.SHINGLE
    sets = [{x[i : i + width] for i in range(max(1, len(x) - width + 1))} for x in lines]
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (x, a), (y, b) in combinations(zip(lines, sets, strict=True), 2):
        if len(a & b) >= threshold * len(a | b):
            root[find(x)] = find(y)
    return {x: find(x) for x in lines}


def brute_line_dedup(docs):
    """docs: (doc_id, text). The text that is left of each."""
    roots = brute_line_components([t for _, t in docs])
    first = {}
    for place in sorted(((d is None, d or 0), n, i) for i, (d, t) in enumerate(docs) for n, _ in enumerate((t or "").split("\n"))):
        normal = line_dedup.normal_line((docs[place[2]][1] or "").split("\n")[place[1]])
        if normal:
            first.setdefault(roots[normal], (place[2], place[1]))
    stay = set(first.values())
    return [None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) in stay or not x.strip()) for i, (_, t) in enumerate(docs)]


def test_line_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(400)]
    base = [" ".join(rng.choice(words, 40)) for _ in range(12)]
    texts = []
    for _ in range(90):
        lines = []
        for _ in range(rng.integers(1, 5)):
            own = str(rng.choice(base)).split() if rng.random() < 0.6 else list(rng.choice(words, rng.integers(1, 30)))
            for _ in range(rng.integers(0, 3)):
                own[rng.integers(len(own))] = str(rng.choice(words))
            lines.append(" ".join(own))
        texts.append("\n".join(lines))
    texts += ["", None, "one line\n\nOne   LINE\nanother", "x", "x"]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_line_dedup(list(enumerate(texts)))


def test_line_dedup_joins_large_buckets(spark):
    """More lines in a bucket than get all their pairs."""
    rng = np.random.default_rng(6)
    base = ["w%d" % i for i in range(60)]
    texts = []
    for _ in range(60):
        own = list(base)
        for i in rng.choice(60, rng.integers(0, 3), replace=False):
            own[i] = "x%d" % rng.integers(1000)
        texts.append(" ".join(own))
    docs = frame(spark, texts)
    _, roots = line_dedup.line_components(docs, all_pairs=2)
    found = defaultdict(set)
    for node, root in roots.collect():
        found[root].add(node)
    expected = defaultdict(set)
    for line, root in brute_line_components(texts).items():
        expected[root].add(line_dedup.line_id(line))
    assert sorted(map(sorted, found.values())) == sorted(sorted(x) for x in expected.values() if len(x) > 1)


@pytest.mark.parametrize("block_shingles", [500, 1 << 20])
def test_line_dedup_joins_large_buckets_exactly(spark, block_shingles):
    """Buckets of families whose lines are near only some of the others, in one block and in many."""
    rng = np.random.default_rng(6)
    texts = []
    for _ in range(120):
        own = ["w%d" % i for i in range(60)]
        for i in rng.choice(60, rng.integers(0, 7), replace=False):
            own[i] = "x%d" % rng.integers(1000)
        texts.append(" ".join(own))
    lines = sorted(set(texts))
    ids = [line_dedup.line_id(x) for x in lines]
    sets = [{x[i : i + 8] for i in range(len(x) - 7)} for x in lines]
    # one bucket that holds all lines, each a component of its own
    members = spark.createDataFrame([(1, i, i) for i in ids], "band long, id long, root long")
    frame_of = spark.createDataFrame(list(zip(ids, lines, strict=True)), "id long, line string")
    links = line_dedup._bucket_links(members, frame_of, 0.8, block_shingles).collect()
    near = {frozenset((ids[i], ids[j])) for i, j in combinations(range(len(lines)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert {frozenset(x) for x in links} <= near
    found = spark.createDataFrame([tuple(x) for x in near], "a long, b long")
    expected = common.connected_components(found, "a", "b").collect()
    got = common.connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    assert sorted(got) == sorted(expected) and len({r["root"] for r in got}) < len(got)


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    votes = Counter(b for g in grams for b in range(64) if xxhash.xxh64_intdigest(g, 42) >> b & 1)
    return sum(1 << b for b, n in votes.items() if 2 * n > len(grams))


def brute_components(values, ids, radius=3):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(values)), 2):
        if (values[i] ^ values[j]).bit_count() <= radius:
            root[find(i)] = find(j)
    least = {}
    for i, doc in enumerate(ids):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) for i in range(len(ids))]


def test_simhash_equals_brute_force(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text").limit(1000).unionByName(odd_frame(spark).select("doc_id", "text"))
    rows = docs.collect()
    prints = [brute_fingerprint(t) for _, t in rows]
    expected = sorted(zip([str(r[0]) for r in rows], [f"{p:016x}" for p in prints], map(str, brute_components(prints, [r[0] for r in rows])), strict=True))
    got = sorted((str(r[0]), r[1], str(r[2])) for r in simhash.simhash_components(docs).collect())
    assert got == expected


@pytest.mark.parametrize("limit", [4096, 8])
def test_bk_links_connect_all_near_fingerprints(spark, limit):
    rng = np.random.default_rng(7)
    values = set(rng.integers(-(2**63), 2**63 - 1, 300).tolist())
    for v in rng.choice(list(values), 30).tolist():
        for _ in range(12):
            x = v & (1 << 64) - 1
            for b in rng.choice(64, rng.integers(1, 6), replace=False).tolist():
                x ^= 1 << b
            values.add(x - (1 << 64) if x >> 63 else x)
    values = sorted(values)
    found = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), bucket_limit=limit)
    roots = dict(common.connected_components(found, "a", "b").collect())
    expected = brute_components([v & (1 << 64) - 1 for v in values], values)
    assert [roots.get(v, v) for v in values] == expected


def test_one_document_stays_of_each_group(spark):
    words = [f"word{i}" for i in range(300)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(reversed(words)), "short one", "short one", None, ""]
    kept = simhash.keep_one_per_component(frame(spark, texts)).select("doc_id").collect()
    prints = [brute_fingerprint(t) for t in texts]
    assert sorted(r[0] for r in kept) == sorted(set(brute_components(prints, list(range(len(texts))))))


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(5, 5)]
    roots = dict(common.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    assert set(roots[i] for i in range(100, 161)) == {100} and set(roots[i] for i in range(200, 260)) == {7} and 5 not in roots


def test_join_by_skewed_key_loses_nothing(spark):
    left = common.materialize(spark.range(6000).select("id", F.when(F.col("id") < 4000, 1).when(F.col("id") < 4010, None).otherwise(F.col("id")).alias("k")), "t")
    right = spark.range(0, 6000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).unionByName(spark.createDataFrame([(1, -1)], "k long, v long"))
    plain = sorted(map(str, left.join(right, "k", "left").select("id", "k", "v").collect()))
    assert sorted(map(str, common.join_by_skewed_key(left, right, "k").select("id", "k", "v").collect())) == plain


def test_packing_is_whole_gapless_and_tight(spark, sf_dir):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    known.encode_special_tokens = True
    docs = documents(spark, sf_dir).select("doc_id", "text").unionByName(frame(spark, [*ODD, None], 10_000).select("doc_id", "text"))
    rows = best_fit.best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    pieces = {(r["doc_id"], r["piece"]): r for r in rows}
    assert len(pieces) == len(rows)
    total = 0
    for doc, text in docs.collect():
        ids = [*known.encode(text or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        for k, low in enumerate(range(0, len(ids), 4096)):
            part, r = ids[low : low + 4096], pieces.pop((doc, k))
            assert (r["start"], r["length"], r["ids_crc32"]) == (low, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()))
    assert not pieces
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= -(-total // 4096) + 1


@pytest.mark.parametrize("seed", range(6))
def test_packing_plan_uses_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(64, rng.geometric(rng.choice([0.02, 0.1, 0.3]), 500)) if seed else np.array([], dtype=int)
    packing = best_fit.plan(dict(Counter(lengths.tolist())), 64)
    used = Counter()
    for combo, times in packing:
        assert sum(combo) <= 64 and times > 0
        for x in combo:
            used[x] += times
    assert used == Counter(lengths.tolist())
    best = len(packed_ids.best_fit_decreasing(lengths.tolist(), 64))
    assert sum(t for _, t in packing) <= best + 1


@pytest.mark.parametrize("seed", range(4))
def test_segment_tree_finds_the_best_fit(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 101, 300).tolist()
    bins, free = [], []
    for i in sorted(range(300), key=lambda i: -lengths[i]):
        fits = [f for f in free if f >= lengths[i]]
        if fits:
            at = max(k for k, f in enumerate(free) if f == min(fits))
        else:
            at = len(bins)
            bins.append([])
            free.append(100)
        bins[at].append(i)
        free[at] -= lengths[i]
    got = packed_ids.best_fit_decreasing(lengths, 100)
    assert sorted(i for b in got for i in b) == list(range(300)) and all(sum(lengths[i] for i in b) <= 100 for b in got)
    assert len(got) == len(bins)


def test_packed_ids_are_lossless(spark, sf_dir, tmp_path):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    known.encode_special_tokens = True
    docs = documents(spark, sf_dir).select("doc_id", "text").unionByName(frame(spark, [*ODD, None], 10_000).select("doc_id", "text"))
    rows = packed_ids.write_packed(docs, public_tokenizers.path("word_bpe_49k.json"), f"file://{tmp_path}/packed", capacity=512, shard_tokens=20_000).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    parts = {}
    for r in rows:
        ids = np.frombuffer(r["ids"], dtype="<u2")
        assert len(ids) == 512 and r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"] and r["position_resets"] == r["cu_seqlens"][:-1]
        assert (ids[r["n_tokens"] :] == 49407).all()
        for doc, piece, a, z in zip(r["doc_ids"], r["pieces"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False):
            parts[doc, piece] = ids[a:z].tolist()
    for doc, text in docs.collect():
        whole = [*known.encode(text or "", add_special_tokens=False).ids, 49407]
        assert [x for k in range(-(-len(whole) // 512)) for x in parts.pop((doc, k))] == whole
    assert not parts


def same(spark, query, sql, path):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet{'/*.parquet' if 'tmp' in path else ''}'")
    expected = con.sql(sql).fetchall()
    columns = [c[0] for c in con.sql(sql).description]
    got = [tuple(r) for r in query.select(columns).collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected))


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_sql_twins(spark, sf_dir, tmp_path, name):
    same(spark, queries.QUERIES[name](spark, sf_dir), queries.ORACLE_SQL[name], sf_dir)
    odd = odd_frame(spark).where("doc_id is not null").distinct()
    texts = ["Released Under-the MIT License!", "CC by\nNC cc_by_nc", "the apache license; version 2. under the mit license", "All  Rights\nReserved", "K mİt license under the mit license", "free of charge to any person obtaining a copy of this software permission is hereby"]
    odd.unionByName(frame(spark, texts, 500)).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    same(spark, queries.QUERIES[name](spark, f"file://{tmp_path}"), queries.ORACLE_SQL[name], str(tmp_path))


def test_frequent_texts_take_the_map_side(spark):
    texts = ["hot  text"] * 300 + ["hot\ttext  "] * 200 + [f"own {i // 2}" for i in range(400)]
    rows = {r["doc_id"]: r for r in exact_dedup.exact_dedup(frame(spark, texts), support=0.05).collect()}
    assert rows[3]["keep_id"] == 300 and rows[3]["group_size"] == 500 and rows[300]["kept"] and not rows[3]["kept"]
    assert rows[501]["keep_id"] == 500 and rows[501]["group_size"] == 2
    assert rows[0]["text_sha256"] == hashlib.sha256(b"hottext").hexdigest()


def test_toxicity_on_held_out_labels(spark):
    path = "/root/testdata/sf0.1"
    got = queries.op7_toxicity(spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id")
    held = got.where("held_out").select("predicted", "toxic", "score").collect()
    toxic, flagged = [r for r in held if r["toxic"] == 1], [r for r in held if r["predicted"] == 1]
    assert sum(r["predicted"] for r in toxic) >= 0.9 * len(toxic) and sum(r["toxic"] for r in flagged) >= 0.9 * len(flagged)


def test_unseen_misspellings_share_subwords():
    clean = [Counter(f"the {w} is nice today".split()) for w in ("cat", "dog", "sun", "garden", "river", "music") * 5]
    toxic = [Counter(f"the {w} is an idiot today".split()) for w in ("cat", "dog", "sun", "garden", "river", "music") * 5]
    model = toxicity.fit(clean + toxic, [0] * 30 + [1] * 30)
    idiott, music, idi0t = model.of_words(["idiott", "music", "idi0t"])
    assert idiott > music + 1 and idi0t != 0


def test_language_on_held_out_documents(spark):
    path = "/root/testdata/sf0.01"
    rows = queries.op10_language_id(spark, path).join(documents(spark, path).select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.98 * len(rows)


def test_backoff_goes_to_shorter_grams():
    model = langid.Model([("a", 0, "known", 5), ("b", 1, "k", 1), ("a", 2, "un", 3), ("b", 2, "xx", 3), ("a", 1, "u", 1)], 2)
    logs, known = model.of_words(["known", "uns", "kz", "zzz"])
    assert logs[:3].argmax(axis=1).tolist() == [0, 0, 1] and known.tolist() == [True, True, True, False]
    assert not logs[3].any()


def test_jpeg_container_round_trip():
    rng = np.random.default_rng(1)
    payloads = [rng.integers(0, 256, 64 * n, dtype=np.uint8).tobytes() for n in (1, 2, 9, 70)] + [bytes(64), b"\xff" * 640, bytes(64 * (jpeg.MAX_ROWS + 3))]
    media = jpeg.store(payloads)
    for payload, data, frames in zip(payloads, media, jpeg.thumbnails(media), strict=True):
        assert b"".join(g.tobytes() for g in frames) == payload
        first = jpeg.parse(data)[0]
        if len(payload) < 5000:  # the general reader agrees with the lockstep one
            assert (jpeg._scan_by_block(data, first)[1] + 128 == frames[0]).all()


def test_media_columns_reads_other_baseline_files(spark):
    """A file with two components, AC coefficients and no restarts, coded by hand."""
    bits, symbols = (0, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0), (0, 3, 1)
    ac_bits, ac_symbols = (0, 2, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0), (0, 0x12)
    size = jpeg._segment(0xC0, bytes([8, 0, 16, 0, 16, 2, 1, 0x21, 0, 2, 0x11, 0]))
    tables = jpeg._segment(0xC4, bytes([0x00, *bits, *symbols, 0x10, *ac_bits, *ac_symbols]))
    head = b"\xff\xd8" + jpeg._segment(0xDB, bytes([0] + [16] * 64)) + size + tables + jpeg._segment(0xDA, bytes([2, 1, 0, 2, 0, 0, 63, 0]))
    # per MCU: two luminance blocks (+5, with one AC pair; then 0) and one chroma block (-1)
    stream = ("01" + "101" + "01" + "10" + "00") + ("00" + "00") + ("10" + "0" + "00")
    stream += ("10" + "1" + "00") + ("00" + "00") + ("00" + "00")
    stream += "1" * (-len(stream) % 8)
    data = head + int(stream, 2).to_bytes(len(stream) // 8, "big") + b"\xff\xd9"
    rows = jpeg.media_columns(spark.createDataFrame([(1, data), (2, b"nothing"), (3, None)], "id long, image binary"), "id", "image").orderBy("id").collect()
    assert (rows[0]["width"], rows[0]["height"]) == (16, 16)
    assert list(rows[0]["thumbnail"]) == [138, 138, 140, 140]
    assert rows[1]["width"] is None and rows[2]["thumbnail"] is None


def test_needed_tokens_and_flat_thumbnails():
    assert jpeg.feature([np.zeros((3, 64), dtype=np.uint8)]).startswith("512x24:" + "0" * 16)
    assert licenses.needed_tokens(5) == 4 and licenses.needed_tokens(3) == 3


def test_license_score_does_not_depend_on_position(spark):
    passages = ["all rights are hereby reserved", "all of the rights reserved", "all rights not expressly granted reserved"]
    texts = [(f"{i}-{k}", "word " * k + p + " word") for i, p in enumerate(passages) for k in range(7)]
    rows = licenses.scan_licenses(spark.createDataFrame(texts, "doc_id string, text string")).collect()
    assert {(r["labels"], r["score"]) for r in rows} == {("all-rights-reserved", 1.0)} and len(rows) == 21


def test_small_shards_are_searched_by_trees(monkeypatch):
    """A shard of three or more builds a tree, whose edge rule passes over children."""
    rng = np.random.default_rng(3)
    values = rng.integers(0, 2**64, 400, dtype=np.uint64).tolist()
    values += [v ^ 1 << int(b) for v, b in zip(values[:40], rng.integers(0, 64, 40), strict=True)]
    built = []
    add = simhash.BKTree.add
    monkeypatch.setattr(simhash.BKTree, "add", lambda self, value: (built.append(value), add(self, value))[1])
    links = simhash.forest(values)
    assert len(built) == len(values) and len(links) == 40
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for v in values[:60]:
        assert sorted(tree.near(v)) == [i for i, x in enumerate(values) if (x ^ v).bit_count() <= 3]


def test_shards_share_one_block():
    assert len(simhash.block_masks()) == 4 and all(m.bit_count() == 16 for m in simhash.block_masks())
    for bits in combinations(range(0, 64, 7), 3):  # three differing bits leave a block alone
        assert any(not any(m >> b & 1 for b in bits) for m in simhash.block_masks())


def test_license_filters_pass_over_blocks(spark):
    """Whole texts match wherever they stand; lookalikes that lack the rarest tokens are cut before any intersection."""
    whole = " ".join(licenses.TEMPLATES[-2][0].split())
    texts = [f"intro words {whole} more", whole.upper().replace(" ", ", "), " ".join(whole.split()[::2]), "the license the software the " * 30]
    rows = {r["doc_id"]: r for r in licenses.scan_licenses(frame(spark, texts)).collect()}
    assert "apache-2" in rows[0]["labels"] and rows[0]["score"] == 1.0 and rows[1]["score"] == 1.0
    assert rows[3]["labels"] == "" and rows[3]["score"] == 0.0
    tokens = list(dict.fromkeys(whole.split()))
    sql = licenses._matching_scores(tokens)
    words = spark.createDataFrame([(whole.split(),), (tokens[licenses.LOOK + len(tokens) - licenses.needed_tokens(len(tokens)) + 1 :],), ([],)], "words array<string>")
    assert [bool(r[0]) for r in words.select(F.expr(sql)).collect()] == [True, False, False]


def test_media_columns_of_the_query(spark, tmp_path):
    """Every column of the query, recomputed from the texts and from the stored bytes."""
    docs = frame(spark, [*ODD, None, "x" * 64, "y" * 63])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op8_jpeg_media(spark, f"file://{tmp_path}").collect()}
    for doc, text in docs.select("doc_id", "text").collect():
        raw = (text or "").encode()
        payload = raw + bytes(64 * max(1, -(-len(raw) // 64)) - len(raw))
        media = jpeg.store([payload])[0]
        frames = next(iter(jpeg.thumbnails([media])))
        r = got[doc]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(b"".join(f.tobytes() for f in frames)).hexdigest() == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        assert r["feature"] == jpeg.feature(frames) and media[:2] == b"\xff\xd8" and media[-2:] == b"\xff\xd9"


def test_feature_sees_the_whole_thumbnail():
    rng = np.random.default_rng(5)
    plain = rng.integers(0, 256, (64, 64), dtype=np.uint8)
    for row, column in ((0, 0), (31, 20), (63, 63)):
        other = plain.copy()
        other[row, column] ^= 255
        assert jpeg.feature([other]) != jpeg.feature([plain])


def plain_subwords(word):
    marked = f"<{word}>"
    return [marked] + [marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1) if n < len(marked)]


def test_toxicity_score_equals_a_plain_loop(spark, sf_dir):
    words = ["idiot", "a", "ab", "straße", "日本語", "x" * 50, "é"]
    places, owner = toxicity.subwords(words)
    for i, word in enumerate(words):  # as many places as subwords, equal ones for equal strings
        assert (owner == i).sum() == len(plain_subwords(word))
    one, _ = toxicity.subwords(["xidiotx"])
    assert len(set(one.tolist()) & set(places[owner == 0].tolist())) >= 6
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), queries.id_crc() % 5 != 0)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    for doc, text in docs.select("doc_id", "text").limit(50).collect():
        own = toxicity.bag(text or "")
        total = sum(k * float(np.mean(model.weights[toxicity.subwords([w])[0]])) for w, k in own.items())
        logit = model.bias + total / max(1, sum(own.values()))
        assert np.isclose(got[doc], 1 / (1 + np.exp(-logit)), atol=1e-5)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_toxicity_recall_and_precision(spark, sf):
    path = f"/root/testdata/{sf}"
    got = queries.op7_toxicity(spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").select("predicted", "toxic").collect()
    toxic, flagged = [r for r in got if r["toxic"] == 1], [r for r in got if r["predicted"] == 1]
    assert sum(r["predicted"] for r in toxic) >= 0.9 * len(toxic) and sum(r["toxic"] for r in flagged) >= 0.9 * len(flagged)


def test_language_score_equals_a_plain_loop(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = langid.train(docs, queries.id_crc() % 3 != 1)
    by_hash = [dict(zip(h.tolist(), r.tolist(), strict=True)) for h, r in model.grams]

    def plain(word):
        if word in model.words:
            return model.logs[model.words[word]].astype(float)
        for n in range(model.longest, 0, -1):
            hashes = [int(langid.gram_hashes(*langid.spelt([g]), n)[0][0]) for g in langid.grams(word, n)]
            known = [by_hash[n - 1][h] for h in hashes if h in by_hash[n - 1]]
            if known:
                return model.logs[known].astype(float).sum(axis=0) / len(known)
        return np.zeros(len(model.langs))

    texts = docs.select("doc_id", "text").limit(25).unionByName(frame(spark, [t for t in ODD if len(t) < 4000], 10_000).select("doc_id", "text"))
    got = {r["doc_id"]: r for r in langid.identify(texts, model).collect()}
    for doc, text in texts.collect():
        found = [w for w in langid._WORD.findall(text.lower())]
        if not any(map(str.isalpha, text)):
            assert got[doc]["lang_pred"] == "und" and got[doc]["score"] == 0
            continue
        pieces = sum(any(map(str.isalpha, p)) for p in text.split())
        total = sum(map(plain, found), np.zeros(len(model.langs))) / pieces**0.5
        weights = np.exp(total - total.max())
        assert got[doc]["lang_pred"] == model.langs[int(weights.argmax())]
        assert np.isclose(got[doc]["score"], weights.max() / weights.sum(), rtol=1e-3)


def test_sample_by_hash_is_bounded(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 100 == 0, "rare").otherwise("hot").alias("g"), "id")
    got = common.first_by_hash(rows, "g", "id", 300).collect()
    by = Counter(r["g"] for r in got)
    assert by == {"hot": 300, "rare": 200}
    hashes = {r["id"]: r["h"] for r in rows.where("g = 'hot'").select("id", F.xxhash64("id").alias("h")).collect()}
    assert all(abs(hashes[r["id"]]) < 2**63 * 600 / 19_800 for r in got if r["g"] == "hot")


@pytest.mark.parametrize("held", [4, 1 << 20])
def test_long_buckets_are_proposed_in_parts(spark, monkeypatch, held):
    monkeypatch.setattr(line_dedup, "HELD_IDS", held)
    rows = spark.createDataFrame([(7, i) for i in range(30)] + [(8, 100), (8, 101), (9, 200)], "band long, id long").repartition(3)
    found = line_dedup._proposals(rows, 8).collect()
    roots = dict(common.connected_components(spark.createDataFrame([(r["a"], r["b"]) for r in found if r["kind"] == 0], "a long, b long"), "a", "b").collect())
    assert {roots[i] for i in range(30)} == {0} and roots[101] == 100 and 200 not in roots
    assert {r["b"] for r in found if r["kind"] == 1 and r["a"] == 7} == set(range(30))


def test_all_similar_lines_of_a_table_meet(spark):
    """Recall on whole tables: every pair of lines of similarity 0.8 or more, counted by postings, ends in one component."""
    docs = documents(spark, "/root/testdata/sf0.01")
    lines = sorted({line_dedup.normal_line(x) for r in docs.select("text").collect() for x in (r[0] or "").split("\n")} - {""})
    sets = [{x[i : i + line_dedup.SHINGLE] for i in range(max(1, len(x) - line_dedup.SHINGLE + 1))} for x in lines]
    postings = defaultdict(list)
    for i, own in enumerate(sets):
        for shingle in own:
            postings[shingle].append(i)
    postings, sizes = {k: np.array(v) for k, v in postings.items()}, np.array([len(x) for x in sets])
    _, roots = line_dedup.line_components(docs)
    root = dict(roots.collect())
    ids = [line_dedup.line_id(x) for x in lines]
    pairs = 0
    for i, own in enumerate(sets):
        common = np.bincount(np.concatenate([postings[x] for x in own]), minlength=len(sets))
        for j in np.flatnonzero(common >= 0.8 * (sizes + sizes[i] - common)).tolist():
            if j > i:
                pairs += 1
                assert root[ids[i]] == root[ids[j]]
    assert pairs > 100
