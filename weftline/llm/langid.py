"""Language identification: known words by per-language log frequency, unseen words by character n-grams.

Training counts words and character n-grams of a bounded sample: at most ``per_language`` documents of each
language, those least by a hash of their id. Where more than ``max_languages`` are labelled, those with most
labelled documents are learned (ties by name). Counting runs on the executors; the driver gets the most frequent
words and n-grams, at most ``max_words`` and, of each length, ``max_grams`` a language. A word outside the
vocabulary is scored by its n-grams of the greatest length, from ``longest`` down to 1, of which any is known.

Defined results: null texts and texts without a letter are ``und`` with score 0; a model without languages
answers ``und``; ties go to the first language in sorted order; repeated rows each get a row; columns beside those
asked for are ignored, whatever their names; very long texts are scored whole. ``known`` counts the words of which
the model knows the word or any n-gram: a text of which it knows nothing gets equal shares for all languages.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import first_by_hash, quoted, sliced
from weftline.llm.grams import gram_hashes, spelt

_WORD = re.compile(r"[^\W\d_]+")
CACHED_PARTS = 100_000  # pieces of text whose sums a task keeps between its slices: some 20 MB


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word between boundary marks (one mark on each side from n = 2 on)."""
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def count_features(texts: DataFrame, longest: int) -> DataFrame:
    """(lang, kind, feature, n): kind 0 words, kind n the n-grams of distinct words weighted by their count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int], Counter] = {}
        for batch in sliced(batches, "text"):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                counts.setdefault((lang, 0), Counter()).update(_WORD.findall((text or "").lower()))
        for (lang, _), words in list(counts.items()):
            for n in range(1, longest + 1):
                own = counts[lang, n] = Counter()
                for word, k in words.items():
                    for g in grams(word, n):
                        own[g] += k
        for (lang, kind), own in counts.items():
            items = list(own.items())
            for low in range(0, len(items), 20_000):
                part = items[low : low + 20_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part)), pa.array([kind] * len(part), pa.int32()), pa.array([w for w, _ in part]), pa.array([k for _, k in part], pa.int64())],
                    ["lang", "kind", "feature", "n"],
                )

    counted = texts.select("lang", "text").mapInArrow(run, "lang string, kind int, feature string, n long")
    return counted.groupBy("lang", "kind", "feature").agg(F.sum("n").alias("n"))


class Model:
    """Log probabilities by language, less those of the best: of words by name, of n-grams by sorted hashes."""

    def __init__(self, rows: list[tuple[str, int, str, int]], longest: int):
        self.langs = sorted({r[0] for r in rows})
        self.longest = longest
        place = {lang: i for i, lang in enumerate(self.langs)}
        self.words: dict[str, int] = {}  # rows of logs
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []  # by length: sorted hashes, rows of logs
        logs: list[np.ndarray] = []
        for kind in range(longest + 1):
            counts: dict[str, np.ndarray] = {}
            for lang, k, feature, n in rows:
                if k == kind:
                    counts.setdefault(feature, np.zeros(len(self.langs)))[place[lang]] += n
            total = sum(counts.values(), np.zeros(len(self.langs)))
            floor = 0.5
            at = len(logs) + np.arange(len(counts))
            if kind:
                hashes, _ = gram_hashes(*spelt(list(counts)), kind)
                order = np.argsort(hashes)
                self.grams.append((hashes[order], at[order]))
            else:
                self.words = dict(zip(counts, at.tolist(), strict=True))
            logs += [np.log((c + floor) / (total + floor * (len(counts) + 1))) for c in counts.values()]
        self.logs = np.array(logs, dtype=np.float32).reshape(len(logs), len(self.langs))
        if len(self.langs):
            self.logs -= self.logs.max(axis=1, keepdims=True)

    def of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihoods of lower-case words by language, less those of the best, and which words are known at all."""
        out = np.zeros((len(words), len(self.langs)), dtype=np.float32)
        known = np.zeros(len(words), dtype=bool)
        step = max(1000, 2_000_000 // max(1, len(self.langs)))
        for low in range(0, len(words), step):
            self._fill(words[low : low + step], out[low : low + step], known[low : low + step])
        return out, known

    def _fill(self, words: list[str], out: np.ndarray, known: np.ndarray) -> None:
        rows = np.fromiter((self.words.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        whole = np.flatnonzero(rows >= 0)
        out[whole], known[whole] = self.logs[rows[whole]], True
        left = np.flatnonzero(rows < 0)
        for n in range(self.longest, 0, -1):
            hashes, places = self.grams[n - 1]
            if not len(left) or not len(hashes):
                continue
            mark = "<" if n > 1 else "", ">" if n > 1 else ""
            own, owner = gram_hashes(*spelt([words[i] for i in left.tolist()], *mark), n)
            at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
            hit = np.flatnonzero(hashes[at] == own)
            if not len(hit):
                continue
            begins = np.concatenate(([0], np.flatnonzero(np.diff(owner[hit])) + 1))
            found = left[owner[hit][begins]]
            sums = np.add.reduceat(self.logs[places[at[hit]]], begins, axis=0)
            out[found] = sums / np.diff(np.append(begins, len(hit)))[:, None].astype(np.float32)
            known[found] = True
            left = left[~known[left]]

    def parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pieces of text without spaces: sums over their words, whether they have a letter, known words."""
        words, owner = [], []
        letters = np.zeros(len(parts), dtype=bool)
        for i, low in enumerate(map(str.lower, parts)):
            if low.isalpha():
                words.append(low)
                owner.append(i)
                letters[i] = True
                continue
            own = _WORD.findall(low)
            words += own
            owner += [i] * len(own)
            letters[i] = any(map(str.isalpha, parts[i]))
        sums, known = np.zeros((len(parts), len(self.langs)), dtype=np.float32), np.zeros(len(parts), dtype=np.int64)
        if words:
            logs, sure = self.of_words(words)
            owner = np.array(owner)
            begins = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1))
            sums[owner[begins]] = np.add.reduceat(logs, begins, axis=0)
            known = np.bincount(owner[sure], minlength=len(parts))
        return sums, letters, known


def train(docs: DataFrame, learnable, per_language: int = 400, max_words: int = 20_000, max_grams: int = 20_000, longest: int = 4, max_languages: int = 200) -> Model:
    """Fit on at most ``per_language`` of the rows of each language where ``learnable`` holds and lang is not null."""
    rows = docs.where(learnable).select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    frequent = rows.groupBy("lang").agg(F.count("*").alias("__n")).orderBy(F.desc("__n"), "lang").limit(max_languages).select("lang")
    ids = first_by_hash(rows.select("lang", "doc_id").join(F.broadcast(frequent), "lang"), "lang", "doc_id", per_language)
    chosen = rows.join(F.broadcast(ids.distinct()), ["doc_id", "lang"])
    counts = count_features(chosen, longest)
    by_count = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "feature")
    kept = counts.withColumn("__r", F.row_number().over(by_count))
    kept = kept.where(F.col("__r") <= F.when(F.col("kind") == 0, max_words).otherwise(max_grams))
    return Model([tuple(r) for r in kept.select("lang", "kind", "feature", "n").collect()], longest)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str, str] = ("lang_pred", "score", "known")) -> DataFrame:
    """Rows of ``docs`` with the language, score (the winner's share of the likelihood, tempered for length) and known words.

    ``keep`` names the columns to carry along (else the id alone), ``names`` the new ones.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    carried = [id_col] if keep is None else keep
    fields = [*carried, text_col]
    plain = [f"c{i}" for i in range(len(carried))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        place: dict[str, int] = {}
        sums = np.zeros((1 << 12, max(1, len(model.langs))), dtype=np.float32)
        letters, known = np.zeros(1 << 12, dtype=bool), np.zeros(1 << 12, dtype=np.int64)
        for batch in sliced(batches, text_field, 1 << 20):
            if len(place) > CACHED_PARTS:
                place.clear()
            split = [(t or "").split() for t in batch.column(text_field).to_pylist()]
            new = list(set().union(*split).difference(place))
            low, high = len(place), len(place) + len(new)
            while high > len(letters):
                sums, letters, known = (np.concatenate((x, np.zeros_like(x))) for x in (sums, letters, known))
            place.update(zip(new, range(low, high), strict=True))
            found, letters[low:high], known[low:high] = model.parts(new)
            sums[low:high, : len(model.langs)] = found
            preds, scores, sure = [], [], []
            for parts in split:
                at = np.array([place[p] for p in parts], dtype=np.int64)
                n = int(letters[at].sum())
                sure.append(int(known[at].sum()))
                if not model.langs or not n:
                    preds.append("und")
                    scores.append(0.0)
                    continue
                total = sums[at].sum(axis=0, dtype=np.float64) / math.sqrt(n)
                weights = np.exp(total - total.max())
                best = int(weights.argmax())
                preds.append(model.langs[best])
                scores.append(float(weights[best] / weights.sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(sure, pa.int64())], schema.names)

    source = docs.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(fields)])
    text_field = f"c{len(carried)}"
    new = [("pred", T.StringType()), ("score", T.DoubleType()), ("known", T.LongType())]
    schema = T.StructType([T.StructField(n, source.schema[n].dataType) for n in plain] + [T.StructField(n, t) for n, t in new])
    return source.mapInArrow(run, schema).toDF(*carried, *names)
