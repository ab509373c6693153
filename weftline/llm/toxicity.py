"""Toxicity: bags of subword embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its hashed character n-grams (3 to 5, between boundary marks) and of the
word itself; a document is the mean of its words. Embeddings and softmax are fitted together by full-batch Adam
on a bounded sample: at most ``per_class`` labelled documents of each class, those least by a hash of their id.
Only the subwords that tell most about the class are embedded. How many is decided by cross-validation on the
sample, so small samples keep few and large ones many; no fixed bound on the evidence switches subwords off.
The score of a document is linear in its words, so scoring needs one number a word.

Defined results: null and wordless texts get the score of the bias alone; without labels of both classes the
score is the share of toxic labels (0 without labels); repeated rows each get a row; columns beside those asked
for are ignored, whatever their names; texts are scored whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import first_by_hash, quoted, sliced
from weftline.llm.grams import gram_hashes, spelt, word_hashes

_WORD = re.compile(r"[^\W\d_]+")
BITS = 16  # subword buckets: 2**BITS
CACHED_PARTS = 100_000  # pieces of text whose sums a task keeps between its slices: some 20 MB
SIZES = (30, 100, 300, 1000)  # numbers of subwords that cross-validation chooses from


def subwords(words: list[str], low: int = 3, high: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, words): the places of each word and of its character n-grams, by the number of the word."""
    codes, starts, lengths = spelt(words, "<", ">")
    hashes, owners = [word_hashes(codes, starts, lengths)], [np.arange(len(words))]
    for n in range(low, high + 1):
        own, owner = gram_hashes(codes, starts, np.where(lengths > n, lengths, 0), n)
        hashes.append(own)
        owners.append(owner)
    return (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(owners)


def bag(text: str) -> Counter:
    """Lower-case words of a text with their counts."""
    return Counter(_WORD.findall(text.lower()))


class Model:
    """Weights of the subword buckets, folded into one number each: (softmax row 1 - row 0) . embedding."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def of_words(self, words: list[str]) -> np.ndarray:
        """The mean weight of each word's subwords."""
        out = np.zeros(len(words))
        for low in range(0, len(words), 50_000):
            part = words[low : low + 50_000]
            places, owner = subwords(part)
            out[low : low + len(part)] = np.bincount(owner, self.weights[places], len(part)) / np.bincount(owner, minlength=len(part))
        return out

    def parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of pieces of text without spaces: sums over their words, and how many words they have."""
        words, owner = [], []
        for i, low in enumerate(map(str.lower, parts)):
            if low.isalpha():
                words.append(low)
                owner.append(i)
            else:
                own = _WORD.findall(low)
                words += own
                owner += [i] * len(own)
        owner = np.array(owner, dtype=np.int64)
        return np.bincount(owner, self.of_words(words), len(parts)), np.bincount(owner, minlength=len(parts))


def evidence(seen: np.ndarray, clean: float, toxic: float) -> np.ndarray:
    """Log likelihood ratio (G2) of each subword's class shares among its documents against those of the sample."""
    both = seen.sum(axis=0)
    expected = np.stack((both * clean, both * toxic)) / (clean + toxic)
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * np.where(seen > 0, seen * np.log(seen / expected), 0.0).sum(axis=0)


class Sample:
    """Labelled bags: of each document its words and their shares, of each word its subword buckets."""

    def __init__(self, vocabulary: list[str], begins: np.ndarray, word: np.ndarray, count: np.ndarray, labels: list[int], folds: int):
        self.y, self.begins, self.word = np.array(labels, dtype=np.int64), begins, word
        totals = np.maximum(1, np.add.reduceat(np.append(count, 0), begins[:-1]) * (np.diff(begins) > 0))
        self.share = (count / np.repeat(totals, np.diff(begins))).astype(np.float32)
        sizes, lists = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int32)]
        for low in range(0, len(vocabulary), 20_000):
            part = vocabulary[low : low + 20_000]
            places, owner = subwords(part)
            lists.append(places[np.argsort(owner, kind="stable")].astype(np.int32))
            sizes.append(np.bincount(owner, minlength=len(part)))
        self.sizes, self.subs = np.concatenate(sizes), np.concatenate(lists)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.fold = np.zeros(len(self.y), dtype=np.int64)
        for k in (0, 1):  # each class is dealt out evenly
            self.fold[self.y == k] = np.arange((self.y == k).sum()) % folds
        self.seen = np.zeros((folds, 2, 1 << BITS), dtype=np.int32)  # documents with each bucket
        for i in range(len(self.y)):
            self.seen[self.fold[i], self.y[i], np.unique(self.document(i)[0])] += 1

    def document(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The subword buckets of a document, repeats included, and the share of the document that each has."""
        own = slice(self.begins[i], self.begins[i + 1])
        word = self.word[own]
        n = self.sizes[word]
        at = np.repeat(self.starts[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.subs[at], np.repeat(self.share[own] / n, n)

    def telling(self, without: int | None) -> np.ndarray:
        """Buckets by their evidence outside a fold, the most telling first, those that tell nothing left out."""
        use = [f for f in range(len(self.seen)) if f != without]
        n = np.bincount(self.y[np.isin(self.fold, use)], minlength=2)
        told = evidence(self.seen[use].sum(axis=0), float(n[0]), float(n[1]))
        return np.argsort(-told, kind="stable")[: int((told > 1e-9).sum())]

    def matrix(self, buckets: np.ndarray) -> np.ndarray:
        """Dense (documents, buckets) shares."""
        place = np.full(1 << BITS, -1)
        place[buckets] = np.arange(len(buckets))
        out = np.zeros((len(self.y), len(buckets)))
        for i in range(len(self.y)):
            subs, share = self.document(i)
            at = place[subs]
            out[i] = np.bincount(at[at >= 0], share[at >= 0], len(buckets))[: len(buckets)]
        return out


def optimise(x: np.ndarray, y: np.ndarray, dim: int, steps: int, rate: float, scale: float, decay: float, init: float, seed: int) -> tuple[np.ndarray, float]:
    """Joint training of embeddings and softmax; classes weigh the same. The weight of each column, and the bias."""
    rng = np.random.default_rng(seed)
    emb, out, bias = rng.normal(0, init, (x.shape[1], dim)), rng.normal(0, 0.5, (dim, 2)), np.zeros(2)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, len(y) - y.sum()))
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (emb, out, bias)]
    for step in range(1, steps + 1):
        docs = scale * (x @ emb)
        logits = docs @ out + bias
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p *= weight[:, None]
        grads = (scale * (x.T @ (p @ out.T)) + decay * emb, docs.T @ p, p.sum(axis=0))
        for value, grad, (m, v) in zip((emb, out, bias), grads, state, strict=True):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-10)
    return scale * (emb @ (out[:, 1] - out[:, 0])), float(bias[1] - bias[0])


def mistakes(logits: np.ndarray, y: np.ndarray) -> float:
    """Share of wrong answers, both classes weighing the same."""
    wrong = (logits >= 0) != (y == 1)
    return float(np.mean([wrong[y == k].mean() for k in (0, 1) if (y == k).any()]))


def fit(bags: list[Counter], labels: list[int], **params) -> Model:
    """``fit_arrays`` on bags of words."""
    vocabulary: dict[str, int] = {}
    word = np.array([vocabulary.setdefault(w, len(vocabulary)) for own in bags for w in own], dtype=np.int64)
    count = np.array([k for own in bags for k in own.values()], dtype=np.int64)
    begins = np.cumsum([0, *map(len, bags)])
    return fit_arrays(list(vocabulary), begins, word, count, labels, **params)


def fit_arrays(
    vocabulary: list[str], begins: np.ndarray, word: np.ndarray, count: np.ndarray, labels: list[int], dim: int = 4, steps: int = 150, rate: float = 0.1,
    scale: float = 100.0, decay: float = 1e-3, init: float = 0.01, seed: int = 0, sizes: tuple[int, ...] = SIZES, folds: int = 3,
) -> Model:
    """Choose the number of subwords by ``folds``-fold cross-validation, then train on all bags.

    Document i has the words ``word[begins[i] : begins[i + 1]]`` of the vocabulary, as often as ``count`` says.
    """
    y = np.array(labels, dtype=np.int64)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(1 << BITS, dtype=np.float32), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    sample, known = Sample(vocabulary, begins, word, count, labels, folds), dict(dim=dim, steps=steps, rate=rate, scale=scale, decay=decay, init=init, seed=seed)
    wrong = np.zeros(len(sizes))
    for f in range(folds):
        inside = sample.fold != f
        if inside.all() or y[inside].min() == y[inside].max():
            continue
        x = sample.matrix(sample.telling(f)[: max(sizes)])
        for i, size in enumerate(sizes):
            weights, bias = optimise(x[inside, :size], y[inside], **known)
            wrong[i] += mistakes(x[~inside, :size] @ weights + bias, y[~inside])
    best = sample.telling(None)[: sizes[int(wrong.argmin())]]
    own, bias = optimise(sample.matrix(best), y, **known)
    weights = np.zeros(1 << BITS, dtype=np.float32)
    weights[best] = own
    return Model(weights, bias)


def train(docs: DataFrame, labels: DataFrame, learnable: Column, per_class: int = 1500, **params) -> Model:
    """Fit on at most ``per_class`` documents of each class among the labelled rows where ``learnable`` holds.

    The sampled texts are counted on the executors; the driver gets their bags of words.
    """
    known = labels.where(learnable & F.col("toxic").isin(0, 1)).select("doc_id", "toxic")
    ids = first_by_hash(known, "toxic", "doc_id", per_class).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 1 << 20):
            bags = [bag(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), pa.array([list(b) for b in bags], pa.list_(pa.string())), pa.array([list(b.values()) for b in bags], pa.list_(pa.int32()))],
                ["doc_id", "toxic", "words", "counts"],
            )

    kind = {f.name: f.dataType.simpleString() for f in [*docs.schema, *labels.schema] if f.name in ("doc_id", "toxic")}
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "toxic", "text")
    rows = chosen.mapInArrow(run, f"doc_id {kind['doc_id']}, toxic {kind['toxic']}, words array<string>, counts array<int>")
    found = rows.toArrow().sort_by([("doc_id", "ascending"), ("toxic", "ascending")]).combine_chunks()
    words, counts = (found[c].combine_chunks() if found.num_rows else pa.array([], found.schema.field(c).type) for c in ("words", "counts"))
    coded = words.flatten().dictionary_encode()
    begins = np.concatenate(([0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False)))).astype(np.int64)
    model = fit_arrays(coded.dictionary.to_pylist(), begins, coded.indices.to_numpy(), counts.flatten().to_numpy(), found["toxic"].to_pylist(), **params)
    classes = dict(known.groupBy("toxic").count().collect())
    if len(classes) == 2:  # the fit weighs both classes the same; half-way back to how common they are
        model.bias += 0.5 * float(np.log(classes[1] / classes[0]))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """Rows of ``docs`` with ``name``, the probability that the text is toxic. ``keep`` names the columns to carry along (else the id alone)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    carried = [id_col] if keep is None else keep
    text_field = f"c{len(carried)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        sums: dict[str, float] = {}
        sizes: dict[str, int] = {}
        for batch in sliced(batches, text_field, 1 << 20):
            if len(sums) > CACHED_PARTS:
                sums.clear()
                sizes.clear()
            split = [(t or "").split() for t in batch.column(text_field).to_pylist()]
            new = list(set().union(*split).difference(sums))
            found, n = model.parts(new)
            sums.update(zip(new, found.tolist(), strict=True))
            sizes.update(zip(new, n.tolist(), strict=True))
            logits = np.array([model.bias + sum([sums[p] for p in parts]) / max(1, sum([sizes[p] for p in parts])) for parts in split])
            scores = 1 / (1 + np.exp(-np.clip(logits, -50.0, 50.0)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], pa.array(scores, pa.float64())], schema.names)

    source = docs.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate([*carried, text_col])])
    schema = T.StructType([*source.schema.fields[: len(carried)], T.StructField("score", T.DoubleType())])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])
    return source.mapInArrow(run, schema).toDF(*carried, name)
