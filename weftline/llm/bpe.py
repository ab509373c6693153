"""Byte-level BPE: encoding and decoding by a ranks file.

Two tiers. A pre-token that is in the vocabulary as a whole is resolved by a minimal perfect hash (hash and
displace: one displacement per bucket, one slot per token, the token's bytes compared). Any other is merged by
a heap of (rank, place) over linked byte segments. Ranks of merge candidates come from the same hash.

Defined results: null text is empty and gives no ids; ids decode to the text's own UTF-8 bytes; repeated rows
each get a row; extra columns are ignored; very long texts are sliced by batch, never cut.
"""

from __future__ import annotations

import base64
import functools
import heapq
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import sliced, texts_of

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class MinimalPerfectHash:
    """Maps n distinct byte strings onto 0..n-1 without gaps; other strings map anywhere."""

    def __init__(self, keys: list[bytes], per_bucket: int = 4, seed: int = 0):
        self.n, self.seed = len(keys), seed
        self.buckets = max(1, -(-self.n // per_bucket))
        self.shift = np.zeros(self.buckets, dtype=np.int64)
        hashes = self.hashes(keys)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        sizes = np.diff(bounds)
        used = np.zeros(self.n, dtype=bool)
        free: list[int] = []
        for b in np.argsort(-sizes, kind="stable"):
            if not sizes[b]:
                break
            own = hashes[order[bounds[b] : bounds[b + 1]]]
            if sizes[b] == 1:  # the largest buckets are placed; single keys take any free slot
                free = free or np.flatnonzero(~used)[::-1].tolist()
                slot = free.pop()
                self.shift[b] = -1 - slot
                used[slot] = True
                continue
            for low in range(0, 1 << 40, 512):
                tries = np.arange(low, low + 512, dtype=np.uint64)
                slots = self._slots(own[None, :], tries[:, None])
                good = ~used[slots].any(axis=1)
                ordered = np.sort(slots, axis=1)
                good &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                hit = np.flatnonzero(good)
                if len(hit):
                    self.shift[b] = low + hit[0]
                    used[slots[hit[0]]] = True
                    break
        self.shifts: list[int] = self.shift.tolist()

    def hashes(self, keys: Iterable[bytes]) -> np.ndarray:
        seed, digest = self.seed, xxhash.xxh64_intdigest
        return np.fromiter((digest(k, seed) for k in keys), dtype=np.uint64)

    def _slots(self, hashes: np.ndarray, shift: np.ndarray) -> np.ndarray:
        x = hashes ^ (shift * _GOLDEN)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> np.uint64(29))) % np.uint64(self.n)).astype(np.int64)

    def one(self, key: bytes) -> int:
        """The slot of one key, as ``__call__`` gives it."""
        h, most = xxhash.xxh64_intdigest(key, self.seed), (1 << 64) - 1
        shift = self.shifts[h % self.buckets]
        if shift < 0:
            return -1 - shift
        x = h ^ (shift * 0x9E3779B97F4A7C15 & most)
        x = (x ^ x >> 31) * 0xBF58476D1CE4E5B9 & most
        return (x ^ x >> 29) % self.n

    def __call__(self, keys: list[bytes]) -> np.ndarray:
        hashes = self.hashes(keys)
        shift = self.shift[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        with np.errstate(over="ignore"):
            return np.where(shift < 0, -1 - shift, self._slots(hashes, shift.astype(np.uint64)))


class ByteBPE:
    """Encoder and decoder for one ranks file; caches the words it has seen up to a bounded size."""

    cache_bytes = 96 << 20

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        tokens = [base64.b64decode(t) for t, _ in pairs]
        ids = [int(i) for _, i in pairs]
        self.hash = MinimalPerfectHash(tokens)
        slots = self.hash(tokens)
        self.slot_id = np.zeros(len(tokens), dtype=np.int64)
        self.slot_id[slots] = ids
        self.slot_token: list[bytes] = [b""] * len(tokens)
        for slot, token in zip(slots.tolist(), tokens, strict=True):
            self.slot_token[slot] = token
        self.token_of = dict(zip(ids, tokens, strict=True))
        self.longest = max(map(len, tokens))
        self.findall = regex.compile(pattern).findall
        self.slot_ids: list[int] = self.slot_id.tolist()
        self._ranks: dict[bytes, int] = {}
        self._packed: dict[str, bytes] = {}  # ids of pre-tokens seen, but the longest
        self._spaced: dict[str, bytes | None] = {}
        self._bare: dict[str, bytes | None] = {}
        self._held = 0

    def ranks(self, keys: list[bytes]) -> list[int]:
        """The id of each key, -1 for those outside the vocabulary."""
        if not keys:
            return []
        slots = self.hash(keys).tolist()
        known = self.slot_token
        ids = self.slot_id[slots].tolist()
        return [i if known[s] == k else -1 for k, s, i in zip(keys, slots, ids, strict=True)]

    def rank(self, key: bytes) -> int:
        """The id of one key or -1; the last answers are kept."""
        found = self._ranks.get(key)
        if found is None:
            if len(self._ranks) > 200_000:
                self._ranks.clear()
            slot = self.hash.one(key)
            found = self._ranks[key] = self.slot_ids[slot] if self.slot_token[slot] == key else -1
        return found

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token: the lowest rank, leftmost first, is merged until none is left."""
        rank = self.rank
        n = len(word)
        after = list(range(1, n + 2))  # start of the next segment
        before = list(range(-1, n + 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(word[i : i + 2])) >= 0]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or after[j] != end:
                continue  # one side has been merged since
            alive[j] = False
            after[i] = end
            if end < n:
                before[end] = i
                if after[end] - i <= self.longest and (r := rank(word[i : after[end]])) >= 0:
                    heapq.heappush(heap, (r, i, after[end]))
            a = before[i]
            if a >= 0 and end - a <= self.longest and (r := rank(word[a:end])) >= 0:
                heapq.heappush(heap, (r, a, end))
        out, i = [], 0
        while i < n:
            out.append(rank(word[i : after[i]]))
            i = after[i]
        return out

    def encode_pieces(self, pieces: list[list[str]]) -> list[bytes]:
        """Ids, as little-endian unsigned 32-bit integers, of lists of pre-tokens."""
        packed = self._packed
        if len(packed) > 500_000:
            packed.clear()
        distinct = [p for p in {p for piece in pieces for p in piece} if p not in packed]
        words = [p.encode("utf-8", "surrogatepass") for p in distinct]
        for p, word, r in zip(distinct, words, self.ranks(words), strict=True):
            packed[p] = array("I", [r] if r >= 0 else self.merge(word)).tobytes()
        out = [b"".join([packed[p] for p in piece]) for piece in pieces]
        for p in distinct:
            if len(p) > 64:
                del packed[p]
        return out

    def _learn(self, cache: dict[str, bytes | None], lead: str, parts: Iterable[str]) -> None:
        """Fill a cache of words between single spaces. Words that touch other white space are marked None."""
        new = [p for p in parts if p not in cache]
        clean = [p for p in new if p and not p[0].isspace() and not p[-1].isspace()]
        cache.update(dict.fromkeys(new))
        for p, ids in zip(clean, self.encode_pieces([self.findall(lead + p) for p in clean]), strict=True):
            cache[p] = ids
            self._held += 2 * len(p) + len(ids) + 160

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. A pre-token never spans a single space between two other characters but may
        begin with it, so texts are looked up word by word; those with other runs go through the pattern whole."""
        split = [t.split(" ") for t in texts]
        firsts, others = {s[0] for s in split}, set().union(*[s[1:] for s in split])
        self._learn(self._bare, "", firsts)
        self._learn(self._spaced, " ", others)
        if self._held > self.cache_bytes:  # keep what this batch uses
            self._bare = {p: self._bare[p] for p in firsts}
            self._spaced = {p: self._spaced[p] for p in others}
            self._held = sum(2 * len(p) + len(v or b"") + 160 for c in (self._bare, self._spaced) for p, v in c.items())
        spaced, bare, out = self._spaced, self._bare, []
        for text, parts in zip(texts, split, strict=True):
            first, rest = bare[parts[0]], [spaced[p] for p in parts[1:]]
            if first is None or None in rest:
                out.append(self.encode_pieces([self.findall(text)])[0])
            else:
                out.append(first + b"".join(rest))
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@functools.lru_cache(maxsize=2)
def _encoder(ranks_path: str, pattern: str) -> ByteBPE:
    return ByteBPE(ranks_path, pattern)


def bpe_round_trip(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, token_ids (binary, little-endian unsigned 32-bit) and decoded (binary, from those ids) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(ranks_path, pattern)
        for batch in sliced(batches, "text", 4 << 20):
            ids = coder.encode(texts_of(batch, "text"))
            decoded = [coder.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())],
                ["doc_id", "token_ids", "decoded"],
            )

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, token_ids binary, decoded binary")
