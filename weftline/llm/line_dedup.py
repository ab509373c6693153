"""Fuzzy line dedup by MinHash: one line stays of each component of lines that are nearly the same.

Lines are compared lower-cased with white space squeezed. Two are linked when the Jaccard similarity of their
sets of ``shingle``-character shingles is at least ``threshold`` (a shorter line is one shingle of its own).
Signatures: every shingle is hashed once and the least hash of each of ``bands * rows`` bins is kept, empty bins
borrowing from the next full one. Lines that agree on a band share a bucket. A bucket of up to ``all_pairs``
lines proposes all its pairs; a larger one first proposes each line with its most widespread line (a near copy
mostly differs less from the original than from another copy) and with its neighbour by id, which is linear in its
size. Proposed pairs are verified on their texts: by the sets of hashes of their shingles where the result is clear,
and near the threshold, where hashes that coincide could decide, by the shingles themselves. Large buckets in which several components are
then left are joined exactly: every line outside the bucket's largest component is compared with all lines of other
components wherever their sizes allow a link, in blocks of bounded size, and only links between components leave a
block (by 64-bit hashes of shingles; two lines of m shingles are judged wrongly with a chance of about m * m / 2**64).
So every pair of similar lines that shares a bucket ends in one component. Of each component the first line by (doc_id, line number) stays,
wherever it is; lines without any word always stay.

What goes is found, not what stays: repeats within a window of a task's lines at once, then the later copies of a
line, then the lines of a component but its first. Documents without such lines are passed on as they are.

With 12 bands of 4 rows a pair of similarity 0.8 shares a bucket with probability 0.998, one of 0.9 practically
always.

Defined results: null text stays null and has no lines; a null doc_id comes after all others; rows that repeat
both doc_id and text count as one document and get the same text; documents keep their row even if no line stays
(their text is then empty); other columns are untouched; long lines and texts are compared whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import connected_components, join_by_skewed_key, materialize, sliced

BANDS, ROWS, SHINGLE, THRESHOLD = 12, 4, 8, 0.8
BLOCK_SHINGLES = 1 << 19  # shingles of a block of a large bucket: 4 MB
DENSE_PAIRS, DENSE_LINES = 1 << 22, 256  # sizes up to which a group is handled by matrices
HELD_IDS = 1 << 20  # lines of an open bucket that a task holds: 16 MB
FILTER_BITS = 1 << 28  # most bits of the filter on proposed lines: 32 MB; else 16 a line

_MIX = np.uint64(0xFF51AFD7ED558CCD)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def normal_line(line: str) -> str:
    return _squeezed(line.lower())


def _squeezed(line: str) -> str:
    if "  " not in line and line.isprintable() and line[:1] != " " and line[-1:] != " ":
        return line  # no white space but single spaces
    return " ".join(line.split())


def line_id(normal: str) -> int:
    """Signed 64-bit id of a normal line. Of n different lines about n * n / 2**65 pairs share one and count as equal."""
    h = xxhash.xxh64_intdigest(normal.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def document_key(id_col: str, text_col: str) -> Column:
    """Tells documents with the same id apart."""
    return F.xxhash64(id_col, text_col)


def shingle_hashes(lines: list[str], width: int = SHINGLE, bits: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``bits`` (32 or 64) of the character shingles of all lines in one array, and where each line's begin."""
    kind, whole = (np.uint32, 0xFFFFFFFF) if bits == 32 else (np.uint64, 0xFFFFFFFFFFFFFFFF)
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(kind, copy=False)
    lengths = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    counts = np.maximum(1, lengths - width + 1)
    starts = np.cumsum(counts) - counts
    if not len(codes):
        return np.zeros(len(lines), dtype=kind), starts
    rolled, step, span = np.concatenate((codes, np.zeros(width, dtype=kind))), 0x9E3779B97F4A7C15 & whole, 1
    if bits == 32:
        step = 0x9E3779B1
    while span < width:  # hashes of twice as many characters, from those that begin span apart
        rolled = rolled[:-span] * kind(step) + rolled[span:]
        step, span = step * step & whole | 1, 2 * span
    drop = np.zeros(len(codes), dtype=bool)
    ends = np.cumsum(lengths)
    for k in range(1, width):  # shingles that would run over the end of their line
        drop[(ends - k)[lengths > k]] = True
    hashes = rolled[: len(codes)][~drop] if lengths.min() >= width else _with_short(rolled, lines, lengths, width)
    half, first, second = (16, 0x85EBCA6B, 0xC2B2AE35) if bits == 32 else (32, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)
    hashes = (hashes ^ (hashes >> kind(half))) * kind(first)
    hashes = (hashes ^ (hashes >> kind(half - 3))) * kind(second)
    return hashes ^ (hashes >> kind(half)), starts


def _with_short(rolled: np.ndarray, lines: list[str], lengths: np.ndarray, width: int) -> np.ndarray:
    """Shingle hashes where some lines are shorter than a shingle: those have one of their own."""
    counts = np.maximum(1, lengths - width + 1)
    begins, starts = np.cumsum(lengths) - lengths, np.cumsum(counts) - counts
    hashes = rolled[np.repeat(begins - starts, counts) + np.arange(counts.sum())]
    digest = xxhash.xxh32_intdigest if rolled.dtype == np.uint32 else xxhash.xxh64_intdigest
    short = np.flatnonzero(lengths < width)
    hashes[starts[short]] = [digest(lines[i].encode("utf-8", "surrogatepass"), 3) for i in short.tolist()]
    return hashes


def distinct_shingles(lines: list[str]) -> list[np.ndarray]:
    """The sorted set of 32-bit shingle hashes of each line."""
    hashes, starts = shingle_hashes(lines)
    counts = np.diff(np.append(starts, len(hashes)))
    keys = np.repeat(np.arange(len(lines), dtype=np.uint64) << np.uint64(32), counts) | hashes
    keys.sort()
    keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys
    ends = np.searchsorted(keys, np.arange(1, len(lines), dtype=np.uint64) << np.uint64(32))
    return np.split(keys.astype(np.uint32), ends)


def similar(a: str, b: str, threshold: float, width: int = SHINGLE) -> bool:
    """Jaccard similarity of the shingles themselves."""
    p, q = ({x[i : i + width] for i in range(max(1, len(x) - width + 1))} for x in (a, b))
    common = len(p & q)
    return common >= threshold * (len(p) + len(q) - common)


def band_hashes(lines: list[str], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(lines, bands) bucket keys as signed 64-bit integers."""
    hashes, starts = shingle_hashes(lines)
    bins = bands * rows
    counts = np.diff(np.append(starts, len(hashes)))
    spread = hashes * np.uint32(0x9E3779B1)
    key = np.repeat(np.arange(len(lines), dtype=np.int64) * bins, counts) + ((spread >> np.uint32(16)) * np.uint32(bins) >> np.uint32(16))
    most = np.uint32(0xFFFFFFFF)
    least = np.full(len(lines) * bins, most, dtype=np.uint32)
    np.minimum.at(least, key, hashes)
    full = least.reshape(len(lines), bins)
    # an empty bin takes the value of the first full one in an order of its own, the same for all lines
    least, rng = full.copy(), np.random.default_rng(bins)
    at = np.arange(len(lines))
    for _ in range(8 * bins):
        at = at[(least[at] == most).any(axis=1)]
        if not len(at):
            break
        part = least[at]
        least[at] = np.where(part == most, full[at[:, None], rng.integers(0, bins, bins)], part)
    least = least.astype(np.uint64)
    out = np.zeros((len(lines), bands), dtype=np.uint64)
    for b in range(bands):
        own = np.full(len(lines), np.uint64(b + 1))
        for r in range(rows):
            own = (own * _STEP) ^ (least[:, b * rows + r] * _MIX)
            own ^= own >> np.uint64(31)
        out[:, b] = own
    return out.view(np.int64)


def _lines_of(docs: DataFrame, id_col: str, text_col: str, window: int = 200_000) -> DataFrame:
    """Occurrences: doc_id, line_no, doc_key, id, first, bands.

    They are gathered in windows of a task's lines. ``first`` holds where no other place in the window comes before
    (by doc_id, line number, key) with the same line; bands are given once for each line of a window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in sliced(batches, "text", 1 << 20):
            seen: dict[str, int] = {}
            at, number, own = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for n, line in enumerate((text or "").lower().split("\n")):
                    if normal := _squeezed(line):
                        at.append(i)
                        number.append(n)
                        own.append(seen.setdefault(normal, len(seen)))
            if not seen:
                continue
            lines = list(seen)
            ids, bands, own = np.array([line_id(x) for x in lines]), band_hashes(lines), np.array(own)
            firsts = np.unique(own, return_index=True)[1]  # lines are numbered as they come: in order
            offsets = np.zeros(len(own) + 1, dtype=np.int32)
            offsets[firsts + 1] = BANDS
            at = pa.array(at, pa.int64())
            held.append(pa.table({
                "doc_id": batch.column("doc_id").take(at),
                "line_no": pa.array(number, pa.int32()),
                "doc_key": batch.column("doc_key").take(at),
                "id": pa.array(ids[own]),
                "bands": pa.ListArray.from_arrays(pa.array(np.cumsum(offsets, dtype=np.int32)), pa.array(bands.ravel())),
            }))
            if sum(t.num_rows for t in held) >= window:
                yield from closed(pa.concat_tables(held))
                held = []
        if held:
            yield from closed(pa.concat_tables(held))

    def closed(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = table.column("id").to_numpy()
        _, where, inverse, counts = np.unique(ids, return_index=True, return_inverse=True, return_counts=True)
        first = np.ones(len(ids), dtype=bool)
        often = np.flatnonzero(counts[inverse] > 1)
        if len(often):
            first[often] = best_places(table.select(["id", *PLACE]).take(pa.array(often)))
        again = np.ones(len(ids), dtype=bool)
        again[where] = False
        bands = table.column("bands").combine_chunks()
        if again.any():
            bands = pc.if_else(pa.array(again), pa.scalar(None, bands.type), bands)
        out = table.set_column(4, "bands", bands).add_column(4, "first", pa.array(first))
        yield from out.combine_chunks().to_batches(max_chunksize=20_000)

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), document_key(id_col, text_col).alias("doc_key"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, line_no int, doc_key long, id long, first boolean, bands array<long>")


PLACE = ("doc_id", "line_no", "doc_key")


def best_places(rows: pa.Table, key: str = "id") -> np.ndarray:
    """Which rows stand at the first place (null doc_ids last) of their key; rows that repeat that place all do."""
    order = pc.sort_indices(rows, sort_keys=[(key, "ascending"), *((c, "ascending") for c in PLACE)]).to_numpy()
    ordered = rows.take(pa.array(order)).combine_chunks()
    keys = ordered.column(key).to_numpy()
    new = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=bool)
    leader = np.flatnonzero(new)[np.cumsum(new) - 1]
    same = np.ones(len(keys), dtype=bool)
    for c in PLACE:
        mine = ordered.column(c)
        other = mine.take(pa.array(leader))
        equal = pc.or_(pc.fill_null(pc.equal(mine, other), False), pc.and_(pc.is_null(mine), pc.is_null(other)))
        same &= equal.to_numpy()
    out = np.zeros(len(keys), dtype=bool)
    out[order] = same
    return out


def _proposals(bands: DataFrame, all_pairs: int) -> DataFrame:
    """From rows (band, id), a row for each batch of documents that has the line: kind 0, a pair (a, b) of ids;
    kind 1, a member b of the large bucket a."""

    def pairs_of(ids: np.ndarray, spread: np.ndarray, more: bool = False) -> tuple[list[np.ndarray], bool]:
        if len(ids) <= all_pairs and not more:
            i, j = np.triu_indices(len(ids), 1)
            return [np.stack((ids[i], ids[j]))], False
        hub = ids[spread.argmax()]
        others = ids[ids != hub]
        return [np.stack((ids[:-1], ids[1:])), np.stack((np.full(len(others), hub), others))], True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(found: list[np.ndarray], large: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            parts = [(0, f) for f in found if f.shape[1]] + [(1, np.stack((np.full(len(x), b), x))) for b, x in large]
            if parts:
                both = np.concatenate([p for _, p in parts], axis=1)
                kinds = np.repeat([k for k, _ in parts], [p.shape[1] for _, p in parts]).astype(np.int32)
                for low in range(0, len(kinds), 1 << 18):
                    cut = slice(low, low + (1 << 18))
                    yield pa.RecordBatch.from_arrays([pa.array(kinds[cut]), pa.array(both[0, cut]), pa.array(both[1, cut])], ["kind", "a", "b"])

        none = np.zeros(0, dtype=np.int64)
        held, held_band, more = (none, none), 0, False  # ids of the open bucket and how many batches of documents have each; more: others went before

        def close() -> tuple[list[np.ndarray], list[tuple[int, np.ndarray]]]:
            if len(held[0]) < 2:
                return [], []
            pairs, large = pairs_of(*held, more)
            return pairs, [(held_band, held[0])] * large

        for batch in batches:
            band, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("band", "id"))
            if not len(ids):
                continue
            order = np.lexsort((ids, band))
            band, ids = band[order], ids[order]
            first = np.flatnonzero(np.concatenate(([True], (band[1:] != band[:-1]) | (ids[1:] != ids[:-1]))))
            spread = np.diff(np.append(first, len(ids)))
            band, ids = band[first], ids[first]
            cuts = np.concatenate(([0], np.flatnonzero(band[1:] != band[:-1]) + 1, [len(ids)]))
            sizes = np.diff(cuts)
            inner = np.ones(len(sizes), dtype=bool)
            inner[[0, -1]] = False  # these may go on in other batches
            twos = cuts[:-1][inner & (sizes == 2)]
            found, large = [np.stack((ids[twos], ids[twos + 1]))], []
            for s in np.flatnonzero(inner & (sizes > 2)).tolist():
                own = slice(cuts[s], cuts[s + 1])
                pairs, big = pairs_of(ids[own], spread[own])
                found += pairs
                large += [(int(band[cuts[s]]), ids[own])] * big
            for s in sorted({0, len(sizes) - 1}):
                own = slice(cuts[s], cuts[s + 1])
                if int(band[cuts[s]]) != held_band:
                    pairs, big = close()
                    found += pairs
                    large += big
                    held, held_band, more = (none, none), int(band[cuts[s]]), False
                both, counts = np.concatenate((held[0], ids[own])), np.concatenate((held[1], spread[own]))
                known, at = np.unique(both, return_inverse=True)
                held = known, np.bincount(at, counts).astype(np.int64)
                if len(known) > HELD_IDS:  # the bucket goes on from its most widespread line
                    more = True
                    pairs, big = close()
                    found += pairs
                    large += big
                    hub = held[1].argmax()
                    held = held[0][hub : hub + 1], held[1][hub : hub + 1]
            yield from emit(found, large)
        yield from emit(*close())

    n = int(bands.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = bands.repartition(n, "band").sortWithinPartitions("band")  # one key: sorted by its bits; ids are put in order by batch
    return ordered.mapInArrow(run, "kind int, a long, b long")


def _texts(docs: DataFrame, pairs: DataFrame, text_col: str) -> DataFrame:
    """(id, line) of the lines in the proposed pairs."""
    spark = docs.sparkSession
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted-lines")
    size = min(FILTER_BITS, 1 << max(12, (16 * wanted.count() - 1).bit_length()))
    bit = F.pmod(F.col("id"), F.lit(size))
    words = wanted.groupBy((bit / 64).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(id, {size}) % 64 as int))")).alias("bits"))
    field = np.zeros(size // 64, dtype=np.int64)
    found = words.toArrow()  # at most one row a word of the filter
    field[found["word"].to_numpy()] = found["bits"].to_numpy()
    shared = spark.sparkContext.broadcast(field)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct lines of each batch whose ids the filter lets through; more than wanted may pass."""
        bits = shared.value.view(np.uint64)
        for batch in sliced(batches, "text", 1 << 20):
            own = {x for t in batch.column("text").to_pylist() if t for x in map(_squeezed, t.lower().split("\n"))}
            own.discard("")
            own = list(own)
            if not own:
                continue
            ids = np.array([line_id(x) for x in own], dtype=np.int64)
            place = np.mod(ids, size)
            passed = np.flatnonzero(bits[place // 64] >> (place % 64).astype(np.uint64) & np.uint64(1)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids[passed]), pa.array([own[i] for i in passed], pa.string())], ["id", "line"])

    texts = docs.select(F.col(text_col).alias("text")).mapInArrow(lines, "id long, line string")
    return materialize(texts.join(wanted, "id", "left_semi").distinct(), "line-texts")


def _verified(texts: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b) ids of the proposed pairs whose lines are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "a_line", 1 << 19):
            a, b = batch.column("a_line").to_pylist(), batch.column("b_line").to_pylist()
            distinct = {x: i for i, x in enumerate(dict.fromkeys([*a, *b]))}
            if not distinct:
                continue
            lines = list(distinct)
            sets = distinct_shingles(lines)
            good = []
            for x, y in zip(map(distinct.get, a), map(distinct.get, b), strict=True):
                p, q = sets[x], sets[y]
                n, least = len(p) + len(q), threshold * max(len(p), len(q))
                slack = 2 + (n * n >> 31)  # shingles that may share a hash of 32 bits by chance
                if min(len(p), len(q)) < least - slack:
                    continue
                both = np.concatenate((p, q))
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                over = common - threshold * (n - common)
                if over >= 2 * slack or over > -2 * slack and similar(lines[x], lines[y], threshold):
                    good.append((line_id(lines[x]), line_id(lines[y])))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in good], pa.int64()), pa.array([y for _, y in good], pa.int64())], ["a", "b"])

    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("a_line")), "a")
    both = both.join(texts.select(F.col("id").alias("b"), F.col("line").alias("b_line")), "b")
    return both.select("a_line", "b_line").mapInArrow(check, "a long, b long")


def line_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, all_pairs: int = 8) -> tuple[DataFrame, DataFrame]:
    """The occurrences of lines, and (node, root) ids of linked lines."""
    occurrences = materialize(_lines_of(docs, id_col, text_col), "lines")
    bands = occurrences.where("bands is not null").select(F.explode("bands").alias("band"), "id")
    proposed = materialize(_proposals(bands, all_pairs), "line-pairs")
    pairs = materialize(_distinct_pairs(proposed), "pairs")
    texts = _texts(docs, pairs, text_col)
    links = materialize(_verified(texts, pairs, threshold), "links")
    roots = materialize(connected_components(links, "a", "b", "line-cc"), "roots")
    large = proposed.where("kind = 1").select(F.col("a").alias("band"), F.col("b").alias("id"))
    members = materialize(large.join(roots.withColumnRenamed("node", "id"), "id", "left").select("band", "id", F.coalesce("root", "id").alias("root")), "members")
    return occurrences, _merged(roots, _bucket_links(members, texts, threshold))


def _bucket_links(members: DataFrame, texts: DataFrame, threshold: float, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(a, b) roots that a link joins, from members (band, id, root) of large buckets.

    A link between components has an end outside the bucket's largest one (its hub), so the others meet each other
    and the hub's lines, and the hub's lines never meet. Both are cut into blocks of about ``block_shingles``
    shingles; a group holds one block of others with one block of either, so no task holds more than two.
    """
    sizes = members.groupBy("band", "root").agg(F.count("*").alias("n"))
    hubs = sizes.groupBy("band").agg(F.count("*").alias("roots"), F.max(F.struct("n", "root")).alias("most"))
    rest = members.join(hubs.where("roots > 1").select("band", F.col("most.root").alias("hub")), "band")
    rest = rest.withColumn("hub", F.col("root") == F.col("hub"))
    sets = materialize(_shingle_sets(texts.join(rest.select("id").distinct(), "id", "left_semi")), "line-shingles")
    sized = rest.join(sets.select("id", F.size("shingles").cast("long").alias("size")), "id")
    count = lambda which: F.greatest(F.lit(1), F.ceil(F.sum(F.when(which, F.col("size"))) / block_shingles)).cast("int")
    blocks = sized.groupBy("band").agg(count(~F.col("hub")).alias("others"), count(F.col("hub")).alias("hubs"))
    own = rest.join(blocks, "band").withColumn("own", F.expr("cast(pmod(xxhash64(id), if(hub, hubs, others)) as int)"))
    # group (p, q): block p of the others on the left; on the right block q of the others, or block -1 - q of the hub
    left = F.transform(F.sequence(F.lit(0), F.col("hubs") - 1), lambda j: F.struct(F.col("own").alias("p"), (-1 - j).alias("q"), F.lit(True).alias("left")))
    among = F.transform(
        F.filter(F.sequence(F.lit(0), F.col("others") - 1), lambda k: k != F.col("own")),
        lambda k: F.struct(F.least("own", k).alias("p"), F.greatest("own", k).alias("q"), (F.col("own") < k).alias("left")),
    )
    right = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda k: F.struct(k.alias("p"), (-1 - F.col("own")).alias("q"), F.lit(False).alias("left")))
    dealt = own.select("band", "id", "root", F.explode(F.when(F.col("hub"), right).otherwise(F.concat(left, among))).alias("g")).select("band", "id", "root", "g.*")

    def linked(table: pa.Table) -> pa.Table:
        within = table.num_rows > 0 and table.column("q")[0].as_py() == -1  # pairs of one block meet in one group only
        a, b = _linked_roots(table.column("root").to_numpy(), table.column("left").to_numpy(), within, table.column("shingles").combine_chunks(), threshold)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    whole = dealt.join(sets, "id").select("band", "p", "q", "left", "root", "shingles")
    return materialize(whole.groupBy("band", "p", "q").applyInArrow(linked, "a long, b long").distinct(), "root-links")


def _shingle_sets(texts: DataFrame) -> DataFrame:
    """(id, shingles): the sorted set of shingle hashes of each line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "line", 1 << 19):
            if not batch.num_rows:
                continue
            hashes, starts = shingle_hashes(batch.column("line").to_pylist(), bits=64)
            sets = [np.unique(x) for x in np.split(hashes, starts[1:])]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))], ["id", "shingles"])

    return texts.select("id", "line").mapInArrow(run, "id long, shingles array<long>")


def _linked_roots(roots: np.ndarray, left: np.ndarray, within: bool, shingles: pa.ListArray, threshold: float) -> tuple[list[int], list[int]]:
    """Links that join the components of a group of lines: lines on the left with those on the right, and with each other if ``within``.

    Shared shingles are counted exactly: the frequent ones of the group as bits, at most 64 for each shingle of
    the group, the others by their lines. Lines of one component, or of too different sizes, are not compared.
    """
    labels, component = np.unique(roots, return_inverse=True)
    rest = len(labels)
    if rest < 2 or not left.any():
        return [], []
    sizes = shingles.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if left.sum() * len(left) <= DENSE_PAIRS:  # lines whose sizes allow no link are left out at once
        here = np.flatnonzero(left)
        able = (component[here][:, None] != component) & (np.minimum(sizes[here][:, None], sizes) >= threshold * np.maximum(sizes[here][:, None], sizes))
        able[:, here] &= np.triu(np.ones((len(here), len(here)), dtype=bool), 1) if within else False
        involved = able.any(axis=0)
        involved[here] |= able.any(axis=1)
        if not involved.any():
            return [], []
        if involved.sum() <= DENSE_LINES:
            some = able[involved[here]][:, involved]
            return _linked_few(labels, component[involved], np.flatnonzero(left[involved]), some, sizes[involved], shingles.take(pa.array(np.flatnonzero(involved))), threshold)
        if not involved.all():
            keep = np.flatnonzero(involved)
            return _linked_roots(roots[keep], left[keep], within, shingles.take(pa.array(keep)), threshold)
    offsets = shingles.offsets.to_numpy()
    offsets = offsets - offsets[0]
    n, line = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
    _, flat, often = np.unique(shingles.flatten().to_numpy(), return_inverse=True, return_counts=True)
    frequent = (often * 64 >= n) & (often > 1)
    column = np.cumsum(frequent) - 1
    bits = np.zeros((n, int(frequent.sum()) // 64 + 1), dtype=np.uint64)
    at = frequent[flat]
    np.bitwise_or.at(bits, (line[at], column[flat[at]] // 64), np.uint64(1) << (column[flat[at]] % 64).astype(np.uint64))
    at = ~frequent[flat] & (often[flat] > 1)
    holder = line[at][np.argsort(flat[at], kind="stable")]
    begins = np.concatenate(([0], np.cumsum(np.bincount(flat[at], minlength=len(often)))))
    first, a, b = component.copy(), [], []
    for i in np.flatnonzero(left).tolist():
        later = (component != component[i]) & (sizes >= threshold * sizes[i]) & (sizes[i] >= threshold * sizes)
        if within:
            later[:i] &= ~left[:i]  # those on the left that came before have met this line
        else:
            later &= ~left
        found = np.flatnonzero(later)
        if not len(found):
            continue
        common = np.bitwise_count(bits[found] & bits[i]).sum(axis=1, dtype=np.int64)
        some = [holder[begins[k] : begins[k + 1]] for k in flat[offsets[i] : offsets[i + 1]].tolist() if begins[k] < begins[k + 1]]
        if some:
            common += np.bincount(np.concatenate(some), minlength=n)[found]
        for j in found[common >= threshold * (sizes[i] + sizes[found] - common)].tolist():
            if component[i] != component[j]:  # not joined meanwhile
                a.append(int(labels[first[i]]))
                b.append(int(labels[first[j]]))
                component[component == component[j]] = component[i]
                rest -= 1
        if rest == 1:
            break
    return a, b


def _linked_few(labels: np.ndarray, component: np.ndarray, left: np.ndarray, able: np.ndarray, sizes: np.ndarray, shingles: pa.ListArray, threshold: float) -> tuple[list[int], list[int]]:
    """``_linked_roots`` of few lines: shared shingles of all pairs by one product of a 0/1 matrix."""
    _, flat = np.unique(shingles.flatten().to_numpy(), return_inverse=True)
    present = np.zeros((len(sizes), int(flat.max()) + 1), dtype=np.float32)
    present[np.repeat(np.arange(len(sizes)), sizes), flat] = 1
    common = present[left] @ present.T
    first, a, b = component.copy(), [], []
    for k, j in np.argwhere(able & (common >= threshold * (sizes[left][:, None] + sizes - common))).tolist():
        i = int(left[k])
        if component[i] != component[j]:  # not joined meanwhile
            a.append(int(labels[first[i]]))
            b.append(int(labels[first[j]]))
            component[component == component[j]] = component[i]
    return a, b


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` after further links between roots."""
    if links.isEmpty():
        return roots
    merged = materialize(connected_components(links, "a", "b", "root-cc"), "merged-roots")
    new = merged.join(roots, "node", "left_anti").select("node", F.col("node").alias("root"))
    newer = merged.select(F.col("node").alias("root"), F.col("root").alias("newer"))
    return roots.unionByName(new).join(newer, "root", "left").select("node", F.coalesce("newer", "root").alias("root"))


def _distinct_pairs(proposed: DataFrame) -> DataFrame:
    return proposed.where("kind = 0").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def dropped_lines(occurrences: DataFrame, roots: DataFrame) -> DataFrame:
    """doc_id, doc_key and the numbers of the lines that go, of documents that lose any.

    Of a line, the first place by (doc_id, line number, key) stays; of linked lines, the first of those.
    """
    spark, place = occurrences.sparkSession, list(PLACE)
    none = {c: F.lit(None).cast(occurrences.schema[c].dataType) for c in place}
    rows = occurrences.where("first").select("id", F.lit(None).cast("long").alias("root"), *place)
    rows = rows.unionByName(roots.select(F.col("node").alias("id"), "root", *[v.alias(c) for c, v in none.items()]))
    ordered = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id").sortWithinPartitions("id")

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places after a line's first, root null; the first place of each linked line, with its root."""
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            if not table.num_rows:
                continue
            out, held = split(table, table.column("id")[-1].as_py())
            yield from out
        if held is not None and held.num_rows:
            yield from split(held, None)[0]

    def split(table: pa.Table, open_id: int | None) -> tuple[list[pa.RecordBatch], pa.Table | None]:
        """What the lines of the table give; the open line, which may go on, is held back as its first places and its root."""
        ids = table.column("id").to_numpy()
        rooted = pc.is_valid(table.column("root")).to_numpy()
        _, inverse, counts = np.unique(ids, return_inverse=True, return_counts=True)
        busy = np.flatnonzero(counts[inverse] > 1)
        if open_id is not None:
            last = np.flatnonzero(ids == open_id)
            busy = np.union1d(busy, last)
        if not len(busy):
            return [], None
        part, linked = table.take(pa.array(busy)), rooted[busy]
        places = part.filter(pa.array(~linked))
        best = best_places(places.select(["id", *place])) if places.num_rows else np.zeros(0, dtype=bool)
        is_open = places.column("id").to_numpy() == open_id if open_id is not None else np.zeros(len(best), dtype=bool)
        winners = places.filter(pa.array(best & ~is_open))
        known = part.filter(pa.array(linked))
        root_of = dict(zip(known.column("id").to_pylist(), known.column("root").to_pylist(), strict=True))
        own = pa.array([root_of.get(i) for i in winners.column("id").to_pylist()], pa.int64())
        linked_winners = winners.set_column(1, "root", own).filter(pc.is_valid(own))
        gone = pa.concat_tables([places.filter(pa.array(~best)), linked_winners]).select(["root", *place]).combine_chunks()
        kept_back = None
        if open_id is not None:
            open_roots = known.filter(pc.equal(known.column("id"), open_id))
            kept_back = pa.concat_tables([places.filter(pa.array(best & is_open)), open_roots]).combine_chunks()
        return gone.to_batches(max_chunksize=20_000), kept_back

    kinds = ", ".join(f"{c} {occurrences.schema[c].dataType.simpleString()}" for c in place)
    gone = materialize(ordered.mapInArrow(later, f"root long, {kinds}"), "later-lines")
    firsts = gone.where("root is not null")
    best = firsts.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), *place)).alias("best"))
    losers = join_by_skewed_key(firsts, best, "root")
    losers = losers.where(~(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("line_no") == F.col("best.line_no")) & (F.col("doc_key") == F.col("best.doc_key"))))
    every = occurrences.where("not first").select(place).unionByName(gone.where("root is null").select(place)).unionByName(losers.select(place))
    return every.groupBy("doc_id", "doc_key").agg(F.collect_set("line_no").alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with only the lines that stay in its text; all columns and rows as before."""
    occurrences, roots = line_components(docs, id_col, text_col, threshold)
    gone = dropped_lines(occurrences, roots).select(F.col("doc_id").alias("__id"), F.col("doc_key").alias("__key"), "gone")
    fields = [f"c{i}" for i in range(len(docs.columns))]
    own, text = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    same = (document_key(own, text) == F.col("__key")) & F.col(own).eqNullSafe(F.col("__id"))
    found = docs.toDF(*fields).join(gone.hint("shuffle_hash"), same, "left")
    # the lines are bound once, as the element of an array
    left = F.expr(f"transform(array(split({text}, '\n', -1)), ls -> array_join(transform(array_except(sequence(0, size(ls) - 1), gone), i -> get(ls, i)), '\n'))[0]")
    changed = F.when(F.col("gone").isNull(), F.col(text)).otherwise(left)
    return found.select(*[changed.alias(c) if c == text else F.col(c) for c in fields]).toDF(*docs.columns)
