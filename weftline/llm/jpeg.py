"""Media columns: baseline JPEG, read to DC-only luminance thumbnails, and as a lossless byte container.

Reader: markers are parsed, scans are Huffman-decoded, and each luminance block's DC coefficient gives one
thumbnail pixel. Scans of one component with restart intervals are decoded in lockstep, one lane an interval, by
numpy; any other baseline scan (interleaved components, subsampling, AC coefficients) is decoded block by block.

Container: a payload is stored one byte a block as the DC value byte - 128 with quantiser 8, so that a decoder
shows the block flat at that byte's grey level: the thumbnail is the payload. Frames are 64 blocks wide, one
restart interval a row, at most 8191 rows; longer payloads take several frames one after another.

Defined results: null and empty payloads are 64 zero bytes; equal payloads give equal media; progressive or
arithmetic-coded files and broken ones give null columns in ``media_columns``; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import sliced, texts_of

WIDE, MAX_ROWS = 64, 8191

# Code lengths and symbols of the container's tables (DC categories by their use in text; AC: end of block).
DC_BITS = (0, 1, 3, 3, 2, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = (7, 3, 4, 5, 0, 2, 6, 1, 8)
AC_BITS = (1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)
AC_SYMBOLS = (0,)


def huffman_codes(bits: tuple[int, ...], symbols: tuple[int, ...]) -> dict[int, tuple[int, int]]:
    """symbol: (code, length), canonical."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(bits, 1):
        for s in symbols[at : at + n]:
            out[s] = (code, length)
            code += 1
        at += n
        code <<= 1
    return out


def lookup(codes: dict[int, tuple[int, int]]) -> np.ndarray:
    """By the next 16 bits: symbol << 8 | length, 0 where no code fits."""
    table = np.zeros(1 << 16, dtype=np.int32)
    for symbol, (code, length) in codes.items():
        table[code << (16 - length) : (code + 1) << (16 - length)] = symbol << 8 | length
    return table


def _extended(raw: int, size: int) -> int:
    return raw if not size or raw >> (size - 1) else raw - (1 << size) + 1


def flat_blocks(dc: np.ndarray, ac: np.ndarray) -> np.ndarray:
    """By the next 16 bits: (difference + 4096) << 8 | bits of a block that is a DC difference and an end of block; 0 if it isn't one or doesn't fit."""
    ahead = np.arange(1 << 16, dtype=np.int64)
    symbol, used = dc >> 8, dc & 255
    ok = (dc > 0) & (symbol <= 11) & (symbol + used < 16)
    size = np.where(ok, symbol, 0)
    raw = (ahead >> np.where(ok, 16 - used - size, 0)) & ((1 << size) - 1)
    value = np.where((size > 0) & (raw >> np.maximum(size - 1, 0) == 0), raw - (1 << size) + 1, raw)
    spent = used + size
    rest = ac[((ahead << np.where(ok, spent, 0)) & 0xFFFF)]
    ok &= (rest > 0) & (rest >> 8 == 0) & ((rest & 255) + spent <= 16)
    return np.where(ok, (value + 4096) << 8 | (spent + (rest & 255)), 0).astype(np.int32)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _tables() -> bytes:
    return _segment(0xC4, bytes([0x00, *DC_BITS, *DC_SYMBOLS, 0x10, *AC_BITS, *AC_SYMBOLS]))


_START = b"\xff\xd8" + _segment(0xDB, bytes([0] + [8] * 64))
_REST = _tables() + _segment(0xDD, struct.pack(">H", WIDE)) + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))


def _block_bits() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number of a block for each difference -255..255."""
    dc, ac = huffman_codes(DC_BITS, DC_SYMBOLS), huffman_codes(AC_BITS, AC_SYMBOLS)
    bits, size = np.zeros(511, dtype=np.uint16), np.zeros(511, dtype=np.uint8)
    for d in range(-255, 256):
        n = abs(d).bit_length()
        code, length = dc[n]
        raw = d if d >= 0 else d + (1 << n) - 1
        bits[d + 255] = (code << n | raw) << ac[0][1] | ac[0][0]
        size[d + 255] = length + n + ac[0][1]
    return bits, size


_BITS, _SIZE = _block_bits()
_MOST = int(_SIZE.max())


def _scan_bytes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of each row (one restart interval), each followed by two bytes for a marker; ends of the rows."""
    value = rows.astype(np.int16) - 128
    diff = np.diff(value, axis=1, prepend=np.int16(0)) + 255
    size = np.concatenate((_SIZE[diff], np.zeros((len(rows), 1), dtype=np.uint8)), axis=1)
    bits = np.concatenate((_BITS[diff], np.full((len(rows), 1), 0xFFFF, dtype=np.uint16)), axis=1)
    total = size.sum(axis=1, dtype=np.int64)
    size[:, -1] = -total % 8
    places = np.arange(_MOST - 1, -1, -1, dtype=np.uint16)
    spread = ((bits[:, :, None] >> places) & 1).astype(np.uint8)
    packed = np.packbits(spread[places < size[:, :, None]])
    length = (total + 7) // 8
    full = packed == 0xFF
    row = np.repeat(np.arange(len(rows)), length)
    before = np.cumsum(full) - full  # stuffed zero bytes before each byte
    at = np.arange(len(packed)) + before + 2 * row
    ends = np.cumsum(length + 2 + np.bincount(row[full], minlength=len(rows)))
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    out[at] = packed
    return out, ends


def store(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a positive multiple of 64 bytes) as JPEG frames."""
    flat = np.frombuffer(b"".join(payloads), dtype=np.uint8).reshape(-1, WIDE)
    out, ends = _scan_bytes(flat)
    media, row = [], 0
    for payload in payloads:
        left, frames = len(payload) // WIDE, []
        while left:
            n = min(left, MAX_ROWS)
            frame_ends = ends[row : row + n]
            marks = 0xD0 + np.arange(n) % 8
            marks[-1] = 0xD9
            out[frame_ends - 2] = 0xFF
            out[frame_ends - 1] = marks
            first = int(ends[row - 1]) if row else 0
            size = _segment(0xC0, struct.pack(">BHHB", 8, 8 * n, 8 * WIDE, 1) + bytes([1, 0x11, 0]))
            frames.append(_START + size + _REST + out[first : int(frame_ends[-1])].tobytes())
            row, left = row + n, left - n
        media.append(b"".join(frames))
    return media


@dataclass
class Frame:
    """What the markers of one image say, and where its scan lies in the file."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    quantisers: dict[int, list[int]] = field(default_factory=dict)
    tables: dict[tuple[int, int], tuple[tuple[int, ...], tuple[int, ...]]] = field(default_factory=dict)
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # component id, DC table, AC table
    interval: int = 0
    start: int = 0
    end: int = 0


def parse(data: bytes) -> list[Frame]:
    """The frames of a file. ValueError for what isn't baseline JPEG."""
    frames, at = [], 0
    while at < len(data):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        at += 2
        frame = Frame()
        while True:
            if at + 4 > len(data) or data[at] != 0xFF:
                raise ValueError("marker expected")
            marker = data[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            length = int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + length]
            at += 2 + length
            if marker == 0xC0 or marker == 0xC1:
                precision, frame.height, frame.width, n = struct.unpack(">BHHB", body[:6])
                if precision != 8:
                    raise ValueError("not 8-bit")
                frame.components = [(c[0], c[1] >> 4, c[1] & 15, c[2]) for c in (body[6 + 3 * i : 9 + 3 * i] for i in range(n))]
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not baseline")
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    frame.tables[body[0] >> 4, body[0] & 15] = (tuple(body[1:17]), tuple(body[17 : 17 + n]))
                    body = body[17 + n :]
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    n = 64 * (1 + wide)
                    frame.quantisers[body[0] & 15] = list(struct.unpack(">64H" if wide else ">64B", body[1 : 1 + n]))
                    body = body[1 + n :]
            elif marker == 0xDD:
                frame.interval = int.from_bytes(body[:2], "big")
            elif marker == 0xDA:
                frame.scan = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
                break
        frame.start = at
        while True:  # to the next marker that is neither a stuffed byte nor a restart
            at = data.find(b"\xff", at)
            if at < 0 or at + 1 >= len(data):
                raise ValueError("no end of image")
            if data[at + 1] == 0 or 0xD0 <= data[at + 1] <= 0xD7:
                at += 2
                continue
            break
        frame.end = at
        if data[at + 1] != 0xD9 or not frame.components or not frame.scan:
            raise ValueError("more than one scan, or none")
        at += 2
        frames.append(frame)
    return frames


class _Lanes:
    """Lockstep decoding of restart intervals that hold the same number of flat blocks of one component."""

    def __init__(self, table: np.ndarray):
        self.table = table

    def decode(self, scans: list[bytes], blocks: int) -> tuple[np.ndarray, np.ndarray]:
        """Differences summed to DC values, (intervals, blocks), and the number of intervals of each scan."""
        lengths = np.array([len(s) + 2 for s in scans])
        data = np.frombuffer(b"".join(x for s in scans for x in (s, b"\xff\xd9")), dtype=np.uint8)
        after = np.empty_like(data)
        after[:-1], after[-1] = data[1:], 0
        mark = (data == 0xFF) & (after != 0)
        ends = np.flatnonzero(mark)
        per_scan = np.diff(np.searchsorted(ends, np.concatenate(([0], np.cumsum(lengths)))))
        drop = mark.copy()
        drop[1:] |= data[:-1] == 0xFF  # marker codes and stuffed zeros
        kept_before = np.cumsum(~drop)
        data = np.concatenate((data[~drop], np.full(4, 0xFF, dtype=np.uint8))).astype(np.uint32)
        window = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
        stops = kept_before[ends]
        at = np.concatenate(([0], stops[:-1])) * 8
        out = np.zeros((blocks, len(at)), dtype=np.int16)
        value = np.zeros(len(at), dtype=np.int32)
        last = len(window) - 1
        for k in range(blocks):
            found = self.table[(window[np.minimum(at >> 3, last)] >> (8 - (at & 7)).astype(np.uint32)) & 0xFFFF]
            if not found.all():
                raise ValueError("not a flat block")
            value += (found >> 8) - 4096
            out[k] = value
            at += found & 255
        if (at > stops * 8).any():
            raise ValueError("interval too short")
        return out.T, per_scan


def _scan_by_block(data: bytes, frame: Frame) -> dict[int, np.ndarray]:
    """DC values of each component, block by block."""
    parts, at = [], frame.start
    for i in range(frame.start, frame.end - 1):
        if data[i] == 0xFF and 0xD0 <= data[i + 1] <= 0xD7:
            parts.append(data[at:i])
            at = i + 2
    parts.append(data[at : frame.end])
    by_id = {c[0]: c for c in frame.components}
    most_h, most_v = max(c[1] for c in frame.components), max(c[2] for c in frame.components)
    codes = {k: lookup(huffman_codes(*t)) for k, t in frame.tables.items()}
    single = len(frame.scan) == 1
    across = -(-frame.width // (8 * most_h))
    down = -(-frame.height // (8 * most_v))
    if single:
        _, h, v, _ = by_id[frame.scan[0][0]]
        across, down = -(-(-(-frame.width * h // most_h)) // 8), -(-(-(-frame.height * v // most_v)) // 8)
    size = {c: (1, 1) if single else by_id[c][1:3] for c, _, _ in frame.scan}
    out = {c: np.zeros((down * size[c][1], across * size[c][0]), dtype=np.int32) for c, _, _ in frame.scan}
    mcu, total = 0, across * down
    for part in parts:
        clean = part.replace(b"\xff\x00", b"\xff")
        number, have, pos = int.from_bytes(clean + b"\xff\xff\xff\xff", "big"), 8 * len(clean) + 32, 0
        before = dict.fromkeys(out, 0)

        def peek(n: int) -> int:
            if have - pos - n < 0:
                raise ValueError("scan too short")
            return number >> (have - pos - n) & ((1 << n) - 1)  # noqa: B023

        for _ in range(frame.interval or total):
            if mcu == total:
                break
            for c, dc, ac in frame.scan:
                wide, high = size[c]
                for b in range(wide * high):
                    found = int(codes[0, dc][peek(16)])
                    if not found:
                        raise ValueError("no such code")
                    pos += found & 255
                    n = found >> 8
                    before[c] += _extended(peek(n), n)
                    pos += n
                    out[c][mcu // across * high + b // wide, mcu % across * wide + b % wide] = before[c]
                    k = 1
                    while k < 64:
                        found = int(codes[1, ac][peek(16)])
                        if not found:
                            raise ValueError("no such code")
                        pos += found & 255
                        symbol = found >> 8
                        if symbol == 0:
                            break
                        pos += symbol & 15
                        k += (symbol >> 4) + 1
            mcu += 1
    if mcu < total:
        raise ValueError("blocks are missing")
    return out


_lanes: dict[tuple, _Lanes] = {}


def thumbnails(files: list[bytes]) -> list[list[np.ndarray]]:
    """DC-only luminance of the frames of each file, one pixel (0 to 255) a block. ValueError for what isn't baseline."""
    frames = [parse(f) for f in files]
    groups: dict[tuple, list[tuple[int, int]]] = {}
    out: list[list[np.ndarray | None]] = [[None] * len(own) for own in frames]
    for i, own in enumerate(frames):
        for j, f in enumerate(own):
            across = -(-f.width // 8)
            if len(f.components) == 1 and f.interval == across:
                dc, ac = f.tables[0, f.scan[0][1]], f.tables[1, f.scan[0][2]]
                groups.setdefault((dc, ac, across), []).append((i, j))
    for (dc, ac, across), members in groups.items():
        if (dc, ac) not in _lanes:
            if len(_lanes) > 16:
                _lanes.clear()
            _lanes[dc, ac] = _Lanes(flat_blocks(lookup(huffman_codes(*dc)), lookup(huffman_codes(*ac))))
        try:
            values, counts = _lanes[dc, ac].decode([files[i][frames[i][j].start : frames[i][j].end] for i, j in members], across)
        except ValueError:
            continue  # these go block by block
        for (i, j), rows in zip(members, np.split(values, np.cumsum(counts)[:-1]), strict=True):
            if len(rows) == -(-frames[i][j].height // 8):
                out[i][j] = rows
    for i, own in enumerate(frames):
        for j, f in enumerate(own):
            if out[i][j] is None:
                out[i][j] = _scan_by_block(files[i], f)[f.components[0][0]]
            quantiser = f.quantisers[f.components[0][3]][0]
            grey = out[i][j].astype(np.int32) * quantiser
            out[i][j] = np.clip((grey + 1024 + 4 * (quantiser % 8 > 0)) >> 3, 0, 255).astype(np.uint8)
    return out


def thumbnail_hash(grey: np.ndarray) -> str:
    """Difference hash, 16 hex digits: is each of 8 x 8 block averages of the whole thumbnail brighter than its right neighbour."""
    for axis, parts in ((0, 8), (1, 9)):
        begins = np.arange(parts) * grey.shape[axis] // parts
        shape = [-1 if k == axis else 1 for k in (0, 1)]
        sizes = np.maximum(1, np.diff(np.append(begins, grey.shape[axis]))).reshape(shape)
        grey = np.add.reduceat(grey.astype(np.float64), begins, axis=axis) / sizes
    return np.packbits(grey[:, :-1] > grey[:, 1:]).tobytes().hex()


def feature(frames: list[np.ndarray]) -> str:
    """Dimensions in pixels, thumbnail hash and CRC-32 of the whole thumbnail of each frame."""
    return "+".join(f"{8 * g.shape[1]}x{8 * g.shape[0]}:{thumbnail_hash(g)}:{zlib.crc32(g.tobytes()):08x}" for g in frames)


def stored_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts in the container and read back: doc_id, n_bytes, media, payload, feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 1 << 20):
            texts = texts_of(batch, "text", as_bytes=True)
            media = store([t + bytes(-len(t) % WIDE or WIDE * (not t)) for t in texts])
            frames = thumbnails(media)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary()), pa.array([b"".join(g.tobytes() for g in f) for f in frames], pa.binary()), pa.array([feature(f) for f in frames])],
                ["doc_id", "n_bytes", "media", "payload", "feature"],
            )

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary, payload binary, feature string")


def media_columns(images: DataFrame, id_col: str, image_col: str) -> DataFrame:
    """id, width, height, thumbnail (bytes, row by row) and thumbnail_hash of baseline JPEG files; null where unreadable."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for data in batch.column("image").to_pylist():
                try:
                    head, grey = parse(data or b"")[0], thumbnails([data])[0][0]
                    rows.append((head.width, head.height, grey.tobytes(), thumbnail_hash(grey)))
                except (ValueError, KeyError, IndexError, struct.error):
                    rows.append((None,) * 4)
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            types = (pa.int32(), pa.int32(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["id", "width", "height", "thumbnail", "thumbnail_hash"])

    source = images.select(F.col(id_col).alias("id"), F.col(image_col).alias("image"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, width int, height int, thumbnail binary, thumbnail_hash string")
