"""TIFF columns: store bytes as TIFF pages, walk the directories back and decode them.

The reader follows the chain of image directories (classic and BigTIFF, either
byte order), decodes strips and tiles that are raw, PackBits, LZW or deflate,
undoes the horizontal and the floating-point predictor, and gives one row a page.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.sources.shared import bounded_batches

# Fixed values of the format: tags, compressions, sizes of field types.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
RAW, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPE_CODES = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}

ROW = 64
PAGE_ROWS = 256
STRIP_ROWS = 128
MOST_PAGES = 1 << 20
EMIT_BYTES = 4 << 20
#: Bytes of one decoded page; a larger one is an error, so a small file cannot fill the memory.
MOST_PAGE_BYTES = 1 << 28


class TiffError(ValueError):
    """The bytes are no TIFF that this reader can decode."""


@dataclass
class Page:
    number: int
    width: int
    length: int
    samples: int
    bits: int
    sample_format: int
    compression: int
    predictor: int
    tiled: bool
    data: bytes
    """Samples row by row, interleaved, little-endian; below 8 bits packed as stored."""


def unpack_bits(data: bytes, most: int = MOST_PAGE_BYTES) -> bytes:
    """PackBits, decoded; no further than to ``most`` bytes."""
    out, at, n, size = [], 0, len(data), 0
    while at < n and size < most:
        head = data[at]
        size += head + 1 if head < 128 else 257 - head if head > 128 else 0
        at += 1
        if head < 128:
            out.append(data[at : at + head + 1])
            at += head + 1
        elif head > 128:
            out.append(data[at : at + 1] * (257 - head))
            at += 1
    return b"".join(out)


_REPEAT = re.compile(rb"(.)\1{2,127}", re.S)


def pack_bits(data: bytes) -> bytes:
    """PackBits, encoded: runs of three bytes or more, literals between them."""
    out, at = [], 0

    def literal(a: int, b: int) -> None:
        for lo in range(a, b, 128):
            part = data[lo : min(lo + 128, b)]
            out.append(bytes([len(part) - 1]) + part)

    for m in _REPEAT.finditer(data):
        literal(at, m.start())
        out.append(bytes([257 - len(m[0])]) + m[1])
        at = m.end()
    literal(at, len(data))
    return b"".join(out)


_SINGLE = [bytes([i]) for i in range(256)]


#: Codes since the last clear code up to which they have so many bits; the table grows by one entry a code.
_WIDTHS = ((254, 9), (766, 10), (1790, 11), (1 << 62, 12))
#: Codes after which an encoder clears its table, and codes that are read at once.
_CLEAR_AFTER, _CODES = 3837, 1 << 14


def _width(index: int) -> tuple[int, int]:
    """Bits of the code ``index`` since the last clear code, and the first index that has more."""
    return next((bits, upto) for upto, bits in _WIDTHS if index < upto)


def lzw_decode(data: bytes, most: int = MOST_PAGE_BYTES) -> bytes:
    """LZW as TIFF has it: codes from the high bit, widths grow one code early; no further than to ``most`` bytes.

    Widths follow from the number of codes since the table was cleared, so codes
    are read in runs of one width; only the table is filled code by code.
    """
    buf = np.frombuffer(data, dtype=np.uint8)
    table: list[bytes] = [*_SINGLE, b"", b""]
    out: list[bytes] = []
    at, index, done, last = 0, 0, 0, None
    while done < most:
        bits, upto = _width(index)
        n = min(upto - index, (8 * len(buf) - at) // bits, _CODES)
        if n <= 0:
            break
        held = np.unpackbits(buf[at >> 3 : (at + n * bits + 7) >> 3])[at & 7 : (at & 7) + n * bits].reshape(n, bits)
        codes = held @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int32))
        stops = np.flatnonzero((codes == 256) | (codes == 257))
        read = int(stops[0]) if len(stops) else n
        size = len(table)
        for code in codes[:read].tolist():
            if code < size:
                if last is None and code > 255:
                    raise TiffError("LZW data starts with no literal")
                entry = table[code]
            elif last is not None and code == size:
                entry = last + last[:1]
            else:
                raise TiffError("LZW code is out of range" if last is not None else "LZW data starts with no literal")
            if last is not None and size < 4096:
                table.append(last + entry[:1])
                size += 1
            out.append(entry)
            last = entry
            done += len(entry)
            if done >= most:
                break
        at, index = at + read * bits, index + read
        if read < n:
            at += bits
            if codes[read] == 257:
                break
            del table[258:]
            index, last = 0, None
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    """LZW as TIFF has it. An entry is known by its code and the byte behind it."""
    runs: list[list[int]] = []
    codes: list[int] = []
    table: dict[int, int] = {}
    code, following = -1, 258
    for byte in data:
        if code < 0:
            code = byte
            continue
        longer = code << 8 | byte
        known = table.get(longer)
        if known is not None:
            code = known
            continue
        codes.append(code)
        table[longer] = following
        following += 1
        if len(codes) == _CLEAR_AFTER:
            runs.append([*codes, 256])
            codes, table, following = [], {}, 258
        code = byte
    if code >= 0:
        codes.append(code)
    runs.append([*codes, 257])
    pieces = [np.array([1, 0, 0, 0, 0, 0, 0, 0, 0], dtype=np.uint8)]  # the table is cleared first
    for run in runs:
        at = 0
        while at < len(run):
            bits, upto = _width(at)
            part = np.array(run[at:upto], dtype=np.int32)
            pieces.append(((part[:, None] >> np.arange(bits - 1, -1, -1)) & 1).astype(np.uint8).ravel())
            at += len(part)
    return np.packbits(np.concatenate(pieces)).tobytes()


def _decompress(data: bytes, compression: int, need: int) -> bytes:
    """The first ``need`` bytes of a strip or tile, or a little more."""
    if compression == RAW:
        return data
    if compression == LZW:
        return lzw_decode(data, need)
    if compression in (DEFLATE, OLD_DEFLATE):
        stream = zlib.decompressobj()
        try:
            out = stream.decompress(data, need)
        except zlib.error as e:
            raise TiffError(str(e)) from e
        if len(out) < need and not stream.eof:
            raise TiffError("deflate data is cut short")
        return out
    if compression == PACKBITS:
        return unpack_bits(data, need)
    raise TiffError(f"compression {compression} is not supported")


def _compress(data: bytes, compression: int) -> bytes:
    return {RAW: bytes, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, 1), PACKBITS: pack_bits}[compression](data)


def _undo(data: bytes, rows: int, width: int, samples: int, bits: int, predictor: int, order: str) -> np.ndarray:
    """A strip or tile as rows of little-endian sample bytes."""
    per_row = (width * samples * bits + 7) // 8
    if len(data) < rows * per_row:
        raise TiffError("a strip or tile is cut short")
    data = data[: rows * per_row]
    if predictor == 3:
        if bits not in (16, 32, 64):
            raise TiffError("the floating-point predictor needs 16, 32 or 64 bits")
        planes = np.cumsum(np.frombuffer(data, dtype=np.uint8).reshape(rows, -1, samples), axis=1, dtype=np.uint8)
        by_byte = planes.reshape(rows, bits // 8, width * samples)
        return np.ascontiguousarray(by_byte[:, ::-1, :].transpose(0, 2, 1)).reshape(rows, per_row)
    if bits not in (8, 16, 32, 64):
        if predictor == 2:
            raise TiffError(f"the horizontal predictor needs whole bytes, not {bits} bits")
        return np.frombuffer(data, dtype=np.uint8).reshape(rows, per_row)
    kind = np.dtype(f"u{bits // 8}")
    grid = np.frombuffer(data, dtype=kind.newbyteorder(order)).astype(kind).reshape(rows, width, samples)
    if predictor == 2:
        grid = np.cumsum(grid, axis=1, dtype=kind)
    elif predictor != 1:
        raise TiffError(f"predictor {predictor} is not supported")
    return np.ascontiguousarray(grid.astype(kind.newbyteorder("<"))).view(np.uint8).reshape(rows, per_row)


def _directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        raise TiffError("no TIFF header")
    magic = struct.unpack_from(order + "H", data, 2)[0]
    big = magic == 43
    if magic not in (42, 43):
        raise TiffError("no TIFF header")
    at = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)[0]
    count_code, place_code, entry_bytes, room = ("Q", "Q", 20, 8) if big else ("H", "I", 12, 4)
    seen: set[int] = set()
    while at:
        if at in seen or len(seen) > MOST_PAGES:
            raise TiffError("the directories form a loop")
        seen.add(at)
        (n,) = struct.unpack_from(order + count_code, data, at)
        at += struct.calcsize(count_code)
        fields: dict[int, tuple] = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HH" + place_code, data, at + i * entry_bytes)
            code = TYPE_CODES.get(kind)
            if code is None:
                continue
            size, place = count * struct.calcsize("=" + code), at + (i + 1) * entry_bytes - room
            if size > room:
                (place,) = struct.unpack_from(order + place_code, data, place)
            if size > len(data):
                raise TiffError("a field is longer than the file")
            fields[tag] = struct.unpack_from(f"{order}{count}{code}", data, place)
        yield order, fields
        (at,) = struct.unpack_from(order + place_code, data, at + n * entry_bytes)


def decode_pages(data: bytes) -> Iterator[Page]:
    """The pages of a TIFF, one after another; raises :class:`TiffError` on what it cannot decode."""
    try:
        for number, (order, f) in enumerate(_directories(data)):
            yield _page(data, number, order, f)
    except (struct.error, LookupError, TypeError, ArithmeticError, MemoryError) as e:
        raise TiffError(f"broken directory: {type(e).__name__} {e}") from e
    except ValueError as e:
        raise e if isinstance(e, TiffError) else TiffError(f"broken directory: {e}") from e


def _page(data: bytes, number: int, order: str, f: dict[int, tuple]) -> Page:
    one = lambda tag, usual: f.get(tag, (usual,))[0]
    width, length, samples, bits = one(WIDTH, 0), one(LENGTH, 0), one(SAMPLES, 1), one(BITS, 1)
    compression, predictor, tiled = one(COMPRESSION, RAW), one(PREDICTOR, 1), TILE_OFFSETS in f
    if len(set(f.get(BITS, (bits,)))) > 1:
        raise TiffError("samples of different widths")
    if not all(isinstance(x, int) and x > 0 for x in (width, length, samples, bits, one(ROWS_PER_STRIP, 1))):
        raise TiffError("a page without size")
    if length * ((width * samples * bits + 7) // 8) > MOST_PAGE_BYTES:
        raise TiffError("a page is too large")
    planes = samples if one(PLANAR, 1) == 2 else 1
    inside = samples // planes
    if tiled:
        tw, tl, offsets, sizes = one(TILE_WIDTH, 0), one(TILE_LENGTH, 0), f[TILE_OFFSETS], f[TILE_BYTES]
        if not all(isinstance(x, int) and x > 0 for x in (tw, tl)) or tw * tl * inside * bits > 8 * MOST_PAGE_BYTES:
            raise TiffError("tiles without size, or too large")
    else:
        tw, tl, offsets = width, min(one(ROWS_PER_STRIP, length), length), f[STRIP_OFFSETS]
        sizes = f.get(STRIP_BYTES) or ((len(data) - offsets[0],) if len(offsets) == 1 else ())
    across, down = -(-width // tw), -(-length // tl)
    if len(offsets) < planes * across * down or len(sizes) < len(offsets):
        raise TiffError("strips or tiles are missing")
    if bits % 8 and (tiled or planes > 1):
        raise TiffError("tiles or planes of less than a byte")
    step = bits // 8 if bits % 8 == 0 else 0
    whole = np.empty((length, width, planes, inside * step), dtype=np.uint8) if step else []
    for k in range(planes * across * down):
        plane, (y, x) = k // (across * down), divmod(k % (across * down), across)
        rows = tl if tiled else min(tl, length - y * tl)
        stored = data[offsets[k] : offsets[k] + sizes[k]]
        part = _undo(_decompress(stored, compression, rows * ((tw * inside * bits + 7) // 8)), rows, tw, inside, bits, predictor, order)
        if not step:
            whole.append(part)
            continue
        block = part.reshape(rows, tw, inside * step)[: length - y * tl, : width - x * tw]
        whole[y * tl : y * tl + block.shape[0], x * tw : x * tw + block.shape[1], plane] = block
    raw = whole.tobytes() if step else np.concatenate(whole).tobytes()
    return Page(number, width, length, samples, bits, one(SAMPLE_FORMAT, 1), compression, predictor, tiled, raw)


#: Layouts a payload's checksum chooses from, in equal shares: compression, predictor, tiled.
#: Predictor 3 is for floating-point samples, so 8-bit payloads never have it.
LAYOUTS = tuple((c, p, t) for c in (PACKBITS, LZW, DEFLATE) for p in (1, 2) for t in (False, True))


def encode(payload: bytes, layout: tuple[int, int, bool] | None = None) -> bytes:
    """``payload`` as a little-endian TIFF of 8-bit gray pages, ``ROW`` samples wide; its length is a multiple of ``ROW``."""
    compression, predictor, tiled = layout or LAYOUTS[zlib.crc32(payload) % len(LAYOUTS)]
    rows = len(payload) // ROW
    out = [b"II*\0\x08\0\0\0"]
    at = 8
    for top in range(0, rows, PAGE_ROWS):
        length = min(PAGE_ROWS, rows - top)
        tall = ROW if tiled else STRIP_ROWS
        parts = []
        for y in range(top, top + length, tall):
            part = payload[y * ROW : min(y + tall, top + length) * ROW]
            if tiled:
                part = part.ljust(tall * ROW, b"\0")
            if predictor == 2:
                grid = np.frombuffer(part, dtype=np.uint8).reshape(-1, ROW)
                part = np.diff(grid, axis=1, prepend=np.zeros((len(grid), 1), dtype=np.uint8)).tobytes()
            parts.append(_compress(part, compression))
        fields = [(WIDTH, 3, [ROW]), (LENGTH, 3, [length]), (BITS, 3, [8]), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1])]
        place, n = [], len(parts)
        entries = 5 + (5 if tiled else 4) + (predictor != 1)
        body = at + 2 + 12 * entries + 4 + (8 * n if n > 1 else 0)
        for part in parts:
            place.append(body)
            body += len(part)
        sizes = [len(p) for p in parts]
        if tiled:
            fields += [(SAMPLES, 3, [1]), *([(PREDICTOR, 3, [predictor])] if predictor != 1 else [])]
            fields += [(TILE_WIDTH, 3, [ROW]), (TILE_LENGTH, 3, [tall]), (TILE_OFFSETS, 4, place), (TILE_BYTES, 4, sizes)]
        else:
            fields += [(STRIP_OFFSETS, 4, place), (SAMPLES, 3, [1]), (ROWS_PER_STRIP, 3, [min(tall, length)]), (STRIP_BYTES, 4, sizes)]
            fields += [(PREDICTOR, 3, [predictor])] if predictor != 1 else []
        assert len(fields) == entries
        spill_at, spill, packed = at + 2 + 12 * entries + 4, b"", []
        for tag, kind, values in fields:
            data = struct.pack(f"<{len(values)}{TYPE_CODES[kind]}", *values)
            if len(data) > 4:
                packed.append(struct.pack("<HHII", tag, kind, len(values), spill_at + len(spill)))
                spill += data
            else:
                packed.append(struct.pack("<HHI", tag, kind, len(values)) + data.ljust(4, b"\0"))
        pad = b"\0" * (body % 2)
        following = body + len(pad) if top + PAGE_ROWS < rows else 0
        out += [struct.pack("<H", entries), *packed, struct.pack("<I", following), spill, *parts, pad]
        at = body + len(pad)
    return b"".join(out)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """A text's UTF-8 padded with bytes 0 to a positive multiple of ``ROW``, and its length before."""
    data = (text or "").encode()
    return data.ljust(max(1, -(-len(data) // ROW)) * ROW, b"\0"), len(data)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes``, ``media``: every whole text, however long, as a TIFF; null is stored as the empty text.

    One row per input row, repeated rows included, equal texts as equal bytes; an
    empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                padded = [payload_of(t) for t in part.column(1).to_pylist()]
                media = pa.array([encode(p) for p, _ in padded], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for _, n in padded], pa.int64()), media], names=["doc_id", "n_bytes", "media"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


_PAGE_COLUMNS = ("page", "width", "length", "samples", "bits", "sample_format", "compression", "predictor", "tiled", "data", "error")


def tiff_pages(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per page of every TIFF of a column.

    Returns the id (any type, also a struct), the page's number and layout, its
    samples as ``data`` and ``error``. A null gives no row; bytes that cannot be
    decoded, empty ones among them, give the pages before the fault, then one row
    with the fault named and no data. Pages above ``MOST_PAGE_BYTES`` are a fault.
    Repeated rows give repeated pages, an empty table gives an empty result; other
    columns are ignored; an id named like a column of the result is refused. Pages
    come in the order of their rows, those of one TIFF after each other.
    """
    if id_col in _PAGE_COLUMNS:
        raise ValueError(f"the id must not be named {id_col}")
    kinds = [T.IntegerType()] * 8 + [T.BooleanType(), T.BinaryType(), T.StringType()]
    schema = T.StructType([media.schema[id_col], *[T.StructField(n, k) for n, k in zip(_PAGE_COLUMNS, kinds, strict=True)]])
    types = [pa.int32()] * 8 + [pa.bool_(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(1)[i].as_py()
                if data is None:
                    continue
                rows, number = [], -1
                try:
                    for p in decode_pages(data):
                        number = p.number
                        rows.append((p.number, p.width, p.length, p.samples, p.bits, p.sample_format, p.compression, p.predictor, p.tiled, p.data, None))
                        if sum(len(r[9]) for r in rows) > EMIT_BYTES:
                            yield _emitted(batch, i, rows, types)
                            rows = []
                except TiffError as e:
                    rows.append((number + 1, *[None] * 9, str(e)))
                if rows:
                    yield _emitted(batch, i, rows, types)

    def _emitted(batch: pa.RecordBatch, i: int, rows: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
        ids = batch.column(0).take(pa.array([i] * len(rows)))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays([ids, *columns], names=[id_col, *_PAGE_COLUMNS])

    return media.select(id_col, media_col).mapInArrow(run, schema)


_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


class _Payload:
    """What the pages of one TIFF amount to, page by page."""

    def __init__(self, key: dict):
        self.key, self.sha, self.size, self.tail = key, hashlib.sha256(), 0, b""
        self.histogram, self.pages, self.layout = np.zeros(256, dtype=np.int64), 0, ""

    def add(self, data: bytes, layout: str) -> None:
        self.sha.update(data)
        self.size += len(data)
        self.tail = (self.tail + data[-ROW:])[-ROW:]
        self.histogram += np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
        self.pages += 1
        self.layout = self.layout or layout

    def row(self) -> tuple:
        n, counts = self.size, self.histogram
        total, squares = int(counts @ np.arange(256)), int(counts @ np.arange(256) ** 2)
        share = counts[counts > 0] / n
        spread = math.sqrt(max(0, squares * n - total * total)) / n
        feature = f"pages={self.pages};layout={self.layout};mean={total / n:.4f};sd={spread:.4f};entropy={float(-(share * np.log2(share)).sum()):.4f}"
        k = self.key
        return k["doc_id"], k["n_bytes"], n, self.sha.hexdigest(), zlib.crc32(self.tail), k["media_bytes"], k["media_sha256"], feature


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages, those of one TIFF after each other, to one row a TIFF."""
    names = [c.split()[0] for c in _DIGEST.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    now, rows = None, []
    for batch in batches:
        for key, compression, predictor, tiled, data, error in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if error is not None:
                raise TiffError(f"document {key['doc_id']}: {error}")
            if now is None or key["row"] != now.key["row"]:
                rows += [now.row()] if now else []
                now = _Payload(key)
            now.add(data, f"{compression}.{predictor}.{'t' if tiled else 's'}")
        if len(rows) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows = []
    rows += [now.row()] if now else []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def op1_tiff_pages(spark, sf_dir: str) -> DataFrame:
    """Texts stored as TIFFs and read back page by page; the pages of one follow each other where they are read, so none is shuffled."""
    stored = store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    size, digest = F.octet_length("media").cast("long"), F.sha2("media", 256)
    key = F.struct(F.monotonically_increasing_id().alias("row"), "doc_id", "n_bytes", size.alias("media_bytes"), digest.alias("media_sha256"))
    pages = tiff_pages(stored.select(key.alias("key"), "media"), "key")
    return pages.select("key", "compression", "predictor", "tiled", "data", "error").mapInArrow(_fold, _DIGEST)
