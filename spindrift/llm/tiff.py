"""Media columns: TIFF files in a binary column (operator 5).

``decode_pages`` walks the chain of image directories of every file and emits one row per page with its samples, after
decoding PackBits, LZW or deflate strips and tiles and undoing horizontal differencing.  ``encode_text`` stores texts as
8-bit grey pages.  Formats are those of the TIFF 6.0 specification.

A null file gives no page.  A file that can't be read gives one row (page -1) with ``error`` set and no samples; a page that
can't be read, that has no samples or that declares more than its data can hold gives a row with ``error``, and the other
pages of the file are kept.  Repeated rows and null keys are worked on like all others, each by itself.  An empty table
gives an empty result, extra input columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: tags, field sizes and compression codes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_SIZES, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES = 322, 323, 324, 325
FIELD_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773

#: Bytes that one byte of data can stand for at the most, by compression.
_EXPANDS = {NONE: 1, LZW: 2730, DEFLATE: 1033, OLD_DEFLATE: 1033, PACKBITS: 64}

PAGE_SCHEMA = "page int, width int, height int, samples int, compression int, predictor int, pixels binary, feature string, error string"


# ---- codecs -------------------------------------------------------------------------------------------------------


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        run = 1
        while run < 128 and i + run < len(data) and data[i + run] == data[i]:
            run += 1
        if run > 2:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        end = i + 1
        while end < len(data) and end - i < 128 and data[end : end + 3] != data[end : end + 1] * 3:
            end += 1
        out += bytes((end - i - 1,)) + data[i:end]
        i = end
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first; the width grows one code early; 256 clears, 257 ends."""
    out: list[bytes] = []
    table: list[bytes] = []
    held = bits = 0
    width, previous = 9, None
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, previous = [bytes((i,)) for i in range(256)] + [b"", b""], 9, None
            continue
        if previous is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else previous + previous[:1]
            table.append(previous + entry[:1])
        out.append(entry)
        previous = entry
        size = len(table) + 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    held = bits = 0
    out = bytearray()

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    table, width = {bytes((i,)): i for i in range(256)}, 9
    following = 258
    put(256, 9)
    word = b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word], width)
        table[longer] = following
        following += 1
        width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
        if following == 4094:
            put(256, width)
            table, width, following = {bytes((k,)): k for k in range(256)}, 9, 258
        word = data[i : i + 1]
    if word:
        put(table[word], width)
        following += 1
        width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
    put(257, width)
    if bits:
        out.append((held << (8 - bits)) & 255)
    return bytes(out)


_DECODE = {NONE: bytes, LZW: lzw_decode, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: unpack_bits}
_ENCODE = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, 1), PACKBITS: pack_bits}


# ---- reading ------------------------------------------------------------------------------------------------------


def directories(data: bytes) -> Iterator[dict[int, list[int]]]:
    """The integer fields of each image directory, in the order of the chain; a chain that loops ends."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen = set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        fields = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            where = at + 10 + 12 * k
            if kind not in (1, 3, 4):
                continue
            if count * FIELD_BYTES[kind] > 4:
                (where,) = struct.unpack_from(order + "I", data, where)
            fields[tag] = list(struct.unpack_from(f"{order}{count}{'BHI'[(1, 3, 4).index(kind)]}", data, where))
        yield fields
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def read_page(data: bytes, fields: dict[int, list[int]]) -> np.ndarray:
    """8-bit samples of one page as rows x columns x samples."""
    one = lambda tag, default: fields.get(tag, [default])[0]
    width, height, samples = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
    if set(fields.get(BITS, [1])) != {8}:
        raise ValueError("samples are not of 8 bits")
    decode = _DECODE.get(one(COMPRESSION, NONE))
    if decode is None:
        raise ValueError(f"compression {one(COMPRESSION, NONE)} is not known")
    planar = one(PLANAR, 1) == 2 and samples > 1
    depth, planes = (1, samples) if planar else (samples, 1)
    tiled = TILE_OFFSETS in fields
    if width < 1 or height < 1 or samples < 1:
        raise ValueError("the page has no samples")
    w = one(TILE_WIDTH, width) if tiled else width
    h = one(TILE_HEIGHT, height) if tiled else min(one(ROWS_PER_STRIP, height), height)
    offsets, sizes = (fields[TILE_OFFSETS], fields[TILE_SIZES]) if tiled else (fields[STRIP_OFFSETS], fields[STRIP_SIZES])
    if w < 1 or h < 1:
        raise ValueError("strips or tiles without samples")
    across, down = -(-width // w), -(-height // h)
    held = sum(len(data[at : at + n]) for at, n in zip(offsets, sizes, strict=True)) * _EXPANDS[one(COMPRESSION, NONE)]
    if width * height * samples > held or (tiled and w * h * depth > held):
        raise ValueError("the page is larger than its data")
    out = np.zeros((height, width, samples), np.uint8)
    for k, (at, n) in enumerate(zip(offsets, sizes, strict=True)):
        plane, k = divmod(k, across * down)
        y, x = k // across * h, k % across * w
        if plane >= planes:
            raise ValueError("more strips or tiles than the page has")
        rows = h if tiled else min(h, height - y)
        raw = np.frombuffer(decode(data[at : at + n]), np.uint8)[: rows * w * depth]
        block = raw.reshape(rows, w, depth)
        if one(PREDICTOR, 1) == 2:
            block = np.cumsum(block, axis=1, dtype=np.uint8)
        part = slice(plane, plane + 1) if planar else slice(None)
        out[y : y + rows, x : x + w, part] = block[: height - y, : width - x]
    return out


def page_feature(pixels: np.ndarray) -> str:
    """Size, mean, standard deviation and the shares of eight equal ranges of brightness."""
    counts = np.bincount(pixels.ravel() >> 5, minlength=8)
    shares = ",".join(f"{c / max(1, pixels.size):.4f}" for c in counts)
    mean, deviation = (float(pixels.mean()), float(pixels.std())) if pixels.size else (0.0, 0.0)
    return f"{pixels.shape[1]}x{pixels.shape[0]}x{pixels.shape[2]};mean={mean:.4f};sd={deviation:.4f};hist={shares}"


def pages_of(data: bytes) -> Iterator[tuple]:
    walked = iter(directories(data))
    page = -1
    while True:
        try:
            fields = next(walked)
        except StopIteration:
            return
        except (ValueError, struct.error) as e:
            yield -1, None, None, None, None, None, None, None, str(e)
            return
        page += 1
        meta = [fields.get(t, [d])[0] for t, d in ((WIDTH, 0), (HEIGHT, 0), (SAMPLES, 1), (COMPRESSION, 1), (PREDICTOR, 1))]
        try:
            pixels = read_page(data, fields)
            yield page, *meta, pixels.tobytes(), page_feature(pixels), None
        except (ValueError, KeyError, IndexError, OverflowError, MemoryError, struct.error, zlib.error) as e:
            yield page, *meta, None, None, str(e) or type(e).__name__


def decode_pages(df: DataFrame, key: str, media: str) -> DataFrame:
    """One row per page of every file: the key, the page's number, geometry, samples and a feature."""
    rows = df.select(F.col(key).alias("_key"), F.col(media).alias("_media"))
    kind = rows.schema["_key"].dataType.simpleString()
    names = [x.split()[0] for x in PAGE_SCHEMA.split(", ")]

    def run(batches):
        target = None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keys, out = part.column(0), []
                for i, data in enumerate(part.column(1).to_pylist()):
                    if data is not None:
                        out += [(i, *page) for page in pages_of(data)]
                target = target or pa.schema([("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("compression", pa.int32()), ("predictor", pa.int32()), ("pixels", pa.binary()), ("feature", pa.string()), ("error", pa.string())])
                columns = [pa.array([r[k + 1] for r in out], f.type) for k, f in enumerate(target)]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array([r[0] for r in out], pa.int64())), *columns], ["_key", *names])

    return rows.mapInArrow(run, f"_key {kind}, {PAGE_SCHEMA}").withColumnRenamed("_key", key)


# ---- writing ------------------------------------------------------------------------------------------------------


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, strip_rows: int = 64, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """Pages of 8-bit samples (rows x columns x samples) as one file, in strips or in tiles of (columns, rows)."""
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + b"\0\0\0\0")
    link = 4
    for pixels in pages:
        height, width, samples = pixels.shape
        w, h = tile or (width, strip_rows)
        offsets, sizes = [], []
        for y in range(0, height, h):
            for x in range(0, width, w):
                block = pixels[y : y + h, x : x + w]
                if tile:
                    block = np.pad(block, ((0, h - block.shape[0]), (0, w - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros_like(block[:, :1]))
                raw = _ENCODE[compression](np.ascontiguousarray(block, np.uint8).tobytes())
                offsets.append(len(out))
                sizes.append(len(raw))
                out += raw
        fields = {WIDTH: [width], HEIGHT: [height], BITS: [8] * samples, COMPRESSION: [compression], PHOTOMETRIC: [1 if samples == 1 else 2], SAMPLES: [samples], PREDICTOR: [predictor]}
        fields |= {TILE_WIDTH: [w], TILE_HEIGHT: [h], TILE_OFFSETS: offsets, TILE_SIZES: sizes} if tile else {STRIP_OFFSETS: offsets, ROWS_PER_STRIP: [h], STRIP_SIZES: sizes}
        entries = bytearray()
        for tag in sorted(fields):
            packed = struct.pack(f"{order}{len(fields[tag])}I", *fields[tag])
            if len(packed) > 4:
                where, packed = len(out), packed
                out += packed
                packed = struct.pack(order + "I", where)
            entries += struct.pack(order + "HHI", tag, 4, len(fields[tag])) + packed
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def text_image(text: str | None, block: int = 576, width: int = 64) -> np.ndarray:
    """A text's UTF-8 bytes, filled with 255 up to a positive multiple of block, as a grey image."""
    raw = (text or "").encode()
    raw += b"\xff" * (-len(raw) % block if raw else block)
    return np.frombuffer(raw, np.uint8).reshape(-1, width, 1)


def encode_text(df: DataFrame, key: str, text: str, compression: int = DEFLATE, predictor: int = 2) -> DataFrame:
    """Each text (null: empty) as a TIFF file of one grey page: the key, the text's bytes and the file."""
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                media = [write_tiff([text_image(t)], compression, predictor) for t in texts]
                sizes = [len((t or "").encode()) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["_key", "n_bytes", "media"])

    return rows.mapInArrow(run, f"_key {kind}, n_bytes long, media binary").withColumnRenamed("_key", key)
