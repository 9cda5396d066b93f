"""TIFF in media columns: a reader that walks image directories, and a writer.

The reader follows the chain of image file directories of a little- or big-endian
TIFF, decodes uncompressed, PackBits, LZW and deflate strips or tiles, undoes the
horizontal predictor and gives one page per directory.  Samples have 8 bits; 1 to 4
samples a pixel, chunky.  The writer makes strips or tiles in any of these codings.

Defined cases: null media has no page; bytes that aren't a readable TIFF give one row
with ``error`` and no samples after the pages read so far, whatever is wrong with them
(sizes that don't fit, missing strips, blocks outside the file or cut short, separate
planes); a directory chain that loops is an error; an image without pixels has empty
samples; a page of over ``MAX_SAMPLES`` bytes is an error.  Null texts are stored as empty
ones; null or repeated ids give one row each, equal texts equal values; very long texts
get several pages; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_bytes

# Tag numbers and codes of TIFF 6.0 and its technical notes (fixed values).
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 284, 317, 322, 323, 324, 325
CODES = {"none": 1, "lzw": 5, "deflate": 8, "packbits": 32773}
_OLD_DEFLATE = 32946
_SIZES = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}
#: Bytes of a page's samples, at most.
MAX_SAMPLES = 1 << 30


@dataclass
class Page:
    number: int
    width: int
    height: int
    samples_per_pixel: int
    compression: int
    predictor: int
    samples: bytes


def unpack_bits(data: bytes, most: int = MAX_SAMPLES) -> bytes:
    out, at, n = bytearray(), 0, len(data)
    while at < n and len(out) < most:
        head = data[at]
        if head < 128:
            out += data[at + 1 : at + 2 + head]
            at += 2 + head
        elif head > 128:
            out += data[at + 1 : at + 2] * (257 - head)
            at += 2
        else:
            at += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, at, n, literal = bytearray(), 0, len(data), 0

    def flush(upto: int) -> None:
        k = literal
        while k < upto:
            part = data[k : min(upto, k + 128)]
            out.append(len(part) - 1)
            out.extend(part)
            k += len(part)

    while at < n:
        run = 1
        while run < 128 and at + run < n and data[at + run] == data[at]:
            run += 1
        if run >= 3:
            flush(at)
            out.extend((257 - run, data[at]))
            at += run
            literal = at
        else:
            at += run
    flush(n)
    return bytes(out)


def lzw_decode(data: bytes, most: int = MAX_SAMPLES) -> bytes:
    """Most significant bit first, 9 to 12 bits, codes widen one code early."""
    clear, end = 256, 257
    first = [bytes([k]) for k in range(256)] + [b"", b""]
    table, out, previous = list(first), [], b""
    held = bits = size = 0
    width = 9
    for byte in data:
        held = (held << 8) | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == clear:
            table, width, previous = list(first), 9, b""
            continue
        if code == end:
            break
        if code < len(table):
            entry = table[code]
        elif code == len(table) and previous:
            entry = previous + previous[:1]
        else:
            raise ValueError("LZW code out of order")
        if previous:
            table.append(previous + entry[:1])
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
        out.append(entry)
        size += len(entry)
        if size >= most:
            break
        previous = entry
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    first = {bytes([k]): k for k in range(256)}
    table, out = dict(first), bytearray()
    held = bits = 0
    width, following = 9, 258

    def put(code: int) -> None:
        nonlocal held, bits
        held = (held << width) | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append((held >> bits) & 255)
            held &= (1 << bits) - 1

    put(256)
    word = b""
    for k in range(len(data)):
        longer = word + data[k : k + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = following
        following += 1
        if following == 4094:
            put(256)
            table, width, following = dict(first), 9, 258
        elif following + 1 > 1 << width:
            width += 1
        word = data[k : k + 1]
    if word:
        put(table[word])
        following += 1
        if following + 1 > 1 << width and width < 12:
            width += 1
    put(257)
    if bits:
        out.append((held << (8 - bits)) & 255)
    return bytes(out)


def _decode(data: bytes, code: int, most: int) -> bytes:
    """Decoded bytes; decoders stop once they have ``most``."""
    if code == 1:
        return data
    if code == CODES["packbits"]:
        return unpack_bits(data, most)
    if code == CODES["lzw"]:
        return lzw_decode(data, most)
    if code in (CODES["deflate"], _OLD_DEFLATE):
        # A limit of 0 would mean none.
        return zlib.decompressobj().decompress(data, max(1, most))
    raise ValueError(f"compression {code} isn't known")


def _encode(data: bytes, name: str, level: int) -> bytes:
    return {"none": lambda d: d, "packbits": pack_bits, "lzw": lzw_encode, "deflate": lambda d: zlib.compress(d, level)}[name](data)


def _difference(block: np.ndarray) -> np.ndarray:
    out = block.copy()
    out[:, 1:] -= block[:, :-1]
    return out


def write_tiff(pages: list[np.ndarray], compression: str = "deflate", predictor: bool = True, rows_per_strip: int = 256, tile: tuple[int, int] | None = None, big_endian: bool = False, level: int = 1) -> bytes:
    """Pages are uint8 arrays (height, width) or (height, width, samples).  PackBits
    takes rows as they come, without a predictor."""
    order = ">" if big_endian else "<"
    out = bytearray((b"MM" if big_endian else b"II") + struct.pack(order + "HI", 42, 0))
    link = 4
    predictor = predictor and compression in ("lzw", "deflate")
    for page in pages:
        image = page.reshape(page.shape[0], page.shape[1], -1)
        height, width, depth = image.shape
        if tile:
            th, tw = tile
            blocks = []
            for y in range(0, height, th):
                for x in range(0, width, tw):
                    whole = np.zeros((th, tw, depth), np.uint8)
                    part = image[y : y + th, x : x + tw]
                    whole[: part.shape[0], : part.shape[1]] = part
                    blocks.append(whole)
        else:
            blocks = [image[y : y + rows_per_strip] for y in range(0, height, rows_per_strip)]
        offsets, counts = [], []
        for block in blocks:
            coded = _encode((_difference(block) if predictor else block).tobytes(), compression, level)
            offsets.append(len(out))
            counts.append(len(coded))
            out += coded
        tags = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8] * depth), (COMPRESSION, 3, [CODES[compression]]), (PHOTOMETRIC, 3, [1 if depth < 3 else 2]), (SAMPLES, 3, [depth])]
        if predictor:
            tags.append((PREDICTOR, 3, [2]))
        if tile:
            tags += [(TILE_WIDTH, 4, [tile[1]]), (TILE_HEIGHT, 4, [tile[0]]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)]
        else:
            tags += [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [rows_per_strip]), (STRIP_COUNTS, 4, counts)]
        entries = []
        for tag, kind, values in sorted(tags):
            form, size = _SIZES[kind]
            data = struct.pack(f"{order}{len(values)}{form}", *values)
            if len(data) > 4:
                out += b"\0" * (len(out) % 2)
                data, at = struct.pack(order + "I", len(out)), data
                out += at
            entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + data.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        out[link : link + 4] = struct.pack(order + "I", len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def read_pages(data: bytes) -> Iterator[Page]:
    """Pages in directory order; ValueError for what can't be read."""
    try:
        yield from _read_pages(data)
    except (struct.error, zlib.error, KeyError, IndexError, OverflowError, MemoryError) as e:
        raise ValueError(f"not a readable TIFF: {type(e).__name__} {e}") from e


def _read_pages(data: bytes) -> Iterator[Page]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("no TIFF header")
    at, seen, number = struct.unpack_from(order + "I", data, 4)[0], set(), 0
    while at:
        if at in seen:
            raise ValueError("the directories form a loop")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags: dict[int, list[int]] = {}
        for k in range(n):
            spot = at + 2 + 12 * k
            tag, kind, count = struct.unpack_from(order + "HHI", data, spot)
            if kind not in _SIZES:
                continue
            form, size = _SIZES[kind]
            place = spot + 8 if count * size <= 4 else struct.unpack_from(order + "I", data, spot + 8)[0]
            tags[tag] = list(struct.unpack_from(f"{order}{count}{form}", data, place))
        (after,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
        yield _page(data, tags, number)
        at, number = after, number + 1


def _page(data: bytes, tags: dict[int, list[int]], number: int) -> Page:
    width, height = tags[WIDTH][0], tags[HEIGHT][0]
    depth = tags.get(SAMPLES, [1])[0]
    if set(tags.get(BITS, [1])) != {8}:
        raise ValueError("samples must have 8 bits")
    if not 1 <= depth <= 4 or (depth > 1 and tags.get(PLANAR, [1])[0] != 1):
        raise ValueError("1 to 4 samples a pixel, one after the other, can be read")
    if width * height * depth > MAX_SAMPLES:
        raise ValueError(f"a page of over {MAX_SAMPLES} bytes")
    code, predictor = tags.get(COMPRESSION, [1])[0], tags.get(PREDICTOR, [1])[0]
    if predictor not in (1, 2):
        raise ValueError(f"predictor {predictor} isn't known")
    if not width or not height:
        return Page(number, width, height, depth, code, predictor, b"")

    def block(offset: int, count: int, rows: int, columns: int) -> np.ndarray:
        need = rows * columns * depth
        if offset + count > len(data):
            raise ValueError("a strip or tile lies outside the file")
        raw = np.frombuffer(_decode(data[offset : offset + count], code, need), np.uint8)
        if raw.size < need:
            raise ValueError("a strip or tile is cut short")
        got = raw[:need].reshape(rows, columns, depth)
        # Each row's differences add up, modulo 256.
        return np.add.accumulate(got, axis=1, dtype=np.uint8) if predictor == 2 else got

    tiled = TILE_OFFSETS in tags
    # A strip is a block as wide as the page whose last one ends with it.
    columns = tags[TILE_WIDTH][0] if tiled else width
    rows = tags[TILE_HEIGHT][0] if tiled else min(tags.get(ROWS_PER_STRIP, [height])[0], height)
    places = list(zip(tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_COUNTS if tiled else STRIP_COUNTS], strict=True))
    if not rows or not columns or columns * rows * depth > MAX_SAMPLES:
        raise ValueError("strips or tiles of no size, or too large")
    across = -(-width // columns)
    if len(places) != across * -(-height // rows):
        raise ValueError("as many strips or tiles as don't fill the page")
    image = np.empty((height, width, depth), np.uint8)
    for k, (o, c) in enumerate(places):
        y, x = k // across * rows, k % across * columns
        image[y : y + rows, x : x + columns] = block(o, c, rows if tiled else min(rows, height - y), columns)[: height - y, : width - x]
    return Page(number, width, height, depth, code, predictor, image.tobytes())


def tiff_pages(df: DataFrame, media_col: str = "media", id_col: str = "doc_id") -> DataFrame:
    """One row per page: ``(id, page, width, height, samples_per_pixel, compression,
    predictor, samples, error)``."""
    rows = df.select(F.col(id_col).alias("__id"), F.col(media_col).cast("binary").alias("__media"))
    names = ["__id", "page", "width", "height", "samples_per_pixel", "compression", "predictor", "samples", "error"]
    kinds = [pa.int32()] * 6 + [pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, media in zip(b.column(0), b.column(1), strict=True):
                out = []
                if media.is_valid:
                    try:
                        for p in read_pages(media.as_py()):
                            out.append((p.number, p.width, p.height, p.samples_per_pixel, p.compression, p.predictor, p.samples, None))
                    except ValueError as e:
                        out.append((None,) * 7 + (str(e),))
                made = [pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * len(out), b.column(0).type), *made], names)

    fields = f"__id {rows.schema['__id'].dataType.simpleString()}, page int, width int, height int, samples_per_pixel int, compression int, predictor int, samples binary, error string"
    return rows.mapInArrow(run, fields).withColumnRenamed("__id", id_col)


#: Bytes of a row of the images that hold texts, and rows of one page.
_COLUMNS, _PAGE_ROWS = 64, 1 << 16


#: Ways to store a text, taken in turn by a checksum of it: compression, tile, byte order.
WAYS = (
    ("deflate", None, False), ("packbits", None, False), ("deflate", (16, 64), True), ("deflate", None, True),
    ("lzw", None, False), ("deflate", (64, 32), False), ("none", (16, 16), False), ("deflate", None, False),
)


def text_to_tiff(data: bytes) -> bytes:
    """The text, padded with bytes 0 to a positive multiple of 64, as pages of 64
    columns; strips or tiles in one of ``WAYS``, LZW and deflate with a horizontal predictor."""
    padded = data + b"\0" * (-len(data) % _COLUMNS or (0 if data else _COLUMNS))
    image = np.frombuffer(padded, np.uint8).reshape(-1, _COLUMNS)
    compression, tile, big_endian = WAYS[zlib.crc32(data) % len(WAYS)]
    return write_tiff([image[at : at + _PAGE_ROWS] for at in range(0, len(image), _PAGE_ROWS)], compression, tile=tile, big_endian=big_endian)


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as a TIFF, read its pages back and describe them: ``(id,
    n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature, n_pages)``.  The feature is the pages' mean, deviation and entropy."""
    rows = df.select(F.col(id_col).alias("__id"), text_bytes(text_col).alias("__text"))
    names = ["__id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_pages"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def one(data: bytes) -> tuple:
        media = text_to_tiff(data)
        digest, size, counts, tail, pages = hashlib.sha256(), 0, np.zeros(256, np.int64), b"", 0
        for p in read_pages(media):
            digest.update(p.samples)
            size += len(p.samples)
            counts += np.bincount(np.frombuffer(p.samples, np.uint8), minlength=256)
            tail, pages = p.samples[-64:], pages + 1
        share = counts[counts > 0] / size
        mean = float(counts @ np.arange(256)) / size
        deviation = float(np.sqrt(max(0.0, counts @ np.arange(256) ** 2 / size - mean * mean)))
        feature = json.dumps({"mean": round(mean, 4), "deviation": round(deviation, 4), "entropy": round(float(-(share * np.log2(share)).sum()), 4), "levels": int((counts > 0).sum())})
        return len(data), size, digest.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature, pages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [one(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds))], names)

    fields = f"__id {rows.schema['__id'].dataType.simpleString()}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_pages bigint"
    return rows.mapInArrow(run, fields).withColumnRenamed("__id", id_col)
