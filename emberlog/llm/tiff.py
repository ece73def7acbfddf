"""TIFF media columns: a reader of strips and tiles, a row a page, and a writer to test it.

The reader walks the chain of image directories in either byte order, decodes PackBits,
LZW and deflate, undoes horizontal differencing, and puts strips or tiles together.  It
takes 8-bit and 16-bit samples, any number of them a pixel, chunky or planar.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

#: Numbers of the format: tags, sizes of field types, codecs.
TAGS = {
    "width": 256,
    "height": 257,
    "bits": 258,
    "compression": 259,
    "photometric": 262,
    "offsets": 273,
    "samples": 277,
    "rows_per_strip": 278,
    "counts": 279,
    "planar": 284,
    "predictor": 317,
    "tile_width": 322,
    "tile_height": 323,
    "tile_offsets": 324,
    "tile_counts": 325,
}
FIELD_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
CODECS = {1: "none", 5: "lzw", 8: "deflate", 32946: "deflate", 32773: "packbits"}
CODES = {"none": 1, "lzw": 5, "deflate": 8, "packbits": 32773}

#: No codec makes more bytes of one; pages that claim more are not read.
EXPANSION = 1500

#: Layout of stored payloads: bytes of a row, rows of a page, rows of a strip, side of a tile.
ROW_BYTES, PAGE_ROWS, STRIP_ROWS, TILE = 576, 4096, 64, 192


def pack_packbits(data: bytes) -> bytes:
    """Runs of three or more equal bytes as repeats, all between as literals."""
    out, n = bytearray(), len(data)
    a = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(a)) + 1
    starts = np.concatenate([[0], edges, [n]]) if n else np.zeros(1, np.int64)
    sizes = np.diff(starts)
    literal = 0  # where pending literals begin

    def flush(to: int) -> None:
        for at in range(literal, to, 128):
            part = data[at : min(to, at + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    for k in np.flatnonzero(sizes >= 3).tolist():
        at, size = int(starts[k]), int(sizes[k])
        flush(at)
        literal = at + size
        while size:
            part = min(size, 128)
            if part == 1:
                out += bytes((0, data[at]))
            else:
                out += bytes((257 - part, data[at]))
            size -= part
    flush(n)
    return bytes(out)


def unpack_packbits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant first, the width growing one code early."""
    bits, held, out = 0, 0, bytearray()

    def put(code: int, width: int) -> None:
        nonlocal bits, held
        held = held << width | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    table = {bytes((i,)): i for i in range(256)}
    width, after, word = 9, 258, b""
    put(256, width)
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word], width)
        table[longer] = after
        after += 1
        word = data[i : i + 1]
        if after == 4095:
            put(256, 12)
            table = {bytes((k,)): k for k in range(256)}
            width, after = 9, 258
        elif after + 1 > 1 << width:
            width += 1
    if word:
        put(table[word], width)
        after += 1
        if after + 1 > 1 << width and width < 12:
            width += 1
    put(257, width)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def unpack_lzw(data: bytes, size: int) -> bytes:
    out, parts = 0, []
    table: list[bytes] = [bytes((i,)) for i in range(256)] + [b"", b""]
    base = list(table)
    width, bits, held, last = 9, 0, 0, b""
    for byte in data:
        held = held << 8 | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 256:
            table, width, last = list(base), 9, b""
            continue
        if code == 257 or out >= size:
            break
        if not last:
            word = table[code]
        else:
            word = table[code] if code < len(table) else last + last[:1]
            table.append(last + word[:1])
        parts.append(word)
        out += len(word)
        last = word
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return b"".join(parts)


def unpack(codec: str, data: bytes, size: int) -> bytes:
    if codec == "deflate":
        return zlib.decompressobj().decompress(data, size)
    if codec == "lzw":
        return unpack_lzw(data, size)
    return unpack_packbits(data, size) if codec == "packbits" else data


def pack(codec: str, data: bytes) -> bytes:
    if codec == "deflate":
        return zlib.compress(data, 1)
    if codec == "lzw":
        return pack_lzw(data)
    return pack_packbits(data) if codec == "packbits" else data


def pages(data: bytes):
    """Each image directory of a file as (facts, samples), samples an array rows x columns x samples."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        found: dict[int, list[int]] = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            size = FIELD_BYTES.get(kind, 1) * count
            where = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
            if kind in (1, 3, 4):
                found[tag] = list(struct.unpack_from(f"{order}{count}{'BHI'[(kind > 1) + (kind > 3)]}", data, where))
        yield _page(data, order, found)
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def _page(data: bytes, order: str, found: dict[int, list[int]]):
    def one(name: str, default: int | None = None) -> int:
        value = found.get(TAGS[name])
        if value is None and default is None:
            raise ValueError(f"a page lacks {name}")
        return value[0] if value else default

    width, height, samples = one("width"), one("height"), one("samples", 1)
    bits = found.get(TAGS["bits"], [1])
    codec = CODECS.get(one("compression", 1))
    if codec is None or set(bits) not in ({8}, {16}):
        raise ValueError(f"compression {one('compression', 1)} with {bits} bits is not supported")
    kind = np.dtype(f"{order}u{bits[0] // 8}")
    planar = one("planar", 1) == 2 and samples > 1
    inner, planes = (1, samples) if planar else (samples, 1)
    tiled = TAGS["tile_offsets"] in found
    if tiled:
        cell_w, cell_h = one("tile_width"), one("tile_height")
        offsets, counts = found[TAGS["tile_offsets"]], found[TAGS["tile_counts"]]
    else:
        cell_w, cell_h = width, min(height, one("rows_per_strip", height)) or 1
        offsets, counts = found[TAGS["offsets"]], found[TAGS["counts"]]
    if height * width * samples * kind.itemsize > EXPANSION * len(data):
        raise ValueError(f"{len(data)} bytes cannot hold {width} x {height} pixels")
    if not (width and height and samples and cell_w and cell_h):
        raise ValueError("a page without pixels")
    across, down = -(-width // cell_w), -(-height // cell_h)
    out = np.zeros((height, width, samples), kind.newbyteorder("="))
    for k, (at, size) in enumerate(zip(offsets, counts, strict=True)):
        plane, rest = divmod(k, across * down)
        top, left = rest // across * cell_h, rest % across * cell_w
        rows = cell_h if tiled else min(cell_h, height - top)
        raw = unpack(codec, data[at : at + size], rows * cell_w * inner * kind.itemsize)
        cell = np.frombuffer(raw, kind, rows * cell_w * inner).reshape(rows, cell_w, inner).astype(out.dtype)
        if one("predictor", 1) == 2:
            cell = np.cumsum(cell, axis=1, dtype=out.dtype)
        rows, columns = min(rows, height - top), min(cell_w, width - left)
        to = slice(plane, plane + 1) if planes > 1 else slice(None)
        out[top : top + rows, left : left + columns, to] = cell[:rows, :columns]
    facts = {"width": width, "height": height, "samples": samples, "bits": bits[0], "compression": codec, "predictor": one("predictor", 1), "tiled": tiled}
    return facts, out


def build(images: list[tuple[np.ndarray, str, int, bool]]) -> bytes:
    """A little-endian file of 8-bit grey pages: (rows x columns, codec, predictor, tiled) each."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for image, codec, predictor, tiled in images:
        height, width = image.shape
        cells = []
        if tiled:
            padded = np.zeros((-(-height // TILE) * TILE, -(-width // TILE) * TILE), np.uint8)
            padded[:height, :width] = image
            cells = [padded[y : y + TILE, x : x + TILE] for y in range(0, padded.shape[0], TILE) for x in range(0, padded.shape[1], TILE)]
        else:
            cells = [image[y : y + STRIP_ROWS] for y in range(0, height, STRIP_ROWS)]
        offsets, counts = [], []
        for cell in cells:
            if predictor == 2:
                cell = np.diff(cell, axis=1, prepend=np.uint8(0))
            part = pack(codec, np.ascontiguousarray(cell).tobytes())
            offsets.append(len(out))
            counts.append(len(part))
            out += part
        fields = {"width": [width], "height": [height], "bits": [8], "compression": [CODES[codec]], "photometric": [1], "samples": [1], "predictor": [predictor]}
        fields |= {"tile_width": [TILE], "tile_height": [TILE], "tile_offsets": offsets, "tile_counts": counts} if tiled else {"offsets": offsets, "rows_per_strip": [STRIP_ROWS], "counts": counts}
        out += b"\0" * (len(out) % 2)
        entries = []
        for name, values in sorted(fields.items(), key=lambda x: TAGS[x[0]]):
            if len(values) > 1:
                where = len(out)
                out += struct.pack(f"<{len(values)}I", *values)
            else:
                where = values[0]
            entries.append(struct.pack("<HHII", TAGS[name], 4, len(values), where))
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def store(payload: bytes) -> bytes:
    """The payload, a positive multiple of ROW_BYTES, as pages of rows of samples.

    Full pages are deflated tiles of differences, the rest but for its last row deflated
    strips of differences, and the last row, which holds the padding, PackBits; a payload
    of one row is LZW.  Equal payloads give equal files.
    """
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES)
    if len(rows) == 1:
        return build([(rows, "lzw", 1, False)])
    images = []
    body = rows[:-1]
    for at in range(0, len(body), PAGE_ROWS):
        part = body[at : at + PAGE_ROWS]
        images.append((part, "deflate", 2, len(part) == PAGE_ROWS))
    return build([*images, (rows[-1:], "packbits", 1, False)])


PAGE = T.StructType(
    [
        T.StructField("page", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("samples", T.IntegerType()),
        T.StructField("bits", T.IntegerType()),
        T.StructField("compression", T.StringType()),
        T.StructField("predictor", T.IntegerType()),
        T.StructField("tiled", T.BooleanType()),
        T.StructField("pixels", T.BinaryType()),
    ]
)
_arrow_page = pa.struct([("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("bits", pa.int32()), ("compression", pa.string()), ("predictor", pa.int32()), ("tiled", pa.bool_()), ("pixels", pa.binary())])


def decode_pages(df: DataFrame, media: str = "media") -> DataFrame:
    """One row per page of each file: all other columns, page (from 0), its facts and pixels.

    ``pixels`` are the samples by rows, those of 16 bits little-endian.  A null or empty
    file gives no row; bytes that are no TIFF, or of a kind not supported, give one row
    with a null page and the reason in ``error``.  Page columns replace others so named.
    """
    names = [*PAGE.names, "error"]
    kept = [f for f in df.schema if f.name not in names and f.name != media]

    def run(batches):
        for batch in slices(batches, media):
            at, rows = [], []
            size = 0
            for i, data in enumerate(batch.column(batch.schema.get_field_index(media)).to_pylist()):
                if not data:
                    continue
                try:
                    for k, (facts, samples) in enumerate(pages(data)):
                        pixels = samples.astype(samples.dtype.newbyteorder("<")).tobytes()
                        rows.append(facts | {"page": k, "pixels": pixels, "error": None})
                        at.append(i)
                        size += len(pixels)
                except (ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
                    rows.append({"error": str(e) or type(e).__name__})
                    at.append(i)
                if size > 16 << 20:
                    yield _rows(batch, kept, at, rows)
                    at, rows, size = [], [], 0
            if rows:
                yield _rows(batch, kept, at, rows)

    def _rows(batch, kept, at, rows):
        left = [batch.column(batch.schema.get_field_index(f.name)).take(pa.array(at, pa.int32())) for f in kept]
        right = [pa.array([r.get(f.name) for r in rows], f.type) for f in _arrow_page] + [pa.array([r["error"] for r in rows], pa.string())]
        return pa.RecordBatch.from_arrays(left + right, names=[f.name for f in kept] + names)

    return df.mapInArrow(run, T.StructType([*kept, *PAGE.fields, T.StructField("error", T.StringType())]))


def encode_text(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every text as a TIFF file: key, n_bytes, media.

    The payload is the text in UTF-8 (null: empty) with bytes 255 appended up to a
    positive multiple of ROW_BYTES.  Repeated rows each give a row; other columns are not
    read; an empty table gives an empty one.
    """

    def run(batches):
        for batch in slices(batches, text):
            sizes, media = [], []
            for t in batch.column(1).to_pylist():
                raw = (t or "").encode("utf-8", "surrogatepass")
                sizes.append(len(raw))
                media.append(store(raw + b"\xff" * (-len(raw) % ROW_BYTES or (0 if raw else ROW_BYTES))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=[key, "n_bytes", "media"])

    return df.select(key, text).mapInArrow(run, T.StructType([df.schema[key], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]))


def digests(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """Read files (key, n_bytes, media) back and reduce each to digests and a feature.

    The row-per-page reader gives the pages of a file one after the other, and these are
    hashed in turn, so no file's samples are put together.  The feature lists the pages,
    the samples' sum, their smallest and largest, and the number of distinct ones.  A null
    or empty file gives no row, one that cannot be read a row of nulls but for key, n_bytes
    and media; equal rows give equal rows; other columns are not read.
    """
    number, string = T.LongType(), T.StringType()
    kinds = {"n_bytes": number, "payload_bytes": number, "payload_sha256": string, "tail_crc32": number, "media_bytes": number, "media_sha256": string, "feature": string}
    arrow = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "feature": pa.string()}
    files = stored.select(F.col(key).alias("key"), "n_bytes", "media", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))

    class Sums:
        def __init__(self):
            self.sha, self.size, self.tail, self.counts, self.shapes = hashlib.sha256(), 0, b"", np.zeros(256, np.int64), []

        def add(self, width: int, height: int, codec: str, raw: memoryview) -> None:
            self.sha.update(raw)
            self.size += len(raw)
            self.tail = (self.tail + bytes(raw[-32:]))[-32:]
            self.counts += np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
            self.shapes.append(f"{width}x{height}{codec[0]}")

        def row(self) -> dict:
            if not self.size:
                return {}
            found = np.flatnonzero(self.counts)
            total = int((self.counts * np.arange(256)).sum())
            feature = f"pages={','.join(self.shapes)};sum={total};min={found[0]};max={found[-1]};distinct={len(found)}"
            return {"payload_bytes": self.size, "payload_sha256": self.sha.hexdigest(), "tail_crc32": zlib.crc32(self.tail), "feature": feature}

    def run(batches):
        sums, last = None, None  # of the file whose pages come now, and its row
        for batch in slices(batches, "pixels"):
            page, width, height, codec = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("page", "width", "height", "compression"))
            pixels = batch.column(batch.schema.get_field_index("pixels"))
            rows, done = [], []
            for i, n in enumerate(page):
                if not n:  # the first page of a file, or a file that cannot be read
                    if sums is not None:
                        done.append(sums.row())
                        rows.append(last)
                    sums, last = Sums(), batch.slice(i, 1).select(["key", "n_bytes", "media_bytes", "media_sha256"])
                if n is not None:
                    sums.add(width[i], height[i], codec[i], memoryview(pixels[i].as_buffer()))
            if done:
                yield made(rows, done)
        if sums is not None:
            yield made([last], [sums.row()])

    def made(rows, done):
        t = pa.Table.from_batches(rows).combine_chunks()
        new = {n: pa.array([d.get(n) for d in done], k) for n, k in arrow.items()}
        return pa.Table.from_arrays([t["key"], *(new[n] if n in new else t[n] for n in kinds)], names=["key", *kinds]).combine_chunks().to_batches()[0]

    schema = T.StructType([T.StructField("key", stored.schema[key].dataType), *(T.StructField(k, v) for k, v in kinds.items())])
    return decode_pages(files).mapInArrow(run, schema).withColumnRenamed("key", key)
