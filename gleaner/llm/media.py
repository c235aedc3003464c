"""Media columns: TIFF files in a binary column, read page by page.

``pages`` walks the image directories of every file (classic and BigTIFF,
either byte order), decodes strips or tiles (none, PackBits, LZW, deflate),
undoes predictors 2 and 3 and emits one row per page.  ``store`` writes the
bytes of a text as a lossless grey TIFF, ``summaries`` computes features from
the pages that were read back.  A text's pages stay in one worker: no pixels
move between tasks.

Edge cases.  A null or malformed file gives one row with page 0, no pixels and
the reason in ``error``; if a later directory, or the way to it, is malformed
the pages before it stay and one row names the error.  Malformed are sizes of
zero or less, and pages that claim more than their packed bytes can hold.  A
directory that was seen before ends the walk.  Null text is stored as empty
text, which is one row of zero bytes.
Long payloads are dealt over pages of ``page_rows`` rows.  Rows that repeat
and tables without rows need no special treatment.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._common import input_columns, package_on_workers, released

# Fixed values of the TIFF 6.0 and BigTIFF formats.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_BYTES, FORMAT = 317, 322, 323, 324, 325, 339
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 13: "I", 16: "Q", 17: "q", 18: "Q"}
#: No compression makes more than so many bytes of one.
MOST_PACKED = 4096

PAGE_DDL = "page int, width int, height int, bits int, samples int, compression int, predictor int, pixels binary, error string"


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
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
        while run < 128 and data[i : i + 1] == data[i + run : i + run + 1]:
            run += 1
        if run > 1:
            out += bytes([257 - run, data[i]])
            i += run
            continue
        end = i + 1
        while end < len(data) and end - i < 128 and data[end : end + 1] != data[end + 1 : end + 2]:
            end += 1
        out += bytes([end - i - 1]) + data[i:end]
        i = end
    return bytes(out)


def unpack_lzw(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, high bit first; 256 clears, 257 ends."""
    out = bytearray()
    words: list[bytes] = []
    width, before, held, bits = 9, b"", 0, 0
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257 or len(out) >= size:
            break
        if code == 256:
            words, width, before = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        if not words:
            raise ValueError("LZW data don't begin with a clear code")
        if code < len(words):
            word = words[code]
        elif code == len(words) and before:
            word = before + before[:1]
        else:
            raise ValueError("LZW code beyond the table")
        out += word
        if before:
            words.append(before + word[:1])
        before = word
        # The writer's table is one entry ahead of the reader's.
        width = min(12, max(9, (len(words) + 1).bit_length()))
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    first = {bytes([k]): k for k in range(256)}
    table, size, width, word = dict(first), 258, 9, b""
    put(256, 9)
    for k in range(len(data)):
        longer = word + data[k : k + 1]
        if longer in table:
            word = longer
            continue
        put(table[word], width)
        table[longer] = size
        size += 1
        word = data[k : k + 1]
        width = min(12, size.bit_length())
        if size == 4094:
            put(256, width)
            table, size, width = dict(first), 258, 9
    if word:
        put(table[word], width)
        size += 1
    put(257, min(12, size.bit_length()))
    if bits:
        out.append(held << 8 - bits & 255)
    return bytes(out)


def _unpacked(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        out = data
    elif compression in (DEFLATE, OLD_DEFLATE):
        out = zlib.decompressobj().decompress(data, size)
    elif compression == LZW:
        out = unpack_lzw(data, size)
    elif compression == PACKBITS:
        out = unpack_bits(data, size)
    else:
        raise ValueError(f"compression {compression} isn't supported")
    if len(out) < size:
        raise ValueError("a strip or tile is too short")
    return out[:size]


def _kind(bits: int, order: str) -> np.dtype:
    if bits not in (8, 16, 32, 64):
        raise ValueError(f"{bits} bits a sample aren't supported")
    return np.dtype(f"{order}u{bits // 8}")


def _undo(block: bytes, predictor: int, rows: int, width: int, samples: int, bits: int, order: str) -> np.ndarray:
    """Samples of a strip or tile (rows, width, samples), in the file's order of bytes."""
    kind = _kind(bits, order)
    if predictor == 3:  # bytes of floats by significance, then differences
        planes = np.cumsum(np.frombuffer(block, np.uint8).reshape(rows, -1, samples), axis=1, dtype=np.uint8)
        planes = planes.reshape(rows, bits // 8, width * samples).transpose(0, 2, 1)
        return np.ascontiguousarray(planes).view(f">u{bits // 8}").astype(kind).reshape(rows, width, samples)
    values = np.frombuffer(block, kind).reshape(rows, width, samples)
    if predictor == 2:
        return np.cumsum(values, axis=1, dtype=kind.newbyteorder("=")).astype(kind)
    if predictor != 1:
        raise ValueError(f"predictor {predictor} isn't supported")
    return values


def walk(data: bytes) -> Iterator[dict]:
    """The pages of a file; pixels: samples in little-endian order."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        raise ValueError("not a TIFF file")
    magic = struct.unpack_from(order + "H", data, 2)[0]
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    big = magic == 43
    count_kind, size_kind, entry = ("Q", "Q", 20) if big else ("H", "I", 12)
    at = struct.unpack_from(order + size_kind, data, 8 if big else 4)[0]
    seen: set[int] = set()
    while at and at not in seen:
        seen.add(at)
        n = struct.unpack_from(order + count_kind, data, at)[0]
        at += struct.calcsize(count_kind)
        if at + n * entry > len(data):
            raise ValueError("a directory reaches beyond the file")
        tags: dict[int, list[int]] = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HH" + size_kind, data, at + k * entry)
            if kind not in TYPES:
                continue
            place = at + k * entry + (12 if big else 8)
            fmt = f"{order}{count}{TYPES[kind]}"
            if struct.calcsize(fmt) > (8 if big else 4):
                place = struct.unpack_from(order + size_kind, data, place)[0]
            tags[tag] = list(struct.unpack_from(fmt, data, place))
        yield _page(data, tags, order)
        at = struct.unpack_from(order + size_kind, data, at + n * entry)[0]


def _page(data: bytes, tags: dict[int, list[int]], order: str) -> dict:
    one = lambda tag, default=None: tags[tag][0] if tag in tags or default is None else default
    width, height, samples = one(WIDTH), one(LENGTH), one(SAMPLES, 1)
    all_bits = tags.get(BITS, [1])
    bits, compression, predictor = all_bits[0], one(COMPRESSION, 1), one(PREDICTOR, 1)
    if len(set(all_bits)) > 1:
        raise ValueError("samples differ in size")
    if min(width, height, samples, bits) < 1:
        raise ValueError("a page without pixels")
    separate = one(PLANAR, 1) == 2 and samples > 1
    planes, per = (samples, 1) if separate else (1, samples)
    if tiled := TILE_OFFSETS in tags:
        across, down = one(TILE_WIDTH), one(TILE_LENGTH)
        offsets, sizes = tags[TILE_OFFSETS], tags[TILE_BYTES]
    else:
        across, down = width, min(one(ROWS_PER_STRIP, height), height)
        offsets, sizes = tags[STRIP_OFFSETS], tags.get(STRIP_BYTES, [len(data)] * len(tags[STRIP_OFFSETS]))
    if min(across, down) < 1 or min(*offsets, *sizes, 0) < 0:
        raise ValueError("strips or tiles without pixels")
    columns, lines = -(-width // across), -(-height // down)
    if len(offsets) != columns * lines * planes or len(sizes) != len(offsets):
        raise ValueError("the number of strips or tiles is wrong")
    if bits == 1:  # rows of whole bytes, high bit first
        step, count = -(-across * per // 8), 8
    else:
        step, count = across * per * _kind(bits, order).itemsize, bits
    if columns * lines * min(down, height) * step * planes > MOST_PACKED * sum(min(x, len(data)) for x in sizes):
        raise ValueError("a page larger than its strips or tiles can hold")
    out = np.zeros((planes, height, width, per), _kind(count, "<"))
    for k, (offset, size) in enumerate(zip(offsets, sizes)):
        plane, cell = divmod(k, columns * lines)
        top, left = cell // columns * down, cell % columns * across
        rows = down if tiled else min(down, height - top)
        block = _unpacked(data[offset : offset + size], compression, rows * step)
        if bits == 1:
            values = np.unpackbits(np.frombuffer(block, np.uint8).reshape(rows, step), axis=1)[:, : across * per].reshape(rows, across, per)
        else:
            values = _undo(block, predictor, rows, across, per, bits, order)
        part = out[plane, top : top + rows, left : left + across]
        part[:] = values[: part.shape[0], : part.shape[1]]
    pixels = out.transpose(1, 2, 0, 3).tobytes() if separate else out.tobytes()
    return {"width": width, "height": height, "bits": bits, "samples": samples, "compression": compression, "predictor": predictor, "pixels": pixels}


def write(payload: bytes, *, width: int = 64, page_rows: int = 16384, strip_rows: int = 1024, compression: int = DEFLATE, predictor: int = 2, tile: int = 0, order: str = "<") -> bytes:
    """A grey 8-bit TIFF of payload, whose size is a multiple of width."""
    if len(payload) % width or not payload:
        raise ValueError("the payload has to fill its rows")
    pack = {NONE: bytes, DEFLATE: lambda x: zlib.compress(x, 6), LZW: pack_lzw, PACKBITS: pack_bits}[compression]
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    every = np.frombuffer(payload, np.uint8).reshape(-1, width)
    for top in range(0, len(every), page_rows):
        page = every[top : top + page_rows]
        if tile:
            padded = np.zeros((-(-len(page) // tile) * tile, -(-width // tile) * tile), np.uint8)
            padded[: len(page), :width] = page
            parts = [padded[y : y + tile, x : x + tile] for y in range(0, len(padded), tile) for x in range(0, padded.shape[1], tile)]
        else:
            parts = [page[y : y + strip_rows] for y in range(0, len(page), strip_rows)]
        if predictor == 2:
            parts = [np.diff(p, axis=1, prepend=np.uint8(0)) for p in parts]
        packed = [pack(np.ascontiguousarray(p).tobytes()) for p in parts]
        offsets = []
        for p in packed:
            offsets.append(len(out))
            out += p
        tags = {WIDTH: [width], LENGTH: [len(page)], BITS: [8], COMPRESSION: [compression], PHOTOMETRIC: [1], SAMPLES: [1], PREDICTOR: [predictor]}
        tags |= {TILE_WIDTH: [tile], TILE_LENGTH: [tile], TILE_OFFSETS: offsets, TILE_BYTES: [*map(len, packed)]} if tile else {STRIP_OFFSETS: offsets, ROWS_PER_STRIP: [strip_rows], STRIP_BYTES: [*map(len, packed)]}
        out += b"\0" * (len(out) % 2)
        lists = {}
        for tag, values in tags.items():
            if len(values) > 1:
                lists[tag] = len(out)
                out += struct.pack(f"{order}{len(values)}I", *values)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags))
        for tag in sorted(tags):
            values = tags[tag]
            out += struct.pack(order + "HHII", tag, 4, len(values), lists.get(tag, values[0]))
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


def payload_of(text: str | None) -> bytes:
    """The text's bytes, with zeros up to a positive multiple of 64."""
    data = (text or "").encode()
    return data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")


def _blocks(batches: Iterator[pa.RecordBatch], column: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The rows in blocks of about ``most`` bytes of a binary column."""
    for batch in batches:
        held = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)) // most
        cuts = [0, *(np.flatnonzero(np.diff(held)) + 1).tolist(), len(batch)]
        yield from (batch.slice(x, y - x) for x, y in zip(cuts, cuts[1:]) if y > x)


def store(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """id, n_bytes (of the text), media (its TIFF file); how: see write()."""
    package_on_workers(docs.sparkSession)

    @F.pandas_udf("binary")
    def stored(texts: pd.Series) -> pd.Series:
        return pd.Series([write(payload_of(x), **how) for x in texts], dtype=object)

    rows = docs.select(*input_columns(docs, id=id_col, text=text_col)).withColumn("text", F.coalesce("text", F.lit("")))
    return rows.select(F.col("id").alias(id_col), F.octet_length("text").cast("long").alias("n_bytes"), stored("text").alias("media"))


def _read(media: bytes | None) -> Iterator[dict]:
    """A file's rows, as PAGE_DDL."""
    page = 0
    try:
        if media is None:
            raise ValueError("no file")
        for found in walk(media):
            yield found | {"page": page, "error": None}
            page += 1
        if not page:
            raise ValueError("no page")
    except (ValueError, KeyError, IndexError, ArithmeticError, struct.error, zlib.error, MemoryError) as e:
        yield {"page": page, "pixels": None, "error": f"{type(e).__name__}: {e}"}


def _page_rows(batches: Iterator[pa.RecordBatch], media_col: str, fields: list[pa.Field], most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The columns of files and one row per page after them, in batches of
    about ``most`` bytes of pixels."""

    def rows(part: pa.RecordBatch, at: list[int], found: list[dict]) -> pa.RecordBatch:
        every, first = pa.array(at), pa.array([k if p["page"] == 0 else None for k, p in zip(at, found)], pa.int64())
        own = [c.take(first if n == media_col else every) for n, c in zip(part.schema.names, part.columns)]
        made = [pa.array([p.get(f.name) for p in found], f.type) for f in fields]
        return pa.RecordBatch.from_arrays(own + made, names=part.schema.names + [f.name for f in fields])

    for part in _blocks(batches, media_col):
        at, found, held = [], [], 0
        for k, media in enumerate(part.column(media_col)):
            for page in _read(media.as_py()):
                at.append(k)
                found.append(page)
                held += len(page["pixels"] or b"")
                if held >= most:
                    yield rows(part, at, found)
                    at, found, held = [], [], 0
        if found:
            yield rows(part, at, found)


def _without(files: DataFrame, ddl: str) -> DataFrame:
    """files without the columns that ddl names."""
    own = {n.lower() for n in T.StructType.fromDDL(ddl).names}
    return files.select(*[files[c] for c in files.columns if c.lower() not in own])


def pages(files: DataFrame, *, media_col: str = "media") -> DataFrame:
    """The columns of files, and one row per page of each file (PAGE_DDL)
    after them, in place of columns of the same names.  The media column stays
    with a file's first page only."""
    package_on_workers(files.sparkSession)
    rows, made = _without(files, PAGE_DDL), T.StructType.fromDDL(PAGE_DDL)
    fields = list(to_arrow_schema(made))
    return rows.mapInArrow(released(lambda batches: _page_rows(batches, media_col, fields)), T.StructType(rows.schema.fields + made.fields))


def feature(pixels: bytes, width: int = 64) -> str:
    """Rows, mean, spread and an 8 x 8 average hash of grey 8-bit pixels."""
    grey = np.frombuffer(pixels, np.uint8).reshape(-1, width)
    total = int(grey.sum(dtype=np.int64))
    squares = int((grey.astype(np.int64) ** 2).sum())
    n = grey.size
    bands = np.add.reduceat(grey.astype(np.int64), np.arange(8) * width // 8, axis=1)
    cuts = np.minimum(np.arange(9) * len(grey) // 8, len(grey))
    sums = np.append(np.zeros((1, 8), np.int64), np.cumsum(bands, axis=0), axis=0)
    cells = sums[cuts[1:]] - sums[cuts[:-1]]
    size = (np.diff(cuts) * (width // 8))[:, None]
    bits = np.packbits(cells * n > total * size).tobytes().hex()
    return f"rows={len(grey)};mean={total // n};var={squares // n - (total // n) ** 2};ahash={bits}"


SUMMARY_DDL = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def summarised(rows: list[dict], media_col: str) -> dict:
    """SUMMARY_DDL of a file's page rows; without values if one is malformed or
    isn't of the form that store() writes."""
    width = rows[0].get("width")
    if any(r["error"] or r["width"] != width or width % 8 or (r["bits"], r["samples"]) != (8, 1) for r in rows):
        return {}
    media, payload = rows[0][media_col], b"".join(r["pixels"] for r in rows)
    return {
        "payload_bytes": len(payload),
        "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-64:]),
        "media_bytes": len(media),
        "media_sha256": hashlib.sha256(media).hexdigest(),
        "feature": feature(payload, width),
    }


def _folded(batches: Iterator[pa.RecordBatch], media_col: str, own: list[str], schema: pa.Schema, most: int = 1000) -> Iterator[pa.RecordBatch]:
    """One row per file from its page rows, which follow each other."""
    file: list[dict] = []
    made: list[dict] = []

    def close() -> None:
        if file:
            made.append({c: file[0][c] for c in own} | summarised(file, media_col))
            file.clear()

    for batch in batches:
        for row in batch.to_pylist():
            if row["page"] == 0:
                close()
            file.append(row)
        if len(made) >= most:
            yield pa.RecordBatch.from_pylist(made, schema)
            made.clear()
    close()
    if made:
        yield pa.RecordBatch.from_pylist(made, schema)


def summaries(files: DataFrame, *, media_col: str = "media") -> DataFrame:
    """One row per file that store() wrote: its columns but the media, and
    SUMMARY_DDL of its page rows.  These are read and folded in one worker."""
    package_on_workers(files.sparkSession)
    rows, fields = _without(_without(files, PAGE_DDL), SUMMARY_DDL), list(to_arrow_schema(T.StructType.fromDDL(PAGE_DDL)))
    own = [f for f in rows.schema.fields if f.name != media_col]
    made = T.StructType(own + T.StructType.fromDDL(SUMMARY_DDL).fields)
    names, schema = [f.name for f in own], to_arrow_schema(made)
    return rows.mapInArrow(released(lambda batches: _folded(_page_rows(batches, media_col, fields), media_col, names, schema)), made)
