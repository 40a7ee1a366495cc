"""TIFF media columns (operator 2): directories walked, strips and tiles decoded, predictors undone, a row per page.

Read: little- and big-endian files, any number of pages, strips or tiles, 8- or 16-bit samples, several samples to
a pixel (interleaved), no compression, PackBits, LZW and deflate, horizontal predictor. Written: the same, 8-bit
and one sample to a pixel.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import part_batches, renamed, table, tidy, utf8

# Fixed values of the format: compression schemes, field types' sizes, tags.
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS, STRIP_COUNTS, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325


# ---- codecs -------------------------------------------------------------------------------------------------


def packbits_encode(data: bytes) -> bytes:
    out, at = [], 0

    def literal(part: bytes):
        for k in range(0, len(part), 128):
            out.append(bytes([len(part[k : k + 128]) - 1]) + part[k : k + 128])

    for run in re.finditer(rb"(?s)(.)\1{2,127}", data):
        literal(data[at : run.start()])
        out.append(bytes([257 - len(run[0])]) + run[1])
        at = run.end()
    literal(data[at:])
    return b"".join(out)


def packbits_decode(data: bytes) -> bytes:
    out, at, n = [], 0, len(data)
    while at < n:
        head = data[at]
        if head < 128:
            out.append(data[at + 1 : at + 2 + head])
            at += 2 + head
        else:
            if head > 128:
                out.append(data[at + 1 : at + 2] * (257 - head))
                at += 2
            else:
                at += 1
    return b"".join(out)


#: Since the last clear, the width of each code and the bits before it: 9 to 12, growing one code early, as the format has it.
LZW_WIDTHS = 9 + sum((np.arange(4096) >= k).astype(np.int64) for k in (254, 766, 1790))
LZW_BITS = np.cumsum(LZW_WIDTHS) - LZW_WIDTHS
LZW_FRESH = [bytes([i]) for i in range(256)] + [b"", b""]


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first. A string in the table is its prefix's code and its last byte."""
    codes, table_, free = [256], {}, 258
    put, known = codes.append, table_.setdefault
    code = data[0] if data else 0
    for byte in memoryview(data)[1:]:
        longer = known(code << 8 | byte, free)
        if longer != free:
            code = longer
            continue
        put(code)
        free += 1
        if free == 4094:
            put(256)
            table_.clear()
            free = 258
        code = byte
    if data:
        put(code)
    put(257)
    all_ = np.array(codes, np.int64)
    clear = np.flatnonzero(all_ == 256)
    since = np.arange(len(all_)) - np.repeat(clear, np.diff(np.append(clear, len(all_)))) - 1
    size = LZW_WIDTHS[np.maximum(since, 0)]
    size[clear[1:]] = 12
    bits = np.unpackbits((all_ << 16 - size).astype(">u2").view(np.uint8)).reshape(-1, 16)
    return np.packbits(bits[np.arange(16) < size[:, None]]).tobytes()


def lzw_decode(data: bytes) -> bytes:
    """Codes are cut out some thousand at once: where one stands depends only on their number since the last clear."""
    raw, end = np.frombuffer(data + b"\0\0\0", np.uint8), 8 * len(data)
    out, table_, last, at, since = [], LZW_FRESH.copy(), None, 0, 0
    put = out.append
    while True:
        if since < len(LZW_BITS):
            place, size = at + LZW_BITS[since:] - LZW_BITS[since], LZW_WIDTHS[since:]
        else:  # a table that is full and not cleared
            place, size = at + 12 * np.arange(4096), np.full(4096, 12)
        n = int(np.searchsorted(place + size, end, side="right"))
        if not n:
            break
        place, size = place[:n], size[:n]
        k = place >> 3
        codes = (raw[k].astype(np.int64) << 16 | raw[k + 1].astype(np.int64) << 8 | raw[k + 2]) >> 24 - (place & 7) - size & (1 << size) - 1
        stop = np.flatnonzero((codes == 256) | (codes == 257))[:1]
        m = int(stop[0]) if len(stop) else n
        free = len(table_)
        for code in codes[:m].tolist():
            if last is None:
                last = table_[code]
                put(last)
                continue
            if code < free:
                part = table_[code]
            elif code == free:
                part = last + last[:1]
            else:
                raise ValueError("LZW code out of range")
            table_.append(last + part[:1])
            free += 1
            put(part)
            last = part
        if not len(stop):
            at, since = int(place[-1] + size[-1]), since + n
        elif codes[m] == 257:
            break
        else:
            at, since, table_, last = int(place[m] + size[m]), 0, LZW_FRESH.copy(), None
    return b"".join(out)


ENCODE = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, 1), PACKBITS: packbits_encode}
DECODE = {NONE: bytes, LZW: lzw_decode, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: packbits_decode}


# ---- files --------------------------------------------------------------------------------------------------


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows: int = 128, tile: tuple[int, int] | None = None) -> bytes:
    """Pages of 8-bit grey samples, each [height, width]; tile: (height, width), multiples of 16, instead of strips."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for page in pages:
        h, w = page.shape
        th, tw = tile or (min(rows, h), w)
        padded = np.pad(page, ((0, -h % th if tile else 0), (0, -w % tw)), mode="edge") if tile else page
        places, counts = [], []
        for y in range(0, h, th):
            for x in range(0, w, tw):
                block = padded[y : y + th, x : x + tw]
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros((len(block), 1), np.uint8))
                code = ENCODE[compression](np.ascontiguousarray(block, np.uint8).tobytes())
                places.append(len(out))
                counts.append(len(code))
                out += code + b"\0" * (len(code) & 1)
        fields = {WIDTH: w, HEIGHT: h, BITS: 8, COMPRESSION: compression, PHOTOMETRIC: 1, SAMPLES: 1, PREDICTOR: predictor}
        fields |= {TILE_WIDTH: tw, TILE_HEIGHT: th, TILE_OFFSETS: places, TILE_COUNTS: counts} if tile else {STRIP_OFFSETS: places, ROWS: th, STRIP_COUNTS: counts}
        entries = b""
        for tag, value in sorted(fields.items()):
            values = value if isinstance(value, list) else [value]
            body = struct.pack(f"<{len(values)}I", *values)
            if len(values) > 1:
                at = len(out)
                out += body
                body = struct.pack("<I", at)
            entries += struct.pack("<HHI", tag, 4, len(values)) + body
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _directory(data: bytes, order: str, at: int) -> tuple[dict[int, list[int]], int]:
    n = struct.unpack_from(f"{order}H", data, at)[0]
    tags: dict[int, list[int]] = {}
    for k in range(at + 2, at + 2 + 12 * n, 12):
        tag, kind, count = struct.unpack_from(f"{order}HHI", data, k)
        if kind in (1, 3, 4):  # the integers; no other kind is needed here
            letter, size = {1: "B", 3: "H", 4: "I"}[kind], SIZES[kind] * count
            place = k + 8 if size <= 4 else struct.unpack_from(f"{order}I", data, k + 8)[0]
            tags[tag] = list(struct.unpack_from(f"{order}{count}{letter}", data, place))
    return tags, struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)[0]


def _page(data: bytes, order: str, tags: dict[int, list[int]]) -> tuple[np.ndarray, int]:
    one = lambda tag, default=None: tags.get(tag, [default])[0]
    w, h, spp, bits, scheme = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(BITS, 1), one(COMPRESSION, NONE)
    if bits not in (8, 16) or scheme not in DECODE or spp > 1 and one(PLANAR, 1) != 1:
        raise ValueError(f"not supported: {bits} bits, compression {scheme}, planes {one(PLANAR, 1)}")
    kind = np.dtype(f"{order}u{bits // 8}")
    tiled = TILE_OFFSETS in tags
    th, tw = (one(TILE_HEIGHT), one(TILE_WIDTH)) if tiled else (min(one(ROWS, h), h), w)
    places, counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_COUNTS])
    out = np.zeros((h, w, spp), kind)
    k = 0
    for y in range(0, h, th):
        for x in range(0, w, tw):
            high = th if tiled else min(th, h - y)
            block = np.frombuffer(DECODE[scheme](data[places[k] : places[k] + counts[k]]), kind, high * tw * spp).reshape(high, tw, spp)
            if one(PREDICTOR, 1) == 2:
                block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
            elif one(PREDICTOR, 1) != 1:
                raise ValueError(f"not supported: predictor {one(PREDICTOR)}")
            out[y : y + th, x : x + tw] = block[: h - y, : w - x]
            k += 1
    return out, scheme


def read_tiff(data: bytes) -> list[tuple[np.ndarray, int]]:
    """Every page's samples [height, width, samples to a pixel] and its compression. ValueError for anything else."""
    try:
        order = {b"II*\0": "<", b"MM\0*": ">"}[data[:4]]
        at, seen, out = struct.unpack_from(f"{order}I", data, 4)[0], set(), []
        while at:
            if at in seen:
                raise ValueError("directories go round in a circle")
            seen.add(at)
            tags, at = _directory(data, order, at)
            out.append(_page(data, order, tags))
        return out
    except (KeyError, IndexError, TypeError, struct.error, zlib.error) as e:
        raise ValueError(f"not a readable TIFF: {e!r}") from e


# ---- columns ------------------------------------------------------------------------------------------------

PAGE = "page int, width int, height int, samples_per_pixel int, bits int, compression int, samples binary, mean double, spread double, entropy double, error string"


def pages(media: DataFrame, column: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per page of each file: the kept columns, then page (from 0), sizes, samples (rows one after another) and figures of them.

    A null or unreadable file gives one row whose page is null and whose error says why; a file's pages are all
    given or none. Repeated rows are decoded each, files of any length whole. Columns that are not kept are not read; a kept
    one named like a column of pages gets an underscore.
    """
    fields = [f for f in media.schema.fields if f.name in keep]

    def figures(a: np.ndarray):
        p = np.bincount(a.ravel().astype(np.int64)) / max(1, a.size)
        p = p[p > 0]
        return float(a.mean()), float(a.std()), float(-(p * np.log2(p)).sum())

    own = [x.split()[0] for x in PAGE.split(", ")]
    names = [*renamed(fields, own), *own]
    kinds = [pa.int32()] * 6 + [pa.binary()] + [pa.float64()] * 3 + [pa.string()]

    def work(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part, rows, at = batch.slice(start, 256), [], []
                for i, data in enumerate(part.column(column).to_pylist()):
                    try:
                        if data is None:
                            raise ValueError("null")
                        for k, (a, scheme) in enumerate(read_tiff(data)):
                            h, w, spp = a.shape
                            rows.append((k, w, h, spp, 8 * a.itemsize, scheme, a.tobytes(), *figures(a), None))
                            at.append(i)
                    except ValueError as e:
                        rows.append((None,) * 10 + (str(e),))
                        at.append(i)
                kept = [part.column(f.name).take(pa.array(at, pa.int64())) for f in fields]
                yield pa.RecordBatch.from_arrays(kept + [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = ", ".join([f"`{n}` {f.dataType.simpleString()}" for n, f in zip(names, fields, strict=False)] + [PAGE])
    return media.select(column, *[f.name for f in fields if f.name != column]).mapInArrow(work, schema)


def store(text: str | None) -> bytes:
    """A text as one page of 64 samples a row. LZW, PackBits and deflate take a third of the texts each, by checksum; those
    of odd checksums go in tiles; all but PackBits with the horizontal predictor."""
    body = utf8(text)
    body += bytes(-len(body) % 64 or (0 if body else 64))
    check = zlib.crc32(body)
    scheme = (LZW, PACKBITS, DEFLATE)[(check >> 1) % 3]
    return write_tiff([np.frombuffer(body, np.uint8).reshape(-1, 64)], scheme, 1 if scheme == PACKBITS else 2, tile=(128, 64) if check & 1 else None)


def to_media(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes (of the text), media: a row per row. Null texts are empty; the empty payload is
    64 zeros. Equal texts have equal files; texts of any length are one page; other columns aren't read; an empty table
    gives no rows."""

    def work(batches):
        for part in part_batches(batches):
            texts = part.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(utf8(t)) for t in texts], pa.int64()), pa.array(list(map(store, texts)), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(work), "doc_id long, n_bytes long, media binary")


def op2_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = to_media(table(spark, sf_dir, "documents")).withColumns({"media_bytes": F.length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    page = pages(media, keep=("doc_id", "n_bytes", "media_bytes", "media_sha256"))
    size = F.length("samples").cast("long")
    return page.select(
        "doc_id", "n_bytes", size.alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(samples, length(samples) - 63, 64)")).alias("tail_crc32"), "media_bytes", "media_sha256",
        F.format_string("%dx%d mean %.6f spread %.6f entropy %.6f", "height", "width", "mean", "spread", "entropy").alias("feature"),
    )


QUERIES = {"op2_tiff": op2_tiff}
SQL: dict[str, str] = {}
