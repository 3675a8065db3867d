"""TIFF media columns: a writer for byte payloads, and a reader that walks image directories.

The reader follows the chain of directories, decodes PackBits, LZW or deflate strips and tiles, undoes the
horizontal predictor and gives one row a page.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tag numbers, field types and compression codes of TIFF 6.0.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS, STRIP_COUNTS, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
SIZES = {1: (1, "B"), 3: (2, "H"), 4: (4, "I")}
#: A page that claims more is refused before memory is taken for it.
MOST_SAMPLES = 1 << 28
NONE, LZW, ADOBE_DEFLATE, DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
NAMES = {NONE: "none", LZW: "lzw", ADOBE_DEFLATE: "deflate", DEFLATE: "deflate", PACKBITS: "packbits"}


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more equal bytes as repeats, the rest as literals; at most 128 bytes a packet."""
    x = np.frombuffer(data, np.uint8)
    if not len(x):
        return b""
    start = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    size = np.diff(np.r_[start, len(x)])
    out, at = bytearray(), 0

    def literal(i: int, j: int) -> None:
        for k in range(i, j, 128):
            part = data[k : min(k + 128, j)]
            out.append(len(part) - 1)
            out.extend(part)

    for i, n in zip(start[size >= 3].tolist(), size[size >= 3].tolist(), strict=True):
        literal(at, i)
        at = i + n
        while n:
            k = min(n, 128)
            out.extend((257 - k, data[i]) if k > 1 else (0, data[i]))
            n -= k
    literal(at, len(data))
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out[:size])


def lzw_encode(data: bytes) -> bytes:
    """TIFF LZW: codes from the high bit down, 9 to 12 bits wide, the width growing one code early."""
    table = {bytes([i]): i for i in range(256)}
    codes, free, w = [256], 258, b""
    for b in data:
        c = w + bytes((b,))
        if c in table:
            w = c
            continue
        codes.append(table[w])
        table[c] = free
        free += 1
        w = c[-1:]
        if free == 4094:
            codes.append(256)
            table = {bytes([i]): i for i in range(256)}
            free = 258
    if w:
        codes.append(table[w])
    codes.append(257)
    out, acc, n, width, free = bytearray(), 0, 0, 9, 257
    for code in codes:
        acc = acc << width | code
        n += width
        while n >= 8:
            n -= 8
            out.append(acc >> n & 255)
        acc &= (1 << n) - 1
        if code == 256:
            width, free = 9, 257
        else:
            free += 1
            width = 9 if free < 511 else 10 if free < 1023 else 11 if free < 2047 else 12
    if n:
        out.append(acc << (8 - n) & 255)
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    out, acc, n, width = bytearray(), 0, 0, 9
    table: list[bytes] = []
    last = b""
    for byte in data:
        acc = (acc & 0xFFFF) << 8 | byte
        n += 8
        if n < width:
            continue
        n -= width
        code = acc >> n & ((1 << width) - 1)
        if code == 257 or len(out) >= size:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if not last:
            last = table[code]
            out += last
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        table.append(last + entry[:1])
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out[:size])


def _encode(data: bytes, compression: int) -> bytes:
    if compression == PACKBITS:
        return packbits_encode(data)
    if compression == LZW:
        return lzw_encode(data)
    return zlib.compress(data, 6) if compression in (ADOBE_DEFLATE, DEFLATE) else data


def _decode(data: bytes, compression: int, size: int) -> bytes:
    if compression == PACKBITS:
        out = packbits_decode(data, size)
    elif compression == LZW:
        out = lzw_decode(data, size)
    elif compression in (ADOBE_DEFLATE, DEFLATE):
        out = zlib.decompressobj().decompress(data, size)
    elif compression == NONE:
        out = data[:size]
    else:
        raise ValueError(f"compression {compression} is not known")
    if len(out) != size:
        raise ValueError("a strip or tile is cut short")
    return out


def write(pages: list[bytes], width: int, compression: int, predictor: int = 1, tile: int = 0, strip_rows: int = 512, order: str = "<") -> bytes:
    """Eight-bit grey pages of whole rows; tiles of ``tile`` x ``tile`` samples if it is set, else strips."""
    out = bytearray(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 0))
    link = 4
    for page in pages:
        x = np.frombuffer(page, np.uint8).reshape(-1, width)
        blocks = []
        if tile:
            high, wide = -(-x.shape[0] // tile) * tile, -(-width // tile) * tile
            full = np.zeros((high, wide), np.uint8)
            full[: x.shape[0], :width] = x
            blocks = [full[r : r + tile, c : c + tile] for r in range(0, high, tile) for c in range(0, wide, tile)]
        else:
            blocks = [x[r : r + strip_rows] for r in range(0, x.shape[0], strip_rows)]
        offsets, counts = [], []
        for b in blocks:
            if predictor == 2:
                b = np.concatenate((b[:, :1], b[:, 1:] - b[:, :-1]), 1)
            data = _encode(np.ascontiguousarray(b).tobytes(), compression)
            offsets.append(len(out))
            counts.append(len(data))
            out += data
        tags = {WIDTH: [width], LENGTH: [x.shape[0]], BITS: [8], COMPRESSION: [compression], PHOTOMETRIC: [1], SAMPLES: [1], PREDICTOR: [predictor]}
        tags |= {TILE_WIDTH: [tile], TILE_LENGTH: [tile], TILE_OFFSETS: offsets, TILE_COUNTS: counts} if tile else {ROWS: [strip_rows], STRIP_OFFSETS: offsets, STRIP_COUNTS: counts}
        entries = b""
        for tag, values in sorted(tags.items()):
            data = struct.pack(f"{order}{len(values)}I", *values)
            if len(values) > 1:
                place = len(out)
                out += data
                data = struct.pack(order + "I", place)
            entries += struct.pack(order + "HHI", tag, 4, len(values)) + data
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def pages(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(facts, samples) of every page along the chain of image directories."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("no TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("the chain of directories runs in a circle")
        seen.add(at)
        tags = {}
        for i in range(struct.unpack_from(order + "H", data, at)[0]):
            tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind in SIZES:
                size, letter = SIZES[kind]
                place = at + 10 + 12 * i
                if size * n > 4:
                    place = struct.unpack_from(order + "I", data, place)[0]
                tags[tag] = list(struct.unpack_from(f"{order}{n}{letter}", data, place))
        one = lambda t, d, tags=tags: tags.get(t, [d])[0]
        width, height, compression, predictor, depth = one(WIDTH, 0), one(LENGTH, 0), one(COMPRESSION, 1), one(PREDICTOR, 1), one(SAMPLES, 1)
        if set(tags.get(BITS, [1])) != {8} or predictor not in (1, 2) or (depth > 1 and one(PLANAR, 1) != 1):
            raise ValueError("only eight-bit samples, those of a pixel side by side, are read")
        if not 0 < width * height * depth <= MOST_SAMPLES:
            raise ValueError(f"a page of {width} x {height} x {depth} samples")
        tiled = TILE_OFFSETS in tags
        wide, high = (one(TILE_WIDTH, 0), one(TILE_LENGTH, 0)) if tiled else (width, min(one(ROWS, height), height))
        if not 0 < wide * high * depth <= MOST_SAMPLES:
            raise ValueError(f"blocks of {wide} x {high} pixels")
        across, down = -(-width // wide), -(-height // high)
        blocks = list(zip(tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_COUNTS if tiled else STRIP_COUNTS], strict=True))
        if len(blocks) != across * down:
            raise ValueError(f"{len(blocks)} blocks where {across * down} make the page")
        image = np.empty((height, width, depth), np.uint8)
        for k, (offset, count) in enumerate(blocks):
            top, left = k // across * high, k % across * wide
            rows = high if tiled else min(high, height - top)
            x = np.frombuffer(_decode(data[offset : offset + count], compression, rows * wide * depth), np.uint8).reshape(rows, wide, depth)
            if predictor == 2:
                x = np.cumsum(x, axis=1, dtype=np.uint8)
            image[top : top + rows, left : left + wide] = x[: height - top, : width - left]
        yield {"width": width, "height": height, "compression": NAMES[compression], "predictor": predictor, "blocks": len(blocks), "tiled": tiled}, image.tobytes()
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * struct.unpack_from(order + "H", data, at)[0])[0]


def store(payload: bytes, page_rows: int = 128, width: int = 64) -> bytes:
    """A payload of whole rows as TIFF; layout and compression follow from its digest, so equal payloads are stored alike."""
    kind, layout = hashlib.sha256(payload).digest()[:2]
    cut = [payload[i : i + page_rows * width] for i in range(0, len(payload), page_rows * width)]
    return write(cut, width, (LZW, PACKBITS, ADOBE_DEFLATE)[kind % 3], predictor=1 + layout % 2, tile=64 if layout & 2 else 0, strip_rows=48, order=">" if layout & 4 else "<")


_PAGE = pa.schema([("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("compression", pa.string()), ("predictor", pa.int32()), ("blocks", pa.int32()), ("tiled", pa.bool_()), ("samples", pa.binary()), ("problem", pa.string())])
_PAGE_DDL = "page int, width int, height int, compression string, predictor int, blocks int, tiled boolean, samples binary, problem string"


def media_pages(media: DataFrame, batch_bytes: int = 8 << 20) -> DataFrame:
    """One row a page of ``media`` (doc_id, media): doc_id, media_bytes, media_sha256, page, width, height, compression, predictor, blocks, tiled, samples, problem.

    A column n_bytes is carried along if there is one; other extra columns are ignored. A null or broken file gives
    one row with page -1 and the reason in ``problem``, behind the pages that could be read; other rows have it null.
    Every row of ``media`` gives its pages, repeated ones too, one after another; an empty table gives none.
    """
    carried = [c for c in media.columns if c == "n_bytes"]

    def rows_of(data):
        try:
            if data is None:
                raise ValueError("no file")
            for n, (f, samples) in enumerate(pages(data)):
                yield (n, f["width"], f["height"], f["compression"], f["predictor"], f["blocks"], f["tiled"], samples, None)
        except (ValueError, struct.error, zlib.error, IndexError, KeyError, ZeroDivisionError, MemoryError, OverflowError) as e:
            yield (-1, None, None, None, None, None, None, None, str(e))

    head = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in carried), ("media_bytes", pa.int64()), ("media_sha256", pa.string())])
    schema = pa.schema([*head, *_PAGE])

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for *told, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                facts = (*told, None, None) if data is None else (*told, len(data), hashlib.sha256(data).hexdigest())
                for row in rows_of(data):
                    rows.append(facts + row)
                    size += len(row[7] or b"") + 100
                    if size > batch_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    ddl = "".join(f"{c} long, " for c in ("doc_id", *carried)) + f"media_bytes long, media_sha256 string, {_PAGE_DDL}"
    return media.select(F.col("doc_id").cast("long"), *(F.col(c).cast("long") for c in carried), F.col("media").cast("binary")).mapInArrow(run, ddl)


def stored_documents(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, media: the UTF-8 text, padded with zero bytes to a positive multiple of 64, as TIFF."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for at in range(0, len(ids), 256):
                raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).slice(at, 256).to_pylist()]
                media = [store(b + b"\0" * (-len(b) % 64 or (0 if b else 64))) for b in raw]
                yield pa.RecordBatch.from_arrays([ids.slice(at, 256), pa.array(list(map(len, raw)), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_features(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs`` with the contract's columns, computed from the pages that are read back from the stored form.

    Null texts count as empty. Repeated rows give repeated rows and equal texts equal values; extra columns are
    ignored; an empty table gives an empty result. A file's pages follow one another in the task that reads it, so they
    are folded there, page by page.
    """
    read = media_pages(stored_documents(docs))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def run(batches):
        now, done = None, []

        def close():
            sha, size, tail, facts, total, first = now["sha"], now["size"], now["tail"], now["first"], now["sum"], now["row"]
            feature = f"{facts[3]}:{facts[4]}:{'tiles' if facts[6] else 'strips'}:{now['pages']}:{facts[1]}x{now['rows']}:{total / size:.4f}"
            done.append((first[0], first[1], size, sha.hexdigest(), zlib.crc32(tail), first[2], first[3], feature))

        for batch in batches:
            for *row, page, width, height, compression, predictor, blocks, tiled, samples, problem in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if problem is not None:
                    raise ValueError(problem)
                if page == 0:
                    if now:
                        close()
                    now = {"sha": hashlib.sha256(), "size": 0, "tail": b"", "pages": 0, "rows": 0, "sum": 0, "row": row, "first": (page, width, height, compression, predictor, blocks, tiled)}
                now["sha"].update(samples)
                now["tail"] = (now["tail"] + samples)[-64:]
                now["size"] += len(samples)
                now["pages"] += 1
                now["rows"] += height
                now["sum"] += int(np.frombuffer(samples, np.uint8).sum(dtype=np.int64))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
                done = []
        if now:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    return read.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
