import hashlib
import struct
import zlib

import numpy as np
import pytest

from brinkline.llm import tiff


def test_packbits_and_lzw_read_the_examples_of_the_specification():
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    want = bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22") + b"\xaa" * 10
    assert tiff._decode(packed, tiff.PACKBITS, len(want)) == want
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]  # nine bits each, first bit highest
    bits = "".join(f"{c:09b}" for c in codes)
    data = int(bits + "0" * (-len(bits) % 8), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff._decode(data, tiff.LZW, 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def colour(height, width, predictor):
    """A deflated three-sample page made by hand."""
    x = np.random.default_rng(3).integers(0, 256, (height, width, 3)).astype(np.uint8)
    y = x.copy()
    if predictor == 2:
        y[:, 1:] = x[:, 1:] - x[:, :-1]
    data = zlib.compress(y.tobytes())
    tags = [(256, 3, 1, width), (257, 3, 1, height), (258, 3, 3, 8 + 2 + 12 * 9 + 4), (259, 3, 1, 8), (262, 3, 1, 2), (273, 4, 1, 8 + 2 + 12 * 9 + 4 + 6), (277, 3, 1, 3), (279, 4, 1, len(data)), (317, 3, 1, predictor)]
    out = struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", len(tags))
    for tag, kind, n, v in tags:
        out += struct.pack("<HHI", tag, kind, n) + (struct.pack("<HH", v, 0) if kind == 3 and n == 1 else struct.pack("<I", v))
    return out + struct.pack("<I", 0) + struct.pack("<HHH", 8, 8, 8) + data, x


@pytest.mark.parametrize("predictor", [1, 2])
def test_pixels_of_three_samples(predictor):
    data, x = colour(5, 7, predictor)
    [(facts, samples)] = tiff.pages(data)
    assert samples == x.tobytes() and (facts["width"], facts["height"]) == (7, 5)


def test_broken_files_are_refused(spark):
    whole = bytearray(tiff.write([bytes(range(64)) * 128], 64, tiff.ADOBE_DEFLATE, strip_rows=64))
    at = struct.unpack_from("<I", whole, 4)[0]
    entry = {struct.unpack_from("<H", whole, at + 2 + 12 * i)[0]: at + 2 + 12 * i for i in range(struct.unpack_from("<H", whole, at)[0])}

    def with_(tag, value):
        out = bytearray(whole)
        struct.pack_into("<I", out, entry[tag] + 8, value)
        return bytes(out)

    circle = bytearray(whole)
    struct.pack_into("<I", circle, len(circle) - 4, at)
    broken = [with_(tiff.LENGTH, 256), with_(tiff.LENGTH, 2**31), with_(tiff.ROWS, 0), with_(tiff.WIDTH, 0), bytes(whole[:200]), b"", None, b"II*\0\xff\xff\xff\xff"]
    rows = [(i, b) for i, b in enumerate(broken)] + [(100, bytes(whole)), (100, bytes(whole)), (None, bytes(whole)), (200, bytes(circle))]
    got = tiff.media_pages(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, media binary, page int")).collect()
    assert all((r.page, r.problem is None) == (-1, False) for r in got if r.doc_id in range(len(broken))) and len([r for r in got if r.doc_id in range(len(broken))]) == len(broken)
    assert [r.page for r in got if r.doc_id == 100] == [0, 0] and [r.page for r in got if r.doc_id is None] == [0] and [r.page for r in got if r.doc_id == 200] == [0, -1]


def test_long_texts_have_several_pages(spark):
    texts = [("é" * 20_000, 1), ("x" * 8192, 2), ("x" * 8193, 3), ("x" * 8193, 4)]
    docs = spark.createDataFrame([(i, t, 5) for t, i in texts], "doc_id long, text string, n_bytes int")
    pages = tiff.media_pages(tiff.stored_documents(docs))
    assert {r.doc_id: r["count"] for r in pages.groupBy("doc_id").count().collect()} == {1: 5, 2: 1, 3: 2, 4: 2}
    got = {r.doc_id: r for r in tiff.media_features(docs.repartition(1)).collect()}
    for t, i in texts:
        raw = t.encode()
        padded = raw + b"\0" * (-len(raw) % 64)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert got[3][2:] == got[4][2:]
    kinds = {tiff.store(bytes([k]) * 640)[8:12] for k in range(40)}
    codecs = {f["compression"] for k in range(40) for f, _ in tiff.pages(tiff.store(bytes([k]) * 640))}
    assert len(kinds) > 5 and codecs == {"lzw", "packbits", "deflate"}
