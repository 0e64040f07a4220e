"""Pictures as bytes: every filter, depth and kind of colour, damage, and the way through PNG and back."""

import struct
import zlib

import numpy as np
import pytest

from paintgraph.sources import pictures


def png(width, height, depth, kind, lines, palette=b"", alphas=b"", interlaced=0):
    c = pictures._chunk
    return pictures.SIGNATURE + c(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, kind, 0, 0, interlaced)) + (c(b"PLTE", palette) if palette else b"") + (c(b"tRNS", alphas) if alphas else b"") + c(b"IDAT", zlib.compress(lines)) + c(b"IEND", b"")


def filtered(lines, pixel, filters):
    out, above = b"", [0] * len(lines[0])
    for line, kind in zip(lines, filters, strict=True):
        row = []
        for i, v in enumerate(line):
            a, b, c = line[i - pixel] if i >= pixel else 0, above[i], above[i - pixel] if i >= pixel else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            row.append((v - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        out += bytes([kind, *row])
        above = line
    return out


@pytest.mark.parametrize("band", [64, 1 << 18])
@pytest.mark.parametrize("kind,n", [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_filters(monkeypatch, kind, n, band):
    monkeypatch.setattr(pictures, "BAND_BYTES", band)
    v = np.random.default_rng(kind).integers(0, 256, (15, 9 * n))
    found = np.concatenate(list(pictures.Picture(png(9, 15, 8, kind, filtered(v.tolist(), n, [0, 1, 2, 3, 4] * 3))).rows()))
    v = v.reshape(15, 9, n)
    assert (found[:, :, :3] == (v[:, :, :3] if n > 2 else v[:, :, :1])).all()
    assert (found[:, :, 3] == (v[:, :, -1] if n in (2, 4) else 255)).all()


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_few_bits(depth):
    v = np.random.default_rng(depth).integers(0, 1 << depth, (4, 11))
    bits = np.unpackbits(v.astype(np.uint8)[:, :, None], axis=2)[:, :, 8 - depth :].reshape(4, -1)
    lines = b"".join(b"\0" + np.packbits(row).tobytes() for row in bits)
    gray = np.concatenate(list(pictures.Picture(png(11, 4, depth, 0, lines)).rows()))
    assert (gray[:, :, 0] == v * 255 // ((1 << depth) - 1)).all()
    palette = np.random.default_rng(1).integers(0, 256, (1 << depth, 3)).astype(np.uint8)
    found = np.concatenate(list(pictures.Picture(png(11, 4, depth, 3, lines, palette.tobytes(), b"\x07")).rows()))
    assert (found[:, :, :3] == palette[v]).all() and (found[:, :, 3] == np.where(v == 0, 7, 255)).all()


def test_sixteen_bits():
    lines = b"\0" + bytes([1, 99, 2, 98, 3, 97]) + b"\0" + bytes([4, 1, 5, 2, 6, 3])
    found = np.concatenate(list(pictures.Picture(png(1, 2, 16, 2, lines)).rows()))
    assert found.tolist() == [[[1, 2, 3, 255]], [[4, 5, 6, 255]]]


def test_what_cannot_be_read_is_one_null_row(spark):
    good = png(2, 2, 8, 0, b"\0\1\2\0\3\4")
    flipped = bytearray(good)
    flipped[-20] ^= 1
    bad = [None, b"", b"GIF89a", good[:-13], bytes(flipped), png(2, 2, 8, 0, b"\0\1\2"), png(2, 2, 8, 0, b"\0" * 60), png(2, 2, 8, 0, b"\5\1\2\0\3\4"), png(2, 2, 8, 0, b"\0\1\2\0\3\4", interlaced=1), png(1, 1, 8, 3, b"\0\5", b"abc"), png(0, 2, 8, 0, b""), png(1, 1, 3, 0, b"\0\0")]
    files = spark.createDataFrame([(i, f"n{i}", x) for i, x in enumerate([good, *bad])], "id long, x string, content binary")
    found = pictures.decoded(files).collect()
    assert [(r.y, r.x, r.b, r.g, r.r, r.a) for r in found if r.id == 0] == [(0, 0, 1, 1, 1, 255), (0, 1, 2, 2, 2, 255), (1, 0, 3, 3, 3, 255), (1, 1, 4, 4, 4, 255)]
    assert sorted(r.id for r in found if r.y is None) == list(range(1, len(bad) + 1)) and len(found) == 4 + len(bad)


def test_there_and_back(spark):
    """Several bands, a band without any pixel, nulls, places left out."""
    rng = np.random.default_rng(2)
    rows = {(i, int(x), int(y)): tuple(int(v) for v in rng.integers(0, 256, 3)) for i in (1, 2) for x, y in zip(rng.integers(0, 40, 200), rng.integers(0, 50, 200) + (rng.random(200) < 0.5) * 150, strict=True)}
    extra = [(1, -1, 3, 1, 1, 1), (2, None, 3, 1, 1, 1), (3, 0, 0, None, 5, 6)]
    p = spark.createDataFrame([(*k, *v) for k, v in rows.items()] + extra, "image_id long, x long, y long, b long, g long, r long")
    rows[3, 0, 0] = (0, 5, 6)
    found = {(r.image_id, r.x, r.y): (r.b, r.g, r.r, r.a) for r in pictures.decoded(pictures.encoded(p)).collect()}
    assert {k: v[:3] for k, v in found.items() if v[3]} == rows and all(v == (0, 0, 0, 0) for v in found.values() if not v[3])
    for i in (1, 2, 3):
        w, h = (1 + max(k[a] for k in rows if k[0] == i) for a in (1, 2))
        assert sum(k[0] == i for k in found) == w * h
    assert pictures.decoded(pictures.encoded(p.limit(0))).count() == 0


def test_checksums_of_parts():
    a, b = b"abc" * 5000, bytes(range(256)) * 700
    assert pictures.joined_adler(zlib.adler32(a), zlib.adler32(b), len(b)) == zlib.adler32(a + b)
    assert pictures.joined_adler(1, zlib.adler32(b), len(b)) == zlib.adler32(b)
