"""PNG pictures as bytes to pixels and back, in Arrow batches and bands of rows.

Contract. `decoded` takes any key columns and `content` (bytes): gray, gray with alpha, palette, RGB and RGBA of 1 to 16
bits, not interlaced; 16 bits are cut to 8. Colour keys of tRNS are ignored, palette alphas aren't. A picture that is null,
isn't a PNG, is damaged, cut short or interlaced gives one row whose pixel is null, and no row of a part of it. Repeated
pictures are decoded each for itself. A task holds one picture's bytes and a band of its rows. `encoded` takes image_id, x, y
from 0 on, b, g, r and writes RGBA; places without a pixel are transparent black, null channels are 0, of repeated pixels
one stays. Rows with a null or negative place are left out. Keys named like a column of pixels are left out. Empty tables give empty tables.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: signature, samples by colour type, depths by colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
#: Bytes of a band of rows that is decoded at a time, and rows of a band that is encoded at a time.
BAND_BYTES, BAND_ROWS, ADLER = 1 << 18, 64, 65521


class Damaged(ValueError):
    """The bytes aren't a picture that can be read."""


def chunks(content: bytes) -> Iterator[tuple[bytes, memoryview]]:
    if content[:8] != SIGNATURE:
        raise Damaged("signature")
    at, view = 8, memoryview(content)
    while at + 12 <= len(content):
        (n,) = struct.unpack_from(">I", content, at)
        if at + 12 + n > len(content):
            raise Damaged("cut short")
        kind, data = content[at + 4 : at + 8], view[at + 8 : at + 8 + n]
        if zlib.crc32(view[at + 4 : at + 8 + n]) != struct.unpack_from(">I", content, at + 8 + n)[0]:
            raise Damaged("checksum")
        yield kind, data
        if kind == b"IEND":
            return
        at += 12 + n
    raise Damaged("no end")


class Picture:
    """A PNG's head, and its rows band by band."""

    def __init__(self, content: bytes):
        self.data, self.palette, head = [], None, None
        alphas = b""
        for kind, data in chunks(content):
            if kind == b"IHDR":
                if len(data) != 13:
                    raise Damaged("head")
                head = struct.unpack(">IIBBBBB", data)
            elif kind == b"PLTE":
                self.palette = np.frombuffer(data, dtype=np.uint8)
            elif kind == b"tRNS":
                alphas = bytes(data)
            elif kind == b"IDAT":
                self.data.append(data)
        if head is None or head[3] not in SAMPLES or head[2] not in DEPTHS[head[3]] or any(head[4:]) or not head[0] or not head[1]:
            raise Damaged("head")
        self.width, self.height, self.depth, self.kind = head[:4]
        bits = SAMPLES[self.kind] * self.depth
        self.pixel, self.line = max(1, bits // 8), (self.width * bits + 7) // 8
        if self.kind == 3:
            if self.palette is None or len(self.palette) % 3:
                raise Damaged("palette")
            colours = self.palette.reshape(-1, 3)
            own = np.frombuffer(alphas, dtype=np.uint8)[: len(colours)]
            self.palette = np.column_stack([colours, np.concatenate([own, np.full(len(colours) - len(own), 255, dtype=np.uint8)])])

    def bands(self) -> Iterator[bytearray]:
        """Filtered rows, whole ones, about BAND_BYTES at a time; raises at the end if there were too few or too many."""
        inflate, held, left = zlib.decompressobj(), bytearray(), self.height * (self.line + 1)
        for data in self.data:
            while len(data):
                try:
                    held += inflate.decompress(data, BAND_BYTES)
                except zlib.error as e:
                    raise Damaged(str(e)) from e
                data = inflate.unconsumed_tail
                whole = len(held) // (self.line + 1) * (self.line + 1)
                left -= whole
                if left < 0:
                    raise Damaged("too many rows")
                if whole:
                    yield held[:whole]
                    del held[:whole]
                if inflate.eof:
                    break
        if left or held or not inflate.eof:
            raise Damaged("rows are missing")

    def rows(self) -> Iterator[np.ndarray]:
        """Bands as arrays rows x width x (r, g, b, a)."""
        above = np.zeros(self.line, dtype=np.uint8)
        for band in self.bands():
            raw = np.frombuffer(bytes(band), dtype=np.uint8).reshape(-1, self.line + 1)
            out = np.empty((len(raw), self.line), dtype=np.uint8)
            for i, row in enumerate(raw):
                out[i] = above = unfiltered(int(row[0]), row[1:], above, self.pixel)
            yield self._colours(out)

    def _colours(self, lines: np.ndarray) -> np.ndarray:
        n = SAMPLES[self.kind]
        if self.depth == 16:
            v = lines[:, ::2]
        elif self.depth < 8:
            bits = np.unpackbits(lines, axis=1)[:, : self.width * self.depth].reshape(len(lines), -1, self.depth)
            v = (bits @ (1 << np.arange(self.depth)[::-1])).astype(np.uint8)
            if self.kind == 0:
                v = (v.astype(int) * 255 // ((1 << self.depth) - 1)).astype(np.uint8)
        else:
            v = lines
        v = v.reshape(len(lines), self.width, n)
        if self.kind == 3:
            if v.max() >= len(self.palette):
                raise Damaged("colour beyond the palette")
            return self.palette[v[:, :, 0]]
        colour = v[:, :, :3] if n >= 3 else np.repeat(v[:, :, :1], 3, axis=2)
        alpha = v[:, :, n - 1 :] if n in (2, 4) else np.full((*v.shape[:2], 1), 255, dtype=np.uint8)
        return np.concatenate([colour, alpha], axis=2)


def unfiltered(kind: int, row: np.ndarray, above: np.ndarray, pixel: int) -> np.ndarray:
    """A row's bytes from its differences to the left, to the row above, to their mean, or to the likeliest of three."""
    if kind == 0:
        return row
    if kind == 1:
        wide = np.zeros(-(-len(row) // pixel) * pixel, dtype=np.uint8)
        wide[: len(row)] = row
        return np.cumsum(wide.reshape(-1, pixel), axis=0, dtype=np.uint8).reshape(-1)[: len(row)]
    if kind == 2:
        return row + above
    if kind not in (3, 4):
        raise Damaged("filter")
    done, up = [0] * pixel, [0] * pixel + above.tolist()
    for i, v in enumerate(row.tolist()):
        a, b, c = done[i], up[i + pixel], up[i]
        if kind == 3:
            guess = (a + b) >> 1
        else:
            near = a + b - c
            guess = min((abs(near - a), 0, a), (abs(near - b), 1, b), (abs(near - c), 2, c))[2]
        done.append((v + guess) & 255)
    return np.array(done[pixel:], dtype=np.uint8)


def decoded(files: DataFrame) -> DataFrame:
    """The key columns and y, x, b, g, r, a (0 to 255) of each pixel of the pictures in `content`."""
    keys = [k for k in files.columns if k not in ("content", *"yxbgra")]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for own, content in zip(pdf[keys].to_dict("records"), pdf.content, strict=True):
                try:
                    if content is None:
                        raise Damaged("null")
                    picture = Picture(bytes(content))
                    for _ in picture.rows():  # a first pass, so that no part of a damaged picture is given
                        pass
                except Damaged:
                    yield pd.DataFrame({**{k: [v] for k, v in own.items()}, **{k: pd.array([None], dtype="Int64") for k in "yxbgra"}})
                    continue
                top = 0
                for band in picture.rows():
                    y, x = np.indices(band.shape[:2])
                    out = {"y": y.ravel() + top, "x": x.ravel(), **{k: band[:, :, i].ravel().astype(np.int64) for i, k in ((2, "b"), (1, "g"), (0, "r"), (3, "a"))}}
                    yield pd.DataFrame({**{k: [v] * y.size for k, v in own.items()}, **out})
                    top += len(band)

    types = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields if f.name in keys], *[f"{k} long" for k in "yxbgra"]])
    return files.select(*keys, "content").mapInPandas(decode, types)


def joined_adler(first: int, second: int, length: int) -> int:
    """Adler-32 of two runs of bytes put together, from those of each and the second's length."""
    a1, b1, a2, b2 = first & 0xFFFF, first >> 16, second & 0xFFFF, second >> 16
    return ((b1 + b2 + length * (a1 - 1)) % ADLER) << 16 | (a1 + a2 - 1) % ADLER


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encoded(pixels: DataFrame) -> DataFrame:
    """image_id, content: a PNG of each image. Bands of rows are packed apart; a picture's bytes are put together last."""
    c = F.col
    p = pixels.where("x >= 0 AND y >= 0").select("image_id", F.floor(c("y") / BAND_ROWS).alias("band"), "x", "y", *[F.coalesce(k, F.lit(0)).alias(k) for k in "bgr"])
    size = p.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    bands = size.select(c("image_id").alias("image_id"), "w", "h", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((c("h") - 1) / BAND_ROWS))).alias("band"))

    def pack(own: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame(columns=["image_id", "w", "h", "band", "piece", "adler", "n"])
        o = own.iloc[0]
        top, w, h = int(o.band) * BAND_ROWS, int(o.w), int(o.h)
        rows = np.zeros((min(BAND_ROWS, h - top), w, 4), dtype=np.uint8)
        rows[pdf.y.to_numpy(int) - top, pdf.x.to_numpy(int)] = np.column_stack([*[pdf[k].to_numpy(int) for k in "rgb"], np.full(len(pdf), 255)])
        rows[:, 1:] -= rows[:, :-1].copy()
        lines = np.concatenate([np.ones((len(rows), 1), dtype=np.uint8), rows.reshape(len(rows), -1)], axis=1).tobytes()
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        piece = z.compress(lines) + z.flush(zlib.Z_FINISH if top + len(rows) == h else zlib.Z_FULL_FLUSH)
        return pd.DataFrame({"image_id": [o.image_id], "w": [w], "h": [h], "band": [o.band], "piece": [piece], "adler": [zlib.adler32(lines)], "n": [len(lines)]})

    image = pixels.schema["image_id"].dataType.simpleString()
    pieces = bands.groupBy("image_id", "band").cogroup(p.groupBy("image_id", "band")).applyInPandas(pack, f"image_id {image}, w long, h long, band long, piece binary, adler long, n long")

    @F.pandas_udf("binary")
    def file(w: pd.Series, h: pd.Series, parts: pd.Series) -> pd.Series:
        out = []
        for wide, high, own in zip(w, h, parts, strict=True):
            adler = 1
            for q in own:
                adler = joined_adler(adler, int(q["adler"]), int(q["n"]))
            data = [b"\x78\x9c", *[bytes(q["piece"]) for q in own], struct.pack(">I", adler)]
            out.append(SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", wide, high, 8, 6, 0, 0, 0)) + b"".join(_chunk(b"IDAT", x) for x in data) + _chunk(b"IEND", b""))
        return pd.Series(out)

    listed = pieces.groupBy("image_id").agg(F.first("w").alias("w"), F.first("h").alias("h"), F.sort_array(F.collect_list(F.struct("band", "piece", "adler", "n"))).alias("parts"))
    return listed.select("image_id", file("w", "h", "parts").alias("content"))
