"""GeoTIFF without outside libraries: header, windows by block, and a writer.

Read: classic and big files, strips and tiles, one or more bands (chunky or planar), uint8/16/32,
int16/32, float32/64; no compression, LZW or deflate; predictor 2 for integers.  Tags are read when
they are asked for, so that a header or a block costs a few ranges of the file.  Written: tiles, one
plane for each band, the same compressions, and overviews by average.  Georeference: pixel scale and
tie point, EPSG code, nodata and band descriptions.
"""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass
from xml.sax.saxutils import escape, unescape

import numpy as np

from bandloom.model import Affine, Raster

#: TIFF 6.0 field types: struct code by number (fixed values).
FIELD = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
NONE, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946
COMPRESSION = {"none": NONE, "lzw": LZW, "deflate": DEFLATE}
KIND = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}


def lzw_decode(data: bytes) -> bytes:
    table: list[bytes] = []
    out, held, width, bits, code_bits = [], 0, 0, 9, None
    for byte in data:
        held, width = held << 8 | byte, width + 8
        if width < bits:
            continue
        width -= bits
        code = held >> width & (1 << bits) - 1
        held &= (1 << width) - 1
        if code == 256:
            table, bits, code_bits = [bytes([k]) for k in range(256)] + [b"", b""], 9, None
            continue
        if code == 257:
            break
        if code_bits is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else code_bits + code_bits[:1]
            table.append(code_bits + entry[:1])
        out.append(entry)
        code_bits = entry
        bits = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out, held, width = bytearray(), 0, 0

    def put(code: int, bits: int) -> None:
        nonlocal held, width
        held, width = held << bits | code, width + bits
        while width >= 8:
            width -= 8
            out.append(held >> width & 255)
        held &= (1 << width) - 1

    known: dict[bytes, int] = {}
    fresh = {bytes([k]): k for k in range(256)}
    bits, put_next = 9, 258
    put(256, 9)
    known = dict(fresh)
    word = b""
    for k in range(len(data)):
        longer = word + data[k : k + 1]
        if longer in known:
            word = longer
            continue
        put(known[word], bits)
        known[longer] = put_next
        put_next += 1
        bits = 9 if put_next < 512 else 10 if put_next < 1024 else 11 if put_next < 2048 else 12
        if put_next >= 4094:
            put(256, bits)
            known, bits, put_next = dict(fresh), 9, 258
        word = data[k : k + 1]
    if word:
        put(known[word], bits)
        put_next += 1
        bits = 9 if put_next < 512 else 10 if put_next < 1024 else 11 if put_next < 2048 else 12
    put(257, bits)
    put(0, 7)
    return bytes(out)


def _unpack(data, form: str, at: int) -> tuple:
    return struct.unpack(form, bytes(data[at : at + struct.calcsize(form)]))


@dataclass
class TiffPage:
    """A page of ``data``; tags hold (type code, count, place of the values)."""

    tags: dict[int, tuple[str, int, int]]
    order: str
    data: object

    def get(self, tag: int, default=None):
        v = self.many(tag)
        return default if tag not in self.tags else v[0] if len(v) == 1 else v

    def many(self, tag: int) -> tuple:
        if tag not in self.tags:
            return ()
        code, count, at = self.tags[tag]
        return _unpack(self.data, f"{self.order}{count}s" if code == "s" else self.order + code * count, at)

    def one(self, tag: int, k: int) -> int:
        """Value ``k`` of a tag, without the others."""
        code, _, at = self.tags[tag]
        return _unpack(self.data, self.order + code, at + k * struct.calcsize("<" + code))[0]

    @property
    def width(self) -> int:
        return self.get(256)

    @property
    def height(self) -> int:
        return self.get(257)

    @property
    def count(self) -> int:
        return self.get(277, 1)

    @property
    def dtype(self) -> np.dtype:
        fmt = self.many(339) or (1,)
        return np.dtype(self.order + KIND[fmt[0], self.many(258)[0]])

    @property
    def nodata(self) -> float | None:
        text = self.get(42113, b"").rstrip(b"\0").decode()
        return float(text) if text.strip() else None

    def block_shape(self) -> tuple[int, int]:
        if 322 in self.tags:
            return self.get(323), self.get(322)
        return min(self.get(278, self.height), self.height), self.width

    def grid(self) -> tuple[int, int]:
        h, w = self.block_shape()
        return -(-self.height // h), -(-self.width // w)


def read_pages(data) -> list[TiffPage]:
    """The pages of a file (bytes, a memory map or ``Ranged``): the full image and its overviews."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    kind = _unpack(data, order + "H", 2)[0] if order else 0
    if kind not in (42, 43):
        raise ValueError("not a TIFF file")
    big = kind == 43
    # the widths of counts of tags, and of counts and places of values
    many, place, width = ("Q", "Q", 8) if big else ("H", "I", 4)
    entry, lead = 4 + 2 * width, struct.calcsize("<" + many)
    pages, at = [], _unpack(data, order + place, 8 if big else 4)[0]
    while at:
        n = _unpack(data, order + many, at)[0]
        tags = {}
        for k in range(n):
            start = at + lead + entry * k
            tag, form, count = _unpack(data, order + "HH" + place, start)
            code = FIELD.get(form)
            if code is None:
                continue
            where = start + 4 + width
            if struct.calcsize("<" + code) * count > width:
                where = _unpack(data, order + place, where)[0]
            tags[tag] = (code, count, where)
        pages.append(TiffPage(tags, order, data))
        at = _unpack(data, order + place, at + lead + entry * n)[0]
    return pages


def header(data, path: str = "") -> Raster:
    """Size, type of the first band, transform, CRS, nodata and descriptions; no pixels are read."""
    page = read_pages(data)[0]
    scale, tie = page.many(33550), page.many(33922)
    transform = Affine(scale[0], 0.0, tie[3] - tie[0] * scale[0], 0.0, -scale[1], tie[4] + tie[1] * scale[1]) if scale and tie else Affine(1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    crs, keys = "", page.many(34735)
    for k in range(4, len(keys) - 3, 4):
        if keys[k] in (2048, 3072) and keys[k + 1] == 0:
            crs = f"EPSG:{keys[k + 3]}"
    text = lambda tag: page.get(tag, b"").rstrip(b"\0").decode()
    names = {int(n): unescape(d) for n, d in re.findall(r'<Item name="DESCRIPTION" sample="(\d+)"[^>]*>([^<]*)</Item>', text(42112))}
    return Raster(path.rsplit("/", 1)[-1], page.width, page.height, transform, crs, page.nodata, tuple(names.get(k, "") for k in range(page.count)), page.dtype.newbyteorder("=").name, path)


def read_block(data, page: TiffPage, row: int, col: int, bands: list[int] | None = None) -> np.ndarray:
    """(bands, h, w) of one block, cut to the image; of planes of their own only the wanted ones are read."""
    bh, bw = page.block_shape()
    rows, cols = page.grid()
    planar, n = page.get(284, 1) == 2, page.count
    offsets, counts = (324, 325) if 322 in page.tags else (273, 279)
    h, w = min(bh, page.height - row * bh), min(bw, page.width - col * bw)
    out = np.empty((n, h, w), page.dtype.newbyteorder("="))
    for plane in (range(n) if bands is None else sorted(set(bands))) if planar else [0]:
        at = (plane * rows + row) * cols + col
        place, size = page.one(offsets, at), page.one(counts, at)
        if not size:  # a block that was never written
            out[plane if planar else slice(None)] = page.nodata or 0
            continue
        raw = bytes(data[place : place + size])
        kind = page.get(259, NONE)
        if kind == LZW:
            raw = lzw_decode(raw)
        elif kind in (DEFLATE, OLD_DEFLATE):
            raw = zlib.decompress(raw)
        elif kind != NONE:
            raise ValueError(f"compression {kind} is not read")
        each = 1 if planar else n
        have = h if 322 not in page.tags else bh
        block = np.frombuffer(raw, page.dtype, have * bw * each).reshape(have, bw, each).astype(page.dtype.newbyteorder("="))
        predictor = page.get(317, 1)
        if predictor == 2 and block.dtype.kind in "iu":
            block = np.cumsum(block, axis=1, dtype=block.dtype)
        elif predictor != 1:
            raise ValueError(f"predictor {predictor} is not read")
        part = np.moveaxis(block, 2, 0)[:, :h, :w]
        if planar:
            out[plane] = part[0]
        else:
            out[:] = part
    return out if bands is None else out[bands]


def read_window(data, row0: int, col0: int, row1: int, col1: int, bands: list[int] | None = None, out_shape: tuple[int, int] | None = None) -> np.ndarray:
    """Bands (from 1; all by default) of rows [row0, row1) and columns [col0, col1); nearest to ``out_shape``."""
    page = read_pages(data)[0]
    bh, bw = page.block_shape()
    out = np.zeros((page.count, row1 - row0, col1 - col0), page.dtype.newbyteorder("="))
    for br in range(max(0, row0) // bh, -(-min(row1, page.height) // bh)):
        for bc in range(max(0, col0) // bw, -(-min(col1, page.width) // bw)):
            block = read_block(data, page, br, bc)
            r, c = br * bh, bc * bw
            a, b = max(r, row0), min(r + block.shape[1], row1)
            x, y = max(c, col0), min(c + block.shape[2], col1)
            out[:, a - row0 : b - row0, x - col0 : y - col0] = block[:, a - r : b - r, x - c : y - c]
    if bands is not None:
        out = out[[b - 1 for b in bands]]
    if out_shape and out_shape != out.shape[1:]:
        rows = ((np.arange(out_shape[0]) + 0.5) * out.shape[1] / out_shape[0]).astype(int)
        cols = ((np.arange(out_shape[1]) + 0.5) * out.shape[2] / out_shape[1]).astype(int)
        out = out[:, rows][:, :, cols]
    return out


def _average(bands: np.ndarray) -> np.ndarray:
    n, h, w = bands.shape
    padded = np.pad(bands.astype(float), ((0, 0), (0, h % 2), (0, w % 2)), mode="edge")
    small = padded.reshape(n, (h + 1) // 2, 2, (w + 1) // 2, 2).mean((2, 4))
    return (np.rint(small) if bands.dtype.kind in "iu" else small).astype(bands.dtype)


def page_tags(raster: Raster, dtype: np.dtype, shape: tuple[int, int], n: int, tile: int, compress: str, overview: bool, predictor: bool = False) -> list[tuple[int, int, tuple | bytes]]:
    """(tag, type, values) of a tiled page with a plane for each band, but for the places of its tiles."""
    (h, w), t, kind = shape, raster.transform, {"u": 1, "i": 2, "f": 3}[dtype.kind]
    sx, sy = t.a * raster.width / w, t.e * raster.height / h
    tags: list[tuple[int, int, tuple | bytes]] = [
        (254, 4, (int(overview),)), (256, 4, (w,)), (257, 4, (h,)), (258, 3, (dtype.itemsize * 8,) * n), (259, 3, (COMPRESSION[compress],)),
        (262, 3, (1,)), (277, 3, (n,)), (284, 3, (2,)), (317, 3, (2 if predictor and kind < 3 else 1,)), (322, 3, (tile,)), (323, 3, (tile,)),
        (339, 3, (kind,) * n), (33550, 12, (sx, -sy, 0.0)), (33922, 12, (0.0, 0.0, 0.0, t.c, t.f, 0.0)),
    ]
    if raster.crs.startswith("EPSG:"):
        code = int(raster.crs[5:])
        flat = code == 4326
        tags.append((34735, 3, (1, 1, 0, 3, 1024, 0, 1, 2 if flat else 1, 1025, 0, 1, 1, 2048 if flat else 3072, 0, 1, code)))
    items = "".join(f'<Item name="DESCRIPTION" sample="{k}" role="description">{escape(d)}</Item>' for k, d in enumerate(raster.descriptions[:n]) if d)
    if items:
        tags.append((42112, 2, f"<GDALMetadata>{items}</GDALMetadata>\0".encode()))
    if raster.nodata is not None:
        tags.append((42113, 2, f"{raster.nodata:.17g}\0".encode()))
    return tags


def compress_block(block: np.ndarray, compress: str) -> bytes:
    raw = block.tobytes()
    return lzw_encode(raw) if compress == "lzw" else zlib.compress(raw) if compress == "deflate" else raw


@dataclass
class Layout:
    """Where things lie in a tiled file whose tiles are written by many tasks.

    ``parts``: (place, bytes) of the header and the pages; ``tables``: for each page the places of its
    tables of tile offsets and tile sizes, whose entries are ``width`` bytes; tiles begin at ``data``.
    """

    parts: list[tuple[int, bytes]]
    tables: list[tuple[int, int]]
    data: int
    width: int


def tiled_layout(raster: Raster, dtype: np.dtype, shapes: list[tuple[int, int]], n: int, tile: int, compress: str, big: bool) -> Layout:
    """The layout of pages of ``shapes``, the first the full image; ``big`` for files of 4 GB and more."""
    many, place, width, form = ("Q", "Q", 8, 16) if big else ("H", "I", 4, 4)
    at = 16 if big else 8
    parts = [(0, b"II+\0\x08\0\0\0" + struct.pack("<Q", at) if big else b"II*\0" + struct.pack("<I", at))]
    tables = []
    for number, (h, w) in enumerate(shapes):
        tiles = n * -(-h // tile) * -(-w // tile)
        tags = [*page_tags(raster, dtype, (h, w), n, tile, compress, number > 0), (324, form, tiles), (325, form, tiles)]
        lead = struct.calcsize("<" + many)
        free = at + lead + (4 + 2 * width) * len(tags) + width
        page, table = struct.pack("<" + many, len(tags)), []
        for k, (tag, kind, value) in enumerate(sorted(tags, key=lambda x: x[0])):
            size = tiles * width if isinstance(value, int) else len(value) if kind == 2 else struct.calcsize("<" + FIELD[kind]) * len(value)
            count = value if isinstance(value, int) else len(value)
            body = b"" if isinstance(value, int) else value if kind == 2 else struct.pack("<" + FIELD[kind] * count, *value)
            here = at + lead + (4 + 2 * width) * k + 4 + width  # where short values stand
            if size > width:
                here, free = free, free + size + size % 2
                if body:
                    parts.append((here, body))
                body = struct.pack("<" + place, here)
            page += struct.pack("<HH" + place, tag, kind, count) + body.ljust(width, b"\0")
            if isinstance(value, int):
                table.append(here)
        last = number == len(shapes) - 1
        parts.append((at, page + struct.pack("<" + place, 0 if last else free)))
        tables.append(tuple(table))
        at = free
    return Layout(parts, tables, at, width)


def encode_tiff(bands: np.ndarray, raster: Raster, compress: str = "lzw", tile: int = 512, predictor: bool = False, overviews: int = 0) -> bytes:
    """A tiled GeoTIFF of (bands, H, W); ``overviews`` halves the size so many times, by average."""
    pages, level = [bands], bands
    for _ in range(overviews):
        level = _average(level)
        pages.append(level)
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for number, image in enumerate(pages):
        n, h, w = image.shape
        image = image.astype(image.dtype.newbyteorder("<"))
        offsets, counts = [], []
        for band in image:
            for r in range(0, h, tile):
                for c in range(0, w, tile):
                    block = np.zeros((tile, tile), image.dtype)
                    part = band[r : r + tile, c : c + tile]
                    block[: part.shape[0], : part.shape[1]] = part
                    if predictor and block.dtype.kind in "iu":
                        block[:, 1:] -= block[:, :-1].copy()
                    raw = compress_block(block, compress)
                    offsets.append(len(out))
                    counts.append(len(raw))
                    out += raw + b"\0" * (len(raw) % 2)
        tags = page_tags(raster, image.dtype, (h, w), n, tile, compress, number > 0, predictor)
        tags += [(324, 4, tuple(offsets)), (325, 4, tuple(counts))]
        entries = []
        for tag, form, value in sorted(tags):
            body = value if form == 2 else struct.pack("<" + FIELD[form] * len(value), *value)
            entries.append((tag, form, len(value), body))
        for k, (tag, form, count, body) in enumerate(entries):
            if len(body) > 4:
                entries[k] = tag, form, count, struct.pack("<I", len(out))
                out += body + b"\0" * (len(body) % 2)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries))
        for tag, form, count, body in entries:
            out += struct.pack("<HHI", tag, form, count) + body.ljust(4, b"\0")
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)
