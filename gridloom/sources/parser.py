"""Reading the file format: byte sources, headers, directory chains, tag values, tiles, decoded blocks.

Plain Python and numpy, used inside tasks by the data source and by scans over BINARY columns.
"""

from __future__ import annotations

import mmap
import os
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

from ..functions import predictors
from ..functions.codecs import codec_of
from ..functions.constants import PIXEL_DTYPE, TYPE_LETTER, TYPE_NAME, TYPE_SIZE, RasterError, Tag


class BufferSource:
    """Bytes in memory. A read past the end is cut short; one that starts past it is OutOfBounds."""

    def __init__(self, data: bytes) -> None:
        self.data, self.size = data, len(data)

    def _fetch(self, offset: int, size: int) -> bytes:
        return bytes(self.data[offset : offset + size])

    def read(self, offset: int, size: int) -> bytes:
        if offset < 0 or offset > self.size:
            raise RasterError("OutOfBounds", f"offset {offset} of {self.size}")
        return self._fetch(offset, min(size, self.size - offset))

    def exact(self, offset: int, size: int) -> bytes:
        out = self.read(offset, size)
        if len(out) < size:
            raise RasterError("UnexpectedEndOfFile", f"{size} bytes at {offset}")
        return out

    def close(self) -> None:
        pass


class FileSource(BufferSource):
    """A local file read by position; safe for threads."""

    def __init__(self, path: str) -> None:
        try:
            self.fd = os.open(path, os.O_RDONLY)
        except OSError as e:
            raise RasterError("FileNotFound", str(e)) from e
        self.size = os.fstat(self.fd).st_size

    def _fetch(self, offset: int, size: int) -> bytes:
        return os.pread(self.fd, size, offset)

    def close(self) -> None:
        os.close(self.fd)


class MmapSource(BufferSource):
    """A local file mapped into memory."""

    def __init__(self, path: str) -> None:
        try:
            with open(path, "rb") as f:
                self.size = os.fstat(f.fileno()).st_size
                self.data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if self.size else b""
        except OSError as e:
            raise RasterError("FileNotFound", str(e)) from e

    def close(self) -> None:
        if self.size:
            self.data.close()


class StoreSource(BufferSource):
    """A file of any store that pyarrow knows, by range reads."""

    def __init__(self, uri: str) -> None:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        try:
            self.file = store.open_input_file(path)
        except OSError as e:
            raise RasterError("FileNotFound", str(e)) from e
        self.size = self.file.size()

    def _fetch(self, offset: int, size: int) -> bytes:
        return self.file.read_at(size, offset)

    def close(self) -> None:
        self.file.close()


_OPENERS: dict[str, Callable[[str], BufferSource]] = {}


def register_source(prefix: str, opener: Callable[[str], BufferSource]) -> None:
    """Open paths with this prefix by one's own source: an object with size, read, exact and close."""
    _OPENERS[prefix] = opener


def open_source(path: str) -> BufferSource:
    for prefix, opener in _OPENERS.items():
        if path.startswith(prefix):
            return opener(path)
    if path.startswith("file:"):
        path = path.removeprefix("file://").removeprefix("file:")
    return StoreSource(path) if "://" in path else FileSource(path)


@dataclass(frozen=True)
class Header:
    order: str  # "<" or ">"
    big: bool
    first: int


@dataclass(frozen=True)
class Entry:
    pos: int
    code: int
    dtype: int
    count: int
    inline: bool
    offset: int  # of an external value; 0 if inline
    raw: bytes


@dataclass(frozen=True)
class Directory:
    page: int
    parent: int  # offset of the parent directory; 0 for pages
    offset: int
    next: int
    entries: tuple[Entry, ...]


def header(src: BufferSource) -> Header:
    head = src.read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or len(head) < 8:
        raise RasterError("InvalidHeader", "byte order")
    (version,) = struct.unpack(order + "H", head[2:4])
    if version == 42:
        return Header(order, False, struct.unpack(order + "I", head[4:8])[0])
    if version != 43 or len(head) < 16:
        raise RasterError("InvalidHeader", f"version {version}")
    size, reserved, first = struct.unpack(order + "HHQ", head[4:16])
    if size != 8 or reserved:
        raise RasterError("InvalidHeader", "offset size or reserved field")
    return Header(order, True, first)


def next_offset(src: BufferSource, h: Header, offset: int) -> tuple[int, int]:
    """(entry count, next offset) without reading the entries."""
    head, step, tail = (8, 20, 8) if h.big else (2, 12, 4)
    (n,) = struct.unpack(h.order + ("Q" if h.big else "H"), src.exact(offset, head))
    (follow,) = struct.unpack(h.order + ("Q" if h.big else "I"), src.exact(offset + head + n * step, tail))
    return n, follow


def directory(src: BufferSource, h: Header, offset: int, page: int = 0, parent: int = 0) -> Directory:
    """One directory: entries and next offset in one read after the count."""
    head, step, tail = (8, 20, 8) if h.big else (2, 12, 4)
    (n,) = struct.unpack(h.order + ("Q" if h.big else "H"), src.exact(offset, head))
    if n * step > src.size:
        raise RasterError("UnexpectedEndOfFile", f"{n} entries at {offset}")
    body = src.exact(offset + head, n * step + tail)
    limit, letter = (8, "HHQ8s") if h.big else (4, "HHI4s")
    entries = []
    for i, (code, dtype, count, raw) in enumerate(struct.iter_unpack(h.order + letter, body[: n * step])):
        inline = TYPE_SIZE.get(dtype, 0) * count <= limit
        at = 0 if inline else struct.unpack(h.order + ("Q" if h.big else "I"), raw)[0]
        entries.append(Entry(i, code, dtype, count, inline, at, raw))
    (follow,) = struct.unpack(h.order + ("Q" if h.big else "I"), body[n * step :])
    return Directory(page, parent, offset, follow, tuple(entries))


def pages(src: BufferSource, h: Header, only: set[int] | None = None, sub: bool = False) -> Iterator[Directory | RasterError]:
    """The chain of pages, and their sub-directories if ``sub``. A cycle or a bad offset yields one error and ends it.

    Pages that aren't asked for are skipped without reading their entries.
    """
    seen: set[int] = set()
    offset, page, last = h.first, 0, max(only) if only else None
    while offset and (last is None or page <= last):
        if offset in seen:
            yield RasterError("InvalidOperation", f"directory cycle at {offset}")
            return
        seen.add(offset)
        try:
            if only is not None and page not in only:
                _, offset = next_offset(src, h, offset)
            else:
                d = directory(src, h, offset, page)
                yield d
                if sub:
                    yield from _children(src, h, d, seen)
                offset = d.next
        except RasterError as e:
            yield e
            return
        page += 1


def _children(src: BufferSource, h: Header, d: Directory, seen: set[int]) -> Iterator[Directory | RasterError]:
    for e in d.entries:
        if e.code == 330:
            for at in numbers(src, h, e):
                if at in seen:
                    yield RasterError("InvalidOperation", f"directory cycle at {at}")
                    continue
                seen.add(at)
                try:
                    child = directory(src, h, at, d.page, d.offset)
                    yield child
                    yield from _children(src, h, child, seen)
                except RasterError as error:
                    yield error


def raw_bytes(src: BufferSource, h: Header, e: Entry) -> bytes:
    n = TYPE_SIZE.get(e.dtype, 0) * e.count
    return e.raw[:n] if e.inline else src.exact(e.offset, n)


def numbers(src: BufferSource, h: Header, e: Entry) -> list:
    """All values of a numeric entry; rationals as pairs."""
    letter = TYPE_LETTER.get(e.dtype)
    if letter is None or letter == "s":
        raise RasterError("InvalidTagType", f"type {e.dtype}")
    data = raw_bytes(src, h, e)
    if len(letter) == 2:
        return [tuple(p) for p in struct.iter_unpack(h.order + letter, data)]
    return list(struct.unpack(f"{h.order}{e.count}{letter}", data))


def value(src: BufferSource, h: Header, e: Entry, tag: Tag):
    """The entry's value as the tag declares it. Listed other types are promoted; anything else is an error."""
    kind = TYPE_NAME.get(e.dtype)
    if tag.shape in ("text", "texts"):
        if kind not in ("Ascii", "Byte", "SByte", "Undefined"):
            raise RasterError("InvalidTagType", f"tag {tag.code} has type {e.dtype}")
        data = raw_bytes(src, h, e)
        if tag.shape == "texts":
            parts = data.split(b"\0")
            return [p.decode("utf-8", "replace") for p in (parts if parts[-1] else parts[:-1])]
        return (data.rstrip(b"\0") if kind == "Ascii" else data).decode("utf-8", "replace")
    if kind != tag.type and kind not in tag.also:
        raise RasterError("InvalidTagType", f"tag {tag.code} has type {e.dtype}")
    if tag.shape == "one":
        if e.count != 1:
            raise RasterError("InvalidTag", f"tag {tag.code} has {e.count} values")
        return numbers(src, h, e)[0]
    if tag.type in ("Byte", "Undefined"):
        data = raw_bytes(src, h, e)
        out = data
    else:
        out = numbers(src, h, e)
    if tag.count is not None:
        if len(out) > tag.count:
            raise RasterError("OutOfBounds", f"tag {tag.code} has {len(out)} values")
        zero = b"\0" if isinstance(out, bytes) else [(0, 0) if tag.type.endswith("Rational") else 0]
        out = out + zero * (tag.count - len(out))
    return out


def extract(src: BufferSource, h: Header, entries: tuple[Entry, ...], spec: list[Tag], assume_sorted: bool = False) -> dict:
    """Values of a schema. A required tag that is missing or bad raises; an optional one is None.

    With ``assume_sorted`` entries out of code order may be missed, as a single merge pass would.
    """
    if not entries:
        if all(t.optional for t in spec):
            return {t.name: None for t in spec}
        raise RasterError("InvalidTag", "empty directory")
    by_code: dict[int, Entry] = {}
    highest = -1
    for e in entries:
        if assume_sorted and e.code < highest:
            continue
        highest = max(highest, e.code)
        by_code.setdefault(e.code, e)
    out = {}
    for t in spec:
        e = by_code.get(t.code)
        if e is None:
            if not t.optional:
                raise RasterError("InvalidTag", f"tag {t.code} is missing")
            out[t.name] = None
            continue
        try:
            out[t.name] = value(src, h, e, t)
        except RasterError:
            if not t.optional:
                raise
            out[t.name] = None
    return out


@dataclass(frozen=True)
class Shape:
    width: int
    height: int
    depth: int
    samples: int
    bits: int
    format: int
    planar: bool

    @property
    def dtype(self) -> np.dtype:
        if (self.bits, self.format) not in PIXEL_DTYPE:
            raise RasterError("UnsupportedFeature", f"{self.bits} bits of format {self.format}")
        return np.dtype(PIXEL_DTYPE[self.bits, self.format])


def shape(v: dict) -> Shape:
    bits, n = v.get("BitsPerSample") or [1], v.get("SamplesPerPixel") or 1
    if v.get("ImageWidth") is None or v.get("ImageLength") is None:
        raise RasterError("InvalidTag", "no image size")
    if len(bits) != n:
        raise RasterError("InvalidFormat", "BitsPerSample has another length than SamplesPerPixel")
    if len(set(bits)) != 1:
        raise RasterError("InvalidFormat", "samples of unequal size")
    return Shape(v["ImageWidth"], v["ImageLength"], v.get("ImageDepth") or 1, n, bits[0], v.get("SampleFormat") or 1, v.get("PlanarConfiguration") == 2)


@dataclass(frozen=True)
class Tile:
    idx: int
    x: int
    y: int
    z: int
    plane: int
    w: int
    h: int
    d: int
    n: int
    offset: int
    length: int


@dataclass(frozen=True)
class Region:
    """Starts and sizes by axis; sizes of None reach to the border."""

    x: int = 0
    y: int = 0
    z: int = 0
    c: int = 0
    w: int | None = None
    h: int | None = None
    d: int | None = None
    n: int | None = None

    def within(self, s: Shape) -> Region:
        full = {"w": s.width - self.x, "h": s.height - self.y, "d": s.depth - self.z, "n": s.samples - self.c}
        out = Region(self.x, self.y, self.z, self.c, *[full[k] if getattr(self, k) is None else getattr(self, k) for k in "whdn"])
        if min(out.w, out.h, out.d, out.n) <= 0 or min(self.x, self.y, self.z, self.c) < 0 or any(getattr(out, k) > full[k] for k in full):
            raise RasterError("OutOfBounds", "region is empty or beyond the image")
        return out


def tiles(v: dict, s: Shape, region: Region | None = None) -> list[Tile]:
    """Tiles (or strips) that a region touches, missing ones too, in file offset order."""
    r = (region or Region()).within(s)
    tiled = all(v.get(k) is not None for k in ("TileWidth", "TileLength", "TileOffsets", "TileByteCounts"))
    if tiled:
        tw, th, td, at, size = v["TileWidth"], v["TileLength"], v.get("TileDepth") or 1, v["TileOffsets"], v["TileByteCounts"]
    else:
        if v.get("StripOffsets") is None or v.get("StripByteCounts") is None:
            raise RasterError("InvalidTag", "neither tiles nor strips")
        rows = v.get("RowsPerStrip")
        tw, th, td, at, size = s.width, min(s.height if rows is None else rows, s.height), 1, v["StripOffsets"], v["StripByteCounts"]
    if min(tw, th, td) <= 0:
        raise RasterError("InvalidFormat", "tile size is zero")
    nx, ny, nz = -(-s.width // tw), -(-s.height // th), -(-s.depth // td)
    planes = range(r.c, r.c + r.n) if s.planar else range(1)
    out = []
    for p in planes:
        for tz in range(r.z // td, (r.z + r.d - 1) // td + 1):
            for ty in range(r.y // th, (r.y + r.h - 1) // th + 1):
                for tx in range(r.x // tw, (r.x + r.w - 1) // tw + 1):
                    i = ((p * nz + tz) * ny + ty) * nx + tx
                    if i >= len(at) or i >= len(size):
                        raise RasterError("OutOfBounds", f"tile {i} of {len(at)}")
                    h = th if tiled else min(th, s.height - ty * th)
                    out.append(Tile(i, tx * tw, ty * th, tz * td, p, tw, h, td, 1 if s.planar else s.samples, at[i], size[i]))
    return sorted(out, key=lambda t: (t.offset, t.idx))


def decode(data: bytes, t: Tile, dtype: np.dtype, compression: int = 1, predictor: int = 1, order: str = "<", pixel_endian: str = "file", float_predictor: str = "bitdelta") -> np.ndarray:
    """A stored block as a (d, h, w, n) array. ``pixel_endian``: "file" swaps with the file's order, "native" never."""
    want = t.w * t.h * t.d * t.n * dtype.itemsize
    plain = codec_of(compression).decompress(data, want)
    if len(plain) != want:
        raise RasterError("InvalidFormat", f"block has {len(plain)} bytes, not {want}")
    swap = pixel_endian == "file" and not predictors.keeps_order(dtype, predictor, float_predictor)
    stored = dtype.newbyteorder(order) if swap else dtype
    block = np.frombuffer(plain, stored).astype(dtype, copy=False).reshape(t.d * t.h, t.w, t.n)
    return predictors.undo(block, predictor, float_predictor).reshape(t.d, t.h, t.w, t.n)


def batches(ts: list[Tile], max_gap: int = 64 << 10, max_batch: int = 4 << 20) -> list[list[Tile]]:
    """Adjacent spans that are read at once; see ``operators.spans.greedy_batches``."""
    out: list[list[Tile]] = []
    begin = end = 0
    for t in ts:
        reach = max(end, t.offset + t.length)
        if out and t.offset - end <= max_gap and reach - begin <= max_batch:
            out[-1].append(t)
            end = reach
        else:
            out.append([t])
            begin, end = t.offset, t.offset + t.length
    return out


def blocks(src: BufferSource, h: Header, v: dict, region: Region | None = None, wanted=None, **how) -> Iterator[tuple[Tile, np.ndarray]]:
    """Decoded blocks of a region; missing tiles (length 0) are left out. ``wanted(tile)`` prunes before any read."""
    s = shape(v)
    todo = [t for t in tiles(v, s, region) if t.length and (wanted is None or wanted(t))]
    for group in batches(todo):
        start = group[0].offset
        data = src.read(start, max(t.offset + t.length for t in group) - start)
        for t in group:
            piece = data[t.offset - start : t.offset - start + t.length]
            if len(piece) < t.length:
                raise RasterError("UnexpectedEndOfFile", f"tile {t.idx}")
            yield t, decode(piece, t, s.dtype, v.get("Compression") or 1, v.get("Predictor") or 1, h.order, **how)


def assemble(s: Shape, region: Region, parts, layout: str = "DHWC", fill: int = 0) -> np.ndarray:
    """Blocks scattered into one array of the region; samples without a block hold ``fill``."""
    r = region.within(s)
    out = np.full((r.d, r.h, r.w, r.n), fill, s.dtype)
    for t, block in parts:
        z0, z1 = max(t.z, r.z), min(t.z + t.d, r.z + r.d)
        y0, y1 = max(t.y, r.y), min(t.y + t.h, r.y + r.h)
        x0, x1 = max(t.x, r.x), min(t.x + t.w, r.x + r.w)
        c0, c1 = (t.plane, t.plane + 1) if s.planar else (r.c, r.c + r.n)
        if min(z1 - z0, y1 - y0, x1 - x0) <= 0:
            continue
        cut = block[z0 - t.z : z1 - t.z, y0 - t.y : y1 - t.y, x0 - t.x : x1 - t.x]
        out[z0 - r.z : z1 - r.z, y0 - r.y : y1 - r.y, x0 - r.x : x1 - r.x, c0 - r.c : c1 - r.c] = cut if s.planar else cut[..., c0:c1]
    axes = {"DHWC": (0, 1, 2, 3), "DCHW": (0, 3, 1, 2), "CDHW": (3, 0, 1, 2)}[layout]
    return np.ascontiguousarray(out.transpose(axes))
