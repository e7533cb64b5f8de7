"""Writing the file format: directories, headers, chunk encoding, whole images, and a sink for DataFrames."""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from ..functions import predictors
from ..functions.codecs import codec_of
from ..functions.constants import COMPRESSION, PHOTOMETRIC, PREDICTOR, SAMPLE_FORMAT, TAGS, TYPE_CODE, TYPE_LETTER, RasterError, Tag
from ..operators.layout import fetch_padded

# Named bundles of write policies.
PRESETS = {
    "reading": {"ifd_placement": "beginning", "tile_order": "image"},
    "writing": {"ifd_placement": "end", "tile_order": "sequential"},
    "streaming": {"ifd_placement": "end", "tile_order": "on_demand"},
    "editing": {"ifd_placement": "inline", "tile_order": "image"},
}


def value_bytes(tag: Tag, value, order: str) -> tuple[int, bytes]:
    """(count, bytes) of a value; text gets a final NUL, bytes don't."""
    if tag.shape in ("text", "texts"):
        parts = [value] if tag.shape == "text" else list(value)
        data = b"".join(p.encode("utf-8") + b"\0" for p in parts)
        return len(data), data
    letter = TYPE_LETTER[TYPE_CODE[tag.type]]
    if isinstance(value, bytes | bytearray):
        return len(value), bytes(value)
    values = [value] if tag.shape == "one" else list(value)
    if tag.count is not None and len(values) != tag.count:
        raise RasterError("InvalidTag", f"tag {tag.code} takes {tag.count} values")
    flat = [x for v in values for x in v] if len(letter) == 2 else values
    try:
        return len(values), struct.pack(f"{order}{len(flat)}{letter[0]}", *flat)
    except struct.error as e:
        raise RasterError("InvalidTag", f"tag {tag.code}: {e}") from e


class DirectoryBuilder:
    """Collects tags, sorts them by code and lays out a directory with its external values right behind it."""

    def __init__(self, order: str = "<", big: bool = False) -> None:
        self.order, self.big, self.next, self.external_at = order, big, 0, None
        self.clear()

    def clear(self) -> None:
        self.items: dict[int, tuple[Tag, int, bytes]] = {}

    def add(self, tag: Tag, value) -> DirectoryBuilder:
        self.items[tag.code] = (tag, *value_bytes(tag, value, self.order))
        return self

    def add_all(self, values: dict[str, object], big: bool | None = None) -> DirectoryBuilder:
        for name, v in values.items():
            if v is not None:
                wide = f"{name}Big"
                self.add(TAGS[wide] if (self.big if big is None else big) and wide in TAGS else TAGS[name], v)
        return self

    @property
    def limit(self) -> int:
        return 8 if self.big else 4

    @property
    def ifd_size(self) -> int:
        return (16 + 20 * len(self.items)) if self.big else (6 + 12 * len(self.items))

    @property
    def external_size(self) -> int:
        return sum(len(d) + len(d) % 2 for _, _, d in self.items.values() if len(d) > self.limit)

    @property
    def total_size(self) -> int:
        return self.ifd_size + self.external_size

    def build(self, offset: int, next_ifd: int = 0) -> bytes:
        """The directory's bytes for a place in the file, external values included."""
        at = offset + self.ifd_size if self.external_at is None else self.external_at
        head, letter = ("Q", "HHQ") if self.big else ("H", "HHI")
        word = "Q" if self.big else "I"
        out, external = [struct.pack(self.order + head, len(self.items))], []
        for code in sorted(self.items):
            tag, count, data = self.items[code]
            entry = struct.pack(self.order + letter, code, TYPE_CODE[tag.type], count)
            if len(data) <= self.limit:
                entry += data.ljust(self.limit, b"\0")
            else:
                entry += struct.pack(self.order + word, at)
                external.append(data + b"\0" * (len(data) % 2))
                at += len(external[-1])
            out.append(entry)
        out.append(struct.pack(self.order + word, next_ifd))
        return b"".join(out + external)


def header_bytes(first: int, order: str = "<", big: bool = False) -> bytes:
    mark = b"II" if order == "<" else b"MM"
    return mark + (struct.pack(order + "HHHQ", 43, 8, 0, first) if big else struct.pack(order + "HI", 42, first))


@dataclass
class Image:
    """Pixels in DHWC order with how to store them. ``rows_per_strip`` makes strips; else tiles."""

    pixels: np.ndarray
    tile: tuple[int, int, int] = (1, 128, 128)  # depth, height, width
    rows_per_strip: int | None = None
    planar: bool = False
    compression: str | int = "None"
    predictor: str = "None"
    tags: dict[str, object] = field(default_factory=dict)
    pixel_endian: str = "file"
    float_predictor: str = "bitdelta"


@dataclass(frozen=True)
class Chunk:
    idx: int
    x: int
    y: int
    z: int
    plane: int
    w: int
    h: int
    d: int
    raw_size: int
    data: bytes


def encode_chunk(block: np.ndarray, compression: int, predictor: int, order: str = "<", pixel_endian: str = "file", float_predictor: str = "bitdelta") -> bytes:
    """A (d, h, w, n) block as stored: predictor, byte order, compression."""
    if 0 in block.shape:
        raise RasterError("UnsupportedFeature", "a chunk without pixels")
    d, h, w, n = block.shape
    flat = predictors.apply(np.ascontiguousarray(block).reshape(d * h, w, n), predictor, float_predictor)
    if pixel_endian == "file" and not predictors.keeps_order(block.dtype, predictor, float_predictor):
        flat = flat.astype(flat.dtype.newbyteorder(order), copy=False)
    return codec_of(compression).compress(flat.tobytes())


def _compression(code: str | int) -> int:
    return COMPRESSION[code] if isinstance(code, str) else code


def encode_image(im: Image, order: str = "<") -> list[Chunk]:
    """All chunks of an image in index order: tiles padded by repeating the edge, the last strip cut to the image."""
    depth, height, width, n = im.pixels.shape
    if 0 in im.pixels.shape:
        raise RasterError("UnsupportedFeature", "an image without pixels")
    strips = im.rows_per_strip is not None
    td, th, tw = (1, min(im.rows_per_strip, height), width) if strips else im.tile
    if min(td, th, tw) <= 0:
        raise RasterError("InvalidFormat", "tile size is zero")
    if strips and depth > 1:
        raise RasterError("UnsupportedFeature", "volumes are stored in tiles")
    out = []
    for plane in range(n if im.planar else 1):
        source = im.pixels[..., plane : plane + 1] if im.planar else im.pixels
        for z in range(0, depth, td):
            for y in range(0, height, th):
                for x in range(0, width, tw):
                    rows = min(th, height - y) if strips else th
                    block = fetch_padded(source, z, y, x, td, rows, tw)
                    data = encode_chunk(block, _compression(im.compression), PREDICTOR[im.predictor], order, im.pixel_endian, im.float_predictor)
                    out.append(Chunk(len(out), x, y, z, plane, tw, rows, td, block.nbytes, data))
    return out


def place(chunks: list[Chunk], start: int, tile_order: str | Callable[[Chunk], object] = "image") -> tuple[list[int], bytes]:
    """(offsets by index, the data in write order). The order is a named policy or a sort key of chunks."""
    key = {"image": lambda c: (c.z, c.plane, c.y, c.x), "sequential": lambda c: c.idx, "on_demand": lambda c: 0}
    if not callable(tile_order) and tile_order not in key:
        raise ValueError(f"unknown tile order {tile_order}")
    offsets, parts, at = [0] * len(chunks), [], start
    for c in sorted(chunks, key=tile_order if callable(tile_order) else key[tile_order]):
        offsets[c.idx] = at
        parts.append(c.data)
        at += len(c.data)
    return offsets, b"".join(parts)


def mandatory_tags(im: Image, counts: list[int]) -> dict[str, object]:
    """Tags that follow from the image. The user's must agree with them where both speak."""
    depth, height, width, n = im.pixels.shape
    kind = {"u": "UnsignedInt", "i": "SignedInt", "f": "IEEEFloat"}.get(im.pixels.dtype.kind)
    if kind is None:
        raise RasterError("UnsupportedFeature", f"pixels of type {im.pixels.dtype}")
    tags: dict[str, object] = {
        "ImageWidth": width, "ImageLength": height, "BitsPerSample": [im.pixels.dtype.itemsize * 8] * n,
        "Compression": _compression(im.compression), "SamplesPerPixel": n, "PlanarConfiguration": 2 if im.planar else 1,
        "SampleFormat": SAMPLE_FORMAT[kind], "PhotometricInterpretation": PHOTOMETRIC["RGB" if n in (3, 4) else "MinIsBlack"],
    }
    if im.predictor != "None":
        tags["Predictor"] = PREDICTOR[im.predictor]
    if im.rows_per_strip is not None:
        tags |= {"RowsPerStrip": min(im.rows_per_strip, height), "StripOffsets": [0] * len(counts), "StripByteCounts": counts}
    else:
        tags |= {"TileWidth": im.tile[2], "TileLength": im.tile[1], "TileOffsets": [0] * len(counts), "TileByteCounts": counts}
        if depth > 1:
            tags |= {"ImageDepth": depth, "TileDepth": im.tile[0]}
    free = {"Compression", "PhotometricInterpretation"}
    for name, v in im.tags.items():
        if name in ("TileOffsets", "TileByteCounts", "StripOffsets", "StripByteCounts"):
            raise RasterError("InvalidTag", f"{name} can't be given")
        if name in tags and name not in free and (list(v) if isinstance(v, list | tuple) else v) != tags[name]:
            raise RasterError("InvalidTag", f"{name} is {v}, but the image has {tags[name]}")
        if name == "Predictor" and name not in tags and v not in (None, 1):
            raise RasterError("InvalidTag", f"Predictor is {v}, but none is used")
    return tags | im.tags


def write(images: Image | list[Image], *, order: str = "<", big: bool = False, ifd_placement: str = "beginning", tile_order: str | Callable[[Chunk], object] = "image", preset: str | None = None) -> bytes:
    """A whole file of one or several pages."""
    if preset:
        ifd_placement, tile_order = PRESETS[preset]["ifd_placement"], PRESETS[preset]["tile_order"]
    if ifd_placement not in ("beginning", "end", "inline"):
        raise ValueError(f"unknown directory placement {ifd_placement}")
    if order not in "<>":
        raise ValueError("byte order is < or >")
    at = 16 if big else 8
    out, first, patch = bytearray(header_bytes(0, order, big)), None, None
    for im in [images] if isinstance(images, Image) else images:
        chunks = encode_image(im, order)
        tags = mandatory_tags(im, [len(c.data) for c in chunks])
        builder = DirectoryBuilder(order, big).add_all(tags)
        name = "StripOffsets" if im.rows_per_strip is not None else "TileOffsets"
        start = at + builder.total_size if ifd_placement == "beginning" else at
        offsets, data = place(chunks, start, tile_order)
        builder.add_all({name: offsets})
        where = at if ifd_placement == "beginning" else start + len(data) + len(data) % 2
        ifd = builder.build(where)
        out += ifd + data if ifd_placement == "beginning" else data + b"\0" * (len(data) % 2) + ifd
        out += b"\0" * (len(out) % 2)
        at = len(out)
        if not big and at >= 1 << 32:
            raise RasterError("UnsupportedFeature", "over 4 GB needs 64-bit offsets")
        word = "Q" if big else "I"
        if first is None:
            first = where
        else:
            out[patch : patch + (8 if big else 4)] = struct.pack(order + word, where)
        patch = where + builder.ifd_size - (8 if big else 4)
    out[: 16 if big else 8] = header_bytes(first or 0, order, big)
    return bytes(out)
