"""From files to relations: row producers for each mode, shared by the data source and by scans of BINARY columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.constants import SPECS, TAGS, RasterError, Tag, spec_schema, tag_list
from . import parser

_S, _L, _I = T.StringType(), T.LongType(), T.IntegerType()


def _fields(text: str) -> list[T.StructField]:
    kinds = {"s": _S, "l": _L, "i": _I, "b": T.BooleanType(), "x": T.BinaryType(), "d": T.DoubleType(), "a": T.ArrayType(T.DoubleType())}
    return [T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in text.split())]


FILES = _fields("path:s length:l endian:s format:s first_ifd:l error_code:s")
IFDS = _fields("path:s page:i parent_offset:l offset:l n_tags:i next_ifd:l error_code:s")
ENTRIES = _fields("path:s page:i ifd_offset:l pos:i code:i name:s dtype:i count:l is_inline:b value_offset:l raw:x numbers:a text:s error_code:s")
SHAPE = _fields("width:l height:l depth:l samples:i bits:i sample_format:i planar:b pixel_type:s error_code:s")
TILES = _fields("path:s page:i idx:l x:l y:l z:l plane:i w:l h:l d:l n:i offset:l length:l compression:i predictor:i endian:s pixel_type:s error_code:s")
BLOCKS = [*TILES[:-1], *_fields("data:x error_code:s")]
PIXELS = _fields("path:s page:i plane:i z:l y:l x:l v:d")
MODES = ("files", "ifds", "tags", "images", "tiles", "blocks", "pixels")


@dataclass
class Options:
    """How to scan. ``error_mode``: PERMISSIVE gives error rows, FAILFAST raises."""

    mode: str = "tags"
    spec: list[Tag] = field(default_factory=lambda: SPECS["MinBigImage"])  # takes 32-bit offsets too
    pages: set[int] | None = None
    sub_ifds: bool = False
    region: parser.Region | None = None
    error_mode: str = "PERMISSIVE"
    pixel_endian: str = "file"
    float_predictor: str = "bitdelta"
    assume_sorted: bool = False
    codes: set[int] | None = None

    @classmethod
    def parse(cls, options: dict[str, str]) -> Options:
        o = {k.lower(): v for k, v in options.items()}
        out = cls(mode=o.get("mode", "tags").lower(), error_mode=o.get("error_mode", "PERMISSIVE").upper())
        if out.mode not in MODES:
            raise ValueError(f"mode is one of {', '.join(MODES)}")
        if "spec" in o:
            out.spec = SPECS[o["spec"]] if o["spec"] in SPECS else tag_list(o["spec"].replace(",", " "))
        if "pages" in o:
            out.pages = {int(p) for p in o["pages"].split(",")}
        if "codes" in o:
            out.codes = {int(p) for p in o["codes"].split(",")}
        if "region" in o:  # x,y,w,h or x,y,z,c,w,h,d,n
            r = [int(v) for v in o["region"].split(",")]
            out.region = parser.Region(r[0], r[1], 0, 0, r[2], r[3]) if len(r) == 4 else parser.Region(*r)
        flag = lambda k: o.get(k, "false").lower() == "true"
        out.sub_ifds, out.assume_sorted = flag("sub_ifds"), flag("assume_sorted")
        out.pixel_endian, out.float_predictor = o.get("pixel_endian", "file"), o.get("float_predictor", "bitdelta")
        return out


def schema_of(o: Options) -> T.StructType:
    fixed = {"files": FILES, "ifds": IFDS, "tags": ENTRIES, "tiles": TILES, "blocks": BLOCKS, "pixels": PIXELS}
    if o.mode in fixed:
        return T.StructType(fixed[o.mode])
    return T.StructType([*_fields("path:s page:i ifd_offset:l parent_offset:l"), *spec_schema(o.spec), *SHAPE])


_NAMES = {t.code: t.name for t in reversed(list(TAGS.values()))}
_ANY = Tag(0, "any", "Ascii", "text")


def rows(src: parser.BufferSource, path: str, o: Options, keep: Callable[[str, object], bool] | None = None, part: tuple[int, int] = (0, 1)) -> Iterator[tuple]:
    """Rows of one file. ``keep(column, value)`` prunes pages and tiles before they are read; ``part`` = (k, n) reads the
    k-th of n stretches of each page's tiles."""
    ok = keep or (lambda column, value: True)
    try:
        h = parser.header(src)
    except RasterError as e:
        yield from _failed(o, path, None, e, src.size)
        return
    endian = "little" if h.order == "<" else "big"
    if o.mode == "files":
        yield path, src.size, endian, "BigTIFF" if h.big else "classic", h.first, None
        return
    for d in parser.pages(src, h, o.pages, o.sub_ifds):
        if isinstance(d, RasterError):
            yield from _failed(o, path, None, d)
        elif ok("page", d.page):
            yield from _of_directory(src, path, o, h, d, endian, ok, part)


def _failed(o: Options, path: str, page: int | None, e: RasterError, size: int | None = None) -> Iterator[tuple]:
    if o.error_mode == "FAILFAST":
        raise e
    names = schema_of(o).names
    if "error_code" in names:
        known = {"path": path, "page": page, "length": size if o.mode == "files" else None, "error_code": e.code}
        yield tuple(known.get(n) for n in names)


def _of_directory(src, path: str, o: Options, h: parser.Header, d: parser.Directory, endian: str, ok, part: tuple[int, int]) -> Iterator[tuple]:
    if o.mode == "ifds":
        yield path, d.page, d.parent, d.offset, len(d.entries), d.next, None
        return
    if o.mode == "tags":
        for e in d.entries:
            if (o.codes is None or e.code in o.codes) and ok("code", e.code):
                yield _entry(src, path, o, h, d, e)
        return
    try:
        v = parser.extract(src, h, d.entries, o.spec, o.assume_sorted)
        s = parser.shape(v)
        kind = f"{s.dtype.kind}{s.dtype.itemsize * 8}"
        if o.mode == "images":
            values = [_spark(v[t.name]) for t in o.spec]
            yield (path, d.page, d.offset, d.parent, *values, s.width, s.height, s.depth, s.samples, s.bits, s.format, s.planar, kind, None)
            return
        todo = parser.tiles(v, s, o.region)
        at, n = part
        todo = todo[len(todo) * at // n : len(todo) * (at + 1) // n]
        overlap = o.mode == "pixels"
        wanted = lambda t: all(ok(c, getattr(t, c)) for c in (("plane",) if overlap and s.planar else ()) or (() if overlap else ("idx", "x", "y", "z", "plane")))
        about = lambda t: (path, d.page, *asdict(t).values(), v.get("Compression") or 1, v.get("Predictor") or 1, endian, kind)
        if o.mode == "tiles":
            yield from ((*about(t), None) for t in todo if wanted(t))
            return
        chosen = {t.idx for t in todo if wanted(t)}
        how = {"pixel_endian": o.pixel_endian, "float_predictor": o.float_predictor}
        for t, block in parser.blocks(src, h, v, o.region, lambda t: t.idx in chosen, **how):
            if o.mode == "blocks":
                yield (*about(t), block.astype(block.dtype.newbyteorder("<"), copy=False).tobytes(), None)
            else:
                yield from _pixels(path, d.page, s, t, block, o.region, ok)
    except RasterError as e:
        yield from _failed(o, path, d.page, e)


def _pixels(path: str, page: int, s: parser.Shape, t: parser.Tile, block: np.ndarray, region: parser.Region | None, ok) -> Iterator[tuple]:
    r = (region or parser.Region()).within(s)
    planes = [t.plane] if s.planar else range(r.c, r.c + r.n)
    for p in planes:
        if not ok("plane", p):
            continue
        for z in range(max(t.z, r.z), min(t.z + t.d, r.z + r.d)):
            if not ok("z", z):
                continue
            for y in range(max(t.y, r.y), min(t.y + t.h, r.y + r.h)):
                if ok("y", y):
                    line = block[z - t.z, y - t.y, :, 0 if s.planar else p].tolist()
                    for x in range(max(t.x, r.x), min(t.x + t.w, r.x + r.w)):
                        if ok("x", x):
                            yield path, page, p, z, y, x, float(line[x - t.x])


def _spark(v):
    if isinstance(v, tuple):
        return {"num": v[0], "den": v[1]}
    if isinstance(v, list):
        return [_spark(x) for x in v]
    return v


def _entry(src, path: str, o: Options, h: parser.Header, d: parser.Directory, e: parser.Entry) -> tuple:
    nums = text = error = None
    try:
        if e.dtype == 2:
            text = parser.value(src, h, e, _ANY)
        elif e.dtype in (5, 10):
            nums = [a / b if b else float("nan") for a, b in parser.numbers(src, h, e)]
        elif e.dtype in parser.TYPE_SIZE:
            nums = [float(x) for x in parser.numbers(src, h, e)]
    except RasterError as x:
        if o.error_mode == "FAILFAST":
            raise
        error = x.code
    return path, d.page, d.offset, e.pos, e.code, _NAMES.get(e.code), e.dtype, e.count, e.inline, e.offset, e.raw, nums, text, error


def scan_binary(files: DataFrame, mode: str, *, path: str = "path", content: str = "content", **options: str) -> DataFrame:
    """Relations from a DataFrame with file contents, such as ``spark.read.format("binaryFile")``, also a streaming one."""
    o = Options.parse({"mode": mode, **options})
    schema = schema_of(o)
    names = schema.names

    def run(batches):
        import pandas as pd

        for b in batches:
            for p, c in zip(b[path], b[content], strict=True):
                if c is not None:
                    found = list(rows(parser.BufferSource(c), p, o))
                    if found:
                        yield pd.DataFrame({n: pd.Series(list(col), dtype="object") for n, col in zip(names, zip(*found, strict=True), strict=True)})

    return files.select(path, content).mapInPandas(run, schema)
