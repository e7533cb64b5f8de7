"""Spark data source "raster": ``spark.read.format("raster").option("mode", ...).load(path)`` and a sink.

Reading: modes files, ifds, tags, images, tiles, blocks and pixels. Filters on page, plane, idx, code, x, y and z are taken
over where the session allows it (``spark.sql.python.filterPushdown.enabled``) and prune directories and tiles before they
are read. Large files are read in stretches of tiles by several tasks. Writing: rows of (name, depth, height, width, samples,
pixel_type, data) become one file each.
"""

from __future__ import annotations

import glob
import operator
import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from ..functions.constants import PIXEL_TYPES
from . import parser, scan, writer

SPLIT_BYTES = 64 << 20
_OPS = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}
_PUSHED = {"ifds": {"page"}, "tags": {"page", "code"}, "images": {"page"}, "tiles": {"page", "plane", "idx", "x", "y", "z"}, "blocks": {"page", "plane", "idx", "x", "y", "z"}, "pixels": {"page", "plane", "x", "y", "z"}}


def list_files(path: str) -> list[tuple[str, int]]:
    """(path, size) of .tif and .tiff files (any case) below a folder, of a glob pattern, or of one file; sorted."""
    local = path.removeprefix("file://").removeprefix("file:")
    if "://" in local:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(local)
        scheme = local.split("://")[0]
        info = store.get_file_info(root)
        found = store.get_file_info(fs.FileSelector(root, recursive=True)) if info.type == fs.FileType.Directory else [info]
        return sorted((f"{scheme}://{f.path}", f.size) for f in found if f.is_file and f.path.lower().endswith((".tif", ".tiff")))
    if os.path.isdir(local):
        names = [os.path.join(d, f) for d, _, files in os.walk(local) for f in files if f.lower().endswith((".tif", ".tiff"))]
    else:
        names = glob.glob(local) or [local]
    return sorted((n, os.path.getsize(n) if os.path.exists(n) else 0) for n in names)


def folder_of(path: str):
    """(file system, path in it) of a folder in any store that pyarrow knows."""
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:"))


def scratch(spark: SparkSession) -> str:
    """A fresh folder below the one the cluster shares (``spark.checkpoint.dir``); a local one only where none is set, as in tests."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir() or tempfile.mkdtemp(prefix="gridloom-")
    return f"{base.rstrip('/')}/gridloom-{uuid.uuid4().hex}"


@dataclass
class Stretch(InputPartition):
    files: list[tuple[str, tuple[int, int]]]


@dataclass
class Pushed:
    """Filters that the scan applies exactly, by column."""

    tests: list[tuple[str, str, object]]

    def __call__(self, column: str, value: object) -> bool:
        ops = {"eq": operator.eq, "gt": operator.gt, "ge": operator.ge, "lt": operator.lt, "le": operator.le, "in": lambda a, b: a in b}
        return all(ops[op](value, want) for c, op, want in self.tests if c == column)


class RasterReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.o, self.tests = options, scan.Options.parse(options), []
        self.split = int({k.lower(): v for k, v in options.items()}.get("split_bytes", SPLIT_BYTES))

    def partitions(self) -> list[Stretch]:
        path = {k.lower(): v for k, v in self.options.items()}.get("path")
        if not path:
            raise ValueError("load() needs a path")
        out, held, size = [], [], 0
        for name, n in list_files(path):
            if self.o.mode in ("tiles", "blocks", "pixels") and n > self.split:
                parts = -(-n // self.split)
                out += [Stretch([(name, (k, parts))]) for k in range(parts)]
                continue
            held.append((name, (0, 1)))
            size += n if self.o.mode in ("blocks", "pixels") else min(n, 1 << 20)
            if size >= self.split:
                out.append(Stretch(held))
                held, size = [], 0
        return out + ([Stretch(held)] if held else []) or [Stretch([])]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        keep = Pushed(self.tests)
        for name, part in partition.files:
            try:
                src = parser.open_source(name)
            except parser.RasterError as e:
                yield from scan._failed(self.o, name, None, e)
                continue
            try:
                yield from scan.rows(src, name, self.o, keep, part)
            finally:
                src.close()


class PushingReader(RasterReader):
    """Takes over filters; what it can't test on every row stays in the plan too."""

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            # mode images exposes file columns too; only columns whose rows are all tested here may leave the plan
            if column in _PUSHED.get(self.o.mode, ()) and type(f) in _OPS and self.o.error_mode == "FAILFAST":
                self.tests.append((column, _OPS[type(f)].__name__, f.value))
            elif column in _PUSHED.get(self.o.mode, ()) and isinstance(f, In) and self.o.error_mode == "FAILFAST":
                self.tests.append((column, "in", tuple(f.value)))
            else:
                if column in _PUSHED.get(self.o.mode, ()) and type(f) in _OPS:  # error rows have nulls, which Spark drops
                    self.tests.append((column, _OPS[type(f)].__name__, f.value))
                yield f


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class RasterWriter(DataSourceWriter):
    """One file per row, in any store. A file appears under its name only when it is complete."""

    def __init__(self, options: dict[str, str]) -> None:
        self.o = {k.lower(): v for k, v in options.items()}

    def write(self, iterator: Iterator) -> Written:
        store, root = folder_of(self.o["path"])
        store.create_dir(root, recursive=True)
        done = []
        for row in iterator:
            target = f"{root}/{row['name']}"
            part = f"{target}.{uuid.uuid4().hex}.part"  # of this attempt alone
            with store.open_output_stream(part) as f:
                f.write(encode_row(row.asDict(), self.o))
            store.move(part, target)
            done.append(target)
        return Written(done)

    def commit(self, messages: list) -> None:
        pass

    def abort(self, messages: list) -> None:
        store, _ = folder_of(self.o["path"])
        for m in messages:
            for f in m.files if m else ():
                try:
                    store.delete_file(f)
                except FileNotFoundError:
                    continue


_DTYPES = {name: letter for name, _, _, letter in PIXEL_TYPES}


def encode_row(row: dict, o: dict[str, str]) -> bytes:
    """A file from a row of dense DHWC pixels (little endian) and sink options."""
    shape = (row["depth"], row["height"], row["width"], row["samples"])
    pixels = np.frombuffer(row["data"], "<" + _DTYPES[row["pixel_type"]]).astype(_DTYPES[row["pixel_type"]]).reshape(shape)
    tile = tuple(int(x) for x in o.get("tile", "1,128,128").split(","))
    im = writer.Image(
        pixels, tile, int(o["rows_per_strip"]) if "rows_per_strip" in o else None, o.get("planar", "false") == "true",
        o.get("compression", "None"), o.get("predictor", "None"), {}, o.get("pixel_endian", "file"), o.get("float_predictor", "bitdelta"),
    )
    return writer.write(im, order=">" if o.get("endian") == "big" else "<", big=o.get("format") == "BigTIFF", ifd_placement=o.get("ifd_placement", "beginning"), tile_order=o.get("tile_order", "image"), preset=o.get("preset"))


class RasterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> T.StructType:
        return scan.schema_of(scan.Options.parse(self.options))

    def reader(self, schema: T.StructType) -> RasterReader:
        plain = {k.lower(): v for k, v in self.options.items()}.get("pushdown") == "false"
        return (RasterReader if plain else PushingReader)(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> RasterWriter:
        return RasterWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the source known to a session; it needs filter pushdown, unless read with option pushdown=false."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RasterSource)


def read(spark: SparkSession, path: str, mode: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("raster").options(mode=mode, **options).load(path)


def read_region(spark: SparkSession, path: str, region: parser.Region | None = None, *, page: int = 0, layout: str = "DHWC", fill: int = 0, **options: str) -> DataFrame:
    """(path, page, pixel_type, d, h, w, n, data): each image's region as one dense array in the given layout.

    Only overlapping tiles are read, close ones in one read, by as many tasks as the files' sizes call for; a region's
    blocks then meet in one task, as its result is one value.
    """
    r = region or parser.Region()
    text = ",".join("" if v is None else str(v) for v in (r.x, r.y, r.z, r.c, r.w, r.h, r.d, r.n))
    full = all(v is not None for v in (r.w, r.h, r.d, r.n))
    opts = {"pages": str(page), "error_mode": "FAILFAST", **({"region": text} if full else {}), **options}
    register(spark)
    shapes = read(spark, path, "images", **{k: v for k, v in opts.items() if k != "region"}).select("path", "width", "height", "depth", "samples", "bits", "sample_format", "planar")
    blocks = read(spark, path, "blocks", **opts)

    def gather(key, images, parts):
        i = images.iloc[0]
        s = parser.Shape(int(i["width"]), int(i["height"]), int(i["depth"]), int(i["samples"]), int(i["bits"]), int(i["sample_format"]), bool(i["planar"]))
        got = []
        for b in parts.itertuples():
            t = parser.Tile(int(b.idx), int(b.x), int(b.y), int(b.z), int(b.plane), int(b.w), int(b.h), int(b.d), int(b.n), 0, 1)
            got.append((t, np.frombuffer(b.data, s.dtype.newbyteorder("<")).astype(s.dtype).reshape(t.d, t.h, t.w, t.n)))
        out = parser.assemble(s, r, got, layout, fill)
        box = r.within(s)
        kind = next(n for n, bits, f, _ in PIXEL_TYPES if (bits, f) == (s.bits, s.format))
        return pd.DataFrame({"path": [key[0]], "page": [page], "pixel_type": [kind], "d": [box.d], "h": [box.h], "w": [box.w], "n": [box.n], "data": [out.astype(out.dtype.newbyteorder("<")).tobytes()]})

    schema = "path string, page int, pixel_type string, d long, h long, w long, n long, data binary"
    return shapes.groupBy("path").cogroup(blocks.groupBy("path")).applyInPandas(gather, schema)


def encode_tiles(blocks: DataFrame, compression: str = "None", predictor: str = "None", endian: str = "little") -> DataFrame:
    """Blocks (w, h, d, n, pixel_type, data) with ``encoded`` and ``enc_size``: chunks of large images in parallel."""
    code, pred, order = writer._compression(compression), writer.PREDICTOR[predictor], ">" if endian == "big" else "<"
    encode, dtypes = writer.encode_chunk, dict(_DTYPES)

    @F.pandas_udf("binary")
    def run(w: pd.Series, h: pd.Series, d: pd.Series, n: pd.Series, kind: pd.Series, data: pd.Series) -> pd.Series:
        out = []
        for row in zip(w, h, d, n, kind, data, strict=True):
            block = np.frombuffer(row[5], "<" + dtypes[row[4]]).astype(dtypes[row[4]]).reshape(row[2], row[1], row[0], row[3])
            out.append(encode(block, code, pred, order))
        return pd.Series(out)

    done = blocks.withColumn("encoded", run("w", "h", "d", "n", "pixel_type", "data"))
    return done.withColumn("enc_size", F.octet_length("encoded").cast("long"))
