"""Queries on files that are written first: the sink, the scans and the region reader, with their DuckDB equivalents.

The ``part`` table is an image 50 wide, of which two files are made, and ``nation`` gives one file per region with a page per
nation. Each query writes its files to a scratch folder, reads them through the data source and compares pixels or tags with
SQL on the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import binary, codecs
from ..functions.constants import PIXEL_TYPES, TAGS, RasterError, Tag
from ..operators import tags as tag_ops
from ..sources import datasource, parser, scan, writer
from ..streaming import ingest
from .queries import _ENTRIES, PART, QUERIES, WIDTH, _part, _read, query  # noqa: F401  queries register themselves in QUERIES

_DTYPE = {name: letter for name, _, _, letter in PIXEL_TYPES}
#: pixel type: (factor, modulus, divisor) of the values made for it
_RANGE = {"u8": (1, 251, 1), "u16": (257, 65521, 1), "u32": (65537, 4294967291, 1), "i16": (257, 32749, 1), "f32": (37, 65521, 4), "f64": (65537, 4294967291, 4)}


def _pixels_sql(kind: str, depth: int, samples: int) -> str:
    """(img, z, y, x, c, v): what ``_write`` stores, times the divisor."""
    factor, modulus, _ = _RANGE[kind]
    return f"SELECT img, z, y, x, c, ((v * (7 * c + 1) + 13 * z + 5 * img) * {factor}) % {modulus} AS v FROM ({PART}), range(2) AS a(img), range({depth}) AS b(z), range({samples}) AS d(c)"


def _write(spark: SparkSession, sf_dir: str, kind: str, depth: int, samples: int, options: dict[str, str]) -> str:
    """Two files through the sink; the folder they are in."""
    factor, modulus, divisor = _RANGE[kind]
    letter = _DTYPE[kind]

    def pack(key, rows):
        z, c = np.arange(depth)[:, None, None], np.arange(samples)[None, None, :]
        v = rows["v"].to_numpy(np.int64)[None, :, None]
        values = ((v * (7 * c + 1) + 13 * z + 5 * key[0]) * factor) % modulus / divisor
        height = int(rows["y"].max()) + 1
        pixels = np.zeros((depth, height, WIDTH, samples), letter)
        pixels[:, rows["y"], rows["x"]] = values.astype(letter)
        row = {"name": f"img-{key[0]}.tif", "depth": depth, "height": height, "width": WIDTH, "samples": samples, "pixel_type": kind, "data": pixels.astype("<" + letter).tobytes()}
        return pd.DataFrame([row])

    both = _part(spark, sf_dir).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("img"))
    rows = both.groupBy("img").applyInPandas(pack, "name string, depth int, height int, width int, samples int, pixel_type string, data binary")
    folder = datasource.scratch(spark)
    datasource.register(spark)
    rows.write.format("raster").options(**options).mode("append").save(folder)
    return folder


def _img(column: str = "path"):
    return F.regexp_extract(column, r"img-(\d+)\.tif$", 1).cast("long").alias("img")


def _unpack(regions: DataFrame, layout: str, divisor: int) -> DataFrame:
    """(img, z, y, x, c, v) of dense regions, as Arrow batches."""
    dtypes = dict(_DTYPE)
    places = {"DHWC": (0, 1, 2, 3), "DCHW": (0, 2, 3, 1), "CDHW": (1, 2, 3, 0)}[layout]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for img, kind, d, h, w, n, data in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                size = {"DHWC": (d, h, w, n), "DCHW": (d, n, h, w), "CDHW": (n, d, h, w)}[layout]
                at = np.indices(size).reshape(4, -1)
                v = np.rint(np.frombuffer(data, "<" + dtypes[kind]).astype(np.float64) * divisor).astype(np.int64)
                cols = [np.full(len(v), img), *(at[i].astype(np.int64) for i in places), v]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["img", "z", "y", "x", "c", "v"])

    chosen = regions.select(_img(), "pixel_type", "d", "h", "w", "n", "data")
    return chosen.mapInArrow(run, "img long, z long, y long, x long, c long, v long")


#: name: (pixel type, depth, samples, sink options, layout, region or None for the whole image)
_BOX = (10, 1, 0, 0, 33, 2, 1, 1)
READS = {
    "read_tiles_u8": ("u8", 1, 3, {"tile": "1,2,16"}, "DHWC", (10, 1, 0, 0, 33, 2, 1, 3)),
    "read_some_channels": ("u8", 1, 4, {"tile": "1,2,16"}, "DCHW", (10, 1, 0, 1, 33, 2, 1, 2)),
    "read_tiles_packbits": ("u16", 1, 1, {"tile": "1,3,32", "compression": "PackBits"}, "DCHW", _BOX),
    "read_whole_image": ("u16", 1, 3, {"tile": "1,16,16", "compression": "ZSTD"}, "DHWC", None),
    "read_planar_predictor": ("u16", 1, 4, {"tile": "1,2,16", "planar": "true", "compression": "ZSTD", "predictor": "Horizontal"}, "CDHW", (10, 1, 0, 1, 33, 2, 1, 3)),
    "read_strips": ("u8", 1, 3, {"rows_per_strip": "3"}, "CDHW", (10, 1, 0, 0, 33, 2, 1, 3)),
    "read_strips_planar": ("u16", 1, 2, {"rows_per_strip": "2", "planar": "true", "compression": "PackBits"}, "DHWC", (10, 1, 0, 0, 33, 2, 1, 2)),
    "read_signed_predictor": ("i16", 1, 2, {"tile": "1,2,16", "predictor": "Horizontal"}, "DHWC", (10, 1, 0, 0, 33, 2, 1, 2)),
    "read_float32_predictor": ("f32", 1, 2, {"tile": "1,2,16", "compression": "ZSTD", "predictor": "FloatingPoint"}, "DHWC", (10, 1, 0, 0, 33, 2, 1, 2)),
    "read_float64_predictor": ("f64", 1, 1, {"tile": "1,2,16", "predictor": "FloatingPoint"}, "DCHW", _BOX),
    "read_float32_planes": ("f32", 1, 2, {"tile": "1,2,16", "predictor": "FloatingPoint", "float_predictor": "adobe"}, "DHWC", (10, 1, 0, 0, 33, 2, 1, 2)),
    "read_big_endian": ("u16", 1, 1, {"tile": "1,2,16", "endian": "big", "compression": "ZSTD", "predictor": "Horizontal"}, "DHWC", _BOX),
    "read_big_endian_float": ("f64", 1, 1, {"rows_per_strip": "2", "endian": "big"}, "DHWC", _BOX),
    "read_big_format": ("u32", 1, 1, {"tile": "1,2,16", "endian": "big", "format": "BigTIFF", "compression": "ZSTD"}, "DHWC", _BOX),
    "read_volume": ("u16", 5, 2, {"tile": "2,2,16", "compression": "ZSTD", "predictor": "Horizontal"}, "DCHW", (10, 1, 1, 0, 33, 2, 3, 2)),
    "read_volume_planar": ("u8", 3, 2, {"tile": "2,4,32", "planar": "true"}, "CDHW", None),
    "read_tags_last": ("u8", 1, 1, {"tile": "1,2,16", "ifd_placement": "end", "tile_order": "sequential"}, "DHWC", _BOX),
    "read_preset_writing": ("u8", 1, 2, {"tile": "1,2,16", "preset": "writing"}, "DHWC", (10, 1, 0, 0, 33, 2, 1, 2)),
    "read_preset_streaming": ("u8", 1, 2, {"tile": "1,2,16", "preset": "streaming"}, "DHWC", (10, 1, 0, 0, 33, 2, 1, 2)),
    "read_preset_editing": ("u8", 1, 2, {"rows_per_strip": "2", "preset": "editing"}, "DHWC", (10, 1, 0, 0, 33, 2, 1, 2)),
}


def _reading(name: str) -> None:
    kind, depth, samples, options, layout, box = READS[name]
    where, start = "", (0, 0, 0, 0)
    if box:
        x, y, z, c, w, h, d, n = box
        start = (x, y, z, c)
        where = f"WHERE x BETWEEN {x} AND {x + w - 1} AND y BETWEEN {y} AND {y + h - 1} AND z BETWEEN {z} AND {z + d - 1} AND c BETWEEN {c} AND {c + n - 1}"
    sql = f"SELECT img, z - {start[2]} AS z, y - {start[1]} AS y, x - {start[0]} AS x, c - {start[3]} AS c, v FROM ({_pixels_sql(kind, depth, samples)}) {where}"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = _write(spark, sf_dir, kind, depth, samples, options)
        how = {k: v for k, v in options.items() if k == "float_predictor"}
        region = parser.Region(*box) if box else None
        return _unpack(datasource.read_region(spark, folder, region, layout=layout, **how), layout, _RANGE[kind][2])

    run.__name__ = name
    query(sql)(run)


for _name in READS:
    _reading(_name)


@query(f"SELECT img, y, x, c, v FROM ({_pixels_sql('u8', 1, 2)}) WHERE x < 20 AND y >= 1 AND c = 1")
def scan_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _write(spark, sf_dir, "u8", 1, 2, {"tile": "1,2,16", "compression": "PackBits"})
    p = datasource.read(spark, folder, "pixels", error_mode="FAILFAST").where("x < 20 and y >= 1 and plane = 1")
    return p.select(_img(), "y", "x", F.col("plane").cast("long").alias("c"), F.col("v").cast("long").alias("v"))


@query("SELECT img, 'big' AS endian, 'BigTIFF' AS format, 16 AS first_ifd FROM range(2) AS a(img)")
def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _write(spark, sf_dir, "u8", 1, 1, {"tile": "1,16,16", "endian": "big", "format": "BigTIFF"})
    return datasource.read(spark, folder, "files").select(_img(), "endian", "format", "first_ifd")


def _tile_rows(planes: int, tw: int, th: int) -> str:
    """Tiles of the two files: all numbers follow from the height of the part image."""
    return f"""WITH s AS (SELECT max(y) + 1 AS h, {-(-WIDTH // tw)} AS nx FROM ({PART})), g AS (SELECT *, (h + {th - 1}) // {th} AS ny FROM s)
SELECT img, (p * ny + ty) * nx + tx AS idx, tx * {tw} AS x, ty * {th} AS y, p AS plane, {tw * th} AS length FROM g, range(2) AS a(img), range({planes}) AS b(p), range(nx) AS c(tx), unnest(range(ny)) AS d(ty)"""


@query(_tile_rows(3, 16, 2))
def scan_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _write(spark, sf_dir, "u8", 1, 3, {"tile": "1,2,16", "planar": "true"})
    t = datasource.read(spark, folder, "tiles")
    return t.select(_img(), "idx", "x", "y", F.col("plane").cast("long").alias("plane"), "length")


@query(f"SELECT img, idx, (rank_ - 1) * 32 AS gap FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY idx) AS rank_ FROM ({_tile_rows(1, 16, 2)})) WHERE rank_ <= 3")
def first_tiles_in_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three tiles by place in the file, and how far each is from the first."""
    from pyspark.sql import Window

    folder = _write(spark, sf_dir, "u8", 1, 1, {"tile": "1,2,16"})
    w = Window.partitionBy("path").orderBy("offset")
    t = datasource.read(spark, folder, "tiles").withColumn("rank", F.row_number().over(w)).withColumn("gap", F.col("offset") - F.min("offset").over(w))
    return t.where("rank <= 3").select(_img(), "idx", "gap")


@query(f"SELECT img, y0 AS y, count(*)::BIGINT AS n, sum(v)::BIGINT AS total FROM (SELECT *, y // 3 * 3 AS y0 FROM ({_pixels_sql('u8', 1, 3)})) GROUP BY img, y0")
def scan_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole decoded strips; the last one is cut to the image."""
    folder = _write(spark, sf_dir, "u8", 1, 3, {"rows_per_strip": "3", "compression": "ZSTD"})
    b = datasource.read(spark, folder, "blocks", error_mode="FAILFAST")
    total = F.pandas_udf(lambda s: s.map(lambda d: int(np.frombuffer(d, np.uint8).sum())), "long")
    return b.select(_img(), "y", F.octet_length("data").cast("long").alias("n"), total("data").alias("total"))


@query(f"SELECT img, 50 AS width, h AS height, 3 AS samples, 'u16' AS pixel_type, 8 AS compression_is_none, false AS planar FROM (SELECT max(y) + 1 AS h FROM ({PART})), range(2) AS a(img)")
def scan_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _write(spark, sf_dir, "u16", 1, 3, {"tile": "1,16,16"})
    i = datasource.read(spark, folder, "images", spec="MinImage")
    return i.select(_img(), "width", "height", F.col("samples").cast("long").alias("samples"), "pixel_type", (F.col("Compression") * 8).cast("long").alias("compression_is_none"), "planar")


@query(f"""WITH s AS (SELECT (max(y) + 1) * 50 AS n FROM ({PART}))
SELECT placement, CASE WHEN placement = 'beginning' THEN 8 ELSE 8 + n + n % 2 END AS first_ifd FROM s, (VALUES ('beginning'), ('end'), ('inline')) AS t(placement)""")
def sink_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each policy puts the directory of an image without compression."""
    out = None
    for p in ("beginning", "end", "inline"):
        folder = _write(spark, sf_dir, "u8", 1, 1, {"rows_per_strip": "1", "ifd_placement": p})
        one = datasource.read(spark, folder, "files").where(_img() == 0).select(F.lit(p).alias("placement"), "first_ifd")
        out = one if out is None else out.unionByName(one)
    return out


# --- pages and tag values ------------------------------------------------------------------------------------------------
#: tags of one's own, one of each kind of value
_OWN = [
    Tag(65001, "OwnByte", "Byte", "list"), Tag(65002, "OwnShort", "Short", "list"), Tag(65003, "OwnLong", "Long", "list"), Tag(65004, "OwnSShort", "SShort", "list"),
    Tag(65005, "OwnSLong", "SLong", "list"), Tag(65006, "OwnDouble", "Double", "list"), Tag(65007, "OwnFloat", "Float", "list"), Tag(65008, "OwnRational", "Rational", "list"),
    Tag(65009, "OwnSRational", "SRational", "one"), Tag(65010, "OwnTexts", "Ascii", "texts"),
]
NATIONS = "SELECT n_regionkey AS region, n_nationkey AS k, n_name AS name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS page, count(*) OVER (PARTITION BY n_regionkey) AS pages FROM nation"


def _pages(spark: SparkSession, sf_dir: str, order: str = "<", big: bool = False) -> DataFrame:
    """(path, content): one file per region, one page per nation, with tags of many kinds."""
    own = list(_OWN)

    def pack(key, rows):
        rows = rows.sort_values("n_nationkey")
        images = []
        for i, r in enumerate(rows.itertuples()):
            k = int(r.n_nationkey)
            tags = {
                "PageNumber": [i, len(rows)], "XResolution": (k, k % 3 + 1), "OwnByte": bytes(range(k % 5 + 1)), "OwnShort": [k, 2 * k, 3 * k][: k % 3 + 1], "OwnLong": [k * 100_000] * 2, "OwnSShort": [-k, k],
                "OwnSLong": [-100_000 * k], "OwnDouble": [k / 4, -k / 8], "OwnFloat": [k / 2], "OwnRational": [(k, 4), (3, 4)], "OwnSRational": (-k, 2), "OwnTexts": [r.n_name, "", f"n{k}"],
            }
            if k % 2 == 0:
                tags["Artist"] = r.n_name
            images.append(writer.Image(np.full((1, 2, k + 1, 1), k, np.uint8), rows_per_strip=2, tags=tags))
        for t in own:
            TAGS[t.name] = t
        return pd.DataFrame({"path": [f"img-{key[0]}.tif"], "content": [writer.write(images, order=order, big=big)]})

    return _read(spark, sf_dir, "nation").groupBy("n_regionkey").applyInPandas(pack, "path string, content binary")


@query(f"SELECT region AS img, page, k + 1 AS width, page AS number, pages, CASE WHEN k % 2 = 0 THEN name END AS artist FROM ({NATIONS})")
def page_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of every file, with an optional tag that half of them lack."""
    i = scan.scan_binary(_pages(spark, sf_dir), "images", spec="ImageWidth,ImageLength,BitsPerSample,PageNumber,Artist?")
    n = F.col("PageNumber")
    return i.select(_img(), F.col("page").cast("long").alias("page"), "width", F.get(n, F.lit(0)).cast("long").alias("number"), F.get(n, F.lit(1)).cast("long").alias("pages"), F.col("Artist").alias("artist"))


@query(f"SELECT region AS img, page, k + 1 AS width FROM ({NATIONS}) WHERE page IN (1, 3)")
def page_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = scan.scan_binary(_pages(spark, sf_dir, ">", True), "images", spec="ImageWidth,ImageLength,BitsPerSample", pages="1,3")
    return i.select(_img(), F.col("page").cast("long").alias("page"), "width")


@query(f"SELECT region AS img, page, CASE WHEN k % 2 = 0 THEN name END AS artist, CASE WHEN k % 2 = 1 THEN 'InvalidTag' END AS error_code FROM ({NATIONS})")
def strict_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A required tag that half of the pages lack is an error of those pages alone."""
    i = scan.scan_binary(_pages(spark, sf_dir), "images", spec="ImageWidth,ImageLength,BitsPerSample,Artist")
    return i.select(_img(), F.col("page").cast("long").alias("page"), F.col("Artist").alias("artist"), "error_code")


@query(f"""SELECT region AS img, page, code, values FROM ({NATIONS}), (VALUES (65001), (65002), (65003), (65004), (65005), (65006), (65007), (65008), (65009), (282), (297)) AS t(code), (SELECT 0) AS z(o),
LATERAL (SELECT array_to_string(CASE code WHEN 65001 THEN range(k % 5 + 1)::DOUBLE[] WHEN 65002 THEN [k, 2 * k, 3 * k][1:k % 3 + 1]::DOUBLE[] WHEN 65003 THEN [k * 100000, k * 100000]::DOUBLE[] WHEN 65004 THEN [-k, k]::DOUBLE[]
  WHEN 65005 THEN [-100000 * k]::DOUBLE[] WHEN 65006 THEN [k / 4, -k / 8]::DOUBLE[] WHEN 65007 THEN [k / 2]::DOUBLE[] WHEN 65008 THEN [k / 4, 0.75]::DOUBLE[] WHEN 65009 THEN [-k / 2]::DOUBLE[] WHEN 282 THEN [k / (k % 3 + 1)]::DOUBLE[]
  ELSE [page, pages]::DOUBLE[] END.list_transform(lambda v: round(v * 1000)::BIGINT::VARCHAR), ' ') AS values)""")
def tag_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric tags of every kind, inline and outside, in thousandths."""
    t = scan.scan_binary(_pages(spark, sf_dir, ">"), "tags").where("code in (282, 297) or code between 65001 and 65009")
    text = F.array_join(F.transform("numbers", lambda v: F.round(v * 1000).cast("long").cast("string")), " ")
    return t.select(_img(), F.col("page").cast("long").alias("page"), "code", text.alias("values"))


@query(f"SELECT region AS img, page, name || '|' || '|n' || k AS parts, k / 4.0::DOUBLE AS first FROM ({NATIONS})")
def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by declared type: several strings in one tag, and rationals as pairs."""
    own = {t.name: t for t in _OWN}
    o = scan.Options.parse({"mode": "images"})
    spec = [TAGS["ImageWidth"], TAGS["ImageLength"], TAGS["BitsPerSample"], own["OwnRational"], own["OwnTexts"]]
    o.spec = spec
    names, schema = scan.schema_of(o).names, scan.schema_of(o)
    rows_of, source = scan.rows, parser.BufferSource

    def run(batches):
        for b in batches:
            for p, c in zip(b["path"], b["content"], strict=True):
                yield pd.DataFrame({n: pd.Series(list(col), dtype="object") for n, col in zip(names, zip(*rows_of(source(c), p, o), strict=True), strict=True)})

    i = _pages(spark, sf_dir).mapInPandas(run, schema)
    first = binary.rational_to_double(F.get("OwnRational", F.lit(0)))
    return i.select(_img(), F.col("page").cast("long").alias("page"), F.array_join("OwnTexts", "|").alias("parts"), first.alias("first"))


@query(f"SELECT region AS img, page, page > 0 AS has_parent_page, page + 1 < pages AS has_next FROM ({NATIONS})")
def scan_ifds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directory headers along the chain."""
    from pyspark.sql import Window

    d = scan.scan_binary(_pages(spark, sf_dir), "ifds")
    w = Window.partitionBy("path").orderBy("page")
    linked = F.lag("next_ifd").over(w) == F.col("offset")
    return d.select(_img(), F.col("page").cast("long").alias("page"), F.coalesce(linked, F.lit(False)).alias("has_parent_page"), (F.col("next_ifd") > 0).alias("has_next"))


_CASES = {  # user tags against what the image says: (tags, expected error code)
    "equal width": ({"ImageWidth": 4}, None),
    "other width": ({"ImageWidth": 5}, "InvalidTag"),
    "equal bits": ({"BitsPerSample": [8, 8, 8]}, None),
    "other bits": ({"BitsPerSample": [16, 16, 16]}, "InvalidTag"),
    "offsets": ({"TileOffsets": [8]}, "InvalidTag"),
    "byte counts": ({"TileByteCounts": [8]}, "InvalidTag"),
    "compression": ({"Compression": 1}, None),
    "photometric": ({"PhotometricInterpretation": 6}, None),
    "predictor none": ({"Predictor": 1}, None),
    "predictor unused": ({"Predictor": 2}, "InvalidTag"),
    "own tag": ({"Software": "me"}, None),
    "planar": ({"PlanarConfiguration": 2}, "InvalidTag"),
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', " + (f"'{e}'" if e else "NULL") + ")" for k, (_, e) in _CASES.items()) + ") AS t(case_name, error_code)")
def mandatory_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the writer says about tags that a user gives for a 4 x 4 image of three samples."""
    cases = {k: t for k, (t, _) in _CASES.items()}

    def run(batches):
        for b in batches:
            codes = []
            for name in b["case_name"]:
                try:
                    writer.write(writer.Image(np.zeros((1, 4, 4, 3), np.uint8), (1, 16, 16), tags=cases[name]))
                    codes.append(None)
                except RasterError as e:
                    codes.append(e.code)
            yield pd.DataFrame({"case_name": b["case_name"], "error_code": pd.Series(codes, dtype="object")})

    return spark.createDataFrame([(k,) for k in cases], "case_name string").mapInPandas(run, "case_name string, error_code string")


@query("SELECT * FROM (VALUES ('all optional', NULL), ('one required', 'InvalidTag')) AS t(spec, error_code)")
def empty_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory without entries satisfies a schema of optional tags alone."""
    specs = {"all optional": [TAGS["Artist"]], "one required": [TAGS["ImageWidth"]]}

    def run(batches):
        from dataclasses import replace

        for b in batches:
            codes = []
            for name in b["spec"]:
                spec = [replace(t, optional=name == "all optional") for t in specs[name]]
                data = writer.header_bytes(8) + writer.DirectoryBuilder().build(8)
                src = parser.BufferSource(data)
                h = parser.header(src)
                try:
                    parser.extract(src, h, parser.directory(src, h, h.first).entries, spec)
                    codes.append(None)
                except RasterError as e:
                    codes.append(e.code)
            yield pd.DataFrame({"spec": b["spec"], "error_code": pd.Series(codes, dtype="object")})

    return spark.createDataFrame([(k,) for k in specs], "spec string").mapInPandas(run, "spec string, error_code string")


@query(f"SELECT ifd, array_to_string(list_sort(list(code)), ' ') AS codes, coalesce(bool_and(code >= before), true) AS was_sorted FROM (SELECT *, lag(code) OVER (PARTITION BY ifd ORDER BY pos) AS before FROM ({_ENTRIES})) GROUP BY ifd")
def sort_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, c = _read(spark, sf_dir, "documents"), F.col("doc_id")
    codes = F.array(*[F.lit(x) for x in (256, 257, 258, 259, 277, 300)])
    pos = F.floor(c / 50)
    entries = d.select((c % 50).alias("ifd"), F.struct(pos.alias("pos"), F.get(codes, ((c * 7 + pos) % 6).cast("int")).alias("code")).alias("x"))
    listed = entries.groupBy("ifd").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["code"]).alias("found"))
    return listed.select("ifd", F.array_join(tag_ops.sort_entries(F.col("found")), " ").alias("codes"), tag_ops.is_sorted(F.col("found")).alias("was_sorted"))


@query("SELECT doc_id, octet_length(encode(text)) + 1 AS text_bytes, 2 * (doc_id % 7) AS short_bytes, 8 * (doc_id % 7) AS double_bytes FROM documents WHERE text IS NOT NULL")
def written_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("doc_id") % 7).cast("int")
    d = _read(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", F.array_repeat(F.lit(0), n).alias("numbers"))
    size = lambda kind, c: binary.written_size(kind, F.col(c)).cast("long")
    return d.select("doc_id", size("Ascii", "text").alias("text_bytes"), size("Short", "numbers").alias("short_bytes"), size("Double", "numbers").alias("double_bytes"))


_XOR = 60_001


def _own_codec() -> codecs.Codec:
    flip = lambda data: bytes(b ^ 0x5A for b in data)
    return codecs.Codec((_XOR,), flip, lambda data, room: flip(data))


@query("SELECT n_nationkey, sha256(n_name) AS digest, sha256(n_name) AS plain, 'InvalidOperation' AS again FROM nation")
def own_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A codec of one's own and the one that copies, both run by executors; a code can have one codec only."""
    if _XOR not in codecs.codec_registry():
        codecs.register_codec(_own_codec())
    try:
        codecs.register_codec(_own_codec())
        again = None
    except ValueError:
        again = "InvalidOperation"
    raw = F.col("n_name").cast("binary")
    n = _read(spark, sf_dir, "nation").select("n_nationkey", codecs.compress(raw, _XOR).alias("z"), codecs.compress(raw, 1).alias("p"))
    back = n.select("n_nationkey", codecs.decompress(F.col("z"), F.octet_length("z"), _XOR).alias("z"), codecs.decompress(F.col("p"), F.octet_length("p"), 1).alias("p"))
    return back.select("n_nationkey", F.sha2("z", 256).alias("digest"), F.sha2("p", 256).alias("plain"), F.lit(again).alias("again"))


@query(f"SELECT img, 50 AS width, h AS height FROM (SELECT max(y) + 1 AS h FROM ({PART})), range(2) AS a(img)")
def stream_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that arrive in a folder, as a stream that takes what is there and stops."""
    folder = _write(spark, sf_dir, "u8", 1, 1, {"tile": "1,16,16"})
    out = datasource.scratch(spark)
    ingest.run_once(ingest.stream_files(spark, folder, "images", spec="MinImage"), f"{out}/rows", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/rows").select(_img(), "width", "height")


