"""Queries on relational rasters, one for each operator that SQL can check, with their DuckDB equivalents.

The driver's tables serve as rasters: ``part`` as an image 50 wide, ``embeddings`` as rows of 64 or tiles, ``documents`` as
byte spans. Each query is (function, SQL); without SQL the query is checked by tests.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import binary, codecs, predictors, results
from ..functions.constants import COMPRESSION, PHOTOMETRIC, PLANAR, PREDICTOR, SAMPLE_FORMAT, SPECS, TAGS, enum_names, tag_names
from ..operators import grid, layout, spans, tags

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WIDTH = 50


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part raster: x, y and an 8-bit value."""
    key = F.col("p_partkey")
    return _read(spark, sf_dir, "part").select((key % WIDTH).alias("x"), F.floor(key / WIDTH).alias("y"), F.col("p_size").cast("long").alias("v"))


PART = f"SELECT p_partkey % {WIDTH} AS x, p_partkey // {WIDTH} AS y, p_size::BIGINT AS v FROM part"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 16-bit pixels: y is the vector, x the position."""
    e = _read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "e"))
    return e.select(F.col("vec_id").alias("y"), "x", F.pmod(F.floor(F.col("e").cast("double") * 1000).cast("long"), F.lit(65536).cast("long")).alias("v"))


VECTORS = "SELECT vec_id AS y, (i - 1)::BIGINT AS x, ((floor(embedding[i]::DOUBLE * 1000)::BIGINT % 65536) + 65536) % 65536 AS v FROM embeddings, unnest(range(1, 65)) AS t(i)"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as byte spans of 16 files; 2500 bytes stay free before every seventh, which leaves gaps."""
    free = F.when(F.col("doc_id") % 7 == 0, 2500).otherwise(0)
    d = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 16).alias("file"), F.col("n_chars").alias("length"), free.alias("free"))
    at = spans.offsets(F.col("length") + F.col("free"), ["id"], ["file"], 8)
    return d.withColumn("offset", at + F.col("free")).drop("free")


SPANS = """SELECT id, file, length, (8 + free + coalesce(sum(length + free) OVER (PARTITION BY file ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset"
FROM (SELECT doc_id AS id, doc_id % 16 AS file, n_chars AS length, CASE WHEN doc_id % 7 = 0 THEN 2500 ELSE 0 END AS free FROM documents)"""


def _image(spark: SparkSession, **v) -> DataFrame:
    base = {"width": 500, "height": 300, "depth": 1, "samples": 3, "planar": False, "tile_width": 128, "tile_height": 128, "tile_depth": 1} | v
    return spark.range(1).select(*[F.lit(x).alias(k) for k, x in base.items()])


def _grid_sql(w: int, h: int, d: int, planes: int, n: int, tw: int, th: int, td: int, clamp: bool = True, where: str = "true") -> str:
    nx, ny, nz = -(-w // tw), -(-h // th), -(-d // td)
    size = lambda full, step, at: f"least({step}, {full} - {at} * {step})" if clamp else f"{step}"
    return f"""SELECT ((p * {nz} + tz) * {ny} + ty) * {nx} + tx AS idx, p AS plane, tx * {tw} AS x, ty * {th} AS y, tz * {td} AS z,
        {size(w, tw, 'tx')} AS w, {size(h, th, 'ty')} AS h, {size(d, td, 'tz')} AS d, {n} AS n
        FROM range({planes}) AS a(p), range({nz}) AS b(tz), range({ny}) AS c(ty), range({nx}) AS e(tx) WHERE {where}"""


TILE = ["idx", "plane", "x", "y", "z", "w", "h", "d", "n"]


@query(_grid_sql(500, 300, 1, 1, 3, 128, 128, 1))
def tile_grid_chunky(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.tile_grid(_image(spark)).select(*TILE)


@query(_grid_sql(500, 300, 20, 3, 1, 128, 64, 8))
def tile_grid_planar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.tile_grid(_image(spark, planar=True, depth=20, tile_height=64, tile_depth=8)).select(*TILE)


@query(_grid_sql(500, 300, 1, 1, 3, 500, 16, 1))
def strip_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.strip_grid(_image(spark, rows_per_strip=16)).select(*TILE)


REGION = {"x0": 100, "y0": 130, "z0": 0, "c0": 1, "rw": 60, "rh": 160, "rd": 1, "rc": 2}


@query(_grid_sql(500, 300, 1, 3, 1, 128, 128, 1, False, "p BETWEEN 1 AND 2 AND tx BETWEEN 100 // 128 AND 159 // 128 AND ty BETWEEN 130 // 128 AND 289 // 128"))
def tiles_for_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.tiles_for_region(_image(spark, planar=True, **REGION)).select(*TILE)


@query(_grid_sql(500, 300, 1, 1, 3, 500, 37, 1, True, "ty BETWEEN 130 // 37 AND 289 // 37"))
def strips_for_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.strips_for_region(_image(spark, rows_per_strip=37, **REGION)).select(*TILE)


@query("SELECT tx, ty, CASE WHEN tx < 4 AND ty < 3 THEN ty * 4 + tx END AS idx, least(128, 500 - tx * 128) AS w, least(128, 300 - ty * 128) AS h FROM range(5) AS a(tx), range(4) AS b(ty)")
def tile_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _image(spark).crossJoin(spark.range(20)).withColumns({"gx": F.col("id") % 5, "gy": F.floor(F.col("id") / 5)})
    return grid.tile_info(at, F.col("gx"), F.col("gy"), F.lit(0), F.lit(0)).select(F.col("gx").alias("tx"), F.col("gy").alias("ty"), "idx", "w", "h")


@query("SELECT 12 AS per_plane, 150000 AS num_pixels, 450000 AS num_elements, false AS is_3d, true AS is_multi_channel, 160 AS x1, 290 AS y1, 19200 AS n_samples")
def derived_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _image(spark, **REGION)
    c = F.col
    per = grid.tiles_per_plane(c("width"), c("height"), c("depth"), c("tile_width"), c("tile_height"), c("tile_depth"))
    ends = {k: v for k, v in grid.region_ends().items() if k in ("x1", "y1", "n_samples")}
    return one.select(per.alias("per_plane"), *[v.alias(k) for k, v in (grid.derived_sizes() | ends).items()])


@query(f"SELECT x, y, (y // 16) * 4 + x // 16 AS idx FROM ({PART})")
def pixel_to_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir).select("x", "y", grid.pixel_to_tile(F.col("x"), F.col("y"), 16, 16, 4).alias("idx"))


@query(f"SELECT x - 10 AS x, y - 1 AS y, v FROM ({PART}) WHERE x BETWEEN 10 AND 29 AND y BETWEEN 1 AND 3")
def region_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.region_read(_part(spark, sf_dir), 10, 1, 20, 3)


@query(f"SELECT x, y, v, (y // 16) * 4 + x // 16 AS idx FROM ({PART}) WHERE x BETWEEN 10 AND 39 AND y BETWEEN 1 AND 20")
def region_tile_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = _image(spark, width=WIDTH, height=400, samples=1, tile_width=16, tile_height=16, x0=10, y0=1, z0=0, c0=0, rw=30, rh=20, rd=1, rc=1)
    return grid.region_tile_join(_part(spark, sf_dir), grid.tiles_for_region(image), 16, 16, 4).select("x", "y", "v", "idx")


@query("SELECT * FROM (VALUES (0, 0, 10, 10, NULL), (490, 0, 11, 10, 'OutOfBounds'), (0, 0, 0, 5, 'OutOfBounds'), (-1, 0, 5, 5, 'OutOfBounds'), (499, 299, 1, 1, NULL), (2147483647, 0, 2147483647, 1, 'OutOfBounds')) AS t(x0, y0, rw, rh, error_code)")
def validate_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(0, 0, 10, 10), (490, 0, 11, 10), (0, 0, 0, 5), (-1, 0, 5, 5), (499, 299, 1, 1), (2147483647, 0, 2147483647, 1)]
    r = spark.createDataFrame(rows, "x0 int, y0 int, rw int, rh int").withColumns({"z0": F.lit(0), "c0": F.lit(0), "rd": F.lit(1), "rc": F.lit(3)})
    r = r.withColumns({"width": F.lit(500), "height": F.lit(300), "depth": F.lit(1), "samples": F.lit(3)})
    return r.select("x0", "y0", "rw", "rh", grid.region_error().alias("error_code"))


@query("SELECT b AS bits, f AS sample_format, CASE WHEN b = 16 AND f = 1 THEN NULL ELSE 'InvalidFormat' END AS error_code, CASE WHEN f = 3 THEN CASE WHEN b >= 32 THEN 'f' || b END ELSE CASE f WHEN 1 THEN 'u' ELSE 'i' END || b END AS pixel_type FROM (VALUES (8), (16), (32), (64)) AS t(b), (VALUES (1), (2), (3)) AS u(f)")
def validate_pixel_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = spark.createDataFrame([(b, f) for b in (8, 16, 32, 64) for f in (1, 2, 3)], "bits int, sample_format int")
    return r.select("bits", "sample_format", binary.pixel_type_error(F.col("bits"), F.col("sample_format"), "u16").alias("error_code"), binary.pixel_type_name(F.col("bits"), F.col("sample_format")).alias("pixel_type"))


@query(f"SELECT x, y, coalesce(v, 0) AS v FROM (SELECT p_partkey % {WIDTH} AS x, p_partkey // {WIDTH} AS y, CASE WHEN p_partkey % 3 = 0 THEN p_size::BIGINT END AS v FROM part)")
def sparse_tile_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _part(spark, sf_dir)
    have = p.where((F.col("y") * WIDTH + F.col("x")) % 3 == 0)
    return grid.sparse_fill(p.select("x", "y"), have, ["x", "y"]).select("x", "y", "v")


@query("SELECT doc_id AS idx, n_chars AS length FROM documents WHERE n_chars > 0")
def missing_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.present(_read(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), F.col("n_chars").alias("length")))


@query(f"WITH p AS ({PART}), s AS (SELECT max(y) + 1 AS h FROM p) SELECT a.x, b.y, p.v FROM range(64) AS a(x), s, unnest(range(((h + 15) // 16) * 16)) AS b(y), p WHERE p.x = least(a.x, {WIDTH - 1}) AND p.y = least(b.y, h - 1)")
def edge_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _part(spark, sf_dir)
    h = p.agg(F.max("y")).first()[0] + 1  # one number
    at = spark.range(64 * (-(-h // 16) * 16)).select((F.col("id") % 64).alias("x"), F.floor(F.col("id") / 64).alias("y"))
    return layout.edge_pad(p, at, WIDTH, h)


_DIMS = {"d": 4, "h": 4, "w": 4, "n": 1}
_D4 = {"d": 1, "h": 4, "w": 4, "n": 4}


@query("SELECT vec_id, ((i - 1) % 4) * 16 + (i - 1) // 4 AS pos, floor(embedding[i]::DOUBLE * 1000)::BIGINT AS v FROM embeddings, unnest(range(1, 65)) AS t(i)")
def layout_hwc_to_chw(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    return e.select("vec_id", layout.relayout(F.col("i"), "DHWC", "DCHW", _D4).alias("pos"), F.floor(F.col("e").cast("double") * 1000).cast("long").alias("v"))


_PAIRS = [(a, b) for a in ("DHWC", "DCHW", "CDHW") for b in ("DHWC", "DCHW", "CDHW")]
_BOX = {"d": 2, "h": 4, "w": 4, "n": 2}


def _pair_sql() -> str:
    at = {  # coordinates from a flat index in each layout of a 2 x 4 x 4 x 2 block, and back
        "DHWC": ("i // 32", "(i // 8) % 4", "(i // 2) % 4", "i % 2", "((z * 4 + y) * 4 + x) * 2 + c"),
        "DCHW": ("i // 32", "(i // 4) % 4", "i % 4", "(i // 16) % 2", "((z * 2 + c) * 4 + y) * 4 + x"),
        "CDHW": ("(i // 16) % 2", "(i // 4) % 4", "i % 4", "i // 32", "((c * 2 + z) * 4 + y) * 4 + x"),
    }
    one = lambda a, b: f"SELECT '{a}' AS source, '{b}' AS target, i, {at[b][4]} AS pos FROM (SELECT i, {at[a][0]} AS z, {at[a][1]} AS y, {at[a][2]} AS x, {at[a][3]} AS c FROM range(64) AS t(i))"
    return " UNION ALL ".join(one(a, b) for a, b in _PAIRS)


@query(_pair_sql())
def layout_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = F.array(*[F.struct(F.lit(a).alias("source"), F.lit(b).alias("target"), layout.relayout(F.col("id"), a, b, _BOX).alias("pos")) for a, b in _PAIRS])
    return spark.range(64).select(F.col("id").alias("i"), F.explode(moves).alias("m")).select("m.source", "m.target", "i", "m.pos")


@query("SELECT idx, row_number() OVER (ORDER BY z, plane, y, x) AS rn FROM (" + _grid_sql(500, 300, 20, 3, 1, 128, 64, 8) + ")")
def chunk_order_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    tiles = grid.tile_grid(_image(spark, planar=True, depth=20, tile_height=64, tile_depth=8))
    return tiles.select("idx", F.row_number().over(Window.orderBy(*spans.write_order("image"))).cast("long").alias("rn"))


@query("SELECT doc_id, (8 + coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS file_offset FROM documents")
def chunk_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents")
    return d.select("doc_id", spans.offsets(F.col("n_chars"), ["doc_id"], ["source"], 8).alias("file_offset"))


@query(f"""WITH s AS ({SPANS}), m AS (SELECT *, max("offset" + length) OVER (PARTITION BY file ORDER BY "offset", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s)
SELECT id, sum(CASE WHEN "offset" - reach > 2000 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY "offset", id ROWS UNBOUNDED PRECEDING)::BIGINT AS batch FROM m""")
def gap_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.gap_batches(_spans(spark, sf_dir), ["file"], 2000).select("id", "batch")


@query(f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY "offset", "offset" + length) AS rn FROM ({SPANS})),
f(file, rn, batch, b, e) AS (
  SELECT file, rn, 0::BIGINT, "offset", "offset" + length FROM s WHERE rn = 1
  UNION ALL
  SELECT s.file, s.rn, CASE WHEN s."offset" - f.e <= 2000 AND greatest(f.e, s."offset" + s.length) - f.b <= 50000 THEN f.batch ELSE f.batch + 1 END,
         CASE WHEN s."offset" - f.e <= 2000 AND greatest(f.e, s."offset" + s.length) - f.b <= 50000 THEN f.b ELSE s."offset" END,
         CASE WHEN s."offset" - f.e <= 2000 AND greatest(f.e, s."offset" + s.length) - f.b <= 50000 THEN greatest(f.e, s."offset" + s.length) ELSE s."offset" + s.length END
  FROM f JOIN s ON s.file = f.file AND s.rn = f.rn + 1)
SELECT file, batch, min(b)::BIGINT AS "offset", max(e)::BIGINT AS "end", count(*) AS n FROM f GROUP BY file, batch""")
def greedy_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.greedy_batches(_spans(spark, sf_dir), ["file"], 2000, 50000)


@query("""SELECT n, big, placement,
  CASE placement WHEN 'beginning' THEN head ELSE head + 1000 END AS ifd_offset,
  CASE placement WHEN 'beginning' THEN head ELSE head + 1000 END + size AS external_offset,
  CASE placement WHEN 'beginning' THEN head + size + 40 ELSE head END AS data_offset, size AS ifd_size
FROM (SELECT n, big, placement, CASE WHEN big THEN 16 ELSE 8 END AS head, CASE WHEN big THEN 16 + 20 * n ELSE 6 + 12 * n END AS size
      FROM range(3, 20) AS t(n), (VALUES (true), (false)) AS u(big), (VALUES ('beginning'), ('end'), ('inline')) AS v(placement))""")
def ifd_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = spark.range(3, 20).select(F.col("id").alias("n"), F.explode(F.array(F.lit(True), F.lit(False))).alias("big"))
    out = None
    for p in ("beginning", "end", "inline"):
        one = base.select("n", "big", F.lit(p).alias("placement"), *[c.alias(k) for k, c in tags.directory_layout(F.col("n"), F.lit(40), F.lit(1000), F.col("big"), p).items()])
        out = one if out is None else out.unionByName(one)
    return out


_ENTRIES = "SELECT doc_id % 50 AS ifd, doc_id // 50 AS pos, [256, 257, 258, 259, 277, 300][1 + (doc_id * 7 + doc_id // 50) % 6] AS code, n_chars AS value FROM documents"


@query(f"""WITH t AS ({_ENTRIES})
SELECT ifd, arg_min(value, pos) FILTER (code = 256) AS width, arg_min(value, pos) FILTER (code = 257) AS height, coalesce(arg_min(value, pos) FILTER (code = 277), 1) AS samples,
       CASE WHEN count(*) FILTER (code = 256) = 0 OR count(*) FILTER (code = 257) = 0 THEN 'InvalidTag' END AS error_code,
       (count(*) FILTER (code = 256) > 0)::INT + (count(*) FILTER (code = 257) > 0)::INT + (count(*) FILTER (code = 277) > 0)::INT AS n_defined
FROM t GROUP BY ifd""")
def tag_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, c = _read(spark, sf_dir, "documents"), F.col("doc_id")
    codes = F.array(*[F.lit(x) for x in (256, 257, 258, 259, 277, 300)])
    pos = F.floor(c / 50)
    entries = d.select((c % 50).alias("ifd"), pos.alias("pos"), F.get(codes, ((c * 7 + pos) % 6).cast("int")).alias("code"), F.col("n_chars").alias("value"))
    spec = [t for t in SPECS["MinImage"] if t.name in ("ImageWidth", "ImageLength", "SamplesPerPixel")]
    wide = tags.project(entries, ["ifd"], spec)
    count = tags.defined_count([t.name for t in spec])
    return wide.select("ifd", F.col("ImageWidth").alias("width"), F.col("ImageLength").alias("height"), tags.or_default("SamplesPerPixel", 1).alias("samples"), "error_code", count.alias("n_defined"))


@query("SELECT s.code, e.n FROM (VALUES (254), (256), (257), (277)) AS s(code) LEFT JOIN (SELECT code, count(*) AS n FROM (" + _ENTRIES + ") GROUP BY code) e USING (code)")
def spec_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, c = _read(spark, sf_dir, "documents"), F.col("doc_id")
    codes = F.array(*[F.lit(x) for x in (256, 257, 258, 259, 277, 300)])
    counts = d.select(F.get(codes, ((c * 7 + F.floor(c / 50)) % 6).cast("int")).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return tags.spec_left_join(spark.createDataFrame([(x,) for x in (254, 256, 257, 277)], "code int"), counts)


def _hdelta_sql(base: str, by: str, bits: int) -> str:
    return f"SELECT *, (((v - coalesce(lag(v) OVER (PARTITION BY {by} ORDER BY x), 0)) % {1 << bits}) + {1 << bits}) % {1 << bits} AS delta FROM ({base})"


@query(_hdelta_sql(VECTORS, "y", 16))
def hdelta_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).withColumn("delta", predictors.hdelta(F.col("v"), ["y"], "x", 16))


@query(f"SELECT x, y, v, v AS back FROM ({PART})")
def hdelta_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _part(spark, sf_dir).withColumn("delta", predictors.hdelta(F.col("v"), ["y"], "x", 8))
    return p.select("x", "y", "v", predictors.unhdelta(F.col("delta"), ["y"], "x", 8).alias("back"))


@query(f"SELECT y, c, x, v, delta FROM ({_hdelta_sql(f'SELECT y, x % 4 AS c, x // 4 AS x, v FROM ({VECTORS})', 'y, c', 16)})")
def hdelta_rgba(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _vectors(spark, sf_dir).select("y", (F.col("x") % 4).alias("c"), F.floor(F.col("x") / 4).alias("x"), "v")
    return p.withColumn("delta", predictors.hdelta(F.col("v"), ["y", "c"], "x", 16))


@query(_hdelta_sql(f"SELECT x, y, (v * 37) % 256 AS v FROM ({PART})", "y", 8))
def hdelta_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _part(spark, sf_dir).withColumn("v", (F.col("v") * 37) % 256)
    return p.withColumn("delta", predictors.hdelta(F.col("v"), ["y"], "x", 8))


def _swap_sql(size: int, c: str) -> str:
    return " + ".join(f"(({c} // {1 << 8 * i}) % 256) * {1 << 8 * (size - 1 - i)}" for i in range(size))


@query(f"SELECT o_orderkey, {_swap_sql(2, '(o_orderkey % 65536)')} AS b16, {_swap_sql(4, 'o_orderkey')} AS b32, o_orderkey % 128 AS low, {_swap_sql(7, 'o_orderkey')} AS b56 FROM orders")
def byteswap(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    swapped = F.shiftrightunsigned(binary.byteswap(F.shiftleft(k, 0), 8), 8)
    return _read(spark, sf_dir, "orders").select("o_orderkey", binary.byteswap(k % 65536, 2).alias("b16"), binary.byteswap(k, 4).alias("b32"), (k % 128).alias("low"), swapped.alias("b56"))


def _small_sql(e: int, m: int, bits: str) -> str:
    """The value of a small float by its definition; every finite one is an exact double, so it may be compared as such."""
    bias, top = (1 << (e - 1)) - 1, (1 << e) - 1
    s, x, f = f"(({bits} >> {e + m}) & 1)", f"(({bits} >> {m}) & {top})", f"({bits} & {(1 << m) - 1})"
    value = f"CASE WHEN {x} = 0 THEN {f}::DOUBLE / {1 << m} * pow(2.0, {1 - bias}) ELSE (1 + {f}::DOUBLE / {1 << m}) * pow(2.0, {x} - {bias}) END"
    signed = f"(CASE WHEN {s} = 1 THEN -1 ELSE 1 END * ({value}))"
    return _shown_sql(signed, f"{x} = {top}", f"CASE WHEN {f} <> 0 THEN 'nan' WHEN {s} = 1 THEN '-inf' ELSE 'inf' END")


def _shown_sql(value: str, special: str, name: str) -> str:
    """Exponent and 24 leading bits of a double as text, which any engine writes alike."""
    power = f"floor(log2(abs({value})))"
    return f"CASE WHEN {special} THEN {name} WHEN {value} = 0 THEN '0' ELSE {power}::BIGINT::VARCHAR || ':' || round({value} / pow(2.0, {power}) * 16777216)::BIGINT::VARCHAR END"


def _shown(c):
    power = binary.binary_exponent(F.abs(c))
    text = F.concat(power.cast("long").cast("string"), F.lit(":"), F.round(c / F.pow(F.lit(2.0), power) * 16777216).cast("long").cast("string"))
    return F.when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf").when(c == 0, "0").otherwise(text)


@query(f"SELECT bits, {_small_sql(5, 10, 'bits')} AS value FROM range(65536) AS t(bits)")
def float16_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(65536).select(F.col("id").alias("bits"), _shown(binary.float16_to_double(F.col("id"))).alias("value"))


@query(f"SELECT bits, {_small_sql(7, 16, 'bits')} AS value FROM (SELECT (o_orderkey * 7919) % 16777216 AS bits FROM orders)")
def float24_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _read(spark, sf_dir, "orders").select(((F.col("o_orderkey") * 7919) % 16777216).alias("bits"))
    return b.select("bits", _shown(binary.float24_to_double(F.col("bits"))).alias("value"))


@query("SELECT bits, CASE WHEN (bits >> 10) & 31 = 31 AND bits & 1023 <> 0 THEN 'nan' ELSE bits::VARCHAR END AS back16 FROM range(65536) AS t(bits)")
def float16_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bit patterns; which NaN comes back is not defined."""
    value = binary.float16_to_double(F.col("id"))
    return spark.range(65536).select(F.col("id").alias("bits"), F.when(F.isnan(value), "nan").otherwise(binary.double_to_float16(value).cast("string")).alias("back16"))


_RUNS = f"""SELECT y, run, min(x) AS start, any_value(v) AS v, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY y ORDER BY x ROWS UNBOUNDED PRECEDING)::BIGINT AS run
FROM (SELECT *, CASE WHEN lag(v) OVER (PARTITION BY y ORDER BY x) = v THEN 0 ELSE 1 END AS fresh FROM (SELECT x, y, v // 20 AS v FROM ({PART})))) GROUP BY y, run"""


@query(_RUNS)
def packbits_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.packbits_runs(_part(spark, sf_dir).withColumn("v", F.floor(F.col("v") / 20)), ["y"], "x", "v")


@query(f"SELECT y, sum(2 * ((n + 127) // 128))::BIGINT AS run_bytes FROM ({_RUNS}) WHERE n >= 2 GROUP BY y")
def packbits_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = packbits_runs(spark, sf_dir).where("n >= 2")
    return runs.groupBy("y").agg(F.sum(2 * F.floor((F.col("n") + 127) / 128)).cast("long").alias("run_bytes"))


_TYPES = "(VALUES (1, 1), (2, 1), (3, 2), (4, 4), (5, 8), (6, 1), (7, 1), (8, 2), (9, 4), (10, 8), (11, 4), (12, 8), (13, 4), (16, 8), (17, 8), (18, 8), (99, 0)) AS t(code, size)"


@query(f"SELECT code, k AS count, big, size, size * k AS data_size, size * k <= CASE WHEN big THEN 8 ELSE 4 END AS is_inline, CASE WHEN size * k > CASE WHEN big THEN 8 ELSE 4 END THEN size * k ELSE 0 END AS external_bytes FROM {_TYPES}, range(1, 10) AS u(k), (VALUES (true), (false)) AS w(big)")
def type_size_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.createDataFrame([(c,) for c in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 16, 17, 18, 99)], "code int")
    t = t.select("code", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(9).cast("long"))).alias("count")).select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("big"))
    c, n, b = F.col("code"), F.col("count"), F.col("big")
    return t.select("code", "count", "big", binary.type_size(c).alias("size"), binary.data_size(c, n).alias("data_size"), binary.is_inline(c, n, b).alias("is_inline"), binary.external_bytes(c, n, b).alias("external_bytes"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN floor(p_partkey * 1000.0 / (p_size % 5))::BIGINT END AS v FROM part")
def rational_to_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.struct(F.col("p_partkey").alias("num"), (F.col("p_size") % 5).alias("den"))
    p = _read(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 1000).alias("k"), r.alias("r"))
    scaled = F.struct(F.col("k").alias("num"), F.col("r.den").alias("den"))
    return p.select("p_partkey", F.floor(binary.rational_to_double(scaled)).cast("long").alias("v"))


@query("SELECT doc_id, len(string_split(t, chr(1))) - CASE WHEN ends_with(t, chr(1)) THEN 1 ELSE 0 END AS n, string_split(t, chr(1))[1] AS first, string_split(rtrim(t, chr(1)), chr(1))[-1] AS last FROM (SELECT doc_id, replace(text, ' ', chr(1)) AS t FROM documents)")
def nul_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spaces as NULs. Char 1 stands for NUL in the SQL: here a text's own NULs and chars 1 change places with each other."""
    nul, one, space = F.lit("\x00"), F.lit("\x01"), F.lit(" ")
    t = F.replace(F.replace(F.replace("text", one, space), nul, one), space, nul)
    d = _read(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    ended = lambda c: F.when(c == "", nul).otherwise(c)  # noqa: E731  an empty text is written as its final NUL
    parts = binary.nul_split(ended(F.col("t")))
    last = F.element_at(binary.nul_split(ended(binary.ascii_trim(F.col("t")))), -1)
    return d.select("doc_id", F.size(parts).cast("long").alias("n"), F.replace(F.get(parts, F.lit(0)), one, nul).alias("first"), F.replace(last, one, nul).alias("last"))


@query("SELECT doc_id, length(text) AS n, sha256(text) AS digest FROM documents")
def ascii_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = binary.ascii_trim(F.concat("text", F.lit("\x00\x00")))
    d = _read(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    return d.select("doc_id", F.char_length("t").cast("long").alias("n"), F.sha2(F.col("t").cast("binary"), 256).alias("digest"))


@query("SELECT o_orderkey, dtype, CASE WHEN dtype IN (3, 4) THEN o_orderkey END AS value, CASE WHEN dtype IN (3, 4) THEN NULL ELSE 'InvalidTagType' END AS error_code FROM (SELECT o_orderkey, 1 + o_orderkey % 6 AS dtype FROM orders)")
def promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders").select("o_orderkey", (1 + F.col("o_orderkey") % 6).alias("dtype"))
    return o.select("o_orderkey", "dtype", binary.promote(F.col("o_orderkey"), F.col("dtype"), "Long", ("Short",)).alias("p")).select("o_orderkey", "dtype", "p.value", "p.error_code")


@query("SELECT doc_id % 10 AS ifd, sum(CASE WHEN n_chars * 2 > 4 THEN n_chars * 2 ELSE 0 END)::BIGINT AS bytes FROM documents GROUP BY 1")
def external_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents")
    size = binary.external_bytes(F.lit(3), F.col("n_chars"), F.lit(False))
    return d.groupBy((F.col("doc_id") % 10).alias("ifd")).agg(F.sum(size).alias("bytes"))


@query("SELECT lang, count(n_chars) AS n, sum(n_chars)::BIGINT AS total, round(avg(n_chars), 3) AS mean, round(stddev_samp(n_chars), 3) AS stddev, median(n_chars) AS median, min(n_chars) AS least, max(n_chars) AS greatest FROM documents GROUP BY lang")
def read_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans.run_stats(_read(spark, sf_dir, "documents"), ["lang"], "n_chars")
    return s.withColumns({"mean": F.round("mean", 3), "stddev": F.round("stddev", 3)})


_LINKS = [(8, 100), (100, 300), (300, 50), (50, 700), (700, 300), (900, 0)]


@query("SELECT * FROM (VALUES (0, 8), (1, 100), (2, 300), (3, 50), (4, 700)) AS t(page, \"offset\")")
def ifd_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.chain(spark.createDataFrame(_LINKS, "offset int, next int"), 8)


@query("SELECT doc_id AS parent, doc_id * 100 + i AS sub FROM documents, unnest(range(n_chars % 4)) AS t(i)")
def sub_ifd_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars") % 4
    subs = F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.col("doc_id") * 100 + i))
    return _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("parent"), F.explode(subs).alias("sub"))


def _roundtrip(spark: SparkSession, sf_dir: str, scheme: str) -> DataFrame:
    raw = F.col("text").cast("binary")
    d = _read(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"))
    packed = d.select("doc_id", F.octet_length("raw").alias("size"), codecs.compress(F.col("raw"), COMPRESSION[scheme]).alias("z"))
    plain = packed.select("doc_id", codecs.decompress(F.col("z"), F.col("size"), COMPRESSION[scheme]).alias("plain"))
    return plain.select("doc_id", F.sha2("plain", 256).alias("digest"))


_DIGEST = "SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents"


@query(_DIGEST)
def zstd_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roundtrip(spark, sf_dir, "ZSTD")


@query(_DIGEST)
def packbits_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roundtrip(spark, sf_dir, "PackBits")


@query(f"SELECT (y // 16) * 4 + x // 16 AS idx, min(v) AS least, max(v) AS greatest, sum(v)::BIGINT AS total, count(*) AS n FROM ({PART}) GROUP BY 1")
def tile_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _part(spark, sf_dir).withColumn("idx", grid.pixel_to_tile(F.col("x"), F.col("y"), 16, 16, 4))
    return p.groupBy("idx").agg(F.min("v").alias("least"), F.max("v").alias("greatest"), F.sum("v").alias("total"), F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id % 20 AS img, arg_min(CASE WHEN n_chars % 3 = 0 THEN 'ReadError' ELSE 'InvalidFormat' END, doc_id) FILTER (n_chars % 5 = 0) AS error_code, min(doc_id) FILTER (n_chars % 5 = 0) AS error_at FROM documents GROUP BY 1")
def first_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    code = F.when(n % 5 == 0, F.when(n % 3 == 0, "ReadError").otherwise("InvalidFormat"))
    d = _read(spark, sf_dir, "documents").select((F.col("doc_id") % 20).alias("img"), F.col("doc_id").alias("idx"), code.alias("error_code"))
    return spans.first_error(d, ["img"])


@query("SELECT * FROM (VALUES (64, 32, NULL::VARCHAR), (64, 0, 'InvalidFormat')) AS t(width, samples, shape_error) WHERE samples > 100 UNION ALL SELECT w AS width, n AS samples, CASE WHEN n = 2 THEN 'InvalidFormat' WHEN w = 300 THEN 'InvalidTag' END AS shape_error FROM (VALUES (100, 3), (200, 2), (300, 3)) AS t(w, n)")
def image_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.createDataFrame([(100, 5, [8, 8, 8], 3), (200, 5, [8, 8, 8], 2), (300, None, [8, 8, 8], 3)], "ImageWidth int, ImageLength int, BitsPerSample array<int>, SamplesPerPixel int")
    return tags.image_shape(t).select("width", "samples", "shape_error")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events")
def date_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy:MM:dd HH:mm:ss").alias("t"))
    return e.select("event_id", F.date_format(binary.date_time(F.col("t")), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 THEN o_orderkey * 2 + 1 WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 7 END AS value, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'ReadError' END WHEN o_orderkey % 5 = 0 THEN 'OutOfBounds' END AS error_code, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey * 2 ELSE -1 END AS fallback FROM orders")
def result_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value that may fail in two steps, with recovery from one kind of failure."""
    k = F.col("o_orderkey")
    first = results.transform(results.ensure(k, k % 3 != 0, "ReadError"), lambda v: v * 2)
    o = _read(spark, sf_dir, "orders").select("o_orderkey", first.alias("a"))
    then = results.and_then(F.col("a"), lambda v: results.ensure(v + 1, v % 5 != 0, "OutOfBounds"))
    spare = F.struct(F.when(k % 2 == 0, F.lit(7).cast("long")).alias("value"), F.lit(None).cast("string").alias("error_code"))
    o = o.select("o_orderkey", "a", then.alias("b"))
    back = results.or_else(F.col("b"), lambda code: F.when((code == "ReadError") & (k % 2 == 0), spare).otherwise(F.struct(F.lit(None).cast("long").alias("value"), code.alias("error_code"))))
    return o.select("o_orderkey", back.alias("c"), results.value_or(F.col("a"), F.lit(-1).cast("long")).alias("fallback")).select("o_orderkey", "c.value", "c.error_code", "fallback")


@query("SELECT doc_id % 8 AS img, sum(n_chars)::BIGINT AS bytes, round(sum(n_chars) / 2.0 / 1000000, 6) AS mb_per_s FROM documents GROUP BY 1")
def total_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents").groupBy((F.col("doc_id") % 8).alias("img")).agg(F.sum("n_chars").alias("bytes"))
    return d.select("img", "bytes", F.round(spans.throughput(F.col("bytes"), F.lit(2.0)), 6).alias("mb_per_s"))


def _values(rows: list[tuple], names: str) -> str:
    text = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS t({names})"


_FAMILIES = {"Compression": COMPRESSION, "SampleFormat": SAMPLE_FORMAT, "Photometric": PHOTOMETRIC, "Predictor": PREDICTOR, "Planar": PLANAR}


_BUILT_IN = tuple(TAGS.values())  # users may register more


@query(_values([(t.code, t.name, t.type, t.shape) for t in _BUILT_IN], "code, name, type, shape"))
def known_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_names(spark).where(F.col("name").isin(*[t.name for t in _BUILT_IN]))


@query(_values([(f, c, n) for f, e in _FAMILIES.items() for n, c in e.items()], "family, code, name"))
def known_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enum_names(spark)


@query(f"SELECT x, y, v FROM ({PART}) WHERE x >= 8 AND x < 40 AND y >= 1 AND y < 4")
def file_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part raster written as a file in one task (tiled, compressed, predicted), scanned back, a region's pixels read."""
    from ..sources import parser, scan, writer

    def pack(key, rows):
        import pandas as pd

        pixels = np.zeros((1, int(rows["y"].max()) + 1, WIDTH, 1), np.uint8)
        pixels[0, rows["y"], rows["x"], 0] = rows["v"]
        return pd.DataFrame({"path": ["part.tif"], "content": [writer.write(writer.Image(pixels, (1, 16, 16), None, False, "ZSTD", "Horizontal"))]})

    files = _part(spark, sf_dir).withColumn("img", F.lit(0)).groupBy("img").applyInPandas(pack, "path string, content binary")
    h = parser.Region(8, 1, 0, 0, 32, 3, 1, 1)
    region = ",".join(str(v) for v in (h.x, h.y, h.z, h.c, h.w, h.h, h.d, h.n))
    pixels = scan.scan_binary(files, "pixels", region=region, error_mode="FAILFAST")
    return pixels.select("x", "y", F.col("v").cast("long").alias("v"))
