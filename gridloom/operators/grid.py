"""Tile grids, region lookups and pixel addressing, in closed form on columns: no join by ranges anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHAPE = ("width", "height", "depth", "samples", "planar")


def ceil_div(a: Column, b: Column) -> Column:
    return F.floor((a + b - 1) / b).cast("long")


def _steps(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(F.array().cast("array<long>"))


def _between(first: Column, last: Column) -> Column:
    return F.when(last >= first, F.sequence(first.cast("long"), last.cast("long"))).otherwise(F.array().cast("array<long>"))


def tile_grid(images: DataFrame) -> DataFrame:
    """One row per tile of each image, in plane, z, y, x order of ``idx``; border tiles are clamped.

    ``images`` has width, height, depth, samples, planar (boolean), tile_width, tile_height, tile_depth; tile sizes of zero
    give no rows. Other columns are kept.
    """
    c = F.col
    ok = images.where("tile_width > 0 and tile_height > 0 and tile_depth > 0")
    out = ok.withColumns({"nx": ceil_div(c("width"), c("tile_width")), "ny": ceil_div(c("height"), c("tile_height")), "nz": ceil_div(c("depth"), c("tile_depth"))})
    planes = F.when(c("planar"), c("samples")).otherwise(1)
    for name, n in (("plane", planes), ("tz", c("nz")), ("ty", c("ny")), ("tx", c("nx"))):
        out = out.withColumn(name, F.explode(_steps(n)))
    return _placed(out).drop("nx", "ny", "nz", "tx", "ty", "tz")


def _placed(out: DataFrame, clamp: bool = True) -> DataFrame:
    c = F.col
    size = lambda full, step, at: F.least(step, full - at * step) if clamp else step
    return out.withColumns(
        {
            "idx": ((c("plane") * c("nz") + c("tz")) * c("ny") + c("ty")) * c("nx") + c("tx"),
            "x": c("tx") * c("tile_width"), "y": c("ty") * c("tile_height"), "z": c("tz") * c("tile_depth"),
            "w": size(c("width"), c("tile_width"), c("tx")), "h": size(c("height"), c("tile_height"), c("ty")), "d": size(c("depth"), c("tile_depth"), c("tz")),
            "n": F.when(c("planar"), 1).otherwise(c("samples")),
        }
    )


def strip_grid(images: DataFrame) -> DataFrame:
    """One row per strip: a tile as wide as the image and ``rows_per_strip`` high; the last one is clamped."""
    rows = F.least("rows_per_strip", "height")
    return tile_grid(images.withColumns({"tile_width": F.col("width"), "tile_height": rows, "tile_depth": F.lit(1)}))


def tiles_per_plane(width: Column, height: Column, depth: Column, tw: Column, th: Column, td: Column) -> Column:
    return ceil_div(width, tw) * ceil_div(height, th) * ceil_div(depth, td)


def tile_info(images: DataFrame, tx: Column, ty: Column, tz: Column, plane: Column) -> DataFrame:
    """The tile at given grid positions, clamped at the border; null ``idx`` if the position is outside."""
    c = F.col
    out = images.withColumns({"nx": ceil_div(c("width"), c("tile_width")), "ny": ceil_div(c("height"), c("tile_height")), "nz": ceil_div(c("depth"), c("tile_depth")), "tx": tx, "ty": ty, "tz": tz, "plane": plane})
    inside = (c("tx") < c("nx")) & (c("ty") < c("ny")) & (c("tz") < c("nz")) & (c("plane") < F.when(c("planar"), c("samples")).otherwise(1))
    return _placed(out).withColumn("idx", F.when(inside, c("idx"))).drop("nx", "ny", "nz", "tx", "ty", "tz")


def tiles_for_region(images: DataFrame) -> DataFrame:
    """One row per tile that a region touches. Regions are columns x0, y0, z0, c0 and rw, rh, rd, rc (starts and sizes).

    The index range along each axis follows from integer division; planar images give only the region's channels. Tile
    sizes aren't clamped here, as stored tiles are full. Empty regions, or beyond the image, give no rows; see
    ``region_error``.
    """
    c = F.col
    ok = images.where(region_error().isNull() & F.expr("tile_width > 0 and tile_height > 0 and tile_depth > 0"))
    out = ok.withColumns({"nx": ceil_div(c("width"), c("tile_width")), "ny": ceil_div(c("height"), c("tile_height")), "nz": ceil_div(c("depth"), c("tile_depth"))})
    axes = (
        ("plane", F.when(c("planar"), c("c0")).otherwise(0), F.when(c("planar"), c("c0") + c("rc") - 1).otherwise(0)),
        ("tz", F.expr("z0 div tile_depth"), F.expr("(z0 + rd - 1) div tile_depth")),
        ("ty", F.expr("y0 div tile_height"), F.expr("(y0 + rh - 1) div tile_height")),
        ("tx", F.expr("x0 div tile_width"), F.expr("(x0 + rw - 1) div tile_width")),
    )
    for name, first, last in axes:
        out = out.withColumn(name, F.explode(_between(first, last)))
    return _placed(out, clamp=False).drop("nx", "ny", "nz", "tx", "ty", "tz")


def strips_for_region(images: DataFrame) -> DataFrame:
    """As ``tiles_for_region`` for strips of ``rows_per_strip``; the last strip's height is clamped."""
    rows = F.least("rows_per_strip", "height")
    out = tiles_for_region(images.withColumns({"tile_width": F.col("width"), "tile_height": rows, "tile_depth": F.lit(1)}))
    return out.withColumn("h", F.least("h", F.col("height") - F.col("y")))


def region_error() -> Column:
    """OutOfBounds for an empty region or one beyond the image, else null. Ends are computed as LONG."""
    c = lambda x: F.col(x).cast("long")
    empty = (c("rw") <= 0) | (c("rh") <= 0) | (c("rd") <= 0) | (c("rc") <= 0)
    low = (c("x0") < 0) | (c("y0") < 0) | (c("z0") < 0) | (c("c0") < 0)
    beyond = (c("x0") + c("rw") > c("width")) | (c("y0") + c("rh") > c("height")) | (c("z0") + c("rd") > c("depth")) | (c("c0") + c("rc") > c("samples"))
    return F.when(empty | low | beyond, "OutOfBounds")


def full_region(images: DataFrame) -> DataFrame:
    zero = F.lit(0)
    return images.withColumns({"x0": zero, "y0": zero, "z0": zero, "c0": zero, "rw": F.col("width"), "rh": F.col("height"), "rd": F.col("depth"), "rc": F.col("samples")})


def region_ends() -> dict[str, Column]:
    c = lambda x: F.col(x).cast("long")
    return {"x1": c("x0") + c("rw"), "y1": c("y0") + c("rh"), "z1": c("z0") + c("rd"), "c1": c("c0") + c("rc"), "n_samples": c("rw") * c("rh") * c("rd") * c("rc")}


def derived_sizes() -> dict[str, Column]:
    c = lambda x: F.col(x).cast("long")
    pixels = c("width") * c("height") * c("depth")
    return {"num_pixels": pixels, "num_elements": pixels * c("samples"), "is_3d": c("depth") > 1, "is_multi_channel": c("samples") > 1}


def pixel_to_tile(x: Column, y: Column, tw: int, th: int, across: int) -> Column:
    """Index of the tile that holds a pixel, in a grid ``across`` tiles wide."""
    return F.floor(y / th).cast("long") * across + F.floor(x / tw).cast("long")


def region_tile_join(pixels: DataFrame, tiles: DataFrame, tw: int, th: int, across: int) -> DataFrame:
    """Pixels (x, y, v) of the generated tiles (idx, ...): an equality join on the tile index, then exact bounds."""
    keyed = pixels.withColumn("idx", pixel_to_tile(F.col("x"), F.col("y"), tw, th, across))
    return keyed.join(tiles.select("idx", "x0", "y0", "rw", "rh"), "idx").where("x >= x0 and x < x0 + rw and y >= y0 and y < y0 + rh").drop("x0", "y0", "rw", "rh")


def region_read(pixels: DataFrame, x0: int, y0: int, w: int, h: int) -> DataFrame:
    """Pixels of a region, re-based to its corner; the filter reaches the scan if x and y are stored columns."""
    inside = (F.col("x") >= x0) & (F.col("x") < x0 + w) & (F.col("y") >= y0) & (F.col("y") < y0 + h)
    return pixels.where(inside).withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})


def sparse_fill(tiles: DataFrame, pixels: DataFrame, on: list[str], fill: int = 0) -> DataFrame:
    """Every position of ``tiles`` with its value, or ``fill`` where the tile is missing."""
    return tiles.join(pixels, on, "left").withColumn("v", F.coalesce("v", F.lit(fill)))


def present(tiles: DataFrame) -> DataFrame:
    """Tiles that hold data: a length of zero marks a missing one."""
    return tiles.where("length > 0")
