"""Array layouts: index permutations on exploded pixels, numpy for dense blocks, edge padding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_AXES = {"DHWC": ("z", "y", "x", "c"), "DCHW": ("z", "c", "y", "x"), "CDHW": ("c", "z", "y", "x")}
_DIM = {"z": "d", "y": "h", "x": "w", "c": "n"}


def flat_index(layout: str, pos: dict[str, Column], dims: dict[str, int]) -> Column:
    """Position in the flat array of a sample at (z, y, x, c); dims are d, h, w, n."""
    out = F.lit(0).cast("long")
    for axis in _AXES[layout]:
        out = out * dims[_DIM[axis]] + pos[axis]
    return out


def coordinates(layout: str, index: Column, dims: dict[str, int]) -> dict[str, Column]:
    """The inverse of ``flat_index``."""
    out, rest = {}, index.cast("long")
    for axis in reversed(_AXES[layout]):
        size = dims[_DIM[axis]]
        out[axis] = F.pmod(rest, F.lit(size).cast("long"))
        rest = F.floor(rest / size).cast("long")
    return out


def relayout(index: Column, source: str, target: str, dims: dict[str, int]) -> Column:
    return flat_index(target, coordinates(source, index, dims), dims)


def transpose(block: np.ndarray, source: str, target: str) -> np.ndarray:
    """A dense 4-D block from one layout to another."""
    return np.ascontiguousarray(block.transpose([_AXES[source].index(a) for a in _AXES[target]]))


def shape_of(layout: str, d: int, h: int, w: int, n: int) -> tuple[int, ...]:
    sizes = {"z": d, "y": h, "x": w, "c": n}
    return tuple(sizes[a] for a in _AXES[layout])


def copy_box(target: np.ndarray, source: np.ndarray, to: dict[str, int], at: dict[str, int], size: dict[str, int], source_layout: str, target_layout: str) -> None:
    """Copy a sub-box (positions and sizes by axis z, y, x, c) between blocks of any two layouts, in place."""
    cut = lambda layout, pos: tuple(slice(pos[a], pos[a] + size[a]) for a in _AXES[layout])
    target[cut(target_layout, to)] = source[cut(source_layout, at)].transpose([_AXES[source_layout].index(a) for a in _AXES[target_layout]])


def fetch_padded(image: np.ndarray, z: int, y: int, x: int, d: int, h: int, w: int) -> np.ndarray:
    """A (d, h, w, n) tile of a DHWC image; beyond the border the edge repeats, wholly outside there are zeros."""
    part = image[z : z + d, y : y + h, x : x + w]
    if 0 in part.shape:
        return np.zeros((d, h, w, image.shape[3]), image.dtype)
    pad = [(0, full - have) for full, have in zip((d, h, w), part.shape, strict=False)]
    return np.pad(part, [*pad, (0, 0)], mode="edge")


def edge_pad(pixels: DataFrame, positions: DataFrame, width: int, height: int) -> DataFrame:
    """Values for all ``positions`` (x, y); outside the image the nearest edge pixel's, by an equality join."""
    near = positions.withColumns({"sx": F.least("x", F.lit(width - 1)), "sy": F.least("y", F.lit(height - 1))})
    source = pixels.select(F.col("x").alias("sx"), F.col("y").alias("sy"), "v")
    return near.join(source, ["sx", "sy"]).select("x", "y", "v")
