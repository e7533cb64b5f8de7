"""Predictors: numpy kernels for decoded blocks, and the same operators as window expressions on pixel rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .constants import PREDICTOR, RasterError

NONE, HORIZONTAL, FLOATING = PREDICTOR["None"], PREDICTOR["Horizontal"], PREDICTOR["FloatingPoint"]


def _words(block: np.ndarray) -> np.ndarray:
    return block.view(f"u{block.dtype.itemsize}")


def delta(block: np.ndarray, axis: int = 1) -> np.ndarray:
    """Differences along a row per channel, modulo the word size; block is (rows, width, samples). Floats: of their bits."""
    if block.shape[axis] == 0:
        raise RasterError("InvalidOperation", "width is zero")
    out = _words(np.ascontiguousarray(block)).copy()
    out[:, 1:] -= _words(np.ascontiguousarray(block))[:, :-1]
    return out.view(block.dtype)


def undelta(block: np.ndarray) -> np.ndarray:
    if block.shape[1] == 0:
        raise RasterError("InvalidOperation", "width is zero")
    words = _words(np.ascontiguousarray(block))
    return np.cumsum(words, axis=1, dtype=words.dtype).view(block.dtype)


def delta24(block: np.ndarray) -> np.ndarray:
    """Differences of 24-bit words held in the low bits of uint32."""
    return delta(block.astype(np.uint32)) & np.uint32(0xFFFFFF)


def undelta24(block: np.ndarray) -> np.ndarray:
    return undelta(block.astype(np.uint32)) & np.uint32(0xFFFFFF)


def with_stride(kernel, flat: np.ndarray, width: int, height: int, stride: int, samples: int = 1) -> np.ndarray:
    """Apply a kernel to the first ``width`` pixels of rows of ``stride`` samples; padding samples stay as they are."""
    rows = flat.reshape(height, stride).copy()
    part = np.ascontiguousarray(rows[:, : width * samples]).reshape(height, width, samples)
    rows[:, : width * samples] = kernel(part).reshape(height, width * samples)
    return rows.reshape(-1)


def shuffle_delta(block: np.ndarray) -> np.ndarray:
    """The common standard's floating point predictor: byte planes from the most significant on, then byte differences."""
    h, w, n = block.shape
    size = block.dtype.itemsize
    planes = block.astype(block.dtype.newbyteorder(">")).view(np.uint8).reshape(h, w * n, size).transpose(0, 2, 1).reshape(h, w * size, n)
    return delta(planes).reshape(h, -1)


def unshuffle_delta(rows: np.ndarray, dtype: np.dtype, width: int, samples: int) -> np.ndarray:
    h, size = rows.shape[0], dtype.itemsize
    planes = undelta(rows.reshape(h, width * size, samples)).reshape(h, size, width * samples).transpose(0, 2, 1)
    return np.ascontiguousarray(planes).view(dtype.newbyteorder(">")).reshape(h, width, samples).astype(dtype)


def keeps_order(dtype: np.dtype, predictor: int, float_mode: str) -> bool:
    """Whether the predictor fixes the byte order itself, so that pixels aren't swapped."""
    return dtype.kind == "f" and predictor == FLOATING and float_mode == "adobe"


def apply(block: np.ndarray, predictor: int, float_mode: str = "bitdelta") -> np.ndarray:
    """Encode. Horizontal on floats and floating point on integers change nothing."""
    floats = block.dtype.kind == "f"
    if predictor == HORIZONTAL and not floats:
        return delta(block)
    if predictor == FLOATING and floats:
        return shuffle_delta(block) if float_mode == "adobe" else delta(block)
    return block


def undo(block: np.ndarray, predictor: int, float_mode: str = "bitdelta") -> np.ndarray:
    floats = block.dtype.kind == "f"
    if predictor == HORIZONTAL and not floats:
        return undelta(block)
    if predictor == FLOATING and floats:
        if float_mode == "adobe":
            h, w, n = block.shape
            return unshuffle_delta(np.ascontiguousarray(block).view(np.uint8).reshape(h, -1), block.dtype, w, n)
        return undelta(block)
    return block


def hdelta(value: Column, by: list[str], order: str, bits: int) -> Column:
    """Window form of ``delta`` on unsigned pixel values: ``by`` names a row and channel, ``order`` the x position."""
    w = Window.partitionBy(*by).orderBy(order)
    return F.pmod(value.cast("long") - F.coalesce(F.lag(value.cast("long")).over(w), F.lit(0)), F.lit(1 << bits).cast("long"))


def unhdelta(value: Column, by: list[str], order: str, bits: int) -> Column:
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.pmod(F.sum(value.cast("long")).over(w), F.lit(1 << bits).cast("long"))
