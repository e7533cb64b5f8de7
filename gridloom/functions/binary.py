"""Scalar functions on bits, as column expressions: byte order, small floats, field sizes, text fields, promotion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import FIELD_TYPES, PIXEL_TYPES, TYPE_CODE


def byteswap(c: Column, size: int) -> Column:
    """Reverse the bytes of an unsigned value of 1, 2, 4 or 8 bytes (8: as a signed LONG with the same bits)."""
    c = c.cast("long")
    out = F.lit(0).cast("long")
    for i in range(size):
        byte = F.shiftrightunsigned(c, 8 * i).bitwiseAND(255)
        out = out.bitwiseOR(F.shiftleft(byte, 8 * (size - 1 - i)))
    return out


def unsigned(hexed: Column, at: int, size: int, endian: str) -> Column:
    """An unsigned integer of up to 7 bytes from the hex digits of a BINARY value."""
    parts = [F.substring(hexed, 2 * (at + i) + 1, 2) for i in range(size)]
    return F.conv(F.concat(*(parts if endian == "big" else reversed(parts))), 16, 10).cast("long")


def _small_float(bits: Column, exponent_bits: int, mantissa_bits: int) -> Column:
    bias = (1 << (exponent_bits - 1)) - 1
    bits = bits.cast("long")
    sign = F.when(F.shiftright(bits, exponent_bits + mantissa_bits).bitwiseAND(1) == 1, -1.0).otherwise(1.0)
    exponent = F.shiftright(bits, mantissa_bits).bitwiseAND((1 << exponent_bits) - 1)
    mantissa = bits.bitwiseAND((1 << mantissa_bits) - 1)
    part = mantissa / F.lit(float(1 << mantissa_bits))
    return (
        F.when(exponent == (1 << exponent_bits) - 1, F.when(mantissa == 0, sign * F.lit(float("inf"))).otherwise(F.lit(float("nan"))))
        .when(exponent == 0, sign * part * F.pow(F.lit(2.0), F.lit(1 - bias)))
        .otherwise(sign * (1 + part) * F.pow(F.lit(2.0), exponent - bias))
    )


def float16_to_double(bits: Column) -> Column:
    """IEEE half precision, subnormals included."""
    return _small_float(bits, 5, 10)


def float24_to_double(bits: Column) -> Column:
    """1 sign, 7 exponent (bias 63) and 16 mantissa bits."""
    return _small_float(bits, 7, 16)


def binary_exponent(size: Column) -> Column:
    """The largest k with 2^k <= size, for a positive DOUBLE. A logarithm alone is off by one at some powers of two."""
    k = F.floor(F.log2(size))
    return F.when(F.pow(F.lit(2.0), k) > size, k - 1).when(F.pow(F.lit(2.0), k + 1) <= size, k + 1).otherwise(k)


def _to_small_float(value: Column, exponent_bits: int, mantissa_bits: int) -> Column:
    """Truncating conversion; too large becomes infinity, below the least subnormal zero."""
    bias = (1 << (exponent_bits - 1)) - 1
    top = ((1 << exponent_bits) - 1) << mantissa_bits
    v = value.cast("double")
    size = F.abs(v)
    exponent = binary_exponent(size)
    normal = F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * (1 << mantissa_bits)).cast("long") + F.shiftleft((exponent + bias).cast("long"), mantissa_bits)
    tiny = F.floor(size * F.pow(F.lit(2.0), F.lit(bias - 1 + mantissa_bits))).cast("long")
    bits = (
        F.when(F.isnan(v), F.lit(top | 1 << (mantissa_bits - 1)).cast("long"))
        .when(size == 0, F.lit(0).cast("long"))
        .when((size == float("inf")) | (exponent > bias), F.lit(top).cast("long"))
        .when(exponent < 1 - bias, tiny)
        .otherwise(normal)
    )
    negative = (v < 0) | (v.cast("string") == "-0.0")
    return F.when(negative & ~F.isnan(v), bits.bitwiseOR(1 << (exponent_bits + mantissa_bits))).otherwise(bits)


def double_to_float16(value: Column) -> Column:
    return _to_small_float(value, 5, 10)


def double_to_float24(value: Column) -> Column:
    return _to_small_float(value, 7, 16)


def type_size(code: Column) -> Column:
    """Bytes of one value of a field type; 0 for unknown types."""
    out = F.lit(0)
    for c, _, size, _ in FIELD_TYPES:
        out = F.when(code == c, size).otherwise(out)
    return out


def data_size(code: Column, count: Column) -> Column:
    return type_size(code).cast("long") * count.cast("long")


def inline_limit(big: Column) -> Column:
    return F.when(big, 8).otherwise(4)


def is_inline(code: Column, count: Column, big: Column) -> Column:
    return data_size(code, count) <= inline_limit(big)


def external_bytes(code: Column, count: Column, big: Column) -> Column:
    """Bytes that a value takes outside its entry."""
    size = data_size(code, count)
    return F.when(size > inline_limit(big), size).otherwise(F.lit(0).cast("long"))


def written_size(kind: str, values: Column) -> Column:
    """Bytes that a value of this field type takes when written: text gets a final NUL, bytes don't."""
    if kind == "Ascii":
        return F.octet_length(values) + 1
    size = {name: s for _, name, s, _ in FIELD_TYPES}[kind]
    return F.size(values) * size


def rational_to_double(value: Column) -> Column:
    """num / den; null for a zero denominator, which files may hold."""
    return F.when(value["den"] != 0, value["num"] / value["den"])


def ascii_trim(text: Column) -> Column:
    """Without trailing NULs; inner ones stay."""
    return F.rtrim(text, F.lit("\x00"))


def nul_split(text: Column) -> Column:
    """Strings between NULs, empty ones included; what follows the last NUL counts if there is something."""
    parts = F.split(text, "\\x00", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def promote(value: Column, actual: Column, declared: str, also: tuple[str, ...]) -> Column:
    """struct(value, error_code): the value if its type is the declared one or one listed for promotion."""
    fits = actual.isin(*[TYPE_CODE[t] for t in (declared, *also)])
    return F.struct(F.when(fits, value).alias("value"), F.when(~fits, "InvalidTagType").alias("error_code"))


def pixel_type_error(bits: Column, sample_format: Column, wanted: str) -> Column:
    """null if the image holds the wanted pixel type, else the error code."""
    for name, b, f, _ in PIXEL_TYPES:
        if name == wanted:
            return F.when((bits == b) & (sample_format == f), F.lit(None).cast("string")).otherwise("InvalidFormat")
    return F.lit("UnsupportedFeature")


def pixel_type_name(bits: Column, sample_format: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, b, f, _ in PIXEL_TYPES:
        out = F.when((bits == b) & (sample_format == f), name).otherwise(out)
    return out


def date_time(text: Column) -> Column:
    """A DateTime tag as a timestamp; null if it isn't one."""
    return F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss"))
