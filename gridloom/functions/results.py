"""Values or errors as a column: struct(value, error_code), combined without exceptions.

``try_`` forms of built-in functions give nulls; these keep the reason, which a PERMISSIVE scan passes on as a column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import ERROR_CODES


def _code(name: str) -> str:
    if name not in ERROR_CODES:
        raise ValueError(f"unknown error code {name}")
    return name


def ok(value: Column) -> Column:
    return F.struct(value.alias("value"), F.lit(None).cast("string").alias("error_code"))


def err(code: str, like: str) -> Column:
    """An error in place of a value of the SQL type ``like``."""
    return F.struct(F.lit(None).cast(like).alias("value"), F.lit(_code(code)).alias("error_code"))


def ensure(value: Column, condition: Column, code: str) -> Column:
    """The value if the condition holds, else the error; an undecided condition is an error too."""
    holds = F.coalesce(condition, F.lit(False))
    return F.struct(F.when(holds, value).alias("value"), F.when(~holds, _code(code)).alias("error_code"))


def is_ok(result: Column) -> Column:
    return result["error_code"].isNull()


def transform(result: Column, f: Callable[[Column], Column]) -> Column:
    """Apply a function to the value; errors pass through."""
    good = is_ok(result)
    return F.struct(F.when(good, f(result["value"])).alias("value"), result["error_code"].alias("error_code"))


def and_then(result: Column, f: Callable[[Column], Column]) -> Column:
    """Continue with a function that itself gives a result; the first error stays."""
    good, following = is_ok(result), f(result["value"])
    return F.struct(F.when(good, following["value"]).alias("value"), F.when(good, following["error_code"]).otherwise(result["error_code"]).alias("error_code"))


def or_else(result: Column, f: Callable[[Column], Column]) -> Column:
    """On an error, the result of a function of its code."""
    good, other = is_ok(result), f(result["error_code"])
    return F.struct(F.when(good, result["value"]).otherwise(other["value"]).alias("value"), F.when(~good, other["error_code"]).alias("error_code"))


def value_or(result: Column, default: Column) -> Column:
    return F.when(is_ok(result), result["value"]).otherwise(default)


def unwrap(result: Column) -> Column:
    """The value; an error fails the query, as FAILFAST scans do."""
    return F.when(is_ok(result), result["value"]).otherwise(F.raise_error(F.concat(F.lit("raster error: "), result["error_code"])).cast("void"))
