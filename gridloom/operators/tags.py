"""Tag relations: projection onto a schema, image shapes, page chains, file layout of tag directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import Tag


def project(tags: DataFrame, by: list[str], spec: list[Tag], value: str = "value", code: str = "code", order: str = "pos") -> DataFrame:
    """One row per directory with a column per tag of the schema, plus ``error_code``.

    Conditional aggregation, so only listed codes leave the partial step. Of repeated codes the first entry counts. A
    required tag that is missing gives InvalidTag; an optional one, null.
    """
    first = [F.min_by(F.col(value), F.when(F.col(code) == t.code, F.col(order))).alias(t.name) for t in spec]
    wide = tags.groupBy(*by).agg(*first)
    return wide.withColumn("error_code", missing_error(spec))


def missing_error(spec: list[Tag]) -> Column:
    lack = F.lit(False)
    for t in spec:
        if not t.optional:
            lack = lack | F.col(t.name).isNull()
    return F.when(lack, "InvalidTag")


def spec_left_join(spec: DataFrame, tags: DataFrame) -> DataFrame:
    """Schema rows (code, ...) with the directory's entries or nulls. The schema is a fixed table of at most some hundred rows."""
    return F.broadcast(spec).join(tags, "code", "left")


def defined_count(columns: list[str]) -> Column:
    """How many of the tags are present."""
    return sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))


def or_default(name: str, default: object) -> Column:
    return F.coalesce(F.col(name), F.lit(default))


def image_shape(tags: DataFrame) -> DataFrame:
    """Shape columns from projected tags: defaults, equal bits, and the rules' error codes.

    Needs ImageWidth and ImageLength; uses BitsPerSample (array), SamplesPerPixel, SampleFormat, PlanarConfiguration,
    ImageDepth where present.
    """
    has = set(tags.columns)
    get = lambda n, d: or_default(n, d) if n in has else F.lit(d)
    bits = F.col("BitsPerSample") if "BitsPerSample" in has else F.array(F.lit(1))
    samples = get("SamplesPerPixel", 1)
    bad = (
        F.when(F.col("ImageWidth").isNull() | F.col("ImageLength").isNull(), "InvalidTag")
        .when((F.size(bits) != samples) | (F.size(F.array_distinct(bits)) != 1), "InvalidFormat")
    )
    return tags.withColumns(
        {
            "width": F.col("ImageWidth"), "height": F.col("ImageLength"), "depth": get("ImageDepth", 1), "samples": samples,
            "bits": F.get(bits, F.lit(0)), "sample_format": get("SampleFormat", 1), "planar": get("PlanarConfiguration", 1) == 2,
            "shape_error": bad,
        }
    )


def sort_entries(entries: Column) -> Column:
    """Entries (structs with the code first) in ascending code order."""
    return F.array_sort(entries)


def is_sorted(codes: Column) -> Column:
    return codes == F.array_sort(codes)


def directory_size(n_tags: Column, big: Column) -> Column:
    """Bytes of a directory without external values: count, entries, next offset."""
    return F.when(big, 8 + n_tags * 20 + 8).otherwise(2 + n_tags * 12 + 4)


def directory_layout(n_tags: Column, external: Column, data: Column, big: Column, placement: str, preferred: Column | None = None) -> dict[str, Column]:
    """Offsets of directory, external values and image data for a placement: beginning, end or inline."""
    header = F.when(big, 16).otherwise(8).cast("long")
    size = directory_size(n_tags, big).cast("long")
    if placement == "beginning":
        ifd, first = header, header + size + external
    elif placement == "end":
        ifd, first = header + data, header
    elif placement == "inline":
        given = F.lit(0) if preferred is None else preferred
        ifd = F.when(given > 0, given.cast("long")).otherwise(header + data)
        first = header
    else:
        raise ValueError(f"unknown placement {placement}")
    return {"ifd_offset": ifd, "external_offset": ifd + size, "data_offset": first, "ifd_size": size}


def chain(links: DataFrame, first: int, max_steps: int = 10_000) -> DataFrame:
    """(page, offset) along next offsets (offset, next) from ``first``; ends at 0, at an unknown offset, or at a cycle.

    A file's chain is read inside one task by the scan; this is the relational form for small link tables, as one
    recursive query. ``max_steps`` bounds a broken chain.
    """
    links.createOrReplaceTempView("_gridloom_links")
    return links.sparkSession.sql(
        f"""
        WITH RECURSIVE walk(page, offset, next, seen) MAX RECURSION LEVEL {max_steps} AS (
            SELECT 0, offset, next, array(offset) FROM _gridloom_links WHERE offset = {int(first)}
            UNION ALL
            SELECT page + 1, l.offset, l.next, concat(seen, array(l.offset))
            FROM walk JOIN _gridloom_links l ON l.offset = walk.next WHERE NOT array_contains(seen, l.offset)
        )
        SELECT page, offset FROM walk"""
    )
