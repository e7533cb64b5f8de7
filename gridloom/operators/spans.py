"""Byte spans: read batching, running offsets, orders, and run statistics."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_GAP = 64 * 1024
MAX_BATCH = 4 * 1024 * 1024


def offsets(length: Column, order: list[str], by: list[str] | None = None, start: int | Column = 0) -> Column:
    """File offset of each piece in write order: the exclusive running sum of lengths. ``by`` names the file."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    base = F.lit(start).cast("long") if isinstance(start, int) else start
    return base + F.coalesce(F.sum(length.cast("long")).over(w), F.lit(0).cast("long"))


def write_order(policy: str) -> list[str]:
    """Columns that a write policy sorts by; "on_demand" leaves the arrival order, here the index, alone."""
    orders = {"image": ["z", "plane", "y", "x"], "sequential": ["idx"], "on_demand": ["idx"]}
    if policy not in orders:
        raise ValueError(f"unknown tile order {policy}")
    return orders[policy]


def gap_batches(spans: DataFrame, by: list[str], max_gap: int = MAX_GAP) -> DataFrame:
    """Add ``batch``: spans of a file whose gap to all before is at most ``max_gap`` share one. Gaps-and-islands."""
    w = Window.partitionBy(*by).orderBy("offset", "id")
    reach = F.max(F.col("offset") + F.col("length")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    far = F.when(F.col("offset") - reach > max_gap, 1).otherwise(0)
    return spans.withColumn("_far", far).withColumn("batch", F.sum("_far").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_far")


def greedy_batches(spans: DataFrame, by: list[str], max_gap: int = MAX_GAP, max_batch: int = MAX_BATCH) -> DataFrame:
    """(by..., batch, offset, end, n): merge spans in offset order while the gap and the batch stay within bounds.

    Each batch depends on where the one before it ended, so spans of a file go in order through one task, as a stream of Arrow
    batches that holds no more than the open batch. Overlapping spans have no gap; a batch ends at the farthest end of
    its spans.
    """
    end = (F.col("offset") + F.col("length")).cast("long")
    key = F.struct(*by).alias("key")
    ordered = spans.select(key, F.col("offset").cast("long").alias("o"), end.alias("e")).repartition("key").sortWithinPartitions("key", "o", "e")
    kind = ordered.schema["key"].dataType.simpleString()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_, number = None, None, 0
        schema = None
        for b in batches:
            keys, o, e = b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()
            schema = schema or pa.schema([("key", keys.type), ("batch", pa.int64()), ("offset", pa.int64()), ("end", pa.int64()), ("n", pa.int64())])
            out = []
            for k, s, t in zip(keys.to_pylist(), o, e, strict=True):
                if k == now and s - open_[1] <= max_gap and max(open_[1], t) - open_[0] <= max_batch:
                    open_ = (open_[0], max(open_[1], t), open_[2] + 1)
                    continue
                if open_:
                    out.append({"key": now, "batch": number, "offset": open_[0], "end": open_[1], "n": open_[2]})
                number = number + 1 if k == now else 0
                now, open_ = k, (s, t, 1)
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if open_:
            yield pa.RecordBatch.from_pylist([{"key": now, "batch": number, "offset": open_[0], "end": open_[1], "n": open_[2]}], schema=schema)

    out = ordered.mapInArrow(merge, f"key {kind}, batch long, offset long, end long, n long")
    return out.select("key.*", "batch", "offset", "end", "n")


def packbits_runs(pixels: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """(by..., run, start, v, n): runs of equal values along an order."""
    w = Window.partitionBy(*by).orderBy(order)
    fresh = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    run = pixels.withColumn("_new", fresh).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return run.groupBy(*by, "run").agg(F.min(order).alias("start"), F.first(value).alias("v"), F.count(F.lit(1)).alias("n"))


def run_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, total, mean, sample deviation, median (mean of the middle two), least and greatest."""
    v = F.col(value)
    return df.groupBy(*by).agg(
        F.count(v).alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("stddev"),
        F.percentile(v, F.lit(0.5)).alias("median"), F.min(v).alias("least"), F.max(v).alias("greatest"),
    )


def throughput(bytes_: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, bytes_ / seconds / 1_000_000)


def first_error(df: DataFrame, by: list[str], code: str = "error_code", order: str = "idx") -> DataFrame:
    """The error of the least index of each group, or null; the same on every run."""
    failed = F.col(code).isNotNull()
    return df.groupBy(*by).agg(F.min_by(code, F.when(failed, F.col(order))).alias("error_code"), F.min(F.when(failed, F.col(order))).alias("error_at"))
