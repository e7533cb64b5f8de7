"""Headline queries, timed. One JSON line: {"metric", "value", "unit", "queries", "sf"}.

"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import numpy as np
from pyspark.sql import SparkSession

from gridloom.plans import queries as raster
from gridloom.sources import datasource, parser, writer

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
TABLES = ("region_read", "region_tile_join", "hdelta_encode", "gap_batches", "greedy_batches", "tag_projection", "packbits_runs", "zstd_roundtrip", "tile_stats")
#: name: (width, height, samples, dtype, compression, predictor)
IMAGES = {
    "512x512x3": (512, 512, 3, "u1", "None", "None"),
    "2048x2048x3_u16_zstd": (2048, 2048, 3, "u2", "ZSTD", "Horizontal"),
    "4096x4096x3": (4096, 4096, 3, "u1", "None", "None"),
}


def gradient(w: int, h: int, n: int, dtype: str) -> np.ndarray:
    y, x = np.mgrid[0:h, 0:w]
    return np.stack([(x + y + c) % 251 for c in range(n)], axis=-1).astype(dtype)[None]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.python.filterPushdown.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = tempfile.mkdtemp(prefix="bench-")
    took: dict[str, float] = {}
    size: dict[str, float] = {}

    def timed(name: str, run) -> None:
        run()  # compiled code and started workers
        began = time.perf_counter()
        run()
        took[name] = round(time.perf_counter() - began, 4)

    try:
        for name in TABLES:
            timed(name, lambda q=raster.QUERIES[name]: q(spark, SF_DIR).write.format("noop").mode("overwrite").save())
        for name, (w, h, n, dtype, comp, pred) in IMAGES.items():
            place = f"{folder}/{name}"
            os.makedirs(place)
            im = writer.Image(gradient(w, h, n, dtype), (1, 128, 128), None, False, comp, pred)
            began = time.perf_counter()
            data = writer.write(im)
            took[f"write_{name}"] = round(time.perf_counter() - began, 4)
            for i in range(4):
                with open(f"{place}/{i}.tif", "wb") as f:
                    f.write(data)
            timed(f"read_{name}_x4", lambda p=place: datasource.read(spark, p, "blocks", error_mode="FAILFAST", split_bytes=str(4 << 20)).write.format("noop").mode("overwrite").save())
            size[f"read_{name}_x4"] = 4 * im.pixels.nbytes / 1e6
            box = parser.Region(w // 4, h // 4, 0, 0, w // 4, h // 4, 1, n)
            timed(f"region_{name}_x4", lambda p=place, b=box: datasource.read_region(spark, p, b).write.format("noop").mode("overwrite").save())
        pages = [writer.Image(gradient(512, 512, 3, "u1"), (1, 128, 128))] * 50
        os.makedirs(f"{folder}/pages")
        with open(f"{folder}/pages/a.tif", "wb") as f:
            f.write(writer.write(pages))
        timed("all_pages_50", lambda: datasource.read(spark, f"{folder}/pages", "images").write.format("noop").mode("overwrite").save())
        timed("page_49_of_50", lambda: datasource.read(spark, f"{folder}/pages", "images", pages="49").write.format("noop").mode("overwrite").save())
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "megabytes": size, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
