"""The data source, the sink, region reads, BINARY scans and the stream, against arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import binary
from gridloom.operators import spans
from gridloom.sources import datasource, parser, scan, writer
from gridloom.streaming import ingest


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(1)
    return [rng.integers(0, 250, (1, 50, 70, 3)).astype("u2") for _ in range(3)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory, images):
    out = tmp_path_factory.mktemp("ras")
    for i, x in enumerate(images):
        first = writer.Image(x, (1, 16, 16), None, i == 1, "ZSTD", "Horizontal", {"Software": "me", "XResolution": (72, 1)})
        (out / f"a{i}.{'tif' if i else 'TIFF'}").write_bytes(writer.write([first, writer.Image(x[:, :9], rows_per_strip=4)], order="<>"[i % 2], big=i == 2))
    (out / "note.txt").write_text("no image")
    return str(out)


def test_relations(spark, folder):
    files = datasource.read(spark, folder, "files").orderBy("path").collect()
    assert [(f.endian, f.format, f.first_ifd) for f in files] == [("little", "classic", 8), ("big", "classic", 8), ("little", "BigTIFF", 16)]
    assert datasource.read(spark, folder, "ifds").count() == 6
    assert datasource.read(spark, folder, "ifds").where("page = 1").count() == 3
    tags = datasource.read(spark, folder, "tags").where("code = 305").collect()
    assert [t.text for t in tags] == ["me"] * 3 and {t.name for t in tags} == {"Software"}
    shapes = datasource.read(spark, folder, "images", pages="0").select("width", "height", "samples", "pixel_type", "XResolution.num").collect()
    assert {tuple(s) for s in shapes} == {(70, 50, 3, "u16", 72)}
    assert datasource.read(spark, folder, "images", spec="ImageWidth,Artist?").columns[4:6] == ["ImageWidth", "Artist"]


@pytest.mark.parametrize("pushdown", ["true", "false"])
def test_pixels_with_and_without_pushdown(spark, folder, images, pushdown):
    q = datasource.read(spark, folder, "pixels", error_mode="FAILFAST", split_bytes="20000", pushdown=pushdown).where("page = 0 and plane = 1 and x >= 10 and x < 20 and y < 5")
    assert q.agg(F.sum("v")).first()[0] == sum(float(x[0, :5, 10:20, 1].sum()) for x in images)


def test_regions(spark, folder, images):
    r = datasource.read_region(spark, folder, parser.Region(5, 6, 0, 0, 30, 20, 1, 3)).orderBy("path").collect()
    for row, x in zip(r, images, strict=True):
        assert (np.frombuffer(row.data, "<u2").reshape(row.d, row.h, row.w, row.n) == x[:, 6:26, 5:35]).all()
    full = datasource.read_region(spark, folder, layout="CDHW").orderBy("path").collect()
    for row, x in zip(full, images, strict=True):
        assert (np.frombuffer(row.data, "<u2").reshape(row.n, row.d, row.h, row.w) == x.transpose(3, 0, 1, 2)).all()


def test_sink(spark, images, tmp_path):
    x = images[0]
    df = spark.createDataFrame([("w.tif", 1, 50, 70, 3, "u16", x.tobytes())], "name string, depth int, height int, width int, samples int, pixel_type string, data binary")
    datasource.register(spark)
    df.write.format("raster").options(compression="PackBits", tile="1,32,32", endian="big", format="BigTIFF").mode("append").save(str(tmp_path))
    row = datasource.read_region(spark, str(tmp_path)).first()
    assert (np.frombuffer(row.data, "<u2").reshape(x.shape) == x).all()


def test_parallel_encoding_equals_the_writer(spark, folder, images):
    blocks = datasource.read(spark, folder + "/a2.tif", "blocks", pages="0", error_mode="FAILFAST")
    got = {r.idx: bytes(r.encoded) for r in datasource.encode_tiles(blocks, "ZSTD", "Horizontal").collect()}
    want = writer.encode_image(writer.Image(images[2], (1, 16, 16), None, False, "ZSTD", "Horizontal"))
    assert got == {c.idx: c.data for c in want}


def test_errors_as_rows_or_raised(spark, tmp_path):
    (tmp_path / "bad.tif").write_bytes(b"not a raster file")
    (tmp_path / "cut.tif").write_bytes(writer.header_bytes(400))
    got = {r.path.rsplit("/")[-1]: r.error_code for r in datasource.read(spark, str(tmp_path), "ifds").collect()}
    assert got == {"bad.tif": "InvalidHeader", "cut.tif": "OutOfBounds"}
    assert datasource.read(spark, str(tmp_path), "files").where("error_code is not null").count() == 1
    with pytest.raises(Exception, match="InvalidHeader"):
        datasource.read(spark, str(tmp_path), "ifds", error_mode="FAILFAST").collect()
    assert datasource.read(spark, str(tmp_path / "none"), "files").first().error_code == "FileNotFound"


def test_binary_scan_and_stream(spark, folder, tmp_path):
    files = spark.read.format("binaryFile").load(folder + "/a*")
    assert scan.scan_binary(files, "ifds").count() == 6
    target, state = str(tmp_path / "out"), str(tmp_path / "state")
    ingest.run_once(ingest.stream_files(spark, folder), target, state)
    assert spark.read.parquet(target).count() == 6
    ingest.run_once(ingest.stream_files(spark, folder), target, state)
    assert spark.read.parquet(target).count() == 6


def test_small_floats(spark):
    values = [0.0, 1.0, -2.5, 65504.0, 1e6, 5.9604644775390625e-08, float("inf"), float("-inf"), 1 / 3]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", binary.double_to_float16(F.col("v")).alias("b"), binary.double_to_float24(F.col("v")).alias("c"))
    df = df.select("v", "b", binary.float24_to_double(F.col("c")).alias("w"))
    for r in df.collect():
        want = np.float64(r.v).astype(np.float32)
        if abs(r.v) < 65505 or np.isinf(r.v):
            half = np.array(r.v, np.float16)
            if abs(float(half)) > abs(r.v):  # numpy rounds, this truncates
                half = np.nextafter(half, np.float16(0))
            assert int(half.view(np.uint16)) == r.b
        assert r.w == want or abs(r.w - r.v) <= abs(r.v) * 2**-16


def test_greedy_equals_python(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for f in range(5):
        at, ts = 0, []
        for i in range(40):
            at += int(rng.integers(-20, 200))
            at = max(at, 0)
            n = int(rng.integers(1, 90))
            rows.append((f, i, at, n))
            ts.append(parser.Tile(i, 0, 0, 0, 0, 1, 1, 1, 1, at, n))
        ts.sort(key=lambda t: (t.offset, t.offset + t.length))
        want[f] = [len(g) for g in parser.batches(ts, 60, 500)]
    df = spark.createDataFrame(rows, "file int, id int, offset long, length long")
    got: dict = {}
    for r in spans.greedy_batches(df, ["file"], 60, 500).orderBy("file", "batch").collect():
        got.setdefault(r.file, []).append(r.n)
    assert got == want


def test_greedy_batches_of_a_million_spans(spark):
    n = 1_000_000
    s = spark.range(n).select(F.lit("a").alias("file"), (F.col("id") * 10).alias("offset"), F.lit(8).alias("length"))
    out = spans.greedy_batches(s, ["file"], 5, 1000).agg(F.count(F.lit(1)).alias("batches"), F.sum("n").alias("n"), F.max("n").alias("most")).first()
    assert (out.batches, out.n, out.most) == (n // 100, n, 100)


def test_sink_takes_a_uri(spark, images, tmp_path):
    x = images[0]
    df = spark.createDataFrame([("w.tif", 1, 50, 70, 3, "u16", x.tobytes())], "name string, depth int, height int, width int, samples int, pixel_type string, data binary")
    datasource.register(spark)
    df.write.format("raster").options(tile="1,32,32").mode("append").save(f"file://{tmp_path}/deep/er")
    back = datasource.read_region(spark, f"file://{tmp_path}/deep/er").first()
    assert back.data == x.tobytes()
    assert [p.name for p in (tmp_path / "deep" / "er").iterdir()] == ["w.tif"]
