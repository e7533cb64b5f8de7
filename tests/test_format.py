"""The file format: golden bytes, round trips over the fixture matrix, directory chains, errors. No Spark."""

import struct

import numpy as np
import pytest

from gridloom.functions import constants as C
from gridloom.functions import predictors
from gridloom.functions.codecs import Codec, codec_of, packbits, register_codec, unpackbits, unzstd, zstd
from gridloom.operators.layout import copy_box, fetch_padded, shape_of, transpose
from gridloom.sources import parser as P
from gridloom.sources import writer as W


def image(dtype, h, w, n=1, d=1, seed=42):
    rng = np.random.default_rng(seed)
    x = rng.random((d, h, w, n))
    return x.astype(dtype) if np.dtype(dtype).kind == "f" else (x * 250).astype(dtype)


def load(data, region=None, page=0, spec="MinBigImage", layout="DHWC", **how):
    src = P.BufferSource(data)
    h = P.header(src)
    d = [x for x in P.pages(src, h) if x.page == page][0]
    v = P.extract(src, h, d.entries, C.SPECS[spec])
    return P.assemble(P.shape(v), region or P.Region(), P.blocks(src, h, v, region, **how), layout)


# (dtype, height, width, samples, tile, rows_per_strip, planar, compression, predictor, order, big)
MATRIX = [
    ("u1", 256, 256, 1, 64, None, False, "None", "None", "<", False),
    ("u2", 128, 128, 1, 32, None, False, "PackBits", "None", "<", False),
    ("f4", 64, 64, 1, 16, None, False, "None", "None", "<", False),
    ("u1", 128, 128, 1, None, 16, False, "None", "None", "<", False),
    ("u1", 128, 128, 3, 32, None, False, "None", "None", "<", False),
    ("u2", 100, 100, 1, 50, None, False, "ZSTD", "Horizontal", ">", False),
    ("f4", 80, 80, 1, 40, None, False, "ZSTD", "FloatingPoint", "<", False),
    ("u2", 64, 64, 4, 32, None, True, "ZSTD", "None", "<", False),
    ("u1", 128, 128, 3, 64, None, False, "PackBits", "None", "<", False),
    ("u1", 120, 120, 1, None, 30, False, "None", "None", "<", False),
    ("u2", 150, 150, 1, 50, None, False, "None", "None", "<", True),
    ("u4", 100, 100, 1, 25, None, False, "ZSTD", "None", ">", True),
    ("u1", 125, 77, 2, None, 30, True, "ZSTD", "Horizontal", ">", True),
    ("f8", 33, 41, 3, 16, None, False, "ZSTD", "FloatingPoint", ">", False),
    ("i8", 33, 41, 1, 16, None, False, "ZSTD", "Horizontal", "<", True),
]


@pytest.mark.parametrize("case", MATRIX, ids=lambda c: "-".join(map(str, c)))
@pytest.mark.parametrize("float_predictor", ["bitdelta", "adobe"])
@pytest.mark.parametrize("pixel_endian", ["file", "native"])
def test_matrix(case, float_predictor, pixel_endian):
    dtype, h, w, n, tile, rows, planar, comp, pred, order, big = case
    x = image(dtype, h, w, n)
    how = {"float_predictor": float_predictor, "pixel_endian": pixel_endian}
    for placement in ("beginning", "end", "inline"):
        im = W.Image(x, (1, tile or 1, tile or 1), rows, planar, comp, pred, **how)
        data = W.write(im, order=order, big=big, ifd_placement=placement)
        assert (load(data, **how) == x).all()
    r = P.Region(5, 7, 0, 0, 20, 11, 1, n)
    assert (load(data, r, **how) == x[:, 7:18, 5:25]).all()
    assert (load(data, r, layout="CDHW", **how) == x[:, 7:18, 5:25].transpose(3, 0, 1, 2)).all()


def test_partial_region_and_volume():
    x = image("u2", 256, 256)
    assert (load(W.write(W.Image(x, (1, 64, 64))), P.Region(100, 100, 0, 0, 64, 64, 1, 1)) == x[:, 100:164, 100:164]).all()
    v = image("u1", 30, 20, 2, 12)
    assert (load(W.write(W.Image(v, (5, 8, 8)))) == v).all()
    assert (load(W.write(W.Image(v, (5, 8, 8))), P.Region(3, 2, 4, 1, 9, 9, 6, 1)) == v[4:10, 2:11, 3:12, 1:2]).all()


def golden():
    """A 4 x 2 8-bit classic file of one strip, laid out by hand."""
    entries = [(256, 3, 1, 4), (257, 3, 1, 2), (258, 3, 1, 8), (259, 3, 1, 1), (273, 4, 1, 8), (277, 3, 1, 1), (278, 4, 1, 2), (279, 4, 1, 8)]
    ifd = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHI", c, t, n) + (struct.pack("<HH", v, 0) if t == 3 else struct.pack("<I", v)) for c, t, n, v in entries)
    return b"II" + struct.pack("<HI", 42, 16) + bytes(range(10, 18)) + ifd + struct.pack("<I", 0)


def test_golden_bytes():
    assert load(golden()).ravel().tolist() == list(range(10, 18))
    src = P.BufferSource(golden())
    assert P.header(src) == P.Header("<", False, 16)
    assert W.header_bytes(16) == golden()[:8]
    assert W.header_bytes(16, ">", True) == b"MM\0+\0\x08\0\0\0\0\0\0\0\0\0\x10"


@pytest.mark.parametrize("data", [b"", b"II", b"XX*\0\0\0\0\0", b"II+\0\x04\0\0\0" + b"\0" * 8, b"II+\0\x08\0\x01\0" + b"\0" * 8, b"MM*\0\0\0\0\x08"])
def test_bad_headers(data):
    with pytest.raises(C.RasterError) as e:
        P.header(P.BufferSource(data))
    assert e.value.code == "InvalidHeader"


def test_reads_at_the_end():
    src = P.BufferSource(b"x" * 100)
    assert len(src.read(90, 50)) == 10
    with pytest.raises(C.RasterError, match="OutOfBounds"):
        src.read(200, 1)
    with pytest.raises(C.RasterError, match="UnexpectedEndOfFile"):
        src.exact(90, 50)


def chain(nexts):
    """Directories of no entries at 8, 20, 32, ... with the given next offsets."""
    return W.header_bytes(8) + b"".join(struct.pack("<HI6x", 0, n) for n in nexts)


def test_directory_chains():
    walk = lambda data: list(P.pages(P.BufferSource(data), P.header(P.BufferSource(data))))
    assert [d.offset for d in walk(chain([20, 32, 0]))] == [8, 20, 32]
    cyclic = walk(chain([20, 8]))
    assert isinstance(cyclic[-1], C.RasterError) and cyclic[-1].code == "InvalidOperation"
    beyond = walk(chain([99999999]))
    assert isinstance(beyond[-1], C.RasterError) and len(beyond) == 2


def test_pages_and_access_by_number():
    ims = [W.Image(image("u1", 10, 10 * (i + 1), seed=i), (1, 16, 16), tags={"PageNumber": [i, 10]}) for i in range(10)]
    data = W.write(ims)
    for i in (0, 4, 9):
        assert (load(data, page=i) == ims[i].pixels).all()
    src = P.BufferSource(data)
    only = list(P.pages(src, P.header(src), {7}))
    assert [d.page for d in only] == [7]


def test_sub_directories():
    b = W.DirectoryBuilder().add_all({"ImageWidth": 5, "SubIFD": [0]})
    size = b.total_size
    b.add_all({"SubIFD": [8 + size]})
    data = W.header_bytes(8) + b.build(8) + W.DirectoryBuilder().add_all({"ImageWidth": 2}).build(8 + size)
    src = P.BufferSource(data)
    got = list(P.pages(src, P.header(src), sub=True))
    assert [(d.page, d.parent) for d in got] == [(0, 0), (0, 8)]


def entries_of(values, order="<", big=False, **extra):
    data = W.header_bytes(16 if big else 8, order, big) + W.DirectoryBuilder(order, big).add_all(values).build(16 if big else 8)
    src = P.BufferSource(data)
    h = P.header(src)
    return src, h, next(iter(P.pages(src, h))).entries


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("big", [False, True])
def test_all_value_types(order, big):
    C.register_tag(65001, "MySigned", "SShort", "list")
    C.register_tag(65002, "MyWide", "SLong8")
    C.register_tag(65003, "MyBytes", "SByte", "list")
    values = {
        "ImageWidth": 70000, "BitsPerSample": [8, 8, 8], "Software": "abc", "XResolution": (72, 1), "WhitePoint": [(1, 2), (3, 4)], "InkNames": ["cyan", "", "red"],
        "SubIFD": [7, 8], "DotRange": b"\1\2\3\4\5\6\7\x08\x09", "Decode": [(-1, 2)], "StoNits": 1.5, "FieldOfViewCotangent": 0.25, "MySigned": [-1, 2],
        "MyWide": -(1 << 40), "MyBytes": [-3, 4], "PageNumber": [1, 10], "RawDataUniqueID": bytes(range(16)),
    }
    src, h, entries = entries_of(values, order, big)
    spec = C.tag_list(" ".join(f"{k}?" for k in values), big)
    assert [e.code for e in entries] == sorted(e.code for e in entries)
    assert P.extract(src, h, entries, spec) == values


def test_schema_rules():
    src, h, entries = entries_of({"ImageWidth": 5, "ImageLength": 6, "Software": "x"})
    get = lambda spec, e=entries, **k: P.extract(src, h, e, C.tag_list(spec), **k)
    assert get("ImageWidth Artist?") == {"ImageWidth": 5, "Artist": None}
    with pytest.raises(C.RasterError, match="InvalidTag"):
        get("ImageWidth Artist")
    wrong = [C.Tag(305, "Software", "Short", optional=True)]
    assert P.extract(src, h, entries, wrong) == {"Software": None}
    with pytest.raises(C.RasterError, match="InvalidTagType"):
        P.extract(src, h, entries, [C.Tag(305, "Software", "Short")])
    assert get("ImageWidth ImageLength", e=entries[::-1]) == {"ImageWidth": 5, "ImageLength": 6}
    assert get("ImageWidth? ImageLength?", e=entries[::-1], assume_sorted=True) == {"ImageWidth": None, "ImageLength": None}
    assert P.extract(src, h, (), C.tag_list("Artist?")) == {"Artist": None}
    with pytest.raises(C.RasterError):
        P.extract(src, h, (), C.tag_list("ImageWidth"))
    with pytest.raises(ValueError, match="ascending"):
        C.tag_list([C.TAGS["ImageLength"], C.TAGS["ImageWidth"]])
    short = entries_of({"YCbCrSubSampling": [2, 2]})
    assert P.extract(*short, [C.Tag(530, "Y", "Short", "4")]) == {"Y": [2, 2, 0, 0]}
    with pytest.raises(C.RasterError, match="OutOfBounds"):
        P.extract(*short, [C.Tag(530, "Y", "Short", "1")])


def test_specs_and_tables():
    assert len({t.code for t in C.TAGS.values() if t.code < 65000}) == 167
    assert len(C.BIG) == 5
    C.check_spec(C.SPECS["MinTiled"], "tiled")
    C.check_spec(C.SPECS["MinStripped"], "stripped")
    with pytest.raises(ValueError):
        C.check_spec(C.SPECS["MinTiled"], "stripped")


def test_packbits_bytes():
    assert packbits(b"\xaa" * 5) == b"\xfc\xaa"
    assert packbits(b"\xff" * 128) == b"\x81\xff"
    assert packbits(b"") == b""
    assert packbits(b"abccd") == b"\x04abccd"
    assert packbits(b"abcccd") == b"\x01ab\xfec\x00d"
    assert unpackbits(b"\x80\x00a", 9) == b"a"
    rng = np.random.default_rng(42)
    for i in range(200):
        data = bytes(np.repeat(rng.integers(0, 4, 50).astype("u1"), rng.integers(1, 6 if i % 2 else 300, 50)))
        assert unpackbits(packbits(data), len(data)) == data
    for bad, room in ((b"\x05ab", 9), (b"\xfe", 9), (b"\x05abcdef", 3), (b"\xf0a", 3)):
        with pytest.raises(C.RasterError, match="InvalidFormat"):
            unpackbits(bad, room)


def test_codec_registry(monkeypatch):
    from gridloom.functions import codecs

    monkeypatch.setattr(codecs, "_CODECS", codecs.codec_registry())
    data = bytes(range(256)) * 9
    assert unzstd(zstd(data), len(data)) == data
    with pytest.raises(C.RasterError, match="InvalidFormat"):
        unzstd(b"not a frame", 10)
    with pytest.raises(C.RasterError, match="UnsupportedFeature"):
        codec_of(5)
    with pytest.raises(ValueError):
        register_codec(Codec((1,), bytes, lambda d, n: d))
    register_codec(Codec((65010,), lambda d: d[::-1], lambda d, n: d[::-1]))
    x = image("u1", 20, 20)
    assert (load(W.write(W.Image(x, (1, 16, 16), compression=65010))) == x).all()


def test_predictor_values():
    d = np.array([[10, 10, 10, 10], [50, 10, 10, 10]], np.uint8).reshape(2, 4, 1)
    assert predictors.undelta(d).reshape(2, 4).tolist() == [[10, 20, 30, 40], [50, 60, 70, 80]]
    for dtype in ("u1", "u2", "u4", "u8", "i1", "i2", "i4", "i8", "f4", "f8", "f2"):
        x = image(dtype, 7, 9, 3)[0]
        assert (predictors.undelta(predictors.delta(x)) == x).all()
    odd = np.array([np.nan, np.inf, -np.inf, 0.0, -0.0], np.float32).reshape(1, 5, 1)
    for mode in ("bitdelta", "adobe"):
        back = predictors.undo(predictors.apply(odd, 3, mode).reshape(1, -1).view(np.float32).reshape(1, 5, 1), 3, mode)
        assert (back.view(np.uint32) == odd.view(np.uint32)).all()
    w = np.array([1, 0xFFFFFF, 0], np.uint32).reshape(1, 3, 1)
    assert (predictors.undelta24(predictors.delta24(w)) == w).all()
    flat = np.arange(24, dtype=np.uint8)
    out = predictors.with_stride(predictors.delta, flat, 4, 3, 8, 1)
    assert out.reshape(3, 8)[:, 4:].tolist() == flat.reshape(3, 8)[:, 4:].tolist() and out.reshape(3, 8)[0, :4].tolist() == [0, 1, 1, 1]
    assert predictors.apply(image("f4", 2, 2)[0], 2) is not None
    with pytest.raises(C.RasterError):
        predictors.delta(np.zeros((2, 0, 1), np.uint8))


def test_layouts_and_padding():
    x = image("u2", 4, 5, 3, 2)
    for a in C.LAYOUTS:
        src = transpose(x, "DHWC", a)
        for b in C.LAYOUTS:
            out = np.zeros(shape_of(b, 3, 6, 7, 3), x.dtype)
            copy_box(out, src, {"z": 1, "y": 2, "x": 2, "c": 0}, {"z": 0, "y": 1, "x": 1, "c": 0}, {"z": 2, "y": 3, "x": 4, "c": 3}, a, b)
            assert (transpose(out, b, "DHWC")[1:3, 2:5, 2:6] == x[:, 1:4, 1:5]).all()
    t = fetch_padded(x, 1, 2, 3, 2, 4, 4)
    assert (t[0, 0, :, 0] == [x[1, 2, 3, 0], x[1, 2, 4, 0], x[1, 2, 4, 0], x[1, 2, 4, 0]]).all() and (t[1] == t[0]).all()
    assert not fetch_padded(x, 9, 0, 0, 1, 2, 2).any()


def test_writer_rules():
    x = image("u1", 20, 20, 3)
    with pytest.raises(C.RasterError, match="InvalidTag"):
        W.write(W.Image(x, tags={"ImageWidth": 3}))
    with pytest.raises(C.RasterError, match="InvalidTag"):
        W.write(W.Image(x, tags={"TileOffsets": [1]}))
    with pytest.raises(C.RasterError, match="InvalidTag"):
        W.write(W.Image(x, tags={"BitsPerSample": [8, 8]}))
    with pytest.raises(C.RasterError, match="UnsupportedFeature"):
        W.write(W.Image(x[:0]))
    with pytest.raises(ValueError):
        W.write(W.Image(x), ifd_placement="middle")
    src = P.BufferSource(W.write(W.Image(x, (1, 16, 16), tags={"Software": "me", "PhotometricInterpretation": 6})))
    h = P.header(src)
    v = P.extract(src, h, next(iter(P.pages(src, h))).entries, C.SPECS["MinImage"])
    assert v["PhotometricInterpretation"] == 6 and v["Predictor"] is None and v["BitsPerSample"] == [8, 8, 8]
    want = load(W.write(W.Image(x, (1, 16, 16)), preset="reading"))
    for preset in W.PRESETS:
        assert (load(W.write(W.Image(x, (1, 16, 16)), preset=preset)) == want).all()
    b = W.DirectoryBuilder().add_all({"Software": "a long enough text", "ImageWidth": 4})
    assert b.total_size == len(b.build(8)) and b.ifd_size == 6 + 24 and b.external_size == 20
    b.clear()
    assert b.ifd_size == 6


def test_missing_tiles_regions_and_errors():
    x = image("u1", 32, 32)
    data = bytearray(W.write(W.Image(x, (1, 16, 16))))
    src = P.BufferSource(bytes(data))
    h = P.header(src)
    v = P.extract(src, h, next(iter(P.pages(src, h))).entries, C.SPECS["MinImage"])
    v["TileByteCounts"] = [0, *v["TileByteCounts"][1:]]
    s = P.shape(v)
    out = P.assemble(s, P.Region(), P.blocks(src, h, v), fill=7)
    assert (out[:, :16, :16] == 7).all() and (out[:, 16:] == x[:, 16:]).all()
    for r in (P.Region(w=0), P.Region(x=30, w=5), P.Region(x=-1), P.Region(c=1)):
        with pytest.raises(C.RasterError, match="OutOfBounds"):
            P.tiles(v, s, r)
    with pytest.raises(C.RasterError, match="OutOfBounds"):
        P.tiles(v | {"TileOffsets": [1]}, s)
    with pytest.raises(C.RasterError, match="InvalidFormat"):
        P.tiles(v | {"TileWidth": 0}, s)
    with pytest.raises(C.RasterError, match="InvalidFormat"):
        P.shape(v | {"BitsPerSample": [8, 8]})
    with pytest.raises(C.RasterError, match="UnsupportedFeature"):
        P.shape(v | {"BitsPerSample": [16], "SampleFormat": 3}).dtype  # noqa: B018
    with pytest.raises(C.RasterError, match="InvalidFormat"):
        P.decode(b"abc", P.Tile(0, 0, 0, 0, 0, 2, 2, 1, 1, 0, 3), np.dtype("u1"))
    groups = P.batches([P.Tile(i, 0, 0, 0, 0, 1, 1, 1, 1, o, n) for i, (o, n) in enumerate([(0, 10), (12, 5), (40, 5)])], 5, 100)
    assert [len(g) for g in groups] == [2, 1]


def test_sources(tmp_path):
    p = tmp_path / "a.bin"
    p.write_bytes(b"0123456789")
    for src in (P.FileSource(str(p)), P.MmapSource(str(p)), P.open_source(f"file://{p}"), P.StoreSource(f"file://{p}")):
        assert src.size == 10 and src.read(8, 9) == b"89"
        src.close()
    with pytest.raises(C.RasterError, match="FileNotFound"):
        P.FileSource(str(tmp_path / "none"))


def test_own_sources_and_orders(monkeypatch):
    monkeypatch.setattr(P, "_OPENERS", {})
    P.register_source("mem:", lambda path: P.BufferSource(golden()))
    assert P.header(P.open_source("mem:x")).first == 16
    x = image("u1", 40, 40)
    data = W.write(W.Image(x, (1, 16, 16)), tile_order=lambda c: -c.idx)
    assert (load(data) == x).all()
