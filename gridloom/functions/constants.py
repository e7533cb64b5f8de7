"""Fixed values of the file format: types, codes, names and ready tag lists, as tables and as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# --- Fixed values: field types as (code, name, bytes, struct letter) -------------------------------------------------
FIELD_TYPES = (
    (1, "Byte", 1, "B"),
    (2, "Ascii", 1, "s"),
    (3, "Short", 2, "H"),
    (4, "Long", 4, "I"),
    (5, "Rational", 8, "II"),
    (6, "SByte", 1, "b"),
    (7, "Undefined", 1, "B"),
    (8, "SShort", 2, "h"),
    (9, "SLong", 4, "i"),
    (10, "SRational", 8, "ii"),
    (11, "Float", 4, "f"),
    (12, "Double", 8, "d"),
    (13, "IFD", 4, "I"),
    (16, "Long8", 8, "Q"),
    (17, "SLong8", 8, "q"),
    (18, "IFD8", 8, "Q"),
)
# --- Fixed values: enumerations --------------------------------------------------------------------------------------
COMPRESSION = {
    "None": 1, "CCITT_RLE": 2, "CCITT_Fax3": 3, "CCITT_Fax4": 4, "LZW": 5, "JPEG_Old": 6, "JPEG": 7, "Deflate_Adobe": 8,
    "Deflate": 32946, "PackBits": 32773, "ZSTD": 50000, "ZSTD_Alt": 34926,
}
SAMPLE_FORMAT = {"UnsignedInt": 1, "SignedInt": 2, "IEEEFloat": 3, "Undefined": 4}
PHOTOMETRIC = {"MinIsWhite": 0, "MinIsBlack": 1, "RGB": 2, "Palette": 3, "Mask": 4, "CMYK": 5, "YCbCr": 6, "CIELab": 8}
PREDICTOR = {"None": 1, "Horizontal": 2, "FloatingPoint": 3}
PLANAR = {"Chunky": 1, "Planar": 2}
LAYOUTS = ("DHWC", "DCHW", "CDHW")
ERROR_CODES = (
    "Success", "FileNotFound", "ReadError", "WriteError", "InvalidHeader", "InvalidFormat", "InvalidTag", "InvalidOperation",
    "UnsupportedFeature", "OutOfBounds", "MemoryError", "UnexpectedEndOfFile", "InvalidTagType", "InvalidPageIndex",
    "CompressionError", "Unknown",
)
# --- Fixed values: pixel types as (name, bits, sample format, numpy letter) -----------------------------------------
PIXEL_TYPES = (
    ("u8", 8, 1, "u1"), ("u16", 16, 1, "u2"), ("u32", 32, 1, "u4"), ("u64", 64, 1, "u8"),
    ("i8", 8, 2, "i1"), ("i16", 16, 2, "i2"), ("i32", 32, 2, "i4"), ("i64", 64, 2, "i8"),
    ("f32", 32, 3, "f4"), ("f64", 64, 3, "f8"),
)
# --- Fixed values: tags as "code name type shape other-accepted-types" ----------------------------------------------
# shape: one value, list, a fixed count, text, or texts (several strings)
TAG_TABLE = """
254 NewSubfileType Long one
255 SubfileType Short one
256 ImageWidth Long one Short
257 ImageLength Long one Short
258 BitsPerSample Short list
259 Compression Short one
262 PhotometricInterpretation Short one
263 Threshholding Short one
264 CellWidth Short one
265 CellLength Short one
266 FillOrder Short one
269 DocumentName Ascii text
270 ImageDescription Ascii text
271 Make Ascii text
272 Model Ascii text
273 StripOffsets Long list Short
274 Orientation Short one
277 SamplesPerPixel Short one
278 RowsPerStrip Long one Short
279 StripByteCounts Long list Short
280 MinSampleValue Short list
281 MaxSampleValue Short list
282 XResolution Rational one
283 YResolution Rational one
284 PlanarConfiguration Short one
285 PageName Ascii text
286 XPosition Rational one
287 YPosition Rational one
288 FreeOffsets Long list
289 FreeByteCounts Long list
290 GrayResponseUnit Short one
291 GrayResponseCurve Short list
292 T4Options Long one
293 T6Options Long one
296 ResolutionUnit Short one
297 PageNumber Short 2
300 ColorResponseUnit Short one
301 TransferFunction Short list
305 Software Ascii text
306 DateTime Ascii text
315 Artist Ascii text
316 HostComputer Ascii text
317 Predictor Short one
318 WhitePoint Rational 2
319 PrimaryChromaticities Rational 6
320 ColorMap Short list
321 HalftoneHints Short 2
322 TileWidth Long one Short
323 TileLength Long one Short
324 TileOffsets Long list Short
325 TileByteCounts Long list Short
326 BadFaxLines Long one
327 CleanFaxData Short one
328 ConsecutiveBadFaxLines Long one
330 SubIFD IFD list Short/Long
332 InkSet Short one
333 InkNames Ascii texts
334 NumberOfInks Short one
336 DotRange Byte list
337 TargetPrinter Ascii text
338 ExtraSamples Byte list
339 SampleFormat Short one
340 SMinSampleValue Undefined list
341 SMaxSampleValue Undefined list
342 TransferRange Short 6
343 ClipPath Byte list
344 XClipPathUnits Long one
345 YClipPathUnits Long one
346 Indexed Short one
347 JPEGTables Undefined list
400 GlobalParametersIFD Long one
401 ProfileType Long one
402 FaxProfile Short one
403 CodingMethods Long one
404 VersionYear Byte 4
405 ModeNumber Byte one
433 Decode SRational list
434 ImageBaseColor Short list
435 T82Options Long one
512 JPEGProc Short one
513 JPEGInterchangeFormat Long one
514 JPEGInterchangeFormatLength Long one
515 JPEGRestartInterval Short one
517 JPEGLosslessPredictors Short list
518 JPEGPointTransforms Short list
519 JPEGQTables Long list
520 JPEGDCTables Long list
521 JPEGACTables Long list
529 YCbCrCoefficients Rational 3
530 YCbCrSubSampling Short 2
531 YCbCrPositioning Short one
532 ReferenceBlackWhite Long list
559 StripRowCounts Long list
700 XMLPacket Byte list
32995 Matteing Short one
32996 DataType Short one
32997 ImageDepth Long one Short
32998 TileDepth Long one Short
33300 ImageFullWidth Long one
33301 ImageFullLength Long one
33302 TextureFormat Ascii text
33303 TextureWrapModes Ascii text
33304 FieldOfViewCotangent Float one
33305 MatrixWorldToScreen Float list
33306 MatrixWorldToCamera Float list
33432 Copyright Ascii text
33723 RichTIFFIPTC Undefined list
34377 Photoshop Byte list
34665 EXIFIFDOffset Long one
34675 ICCProfile Undefined list
34732 ImageLayer Long list
34853 GPSIFDOffset Long one
34908 FaxRecvParams Long one
34909 FaxSubAddress Ascii text
34910 FaxRecvTime Long one
34911 FaxDcs Ascii text
37439 StoNits Double one
37724 PhotoshopDocDataBlock Byte list
40965 InteroperabilityIFDOffset Long one
50706 DNGVersion Byte 4
50707 DNGBackwardVersion Byte 4
50708 UniqueCameraModel Ascii text
50709 LocalizedCameraModel Ascii text
50710 CFAPlaneColor Byte list
50711 CFALayout Short one
50712 LinearizationTable Short list
50713 BlackLevelRepeatDim Short 2
50714 BlackLevel Rational list
50715 BlackLevelDeltaH SRational list
50716 BlackLevelDeltaV SRational list
50717 WhiteLevel Long list
50718 DefaultScale Rational 2
50719 DefaultCropOrigin Rational 2
50720 DefaultCropSize Rational 2
50721 ColorMatrix1 SRational list
50722 ColorMatrix2 SRational list
50723 CameraCalibration1 SRational list
50724 CameraCalibration2 SRational list
50725 ReductionMatrix1 SRational list
50726 ReductionMatrix2 SRational list
50727 AnalogBalance Rational list
50728 AsShotNeutral Rational list
50729 AsShotWhiteXY Rational 2
50730 BaselineExposure SRational one
50731 BaselineNoise Rational one
50732 BaselineSharpness Rational one
50733 BayerGreenSplit Long one
50734 LinearResponseLimit Rational one
50735 CameraSerialNumber Ascii text
50736 LensInfo Rational 4
50737 ChromaBlurRadius Rational one
50738 AntiAliasStrength Rational one
50739 ShadowScale Rational one
50740 DNGPrivateData Byte list
50741 MakerNoteSafety Short one
50778 CalibrationIlluminant1 Short one
50779 CalibrationIlluminant2 Short one
50780 BestQualityScale Rational one
50781 RawDataUniqueID Byte 16
50827 OriginalRawFileName Ascii text
50828 OriginalRawFileData Undefined list
50829 ActiveArea Long 4
50830 MaskedAreas Long list
50831 AsShotICCProfile Undefined list
50832 AsShotPreProfileMatrix SRational list
50833 CurrentICCProfile Undefined list
50834 CurrentPreProfileMatrix SRational list
273 StripOffsetsBig Long8 list Short/Long
279 StripByteCountsBig Long8 list Short/Long
324 TileOffsetsBig Long8 list Short/Long
325 TileByteCountsBig Long8 list Short/Long
330 SubIFDBig IFD8 list Short/Long/IFD/Long8
"""
# --- Fixed values: ready tag lists; a question mark makes a tag optional ---------------------------------------------
_STRIPPED = "ImageWidth ImageLength BitsPerSample Compression StripOffsets SamplesPerPixel? RowsPerStrip StripByteCounts Predictor? SampleFormat?"
_TILED = "ImageWidth ImageLength BitsPerSample Compression SamplesPerPixel? Predictor? TileWidth TileLength TileOffsets TileByteCounts SampleFormat?"
_IMAGE = (
    "ImageWidth ImageLength BitsPerSample Compression PhotometricInterpretation? FillOrder? StripOffsets? Orientation? "
    "SamplesPerPixel? RowsPerStrip? StripByteCounts? MinSampleValue? MaxSampleValue? XResolution? YResolution? "
    "PlanarConfiguration? ResolutionUnit? TransferFunction? Predictor? WhitePoint? PrimaryChromaticities? ColorMap? TileWidth? "
    "TileLength? TileOffsets? TileByteCounts? SubIFD? ExtraSamples? SampleFormat? SMinSampleValue? SMaxSampleValue? JPEGTables? "
    "JPEGProc? JPEGInterchangeFormat? JPEGInterchangeFormatLength? JPEGRestartInterval? JPEGLosslessPredictors? "
    "JPEGPointTransforms? JPEGQTables? JPEGDCTables? JPEGACTables? YCbCrCoefficients? YCbCrSubSampling? YCbCrPositioning? "
    "ReferenceBlackWhite? ImageDepth? TileDepth? ICCProfile?"
)

TYPE_NAME = {code: name for code, name, _, _ in FIELD_TYPES}
TYPE_CODE = {name: code for code, name, _, _ in FIELD_TYPES}
TYPE_SIZE = {code: size for code, _, size, _ in FIELD_TYPES}
TYPE_LETTER = {code: letter for code, _, _, letter in FIELD_TYPES}
PIXEL_DTYPE = {(bits, fmt): letter for _, bits, fmt, letter in PIXEL_TYPES}

_RATIONAL = T.StructType([T.StructField("num", T.LongType()), T.StructField("den", T.LongType())])
_SPARK = {
    "Byte": T.ShortType(), "Ascii": T.StringType(), "Short": T.IntegerType(), "Long": T.LongType(), "Rational": _RATIONAL,
    "SByte": T.ByteType(), "Undefined": T.ShortType(), "SShort": T.ShortType(), "SLong": T.IntegerType(), "SRational": _RATIONAL,
    "Float": T.FloatType(), "Double": T.DoubleType(), "IFD": T.LongType(), "Long8": T.LongType(), "SLong8": T.LongType(),
    "IFD8": T.LongType(),
}


@dataclass(frozen=True)
class Tag:
    """One tag of a schema: ``shape`` as in ``TAG_TABLE``; ``also`` names types that are promoted to ``type``."""

    code: int
    name: str
    type: str
    shape: str = "one"
    also: tuple[str, ...] = ()
    optional: bool = False

    @property
    def count(self) -> int | None:
        return int(self.shape) if self.shape.isdigit() else None

    @property
    def spark_type(self) -> T.DataType:
        if self.shape == "text":
            return T.StringType()
        if self.shape == "texts":
            return T.ArrayType(T.StringType())
        if self.shape == "one":
            return _SPARK[self.type]
        return T.BinaryType() if self.type in ("Byte", "Undefined") else T.ArrayType(_SPARK[self.type])


def _parse(line: str) -> Tag:
    code, name, kind, shape, *also = line.split()
    return Tag(int(code), name, kind, shape, tuple(also[0].split("/")) if also else ())


TAGS: dict[str, Tag] = {t.name: t for t in map(_parse, TAG_TABLE.split("\n")[1:-1])}
BIG = {name.removesuffix("Big"): tag for name, tag in TAGS.items() if name.endswith("Big") and name.removesuffix("Big") in TAGS}


def register_tag(code: int, name: str, type: str, shape: str = "one", also: tuple[str, ...] = (), optional: bool = False) -> Tag:
    """Add a tag of one's own, to be used in ``tag_list`` by name."""
    if type not in TYPE_CODE:
        raise ValueError(f"unknown field type {type}")
    TAGS[name] = Tag(code, name, type, shape, also, optional)
    return TAGS[name]


def tag_list(spec: str | list[str] | list[Tag], big: bool = False) -> list[Tag]:
    """A schema: tags by name (``?`` = optional) or as ``Tag``; codes must rise strictly. ``big``: 64-bit offsets."""
    out = []
    for x in spec.split() if isinstance(spec, str) else spec:
        if isinstance(x, Tag):
            out.append(x)
            continue
        name = x.rstrip("?")
        tag = replace(BIG[name], name=name) if big and name in BIG else TAGS[name]
        out.append(replace(tag, optional=tag.optional or x.endswith("?")))
    out = out if not isinstance(spec, str) else sorted(out, key=lambda t: t.code)
    if any(a.code >= b.code for a, b in zip(out, out[1:], strict=False)):
        raise ValueError("tag codes must be strictly ascending")
    return out


SPECS = {
    "MinStripped": tag_list(_STRIPPED), "MinTiled": tag_list(_TILED), "MinBigStripped": tag_list(_STRIPPED, True),
    "MinBigTiled": tag_list(_TILED, True), "MinImage": tag_list(_IMAGE), "MinBigImage": tag_list(_IMAGE, True),
}


def spec_schema(spec: list[Tag]) -> T.StructType:
    return T.StructType([T.StructField(t.name, t.spark_type, True) for t in spec])


def check_spec(spec: list[Tag], kind: str) -> None:
    """Raise unless the schema describes an image of this kind: "image", "stripped" or "tiled"."""
    need = {"image": "ImageWidth ImageLength BitsPerSample", "stripped": "ImageWidth ImageLength StripOffsets StripByteCounts RowsPerStrip", "tiled": "ImageWidth ImageLength TileWidth TileLength TileOffsets TileByteCounts"}[kind]
    missing = set(need.split()) - {t.name for t in spec}
    if missing:
        raise ValueError(f"a {kind} schema needs {', '.join(sorted(missing))}")


def tag_names(spark: SparkSession) -> DataFrame:
    """(code, name, type, shape) of all known tags."""
    return spark.createDataFrame([(t.code, t.name, t.type, t.shape) for t in TAGS.values()], "code int, name string, type string, shape string")


def enum_names(spark: SparkSession) -> DataFrame:
    """(family, code, name) of the enumerations."""
    families = {"Compression": COMPRESSION, "SampleFormat": SAMPLE_FORMAT, "Photometric": PHOTOMETRIC, "Predictor": PREDICTOR, "Planar": PLANAR}
    return spark.createDataFrame([(f, c, n) for f, e in families.items() for n, c in e.items()], "family string, code int, name string")


class RasterError(Exception):
    """An error with one of ``ERROR_CODES``."""

    def __init__(self, code: str, message: str = "") -> None:
        if code not in ERROR_CODES:
            raise ValueError(f"unknown error code {code}")
        super().__init__(f"{code}: {message}" if message else code)
        self.code, self.message = code, message

    def __reduce__(self):
        return RasterError, (self.code, self.message)
