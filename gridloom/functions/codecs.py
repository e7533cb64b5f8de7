"""Compression codecs and their registry. A codec is a pair of functions on bytes; users may register their own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import COMPRESSION, RasterError


@dataclass(frozen=True)
class Codec:
    """``compress(data) -> bytes``; ``decompress(data, room) -> bytes`` of at most ``room`` bytes."""

    codes: tuple[int, ...]
    compress: Callable[[bytes], bytes]
    decompress: Callable[[bytes, int], bytes]


def _copy(data: bytes, room: int) -> bytes:
    if len(data) > room:
        raise RasterError("OutOfBounds", "output buffer too small")
    return bytes(data)


def packbits(data: bytes) -> bytes:
    """Runs of 2 to 128 equal bytes as a count and the byte; else literals, which end where 3 equal bytes begin."""
    x = np.frombuffer(data, np.uint8)
    if not len(x):
        return b""
    starts = np.concatenate([[0], np.flatnonzero(np.diff(x)) + 1])
    lengths = np.diff(np.concatenate([starts, [len(x)]]))
    out = bytearray()
    literal_from, literal = 0, 0  # pending literal bytes data[literal_from : literal_from + literal]

    def flush() -> None:
        nonlocal literal
        if literal:
            out.append(literal - 1)
            out.extend(data[literal_from : literal_from + literal])
        literal = 0

    for at, n in zip(starts.tolist(), lengths.tolist(), strict=True):
        while n:
            if literal and n < 3:  # a pair inside a literal joins it, as far as it fits
                take = min(n, 128 - literal)
                literal += take
                if literal == 128:
                    flush()
            else:
                flush()
                take = min(n, 128)
                if take >= 2:
                    out += bytes((257 - take, data[at]))
                else:
                    literal_from, literal = at, 1
            at, n = at + take, n - take
    flush()
    return bytes(out)


def unpackbits(data: bytes, room: int) -> bytes:
    out, at, end = bytearray(), 0, len(data)
    while at < end:
        if len(out) >= room:
            raise RasterError("InvalidFormat", "output buffer too small")
        n, at = data[at], at + 1
        if n == 128:
            continue
        piece = data[at : at + n + 1] if n < 128 else data[at : at + 1] * (257 - n)
        want = n + 1 if n < 128 else 257 - n
        if len(piece) < want:
            raise RasterError("InvalidFormat", "unexpected end of input")
        if len(out) + want > room:
            raise RasterError("InvalidFormat", "output buffer too small")
        out += piece
        at += n + 1 if n < 128 else 1
    return bytes(out)


def zstd(data: bytes, level: int = 3) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(data)


def unzstd(data: bytes, room: int) -> bytes:
    import zstandard

    if not data:
        return b""
    try:
        out = zstandard.ZstdDecompressor().decompress(data, max_output_size=max(room, 1))
    except zstandard.ZstdError as e:
        raise RasterError("InvalidFormat", str(e)) from e
    if len(out) > room:
        raise RasterError("InvalidFormat", "output buffer too small")
    return out


_CODECS: dict[int, Codec] = {}


def register_codec(codec: Codec) -> None:
    """Add a codec; a code can have one codec only."""
    if taken := [c for c in codec.codes if c in _CODECS]:
        raise ValueError(f"compression code {taken[0]} already has a codec")
    _CODECS.update(dict.fromkeys(codec.codes, codec))


register_codec(Codec((COMPRESSION["None"],), bytes, _copy))
register_codec(Codec((COMPRESSION["PackBits"],), packbits, unpackbits))
register_codec(Codec((COMPRESSION["ZSTD"], COMPRESSION["ZSTD_Alt"]), zstd, unzstd))


def codec_of(code: int) -> Codec:
    if code not in _CODECS:
        raise RasterError("UnsupportedFeature", f"compression scheme {code}")
    return _CODECS[code]


def codec_registry() -> dict[int, Codec]:
    """A copy of the registry, to be captured by functions that run on executors."""
    return dict(_CODECS)


def compress(data: Column, code: int) -> Column:
    """Compress a BINARY column (Arrow batches)."""
    codec = codec_of(code)

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else codec.compress(b))

    return run(data)


def decompress(data: Column, room: Column, code: int) -> Column:
    """Decompress a BINARY column into at most ``room`` bytes each."""
    codec = codec_of(code)

    @F.pandas_udf("binary")
    def run(s: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else codec.decompress(b, int(k)) for b, k in zip(s, n, strict=True)])

    return run(data, room)
