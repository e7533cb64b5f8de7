"""Near-duplicates by SimHash and the generalised pigeonhole principle.

Fingerprints are computed once per document (an Arrow-batched function; hashing and bit counts per batch) and reduced to
distinct values at once, so copies of a text cost one row. Bits that correlate over the corpus are grouped into
parts, of unequal width where the groups are; how many (``PARTS``) is chosen with the thresholds. Thresholds T_i >= -1 with sum(T_i) = distance - parts + 1 make
every linked pair agree up to T_i bits in some part i; a dynamic programme picks the cheapest thresholds from candidate
counts estimated over all fingerprints: few long parts with masked bits where there are very many fingerprints. Probing groups fingerprints by a part's bits (for T_i > 0 with T_i bits masked
out, in all ways), and every candidate pair is verified on all 64 bits.

Groups above ``LIGHT`` members aren't paired. There each fingerprint lists itself and its 64 single-bit neighbours: two
fingerprints differ by at most two bits exactly if their lists meet, and no list entry can have more than 65 owners, so
this finds every link of a group of any size in linear work.

Defined results: a null or wordless text has fingerprint zero, which is linked like any other; every input row gives one output
row, also repeated ones; a component whose ids are all null has a null id; a text of any length is read whole; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import components

BITS = 64
PARTS = (1, 2, 3, 4)  # numbers of parts to choose from
DISTANCE = 2
LIGHT = 64
SHINGLE = 3
SEED = 42


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of one text; null and wordless texts give 0."""
    from xxhash import xxh64_intdigest

    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # ASCII case and white space only
    if not w:
        return 0
    n = max(len(w) - width + 1, 1)
    count = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):  # shingles of a very long text are never all there at once
        part = w[at : at + (1 << 16) + width - 1]
        grams = [part] if n == 1 else zip(*[part[i:] for i in range(width)], strict=False)
        count += _set_bits(np.array([xxh64_intdigest(b" ".join(g), SEED) for g in grams], "<u8"))
    return _majority(count, n)


def _set_bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _majority(count: np.ndarray, n: int) -> int:
    return int(np.packbits((2 * count > n).astype(np.uint8), bitorder="little").view("<i8")[0])


def of_hashes(h: np.ndarray) -> int:
    """Signed 64-bit SimHash of hashed shingles."""
    return _majority(sum((_set_bits(h[at : at + (1 << 16)]) for at in range(0, len(h), 1 << 16)), np.zeros(BITS, np.int64)), len(h))


@F.pandas_udf(T.LongType())
def fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield pd.Series([fingerprint(t) for t in s], dtype="int64")


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask


def cooccurrence(fps: DataFrame) -> np.ndarray:
    """64 x 64 counts of bits set together, over all fingerprints; partial sums per task, added up by Spark."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += np.rint(bits.T @ bits).astype(np.int64)
        cells = np.nonzero(total.ravel())[0]
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(total.ravel()[cells], pa.int64())], ["cell", "n"])

    out = np.zeros(BITS * BITS, np.int64)
    for r in fps.select("fp").mapInArrow(part, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # 4096 rows at most
        out[r.cell] = r.n
    return out.reshape(BITS, BITS)


def group_bits(together: np.ndarray, n: int, parts: int = 3, slack: int = 3) -> list[list[int]]:
    """Bits into parts, correlated bits first: merge the most correlated groups while they fit, then pack the groups."""
    p = np.diag(together) / max(n, 1)
    cov = together / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(cov / np.outer(sd, sd))
    room = -(-BITS // parts) + slack
    of = {b: frozenset([b]) for b in range(BITS)}
    for a, b in sorted(combinations(range(BITS), 2), key=lambda x: (-corr[x], x)):
        if of[a] is not of[b] and len(of[a]) + len(of[b]) <= room and corr[a, b] > 0.1:
            merged = of[a] | of[b]
            of |= dict.fromkeys(merged, merged)
    out: list[list[int]] = [[] for _ in range(parts)]
    for g in sorted(set(of.values()), key=lambda g: (-len(g), min(g))):
        for b in [g] if any(len(o) + len(g) <= room for o in out) else [frozenset([x]) for x in sorted(g)]:
            fits = [o for o in out if len(o) + len(b) <= room]
            min(fits, key=len).extend(sorted(b))
    return out


def thresholds(pairs: list[float], odds: list[float], widths: list[int], n: int, distance: int = DISTANCE) -> list[int]:
    """Cheapest T_i >= -1 with sum distance - parts + 1, by dynamic programming over the parts.

    ``pairs``: candidate pairs at T = 0; ``odds``: expected pairs one bit away for each such pair. A probe costs as much as
    a candidate.
    """
    return list(_cheapest(pairs, odds, widths, n, distance)[1])


def _cheapest(pairs: list[float], odds: list[float], widths: list[int], n: int, distance: int) -> tuple[float, tuple[int, ...]]:
    """Cost and thresholds."""

    def cost(i: int, t: int) -> float:
        if t < 0:
            return 0.0
        grow = sum(odds[i] ** k / max(1, np.prod(range(1, k + 1))) for k in range(t + 1))
        return pairs[i] * grow + n * comb(widths[i], t)

    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for i in range(len(pairs)):
        new: dict[int, tuple[float, tuple[int, ...]]] = {}
        for total, (c, ts) in best.items():
            for t in range(-1, distance + 1):
                if t <= widths[i]:
                    x = (c + cost(i, t), (*ts, t))
                    if total + t not in new or x < new[total + t]:
                        new[total + t] = x
        best = new
    return best[distance - len(pairs) + 1]


def _keys(parts: list[list[int]], ts: list[int]) -> Column:
    """The probe keys of fp: for each part with T >= 0, its bits without each choice of T of them."""
    keys = []
    for i, (bits, t) in enumerate(zip(parts, ts, strict=True)):
        for gone in combinations(bits, t) if t >= 0 else ():
            mask = sum(1 << b for b in bits if b not in gone)
            keys.append(F.xxhash64(F.lit(i), F.lit(_signed(sum(1 << b for b in gone))), F.col("fp").bitwiseAND(F.lit(_signed(mask)))))
    return F.array(*keys)


def plan(fps: DataFrame, counts: tuple[int, ...] = PARTS, distance: int = DISTANCE, light: int = LIGHT) -> tuple[list[list[int]], list[int]]:
    """Parts and thresholds of the cheapest probe: for each number of parts the bits are grouped and the dynamic programme finds the
    thresholds; candidates are counted over all fingerprints, for all of these parts at once."""
    n = fps.count()
    together = cooccurrence(fps)
    p = np.diag(together) / max(n, 1)
    same = p**2 + (1 - p) ** 2
    grouped = [group_bits(together, n, k) for k in counts]
    flat = [bits for parts in grouped for bits in parts]
    masks = F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in bits)))) for bits in flat])
    sizes = fps.select(F.posexplode(masks).alias("part", "v")).groupBy("part", "v").count()
    work = F.when(F.col("count") <= light, F.col("count") * (F.col("count") - 1) / 2).otherwise(F.col("count") * (BITS + 1))
    got = {r.part: float(r.c) for r in sizes.groupBy("part").agg(F.sum(work).alias("c")).collect()}  # a row for each part
    best, at = None, 0
    for parts in grouped:
        odds = [float(sum((1 - same[b]) / same[b] for b in bits)) for bits in parts]
        found = _cheapest([got.get(at + i, 0.0) for i in range(len(parts))], odds, [len(b) for b in parts], n, distance)
        at += len(parts)
        if best is None or found[0] < best[0]:
            best = (found[0], parts, list(found[1]))
    return best[1], best[2]


def links(fps: DataFrame, folder: str, parts: tuple[int, ...] = PARTS, distance: int = DISTANCE, light: int = LIGHT, whole: bool = True) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints within ``distance`` (at most 2) bits: every link in light
    groups, and stars over shared neighbours, which connect the same fingerprints, in heavy ones. Without ``whole`` the distance
    may be larger; in heavy groups only what two bits connect is then found, and the caller looks for the rest."""
    if whole and distance > 2:
        raise ValueError("heavy groups are resolved for at most two differing bits")
    grouped, ts = plan(fps, parts, distance, light)
    index = common.table(fps.select("fp", F.explode(_keys(grouped, ts)).alias("k")), f"{folder}/index")
    counts = common.table(index.groupBy("k").count().where("count > 1"), f"{folder}/counts")
    index = common.table(index.join(counts, "k"), f"{folder}/candidates")
    a = index.where(F.col("count") <= light).select("k", F.col("fp").alias("a"))
    b = a.select("k", F.col("a").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    paired = a.join(b.withColumnRenamed("k", "kb"), (F.col("k") == F.col("kb")) & (F.col("a") < F.col("b")) & close).select("a", "b")
    heavy = index.where(F.col("count") > light).select("fp").distinct()
    # two single-bit neighbourhoods meet if and only if two bits at most differ; with distance 1 only ends are shared
    near = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(BITS)]
    if distance == 0:
        near = near[:1]
    met = heavy.select("fp", F.explode(F.array(*near)).alias("mid")).groupBy("mid").agg(F.collect_set("fp").alias("owners")).where(F.size("owners") > 1)
    star = met.select(F.explode("owners").alias("a"), F.array_min("owners").alias("b")).where("a <> b")
    if distance == 1:
        star = star.where(close)
    return paired.unionByName(star)


def cluster(docs: DataFrame, folder: str, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id) for every row, also for repeated rows and null texts (empty).

    A component whose ids are all null has a null id. ``component_id`` is the least id reachable over links.
    """
    rows = common.table(docs.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text)).alias("fp")), f"{folder}/fingerprints")
    fps = common.table(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), f"{folder}/distinct")
    edges = links(fps, folder)
    roots = components(edges, f"{folder}/components")
    each = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    each = common.table(each, f"{folder}/rooted")
    ids = common.table(each.groupBy("root").agg(F.min("least").alias("component_id")), f"{folder}/ids")
    named = common.table(each.join(ids, "root").select("fp", "component_id"), f"{folder}/named")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def report(docs: DataFrame, folder: str) -> DataFrame:
    out = cluster(docs, folder)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, folder: str) -> DataFrame:
    """``docs`` without near copies by the pipeline's rule, five-word shingles of similarity 0.8: links of fingerprints, each verified, and
    by an exact path what no radius covers. See ``near_copies``."""
    from . import near_copies  # which takes its first links from this module

    return near_copies.keep_one(docs, folder)
