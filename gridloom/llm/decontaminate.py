"""Benchmark decontamination by winnowing (DataFrame operations only).

Words of both sides are hashed in grams of ``GRAM`` words. Of every ``SPAN - GRAM + 1`` consecutive gram hashes the least
is kept (ties: all), so any shared run of ``SPAN`` words shares at least one kept gram. Kept grams are joined on the hash;
each hit is checked word by word and extended to both sides, and counts if the run reaches ``SPAN`` words. Items shorter
than ``SPAN`` words are one window, for which kept grams promise nothing; documents are then also read in grams of just
those lengths.

The item side is broadcast only if its measured size is below ``BROADCAST_GRAMS`` grams (eleven words each); beyond
that the grams are joined by a shuffle and the words are fetched again for the hits alone.

Defined results: a null or empty text has no words and no hits; every input row gives one output row, also repeated ones;
an item without an id can mark words but isn't counted or listed; kept columns may have any name, as they travel in a struct;
a text of any length is one row; empty tables give empty or clean results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPAN = 8
GRAM = 5
BROADCAST_GRAMS = 200_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(common.lower_ascii(text), SEPARATORS), "")


def _hashes(w: str, n: int) -> Column:
    """Hashes of all grams of n words; empty if there are fewer words."""
    at = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(F.col(w), i + k) for k in range(n)]))


def _winnow(df: DataFrame, w: str, span: int, gram: int) -> DataFrame:
    """Add ``h``, all gram hashes, and ``kept``, the positions whose hash is the least of some window."""
    width = span - gram + 1
    df = df.withColumn("h", _hashes(w, gram))
    n = F.size("h")
    at = lambda last: F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    low = F.transform(at(n - width), lambda j: F.least(*[F.get(F.col("h"), j + k) for k in range(width)]))
    df = df.withColumn("low", low)
    best = lambda p: F.greatest(*[F.get(F.col("low"), p - k) for k in range(width)])
    # a negative index gives null, which greatest() passes over
    kept = F.filter(at(n - 1), lambda p: F.get(F.col("h"), p) == best(p))
    return df.withColumn("kept", kept).drop("low")


def _grams(items: DataFrame, span: int, gram: int) -> DataFrame:
    """Kept grams of long items with the words around them: (fp, item_id, m, need, g, before, after)."""
    long_ = _winnow(items.where(F.size("w") >= span), "w", span, gram)
    reach = span - gram
    q = F.col("q")
    # explode() would push a test of its array below the projections and so evaluate all of this once more per element
    long_ = long_.select("item_id", "w", "h", F.explode_outer("kept").alias("q")).where("q is not null").select(
        F.get("h", q).alias("fp"),
        "item_id",
        F.slice("w", q + 1, gram).alias("g"),
        F.array(*[F.get("w", q - 1 - k) for k in range(reach)]).alias("before"),
        F.array(*[F.get("w", q + gram + k) for k in range(reach)]).alias("after"),
    )
    return long_.distinct()


def _runs(p: Column, g: Column, before: Column, after: Column, gram: int, span: int) -> Column:
    """The matched run (s, e) around document position p, or null if the gram differs or the run is too short."""
    w, reach = F.col("w"), span - gram

    def extent(mine, theirs) -> Column:
        out = F.lit(0)
        for k in reversed(range(reach)):  # nested: counts equal words up to the first difference
            out = F.when(mine(k) == F.get(theirs, F.lit(k)), F.lit(1) + out).otherwise(F.lit(0))
        return out

    left = extent(lambda k: F.get(w, p - 1 - k), before)
    right = extent(lambda k: F.get(w, p + gram + k), after)
    run = F.struct((p - left).alias("s"), (p + gram + right).alias("e"))
    return F.when((F.slice(w, p + 1, gram) == g) & (left + right + gram >= span), run)


def _short_hits(docs: DataFrame, items: DataFrame, span: int) -> DataFrame | None:
    """(rid, run, item_id) of items with fewer than ``span`` words; None if there are none."""
    short = items.where((F.size("w") < span) & (F.size("w") > 0))
    lengths = sorted(r.m for r in short.select(F.size("w").alias("m")).distinct().collect())  # span - 1 rows at most
    if not lengths:
        return None
    keyed = short.select(F.size("w").alias("m"), F.xxhash64(F.size("w"), "w").alias("fp"), "item_id", F.col("w").alias("g"))
    parts = None
    for m in lengths:
        at = F.when(F.size("w") >= m, F.sequence(F.lit(0), F.size("w") - m)).otherwise(F.array().cast("array<int>"))
        one = docs.where(F.size("w") >= m).select("rid", F.lit(m).alias("m"), F.posexplode_outer(F.transform(at, lambda i: F.slice("w", i + 1, F.lit(m))))).select(
            "rid", "m", "pos", F.col("col").alias("dw"), F.xxhash64("m", "col").alias("fp")
        )
        parts = one if parts is None else parts.unionByName(one)
    hits = parts.join(keyed, ["fp", "m"]).where(F.col("dw") == F.col("g"))
    return hits.select("rid", F.struct(F.col("pos").alias("s"), (F.col("pos") + F.col("m")).alias("e")).alias("run"), "item_id")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    span: int = SPAN,
    gram: int = GRAM,
    min_items: int = 2,
    broadcast_grams: int = BROADCAST_GRAMS,
) -> DataFrame:
    """One row per document row: ``keep``, n_words, n_hit, n_items, items_sha256, contaminated, runs (hit words), items."""
    out = _judged(docs, benchmark, keep, text, item_id, item_text, span, gram, min_items, broadcast_grams)
    return out.select("row.*", *[c for c in out.columns if c != "row"])


def _judged(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...], text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = SPAN, gram: int = GRAM, min_items: int = 2, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """As ``contamination`` with the kept columns in one struct, so that their names can't clash."""
    items = benchmark.select(F.col(item_id).alias("item_id"), words(common.text_of(item_text)).alias("w"))
    # a row's key comes from what it holds, never from where it lies, so that another evaluation gives the same; equal rows share one
    w = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), common.text_of(text).alias("t"))
    w = w.select("row", F.struct(F.xxhash64(F.lit(1), "row", "t").alias("a"), F.xxhash64(F.lit(2), "t", "row").alias("b")).alias("rid"), words(F.col("t")).alias("w"))
    grams = _grams(items, span, gram)
    found = _winnow(w, "w", span, gram)
    # position -1 stands for the document itself; its key is spread like a hash, so that nothing piles up
    each = found.select("row", "rid", "w", "h", F.explode_outer(F.concat(F.array(F.lit(-1)), "kept")).alias("p"))
    key = F.when(F.col("p") >= 0, F.get("h", F.greatest("p", F.lit(0)))).otherwise(F.xxhash64("rid"))
    row, n_words = F.when(F.col("p") < 0, F.col("row")).alias("row"), F.when(F.col("p") < 0, F.size("w")).alias("n_words")
    run = F.when(F.col("p") >= 0, _runs(F.col("p"), F.col("g"), F.col("before"), F.col("after"), gram, span)).alias("run")
    if grams.limit(broadcast_grams + 1).count() <= broadcast_grams:
        hits = (
            each.select("row", "rid", "w", "p", key.alias("fp"))
            .join(F.broadcast(grams), "fp", "left")
            .where((F.col("p") < 0) | F.col("g").isNotNull())
            .select("rid", row, n_words, run, "item_id")
        )
    else:
        base = each.where("p < 0").select("rid", row, n_words, F.lit(None).cast("struct<s:int,e:int>").alias("run"), F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"))
        cand = each.where("p >= 0").select("rid", "p", key.alias("fp")).join(grams, "fp").drop("fp").distinct()
        near = cand.join(w.groupBy("rid").agg(F.first("w").alias("w")), "rid").select("rid", F.lit(None).cast(each.schema["row"].dataType).alias("row"), F.lit(None).cast("int").alias("n_words"), run, "item_id")
        hits = base.unionByName(near)
    hits = hits.where(F.col("row").isNotNull() | F.col("run").isNotNull())
    if (short := _short_hits(w, items, span)) is not None:
        empty = lambda f: F.lit(None).cast(hits.schema[f].dataType).alias(f)
        hits = hits.unionByName(short.select("rid", empty("row"), empty("n_words"), "run", "item_id"))
    per = hits.groupBy("rid").agg(
        F.first("row", ignorenulls=True).alias("row"),
        F.count("n_words").alias("copies"),  # one for each row of this content
        F.first("n_words", ignorenulls=True).cast("long").alias("n_words"),
        F.array_sort(F.collect_set("run")).alias("runs"),
        F.collect_set(F.when(F.col("run").isNotNull(), F.col("item_id"))).alias("items"),
    )

    def cover(acc: Column, x: Column) -> Column:
        new = F.greatest(x["e"] - F.greatest(x["s"], acc["to"]), F.lit(0))
        return F.struct(F.greatest(acc["to"], x["e"]).alias("to"), (acc["n"] + new).alias("n"))

    n_hit = F.aggregate("runs", F.struct(F.lit(0).alias("to"), F.lit(0).alias("n")), cover, lambda a: a["n"])
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    thousand = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"), F.lit(1000).cast("long"))).alias("at")
    per = per.select("*", thousand).select("*", F.explode(F.array_repeat(F.lit(0), F.least(F.col("copies") - F.col("at") + 1, F.lit(1000)).cast("int"))))
    return per.select(
        "row",
        "n_words",
        n_hit.cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.size("items") >= min_items).alias("contaminated"),
        "runs",
        "items",
    )


ORACLE = r"""
WITH iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 8) AS m, array_to_string(list_slice(w, i, i + least(len(w), 8) - 1), ' ') AS k
        FROM iw, unnest(range(1, greatest(len(w) - 8, 0) + 2)) AS t(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dg AS (SELECT doc_id, i, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS k
       FROM dw, (SELECT DISTINCT m FROM win), unnest(range(1, len(w) - m + 2)) AS t(i)),
hit AS (SELECT doc_id, i, dg.m, item_id FROM dg JOIN win USING (k, m)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + m)) AS t(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs, benchmark).drop("runs", "items")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without rows that hold a window of any item; the pipeline's stage."""
    found = _judged(docs, benchmark, tuple(docs.columns), min_items=1)
    return found.where(~F.col("contaminated")).select("row.*")
