"""Near copies by exact similarity: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

No SimHash radius finds all of these (pairs at 0.8 differ by 10 bits of 64 on average, some by far more), so candidates come
from prefixes: in any fixed order of shingles, two sets of that similarity share one of their first n // 5 + 1. The order
is that of the hashes, but shingles whose slot in a bitmap of fixed size is marked come last. A first pass marks those that
more than ``LIGHT`` / 2 prefixes hold; as others of a common passage then move up into the prefixes, ``ROUNDS`` more passes mark
what more than ``LIGHT`` prefixes hold, and only texts with such a shingle in their prefix are taken again. The order is the same for all texts, so a full bitmap or a
shingle that no pass has marked costs time and no pairs. A pair is passed over where its sizes, or what the prefix that ends
first lacks in the other, rule out 0.8; every other candidate is verified on the whole sets.

The first links come from SimHash fingerprints of the sets, probed by the parts of ``simhash.links`` within ``RADIUS`` bits and verified
in the same way. The prefixes then find what no radius covers: only candidates in different components of those links go on.

Only groups of texts that are common almost throughout still meet in more than ``LIGHT``. There each is compared with
``PIVOTS`` texts that differ least from what is common. What is still in different components afterwards is joined by the
differences from one common text, see ``_by_difference``. So a pair is either verified or joined by other links, in groups of any size.

Texts and shingles are told apart by 64-bit hashes. Words are runs without white space, ASCII case ignored; a shorter text is
one shingle; all texts without a word are one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, simhash
from .components import components

WORDS = 5
LIGHT = 64
ROUNDS = 2
RADIUS = 3  # bits by which fingerprints of the first links differ
PIVOTS = 16
SEED = 42
SLOTS = 1 << 22
CLASSES = 20  # classes of members by their difference from a common text, for each unit of its size
BATCH = 500_000


def shingles(text: str | None, width: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word windows; empty without words."""
    from xxhash import xxh64_intdigest

    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    grams = [b" ".join(w)] if 0 < len(w) < width else [b" ".join(g) for g in zip(*[w[i:] for i in range(width)], strict=False)]
    return np.unique(np.array([xxh64_intdigest(g, SEED) for g in grams], "<u8").view("<i8"))


def node_of(text: Column) -> Column:
    """The hash of a text; one for all texts without a word."""
    return F.xxhash64(F.when(text.rlike(r"[^\x09-\x0D\x20]"), text).otherwise(F.lit("")))


def _marked(slots: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = x.view(np.uint64) & np.uint64(SLOTS - 1)
    return (slots[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _slots(df: DataFrame, name: str) -> np.ndarray:
    """A bitmap of the low bits of a column."""
    out = np.zeros(SLOTS >> 6, np.int64)
    marks = df.groupBy(F.shiftright(F.col(name).bitwiseAND(F.lit(SLOTS - 1)), 6).alias("at")).agg(F.expr(f"bit_or(shiftleft(1L, cast({name} & 63 as int)))").alias("m"))
    for r in marks.collect():  # SLOTS / 64 rows at most
        out[r["at"]] = r["m"]
    return out.view(np.uint64)


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k): the first shingles of each text by hash, as many as its prefix has."""
    held: list[np.ndarray] = []
    for b in batches:
        for text in b.column(0):
            h = shingles(text.as_py())
            held.append(h[: len(h) // 5 + 1])
            if sum(len(x) for x in held[-1:]) > BATCH or len(held) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held))], ["k"])
                held.clear()
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*held, np.zeros(0, np.int64)]))], ["k"])


def _prefixes(batches: Iterator[pa.RecordBatch], often: np.ndarray, only: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(node, n, rare, fp, k array): of the nodes whose slot is marked in ``only``, the size, the number of keys that do not come last,
    the fingerprint and the prefix, keys that come last at its end."""
    held: list[tuple[int, int, int, int]] = []
    keys: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
        flat = pa.array(np.concatenate([*keys, np.zeros(0, np.int64)]))
        cols = [pa.array([x[i] for x in held], pa.int64()) for i in range(4)]
        out = pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(ends), flat)], ["node", "n", "rare", "fp", "k"])
        held.clear()
        keys.clear()
        return out

    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for i in range(len(ids)) if only is None else np.nonzero(_marked(only, ids))[0]:
            h = shingles(b.column(1)[int(i)].as_py())
            if not len(h):
                continue
            last = _marked(often, h)
            held.append((int(ids[i]), len(h), len(h) - int(last.sum()), simhash.of_hashes(h)))
            keys.append(np.concatenate([h[~last], h[last]])[: len(h) // 5 + 1])
            size += len(keys[-1])
            if size > BATCH or len(held) >= 5000:
                size = 0
                yield flush()
    yield flush()


def _index(texts: DataFrame, light: int, path: str) -> DataFrame:
    """The prefixes of all nodes, see ``_prefixes``, one row for each. Those of texts that hold a key which turns out to be common are
    taken again, until no key but those that come last is in more than ``light`` prefixes."""
    kind = "node long, n long, rare long, fp long, k array<long>"

    def taken(often: np.ndarray, only: np.ndarray | None = None) -> DataFrame:
        return texts.mapInArrow(lambda it: _prefixes(it, often, only), kind)

    def whole(found: DataFrame, path: str) -> DataFrame:  # copies of a text have equal rows
        return common.table(found.groupBy("node").agg(F.first(F.struct("n", "rare", "fp", "k")).alias("x")).select("node", "x.*"), path)

    often = _slots(texts.select("text").mapInArrow(_heads, "k long").groupBy("k").count().where(F.col("count") > light // 2), "k")
    layers = [whole(taken(often), f"{path}-0")]
    slot = F.col("k").bitwiseAND(F.lit(SLOTS - 1)).alias("slot")
    for step in range(1, ROUNDS + 1):
        index = reduce(DataFrame.unionByName, layers)
        keys = index.select("node", F.explode(F.slice("k", 1, F.least("rare", F.size("k")).cast("int"))).alias("k"))
        crowd = common.table(keys.groupBy("k").count().where(F.col("count") > light).select("k"), f"{path}-crowd-{step}")
        more = _slots(crowd, "k")
        if not more.any():
            break
        often = often | more
        moved = keys.select("node", slot).join(crowd.select(slot).distinct(), "slot", "left_semi").select("node").distinct()
        moved = common.table(moved, f"{path}-moved-{step}")
        again = taken(often, _slots(moved, "node")).join(moved, "node", "left_semi")
        layers = [x.join(moved, "node", "left_anti") for x in layers] + [whole(again, f"{path}-{step}")]
    return reduce(DataFrame.unionByName, layers)


def _whole(batches: Iterator[pa.RecordBatch], slots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(node, k array): the whole sets of the nodes whose slot is marked."""
    nodes: list[int] = []
    held: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        ends = np.concatenate([[0], np.cumsum([len(h) for h in held])]).astype(np.int32)
        flat = pa.array(np.concatenate([*held, np.zeros(0, np.int64)]))
        out = pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), flat)], ["node", "k"])
        nodes.clear()
        held.clear()
        return out

    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for i in np.nonzero(_marked(slots, ids))[0]:
            nodes.append(int(ids[i]))
            held.append(shingles(b.column(1)[int(i)].as_py()))
            if sum(len(h) for h in held[-1:]) > BATCH or len(held) >= 1000:
                yield flush()
    yield flush()


def _sets_of(texts: DataFrame, need: DataFrame, path: str) -> DataFrame:
    """(node, set) of the nodes in ``need``. A bitmap of fixed size passes over most others before the exact join."""
    slots = _slots(need, "node")
    found = texts.mapInArrow(lambda it: _whole(it, slots), "node long, k array<long>")
    return common.table(found.join(need, "node", "left_semi").groupBy("node").agg(F.first("k").alias("set")), path)


def _verified(pairs: DataFrame, texts: DataFrame, path: str) -> DataFrame:
    """The pairs (a, b) of similarity 0.8 at least."""
    pairs = common.table(pairs.distinct(), f"{path}-pairs")
    need = common.table(pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct().withColumnRenamed("a", "node"), f"{path}-need")
    sets = _sets_of(texts, need, f"{path}-sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb")).cast("long")
    close = both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), shared.alias("n")).where("5 * n >= 4 * (na + nb - n)")
    return common.table(close.select("a", "b"), f"{path}-close")


def _possible(pairs: DataFrame, ends: DataFrame, heavy: DataFrame) -> DataFrame:
    """Pairs (a, b, c) that may have similarity 0.8. ``c`` is their number of light keys in common; heavy ones may all be.

    At 0.8, sets of sizes n and m share 4/9 (n + m) at least. All of the prefix that ends first that the other set holds is
    in the other's prefix.
    """
    n_heavy = heavy.groupBy("node").count().withColumnRenamed("count", "h")
    info = ends.join(n_heavy, "node", "left").na.fill(0, ["h"])
    for x in "ab":
        pairs = pairs.join(info.select(F.col("node").alias(x), *[F.col(c).alias(c + x) for c in ("n", "last", "h")]), x)
    first = F.when(F.col("lasta") <= F.col("lastb"), F.col("na")).otherwise(F.col("nb"))
    must = F.floor(first / 5) + 1 - F.col("c") - F.least("ha", "hb")  # surely not in the other
    return pairs.where("5 * least(na, nb) >= 4 * greatest(na, nb)").where(9 * (first - must) >= 4 * (F.col("na") + F.col("nb"))).select("a", "b")


def _by_fingerprint(ends: DataFrame, texts: DataFrame, path: str) -> DataFrame:
    """The near copies (a, b) whose SimHash fingerprints are linked: probed by the parts of ``simhash.links`` and verified. Texts of one
    fingerprint are compared with the least of them, which stands for it."""
    fps = common.table(ends.groupBy("fp").agg(F.min("node").alias("least")), f"{path}-fingerprints")
    linked = simhash.links(fps.select("fp"), path, distance=RADIUS, whole=False)
    for x in "ab":
        linked = linked.join(fps.select(F.col("fp").alias(x), F.col("least").alias(f"least{x}")), x)
    same = ends.join(fps, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    pairs = linked.select(F.least("leasta", "leastb").alias("a"), F.greatest("leasta", "leastb").alias("b")).unionByName(same)
    for x in "ab":
        pairs = pairs.join(ends.select(F.col("node").alias(x), F.col("n").alias(f"n{x}")), x)
    return _verified(pairs.where("5 * least(na, nb) >= 4 * greatest(na, nb)").select("a", "b"), texts, path)


def links(docs: DataFrame, folder: str, *, light: int = LIGHT) -> DataFrame:
    """Edges (a, b) that connect all nodes of (node, text) that are near copies, and no others."""
    texts = docs.select("node", "text")
    index = _index(texts, light, f"{folder}/index")
    last = F.struct((F.size("k") > F.col("rare")).cast("int").alias("often"), F.element_at("k", -1).alias("k")).alias("last")
    ends = common.table(index.select("node", "n", "rare", "fp", last), f"{folder}/ends")
    by = Window.partitionBy("k")
    each = index.select("node", F.explode("k").alias("k"))
    every = common.table(each.select("node", "k", F.count(F.lit(1)).over(by).alias("count")).where("count > 1"), f"{folder}/every")
    a = every.where(F.col("count") <= light).select("k", F.col("node").alias("a"))
    same = (F.col("k") == F.col("kb")) & (F.col("a") < F.col("b"))
    paired = a.join(a.select(F.col("k").alias("kb"), F.col("a").alias("b")), same).groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    paired = common.table(paired, f"{folder}/paired")
    off = 2 * F.col("rare") - F.col("n")  # what a text differs by from all that is common, up to a constant
    heavy = common.table(every.where(F.col("count") > light).join(ends, "node").select("node", "k", off.alias("off")), f"{folder}/heavy")
    best = F.struct("off", "node")
    pivots = heavy.groupBy("k").agg(F.array(*[F.min(F.when(F.pmod("node", F.lit(PIVOTS)) == i, best)) for i in range(PIVOTS)]).alias("pivots"))
    stars = heavy.join(pivots, "k").select("node", F.explode("pivots.node").alias("pivot")).where("node <> pivot")
    stars = stars.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"), F.lit(0).cast("long").alias("c"))

    near = _by_fingerprint(ends, texts, f"{folder}/simhash")
    known = components(near, f"{folder}/simhash-linked")

    def checked(more: DataFrame, which: DataFrame, path: str) -> DataFrame:
        both = _possible(which.unionByName(more.distinct()).groupBy("a", "b").agg(F.sum("c").alias("c")), ends, heavy)
        for x in "ab":
            both = both.join(known.select(F.col("node").alias(x), F.col("root").alias(f"root{x}")), x, "left")
        return _verified(both.where("coalesce(roota, a) <> coalesce(rootb, b)").select("a", "b"), texts, path)

    edges = near.unionByName(checked(stars, paired, f"{folder}/first"))
    if heavy.isEmpty():
        return edges
    roots = components(edges, f"{folder}/linked")
    placed = heavy.join(roots, "node", "left").select("node", "k", "off", F.coalesce("root", "node").alias("root"))
    placed = common.table(placed, f"{folder}/placed")
    main = placed.groupBy("k", "root").count().groupBy("k").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count(F.lit(1)).alias("roots"))
    typical = placed.groupBy(F.col("root").alias("main")).agg(F.min(F.struct("off", "node")).alias("x")).select("main", F.col("x.node").alias("p"))
    open_ = placed.join(main.where("roots > 1"), "k").select("node", "root", "main").distinct().join(typical, "main")
    open_ = common.table(open_, f"{folder}/open")
    left = _by_difference(open_, texts, f"{folder}/by-difference")
    return edges.unionByName(checked(left, paired.join(left.select("a", "b"), ["a", "b"], "left_semi"), f"{folder}/second"))


def _by_difference(open_: DataFrame, texts: DataFrame, path: str) -> DataFrame:
    """Candidate pairs (a, b, c) among (node, root, main, p): members of different components that are told apart by what sets them off
    from one text ``p``, the one that differs least from what is common in ``main``, the component that most of them are in.

    Two sets x and y of sizes n and m are similar if and only if their symmetric difference has (n + m) / 9 elements at most, and it
    is that of their differences dx and dy from p. So either |dx| + |dy| is that small: then both are similar to the member with the
    most slack, n / 9 - |dx|, and a star is enough. Or dx and dy share at least half of what is too much, and meet in prefixes of
    dx and dy, rare elements first, which are the shorter the less alike the two are to p. Members are dealt into
    classes of |dx| / n, so that this share is known for a pair of classes. What no other member that counts differs by sets a member
    off from all of them: with more than a quarter of its size it has no partner, whose size is within a quarter of its own.
    Before any of this, members with more than a fifth that no other component holds are put aside, by their own elements alone: they have
    no partner, but as texts that share one passage and nothing else all lack the rest of ``p``, they would all meet in it.
    """
    need = open_.select("node").unionByName(open_.select(F.col("p").alias("node"))).distinct()
    sets = _sets_of(texts, need, f"{path}-sets")
    members = open_.select("node", "root", "p").unionByName(open_.select(F.col("p").alias("node"), F.col("main").alias("root"), "p")).distinct()
    both = members.join(sets.withColumnRenamed("set", "sx"), "node").join(sets.select(F.col("node").alias("p"), F.col("set").alias("sp")), "p")
    both = both.select("p", "node", "root", F.size("sx").alias("n"), F.array_except("sx", "sp").alias("own"), "sx", "sp")
    own = common.table(both.drop("sx", "sp"), f"{path}-own")
    each = own.select("p", "node", "root", F.explode("own").alias("e"))
    met = each.groupBy("p", "e").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("p", "e")
    held = each.join(met, ["p", "e"]).groupBy("p", "node").count()
    partner = own.join(held, ["p", "node"], "left").where("5 * (size(own) - coalesce(count, 0)) <= n").select("p", "node")
    partner = common.table(partner, f"{path}-partner")
    apart = F.concat("own", F.array_except("sp", "sx")).alias("d")
    diff = common.table(both.join(partner, ["p", "node"], "left_semi").select("p", "node", "root", "n", apart), f"{path}-differences")
    size = F.size("d")
    slack = (F.col("n") / 9 - size).alias("slack")
    most = diff.groupBy("p").agg(F.max(F.struct(slack, F.col("node").alias("hub"))).alias("x")).select("p", F.col("x.slack").alias("most"), "x.hub")
    most = common.table(most, f"{path}-hubs")
    held = diff.join(most, "p").withColumn("near", F.col("n") / 9 - size + F.col("most") >= -1e-6)
    star = held.where("near and node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    # two members near the hub are joined by it; so a pair has one that is not, and meets in an element and a class of such a one
    far = held.where("not near").select("p", F.floor(size / F.col("n") * CLASSES).cast("int").alias("own"), "node")
    held = held.join(far.groupBy("p").agg(F.collect_set("own").alias("far")), "p")  # a few dozen classes
    each = held.select("p", "node", "near", F.explode("d").alias("e"))
    often = each.groupBy("p", "e").agg(F.count(F.lit(1)).alias("often"), F.bool_and("near").alias("all_near")).where("often > 1 and not all_near")
    often = common.table(often.select("p", "e", "often"), f"{path}-often")
    ranked = each.join(often, ["p", "e"]).groupBy("p", "node").agg(F.array_sort(F.collect_list(F.struct("often", "e"))).alias("shared"))
    ranked = held.select("p", "node", "root", "n", "near", "far", size.alias("size")).join(ranked, ["p", "node"])  # what no other has can't meet
    ranked = ranked.where(4 * (F.col("size") - F.size("shared")) <= F.col("n"))
    own = F.floor(F.col("size") / F.col("n") * CLASSES).cast("int")
    excess = lambda u, m: (u - 1 / 9) * m

    def reach(c: Column) -> Column:
        """How many of the elements, the rarest first, may be the first that is shared with a member of class c."""
        low = c / CLASSES
        other = F.when(low >= 1 / 9, excess(low, F.col("n") * 0.8)).otherwise(excess(low, F.col("n") * 1.25))
        must = F.greatest(F.ceil((excess(F.col("size") / F.col("n"), F.col("n")) + other) / 2 - 1e-6), F.lit(1))
        may = must <= F.least(F.col("size"), (c + 1) / CLASSES * F.col("n") * 1.25 + 1)
        alone = F.col("size") - F.size("shared")  # elements of its own come first in the order
        return F.when(may, F.col("size") - must + 1 - alone).otherwise(0).cast("int")

    u = F.col("size") / F.col("n")  # a partner's size is within a quarter of n, and so is its difference's
    from_, to = F.greatest(F.floor((u - 0.25) / 1.25 * CLASSES) - 1, F.lit(0)).cast("int"), (F.floor((u + 0.25) / 0.8 * CLASSES) + 1).cast("int")
    all_ = F.transform(F.sequence(from_, to), lambda c: F.struct(c.alias("c"), reach(c).alias("take")))
    dealt = ranked.select("p", "node", "root", "n", "near", "shared", own.alias("own"), F.explode(F.filter(all_, lambda x: (x["take"] > 0) & (~F.col("near") | F.array_contains("far", x["c"])))).alias("x"))
    keyed = dealt.select(
        "node", "root", "n", "near", "own", F.explode(F.slice(F.col("shared.e"), F.lit(1), F.col("x.take"))).alias("e"), "p",
        F.least("own", "x.c").alias("lo"), F.greatest("own", "x.c").alias("hi"),
    )
    key = ["p", "lo", "hi", "e"]
    keyed = common.table(keyed, f"{path}-keys")
    alive = keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("members"), F.min("root").alias("r0"), F.max("root").alias("r1"), F.bool_and("near").alias("all_near"), F.min("own").alias("o0"), F.max("own").alias("o1"))
    alive = alive.where("members > 1 and r0 <> r1 and not all_near and o0 = lo and o1 = hi").select(*key)
    keyed = common.table(keyed.join(alive, key), f"{path}-alive")
    x = keyed.where("own = lo").select(*key, *[F.col(c).alias(f"{c}x") for c in ("node", "root", "n", "near")])
    y = keyed.where("own = hi").select(*[F.col(c).alias(f"{c}y") for c in (*key, "node", "root", "n", "near")])
    meet = F.expr("p = py and lo = loy and hi = hiy and e = ey and rootx <> rooty and (lo < hi or nodex < nodey) and not (nearx and neary) and 5 * least(nx, ny) >= 4 * greatest(nx, ny)")
    pairs = x.join(y, meet).select(F.least("nodex", "nodey").alias("a"), F.greatest("nodex", "nodey").alias("b"))
    found = star.unionByName(pairs).distinct().withColumn("c", F.lit(0).cast("long"))
    return common.table(found, f"{path}-found")


def keep_one(docs: DataFrame, folder: str) -> DataFrame:
    """``docs`` with one row for each group that near copies connect: that of the least doc_id. A doc_id may stand for several texts,
    each of which is judged by its own group; of several rows of a group that share the least doc_id the one of the least content hash stays,
    and equal rows are one. Rows without an id can't be told apart and all stay."""
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    each = docs.select("doc_id", node_of(F.col("text")).alias("node"), F.col("text").alias("text"))
    light = common.table(docs.where("doc_id is not null").select("doc_id", node_of(F.col("text")).alias("node"), whole.alias("content")), f"{folder}/light")
    roots = components(links(each, folder), f"{folder}/components")
    rooted = light.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), F.struct("doc_id", "content", "node").alias("x"))
    first = common.table(rooted.groupBy("root").agg(F.min("x").alias("x")).select("x.doc_id", "x.content").distinct(), f"{folder}/first")
    rows = docs.where("doc_id is not null").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("_id"), whole.alias("_content"))
    kept = rows.join(first, (F.col("_id") == F.col("doc_id")) & (F.col("_content") == F.col("content")), "left_semi")
    kept = kept.groupBy("_id", "_content").agg(F.first("row").alias("row"))
    return kept.select("row.*").unionByName(docs.where("doc_id is null"))
