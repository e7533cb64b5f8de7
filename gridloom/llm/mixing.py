"""Mixing sources to target weights by hierarchical budgeting (DataFrame operations only).

A token budget flows down the tree domain - language - source in whole tokens. Among the children of a node it is split by
weight; a child whose supply (its tokens times ``max_epochs``) is short gets its supply, and what it lacks goes to its
siblings by weight. Only what a whole subtree lacks reaches the siblings of its ancestors. Each leaf then takes whole
epochs while its budget lasts and, of the last one, the token prefix in an order that seed and epoch fix.

The prefix of a leaf of any size needs no sort of the leaf: rows fall into 4096 ranges of the order's key, token
sums per range show the range that the budget ends in, and that range alone is split again until it is small. Texts take no part in
this; equal rows are counted, not listed.

Defined results: null texts have no tokens and aren't chosen; a null domain, language or source is a name of its own; nodes
without a weight have weight ``default``; rows that share an id, or have none, are ordered by a hash of all they hold, equal rows
being exchangeable; a text of any length counts whole; an input column named domain, epoch, tokens or tokens_taken, which the result
adds, comes out as ``input_...``; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

DIGITS = 3  # hex digits of the order that a step looks at: 4096 ranges
PLACES = 48  # hex digits of the order: MD5 of seed, epoch and id, then a hash of the row
EDGE_ROWS = 20_000
BROADCAST_LEAVES = 50_000
LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Mix:
    """``share``: budget as a rational part of all tokens. Weights are whole numbers."""

    share: tuple[int, int] = (1, 2)
    max_epochs: int = 4
    seed: int = 7
    default: int = 10
    weights: dict[str, dict[str, int]] = field(
        default_factory=lambda: {"domain": {"web": 30, "curated": 70}, "lang": {"en": 50, "de": 20, "fr": 20, "es": 10}, "source": {}}
    )


def domain_of(source: Column) -> Column:
    """The demonstration tree's top level: a fixed half of the source names each."""
    return F.when(F.md5(F.coalesce(source, F.lit("")).cast("binary")) < "8", "web").otherwise("curated")


def tokens_of(text: Column) -> Column:
    """Words between white space; built in, so that counting stays in the JVM."""
    words = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.size(F.array_remove(words, "")).cast("long")


def _share(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Add ``budget`` to children (parent..., name, w, cap, total): exact water filling in whole tokens."""
    big = lambda c, p: F.col(c).cast(f"decimal({p},0)")
    df = children.withColumn("cap", F.when(F.col("w") > 0, F.col("cap")).otherwise(F.lit(0)).cast("long"))
    at = Window.partitionBy(*parent)
    order = at.orderBy(F.when(F.col("w") > 0, F.col("cap").cast("double") / F.col("w")).otherwise(F.lit(float("inf"))), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    df = df.withColumn("total", F.least("total", F.sum("cap").over(at)))
    df = df.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("rest", F.sum("w").over(after))
    full = (F.col("w") > 0) & (big("cap", 19) * big("rest", 19) <= big("left", 19) * big("w", 19))
    df = df.withColumn("full", (F.col("cap") == 0) | full)
    df = df.withColumn("open", F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(at), F.lit(0)))
    df = df.withColumn("weight", F.coalesce(F.sum(F.when(~F.col("full"), F.col("w"))).over(at), F.lit(0)))
    product = big("open", 19) * big("w", 19)
    part = F.when(F.col("full"), F.col("cap")).otherwise(F.floor(product / F.greatest(big("weight", 19), F.lit(1))).cast("long"))
    # exact quotient: floor of a rounded decimal quotient may be one too high
    df = df.withColumn("part", part)
    df = df.withColumn("part", F.when(~F.col("full") & (big("part", 19) * big("weight", 19) > product), F.col("part") - 1).otherwise(F.col("part")))
    df = df.withColumn("over", F.when(~F.col("full"), product - big("part", 19) * big("weight", 19)).otherwise(F.lit(-1).cast("decimal(38,0)")))
    df = df.withColumn("spare", F.col("open") - F.coalesce(F.sum(F.when(~F.col("full"), F.col("part"))).over(at), F.lit(0)))
    rank = F.row_number().over(at.orderBy(F.col("over").desc(), name))
    df = df.withColumn("rank", rank)
    one = F.when(~F.col("full") & (F.col("w") > 0) & (F.col("rank") <= F.col("spare")), 1).otherwise(0)
    return df.withColumn("budget", (F.col("part") + one).cast("long")).drop("left", "rest", "full", "open", "weight", "part", "over", "spare", "rank", "total")


def _weight(level: str, mix: Mix) -> Column:
    out = F.lit(mix.default)
    for k, v in mix.weights.get(level, {}).items():
        out = F.when(F.col(level) == k, v).otherwise(out)
    return out.cast("long")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """Leaves (domain, lang, source, tokens) to the same with ``budget``. Names are never null here."""
    cap = F.col("tokens") * mix.max_epochs
    for level in LEVELS:  # what stands below a weight of zero is no supply
        cap = F.when(_weight(level, mix) > 0, cap).otherwise(F.lit(0))
    supply = leaves.withColumn("cap", cap.cast("long"))
    tokens = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first().n  # one number
    goal = tokens * mix.share[0] // mix.share[1]
    up: DataFrame | None = None
    for i, level in enumerate(LEVELS):
        keys = list(LEVELS[: i + 1])
        nodes = supply.groupBy(*keys).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(level, mix)).withColumn("_root", F.lit(0))
        nodes = nodes.withColumn("total", F.lit(goal).cast("long")) if up is None else nodes.join(up, keys[:-1])
        up = _share(nodes, keys[:-1] or ["_root"], level).select(*keys, F.col("budget").alias("total"))
    return leaves.join(up.withColumnRenamed("total", "budget"), list(LEVELS))


def _named(docs: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The row as one struct, the tree's names, tokens, id and a hash of all it holds; null is a name of its own."""
    null = F.lit("∅")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(
        whole.alias("_row"),
        *[F.coalesce(columns[k].cast("string"), null).alias(f"_{k}") for k in LEVELS],
        tokens_of(F.col("text")).alias("_tokens"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_key"),
        F.xxhash64(whole).alias("_content"),
    )


def _cuts(light: DataFrame, plan: DataFrame, folder: str, edge_rows: int) -> tuple[DataFrame, int]:
    """((leaf, epochs, rest, prefix, before), digits): where in each leaf's order the budget ends.

    ``light`` has (leaf, tokens, at), ``at`` being the place in the order as hex digits. Token sums by the next ``DIGITS`` of them
    show the range that the budget ends in, which is then split by the ``DIGITS`` after these, until no such range holds more than
    ``edge_rows`` rows or all digits are used and its rows are equal. A step sums light rows of the open ranges alone.
    """
    leaf = list(LEVELS)
    cuts = plan.select(*leaf, "epochs", "rest", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("before"))
    for used in range(0, PLACES, DIGITS):
        step = F.substring("at", used + 1, DIGITS)
        open_ = light.join(cuts.select(*leaf, "prefix"), leaf).where(F.substring("at", F.lit(1), F.lit(used)) == F.col("prefix"))
        sums = open_.groupBy(*leaf, step.alias("step")).agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("rows"))
        w = Window.partitionBy(*leaf).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)  # 4096 rows of a leaf at most
        sums = sums.withColumn("sum", F.coalesce(F.sum("n").over(w), F.lit(0))).join(cuts.drop("rows"), leaf).withColumn("start", F.col("before") + F.col("sum"))
        found = sums.where((F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("start") + F.col("n")))
        found = found.select(*leaf, "epochs", "rest", F.concat("prefix", "step").alias("prefix"), F.col("start").alias("before"), "rows")
        cuts = common.table(found, f"{folder}/cuts-{used}")
        if (cuts.agg(F.max("rows").alias("n")).first().n or 0) <= edge_rows:  # one number
            break
    return cuts.drop("rows"), used + DIGITS


def mix_sources(docs: DataFrame, folder: str, mix: Mix | None = None, columns: dict[str, Column] | None = None, edge_rows: int = EDGE_ROWS) -> DataFrame:
    """Chosen rows: the columns of ``docs`` with domain, epoch, tokens and tokens_taken; one row per document and epoch.

    The tokens taken in a leaf add up to its budget exactly: the last document of the prefix is taken in part.
    """
    mix = mix or Mix()
    columns = columns or {"domain": domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
    leaf, under = list(LEVELS), [f"_{k}" for k in LEVELS]
    named = _named(docs, columns)
    light = common.table(named.where("_tokens > 0").select(*[F.col(f"_{k}").alias(k) for k in LEVELS], *[F.col(f"_{c}").alias(c) for c in ("tokens", "key", "content")]), f"{folder}/light")
    leaves = common.table(light.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), f"{folder}/leaves")
    plan = budgets(leaves, mix).where("tokens > 0")
    plan = plan.withColumn("epochs", F.expr("budget div tokens")).withColumn("rest", F.col("budget") % F.col("tokens"))
    plan = common.table(plan, f"{folder}/budgets")
    small = plan.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES
    hint = F.broadcast if small else lambda x: x

    def order(key: str, epochs: str, content: str) -> Column:
        """Seed, epoch and id decide; rows that share an id are told apart by what they hold."""
        first = F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.col(epochs).cast("string"), F.col(key)).cast("binary"))
        return F.concat(first, F.lower(F.lpad(F.hex(content), 16, "0")))

    placed = light.join(hint(plan.select(*leaf, "epochs")), leaf).select(*leaf, "tokens", order("key", "epochs", "content").alias("at"))
    cuts, digits = _cuts(placed, hint(plan), folder, edge_rows)
    head = lambda c: F.substring(c, 1, digits)
    # the range that the budget ends in, row by row; equal rows are one with a count
    edge = placed.join(hint(cuts), leaf).where(head("at") == F.col("prefix")).groupBy(*leaf, "at", "tokens", "rest", "before").agg(F.count(F.lit(1)).alias("copies"))
    w = Window.partitionBy(*leaf).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # edge_rows rows of a leaf at most
    edge = edge.withColumn("left", F.col("rest") - F.col("before") - F.coalesce(F.sum(F.col("tokens") * F.col("copies")).over(w), F.lit(0)))
    edge = edge.where("left > 0").withColumn("whole", F.least("copies", F.expr("left div tokens")))
    edge = edge.withColumn("part", F.when(F.col("whole") < F.col("copies"), F.least("tokens", F.col("left") - F.col("whole") * F.col("tokens"))).otherwise(0))
    edge = common.table(edge.select(*[F.col(k).alias(f"_{k}") for k in LEVELS], F.col("at").alias("_at"), "whole", "part"), f"{folder}/edge")

    of_leaf = cuts.select(*[F.col(k).alias(f"_{k}") for k in LEVELS], F.col("epochs").alias("_epochs"), F.col("prefix").alias("_prefix"))
    rows = named.where("_tokens > 0").join(hint(of_leaf), under).withColumn("_at", order("_key", "_epochs", "_content"))
    full = rows.where("_epochs > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_epochs") - 1)).alias("_epoch"), F.col("_tokens").alias("_taken"))
    last = rows.where(head("_at") < F.col("_prefix")).select("*", F.col("_epochs").alias("_epoch"), F.col("_tokens").alias("_taken"))
    # few rows are left here; of equal ones any may stand for all
    ends = rows.where(head("_at") == F.col("_prefix")).groupBy(*under, "_at").agg(*[F.first(c).alias(c) for c in rows.columns if c not in (*under, "_at")])
    ends = ends.join(edge, [*under, "_at"])
    thousand = F.explode(F.sequence(F.lit(1).cast("long"), F.col("whole"), F.lit(1000).cast("long"))).alias("_from")
    taken = ends.where("whole > 0").select("*", thousand).select("*", F.explode(F.array_repeat(F.lit(0), F.least(F.col("whole") - F.col("_from") + 1, F.lit(1000)).cast("int"))))
    taken = taken.select(*rows.columns, F.col("_epochs").alias("_epoch"), F.col("_tokens").alias("_taken"))
    part = ends.where("part > 0").select(*rows.columns, F.col("_epochs").alias("_epoch"), F.col("part").alias("_taken"))
    out = full.unionByName(last).unionByName(taken).unionByName(part)
    extra = {"domain": "_domain", "epoch": "_epoch", "tokens": "_tokens", "tokens_taken": "_taken"}
    return out.select(*[F.col(f"_row.`{c}`").alias(_free(c, [*docs.columns, *extra]) if c in extra else c) for c in docs.columns], *[F.col(v).alias(k) for k, v in extra.items()])


def _free(name: str, taken: list[str]) -> str:
    """``input_name``, with as many more ``input_`` before it as it takes to be new."""
    while name in taken:
        name = f"input_{name}"
    return name


def report(docs: DataFrame, folder: str, mix: Mix | None = None) -> DataFrame:
    return mix_sources(docs.select("doc_id", "text", "lang", "source"), folder, mix).drop("text")


def oracle(mix: Mix | None = None) -> str:
    """DuckDB SQL for ``report``."""
    mix = mix or Mix()
    weight = lambda level: "CASE " + level + "".join(f" WHEN '{k}' THEN {v}" for k, v in mix.weights[level].items()) + f" ELSE {mix.default} END" if mix.weights[level] else str(mix.default)
    steps, up = [], "goal"
    for i, level in enumerate(LEVELS):
        keys, parent = ", ".join(LEVELS[: i + 1]), ", ".join(LEVELS[:i]) or "1"
        link = f"JOIN up{i - 1} USING ({parent})" if i else ", goal"
        part, order = f"PARTITION BY {parent}", f"ORDER BY cap::DOUBLE / w, {level}"
        steps.append(f"""
n{i} AS (SELECT x.*, total FROM (SELECT {keys}, sum(tokens * {mix.max_epochs}) AS cap, {weight(level)} AS w FROM leaf GROUP BY {keys}) x {link}),
a{i} AS (SELECT * REPLACE (least(total, sum(cap) OVER ({part})) AS total) FROM n{i}),
b{i} AS (SELECT *, total - coalesce(sum(cap) OVER ({part} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rem, sum(w) OVER ({part} {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM a{i}),
c{i} AS (SELECT *, cap = 0 OR cap::HUGEINT * rest <= rem::HUGEINT * w AS done FROM b{i}),
d{i} AS (SELECT *, total - coalesce(sum(cap) FILTER (done) OVER ({part}), 0) AS pot, sum(w) FILTER (NOT done) OVER ({part}) AS weight FROM c{i}),
e{i} AS (SELECT *, CASE WHEN done THEN cap ELSE pot::HUGEINT * w // weight END AS part, CASE WHEN done THEN -1 ELSE pot::HUGEINT * w % weight END AS over FROM d{i}),
f{i} AS (SELECT *, pot - coalesce(sum(part) FILTER (NOT done) OVER ({part}), 0) AS spare, row_number() OVER ({part} ORDER BY over DESC, {level}) AS rn FROM e{i}),
up{i} AS (SELECT {keys}, (part + CASE WHEN NOT done AND rn <= spare THEN 1 ELSE 0 END)::BIGINT AS total FROM f{i})""")
    return f"""
WITH doc AS (SELECT doc_id, documents.lang AS own_lang, documents.source AS own_source, CASE WHEN md5(coalesce(source, '')) < '8' THEN 'web' ELSE 'curated' END AS domain,
       coalesce(lang, '∅') AS lang, coalesce(source, '∅') AS source, len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(tokens) AS tokens FROM doc GROUP BY ALL),
goal AS (SELECT (coalesce(sum(tokens), 0) * {mix.share[0]} // {mix.share[1]})::BIGINT AS total FROM leaf),{",".join(steps)},
plan AS (SELECT domain, lang, source, total // leaf.tokens AS epochs, total % leaf.tokens AS rest FROM leaf JOIN up2 USING (domain, lang, source) WHERE leaf.tokens > 0),
row_ AS (SELECT *, md5('{mix.seed}:' || epochs::BIGINT || ':' || coalesce(doc_id::VARCHAR, '')) AS k FROM doc JOIN plan USING (domain, lang, source) WHERE tokens > 0),
put AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY k, coalesce(doc_id::VARCHAR, ''), tokens ROWS UNBOUNDED PRECEDING) - tokens AS start FROM row_)
SELECT doc_id, own_lang AS lang, own_source AS source, domain, e::BIGINT AS epoch, tokens, tokens AS tokens_taken FROM row_, unnest(range(epochs::BIGINT)) AS u(e)
UNION ALL
SELECT doc_id, own_lang, own_source, domain, epochs::BIGINT, tokens, least(tokens, rest - start)::BIGINT FROM put WHERE start < rest"""
