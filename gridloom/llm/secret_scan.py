"""Secret scans by an incremental blob ledger (DataFrame operations only).

Every version of every document is addressed by the SHA-256 of its text. A ledger table holds what each
(blob, rule version) pair contained; a run scans only blobs that the ledger lacks for the current rules, appends what it
found, and joins the ledger back to all paths. Copies of a text, however many, are scanned once: they meet in a
map-side aggregate before the only exchange that carries texts. The ledger lies where the caller says; the registered query takes
the folder from the session's ``LEDGER`` setting and keeps it for later runs, or starts a fresh one where that is unset.

Defined results: a null text counts as empty and has no findings; every input row gives one output row, repeated rows and
repeated ids included; a blob that the ledger holds twice counts once; a text may hold any number of secrets; an empty table gives an empty
result; extra columns of the input are ignored, and those that clash with added names are kept in ``redacted``.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, spans

LEDGER = "spark.gridloom.secretLedger"


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``hint`` is a cheap necessary condition; ``group``/``least``: a group's least length."""

    kind: str
    pattern: str
    hint: tuple[str, ...]
    fold: bool = False
    group: int = 0
    least: int = 0


# Fixed patterns, in the order in which kinds are listed. The first three are the base kinds.
RULES = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
        True,
        2,
        8,
    ),
    Rule("access", r"AKIA[A-Z0-9]{12,}", ("AKIA",)),
    Rule("hex", r"[0-9a-f]{32,}", ()),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", ("PRIVATE KEY-----",)),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", ("gh",)),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", ("xox",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", ("eyJ",)),
)
BASE = 3


def version_of(rules: tuple[Rule, ...]) -> str:
    """A digest of the rules themselves: whoever edits one gets another version and a new scan."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def _hits(rule: Rule, text: Column, folded: Column) -> Column:
    hits = spans.regex_hits(text, rule.pattern, rule.group)
    if rule.least:
        hits = F.filter(hits, lambda x: F.char_length(x["g"]) >= rule.least)
    if rule.hint:
        body = folded if rule.fold else text
        may = F.contains(body, F.lit(rule.hint[0]))
        for word in rule.hint[1:]:
            may = may | F.contains(body, F.lit(word))
    else:
        may = text.rlike(rule.pattern)
    return F.when(may, hits).otherwise(F.array().cast(spans.HIT))


def find(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blobs`` (blob, text) to (blob, hits per rule as arrays named by kind)."""
    folded = blobs.withColumn("folded", F.lower("text"))
    return folded.select("blob", *[_hits(r, F.col("text"), F.col("folded")).alias(r.kind) for r in rules])


def _ledger(spark: SparkSession, path: str, version: str, schema) -> DataFrame | None:
    """The part of the ledger that belongs to these rules, one row for each blob, also if two runs wrote it at the same time; None if
    nothing has been written yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path).where(F.col("rule_version") == version).dropDuplicates(["blob"])
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def scan(
    docs: DataFrame,
    ledger_path: str,
    *,
    paths: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    rules: tuple[Rule, ...] = RULES,
    rule_version: str | None = None,
) -> DataFrame:
    """Scan unseen blobs into the ledger at ``ledger_path`` and return one row per input row.

    Columns: ``paths``, blob (hex), one array of hits (s, e, secret_sha256) per rule kind. Appending is Spark's own
    committed write, so a lost executor or a failed run leaves no half-written findings; a repeated run scans nothing.
    """
    out = _scanned(docs, ledger_path, paths, text, rules, rule_version)
    return out.select("row.*", *[c for c in out.columns if c != "row"])


def _scanned(docs: DataFrame, ledger_path: str, paths: tuple[str, ...], text: str = "text", rules: tuple[Rule, ...] = RULES, rule_version: str | None = None) -> DataFrame:
    """As ``scan`` with the paths in one struct, so that their names can't clash."""
    spark, rule_version = docs.sparkSession, rule_version or version_of(rules)
    versions = docs.select(F.struct(*[F.col(f"`{p}`") for p in paths]).alias("row"), F.unhex(F.sha2(common.text_of(text), 256)).alias("blob"))
    blobs = docs.select(
        F.unhex(F.sha2(common.text_of(text), 256)).alias("blob"), common.text_of(text).alias("text")
    ).groupBy("blob").agg(F.first("text").alias("text"))
    hit = "array<struct<s:int,e:int,secret_sha256:string>>"
    schema = "blob binary, rule_version string, " + ", ".join(f"{r.kind} {hit}" for r in rules)
    if (seen := _ledger(spark, ledger_path, rule_version, schema)) is not None:
        blobs = blobs.join(seen.select("blob"), "blob", "left_anti")
    kept = lambda kind: F.transform(  # noqa: E731  the ledger holds digests of secrets, never the secrets
        kind, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.sha2(x["m"], 256).alias("secret_sha256"))
    )
    found = find(blobs, rules)
    found = found.select("blob", F.lit(rule_version).alias("rule_version"), *[kept(F.col(r.kind)).alias(r.kind) for r in rules])
    found.write.mode("append").parquet(ledger_path)
    # a table of its own, so that the join below has plain scans on both sides and Spark can split a blob with very many rows
    seen = common.table(_ledger(spark, ledger_path, rule_version, schema).drop("rule_version"), f"{common.shared_dir(spark)}/known")
    return versions.join(seen, "blob", "left").withColumn("blob", F.lower(F.hex("blob")))


def report(findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts, digest of the base spans, and all spans as text, for each row of ``scan``."""
    base = F.concat(*[spans.labelled(F.col(r.kind), i, r.kind) for i, r in enumerate(rules[:BASE])])
    every = F.concat(*[spans.labelled(F.col(r.kind), i, r.kind) for i, r in enumerate(rules)])
    return findings.select(
        "doc_id",
        *[F.size(r.kind).cast("long").alias(f"n_{r.kind}") for r in rules[:BASE]],
        F.sha2(spans.joined(base), 256).alias("base_sha256"),
        spans.joined(every).alias("spans"),
        "blob",
    )


def oracle() -> str:
    """DuckDB SQL for ``report``: gaps between matches and the matches give all positions."""
    quote = lambda x: x.replace("'", "''")
    rules = ", ".join(f"({k}, '{r.kind}', '{quote(r.pattern)}', {r.least})" for k, r in enumerate(RULES) if not r.group)
    assign = quote(RULES[0].pattern)
    base = f"FILTER (k < {BASE})"
    return f"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
plain AS (SELECT doc_id, k, kind, regexp_extract_all(t, p) AS ms, regexp_extract_all(t, p) AS gs, string_split_regex(t, p) AS gaps, least FROM doc, (VALUES {rules}) AS r(k, kind, p, least)),
assign AS (SELECT doc_id, 0 AS k, 'assign' AS kind, regexp_extract_all(t, '{assign}') AS ms, regexp_extract_all(t, '{assign}', 2) AS gs, string_split_regex(t, '{assign}') AS gaps, {RULES[0].least} AS least FROM doc),
hit AS (SELECT doc_id, k, kind, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0))::BIGINT AS s, length(ms[i]) AS n, length(gs[i]) AS g, least
        FROM (SELECT * FROM plain UNION ALL SELECT * FROM assign), unnest(range(1, len(ms) + 1)) AS u(i) WHERE len(ms) > 0),
span AS (SELECT doc_id, k, s, kind || ':' || s || ':' || (s + n) AS txt FROM hit WHERE g >= least),
per AS (SELECT doc_id, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c,
        string_agg(txt, ',' ORDER BY s, k) {base} AS base, string_agg(txt, ',' ORDER BY s, k) AS spans FROM span GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(t) AS blob
FROM doc LEFT JOIN per USING (doc_id)"""


def redacted(docs: DataFrame, ledger_path: str) -> DataFrame:
    """``documents`` with each found secret replaced by ``[SECRET]``; the pipeline's stage. Clean rows stay as they are."""
    found = _scanned(docs, ledger_path, tuple(docs.columns))
    pair = lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))
    found = found.select("row", F.array_sort(F.concat(*[F.transform(F.col(r.kind), pair) for r in RULES])).alias("spans"))
    clean = spans.replaced(F.col("row.text"), F.col("spans"), "[SECRET]")
    out = found.select("row", F.when(F.size("spans") > 0, clean).alias("clean"))
    new = {"text": F.coalesce("clean", "row.text"), "n_chars": F.when(F.col("clean").isNotNull(), F.char_length("clean").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])
