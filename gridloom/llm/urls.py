"""URL filters with redirect equivalence.

Redirect and canonical-link edges make aliases; their connected
components are found by distributed steps, and a component without an explicit allow takes over a block of any member.
An explicit rule on a url itself always decides that url; an explicit allow in a component protects its aliases. Rules are a table of
any size, joined by host suffix and path prefix. All canonical links and refreshes of a page count, and their targets are
resolved against the page as url references are.

Defined results: html of any length is read whole; a null url, or one without ``://``, has an empty host and path, no rule and no aliases, and is allowed;
repeated rows are judged alike, one output row each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components


@dataclass(frozen=True)
class Rule:
    """``host`` covers its subdomains; ``path`` is a prefix that starts with a slash."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


# Fixed rules of the registered query.
RULES = (
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
)


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, query with its mark) of a url; all empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substring(rest, F.char_length(raw) + 1, F.char_length(rest))
    path = F.regexp_extract(tail, r"^[^?#]*", 0)
    query = F.regexp_extract(tail, r"^[^?#]*(\?[^#]*)?", 1)
    return common.lower_ascii(raw), path, query


def rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    """Rules as a table (rule_host, rule_path, rule_verdict, place): what ``judge`` takes, of any size. Of equally long rules that fit the
    least place wins."""
    rows = [(r.host, r.path, r.verdict, i) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_host string, rule_path string, rule_verdict string, place long")


def match(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, own) of the distinct places (host, path) that a rule fits, by its longest rule.

    Joins by equality alone: a host's suffixes at dots meet the rules' hosts, and the path's prefixes of the lengths that such a
    host's rules have meet the rules' paths.
    """
    lengths = rules.groupBy("rule_host").agg(F.collect_set(F.char_length("rule_path")).alias("lengths"))  # not more than a path is long
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = places.select("host").distinct().select("host", F.explode(suffixes).alias("rule_host")).join(lengths, "rule_host")
    cuts = places.join(hosts, "host").select("host", "path", "rule_host", F.explode(F.filter("lengths", lambda n: n <= F.char_length("path"))).alias("n"))
    cuts = cuts.withColumn("rule_path", F.substring("path", F.lit(1), F.col("n")))
    best = F.struct((F.char_length("rule_host") + F.char_length("rule_path")).alias("long"), (-F.col("place")).alias("place"), F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("own"))
    return cuts.join(rules, ["rule_host", "rule_path"]).groupBy("host", "path").agg(F.max(best).alias("x")).select("host", "path", "x.rule", "x.own")


def _without_dots(path: Column) -> Column:
    """A path without the segments ``.`` and ``..``."""

    def step(done: Column, x: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))
        return F.when(x == "..", up).when(x == ".", done).otherwise(F.concat(done, F.array(x)))

    parts = F.split(path, "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    last = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(F.contains(path, F.lit("/.")), F.array_join(last, "/")).otherwise(path)


def resolved(target: Column, host: Column, path: Column) -> Column:
    """A url reference as a whole url, seen from a page at host and path; null if it names no other page by host."""
    t = F.regexp_extract(F.replace(target, F.lit("&amp;"), F.lit("&")), r"^[^#]*", 0)
    own = F.regexp_extract(t, r"^[^?]*", 0)
    query = F.regexp_extract(t, r"^[^?]*(.*)$", 1)
    home, folder = F.concat(F.lit("https://"), host), F.regexp_extract(path, r"^.*/", 0)
    folder = F.when(folder == "", "/").otherwise(folder)
    return (
        F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), t)
        .when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))  # mailto: and the like
        .when(t.startswith("//"), F.concat(F.lit("https:"), t))
        .when(t.startswith("/"), F.concat(home, _without_dots(own), query))
        .when(t.startswith("?"), F.concat(home, path, query))
        .when(t != "", F.concat(home, _without_dots(F.concat(folder, own)), query))
    )


LINK = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
META = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): a page's node and those of all its canonical links and refreshes. Nodes are host + path + query."""
    page = F.coalesce(F.col(html), F.lit(""))
    low = F.lower(page)
    every = lambda word, tag, value: F.when(
        F.contains(low, F.lit(word)), F.transform(F.regexp_extract_all(page, F.lit(tag), F.lit(0)), lambda x: F.regexp_extract(x, value, 1))
    ).otherwise(F.array().cast("array<string>"))
    targets = F.concat(every("canonical", LINK, r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""), every("refresh", META, r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""))
    host, path, query = split_url(F.col(url))
    both = pages.select(host.alias("host"), path.alias("path"), F.concat(host, path, query).alias("a"), F.explode(targets).alias("to"))
    # a generator keeps the optimizer from writing this expression out at each of its uses below
    return _pairs(both.select("a", F.explode_outer(F.array(resolved(F.col("to"), F.col("host"), F.col("path")))).alias("to")))


def redirect_edges(redirects: DataFrame, source: str = "from_url", target: str = "to_url") -> DataFrame:
    """(a, b) of a table of redirects."""
    return _pairs(redirects.select(F.concat(*split_url(F.col(source))).alias("a"), F.col(target).alias("to")))


def _pairs(df: DataFrame) -> DataFrame:
    b = F.concat(*split_url(F.col("to")))
    return df.select("a", b.alias("b")).where((F.col("a") != "") & (F.col("b") != "") & (F.col("a") != F.col("b"))).distinct()


def judge(
    pages: DataFrame,
    folder: str,
    *,
    rules: tuple[Rule, ...] | DataFrame = RULES,
    redirects: DataFrame | None = None,
    page_id: str = "page_id",
    url: str = "url",
    html: str | None = "html",
) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``. ``rules`` may be a table as ``rule_table`` makes."""
    if not isinstance(rules, DataFrame):
        rules = rule_table(pages.sparkSession, rules)
    edges = None if html is None else alias_edges(pages, url, html)
    if redirects is not None:
        more = redirect_edges(redirects)
        edges = more if edges is None else edges.unionByName(more)
    host, path, query = split_url(F.col(url))
    own = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), query.alias("query"))
    own = own.withColumn("node", F.concat("host", "path", "query"))
    places = own.select("host", "path")
    if edges is None:
        voted = own.select(F.col("node").alias("to"), F.lit(None).cast("string").alias("alias_verdict")).limit(0)
        ruled = common.table(match(places.distinct(), rules), f"{folder}/ruled")
    else:
        roots = components(edges, f"{folder}/aliases")
        h, p, _ = split_url(F.concat(F.lit("https://"), F.col("node")))
        placed = common.table(roots.select("node", "root", h.alias("host"), p.alias("path")), f"{folder}/roots")
        ruled = common.table(match(places.unionByName(placed.select("host", "path")).distinct(), rules), f"{folder}/ruled")
        votes = placed.join(ruled, ["host", "path"]).groupBy("root").agg(F.bool_or(F.col("own") == "allow").alias("allowed"), F.bool_or(F.col("own") == "block").alias("blocked"))
        votes = common.table(votes, f"{folder}/votes")
        said = F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block")
        voted = common.table(placed.join(votes, "root").select(F.col("node").alias("to"), said.alias("alias_verdict")), f"{folder}/voted")
    out = own.join(ruled, ["host", "path"], "left").join(voted, F.col("node") == F.col("to"), "left")
    final = F.coalesce("own", "alias_verdict", F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", final.alias("verdict"))


ORACLE = r"""
WITH RECURSIVE rules(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
split AS (SELECT page_id, coalesce(html, '') AS page, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosted AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM split),
own AS (SELECT page_id, page, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*(\?[^#]*)?', 1) AS query FROM hosted),
tag AS (SELECT host, path, host || path || query AS a, unnest(regexp_extract_all(page, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>')) AS x, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)' AS p FROM own
        UNION ALL SELECT host, path, host || path || query, unnest(regexp_extract_all(page, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>')), '(?is)\burl\s*=\s*["'']?([^"''\s>]+)' FROM own),
target AS (SELECT a, host, path, regexp_extract(replace(CASE WHEN p LIKE '%href%' THEN regexp_extract(x, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) ELSE regexp_extract(x, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) END, '&amp;', '&'), '^[^#]*') AS t FROM tag),
piece AS (SELECT *, regexp_extract(t, '^[^?]*') AS tp, regexp_extract(t, '^[^?]*(.*)$', 1) AS tq, CASE WHEN regexp_extract(path, '^.*/') = '' THEN '/' ELSE regexp_extract(path, '^.*/') END AS dir FROM target WHERE t <> ''),
joined AS (SELECT *, string_split(CASE WHEN starts_with(t, '/') THEN tp ELSE dir || tp END, '/') AS seg FROM piece),
dotted AS (SELECT *, list_reduce(list_transform(seg, lambda s: [s]), lambda acc, s: CASE WHEN s[1] = '..' THEN acc[1:greatest(len(acc) - 1, 1)] WHEN s[1] = '.' THEN acc ELSE list_concat(acc, s) END) AS done FROM joined),
absolute AS (SELECT a, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN substr(t, strpos(t, '://') + 3) WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN '' WHEN starts_with(t, '//') THEN substr(t, 3)
             WHEN starts_with(t, '?') THEN host || path || tq ELSE host || array_to_string(CASE WHEN seg[-1] IN ('.', '..') THEN list_concat(done, ['']) ELSE done END, '/') || tq END AS rest FROM dotted),
aimed AS (SELECT a, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM absolute),
edge AS (SELECT DISTINCT a, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(substr(rest, length(raw) + 1), '^[^#]*') AS b FROM aimed WHERE a <> ''),
both_ways AS (SELECT a, b FROM edge WHERE b <> '' AND a <> b UNION SELECT b, a FROM edge WHERE b <> '' AND a <> b),
node AS (SELECT DISTINCT a AS node, regexp_extract(a, '^[^/?#]*') AS host, regexp_extract(substr(a, length(regexp_extract(a, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM both_ways),
vote AS (SELECT node, arg_max(v, length(h || p)) AS v FROM node JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY node),
reach(node, v) AS (SELECT node, v FROM vote UNION SELECT b, v FROM reach JOIN both_ways ON node = a),
said AS (SELECT node, CASE WHEN bool_or(v = 'allow') THEN 'allow' ELSE 'block' END AS v FROM reach GROUP BY node),
ruled AS (SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
          FROM (SELECT DISTINCT host, path FROM own) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
SELECT page_id, own.host, own.path, rule, coalesce(ruled.v, said.v, 'allow') AS verdict
FROM own LEFT JOIN ruled ON own.host = ruled.host AND own.path = ruled.path LEFT JOIN said ON said.node = own.host || own.path || own.query
"""


def report(pages: DataFrame, folder: str) -> DataFrame:
    return judge(pages, folder)
