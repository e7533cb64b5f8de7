"""Personal data by boosted trees over proposed spans (DataFrame operations only).

Generators of high recall propose spans, which may overlap. The four base kinds are accepted by their own checks. All other
proposals are scored by boosted trees on format and context features; a kind's threshold is calibrated on held-out rows so
that at least ``PRECISION`` of what it accepts is right, and of overlapping accepted proposals the best score stays.
The trees are fitted on the driver from ``training_rows`` (a fixed, seeded set of ``TRAIN_ROWS`` labelled snippets) and
become one SQL expression, so the pass over the corpus is a map without any exchange.

Defined results: a null text is empty and has no spans; every input row gives one output row; extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, spans

TRAIN_ROWS = 1200
ROUNDS = 24
RATE = 0.3
PRECISION = 0.98

# Fixed patterns in listing order; the first four are the base kinds. Loops are possessive and runs are entered at their
# start only, which matches the same spans as the plain forms without their backtracking on very long runs.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TEL = r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
MASKED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]{1,63}){1,8}"
BASE = ("email", "ip", "card", "phone")
EXTRA = ("tel", "ssn", "iban", "masked")
WORDS = ("tel", "phone", "call", "ssn", "social", "iban", "account", "mail", "contact", "part", "order", "isbn", "serial", "version")
FEATURES = ("length", "n_digits", "n_letters", "n_seps", "distinct_digits", "first_digit", "before_letter", "after_letter", "kind", *WORDS)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = _digits(m)
    n = F.char_length(d)

    def add(acc: Column, i: Column) -> Column:
        v = F.substring(d, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(v > 9, v - 9).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _octet(p: Column) -> Column:
    p = F.regexp_replace(p, "^0+", "")
    return (F.char_length(p) <= 2) | ((F.char_length(p) == 3) & (p <= "255"))


def _none() -> Column:
    return F.array().cast(spans.HIT)


def base_hits(text: Column) -> dict[str, Column]:
    """Hits of the base kinds. Each pattern runs only over texts that pass a cheap necessary test."""
    hits = lambda may, pattern: F.when(may, spans.regex_hits(text, pattern)).otherwise(_none())
    n = lambda x: F.char_length(_digits(x["m"]))
    return {
        "email": hits(F.contains(text, F.lit("@")), EMAIL),
        "ip": F.filter(hits(text.rlike(IP), IP), lambda x: F.forall(F.split(x["m"], r"\."), _octet)),
        "card": F.filter(hits(text.rlike(CARD), CARD), lambda x: n(x).between(14, 19) & _luhn(x["m"])),
        "phone": F.filter(hits(F.contains(text, F.lit("+")), PHONE), lambda x: n(x).between(10, 15)),
    }


def proposals(text: Column) -> dict[str, Column]:
    """Hits of the kinds that the trees decide."""
    hits = lambda may, pattern: F.when(may, spans.regex_hits(text, pattern)).otherwise(_none())
    masked = F.lower(text)
    return {
        "tel": hits(text.rlike(TEL), TEL),
        "ssn": hits(text.rlike(SSN), SSN),
        "iban": hits(text.rlike(IBAN), IBAN),
        "masked": hits(F.contains(masked, F.lit("(at)")) | F.contains(masked, F.lit("[at]")), MASKED),
    }


CONTEXT = 24


def _features(hits: Column, text: Column, kind: int) -> Column:
    """Format and context features of each hit as structs of ints."""

    def of(x: Column, before: Column, after: Column) -> Column:
        now = F.struct(F.lower(before).alias("near"), _digits(x["m"]).alias("d"), F.substring(before, -1, 1).alias("b"), after.alias("a"))
        return spans.let(now, lambda c: _values(x, c["near"], c["d"], c["b"], c["a"], kind))

    return spans.in_context(hits, text, CONTEXT, of)


def _values(x: Column, near: Column, d: Column, before: Column, after: Column, kind: int) -> Column:
    m = x["m"]
    is_letter = lambda c: F.when(c.rlike(r"^\p{L}$"), 1).otherwise(0)
    values = {
        "length": F.char_length(m),
        "n_digits": F.char_length(d),
        "n_letters": F.char_length(F.regexp_replace(m, "[^A-Za-z]", "")),
        "n_seps": F.char_length(F.regexp_replace(m, "[A-Za-z0-9]", "")),
        "distinct_digits": F.size(F.array_distinct(F.split(d, ""))),
        "first_digit": F.coalesce(F.try_to_number(F.substring(d, 1, 1), F.lit("9")).cast("int"), F.lit(-1)),
        "before_letter": is_letter(before),
        "after_letter": is_letter(after),
        "kind": F.lit(kind),
    } | {w: F.contains(near, F.lit(w)).cast("int") for w in WORDS}
    return F.struct(x["s"].alias("s"), x["e"].alias("e"), *[values[f].cast("int").alias(f) for f in FEATURES])


def training_rows() -> list[tuple[str, str, int]]:
    """(text, kind, label): snippets made from a fixed seed; negatives have the same shapes in other contexts."""
    rng = random.Random(20240229)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    filler = ("the", "of", "and", "la", "de", "der", "und", "que", "see", "was", "in", "to")
    shapes = {
        "tel": lambda: rng.choice(("{} {} {}", "{}-{}-{}", "({}) {}-{}", "{}.{}.{}")).format(rng.choice("23456789") + digits(2), digits(3), digits(4)),
        "ssn": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        "iban": lambda: rng.choice(("DE", "FR", "ES", "GB", "NL")) + digits(2) + "".join(digits(4) for _ in range(rng.randint(3, 5))),
        "masked": lambda: f"{rng.choice(('ann', 'j.doe', 'info', 'sales'))} {rng.choice(('(at)', '[at]'))} {rng.choice(('example', 'mail'))}{rng.choice(('.com', ' [dot] org', '.net'))}",
    }
    good = {"tel": ("call", "phone", "tel:", "contact"), "ssn": ("ssn", "social security"), "iban": ("iban", "account"), "masked": ("mail", "contact", "write to")}
    poor = {"tel": ("part no", "order", "version"), "ssn": ("part", "serial no", "order"), "iban": ("serial", "part", "version"), "masked": ("serial", "version", "part")}
    rows = []
    for i in range(TRAIN_ROWS):
        kind = EXTRA[i % len(EXTRA)]
        label = (i // len(EXTRA)) % 2
        near = rng.choice(good[kind] if label else (*poor[kind], ""))
        words = [rng.choice(filler) for _ in range(6)]
        rows.append((" ".join([*words[:3], near, shapes[kind](), *words[3:]]), kind, label))
    return rows


def _boost(x: list[tuple], y: list[int]) -> tuple[float, list]:
    """Depth-two trees on the gradient of the log loss: (prior, [(feature, cut, low side, high side)]); a side is (feature,
    cut, leaf, leaf)."""
    rows, label = np.array(x, float), np.array(y, float)
    cuts = [(f, c) for f in range(rows.shape[1]) for c in sorted(set(rows[:, f]))[1:17]]
    below = np.array([rows[:, f] < c for f, c in cuts])
    prior = math.log((label.sum() + 1) / (len(y) - label.sum() + 1))
    score, trees = np.full(len(y), prior), []

    def split(part: np.ndarray, g: np.ndarray, h: np.ndarray) -> int:
        lg, lh = below @ (g * part), below @ (h * part)
        gain = lg**2 / (lh + 1) + ((g * part).sum() - lg) ** 2 / ((h * part).sum() - lh + 1)
        return int(np.argmax(np.round(gain, 9)))

    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        g, h = label - p, p * (1 - p)
        top = split(np.ones(len(y), bool), g, h)
        sides = []
        for part in (below[top], ~below[top]):
            i = split(part, g, h)
            leaves = []
            for leaf in (part & below[i], part & ~below[i]):
                leaves.append(float(RATE * g[leaf].sum() / (h[leaf].sum() + 1)))
                score[leaf] += leaves[-1]
            sides.append((*cuts[i], *leaves))
        trees.append((*cuts[top], *sides))
    return prior, trees


def _score_of(model: tuple[float, list], row: tuple) -> float:
    total = model[0]
    for f, c, low, high in model[1]:
        f2, c2, a, b = low if row[f] < c else high
        total += a if row[f2] < c2 else b
    return total


@functools.lru_cache(maxsize=1)
def _fit(key: tuple) -> tuple[tuple[float, list], dict[str, float]]:
    """Trees from two thirds of the rows and, from the rest, each kind's least score that keeps ``PRECISION``."""
    train, held = [r for i, r in enumerate(key) if i % 3], [r for i, r in enumerate(key) if i % 3 == 0]
    model = _boost([r[0] for r in train], [r[1] for r in train])
    cut = {}
    for k, kind in enumerate(EXTRA):
        scored = sorted(((_score_of(model, f), y) for f, y in held if f[FEATURES.index("kind")] == k), reverse=True)
        right, best = 0, math.inf
        for n, (s, y) in enumerate(scored, 1):
            right += y
            if right / n >= PRECISION:
                best = s
        cut[kind] = max(best, 0.0)  # never below even odds
    return model, cut


def fit(spark: SparkSession) -> tuple[tuple[float, list], dict[str, float]]:
    """Features come from the same expressions that score the corpus; the bounded table is collected to the driver."""
    rows = spark.createDataFrame(training_rows(), "text string, kind string, label int")
    cols = proposals(F.col("text"))
    rows = rows.select("text", "label", "kind", *[c.alias(f"p_{k}") for k, c in cols.items()])
    feats = F.coalesce(*[F.when(F.col("kind") == k, F.get(_features(F.col(f"p_{k}"), F.col("text"), i), F.lit(0))) for i, k in enumerate(EXTRA)])
    got = rows.select(feats.alias("f"), "label").where("f is not null").collect()  # TRAIN_ROWS rows at most
    return _fit(tuple(sorted((tuple(r.f[f] for f in FEATURES), r.label) for r in got)))


def _score(x: Column, model: tuple[float, list]) -> Column:
    total = F.lit(float(model[0]))
    for f, c, low, high in model[1]:
        side = lambda t: F.when(x[FEATURES[t[0]]] < int(t[1]), F.lit(float(t[2]))).otherwise(F.lit(float(t[3])))
        total = total + F.when(x[FEATURES[f]] < int(c), side(low)).otherwise(side(high))
    return total


def detect(docs: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep``, text, one array of hits per base kind, and ``extra``: accepted (s, e, kind, score)."""
    model, cut = fit(docs.sparkSession)
    t = F.col("text")
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), common.text_of(text).alias("text"))
    df = df.withColumn("digit", t.rlike("[0-9]"))
    guard = lambda k, c: c if k in ("email", "masked") else F.when(F.col("digit"), c).otherwise(_none())
    df = df.select("row", "text", *[guard(k, c).alias(k) for k, c in (base_hits(t) | proposals(t)).items()])
    feats = [_features(F.col(k), t, i) for i, k in enumerate(EXTRA)]
    df = df.select("row", "text", *BASE, F.concat(*feats).alias("f"))
    kinds = F.array(*[F.lit(k) for k in EXTRA])
    at_least = F.array(*[F.lit(float(min(cut[k], 1e300))) for k in EXTRA])
    scored = F.transform(
        "f",
        lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.get(kinds, x["kind"]).alias("kind"), x["kind"].alias("k"), _score(x, model).alias("score")),
    )
    df = df.select("row", "text", *BASE, F.filter(scored, lambda x: x["score"] >= F.get(at_least, x["k"])).alias("x"))
    taken = F.concat(*[F.transform(k, lambda h: F.struct(h["s"].alias("s"), h["e"].alias("e"))) for k in BASE])
    order = lambda a: F.struct(-a["score"], a["s"], a["k"])
    free = spans.not_beaten(F.array_sort("x"), taken, lambda b, a: F.lit(True))
    df = df.select("row", "text", *BASE, free.alias("x"))
    best = spans.not_beaten(F.col("x"), F.col("x"), lambda b, a: order(b) < order(a))
    return df.select("row.*", "text", *BASE, best.alias("extra"))


def report(docs: DataFrame) -> DataFrame:
    found = detect(docs)
    base = F.concat(*[spans.labelled(F.col(k), i, k) for i, k in enumerate(BASE)])
    more = F.transform("extra", lambda x: F.struct(x["s"].alias("s"), (x["k"] + len(BASE)).alias("k"), x["kind"].alias("kind"), x["e"].alias("e")))
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(spans.joined(base), 256).alias("base_sha256"),
        spans.joined(F.concat(base, more)).alias("spans"),
    )
