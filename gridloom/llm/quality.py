"""Quality scores by a document classifier and hierarchical empirical Bayes.

A logistic model on shape features (character classes, repetition, lengths) is fitted on at most ``LABELLED`` labelled
rows, drawn by a fixed hash order. Every document's evidence is then combined with posteriors of its host and of its path
on that host: the global mean is the prior of hosts, a host's posterior the prior of its paths, each with a strength
estimated from the spread between groups (method of moments) over all rows. A path's posterior as seen by a document
leaves the document out, so a site of one page says nothing about it.

Defined results: a null text is an empty one; a null host or path name is a group of its own; rows may repeat; a text of any length is read
whole; columns are chosen by name, so extra ones don't clash; without usable labels (none, or of one class) every document has even odds and is kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LABELLED = 20_000
KEEP_AT = 0.5
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1000.0

_CLASS = np.full(256, 7, np.int64)  # class of each byte: other punctuation unless set below
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[128:] = 4
_CLASS[[44, 46]] = 5
_CLASS[[35, 36, 37, 38, 42, 64, 94, 126]] = 6
_CLASS[124] = 8
_CLASS[33] = 9
FEATURES = 10 + 8


def features(text: str | None) -> np.ndarray:
    """Shares of byte classes, then length, word and line statistics; all zero for an empty text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(FEATURES)
    if not raw:
        return out
    share = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=10) / len(raw)
    out[:10] = np.sqrt(share)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n = max(len(words), 1)
    size = {}
    for x in lines:
        size[x] = size.get(x, 0) + 1
    repeated = sum(len(x) * (c - 1) for x, c in size.items())
    triples = len(set(zip(words, words[1:], words[2:], strict=False)))
    out[10] = np.log1p(len(words))
    out[11] = len(raw) / n / 10
    out[12] = len(set(words)) / n
    out[13] = triples / max(len(words) - 2, 1)
    out[14] = repeated / len(raw)
    out[15] = np.log1p(n / max(len(lines), 1))
    out[16] = sum(x.isupper() for x in words) / n
    out[17] = sum(1 for x in words if len(x) == 1) / n
    return out


def _basis(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Features, and for each the steps over its cuts: a smooth additive model stays linear."""
    steps = [np.maximum(x - c, 0) for c in cuts]
    return np.hstack([np.ones((len(x), 1)), x, *steps])


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.3, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Penalised logistic regression by Newton steps: (cuts, weights)."""
    cuts = np.quantile(x, [0.25, 0.5, 0.75, 0.95], axis=0)
    b = _basis(x, cuts)
    w = np.zeros(b.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(b @ w, -30, 30)))
        grad = b.T @ (y - p) - ridge * w
        step = np.linalg.solve((b * (p * (1 - p))[:, None]).T @ b + np.diag(ridge), grad)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return cuts, w


def sample_of(labels: DataFrame, column: str, bound: int) -> DataFrame:
    """At most ``bound`` rows (doc_id, y), in a fixed hash order: a bounded set, whatever the table's size."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(F.max(column).alias("y"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def train(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> tuple[np.ndarray, np.ndarray] | None:
    """The classifier from labelled rows; None if they have one class or none. Broadcasts ``bound`` ids and collects features of as many
    rows at most; of several rows of a labelled doc_id one text is learnt from."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"y": b["y"].astype("float64"), "x": [features(t).tolist() for t in b["text"]]})

    few = F.broadcast(sample_of(labels, "quality", bound))
    chosen = docs.select("doc_id", "text").join(few, "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("y").alias("y"))
    got = chosen.select("text", "y").mapInPandas(rows, "y double, x array<double>").toPandas()
    if got["y"].nunique() < 2:
        return None
    return fit(np.array(got["x"].tolist()), got["y"].to_numpy())


def evidence(model: tuple[np.ndarray, np.ndarray] | None):
    """A vectorised function from text to the classifier's probability."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            if model is None or not len(s):
                yield pd.Series(np.full(len(s), 0.5))
                continue
            x = np.array([features(t) for t in s])
            yield pd.Series(1 / (1 + np.exp(-np.clip(_basis(x, model[0]) @ model[1], -30, 30))))

    return score


def _strength(groups: DataFrame, mean: Column) -> float:
    """Beta prior strength from the spread of group means beyond what their sizes explain."""
    m = F.col("s") / F.col("n")
    row = groups.agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("g"), F.sum(F.col("n") * (m - mean) ** 2).alias("between"),
        F.sum(F.col("q") - F.col("s") * m).alias("within"), F.sum(F.col("n") * F.col("n")).alias("nn"),
    ).first()
    if not row.n or row.g < 2 or row.n <= row.g:
        return MOST_STRENGTH
    within = max(row.within, 0.0) / (row.n - row.g)
    spread = (row.between - (row.g - 1) * within) / max(row.n - row.nn / row.n, 1e-9)
    return float(np.clip(within / spread, LEAST_STRENGTH, MOST_STRENGTH)) if spread > 0 else MOST_STRENGTH


def assess(docs: DataFrame, labels: DataFrame, folder: str, *, host: Column | None = None, path: Column | None = None, bound: int = LABELLED) -> DataFrame:
    """(doc_id, p_doc, host_posterior, path_posterior, quality, keep) for every row."""
    null = F.lit("∅")
    host = F.coalesce((F.col("source") if host is None else host).cast("string"), null)
    path = F.coalesce((F.col("lang") if path is None else path).cast("string"), null)
    score = evidence(train(docs, labels, bound))
    rows = common.table(docs.select("doc_id", host.alias("host"), path.alias("path"), score(F.col("text")).alias("p")), f"{folder}/evidence")
    sums = lambda *by: rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q"))
    paths = common.table(sums("host", "path"), f"{folder}/paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    hosts = common.table(hosts, f"{folder}/hosts")
    total = hosts.agg((F.sum("s") / F.sum("n")).alias("m")).first().m
    mean = 0.5 if total is None else float(total)
    k_host = _strength(hosts, F.lit(mean))
    hosts = hosts.select("host", ((F.col("s") + k_host * mean) / (F.col("n") + k_host)).alias("host_posterior"))
    placed = common.table(paths.join(hosts, "host"), f"{folder}/placed")
    k_path = _strength(placed, F.col("host_posterior"))
    placed = placed.select("host", "path", "n", "s", "host_posterior")
    out = rows.join(placed.withColumnsRenamed({"host": "_h", "path": "_p"}), (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")))
    others = (F.col("s") - F.col("p") + k_path * F.col("host_posterior")) / (F.col("n") - 1 + k_path)
    logit = lambda c: F.log(F.greatest(c, F.lit(1e-6)) / F.greatest(1 - c, F.lit(1e-6)))
    total_logit = logit(F.col("p")) + logit(others) - logit(F.lit(mean))
    quality = 1 / (1 + F.exp(-total_logit))
    return out.select("doc_id", F.col("p").alias("p_doc"), "host_posterior", others.alias("path_posterior"), quality.alias("quality"), (quality >= KEEP_AT).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, folder: str) -> DataFrame:
    """``docs`` without those that ``assess`` rejects; the pipeline's stage. Rows of one doc_id share a decision: the
    best of theirs; rows without an id stay."""
    found = assess(docs, labels, folder)
    poor = found.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or("keep").alias("keep")).where("not keep").select("doc_id")
    return docs.join(poor, "doc_id", "left_anti").select(*docs.columns)
