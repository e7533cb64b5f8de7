"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models with absolute discounting and Kneser-Ney lower orders, one of toxic and one of ordinary rows, back off to
a class's counts of stems (the first five letters), and within a stem to one shared distribution: the word counts of
the whole corpus. A rare expression that either class lacks thus gets the backing of its stem, and a rare stem the same
backing in both classes; only what differs between the classes moves the score. A document is scored by its mean log
ratio per word and by its most telling words (means of the largest, and how many pass fixed levels, absolutely and per word), through a logistic
link fitted on labelled rows that the models haven't seen.

Words and stems are known by 64-bit hashes. Counts are tables in the shared folder: the shared ones hold every word of
every row, those of the classes every word pair of the labelled rows that are learnt from; nothing is cut off, so each
conditional distribution sums to one. Scoring tasks read the class tables from there, joined with the shared counts; the
counts of a word that no labelled row holds are the same in both classes and cancel. Nothing of this reaches the driver.

Labels come only from rows with crc32(doc_id as text) mod 5 <> 0: remainder 1 fits the link, 2 to 4 the models. At most
``LABELLED`` labelled rows of a class are used, in a fixed hash order, which bounds what a scoring task holds; the shared counts cover
every row of the corpus.

Defined results: a null text is empty; an empty text gets the score of no evidence; a null doc_id is never held out nor
labelled; of several rows of a labelled doc_id one text is learnt from; where the labelled rows are too few to fit models and link for both classes every
score is 0.0; repeated rows get equal scores; texts of any length are scored whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LABELLED = 20_000
STEM = 5
START = 0  # the mark before a text's first word
WORD = re.compile(r"\w+")
TOP = (1, 2, 4, 8, 16)
LEVELS = (2.0, 3.5, 5.0)
EVIDENCE = 2 + len(TOP) + 2 * len(LEVELS)
FLUSH = 200_000
_MIX = 0x9E3779B97F4A7C15
_SIEVE = 24  # bits of a pair's key that a first look-up uses


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def ids_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of words and of their stems."""
    from xxhash import xxh64_intdigest

    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    stems = [w[:STEM].encode("utf-8", "surrogatepass") for w in words]
    return tuple(np.array([xxh64_intdigest(w, 42) for w in x], np.uint64).view(np.int64) for x in (raw, stems))


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """One 64-bit key for each pair of word ids."""
    k = (before.view(np.uint64) * np.uint64(_MIX)) ^ word.view(np.uint64)
    k ^= k >> np.uint64(32)
    k *= np.uint64(_MIX)
    return (k ^ (k >> np.uint64(29))).view(np.int64)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, s, n): words of all rows with stem and count. Flushes when much has gathered."""
    held: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        w, s = ids_of(list(held))
        n = np.array(list(held.values()), np.int64)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(w), pa.array(s), pa.array(n)], ["w", "s", "n"])

    for b in batches:
        for t in b.column(0):
            held.update(words_of(t.as_py()))
            if len(held) > FLUSH:
                yield flush()
    if held:
        yield flush()


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, v, w, s, c0, c1): word pairs of (text, y) rows by class, counted within a batch."""
    for b in batches:
        held: list[list[np.ndarray]] = []
        for t, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            w, s = ids_of(words_of(t.as_py()))
            if len(w):
                v = np.concatenate([[START], w[:-1]])
                held.append([pair_keys(v, w), v, w, s, np.full(len(w), y, np.int64)])
        if not held:
            continue
        k, v, w, s, y = (np.concatenate(c) for c in zip(*held, strict=True))
        k, first, which = np.unique(k, return_index=True, return_inverse=True)
        c1 = np.bincount(which, y).astype(np.int64)
        cols = [k, v[first], w[first], s[first], np.bincount(which).astype(np.int64) - c1, c1]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["k", "v", "w", "s", "c0", "c1"])


def labelled(labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """(doc_id, y, fold): labelled rows that may be learnt from, ``bound`` of a class at most."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    rows = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    rows = rows.withColumn("fold", fold.cast("int")).where("fold <> 0 and y in (0, 1)")
    of = lambda y: rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return of(0).unionByName(of(1))


def _sorted(df: DataFrame, key: str, path: str) -> None:
    """A table in which the files' order and the rows' order are that of the key."""
    common.table(df.orderBy(key), path)


def train(docs: DataFrame, labels: DataFrame, folder: str, bound: int = LABELLED) -> dict | None:
    """Writes the tables that ``Model`` reads and returns its constants and the link; None unless both parts of the labelled rows have
    both classes."""
    texts = docs.select("doc_id", "text")
    few = common.table(labelled(labels, bound).coalesce(1), f"{folder}/labelled")
    chosen = texts.join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("y").alias("y"), F.first("fold").alias("fold"))
    chosen = common.table(chosen.select("text", "y", "fold"), f"{folder}/chosen")  # 2 x bound rows at most
    if len({(r.y, r.fold == 1) for r in chosen.select("y", "fold").distinct().collect()}) < 4:  # eight rows at most
        return None
    shared = texts.select("text").mapInArrow(_word_counts, "w long, s long, n long").groupBy("w").agg(F.first("s").alias("s"), F.sum("n").alias("n"))
    shared = common.table(shared, f"{folder}/shared")
    pairs = chosen.where("fold > 1").select("text", "y").mapInArrow(_pair_counts, "k long, v long, w long, s long, c0 long, c1 long")
    pairs = pairs.groupBy("k").agg(*[F.first(c).alias(c) for c in "vws"], F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    pairs = common.table(pairs, f"{folder}/counted")
    one = lambda c: F.sum((F.col(c) > 0).cast("long"))
    after = pairs.groupBy(F.col("v").alias("w")).agg(F.sum("c0").alias("n0"), F.sum("c1").alias("n1"), one("c0").alias("t0"), one("c1").alias("t1"))
    into = common.table(pairs.groupBy("w").agg(F.first("s").alias("s"), one("c0").alias("r0"), one("c1").alias("r1")), f"{folder}/into")
    stems = into.groupBy("s").agg(F.sum("r0").alias("r0"), F.sum("r1").alias("r1")).join(shared.groupBy("s").agg(F.sum("n").alias("ns")), "s")
    stems = common.table(stems, f"{folder}/stem-counts")
    single = pairs.agg(*[F.sum((F.col(f"c{c}") == n).cast("long")).alias(f"m{c}{n}") for c in (0, 1) for n in (1, 2)], one("c0").alias("kinds0"), one("c1").alias("kinds1")).first()
    types = into.agg(one("r0").alias("w0"), one("r1").alias("w1")).first()
    stem_types = stems.agg(one("r0").alias("s0"), one("r1").alias("s1")).first()
    total = shared.agg(F.sum("n").alias("n")).first().n
    discount, kinds, back, stem_back = [], [], [], []
    for c in (0, 1):
        m1, m2 = single[f"m{c}1"] or 1, single[f"m{c}2"] or 1
        discount.append(m1 / (m1 + 2 * m2))
        kinds.append(max(single[f"kinds{c}"], 1))
        back.append(discount[c] * types[f"w{c}"] / kinds[c])
        stem_back.append(discount[c] * stem_types[f"s{c}"] / kinds[c])
    less = lambda x, c: F.greatest(F.col(f"{x}{c}") - discount[c], F.lit(0.0))
    of_stem = [less("r", c) / kinds[c] + stem_back[c] * F.col("ns") / total for c in (0, 1)]
    of_stem = stems.select("s", "ns", *[x.alias(f"p{c}") for c, x in enumerate(of_stem)])
    known = after.join(into, "w", "full").join(shared.select("w", "n"), "w", "left").join(of_stem, "s", "left").na.fill(0)
    within = F.when(F.col("ns") > 0, F.col("n") / F.col("ns")).otherwise(0.0)  # the start mark has no stem
    low = [less("r", c) / kinds[c] + back[c] * F.col(f"p{c}") * within for c in (0, 1)]
    small = lambda x, name: x.cast("float").alias(name)
    words = known.select("w", *[small(x, f"{k}{c}") for c in (0, 1) for k, x in (("low", low[c]), ("total", F.col(f"n{c}")), ("scale", discount[c] * F.col(f"t{c}")))])
    _sorted(words, "w", f"{folder}/words")
    _sorted(of_stem.select("s", *[(back[c] * F.col(f"p{c}")).alias(f"unseen{c}") for c in (0, 1)]), "s", f"{folder}/stems")
    _sorted(pairs.select("k", *[small(less("c", c), f"count{c}") for c in (0, 1)]), "k", f"{folder}/pairs")
    made: dict = {"folder": folder, "unseen": [back[c] * stem_back[c] for c in (0, 1)], "link": None}
    few_rows = chosen.where("fold = 1").select("text", "y").mapInArrow(_rows_of(made), "y double, x array<double>").toPandas()  # 2 x bound rows at most
    made["link"] = _link(np.array(few_rows["x"].tolist()), few_rows["y"].to_numpy())
    return made


def _columns(folder: str, name: str, columns: dict[str, str], before: int = 0) -> list[np.ndarray]:
    """Columns of a table in the shared folder as arrays of the given types, in the order of its files, behind some zeros.
    Read piece by piece."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(f"{folder}/{name}")
    paths = sorted(f.path for f in store.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet"))
    files = [pq.ParquetFile(store.open_input_file(p)) for p in paths]
    out, at = [np.zeros(before + sum(f.metadata.num_rows for f in files), t) for t in columns.values()], before
    for f in files:
        for b in f.iter_batches(batch_size=1 << 16, columns=list(columns), use_threads=False):
            for c, whole in zip(columns, out, strict=True):
                whole[at : at + b.num_rows] = b.column(c).to_numpy(zero_copy_only=False)
            at += b.num_rows
        f.close()
    pa.default_memory_pool().release_unused()
    return out


def _rows_in(known: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Where each id stands in a sorted array, or -1. Ids are looked up in order, which is kinder to the caches."""
    order = np.argsort(ids)
    at = np.empty(len(ids), np.int64)
    at[order] = np.minimum(np.searchsorted(known, ids[order]), len(known) - 1)
    return np.where(known[at] == ids, at, -1)


class Model:
    """Both classes' models as arrays; row 0 stands for whatever no labelled row holds."""

    def __init__(self, made: dict) -> None:
        both = lambda k: {f"{k}{c}": "f4" for c in (0, 1)}
        self.word_ids, *low = _columns(made["folder"], "words", {"w": "i8", **both("low"), **both("total"), **both("scale")}, 1)
        self.low, self.total, self.scale = low[:2], low[2:4], low[4:]
        self.stem_ids, *self.unseen = _columns(made["folder"], "stems", {"s": "i8", "unseen0": "f8", "unseen1": "f8"}, 1)
        for c, x in enumerate(made["unseen"]):
            self.unseen[c][0] = x
        self.word_ids, self.stem_ids = self.word_ids[1:], self.stem_ids[1:]
        self.start = int(np.searchsorted(self.word_ids, START)) + 1
        self.keys, *self.count = _columns(made["folder"], "pairs", {"k": "i8", **both("count")})
        self.sieve = np.zeros(1 << _SIEVE, bool)
        for at in range(0, len(self.keys), 1 << 20):
            self.sieve[self._slot(self.keys[at : at + (1 << 20)])] = True
        self.cache: dict[str, int] = {}

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) >> np.uint64(64 - _SIEVE)).astype(np.int64)

    def rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(row of the word, row of its stem) for each word, 0 where unknown. The cache is emptied when large."""
        cache = self.cache
        if len(cache) > 120_000:
            cache.clear()
        new = list(set(words).difference(cache))
        if new:
            both = [_rows_in(known, ids) + 1 for ids, known in zip(ids_of(new), (self.word_ids, self.stem_ids), strict=True)]
            cache.update(zip(new, (both[0] << 32 | both[1]).tolist(), strict=True))
        code = np.fromiter(map(cache.__getitem__, words), np.int64, len(words))
        return code >> 32, code & 0xFFFFFFFF

    def log_ratios(self, word: np.ndarray, stem: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log ratio of toxic to ordinary of each word after the one before; ``first`` marks the first words of texts."""
        before = np.concatenate([[self.start], word[:-1]]) if len(word) else word
        before = np.where(first, self.start, before)
        both = np.flatnonzero((word > 0) & (before > 0))
        v = np.where(before[both] == self.start, START, self.word_ids[before[both] - 1])
        k = pair_keys(v, self.word_ids[word[both] - 1])
        may = np.flatnonzero(self.sieve[self._slot(k)])
        at, both = _rows_in(self.keys, k[may]), both[may]
        at, both = at[at >= 0], both[at >= 0]
        logs = []
        for c in (0, 1):
            low = np.where(word > 0, self.low[c][word], self.unseen[c][stem])
            total = self.total[c][before]
            got = np.zeros(len(word))
            got[both] = self.count[c][at]
            logs.append(np.log(np.where(total > 0, (got + self.scale[c][before] * low) / np.maximum(total, 1), low) + 1e-300))
        return logs[1] - logs[0]

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """A row for each text: mean log ratio per word, means of the largest log ratios, how many words pass each level, how densely,
        and length."""
        out = np.zeros((len(texts), EVIDENCE))
        held: list[list[str]] = []
        done = 0

        def flush() -> None:
            nonlocal done
            sizes = np.array([len(x) for x in held])
            words = [w for x in held for w in x]
            ends = np.cumsum(sizes)
            first = np.zeros(len(words), bool)
            first[(ends - sizes)[sizes > 0]] = True
            ratio = self.log_ratios(*self.rows(words), first)
            for i, (a, b) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), strict=True)):
                if a < b:
                    best = np.sort(ratio[a:b])[::-1]
                    over = np.array([b - a - np.searchsorted(best[::-1], t, "right") for t in LEVELS])
                    top = best[: TOP[-1]].cumsum()
                    out[done + i] = [best.mean(), *[top[min(k, b - a) - 1] / min(k, b - a) for k in TOP], *np.log1p(over), *np.sqrt(over / (b - a)), np.log1p(b - a)]
            done += len(held)
            held.clear()

        n = 0
        for t in texts:
            held.append(words_of(t.as_py()))
            n += len(held[-1])
            if n > 100_000:
                flush()
                n = 0
        flush()
        return out


def _rows_of(made: dict):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for b in batches:
            model = model or Model(made)
            x = model.evidence(b.column(0))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, EVIDENCE), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(1).cast(pa.float64()), flat], ["y", "x"])

    return rows


def _link(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic link by Newton steps on standardised evidence: (mean, deviation, weights)."""
    mean, dev = x.mean(axis=0), x.std(axis=0) + 1e-9
    b = np.hstack([np.ones((len(x), 1)), (x - mean) / dev])
    w = np.zeros(b.shape[1])
    ridge = np.array([1e-6] + [penalty] * (len(w) - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(b @ w, -30, 30)))
        step = np.linalg.solve((b * (p * (1 - p))[:, None]).T @ b + np.diag(ridge), b.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-7:
            break
    return mean, dev, w


def score(docs: DataFrame, labels: DataFrame, folder: str, bound: int = LABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    made = train(docs, labels, folder, bound)  # constants and the link's weights: a few dozen numbers

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for b in batches:
            found = np.zeros(b.num_rows)
            if made is not None and b.num_rows:
                model = model or Model(made)
                mean, dev, w = made["link"]
                found = 1 / (1 + np.exp(-np.clip(w[0] + ((model.evidence(b.column(1)) - mean) / dev) @ w[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found)], ["doc_id", "score"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(rate, f"doc_id {kind}, score double")
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
