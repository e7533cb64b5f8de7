"""The pipeline's near copies against brute force over all pairs."""

import random
import re

import pytest
from llm_texts import words
from pyspark.sql import functions as F

from gridloom.llm import near_copies, simhash


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def kept(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return sorted(min(r[0] for r, h in zip(rows, group, strict=True) if h == g) for g in set(group))


def changed(rng, text, n):
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = f"new{rng.random()}"
    return " ".join(w)


@pytest.mark.parametrize("light", [64, 3])
def test_near_copies(spark, folder, monkeypatch, light):
    monkeypatch.setattr(near_copies.links, "__kwdefaults__", {"light": light})
    rng = random.Random(4)
    texts = [None, "", " ", "Two words", "two  WORDS", "two word"]
    for _ in range(25):  # one to three changed words, similarities on both sides of 0.8
        base = words(rng, rng.randint(30, 150))
        texts += [base, base.upper() if base.isascii() else base] + [changed(rng, base, rng.randint(1, 3)) for _ in range(3)]
    line, hub = words(rng, 25), words(rng, 100)
    texts += [words(rng, 30) + " " + line for _ in range(20)]  # a line in many texts that aren't copies
    texts += [hub] + [changed(rng, hub, rng.randint(1, 4)) for _ in range(40)]  # a large group
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs, folder).collect()) == kept(rows)


def test_one_changed_word_is_a_copy(spark, folder):
    rng = random.Random(6)
    texts = [words(rng, 100) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, changed(rng, t, 1)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs, folder).collect()) == list(range(20))


def test_awkward_near_copies(spark, folder, awkward, clashing, empty):
    for i, df in enumerate((awkward, clashing)):
        out = simhash.keep_one(df, f"{folder}/{i}")
        assert out.columns == df.columns and out.where("doc_id is null").count() == 2
        assert sorted(r.doc_id for r in out.where(F.col("doc_id").isNotNull()).collect()) == kept([(r.doc_id, r.text) for r in df.where("doc_id is not null").collect()])
    assert simhash.keep_one(empty, f"{folder}/e").count() == 0


def test_one_id_may_have_several_texts(spark, folder):
    rng = random.Random(8)
    a, b = words(rng, 60), words(rng, 60)
    rows = [(1, a, "x"), (9, a, "x"), (9, b, "x"), (9, b, "x"), (9, b, "y"), (12, b, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string")
    for i, df in enumerate((docs, docs.repartition(5))):
        out = [tuple(r) for r in simhash.keep_one(df, f"{folder}/{i}").collect()]
        assert len(out) == 2 and (1, a, "x") in out and {r[:2] for r in out} == {(1, a), (9, b)}
        assert i == 0 or sorted(out) == before  # the same of several rows each time
        before = sorted(out)


def test_large_group_of_loose_copies(spark, folder, monkeypatch):
    """Members on both sides of the threshold, most of them too far from every pivot."""
    monkeypatch.setattr(near_copies.links, "__kwdefaults__", {"light": 8})
    monkeypatch.setattr(near_copies, "PIVOTS", 2)
    rng = random.Random(9)
    hub, line = words(rng, 70), words(rng, 12)
    texts = [changed(rng, hub, rng.randint(1, 8)) for _ in range(220)]
    texts += [changed(rng, t, 1) for t in rng.sample(texts, 60)] + [t + " " + line for t in rng.sample(texts, 40)] + [" ".join(t.split()[: rng.randint(50, 69)]) for t in rng.sample(texts, 30)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs, folder).collect()) == kept(rows)
    assert spark.read.parquet(f"{folder}/by-difference-found").count() > 0


def test_texts_that_share_one_passage_are_told_apart_early(spark, folder, monkeypatch):
    """No element of texts without a partner is listed by class, however long the text that the others are compared with."""
    monkeypatch.setattr(near_copies.links, "__kwdefaults__", {"light": 8})
    rng = random.Random(10)
    line, hub = words(rng, 60), words(rng, 70)
    texts = [words(rng, rng.randint(40, 50)) + " " + line for _ in range(60)] + [line + " " + words(rng, 900)]
    texts += [changed(rng, hub, rng.randint(1, 4)) for _ in range(40)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs, folder).collect()) == kept(rows)
    listed = {r.node for r in spark.read.parquet(f"{folder}/by-difference-keys").select("node").distinct().collect()}
    copies = docs.where("doc_id > 60").select(near_copies.node_of(F.col("text")).alias("node"))
    assert listed <= {r.node for r in copies.collect()}


def groups(pairs):
    of = {x: frozenset([x]) for p in pairs for x in p}
    for a, b in pairs:
        of |= dict.fromkeys(of[a] | of[b], of[a] | of[b])
    return set(of.values())


def test_links_of_fingerprints_come_first(spark, folder):
    """What SimHash links and the whole sets confirm is linked by that step alone."""
    rng = random.Random(11)
    texts = [words(rng, 400) for _ in range(30)]
    rows = list(enumerate(texts + [changed(rng, t, rng.randint(1, 3)) for t in texts for _ in range(4)]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs, folder).collect()) == kept(rows)
    nodes = [r.node for r in docs.orderBy("doc_id").select(near_copies.node_of(F.col("text")).alias("node")).collect()]
    sets = [near_copies.shingles(t) for _, t in rows]
    fps = [simhash.of_hashes(h) for h in sets]
    assert fps[:5] == [simhash.fingerprint(t, near_copies.WORDS) for t in texts[:5]]
    want = set()
    for i, a in enumerate(sets):
        for j in range(i):
            n = len(set(a.tolist()) & set(sets[j].tolist()))
            if ((fps[i] ^ fps[j]) & (1 << 64) - 1).bit_count() <= near_copies.RADIUS and 5 * n >= 4 * (len(a) + len(sets[j]) - n):
                want.add((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))
    got = {(r.a, r.b) for r in spark.read.parquet(f"{folder}/simhash-close").collect()}
    assert got and got <= want and groups(got) == groups(want)  # texts of one fingerprint are linked by the least of them
