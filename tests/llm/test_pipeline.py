"""The pipeline, the registered queries and the guard of the entry module."""

import random
import re
import subprocess
import sys
from pathlib import Path

import pytest
from llm_texts import words

REPO = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(2)
    out = tmp_path_factory.mktemp("sf")
    leak = words(rng, 30)
    rows = []
    for i in range(240):
        text = words(rng, rng.randint(40, 160)) + "."
        if i % 6 == 0:
            text = " | ".join(w.upper() + "!!" for w in text.split())
        rows.append([i, text, rng.choice(["en", "de"]), f"s{i % 5}", len(text)])
    rows[7][1] += " " + leak
    rows[13][1] += " token=abcdefgh12345"
    rows += [[300, rows[1][1], "en", "s1", 3], [301, rows[1][1], "en", "s2", 3], [None, None, None, None, None], [302, "", "en", "s1", 0]]
    spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 > 0), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), {r[0]: r[1] for r in rows}, leak


def test_stages(spark, corpus, folder):
    import corpus_pipeline

    sf, texts, leak = corpus
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if i < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        seen[i] = docs.collect()
    ids = lambda i: {r.doc_id for r in seen[i]}
    good = {i for i in range(240) if i % 6}
    assert good <= ids(0) and not ids(0) & {i for i in range(240) if i % 6 == 0}
    assert 1 in ids(1) and not ids(1) & {300, 301} and good <= ids(1)
    assert ids(1) - ids(2) == {7}
    assert ids(3) == ids(2)
    changed = [r for r in seen[3] if r.doc_id is not None and r.text != texts[r.doc_id]]
    assert [r.doc_id for r in changed] == [13] and "[SECRET]" in changed[0].text and len(changed[0].text) == changed[0].n_chars
    tokens = sum(len((r.text or "").split()) for r in seen[3])
    assert sum(r.tokens_taken for r in seen[4]) == tokens // 2
    whole = corpus_pipeline.run(spark, sf).collect()
    assert sorted(repr((r.doc_id, r.epoch, r.tokens_taken)) for r in whole) == sorted(repr((r.doc_id, r.epoch, r.tokens_taken)) for r in seen[4])


def test_all_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= names


def test_entry_survives_without_these_operators(tmp_path):
    import shutil

    shutil.copytree(REPO / "gridloom", tmp_path / "gridloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op1_') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
