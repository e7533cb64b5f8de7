"""Operators on texts reach what lies behind the prefixes of their SQL."""

import duckdb

from gridloom.plans import queries as Q


def _texts(spark, folder):
    rows = [(1, "a " * 1000 + "end"), (2, "x" * 5000), (3, None), (4, "b c ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return f"{folder}"


def test_nul_split(spark, tmp_path):
    got = {r.doc_id: (r.n, r.first, r["last"]) for r in Q.QUERIES["nul_split"](spark, _texts(spark, tmp_path)).collect()}
    assert got[1] == (1001, "a", "end") and got[2] == (1, "x" * 5000, "x" * 5000) and got[4] == (2, "b", "c")


def test_ascii_trim(spark, tmp_path):
    got = {r.doc_id: r.n for r in Q.QUERIES["ascii_trim"](spark, _texts(spark, tmp_path)).collect()}
    assert got == {1: 2003, 2: 5000, 3: None, 4: 4}


def test_nul_split_of_odd_texts(spark, tmp_path):
    """Empty texts, texts of separators alone, line ends after separators, NULs and chars 1: as the SQL says."""
    texts = ["", " ", "   ", None, "a", "a ", " a", "a  b", "b c  ", "a \n", "a \r\n", "a \u2028", "\n", "a\x00b c", "a\x01b c", "\x00", "\x01", "\x00 \x01 ", "a b\x01", "a b\x00 ", "a \x00", "\u00e9 \u00fc ", "\u00a0 b"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n, r.first, r["last"]) for r in Q.QUERIES["nul_split"](spark, f"{tmp_path}").collect()}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == {r[0]: r[1:] for r in con.sql(Q.ORACLES["nul_split"]).fetchall()}
