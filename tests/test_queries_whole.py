"""Queries over documents whose ids lie far apart."""

import hashlib
import os
import re

import pytest

from lectern.queries import oracle_sql, queries

from .test_queries import DATA, pytestmark, rows  # noqa: F401

TEXT = "\n".join(f"line {k} of some words" for k in range(45))


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """Few documents, of ids small and large, with the other tables as they are."""
    import duckdb

    path = tmp_path_factory.mktemp("wide")
    con = duckdb.connect()
    docs = [(k, TEXT) for k in (0, 1, 2, 19, 20, 21, 199, 200, 201, 202, 5000, 5001)]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(str(path / "documents.parquet"))
    os.symlink(f"{DATA}/supplier.parquet", path / "supplier.parquet")
    for name in ("documents", "supplier"):
        at = f"{path}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{at + '/*.parquet' if os.path.isdir(at) else at}')")
    return str(path), con


def whole(spark, wide, name):
    """The query's rows against its SQL."""
    path, con = wide
    sql = oracle_sql()[name]
    found = queries()[name](spark, path).toPandas()
    assert set(found.doc_id) >= {200, 201, 5001} or name != "table_region_antijoin"
    assert found.doc_id.max() > 200
    assert rows(found) == rows(con.execute(sql).df())


@pytest.mark.parametrize("name", ["eqno_regions", "layout_regions", "formula_cascade"])
def test_formula_regions_of_all_documents(spark, wide, name):
    whole(spark, wide, name)


def test_lines_outside_regions_of_all_documents(spark, wide):
    whole(spark, wide, "table_region_antijoin")


def test_dictionary_on_all_rows(spark):
    """Against Python's word boundaries."""
    given = spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "text").collect()
    found = queries()["dictionary_apply"](spark, DATA).collect()

    def brute(text):
        return text and re.sub(r"(?i)\bof\b", "o f", re.sub(r"(?i)\bthe\b", "T H E", text))

    assert any(not r.text.isascii() for r in given if r.text)
    assert sorted(map(str, ((r.conv_id, r.turn, brute(r.text)) for r in given))) == sorted(map(str, map(tuple, found)))


def test_formula_flag_on_lines_with_dashes(spark, tmp_path):
    texts = ["x = 1 – 2", "x = 1 — 2", "x = a\u00adb", "plain – words"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id for r in queries()["formula_text_flag"](spark, str(tmp_path)).collect()} == {0, 1, 2}


def test_every_word_of_the_benchmark_is_a_rule(spark, tmp_path):
    """Words of one to three letters and words with other than ASCII letters, too; against plain replacing and the SQL."""
    import duckdb

    items = ["It is a Chöß, not an apple.", "Ñ e\u0301t 42 of\nit", None, ""]
    texts = ["it is a Chöß and Ñ is it", "Ch ö an apple, e\u0301t of 142", "öß", "Zug", "", None]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    words = sorted({"It", "is", "a", "Chöß", "not", "an", "apple", "Ñ", "e\u0301t", "42", "of", "it"}, key=lambda w: (len(w), w.encode()))

    def brute(text):
        for n, w in enumerate(words, 1):
            text = text and text.replace(w, f"{w[1:]}{n}")
        return text if text is None else hashlib.sha256(text.encode()).hexdigest()

    found = queries()["rule_replace"](spark, str(tmp_path)).toPandas()
    assert rows(found)[1] == sorted((str(k), str(brute(x))) for k, x in enumerate(texts))
    con = duckdb.connect()
    for name in ("benchmark", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    assert rows(found) == rows(con.execute(oracle_sql()["rule_replace"]).df())
