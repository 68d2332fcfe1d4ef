"""Items of texts without any word."""

import os

import duckdb

from millrace import fixtures as X
from millrace.plans import QUERIES, SQL

TEXTS = ["", " \n\t", "Of two", "one", "a test of src7 and more"]


def folder(spark, path):
    rows = [(i, text, "en", "src7" if i == 0 else "web", len(text)) for i, text in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(f"{path}/documents.parquet")
    words = spark.createDataFrame([(1, "words about nothing"), (2, "source of tests")], "item_id bigint, text string")
    words.coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_a_text_without_words_has_no_first_word(spark, tmp_path):
    got = {r["item_id"]: r["tools"] for r in X.items(spark, folder(spark, tmp_path)).select("item_id", "tools").collect()}
    assert got == {0: ["src7", None], 1: ["web", None], 2: ["web", "of"], 3: ["web", "one"], 4: ["web", "a"]}


def test_queries_over_texts_without_words(spark, tmp_path):
    """The rows of the SQL, and no error, whichever lists of an item are read."""
    d = folder(spark, tmp_path)
    duck = duckdb.connect()
    for name in os.listdir(d):
        duck.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{d}/{name}/*.parquet')")
    for name in ("b4_element_match", "b6_heuristic_gate", "c3_substring_grading", "a13_qrels_snapshot"):
        rows = QUERIES[name](spark, d)
        want = duck.execute(f"SELECT {', '.join(rows.columns)} FROM ({SQL[name]})").fetchall()
        assert sorted(map(tuple, rows.collect()), key=repr) == sorted(want, key=repr), name
