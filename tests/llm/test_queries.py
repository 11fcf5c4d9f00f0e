"""All queries: SQL where there is some, one row for each input row, empty tables, nulls, repeated rows, clashing names."""

from __future__ import annotations

import pytest

import corpus_pipeline
from tests.conftest import as_rows, spark_rows, sql_rows
from waymark.llm.queries import ORACLE_SQL, QUERIES

ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "7 8 9 !"), (None, "words of a row without an id, in all words"), (5, "long " * 9000), (6, "the same words stand in two rows here"), (6, "the same words stand in two rows here"), (7, "the same words stand in two rows here"), (8, "ünï çödé ▁ \u0000 日本語 \U0001f600"), (9, "x")]
DOCUMENTS = [(i, t, "en" if i is None or i % 2 else "fr", "web", len(t or "")) for i, t in ODD]
WHOLE = {"op1_url_filter": "pages", "op3_lm_scoring": "documents", "op4_sentencepiece": "documents", "op5_language_id": "documents", "op6_suffix_dedup": "documents", "op7_license_scan": "documents", "op8_toxicity": "documents", "op9_embedding_dedup": "embeddings", "op10_simhash_dedup": "documents", "op12_merkle_manifest": "documents"}
LABELS = [(i, 0, i % 2) for i in range(9)] + [(None, 0, 1), (3, 1, None), (1, 0, 0)]
URLS = [(1, None), (2, ""), (3, "no scheme/com/en/1"), (4, "http://A.Example.COM/en/7x?q#f"), (5, "http://A.Example.COM/en/7x?q#f"), (6, "x://y.org#/es/"), (None, "https://n.net/de/8"), (8, "https://b.example.net/de/8/a/b/c/d/e/f/g"), (9, "://"), (10, "a://b://c.com/en/")] + [(100 + i, f"http://h.com/{'en' if i % 3 else 'fr'}/{i}/x") for i in range(60)]
VECTORS = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.1]), (4, None), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, []), (10, [1.0, 0.0, 0.0]), (11, [0.0, 1.0]), (12, [-1.0, 0.0])]
ITEMS = [(1, "words of a row without an id"), (2, None), (3, ""), (4, "x")]


@pytest.fixture
def odd(tables):
    return lambda clash: tables(clash, documents=DOCUMENTS, labels=LABELS, pages=URLS, embeddings=VECTORS, benchmark=ITEMS)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, sf_dir, name):
    assert spark_rows(QUERIES[name](spark, sf_dir)) == sql_rows(ORACLE_SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_odd_rows_equal_sql(spark, odd, name):
    folder = odd(False)
    assert spark_rows(QUERIES[name](spark, folder)) == sql_rows(ORACLE_SQL[name], folder)


@pytest.mark.parametrize("name", [*QUERIES, "pipeline"])
def test_empty_tables(spark, tables, name):
    query = QUERIES.get(name, corpus_pipeline.run)
    assert query(spark, tables()).collect() == []


@pytest.mark.parametrize("name", list(QUERIES))
def test_odd_rows_and_clashing_names(spark, odd, name):
    first = QUERIES[name](spark, odd(False))
    plain = as_rows(first.columns, first.collect())
    second = QUERIES[name](spark, odd(True))
    assert plain == as_rows(second.columns, second.collect())
    if name in WHOLE:
        assert len(plain) == {"documents": len(DOCUMENTS), "pages": len(URLS), "embeddings": len(VECTORS)}[WHOLE[name]]
    scores = [r["score"] for r in first.collect()] if "score" in first.columns and name != "op3_lm_scoring" else []
    assert all(0 <= s <= 1 for s in scores)
