"""The pipeline: each stage against a plain version on the same input, whole runs, rows that stages must not confuse."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from tests.llm.test_decontamination import normal
from tests.llm.test_simhash_dedup import components, print_of
from tests.llm.test_suffix_dedup import by_hand as cut_by_hand
from waymark.llm.decontamination import LeakParams

STAGES = dict(corpus_pipeline.STAGES)
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def holds(item, text, limit):
    """Whether some substring of text is within the limit of the item: one row of the distance table after another."""
    row, places = np.zeros(len(text) + 1, np.int64), np.arange(len(text) + 1)
    codes = np.array([ord(c) for c in text])
    for i, c in enumerate(item, 1):
        new = np.concatenate([[i], np.minimum(row[:-1] + (codes != ord(c)), row[1:] + 1)])
        row = np.minimum.accumulate(new - places) + places
        if row.min() > limit:
            return False
    return bool(row.min() <= limit)


def test_stages_on_the_table(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = {r["doc_id"]: r for r in docs.collect()}
        assert docs.count() == len(after)
        texts = [(i, r["text"]) for i, r in before.items()]
        if name == "sentencepiece":
            assert after.keys() == before.keys()
            assert all(r["lang"] == before[i]["lang"] for i, r in after.items())
            break
        assert docs.columns == COLUMNS
        if name == "language_id":
            assert 0.95 * len(before) < len(after) <= len(before)
        if name == "simhash_dedup":
            prints = [(i, print_of(t)) for i, t in texts]
            smallest = components(prints)
            assert set(after) == {smallest[fp] for _, fp in prints}
        if name == "suffix_dedup":
            wanted = {i: (n - gone, sha) for i, n, gone, _, sha in cut_by_hand(texts)}
            assert set(after) == {i for i, (n, _) in wanted.items() if n or not before[i]["text"]}
            assert all(hashlib.sha256(r["text"].encode()).hexdigest() == wanted[i][1] for i, r in after.items() if r["text"].isascii())
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
        if name == "decontamination":
            items = [n for t in pq.read_table(f"{sf_dir}/benchmark.parquet").column("text").to_pylist() if len(n := normal(t)) >= LeakParams().shortest]
            bad = {i for i, t in texts if any(holds(n, normal(t), len(n) // 10) for n in items)}
            assert set(after) == set(before) - bad
            assert bad
        before = after


ITEM = "the ferry to the northern islands leaves at seven"
ROWS = [
    (1, "quiet water under the old stone bridge near our village", "en", "web", 1), (1, f"someone said {ITEM} on most days", "en", "web", 1), (None, "a first row without any id at all in this small table", "en", "web", 1), (None, f"they told us {ITEM}", "en", "web", 1),
    (None, "a first row without any id at all in this small table", "en", "web", 1), (5, "a first row without any id at all in this small table", "en", "web", 1), (6, None), (7, ""), (6, None), (8, "1 2 3"),
]


@pytest.fixture
def odd(spark, tables):
    folder = tables(True, documents=ROWS, benchmark=[(1, ITEM), (2, None)])
    return folder, spark.read.parquet(f"{folder}/documents.parquet")


def test_near_copies_of_odd_rows(spark, odd):
    folder, docs = odd
    out = STAGES["simhash_dedup"](spark, docs, folder)
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == sorted([(1, ROWS[0][1]), (1, ROWS[1][1]), (None, ROWS[3][1]), (5, ROWS[5][1]), (6, None), (8, "1 2 3")], key=repr)


def test_leaks_of_odd_rows(spark, odd):
    folder, docs = odd
    out = STAGES["decontamination"](spark, docs, folder)
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == sorted(((i, t) for i, t, *_ in ROWS if ITEM not in (t or "")), key=repr)


def test_cuts_and_languages_of_odd_rows(spark, odd):
    folder, docs = odd
    out = STAGES["suffix_dedup"](spark, docs, folder)
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} == {1, None, 5, 6, 7, 8}
    out = STAGES["language_id"](spark, docs, folder)
    assert out.columns == docs.columns
    assert {(r["doc_id"], r["text"]) for r in out.collect()} <= {(i, t) for i, t, *_ in ROWS if i not in (6, 7, 8)}


def test_run_twice(spark, sf_dir):
    one, two = (sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) for _ in range(2))
    assert one == two and one
