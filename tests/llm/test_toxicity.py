"""Toxicity: the index against all cosines, held-out ranking, inputs, learning."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.conftest import as_rows
from waymark.llm.queries import op8_toxicity
from waymark.llm.toxicity import BlockMaxIndex, ToxicParams, Vectors, calibrated, calibration, learn, like_groups, row_features, score

held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2


def as_vectors(dense: np.ndarray) -> Vectors:
    row, feature = np.nonzero(dense)
    return Vectors(len(dense), row, feature, dense[row, feature])


@pytest.mark.parametrize("few", [0, 7, 99])
def test_nearest_are_exact(few):
    rng = np.random.default_rng(4)
    dense = rng.random((500, 40)) * (rng.random((500, 40)) < 0.1)
    dense[100:200] = dense[:100]  # ties
    norm = np.linalg.norm(dense, axis=1, keepdims=True)
    dense = np.float64(np.float32(np.divide(dense, norm, out=np.zeros_like(dense), where=norm > 0)))  # as in the index
    index = BlockMaxIndex(as_vectors(dense), 40, 16, few)
    ids, found = index.nearest(as_vectors(dense[:150]), 7, batch=2000)
    for q, near, there in zip(dense[:150], ids, found, strict=True):
        cosines = np.round(dense @ q, 12)
        best = [i for i in np.lexsort((np.arange(500), -cosines))[:7] if cosines[i] > 0]
        assert near.tolist() == best + [-1] * (7 - len(best))
        assert np.allclose(there[: len(best)], cosines[best], atol=1e-6)
    assert index.visited < 150 * index.blocks * 0.9  # blocks are left out, or the bound would be of no use


def test_like_examples_share_blocks():
    rng = np.random.default_rng(5)
    kind = rng.permutation(np.repeat(np.arange(8), 64))
    dense = np.zeros((512, 8000))
    for i, k in enumerate(kind):
        dense[i, k * 1000 + rng.integers(0, 50, 30)] = 1
    groups = like_groups(as_vectors(dense), 64)
    assert sorted(np.concatenate(groups).tolist()) == list(range(512))
    assert max(map(len, groups)) <= 64 and sum(len(set(kind[g])) for g in groups) < 20


def auc(scores, labels):
    pos, neg = (np.array([s for s, x in zip(scores, labels, strict=True) if x == c]) for c in (1, 0))
    return ((pos[:, None] > neg[None]).mean() + (pos[:, None] == neg[None]).mean() / 2) if len(pos) and len(neg) else 1.0


def test_held_out_ranking(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    marks = {i: t for i, t in zip(*(pq.read_table(f"{folder}/labels.parquet").column(c).to_pylist() for c in ("doc_id", "toxic")), strict=True)}
    rows = op8_toxicity(spark, folder).collect()
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    test = [r for r in rows if r["held_out"] and marks.get(r["doc_id"]) is not None]
    assert auc([r["score"] for r in test], [marks[r["doc_id"]] for r in test]) > 0.9
    assert all(not held(i) for r in rows for i in r["evidence"])


def test_labels_of_held_out_rows_are_not_used(spark, tables, documents, sf_dir):
    marks = list(zip(*pq.read_table(f"{sf_dir}/labels.parquet").to_pydict().values(), strict=True))
    folder = tables(documents=documents, labels=marks)
    names = ["doc_id", "held_out", "score", "predicted", "evidence"]
    first = as_rows(names, op8_toxicity(spark, folder).collect())
    turned = [(i, q, 1 - t if held(i) and t is not None else t) for i, q, t in marks]
    folder = tables(documents=[(i, t, "xx", "elsewhere", 0) for i, t, *_ in documents], labels=turned)
    assert as_rows(names, op8_toxicity(spark, folder).collect()) == first


def test_shuffled_labels_teach_the_same(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    one, other = (sorted(map(tuple, score(docs, learn(docs, labels, F.lit(True), ToxicParams(broadcast=n))).collect())) for n in (1 << 20, 0))
    assert one == other


def test_without_labels(spark, tables):
    rows = op8_toxicity(spark, tables(documents=[(1, "some text"), (2, None)])).collect()
    assert [(r["score"], r["predicted"]) for r in rows] == [(0.0, 0)] * 2


def brute(docs: list[tuple], marks: dict[int, int], k: int = 15) -> dict[int, tuple[float, list[int]]]:
    """Scores and evidence from all cosines, every word and word beginning hashed by itself; needs ids and texts all different."""
    words = {i: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t, *_ in docs}
    hashed = {w: row_features(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]), ToxicParams())[0].tolist() for ws in words.values() for w in ws}
    terms = {i: Counter(f for w in ws for f in hashed[w]) for i, ws in words.items()}
    seen = [i for i, t, *_ in docs if t is not None and i in marks and not held(i)]
    n = [sum(marks[i] == c for i in seen) for c in (0, 1)]
    df = [Counter(w for i in seen if marks[i] == c for w in terms[i]) for c in (0, 1)]

    def worth(w):
        a, b = df[1][w], df[0][w]
        rate = n[1] / sum(n)
        toxic = (a + 10 * rate) / (a + b + 10)
        lean = math.log(toxic / (1 - toxic)) - math.log(rate / (1 - rate))
        return (math.log((1 + sum(n)) / (1 + a + b)) + 1) * (0.3 + max(0.0, lean))

    value = {i: {w: (1 + math.log(c)) * worth(w) for w, c in t.items()} for i, t in terms.items()}
    for v in value.values():
        size = math.sqrt(sum(x * x for x in v.values()))
        v.update({w: x / size for w, x in v.items()})
    stands = {i: 1.0 for i in seen}  # all rows are indexed, so each stands for itself
    full, empty = [i for i in seen if terms[i]], [i for i in seen if not terms[i]]
    everyone = (n[1] + 0.5) / (len(seen) + 1)
    blank = (sum(marks[i] for i in empty) + everyone) / (len(empty) + 1)

    def votes(i, without):
        cosines = {j: sum(x * value[j].get(w, 0.0) for w, x in value[i].items()) for j in full if j != without}
        near = sorted((j for j in cosines if cosines[j] > 0), key=lambda j: -cosines[j])[:k]
        toxic, all_ = (sum(cosines[j] * stands[j] * (marks[j] if c else 1) for j in near) for c in (1, 0))
        return min(max((toxic + 0.5 * everyone) / (all_ + 0.5), 1e-4), 1 - 1e-4), near

    a, b = calibration(np.array([votes(i, i)[0] for i in full]), np.array([float(marks[i]) for i in full]), np.ones(len(full)))
    out = {}
    for i in terms:
        share, near = votes(i, None) if terms[i] else (0.5, [])
        out[i] = (float(calibrated(np.array(share), a, b)) if near else everyone if terms[i] else blank), near[:3]
    return out


def test_query_equals_brute_force(spark, tables, documents, sf_dir):
    marks = {i: t for i, _, t in zip(*pq.read_table(f"{sf_dir}/labels.parquet").to_pydict().values(), strict=True)}
    seen: set = set()
    docs = [d for d in documents if d[1] not in seen and not seen.add(d[1])][:150] + [(9001, None), (9002, "!"), (9003, "zzzz qqqq"), (9005, "")]
    marks |= {9001: 1, 9002: 1, 9005: 0}
    folder = tables(documents=docs, labels=[(i, 0, t) for i, t in marks.items()])
    expected = brute(docs, marks)
    for r in op8_toxicity(spark, folder).collect():
        score, near = expected[r["doc_id"]]
        assert abs(r["score"] - score) < 1e-6
        assert r["evidence"] == near


def test_repeated_id_and_copies_stay_bounded(spark):
    docs = spark.range(900).selectExpr("if(id < 600, 7, id) AS doc_id", "if(id < 300, 'you idiot', concat('words of row ', id)) AS text")
    labels = spark.range(900).selectExpr("if(id < 600, 7, id) AS doc_id", "cast(id % 5 = 2 AS int) AS toxic")
    judge = learn(docs, labels, F.lit(True), ToxicParams(examples=20))
    assert len(judge.examples.labels) == 40
    assert score(docs, judge).where("score between 0 and 1").count() == 900
