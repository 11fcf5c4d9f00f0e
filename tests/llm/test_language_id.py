"""Language identification: held-out accuracy, inputs, rows without letters."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tests.conftest import as_rows
from waymark.llm.language_id import LangParams, features, predict, train
from waymark.llm.queries import op5_language_id


def test_held_out_accuracy(spark, sf_dir, documents):
    lang = {d[0]: d[2] for d in documents}
    rows = op5_language_id(spark, sf_dir).collect()
    assert len(rows) == len(documents)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) > 0.93 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_only_text_decides(spark, tables, documents):
    """Ids stay in their folds; languages of held-out rows and all sources are changed."""
    first = op5_language_id(spark, tables(documents=documents)).collect()
    spoilt = [(i, t, lang if zlib.crc32(str(i).encode()) % 3 != 1 else "zz", "elsewhere", None) for i, t, lang, *_ in documents]
    second = op5_language_id(spark, tables(documents=spoilt)).collect()
    names = ["doc_id", "held_out", "lang_pred", "score"]
    assert as_rows(names, first) == as_rows(names, second)


def test_rows_without_letters_and_without_languages(spark, tables, documents):
    odd = [(10**6, None, "en"), (10**6 + 1, "", "en"), (10**6 + 2, "12 34 _ !", "fr"), (10**6 + 3, "ein Wort und noch eines", None), (10**6 + 4, "½", "fr"), (10**6 + 5, "²³ 12 ① Ⅷ", "fr"), (10**6 + 6, "字", "en"), (10**6 + 7, "²a", "en")]
    rows = {r["doc_id"]: r for r in op5_language_id(spark, tables(documents=[*documents, *odd])).collect()}
    assert [rows[10**6 + k]["lang_pred"] for k in range(3)] == ["und"] * 3
    assert [rows[10**6 + k]["lang_pred"] for k in (4, 5)] == ["und"] * 2
    assert all(rows[10**6 + k]["lang_pred"] != "und" for k in (6, 7))
    assert rows[10**6 + 3]["lang_pred"] in {d[2] for d in documents}
    alone = op5_language_id(spark, tables(documents=[(1, "no language is known", None)])).collect()
    assert [(r["lang_pred"], r["score"]) for r in alone] == [("und", 0.0)]


def plain_fit(rows, params):
    """The classifier's weights in dictionaries of names, one feature and language at a time; (lang, text) in order."""
    counts = [(lang, Counter(grams(t, params))) for lang, t in rows]
    df = Counter(f for _, c in counts for f in c)
    idf = lambda f: math.log((1 + len(rows)) / (1 + df[f])) + 1

    def vector(c):
        v = {f: (1 + math.log(k)) * idf(f) for f, k in c.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {f: x / size for f, x in v.items()}

    langs = sorted({lang for lang, _ in rows})
    data = [(lang, vector(c)) for lang, c in counts]
    train, z, n = data[: len(data) - len(data) // 5], Counter(), Counter()

    def weight(f, k):
        a = z[f, k]
        return 0.0 if abs(a) <= params.l1 else -(a - math.copysign(params.l1, a)) / ((params.beta + math.sqrt(n[f, k])) / params.alpha + params.l2)

    def shares(v, heat=1.0):
        logit = [sum(x * weight(f, k) for f, x in v.items()) / heat for k in langs]
        e = [math.exp(x - max(logit)) for x in logit]
        return [x / sum(e) for x in e]

    for _ in range(params.rounds):
        for lang, v in train:
            v = v | {None: 1.0}
            now = [(f, k, weight(f, k)) for f in v for k in langs]
            error = {k: p - (k == lang) for k, p in zip(langs, shares(v), strict=True)}
            for f, k, w in now:
                g = v[f] * error[k]
                z[f, k] += g - (math.sqrt(n[f, k] + g * g) - math.sqrt(n[f, k])) / params.alpha * w
                n[f, k] += g * g
    return langs, vector, lambda v, heat: shares(v | {None: 1.0}, heat)


def grams(text, params):
    """The hashed n-grams of a text, cut one by one."""
    text = re.sub(r"[\x00-\x20]+", " ", f" {text.lower()} ")
    for order in params.orders:
        for i in range(len(text) - order + 1):
            h = 0
            for k, c in enumerate(text[i : i + order], 1):
                h = (h * 0x01000193 + ord(c) * 0x9E3779B1 + k) % 2**32
            yield ((h ^ h >> 15) * 0x85EBCA6B % 2**32) >> (32 - params.bits)


def test_fit_and_prediction_equal_plain_arithmetic(spark, tables, documents):
    docs = [d for d in documents if d[1]][:60]
    folder = tables(documents=docs)
    table = spark.read.parquet(f"{folder}/documents.parquet")
    model = train(table, F.lit(True))
    order = table.select("lang", "text", F.xxhash64("doc_id", "lang", "text", F.lit(3)).alias("by")).where("lang is not null").orderBy("by").collect()
    langs, vector, shares = plain_fit([(r["lang"], r["text"]) for r in order], LangParams())
    assert model.langs == langs
    for r in predict(table, model).collect():
        text = next(d[1] for d in docs if d[0] == r["doc_id"])
        p = shares(vector(Counter(grams(text, LangParams()))), model.temperature)
        assert r["lang_pred"] == langs[p.index(max(p))]
        assert abs(r["score"] - max(p)) < 1e-9


def test_long_texts_in_pieces():
    """Pieces of a few characters give the counts of the whole, and of the n-grams cut one by one."""
    p = LangParams()
    for text in ("", " ", "a", "Ab  c\n\n d ΣΑΣ ends  ", "one two three four five six seven eight " * 40, "x" * 3000, "  " * 50 + "ß"):
        whole = [x.tolist() for x in features(text, p.orders, p.bits)]
        assert dict(zip(*whole, strict=True)) == Counter(grams(text, p))
        assert all([x.tolist() for x in features(text, p.orders, p.bits, size)] == whole for size in (1, 3, 7, 100))


def test_one_id_on_most_rows(spark):
    docs = spark.range(3000).selectExpr("if(id < 2000, 7, id) AS doc_id", "if(id % 2 = 0, 'the words of one', 'les mots de deux') || if(id < 1000, '', cast(id AS string)) AS text", "if(id % 2 = 0, 'en', 'fr') AS lang")
    model = train(docs, F.lit(True), LangParams(sample=100))
    assert predict(docs, model).where("lang_pred = 'en'").count() == 1500
