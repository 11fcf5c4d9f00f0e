"""Licence scans: exact phrases by hand, planted edits found, clean texts left alone."""

from __future__ import annotations

import random
import re

import numpy as np

from waymark.llm.license_scan import NOTICES, LicenseParams, Scanner, scan
from waymark.llm.queries import op7_license_scan
from waymark.llm.words import WordBlock, rare_pieces

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def by_hand(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = sorted((k, label) for phrase, label in NOTICES for n in [phrase.split()] for k in range(len(words) - len(n) + 1) if words[k : k + len(n)] == n)
    return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places}))


def corpus():
    rng = random.Random(8)
    filler = ["under", "the", "mit", "license", "version", "2", "cc", "by", "nc", "apache", "word", "é", "MIT", "2x", "the-mit"]
    docs = [(i, " ".join(rng.choice(filler) for _ in range(rng.randint(0, 300)))) for i in range(60)]
    odd = ["under the MIT license", "Under\nthe--mit\tLICENSE cc by nc", "sunder the mit license", "under the mit licenses", "cc by ncé", "cc by nc", None, "", " cc by nc", "cc by nc" * 30, "(c) Apache License, Version 2.0", "apache license version 2 apache license version 2", "x " * 20000 + "cc-by-nc", "under the mit\x00license", "cc by\x7fnc"]
    return docs + [(1000 + i, t) for i, t in enumerate(odd)] + [(1000, "a repeated id, cc by nc")]


def test_base_columns(spark, tables):
    docs = corpus()
    rows = [(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in op7_license_scan(spark, tables(documents=docs)).collect()]
    assert sorted(rows, key=repr) == sorted(((i, *by_hand(t)) for i, t in docs), key=repr)


def test_base_columns_on_the_table(spark, sf_dir, documents):
    rows = {r["doc_id"]: r for r in op7_license_scan(spark, sf_dir).collect()}
    for i, text, *_ in documents:
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == by_hand(text)
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1 and (r["score"] == 1 if r["n_base"] else r["score"] < 1)


def test_damaged_notices(spark, tables):
    found = {"under the mit licence": "mit", "undr the mit license": "mit", "apache licence version 2": "apache-2", "Apache License, Vers1on 2": "apache-2", "under themit license": "mit", "cc by n": "cc-by-nc"}
    not_found = ["over the hills and far away", "the license of the driver", "version 2 of the text", "a city by night"]
    texts = [f"some words {t} more words" for t in [*found, *not_found]]
    rows = {r["doc_id"]: r for r in op7_license_scan(spark, tables(documents=list(enumerate(texts)))).collect()}
    for i, label in enumerate(found.values()):
        assert rows[i]["labels"] == label and rows[i]["n_base"] == 0 and 0.7 < rows[i]["score"] < 1, texts[i]
        assert rows[i]["spans"][0]["first"] == 2
    for i in range(len(found), len(texts)):
        assert rows[i]["labels"] == "" and rows[i]["score"] == 0, texts[i]


def test_matches_do_not_cross_documents(spark, tables):
    folder = tables(documents=[(1, "under the mit"), (2, "license"), (3, "cc by"), (4, "nc")])
    rows = scan(spark.read.parquet(f"{folder}/documents.parquet")).collect()
    assert all(not r["base"] for r in rows)


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_fuzzy_labels_equal_all_word_spans():
    """Every run of whole words against every notice: the same labels, and the least edits of each."""
    rng, scanner = random.Random(12), Scanner(LicenseParams())
    letters = "abceilmnrstuy 2"

    def hurt(text, edits):
        text = list(text)
        for _ in range(edits):
            at = rng.randrange(len(text))
            text[at : at + 1] = rng.choice([[], [rng.choice(letters)], [text[at], rng.choice(letters)]])
        return "".join(text)

    texts = [" ".join([rng.choice(["some", "by", "the", "mit", "é"]), hurt(rng.choice(NOTICES)[0], rng.randint(0, 5)), rng.choice(["more", "nc", "2"])]) for _ in range(250)]
    hits = 0
    for text in texts:
        raw = text.encode()
        block = WordBlock(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        words = WORD.findall(text)
        best: dict[str, int] = {}
        for phrase, label, errors, *_ in scanner.notices:
            least = min(distance(phrase, " ".join(words[i:j])) for i in range(len(words)) for j in range(i + 1, len(words) + 1))
            if least <= errors:
                best[label] = least
        found: dict[str, int] = {}
        for *_, label, edits, _ in scanner.fuzzy(block):
            found[label] = min(found.get(label, 99), edits)
        assert found == best, text
        hits += bool(best)
    assert 50 < hits < 240


def test_pieces_are_cut_where_they_are_rare():
    """Pieces are disjoint and cover the notice whatever text is shown; frequent words are cut through or joined to others."""
    for phrase, _ in NOTICES:
        for shown in (b"", b"under the mit license " * 9, b"the the the by by version 2 of 2 "):
            cut = rare_pieces(phrase, -int(-len(phrase) * 0.1 // 1), shown)
            assert b"".join(piece for _, piece in cut).decode() == phrase
            assert [at for at, _ in cut] == [sum(len(p) for _, p in cut[:k]) for k in range(len(cut))]
            assert len(cut) == 1 - int(-len(phrase) * 0.1 // 1) and min(len(p) for _, p in cut) >= len(phrase) // len(cut) - 2
    shown = b"from the house to the river under a bridge; and the sun"
    assert sum(shown.count(p) for _, p in rare_pieces("under the mit license", 3, shown)) <= 1
    assert rare_pieces("é√é√", 1, b"") == [(0, "é√".encode()), (5, "é√".encode())]


def test_any_cut_finds_the_same():
    """Texts full of a notice's words, scanned with cuts chosen on each of several texts."""
    rng = random.Random(4)
    words = ["under", "the", "mit", "license", "licence", "mt", "teh", "apache", "version", "2", "cc", "by", "nc", "n"]
    text = " ".join(rng.choice(words) for _ in range(6000)).encode()
    found = []
    for first in (b"a", text, b"under the mit license cc by nc apache license version 2"):
        scanner = Scanner(LicenseParams())
        scanner.fuzzy(WordBlock(np.frombuffer(first, np.uint8), np.array([0, len(first)])))
        found.append({(row, label, start) for row, start, _, label, *_ in scanner.fuzzy(WordBlock(np.frombuffer(text, np.uint8), np.array([0, len(text)])))})
    assert found[0] == found[1] == found[2] and found[0]
