"""Decontamination against the textbook edit distance on every item and text."""

from __future__ import annotations

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from waymark.llm.decontamination import LeakParams, distance, leaks
from waymark.llm.queries import op2_decontamination, op2_short_items


def normal(text):
    return re.sub(r"[^0-9a-z\u0080-\U0010ffff]+", " ", "".join(c.lower() if c.isascii() else c for c in text or "")).strip()


def least(pattern, text):
    """Edit distance of the pattern to its nearest substring of text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@settings(max_examples=150, deadline=None)
@given(st.text("ab c", min_size=1, max_size=80), st.text("ab c", max_size=120), st.integers(0, 9))
def test_distance(pattern, text, limit):
    edits, start, end = distance(pattern, text, limit)
    right = least(pattern, text)
    assert edits == min(right, limit + 1) or right <= limit and edits == right
    if right <= limit and right < len(pattern):
        assert least(pattern, text[start:end]) == right


def test_query_equals_all_pairs(spark, tables):
    rng = random.Random(5)
    words = ["river", "stone", "cloud", "winter", "the", "of", "seven", "größe", "lamp", "Ort"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, say(rng.randint(3, 12)) + ("?" if k % 2 else "")) for k in range(12)] + [(90, None), (91, ""), (92, "of the of"), (93, items_repeat := "the winter lamp of seven rivers"), (94, items_repeat)]

    def hurt(text, edits):
        text = list(text)
        for _ in range(edits):
            at = rng.randrange(len(text))
            text[at : at + 1] = rng.choice([[], ["z"], [text[at], "q"]])
        return "".join(text)

    docs = [(i, f"{say(20)} {hurt(items[i % 12][1].upper() if i % 3 else items[i % 12][1], rng.randint(0, 9))}, {say(20)}") for i in range(40)]
    docs += [(100, None), (101, ""), (102, items_repeat), (102, items_repeat), (103, say(3000))]
    p = LeakParams()
    wanted = set()
    for i, text in docs:
        for k, item in items:
            n = normal(item)
            if len(n) >= p.shortest and (d := least(n, normal(text))) <= int(len(n) * p.share):
                wanted.add((i, k, d))
            elif 0 < len(n) < p.shortest and f" {n} " in f" {normal(text)} ":
                wanted.add((i, k, 0))
    found = op2_decontamination(spark, tables(True, documents=docs, benchmark=items)).collect()
    assert {(r["doc_id"], r["item_id"], r["edits"]) for r in found} == wanted
    assert sum(r["doc_id"] == 102 for r in found) >= 4  # both rows, both items
    assert len(wanted) > 15


def test_parts_of_a_large_benchmark_add_up(spark, tables):
    """A benchmark above the size of one automaton is scanned in parts."""
    items = [(k, f"item number {k} has these words in a row {k * 7919}") for k in range(30)]
    folder = tables(documents=[(k, f"before {t} after") for k, t in items], benchmark=items)
    docs, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    one, parts = (sorted(map(tuple, leaks(docs, bench, LeakParams(part=n)).collect())) for n in (8 << 20, 400))
    assert one == parts and {(k, k) for k, _ in items} <= {r[:2] for r in one}


def test_short_items_are_found_word_for_word(spark, tables):
    """Whole words only, but in scripts without spaces anywhere; together with the other query no item is left out."""
    items = [(1, "What is 7 times 8?"), (2, "水的沸点是多少？"), (3, "of"), (4, "..."), (5, None), (6, "what is 7 times 8"), (7, "an item that is long enough for edits")]
    docs = [(1, "He asked: what is 7  TIMES 8"), (2, "what is 7 times 80"), (3, "请问水的沸点是多少？谢谢"), (4, "office of"), (5, "soft offer"), (6, None), (7, "here: an item that is long enough for edits"), (8, "what is 7 times 80, what is 7 times 8")]
    folder = tables(True, documents=docs, benchmark=items)
    rows = op2_short_items(spark, folder).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(1, 1), (1, 6), (3, 2), (4, 3), (8, 1), (8, 6)} and len(rows) == 6
    assert all(r["edits"] == 0 and r["similarity"] == 1.0 for r in rows)
    assert all(normal(docs[r["doc_id"] - 1][1])[r["start"] : r["end"]] == normal(items[r["item_id"] - 1][1]) for r in rows)
    assert {(r["doc_id"], r["item_id"]) for r in op2_decontamination(spark, folder).collect()} == {(7, 7)} | {(r["doc_id"], r["item_id"]) for r in rows}
    tables_ = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    assert {(r["doc_id"], r["item_id"]) for r in leaks(*tables_, short=False).collect()} == {(7, 7)}
