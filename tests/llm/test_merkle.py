"""Manifests against a plain tree in Python."""

from __future__ import annotations

import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from waymark.llm.merkle import MerkleParams, audited, covers, folded, manifest, parent


def tree(nodes: list[str], arity: int = 3) -> tuple[str, list[list[tuple[int, list[str]]]]]:
    """Root and each node's steps (place, siblings) of a tree over hex digests."""
    paths: list[list] = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        next_, next_under = [], []
        for a in range(0, len(nodes), arity):
            run = nodes[a : a + arity]
            for k in range(len(run)):
                for i in under[a + k]:
                    paths[i].append((k, run[:k] + run[k + 1 :]))
            next_.append(sha256("".join(run).encode()).hexdigest())
            next_under.append([i for u in under[a : a + arity] for i in u])
        nodes, under = next_, next_under
    return nodes[0], paths


def climbed(digest: str, path: list) -> str:
    for place, others in path:
        digest = sha256("".join([*others[:place], digest, *others[place:]]).encode()).hexdigest()
    return digest


def expected(rows: list[tuple], arity: int) -> list[tuple]:
    """(doc_id, leaf, subroot, root, siblings) of (doc_id, leaf, group) rows."""
    groups: dict = {}
    for doc_id, leaf, group in rows:
        groups.setdefault(group, []).append((doc_id, leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {g: tree([x for _, x in sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))], arity) for g in names}
    root, crown = tree([made[g][0] for g in names], arity)
    out = []
    for g, top in zip(names, crown, strict=True):
        order = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        for (doc_id, leaf), path in zip(order, made[g][1], strict=True):
            whole = path + top
            assert climbed(leaf, whole) == root
            out.append((doc_id, leaf, made[g][0], root, "".join(x for _, others in whole for x in others)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("arity", "height", "partitions"), [(3, 1, 7), (3, 2, 5), (3, 7, 3), (2, 2, 4)])
def test_manifest_equals_a_plain_tree(spark, arity, height, partitions):
    """Groups of one leaf up to two hundred, around the powers, dealt over many sorted partitions; repeated rows; no group."""
    rng = random.Random(height)
    sizes = {None: 5, "a": 1, "b": 2, "é": 3, "z": 27, "hot": 200, "": 28, "B": 9, "y": 82}
    rows = [(None if k == 0 and g == "hot" else k // (3 if g == "z" else 1), sha256(repr((g, k // 2 if g == "y" else k)).encode()).hexdigest(), g) for g, n in sizes.items() for k in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, h string, grp string").select("doc_id", F.unhex("h").alias("leaf"), F.lit(None).cast("binary").alias("other"), "grp")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = manifest(df, "grp", MerkleParams(arity, height, part_rows=40)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(folded(bytes(r["leaf"]), bytes(r["steps"]), bytes(r["siblings"])) == bytes(r["root"]) for r in found)
    assert sorted(((r["doc_id"], r["leaf"].hex(), r["subroot"].hex(), r["root"].hex(), r["siblings"].hex()) for r in found), key=repr) == expected(rows, arity)


def test_one_leaf_and_none(spark):
    one = spark.createDataFrame([(1, b"x" * 32, None)], "doc_id long, leaf binary, other binary").withColumn("g", F.lit("s"))
    r = manifest(one, "g").first()
    assert bytes(r["leaf"]) == bytes(r["subroot"]) == bytes(r["root"]) and not r["steps"] and not r["siblings"]
    assert manifest(one.where("doc_id > 1"), "g").collect() == []


def test_subtrees_cover_a_run():
    assert covers(0, 9, 3, 2) == [(2, 0)] and covers(2, 10, 3, 7) == [(0, 2), (1, 1), (1, 2), (0, 9)] and covers(0, 9, 3, 1) == [(1, 0), (1, 1), (1, 2)]
    a, b = sha256(b"a").digest(), sha256(b"b").digest()
    assert parent([a, b]).hex() == sha256((a.hex() + b.hex()).encode()).hexdigest()


def test_tampering_shows(spark):
    """Only rows whose text changes fail; a null text or id never does; the root tells rows apart that read alike."""
    import zlib

    rows = [(i, f"line\n{i}" if i % 3 else f"line {i}", "en", "s" if i % 2 else None, 6) for i in range(40)] + [(40, None, None, None, None), (None, "a\nb", "en", "s", 3)]
    found = audited(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    assert len(found) == 42 and len({r["root"] for r in found}) == 1
    for r in found:
        i = r["doc_id"]
        changed = i is not None and i < 40 and i % 3 and zlib.crc32(str(i).encode()) % 2 == 0
        assert r["verified"] == (not changed) == (r["folded_root"] == r["root"])
    shifted = spark.createDataFrame([(1, "b", "a", "s", 1), (2, "ab", None, "s", 1), (3, "-", "-", None, None), (4, None, None, "-", None)], "doc_id long, text string, lang string, source string, n_chars long")
    leaves = {r["doc_id"]: r["leaf"] for r in audited(shifted).collect()}
    assert leaves[1] == sha256(b"1:11:s1:a1:11:b").hexdigest() and leaves[4] == sha256(b"1:41:----").hexdigest() and len(set(leaves.values())) == 4
