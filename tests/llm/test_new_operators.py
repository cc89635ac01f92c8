"""Manifests, ranked search and repeated windows against brute force and SQL, with odd rows."""

from __future__ import annotations

import glob
import hashlib
import math
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from agoralytics.llm import doubling, manifest, queries, ranked

SCHEMA = "doc_id bigint, text string, tree string, leaf string, slice int, block int, score string"
WORDS = ["rat", "eel", "Owl", "née", "ox", "a1", "x-y", "the", "THE", "emu"]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    passage = sentence(rng, 90)
    out = [(0, sentence(rng, 9000)), (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, passage)]
    out += [(k, sentence(rng, rng.randint(1, 120))) for k in range(6, 30)]
    out += [(k, f"{sentence(rng, 30)}\n{passage}  {sentence(rng, 7)}") for k in range(30, 40)]
    return [*out, out[5], out[6], (None, out[7][1]), (None, passage), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "t", "l", 0, 1, "s") for i, t in rows], SCHEMA)


def test_addresses_are_a_permutation_of_aligned_subtrees():
    for levels in range(1, 10):
        by_depth = [manifest.address(levels, d, np.arange(1 << d)) for d in range(levels)]
        assert sorted(np.concatenate(by_depth).tolist()) == list(range((1 << levels) - 1))
        top = levels // 2
        if top:
            assert sorted(np.concatenate(by_depth[:top]).tolist()) == list(range((1 << top) - 1))
            size = (1 << (levels - top)) - 1
            lowest = by_depth[-1].reshape(1 << top, -1)
            for k, places in enumerate(lowest):
                first = (1 << top) - 1 + k * size
                assert first <= places.min() and places.max() < first + size


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
    return levels


def path_of(levels, k):
    out = []
    for level in levels[:-1]:
        out.append((level[k ^ 1] if k ^ 1 < len(level) else None, k & 1))
        k >>= 1
    return out


def proved(rows):
    """Rows ``(tree, id, leaf, claimed)`` to what ``prove`` should return."""
    groups = {}
    for row in rows:
        groups.setdefault(row[0], []).append(row)
    keys = sorted(groups, key=str.encode)
    trees = {}
    for key in keys:
        members = sorted(groups[key], key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        trees[key] = (members, tree_of([r[2] for r in members]))
    top = tree_of([trees[k][1][-1][0] for k in keys])
    out = []
    for j, key in enumerate(keys):
        members, levels = trees[key]
        for k, (_, doc, leaf, claimed) in enumerate(members):
            path = path_of(levels, k) + path_of(top, j)
            folded = claimed or leaf
            for sibling, odd in path:
                folded = digest(folded) if sibling is None else digest(sibling, folded) if odd else digest(folded, sibling)
            proof = digest(*(s for s, _ in path if s))
            out.append((doc, leaf, levels[-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_levels", [2, 3, 13])
def test_proofs_equal_plain_trees(spark, block_levels):
    rng = random.Random(7)
    rows = []
    for key, size in (("", 1), ("=a", 37), ("=b", 8), ("=é", 1), ("=z", 5), ("=c", 2), ("=d", 3)):
        for k in range(size):
            leaf = digest(key, str(k))
            rows.append((key, k if k % 5 else None, leaf, digest("other") if rng.random() < 0.2 else None))
    rows += [rows[3], rows[3], rows[4]]
    frame = spark.createDataFrame([(*r, "x", 9) for r in rows], "tree string, doc_id bigint, leaf string, claimed string, root string, total int")
    got = sorted((tuple(r) for r in manifest.prove(frame, block_levels).collect()), key=str)
    assert got == proved(rows)
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_proofs_of_one_leaf_and_of_none(spark):
    frame = spark.createDataFrame([("", None, digest("x"), None)], "tree string, doc_id bigint, leaf string, claimed string")
    (row,) = manifest.prove(frame).collect()
    assert tuple(row) == (None, digest("x"), digest("x"), digest("x"), digest(), digest("x"), True)
    assert manifest.prove(frame.limit(0)).count() == 0


def test_leaves_tell_nulls_empties_and_bytes_apart(spark):
    frame = spark.createDataFrame([(None, ""), (1, None), (12, "é")], "a bigint, b string")
    got = [r[0] for r in frame.select(manifest.leaf_digest(F.col("a"), F.col("b"))).collect()]
    assert got == [digest("-", "0:"), digest("1:1", "-"), digest("2:12", "2:é")]
    keys = [r[0] for r in frame.select(manifest.tree_key(F.col("b"))).collect()]
    assert keys == ["=", "", "=é"]


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def ranking(docs, items, top):
    bags = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    count, length = sum(map(bool, (b for _, b in bags))), sum(b.total() for _, b in bags)
    holders = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        asked = Counter(TERM.findall((text or "").translate(LOWER)))
        found = []
        for i, bag in bags:
            score = 0
            for term in asked.keys() & bag.keys():
                weight = math.floor(1000 * math.log((2 * count + 2) / (2 * holders[term] + 1)))
                norm = 75 + 25 * bag.total() * count // length
                score += asked[term] * weight * (1000000000 * bag[term] // (1000 * bag[term] + 12 * norm))
            if score:
                found.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("owners", "bundle", "per_slice"), [(1, 256, 4096), (4, 256, 8), (3, 2, 5)])
def test_search_equals_plain_scores(spark, docs, rows, monkeypatch, owners, bundle, per_slice):
    monkeypatch.setattr(ranked, "SLICE_DOCS", per_slice)
    items = [(1, "the owl"), (2, None), (3, ""), (4, "née NÉE x y OWL owl owl"), (5, "unheard of"), (6, "rat"), (6, "rat"), (None, "one ox")]
    frame = spark.createDataFrame([(i, t, "b") for i, t in items], "item_id bigint, text string, term string").coalesce(1)
    found = ranked.rank_documents(docs.coalesce(2), frame, top=6, owners=owners, bundle_items=bundle)
    assert sorted((tuple(r) for r in found.collect()), key=str) == ranking(rows, items, 6)


def test_search_of_nothing(spark, docs):
    items = spark.createDataFrame([(1, "the owl")], "item_id bigint, text string")
    assert ranked.rank_documents(docs.limit(0), items).count() == 0
    assert ranked.rank_documents(docs, items.limit(0)).count() == 0
    assert ranked.rank_documents(docs.where("text IS NULL"), items).count() == 0


def stripped(docs, length):
    cut = [(i, (t or "").encode().split()) for i, t in docs]
    seen = Counter(tuple(w[k : k + length]) for _, w in cut for k in range(len(w) - length + 1))
    out = []
    for i, words in cut:
        gone = [False] * len(words)
        for k in range(len(words) - length + 1):
            if seen[tuple(words[k : k + length])] > 1:
                gone[k : k + length] = [True] * length
        out.append((i, len(words), sum(gone), b" ".join(w for w, g in zip(words, gone, strict=True) if not g)))
    return sorted(out, key=str)


def windows_of(frame, **more):
    return sorted(
        ((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), bytes(r.kept)) for r in doubling.strip_windows(frame, **more).collect()),
        key=str,
    )


@pytest.mark.parametrize(("length", "levels"), [(35, 2), (35, 5), (6, 2), (5, 9), (1, 2), (100, 3)])
def test_windows_equal_plain_counts(docs, rows, monkeypatch, length, levels):
    monkeypatch.setattr(doubling, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(doubling, "BUCKET_BYTES", 20000)
    monkeypatch.setattr(doubling, "SHARD_BYTES", 9000)
    monkeypatch.setattr(doubling, "PIECE_BYTES", 700)
    assert windows_of(docs, length=length, levels=levels) == stripped(rows, length)


def test_levels_double_up_to_the_length():
    assert doubling.level_lengths(35) == [18, 35]
    assert doubling.level_lengths(35, 9) == [1, 2, 3, 5, 9, 18, 35]
    assert doubling.level_lengths(1, 4) == [1]


def test_windows_of_nothing_and_without_repeats(spark, docs):
    assert windows_of(docs.limit(0)) == []
    assert windows_of(docs.where("doc_id IN (1, 2, 3) OR text IS NULL"), length=2) == stripped([(1, ""), (2, ""), (3, ""), (None, "")], 2)
    frame = spark.createDataFrame([(1, " ".join(map(str, range(70000)))), (2, "a b")], "doc_id bigint, text string")
    (first, second) = windows_of(frame, length=3)
    assert first[1:3] == (70000, 0) and second == (2, 2, 0, b"a b")


@pytest.mark.parametrize("key", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, small_folder, key):
    engine = duckdb.connect()
    for path in glob.glob(f"{small_folder}/*.parquet"):
        engine.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    engine.execute(queries.ORACLE_SQL[key])
    names = [d[0] for d in engine.description]
    found = queries.QUERIES[key](spark, small_folder)
    assert sorted(found.columns) == sorted(names)
    assert sorted((tuple(r) for r in found.select(*names).collect()), key=str) == sorted(engine.fetchall(), key=str)
