import os
import random

import numpy as np
import pytest

from attestor.llm import minhash as M
from attestor.llm.common import Workspace
from attestor.llm.components import components


def brute(texts: dict, width: int, percent: int) -> dict:
    """Smallest reachable id of each document, over all pairs of exact sets of word tuples."""

    def shingles(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()

    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (find(i), len(sets[i])) for i in texts}


def corpus(seed: int, groups: int, copies: int, words: int, changes: int) -> dict:
    """Groups of a base text and its mutated copies, ids dealt at random so that the base need not come first."""
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
        out.append(base)
        for _ in range(copies):
            copy = list(base)
            for _ in range(rng.randrange(changes + 1)):
                copy[rng.randrange(words)] = f"m{rng.randrange(10**6)}"
            out.append(copy)
    rng.shuffle(out)
    return {k: " ".join(x) for k, x in enumerate(out)}


@pytest.mark.parametrize("width, percent, changes", [(3, 85, 8), (5, 80, 6), (3, 85, 20)])
def test_equals_brute_force(spark, width, percent, changes):
    texts = corpus(width * 100 + changes, 3, 45, 200, changes)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    expected = brute(texts, width, percent)
    for r in M.near_duplicates(df, width, percent).collect():
        assert (r.component_id, r.n_shingles) == expected[r.doc_id], r.doc_id
        assert r.kept == (r.component_id == r.doc_id)


def test_edge_cases(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t", "a"), (4, "A b", "a"), (5, "a  B\n", "b"), (6, "a", "b"), (None, "x y z w", "c"), (7, "word " * 60_000, "c"), (8, "word " * 60_000, "c"), (9, "é ü", "c"), (9, "é ü", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    found = sorted(((r.doc_id, r.component_id, r.kept, r.n_shingles) for r in M.near_duplicates(df, 3, 85).collect()), key=str)
    assert found == sorted([(1, 1, True, 0), (2, 2, True, 0), (3, 3, True, 0), (4, 4, True, 1), (5, 4, False, 1), (6, 6, True, 1), (None, None, True, 2), (7, 7, True, 1), (8, 7, False, 1), (9, 9, True, 1), (9, 9, True, 1)], key=str)
    assert M.near_duplicates(df.where("false"), 3, 85).count() == 0
    kept = M.without_near_duplicates(df, 3, 85)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "4", "6", "7", "9", "None"])


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    for n in (1, 2, 10, 1000):
        assert len(M.sketch(np.unique(rng.integers(0, 2**63, n).astype(np.uint64)))) == M.COORDINATES
    errors = []
    for _ in range(30):
        pool = np.unique(rng.integers(0, 2**63, 1500).astype(np.uint64))
        rng.shuffle(pool)
        a, b = np.sort(pool[:1000]), np.sort(pool[200:1200])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        errors.append((M.sketch(a) == M.sketch(b)).mean() - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05
    code = M.fine_code(np.arange(1, 50, dtype=np.uint64))
    assert len(code) == M.FINE // 64


def test_bands_miss_rarely():
    for t in (0.8, 0.85):
        r = M.rows_per_band(t)
        assert (1 - t**r) ** (M.COORDINATES // r) <= M.MISS


def test_close_pairs_between_components(spark):
    """Members of one bucket, each its own component: every close pair comes out once, in any block."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    rows, sets = [], {}
    for k in range(40):
        s = base.copy()
        s[rng.choice(400, 12, replace=False)] = rng.integers(0, 2**63, 12)
        sets[k] = np.unique(s)
        rows.append((7, k, k, 1000, np.concatenate([[7], [100 + k]]).astype("<i8").tobytes(), M.fine_code(sets[k]).tobytes()))
    df = spark.createDataFrame([(a, b, c, d, bytearray(e), bytearray(f)) for a, b, c, d, e, f in rows], "key long, doc_id long, component long, n long, bands binary, code binary")
    found = [(r.a, r.b) for r in M._close_pairs(df, 85, Workspace(spark)).collect()]
    assert len(found) == len(set(found))
    must = {(a, b) for a in range(40) for b in range(a) if M.similar(sets[a], sets[b], 85)}
    assert must and must <= set(found)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_recall_on_a_whole_table(spark, width, percent):
    """Every pair of the table against its components: no link is lost, and none is made up."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r.doc_id: M.shingle_set(r.text, width) for r in docs.collect()}
    ids = sorted((i for i in sets if len(sets[i])), key=lambda i: len(sets[i]))
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if 100 * len(sets[i]) < percent * len(sets[j]):
                break
            if M.similar(sets[i], sets[j], percent):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    found = {r.doc_id: r.component_id for r in M.near_duplicates(docs, width, percent).collect()}
    assert found == {i: root(i) for i in sets}
    assert sum(i != c for i, c in found.items()) > 20


def test_texts_of_one_id(spark):
    """The least text stands for an id, whatever the order of the rows."""
    rows = [(5, "b " + "x y z " * 9), (5, "a b c d e f"), (6, "a b c d e f"), (7, "b " + "x y z " * 9)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string")
        assert sorted((r.doc_id, r.component_id) for r in M.near_duplicates(df, 3, 85).collect()) == [(5, 5), (5, 5), (6, 5), (7, 7)]
        assert sorted((r.doc_id, r.text[0]) for r in M.without_near_duplicates(df, 3, 85).collect()) == [(5, "a"), (7, "b")]


def test_components_of_paths(spark):
    edges = [(k, k + 1) for k in range(60)] + [(200, 100), (300, 200)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = {r.node: r.component for r in components(df, Workspace(spark)).collect()}
    assert found == {**{k: 0 for k in range(61)}, 100: 100, 200: 100, 300: 100}
    assert components(df.where("false"), Workspace(spark)).count() == 0
