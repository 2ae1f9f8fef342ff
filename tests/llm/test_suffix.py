import random
from collections import defaultdict

import pytest

from attestor.llm import suffix_dedup as X
from attestor.llm.minhash import words_of


def brute(texts: dict) -> dict:
    """Spans of words that lie in a stretch of 50 words of another document too."""
    where = defaultdict(set)
    words = {i: words_of(t) for i, t in texts.items()}
    for i, w in words.items():
        for k in range(len(w) - X.PASSAGE + 1):
            where[tuple(w[k : k + X.PASSAGE])].add(i)
    out = {}
    for i, w in words.items():
        covered = set()
        for k in range(len(w) - X.PASSAGE + 1):
            if len(where[tuple(w[k : k + X.PASSAGE])]) > 1:
                covered.update(range(k, k + X.PASSAGE))
        spans = []
        starts, ends = X.word_bounds(texts[i]) if texts[i] else ([], [])
        for k in sorted(covered):
            if spans and spans[-1][1] == k:
                spans[-1][1] = k + 1
            else:
                spans.append([k, k + 1])
        out[i] = (len(covered), ",".join(f"{starts[a]}:{ends[b - 1]}" for a, b in spans))
    return out


def brute_inner(texts: dict) -> dict:
    """Spans of words that lie in a stretch of 50 words that its own document has twice."""
    out = {}
    for i, t in texts.items():
        words = words_of(t)
        places = defaultdict(list)
        for k in range(len(words) - X.PASSAGE + 1):
            places[tuple(words[k : k + X.PASSAGE])].append(k)
        covered = sorted({j for at in places.values() if len(at) > 1 for k in at for j in range(k, k + X.PASSAGE)})
        starts, ends = X.word_bounds(t) if t else ([], [])
        spans = []
        for k in covered:
            if spans and spans[-1][1] == k:
                spans[-1][1] = k + 1
            else:
                spans.append([k, k + 1])
        out[i] = ",".join(f"{starts[a]}:{ends[b - 1]}" for a, b in spans)
    return out


def corpus():
    rng = random.Random(11)
    vocabulary = [f"wört{k}" for k in range(3000)]

    def prose(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    passages = [prose(n) for n in (49, 50, 51, 80, 140)]
    left, middle, right = prose(40), prose(30), prose(40)
    docs = []
    for _ in range(60):
        parts = prose(rng.randrange(120))
        for _ in range(rng.randrange(3)):
            parts += rng.choice(passages) + prose(rng.randrange(40))
        docs.append(parts)
    # X shares left + middle with Y and middle + right with Z: no single neighbour shows both.
    docs += [prose(9) + left + middle + right + prose(9), prose(5) + left + middle + prose(30), prose(3) + middle + right + prose(30)]
    docs += [list(docs[3]), ["a"] * 200, ["a"] * 120 + prose(10)]
    own, line = prose(60), prose(7)
    docs += [own + prose(5) + own, prose(20) + line * 12]
    return {k: rng.choice([" ", "\n", " \t "]).join(x) for k, x in enumerate(docs)}


@pytest.mark.parametrize("hot, part", [(X.HOT, X.PART), (10, 3), (1, 1)])
def test_equals_brute_force(spark, monkeypatch, hot, part):
    """Also with some or all heads too large for a task."""
    monkeypatch.setattr(X, "HOT", hot)
    monkeypatch.setattr(X, "PART", part)
    texts = corpus()
    expected, inner = brute(texts), brute_inner(texts)
    assert sum(map(bool, inner.values())) >= 4
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = X.repeated_passages(df).collect()
    assert len(found) == len(texts)
    assert sum(1 for w, _ in expected.values() if w) > 20
    for r in found:
        assert (r.repeated_words, r.spans) == expected[r.doc_id], r.doc_id
        assert r.n_spans == len([s for s in r.spans.split(",") if s])
        assert (r.first_doc_id is None) == (r.n_spans == 0)
        assert r.inner_spans == inner[r.doc_id], r.doc_id
        assert r.n_inner == len([s for s in r.inner_spans.split(",") if s])


def test_first_document(spark):
    texts = corpus()
    stretches = {i: {tuple(w[k : k + X.PASSAGE]) for k in range(len(w) - X.PASSAGE + 1)} for i, w in ((i, words_of(t)) for i, t in texts.items())}
    for r in X.repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect():
        shared = {i for i, s in stretches.items() if s & stretches[r.doc_id]}
        assert r.first_doc_id == (min(shared) if len(shared) > 1 else None)


def test_texts_of_one_id(spark):
    """One text stands for an id, the same one in any order of the rows."""
    long = " ".join(f"w{k}" for k in range(80))
    rows = [(1, long), (1, "other " * 70), (2, "start " + long), (2, "start " + long), (3, "few")]
    found = [sorted(map(tuple, X.repeated_passages(spark.createDataFrame(order, "doc_id long, text string")).collect())) for order in (rows, rows[::-1])]
    assert found[0] == found[1] and len(found[0]) == 5
    assert len({r for r in found[0] if r[0] == 1}) == 1


def test_edge_cases(spark):
    long = " ".join(f"w{k}" for k in range(20_000))
    rows = [(1, None, 1), (2, "", 1), (3, "few words", 1), (4, "few words", 1), (None, long, 1), (5, long, 2), (6, long + " end", 2), (7, "b " * 60, 3), (7, "b " * 60, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, places int")
    found = X.repeated_passages(df).collect()
    by = {r.doc_id: r for r in found}
    assert len(found) == 9
    assert [by[k].n_spans for k in (1, 2, 3, 4, None, 7)] == [0] * 6
    assert (by[5].repeated_words, by[6].repeated_words, by[6].first_doc_id) == (20_000, 20_000, 5)
    assert X.repeated_passages(df.where("false")).count() == 0
