import random

import pytest

from attestor.llm import decontaminate as D


def edits_between(pattern: bytes, region: bytes) -> int:
    """Fewest edits of the pattern at any place of the region, by the full table."""
    last = [0] * (len(region) + 1)
    for i, c in enumerate(pattern, 1):
        row = [i] + [0] * len(region)
        for j, d in enumerate(region, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (c != d))
        last = row
    return min(last)


def prose(rng, n):
    return "".join(rng.choice("abcdefghijklmnop  ") for _ in range(n))


def edited(rng, text, n):
    x = list(text)
    for _ in range(n):
        p, kind = rng.randrange(len(x)), rng.random()
        if kind < 0.34:
            x[p] = rng.choice("ABCxyz")
        elif kind < 0.67:
            del x[p]
        else:
            x.insert(p, rng.choice("xyz"))
    return "".join(x)


def test_alignment_equals_full_table():
    rng = random.Random(5)
    for _ in range(120):
        p = D.normal(prose(rng, 100))
        before = rng.randrange(12)
        region = b"q" * before + D.normal(edited(rng, p.decode(), rng.randrange(10))) + b"z" * 10
        true, most = edits_between(p, region), D.budget(len(p))
        got = D.aligned(p, region, most, before)
        assert (got is None) == (true > most) and (got is None or got[0] == true)


def test_search_equals_brute_force():
    rng = random.Random(6)
    items = [(k, prose(rng, rng.choice([30, 60, 100, 170, 260]))) for k in range(20)]
    index = D.Index(items)
    table = index.table()
    texts = []
    for _ in range(40):
        k, item = rng.choice(items)
        texts.append(D.normal(prose(rng, rng.randrange(80)) + edited(rng, item, rng.choice([0, 1, 3, 6, 9])) + prose(rng, rng.randrange(80))))
    found = {(t, w): e for t, w, e, _, _ in D.search(texts, index, table)}
    expected = {}
    for t, text in enumerate(texts):
        for w, pattern in enumerate(index.windows):
            e = edits_between(pattern, text)
            if e <= D.budget(len(pattern)):
                expected[t, w] = e
    assert found == expected and len(expected) > 40


def test_frame(spark):
    rng = random.Random(7)
    items = [(0, prose(rng, 200)), (1, prose(rng, 80)), (2, "short"), (3, None), (None, prose(rng, 90)), (1, "ab" * 40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    clean = prose(rng, 500)
    rows = [(1, None, 1), (2, "", 1), (3, "é" + items[0][1].upper() + clean, 1), (4, clean, 2), (None, items[1][1], 2), (5, "short", 3), (6, "x " * 100_000 + items[0][1][100:], 3), (6, clean, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    found = {(r.doc_id, r.item_id): r for r in D.contaminated(df, bench).collect()}
    assert set(found) == {(3, 0), (None, 1), (6, 0), (5, 2)}
    whole = found[3, 0]
    assert (whole.windows, whole.item_windows, whole.min_edits) == (3, 3, 0)
    assert abs(whole.start_char - 1) <= 2 and abs(whole.end_char - 201) <= 2
    kept = D.without_contaminated(df, bench)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "4", "6"]
    assert D.contaminated(df, bench.where("false")).count() == D.contaminated(df.where("false"), bench).count() == 0
    assert D.without_contaminated(df, bench.where("false")).count() == 8


def test_large_benchmarks_come_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(D, "CHUNK_BYTES", 150)
    rng = random.Random(8)
    items = [(k, prose(rng, 90).strip()) for k in range(5)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert len(list(D.chunks(bench, "item_id", "text"))) == 5
    df = spark.createDataFrame([(k, "zz " + t) for k, t in items], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.contaminated(df, bench).collect()} == {(k, k) for k, _ in items}


@pytest.mark.parametrize("m", range(D.SHORT, 200))
def test_the_bound_is_never_empty(m):
    assert m + 1 - D.Q * (D.budget(m) + 1) >= 1


ACCENTED = [
    "Élève étonné, l'été dernier à Orléans où la forêt brûlée a été replantée près de la rivière gelée, même là-bas, très tôt",
    "El niño pequeño soñó mañana con una cigüeña; después llamó a su compañía, pidió además más café, y también llegó José aquí",
    "Größere Straßen führen über schöne Flüsse; Mädchen müssen täglich öfter grüßen, während süße Äpfel am höchsten Ast hängen",
]


def test_upper_case_of_accented_letters(spark):
    bench = spark.createDataFrame(list(enumerate(ACCENTED)), "item_id long, text string")
    before = "ẞİŉ Straße: "  # folds that change the length
    df = spark.createDataFrame([(k, before + x.upper() + " ... é") for k, x in enumerate(ACCENTED)], "doc_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in D.contaminated(df, bench).collect()}
    assert set(found) == {(k, k) for k in range(3)}
    for k, x in enumerate(ACCENTED):
        r = found[k, k]
        assert r.windows == r.item_windows and r.max_edits == 0
        assert (r.start_char, r.end_char) == (len(before), len(before) + len(x.upper()))
    assert D.without_contaminated(df, bench).count() == 0


def test_offsets_are_those_of_the_text():
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x20000)]):
        assert D.normal(c.upper()) == D.normal(c)
    text = "aẞéßİ\U0001d400z"
    assert D.char_offsets(text, [len(D.normal(text[:k])) for k in range(len(text) + 1)]) == list(range(len(text) + 1))


def test_short_items_as_whole_words(spark):
    bench = spark.createDataFrame([(1, "Paris"), (2, " two  words "), (3, "?!"), (4, "e=mc^2"), (5, ""), (6, "PARIS")], "item_id long, text string")
    texts = ["In paris, yes", "comparison", "two\n\twords", "so e=mc^2!", "élan-Paris", "éparis", "?!", "two words2"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r.doc_id, r.item_id): (r.start_char, r.end_char) for r in D.contaminated(df, bench).collect()}
    assert found == {(0, 1): (3, 8), (0, 6): (3, 8), (2, 2): (0, 10), (3, 4): (3, 9), (4, 1): (5, 10), (4, 6): (5, 10)}
    assert [r.doc_id for r in D.without_contaminated(df, bench).orderBy("doc_id").collect()] == [1, 5, 6, 7]


def test_white_space_counts_once(spark):
    rng = random.Random(9)
    item = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(40))
    text = "é  " + item.replace(" ", " \n    ") + "  end"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (r,) = D.contaminated(df, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert r.windows == r.item_windows and r.max_edits == 0 and text[r.start_char : r.end_char].split() == item.split()


def test_repeated_items_cost_once(spark):
    rng = random.Random(10)
    item = prose(rng, 300).strip()
    index = D.Index([(k, item) for k in range(2000)])
    assert len(index.windows) == len(set(index.windows)) <= 6 and all(len(x) == 2000 for x in index.items)
    df = spark.createDataFrame([(k, "zz " + item) for k in range(3)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, item) for k in range(50)], "item_id long, text string")
    assert D.contaminated(df, bench).count() == 150


def test_many_shared_grams_are_counted_in_parts(monkeypatch):
    rng = random.Random(11)
    items = [(k, "which of the following statements is the right one here " + prose(rng, 80)) for k in range(60)]
    index = D.Index(items)
    texts = [D.normal(prose(rng, 50) + t + prose(rng, 50)) for _, t in items]
    whole = D.search(texts, index, index.table())
    monkeypatch.setattr(D, "COUNTED", 100)
    assert D.search(texts, index, index.table()) == whole and len(whole) >= 60
