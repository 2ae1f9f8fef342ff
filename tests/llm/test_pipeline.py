"""The pipeline against a plain version of its decisions, on a small folder of tables."""

import random

import pytest

import corpus_pipeline
from attestor.llm import secrets, toxicity
from attestor.llm.minhash import shingle_set, similar


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    words = [f"lorem{k}" for k in range(2000)]

    def prose(n):
        return [rng.choice(words) for _ in range(n)]

    item = "what is the answer to the question that nobody asked before the end of the longest day of the year"
    texts = {}
    for k in range(120):
        texts[k] = " ".join(prose(rng.randrange(30, 90)))
    for k in range(120, 150):  # near copies of the first thirty, and exact ones
        copy = texts[k - 120].split()
        if k % 2:
            copy.append("end")
        texts[k] = " ".join(copy)
    for k in (40, 41, 42):
        texts[k] += " you idiot and moron"
    for k in (50, 51):
        texts[k] += " " + item
    texts[60] += " password=hunter2hunter2"
    root = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(k, t, "en", "src0", len(t)) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([(k, 1, int(k in (40, 41, 42))) for k in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root, texts, item


def test_stages_and_run(spark, folder):
    root, texts, item = folder
    model = toxicity.fit_toxicity(spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet"))
    scorer = toxicity.Scorer(model)
    left = {k: t for k, t in texts.items() if scorer(t) < 0.5}
    assert set(texts) - set(left) == {40, 41, 42}
    sets = {k: shingle_set(t, 5) for k, t in left.items()}
    kept = {}
    for k in sorted(left):
        if not any(similar(sets[k], sets[j], 80) for j in kept):
            kept[k] = left[k]
    kept = {k: t for k, t in kept.items() if item not in t}
    clean = {k: secrets.redact(t, secrets.scan(t)) for k, t in kept.items()}

    docs = spark.read.parquet(f"{root}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, root)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    found = {r.doc_id: r for r in docs.collect()}
    assert {k: r.text for k, r in found.items()} == clean
    assert all(r.n_chars == len(r.text) for r in found.values())
    assert "[SECRET]" in found[60].text

    import hashlib

    import public_tokenizers
    import tiktoken

    from attestor.llm.bpe import read_ranks

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))), special_tokens={})
    result = {r.doc_id: r for r in corpus_pipeline.run(spark, root).collect()}
    assert set(result) == set(clean)
    for k, r in result.items():
        assert r.ids == library.encode_ordinary(clean[k]) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(clean[k].encode()).hexdigest()


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "encoding"]


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} == {f"op{k}" for k in range(1, 11)}
    assert "pipeline" in names


def test_secrets_stage_needs_no_count_of_characters(spark):
    df = spark.createDataFrame([(1, "password=abcdef1 and more", "x"), (2, None, None)], "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in corpus_pipeline.secrets(spark, df, "").collect()}
    assert found[1].text == "[SECRET] and more" and found[2].text is None
    assert corpus_pipeline.secrets(spark, df, "").columns == df.columns
