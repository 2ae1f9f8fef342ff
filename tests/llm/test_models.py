import random
import re

import numpy as np
import pytest

from attestor.llm import linear, quality, toxicity

FILLER = [f"word{k}" for k in range(400)]


def corpus(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        words = [rng.choice(FILLER) for _ in range(rng.randrange(20, 80))]
        toxic, good = rng.random() < 0.2, rng.random() < 0.7
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "grumblex" + rng.choice("abc"), "Loser,"]))
        if not good:
            words = [w + "###" for w in words] if rng.random() < 0.5 else [w for w in words[:4] for _ in range(15)] + (words if toxic else [])
        rows.append((k, " ".join(words), rng.choice(["src0", "src0", "src1"]), rng.choice(["en", "de"]), int(good), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    df = spark.createDataFrame(corpus(1500), "doc_id long, text string, source string, lang string, quality int, toxic int").cache()
    return df.select("doc_id", "text", "source", "lang"), df.select("doc_id", "quality", "toxic")


def test_toxicity_on_held_out_rows(tables):
    docs, labels = tables
    model = toxicity.fit_toxicity(docs, labels)
    assert "^grum" in model.voters or "^grumb" in model.voters
    rows = toxicity.toxicity_scores(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 200
    right = np.mean([r.predicted == r.toxic for r in rows])
    assert right > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_labels_of_held_out_rows_are_not_read(spark, tables):
    docs, labels = tables
    flipped = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = toxicity.fit_toxicity(docs, labels), toxicity.fit_toxicity(docs, flipped)
    assert a.voters == b.voters and np.allclose(a.weights, b.weights) and a.intercept == b.intercept


def test_toxicity_edges(spark, tables):
    docs, labels = tables
    model = toxicity.fit_toxicity(docs, labels)
    rows = [(1, None, 0.5), (2, "", 0.5), (None, "you idiot", 0.5), (3, "fine " * 50_000 + "idiot", 0.5), (3, "fine", 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    found = toxicity.toxicity_scores(df, model).collect()
    assert len(found) == 5
    assert sorted(str(r.doc_id) for r in found if r.predicted) == ["3", "None"]
    kept = toxicity.without_toxic(df, model)
    assert kept.columns == df.columns and kept.count() == 3
    assert toxicity.toxicity_scores(df.where("false"), model).count() == 0
    seeds = toxicity.fit_toxicity(docs, labels.where("false"))
    assert [r.predicted for r in toxicity.toxicity_scores(df.where("doc_id is null"), seeds).collect()] == [1]


def test_label_model_shares_weight_of_copies():
    rng = np.random.default_rng(1)
    gold = (rng.random(500) < 0.3).astype(float)
    one = ((rng.random(500) < 0.8) & (gold > 0)).astype(float)
    other = ((rng.random(500) < 0.7) & (gold > 0)).astype(float)
    _, share = toxicity.label_model(np.column_stack([one, one, one, other]), gold)
    assert share.tolist() == pytest.approx([1 / 3, 1 / 3, 1 / 3, 1.0])


def test_quality(spark, tables):
    docs, labels = tables
    found = quality.quality_posteriors(docs, *quality.fit_quality(docs, labels)).join(labels, "doc_id").collect()
    assert len(found) == 1500
    held = {r.doc_id for r in labels.where(quality.held_out()).collect()}
    assert len(held) > 200 and np.mean([r.keep == bool(r.quality) for r in found if r.doc_id in held]) > 0.97
    hosts = {round(r.host_posterior, 9) for r in found}
    assert len(hosts) == 2


def test_quality_shrinks_sparse_hosts(spark, tables):
    docs, labels = tables
    weights, prior = quality.fit_quality(docs, labels)
    bad = spark.createDataFrame([(9000 + k, "x### y### z### " * 5, "bad", None) for k in range(300)] + [(9999, "x### y### z### " * 5, "lone", "en"), (9998, None, None, "en"), (9998, None, None, "en")], docs.schema)
    found = {r.doc_id: r for r in quality.quality_posteriors(docs.unionByName(bad), weights, prior).collect()}
    assert found[9000].host_posterior < 0.1 < found[9999].host_posterior
    assert not found[9000].keep
    assert quality.quality_posteriors(docs.where("false"), weights, prior).count() == 0
    assert quality.fit_quality(docs, labels.where("quality = 1"))[1] == 0.5


def test_logistic_fit():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < linear.sigmoid(0.5 + 2 * x[:, 0] - x[:, 1])).astype(float)
    assert linear.fit_logistic(x, y) == pytest.approx([0.5, 2, -1], abs=0.2)


def test_labels_of_held_out_rows_do_not_shape_quality(tables):
    docs, labels = tables
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality", "toxic")
    (a, x), (b, y) = quality.fit_quality(docs, labels), quality.fit_quality(docs, flipped)
    assert np.allclose(a, b) and x == y


def test_posteriors_by_plain_loops(spark, tables):
    """Group sums, moments, shrinkage and Bayes' rule over all documents, one after the other."""
    docs, labels = tables
    weights, prior = quality.fit_quality(docs, labels)
    rows = docs.collect()
    logit = {r.doc_id: weights[0] + float(np.dot(weights[1:], quality.features(r.text))) for r in rows}
    p = {k: 1 / (1 + np.exp(-v)) for k, v in logit.items()}
    hosts, paths = {}, {}
    for r in rows:
        for groups, key in ((hosts, r.source), (paths, (r.source, r.lang))):
            n, s = groups.get(key, (0, 0.0))
            groups[key] = (n + 1, s + p[r.doc_id])
    n_all = sum(n for n, _ in hosts.values())
    mean = sum(s for _, s in hosts.values()) / n_all

    def strength(groups, towards):
        between = (sum(n * (s / n - towards(k)) ** 2 for k, (n, s) in groups.items()) - mean * (1 - mean) * len(groups)) / n_all
        return min(1e6, max(1.0, mean * (1 - mean) / between - 1)) if between > 1e-12 else 1e6

    k_host = strength(hosts, lambda k: mean)
    host = {k: (s + k_host * mean) / (n + k_host) for k, (n, s) in hosts.items()}
    k_path = strength(paths, lambda k: host[k[0]])
    path = {k: (s + k_path * host[k[0]]) / (n + k_path) for k, (n, s) in paths.items()}
    for r in quality.quality_posteriors(docs, weights, prior).join(docs.select("doc_id", "source", "lang"), "doc_id").collect():
        q = path[r.source, r.lang]
        full = logit[r.doc_id] - np.log(prior / (1 - prior)) + np.log(q / (1 - q))
        assert r.host_posterior == pytest.approx(host[r.source]) and r.path_posterior == pytest.approx(q)
        assert r.posterior == pytest.approx(1 / (1 + np.exp(-full)), abs=1e-9) and r.keep == (r.posterior >= 0.5)


def test_scores_by_plain_loops(tables):
    docs, labels = tables
    model = toxicity.fit_toxicity(docs, labels)
    weight = dict(zip(model.voters, model.weights, strict=True))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.toxicity_scores(docs, model).collect():
        words = {w for t in texts[r.doc_id].lower().split() for w in re.findall(r"\w+", t)}
        fired = {v for v in weight if any(w == v[1:] if v[0] == "=" else w.startswith(v[1:]) for w in words)}
        total = model.intercept + sum(weight[v] for v in fired) + float(np.dot(model.pattern_weights, toxicity.writing(texts[r.doc_id])))
        assert r.score == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-12)


def test_label_model_by_plain_loops():
    """Expectation maximisation over single rows, for voters that do not correlate."""
    rng = np.random.default_rng(5)
    truth = rng.random(300) < 0.3
    fires = np.array([[float(rng.random() < (a if t else b)) for a, b in ((0.8, 0.02), (0.6, 0.05), (0.5, 0.01))] for t in truth])
    gold = np.array([float(t ^ (rng.random() < 0.05)) for t in truth])
    posterior, share = toxicity.label_model(fires, gold)
    assert share.tolist() == [1.0, 1.0, 1.0]
    q = [0.95 if g else 0.05 for g in gold]
    for _ in range(8):
        on, off = sum(q), len(q) - sum(q)
        rate = [((sum(x * f[j] for x, f in zip(q, fires)) + 0.5) / (on + 1), (sum((1 - x) * f[j] for x, f in zip(q, fires)) + 0.5) / (off + 1)) for j in range(3)]
        right1, right0 = (sum(x * g for x, g in zip(q, gold)) + 19) / (on + 20), (sum((1 - x) * (1 - g) for x, g in zip(q, gold)) + 19) / (off + 20)
        prior = (on + 1) / (len(q) + 2)
        new = []
        for f, g in zip(fires, gold):
            a, b = prior, 1 - prior
            for j, (r1, r0) in enumerate(rate):
                a, b = a * (r1 if f[j] else 1 - r1), b * (r0 if f[j] else 1 - r0)
            a, b = (a * right1, b * (1 - right0)) if g else (a * (1 - right1), b * right0)
            new.append(a / (a + b))
        q = new
    assert posterior == pytest.approx(q, abs=1e-6)
    assert np.mean((posterior > 0.5) == truth) > 0.95
