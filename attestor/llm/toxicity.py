"""Toxicity by weak supervision.

Voters are a seed lexicon, words and word beginnings mined from labelled rows, and writing patterns. A generative
label model estimates the firing rates of all of them, and of the given labels, in either class by expectation
maximisation, and correlations between voters given the class; correlated voters share their weight. A linear classifier
over voters and writing features is then trained on the model's posterior labels, and scores whole texts.

Labels are read only where crc32 of the id as text, mod 5, is not 0. The fit uses a bounded sample of them
(``TRAIN_ROWS`` ids of least hash), written once; of the words counted over it the best ``MINED_MOST`` become voters.
What reaches the driver is voter counts and the sample's votes, one row an id, never texts.

Defined results: null and empty texts get the classifier's score of a text without any voter; a null id is scored like
any other row (held_out null); conflicting labels of one id count as toxic; no usable labels give the seed lexicon
alone; an empty table gives an empty table; only id and text columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, filter_rows, map_columns, text_rows
from .linear import fit_logistic, sigmoid

TRAIN_ROWS = 6000
MINED_MOST = 400
MINED_GAIN = 30.0
PREFIXES = (4, 5, 6, 7)
REMEMBERED = 150_000

# The seed lexicon.
SEEDS = ("idiot", "moron", "stupid", "loser", "worthless", "clown", "scum", "trash", "pathetic", "disgusting", "dumb", "imbecile", "filthy", "vermin", "bastard", "retard", "freak", "garbage", "ugly", "kill")

_words = re.compile(r"\w+")


def word_features(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:n] for n in PREFIXES if len(word) >= n)]


def tokens(text: str | None) -> set[str]:
    return set(text.lower().split()) if text else set()


def features(text: str | None) -> set[str]:
    return {f for t in tokens(text) for w in _words.findall(t) for f in word_features(w)}


def writing(text: str | None) -> list[float]:
    """Pattern features: exclamation and question marks, all in capitals, no text."""
    text = text or ""
    n = max(1, len(text))
    return [min(1.0, 20 * text.count("!") / n), min(1.0, 20 * text.count("?") / n), float(text.isupper()), float(not text)]


WRITING = 4


@dataclass
class Model:
    voters: list[str] = field(default_factory=lambda: ["=" + w for w in SEEDS])
    weights: np.ndarray = field(default_factory=lambda: np.full(len(SEEDS), 4.0))
    pattern_weights: np.ndarray = field(default_factory=lambda: np.zeros(WRITING))
    intercept: float = -3.0


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, toxic) of at most ``rows`` labelled ids, one row an id; of several texts of an id the least stands."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def _mine(sample: DataFrame) -> tuple[list[str], int]:
    """Features that speak for the toxic class by log-likelihood gain, the best ``MINED_MOST`` first; rows sampled."""

    def make():
        def fn(texts, toxic):
            pos, every = Counter(), Counter()
            for t, y in zip(texts, toxic, strict=True):
                found = features(t)
                every.update(found)
                if y:
                    pos.update(found)
            yield None, sum(toxic), len(toxic)
            yield from ((f, pos[f], n) for f, n in every.items())

        return fn

    partial = map_columns(sample.select("text", "toxic"), make, "feature string, pos long, n long", 1024)
    counts = partial.groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    total = counts.where("feature is null").first()
    n_pos, n = (int(total.pos), int(total.n)) if total else (0, 0)
    if not n_pos or n_pos == n:
        return [], n
    base = n_pos / n
    gain = 2 * F.col("pos") * F.log(F.col("pos") / (F.col("n") * base))
    best = counts.where("feature is not null and pos >= 0.9 * n").withColumn("gain", gain).where(F.col("gain") >= MINED_GAIN).orderBy(F.desc("gain"), F.length("feature"), "feature").limit(MINED_MOST)
    return [r.feature for r in best.collect()], n


def _votes(sample: DataFrame, voters: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    def make():
        index = {v: k for k, v in enumerate(voters)}

        def fn(texts, toxic):
            for t, y in zip(texts, toxic, strict=True):
                yield sorted(index[f] for f in features(t) if f in index), writing(t), int(y)

        return fn

    rows = map_columns(sample.select("text", "toxic"), make, "fires array<int>, writing array<double>, toxic int").collect()
    fires = np.zeros((len(rows), len(voters)))
    for k, r in enumerate(rows):
        fires[k, r.fires] = 1
    return fires, np.array([r.writing for r in rows]).reshape(len(rows), WRITING), np.array([r.toxic for r in rows], float)


def label_model(fires: np.ndarray, gold: np.ndarray, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(posterior, weight share of each voter) by EM over firing rates in either class.

    The given labels are one more voter: its rates are estimated like the others', from a prior of 19 right in 20.
    Voters whose residuals given the class correlate above one half, as of the last round, share one weight.
    """
    n = len(gold)
    posterior = gold * 0.95 + (1 - gold) * 0.05
    share = np.ones(fires.shape[1])
    for step in range(rounds):
        prior = (posterior.sum() + 1) / (n + 2)
        toxic, clean = posterior.sum(), (1 - posterior).sum()
        rate1, rate0 = (posterior @ fires + 0.5) / (toxic + 1), ((1 - posterior) @ fires + 0.5) / (clean + 1)
        right1, right0 = (posterior @ gold + 19) / (toxic + 20), ((1 - posterior) @ (1 - gold) + 19) / (clean + 20)
        if step:
            residual = fires - np.outer(posterior, rate1) - np.outer(1 - posterior, rate0)
            spread = np.sqrt((residual**2).sum(0)) + 1e-9
            close = (residual.T @ residual) / np.outer(spread, spread) > 0.5
            share = 1.0 / np.maximum(1, close.sum(1))
        on, off = np.log(rate1 / rate0) * share, np.log((1 - rate1) / (1 - rate0)) * share
        logit = np.log(prior / (1 - prior)) + fires @ on + (1 - fires) @ off
        logit += np.where(gold > 0, np.log(right1 / (1 - right0)), np.log((1 - right1) / right0))
        posterior = sigmoid(logit)
    return posterior, share


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Model:
    work = Workspace(docs.sparkSession)
    sample = work.keep(_sample(text_rows(docs, id_col, text_col), labels, rows))  # the texts are read once for the fit
    mined, n = _mine(sample)
    seeds = ["=" + w for w in SEEDS]
    voters = seeds + [v for v in mined if v not in set(seeds)]
    if not n:
        return Model()
    fires, pattern, gold = _votes(sample, voters)
    work.drop(sample)
    seen: set[bytes] = set()
    useful = np.zeros(len(voters), bool)
    for k in range(len(voters)):  # of voters that fire on the same documents the first stays: the seed or the shorter beginning
        same = fires[:, k].tobytes()
        useful[k] = k < len(seeds) or same not in seen and fires[gold > 0, k].sum() >= 0.9 * max(1, fires[:, k].sum())
        seen.add(same)
    fires, voters = fires[:, useful], [v for v, u in zip(voters, useful, strict=True) if u]
    if gold.sum() < 3:
        return Model()
    posterior, _ = label_model(np.column_stack([fires, pattern > 0.5]), gold)
    beta = fit_logistic(np.column_stack([fires, pattern]), posterior, penalty=0.05)
    logit = beta[0] + fires @ beta[1 : 1 + len(voters)] + pattern @ beta[1 + len(voters) :]
    shift, scale = fit_logistic(logit[:, None], gold, penalty=0.01)  # puts one half between the classes
    beta = np.r_[shift + scale * beta[0], scale * beta[1:]] if scale > 0 else beta
    weights = beta[1 : 1 + len(voters)]
    for k, v in enumerate(voters):  # a seed that the sample never shows keeps its lexicon weight
        if k < len(seeds) and not fires[:, k].any():
            weights[k] = 4.0
    return Model(voters, weights, beta[1 + len(voters) :], float(beta[0]))


class Scorer:
    def __init__(self, model: Model):
        self.model, self.memory = model, {}
        self.index = {v: k for k, v in enumerate(model.voters)}

    def __call__(self, text: str | None) -> float:
        memory, index = self.memory, self.index
        found: set[int] = set()
        if len(memory) > REMEMBERED:
            memory.clear()
        for t in tokens(text):
            hit = memory.get(t)
            if hit is None:
                hit = memory[t] = tuple(index[f] for w in _words.findall(t) for f in word_features(w) if f in index)
            if hit:
                found.update(hit)
        value = self.model.intercept + sum(self.model.weights[k] for k in sorted(found)) + float(np.dot(self.model.pattern_weights, writing(text)))
        return float(sigmoid(value))


def toxicity_scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of one half) of each document."""

    def make():
        scorer = Scorer(model)

        def fn(ids, texts):
            for i, t in zip(ids, texts, strict=True):
                s = scorer(t)
                yield i, s, int(s >= 0.5)

        return fn

    scored = map_columns(text_rows(docs, id_col, text_col), make, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not call toxic, with all their columns."""

    def make():
        scorer = Scorer(model)
        return lambda texts: [scorer(t) < 0.5 for t in texts]

    return filter_rows(docs, text_col, make)
