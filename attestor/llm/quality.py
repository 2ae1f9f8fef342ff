"""Document quality by hierarchical empirical Bayes.

A classifier over writing features gives each document's evidence as a log-odds ratio. Grouped aggregations over all
documents give each host (``source``) and each path under it (``source`` and ``lang``) the sum of its documents'
probabilities; the between-group variance, by moments, says how far groups really differ, and from it follows how
strongly a group is shrunk: hosts towards the global prior, paths towards their host. A document's posterior is its
own evidence on top of its path's prior.

The classifier is fit on a bounded sample of labelled rows that are not held out (``TRAIN_ROWS`` ids of least hash); only
feature vectors reach the driver. Counts, sums and variances cover all documents.

Defined results: null and empty texts have features of zero and are scored as such; a null source or lang is a group
of its own; conflicting labels of one id count as low quality; without usable labels of both classes the fixed
weights of ``FALLBACK`` apply; repeated rows count each; an empty table gives an empty table; only the id, text, host
and path columns are read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, broadcast_if_few, map_columns
from .linear import fit_logistic, sigmoid

TRAIN_ROWS = 6000
BROADCAST_GROUPS = 200_000
FEATURES = ("log_words", "distinct_share", "repeat_share", "top_share", "symbol_share", "capital_share", "digit_share", "shout_share", "line_repeat_share", "stop_share")
#: Weights without labels: repeats, symbols, capitals and shouting speak against a text.
FALLBACK = np.array([2.0, 0.0, 1.0, -6.0, -3.0, -8.0, -4.0, -2.0, -8.0, -2.0, 0.0])

_symbols = re.compile(r"[#$%&*<>^~|=_\\{}\[\]@]")
_digits = re.compile(r"[0-9]")
_capitals = re.compile(r"[A-ZÀ-ÖØ-Þ]")


def features(text: str | None) -> list[float]:
    words = text.split() if text else []
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    counts = Counter(words)
    chars = len(text)
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        float(np.log1p(n)),
        len(counts) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        max(counts.values()) / n if n >= 20 else 0.0,
        min(1.0, 5 * len(_symbols.findall(text)) / chars),
        len(_capitals.findall(text)) / chars,
        len(_digits.findall(text)) / chars,
        min(1.0, text.count("!") / n),
        1 - len(set(lines)) / max(1, len(lines)),
        text.count(".") / n,
    ]


def held_out(id_col: str = "doc_id"):
    """Rows whose labels no fit reads: crc32 of the id as text, mod 5, is 0."""
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """(weights, the intercept first; share of good rows in the sample)."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null").where(~held_out())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def make():
        def fn(texts, good):
            for t, y in zip(texts, good, strict=True):
                yield features(t), y

        return fn

    one = texts.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))  # a row an id
    sample = map_columns(one.select("text", "quality"), make, "x array<double>, y int").collect()
    y = np.array([r.y for r in sample], float)
    if len(y) == 0 or y.min() == y.max():
        return FALLBACK, 0.5
    return fit_logistic(np.array([r.x for r in sample]), y, penalty=0.01), float(y.mean())


def quality_posteriors(docs: DataFrame, weights: np.ndarray, prior: float, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", threshold: float = 0.5) -> DataFrame:
    """doc_id, doc_probability, host_posterior, path_posterior, posterior and keep."""
    work = Workspace(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"))

    def make():
        def fn(ids, texts, hosts, paths):
            for i, t, h, p in zip(ids, texts, hosts, paths, strict=True):
                logit = float(weights[0] + np.dot(weights[1:], features(t)))
                yield i, h, p, logit, float(sigmoid(logit))

        return fn

    scored = work.keep(map_columns(rows, make, "doc_id long, host string, path string, logit double, p double"))
    paths = work.keep(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")))
    hosts = work.keep(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = min(max(total.s / total.n, 1e-6), 1 - 1e-6) if total.n else 0.5

    def strength(groups: DataFrame, towards) -> float:
        """Beta strength by moments: binomial variance over the variance between groups beyond it."""
        share = F.col("s") / F.col("n")
        m = groups.agg(F.sum(F.col("n") * (share - towards) ** 2).alias("spread"), F.count("*").alias("groups"), F.sum("n").alias("n")).first()
        if not m.groups or m.groups < 2:
            return 1e6
        within = mean * (1 - mean)
        between = (m.spread / m.n) - within * m.groups / m.n
        return float(min(1e6, max(1.0, within / between - 1))) if between > 1e-12 else 1e6

    k_host = strength(hosts, F.lit(mean))
    host_post = hosts.select("host", ((F.col("s") + k_host * mean) / (F.col("n") + k_host)).alias("host_posterior"))
    joined = paths.join(host_post, paths["host"].eqNullSafe(host_post["host"])).select(paths["host"], paths["path"], "n", "s", "host_posterior")
    k_path = strength(joined, F.col("host_posterior"))
    path_post = work.keep(joined.select(F.col("host").alias("h"), F.col("path").alias("q"), "host_posterior", ((F.col("s") + k_path * F.col("host_posterior")) / (F.col("n") + k_path)).alias("path_posterior")))
    led = scored.join(broadcast_if_few(path_post, BROADCAST_GROUPS), F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    path_prior = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), F.col("path_posterior")))
    logit = F.col("logit") - float(np.log(prior / (1 - prior))) + F.log(path_prior / (1 - path_prior))
    posterior = 1 / (1 + F.exp(-logit))
    return led.select("doc_id", F.col("p").alias("doc_probability"), "host_posterior", "path_posterior", posterior.alias("posterior"), (posterior >= threshold).alias("keep"))
