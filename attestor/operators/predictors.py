"""Plug point for predictors: rules or models that answer records in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parse import classify_attempt, marker_bits, marker_categories, marker_ids

#: answers(texts, protocol) -> responses, in order
Predictor = Callable[[list[str], str], list[str]]
PROTOCOLS = ("CATEGORIES", "LABEL_IDS", "BITVECTOR")


def keyword_predictor(keywords: dict[str, str]) -> Predictor:
    """A deterministic predictor: a category for each keyword that occurs, in the protocol's marker."""
    names = sorted(set(keywords.values()))

    def answer(texts: list[str], protocol: str) -> list[str]:
        out = []
        for text in texts:
            found = sorted({c for k, c in keywords.items() if k in (text or "").lower()})
            if protocol == "CATEGORIES":
                out.append("CATEGORIES=" + (", ".join(found) or "NONE"))
            elif protocol == "LABEL_IDS":
                out.append("LABEL_IDS=" + (",".join(str(names.index(c) + 1) for c in found) or "NONE"))
            else:
                out.append("BITVECTOR=" + ",".join(str(int(c in found)) for c in names))
        return out

    return answer


def predict(records: DataFrame, key: str, text: str, predictor: Predictor, protocol: str) -> DataFrame:
    """key and response of each record, in Arrow batches."""

    def run(frames: Iterator):
        for pdf in frames:
            yield pdf[[key]].assign(response=predictor(pdf[text].tolist(), protocol))

    kind = dict(records.dtypes)[key]
    return records.select(key, text).mapInPandas(run, f"{key} {kind}, response string")


def closed_choice(records: DataFrame, key: str, text: str, predictor: Predictor, categories: list[str]) -> DataFrame:
    """Three protocols in turn, each only for records that none before could answer: categories and the protocol."""
    parsers = {"CATEGORIES": marker_categories, "LABEL_IDS": marker_ids, "BITVECTOR": marker_bits}
    left, done = records, None
    for protocol in PROTOCOLS:
        answered = predict(left, key, text, predictor, protocol).select(key, parsers[protocol](F.col("response"), categories).alias("categories"), F.lit(protocol).alias("protocol"))
        valid = answered.where("categories is not null")
        done = valid if done is None else done.unionByName(valid)
        left = left.join(valid.select(key), key, "left_anti")
    return done


def outcome_of(attempts: DataFrame) -> DataFrame:
    return attempts.withColumn("outcome", classify_attempt(F.col("parse_status"), F.col("error")))
