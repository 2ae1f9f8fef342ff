"""The registered queries of the corpus operators; each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .bpe import bpe
from .common import read
from .decontaminate import contaminated
from .html_extract import main_text
from .media import encode_texts, media_digests
from .minhash import near_duplicates
from .pii import pii_scan
from .quality import fit_quality, quality_posteriors
from .secrets import secret_scan
from .suffix_dedup import repeated_passages
from .toxicity import fit_toxicity, toxicity_scores


#: Where the public tokenizers' files lie; the rank file itself is a parameter of the operator.
RANK_FILE = "byte_bpe_50k.tiktoken"


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), width=3, percent=85)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe(read(spark, sf_dir, "documents"), public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(read(spark, sf_dir, "documents")).drop("redacted")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read(spark, sf_dir, "documents"))


def op5_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(encode_texts(read(spark, sf_dir, "documents")))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_scan(read(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity_scores(docs, fit_toxicity(docs, read(spark, sf_dir, "labels")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality_posteriors(docs, *fit_quality(docs, read(spark, sf_dir, "labels")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read(spark, sf_dir, "pages"))


def queries() -> dict:
    return {name: f for name, f in sorted(globals().items()) if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
