"""Documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prosemetrics.llm.mixing import Mixture, mix
from prosemetrics.llm.near_copies import keep_one
from prosemetrics.llm.packing import pack
from prosemetrics.llm.pii import redact
from prosemetrics.llm.quality_model import keep_good
from prosemetrics.llm.shared import release, steps_stored, stored

# SQL cannot express the trained models and fingerprints; the stages are tested against brute force.
ORACLE_SQL = None

TOKENIZER = "byte_bpe_50k.json"
MIXTURE = Mixture(
    domains={f"src{i}": ("web" if i < 10 else "books" if i < 16 else "forum") for i in range(20)},
    domain_weights={"web": 5, "books": 4, "forum": 2},
    lang_weights={"en": 4, "de": 2, "fr": 2, "es": 2},
    source_weights={"src0": 3, "src1": 2},
    share_pct=90,
    epochs=1,
    seed=42,
)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of near copies (five-word shingles, similarity 0.8): that with the smallest id."""
    return keep_one(docs, words=5, similarity=0.8)


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the target mixture, each at most once."""
    return mix(docs, MIXTURE)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 2048 tokens."""
    return pack(docs, TOKENIZER, 2048)


STAGES = [
    ("quality", quality),
    ("deduplication", deduplication),
    ("privacy", privacy),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again.

    What a stage has stored is deleted as soon as its result is written, and that result when the
    next one is.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    begun = steps_stored()
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, begun, keep=1)
    return docs
