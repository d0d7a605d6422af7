"""The registered queries of this subpackage, with their production parameters and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemetrics.llm.alignment import alignments
from prosemetrics.llm.exact_dedup import exact_duplicates, text_stream
from prosemetrics.llm.hard_negatives import hard_negatives
from prosemetrics.llm.mixing import Mixture, mixed_ids
from prosemetrics.llm.oracles import exact_duplicates_sql, hard_negatives_sql, mixing_sql, top_k_sql, url_sql
from prosemetrics.llm.packing import pack
from prosemetrics.llm.pii import personal_data
from prosemetrics.llm.quality_model import quality_scores
from prosemetrics.llm.quality_rules import quality_rules
from prosemetrics.llm.sharding import shards
from prosemetrics.llm.simhash import near_duplicates
from prosemetrics.llm.token_counts import token_counts
from prosemetrics.llm.topk import top_k
from prosemetrics.llm.url_filter import ALLOW, BLOCK, Rule, UrlPolicy, url_verdicts

TOKENIZER = "byte_bpe_50k.json"
PIECE_TOKENIZER = "piece_bpe_32k.model"
URL_POLICY = UrlPolicy(
    rules=(
        Rule(BLOCK, "net", "/"),
        Rule(ALLOW, "example.net", "/en/"),
        Rule(BLOCK, "example.com", "/de/"),
        Rule(ALLOW, "org", "/fr/"),
    )
)
MIXTURE = Mixture(
    domains={f"src{i}": ("web" if i < 10 else "books" if i < 16 else "forum") for i in range(20)},
    domain_weights={"web": 5, "books": 4, "forum": 2},
    lang_weights={"en": 4, "de": 2, "fr": 2, "es": 2},
    source_weights={"src0": 3, "src1": 2},
    share_pct=60,
    epochs=2,
    seed=42,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), words=4, max_bits=4)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), TOKENIZER, 1024)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(_table(spark, sf_dir, "pages"), URL_POLICY)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(_table(spark, sf_dir, "documents"), 8)


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), TOKENIZER, 2048)


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_ids(_table(spark, sf_dir, "documents"), MIXTURE)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    # As a glob the path may also name a single file.
    return exact_duplicates(docs, text_stream(spark, f"{sf_dir}/documents.parque[t]", docs.schema))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(_table(spark, sf_dir, "documents"), TOKENIZER, PIECE_TOKENIZER)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_quality_rules": op2_quality_rules,
    "op3_quality_model": op3_quality_model,
    "op4_token_counts": op4_token_counts,
    "op5_url_filter": op5_url_filter,
    "op6_sharding": op6_sharding,
    "op7_top_k": op7_top_k,
    "op8_packing": op8_packing,
    "op9_personal_data": op9_personal_data,
    "op10_mixing": op10_mixing,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_alignment": op12_alignment,
    "op13_hard_negatives": op13_hard_negatives,
}

# The others have trained models, checksums or hashes that DuckDB lacks, or free numbers; tests/llm
# compares them with brute force.
ORACLES: dict[str, str] = {
    "op5_url_filter": url_sql(URL_POLICY),
    "op7_top_k": top_k_sql(10, 100),
    "op10_mixing": mixing_sql(MIXTURE),
    "op11_exact_dedup": exact_duplicates_sql(),
    "op13_hard_negatives": hard_negatives_sql(),
}
