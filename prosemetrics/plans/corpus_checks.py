"""Corpus jobs: validation, statistics and the gate over them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from prosemetrics.operators import integrity
from prosemetrics.packs.base import Rules


def validate_corpus(docs: DataFrame, rules: Rules) -> DataFrame:
    """All integrity findings of ``docs(doc_id, path, meta, text)``, keyed by path."""
    return (
        integrity.record_findings(docs, rules)
        .unionByName(integrity.duplicate_findings(docs, rules))
        .unionByName(integrity.empty_corpus_findings(docs, rules))
    )
