"""Corpus pipeline: quality rules, near-duplicates, benchmark passages, mix, token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohorta.llm import fm_index, line_quality, queries, raking, setsketch
from cohorta.llm.registry import cut, prepare, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the plain rules and hold mostly content lines."""
    prepare(spark)
    judged = line_quality.line_quality(docs, table(spark, sf_dir, "labels"))
    return judged.where("__lines.kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    prepare(spark)
    return setsketch.without_near_duplicates(docs).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that benchmark passages cover."""
    prepare(spark)
    return fm_index.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled towards the target mix of sources, languages and topics."""
    prepare(spark)
    return raking.mix(docs).where("__mix.sampled").select(*docs.columns)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids as bit-plane files; per document what the files hold."""
    prepare(spark)
    return queries.encode_documents(spark, docs)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", token_files),
]

#: Line labelling, components, suffix search and tokenizers have no SQL form; tests/llm holds the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what each returns is written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
