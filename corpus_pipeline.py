"""The training-corpus pipeline: quality rules, classifier, near-duplicates, secrets, packing.

Every stage takes the documents that its predecessor kept, written as Parquet, and its
decisions take effect: rejected documents and all but one document of each near-duplicate
group go, secrets are replaced in the texts, and the last stage packs what is left.

Defined cases, in every stage: null and empty texts have no words, so that the quality rules
reject them; later stages on their own keep them (the classifier scores them like an empty
passage, they are nobody's near duplicate, have no secrets and pack as an end id). Repeated rows
are judged alike, and one of them stays after the near duplicates. Of near duplicates the one of
the least doc_id stays. Very long texts are handled whole. Columns that a stage doesn't know are
carried along whatever their names, up to the packing, which returns pieces. An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import ngram_join, packing, quality_classifier, quality_rules, secrets
from loomgraph.llm._store import dropped, scope, staged


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or diverge from every language go."""
    return quality_rules.keep_documents(docs)


def apply_quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for low quality go; it learns from the labelled ones among them."""
    return quality_classifier.keep_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: 5-word shingles, Jaccard similarity of 0.8 or more."""
    return ngram_join.keep_one_of_each(docs, 5, 80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets and linked credential parts are replaced in the texts."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens packed into sequences at the corpus's mixture of sources."""
    import public_tokenizers as vocabularies

    # Its workers have served four other stages: fewer words are kept.
    return packing.pack(docs, vocabularies.path("word_bpe_49k.json"), cached_words=100_000)


STAGES = [
    ("quality rules", apply_quality_rules),
    ("quality classifier", apply_quality_classifier),
    ("near duplicates", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("packing", pack_sequences),
]

#: SQL can't express the classifier and the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        if i + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        before = docs
        with scope(spark):  # the stage's own tables go with it
            docs = staged(stage(spark, docs, sf_dir), f"stage{i + 1}", keep=True)
        if i:
            dropped(before)
    return docs
