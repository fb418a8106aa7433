"""Corpus pipeline: quality rules, near duplicates, personal data, mixing and encoding, each stage on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wattline.llm.bpe_lexicon import encode_figures, prepare
from wattline.llm.common import free_names, hold_few_bytes, materialise, read_table
from wattline.llm.line_rules import clean_documents
from wattline.llm.mixing import mix
from wattline.llm.pii_spans import redact_documents
from wattline.llm.shingle_join import keep_first

#: Near duplicates share five-word shingles to 80 hundredths at least.
NEAR_WORDS, NEAR_SIMILAR = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; failing lines of the others go. Null and empty texts have no words and go; repeated rows are judged
    alike; an empty table stays empty; other columns are kept, whatever their names."""
    hold_few_bytes(spark)
    return clean_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each connected group stays, one of rows that repeat id and text. Null and empty texts are groups of
    their own; a null id comes first; an empty table stays empty; other columns are kept, whatever their names."""
    hold_few_bytes(spark)
    return keep_first(docs, width=NEAR_WORDS, similar=NEAR_SIMILAR)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes the name of its kind. A null text stays null; repeated rows change alike; an empty table stays empty;
    other columns are kept, whatever their names."""
    hold_few_bytes(spark)
    return redact_documents(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose token shares follow the target weights. Null sources and languages are categories; repeated rows stay or go
    together; an empty table stays empty; other columns are kept, whatever their names."""
    hold_few_bytes(spark)
    (into,) = free_names(docs, "mixed")
    return mix(docs, into=into).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with the digests of ids and decoded text. A null text is encoded as the empty one; repeated rows
    stay; an empty table stays empty."""
    hold_few_bytes(spark)
    encoded = encode_figures(prepare(docs), "text", with_ids=True)
    return docs.select("doc_id", "source", "lang", encoded.alias("e")).select("doc_id", "source", "lang", "e.*")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixing), ("encoding", encoding)]
#: The stages need Python for line rules, overlap search, transducers and merges; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
