"""A corpus from raw documents: language, exact copies, near copies, mixture, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept,
and returns a DataFrame that is written and reread as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratalog.llm import bpe, exact_dedup, language, mixing, near_dedup
from stratalog.llm.queries_text import remainder, tokenizer_path
from stratalog.llm.scratch import Scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language. Null and empty texts, those without a letter and those in no learned script go; a mixed text stays. Ties and repeated rows are judged by their text; no rows, no result."""
    return language.drop_unidentified(docs, language.train(docs, remainder(4) != 2))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, apart from white space: the smallest id, a null id last; of repeated rows one. Null and empty are one text. No rows, no result."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies: five-word shingles, similarity of 0.8 or more. Texts without words and rows without an id stay; rows of one id stay or go together. No rows, no result."""
    return near_dedup.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources, a whole row for each repeat of a document. Texts without words go; null sources are one source; rows with null or equal ids have their own places. No rows, no result."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of the ids and of the decoded text, a row for each row. A null text has no ids; repeated rows are encoded alike. No rows, no result."""
    return bpe.encoded(docs, tokenizer_path()).drop("decoded")


STAGES = [("language", language_id), ("exact", exact), ("near", near), ("mix", mix), ("tokens", tokens)]
#: SQL has neither the classifier nor the components nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        before = list(Scratch.opened)
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        for own in [s for s in Scratch.opened if s not in before]:
            own.close()  # the stage is written: nothing reads its tables any more
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
