"""A training corpus from documents: language, quality, near duplicates, secrets, packed sequences.

STAGES are run in order over the documents table; each works on all rows its predecessor kept, is written as Parquet
and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm import jaccard, langid, packing, quality, secrets
from kgloom.session import staged, table

#: Least probability of the predicted language; short clean texts between two languages reach it. Texts without a letter
#: (und) have none.
SURE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9, learned from the labelled languages of docs: texts without a sure language go.

    Null and empty texts and texts without letters are rejected; where no language is labelled, nothing is known and all
    go. Rows that are alike stay or go together. Columns of any name stay as they are.
    """
    found = langid.identified(docs, langid.train(docs))
    pred, prob = found.columns[-2:]
    return found.where((F.col(pred) != langid.UNKNOWN) & (F.col(prob) >= SURE)).select(*docs.columns)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1, learned from the labels of docs: texts scored under GOOD go. Without labels there is no score, and all stay.

    Null and empty texts are scored like others. Rows that are alike stay or go together. Columns of any name stay as they are.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    if model is None:
        return docs
    found = quality.scored(docs, model)
    return found.where(F.col(found.columns[-1]) >= quality.GOOD).select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3 at five words and 0.8: of each group of linked documents the smallest doc_id stays.

    Null and empty texts and rows without an id link with nothing and stay; of rows that repeat a doc_id one stays.
    """
    return jaccard.one_of_each(spark, docs)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: secrets are replaced by their kind in brackets, and n_chars follows. No row goes, null texts stay null."""
    return secrets.redact_column(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: pieces of sequences of 1024 tokens. Null and empty texts are their end alone; repeated rows are packed each."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language), ("quality", good), ("near_duplicates", distinct), ("secrets", redacted), ("packing", packed)]

#: The stages are models, links and a tokenizer; SQL expresses none of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir; each stage before it is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
