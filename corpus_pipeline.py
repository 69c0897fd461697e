"""From raw documents to token ids: language, exact copies, near copies, mix, encoding.

Each stage takes (spark, docs, sf_dir) and returns the documents that it leaves, in their own columns; the last returns digests
of the ids. Stages are handed on as Parquet, and what a stage wrote on the way goes when it is done. SQL can't express the first stage, so
there is no ORACLE_SQL.

A row is judged by itself and not by its doc_id, so an id may be null or stand for several texts. Null and empty texts have no letter and go
in the first stage; repeated rows are exact copies, of which one stays; an empty table gives an empty one. Columns besides doc_id,
text, lang, source and n_chars are handed on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import exact_dedup, langid, minhash, mixing
from quern.llm.common import documents, fold, settled
from quern.llm.q_bpe import digest

#: Least likeness to a language's profile; what is below is in none of the languages.
LEAST_SCORE = 0.25
#: Similarity in percent from which two documents are near copies.
NEAR = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: those without letters, and those unlike every profile, go."""
    profiles = langid.fit(docs, fold(F.col("doc_id"), 4) != 2)
    judged = langid.predict(docs, profiles)
    return judged.where((F.col("lang_pred") != langid.UND) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id; of its repeated rows, one."""
    return exact_dedup.representatives(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id."""
    return minhash.representatives(docs, percent=NEAR)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents as often as the mix takes them."""
    return mixing.mixed(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digests of the ids of each document of the mix, and of what they decode to."""
    return digest(docs)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_copies),
    ("MinHash near-dedup", near_copies),
    ("mixing sources to target weights", mix),
    ("byte-level BPE", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), "stage-" + "".join(c if c.isalnum() else "-" for c in name))
    return STAGES[-1][1](spark, docs, sf_dir)
