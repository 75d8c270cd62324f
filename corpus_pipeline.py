"""Training-corpus pipeline: language, near duplicates, mixture, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept;
each result is written as Parquet and read back as the next stage's documents.
"""

from pyspark.sql import DataFrame, SparkSession

from retentia.llm import jaccard, langid, mixing, pieces
from retentia.llm.common import table
from retentia.llm.registry import piece_model_path
from retentia.sources.staging import stage

_NAMES = ("_lang_pred", "_lang_score", "_lang_rejected")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without letters or margin go."""
    content = langid.dictionaries(docs.where(~langid.held_out("doc_id")))
    found = langid.identify(docs, content, names=_NAMES)
    return found.where(f"NOT {_NAMES[2]}").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near copies."""
    return jaccard.keep_first(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or repeatedly."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their piece ids and the text these decode to."""
    return pieces.encode_decode(docs, piece_model_path())


STAGES = [
    ("language", language),
    ("near duplicates", near_duplicates),
    ("mixture", mixture),
    ("tokens", tokens),
]

# Compression sizes, hashes and piece merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
