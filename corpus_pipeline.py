"""From raw documents to packed training batches, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkstore.llm import language, mixing, packing, queries, simhash, toxicity
from sparkstore.llm.common import cut, fresh, table

#: Least calibrated probability of a document's language.
SURE = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network does not mark, learned on this input."""
    score, mark = fresh("score"), fresh("mark")  # the input may have columns of any name
    scored = toxicity.score(docs, table(spark, sf_dir, "labels"), names=(score, mark))
    return scored.where(F.col(mark) == 0).drop(score, mark)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is told with a probability of SURE or more."""
    lang, score = fresh("lang"), fresh("score")
    told = language.identify(docs, language.learn(docs), names=(lang, score))
    return told.where((F.col(lang) != language.UNKNOWN) & (F.col(score) >= SURE)).drop(lang, score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, five-word shingles of a likeness
    of 0.8 or more: that of the smallest doc_id."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight takes it, whole copies."""
    return mixing.apply_mix(docs)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, lengths in tokens, in batches of optimal length buckets."""
    return packing.pack_tokens(docs, queries.TOKENIZER)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_known_language),
    ("near_duplicates", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_batches),
]

#: Models and keyed hashes decide here; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared
    checkpoint folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
