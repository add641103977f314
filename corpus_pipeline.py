"""The corpus pipeline: from documents to packed sequences.

Toxic documents go, then lines that many documents share, then all but one of each group of
near-duplicates; a mix of the sources to their target weights is taken, and packed. Each
stage reads what the one before has written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logtable.llm.common import read_table, unused
from logtable.llm.line_dedup import drop_frequent_lines
from logtable.llm.mixing import mix_sources
from logtable.llm.near_dedup import near_duplicates
from logtable.llm.packing import pack, token_pieces
from logtable.llm.queries import BLOCK_WORDS, tokenizer_path
from logtable.llm.toxicity import TOXIC_FROM, learn, scorer
from logtable.plans.staging import stage

#: Tables of ids with up to so many rows are broadcast (16 MB); larger ones are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _few(ids: DataFrame) -> DataFrame:
    ids = stage(ids)
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, learnt from their labels, does not call toxic."""
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    score = scorer(spark, learn(docs, labels))
    return docs.filter(score(F.col("text").cast("string")) < TOXIC_FROM)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines found in ten of them or more."""
    kept = drop_frequent_lines(docs, min_docs=10)
    values = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return kept.select(*[values.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates."""
    copies = near_duplicates(docs).filter("NOT kept").select("doc_id").distinct()
    return docs.join(_few(copies), "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes of its words, to the nearest whole one."""
    taken = mix_sources(docs, block_words=BLOCK_WORDS).filter("taken > 0")
    # Rows that repeat an id and a size get the same number each.
    number = F.round(F.sum("taken") / F.first("size") / F.count(F.lit(1))).cast("int")
    copies = taken.groupBy("doc_id", "source", "size").agg(number.alias("copies"))
    copies = copies.groupBy("doc_id", "source").agg(F.max("copies").alias("copies")).filter("copies > 0")
    of, of_source, times, copy = unused(docs.columns, "of", "of_source", "times", "copy")
    copies = _few(copies.withColumnsRenamed({"doc_id": of, "source": of_source, "copies": times}))
    same = F.col("doc_id").eqNullSafe(F.col(of)) & F.col("source").eqNullSafe(F.col(of_source))
    return docs.join(copies, same).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequence and offset of every piece of every document."""
    return pack(token_pieces(docs, tokenizer_path()))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near dedup", drop_near_copies),
    ("mixing", mix),
    ("packing", pack_sequences),
]

#: Token ids are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for _, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
