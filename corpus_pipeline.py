"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import text_of
from tidemark.llm.exact_dedup import drop_exact_duplicates
from tidemark.llm.mixing import mix_documents
from tidemark.llm.ngram_join import near_duplicates
from tidemark.llm.packing import pack_documents
from tidemark.llm.toxicity import drop_toxic
from tidemark.scratch import fresh, written

TOKENIZER = "word_bpe_49k.json"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, rejects go.

    Null and empty texts have no features and score by the bias and length alone; very long texts are scored whole; repeated rows score
    alike and go or stay together; an empty table stays empty; columns of any name pass through.
    """
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays.

    Null, empty and blank texts: null and empty ones are equal, blank ones are a space; very long texts
    are compared chunk by chunk; of repeated rows one stays; a null id stays only where no other has
    the text; an empty table stays empty; columns of any name pass through.
    """
    return drop_exact_duplicates(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document that names it, the smallest doc_id, stays.

    Texts without words are classes of their own and stay, and so do documents without an id whose
    class has no other; very long texts are compared on their whole n-gram sets; repeated rows that
    name their class all stay (exact_dedup goes before); an empty table stays empty; columns of any
    name pass through.
    """
    id_, digest_, own = fresh(docs, "_id", "_digest", "_own")
    named = near_duplicates(docs).filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
    stay = named.select(F.col("doc_id").alias(id_), F.col("digest").alias(digest_))
    digest = F.md5(text_of("text").cast("binary"))
    return docs.withColumn(own, digest).join(stay, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(digest_)), "left_semi").drop(own)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in the global order of virtual finish times; one
    that is cut by the budget comes whole that once.

    Null and empty texts have no words and are never taken; very long texts are served like others;
    rows that share a doc_id, repeated ones too, all come as often as the best served of them; an
    empty table stays empty; columns of any name pass through.
    """
    id_, times, first, lap, epoch, finish = fresh(docs, "_id", "_times", "_first", "_lap", "_epoch", "_finish")
    queue = mix_documents(docs).filter("taken > 0")
    served = queue.groupBy(F.col("doc_id").alias(id_)).agg(F.max(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias(times), F.min((F.col("start") + F.col("size")) / F.col("target")).alias(first), F.min(F.col("source_size") / F.col("target")).alias(lap))
    taken = docs.join(served, F.col("doc_id").eqNullSafe(F.col(id_))).withColumn(epoch, F.explode(F.sequence(F.lit(0), F.col(times) - 1)))
    return taken.withColumn(finish, F.col(first) + F.col(epoch) * F.col(lap)).orderBy(finish, "doc_id").drop(id_, times, first, lap, epoch, finish)


def ranked(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with their rank, from 0, in the order in which they were written, and that column's name.

    Spark writes a sorted table as numbered files in order, but reads files by size. Where the rows
    come from files, their rank is the rows of all files with lower numbers and their place in their own; else it
    is their place in ``docs`` as it stands.
    """
    (rank, file, at, ahead, rows) = fresh(docs, "_rank", "_file", "_at", "_ahead", "_rows")
    try:
        placed = docs.select("*", F.struct(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("bigint"), F.regexp_extract("_metadata.file_name", r"-c(\d+)", 1).cast("bigint"), "_metadata.file_name").alias(file), F.col("_metadata.row_index").alias(at))
        sums = placed.groupBy(file).agg(F.count("*").alias(rows))
    except AnalysisException:  # no rows of files
        placed = docs.select("*", F.struct(F.spark_partition_id()).alias(file), (F.monotonically_increasing_id() % (1 << 33)).alias(at))
        sums = placed.groupBy(file).agg(F.count("*").alias(rows))
    # A row for each file.
    before = F.coalesce(F.sum(rows).over(Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(F.col(file).alias(rows), before.alias(ahead))
    return placed.join(offsets, F.col(file) == F.col(rows)).withColumn(rank, F.col(ahead) + F.col(at)).drop(file, at, ahead, rows), rank


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows without padding, a row per piece; see pack_documents() for the columns. The documents are
    packed in the order of the mix: a stretch of it after the other.

    Null and empty texts are their end id alone; very long texts are many windows; repeated rows are
    documents of their own; an empty table has no pieces; other columns are not read.
    """
    placed, rank = ranked(docs)
    return pack_documents(placed, public_tokenizers.path(TOKENIZER), rank=F.col(rank))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("ngram_join", ngram_join), ("mixing", mixing), ("packing", packing)]

#: Classifier, MinHash and tokenizer are not SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
