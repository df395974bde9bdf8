"""From raw documents to packed training batches, in five stages over the corpus operators.

Each stage takes (spark, docs, sf_dir) and decides on all rows its predecessor kept. All but the last return the columns
of documents: doc_id, text, lang, source, n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm.common import materialize, word_count
from tessella.llm.fertility import fertility
from tessella.llm.longest_match import token_counts
from tessella.llm.near_dedup import near_groups
from tessella.llm.packing import pack
from tessella.llm.source_mix import entropy_mix
from tessella.llm.suffix_dedup import drop_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words a shingle of the near-duplicate stage; the two words of op5_near_dedup's contract bind that query only.
SHINGLE = 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the fertility bands reject go.

    Null, empty and blank texts have no words and go; very long ones are measured whole; repeated rows are judged alike,
    each by itself; nulls in other columns do not matter; an empty table stays empty; other columns are dropped."""
    return fertility(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one of the smallest identifier.

    Of rows that repeat an identifier one stays: the first by the texts' SHA-256, then by text, language, source and
    size. Rows without an identifier and texts without words are linked with nothing and stay; an empty table stays
    empty; other columns are dropped."""
    docs = docs.select(*COLUMNS)
    gone = near_groups(docs, size=SHINGLE).filter(~F.col("kept")).select("doc_id")
    again = materialize(docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").count().filter("count > 1").select("doc_id"), "again")
    if not again.isEmpty():
        order = [F.sha2("text", 256), F.col("text"), F.col("lang"), F.col("source"), F.col("n_chars")]
        first = F.row_number().over(W.partitionBy("doc_id").orderBy(*order))
        once = docs.join(again, "doc_id", "left_semi").withColumn("_k", first).filter("_k = 1").select(*COLUMNS)
        docs = docs.join(again, "doc_id", "left_anti").select(*COLUMNS).unionByName(once)
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out of the texts; a document of which nothing is left goes.

    Cuts fall on bytes; a character that loses some of its bytes goes with them. Null and empty texts go; rows that
    repeat identifier and text keep what their first one keeps; n_chars is counted anew; an empty table stays empty."""
    left = drop_repeats(docs, carry=("lang", "source")).filter(F.length("kept_text") > 0)
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    The mix is settled on identifiers, text hashes and sizes; texts are joined to their copies once. Null texts have size
    0 and stay once while their source has a target; a null source is one of its own; rows without an identifier are
    told apart by their texts; equal rows share the copies of all of them; an empty table stays empty."""
    docs = docs.select(*COLUMNS)
    mark = F.xxhash64("text", "lang", "n_chars")
    narrow = materialize(docs.select("doc_id", "source", mark.alias("mark"), word_count(F.col("text")).alias("size")), "sizes")
    mixed = entropy_mix(narrow, "doc_id").filter("copies > 0")
    same = mixed.groupBy("doc_id", "source", "mark").agg(F.sum("copies").alias("copies"))
    taken = materialize(same.toDF("_i", "_s", "_m", "copies"), "copies")
    keys = [F.col("doc_id").eqNullSafe(F.col("_i")), F.col("source").eqNullSafe(F.col("_s")), mark == F.col("_m")]
    once = docs
    again = materialize(narrow.groupBy("doc_id", "source", "mark").count().filter("count > 1").drop("count").toDF("_i", "_s", "_m"), "again")
    if not again.isEmpty():
        several = docs.join(again, keys, "left_semi").dropDuplicates(list(COLUMNS))
        once = docs.join(again, keys, "left_anti").unionByName(several)
    joined = once.join(taken, keys)
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their bucket width, batch and slot.

    Texts without a token have no piece; a document that the mix repeats is packed as often; nulls in other columns do
    not matter; an empty table gives an empty result."""
    return pack(materialize(token_counts(docs.select("doc_id", "source", "text")).select("doc_id", "source", "n_tokens"), "lengths"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("mixing", mixing), ("packing", packing)]

#: Newton steps, suffix arrays and the vocabulary's measures have no SQL form; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
