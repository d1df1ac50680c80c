"""The corpus pipeline: documents to packed training sequences.

Five stages, each over all that the one before kept: quality (rejected documents
go), language ID (documents without a recognisable language go), near-duplicates
(one document of each group stays), benchmark decontamination (documents that
hold a benchmark item go) and packing. All but the last return the columns of
their input. A stage's result is written as Parquet into the shared folder and
read again as the next one's documents.

Nulls: a NULL text is scored like an empty one, has no language and goes with
the second stage; a NULL id is never learned from and stays if its text does. Rows
are dropped by id and text: one that shares its id with another is judged by its
own text, and of rows that repeat both, one stays after the third stage. An empty
table passes through all stages as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.llm import common as C
from farebox.llm import decontam, language, neardup, packing, quality
from farebox.llm.queries import table, tokenizer_path
from farebox.session import cut_lineage, work_path

#: Least mean probability of a document's language, as a multiple of an even
#: guess among the languages learned, and at most a half.
LEAST_LANGUAGE = 1.2
#: Ids of dropped documents sent to every task at most (8 bytes each); beyond
#: this they are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _wrapped(docs: DataFrame) -> DataFrame:
    """The rows as one column, so that no column of theirs meets a result's name."""
    return docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows as one column, and a key of each: a hash of its id and text."""
    return docs.select(F.struct("*").alias("row"), F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("key"))


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` but those whose key is in ``keys`` (one column, key)."""
    keys = cut_lineage(keys.distinct())
    few = F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys
    return _keyed(docs).join(few, "key", "left_anti")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~C.in_fold("_id", 3, 1))
    return quality.score(_wrapped(docs), model).filter("predicted = 1").select("row.*")


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = language.fit(docs, ~C.in_fold("_id", 5, 0))
    found = language.predict(_wrapped(docs), net)
    least = min(0.5, LEAST_LANGUAGE / max(1, len(net.labels))) if net else 0.0
    return found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= least)).select("row.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = neardup.cluster(docs, neardup.Config(words=5)).select(
        F.xxhash64("doc_id", "text_hash").alias("key"), "n_shingles", "stays")
    groups = cut_lineage(groups)
    out = _without(docs, groups.filter(~F.col("stays")).select("key"))
    repeats = cut_lineage(groups.filter(F.col("stays") & (F.col("n_shingles") > 0)).groupBy("key").count().filter("count > 1").select("key"))
    n = repeats.count()
    if n:
        few = F.broadcast(repeats) if n <= BROADCAST_IDS else repeats
        once = out.join(few, "key", "left_semi").groupBy("key").agg(F.first("row").alias("row"))
        out = out.join(few, "key", "left_anti").unionByName(once)
    return out.select("row.*")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.matches(_keyed(docs).select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")),
                             table(spark, sf_dir, "benchmark"))
    return _without(docs, found.select(F.col("doc_id").alias("key"))).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_quality),
    ("language", keep_language),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: Trained models and token ids are beyond SQL; tests hold the run against
#: brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the packed pieces."""
    docs = table(spark, sf_dir, "documents")
    base = work_path(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
