"""A corpus pipeline of five stages: toxicity, line dedup, near-dedup, mixing to weights, packing.

Each stage takes ``(spark, docs, sf_dir)``, works on all documents its predecessor kept, and returns a DataFrame; ``run``
writes it as Parquet to the shared checkpoint folder and reads it again for the next one. All but the last return the
columns of ``documents``. A document whose lines all occurred earlier stays as an empty one; it takes one token in the
packing. Empty tables pass through. Null texts count as empty; a null source has the weight of an unnamed one. Rows are
judged one by one in every stage, also where ids are null or repeated.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import lines, minhash, mixing, packing, toxicity
from ridgeline.llm.queries import OTHER_WEIGHT, WEIGHTS, tokenizer
from ridgeline.session import cut_lineage, ensure_checkpoint_dir, ship

#: Word shingles of five words, similarity 0.8 or more.
PERCENT = 80
#: Keys of rows that their id does not tell apart lie from here on; ids are below.
ABOVE_IDS = 1 << 61

#: The first stage learns a model and the last reads a tokenizer's vocabulary, neither of which SQL can express.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, learned from the labels, rejects go."""
    labels = ship(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean(docs, toxicity.learn(docs, labels))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are like an earlier one go from the texts; ``n_chars`` follows."""
    out = lines.deduplicate(docs, percent=80).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def told_apart(docs: DataFrame) -> DataFrame:
    """``key, text, row``: a key for each id and text. It is the id, but where an id is null or has several texts.

    The keys of those others are hashes above all ids, those of rows without an id above all others.
    """
    digest = F.xxhash64("row.text", F.col("row.text").isNull())
    rows = docs.select(F.struct(*docs.columns).alias("row"))  # so that columns may have any name
    rows = rows.select(F.col("row.doc_id").cast("long").alias("id"), digest.alias("digest"), "row")
    several = rows.where("id is not null").groupBy("id").agg(F.min("digest").alias("own"), F.max("digest").alias("other")).where("own <> other")
    several = cut_lineage(several.select(F.col("id").alias("shared"), "own"))
    if several.isEmpty():
        rows = rows.withColumn("own", F.lit(None).cast("long"))
    else:
        rows = rows.join(several, F.col("id") == F.col("shared"), "left")
    hashed = F.xxhash64("id", "digest").bitwiseAND(F.lit(ABOVE_IDS // 2 - 1))
    above = F.lit(ABOVE_IDS) + F.when(F.col("id").isNull(), F.lit(ABOVE_IDS // 2)).otherwise(F.lit(0)) + hashed
    key = F.when(F.col("id").isNull() | (F.col("own") != F.col("digest")), above).otherwise(F.col("id"))
    return rows.select(key.alias("key"), F.col("row.text").alias("text"), "row")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays, one of the smallest id.

    Rows without an id, and rows that share one but not the text, are compared as documents of their own; of rows with
    equal id and text, however their other columns differ, one stays.
    """
    rows = told_apart(docs)
    stays = minhash.deduplicate(rows, percent=PERCENT, id_col="key").where("kept").select("doc_id").distinct()
    left = rows.join(cut_lineage(stays), F.col("key") == F.col("doc_id"), "left_semi")
    often = cut_lineage(rows.groupBy("key").count().where("count > 1").select(F.col("key").alias("often")))
    if not often.isEmpty():
        again = left.join(often, F.col("key") == F.col("often"), "left_semi").groupBy("key").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        left = left.join(often, F.col("key") == F.col("often"), "left_anti").select("key", "row").unionByName(again)
    return left.select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources have their target weights, in a global random order."""
    return mixing.mix(docs, WEIGHTS, OTHER_WEIGHT).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their place in sequences of at most 2,048 tokens."""
    ship(spark)
    return packing.pack(docs, tokenizer(), capacity=2048)


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("near dedup", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(ship(spark))
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
