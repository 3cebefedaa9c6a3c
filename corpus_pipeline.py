"""Corpus pipeline: quality rules, language identification, near-duplicate
removal, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result to the shared folder and reads it again as the next stage's docs.
The filtering stages return all columns of the documents they keep.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm import langid, minhash, packing, quality
from platewise.llm.store import Scratch, without

#: near_dedup links documents at this percentage (op6's contract has its own, 85)
PERCENT = 80
#: a pair at 0.80 shares no band with probability (1 - 0.8^5)^40 = 1e-7
BANDS, ROWS = 40, 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fences of their language and source."""
    return quality.judge(docs, docs.columns).where("kept").select("row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one recognised language (texts without letters and ambiguous ones go)."""
    said = langid.identify(docs, docs.columns)
    return said.where(~F.col("ambiguous") & (F.col("lang_pred") != langid.UNKNOWN)).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (0.80 or more): the one with the smallest doc_id.

    Every row is a document of its own: unlike texts with one doc_id are both
    judged, rows without doc_id come after those with one, and among equal ids
    digests decide.  Of equal rows one stays.
    """
    scratch = Scratch(spark, "near-dedup")
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"),
                   F.xxhash64(*(x for c in docs.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`")))).alias("row"))
    keyed = docs.withColumn("__key", key)
    again = scratch.write(keyed.groupBy("__key").count().where("count > 1").select("__key"), "again")
    if not again.isEmpty():
        once = keyed.join(again, "__key", "left_semi").dropDuplicates(["__key"])
        keyed = scratch.write(keyed.join(again, "__key", "left_anti").unionByName(once), "once")
    found = minhash.near_duplicates(keyed.select(F.col("__key").alias("doc_id"), "text"), percent=PERCENT, bands=BANDS, rows=ROWS)
    removed = scratch.write(found.where(~F.col("kept")).select(F.col("doc_id").alias("__key")), "removed")
    return without(keyed, removed, "__key", minhash.FEW_SETS).drop("__key")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents and their places in sequences."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        pieces = packing.cut_documents(docs, f.read())
    return packing.pack_pieces(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("best_fit_packing", best_fit_packing),
]
#: language identification has no SQL form; the tests compare every stage with a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
