"""Corpus pipeline: quality rules, near-duplicates, decontamination, mixing, token output.

Each stage takes the documents that the one before it kept and returns documents; the last one returns what its token
files hold. Null ids are kept by all stages; stages that decide by document decide alike for repeated rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.config import materialize, shared_dir
from vigilframe.llm.common import BROADCAST_ROWS, may_match, small_side
from vigilframe.llm.curriculum import mix
from vigilframe.llm.decontaminate import contamination
from vigilframe.llm.neardup import near_duplicates
from vigilframe.llm.quality import quality
from vigilframe.llm.tokens import token_output
from vigilframe.session import ship

# Equality of token files cannot be stated in SQL.
ORACLE_SQL = None


def _drop(docs: DataFrame, key: Column, gone: DataFrame, gone_key: Column, same: Column) -> DataFrame:
    """Rows of ``docs`` (d) that are the ``same`` as none of the (materialised) ``gone`` (r).

    Where these are too many to be broadcast, rows whose key none of them has stay where they lie; only the rest is moved.
    """
    without = lambda d: d.alias("d").join(small_side(gone).alias("r"), same, "left_anti")
    if gone.count() <= BROADCAST_ROWS:
        return without(docs)
    marked = may_match(docs, key, gone, gone_key)
    return marked.where("not __may").drop("__may").unionByName(without(marked.where("__may").drop("__may")))


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows whose (doc_id, text_hash) is not among the rejected ones."""
    rejected = materialize(rejected.select("doc_id", "text_hash").distinct(), "rejected")
    same = F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.xxhash64("d.text") == F.col("r.text_hash"))
    return _drop(docs, F.struct(F.col("doc_id"), F.xxhash64("text")), rejected, F.struct("doc_id", "text_hash"), same)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the outlier test rejects."""
    ship(spark)
    return _without(docs, quality(docs).where("not kept"))


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that of the smallest id, and of rows that repeat an id the smallest one."""
    ship(spark)
    gone = materialize(near_duplicates(docs).where("not kept").select("doc_id").distinct(), "gone")
    left = _drop(docs, F.col("doc_id"), gone, F.col("doc_id"), F.col("d.doc_id") == F.col("r.doc_id")).select(docs.columns)
    repeated = left.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    repeated = small_side(materialize(repeated, "repeated"))
    once = left.join(repeated, "doc_id", "left_anti")
    rest = [c for c in docs.columns if c != "doc_id"]
    many = left.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("r"))
    return once.unionByName(many.select("doc_id", "r.*")).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    ship(spark)
    return _without(docs, contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix reads at least half of their words; texts stay whole."""
    ship(spark)
    times = F.round(F.try_divide("taken", "size")).cast("int")
    reads = mix(docs).where("taken > 0").groupBy("doc_id", "source", "text_hash").agg(F.max(times).alias("n")).where("n > 0")
    reads = materialize(reads, "reads")
    same = (
        F.col("d.doc_id").eqNullSafe(F.col("m.doc_id"))
        & F.col("d.source").eqNullSafe(F.col("m.source"))
        & (F.xxhash64("d.text") == F.col("m.text_hash"))
    )
    kept = docs.alias("d").join(small_side(reads).alias("m"), same)
    return kept.select("d.*", F.explode(F.sequence(F.lit(1), F.col("m.n"))).alias("__copy")).drop("__copy")


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the token files of the mix hold."""
    ship(spark)
    return token_output(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicate_groups),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token output", token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table; each stage's documents are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, name.replace(" ", "-")) + uuid.uuid4().hex[:4]
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
