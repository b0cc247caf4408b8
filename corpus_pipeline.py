"""A corpus pipeline of five operators, each stage a function ``(spark, docs, sf_dir) -> DataFrame``.

Stages keep the columns of ``documents``; the last adds the shard.  ``run`` writes every stage as
Parquet to the cluster's shared folder and rereads it, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from harmonia.llm import decontaminate, minhash, mixing, sharding, toxicity
from harmonia.llm._store import discard, stash

SHARDS = 24
#: The mixture takes this share of the tokens that reach it, at most once each.
MIX_SHARE = 0.9


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores at 0.3 or more go.

    Null and blank texts get the score of a text without sentences and stay unless nearly all labels are toxic;
    without labels of both classes every score is their share.  Repeated rows share their fate; an empty table
    stays empty; all columns, whatever their names, pass through."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (similarity 0.8) stays, that of the smallest id.

    Null and blank texts are no one's duplicate; rows of null id stay; a row that repeats id and text stays once; an
    id with two texts loses neither unless it is a copy.  An empty table stays empty, other columns pass through."""
    return minhash.drop_near_duplicates(docs, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or a re-parameterised one, go.

    Null and blank texts hold nothing; without items all rows stay; repeated rows share their fate; an empty
    table stays empty, other columns pass through."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources that hold more than their weight give up what the budget leaves out.

    A null language or source is a branch of its own; a branch without any words stays whole; equal rows (id and
    text) have one place in the order; an empty table stays empty, other columns pass through."""
    return mixing.keep_mixture(docs, domain_of(docs["source"]), share=MIX_SHARE)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its shard: an int column ``shard``, in place of one that is there already.

    Equal texts share a shard, null texts go with empty ones, and no row is lost; an empty table stays empty."""
    return sharding.with_shard(docs, SHARDS)


def domain_of(source):
    """Four domains by a hash of the source's name; a null source is a domain of its own."""
    return F.concat(F.lit("domain"), F.pmod(F.crc32(source.cast("binary")), F.lit(4)))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", cut_shards),
]

#: Kernel scores, sketches and hash orders are not SQL: tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before, docs = docs, stash(stage(spark, docs, sf_dir))
        discard(before)
    return docs
