"""Corpus pipeline: language, near copies, benchmark leaks, mixture, shards - one operator after another.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return the columns of
documents. run() writes each stage's rows as Parquet below the shared checkpoint folder and reads them again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.llm import decontaminate, jaccard_join, language_id, mixing, sharding
from catalith.llm.common import doc_key, ensure_checkpoint_dir


#: Names of our own beside any columns of documents.
DID, TH = "__pipeline_did", "__pipeline_th"
#: A document goes if the network gives its best language less than this; clean held-out documents reach far more.
LEAST_SCORE = 0.35


def keys(docs: DataFrame) -> list:
    """doc_key under names that clash with no column."""
    return [c.alias(n) for c, n in zip(doc_key(docs), (DID, TH), strict=True)]


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose language can't be told: null texts, texts without a letter, and texts for which no
    language reaches LEAST_SCORE (asked where four languages or more were learned)."""
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    least = LEAST_SCORE if len(model[1]) > 3 else 0.0
    found = language_id.predict(docs, model)
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= least)).select(*docs.columns)


def by_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the one with the smallest id, null ids last, then by a hash of the
    text. Rows that repeat id and text are one document. Texts without words have no copies and stay."""
    linked = jaccard_join.link_components(docs.select("doc_id", "text"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "did", "th")).alias("first")
    own = F.when(F.col("component").isNull(), F.struct("did", "th")).alias("own")
    kept = linked.groupBy("component", own).agg(first).select(F.col("first.did").alias(DID), F.col("first.th").alias(TH))
    keyed = docs.select("*", *keys(docs))
    many = keyed.groupBy(DID, TH).agg(F.count("*").alias("n")).where("n > 1").select(DID, TH)
    stay = keyed.join(kept, [DID, TH], "left_semi")
    # only the rows that repeat id and text move as a whole
    once = stay.join(many, [DID, TH], "left_semi").dropDuplicates([DID, TH])
    return stay.join(many, [DID, TH], "left_anti").unionByName(once).select(*docs.columns)


def by_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    leaks = decontaminate.contaminated(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = leaks.select(F.col("did").alias(DID), F.col("th").alias(TH)).distinct()
    return docs.select("*", *keys(docs)).join(leaks, [DID, TH], "left_anti").select(*docs.columns)


def by_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: taken / size, rounded half up. Equal rows are taken equally often."""
    row = F.coalesce(F.xxhash64("doc_id", "text", "source"), F.lit(0))
    keyed = docs.select("*", row.alias(DID))
    taken = mixing.mix(docs.select("doc_id", "source", "text", row.alias("row"))).where("size > 0")
    taken = taken.select(F.col("row").alias(DID), F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size"))).cast("int").alias(TH))
    taken = taken.groupBy(DID).agg(F.max(TH).alias(TH)).where(F.col(TH) > 0)
    return keyed.join(taken, DID).withColumn(TH, F.explode(F.sequence(F.lit(1), F.col(TH)))).select(*docs.columns)


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, dealt into shards."""
    return sharding.shard_rows(docs)


STAGES = [
    ("language ID", by_language),
    ("n-gram Jaccard join", by_near_copies),
    ("benchmark decontamination", by_leaks),
    ("mixing sources", by_mixture),
    ("sharding", into_shards),
]

#: The language stage is a trained network, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, one written and read again after the other."""
    ensure_checkpoint_dir(spark)
    home = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{i}")
        docs = spark.read.parquet(f"{home}/{i}")
    return docs
