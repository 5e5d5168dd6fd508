"""The pipeline over documents: stages that each call one operator of engram.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.decontaminate import find_leaks
from engram.llm.jaccard import similar_documents
from engram.llm.langid import held_out, identify, train
from engram.llm.mixing import mix_sources
from engram.llm.shared import shared_dir
from engram.llm.sharding import ShardStore

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Share of a text's letters that its main language has at least.
LEAST_SHARE = 0.5
#: Bytes of the batches that go to Python workers, a few of which are held on both sides.
BATCH_BYTES = 4 << 20


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a main language. Those without letters, or with no language for half of the letters, go."""
    _small_batches(spark)
    model = train(docs.where(~held_out()).select("text", "lang"))
    return identify(docs.select(*COLUMNS), model).where((F.col("lid_lang") != "und") & (F.col("lid_score") >= LEAST_SHARE)).select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id; documents without an id or words stay."""
    _small_batches(spark)
    found = similar_documents(docs.select("doc_id", "text"))
    copies = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a part of a benchmark item."""
    _small_batches(spark)
    found = find_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("leak_items") == 0).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    mixed = mix_sources(docs).where("mix_copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int")))).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, as read back from the committed shards."""
    store = ShardStore(spark, shared_dir(spark, "corpus"))
    for k in range(store.fan_in):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(store.fan_in)) == k))
        store.compact()
    store.vacuum()
    return store.read()


STAGES = [("language ID", language), ("n-gram Jaccard join", deduplicate), ("benchmark decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]
#: SQL has no language model, no alignment and no components of near copies: the tests use a version by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each one's result written as Parquet and read as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = shared_dir(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
