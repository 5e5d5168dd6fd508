"""The queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm import quality
from engram.llm.chat import link_tool_calls
from engram.llm.decontaminate import find_leaks
from engram.llm.embedding import near_vectors
from engram.llm.jaccard import similar_documents
from engram.llm.langid import held_out, identify, train
from engram.llm.merkle import lowered, merkle_manifest
from engram.llm.mixing import mix_sources
from engram.llm.oracles import ORACLE_SQL
from engram.llm.shared import shared_dir
from engram.llm.sharding import ShardStore
from engram.llm.suffix import dedup_substrings
from engram.llm.urlfilter import judge_urls
from engram.llm.warc import FIRST_PAGE, PAGE, archive_pages, read_warc
from engram.llm.whitening import whiten

#: The rules of op1, fixed by its contract.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
#: The tools of op4's calls.
TOOLS = {
    "search": {"properties": {"query": {"type": "string"}, "top": {"type": "integer"}}, "required": ["query", "top"], "additionalProperties": False},
    "lookup": {"properties": {"id": {"type": "integer"}, "strict": {"type": "boolean"}}, "required": ["id", "strict"], "additionalProperties": False},
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages take the toxic label of the document with their number as the label of a bad page."""
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("bad"))
    return judge_urls(_table(spark, sf_dir, "pages"), labels, RULES)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken"))


def tool_messages(turns: DataFrame) -> DataFrame:
    """The conversations as an exchange with tools: each assistant turn makes a call, each user turn answers the turn before.

    A call needs the result of the one two turns before, so that a conversation is a chain as long as it is. Every third call looks up by number and the others search; in every fifth lookup the number is a string, against its schema.
    """
    is_call, is_result = F.col("role") == "assistant", (F.col("role") == "user") & (F.col("turn") > 0)
    lookup = F.col("turn") % 3 == 0
    ident = F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit('"'), F.col("conv_id"), F.lit('"'))).otherwise(F.col("conv_id").cast("string"))
    args = F.when(lookup, F.concat(F.lit('{"strict": true, "id": '), ident, F.lit("}"))).otherwise(F.concat(F.lit('{"top": '), F.col("turn"), F.lit(', "query": "conversation '), F.col("conv_id"), F.lit('"}')))
    call_id = lambda turn: F.concat(F.lit("call-"), F.col("conv_id"), F.lit("-"), turn)
    return turns.select(
        "conv_id", "turn", "role", F.col("text").alias("content"), F.when(is_call, call_id(F.col("turn"))).alias("call_id"),
        F.when(is_call, F.when(lookup, "lookup").otherwise("search")).alias("call_name"), F.when(is_call, args).alias("call_args"), F.when(is_result, call_id(F.col("turn") - 1)).alias("result_of"),
        F.when(is_call, F.array(call_id(F.col("turn") - 2))).alias("needs"),
    )


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = link_tool_calls(tool_messages(_table(spark, sf_dir, "conversations")), TOOLS)
    return linked.select("conv_id", "turn", "role", "link", F.col("depth").cast("long").alias("depth"), "valid", F.array_join("errors", "; ").alias("errors"), "message_json")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four arrivals of documents, appended and compacted, then read back by the manifest."""
    store = ShardStore(spark, shared_dir(spark, "shards"))
    docs = _table(spark, sf_dir, "documents")
    for k in range(store.fan_in):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(store.fan_in)) == k))
        store.compact()
    store.vacuum()
    return store.read().select("doc_id", "lang", "source", F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("text_md5"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("leak_items") > 0).alias("contaminated"), "leak_items", F.array_min("leaks.edits").alias("least_edits"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()).select("text", "lang"))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), F.col("lid_lang").alias("lang_pred"), F.col("lid_score").alias("score"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(_table(spark, sf_dir, "documents")).drop("spans")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses are read with their payloads; revisits by a pushed record type, without inflating any payload."""
    path = archive_pages(_table(spark, sf_dir, "pages"))
    responses = read_warc(spark, path).where("record_type = 'response'")
    revisits = read_warc(spark, path, payloads=False).where("record_type = 'revisit'")
    number = lambda name: F.col("headers")[name].try_cast("long")
    row = lambda df, size, digest: df.select(number(PAGE).alias("page_id"), size.cast("long").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", number(FIRST_PAGE).alias("refers_to"))
    return row(responses, F.octet_length("payload"), F.sha2("payload", 256)).unionByName(row(revisits, F.col("payload_bytes"), F.substring_index("payload_digest", ":", -1)))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    weights = quality.train(docs, labels.where(~quality.held_out()))
    found = quality.score(docs.select("doc_id", "text"), weights)
    return found.select("doc_id", quality.held_out().alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the documents, by the remainder of a checksum of their ids, are verified with their text in lower case."""
    return merkle_manifest(_table(spark, sf_dir, "documents"), F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, lowered(F.col("text"))))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_jaccard_join, op3_mixing, op4_chat_formatting, op5_embedding_dedup, op6_sharding, op7_decontamination, op8_language_id, op9_suffix_dedup, op10_warc, op11_quality_classifier, op12_embedding_whitening, op13_merkle_manifest)}
__all__ = ["ORACLE_SQL", "QUERIES"]
