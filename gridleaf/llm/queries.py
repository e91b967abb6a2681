"""Registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, counttree, langid, lempel, licences, mixing, packing, phrases, prefixes, rules, simhash, toxicity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(work: Query) -> Query:
    QUERIES[work.__name__] = work
    return work


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op6_rule_ledger(spark, d):
    out = rules.rule_ledger(table(spark, d, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


@query
def op6_rule_ablations(spark, d):
    return rules.ablations(rules.ledger(table(spark, d, "documents")))


@query
def op4_vector_packing(spark, d):
    return packing.pack_documents(table(spark, d, "documents"), tokenizer())


@query
def op1_simhash_trees(spark, d):
    found = simhash.near_duplicates(table(spark, d, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op5_centroid_language(spark, d):
    return langid.identify(table(spark, d, "documents")).select("doc_id", "held_out", "lang_pred", "score", "accepted")


@query
def op9_pivotal_mix(spark, d):
    out = mixing.mix(table(spark, d, "documents"), [3, 1, 2], 1.5, 2.0)
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies", "part")


@query
def op3_lempel_ziv_spans(spark, d):
    return lempel.deduplicated(table(spark, d, "documents"))


@query
def op3_lempel_ziv_factors(spark, d):
    return lempel.parsed(table(spark, d, "documents"))


@query
def op2_prefix_fingerprints(spark, d):
    return prefixes.fingerprinted(table(spark, d, "documents"))


@query
def op10_toxic_neighbours(spark, d):
    out = toxicity.scored(table(spark, d, "documents"), table(spark, d, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", "evidence")


@query
def op7_chat_templates(spark, d):
    odd = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), odd.alias("text"))
    return chat.digests(table(spark, d, "conversations").select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text").unionByName(extra))


@query
def op8_license_scan(spark, d):
    return licences.scan(table(spark, d, "documents"))


@query
def op8_short_notices(spark, d):
    return licences.scan(table(spark, d, "documents"), licences.SHORT)


@query
def op11_aligned_tokens(spark, d):
    import public_tokenizers

    return alignment.alignments(table(spark, d, "documents"), *map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model")))


@query
def op12_count_rtree(spark, d):
    return counttree.jaccard_components(table(spark, d, "documents"))


@query
def op13_rabin_karp_phrases(spark, d):
    return phrases.collocations(table(spark, d, "documents")).drop("first")
