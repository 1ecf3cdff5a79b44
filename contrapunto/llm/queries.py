"""One query per operator, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrapunto.llm import align, bpe, chat, decontaminate, licenses, mix, multiset, pii, quality, simhash, substrings, toxicity, whiten
from contrapunto.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer() -> tuple[str, str]:
    """Place and pattern of the multilingual byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def tokenizer_pair() -> tuple[str, str, str]:
    """Places of the byte-level vocabulary (with its pattern) and of the piece vocabulary that are aligned."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")


@query
def op1_bpe_round_trip(spark, folder):
    return bpe.round_trip(table(spark, folder, "documents"), *tokenizer())


@query
def op7_multiset_fingerprints(spark, folder):
    return multiset.against_next(table(spark, folder, "documents"))


@query
def op9_simhash_groups(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query
def op10_repeated_substrings(spark, folder):
    return substrings.digests(table(spark, folder, "documents"))


@query
def op8_toxicity(spark, folder):
    return toxicity.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op6_benchmark_leaks(spark, folder):
    return decontaminate.contaminations(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op3_pseudonyms(spark, folder):
    return pii.pseudonymised(table(spark, folder, "documents").select("doc_id", "text"), count="n_changed")


@query
def op2_chat_format(spark, folder):
    same = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(same).alias("text"))
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_back(chat.formatted(turns, *tokenizer()), *tokenizer())


@query
def op4_license_scan(spark, folder):
    return licenses.scan(table(spark, folder, "documents"))


@query
def op5_quality(spark, folder):
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op11_embedding_whitening(spark, folder):
    return whiten.whitened(table(spark, folder, "embeddings"))


@query
def op12_source_mix(spark, folder):
    return mix.taken(table(spark, folder, "documents"))


@query
def op13_token_alignment(spark, folder):
    return align.alignment(table(spark, folder, "documents"), *tokenizer_pair())
