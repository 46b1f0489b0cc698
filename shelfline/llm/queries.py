"""The registered queries of the training-data operators: each on its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm import ann, chat, language, licenses, mixing, neardup, packing, quality, ranked, repeats, tokens, topk, whitening
from shelfline.session import scratch_path, stage

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark)
    tokens.write(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    found = tokens.read(spark, folder)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = stage(quality.describe(_table(spark, sf_dir, "documents")), "described")
    return quality.score(described, quality.fit(described, _table(spark, sf_dir, "labels")))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(_table(spark, sf_dir, "conversations"))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer, end_id=1, with_ids=False)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    marks = language.landmarks(documents)
    described = stage(language.describe(documents, marks), "kernels")
    return language.predict(described, language.fit(described, marks))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def build() -> dict[str, Query]:
    return {name: fn for name, fn in globals().items() if name.startswith("op")}


_ORACLES: dict[str, str] = {"op2_top_k": topk.SQL, "op4_chat": chat.SQL, "op9_mix_sources": mixing.SQL, "op11_ranked_search": ranked.SQL}


def oracle() -> dict[str, str]:
    return dict(_ORACLES)
