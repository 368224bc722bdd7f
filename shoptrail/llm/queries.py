"""The operators as queries over the tables of a folder, with their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoptrail.llm import (
    lexical,
    licenses,
    mixing,
    mtree,
    near_vectors,
    packing,
    phrases,
    prepare,
    quality,
    sharding,
    simhash,
    substrings,
    toxicity,
    warc,
)
from shoptrail.session import configure, new_folder

TOKENIZER = "word_bpe_49k.json"
SHARDS = 40


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(configure(spark)).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def op2_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mtree.search_embeddings(_table(spark, sf_dir, "embeddings"))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    found = sharding.shard(docs, [1.0] * SHARDS, tie=("text_crc32", "size"))
    return found.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        "slot",
        sharding.rendezvous(F.col("doc_id"), [1.0] * (SHARDS + 1)).alias("grown_shard"),
    )


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    base = F.filter("places", lambda x: x["base"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["word"])).alias("last_word"),
        F.array_join(
            F.array_sort(F.array_distinct(F.transform(base, lambda x: x["label"]))), ","
        ).alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    path = new_folder(spark, "archive")
    warc.write_archive(pages, path)
    return warc.read_archive(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeated(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.ledger(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~quality.passes(quality.BASE)).alias("base_failed"),
        quality.passes(quality.LATEST).alias("kept"),
    )


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrases.collocations(_table(spark, sf_dir, "documents"))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_mtree": op2_mtree,
    "op3_mixing": op3_mixing,
    "op4_sharding": op4_sharding,
    "op5_licenses": op5_licenses,
    "op6_warc": op6_warc,
    "op7_near_vectors": op7_near_vectors,
    "op8_toxicity": op8_toxicity,
    "op9_packing": op9_packing,
    "op10_substrings": op10_substrings,
    "op11_quality": op11_quality,
    "op12_phrases": op12_phrases,
    "op13_lexical": op13_lexical,
}
