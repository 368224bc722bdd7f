"""From raw documents to packed training sequences: five stages over the table ``documents``.

Every stage is written and read again before the next one, works on all rows that the one before
kept, and reads the columns of ``documents`` only. The pipeline cannot be expressed in SQL (its
first stage is a trained model), so there is no ORACLE_SQL; each stage is tested on its own input.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoptrail.llm import mixing, near_copies, packing, prepare, substrings, toxicity
from shoptrail.llm.queries import tokenizer_path
from shoptrail.session import configure, materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 stay."""
    docs = docs.select(*COLUMNS)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return model.annotate(docs).where("score < 0.5").select(*COLUMNS)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity of at least 0.8 over 5-word shingles)
    stays: that with the smallest id."""
    return near_copies.representatives(docs.select(*COLUMNS))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words that repeated windows cover; a text that nothing is cut from stays as
    it is, one that everything is cut from goes."""
    found = substrings.remove_repeated(docs, keep=COLUMNS)
    cut = F.col("n_removed") > 0
    text = F.when(cut, F.col("kept").cast("string")).otherwise(F.col("text"))
    left = found.where("NOT (n_removed > 0 AND n_removed = n_words)").withColumn("_text", text)
    n_chars = F.when(cut, F.length("_text").cast("long")).otherwise(F.col("n_chars"))
    return left.select(
        "doc_id", F.col("_text").alias("text"), "lang", "source", n_chars.alias("n_chars")
    )


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mix(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path())


def _stage(build):
    """A stage in a session prepared for it."""

    @wraps(build)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return build(prepare(spark), docs, sf_dir)

    return stage


STAGES = [
    ("toxicity", _stage(drop_toxic)),
    ("simhash", _stage(one_of_near_copies)),
    ("substrings", _stage(drop_repeated_passages)),
    ("mixing", _stage(mix_sources)),
    ("packing", _stage(pack_sequences)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of a folder."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


ORACLE_SQL = None
