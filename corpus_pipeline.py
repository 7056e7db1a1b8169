"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import contamination, exact, language, mixing, simhash
from foliospark.llm.common import dropped, id_remainder, stored
from foliospark.session import scratch_path

#: Row keys that are broadcast at most (about 20 MB); more are joined by a shuffle.
BROADCAST_IDS = 100_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a column that tells their rows apart, ids may be null or repeated, and that column's name.

    Rows read from files have the file's path and their place in it, which every read finds again. Other rows are stored with numbers.
    """
    name = "_row"
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    try:
        return docs.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias(name)), name
    except AnalysisException:
        return stored(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def without(docs: DataFrame, gone: DataFrame, row: str) -> DataFrame:
    """The documents whose row key isn't among those of `gone`. Up to BROADCAST_IDS keys are sent to where the texts are."""
    gone = stored(gone, "gone")
    small = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if small else gone, row, "left_anti").drop(row)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model rejects go: texts without letters (null ones too), or too unlike all languages it knows."""
    model = language.train(docs, id_remainder("doc_id", 4) != 2)
    return language.accepted(docs, model)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact.drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked fingerprints exactly one row stays: that with the smallest id (null is the largest), of equal ids the first row."""
    docs, row = keyed(docs)
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("row"))
    groups = simhash.near_duplicates(docs.select(key.alias("key"), "text"), "key")
    gone = groups.where(F.col("doc_id.row") != F.col("component_id.row")).select(F.col("doc_id.row").alias(row))
    return without(docs, gone, row)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which benchmark windows cover a twentieth of the words or more go; others of the same id stay."""
    docs, row = keyed(docs)
    found = contamination.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), row)
    gone = found.where(contamination.contaminated()).select(F.col("doc_id").alias(row))
    return without(docs, gone, row)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str, shards: str | None = None) -> DataFrame:
    """The output shards are written to `shards` (or to the scratch folder); gives sizes, targets and the words they take of each document."""
    return mixing.mix(docs, path=shards)


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix_sources),
]

#: No SQL: language, fingerprints and permutations can't be expressed there. tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, shards: str | None = None) -> DataFrame:
    """All stages over documents; each one's result is stored before the next reads it, and goes when that one's is stored.
    The mix is written to `shards`."""
    docs, old = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
        if old is not None:
            dropped(spark, old)
        old = path
    return mix_sources(spark, docs, sf_dir, shards)
