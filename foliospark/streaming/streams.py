"""Run logs and inputs as streams. Every function takes and gives streaming DataFrames, and works on batches alike."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliospark.operators.scan import running, tiles

# --- fixed values: timed stages of a page
STAGES = ("total_ms", "detect_ms", "layout_ms", "recog_ms", "table_ms", "read_ms", "parse_ms", "page_llm_ms")
TIMING_SCHEMA = "file string, ts timestamp, pages array<struct<page:bigint, " + ", ".join(f"{s}:bigint" for s in STAGES) + ">>"


def explode_timings(logs: DataFrame) -> DataFrame:
    """file, ts, page, stage, ms: one row per timed stage of a page."""
    pages = logs.select("file", "ts", F.explode("pages").alias("p"))
    pairs = F.array(*(F.struct(F.lit(s).alias("stage"), F.col(f"p.{s}").alias("ms")) for s in STAGES))
    rows = pages.select("file", "ts", F.col("p.page").alias("page"), F.explode(pairs).alias("x")).select("file", "ts", "page", "x.*")
    return rows.filter(F.col("ms").isNotNull())


def stream_page_timings(spark: SparkSession, path: str) -> DataFrame:
    """Tails a folder of timing logs."""
    return explode_timings(spark.readStream.schema(TIMING_SCHEMA).json(path))


def stream_stage_latency(timings: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """p50 and p95 per stage and tumbling window; rows later than `late` are dropped."""
    rows = timings.withWatermark("ts", late) if timings.isStreaming else timings
    return rows.groupBy(F.window("ts", window), "stage").agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("ms", 0.5, 10000).alias("p50"), F.percentile_approx("ms", 0.95, 10000).alias("p95"),
    ).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "stage", "n", "p50", "p95")


def _sides(begins: DataFrame, ends: DataFrame, bound: str, late: str):
    b = begins.select("run_id", "index", F.col("ts").alias("begin_ts"))
    e = ends.select(F.col("run_id").alias("e_run"), F.col("index").alias("e_index"), F.col("ts").alias("end_ts"))
    if b.isStreaming:
        b, e = b.withWatermark("begin_ts", late), e.withWatermark("end_ts", late)
    on = (
        (F.col("run_id") == F.col("e_run")) & (F.col("index") == F.col("e_index")) & (F.col("end_ts") >= F.col("begin_ts"))
        & (F.col("end_ts") <= F.col("begin_ts") + F.expr(f"interval {bound}"))
    )
    return b, e, on


def stream_run_pairs(begins: DataFrame, ends: DataFrame, bound: str, late: str) -> DataFrame:
    """run_id, index, latency_s of units whose end follows their begin within `bound`."""
    b, e, on = _sides(begins, ends, bound, late)
    micros = F.unix_micros("end_ts") - F.unix_micros("begin_ts")
    return b.join(e, on, "inner").select("run_id", "index", (micros / 1e6).alias("latency_s"))


def stream_unfinished(begins: DataFrame, ends: DataFrame, bound: str, late: str) -> DataFrame:
    """Units without an end within `bound`: failed or hung. A stream gives them once the watermark has passed the bound."""
    b, e, on = _sides(begins, ends, bound, late)
    return b.join(e, on, "left_outer").filter(F.col("e_run").isNull()).select("run_id", "index", "begin_ts")


def stream_dedup_inputs(inputs: DataFrame, late: str) -> DataFrame:
    """Each content (sha256) once within the watermark."""
    if not inputs.isStreaming:
        return inputs.dropDuplicates(["sha256"])
    return inputs.withWatermark("ts", late).dropDuplicatesWithinWatermark(["sha256"])


def stream_running_best(evals: DataFrame, by: str = "trial") -> DataFrame:
    """Lowest error per run with its step. In update mode a row comes out whenever a batch changed it."""
    best = F.min_by(F.struct("step", "cer"), F.struct("cer", "step"))
    return evals.groupBy(by).agg(best.alias("b")).select(by, "b.step", "b.cer")


def stream_improvements(evals: DataFrame, by: str = "trial") -> DataFrame:
    """by, step, cer of the evaluations that lower the error of their run, in the order of steps; a null error never does.

    A stream keeps each run's lowest error as state, so a row comes out once, in the batch that brings it, and only if no row before was as
    low; a batch of several steps gives each improvement among them. Equal to the batch result as long as steps arrive in order.
    """
    rows = evals.where("cer IS NOT NULL").select(by, "step", F.col("cer").cast("double").alias("cer"))
    if not evals.isStreaming:
        before = running(rows, [by], ["step", "cer"], tiles(F.col("step"), 1024), {"_before": ("min_before", F.col("cer"))})
        return before.where("_before IS NULL OR cer < _before").drop("_before")

    def better(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get[0] if state.exists else np.inf
        new = pd.concat(list(parts)).sort_values(["step", "cer"])
        upto = np.minimum.accumulate(np.concatenate([[best], new["cer"].to_numpy()]))
        state.update((float(upto[-1]),))
        yield new[new["cer"].to_numpy() < upto[:-1]]

    return rows.groupBy(by).applyInPandasWithState(better, rows.schema, "best double", "append", GroupStateTimeout.NoTimeout)


def run_name(checkpoint: str) -> str:
    """Name of all runs from one checkpoint; batch numbers begin again with another one."""
    return hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]


def to_parquet(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs a stream over what is there now into a parquet folder. Batches are replaced by run and number, so a repeated batch
    leaves no second copy and another run from a new checkpoint adds to what is there."""
    run = run_name(checkpoint)

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/run={run}/batch={number}")

    return (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(save).start())


#: Buckets of documents in which added tables are stored, and documents of a batch that are looked up by value.
BUCKETS, FEW_DOCS = 64, 1000


def added_keys(batch: DataFrame, target: str, doc: str, table: str) -> DataFrame:
    """doc, table, run, batch of the tables in the target whose document may be among those of the batch.

    Only keys are read, and only in the buckets that the batch's documents fall into; a few documents are also looked up by value, which
    skips row groups, as buckets are stored in the order of documents.
    """
    spark = batch.sparkSession
    schema = T.StructType([batch.schema[doc], batch.schema[table], T.StructField("run", T.StringType()),
                           T.StructField("batch", T.LongType()), T.StructField("bucket", T.LongType())])
    keys = spark.read.schema(schema).option("basePath", target).parquet(target)
    keys = keys.where(F.col("bucket").isin([r[0] for r in batch.select(bucket_of(doc)).distinct().collect()]))
    docs = [r[0] for r in batch.where(F.col(doc).isNotNull()).select(doc).distinct().limit(FEW_DOCS + 1).collect()]
    return (keys if len(docs) > FEW_DOCS else keys.where(F.col(doc).isin(docs))).drop("bucket")


def bucket_of(doc: str) -> Column:
    return F.pmod(F.xxhash64(F.col(doc)), F.lit(BUCKETS)).alias("bucket")


def incremental_ground_truth(stream: DataFrame, target: str, checkpoint: str, doc: str = "doc_id", table: str = "table_idx") -> StreamingQuery:
    """Adds tables of documents that no earlier run has added; in this run a document may come in several batches.

    A repeated batch or run adds nothing. Runs are told apart by their checkpoint. A batch looks only for its own documents in the target.
    """
    run = run_name(checkpoint)

    def add(batch: DataFrame, number: int) -> None:
        from foliospark.operators.render import silver_tables
        from foliospark.sources.readers import path_exists

        if path_exists(batch.sparkSession, target):
            old = added_keys(batch, target, doc, table).where((F.col("run") != run) | (F.col("batch") != number))
            before, now = old.where(F.col("run") != run), old.where(F.col("run") == run)
            batch = batch.join(now.select(doc, table).distinct(), [doc, table], "left_anti")
        else:
            before = batch.limit(0)
        fresh = silver_tables(batch, before.select(doc), doc=doc).withColumn("bucket", bucket_of(doc))
        # a bucket is as few files as its size allows; adaptive execution splits that of a large document
        files = fresh.hint("rebalance", "bucket").sortWithinPartitions("bucket", doc)
        files.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/run={run}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(add).start()
