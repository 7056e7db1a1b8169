"""Queries over streams: each runs over what is there, and gives what the final watermark has closed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from foliospark.operators import windows as w
from foliospark.plans.fixtures import Tables, sql
from foliospark.plans.page_queries import RUN_LOG
from foliospark.plans.registry import query
from foliospark.session import scratch_path
from foliospark.streaming import streams as st


def finish(tb: Tables, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs the stream into a new folder and reads it."""
    path = scratch_path(tb.spark, "stream")
    run = st.to_parquet(stream, path, scratch_path(tb.spark, "stream-state"), mode)
    run.awaitTermination()
    return tb.spark.read.schema(stream.schema).parquet(path).select(*stream.columns)


def stream_of(tb: Tables, df: DataFrame) -> DataFrame:
    """A batch frame written to a new folder and opened as a stream."""
    path = scratch_path(tb.spark, "stream-input")
    df.write.parquet(path)
    return tb.spark.readStream.schema(df.schema).parquet(path)


@query("stream_page_timings", sql("""
    SELECT CAST(run_id AS VARCHAR) AS file, event_id AS page, 'detect_ms' AS stage, ms FROM run_events
    UNION ALL SELECT CAST(run_id AS VARCHAR), event_id, 'total_ms', 2 * ms FROM run_events""", "run_events"))
def stream_page_timings(tb: Tables):
    path = scratch_path(tb.spark, "timings")
    none = [F.lit(None).cast("bigint").alias(s) for s in st.STAGES[2:]]
    page = F.struct(F.col("event_id").alias("page"), (2 * F.col("ms")).alias("total_ms"), F.col("ms").alias("detect_ms"), *none)
    tb.run_events.select(F.col("run_id").cast("string").alias("file"), "ts", F.array(page).alias("pages")).write.json(path)
    return finish(tb, st.stream_page_timings(tb.spark, path)).select("file", "page", "stage", "ms")


@query("stream_stage_latency", sql("""
    SELECT strftime(s, '%Y-%m-%d %H') AS start, stage, n, l[CAST(ceil(0.5 * n) AS BIGINT)] AS p50, l[CAST(ceil(CAST(0.95 AS DOUBLE) * n) AS BIGINT)] AS p95 FROM (
      SELECT date_trunc('day', ts) AS s, stage, count(*) AS n, list(ms ORDER BY ms) AS l FROM run_events GROUP BY ALL)
    WHERE s + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM run_events)""", "run_events"))
def stream_stage_latency(tb: Tables):
    out = finish(tb, st.stream_stage_latency(stream_of(tb, tb.run_events), "1 day", "1 hour"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "stage", "n", "p50", "p95")


def log_streams(tb: Tables):
    log = stream_of(tb, w.run_log(tb.run_events))
    return log.filter("event = 'begin'"), log.filter("event = 'end'")


@query("stream_run_pairs", sql("""
    SELECT b.run_id, (b.k + 1) // 2 AS index, (epoch_us(e.ts) - epoch_us(b.ts)) / 1e6 AS latency_s
    FROM log b JOIN log e ON e.run_id = b.run_id AND e.k = b.k + 1 AND e.ts <= b.ts + INTERVAL 6 HOUR WHERE b.k % 2 = 1""", "run_events", log=RUN_LOG))
def stream_run_pairs(tb: Tables):
    begins, ends = log_streams(tb)
    return finish(tb, st.stream_run_pairs(begins, ends, "6 hours", "1 hour"))


@query("stream_unfinished", sql("""
    SELECT b.run_id, (b.k + 1) // 2 AS index FROM log b LEFT JOIN log e ON e.run_id = b.run_id AND e.k = b.k + 1 AND e.ts <= b.ts + INTERVAL 6 HOUR
    WHERE b.k % 2 = 1 AND e.k IS NULL AND b.ts + INTERVAL 6 HOUR < (SELECT least(max(ts) FILTER (WHERE k % 2 = 1), max(ts) FILTER (WHERE k % 2 = 0)) - INTERVAL 1 HOUR FROM log)""",
    "run_events", log=RUN_LOG))
def stream_unfinished(tb: Tables):
    begins, ends = log_streams(tb)
    return finish(tb, st.stream_unfinished(begins, ends, "6 hours", "1 hour")).select("run_id", "index")


@query("stream_dedup_inputs", "SELECT DISTINCT sha256(text) AS sha256 FROM documents")
def stream_dedup_inputs(tb: Tables):
    docs = tb.read("documents").select(F.sha2("text", 256).alias("sha256"), F.timestamp_seconds(1_700_000_000 + F.col("doc_id") * 60).alias("ts"))
    return finish(tb, st.stream_dedup_inputs(stream_of(tb, docs), "1 hour")).select("sha256")


@query("stream_running_best", sql("SELECT trial, arg_min(step, (cer, step)) AS step, min(cer) AS cer FROM evals GROUP BY trial", "evals"))
def stream_running_best(tb: Tables):
    out = finish(tb, st.stream_running_best(stream_of(tb, tb.evals)), "update")
    return out.groupBy("trial").agg(F.min_by(F.struct("step", "cer"), F.struct("cer", "step")).alias("b")).select("trial", "b.*")


@query("stream_improvements", sql("""
    SELECT trial, step, cer FROM (SELECT *, min(cer) OVER (PARTITION BY trial ORDER BY step, cer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM evals)
    WHERE b IS NULL OR cer < b""", "evals"))
def stream_improvements(tb: Tables):
    """Four files in the order of steps, one in each batch, read by two runs from one checkpoint: state outlives the first."""
    source, state, out = (scratch_path(tb.spark, n) for n in ("evals", "evals-state", "improvements"))
    rows = tb.evals.select("trial", "step", "cer")
    cuts = [r["c"] for r in rows.agg(F.percentile("step", [0.25, 0.5, 0.75]).alias("q")).select(F.explode("q").alias("c")).collect()]
    for lo, hi in zip([None, *cuts], [*cuts, None], strict=True):
        part = rows.where(F.lit(True) if lo is None else F.col("step") > lo).where(F.lit(True) if hi is None else F.col("step") <= hi)
        part.coalesce(1).write.mode("append").parquet(source)
        if lo is not None:
            stream = tb.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
            st.to_parquet(st.stream_improvements(stream), out, state).awaitTermination()
    return tb.spark.read.parquet(out).select("trial", "step", "cer")


@query("incremental_ground_truth", sql("""
    SELECT tbl // 8 AS doc, tbl AS table_idx, md5(pred) AS h FROM html_pairs WHERE pred <> '<table></table>'""", "html_pairs"))
def incremental_ground_truth(tb: Tables):
    """The same tables come twice: a second run from a new checkpoint finds all documents there and adds nothing."""
    html = F.when(F.col("pred") == "<table></table>", " ").otherwise(F.col("pred"))
    rows = tb.html_pairs.select(F.expr("tbl div 8").alias("doc"), F.col("tbl").alias("table_idx"), html.alias("html"))
    target, source = scratch_path(tb.spark, "truth"), stream_of(tb, rows)
    for _ in range(2):
        st.incremental_ground_truth(source, target, scratch_path(tb.spark, "truth-state"), "doc").awaitTermination()
    return tb.spark.read.parquet(target).select("doc", "table_idx", F.md5("html").alias("h"))
