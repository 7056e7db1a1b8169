"""Model calls as batch stages: a provider is built once per Python worker and called per Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from foliospark.functions import text as t
from foliospark.operators import prompts

Batch = Callable[[pd.DataFrame], pd.DataFrame]


def infer_pages(df: DataFrame, provider: Callable[[], Batch], schema: str) -> DataFrame:
    """Rows to any number of detection rows. `provider()` builds the model, the result maps a batch."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = None
        for batch in batches:
            call = call or provider()
            yield call(batch)

    return df.mapInPandas(run, schema)


def infer_with_fallback(
    df: DataFrame, primary: tuple[str, Callable[[], Batch]], secondary: tuple[str, Callable[[], Batch]], schema: str, allow: bool = True,
) -> DataFrame:
    """As infer_pages, row by row where a batch fails: the second provider takes failed rows; what fails in the end stays
    as a row with its error. `schema` lists the output columns, the input's first; `provider` and `error` are added."""
    names = [c.strip().split()[0] for c in schema.split(",")]
    tried = [primary, secondary] if allow else [primary]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready: dict[str, Batch] = {}

        def call(label: str, build: Callable[[], Batch], rows: pd.DataFrame) -> pd.DataFrame:
            if label not in ready:
                ready[label] = build()
            return ready[label](rows).assign(provider=label, error=None)

        def one(rows: pd.DataFrame) -> pd.DataFrame:
            error = ""
            for label, build in tried:
                try:
                    return call(label, build, rows)
                except Exception as e:  # a provider may fail in any way
                    error = f"{label}: {e}"
            return rows.reindex(columns=names).assign(provider=None, error=error)

        for batch in batches:
            try:
                yield call(*primary, batch)[[*names, "provider", "error"]]
            except Exception:
                parts = [one(batch.iloc[i:i + 1]) for i in range(len(batch))]
                if parts:
                    yield pd.concat(parts, ignore_index=True)[[*names, "provider", "error"]]

    return df.mapInPandas(run, f"{schema}, provider string, error string")


def model_tasks(df: DataFrame, task: str, client: Callable[[], Callable[[str], str | None]], lang: str = "ja", calls: int | None = None,
                text: str = "text", question: Column | None = None, schema: Column | None = None) -> DataFrame:
    """Adds `prompt` and `result` for task summary, qa, json or chat. A failed call gives null.

    Prompts and the clean-up of replies are expressions; only the call itself runs in Python. `calls` bounds the number
    of tasks that call the model at a time.
    """
    doc = F.col(text)
    if task == "summary":
        prompt = prompts.summary_prompt(doc, F.lit(None).cast("int"), F.array().cast("array<string>"))
    elif task == "qa":
        prompt = prompts.format_prompt(doc, question, F.lit("low"))
    elif task == "json":
        prompt = prompts.extraction_prompt(doc, schema)
    elif task == "chat":
        prompt = doc
    else:
        raise ValueError(f"unknown task {task}")
    rows = df.withColumn("prompt", prompts.language_suffix(prompt, F.lit(task), F.lit(lang)))
    if calls:
        rows = rows.repartition(calls)
    out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", _reply string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = None

        def safe(p: str):
            try:
                return ask(p)
            except Exception:  # a client may fail in any way
                return None

        for batch in batches:
            ask = ask or client()
            yield batch.assign(_reply=[safe(p) for p in batch["prompt"]])

    replies = rows.mapInPandas(run, out_schema)
    reply = t.strip(F.col("_reply"))
    if task in ("summary", "qa"):
        result = F.when(reply != "", F.regexp_extract(reply, r"^([^\r\n]*)", 1))
    elif task == "json":
        result = F.coalesce(t.coerce_json(F.col("_reply")), F.col("_reply"))
    else:
        result = F.col("_reply")
    return replies.withColumn("result", result).drop("_reply")
