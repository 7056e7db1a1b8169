"""Exact, seeded sampling in hash order; the order of a row depends on its id and the seed only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliospark.operators.scan import ranked


def hash_of(id_col: Column, seed: int | str) -> Column:
    return F.md5(F.concat(id_col.cast("string"), F.lit(f":{seed}")))


def hash_number(h: Column) -> Column:
    """0 .. 2^32 - 1 from the first eight digits."""
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")


def hash_ranked(df: DataFrame, keys: list[str], id_col: str, seed: int | str) -> DataFrame:
    """Adds `_rank`, the 1-based place of a row in hash order. The 4,096 buckets are the first three hash digits."""
    rows = df.withColumn("_h", hash_of(F.col(id_col), seed))
    return ranked(rows, keys, ["_h", id_col], F.substring("_h", 1, 3), "_rank").drop("_h")


#: Rows among which the cut of a selection is looked up directly.
CUT_ROWS = 10_000


def hash_cut(df: DataFrame, n: int, seed: int | str, id_col: str) -> tuple[Column, Column, int, int] | None:
    """Where the first `n` rows in hash order end: (comes before the cut, stands at the cut, rows of these that belong, rows at the cut).
    None: all rows belong.

    A radix selection over ids: rows are counted by three hash digits, then only those of the bucket in which the n-th row falls by the next
    three, until few are left. Every round reads the id column and moves 4,096 counts; rows don't move.
    """
    h = F.coalesce(hash_of(F.col(id_col), seed), F.lit(""))
    keys = df.select(h.alias("h"), F.col(id_col).alias("id"))
    prefix, left, here = "", n, None
    while here is None or (here > CUT_ROWS and len(prefix) < 30):
        counts = keys.where(F.col("h").startswith(prefix)).groupBy(F.substring("h", len(prefix) + 1, 3).alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()
        rows = sorted((r["d"], r["n"]) for r in counts)
        if not prefix and sum(c for _, c in rows) <= n:
            return None
        for digits, here in rows:
            if left <= here:
                break
            left -= here
        if not digits:  # only null ids have no digits
            prefix = None
            break
        prefix += digits
    own = keys.where(F.col("h") == "") if prefix is None else keys.where(F.col("h").startswith(prefix))
    by_key = own.groupBy("h", "id").agg(F.count(F.lit(1)).alias("n")).orderBy("h", "id").limit(CUT_ROWS).collect()
    for r in by_key:
        if left <= r["n"]:
            break
        left -= r["n"]
    kind = df.schema[id_col].dataType
    at, cut = F.struct(h.alias("h"), F.col(id_col).alias("id")), F.struct(F.lit(r["h"]).alias("h"), F.lit(r["id"]).cast(kind).alias("id"))
    return at < cut, at.eqNullSafe(cut), left, r["n"]


def with_first(df: DataFrame, n: int, seed: int | str, id_col: str) -> DataFrame:
    """Adds `_first`: whether a row is among the first `n` in hash order. Only rows that share the id at the cut, where some of them belong
    and some don't, are ranked; all others are told by their own id."""
    if n <= 0:
        return df.withColumn("_first", F.lit(False))
    cut = hash_cut(df, n, seed, id_col)
    if cut is None:
        return df.withColumn("_first", F.lit(True))
    before, at, belong, there = cut
    if belong == there:
        return df.withColumn("_first", before | at)
    tied = hash_ranked(df.where(at), [], id_col, seed).withColumn("_first", F.col("_rank") <= belong).drop("_rank")
    return df.where(~at).withColumn("_first", before).unionByName(tied)


def sample_exact(df: DataFrame, n: int, seed: int, id_col: str) -> DataFrame:
    """Exactly n rows without replacement; fewer if there are fewer. Null ids come first, of rows that share an id any may be taken."""
    return with_first(df, n, seed, id_col).filter("_first").drop("_first")


def oversample(df: DataFrame, n: int, seed: int, id_col: str) -> DataFrame:
    """n rows, all rows in turn as often as it takes; `copy` numbers the rounds from 0. Fails on an empty input."""
    size = df.count()
    if size == 0:
        raise ValueError("cannot fill a sample from an empty table")
    return repeated(df, n, size, seed, id_col)


def repeated(df: DataFrame, n: int, size: int, seed: int | str, id_col: str) -> DataFrame:
    """The `size` rows repeated so that n come out: all in whole rounds, and in the last one the first in hash order."""
    rounds = F.lit(n // size) + F.when(F.col("_first"), 1).otherwise(0)
    rows = with_first(df, n % size, seed, id_col).withColumn("_rounds", rounds.cast("bigint")).filter("_rounds > 0")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_rounds") - 1))).drop("_first", "_rounds")


def repeat_ranked(rows: DataFrame, n: Column, size: Column) -> DataFrame:
    """Rows with `_rank` repeated so that n rows come out, earlier ranks first."""
    rounds = F.floor((n - F.col("_rank")) / size)
    kept = rows.filter(F.col("_rank") <= n)
    return kept.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), rounds.cast("bigint"))))


def shuffle_rows(df: DataFrame, seed: int, id_col: str) -> DataFrame:
    """All rows with their place `pos` in a seeded shuffle; write with repartitionByRange("pos") to store that order."""
    return hash_ranked(df, [], id_col, seed).withColumnRenamed("_rank", "pos")


def train_val_split(df: DataFrame, ratio: float, seed: int, id_col: str) -> DataFrame:
    """Adds `split`: exactly int(n * ratio) rows are `val`, the rest `train`."""
    n_val = int(df.count() * ratio)
    return with_first(df, n_val, seed, id_col).withColumn("split", F.when(F.col("_first"), "val").otherwise("train")).drop("_first")


def split_complement(df: DataFrame, sampled: DataFrame, id_col: str) -> DataFrame:
    """Rows whose id was not sampled."""
    return df.alias("d").join(sampled.select(id_col).distinct().alias("s"), F.col("d." + id_col).eqNullSafe(F.col("s." + id_col)), "left_anti")


def line_fragments(lines: DataFrame, total: int, max_len: int, seed: int, id_col: str, text: str = "text") -> DataFrame:
    """`total` fragments of up to `max_len` characters, one window per line, repeated where lines are too few."""
    size = F.length(text)
    start = hash_number(hash_of(F.col(id_col), f"w{seed}")) % F.greatest(size - max_len + 1, F.lit(1)) + 1
    cut = F.when(size > max_len, F.substring(F.col(text), start.cast("int"), F.lit(max_len))).otherwise(F.col(text))
    rows = lines.withColumn("fragment", cut).filter(F.trim("fragment") != "")
    return oversample(rows, total, seed, id_col)


def first_n_inputs(inputs: DataFrame, sidecars: DataFrame, n: int, name: str = "name", stem: str = "stem") -> tuple[DataFrame, DataFrame]:
    """First n inputs by name, and the side files of these."""
    first = inputs.orderBy(name).limit(n)
    return first, sidecars.join(first.select(stem), stem, "left_semi")


def limit_pages(df: DataFrame, max_pages: int, page: str = "page_num") -> DataFrame:
    """First pages of every document; the filter reaches the scan."""
    return df.filter(F.col(page) <= max_pages)


# --- fixed values: shares of a training mix
GENERAL_SHARE = 0.7
TASK_WEIGHTS = {"qa": 0.35, "json_extraction": 0.25, "summary": 0.20, "table_qa": 0.10, "layout_understanding": 0.10}


def mix_union(general: DataFrame, doc: DataFrame) -> DataFrame:
    return general.unionByName(doc, allowMissingColumns=True)


def mix_datasets(
    general: DataFrame, doc: DataFrame, id_col: str = "id", size: int | None = None, share: float = GENERAL_SHARE,
    weights: dict[str, float] = TASK_WEIGHTS, seed: int = 42,
) -> DataFrame:
    """General samples and document samples by task in given shares; `source`, `task_type` and `copy` tell where a row is from.

    Only counts come to the driver: one per task of the weight list. Lists too short are repeated; what truncation or
    a missing task leaves open is filled with qa rows drawn with replacement, and stays open without qa rows.
    """
    by_task = {r["task_type"]: r["n"] for r in doc.filter(F.col("task_type").isin(*weights)).groupBy("task_type").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    n_general_rows = general.count()
    size = n_general_rows + doc.count() if size is None else size
    n_general = int(size * share)
    n_doc = size - n_general
    if n_general and not n_general_rows:
        raise ValueError("a general share above zero needs general samples")
    zero = F.lit(0).cast("bigint")
    out_general = repeated(general, n_general, max(n_general_rows, 1), seed, id_col)
    out_general = out_general.withColumn("source", F.lit("general")).withColumn("task_type", F.lit(None).cast("string"))

    quotas = {task: int(n_doc * w) for task, w in weights.items() if by_task.get(task)}
    number = lambda d: F.element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), F.col("task_type"))
    ranks = hash_ranked(doc.filter(F.col("task_type").isin(*quotas)), ["task_type"], id_col, seed)
    out_doc = repeat_ranked(ranks, number(quotas), number({k: by_task[k] for k in quotas})).withColumn("source", F.lit("doc"))
    out = mix_union(out_general, out_doc).drop("_rank")
    open_rows = n_doc - sum(quotas.values())
    if open_rows > 0 and by_task.get("qa"):
        spark = doc.sparkSession
        picks = spark.range(open_rows).select(
            F.col("id").alias("_i"), (hash_number(hash_of(F.col("id"), f"fill{seed}")) % by_task["qa"] + 1).alias("_rank"))
        qa = hash_ranked(doc.filter("task_type = 'qa'"), [], id_col, seed)
        fill = qa.join(picks, "_rank").withColumn("copy", -1 - F.col("_i")).withColumn("source", F.lit("fill")).drop("_rank", "_i")
        out = mix_union(out, fill)
    return out.withColumn("copy", F.coalesce("copy", zero))
