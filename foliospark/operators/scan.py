"""Running totals, ranks and previous values that do not need a whole key in one task.

A plain window sends all rows of a key to one task. Here the key is cut into ordered buckets: totals per
(key, bucket) are aggregated first, a window runs over these totals only, and each row's value is the prefix of
its bucket plus a window inside the bucket. `bucket` must grow with the first order column.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from foliospark.operators.groups import join_null_safe

#: Rows of a bucket cut at quantiles, and the most buckets of a key.
TILE_ROWS = 100_000
MOST_TILES = 4096
#: Rows of a key that one window goes over; larger keys are cut into buckets.
WINDOW_ROWS = 100_000
#: Rows that one task sorts for a window whose rows are dealt by their number.
TASK_ROWS = 2_000_000


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: Column,
    specs: dict[str, tuple[str, Column | None]],
    deal: bool = False,
) -> DataFrame:
    """Adds one column per spec: name -> (kind, column).

    Kinds: row_number, sum, min, max (all up to and with the current row), lag (previous row),
    last (latest non-null value up to the current row), next (first non-null value from the current row on),
    min_before (up to the previous row).

    Keys are counted first, moving only counts. Where none has more than WINDOW_ROWS rows, a plain window does: rows move once.
    With `deal` they move to as many tasks as their number asks for, so that what a task sorts does not grow with the table.
    """
    columns = list(df.columns)
    if keys and deal:
        most, rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n"), F.sum("_n")).first()
        if (most or 0) <= WINDOW_ROWS:
            tasks = -(-(rows or 0) // TASK_ROWS)
            if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
                df = df.repartition(tasks, *keys)
            return _windowed(df, keys, order, specs)
    elif keys and not larger_than(df, keys, WINDOW_ROWS):
        return _windowed(df, keys, order, specs)
    # one struct of keys and bucket: equal structs join also where a key or the bucket is null
    df = df.withColumn("_bucket", _place(keys, bucket))
    own = [F.col(f"_bucket.k{i}") for i in range(len(keys))]
    position = F.struct(*(F.col(o) for o in order))
    totals = []
    for name, (kind, c) in specs.items():
        if kind == "row_number":
            total = F.count(F.lit(1))
        elif kind in ("sum", "min", "max"):
            total = getattr(F, kind)(c)
        elif kind == "min_before":
            total = F.min(c)
        elif kind == "lag":
            total = F.max_by(c, position)
        elif kind == "last":
            total = F.max_by(c, F.when(c.isNotNull(), position))
        elif kind == "next":
            total = F.min_by(c, F.when(c.isNotNull(), position))
        else:
            raise ValueError(f"unknown running value {kind}")
        totals.append(total.alias(f"_t_{name}"))
    sums = df.groupBy("_bucket").agg(*totals)

    along = Window.partitionBy(*own).orderBy("_bucket.at") if keys else Window.orderBy("_bucket.at")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    prefixes = []
    for name, (kind, _) in specs.items():
        total = F.col(f"_t_{name}")
        if kind in ("row_number", "sum"):
            prefix = F.sum(total).over(before)
        elif kind in ("min", "max"):
            prefix = getattr(F, kind)(total).over(before)
        elif kind == "min_before":
            prefix = F.min(total).over(before)
        elif kind == "lag":
            prefix = F.lag(total).over(along)
        elif kind == "next":
            prefix = F.first(total, ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing))
        else:
            prefix = F.last(total, ignorenulls=True).over(before)
        prefixes.append(prefix.alias(f"_p_{name}"))
    bases = sums.select("_bucket", *prefixes)

    joined = df.join(bases, "_bucket")
    inside = Window.partitionBy("_bucket").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = []
    for name, (kind, c) in specs.items():
        prefix = F.col(f"_p_{name}")
        if kind == "row_number":
            value = F.coalesce(prefix, F.lit(0)) + F.row_number().over(inside)
        elif kind == "sum":
            value = F.coalesce(prefix, F.lit(0)) + F.sum(c).over(upto)
        elif kind == "min":
            value = F.least(prefix, F.min(c).over(upto))
        elif kind == "max":
            value = F.greatest(prefix, F.max(c).over(upto))
        elif kind == "min_before":
            earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
            value = F.least(prefix, F.min(c).over(earlier))
        elif kind == "lag":
            value = F.when(F.row_number().over(inside) == 1, prefix).otherwise(F.lag(c).over(inside))
        elif kind == "next":
            rest = inside.rowsBetween(0, Window.unboundedFollowing)
            value = F.coalesce(F.first(c, ignorenulls=True).over(rest), prefix)
        else:
            value = F.coalesce(F.last(c, ignorenulls=True).over(upto), prefix)
        out.append(value.alias(name))
    return joined.select(*columns, *out)


def larger_than(df: DataFrame, keys: list[str], limit: int) -> bool:
    """Whether any key has more rows than `limit`."""
    return not df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).select("_n").isEmpty()


def _windowed(df: DataFrame, keys: list[str], order: list[str], specs: dict[str, tuple[str, Column | None]]) -> DataFrame:
    along = Window.partitionBy(*keys).orderBy(*order)
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    made = {
        "row_number": lambda c: F.row_number().over(along).cast("bigint"),
        "sum": lambda c: F.sum(c).over(upto), "min": lambda c: F.min(c).over(upto), "max": lambda c: F.max(c).over(upto),
        "min_before": lambda c: F.min(c).over(along.rowsBetween(Window.unboundedPreceding, -1)),
        "lag": lambda c: F.lag(c).over(along), "last": lambda c: F.last(c, ignorenulls=True).over(upto),
        "next": lambda c: F.first(c, ignorenulls=True).over(along.rowsBetween(0, Window.unboundedFollowing)),
    }
    for kind, _ in specs.values():
        if kind not in made:
            raise ValueError(f"unknown running value {kind}")
    return df.select(*df.columns, *(made[kind](c).alias(name) for name, (kind, c) in specs.items()))


def _place(keys: list[str], bucket: Column) -> Column:
    return F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), bucket.alias("at"))


def islands(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, lo: Column, hi: Column, gap: Column, name: str
) -> DataFrame:
    """Adds the island of a row: the order values of its first row.

    An island starts where `lo` lies more than `gap` beyond every `hi` before it. `lo` must not fall along the order;
    `gap` is constant within a key.
    """
    columns = list(df.columns)
    rows = df.withColumn("_bucket", _place(keys, bucket)).withColumn("_lo", lo).withColumn("_hi", hi).withColumn("_gap", gap)
    inside = Window.partitionBy("_bucket").orderBy(*order)
    seen = F.max("_hi").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    position = F.struct(*(F.col(o) for o in order))
    opens = seen.isNull() | (F.col("_lo") - seen > F.col("_gap"))
    rows = rows.withColumn("_open", F.when(opens, position))
    # The last row of a bucket that could open an island does so when it also clears the buckets before.
    last = F.max_by(F.struct("_open", "_lo"), F.when(F.col("_open").isNotNull(), position))
    sums = rows.groupBy("_bucket").agg(F.max("_hi").alias("_top"), last.alias("_last"), F.first("_gap").alias("_gap"))
    own = [F.col(f"_bucket.k{i}") for i in range(len(keys))]
    before = Window.partitionBy(*own).orderBy("_bucket.at").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_reach", F.max("_top").over(before))
    clears = F.col("_reach").isNull() | (F.col("_last._lo") - F.col("_reach") > F.col("_gap"))
    sums = sums.withColumn("_start", F.when(clears, F.col("_last._open")))
    bases = sums.select("_bucket", "_reach", F.last("_start", ignorenulls=True).over(before).alias("_carry"))
    joined = rows.join(bases, "_bucket")
    opened = F.when(F.col("_reach").isNull() | (F.col("_lo") - F.col("_reach") > F.col("_gap")), F.col("_open"))
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    island = F.coalesce(F.last(opened, ignorenulls=True).over(upto), F.col("_carry"))
    return joined.select(*columns, island.alias(name))


def ranked(df: DataFrame, keys: list[str], order: list[str], bucket: Column, name: str = "rank") -> DataFrame:
    """Exact 1-based position within the key."""
    return running(df, keys, order, bucket, {name: ("row_number", None)})


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly. For work that costs far more than moving a row, such as edit distances of long texts."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def tiles(c: Column, width: float) -> Column:
    """Bucket of a numeric column."""
    return F.floor(c / F.lit(float(width)))


def with_quantile_tiles(df: DataFrame, value: str, name: str = "_tile") -> DataFrame:
    """Adds a bucket of a number, for `running`: cut at quantiles, so buckets hold about TILE_ROWS rows (or one value's ties) wherever the
    values lie. One aggregation finds the cuts, at most MOST_TILES; nulls come first and NaN last, as in sorting.
    """
    c = F.col(value).cast("double")
    parts = [i / MOST_TILES for i in range(1, MOST_TILES)]
    n, cuts = df.agg(F.count(c), F.percentile_approx(F.when(~F.isnan(c), c), parts, 4 * MOST_TILES)).first()
    tiles_ = min(MOST_TILES, n // TILE_ROWS)
    cuts = sorted({cuts[i * MOST_TILES // tiles_ - 1] for i in range(1, tiles_)} - {float("-inf"), float("inf")}) if cuts and tiles_ > 1 else []
    if not cuts:
        return df.withColumn(name, F.lit(0.0))
    place = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="_cut", outputCol=name, handleInvalid="keep")
    placed = place.transform(df.withColumn("_cut", c)).drop("_cut")
    return placed.withColumn(name, F.when(c.isNull(), F.lit(-1.0)).otherwise(F.col(name)))


def ordered_concat(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    text: str,
    sep: str,
    name: str,
    bucket: Column | None = None,
) -> DataFrame:
    """Joins `text` in order into one string per key.

    With a bucket the pieces are joined per (key, bucket) first, so no task collects all rows of a key; what is
    left per key is one piece per bucket. Null texts are skipped.
    """
    entry = F.struct(*(F.col(o) for o in order), F.col(text).alias("_text"))

    def joined() -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), entry)))
        return F.array_join(F.transform(rows, lambda r: r["_text"]), sep)

    if bucket is None:
        return df.groupBy(*keys).agg(joined().alias(name))
    pieces = df.filter(F.col(text).isNotNull()).groupBy(*keys, bucket.alias("_bucket")).agg(joined().alias("_piece"))
    rows = F.array_sort(F.collect_list(F.struct("_bucket", "_piece")))
    whole = F.array_join(F.transform(rows, lambda r: r["_piece"]), sep)
    return pieces.groupBy(*keys).agg(whole.alias(name))


def value_at_ranks(
    df: DataFrame, keys: list[str], value: str, picks: dict[str, Column], width: float
) -> DataFrame:
    """Order statistics per key: `picks` maps a name to a 0-based index, written over the column `n`.

    Equal values are counted first; only the counts are ranked. The result is exact. A null key is a key like any other.
    """
    if not keys:
        whole = value_at_ranks(df.withColumn("_all", F.lit(1)), ["_all"], value, picks, width)
        return whole.drop("_all")
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    upto = running(counts, keys, [value], tiles(F.col(value), width), {"_upto": ("sum", F.col("_c"))})
    sizes = counts.groupBy(*keys).agg(F.sum("_c").alias("n"))
    placed = join_null_safe(upto, sizes, keys)
    exprs = []
    for name, index in picks.items():
        inside = (index < F.col("_upto")) & (index >= F.col("_upto") - F.col("_c"))
        exprs.append(F.max(F.when(inside, F.col(value))).alias(name))
    return placed.groupBy(*keys, "n").agg(*exprs)
