"""Exact duplicates by two Bloom passes: only rows whose hash may repeat are shuffled."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import stored

#: Cells of a counting filter for each row, and the largest filter (32 MB as bits) that is sent to executors.
#: Beyond that size more unrepeated rows are taken for possible repeats and shuffled too; results stay exact.
CELLS_PER_ROW, MAX_CELLS = 16, 1 << 28
#: Hash functions of the filter.
HASHES = 2
#: Bits in one bitmap of Spark's bitmap functions.
BITMAP_BITS = 32768


def text_digest(text: str | Column) -> Column:
    return F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256)


def _cell(digest: Column, which: int, cells: int) -> Column:
    return F.pmod(F.xxhash64(digest, F.lit(which)), F.lit(cells))


def repeated_filter(digests: DataFrame, digest: str, n_rows: int) -> tuple[int, list[np.ndarray]]:
    """First pass: for each hash function, a bitmap of the cells hit at least twice.

    Hits are counted per task before they are shuffled as numbers; texts never move.
    """
    cells = -(-min(max(n_rows, 1) * CELLS_PER_ROW, MAX_CELLS) // BITMAP_BITS) * BITMAP_BITS
    pairs = digests.select(F.explode(F.array(*[F.struct(F.lit(j).alias("j"), _cell(F.col(digest), j, cells).alias("cell")) for j in range(HASHES)])).alias("p"))
    twice = pairs.groupBy("p.j", "p.cell").agg(F.count("*").alias("n")).where("n > 1")
    maps = twice.groupBy("j", F.expr("bitmap_bucket_number(cell)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(cell))").alias("bits"))
    out = [np.zeros(cells // 8 + BITMAP_BITS // 8, np.uint8) for _ in range(HASHES)]
    width = BITMAP_BITS // 8
    for row in maps.collect():
        at = (row["b"] - 1) * width if row["b"] > 0 else len(out[0]) - width
        out[row["j"]][at : at + width] |= np.frombuffer(bytes(row["bits"]), np.uint8)
    return cells, out


def _possible(digest: Column, cells: int, maps: list[np.ndarray], spark) -> Column:
    sent = spark.sparkContext.broadcast(maps)

    @F.pandas_udf("boolean")
    def probe(*cell: pd.Series) -> pd.Series:
        found = np.ones(len(cell[0]), bool)
        for series, bits in zip(cell, sent.value, strict=True):
            # bitmap_bucket_number puts cells 1..32768 into bucket 1 and cell 0 into bucket 0, at the end of the array
            at = series.to_numpy(np.int64) - 1
            at[at < 0] = (len(bits) - BITMAP_BITS // 8) * 8
            found &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return pd.Series(found)

    return probe(*[_cell(digest, j, cells) for j in range(HASHES)])


def mark_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays (a null id is the smallest). Null texts are empty texts. Of rows that
    also share the id, exactly one is kept. An empty table gives an empty result.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), text_digest(text).alias("text_sha256"), F.monotonically_increasing_id().alias("_row"))
    own = stored(own, "digests")
    cells, maps = repeated_filter(own, "text_sha256", own.count())
    own = own.withColumn("_maybe", _possible(F.col("text_sha256"), cells, maps, docs.sparkSession))
    alone = own.where("NOT _maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    maybe = own.where("_maybe")
    groups = maybe.groupBy("text_sha256").agg(
        F.max(F.struct(F.col("doc_id").isNotNull().alias("there"), "doc_id", "_row")).alias("_top"), F.count("*").alias("group_size"))
    # a stored side leaves the join with two plain shuffles, so that adaptive execution can split a hot group's rows
    marked = maybe.join(stored(groups, "groups"), "text_sha256").select(
        "doc_id", F.col("_top.doc_id").alias("keep_id"), "group_size", (F.col("_row") == F.col("_top._row")).alias("kept"), "text_sha256")
    return alone.unionByName(marked)


def drop_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns. Possible repeats are reduced to the largest id inside tasks before they move."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    key, value = F.col(names[docs.columns.index(doc_id)]), F.col(names[docs.columns.index(text)])
    rows = rows.withColumn("_sha", text_digest(value))
    digests = stored(rows.select("_sha"), "digests")
    cells, maps = repeated_filter(digests, "_sha", digests.count())
    rows = rows.withColumn("_maybe", _possible(F.col("_sha"), cells, maps, docs.sparkSession))
    best = rows.where("_maybe").groupBy("_sha").agg(F.max_by(F.struct(*names), F.struct(key.isNotNull(), key)).alias("_row")).select("_row.*")
    return rows.where("NOT _maybe").select(*names).unionByName(best.select(*names)).toDF(*docs.columns)
