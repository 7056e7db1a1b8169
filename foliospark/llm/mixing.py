"""Mixing sources to target weights: blocks of words, multinomial draws for every output shard, permuted block indices."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from foliospark.llm.common import WORD, bound_batches, stored
from foliospark.session import scratch_path

#: Words of a block; slots of an output shard.
BLOCK_WORDS, SHARD_SLOTS = 64, 1 << 12
#: Weights of sources in their order, repeating; output size as a share of the input; most times a source is used.
WEIGHTS, SHARE, MOST_TIMES = (3.0, 1.0, 2.0), 1.5, 2
SEED = 20_240
#: Documents of one source in one bucket of its order.
BUCKET_DOCS = 4096


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_TIMES) -> list[float]:
    """Target of each source: `share` of all sizes by weight, no source above `most` times its size; what is above goes to
    the other sources by weight, again and again."""
    want = share * sum(sizes)
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out, free = [0.0] * len(sizes), list(range(len(sizes)))
    while free:
        unit = want / sum(weight[i] for i in free)
        full = [i for i in free if weight[i] * unit > most * sizes[i]]
        if not full:
            for i in free:
                out[i] = weight[i] * unit
            break
        for i in full:
            out[i] = float(most * sizes[i])
            want -= out[i]
        free = [i for i in free if i not in set(full)]
    return out


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pseudorandom one-to-one map of [0, size) for each key: a four-round Feistel network over the next even power of two,
    applied again to whatever falls outside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64).copy(), np.arange(len(index))
    while len(todo):
        left, right = out[todo] >> half[todo], out[todo] & mask[todo]
        for turn in range(4):
            h = (right + key[todo].astype(np.uint64) + np.uint64(turn + 1)) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((h ^ (h >> np.uint64(32))) & mask[todo])
        out[todo] = (left << half[todo]) | right
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def bucketed(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Adds bucket, by hash of the id and the text, from source_no, doc_id, _hash and the sources' numbers of documents (`groups`)."""
    return docs.join(F.broadcast(groups), "source_no").withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "_hash"), F.floor(F.col("docs") / BUCKET_DOCS) + 1)).drop("docs")


def positions(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """doc_id, source_no, text hash, size -> (adds first_word, the number of words before the document in its source, null
    without words; documents by source; words before each bucket).

    A source is cut into buckets by hash, so that a source with a third of all rows is ordered by many tasks. In a bucket rows go
    by id and text hash; what ties has the same words, so any order of ties gives the same sequence.
    """
    groups = docs.groupBy("source_no").agg(F.count("*").alias("docs"))
    buckets = stored(bucketed(docs, groups), "sizes")
    totals = buckets.groupBy("source_no", "bucket").agg(F.sum("size").alias("words"))
    every = Window.partitionBy("source_no")
    upto = F.sum("words").over(every.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    totals = totals.select("source_no", "bucket", (upto - F.col("words")).alias("before"), upto.alias("upto"), F.sum("words").over(every).alias("total"))
    totals = stored(totals, "buckets")
    own = F.sum("size").over(Window.partitionBy("source_no", "bucket").orderBy("doc_id", "_hash").rowsBetween(Window.unboundedPreceding, -1))
    placed = buckets.withColumn("within", F.coalesce(own, F.lit(0))).join(totals.select("source_no", "bucket", "before"), ["source_no", "bucket"]).withColumn(
        "first_word", F.when(F.col("size") > 0, F.col("before") + F.col("within")))
    return placed.drop("before", "within", "bucket"), groups, totals


def pieces(block_words: int) -> Column:
    """From block, from_word and counts of a shard's row: array of (first_word of a document, first of its words in the block, how many)."""
    start = F.col("block") * block_words

    def piece(n: Column, i: Column) -> Column:
        earlier = F.aggregate(F.slice("counts", 1, i), F.lit(0).cast("long"), lambda a, x: a + x)
        return F.struct((start + F.when(i == 0, -F.col("from_word")).otherwise(earlier)).alias("first_word"),
                        F.when(i == 0, F.col("from_word")).otherwise(0).alias("from_word"), n.cast("long").alias("words"))

    return F.transform("counts", piece)


def homes(totals: DataFrame, block_words: int) -> DataFrame:
    """source_no, block, bucket, shared: the buckets that hold words of each block; shared blocks lie in more than one."""
    first, last = F.floor(F.col("before") / block_words), F.floor((F.col("upto") - 1) / block_words)
    rows = totals.where("upto > before").select("source_no", "bucket", "before", "upto", "total", first.alias("first"), last.alias("last"))
    rows = rows.withColumn("block", F.explode(F.sequence("first", "last")))
    opened = (F.col("block") == F.col("first")) & (F.col("before") % block_words > 0)
    goes_on = (F.col("block") == F.col("last")) & (F.col("upto") % block_words > 0) & (F.col("upto") < F.col("total"))
    return rows.select("source_no", "block", "bucket", (opened | goes_on).alias("shared"))


CUT = "shard long, slot long, source_no long, block long, time long, start int, text string, from_word long, counts array<int>, shared boolean"


def packed(texts: DataFrame, slots: DataFrame, block_words: int) -> DataFrame:
    """source_no, bucket, before, text of each source's rows in order, and the slots of each bucket's blocks -> a row for each slot and
    bucket of its block: shard, slot, source_no, block, time, start, text, from_word, counts, shared.

    The words of all rows of a source stand one after the other, cut into blocks, joined by single spaces. from_word: which word of its
    document is the first here; counts: how many words of each document; start: the first word's place in the block. Slots go to where their
    blocks are packed, so a text moves once. A task reads the slots of a bucket, then its rows as they come, and holds one block.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, words, parts, begin, out = None, 0, [], [], 0, []
        wanted: dict[str, array] = {}
        place = 0

        def close() -> None:
            nonlocal words, parts, place
            if words:
                block = (at - 1) // block_words
                cut = ((at - len(words)) % block_words, b" ".join(words).decode(), begin, parts)
                while place < len(wanted["block"]) and wanted["block"][place] == block:
                    out.append((wanted["shard"][place], wanted["slot"][place], key[0], block, wanted["time"][place], *cut, bool(wanted["shared"][place])))
                    place += 1
            words, parts = [], []

        def batch() -> pa.RecordBatch:
            kinds = (*[pa.int64()] * 5, pa.int32(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.bool_())
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in CUT.split(", ")])

        names = ("block", "shard", "slot", "time", "shared")
        for rows in batches:
            columns = [rows.column(name).to_pylist() for name in ("source_no", "bucket", "is_text", "before", "text")]
            slots = [rows.column(name).to_pylist() for name in names]
            for i, (no, bucket, is_text, before, text) in enumerate(zip(*columns, strict=True)):
                if (no, bucket) != key:
                    close()
                    key, at, place, wanted = (no, bucket), -1, 0, {n: array("q") for n in names}
                if not is_text:
                    for name, column in zip(names, slots, strict=True):
                        wanted[name].append(column[i])
                    continue
                at = before if at < 0 else at
                own, lo = text.encode().split(), 0  # of bytes: splits at the white space of WORD
                while lo < len(own):
                    n = min(block_words - at % block_words, len(own) - lo)
                    begin = begin if words else lo
                    words += own[lo : lo + n]
                    parts.append(n)
                    lo, at = lo + n, at + n
                    if at % block_words == 0:
                        close()
                        if len(out) >= 4096:
                            yield batch()
            if out:
                yield batch()
        close()
        if out:
            yield batch()

    columns = ["source_no", "bucket", "is_text", "before", "text", *("block", "shard", "slot", "time", "shared")]
    both = texts.withColumn("is_text", F.lit(True)).unionByName(slots.withColumn("is_text", F.lit(False)), allowMissingColumns=True)
    rows = both.repartition("source_no", "bucket").sortWithinPartitions("source_no", "bucket", "is_text", "block", "doc_id", "_hash")
    return rows.select(*columns).mapInArrow(pack, CUT)


SHARDS = ["shard", "slot", "source_no", "block", "time", "text", "from_word", "counts"]


def written(cut: DataFrame, path: str | None) -> DataFrame:
    """The output shards, one row for each slot. Rows of whole blocks stay where they were packed; of shared blocks the parts are joined."""
    spark = cut.sparkSession
    at, writers = scratch_path(spark, "shards"), "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(writers)
    spark.conf.set(writers, "2")  # both folders are written at once, without sorting
    try:
        cut.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "9").partitionBy("shared").parquet(at)
    finally:
        spark.conf.set(writers, before)
    made = spark.read.schema(cut.schema).parquet(at)
    found = made.where("shared").groupBy("shard", "slot", "source_no", "block", "time").agg(
        F.array_sort(F.collect_list(F.struct("start", "text", "from_word", "counts"))).alias("p"))
    joined = found.select("shard", "slot", "source_no", "block", "time", F.array_join("p.text", " ").alias("text"),
                          F.col("p")[0]["from_word"].alias("from_word"), F.flatten("p.counts").alias("counts"))
    shards = made.where("NOT shared").select(*SHARDS).union(stored(joined, "joined"))
    if path is None:
        return shards
    shards.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "9").parquet(path)
    return spark.read.schema(shards.schema).parquet(path)


def drawn_slots(spark, plan: pd.DataFrame, seed: int = SEED, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The output's slots: shard, slot, source_no, nth (how many slots its source had before).

    Each shard draws its slots' counts by source from a multinomial of the targets, seeded by the shard's number. A source's
    draws end at its own number of slots; what then is missing anywhere is dealt to shards at the end. A shard's slots are
    numbered from 0 without gaps, its sources permuted over them.
    """
    wanted = plan["slots"].to_numpy(np.int64)
    total = int(wanted.sum())
    shards = -(-total // shard_slots)
    share = wanted / max(total, 1)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shard in pdf["shard"]:
                size = min(shard_slots, total - shard * shard_slots)
                counts = np.random.default_rng([seed, int(shard)]).multinomial(size, share)
                at = np.flatnonzero(counts)
                yield pd.DataFrame({"shard": shard, "source_no": at, "n": counts[at]})

    counts = stored(spark.range(shards).withColumnRenamed("id", "shard").mapInPandas(draw, "shard long, source_no long, n long"), "draws")
    # shards are summed in runs, so that no task orders all shards of a source
    run = F.floor(F.col("shard") / 1024)
    by_run = counts.groupBy("source_no", run.alias("run")).agg(F.sum("n").alias("n"))
    offset = F.sum("n").over(Window.partitionBy("source_no").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    by_run = by_run.select("source_no", "run", F.coalesce(offset, F.lit(0)).alias("offset"))
    inside = F.sum("n").over(Window.partitionBy("source_no", "run").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    placed = counts.withColumn("run", run).withColumn("inside", F.coalesce(inside, F.lit(0))).join(by_run, ["source_no", "run"])
    known = spark.createDataFrame([(i, int(w)) for i, w in enumerate(wanted)], "source_no long, wanted long")
    placed = placed.withColumn("from", F.col("offset") + F.col("inside")).join(F.broadcast(known), "source_no")
    placed = placed.select("shard", "source_no", "from", F.least(F.col("from") + F.col("n"), "wanted").alias("to"))
    # slots that a source still lacks
    drawn = counts.groupBy("source_no").agg(F.sum("n").alias("n"))
    rest = known.join(drawn, "source_no", "left").select("source_no", F.least(F.coalesce("n", F.lit(0)), "wanted").alias("from"), F.col("wanted").alias("to"))
    step = F.explode(F.sequence(F.col("from"), F.col("to") - 1, F.lit(shard_slots))).alias("start")
    rest = rest.where("from < to").select("source_no", step, "to").select(
        (F.lit(shards) + F.floor(F.col("start") / shard_slots)).alias("shard"), "source_no", F.col("start").alias("from"), F.least("to", F.col("start") + shard_slots).alias("to"))
    ranges = placed.where("from < to").unionByName(rest).withColumn("n", F.col("to") - F.col("from"))
    earlier = F.sum("n").over(Window.partitionBy("shard").orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.withColumn("base", F.coalesce(earlier, F.lit(0))).withColumn("size", F.sum("n").over(Window.partitionBy("shard")))
    every = ranges.select("shard", "source_no", "from", "base", "size", F.explode(F.sequence(F.col("from"), F.col("to") - 1)).alias("nth"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            index, size, shard = ((pdf[c]).to_numpy(np.int64) for c in ("index", "size", "shard"))
            pdf["slot"] = permuted(index, size, shard * 2_654_435_761 + seed + 1)
            yield pdf[["shard", "slot", "source_no", "nth"]]

    index = (F.col("base") + F.col("nth") - F.col("from")).alias("index")
    return every.select("shard", "source_no", "nth", "size", index).mapInPandas(place, "shard long, slot long, source_no long, nth long")


def mix_shards(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", block_words: int = BLOCK_WORDS,
               seed: int = SEED, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The documents with sizes and targets, and the output shards: (documents, shards).

    documents: doc_id, source, source_no, size, source_size, target, first_word. shards, one row for each slot, kept in the scratch
    folder and with a `path` also written there: shard, slot, source_no, block, time, text (the block's words), from_word and counts (see
    `packed`). Rows with words have source_no and first_word to themselves, whatever their ids; `pieces` gives them for a row of a shard. A document without words is in no block.
    Null texts have no words; null ids and repeated rows are rows of their own; null sources are one source, the last one.
    A source's slots number its target divided by the block length, rounded to the nearest; slot n of a source takes block
    perm(n mod blocks), with another permutation for every turn, so no block is taken more often than MOST_TIMES.
    Sums per source go through the driver: their number is that of the sources, not of documents. `docs` is read twice: sizes, then texts.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.xxhash64(F.col(text)).alias("_hash"), F.col(text).alias("text"))
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    sized = stored(own.select("doc_id", "source", "_hash", words.alias("size")), "sizes")
    sums = {r["source"]: r["words"] for r in sized.groupBy("source").agg(F.sum("size").alias("words")).collect()}
    names = sorted((s for s in sums if s is not None)) + [None] * (None in sums)
    sizes = [sums[s] for s in names]
    goal = targets(sizes, weights, share)
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("source_no", T.LongType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])
    plan = spark.createDataFrame([(s, i, sizes[i], goal[i]) for i, s in enumerate(names)], schema)
    known = plan.withColumnRenamed("source", "_source")
    known = F.broadcast(known) if len(names) < 100_000 else known
    numbered = lambda df: df.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    blocks = [-(-n // block_words) for n in sizes]
    slots = [min(MOST_TIMES * b, round(g / (n / b))) if b else 0 for g, n, b in zip(goal, sizes, blocks, strict=True)]
    placed, groups, totals = positions(numbered(sized))
    texts = bucketed(numbered(own.where(F.col("text").isNotNull())).drop("source", "source_size", "target"), groups)
    starts = totals.select("source_no", "bucket", "before")
    texts = texts.join(F.broadcast(starts) if totals.count() < 100_000 else starts, ["source_no", "bucket"])
    n_blocks = np.array(blocks, np.int64)

    def to_block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            no, nth = pdf["source_no"].to_numpy(np.int64), pdf["nth"].to_numpy(np.int64)
            time = nth // n_blocks[no]
            pdf["block"] = permuted(nth % n_blocks[no], n_blocks[no], (no * 1000 + time) * 2_654_435_761 + seed)
            pdf["time"] = time
            yield pdf[["shard", "slot", "source_no", "block", "time"]]

    taken = drawn_slots(spark, pd.DataFrame({"slots": slots}), seed).mapInPandas(to_block, "shard long, slot long, source_no long, block long, time long")
    # of equal partitions, so that no side is broadcast on its compressed size
    slots = taken.hint("merge").join(homes(totals, block_words), ["source_no", "block"])
    return placed.drop("_hash"), written(packed(texts, slots, block_words), path)


def mix_blocks(docs: DataFrame, *columns: str, block_words: int = BLOCK_WORDS, **options) -> tuple[DataFrame, DataFrame]:
    """The documents as mix_shards has them, and what its shards hold of them: (documents, pieces).

    pieces: one row for each document's part of a slot: shard, slot, source_no, block, time, first_word, from_word, words.
    """
    marked, shards = mix_shards(docs, *columns, block_words=block_words, **options)
    return marked, shards.select("shard", "slot", "source_no", "block", "time", F.inline(pieces(block_words)))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words of it in the shards made, repeats counted)."""
    marked, pieces = mix_blocks(docs, doc_id, text, source, **options)
    taken = pieces.groupBy("source_no", "first_word").agg(F.sum("words").alias("taken"))
    joined = marked.join(taken, ["source_no", "first_word"], "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
