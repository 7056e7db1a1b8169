"""Merkle manifest of a dataset: leaf coordinates by ranks in merged id bitmaps, levels reduced in arrays of slots."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import bound_batches, stored
from foliospark.operators.groups import join_null_safe
from foliospark.operators.scan import running

#: Ids of one compressed bitmap, and of one entry of its popcount directory.
CHUNK_BITS, WORD_BITS = 16, 6
#: Levels of the tree that one array of slots reduces: it has up to 2 ** LEVELS nodes.
LEVELS = 10
#: Leaves whose ids a task gathers before it sends their bitmaps on.
GATHERED = 1 << 20
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def framed(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*(framed(c) for c in (doc_id, source, lang, n_chars, text))), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """row (a number of its own), doc_id, lang, leaf, altered (the leaf after tampering, null where nothing is tampered with).

    Tampering adds 1 to n_chars where 7 divides the crc32 of the decimal doc_id; a null doc_id or n_chars stays as it is.
    """
    doc_id, source, lang, n_chars, text = (F.col(c) for c in FIELDS)
    more = n_chars.cast("decimal(38,0)") + 1
    hit = (F.crc32(doc_id.cast("string")) % 7 == 0) & n_chars.isNotNull()
    return docs.select(
        F.monotonically_increasing_id().alias("row"), doc_id.cast("long").alias("doc_id"), lang.cast("string").alias("lang"),
        leaf(doc_id, source, lang, n_chars, text).alias("leaf"), F.when(hit, leaf(doc_id, source, lang, more, text)).alias("altered"))


def id_bitmaps(rows: DataFrame) -> DataFrame:
    """lang, chunk (doc_id >> CHUNK_BITS), bitmap (zstd), repeats (array of low id bits and further rows of that id), n (all rows).

    A task sends one compressed bitmap for each of its chunks; those of a chunk are merged, whichever tasks have its ids.
    """
    size = 1 << CHUNK_BITS
    schema = "lang string, chunk long, bitmap binary, repeats array<struct<low:int,more:long>>, n long"

    def pack(lang: str | None, chunk: int, low: np.ndarray, times: np.ndarray) -> tuple:
        """`low` ascends, without repeats."""
        bits = np.zeros(size, bool)
        bits[low] = True
        again = np.flatnonzero(times > 1)
        more = [{"low": int(a), "more": int(b) - 1} for a, b in zip(low[again], times[again], strict=True)]
        return lang, chunk, zstandard.compress(np.packbits(bits, bitorder="little").tobytes(), 3), more, int(times.sum())

    def batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.binary(), pa.list_(pa.struct([("low", pa.int32()), ("more", pa.int64())])), pa.int64())
        columns = zip(*out, strict=True) if out else ([],) * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["lang", "chunk", "bitmap", "repeats", "n"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, list[np.ndarray]] = {}
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal count
            for lang, parts in held.items():
                ids, times = np.unique(np.concatenate(parts), return_counts=True)
                edges = [0, *(np.flatnonzero(np.diff(ids >> CHUNK_BITS)) + 1).tolist(), len(ids)]
                for at in range(0, len(edges) - 1, 256):
                    cuts = edges[at : at + 257]
                    yield batch([pack(lang, int(ids[a] >> CHUNK_BITS), ids[a:b] & (size - 1), times[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)])
            held.clear()
            count = 0

        for rows in batches:
            ids, langs = rows.column("doc_id").to_numpy(), rows.column("lang").dictionary_encode()
            code = langs.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            for c in np.unique(code):
                held.setdefault(None if c < 0 else langs.dictionary[int(c)].as_py(), []).append(ids[code == c])
            count += len(ids)
            if count >= GATHERED:
                yield from flush()
        yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None

        def close() -> list[tuple]:
            low = np.flatnonzero(total)
            return [pack(*key, low, total[low])] if key is not None else []

        for rows in batches:
            out = []
            for r in rows.to_pylist():
                if (r["lang"], r["chunk"]) != key:
                    out += close()
                    key, total = (r["lang"], r["chunk"]), np.zeros(size, np.int64)
                total += np.unpackbits(np.frombuffer(zstandard.decompress(r["bitmap"]), np.uint8), bitorder="little")
                for x in r["repeats"]:
                    total[x["low"]] += x["more"]
            yield batch(out)
        yield batch(close())

    parts = rows.where("doc_id IS NOT NULL").select("lang", "doc_id").mapInArrow(gather, schema)
    return parts.repartition("lang", "chunk").sortWithinPartitions("lang", "chunk").mapInArrow(merge, schema)


def directory(bitmaps: DataFrame) -> DataFrame:
    """lang, word (doc_id >> WORD_BITS), bits (of the ids there), repeats (of them), before (rows of the language with smaller ids there
    are before this word's). Only words with ids have a row."""
    # chunks are summed in ordered runs, so that no task has all chunks of a language
    ordered = running(bitmaps.select("lang", "chunk", "n"), ["lang"], ["chunk"], F.shiftright("chunk", 10), {"upto": ("sum", F.col("n"))})
    based = join_null_safe(bitmaps, ordered.select("lang", "chunk", "upto"), ["lang", "chunk"]).withColumn("base", F.col("upto") - F.col("n"))
    words = 1 << (CHUNK_BITS - WORD_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for r in rows.to_pylist():
                packed = np.frombuffer(zstandard.decompress(r["bitmap"]), np.int64)
                times = np.bitwise_count(packed.view(np.uint64)).astype(np.int64)
                again: list[list[dict] | None] = [None] * words
                for x in r["repeats"]:
                    w = x["low"] >> WORD_BITS
                    times[w] += x["more"]
                    again[w] = [*(again[w] or []), {"bit": x["low"] & ((1 << WORD_BITS) - 1), "more": x["more"]}]
                before = r["base"] + np.cumsum(times) - times
                at = np.flatnonzero(times)
                yield pa.RecordBatch.from_arrays([
                    pa.array([r["lang"]] * len(at), pa.string()), pa.array((r["chunk"] * words) + at, pa.int64()), pa.array(packed[at]),
                    pa.array([again[i] for i in at], pa.list_(pa.struct([("bit", pa.int32()), ("more", pa.int64())]))), pa.array(before[at], pa.int64())],
                    ["lang", "word", "bits", "repeats", "before"])

    return based.select("lang", "chunk", "bitmap", "repeats", "base").mapInArrow(
        count, "lang string, word long, bits long, repeats array<struct<bit:int,more:long>>, before long")


def tie_ranks(rows: DataFrame) -> DataFrame:
    """row, tie: rows that share language and doc_id numbered from 0 by leaf; equal leaves in any order.

    Different leaves are counted before any order is made, in runs by their first digits; the copies of one leaf are counted by the task
    that wrote them. So however many rows share an id, no task has them all.
    """
    key = ["lang", "doc_id"]
    part = F.shiftright("row", 33)
    counts = stored(rows.groupBy(*key, "leaf").agg(F.count("*").alias("n")), "ties")
    upto = running(counts, key, ["leaf"], F.conv(F.substring("leaf", 1, 4), 16, 10).cast("long"), {"upto": ("sum", F.col("n"))})
    parts = rows.groupBy(*key, "leaf", part.alias("part")).agg(F.count("*").alias("own"))
    before = F.sum("own").over(Window.partitionBy(*key, "leaf").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("earlier", F.coalesce(before, F.lit(0))).drop("own")
    inside = F.row_number().over(Window.partitionBy(*key, "leaf", "part").orderBy("row")) - 1
    placed = join_null_safe(rows.withColumn("part", part).withColumn("inside", inside), parts, [*key, "leaf", "part"])
    placed = join_null_safe(placed, upto.withColumn("start", F.col("upto") - F.col("n")).select(*key, "leaf", "start"), [*key, "leaf"])
    return placed.select("row", (F.col("start") + F.col("earlier") + F.col("inside")).alias("tie"))


def coordinates(rows: DataFrame) -> DataFrame:
    """Adds `at`, the place of a leaf in its language from 0: null ids first, then by doc_id, equal ids by leaf.

    A leaf asks the directory's entry of its id for the rows before it and counts the bits below its own.
    """
    bitmaps = stored(id_bitmaps(rows), "bitmaps")
    entries = directory(bitmaps)
    bit = F.col("doc_id").bitwiseAND((1 << WORD_BITS) - 1).cast("int")
    asked = join_null_safe(rows.withColumn("word", F.shiftright("doc_id", WORD_BITS)), entries.hint("shuffle_hash"), ["lang", "word"], "left")
    below = F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), bit))))
    earlier = F.aggregate("repeats", F.lit(0).cast("long"), lambda a, x: a + F.when(x["bit"] < bit, x["more"]).otherwise(0))
    shared = F.exists("repeats", lambda x: x["bit"] == bit)
    rank = F.col("before") + below + F.coalesce(earlier, F.lit(0))
    ranked = asked.select(*rows.columns, rank.alias("rank"), (F.coalesce(shared, F.lit(False)) | F.col("doc_id").isNull()).alias("shared"))
    ranked = stored(ranked, "ranked")
    if ranked.where("shared").isEmpty():
        return ranked.select(*rows.columns, F.col("rank").alias("at"))
    none = ranked.where("doc_id IS NULL").groupBy("lang").agg(F.count("*").alias("none"))
    ranked = join_null_safe(ranked, none, ["lang"], "left")
    ranked = ranked.join(tie_ranks(ranked.where("shared").select(*rows.columns)), "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    place = F.when(F.col("doc_id").isNull(), 0).otherwise(zero(F.col("none")) + zero(F.col("rank")))
    return ranked.select(*rows.columns, (place + zero(F.col("tie"))).alias("at"))


def node(*children: str) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def levels_of(nodes: list[str], whole: bool) -> list[list[str]]:
    """The levels of a slot array, its nodes first. `whole`: it is all there is of its group, so it ends with one node; else it is reduced by
    LEVELS levels, a last lone node with them."""
    out = [nodes]
    while len(out[-1]) > 1 if whole else len(out) <= LEVELS:
        now = out[-1]
        out.append([node(*now[i : i + 2]) for i in range(0, len(now), 2)])
    return out


def siblings(levels: list[list[str]], at: int) -> list[str]:
    """What a slot and its parents are hashed with, below the array's last level: L or R and the digest to their left or right, or `-`."""
    out = []
    for level in levels[:-1]:
        other = at ^ 1
        out.append(("L" if at & 1 else "R") + level[other] if other < len(level) else "-")
        at >>= 1
    return out


def folded(digest: str, path: list[str]) -> str:
    """The digest above `path` that follows from `digest`."""
    for step in path:
        digest = node(step[1:], digest) if step[0] == "L" else node(digest, step[1:])
    return digest


def slot_arrays(nodes: DataFrame, *more: str) -> DataFrame:
    """group, at, digest -> group, block, count (of the group), slots: the nodes of a group cut into arrays of 2 ** LEVELS slots, in order."""
    counts = nodes.groupBy("group").agg((F.max("at") + 1).alias("count"))
    slot = F.struct(F.col("at").bitwiseAND((1 << LEVELS) - 1).cast("int").alias("slot"), "digest", *more)
    arrays = nodes.groupBy("group", F.shiftright("at", LEVELS).alias("block")).agg(F.array_sort(F.collect_list(slot)).alias("slots"))
    return join_null_safe(arrays, counts, ["group"])


def reduce_levels(nodes: DataFrame, *more: str) -> tuple[list[DataFrame], DataFrame]:
    """The stored slot arrays of all rounds, the first round's (with the columns `more`) first, and each group's top node: group, at, digest."""

    @F.udf("string")
    def top(digests, count):
        return levels_of(list(digests), count <= 1 << LEVELS)[-1][0]

    rounds = []
    while True:
        rounds.append(stored(slot_arrays(nodes, *more), "slots"))
        more = ()
        nodes = stored(rounds[-1].select("group", F.col("block").alias("at"), top("slots.digest", "count").alias("digest")), "nodes")
        if nodes.where("at > 0").isEmpty():
            return rounds, nodes


def paths_down(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """group, at, path for the slots of all rounds given; `tops`: group, at, path of the last round's nodes."""

    @F.udf("array<string>")
    def inside(digests, count):
        levels = levels_of(list(digests), count <= 1 << LEVELS)
        return [",".join(siblings(levels, i)) for i in range(len(digests))]

    for arrays in reversed(rounds):
        above = join_null_safe(arrays, tops.withColumnRenamed("at", "block"), ["group", "block"])
        steps = F.posexplode(inside("slots.digest", "count")).alias("slot", "own")
        tops = above.select("group", "block", "path", steps).select(
            "group", (F.col("block") * (1 << LEVELS) + F.col("slot")).alias("at"), F.concat_ws(",", F.nullif("own", F.lit("")), F.nullif("path", F.lit(""))).alias("path"))
    return tops


def proofs(arrays: DataFrame, above: DataFrame, root: str) -> DataFrame:
    """A row for each leaf of the slot arrays. `above`: group, block, path from each array's top to the root, subroot."""

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for r in rows.to_pylist():
                slots = r["slots"]
                levels = levels_of([s["digest"] for s in slots], r["count"] <= 1 << LEVELS)
                upper = r["path"].split(",") if r["path"] else []
                out = []
                for i, s in enumerate(slots):
                    path = [*siblings(levels, i), *upper]
                    proof = node(*(step[1:] for step in path))
                    out.append((s["doc_id"], s["digest"], r["subroot"], proof, folded(s["altered"] or s["digest"], path)))
                kinds = (pa.int64(), *[pa.string()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                                                 ["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"])

    rows = join_null_safe(arrays, above, ["group", "block"]).select("slots", "count", "path", "subroot").mapInArrow(
        prove, "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string")
    return rows.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of `docs` (doc_id, source, lang, n_chars, text).

    All digests are lowercase hex SHA-256. A leaf hashes the row's fields (see `framed`); a language's leaves, by doc_id, are hashed in
    runs of two until one node, the subroot, is left; the subroots, null language first, then by the names' bytes, give the root
    likewise. folded_root recomputes the root from the row's leaf, after tampering where it is tampered with, and its siblings.
    Null ids come first in their language; rows that share id and language go by leaf, so repeated rows are leaves of their own. A null
    doc_id is never tampered with. Other columns are ignored; an empty table gives no rows.

    Texts are read once and hashed where they are; what moves is a digest for each row. Leaves get their places from id bitmaps, in arrays of
    2 ** LEVELS slots; a round reduces an array to one node. Languages meet in one task as one row each.
    """
    bound_batches(docs.sparkSession)
    rows = stored(leaves(docs), "leaves")
    if rows.isEmpty():
        return docs.sparkSession.createDataFrame([], MANIFEST)
    placed = coordinates(rows).select(F.col("lang").alias("group"), "at", F.col("leaf").alias("digest"), "doc_id", "altered")
    rounds, subroots = reduce_levels(placed, "doc_id", "altered")
    ranked = subroots.select("group", "digest", (F.row_number().over(Window.orderBy(F.asc_nulls_first("group"))) - 1).cast("long").alias("place"))
    ranked = stored(ranked, "languages")
    all_of = ranked.select(F.lit("all").alias("group"), F.col("place").alias("at"), "digest")
    upper, roots = reduce_levels(all_of)
    root = roots.first()["digest"]
    by_place = paths_down(upper, roots.select("group", "at", F.lit("").alias("path"))).select(F.col("at").alias("place"), "path")
    subroot_of = stored(ranked.join(by_place, "place").select("group", F.lit(0).cast("long").alias("at"), "path", F.col("digest").alias("subroot")), "subroots")
    above = paths_down(rounds[1:], subroot_of.drop("subroot")).withColumnRenamed("at", "block")
    return proofs(rounds[0], join_null_safe(above, subroot_of.select("group", "subroot"), ["group"]), root)


MANIFEST = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), T.StructField("verified", T.BooleanType())])

#: Levels are unrolled by recursion; ties as in `manifest`.
ORACLE_SQL = """
WITH RECURSIVE bits AS (
  SELECT i AS byte, 0 AS k, i AS v FROM range(256) t(i)
  UNION ALL SELECT byte, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8
), crcs AS (SELECT list(v ORDER BY byte) AS crc FROM bits WHERE k = 8
), fields AS (
  SELECT doc_id, lang, n_chars, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') AS f_id, coalesce(strlen(source) || ':' || source, '-') AS f_source,
    coalesce(strlen(lang) || ':' || lang, '-') AS f_lang, coalesce(strlen(text) || ':' || text, '-') AS f_text,
    xor(4294967295, list_reduce([4294967295] || list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint), lambda c, x: xor(c >> 8, crc[xor(c & 255, x) + 1]))) AS crc32_of
  FROM documents, crcs
), base AS (
  SELECT doc_id, lang, crc32_of, sha256(concat(f_id, f_source, f_lang, coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-'), f_text)) AS leaf,
    sha256(concat(f_id, f_source, f_lang, coalesce(strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1), '-'), f_text)) AS altered FROM fields
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM base
), tree AS (
  SELECT lang, 0 AS level, pos, leaf AS h, n FROM leaves
  UNION ALL
  SELECT lang, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 1) // 2) FROM tree WHERE n > 1 GROUP BY lang, level, pos // 2
), subroots AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1
), top AS (
  SELECT 0 AS level, pos, subroot AS h, n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 1) // 2) FROM top WHERE n > 1 GROUP BY level, pos // 2
), steps AS (
  SELECT lang, level, pos, h, n, 0 AS part FROM tree WHERE n > 1
  UNION ALL SELECT NULL, level, pos, h, n, 1 FROM top WHERE n > 1
), start AS (
  SELECT l.*, s.subroot, s.pos AS place, CASE WHEN crc32_of % 7 = 0 THEN altered ELSE leaf END AS told FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
), walk AS (
  SELECT doc_id, leaf, subroot, lang, place, 0 AS part, 0 AS level, pos, n, '' AS proof, told AS h FROM start
  UNION ALL
  SELECT w.doc_id, w.leaf, w.subroot, w.lang, w.place,
    CASE WHEN w.n > 1 THEN w.part ELSE w.part + 1 END,
    CASE WHEN w.n > 1 THEN w.level + 1 ELSE 0 END,
    CASE WHEN w.n > 1 THEN w.pos // 2 ELSE w.place END,
    CASE WHEN w.n > 1 THEN (w.n + 1) // 2 WHEN w.part = 0 THEN (SELECT count(*) FROM subroots) ELSE 0 END,
    w.proof || CASE WHEN w.n > 1 THEN coalesce(s.h, '') ELSE '' END,
    CASE WHEN w.n > 1 THEN sha256(CASE WHEN w.pos % 2 = 1 THEN s.h || w.h ELSE w.h || coalesce(s.h, '') END) ELSE w.h END
  FROM walk w LEFT JOIN steps s ON w.n > 1 AND s.part = w.part AND s.level = w.level AND s.pos = xor(w.pos, 1) AND (w.part = 1 OR s.lang IS NOT DISTINCT FROM w.lang)
  WHERE w.part < 2
)
SELECT doc_id, leaf, subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = (SELECT h FROM top WHERE n = 1) AS verified
FROM walk WHERE part = 2
"""
