"""Benchmark decontamination by winnowing, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import stored

#: Words of a window; words of a k-gram. A shared window holds WINDOW - K + 1 k-grams, of which the least hash is kept on both sides.
WINDOW, K = 13, 5
#: A document with at least this share of its words hit is contaminated: 1 in 20.
ONE_IN = 20
#: Bits of the benchmark's bitmap for each of its fingerprints, and the largest bitmap (2 MB). Beyond it more documents are looked
#: at for nothing; results stay exact.
BITS_PER_FINGERPRINT, MAX_BITS = 256, 1 << 24
#: Benchmark windows that are broadcast at most; more are joined by a shuffle.
MAX_BROADCAST = 200_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once; a plain column in a lambda function would be computed for every element."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words of the text with A-Z lower-cased; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), "")


def upto(n: Column) -> Column:
    """0, 1, ... n - 1; empty if n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def grams(hashes: Column, k: int) -> Column:
    """Hash of each k consecutive word hashes."""
    return F.transform(upto(F.size(hashes) - (k - 1)), lambda i: F.xxhash64(F.slice(hashes, i + 1, F.lit(k))))


def winnowed(hashes: Column, width: int) -> Column:
    """The least of every `width` consecutive k-gram hashes, each value once."""
    return F.array_distinct(F.transform(upto(F.size(hashes) - (width - 1)), lambda i: F.array_min(F.slice(hashes, i + 1, F.lit(width)))))


def _cells(fingerprint: Column, bits: int) -> list[Column]:
    return [F.pmod(fingerprint, F.lit(bits)), F.pmod(F.shiftrightunsigned(fingerprint, 24), F.lit(bits))]


def _bitmap(fingerprints: DataFrame, bits: int) -> DataFrame:
    """One row: array of longs that holds both cells of every fingerprint."""
    cells = fingerprints.select(F.explode(F.array(*_cells(F.col("f"), bits))).alias("cell"))
    longs = cells.groupBy(F.shiftright("cell", 6).alias("id")).agg(F.expr("bit_or(shiftleft(1L, cast(cell % 64 as int)))").alias("bits"))
    every = fingerprints.sparkSession.range(bits // 64).join(longs, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("map"))


def _inside(fingerprint: Column, bitmap: Column, bits: int) -> Column:
    one, two = [bitmap[F.shiftright(c, 6).cast("int")].bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (c % 64).cast("int"))) != 0 for c in _cells(fingerprint, bits)]
    return one & two


def benchmark_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """item (the id as text, empty if null), n_words of the item, size and window (text) of each distinct window of an item."""
    own = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    pieces = let(F.col("w"), lambda w: F.transform(upto(F.size(w) - F.least(F.size(w), F.lit(window)) + 1), lambda i: F.array_join(F.slice(w, i + 1, F.least(F.size(w), F.lit(window))), " ")))
    return own.select("item", size.alias("size"), F.explode(pieces).alias("window")).distinct()


def _fingerprints(benchmark: DataFrame, text: str, sizes: list[int], window: int, k: int) -> DataFrame:
    own = benchmark.select(F.transform(words(F.col(text)), lambda x: F.xxhash64(x)).alias("h"))
    long = let(F.col("h"), lambda h: let(grams(h, k), lambda g: winnowed(g, window - k + 1)))
    kinds = [own.where(F.size("h") >= window).select(F.explode(long).alias("f"))] if window in sizes else []
    kinds += [own.where(F.size("h") == n).select(F.xxhash64("h").alias("f")) for n in sizes if n < window]
    out = kinds[0]
    for x in kinds[1:]:
        out = out.union(x)
    return out.distinct()


def _near_windows(w: Column, bitmap: Column, bits: int, sizes: list[int], window: int, k: int) -> Column:
    """Windows (start, size, window) of a document around its fingerprints that the benchmark's bitmap holds."""

    def of_starts(starts: Column, n: int) -> Column:
        return F.transform(starts, lambda s: F.struct(s.alias("start"), F.lit(n).alias("size"), F.array_join(F.slice(w, s + 1, F.lit(n)), " ").alias("window")))

    def long(h: Column) -> Column:
        def around(g: Column, hits: Column) -> Column:
            places = F.filter(upto(F.size(g)), lambda p: F.array_contains(hits, g[p]))
            starts = F.transform(places, lambda p: F.sequence(F.greatest(p - (window - k), F.lit(0)), F.least(p, F.size(h) - window)))
            return of_starts(F.array_distinct(F.flatten(starts)), window)

        def extended(g: Column, hits: Column) -> Column:
            return F.when(F.size(hits) > 0, around(g, hits)).otherwise(of_starts(F.array().cast("array<int>"), window))

        return let(grams(h, k), lambda g: let(F.filter(winnowed(g, window - k + 1), lambda f: _inside(f, bitmap, bits)), lambda hits: extended(g, hits)))

    def short(h: Column, n: int) -> Column:
        return let(grams(h, n), lambda g: of_starts(F.filter(upto(F.size(g)), lambda p: _inside(g[p], bitmap, bits)), n))

    return let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.concat(*[long(h) if n == window else short(h, n) for n in sizes]))


def find_contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                       item_text: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside a window of an item), items (sorted ids as text).

    A window is `window` consecutive words of an item, or all of a shorter one. Both sides keep the least k-gram hash of each
    window (for short items the hash of the whole item), so every shared window shares a kept hash. Documents that hold a
    kept hash of the benchmark are extended around it: the windows there are joined with the benchmark's by their words.
    Null texts have no words; items without words are left out; null ids and repeated rows are rows of their own; an item id
    that occurs twice is one item. Without items nothing is hit.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(doc_id), F.col(text)).alias("_key"), words(F.col(text)).alias("w"))
    windows = stored(benchmark_windows(benchmark, item_id, item_text, window), "windows")
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # at most `window` numbers
    if not sizes:
        return own.select("doc_id", F.size("w").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    prints = stored(_fingerprints(benchmark, item_text, sizes, window, k), "fingerprints")
    bits = 1 << max(10, min(prints.count() * BITS_PER_FINGERPRINT, MAX_BITS) - 1).bit_length()
    near = let(F.col("_map"), lambda m: let(F.col("w"), lambda w: _near_windows(w, m, bits, sizes, window, k)))
    found = stored(own.withColumn("_map", stored(_bitmap(prints, bits), "bitmap").scalar()).select("doc_id", "_key", F.size("w").cast("long").alias("n_words"), near.alias("near")), "near")
    texts = windows.select("size", "window").distinct()
    small = windows.count() <= MAX_BROADCAST
    at = found.where(F.size("near") > 0).select("doc_id", "_key", F.explode("near").alias("n")).select("doc_id", "_key", "n.*").distinct()
    hits = stored(at.join(F.broadcast(texts) if small else texts, ["size", "window"]), "hits")
    ordered = F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("size")).alias("end"))))
    union = F.aggregate(
        ordered, F.struct(F.lit(0).alias("upto"), F.lit(0).alias("hit")),
        lambda a, x: F.struct(F.greatest(a["upto"], x["end"]).alias("upto"), (a["hit"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["upto"], x["start"]))).alias("hit")))
    n_hit = hits.groupBy("doc_id", "_key").agg(union["hit"].cast("long").alias("n_hit"))
    by_item = hits.select("doc_id", "_key", "size", "window").distinct().join(F.broadcast(windows) if small else windows, ["size", "window"])
    items = by_item.groupBy("doc_id", "_key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    both = n_hit.join(items, n_hit["_key"].eqNullSafe(items["_key"]) & n_hit["doc_id"].eqNullSafe(items["doc_id"])).select(
        n_hit["doc_id"].alias("_id"), n_hit["_key"].alias("_k"), "n_hit", "items")
    rows = found.select("doc_id", "_key", "n_words").join(both, (F.col("_key") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return rows.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contamination_report(found: DataFrame, one_in: int = ONE_IN) -> DataFrame:
    """Adds n_items, items_sha256 and contaminated to find_contamination."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated(one_in).alias("contaminated"))


def contaminated(one_in: int = ONE_IN) -> Column:
    return (F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS t
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
dw AS (SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS t
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw))),
h AS MATERIALIZED (SELECT dw.r, dw.s, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.t = iw.t),
p AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM h) GROUP BY r),
q AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN q USING (r)
"""
