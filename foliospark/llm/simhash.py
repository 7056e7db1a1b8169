"""SimHash near duplicates: fingerprints, an exact search in Gray order, and linked groups."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import bound_batches, partitions, stored, utf8
from foliospark.llm.components import components

#: Words of a shingle, and differing bits up to which two fingerprints link.
SHINGLE_WORDS, MAX_BITS = 4, 4
#: The 64 bits are cut into so many blocks. At most MAX_BITS of them can hold a difference, so any two linked fingerprints
#: agree on BLOCKS - MAX_BITS blocks: each choice of so many blocks makes one table, whose equal blocks are its first level.
BLOCKS = 6
#: Fingerprints in a lowest node of the index, and lowest nodes in the node above.
LEAF, FAN = 64, 32
#: Larger groups of a table are cut into parts of so many fingerprints; every two parts meet in a task of their own.
PART = 1 << 14
#: Shingles hashed at once.
CHUNK = 1 << 16


def fingerprint(text: bytes, size: int = SHINGLE_WORDS) -> int:
    """64 majority bits of the XXH64 values (seed 42) of all shingles of the lower-cased words; no words: 0."""
    words = text.lower().split()  # of bytes: lower-cases A-Z only, splits at ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - size + 1)
    starts, ends = starts[:n].tolist(), (ends[size - 1 :] if len(words) >= size else ends[-1:]).tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for lo in range(0, n, CHUNK):
        hashes = np.array([digest(joined[s:e], 42) for s, e in zip(starts[lo : lo + CHUNK], ends[lo : lo + CHUNK], strict=True)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row. A null text counts as empty."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column(1))
            out = np.array([fingerprint(data[s:e].tobytes(), size) for s, e in zip(offs[:-1], offs[1:], strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return rows.mapInArrow(of, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp bigint")


def tables(blocks: int = BLOCKS, bits: int = MAX_BITS) -> list[tuple[np.ndarray, int]]:
    """For each table the order in which it takes the 64 bits (highest first), and how many of them are the equal blocks."""
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    out = []
    for chosen in combinations(range(blocks), blocks - bits):
        first = [b for i in chosen for b in range(cuts[i], cuts[i + 1])]
        out.append((np.array(first + [b for b in range(64) if b not in set(first)]), len(first)))
    return out


def permute(fps: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The bits (0 is the highest) in another order; runs of neighbouring bits move together."""
    out, at = np.zeros(len(fps), np.uint64), 0
    for run in np.split(order, np.flatnonzero(np.diff(order) != 1) + 1):
        width = len(run)
        part = (fps >> np.uint64(64 - int(run[-1]) - 1)) & np.uint64((1 << width) - 1)
        at += width
        out |= part << np.uint64(64 - at)
    return out


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Position of a bit pattern in the Gray code: neighbours in this order differ in few bits."""
    out = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayIndex:
    """Fingerprints in Gray order, in leaves of LEAF and nodes of FAN leaves.

    A node keeps the bits on which all its members agree (mask) and their pattern. What it shares with its node above is
    factored out: a search adds, level by level, the differences on the newly fixed bits and drops a node as soon as more
    than `bits` are reached.
    """

    def __init__(self, fps: np.ndarray):
        self.order = np.argsort(gray_rank(fps), kind="stable")
        self.fps = fps[self.order]
        self.leaf_at = np.arange(0, len(fps), LEAF)
        self.leaf_mask, self.leaf_bits = self._shared(self.leaf_at)
        self.node_at = np.arange(0, len(fps), LEAF * FAN)
        self.node_mask, self.node_bits = self._shared(self.node_at)
        node_of = self.leaf_at // (LEAF * FAN)
        self.rest_mask = self.leaf_mask & ~self.node_mask[node_of]
        self.node_of = node_of

    def _shared(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        all_ones, any_one = np.bitwise_and.reduceat(self.fps, at), np.bitwise_or.reduceat(self.fps, at)
        return all_ones | ~any_one, all_ones

    def near_leaves(self, mask: np.uint64, pattern: np.uint64, bits: int, wanted: np.ndarray) -> np.ndarray:
        """Leaves (of those wanted) that may hold a member within `bits` of a group given by its shared mask and pattern."""
        upper = np.bitwise_count((self.node_bits ^ pattern) & self.node_mask & mask)
        leaves = np.flatnonzero(wanted & (upper <= bits)[self.node_of])
        more = np.bitwise_count((self.leaf_bits[leaves] ^ pattern) & self.rest_mask[leaves] & mask)
        return leaves[upper[self.node_of[leaves]] + more <= bits]


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def linked(fps: np.ndarray, bits: int = MAX_BITS, split: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Positions i, j of links that connect whatever links within `bits` connect; at most one for each fingerprint.

    split > 0: only links between the first `split` fingerprints and the others count as unknown, the two sides are
    searched against each other. Nodes that are wholly in one group already are not compared again.
    """
    index = GrayIndex(fps)
    n, sorted_fps = len(fps), index.fps
    label = np.arange(n)
    side = index.order < split
    n_leaves = len(index.leaf_at)
    ends = np.append(index.leaf_at[1:], n)
    left, right = [], []
    for leaf in range(n_leaves):
        lo, hi = int(index.leaf_at[leaf]), int(ends[leaf])
        # leaves of one label each are joined already if the labels are equal
        low, high = np.minimum.reduceat(label, index.leaf_at), np.maximum.reduceat(label, index.leaf_at)
        wanted = np.arange(n_leaves) >= leaf
        if low[leaf] == high[leaf]:
            wanted &= ~((low == low[leaf]) & (high == low[leaf]))
        near = index.near_leaves(index.leaf_mask[leaf], index.leaf_bits[leaf], bits, wanted)
        if not len(near):
            continue
        others = (index.leaf_at[near][:, None] + np.arange(LEAF)).ravel()
        others = others[others < n]
        close = np.bitwise_count(sorted_fps[lo:hi, None] ^ sorted_fps[None, others]) <= bits
        close &= label[lo:hi, None] != label[None, others]
        if split:
            close &= side[lo:hi, None] != side[None, others]
        i, j = np.nonzero(close)
        if not len(i):
            continue
        pairs = np.column_stack([label[lo + i], label[others[j]]])
        pairs.sort(axis=1)
        _, one = np.unique(pairs[:, 0] * n + pairs[:, 1], return_index=True)
        parent: dict[int, int] = {}
        known = lambda x: parent.setdefault(x, x)
        for k in one.tolist():
            a, b = (int(x) for x in pairs[k])
            known(a), known(b)
            a, b = _find(parent, a), _find(parent, b)
            if a != b:
                parent[max(a, b)] = min(a, b)
                left.append(lo + int(i[k]))
                right.append(int(others[j[k]]))
        old = np.array(sorted(parent))
        new = np.array([_find(parent, int(x)) for x in old])
        at = np.searchsorted(old, label)
        at[at == len(old)] = 0
        label = np.where(old[at] == label, new[at], label)
    return index.order[np.array(left, np.int64)], index.order[np.array(right, np.int64)]


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of equal neighbours."""
    at = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1]) if len(keys) else np.zeros(0, np.int64)
    return at, np.diff(np.append(at, len(keys)))


def _small_links(fps: np.ndarray, at: np.ndarray, size: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups of up to LEAF fingerprints that lie one after another: all groups are compared step by step."""
    group_end = np.repeat(at + size, size)
    i = np.repeat(at, size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
    left, right, step = [], [], 1
    while True:
        ok = i + step < group_end
        i, group_end = i[ok], group_end[ok]
        if not len(i):
            break
        near = np.bitwise_count(fps[i] ^ fps[i + step]) <= bits
        left.append(i[near])
        right.append(i[near] + step)
        step += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def links(fps: DataFrame, bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """Links a, b between distinct fingerprints (column fp) that connect all that differ in at most `bits` bits.

    Every table puts its equal blocks in front; fingerprints equal there meet in one group, sorted by Gray rank and searched
    through the hierarchical index. Groups over PART fingerprints are cut into parts: each pair of parts is a task's work.
    """
    spec = tables(blocks, bits)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for number, (order, width) in enumerate(spec):
                moved = permute(values, order)
                key = (np.uint64(number) << np.uint64(width)) | (moved >> np.uint64(64 - width))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(values.view(np.int64))], ["key", "fp"])

    rows = stored(fps.select("fp").mapInArrow(keyed, "key bigint, fp bigint"), "tables")
    sizes = rows.groupBy("key").count()
    # of at most rows / PART keys; the join is with a measured side
    large = stored(sizes.where(F.col("count") > PART).select("key", F.ceil(F.col("count") / PART).cast("int").alias("parts")), "groups")
    if large.isEmpty():
        small, pieces = rows, None
    else:
        small = rows.join(large, "key", "left_anti")
        cut = rows.join(large, "key").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        # part p meets part q >= p in the piece (p, q)
        other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q")
        pieces = cut.select("key", "fp", "part", other).select(
            "key", F.least("part", "q").alias("p"), F.greatest("part", "q").alias("q"), F.col("part"), "fp")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by key; a key's rows may go on in the next batch."""
        rest_key, rest_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in chain(_one_by_one(batches), [None]):
            if batch is not None:
                rest_key = np.concatenate([rest_key, batch.column(0).to_numpy(zero_copy_only=False)])
                rest_fp = np.concatenate([rest_fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
                done = int(np.searchsorted(rest_key, rest_key[-1])) if len(rest_key) else 0
            else:
                done = len(rest_key)
            key, fp, rest_key, rest_fp = rest_key[:done], rest_fp[:done], rest_key[done:], rest_fp[done:]
            at, size = runs(key)
            few = (size > 1) & (size <= LEAF)
            i, j = _small_links(fp, at[few], size[few], bits)
            left, right = [fp[i]], [fp[j]]
            for lo, n in zip(at[size > LEAF].tolist(), size[size > LEAF].tolist(), strict=True):
                i, j = linked(fp[lo : lo + n], bits)
                left.append(fp[lo + i])
                right.append(fp[lo + j])
            a, b = np.concatenate(left), np.concatenate(right)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    found = small.repartition(partitions(small), "key").sortWithinPartitions("key").mapInArrow(search, "a bigint, b bigint")
    if pieces is not None:

        def meet(table: pa.Table) -> pa.Table:
            part = table.column("part").to_numpy()
            same = table.column("p")[0].as_py() == table.column("q")[0].as_py()
            order = np.argsort(part != table.column("p")[0].as_py(), kind="stable")
            fp = table.column("fp").to_numpy().view(np.uint64)[order]
            i, j = linked(fp, bits, 0 if same else int((part == table.column("p")[0].as_py()).sum()))
            return pa.table({"a": fp[i].view(np.int64), "b": fp[j].view(np.int64)})

        found = found.unionByName(pieces.groupBy("key", "p", "q").applyInArrow(meet, "a bigint, b bigint"))
    return found


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from (b for b in batches if b.num_rows)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits) and component_id, the smallest id reachable over links.

    A null text is an empty one, whose fingerprint 0 links like any other. Null ids count as the largest: a component of
    null ids only has a null component_id. Repeated rows are kept. An empty table gives an empty result.
    """
    own = stored(fingerprints(docs, doc_id, text), "fingerprints")
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    groups = components(links(distinct, bits))
    member = distinct.join(groups.withColumnRenamed("node", "fp"), "fp")
    least = member.groupBy("component").agg(F.min("least").alias("component_id"))
    linked_fps = member.join(least, "component").select("fp", "component_id")
    whole = distinct.join(linked_fps, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    # a stored side leaves the join with two plain shuffles, so that adaptive execution can split a hot fingerprint's rows
    return own.join(stored(whole, "whole"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
