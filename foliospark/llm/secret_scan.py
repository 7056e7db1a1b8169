"""Secret scan: one minimised automaton for all rules, run over the bytes of many texts side by side."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import bound_batches, slices, utf8

#: Ends a text in the scanned buffer; it never occurs in UTF-8, so no rule goes across it.
STOP = 255
#: Texts are scanned in so many lanes at once.
LANES = 2048


class Rule:
    """A regular expression, kept as nested tuples: ("set", bytes), ("seq", a, b), ("alt", a, b), ("star", a), ("eps",)."""

    def __init__(self, node: tuple):
        self.node = node

    def __add__(self, other: Rule) -> Rule:
        return Rule(("seq", self.node, other.node))

    def __or__(self, other: Rule) -> Rule:
        return Rule(("alt", self.node, other.node))

    def star(self) -> Rule:
        return Rule(("star", self.node))

    def plus(self) -> Rule:
        return self + self.star()

    def maybe(self) -> Rule:
        return self | Rule(("eps",))

    def least(self, n: int) -> Rule:
        out = self.star()
        for _ in range(n):
            out = self + out
        return out


def one_of(chars: str) -> Rule:
    return Rule(("set", frozenset(chars.encode())))


def word(text: str, any_case: bool = False) -> Rule:
    out = None
    for c in text:
        step = one_of(c.lower() + c.upper() if any_case else c)
        out = step if out is None else out + step
    return out


LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


@dataclass(frozen=True)
class Kind:
    """A named rule. A match shorter than `least` bytes (of its tail after the last of `after`, if given) is dropped."""

    name: str
    rule: Rule
    least: int = 0
    tail: str = ""


def _keys() -> Rule:
    out = word("password", True) | word("passwd", True) | word("secret", True) | word("token", True)
    return out | (word("api", True) + one_of("_").maybe() + word("key", True))


_QUOTE, _BLANKS, _VALUE = one_of("\"'").maybe(), one_of(" ").star(), LOWER + UPPER + DIGITS + "+/_.=-"
#: The base rules, in the order in which spans of one start are listed, then the rules this method adds.
BASE_KINDS = (
    Kind("assign", _keys() + _QUOTE + _BLANKS + one_of(":=") + _BLANKS + _QUOTE + one_of(_VALUE).plus(), 6, _VALUE),
    Kind("access", word("AKIA") + one_of(UPPER + DIGITS).plus(), 20),
    Kind("hex", one_of(DIGITS + "abcdef").least(24)),
)
ADDED_KINDS = (
    Kind("pem", word("-----BEGIN ") + one_of(UPPER + " ").star() + word("PRIVATE KEY-----")),
    Kind("forge", word("gh") + one_of("pousr") + word("_") + one_of(LOWER + UPPER + DIGITS).plus(), 40),
    Kind("chat", word("xox") + one_of("abprs") + word("-") + one_of(LOWER + UPPER + DIGITS + "-").plus(), 15),
)
KINDS = BASE_KINDS + ADDED_KINDS


class _Nfa:
    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.step: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.step.append(None)
        return len(self.empty) - 1

    def add(self, node: tuple, into: int, back: bool) -> int:
        """Adds `node` so that what it matches leads to state `into`; gives its first state. back: reversed."""
        kind = node[0]
        if kind == "eps":
            return into
        if kind == "set":
            s = self.state()
            self.step[s] = (node[1], into)
            return s
        if kind == "seq":
            first, last = (node[2], node[1]) if back else (node[1], node[2])
            return self.add(first, self.add(last, into, back), back)
        s = self.state()
        if kind == "alt":
            self.empty[s] = [self.add(node[1], into, back), self.add(node[2], into, back)]
        else:
            self.empty[s] = [self.add(node[1], s, back), into]
        return s

    def closure(self, states: Iterable[int]) -> frozenset:
        seen, todo = set(), list(states)
        while todo:
            if (s := todo.pop()) not in seen:
                seen.add(s)
                todo += self.empty[s]
        return frozenset(seen)


def automaton(rules: list[Rule], search: bool, back: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Transition array (states x 256) and, for each state, the bits of the rules that end there. State 0 is the first.

    Subset construction, then minimisation by refining classes of states. search: a match may begin anywhere.
    In an anchored automaton the state that nothing leads out of is the last one with no bits.
    """
    nfa, ends, starts = _Nfa(), {}, []
    for i, rule in enumerate(rules):
        end = nfa.state()
        ends[end] = 1 << i
        starts.append(nfa.add(rule.node, end, back))
    first = nfa.closure(starts)
    number, order, rows = {first: 0}, [first], []
    for states in order:
        row = []
        moves = [nfa.step[s] for s in states if nfa.step[s]]
        cache: dict[frozenset, int] = {}
        for byte in range(256):
            targets = frozenset(t for chars, t in moves if byte in chars)
            if targets not in cache:
                got = nfa.closure(targets | (set(starts) if search else set()))
                if got not in number:
                    number[got] = len(order)
                    order.append(got)
                cache[targets] = number[got]
            row.append(cache[targets])
        rows.append(row)
    table = np.array(rows, np.int64)
    bits = np.array([sum({ends[s] for s in states if s in ends}) for states in order], np.int64)
    _, group = np.unique(bits, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([group, group[table]]), axis=0, return_inverse=True)
        if finer.max() == group.max():
            break
        group = finer
    # classes are numbered by their first state, so that the first state stays 0
    _, at = np.unique(group, return_index=True)
    rank = np.empty(len(at), np.int64)
    rank[np.argsort(at)] = np.arange(len(at))
    keep = np.sort(at)
    return rank[group[table[keep]]], bits[keep]


class Scanner:
    """All rules of `kinds` over a batch of texts in one pass."""

    def __init__(self, kinds: tuple[Kind, ...]):
        self.kinds = kinds
        table, self.bits = automaton([k.rule for k in kinds], search=True)
        self.table = (table * 256).astype(np.int32).ravel()
        self.reverse = []
        for k in kinds:
            t, b = automaton([k.rule], search=False, back=True)
            dead = next((s for s in range(len(t)) if not b[s] and (t[s] == s).all()), -1)
            self.reverse.append((t.tolist(), b.astype(bool).tolist(), dead))

    def states(self, buffer: np.ndarray) -> np.ndarray:
        """State after each byte. Lanes begin in the first state; where the lane before ends in another one,
        the lane's beginning is run again until both courses meet."""
        lanes = min(LANES, max(1, len(buffer) // 64))
        width = -(-len(buffer) // lanes)
        padded = np.full(lanes * width, STOP, np.uint8)
        padded[: len(buffer)] = buffer
        columns = np.ascontiguousarray(padded.reshape(lanes, width).T)
        course = np.empty((width, lanes), np.int32)
        now = np.zeros(lanes, np.int32)
        for i in range(width):
            now = self.table.take(now + columns[i])
            course[i] = now
        course = np.ascontiguousarray(course.T)
        for lane in range(1, lanes):
            s, row = int(course[lane - 1, -1]), course[lane]
            if s:
                for i, byte in enumerate(padded[lane * width : (lane + 1) * width].tolist()):
                    s = int(self.table[s + byte])
                    if s == row[i]:
                        break
                    row[i] = s
        return course.ravel()[: len(buffer)] >> 8

    def start_of(self, which: int, text: bytes, end: int, limit: int) -> int:
        """Leftmost start from `limit` on of a match that ends at `end`; -1 without one."""
        table, accepts, dead = self.reverse[which]
        s, found = 0, -1
        for at in range(end - 1, limit - 1, -1):
            s = table[s][text[at]]
            if s == dead:
                break
            if accepts[s]:
                found = at
        return found

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """For each text: (start, kind number, end) in code points, sorted."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
        b, o = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        if not len(b):
            return out
        at = o + np.arange(len(o))  # where texts begin in the buffer
        buffer = np.full(len(b) + len(o) - 1, STOP, np.uint8)
        own = np.ones(len(buffer), bool)
        own[at[1:] - 1] = False
        buffer[own] = b
        bits = self.bits[self.states(buffer)]
        hit = np.flatnonzero(bits)
        if not len(hit):
            return out
        follows = np.append(bits[1:], 0)[hit]
        for which, kind in enumerate(self.kinds):
            bit = 1 << which
            ends = hit[(bits[hit] & bit > 0) & (follows & bit == 0)] + 1
            docs = np.searchsorted(at, ends - 1, "right") - 1
            before, text, last = -1, b"", 0
            for end, doc in zip(ends.tolist(), docs.tolist(), strict=True):
                if doc != before:
                    before, text, last = doc, buffer[at[doc] : at[doc + 1] - 1].tobytes(), 0
                end -= int(at[doc])
                start = self.start_of(which, text, end, last)
                if start < 0:
                    continue
                last = end
                size = end - start
                if kind.tail:
                    size = len(text[start:end]) - len(text[start:end].rstrip(kind.tail.encode()))
                    # the value goes back to the separator at most, which may be a value character itself
                    size = min(size, end - start - _separator(text[start:end]))
                if size >= kind.least:
                    out[doc].append((start, which, end))
        for doc, found in enumerate(out):
            if found:
                found.sort()
                begins = (buffer[at[doc] : at[doc + 1] - 1] & 0xC0) != 0x80
                points = np.concatenate([[0], np.cumsum(begins)])
                out[doc] = [(int(points[s]), which, int(points[e])) for s, which, e in found]
        return out


def _separator(match: bytes) -> int:
    """Length of an assignment up to and including its first : or =."""
    return min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0) + 1


def find_secrets(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and spans: array of (kind, start, end) in code points, end exclusive, by start and then in the order of `kinds`.

    Matches of one kind are leftmost, as long as possible and don't overlap. A null text is an empty one and has no spans.
    One row for each input row; repeated rows and null ids are kept; other columns are not read.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    scanner = Scanner(kinds)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [k.name for k in kinds]
        kind_of = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            found = []
            for lo, hi in slices(offsets):
                found += scanner.spans(data, offsets[lo : hi + 1])
            flat = [x for spans in found for x in spans]
            values = pa.StructArray.from_arrays(
                [pa.array([names[x[1]] for x in flat], pa.string()), pa.array([x[0] for x in flat], pa.int64()), pa.array([x[2] for x in flat], pa.int64())],
                fields=list(kind_of))
            ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, values)], ["doc_id", "spans"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def secret_report(found: DataFrame) -> DataFrame:
    """Counts and digests of the spans of find_secrets: n_assign, n_access, n_hex, base_sha256, spans."""
    base = [k.name for k in BASE_KINDS]

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(name: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")

    return found.select("doc_id", *[of(n) for n in base], F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
