"""SimHash groups, components, decontamination and licences against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from foliospark.llm import contamination, licenses, simhash
from foliospark.llm.components import components


def plain_fingerprint(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]).encode(), 42) for i in range(max(1, len(words) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(fps, bits=4):
    """Smallest position reachable over links, by all pairs."""
    fps = np.array(fps, np.uint64)
    group = np.arange(len(fps))
    while True:
        new = group.copy()
        for i in range(len(fps)):
            new[i] = group[np.bitwise_count(fps ^ fps[i]) <= bits].min()
        if (new == group).all():
            return group.tolist()
        group = new


def test_near_duplicates(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}é" for i in range(400)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(60, 400))) for _ in range(40)]
    for t in texts[:12]:
        words = t.split()
        for _ in range(3):
            copy = list(words)
            copy[rng.randrange(len(copy))] = "changed"
            texts.append("\t".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    texts += [None, "", " \n", "one", "ONE", "one two three", "word " * 50_000]
    rows = [(1000 - i, t, "x", "y") for i, t in enumerate(texts)] + [(1000, texts[0], "x", "y")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string, component string"))
    rows.sort(key=lambda r: r[0])
    want = plain_groups([plain_fingerprint(r[1]) for r in rows])
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()) == sorted((r[0], f"{plain_fingerprint(r[1]):016x}", rows[g][0]) for r, g in zip(rows, want, strict=True))


@pytest.mark.parametrize("part", [simhash.PART, 300])
def test_links_in_dense_balls(spark, monkeypatch, part):
    """Many fingerprints around one centre, in one group of a table; small parts force the meeting of parts."""
    monkeypatch.setattr(simhash, "PART", part)
    rng = np.random.default_rng(1)
    fps = {int(x) for x in rng.integers(0, 2**64, 500, dtype=np.uint64)}
    for centre in rng.integers(0, 2**64, 2, dtype=np.uint64).tolist():
        for _ in range(900):
            for bit in rng.integers(0, 64, rng.integers(0, 7)).tolist():
                centre_bit = 1 << bit
                fps.add(centre ^ centre_bit)
            value = centre
            for bit in rng.integers(0, 64, 5).tolist():
                value ^= 1 << bit
            fps.add(value)
    fps = sorted(fps)
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp long")
    found = {r.node % 2**64: r.component for r in components(simhash.links(df)).collect()}
    want = plain_groups(fps)
    ours = [found.get(x, x) for x in fps]
    assert len(set(zip(ours, want, strict=True))) == len(set(ours)) == len(set(want))


def test_tables_cover_every_pair_of_blocks():
    for order, width in simhash.tables():
        assert sorted(order.tolist()) == list(range(64)) and 20 <= width <= 23
    x = np.array([0x8000000000000001, 0x0123456789ABCDEF], np.uint64)
    order = simhash.tables()[7][0]
    assert simhash.permute(x, order).tolist() == [int("".join(f"{v:064b}"[b] for b in order), 2) for v in x.tolist()]
    ranks = simhash.gray_rank(np.arange(16, dtype=np.uint64))
    assert [int(i ^ (i >> 1)) for i in ranks.tolist()] == list(range(16))


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (5, 5), (7, 6), (6, 8), (None, 4)] + [(i, i + 1) for i in range(20, 60)] + [(100, i) for i in range(101, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 6: 6, 7: 6, 8: 6} | {i: 20 for i in range(20, 61)} | {i: 100 for i in range(100, 300)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_contamination(text, items, window=13):
    words, hit, found = plain_words(text), set(), set()
    for item, own in items:
        own = plain_words(own)
        n = min(window, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1) if n else ():
            if tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add("" if item is None else str(item))
    return len(words), len(hit), sorted(found)


def test_contamination(spark):
    rng = random.Random(9)
    word = lambda: rng.choice(["alpha", "Beta", "gamma", "Δelta", "ñu", "x1", "seven"])
    text = lambda n: "".join(word() + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 5, 12, 13, 14, 30, 45]))) for i in range(25)] + [(None, text(20)), (30, None), (31, "..."), (3, text(15))]
    docs = [(i, text(rng.randint(0, 80)) + (rng.choice(items)[1] or "") + text(rng.randint(0, 30))) for i in range(120)]
    docs += [(500, None), (501, ""), (None, items[7][1]), (502, items[7][1]), (502, items[7][1]), (503, "zz " * 30_000 + (items[6][1] or ""))]
    df = spark.createDataFrame([(*d, 1, "w") for d in docs], "doc_id long, text string, n_hit int, w string")
    bench = spark.createDataFrame([(*b, "x") for b in items], "item_id long, text string, `window` string")
    got = contamination.find_contamination(df, bench).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got), key=key) == sorted(
        ((i, *(lambda n, h, f: (n, h, tuple(f)))(*plain_contamination(t, items))) for i, t in docs), key=key)
    none = contamination.find_contamination(df, bench.where("item_id = 31"))
    assert none.count() == len(docs) and none.where("n_hit > 0").count() == 0
    assert contamination.contamination_report(contamination.find_contamination(df.where("doc_id < 0"), bench)).count() == 0


def test_licenses(spark):
    mit = next(t for n, t in licenses.KNOWN if n == "MIT")
    docs = [(1, mit), (2, "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace(",", " ; ")), (3, "prose\nLICENCED UNDER THE MIT LICENCE\nmore"), (4, None), (5, ""),
            (6, "Copyright 2021 A"), (7, "prose only " * 20_000), (8, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License"), (None, mit), (1, mit)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, license string")
    got = {r.doc_id: (r.text_license, r.n_license_lines, r["licenses"]) for r in licenses.find_licenses(df, licenses.known_digests(spark)).collect()}
    assert licenses.find_licenses(df, licenses.known_digests(spark)).count() == len(docs)
    assert got[1] == got[2] == got[None] and got[1][0] == "MIT"
    assert got[3] == (None, 1, ["MIT"]) and got[8] == (None, 2, ["CC-BY-NC-4.0", "MIT"])
    assert got[4] == got[5] == got[6] == got[7] == (None, 0, [])
    empty = {r.text_sha256 for r in licenses.find_licenses(df.where("doc_id in (4, 5, 6)"), licenses.known_digests(spark)).collect()}
    assert empty == {hashlib.sha256(b"").hexdigest()}
    assert licenses.find_licenses(df.where("false"), licenses.known_digests(spark)).count() == 0


def test_search_streams_its_batches(spark, monkeypatch):
    import pyarrow as pa

    kind, found = type(spark.range(1)), {}
    plain = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, fn, *a, **b: (found.setdefault(fn.__name__, fn), plain(self, fn, *a, **b))[1])
    simhash.links(spark.createDataFrame([(1,), (3,)], "fp long"))
    read = []

    def batches():
        for k in range(10):
            read.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([k, k]), pa.array([8 * k, 8 * k + 1])], ["key", "fp"])

    out = found["search"](batches())
    next(out)
    assert len(read) < 10 and sum(b.num_rows for b in out) == 9
