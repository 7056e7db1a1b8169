"""Language, language model, token counts and toxicity: exact parts by brute force, learned parts by held-out quality."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliospark.llm import language, lm, token_counts, toxicity
from foliospark.llm.common import id_remainder

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "1234 !!", "de"), (None, "the word", None), (4, "the the", "en"), (4, "the the", "en"), (5, "a " * 400_000, "en")]
    return spark.createDataFrame([(*r, "x", "y", 1.0) for r in rows], "doc_id long, text string, lang string, rejected string, word string, score double")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_remainder(spark):
    got = spark.range(50).select("id", id_remainder("id", 7).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 7 for r in got)


def test_language_held_out_and_odd_texts(spark, documents, odd):
    held = id_remainder("doc_id", 4) == 2
    model = language.train(documents, ~held, sample=400)
    got = language.identify(documents.where(held), model)
    assert got.columns[: len(documents.columns)] == documents.columns
    n = got.count()
    assert got.where("lang = lang_pred").count() >= 0.98 * n and got.where("NOT rejected").count() >= 0.99 * n
    out = language.identify(odd, model).collect()
    assert len(out) == 7
    for r in out:
        none = not re.search("[a-z]", r.text or "")
        assert (r.lang_pred == "und") == none and 0 <= r.score <= 1 and (not none or (r.score == 0 and r.rejected))
    assert language.identify(odd.where("false"), model).count() == 0
    assert language.identify(odd, language.train(odd, F.lit(False))).count() == 7


def test_language_rejects_unlearned_languages_and_junk(spark, documents):
    """None of these is like the four languages of the table; plain sentences of those, from another domain, are accepted."""
    model = language.train(documents, id_remainder("doc_id", 4) != 2)
    strange = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
        "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
        "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。",
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
        "xkcd zrtp qwfp brst vbnm ghjk lmnp rtzs", "bcdfg hjklm npqrst vwxz bcdf ghjk lmnp qrst", "qqq www zzz xxx kkk jjj", "zxcvbnm asdfghjkl qwrtp"]
    plain = [
        "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience.",
        "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt.",
        "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia.",
        "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience."]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(strange + plain)], "doc_id int, text string")
    got = {r.doc_id: r.rejected for r in language.identify(rows, model).collect()}
    assert [got[i] for i in range(len(got))] == [True] * len(strange) + [False] * len(plain)
    kept = language.accepted(documents, model)
    assert kept.columns == documents.columns and kept.count() >= 0.999 * documents.count()


@pytest.mark.parametrize("task_docs", [100_000, 2000])
def test_language_learns_from_all_rows(spark, monkeypatch, task_docs):
    """Each of 4,000 words stands in four documents, one of them not trusted: who learns from a few thousand doesn't meet many of the words.

    The rows are sorted by language; repeated and null ids count like others.
    """
    monkeypatch.setattr(language, "TASK_DOCS", task_docs, raising=False)
    rng = random.Random(3)
    kind = [rng.choice(["xx", "yy"]) for _ in range(4000)]
    word = [chr(0x4E00 + 2 * i) + chr(0x4E01 + 2 * i) for i in range(4000)]
    rows = sorted((kind[i], f"{word[i]} {n} {word[i]}", n < 3) for i in range(4000) for n in range(4))
    docs = spark.createDataFrame([(None if i % 7 == 0 else i % 5000, t, k, a) for i, (k, t, a) in enumerate(rows)], "doc_id long, text string, lang string, trusted boolean")
    model = language.train(docs, F.col("trusted"))
    asked = language.identify(docs.where("NOT trusted"), model)
    assert asked.where("lang = lang_pred").count() >= 0.9 * 4000
    assert model.labels == ["xx", "yy"] and 0 <= model.least <= language.EVEN and model.farthest >= language.GRANTED


def test_language_limits_come_from_all_calibration_rows(spark):
    """Of 9,000 rightly predicted texts four may be lost by a measure, so that the fifth lowest and highest are the limits."""
    table = np.zeros((language.ROWS, 3), np.float32)
    model = language.Model(["xx", "yy"], table, np.array([0.1, 0.0]))
    rng = np.random.default_rng(5)
    table[:, 0], table[:, 2] = rng.normal(3, 2, language.ROWS), rng.normal(-8, 1, language.ROWS)
    rows = spark.createDataFrame([("".join(chr(0x4E00 + int(c)) for c in rng.integers(0, 20_000, 2)), "xx") for _ in range(9000)], "text string, lang string")
    language._calibrate(rows, model)
    left = language.Model(**vars(model) | {"least": 0.0, "farthest": 1e9})
    names, scored = language._scored(rows, left, "text")
    got = scored.where(F.col(names[2]) == "xx").select(F.col(names[3]).alias("score"), F.col(names[5]).alias("short")).toPandas()
    rank = int(len(got) * language.LOSS / 2)
    assert model.least == pytest.approx(min(language.EVEN, sorted(got.score)[rank])) and rank >= 3
    assert model.farthest == pytest.approx(max(language.GRANTED, sorted(got.short)[-1 - rank]))


def test_language_clashing_names(spark):
    """Added names are replaced whatever their case; names with dots and all columns of accepted rows stay."""
    model = language.fit([], [])
    rows = spark.createDataFrame([(1, "some words", 1, 2, 3, 4, 5)], "doc_id int, text string, `a.b` int, Score int, Lang_Pred int, REJECTED int, c0 int")
    got = language.identify(rows, model)
    assert got.columns == ["doc_id", "text", "a.b", "c0", "lang_pred", "score", "rejected"] and [*got.first()][:4] == [1, "some words", 3 - 2, 5]
    assert language.accepted(rows, model).columns == rows.columns


def test_language_mean_is_that_of_all_subwords():
    """Cutting a text into parts changes nothing."""
    reader, text = language.Reader(), "ab é1 the quick, ñandú" * 30
    whole = np.sort(np.concatenate([r for _, r, _ in reader.parts([text])]))
    keep, language.PART = language.PART, 17
    try:
        cut = np.sort(np.concatenate([r for _, r, _ in reader.parts([text])]))
    finally:
        language.PART = keep
    words = re.findall(r"[^\W\d_]+", text)
    assert len(whole) == sum(max(0, len(w) + 2 - n + 1) for w in words for n in language.SIZES) and (whole == cut).all()


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def test_language_model(spark, documents, odd):
    docs = documents.select("doc_id", "text", F.lit(1).alias("word")).unionByName(odd.select("doc_id", "text", F.lit(1).alias("word")))
    trusted = id_remainder("doc_id", 7) != 2
    vocab = lm.vocabulary(docs, trusted)
    totals = lm.sample(vocab)
    words = lm.model(vocab, totals)
    got = lm.score(docs, words, totals).collect()
    rows = docs.collect()
    counts = collections.Counter()
    for r in rows:
        if zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 != 2:
            counts.update(tokens(r.text))
    n, v = sum(counts.values()), len(counts)
    want = sorted(((len(t), sum(counts[w] > 0 for w in t), sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t)) for t in (tokens(r.text) for r in rows)))
    assert len(got) == len(rows) and {r.train_tokens for r in got} == {n}
    for a, b in zip(sorted((r.n_tokens, r.n_known, r.base_score) for r in got), want, strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-9)
    held = [r for r in got if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    # in every context the probabilities of all words and of an unknown one sum to 1
    rows = words.collect()
    for context in (0, 5, 40):
        back = np.array([totals.back(s)[context] for s in range(lm.BURN + 1, len(totals.sweeps))])
        none = np.array([totals.root(np.zeros(1), np.zeros(1), s)[0] for s in range(lm.BURN + 1, len(totals.sweeps))])
        total = (back * none).mean() + sum((back * np.array(r.roots)).mean() + sum(e.extra for e in r.entries if e.context == context) for r in rows)
        assert total == pytest.approx(1.0, abs=1e-6)


def test_language_model_without_words(spark, odd):
    none = odd.where("false")
    vocab = lm.vocabulary(none, F.lit(True))
    totals = lm.sample(vocab)
    assert lm.score(none, lm.model(vocab, totals), totals).count() == 0
    got = lm.score(odd, lm.model(vocab, totals), totals).collect()
    assert len(got) == 7 and all(r.n_known == 0 and r.base_score == 0 for r in got)


def test_seating_keeps_bounds():
    rng = np.random.default_rng(0)
    c = np.array([0, 1, 2, 10, 1000, 100_000])
    t = lm.seat(c, np.full(6, 5.0), 0.5, rng)
    assert (t <= c).all() and (t >= np.minimum(c, 1)).all()
    assert (lm.seat(c, np.zeros(6), 0.5, rng) == np.minimum(c, 1)).all()


def test_seating_equals_single_customers():
    """Means of the blocked seating and of one customer after another."""
    rng, n, new, d = np.random.default_rng(4), 400, 3.0, 0.6
    blocked = lm.seat(np.full(4000, n), np.full(4000, new), d, rng).mean()
    t = np.ones(4000)
    for i in range(1, n):
        t += rng.random(4000) < new / (new + i - d * t)
    assert blocked == pytest.approx(t.mean(), rel=0.03)


def plain_count(word, pieces, bad, longest):
    """Best (score, fewest tokens) over all segmentations, by recursion from the left."""
    word = token_counts.MARK + word
    best = [(0.0, 0)]
    for e in range(1, len(word) + 1):
        n = len(word[e - 1].encode())
        c = word[e - 1]
        options = [(best[e - 1][0] + (pieces[c] if c in pieces else n * bad), best[e - 1][1] - (1 if c in pieces else n))]
        best.append(max(options + [(best[b][0] + pieces[word[b:e]], best[b][1] - 1) for b in range(max(0, e - longest), e - 1) if word[b:e] in pieces]))
    return -best[-1][1]


def test_token_counts(spark, documents, odd):
    pieces = token_counts.load_pieces()
    docs = documents.limit(60).select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    got = token_counts.token_counts(docs.withColumn("n_tokens", F.lit("x")), pieces).collect()
    texts = [re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for r in docs.collect()]
    bad, longest = min(pieces.values()) - token_counts.BYTE_PENALTY, max(map(len, pieces))
    known = {w: plain_count(w, pieces, bad, longest) for w in {w for t in texts for w in t}}
    want = [(len(t), sum(known[w] for w in t)) for t in texts]
    assert sorted((r.n_words, r.n_tokens) for r in got) == sorted(want)
    assert token_counts.token_counts(docs.where("false"), pieces).count() == 0


def test_shared_prefixes_change_nothing():
    rng = random.Random(2)
    pieces = {token_counts.MARK: -3.0, "a": -2.0, "b": -2.5, "ab": -3.0, "aba": -4.0, "▁a": -2.0, "bb": -4.5}
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(300)]
    assert token_counts.count_tokens(words, pieces) == [plain_count(w, pieces, min(pieces.values()) - token_counts.BYTE_PENALTY, 99) for w in words]


def test_toxicity(spark, documents, odd):
    rng = random.Random(8)
    plain = [" ".join(rng.choice(["der", "the", "of", "and"]) + f" w{rng.randint(0, 3000)}" for _ in range(60)) for _ in range(900)]
    rows = []
    for i, t in enumerate(plain):
        toxic = int(i % 8 == 0)
        rows.append((i, t + (" " + " ".join(rng.choice(["zork", "blarg", "fnord"]) for _ in range(3)) if toxic else ""), toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = docs.select("doc_id", "toxic").union(spark.createDataFrame([(None, 1), (3, None), (8, 1), (8, 0)], "doc_id long, toxic int"))
    held = id_remainder("doc_id", 4) == 2
    models = toxicity.train(docs.drop("toxic"), labels, ~held)
    got = toxicity.score(docs.where(held), models).join(docs.select("doc_id", "toxic"), "doc_id").collect()
    right = sum(r.predicted == r.toxic for r in got)
    assert right >= 0.97 * len(got)
    out = toxicity.score(odd, models).collect()
    assert len(out) == 7 and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score(odd.where("false"), models).count() == 0
    untrained = toxicity.train(docs, labels.where("false"), F.lit(True))
    assert {round(r.score, 6) for r in toxicity.score(odd, untrained).collect()} == {round(1 / (1 + math.exp(3)), 6)}


def test_language_model_counts_a_group_in_small_slices(spark, monkeypatch):
    """Words are cut from SCORE_BYTES of text at a time, and counted for a whole group: the same entries, in far less memory."""
    docs = spark.createDataFrame([(i, f"one two three{i % 7} four " * 5) for i in range(60)], "doc_id long, text string").coalesce(1)
    rows = lambda: sorted((r["word"], r["count"], tuple(sorted(map(tuple, r["entries"])))) for r in lm.vocabulary(docs, F.lit(True)).collect())
    want, cut = rows(), lm.token_arrays

    def bounded(data, offsets, hasher):
        assert len(offsets) == 2 or offsets[-1] - offsets[0] <= 300
        return cut(data, offsets, hasher)

    monkeypatch.setattr(lm, "SCORE_BYTES", 300)
    monkeypatch.setattr(lm, "token_arrays", bounded)
    assert rows() == want


def test_language_model_learns_whole_words_before(spark):
    """Words of one ending are different words before: what follows one of them doesn't follow the other."""
    docs = spark.createDataFrame([(i, "aaxx left" if i % 2 else "bbxx right") for i in range(100)], "doc_id long, text string")
    vocab = lm.vocabulary(docs, F.lit(True))
    totals = lm.sample(vocab)
    asked = spark.createDataFrame([(0, "aaxx left"), (1, "aaxx right"), (2, "bbxx right"), (3, "bbxx left")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.score(asked, lm.model(vocab, totals), totals).collect()}
    assert got[0] - got[1] > 1 and got[2] - got[3] > 1


@pytest.mark.parametrize("hot", [2, 4096])
def test_language_model_scores_by_its_tables(spark, monkeypatch, hot):
    """Scores are what the stored tables say of each token, whichever words are frequent; after any word before, all words sum to 1."""
    monkeypatch.setattr(lm, "HOT", hot)
    rng = np.random.default_rng(3)
    said = [" ".join(rng.choice([f"w{int(k)}" for k in rng.zipf(1.4, 20)], 12)) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string").unionByName(spark.createDataFrame([(200, "w1 unseen w1"), (201, None)], "doc_id long, text string"))
    vocab = lm.vocabulary(docs, F.col("doc_id") < 120)
    totals = lm.sample(vocab)
    words = lm.model(vocab, totals).collect()
    backs = np.array([totals.back(s) for s in range(lm.BURN + 1, len(totals.sweeps))])
    none = np.array([totals.root(np.zeros(1), np.zeros(1), s)[0] for s in range(lm.BURN + 1, len(totals.sweeps))])
    roots, extra = {r.word: np.array(r.roots) for r in words}, {(r.word, e.context): e.extra for r in words for e in r.entries}
    own = {(r.word, b): n for r in spark.read.parquet(totals.pairs).collect() for b, n in zip(r.befores, r.own)}
    befores = {r.before: (r.customers, r.back) for r in spark.read.parquet(totals.befores).collect()}
    assert len(own) == vocab.selectExpr("sum(size(entries)) as n").first().n and sum(c for c, _ in befores.values()) == totals.tokens

    def p(word, before, context):
        customers, back = befores.get(before, (0, 1.0))
        below = (backs[:, context] * roots.get(word, none)).mean() + extra.get((word, context), 0.0)
        return own.get((word, before), 0.0) / (lm.STRENGTH + customers) + back * below

    data, offsets = lm.utf8(pa.array([r.text for r in docs.orderBy("doc_id").collect()], pa.string()))
    word, before, context, row = lm.token_arrays(data, offsets, lm.WordHash())
    word, before = word.view(np.int64).tolist(), before.view(np.int64).tolist()
    want = np.bincount(row, [math.log10(p(*t)) for t in zip(word, before, context.tolist())])
    got = lm.score(docs, lm.model(vocab, totals), totals).orderBy("doc_id").collect()
    assert [r.score for r in got] == pytest.approx(want.tolist(), rel=1e-5)
    for b, c in list(dict(zip(before, context.tolist())).items())[:20]:
        assert sum(p(w, b, c) for w in [*roots, None]) == pytest.approx(1.0, abs=1e-5)
