"""Operators 11 to 13 against brute force, on odd tables and at the limits of their numbers."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewatch.llm import minhash, resample, tokengroups, vectorcode


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sets_of(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return frozenset(zip(*(w[i:] for i in range(width)), strict=False)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute_join(rows, width, percent):
    sets, root = [(i, sets_of(t, width)) for i, t in rows], {i: i for i, _ in rows if i is not None}
    find = lambda i: i if root[i] == i else find(root[i])
    for (a, x), (b, y) in itertools.combinations([s for s in sets if s[0] is not None and s[1]], 2):
        k = len(x & y)
        if 100 * k >= percent * (len(x) + len(y) - k):
            u, v = find(a), find(b)
            root[max(u, v)] = min(u, v)
    return sorted((str(i), len(s), None if i is None else find(i)) for i, s in sets)


@pytest.fixture(scope="module")
def near():
    """Families of near copies around the threshold, passages that many share, repeated ids, odd and very long texts."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(3000)}"
    rows, passage = [], [word() for _ in range(60)]
    for family in range(6):
        base = [word() for _ in range(rng.choice([8, 40, 120, 300]))]
        for _ in range(25):
            text = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                text[rng.randrange(len(text))] = word()
            rows.append(text if family % 2 else [*text[:4], *passage, *text[4:]])
    rows += [[*passage, *[word() for _ in range(n)]] for n in (0, 1, 2, 3, 4, 5, 6, 7, 30)]
    rows = [(rng.choice([i, i, i, i, i % 40]), " ".join(t)) for i, t in enumerate(rows)]
    long = " ".join(word() for _ in range(60_000))
    odd = [(500, ""), (501, None), (502, " \t\n"), (503, "One"), (504, "oNE"), (505, "one two"), (506, "ONE  two"), (None, "no id here"), (None, rows[0][1]), (507, long), (508, long + " more"), (509, long[: len(long) // 2])]
    return [*rows, *odd, rows[5], rows[5]]


@pytest.mark.parametrize("block", [4, tokengroups.BLOCK])
def test_similar_documents_lose_no_link(spark, near, block):
    docs = spark.createDataFrame(near, "doc_id long, text string").repartition(3).withColumns({"leader": F.lit("clash"), "key": F.lit(1), "CID": F.lit(2)})
    found = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in tokengroups.similar_documents(docs, width=3, percent=90, block=block).collect())
    assert found == brute_join(near, 3, 90)
    assert tokengroups.similar_documents(docs.limit(0), width=3, percent=90).count() == 0


def test_repeated_ids_join_their_texts(spark):
    """One doc_id under three texts, of which others have copies: all are one component."""
    text = lambda c: " ".join(f"{c}{i}" for i in range(30))
    rows = [(9, text("a")), (9, text("b")), (9, text("c")), (3, text("b")), (5, text("c")), (7, text("a")), (1, text("d"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for found in (minhash.near_duplicates(docs), tokengroups.similar_documents(docs)):
        assert {(r.doc_id, r.component_id) for r in found.collect()} == {(9, 3), (3, 3), (5, 3), (7, 3), (1, 1)}


def test_intersections_by_products_and_lists():
    rng = np.random.default_rng(3)
    for codes, most in ((40, 30), (60_000, 200), (9000, 2000)):
        sets = [np.unique(np.minimum(rng.zipf(1.3, rng.integers(1, most)), codes) - 1) for _ in range(130)]
        sets = [np.unique(np.concatenate([s, rng.integers(0, codes, 20)])) for s in sets]
        both = tokengroups.Sets(np.concatenate(sets), np.array([len(s) for s in sets]))
        x, y = np.arange(50), np.arange(30, 130)
        found = tokengroups.intersections(both.take(x), both.take(y), codes)
        assert found.tolist() == [[len(np.intersect1d(sets[i], sets[j])) for j in y] for i in x]


def test_blocks_stay_closed_to_those_that_lack_the_tokens(monkeypatch):
    asked = []
    monkeypatch.setattr(tokengroups, "intersections", lambda x, y, n, f=tokengroups.intersections: asked.append(len(x.size)) or f(x, y, n))
    a = np.arange(100)
    sets = [a, np.concatenate([a[:95], [200]]), np.concatenate([a[:50], np.arange(300, 350)]), np.arange(400, 420)]
    links, label = tokengroups.block_links(sets, np.array([2, 0, 0, 0]), 90)
    assert links == [(1, 0)] and asked == [2]  # the member itself, and the only row that may be like it
    assert label[0] == label[1] != label[2]


# -- codes of vectors -------------------------------------------------------------------------------


def brute_codes(rows, parts, entries, rounds, scale=256):
    """Codes and codebooks in Python's integers."""
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    near = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            held = collections.defaultdict(list)
            for _, v, _ in kept:
                held[near(cut(v, p), books[p])].append(cut(v, p))
            books[p] = [[sum(c) // len(held[e]) for c in zip(*held[e], strict=True)] if e in held else old for e, old in enumerate(books[p])]
    out = []
    for i, v, label in kept:
        code = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{c:02x}" for c in code), sum(far(cut(v, p), books[p][c]) for p, c in enumerate(code)), label))
    total = collections.Counter()
    for _, _, error, label in out:
        total[label] += error
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return sorted(str((i, c, e, total[label], digest)) for i, c, e, label in out)


@pytest.mark.parametrize(("size", "kind"), [(1.0, "float"), (3e4, "float"), (9e5, "double")])
def test_codes_against_whole_numbers(spark, size, kind):
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, size) for _ in range(8)], rng.choice([1, 1, 2, None])) for i in range(90)]
    rows = [(i, [float(np.float32(x)) for x in v], k) for i, v, k in rows]
    rows += [rows[3], rows[3], (3, rows[4][1], 1), (None, rows[5][1], 2), (200, None, 1), (201, [1.0] * 7 + [None], 1), (202, [float("nan")] * 8, 1), (203, [float("inf")] + [0.0] * 7, 1), (204, [0.0] * 8, None), (-5, [-size] * 8, 1)]
    table = spark.createDataFrame(rows, f"vec_id long, vector array<{kind}>, label int").repartition(5).withColumns({"_share": F.lit(1), "fits": F.lit(False), "Code": F.lit("clash")})
    found = vectorcode.vector_codes(table, parts=4, entries=16, rounds=2)
    assert sorted(str(tuple(r)) for r in found.collect()) == brute_codes(rows, 4, 16, 2)
    assert vectorcode.vector_codes(table.limit(0)).count() == 0


def test_vectors_without_a_code(spark):
    rows = [(1, [1.0, 2.0], 1), (2, [3.0, 4.0], 1), (3, [1.0], 1), (4, [1e300, 0.0], 2), (5, [], 2), (6, [2.0**53, 1.0], 3)]
    found = {r.vec_id: r for r in vectorcode.vector_codes(spark.createDataFrame(rows, "vec_id long, vector array<double>, label int"), parts=2, entries=2).collect()}
    assert set(found) == {1, 2, 3, 4, 5, 6}
    assert [i for i in found if found[i].code is None] == [3, 4, 5] or {i for i in found if found[i].code is None} == {3, 4, 5}
    assert found[3].label_error == found[1].error + found[2].error and found[5].label_error is None
    assert found[6].error is None or found[6].error < 2**63
    odd = spark.createDataFrame([(1, [1.0], 1)], "vec_id long, vector array<double>, label int")
    assert [r.code for r in vectorcode.vector_codes(odd).collect()] == [None]


def test_products_are_exact_where_float64_is_not():
    rng = np.random.default_rng(1)
    for low, width, kind in ((2**9, 4, np.int64), (2**30, 5, np.int64), (2**55, 3, object)):
        x, y = rng.integers(-low, low, (20, width)), rng.integers(-low, low, (9, width))
        x[0], y[0] = -low, -low
        exact = [[sum(a * b for a, b in zip(u, v, strict=True)) for v in y.tolist()] for u in x.tolist()]
        assert vectorcode.products(x, y, kind).tolist() == exact
        for part in vectorcode.limbs(x, 20):
            assert np.abs(part).max() <= 2**20
    assert [c.tolist() for c in vectorcode.assign(np.array([[0], [5]]), np.array([[1], [-1], [1]]))] == [[0, 0], [1, 16]]


# -- resampling ---------------------------------------------------------------------------------------


def brute_resample(docs, target, percent=5, least=20):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    s, t = collections.Counter(), collections.Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    of, to = s.total() + 10_000, t.total() + 10_000
    out = []
    for i, text in docs:
        n, f = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * of / ((s[b] + 1) * to))) for b in f)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    may = sorted((r for r in out if r[0] is not None and r[5] >= least), key=lambda r: (-r[3], r[0], r[1]))
    for rank, r in enumerate(may[: percent * len(may) // 100], 1):
        r[4] = rank
    return sorted(str(tuple(r[:5])) for r in out)


@pytest.mark.parametrize("percent", [5, 40, 100])
def test_resampling_against_plain_counts(spark, percent):
    rng = random.Random(2)
    said = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(200)] + ["é", "日本語のことば", "x" * 70, "y" * 600, "Zİz", "nul\0word"]
    text = lambda n: rng.choice([" ", ", ", "--"]).join(rng.choices(said, k=n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(150)]
    docs += [(7, docs[7][1])] * 9 + [(8, "no"), (None, text(30)), (900, None), (901, ""), (902, text(20)), (903, text(19)), (904, text(30_000)), (905, "日" * 100_000), (906, "!? 12 " * 9)]
    target = [text(rng.randint(0, 40)) for _ in range(20)] + [None, ""]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).withColumns({"_row": F.lit(1), "Rank": F.lit("x"), "weight": F.lit(2)})
    found = resample.resample(table, spark.createDataFrame([(t,) for t in target], "text string"), percent=percent)
    assert sorted(str(tuple(r)) for r in found.collect()) == brute_resample(docs, target, percent)


def test_resampling_of_nothing(spark):
    docs, target = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert resample.resample(docs, target).count() == 0
    assert [tuple(r) for r in resample.resample(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), target, least_words=1, percent=100).select("doc_id", "n_features", "rank").collect()] == [(1, 3, 1)]


def test_thresholds_meet_ties(spark):
    rng = random.Random(4)
    rows = [(rng.choice([-(2**40), 0, 0, 5, 5, 5, 2**40, rng.randrange(10**12)]), rng.randrange(4), i) for i in range(400)]
    table = spark.createDataFrame(rows, "a long, b long, c long").cache()
    ordered = sorted(rows)
    for k in (1, 2, 57, 200, 399, 400):
        assert tuple(resample.kth(table, ["a", "b", "c"], k)) == ordered[k - 1]


def test_crcs_of_words_and_zeros():
    rng = random.Random(8)
    data = [rng.randbytes(n) for n in (0, 1, 5, 63, 64, 65, 300, 70_000)]
    flat, edge = np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])
    crc = resample.word_crcs(flat, edge[:-1], edge[1:])
    assert crc.tolist() == [zlib.crc32(x) for x in data]
    joined = resample.after_zeros(np.full(len(data), zlib.crc32(b"head"), np.uint32), np.diff(edge)) ^ crc
    assert joined.tolist() == [zlib.crc32(b"head" + x) for x in data]
