import hashlib
import html
import itertools
import random
import re
import time
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tablewatch.llm import ann, decontam, langid, licenses, minhash, packing, queries, suffix, tokens, urlfilter, warc

ODD = [(1, ""), (2, None), (3, "one"), (4, " ".join(f"w{i}" for i in range(400))), (5, " ".join(f"w{i}" for i in range(400))), (6, " ".join(f"w{i}" for i in range(399))), (None, "no id here"), (7, "é" * 60 + " x"), (8, "y " + "é" * 60)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumn("kept", F.lit(1)).withColumn("node", F.lit("clash"))


def shingles(text, width=2):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(*(w[i:] for i in range(width)), strict=False)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    find = lambda i: i if root[i] == i else find(root[i])
    for a, b in itertools.combinations(sorted(sets), 2):
        k = len(sets[a] & sets[b])
        if k and 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_near_duplicates(docs):
    found = {r.doc_id: r for r in minhash.near_duplicates(docs, width=2).collect()}
    assert {i: r.component_id for i, r in found.items() if i} == brute_components([x for x in ODD if x[0]])
    assert found[1].n_shingles == found[2].n_shingles == 0 and found[None].kept
    assert minhash.near_duplicates(docs.limit(0), width=2).count() == 0


def test_repeats_against_brute_force(docs):
    first, expected = {}, {}
    for i, t in sorted(x for x in ODD if x[0]):
        b = (t or "").encode()
        hit = bytearray(len(b))
        for p in range(len(b) - 49):
            if first.setdefault(b[p : p + 50], i) < i:
                hit[p : p + 50] = b"\1" * 50
        expected[i] = (sum(hit), hashlib.sha256(bytes(x for x, h in zip(b, hit, strict=True) if not h)).hexdigest())
    found = {r.doc_id: (r.n_removed, r.kept_sha256) for r in suffix.repeats(docs).collect() if r.doc_id}
    assert found == expected
    assert suffix.repeats(docs.limit(0)).count() == 0
    left = {r.doc_id: r.text for r in suffix.remove_repeats(docs).collect()}
    assert 5 not in left and left[2] is None and left[8].strip() == "y"


def test_merged_transforms_find_repeated_windows():
    strings = [b"abcabcabcx", b"zabcabcab", b"nothing", b"abcabcab"]
    string, offset = suffix.repeated_windows(strings, np.array([3, 1, 2, 5]), 4)
    found = set(zip(string.tolist(), offset.tolist(), strict=True))
    expected = {(i, p) for i, s in enumerate(strings) for p in range(len(s) - 3) if any(s[p : p + 4] in t and o < [3, 1, 2, 5][i] for t, o in zip(strings, [3, 1, 2, 5], strict=True))}
    assert found == expected


def brute_repeats(rows, length=50):
    held = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1 if i is not None else 0):
            held[b[p : p + length]] = min(held.get(b[p : p + length], i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        hit = bytearray(len(b))
        for p in range(len(b) - length + 1 if i is not None else 0):
            if held[b[p : p + length]] < i:
                hit[p : p + length] = b"\1" * length
        out.append((str(i), len(b), sum(hit), hashlib.sha256(bytes(x for x, h in zip(b, hit, strict=True) if not h)).hexdigest()))
    return sorted(out)


@pytest.fixture(scope="module")
def repeating():
    """Random texts with repeated ids, copies, null ids, a passage in most of them, and some of a hundred kilobytes."""
    rng = random.Random(5)
    said = ["".join(rng.choices("abcde é", k=rng.randint(2, 9))) for _ in range(60)]
    passage, rows = " ".join(rng.choices(said, k=30)), []
    for i in range(150):
        t = " ".join(rng.choices(said, k=rng.randint(0, 80)))
        t = passage if i % 7 == 0 else t[: rng.randint(0, len(t))] + passage + t if i % 3 else t
        rows.append((rng.choice([i, i, i, i % 50, None]), t))
    long = " ".join(rng.choices(said, k=20_000))
    return [*rows, (5, None), (6, ""), (1000, "ab" * 3000), (1001, "x" + "ab" * 40), (999, "ba" * 2000), (2000, passage * 400), (7, long), (3000, long), (3001, "x" + long[:50_000])]


@pytest.mark.parametrize(("merged", "many"), [(1024, 4096), (8, 8)])
def test_repeats_of_odd_texts(spark, repeating, monkeypatch, merged, many):
    monkeypatch.setattr(suffix, "_MERGED", merged)
    monkeypatch.setattr(suffix, "_CHUNK", many)
    docs = spark.createDataFrame(repeating, "doc_id long, text string").repartition(5)
    found = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix.repeats(docs).collect())
    assert found == brute_repeats(repeating)


def test_long_texts_are_looked_through_in_parts(monkeypatch):
    import pyarrow as pa

    text = "".join(random.Random(3).choices("ab ", k=5000))
    piece = pa.RecordBatch.from_arrays([pa.array([1, 2, None]), pa.array([text, "short", text]), pa.array([1, 2, None], pa.int64())], ["doc_id", "text", "id"])

    def windows():
        c = suffix.Chunk(piece, None, 50, 22)
        return {(int(r), w): (int(p), int(k)) for r, lo, hi, p, k in zip(c.row, c.lo, c.hi, c.pos, c.key, strict=True) for w in range(lo, hi - 49)}

    whole = windows()
    monkeypatch.setattr(suffix, "CHUNK_BYTES", 300)
    assert windows() == whole and len(whole) == 4951
    monkeypatch.undo()
    ids = list(range(40))
    piece = pa.RecordBatch.from_arrays([pa.array(ids), pa.array([text[i * 100 : i * 100 + 40 + i] for i in ids]), pa.array(ids, pa.int64())], ["doc_id", "text", "id"])
    whole = windows()
    monkeypatch.setattr(suffix, "CHUNK_BYTES", 300)  # now a part holds several texts
    assert windows() == whole and len(whole) == sum(max(0, 40 + i - 49) for i in ids)


def test_what_a_worker_keeps_does_not_follow_the_longest_text():
    from tablewatch.llm import text as tx

    tx.powers(100)
    up, down = tx.powers(3 * tx.SLICE)
    assert len(up) == len(down) == 3 * tx.SLICE and bool((up[-1000:] * down[-1000:] == 1).all())
    assert len(tx._powers) == len(tx._inverse) == tx.SLICE + 64 and bool((tx._powers == up[: len(tx._powers)]).all())


def test_a_task_gives_back_what_it_has_freed():
    from tablewatch.llm.session import released

    def held():
        with open("/proc/self/smaps_rollup") as f:
            return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", f.read()))) >> 10

    pins = []

    def work(batches):
        for batch in batches:
            blocks = [b"x" * 50_000 for _ in range(4000)]  # too small for mappings of their own
            pins.append(b"y" * 50_000)
            yield batch, len(blocks)

    before = held()
    assert list(released(work)([1, 2])) == [(1, 4000), (2, 4000)]
    assert held() - before < 100


def test_a_chunk_asks_for_an_anchor_once_however_many_documents_hold_it(monkeypatch):
    import pyarrow as pa

    passage = "".join(random.Random(4).choices("abcdefgh ", k=200))
    ids = [i // 2 for i in range(400)]  # every doc_id stands under two texts
    piece = pa.RecordBatch.from_arrays([pa.array(ids), pa.array([f"{i:030d}{passage}{i:030d}" for i in range(400)]), pa.array(ids, pa.int64())], ["doc_id", "text", "id"])
    c = suffix.Chunk(piece, None, 50, 22)
    assert len(np.unique(c.asked)) == len(c.asked) == len(c.held) and set(c.asked) == set(c.key)
    holders = {int(k): len({int(c.ids[r]) for r in c.row[c.key == k]}) for k in c.asked}
    assert holders == dict(zip(c.asked.tolist(), c.held.tolist(), strict=True)) and max(holders.values()) == 200
    monkeypatch.setattr(suffix, "_CHUNK", 8)
    assert max(suffix.Chunk(piece, None, 50, 22).held) == 9


def test_a_passage_after_many_texts_stays_out_of_the_merge(spark, monkeypatch):
    merged = suffix.repeated_windows

    def bounded(strings, owner, length):
        assert len(strings) <= 8
        return merged(strings, owner, length)

    monkeypatch.setattr(suffix, "_MERGED", 8)
    monkeypatch.setattr(suffix, "_CHUNK", 8)
    monkeypatch.setattr(suffix, "repeated_windows", bounded)
    passage = " ".join(f"shared{i * i}" for i in range(30))
    text = [(i, hashlib.sha512(bytes([i])).hexdigest() + passage + hashlib.sha512(bytes([i, 1])).hexdigest()) for i in range(1, 61)]
    rows = spark.createDataFrame(text, "doc_id long, text string").repartition(7)
    found = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix.repeats(rows).collect())
    assert found == brute_repeats(text)


def near_group():
    """A group of near copies, about as many a little below as above the threshold to their source, and copies of these."""
    rng = random.Random(11)
    source, rows = [f"s{i}" for i in range(90)], []
    for i in range(120):
        words = list(source)
        for at in rng.sample(range(90), rng.randint(2, 12)):
            words[at] = f"n{i}x{at}"
        rows.append((i + 10, " ".join(words)))
        if i % 5 == 0:
            words[rng.randrange(90)] = "last"
            rows.append((i + 500, " ".join(words)))
    return [*rows, (3, rows[4][1]), (3, "an id that two texts have"), (900, "an id that two texts have"), (901, " ".join(source[:50]))]


@pytest.mark.parametrize("block", [2048, 16])
def test_a_group_around_the_threshold(spark, block):
    rows = near_group()
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), width=2, block=block).collect()}
    sets, root = [(i, shingles(t)) for i, t in rows], {i: i for i, _ in rows}
    find = lambda i: i if root[i] == i else find(root[i])
    for (a, x), (b, y) in itertools.combinations(sets, 2):
        k = len(x & y)
        if 100 * k >= 80 * (len(x) + len(y) - k):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    assert found == {i: find(i) for i in root} and len(set(found.values())) > 5


def test_decontamination_slices_add_up(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "short item"), (3, None), (4, "l m n o p q r s t u")], "item_id long, text string")
    text = [(1, "x A b c d e f g h i j, k y short Item z"), (2, None), (3, "l m n o p q r s t u"), (4, "clean")]
    rows = spark.createDataFrame(text, "doc_id long, text string")
    for limit in (1 << 20, 5):
        found = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontam.contamination(rows, items, slice_bytes=limit).collect()}
        assert found == {1: (16, 13, 2), 2: (0, 0, 0), 3: (10, 10, 1), 4: (1, 0, 0)}
    assert {r.doc_id for r in decontam.decontaminate(rows, items).collect()} == {2, 4}


def test_documents_are_cut_and_judged_on_all_slices_at_once(spark, monkeypatch):
    items = spark.createDataFrame([(1, "a b c"), (2, "d e f"), (3, "c x y"), (4, "p q")], "item_id long, text string")
    text = [(1, "a b c 1 d e f 2 3 4"), (2, "1 2 3 4 5 6 7 a b c x y"), (3, "1 2 3 p a b c q 4 5 6 7"), (4, None), (5, "clean")]
    rows = spark.createDataFrame(text, "doc_id long, text string").withColumn("more", F.lit(1))
    for limit in (1 << 20, 5):
        monkeypatch.setattr(decontam, "SLICE_BYTES", limit)
        found = decontam.decontaminate(rows, items, width=3)
        assert found.columns == rows.columns
        assert {r.doc_id: r.text for r in found.collect()} == {2: "1 2 3 4 5 6 7 ", 3: "1 2 3 p  q 4 5 6 7", 4: None, 5: "clean"}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_bulk_encoding_equals_the_library(name):
    import random

    from tokenizers import Tokenizer

    random.seed(3)
    parts = ["a", "B", "É", "12", " ", "  ", "\n", "'", "'s", "'LL", "!", "ø", "×", "€", "日本", "<|endoftext|>", "\xa0", "don't"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 9))) for _ in range(3000)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    ours = [np.frombuffer(x, "<u4").tolist() for _, found in tokens.encoded(batch, public_tokenizers.path(name)) for x in found]
    assert ours == [e.ids for e in Tokenizer.from_file(public_tokenizers.path(name)).encode_batch(texts, add_special_tokens=False)]


def test_token_files_round_trip(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    manifest, dictionary = tokens.write_ids(docs, path, end_id=2)
    read = {r.doc_id: r for r in tokens.read_ids(manifest, dictionary, with_ids=True).collect()}
    for i, t in ODD:
        ids = [*tokens.encoder(path).tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert list(read[i].ids) == ids and read[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    starts = sorted((r.start, r.n_tokens) for r in read.values())
    assert all(a + n == b for (a, n), (b, _) in itertools.pairwise(starts))


def expected_pieces(rows, capacity=2048):
    from tokenizers import Tokenizer

    library, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), capacity):
            part = np.array(ids[k : k + capacity], "<u4")
            out.append((i, k // capacity, k, len(part), zlib.crc32(part.tobytes())))
    return sorted(out, key=str)


def gapless(found, capacity):
    by = {}
    for r in found:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        assert sum(n for _, n in pieces) <= capacity
        assert all(a + n == b for (a, n), (b, _) in itertools.pairwise(sorted(pieces))) and min(pieces)[0] == 0
    return len(by)


def test_packing_against_the_library(spark, docs):
    found = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=64).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=str) == expected_pieces(ODD, 64)
    assert gapless(found, 64) <= sum(r.length for r in found) / 64 + 2
    assert packing.pack_documents(docs.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("merged", [64, 2])
def test_search_against_brute_force(spark, monkeypatch, merged):
    monkeypatch.setattr(ann, "MERGED", merged)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[10] = x[11] = x[12]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [0.0] * 8), (502, [float("nan")] * 8)]
    vectors = spark.createDataFrame(rows, "vec_id long, vector array<float>")
    found = ann.nearest(vectors, k=5, query=F.col("vec_id") % 20 == 0, query_block=4, candidate_block=50).collect()
    wide = x.astype(np.float64)
    for q in range(0, 300, 20):
        score = wide @ wide[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(300), -np.round(score, 12)))[:5].tolist()
        assert [r.vec_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])] == best


@pytest.mark.parametrize("many", [2000, 0])
def test_url_rules(spark, monkeypatch, many):
    monkeypatch.setattr(urlfilter, "RULES_IN_PLAN", many)
    rules = [urlfilter.Rule("block", "com/en/"), urlfilter.Rule("allow", "example.com/en/7"), urlfilter.Rule("block", "org/v1.0/"), urlfilter.Rule("allow", "org/v1.0/a.b")]
    urls = ["http://A.example.com/en/71?x", "https://com/en/", "http://xcom/en/", "nothing", None, "http://example.com", "http://b.com/en/9#y", "ftp://x.org/v1.0/y", "ftp://x.org/v1.0/a.bc", "ftp://x.org/v1.0", "://" + "a" * 200_000, "nothing"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1))
    found = [tuple(r)[1:] for r in sorted(urlfilter.filter_urls(pages, rules).collect())]
    none = ("", "", None, "allow")
    assert found == [("a.example.com", "/en/71", "example.com/en/7", "allow"), ("com", "/en/", "com/en/", "block"), ("xcom", "/en/", None, "allow"), none, none, ("example.com", "", None, "allow"), ("b.com", "/en/9", "com/en/", "block"), ("x.org", "/v1.0/y", "org/v1.0/", "block"), ("x.org", "/v1.0/a.bc", "org/v1.0/a.b", "allow"), ("x.org", "/v1.0", None, "allow"), ("a" * 200_000, "", None, "allow"), none]
    assert urlfilter.filter_urls(pages.limit(0), rules).count() == 0


def test_url_rules_of_the_query(spark, tmp_path):
    urls = ["http://a.com/en/1", "http://example.com/en/7x", "http://b.NET/de/1", "http://example.net/de/9", "http://w.example.net/de/81", "http://c.org/es/1", "http://d.io/"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    found = [tuple(r)[3:] for r in sorted(queries.op10_url_filter(spark, str(tmp_path)).collect())]
    assert found == [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"), (None, "allow")]


def test_licenses(spark):
    text = [(1, "x y z " * 30 + "Released under the MIT License. more"), (2, "nothing of the kind"), (3, None), (4, licenses.NOTICES["bsd"]), (4, licenses.NOTICES["bsd"]), (5, "q " * 99_999 + licenses.NOTICES["mit-whole"]), (6, ""), (None, licenses.NOTICES["isc"])]
    docs = spark.createDataFrame(text, "doc_id long, text string").withColumn("words", F.lit("clash")).withColumn("license", F.lit(1))
    found = {(r.doc_id, r.license) for r in licenses.scan_licenses(docs).collect()}
    assert found == {(1, "mit"), (4, "bsd"), (5, "mit-whole"), (5, "mit-text"), (None, "isc")}
    assert licenses.scan_licenses(docs.limit(0)).count() == licenses.scan_licenses(docs, {}).count() == 0


def test_many_templates_give_what_few_do(spark, monkeypatch):
    rng = random.Random(2)
    said = [f"w{i}" for i in range(300)]
    templates = {f"t{i}": " ".join(rng.choices(said, k=rng.choice([8, 12, 40]))) for i in range(30)}
    rows = [(None, "x"), (7, None), (8, "")]
    for i in range(80):
        words, inner = rng.choices(said, k=rng.randint(0, 60)), templates[f"t{i % 30}"].split()
        inner[rng.randrange(len(inner))] = "zz" if i % 4 else inner[0]
        words[len(words) // 2 : len(words) // 2] = inner
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    few = sorted(map(tuple, licenses.scan_licenses(docs, templates).collect()))
    monkeypatch.setattr(licenses, "TEMPLATES", 3)
    assert sorted(map(tuple, licenses.scan_licenses(docs, templates).collect())) == few and len(few) > 20


def test_warc_links_and_digests(spark):
    page = "<html><title>T &amp; U</title><script>no</script><p>Hello <a href='/x'>there</a></p></html>"
    data = warc.response(7, "http://a/", page, "2024-01-01T00:00:00Z")
    headers, block = warc.parse(data)
    about, text = (warc.parse(x) for x in warc.derive(data))
    assert about[0]["warc-refers-to"] == text[0]["warc-refers-to"] == headers["warc-record-id"]
    assert text[1].decode() == "T & U\nHello there" and text[0]["warc-source-payload-digest"] == warc.digest(page.encode())
    rows = [(7, "http://a/", page), (7, "http://a/", page), (7, "http://a/", "<p>other"), (8, None, None), (None, "http://b/", ""), (9, "http://c/\r\nX: y", "x" * 1_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("kind", F.lit("clash")).withColumn("path", F.lit(1))
    found = warc.linked_derivatives(pages).collect()
    assert len(found) == 5 and all(r.response_id == r.conversion_refers_to for r in found)
    # the same, record by record
    plain = set()
    for row in set(rows):
        data = warc.response(*row, "2024-01-01T00:00:00Z")
        (a, about), (t, text) = (warc.parse(x) for x in warc.derive(data))
        plain.add((row[0], warc.parse(data)[0]["warc-record-id"], a["warc-record-id"], t["warc-record-id"], t.get("warc-target-uri"), warc.digest((row[2] or "").encode()), warc.digest(text), len(text), len(about)))
    assert {(r.page_id, r.response_id, r.metadata_id, r.conversion_id, r.target, r.payload_digest, r.text_digest, r.text_bytes, r.metadata_bytes) for r in found} == plain
    assert warc.linked_derivatives(pages.limit(0)).count() == 0


def test_pages_are_read_as_plainly_said():
    said = {
        "<p>a<p>b<br/>c": ("a\nb\nc", None, []),
        "x<!-- <p>no</p> -->y<style>p{}</style>z": ("x y z", None, []),
        "a < b &lt; c": ("a < b < c", None, []),
        "<a class=x href = \"/1?a&amp;b\">t</a><a data-href='/no'>u</a><A HREF=/2>v": ("tuv", None, ["/1?a&b", "/2"]),
        "<title> A<b>B </title>c<title>D</title>": ("AB\nc\nD", "AB", []),
        "<scripty>kept</scripty><script>var a='</p>'</SCRIPT >z": ("kept z", None, []),
        "open <script>never closed": ("open", None, []),
        "": ("", None, []),
    }
    assert {k: warc.read_page(k) for k in said} == said
    assert warc._decoded("né".encode("latin-1"), "text/html; charset=ISO-8859-1") == "né" and warc._decoded(b"\xc3\xa9", "text/html; charset=none") == "é"
    for odd in ("<script>x", "<a", "<!--", "<p><!", "</script", "<a href=", "<title>", "&", "<style", "</"):
        began = time.monotonic()
        warc.read_page(odd * (1_000_000 // len(odd)))
        assert time.monotonic() - began < 5, odd


def test_language_id_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(docs, public_tokenizers.path("piece_bpe_32k.model"))
    found = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) >= 0.95
    odd = spark.createDataFrame([(1, None), (2, "12 34 !"), (3, "the thing")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(odd, model).collect()} | {3: "x"} == {1: "und", 2: "und", 3: "x"}


def test_language_sums_take_all_pieces_and_whole_words(spark):
    vocabulary = sorted({b" international", b"ab", "日本".encode(), "日本語日本語".encode()} | {bytes([i]) for i in range(256)})
    rng = np.random.default_rng(2)
    weights = np.concatenate([rng.random((len(vocabulary), 2)) * [1e-3, 1e-6] + 1e-9, np.zeros((1, 2))])

    def brute(word):
        alpha = np.full((len(word) + 1, 2), -np.inf)
        alpha[0] = 0
        for end, (k, x) in itertools.product(range(1, len(word) + 1), enumerate(vocabulary)):
            if word[:end].endswith(x):
                alpha[end] = np.logaddexp(alpha[end], alpha[end - len(x)] + np.log(weights[k]))
        return alpha[-1]

    words = [b" international", b" ab", b" " + "日本語".encode() * 40, b" " + b"ab" * 300]
    assert np.allclose(langid.Pieces(vocabulary).scores(words, weights), [brute(w) for w in words], rtol=1e-9)
    fitted = langid.fit(words, np.array([[1, 0], [0, 2], [3, 0], [0, 1]], float), langid.Pieces(vocabulary), len(vocabulary))
    assert np.allclose(fitted.sum(axis=0), 1, atol=1e-5) and fitted[vocabulary.index(b"ab"), 1] > 0.9
    data = np.frombuffer(("x" * 50).encode() + "語".encode() * 99, np.uint8)
    assert [x.tolist() for x in langid._words(data, np.array([0, len(data)]))[1:3]] == [[0], [len(data)]]
    rows = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    model = langid.train(rows, public_tokenizers.path("piece_bpe_32k.model"))
    assert langid.keep_identified(rows, model).count() == 1


def brute_scores(model, text):
    """Log probabilities of a text's words in each language, summed over segmentations one by one."""
    pieces = {x: k for k, x in enumerate(model.vocabulary)}
    longest, total = max(map(len, pieces)), np.zeros(len(model.languages))
    lowered = re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode())
    for word in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered):
        word = b" " + word
        alpha = np.full((len(word) + 1, len(model.languages)), -np.inf)
        alpha[0] = 0
        for end in range(1, len(word) + 1):
            for start in range(max(0, end - longest), end):
                if (k := pieces.get(word[start:end])) is not None:
                    alpha[end] = np.logaddexp(alpha[end], alpha[start] + np.log(model.weights[k]))
        total += alpha[-1]
    return total


def test_languages_against_plain_sums(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = langid.train(docs, public_tokenizers.path("piece_bpe_32k.model"))
    text = {r.doc_id: r.text[:600] if r.text else r.text for r in docs.orderBy("doc_id").limit(25).collect()} | {-1: None, -2: "", -3: "12 , 3", -4: "東京都" * 200, -5: "x" * 5000}
    odd = spark.createDataFrame(list(text.items()), "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("held_out", F.lit(1))
    found = {r.doc_id: r for r in langid.identify(odd.union(odd.limit(1)), model).collect()}
    for i, t in text.items():
        if not any(c.isalpha() for c in t or ""):
            assert (found[i].lang_pred, found[i].score) == ("und", 0.0)
            continue
        each = brute_scores(model, t)
        each = np.exp(each - each.max())
        assert found[i].lang_pred == model.languages[int(each.argmax())] and abs(found[i].score - each.max() / each.sum()) < 1e-6
        assert found[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert langid.identify(odd.limit(0), model).count() == 0


@pytest.fixture(scope="module")
def clashing(spark):
    """Documents with nulls, repeated rows and columns of names that operators use themselves."""
    rows = [(1, "the first text of these " * 9, "en"), (1, "the first text of these " * 9, "en"), (2, None, None), (3, "", "en"), (None, "no id here", "fr"), (4, "a text by itself, not like others", "en"), (5, "le texte " * 3000, "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("n_chars", F.length("text").cast("long"))
    for name in ("_gone", "runs", "spans", "_covered_id", "id", "_words", "_items", "_runs", "_spans", "node", "key", "component_id", "kept", "chunk", "path", "slot", "piece"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_with_odd_tables(spark, clashing, name, stage):
    found = stage(spark, clashing, "/root/testdata/sf0.001")
    if name != "packing":
        assert found.columns == clashing.columns and {r["_gone"] for r in found.collect()} == {"clash"}
        kept = {r.doc_id: r.text for r in found.collect()}
        assert kept[4] == "a text by itself, not like others" and (kept[2] is None if name != "language_id" else 2 not in kept)
    else:
        assert gapless(found.collect(), 2048) >= 1
    assert stage(spark, clashing.limit(0), "/root/testdata/sf0.001").count() == 0


def test_operators_with_odd_tables(spark, clashing):
    assert minhash.near_duplicates(clashing, width=2).count() == suffix.repeats(clashing).count() == 7
    items = spark.createDataFrame([(1, "a text by itself"), (None, "x"), (2, None)], "item_id long, text string").withColumn("spans", F.lit(1))
    found = decontam.contamination(clashing, items).collect()
    assert len(found) == 7 and {r.doc_id for r in found if r.contaminated} == {4}
    assert decontam.contamination(clashing, items.limit(0)).where("contaminated").count() == decontam.contamination(clashing.limit(0), items).count() == 0
    manifest, dictionary = tokens.write_ids(clashing, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    read = sorted(tokens.read_ids(manifest, dictionary).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in read] == [None, 1, 1, 2, 3, 4, 5] and read[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in itertools.pairwise(read))
    manifest, dictionary = tokens.write_ids(clashing.limit(0), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    assert tokens.read_ids(manifest, dictionary).count() == 0
    vectors = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(40)] + [(0, [1.0, 0.0]), (None, [1.0, 1.0])], "vec_id long, vector array<double>").withColumn("block", F.lit("clash")).withColumn("dim", F.lit("clash"))
    top = [r.vec_id for r in sorted(ann.nearest(vectors, k=25, query=F.col("vec_id") == 1).collect(), key=lambda r: r["rank"])]
    assert top == [*range(3, 40, 2), *range(0, 12, 2)]
    assert ann.nearest(vectors.limit(0)).count() == 0


def test_pipeline_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r.doc_id: r.text for r in corpus_pipeline.language_id(spark, docs, folder).select("doc_id", "text").collect()}
    sure = {r.doc_id for r in langid.identify(docs, langid.train(docs, public_tokenizers.path("piece_bpe_32k.model"))).where("lang_pred <> 'und' and score >= 0.5").collect()}
    assert set(kept) == sure
    # near duplicates
    sets, root = {i: shingles(t, 5) for i, t in kept.items()}, {i: i for i in kept}
    find = lambda i: i if root[i] == i else find(root[i])
    for a, b in itertools.combinations(sorted(sets), 2):
        k = len(sets[a] & sets[b])
        if k and 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    kept = {i: t for i, t in kept.items() if find(i) == i}
    # repeats
    held = {}
    for i, t in kept.items():
        b = t.encode()
        for p in range(len(b) - 49):
            held[b[p : p + 50]] = min(held.get(b[p : p + 50], i), i)
    left = {}
    for i, t in kept.items():
        b = t.encode()
        hit = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if held[b[p : p + 50]] < i:
                hit[p : p + 50] = True
        runs = [x.tobytes() for x in np.split(np.frombuffer(b, np.uint8), np.flatnonzero(np.diff(hit)) + 1)]
        of = [bool(x[0]) for x in np.split(hit, np.flatnonzero(np.diff(hit)) + 1)] if len(b) else []
        text = "".join(x.decode("utf-8", "ignore") for x, h in zip(runs, of, strict=False) if not h)
        if not hit.any() or text.strip():
            left[i] = text if hit.any() else t
    # benchmark passages
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())
    windows = {}
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        w = word.findall(lower(r.text))
        for i in range(max(0, len(w) - 9) if len(w) >= 10 else min(1, len(w))):
            windows.setdefault(min(10, len(w)), set()).add(tuple(w[i : i + 10]))
    clean = {}
    for i, t in left.items():
        raw = t.encode()
        found = list(word.finditer(lower(t)))
        hit = np.zeros(len(found), bool)
        for n, known in windows.items():
            for p in range(len(found) - n + 1):
                if tuple(m[0] for m in found[p : p + n]) in known:
                    hit[p : p + n] = True
        if hit.any() and hit.mean() >= 0.5:
            continue
        out, at = [], 0
        for p in range(len(found)):
            if hit[p] and (p == 0 or not hit[p - 1]):
                out.append(raw[at : found[p].start()])
            if hit[p]:
                at = found[p].end()
        clean[i] = b"".join([*out, raw[at:]]).decode("utf-8", "ignore") if hit.any() else t
    packed = corpus_pipeline.run(spark, folder).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed), key=str) == expected_pieces(list(clean.items()))
    assert gapless(packed, 2048) <= sum(r.length for r in packed) / 2048 + 2
