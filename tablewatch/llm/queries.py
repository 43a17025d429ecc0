"""One query for each operator over whole tables, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from .ann import nearest
from .decontam import contamination
from .langid import identify, train
from .licenses import NOTICES, scan_licenses
from .minhash import near_duplicates
from .packing import pack_documents
from .resample import resample
from .suffix import repeats
from .tokengroups import similar_documents
from .tokens import read_ids, write_ids
from .urlfilter import Rule, filter_urls
from .vectorcode import vector_codes
from .warc import linked_derivatives

BYTE_BPE, WORD_BPE, PIECES = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"
#: The rules that are asked for.
URL_RULES = [Rule("block", "com/en/"), Rule("allow", "example.com/en/7"), Rule("allow", "net/de/"), Rule("block", "example.net/de/8"), Rule("block", "org/es/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"), length=50).drop("spans")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).select("doc_id", "license", *[F.col(c).cast("long").alias(c) for c in ("n_shingles", "n_matched", "first_word")])


def op4_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return nearest(vectors, k=20, query=F.col("vec_id") % 20 == 0)


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, dictionary = write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), end_id=2)
    return read_ids(manifest, dictionary)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), end_id=0, capacity=2048)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10).drop("text", "spans")


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_derivatives(table(spark, sf_dir, "pages"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs, public_tokenizers.path(PIECES)))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"), width=3, percent=90)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_AZ.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
        ELSE list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) END AS s FROM w),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, len(a.s) + len(b.s) AS n, len(list_intersect(a.s, b.s)) AS k
      FROM s a JOIN s b ON a.doc_id < b.doc_id AND len(a.s) > 0 AND len(b.s) > 0
        AND 100 * least(len(a.s), len(b.s)) >= 80 * greatest(len(a.s), len(b.s))),
l AS (SELECT a, b FROM p WHERE 100 * k >= 80 * (n - k)),
e AS (SELECT a AS x, b AS y FROM l UNION ALL SELECT b, a FROM l),
r(x, y) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = s.doc_id
"""

_OP3 = f"""
WITH t AS (SELECT license, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in sorted(NOTICES.items()))}) v(license, text)),
ts AS (SELECT license, len(w) AS size, greatest(1, len(w) // 4) AS step, list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) AS s FROM t),
tx AS (SELECT license, step, size + step - 5 AS span, len(s) AS n_shingles, unnest(s) AS s FROM ts),
w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w),
d AS (SELECT doc_id, i - 1 AS p, array_to_string(w[i:i + 4], ' ') AS s FROM p),
m AS (SELECT d.doc_id, license, n_shingles, step, d.p, d.s, span FROM d JOIN tx ON d.s = tx.s),
x AS (SELECT *, unnest(range(greatest(0, (p - span + step) // step), p // step + 1)) * step AS start FROM m),
c AS (SELECT doc_id, license, n_shingles, start, count(DISTINCT s) AS n FROM x WHERE start <= p AND p < start + span GROUP BY ALL)
SELECT doc_id, license, CAST(n_shingles AS BIGINT) AS n_shingles, CAST(max(n) AS BIGINT) AS n_matched, CAST(min(start) AS BIGINT) AS first_word
FROM c WHERE 100 * n >= 80 * n_shingles GROUP BY doc_id, license, n_shingles
"""

_OP4 = """
WITH v AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce([q.e[i] * c.e[i] FOR i IN range(1, len(q.e) + 1)], lambda a, b: a + b) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

_OP7 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_AZ.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_AZ.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM bi),
ns AS (SELECT DISTINCT n FROM bw),
di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM di),
m AS (SELECT doc_id, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""

_OP10 = f"""
WITH r(rule, verdict, host, path) AS (VALUES {", ".join(f"('{r.pattern}', '{r.verdict}', '{r.host}', '{r.path}')" for r in URL_RULES)}),
u AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT row_number() OVER () AS k, page_id, {_AZ.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT p.k, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.k)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (k)
"""

_OP11 = rf"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_AZ.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s FROM w),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, len(a.s) + len(b.s) AS n, len(list_intersect(a.s, b.s)) AS k
      FROM s a JOIN s b ON a.doc_id < b.doc_id AND len(a.s) > 0 AND len(b.s) > 0
        AND 100 * least(len(a.s), len(b.s)) >= 90 * greatest(len(a.s), len(b.s))),
l AS (SELECT a, b FROM p WHERE 100 * k >= 90 * (n - k)),
e AS (SELECT a AS x, b AS y FROM l UNION ALL SELECT b, a FROM l),
c(x, y) AS (SELECT doc_id, doc_id FROM s UNION SELECT c.x, e.y FROM c JOIN e ON c.y = e.x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id
FROM s LEFT JOIN (SELECT x, min(y) AS component_id FROM c GROUP BY x) m ON m.x = s.doc_id
"""


def _op12_round(n: int) -> str:
    """Parts with their nearest entries of codebook ``n``, and the codebook that follows."""
    return f"""
a{n} AS (SELECT r, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d
  FROM (SELECT p.r, p.part, b.entry, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(p.x, b.x)]) AS d FROM p JOIN b{n} b USING (part)) GROUP BY r, part),
u{n} AS (SELECT part, entry, list(CAST(floor(total / many) AS BIGINT) ORDER BY spot) AS x
  FROM (SELECT a.part, a.entry, spot, sum(p.x[spot]) AS total, count(*) AS many FROM a{n} a JOIN p USING (r, part), range(1, (SELECT max(width) FROM k) + 1) t(spot) GROUP BY ALL) GROUP BY part, entry),
b{n + 1} AS (SELECT part, entry, coalesce(u.x, b.x) AS x FROM b{n} b LEFT JOIN u{n} u USING (part, entry))"""


_OP12 = f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, len(embedding) // 16 AS width,
    [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS MATERIALIZED (SELECT r, part, v[part * width + 1:(part + 1) * width] AS x FROM k, range(16) t(part)),
b0 AS (SELECT part, r - 1 AS entry, x FROM p WHERE r <= 64),{_op12_round(0)},{_op12_round(1)},{_op12_round(2)},
f AS (SELECT r, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY r),
h AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, spot)) AS codebooks_sha256
  FROM (SELECT part, entry, unnest(x) AS x, generate_subscripts(x, 1) AS spot FROM b2))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN f USING (r), h
"""

_CRC_BYTE = "list_reduce([{}, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)"

_OP13 = rf"""
WITH crc AS MATERIALIZED (SELECT list({_CRC_BYTE.format("CAST(b AS BIGINT)")} ORDER BY b) AS t FROM range(256) r(b)),
texts AS (SELECT row_number() OVER () AS r, false AS target, doc_id, text FROM documents UNION ALL SELECT row_number() OVER (), true, NULL, text FROM benchmark),
w AS MATERIALIZED (SELECT r, target, doc_id, regexp_extract_all({_AZ.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
f AS MATERIALIZED (SELECT r, target, array_to_string(w[i:i + n - 1], ' ') AS f, count(*) AS n FROM (SELECT r, target, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, range(1, 4) t(n)) GROUP BY r, target, f),
g AS MATERIALIZED (SELECT f, xor(list_reduce([4294967295] || [CAST('0x' || hex(encode(f))[2 * i - 1:2 * i] AS BIGINT) FOR i IN range(1, strlen(f) + 1)],
  lambda c, x: xor(t[xor(c, x) % 256 + 1], c // 256)), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT f FROM f), crc),
c AS (SELECT bucket, CAST(coalesce(sum(n) FILTER (NOT target), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (target), 0) AS DOUBLE) AS t FROM f JOIN g USING (f) GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM c) + 10000) / ((s + 1) * ((SELECT sum(t) FROM c) + 10000)))) AS BIGINT) AS gain FROM c),
d AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM f JOIN g USING (f) JOIN gain USING (bucket) WHERE NOT target GROUP BY r),
h AS (SELECT w.r, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  CAST('0x' || sha256('42:' || CAST(doc_id AS VARCHAR))[1:8] AS BIGINT) AS h FROM w LEFT JOIN d USING (r) WHERE NOT target),
o AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM h),
q AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, n_features) AS rank, count(*) OVER () AS n FROM o WHERE n_words >= 20 AND doc_id IS NOT NULL)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * n // 100 THEN rank END AS rank FROM o LEFT JOIN q USING (r)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_minhash_near_dedup, op2_suffix_dedup, op3_license_scan, op4_ann_search, op5_token_ids, op6_best_fit_packing, op7_decontamination, op8_warc_derivatives, op9_language_id, op10_url_filter, op11_ngram_jaccard_join, op12_vector_codes, op13_importance_resampling]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_near_dedup": _OP1, "op3_license_scan": _OP3, "op4_ann_search": _OP4, "op7_decontamination": _OP7, "op10_url_filter": _OP10, "op11_ngram_jaccard_join": _OP11, "op12_vector_codes": _OP12, "op13_importance_resampling": _OP13}
