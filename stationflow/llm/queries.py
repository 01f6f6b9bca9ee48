"""Registered queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationflow.llm import (
    brown, decontaminate, hyperminhash, infill, language, licenses, merkle, mixing, pii, quality, repeats, simhash, url_filter,
)
from stationflow.llm.base import sha256_text, table

# Names of listed hosts (fixed values).
LISTED = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op2_repeated_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.repeated_bytes(table(spark, sf, "documents"))


def op3_language(spark: SparkSession, sf: str) -> DataFrame:
    return language.identified(table(spark, sf, "documents"))


def op4_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"))


def op5_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf, "documents"))


def op6_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, sf, "documents"))


def op7_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Listed are the URLs of all pages on hosts known for ads, spam, gambling and the like."""
    pages = table(spark, sf, "pages")
    listed = pages.select("url").where(url_filter.host(F.col("url")).rlike(f"^(.*[.])?({'|'.join(LISTED)})[.]"))
    return url_filter.judge_urls(pages, listed)


def op8_mixing(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return mixing.mix(docs, mixing.square_root_weights(docs))


def op9_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    return pii.personal_data(table(spark, sf, "documents"))


def op10_brown_scores(spark: SparkSession, sf: str) -> DataFrame:
    return brown.perplexity_scores(table(spark, sf, "documents"))


def op11_hyperminhash(spark: SparkSession, sf: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf, "documents"))


def manifest_digests(docs: DataFrame, height: int = merkle.HEIGHT) -> DataFrame:
    """The manifest with each proof's digest and the root that a partly tampered table leads to."""
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = merkle.leaf(F.when(half, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text")))
    rows = merkle.manifest(docs, {"tampered": tampered}, height)
    rows = rows.withColumn("folded_root", merkle.folded(F.col("tampered"), F.col("witness")))
    return rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("witness")).alias("proof_sha256"),
                       "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return manifest_digests(table(spark, sf, "documents"))


def infill_digests(docs: DataFrame) -> DataFrame:
    """Digests of the transformed texts and of the texts rebuilt from them."""
    made = infill.fill_in_middle(docs)
    made = made.withColumn("restored", infill.restored(F.col("output"), F.col("form")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha256_text(F.col("output")).alias("output_sha256"),
                       sha256_text(F.col("restored")).alias("restored_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    return infill_digests(table(spark, sf, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_decontamination, op2_repeated_bytes, op3_language, op4_simhash, op5_licenses, op6_quality_rules, op7_url_filter, op8_mixing, op9_personal_data,
    op10_brown_scores, op11_hyperminhash, op12_merkle_manifest, op13_fill_in_middle)}


def _canonical_sql() -> str:
    host = "lower(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''))"
    path = "coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '')"
    query = "regexp_extract(url, '://[^?#]*[?]([^#]*)', 1)"
    kept = (f"array_to_string(list_sort(list_filter(string_split({query}, '&'), "
            "lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref)='))), '&')")
    return f"""
WITH p AS (SELECT page_id, {host} AS host, {path} AS path, {kept} AS q FROM pages),
c AS (SELECT *, CASE WHEN host <> '' THEN
        regexp_replace(regexp_replace(host, '^www[.]', ''), ':(80|443)$', '')
        || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q = '' THEN '' ELSE '?' || q END END AS key FROM p),
listed AS (SELECT DISTINCT key FROM c
           WHERE key IS NOT NULL AND regexp_matches(host, '^(.*[.])?({'|'.join(LISTED)})[.]')),
r AS (SELECT *, key IN (SELECT key FROM listed) AS hit, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM c)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN hit THEN 'block' ELSE 'allow' END AS verdict, coalesce(hit, false) AS listed FROM r"""


INFILL_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
h AS (SELECT *, len(u) AS n, CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2,
    CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE
    WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
           ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""

HYPERMINHASH_SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END) AS s FROM w),
k AS (SELECT doc_id, len(s) AS n, CASE WHEN len(s) > 0 THEN sha256(array_to_string(s, chr(10))) END AS k, s FROM s),
f AS (SELECT k, min(doc_id) AS node, any_value(n) AS n, any_value(s) AS s FROM k WHERE n > 0 GROUP BY k),
p AS (SELECT node, n, unnest(s) AS x FROM f),
l AS (SELECT a.node AS a, b.node AS b FROM p a JOIN p b ON a.x = b.x AND a.node < b.node
    GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT node, node AS seen FROM f UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
c AS (SELECT node, min(seen) AS root FROM r GROUP BY node)
SELECT k.doc_id, k.n AS n_shingles, coalesce(c.root, k.doc_id) AS component_id, coalesce(c.root, k.doc_id) = k.doc_id AS kept
FROM k LEFT JOIN f ON f.k = k.k LEFT JOIN c ON c.node = f.node"""

MERKLE_SQL = """
WITH RECURSIVE
bits AS (SELECT DISTINCT doc_id, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda c: list_transform(range(8), lambda k: (ascii(c) >> k) & 1))) AS b FROM documents),
-- crc32 bit by bit
odd AS (SELECT doc_id, xor(list_reduce(b, lambda c, x: CASE WHEN xor(c, x) & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END,
    4294967295), 4294967295) % 2 = 1 AS odd FROM bits),
base AS (SELECT doc_id, source, text, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-')
    || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM documents),
leaves AS (SELECT *, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) AS other FROM base),
placed AS (SELECT doc_id, source, leaf, other,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    count(*) OVER (PARTITION BY source) AS n FROM leaves),
grow AS (SELECT source, 0 AS h, i, n, leaf AS d FROM placed
    UNION ALL
    SELECT source, h + 1, i // 3, (max(n) + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM grow WHERE n > 1 GROUP BY source, h, i // 3),
subs AS (SELECT source, d AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n
    FROM grow WHERE n = 1),
top AS (SELECT 0 AS h, i, n, subroot AS d FROM subs
    UNION ALL
    SELECT h + 1, i // 3, (max(n) + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY h, i // 3),
runs AS (SELECT source, h, i // 3 AS run, list(d ORDER BY i) AS ds FROM grow WHERE n > 1 GROUP BY source, h, i // 3),
topruns AS (SELECT h, i // 3 AS run, list(d ORDER BY i) AS ds FROM top WHERE n > 1 GROUP BY h, i // 3),
way AS (SELECT p.doc_id, p.source, leaf, i, 0 AS h, '' AS proof, i AS at,
        CASE WHEN coalesce(odd, true) THEN leaf ELSE other END AS now
    FROM placed p JOIN odd ON odd.doc_id IS NOT DISTINCT FROM p.doc_id
    UNION ALL
    SELECT w.doc_id, w.source, w.leaf, w.i, w.h + 1,
        w.proof || array_to_string(list_concat(ds[:w.at % 3], ds[w.at % 3 + 2:]), ''), w.at // 3,
        sha256(array_to_string(list_concat(ds[:w.at % 3], [w.now], ds[w.at % 3 + 2:]), ''))
    FROM way w JOIN runs r ON r.source IS NOT DISTINCT FROM w.source AND r.h = w.h AND r.run = w.at // 3),
ends AS (SELECT w.*, s.subroot, s.i AS si FROM (SELECT *, row_number() OVER (PARTITION BY source, i ORDER BY h DESC) AS k FROM way) w
    JOIN subs s ON s.source IS NOT DISTINCT FROM w.source WHERE k = 1),
up AS (SELECT doc_id, leaf, subroot, source, i, 0 AS h, proof, si AS at, now FROM ends
    UNION ALL
    SELECT u.doc_id, u.leaf, u.subroot, u.source, u.i, u.h + 1,
        u.proof || array_to_string(list_concat(ds[:u.at % 3], ds[u.at % 3 + 2:]), ''), u.at // 3,
        sha256(array_to_string(list_concat(ds[:u.at % 3], [u.now], ds[u.at % 3 + 2:]), ''))
    FROM up u JOIN topruns r ON r.h = u.h AND r.run = u.at // 3)
SELECT doc_id, leaf, subroot, (SELECT d FROM top WHERE n = 1) AS root, sha256(proof) AS proof_sha256, now AS folded_root,
    now = (SELECT d FROM top WHERE n = 1) AS verified
FROM (SELECT *, row_number() OVER (PARTITION BY source, i ORDER BY h DESC) AS k FROM up) WHERE k = 1"""


SQL: dict[str, str] = {"op7_url_filter": _canonical_sql(), "op11_hyperminhash": HYPERMINHASH_SQL,
                       "op12_merkle_manifest": MERKLE_SQL,
                       "op13_fill_in_middle": INFILL_SQL}
