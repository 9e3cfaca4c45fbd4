"""The registered queries of this subpackage: thin digests of its operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_id, line_dedup, near_dup, packing, pu_classifier, quality_rules, sharding, substring_dedup, url_filter, vector_codes, warc, whitening
from .frames import table


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_benchmark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated().alias("contaminated"),
    )


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.find_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_table(table(spark, sf_dir, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The contract's rules.
URL_RULES = [url_filter.Rule("block", "net", "/"), url_filter.Rule("allow", "example.net", "/en/"), url_filter.Rule("block", "example.com", "/de/"), url_filter.Rule("allow", "org", "/fr/")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def captures(pages: DataFrame) -> DataFrame:
    """A capture log of all pages: page n is fetched at minute n and asked for again a day later, when its server
    answers not-modified with the page's entity tag and a new date. Where pages share a canonical url, the latest
    earlier response can be another page's, whose tag then differs."""
    tag = F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    base = pages.select("page_id", "url", tag.alias("tag"), F.octet_length("html").cast("string").alias("size"))
    minute = lambda day: F.timestamp_seconds(F.lit(1704067200) + F.lit(86400 * day) + F.col("page_id") * 60)
    full = base.select(F.concat(F.lit("r"), "page_id").alias("record_id"), F.lit("response").alias("record_type"), "url", minute(0).alias("ts"), F.map_from_arrays(F.array(F.lit("etag"), F.lit("content-length"), F.lit("date")), F.array(F.concat(F.lit('W/"'), "tag", F.lit('"')), "size", F.col("page_id").cast("string"))).alias("headers"), F.col("tag").alias("payload_digest"))
    again = base.select(F.concat(F.lit("v"), "page_id").alias("record_id"), F.lit("revisit").alias("record_type"), "url", minute(1).alias("ts"), F.map_from_arrays(F.array(F.lit("etag"), F.lit("content-length"), F.lit("date")), F.array(F.concat(F.lit('"'), "tag", F.lit('"')), F.lit("0"), F.concat("page_id", F.lit("+1")))).alias("headers"), F.lit(None).cast("string").alias("payload_digest"))
    return full.unionByName(again)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(captures(table(spark, sf_dir, "pages")))
    return found.select("record_id", "canonical_url", "resolved_id", "outcome", *(F.col("headers")[h].alias(n) for h, n in (("etag", "etag"), ("content-length", "size"), ("date", "date"))))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    each = found.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "of"))
    return each.select("vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", "of.whitened", "of.explained", "identity_error")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, codebooks = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.codebooks_digest(codebooks)).alias("codebooks_sha256"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_decontaminate": op2_decontaminate,
    "op3_near_dup": op3_near_dup,
    "op4_url_filter": op4_url_filter,
    "op5_packing": op5_packing,
    "op6_quality_rules": op6_quality_rules,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_warc": op9_warc,
    "op10_language_id": op10_language_id,
    "op11_whitening": op11_whitening,
    "op12_line_dedup": op12_line_dedup,
    "op13_vector_codes": op13_vector_codes,
}

_WORDS2 = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = {
    "op4_url_filter": r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(v, h, s) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
f AS (SELECT page_id, max_by(h || s, len(h || s)) AS rule, max_by(v, len(h || s)) AS v
      FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN f USING (page_id)""",
    "op2_decontaminate": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS2}, []) AS w FROM documents),
b AS (SELECT item_id, coalesce({_WORDS2}, []) AS w FROM benchmark),
i AS (SELECT item_id, w, least(13, len(w)) AS m FROM b WHERE len(w) > 0),
p AS (SELECT DISTINCT item_id, m, array_to_string(w[j:j + m - 1], ' ') AS s
      FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS j FROM i)),
n AS (SELECT DISTINCT m FROM p),
x AS (SELECT r, m, j, array_to_string(w[j:j + m - 1], ' ') AS s
      FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS j FROM d, n WHERE len(w) >= m)),
h AS (SELECT x.r, x.m, x.j, p.item_id FROM x JOIN p ON x.s = p.s AND x.m = p.m),
c AS (SELECT r, count(DISTINCT j + k) AS n_hit FROM (SELECT DISTINCT r, m, j FROM h) AS q, range(0, 13) AS g(k) WHERE k < m GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
      FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)""",
    "op7_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
x AS (SELECT r, doc_id, j, array_to_string(w[j:j + 12], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 11)) AS j FROM d WHERE len(w) >= 13)),
m AS (SELECT r, j, doc_id > min(doc_id) OVER (PARTITION BY s) AS gone FROM x),
g AS (SELECT DISTINCT r, j + k AS p FROM m, range(0, 13) AS q(k) WHERE gone),
l AS (SELECT r, list(p) AS gone FROM g GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ')
              ELSE coalesce(array_to_string(list_filter(w, lambda x, i: NOT list_contains(gone, i)), ' '), '') END) AS kept_sha256
FROM d LEFT JOIN l USING (r)""",
    "op9_warc": r"""
WITH u AS (SELECT page_id, md5(coalesce(html, '')) AS tag, CAST(strlen(html) AS VARCHAR) AS size,
             CASE WHEN instr(url, '://') > 0 THEN regexp_replace(substr(url, instr(url, '://') + 3), '#.*', '', 's') END AS rest FROM pages),
p AS (SELECT *, regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), ':(80|443)$', '') AS host,
             regexp_extract(rest, '^[^/?]*([^?]*)', 1) AS path,
             array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*\?(.*)', 1), '&'),
               lambda q: q <> '' AND split_part(q, '=', 1) NOT IN ('ref', 'fbclid', 'gclid', 'sessionid') AND NOT starts_with(q, 'utm_'))), '&') AS q FROM u),
c AS (SELECT page_id, tag, size, host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS canon FROM p),
m AS (SELECT v.page_id, max_by(r.page_id, r.page_id) AS rid FROM c v LEFT JOIN c r ON v.canon = r.canon AND r.page_id < v.page_id + 1440 GROUP BY v.page_id)
SELECT 'v' || v.page_id AS record_id, v.canon AS canonical_url, 'r' || rid AS resolved_id,
       CASE WHEN rid IS NULL THEN 'missing' WHEN r.tag = v.tag THEN 'resolved' ELSE 'changed' END AS outcome,
       '"' || v.tag || '"' AS etag, CASE WHEN r.tag = v.tag THEN r.size ELSE '0' END AS size, v.page_id || '+1' AS "date"
FROM c v JOIN m USING (page_id) LEFT JOIN c r ON r.page_id = m.rid""",
    "op12_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT r, doc_id, j, translate(trim(l[j], ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM (SELECT *, unnest(range(1, len(l) + 1)) AS j FROM d)),
f AS (SELECT k, max(doc_id) AS keeper FROM x WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
g AS (SELECT r, list(j) AS gone FROM x JOIN f USING (k) WHERE doc_id <> keeper GROUP BY r)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_dropped,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(l, chr(10))
              ELSE coalesce(array_to_string(list_filter(l, lambda s, i: NOT list_contains(gone, i)), chr(10)), '') END) AS kept_sha256
FROM d LEFT JOIN g USING (r)""",
}
