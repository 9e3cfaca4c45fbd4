"""Queries on scanning, classifying, chunking and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import chunking, rules, stats
from ..sources import corpus, web
from .registry import query, table

_PATH = "source || '/' || lang || '/doc_' || doc_id || CASE lang WHEN 'en' THEN '.md' WHEN 'fr' THEN '.ts' WHEN 'de' THEN '.json' ELSE '.py' END"
_FILES = f"SELECT doc_id, source AS repo_key, {_PATH} AS path, text AS content, CASE lang WHEN 'en' THEN 'markdown' WHEN 'fr' THEN 'typescript' WHEN 'de' THEN 'json' ELSE 'python' END AS language FROM documents"
#: Paths of every class, made of the documents' ids (the same expression in both dialects).
MADE_PATH = "CASE doc_id % 6 WHEN 0 THEN concat('src/features/', source, '/View', doc_id, '.tsx') WHEN 1 THEN concat('test/', source, '/m', doc_id, '.test.ts') WHEN 2 THEN concat('packages/', lang, '/docs/readme_', doc_id, '.md') WHEN 3 THEN concat('packages/', lang, '/src/gen/', source, '.json') WHEN 4 THEN concat('./app/', source, '/Page.PNG') ELSE concat('packages/', lang, '/core/src/m', doc_id, '.js') END"
_LINES = r"CASE WHEN t[-1] = '' THEN t[1:len(t) - 1] ELSE t END"
_WINDOWS = "SELECT {cols}, unnest(CASE WHEN len(l) = 0 THEN []::BIGINT[] ELSE list_transform(range(0, CAST(greatest(0, ceil((len(l) - 20) / 15.0)) AS BIGINT) + 1), lambda k: k * 15) END) AS s FROM {source}"


def _files(spark, sf):
    return corpus.documents_as_files(table(spark, sf, "documents"))


def _made(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.expr(MADE_PATH).alias("path"), "text", "n_chars", "source", "lang")


@query(f"SELECT doc_id, path, language FROM ({_FILES})")
def language_detect(spark, sf):
    return _files(spark, sf).select("doc_id", "path", "language")


@query(f"""SELECT doc_id, CASE WHEN regexp_matches(path, '(^|/)src1(/|$)|/fr/') THEN 'configured generatedPaths match'
  WHEN contains(lower(content[1:4096]), 'do not edit') THEN 'header marker: do not edit' END AS reason FROM ({_FILES})""")
def generated_flag(spark, sf):
    files = _files(spark, sf)
    return files.select("doc_id", paths.generated_reason(F.col("path"), F.col("content"), ["src1", "*/fr/**"]).alias("reason"))


@query(f"""SELECT doc_id, replace(regexp_replace(path, '^\\./', ''), '', '') AS rel, regexp_matches(path, '(^|/)(tests?|__tests__)(/|$)|\\.(test|spec)\\.[jt]sx?$') AS is_test,
  ends_with(path, '.md') OR contains(path, '/docs/') OR contains(path, '/readme') AS is_doc, lower(path) LIKE '%.png' AS is_binary,
  CASE WHEN contains(path, '/gen/') THEN 'generated directory path' END AS generated,
  CASE WHEN starts_with(path, 'src/features/') THEN 'src/features/' || source END AS feature,
  CASE WHEN regexp_matches(path, '^packages/en/core/') THEN 'en-core' WHEN regexp_matches(path, '^packages/en/') THEN 'en' WHEN regexp_matches(path, '^(\\./)?app/') THEN 'app' END AS package
FROM (SELECT *, {MADE_PATH} AS path FROM documents)""")
def path_classes(spark, sf):
    p = F.col("path")
    packages = {"packages/en": "en", "packages/en/core/": "en-core", "./app": "app"}
    return _made(spark, sf).select("doc_id", paths.normalized(p).alias("rel"), paths.is_test_path(p).alias("is_test"), paths.is_doc_path(p).alias("is_doc"), paths.is_binary_path(p).alias("is_binary"), paths.generated_reason(p, F.lit("")).alias("generated"), paths.feature_root(p).alias("feature"), paths.longest_prefix(p, packages).alias("package"))


#: A name, a glob of every form, and the expression that DuckDB checks it with.
_GLOBS = {
    "any_src": ("src", r"(^|/)src(/|$)"),
    "docs": ("packages/*/docs/**/*.md", r"^packages/[^/]+/docs/.*\.md$"),
    "views": ("src/features/*/View*.tsx", r"^src/features/[^/]*/View[^/]*\.tsx$"),
    "typed": ("*.{ts,tsx}", r"\.(ts|tsx)$"),
    "brace_dirs": ("{src/features/src1,packages/{fr,de}/docs}/**", r"^(src/features/src1|packages/(fr|de)/docs)/."),
    "brace_range": ("**/m{1..99}.{test.ts,js}", r"(^|/)m[1-9][0-9]?\.(test\.ts|js)$"),
    "brace_padded": ("readme_{08..110..6}.md", r"readme_(008|014|020|026|032|038|044|050|056|062|068|074|080|086|092|098|104|110)\.md$"),
    "one_or_more": ("View+([0-4]|7).tsx", r"(^|/)View[0-47]+\.tsx$"),
    "any_number": ("m*(1|23).test.ts", r"(^|/)m(1|23)*\.test\.ts$"),
    "perhaps": ("{m,readme_}?(1)[0-9].@(js|md)", r"(^|/)(m|readme_)1?[0-9]\.(js|md)$"),
    "all_but": ("packages/!(en|fr)/!(src)/**", r"^packages/(es|de)/(docs|core)/."),
    "posix": ("[[:upper:]]iew[[:digit:]][[:digit:]].[^[:space:]j]*", r"(^|/)View[0-9][0-9]\.tsx$"),
    "turned": ("!packages/**/*.{js,json}", None),
    "comment": ("#src/**", None),
    "parent": ("src/../test//*/m*", r"^test/[^/]+/m[^/]*$"),
}


def _glob_sql(name):
    # A glob that is turned round fits by one of its forms: the path, the base name, or what lies below.
    return "true" if name == "turned" else "false" if name == "comment" else f"regexp_matches(rel, '{_GLOBS[name][1]}')"


@query(f"SELECT doc_id, {', '.join(f'{_glob_sql(n)} AS {n}' for n in _GLOBS)} FROM (SELECT doc_id, regexp_replace({MADE_PATH}, '^\\./', '') AS rel FROM documents)")
def glob_match(spark, sf):
    return _made(spark, sf).select("doc_id", *(paths.matches_any(F.col("path"), [glob]).alias(name) for name, (glob, _) in _GLOBS.items()))


@query(f"""SELECT count(*) FILTER (WHERE r IS NULL) AS files, count(r) AS skipped, count(*) FILTER (WHERE r = 'ignored') AS skipped_ignored,
  count(*) FILTER (WHERE r = 'binary') AS skipped_binary, count(*) FILTER (WHERE r = 'too_large') AS skipped_too_large
FROM (SELECT CASE WHEN regexp_matches(path, '(^|/)src7(/|$)|^test/') THEN 'ignored' WHEN lower(path) LIKE '%.png' THEN 'binary' WHEN strlen(text) > 5000 THEN 'too_large' END AS r
      FROM (SELECT *, {MADE_PATH} AS path FROM documents))""")
def scan_counters(spark, sf):
    files = _made(spark, sf).select("path", F.octet_length("text").alias("size_bytes"), F.col("text").cast("binary").alias("content"))
    return stats.scan_counters(corpus.classify(files, corpus.ScanConfig(exclude=("src7", "test/**"), max_file_bytes=5000)))


@query("SELECT doc_id, sha256(text) AS file_hash, strlen(text) AS size_bytes FROM documents")
def content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("file_hash"), F.octet_length("text").cast("long").alias("size_bytes"))


@query("SELECT sha256(text) AS file_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def exact_duplicates(spark, sf):
    hashed = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("file_hash"))
    return hashed.groupBy("file_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


@query("SELECT source, count(*) AS files, sum(n_chars) AS chars, count(DISTINCT lang) AS languages, count(quality) AS labelled, avg(quality) AS quality FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def corpus_stats(spark, sf):
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return joined.groupBy("source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"), F.countDistinct("lang").alias("languages"), F.count("quality").alias("labelled"), F.avg("quality").alias("quality"))


@query(f"SELECT doc_id, len({_LINES}) AS n_lines FROM (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS t FROM documents)")
def line_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(text.split_lines(F.col("text"))).cast("long").alias("n_lines"))


@query(f"""WITH d AS (SELECT doc_id, {_LINES} AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents)), w AS ({_WINDOWS.format(cols="doc_id, l", source="d")})
SELECT doc_id, CAST(s + 1 AS INTEGER) AS start_line, CAST(least(s + 20, len(l)) AS INTEGER) AS end_line, sha256(array_to_string(l[s + 1:least(s + 20, len(l))], chr(10))) AS content_hash FROM w""")
def line_window_chunks(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", text.split_lines(F.col("text")).alias("lines"))
    rows = docs.select("doc_id", F.explode(chunking.line_windows(F.col("lines"), F.lit("module"), 20, 5)).alias("c"))
    return rows.select("doc_id", "c.start_line", "c.end_line", F.sha2("c.content", 256).alias("content_hash"))


@query(f"""WITH d AS (SELECT *, {_LINES} AS l FROM (SELECT *, string_split(content, chr(10)) AS t FROM ({_FILES}))),
w AS ({_WINDOWS.format(cols="path, language, content, l", source="d WHERE NOT (language = 'json' AND len(l) <= 20)")}),
c AS (SELECT path, CASE language WHEN 'markdown' THEN 'markdown_section' WHEN 'json' THEN 'config' ELSE 'module' END AS chunk_kind, s + 1 AS start_line, least(s + 20, len(l)) AS end_line,
        array_to_string(l[s + 1:least(s + 20, len(l))], chr(10)) AS content FROM w
      UNION ALL SELECT path, 'config', 1, greatest(1, len(l)), content FROM d WHERE language = 'json' AND len(l) <= 20)
SELECT path, chunk_kind, count(*) AS chunks, CAST(max(end_line) AS INTEGER) AS last_line, sum(length(content)) AS chars FROM c WHERE regexp_matches(content, '\\S') GROUP BY path, chunk_kind""")
def chunk_dispatch(spark, sf):
    chunks = chunking.chunk_files(_files(spark, sf), 20, 5)
    return chunks.groupBy("path", "chunk_kind").agg(F.count("*").alias("chunks"), F.max("end_line").alias("last_line"), F.sum(F.length("content")).alias("chars"))


@query(r"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '<h[1-6][^>]*>', 0)) AS tag FROM pages)
SELECT page_id, 'h' || tag[3:3] AS level, count(*) AS n FROM h GROUP BY ALL""")
def html_headings(spark, sf):
    tags = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<(h[1-6])[^>]*>"), 1)).alias("level"))
    return tags.groupBy("page_id", "level").agg(F.count("*").alias("n"))


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\b.*?</script\s*>', ' ', 'gis'), '<style\b.*?</style\s*>', ' ', 'gis'), '<head\b.*?</head\s*>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS body FROM pages""")
def html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", web.html_words(F.col("html")).alias("body"))


@query()
def html_to_markdown(spark, sf):
    return table(spark, sf, "pages").select("page_id", web.html_to_markdown(F.col("html")).alias("markdown"), web.html_to_text(F.col("html")).alias("plain"))


@query(r"""WITH q AS (SELECT conv_id, turn, list_filter(list_transform(string_split_regex(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+'), lambda t: regexp_replace(t, '[^\p{L}\p{N}_./:-]', '', 'g')), lambda t: length(t) >= 2)[1:12] AS t,
  list_filter(string_split_regex(text, '[^A-Za-z0-9_./-]+'), lambda t: length(t) >= 2)[1:20] AS p FROM conversations)
SELECT conv_id, turn, array_to_string(list_transform(t, lambda x: '"' || x || '"'), ' OR ') AS expression, array_to_string(p, ' ') AS tokens FROM q""")
def query_sanitize(spark, sf):
    t = F.col("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", text.match_expression(t).alias("expression"), F.array_join(text.path_tokens(t), " ").alias("tokens"))


@query(r"""SELECT conv_id, turn, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]{3,}')), lambda w: w NOT IN ('const', 'function', 'return', 'type', 'interface', 'string', 'number', 'boolean', 'undefined', 'export', 'import', 'from', 'true', 'false'))), ' ') AS terms,
 trim(regexp_replace(lower(text), '[^a-z0-9_./-]+', ' ', 'g')) AS normal FROM conversations""")
def term_sets(spark, sf):
    t = F.col("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(text.code_terms(t)), " ").alias("terms"), text.plain(t).alias("normal"))


@query(f"""SELECT doc_id, array_to_string(list_distinct([regexp_replace(path, '^\\./', ''), 'lib/x.' || source]), ',') AS mentioned FROM (SELECT doc_id, source, {MADE_PATH} AS path FROM documents) WHERE doc_id % 6 <> 4
UNION ALL SELECT doc_id, 'app/' || source || '/Page.PNG,lib/x.' || source FROM documents WHERE doc_id % 6 = 4""".replace("array_to_string(list_distinct([regexp_replace(path, '^\\./', ''), 'lib/x.' || source]), ',')", "regexp_replace(path, '^\\./', '') || ',lib/x.' || source"))
def path_mentions(spark, sf):
    message = F.concat(F.lit("please look at "), "path", F.lit("  and then `lib/x."), "source", F.lit("`, or http://h.io/a/b.html"))
    found = _made(spark, sf).select("doc_id", text.mentioned_paths(message).alias("m"))
    return found.select("doc_id", F.array_join("m", ",").alias("mentioned"))


@query(r"""SELECT doc_id, CASE WHEN length(c) <= 160 THEN c ELSE c[1:157] || '...' END AS label, CASE WHEN length(text) > 6000 THEN text[1:6000] || chr(10) || '... truncated ...' ELSE text END AS body
FROM (SELECT doc_id, text, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS c FROM documents)""")
def display_forms(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", text.shorten(t, 160).alias("label"), text.cut_with_mark(t, 6000).alias("body"))


@query(r"""SELECT page_id, lower(h || '/' || regexp_replace(regexp_replace(p, '^/+|/+$', '', 'g'), '(?i)\.git$', '')) AS remote, sha256(lower(h || '/' || regexp_replace(p, '^/+|/+$', '', 'g'))) AS repo_key
FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS h, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM pages)""")
def repo_keys(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.remote_key(F.col("url")).alias("remote"), text.repo_key(F.col("url")).alias("repo_key"))


@query(r"""WITH l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), f AS (SELECT source, regexp_replace(regexp_replace(line, '\s+', ' ', 'g'), '^ | $', '', 'g') AS pattern FROM l)
SELECT source, pattern, count(*) AS n FROM f WHERE length(pattern) >= 80 AND NOT regexp_matches(pattern, '^(import|export)\s') GROUP BY ALL HAVING count(*) > 1""")
def duplicate_lines(spark, sf):
    lines = table(spark, sf, "documents").select("source", F.col("doc_id").cast("string").alias("path"), F.posexplode(F.split("text", "\n")).alias("place", "line"))
    return rules.duplicate_lines(lines, "source", "path", "line", "place").select("source", "pattern", "n")


@query(r"""WITH b AS (SELECT item_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]{3,}'), lambda w: w NOT IN ('const', 'function', 'return', 'type', 'interface', 'string', 'number', 'boolean', 'undefined', 'export', 'import', 'from', 'true', 'false')))) AS w FROM benchmark),
d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]{3,}'))) AS w FROM documents),
n AS (SELECT item_id, count(*) AS n FROM b GROUP BY item_id), m AS (SELECT item_id, doc_id, count(*) AS shared FROM b JOIN d USING (w) GROUP BY ALL)
SELECT item_id, doc_id, shared, shared / n AS overlap FROM m JOIN n USING (item_id) WHERE shared / n >= 0.55""")
def dry_overlap(spark, sf):
    """Documents that share most terms of a benchmark item: only pairs with a common term are ever made."""
    items = table(spark, sf, "benchmark").select("item_id", text.code_terms(F.col("text")).alias("t"))
    terms = items.select("item_id", F.size("t").alias("n"), F.explode("t").alias("w"))
    words = table(spark, sf, "documents").select("doc_id", F.explode(text.code_terms(F.col("text"))).alias("w"))
    shared = words.join(terms, "w").groupBy("item_id", "n", "doc_id").agg(F.count("*").alias("shared"))
    return shared.select("item_id", "doc_id", "shared", (F.col("shared") / F.col("n")).alias("overlap")).filter("overlap >= 0.55")


@query("""SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' ELSE round(n_chars / 1024, 1) || ' KB' END AS size,
 CASE WHEN n_chars < 60 THEN n_chars || 's' WHEN n_chars < 3600 THEN (n_chars // 60) || 'm ' || (n_chars % 60) || 's' ELSE (n_chars // 3600) || 'h ' || (n_chars % 3600 // 60) || 'm' END AS lasts FROM documents""")
def labels_of_numbers(spark, sf):
    n = F.col("n_chars")
    return table(spark, sf, "documents").select("doc_id", text.bytes_label(n).alias("size"), text.duration_label(n).alias("lasts"))


@query("""SELECT doc_id, CASE WHEN doc_id % 6 = 1 THEN 'test/' || source || '/m' || doc_id || '.ts,src/' || source || '/m' || doc_id || '.ts'
  WHEN doc_id % 6 = 0 THEN 'src/features/' || source || '/View' || doc_id || '.test.tsx,src/features/' || source || '/View' || doc_id || '.spec.tsx,test/View' || doc_id || '.test.tsx,tests/View' || doc_id || '.test.tsx'
  ELSE 'packages/' || lang || '/core/src/m' || doc_id || '.test.js,packages/' || lang || '/core/src/m' || doc_id || '.spec.js,test/m' || doc_id || '.test.js,tests/m' || doc_id || '.test.js' END AS candidates
FROM documents WHERE doc_id % 6 IN (0, 1, 5)""")
def test_counterparts(spark, sf):
    files = _made(spark, sf).filter(F.col("path").rlike(r"\.(ts|tsx|js)$"))
    return files.select("doc_id", F.array_join(paths.test_counterparts(F.col("path")), ",").alias("candidates"))


@query(r"""SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '<a\b[^>]*?\bhref="([^"]*)"', 1))) AS href FROM pages""")
def page_links(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(web.links(F.col("html"))).alias("href"))


@query("SELECT conv_id, turn, 'reply: ' || text AS first_text FROM conversations")
def sse_parse(spark, sf):
    reply = F.to_json(F.struct(F.struct(F.array(F.struct(F.concat(F.lit("reply: "), "text").alias("text"))).alias("content")).alias("result")))
    stream = F.concat(F.lit("event: ping\ndata: {}\n\nevent: message\ndata: "), reply, F.lit("\n\ndata: {\"result\": {\"content\": [{\"text\": \"late\"}]}}\n"))
    return table(spark, sf, "conversations").select("conv_id", "turn", web.first_event_text(stream).alias("first_text"))


@query("SELECT page_id, CASE WHEN strlen(html) > 5242880 THEN 'rejected' ELSE 'html' END AS kind, contains(url, '.html') AS named FROM pages")
def fetch_routes(spark, sf):
    return table(spark, sf, "pages").select("page_id", web.route(F.lit("text/html; charset=utf-8"), F.octet_length("html")).alias("kind"), F.col("url").contains(".html").alias("named"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_payload(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))
