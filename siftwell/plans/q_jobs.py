"""Queries on lookups, the work queue, suggestions, review helpers and text forms."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import jobs, knowledge, lifecycle, lookups, ordering, retrieval, rules, sessions
from ..sources import store, web
from ..sources.store import Store
from . import engine, stored
from .q_graph import _LEARN, _MADE, _P, _code_files, _diffs, _learnings
from .q_text import MADE_PATH
from .registry import query, table


@query("SELECT doc_id, source, lang FROM documents WHERE source = 'src3' AND lang = 'en'")
def lookup_file(spark, sf):
    return lookups.by_key(table(spark, sf, "documents"), source="src3", lang="en").select("doc_id", "source", "lang")


@query("SELECT p_partkey AS learning_id, p_name AS title FROM part WHERE p_partkey = 77")
def lookup_learning(spark, sf):
    return lookups.by_key(_learnings(spark, sf), learning_id=77, repo_key="r").select("learning_id", "title")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id = 7")
def lookup_embedding(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("model", F.lit("m"))
    return lookups.by_key(e, vec_id=7, model="m").select("vec_id", "label")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def lookup_by_keys(spark, sf):
    keys = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return lookups.by_keys(table(spark, sf, "customer").select("c_custkey", "c_name"), keys, "c_custkey")


@query("SELECT EXISTS (SELECT 1 FROM customer WHERE c_custkey = 5) AS present, EXISTS (SELECT 1 FROM customer WHERE c_custkey = -5) AS absent")
def lookup_exists(spark, sf):
    c = table(spark, sf, "customer")
    return lookups.exists(c, c_custkey=5).withColumnRenamed("found", "present").join(lookups.exists(c, c_custkey=-5).withColumnRenamed("found", "absent"), how="cross")  # one row each


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0 ORDER BY c_name, c_custkey LIMIT 40")
def enabled_repos(spark, sf):
    c = table(spark, sf, "customer")
    return lookups.listed(c, F.col("c_acctbal") > 0, [F.col("c_name"), F.col("c_custkey")], 40).select("c_custkey", "c_name")


@query("SELECT o_orderkey AS path FROM orders WHERE o_orderstatus <> 'F'")
def active_files(spark, sf):
    files = table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("deleted_at"))
    return lookups.active(files, "path")


@query(f"SELECT id AS learning_id, confidence FROM ({_LEARN}) WHERE status = 'active' ORDER BY confidence DESC, id LIMIT 50")
def list_learnings(spark, sf):
    return lookups.listed(_learnings(spark, sf), F.col("status") == "active", [F.desc("confidence"), F.col("learning_id")], 50).select("learning_id", "confidence")


@query("SELECT event_id, event_type FROM events WHERE user_id = 3 ORDER BY ts DESC, event_id DESC LIMIT 20")
def list_events(spark, sf):
    return lookups.listed(table(spark, sf, "events"), F.col("user_id") == 3, [F.desc("ts"), F.desc("event_id")], 20).select("event_id", "event_type")


_NAMES = ["Brand#7", "Brand#2", "Brand#7", "no such", "Brand#19"]


@query("""WITH n AS (SELECT * FROM (VALUES ('Brand#7', 0), ('Brand#2', 1), ('no such', 2), ('Brand#19', 3)) AS v(name, o)),
p AS (SELECT p_partkey, p_brand, o, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS k FROM part JOIN n ON p_brand = name)
SELECT p_partkey, p_brand AS name FROM p WHERE k <= 30 ORDER BY o, k LIMIT 30""")
def entities_by_names(spark, sf):
    found = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("name"), F.col("p_name").alias("path"), F.col("p_partkey").alias("start_line"))
    return lookups.by_names(found, _NAMES, 30).select("p_partkey", "name")


_JOB = "CASE event_type WHEN 'view' THEN 'changedFilesIndex' WHEN 'click' THEN 'changedFilesIndex' WHEN 'error' THEN 'deletedFileCleanup' WHEN 'signup' THEN 'embeddingBackfill' ELSE 'fullRepoIndex' END"
_REQUESTS = f"SELECT user_id AS queue, event_id AS seq, {_JOB} AS kind, CASE WHEN event_id % 9 <> 4 THEN 'f' || event_id % 23 END AS path FROM events"


@query(f"""WITH r AS (SELECT queue, seq, kind, CASE WHEN kind IN ('changedFilesIndex', 'deletedFileCleanup') THEN path END AS path FROM ({_REQUESTS}) WHERE kind NOT IN ('changedFilesIndex', 'deletedFileCleanup') OR path IS NOT NULL),
f AS (SELECT queue, kind, path, min(seq) AS s FROM r GROUP BY ALL), j AS (SELECT queue, kind, min(s) AS seq, coalesce(array_to_string(list(path ORDER BY s) FILTER (WHERE path IS NOT NULL), ','), '') AS paths FROM f GROUP BY queue, kind)
SELECT * FROM j WHERE kind <> 'embeddingBackfill' OR NOT EXISTS (SELECT 1 FROM j AS g WHERE g.queue = j.queue AND g.kind = 'fullRepoIndex' AND g.seq <= j.seq)""")
def pending_jobs(spark, sf):
    made = table(spark, sf, "events").selectExpr("user_id AS queue", "event_id AS seq", f"{_JOB} AS kind", "CASE WHEN event_id % 9 <> 4 THEN concat('f', event_id % 23) END AS path")
    return jobs.pending(made).withColumn("paths", F.array_join("paths", ","))


def _throttled_sql(due: str) -> str:
    return f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) AS k FROM (SELECT user_id, epoch_us(ts) AS t, max(event_id) AS n FROM events GROUP BY ALL)),
s AS (SELECT user_id, k, t, n, t AS lt, n AS ln, true AS shown FROM e WHERE k = 1
 UNION ALL SELECT user_id, k, t, n, CASE WHEN due THEN t ELSE lt END, CASE WHEN due THEN n ELSE ln END, due FROM (SELECT e.user_id, e.k, e.t, e.n, lt, ln, {due} AS due FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1))
SELECT user_id, t AS micros, n AS event_id FROM s WHERE shown"""


@query(_throttled_sql("e.t - lt >= 90000 * 1000000::BIGINT OR e.n - ln >= 400"))
def progress_throttle(spark, sf):
    shown = jobs.throttled(table(spark, sf, "events"), "user_id", "ts", 90000, "event_id", 400)
    return shown.select("user_id", F.unix_micros("ts").alias("micros"), "event_id")


@query(_throttled_sql("e.t - lt >= 60000 * 1000000::BIGINT").replace("t AS micros, n AS event_id", "count(*) AS shown") + " GROUP BY user_id")
def rate_limit(spark, sf):
    return jobs.throttled(table(spark, sf, "events"), "user_id", "ts", 60000).groupBy("user_id").agg(F.count("*").alias("shown"))


@query("""SELECT c_custkey, CASE WHEN c_nationkey % 4 = 0 AND c_nationkey % 3 <> 0 AND c_acctbal > 0 THEN 'kick' WHEN c_nationkey % 3 = 0 OR c_acctbal <= 0 OR c_custkey % 10 < 2 THEN 'wait'
 WHEN c_mktsegment = 'MACHINERY' THEN 'full' WHEN c_nationkey % 5 > 2 OR (c_mktsegment = 'BUILDING' AND c_nationkey > 0 AND c_nationkey % 2 = 0) THEN 'backfill' ELSE 'none' END AS action FROM customer""")
def recovery_decisions(spark, sf):
    n = F.col("c_nationkey")
    action = jobs.recovery(
        F.when(n % 4 == 0, 2).otherwise(0), n % 3 == 0, F.when(F.col("c_acctbal") <= 0, 4711), F.when(F.col("c_mktsegment") != "MACHINERY", "2024-01-01"),
        F.when(n % 5 > 2, 9).otherwise(0), F.when(F.col("c_mktsegment") == "BUILDING", "not_started").otherwise("ready"), n, n % 2, (F.col("c_custkey") % 10 * 4).cast("double"),
    )
    return table(spark, sf, "customer").select("c_custkey", action.alias("action"))


@query("SELECT c_custkey, CAST(CASE c_mktsegment WHEN 'MACHINERY' THEN 64 WHEN 'BUILDING' THEN 1 ELSE 16 END AS INTEGER) AS batch FROM customer")
def batch_sizes(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", jobs.batch_size(F.col("c_mktsegment"), {"MACHINERY": 64, "BUILDING": 0}, 16).alias("batch"))


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey >= 3 UNION ALL SELECT * FROM (VALUES (1, 'first'), (2, 'second')) AS v")
def singleton_seed(spark, sf):
    known = table(spark, sf, "nation").filter("n_nationkey >= 3").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return jobs.seeded(known, spark.createDataFrame([(1, "first"), (2, "second"), (3, "third")], "id int, name string"), "id")


@query("SELECT doc_id, array_to_string(list_filter(['les', 'nicht', 'que', 'thereou', 'tion', 'und', 'x y z', 'the', 'and'], lambda c: contains(text, c))[1:4], ',') AS terms FROM documents")
def exact_terms(spark, sf):
    terms = retrieval.exact_terms(F.col("text"), ("les", "nicht", "que", "thereou", "tion", "und", "x y z", "the", "and"), 4)
    return table(spark, sf, "documents").select("doc_id", F.array_join(terms, ",").alias("terms"))


_SYMBOL = "CASE p_partkey % 7 WHEN 0 THEN 'default export' WHEN 1 THEN 'describe' WHEN 2 THEN p_type WHEN 3 THEN 'ab' WHEN 4 THEN NULL WHEN 5 THEN 'useIt' ELSE p_name END"


@query(f"SELECT p_partkey, {_SYMBOL} AS symbol FROM part WHERE p_partkey % 7 >= 5")
def useful_symbols(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.expr(_SYMBOL).alias("symbol")).filter(retrieval.is_useful_symbol(F.col("symbol")))


@query("""WITH g AS (SELECT * FROM (VALUES ('a.ts', 0), ('src/x', 1), ('b.ts', 2), ('a.ts', 3)) AS v(path, o)), t AS (SELECT source || '/' || lang AS path, 3 + row_number() OVER (ORDER BY n_chars DESC, doc_id) AS o FROM documents ORDER BY n_chars DESC, doc_id LIMIT 8)
SELECT path, row_number() OVER (ORDER BY min(o)) AS place FROM (FROM g UNION ALL FROM t) GROUP BY path""")
def seed_paths(spark, sf):
    found = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.concat_ws("/", "source", "lang").alias("path"), F.col("n_chars").alias("score"))
    named = {"current_file": [" a.ts"], "visible_file": ["a.ts", " "], "changed_file": ["src/x", "b.ts"]}
    return retrieval.seed_paths(found, named).select("path", F.col("place").cast("long").alias("place"))


_KINDS = "CASE doc_id % 4 WHEN 0 THEN 'type' ELSE 'function' END"
_FOUND = f"SELECT doc_id AS chunk_id, source AS path, n_chars AS score, {_KINDS} AS chunk_kind, CASE WHEN doc_id % 5 = 0 THEN 'constant' ELSE 'function' END AS symbol_kind, CASE WHEN doc_id % 6 = 0 THEN 'MAX_' || doc_id ELSE 'fn' END AS symbol_name, doc_id % 3 <> 0 AS only_set FROM documents"


@query(f"""WITH f AS (SELECT *, only_set AND (chunk_kind = 'type' OR symbol_kind = 'constant' OR symbol_name <> 'fn') AS low FROM ({_FOUND})),
t AS (SELECT *, CASE WHEN low THEN 2 WHEN row_number() OVER (PARTITION BY path, low ORDER BY score DESC, chunk_id) <= 1 THEN 0 ELSE 1 END AS tier FROM f)
SELECT chunk_id, low FROM t ORDER BY tier, score DESC, chunk_id LIMIT 30""")
def representative_chunks(spark, sf):
    docs = table(spark, sf, "documents")
    reasons = F.when(F.col("doc_id") % 3 != 0, F.array(F.lit("current_file"))).otherwise(F.array(F.lit("current_file"), F.lit("fts_match")))
    found = docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("path"), F.col("n_chars").alias("score"), F.expr(_KINDS).alias("chunk_kind"), F.expr("CASE WHEN doc_id % 5 = 0 THEN 'constant' ELSE 'function' END").alias("symbol_kind"), F.expr("CASE WHEN doc_id % 6 = 0 THEN concat('MAX_', doc_id) ELSE 'fn' END").alias("symbol_name"), reasons.alias("reasons"))
    low = retrieval.is_low_value_chunk(F.col("reasons"), F.col("chunk_kind"), F.col("symbol_kind"), F.col("symbol_name"))
    return retrieval.representative(found, 30, 1).select("chunk_id", low.alias("low"))


_SCOPES = {0: None, 1: ["src/**"], 2: ["*.PNG", "nothing/**"], 3: ["absent/**"], 4: ["readme_*.md"], 5: [], 6: ["**/gen/*.json"]}


@query(f"""WITH m AS {_MADE}, p AS (SELECT regexp_replace(path, '^\\./', '') AS path FROM m),
h AS (SELECT count(*) FILTER (WHERE starts_with(path, 'src/')) > 0 AS a, count(*) FILTER (WHERE ends_with(path, '.PNG')) > 0 AS b, count(*) FILTER (WHERE regexp_matches(path, '/readme_[^/]*\\.md$')) > 0 AS c, count(*) FILTER (WHERE regexp_matches(path, '/gen/[^/]*\\.json$')) > 0 AS d FROM p)
SELECT p_partkey AS rule_id FROM part, h WHERE p_partkey % 7 IN (0, 5) OR (p_partkey % 7 = 1 AND a) OR (p_partkey % 7 = 2 AND b) OR (p_partkey % 7 = 4 AND c) OR (p_partkey % 7 = 6 AND d)""")
def scoped_rules(spark, sf):
    files = table(spark, sf, "documents").select(F.expr(MADE_PATH).alias("path"))
    scopes = spark.createDataFrame(list(_SCOPES.items()), "k long, scope array<string>")
    made = table(spark, sf, "part").select(F.col("p_partkey").alias("rule_id"), (F.col("p_partkey") % 7).alias("k")).join(F.broadcast(scopes), "k").drop("k")  # seven rows
    return rules.scoped_rules(made, files).select("rule_id")


_WARN = "SELECT l_orderkey AS diff_id, 'r' || l_linenumber AS rule_id, CASE WHEN l_linenumber % 2 = 0 THEN 'p' || l_partkey % 10 END AS path, CASE WHEN l_linenumber % 3 > 0 THEN 'e' || l_suppkey % 4 END AS evidence, CASE l_returnflag WHEN 'R' THEN 'error' WHEN 'A' THEN 'warning' ELSE 'info' END AS severity FROM lineitem"


@query(f"""WITH g AS (SELECT diff_id, array_to_string(list(rule_id || ':' || coalesce(path, '') || ':' || coalesce(evidence, '') ORDER BY rule_id || ':' || coalesce(path, '') || ':' || coalesce(evidence, '')), chr(10)) AS k, count(*) AS warnings FROM ({_WARN}) WHERE severity <> 'info' GROUP BY diff_id)
SELECT diff_id, md5(k) AS key, warnings FROM g WHERE k NOT IN (SELECT k FROM g WHERE diff_id % 2 = 0)""")
def post_edit_messages(spark, sf):
    """Messages of even diffs were shown before."""
    i = table(spark, sf, "lineitem")
    n = F.col("l_linenumber")
    made = i.select(F.col("l_orderkey").alias("diff_id"), F.concat(F.lit("r"), n).alias("rule_id"), F.when(n % 2 == 0, F.concat(F.lit("p"), F.col("l_partkey") % 10)).alias("path"), F.when(n % 3 > 0, F.concat(F.lit("e"), F.col("l_suppkey") % 4)).alias("evidence"), F.when(F.col("l_returnflag") == "R", "error").when(F.col("l_returnflag") == "A", "warning").otherwise("info").alias("severity"))
    none = spark.createDataFrame([], "message_key string")
    shown = rules.review_messages(made.filter("diff_id % 2 = 0"), none).select("message_key")
    return rules.review_messages(made, shown).select("diff_id", F.md5(F.col("message_key").cast("binary")).alias("key"), "warnings")


@query("""SELECT p_partkey, 'Files ' || p_size || '/' || CASE WHEN p_size % 3 = 0 THEN '?' ELSE CAST(p_partkey AS VARCHAR) END AS whole, CASE p_size % 4 WHEN 0 THEN 'Changed files ' || p_size WHEN 1 THEN 'Deleted files ' || p_size WHEN 2 THEN 'Files ' || CASE WHEN p_size % 3 = 0 THEN p_size ELSE p_partkey END ELSE 'Files ' || p_size END AS progress,
 replace(p_name, ' ', '\\|') || ' x' AS cell, CASE WHEN p_type IN ('SMALL', 'LARGE') THEN lower(p_type) ELSE 'hybrid' END AS mode, 'file:' || p_type AS key, regexp_replace(trim(p_name || '  a'), '\\s+', ' ', 'g') AS focus FROM part""")
def text_forms(spark, sf):
    total = F.when(F.col("p_size") % 3 != 0, F.col("p_partkey"))
    kind = F.when(F.col("p_size") % 4 == 0, "changedFilesIndex").when(F.col("p_size") % 4 == 1, "deletedFileCleanup").when(F.col("p_size") % 4 == 2, "embeddingBackfill")
    name = F.replace("p_name", F.lit(" "), F.lit("|"))
    return table(spark, sf, "part").select(
        "p_partkey", text.file_progress_label(F.lit("fullRepoIndex"), F.col("p_size"), total).alias("whole"), text.file_progress_label(kind, F.col("p_size"), total).alias("progress"),
        text.table_cell(F.concat(name, F.lit("\n"), F.lit("x"))).alias("cell"), text.one_of(F.concat(F.lit(" "), "p_type"), ("small", "large"), "hybrid").alias("mode"), F.concat(F.lit("file:"), "p_type").alias("key"), text.compact(F.concat(F.lit("\n "), "p_name", F.lit("  a\t"))).alias("focus"),
    )


@query("""SELECT p_brand, array_to_string(list(k || '=' || n ORDER BY n DESC, k), ', ') AS label FROM (SELECT p_brand, p_type AS k, count(*) AS n FROM part GROUP BY ALL) GROUP BY p_brand""")
def counts_label(spark, sf):
    counts = table(spark, sf, "part").groupBy("p_brand", F.col("p_type").alias("kind")).agg(F.count("*").alias("n"))
    return counts.groupBy("p_brand").agg(text.counts_label(F.collect_list(F.struct("n", "kind"))).alias("label"))


@query("""WITH RECURSIVE w AS (SELECT c_custkey, string_split(trim(c_name || ' ' || c_mktsegment || ' of ' || c_nationkey), ' ') AS ws FROM customer),
s AS (SELECT c_custkey, ws, 0 AS k, '' AS cur, []::VARCHAR[] AS lines FROM w
 UNION ALL SELECT c_custkey, ws, k + 1, CASE WHEN length(j) <= 8 THEN j ELSE word[((length(word) - 1) // 8) * 8 + 1:] END,
  CASE WHEN length(j) <= 8 THEN lines ELSE list_concat(list_concat(lines, CASE WHEN cur = '' THEN []::VARCHAR[] ELSE [cur] END), list_transform(range(0, (length(word) - 1) // 8), lambda i: word[i * 8 + 1:i * 8 + 8])) END
  FROM (SELECT *, ws[k + 1] AS word, CASE WHEN cur = '' THEN ws[k + 1] ELSE cur || ' ' || ws[k + 1] END AS j FROM s WHERE k < len(ws)))
SELECT c_custkey, array_to_string(list_append(lines, cur), '/') AS wrapped FROM s WHERE k = len(ws)""")
def word_wrap(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.concat_ws(" ", "c_name", "c_mktsegment", F.lit("of"), F.col("c_nationkey").cast("string")).alias("t"))
    return c.select("c_custkey", F.array_join(text.wrap(F.col("t"), 8), "/").alias("wrapped"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'text/markdown;q=1.0, text/x-markdown;q=0.9, text/plain;q=0.8, text/html;q=0.7, */*;q=0.1' WHEN 1 THEN 'text/plain;q=1.0, text/markdown;q=0.9, text/html;q=0.8, */*;q=0.1' WHEN 2 THEN 'text/html;q=1.0, application/xhtml+xml;q=0.9, text/plain;q=0.8, text/markdown;q=0.7, */*;q=0.1' END AS accept FROM part")
def accept_headers(spark, sf):
    form = F.element_at(F.array(*map(F.lit, ("markdown", "text", "html", "other"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", web.accept_header(form).alias("accept"))


@query(f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN regexp_replace(path, '^\\./', '') WHEN 1 THEN NULL ELSE 'lib/' || source END AS inside FROM (SELECT doc_id, source, {MADE_PATH} AS path FROM documents)")
def watched_paths(spark, sf):
    absolute = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/work/repo/"), "path")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("/work/repo/../other/"), "path")).otherwise(F.concat(F.lit("/work/./repo/x/../lib/"), "source"))
    return table(spark, sf, "documents").select("doc_id", "source", F.expr(MADE_PATH).alias("path")).select("doc_id", paths.below(absolute, "/work/repo").alias("inside"))


@query("SELECT l_orderkey AS source_path, l_partkey AS target_path FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND l_partkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def cascade_delete(spark, sf):
    gone = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("path"))
    edges = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("source_path"), F.col("l_partkey").alias("target_path"))
    return lifecycle.drop_edges(edges, gone)


@query("SELECT l_orderkey AS source_path, l_partkey AS target_path FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_orderkey, -1 FROM orders WHERE o_orderstatus = 'P'")
def replace_derived(spark, sf):
    orders = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("path"))
    edges = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("source_path"), F.col("l_partkey").alias("target_path"))
    return lifecycle.replace_for(edges, orders, orders.select(F.col("path").alias("source_path"), F.lit(-1).cast("long").alias("target_path")), "source_path")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS name, '2020-01-01' AS created FROM customer WHERE c_custkey < 600 UNION ALL SELECT c_custkey, 'new', '2030-01-01' FROM customer WHERE c_custkey >= 600 AND c_custkey % 3 = 0")
def registry_upsert(spark, sf):
    c = table(spark, sf, "customer").withColumnRenamed("c_name", "name")
    known = c.filter("c_custkey < 600").select("c_custkey", "name", F.lit("2020-01-01").alias("created_at"))
    rows = c.filter("c_custkey % 3 = 0").select("c_custkey", F.lit("new").alias("name"), F.lit("2030-01-01").alias("created_at"))
    return lifecycle.upsert_keep_created(known, rows, "c_custkey").withColumnRenamed("created_at", "created")


@query("SELECT vec_id, label = 3 OR label % 2 <> 0 OR label = 4 AS stale FROM embeddings")
def model_change(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.concat(F.lit("m"), F.col("label") % 2).alias("model"), F.size("embedding").alias("dimensions"), F.when(F.col("label") == 4, 2).otherwise(1).alias("version"), (F.col("label") == 3).alias("stale"))
    return lifecycle.mark_stale(e, "m0", 64, 1).select("vec_id", "stale")


@query("SELECT c_custkey AS id, c_name AS title FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 7 <> 0")
def json_index(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))
    whole = store.upsert_index(c, c.filter("id % 5 = 0").withColumn("title", F.lit("new")), "id")
    return store.delete_index(whole, c.filter("id % 7 = 0"), "id")


@query("SELECT doc_id AS diff_id, 'ban' AS rule_id, 'dep1' AS pattern, 'devDependencies.dep1' AS evidence FROM documents WHERE doc_id % 3 = 1")
def rule_eval_dependencies(spark, sf):
    rule = spark.createDataFrame([("ban", "forbidden_dependency", "dep1", "m", "error", "active"), ("off", "forbidden_dependency", "dep2", "m", "error", "disabled")], "rule_id string, rule_kind string, pattern string, message string, severity string, status string")
    found = rules.added_dependencies(rules.diff_lines(_diffs(spark, sf)))
    return rules.forbidden_dependencies(found, rule).select("diff_id", "rule_id", "pattern", "evidence")


def _repeating_diffs(spark, sf):
    """For each document a diff that adds, in a file of its own, the document's function over again."""
    n, p = F.col("doc_id"), F.col("doc_id") - 1
    body = [
        F.concat(F.lit("diff --git a/src/new/x"), n, F.lit(".ts b/src/new/x"), n, F.lit(".ts")), F.lit("--- /dev/null"), F.concat(F.lit("+++ b/src/new/x"), n, F.lit(".ts")), F.lit("@@ -0,0 +1,5 @@"),
        F.concat(F.lit("+function fn_"), n, F.lit("(x: number) {")), F.concat(F.lit("+  return fn_"), p, F.lit("(x) + helper_"), n, F.lit("(x)")), F.lit("+  // ----------------------------------------"), F.lit("+}"), F.lit(" // kept"), F.concat(F.lit("+const short_"), n, F.lit(" = 1")),
    ]
    return table(spark, sf, "documents").select(n.alias("diff_id"), F.concat_ws("\n", *body).alias("diff"))


@query("SELECT doc_id AS diff_id, 'src/new/x' || doc_id || '.ts' AS path, 'function fn_' || doc_id || '(x: number) {' || chr(10) || '  return fn_' || (doc_id - 1) || '(x) + helper_' || doc_id || '(x)' || chr(10) || '  // ----------------------------------------' || chr(10) || '}' AS text FROM documents")
def added_blocks(spark, sf):
    return rules.added_blocks(rules.diff_lines(_repeating_diffs(spark, sf))).select("diff_id", "path", "text")


def _whole_index(spark, sf):
    return engine.build_index(_code_files(spark, sf))


@query("SELECT doc_id AS diff_id, 'src/new/x' || doc_id || '.ts' AS path, true AS near FROM documents")
def dry_review(spark, sf):
    """Blocks that repeat a function of the corpus, found by one retrieval for all of them: the function itself, or that
    of the file before or after, which shares a name with it."""
    found = engine.dry_warnings(_whole_index(spark, sf), _repeating_diffs(spark, sf))
    number = F.regexp_extract("evidence", r"^similar to \S*/f(\d+)\.ts:\d+-\d+ \(", 1).cast("long")
    return found.select("diff_id", "path", (F.abs(number - F.col("diff_id")) <= 1).alias("near"))


@query("SELECT p_partkey AS candidate_id, p_partkey + 1 AS learning_id FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 5 <> 0 AND p_partkey % 4 >= 1")
def semantic_duplicates(spark, sf):
    k = F.col("p_partkey")
    side = lambda avoid, kind: F.struct(F.lit("t").alias("title"), F.lit("s").alias("summary"), avoid.alias("avoid"), F.lit(None).cast("string").alias("prefer"), kind.alias("rule_type"), F.lit(None).cast("array<string>").alias("path_globs"))
    avoid = F.lit("legacy client library")
    found = table(spark, sf, "part").select(k.alias("candidate_id"), (k + 1).alias("learning_id"), (0.7 + (k % 4) / 10).alias("score"), F.lit(1).alias("place"), side(avoid, F.lit("style")).alias("l"), side(F.when(k % 3 == 0, avoid).otherwise(F.lit("other things entirely")), F.when(k % 5 != 0, "style").otherwise("workflow")).alias("c"))
    return knowledge.semantic_duplicates(found)


@query(f"""WITH d AS (SELECT doc_id, {_P} AS path, 1 + doc_id % 9 AS a, 4 + doc_id % 9 AS b FROM documents), e AS (SELECT path, a, b, doc_id, unnest(['C_' || doc_id, 'fn_' || doc_id]) AS name, unnest([8, 4]) AS line FROM d)
SELECT d.path, coalesce(array_to_string(list(name ORDER BY name) FILTER (WHERE line BETWEEN e.a AND e.b), ','), '') AS declarations, 'missing_candidate' AS status, min(d.a) || '-' || min(d.b) AS ranges FROM d JOIN e USING (path) GROUP BY d.path""")
def change_analysis(spark, sf):
    """Diffs that touch four lines of each code file."""
    n = F.col("doc_id")
    diffs = _code_files(spark, sf).select(n.alias("diff_id"), F.concat(F.lit("diff --git a/"), "path", F.lit(" b/"), "path", F.lit("\n--- a/"), "path", F.lit("\n+++ b/"), "path", F.lit("\n@@ -1,0 +"), 1 + n % 9, F.lit(",4 @@\n+x")).alias("diff"))
    found = engine.analyze_changes(_whole_index(spark, sf), diffs)
    label = F.array_join(F.transform("ranges", lambda r: F.concat_ws("-", r["start_line"], r["end_line"])), ",")
    return found.select("path", F.coalesce(F.array_join("declarations", ","), F.lit("")).alias("declarations"), "status", label.alias("ranges"))


@query(f"""WITH d AS (SELECT doc_id, {_P} AS path FROM documents WHERE doc_id % 10 <> 1) SELECT path, unnest(CASE WHEN doc_id % 10 = 2 THEN ['extra_' || doc_id] ELSE ['C_' || doc_id, 'fn_' || doc_id] END) AS name FROM d""")
def incremental_index(spark, sf):
    """A stored index after a tenth of the files changed and a tenth was deleted."""
    return _changed_index(spark, sf)[0].entities.filter("kind != 'module'").select("path", "name")


_INDEX_TABLES = ("files", "chunks", "entities", "imports", "candidates", "file_edges", "code_edges", "embeddings", "postings")


@query(f"SELECT unnest({list(_INDEX_TABLES)}) AS name, 0::BIGINT AS missing, 0::BIGINT AS extra")
def incremental_rebuild(spark, sf):
    """How many rows of each table of that index a new index of the same files has more, or fewer."""
    index, files = _changed_index(spark, sf)
    new = stored.store_index(_new_store(spark), engine.build_index(files))
    both = []
    for name in _INDEX_TABLES:
        kept = [c for c in getattr(new, name).columns if c != "bucket"]
        a, b = (getattr(i, name).select(kept) for i in (new, index))
        one = lambda df, column: df.agg(F.count("*").alias(column))
        both.append(one(a.exceptAll(b), "missing").join(one(b.exceptAll(a), "extra"), how="cross").select(F.lit(name).alias("name"), "missing", "extra"))  # one row each
    return reduce(DataFrame.unionByName, both)


def _new_store(spark):
    ordering.ensure_checkpoint_dir(spark)
    return Store(spark, f"{spark.sparkContext.getCheckpointDir()}/index-{uuid.uuid4().hex}")


def _changed_index(spark, sf):
    """The index, and the files that it is of now."""
    files = _code_files(spark, sf)
    changed = files.filter("doc_id % 10 = 2").withColumn("content", F.concat(F.lit("export function extra_"), "doc_id", F.lit("() {\n  return 1\n}\n")))
    deleted, store = files.filter("doc_id % 10 = 1").select("repo_key", "path"), _new_store(spark)
    stored.store_index(store, engine.build_index(files))
    return stored.update_index(store, changed, deleted), files.filter("doc_id % 10 NOT IN (1, 2)").unionByName(changed)


@query(f"SELECT doc_id, CASE WHEN starts_with(p, 'packages/en/core/') THEN 'core' WHEN starts_with(p, 'packages/en/') THEN 'en' WHEN starts_with(p, 'app/') THEN 'app' END AS package FROM (SELECT doc_id, regexp_replace({MADE_PATH}, '^\\./', '') AS p FROM documents)")
def package_assignment(spark, sf):
    made = table(spark, sf, "documents").select("doc_id", F.expr(MADE_PATH).alias("path"))
    return made.select("doc_id", paths.longest_prefix(F.col("path"), {"packages/en": "en", "packages/en/core/": "core", "./app": "app"}).alias("package"))


@query("""SELECT p_partkey, lower(CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN p_type WHEN 2 THEN p_type || 'Panel' ELSE 'Load' END) AS form FROM part""")
def symbol_forms(spark, sf):
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.concat(F.lit("get"), "p_type", F.lit("Screen"))).when(k == 1, F.concat(F.lit("Format"), "p_type", F.lit("hook"))).when(k == 2, F.concat("p_type", F.lit("Panel"))).otherwise(F.lit("useLoadView"))
    return table(spark, sf, "part").select("p_partkey", text.symbol_form(name).alias("form"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS marked, CASE WHEN p_partkey % 3 <> 2 THEN p_size END AS fenced FROM part")
def replies_with_json(spark, sf):
    k, size = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    body = F.concat(F.lit('{"size": '), size, F.lit("}"))
    reply = F.when(k == 0, F.concat(F.lit("so <<<"), body, F.lit(">>> then"))).when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.lit("<<<none>>> at all"))
    marked = F.try_variant_get(web.between_marks(reply, "<<<", ">>>"), "$.size", "int")
    return table(spark, sf, "part").select("p_partkey", marked.alias("marked"), web.fenced_json(reply, "size int")["size"].alias("fenced"))


@query("SELECT c_custkey, CAST(CASE WHEN c_custkey % 5 = 0 THEN 7 ELSE least(5000, greatest(-100, trunc(c_acctbal))) END AS DOUBLE) AS value FROM customer")
def clamped_values(spark, sf):
    k = F.col("c_custkey")
    raw = F.when(k % 15 == 0, F.lit(float("nan"))).when(k % 15 == 5, F.lit(float("inf"))).when(k % 15 == 10, F.lit(None)).otherwise(F.col("c_acctbal"))
    return table(spark, sf, "customer").select("c_custkey", text.clamped(raw, -100, 5000, 7).alias("value"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'read,' || p_type || ',subagent_run' ELSE 'bash' END AS tools FROM part")
def tool_allowlist(spark, sf):
    asked = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit(" read"), F.lit(""), "p_type", F.lit("read"), F.lit("subagent_run")))
    return table(spark, sf, "part").select("p_partkey", F.array_join(text.allowed_tools(F.array(F.lit("bash"), F.lit("subagent_list")), asked), ",").alias("tools"))


@query("SELECT p_partkey, CASE WHEN r >= 10 THEN CAST(round(r) AS BIGINT) || '/s' ELSE format('{:.1f}/s', r) END AS rate FROM (SELECT p_partkey, p_size + 0.26 AS r FROM part)")
def rate_labels(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.rate_label(F.col("p_size") + F.lit(0.26)).alias("rate"))


@query("""SELECT p_partkey, '- [error] ' || p_name || ' (' || p_type || ': ' || p_brand || ')' AS rule, '- [error] ' || CASE WHEN p_size % 2 = 0 THEN p_brand || ': ' ELSE '' END || p_name || ' (' || p_type || ': x' || CASE WHEN p_size % 3 = 0 THEN '; e' || p_size ELSE '' END || ')' AS warning,
 '### ' || p_brand || ':' || p_size || '-' || (p_size + 4) || chr(10) || 'Why retrieved: a, b' || CASE WHEN p_size % 2 = 0 THEN chr(10) || 'Symbol: s' ELSE '' END || chr(10) || '```' || chr(10) || p_name || chr(10) || '```' AS chunk,
 CASE WHEN p_size % 4 = 0 THEN 'L' || p_size ELSE 'L' || p_size || '-L' || (p_size + p_size % 4) END || ', L7' AS ranges FROM part""")
def formatted_lines(spark, sf):
    from ..operators import formats

    p, n = table(spark, sf, "part"), F.col("p_size")
    base = p.select("p_partkey", "p_size", F.lit("error").alias("severity"), F.col("p_name").alias("message"), F.col("p_type").alias("rule_kind"), F.col("p_brand").alias("pattern"))
    warned = base.withColumns({"path": F.when(n % 2 == 0, F.col("pattern")), "evidence": F.when(n % 3 == 0, F.concat(F.lit("e"), n)), "shown": F.col("pattern")}).withColumn("pattern", F.lit("x"))
    chunk = warned.withColumns({"path": F.col("shown"), "start_line": n, "end_line": n + 4, "reasons": F.array(F.lit("a"), F.lit("b")), "symbol_name": F.when(n % 2 == 0, "s"), "content": F.col("message")})
    spans = F.array(F.struct(n.alias("start_line"), (n + n % 4).alias("end_line")), F.struct(F.lit(7).alias("start_line"), F.lit(7).alias("end_line")))
    ranges = formats.ranges_label(spans).alias("ranges")
    rules_ = base.select("p_partkey", formats.rule_line().alias("rule"))
    return rules_.join(warned.select("p_partkey", formats.warning_line().alias("warning")), "p_partkey").join(chunk.select("p_partkey", formats.chunk_text().alias("chunk"), ranges), "p_partkey")


@query(f"SELECT doc_id AS diff_id, path FROM {_MADE} UNION SELECT doc_id, 'package.json' FROM documents UNION SELECT doc_id, 'new/' || source FROM documents WHERE doc_id % 4 = 1")
def changed_file_list(spark, sf):
    new = table(spark, sf, "documents").filter("doc_id % 4 = 1 OR doc_id % 4 = 2").select(F.col("doc_id").alias("diff_id"), F.when(F.col("doc_id") % 4 == 1, F.concat(F.lit(" new/"), "source")).otherwise("  ").alias("path"))
    return rules.changed_files(_diffs(spark, sf), new)


@query(f"""WITH e AS (SELECT {_P} AS s, 'src/features/d' || (doc_id - 1) % 20 || '/f' || (doc_id - 1) || '.ts' AS t, doc_id FROM documents WHERE doc_id - 1 IN (SELECT doc_id FROM documents)),
c AS (SELECT {_P} AS path FROM documents WHERE doc_id = 50) SELECT path, CAST(0 AS INTEGER) AS hop FROM c UNION SELECT t, 1 FROM e WHERE s IN (FROM c) UNION SELECT s, 1 FROM e WHERE t IN (FROM c)""")
def impact_summaries(spark, sf):
    """Files that import the changed one, or that it imports."""
    index = engine.build_index(_code_files(spark, sf), embed=None)
    changed = table(spark, sf, "documents").filter("doc_id = 50").select(F.expr("concat('src/features/d', doc_id % 20, '/f', doc_id, '.ts')").alias("path"))
    index.file_edges = index.file_edges.filter("kind = 'imports'")
    return engine.impact(index, changed).filter("hop < 2").select("path", "hop")


@query("SELECT 'chunks' AS name, count(*) FILTER (WHERE c_nationkey <> 3) AS n FROM customer UNION ALL SELECT 'files', count(*) FROM customer")
def reset_index(spark, sf):
    c = table(spark, sf, "customer")
    left = lifecycle.reset({"files": c, "chunks": c}, "chunks", c_nationkey=3)
    count = lambda name: left[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return count("chunks").unionByName(count("files"))


#: Events made of conversations: an assistant's text comes as two deltas, and some of its messages stay open.
_EVENTS = """SELECT conv_id, turn * 10 + 0 AS s, 'thinking_delta' AS type, NULL AS role, NULL AS tool, NULL AS text, NULL AS error, false AS is_error, 0 AS tokens FROM conversations WHERE role = 'assistant'
UNION ALL SELECT conv_id, turn * 10 + 1, 'text_delta', NULL, NULL, substr(text, 1, 20), NULL, false, 0 FROM conversations WHERE role = 'assistant'
UNION ALL SELECT conv_id, turn * 10 + 2, 'text_delta', NULL, NULL, substr(text, 21), NULL, false, 0 FROM conversations WHERE role = 'assistant'
UNION ALL SELECT conv_id, turn * 10 + 3, 'message_end', 'assistant', NULL, CASE WHEN turn % 4 <> 3 THEN text END, CASE WHEN turn % 5 = 3 THEN 'bad  end' END, false, length(text) FROM conversations WHERE role = 'assistant' AND (turn % 4 <> 1 OR conv_id % 3 = 0)
UNION ALL SELECT conv_id, turn * 10 + 0, 'tool_execution_start', NULL, 'read', NULL, NULL, false, 0 FROM conversations WHERE role = 'user'
UNION ALL SELECT conv_id, turn * 10 + 1, 'tool_execution_end', NULL, 'read', NULL, NULL, conv_id % 2 = 0, 0 FROM conversations WHERE role = 'user'
UNION ALL SELECT conv_id, turn * 10 + 2, 'message_end', 'toolResult', 'read', NULL, NULL, false, 0 FROM conversations WHERE role = 'user'
UNION ALL SELECT conv_id, turn * 10 + 0, 'prompt_end', NULL, NULL, text, NULL, false, 0 FROM conversations WHERE role = 'system'"""
_CUT = "CASE WHEN length({0}) > 60 THEN left({0}, 57) || '...' ELSE {0} END"


def _preview_sql(text):
    return _CUT.format(f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))")


@query(f"""WITH e AS ({_EVENTS}), a AS (SELECT *, type = 'message_end' AND coalesce(role, '') = 'assistant' AS fin FROM e),
m AS (SELECT *, sum(fin::INT) OVER (PARTITION BY conv_id ORDER BY s) AS message, (fin AND error IS NULL AND coalesce(text, '') <> '') OR type = 'prompt_end' AS whole FROM a),
l AS (SELECT conv_id, CASE WHEN count(*) FILTER (WHERE fin AND error IS NOT NULL OR type = 'prompt_end') = 0 THEN 'running' ELSE arg_max(CASE WHEN type = 'prompt_end' THEN 'completed' ELSE 'error' END, s) FILTER (WHERE fin AND error IS NOT NULL OR type = 'prompt_end') END AS status,
  arg_max(type = 'thinking_delta', s) FILTER (WHERE type IN ('thinking_delta', 'text_delta', 'message_end', 'tool_execution_start', 'prompt_end')) AS thinking,
  arg_max(CASE WHEN type = 'thinking_delta' THEN 'thinking' WHEN type = 'text_delta' THEN 'responding' WHEN fin AND error IS NOT NULL THEN 'assistant error' WHEN fin THEN 'assistant message complete' WHEN type = 'message_end' THEN 'tool read'
    WHEN type = 'tool_execution_start' THEN 'running read' WHEN type = 'tool_execution_end' THEN CASE WHEN is_error THEN 'failed read' ELSE 'finished read' END ELSE 'completed' END, s) FILTER (WHERE NOT (fin AND error IS NULL AND coalesce(text, '') = '')) AS last_activity,
  CASE WHEN count(error) > 0 THEN 'bad end' END AS last_error, count(*) FILTER (WHERE fin) AS messages, count(*) FILTER (WHERE type = 'tool_execution_start') AS tools_started, count(*) FILTER (WHERE type = 'tool_execution_end' AND is_error) AS tools_failed, CAST(sum(tokens) AS BIGINT) AS input_tokens,
  arg_max(whole, s) FILTER (WHERE whole OR type = 'text_delta') AS last_whole, arg_max(message, s) FILTER (WHERE whole OR type = 'text_delta') AS last_message, arg_max(text, s) FILTER (WHERE whole OR type = 'text_delta') AS last_text FROM m GROUP BY conv_id),
t AS (SELECT m.conv_id, string_agg(text, '' ORDER BY s) AS typed FROM m JOIN l ON m.conv_id = l.conv_id AND message = last_message WHERE type = 'text_delta' GROUP BY m.conv_id)
SELECT l.conv_id, status, thinking, last_activity, CASE WHEN last_whole THEN {_preview_sql('last_text')} ELSE {_preview_sql('typed')} END AS last_response, last_error, messages, tools_started, tools_failed, input_tokens FROM l LEFT JOIN t USING (conv_id)""")
def session_fold(spark, sf):
    """Each conversation's events folded to its state."""
    c = table(spark, sf, "conversations")
    event = lambda k, type, role=None, tool=None, text=None, error=None, is_error=None, tokens=None, where=None: F.when(F.lit(True) if where is None else where, F.struct(F.lit(k).alias("k"), F.lit(type).alias("type"), F.lit(role).cast("string").alias("role"), F.lit(tool).cast("string").alias("tool"), (F.lit(None) if text is None else text).cast("string").alias("text"), (F.lit(None) if error is None else error).cast("string").alias("error"), (F.lit(False) if is_error is None else is_error).alias("is_error"), (F.lit(0) if tokens is None else tokens).cast("long").alias("input_tokens")))
    t, n = F.col("text"), F.col("turn")
    closed = (n % 4 != 1) | (F.col("conv_id") % 3 == 0)
    spoken = F.array(event(0, "thinking_delta"), event(1, "text_delta", text=F.substring(t, 1, 20)), event(2, "text_delta", text=F.substr(t, F.lit(21))), event(3, "message_end", "assistant", text=F.when(n % 4 != 3, t), error=F.when(n % 5 == 3, "bad  end"), tokens=F.length(t), where=closed))
    asked = F.array(event(0, "tool_execution_start", tool="read"), event(1, "tool_execution_end", tool="read", is_error=F.col("conv_id") % 2 == 0), event(2, "message_end", "toolResult", "read"))
    each = F.when(F.col("role") == "assistant", spoken).when(F.col("role") == "user", asked).when(F.col("role") == "system", F.array(event(0, "prompt_end", text=t)))
    events = c.select("conv_id", "turn", F.explode(F.array_compact(each)).alias("e")).select("conv_id", (n * 10 + F.col("e.k")).alias("seq"), *(F.col(f"e.{f}").alias(f) for f in ("type", "role", "tool", "text", "error", "is_error", "input_tokens")))
    return sessions.fold_sessions(events, "conv_id", most=60).drop("output_tokens", "last_seq")
