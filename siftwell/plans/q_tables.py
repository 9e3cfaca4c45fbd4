"""Queries on lifecycle, latest records, windows, change feeds and counts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import paths
from ..operators import lifecycle, ordering, stats
from ..sources import tree
from ..streaming import changes
from .registry import query, table

#: Orders as a file table: the price stands for the hash, finished orders are deleted ones.
_KNOWN = "SELECT o_orderkey AS path, CAST(round(o_totalprice) AS BIGINT) AS file_hash, o_orderpriority = '1-URGENT' AS is_generated, o_orderdate AS last_indexed_at, o_orderdate AS updated_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS deleted_at FROM orders"
#: Line items by order as a new scan: orders with few items keep the hash.
_SCANNED = "SELECT l_orderkey AS path, CASE WHEN count(*) <= 4 THEN max(file_hash) ELSE count(*) END AS file_hash, bool_or(is_generated) AS is_generated FROM lineitem JOIN known ON path = l_orderkey WHERE l_quantity > 5 GROUP BY l_orderkey"


def _views(spark, sf):
    orders, items = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    at = F.col("o_orderdate").cast("timestamp")
    known = orders.select(F.col("o_orderkey").alias("path"), F.round("o_totalprice").cast("long").alias("file_hash"), (F.col("o_orderpriority") == "1-URGENT").alias("is_generated"), at.alias("last_indexed_at"), at.alias("updated_at"), F.when(F.col("o_orderstatus") == "F", at).alias("deleted_at"))
    joined = items.filter("l_quantity > 5").join(known, F.col("l_orderkey") == F.col("path"))
    scanned = joined.groupBy("path").agg(F.when(F.count("*") <= 4, F.max("file_hash")).otherwise(F.count("*")).alias("file_hash"), F.bool_or("is_generated").alias("is_generated"))
    return known, scanned


_CHANGES = f"""WITH known AS ({_KNOWN}), scanned AS ({_SCANNED}),
c AS (SELECT coalesce(k.path, s.path) AS path, CASE WHEN k.path IS NULL THEN 'insert' WHEN s.path IS NULL AND k.deleted_at IS NULL THEN 'missing' WHEN s.path IS NULL THEN 'gone'
  WHEN k.deleted_at IS NOT NULL THEN 'restore' WHEN k.file_hash = s.file_hash AND k.is_generated = s.is_generated THEN 'touch' ELSE 'update' END AS change
FROM known k FULL JOIN scanned s ON k.path = s.path)"""


@query(_CHANGES + " SELECT * FROM c WHERE change <> 'gone'")
def change_classes(spark, sf):
    return lifecycle.change_classes(*_views(spark, sf))


@query(_CHANGES + """ SELECT path, CASE WHEN change IN ('insert', 'update', 'restore') THEN s.file_hash ELSE k.file_hash END AS file_hash,
 strftime(CASE WHEN change IN ('touch', 'insert', 'update', 'restore') THEN TIMESTAMP '2030-01-01' ELSE k.last_indexed_at END, '%Y-%m-%d') AS indexed, change <> 'restore' AND k.deleted_at IS NOT NULL AS deleted
FROM c LEFT JOIN known k USING (path) LEFT JOIN scanned s USING (path)""")
def upsert_files(spark, sf):
    known, scanned = _views(spark, sf)
    out = lifecycle.upsert_files(known, scanned, "2030-01-01")
    return out.select("path", "file_hash", F.date_format("last_indexed_at", "yyyy-MM-dd").alias("indexed"), F.col("deleted_at").isNotNull().alias("deleted"))


@query(f"WITH known AS ({_KNOWN}), scanned AS ({_SCANNED}) SELECT count(*) AS rows_left, count(*) FILTER (WHERE deleted_at IS NOT NULL OR path NOT IN (SELECT path FROM scanned)) AS deleted, count(*) FILTER (WHERE deleted_at IS NULL AND path NOT IN (SELECT path FROM scanned)) AS newly FROM known")
def soft_delete_missing(spark, sf):
    known, scanned = _views(spark, sf)
    out = lifecycle.mark_missing(known, scanned, "2030-01-01")
    gone = F.col("deleted_at").isNotNull()
    return out.agg(F.count("*").alias("rows_left"), F.count_if(gone).alias("deleted"), F.count_if(gone & (F.year("deleted_at") == 2030)).alias("newly"))


@query(f"""WITH known AS ({_KNOWN}) SELECT path FROM known WHERE NOT (deleted_at IS NOT NULL AND deleted_at < TIMESTAMP '1998-01-01' - INTERVAL 30 DAYS
 AND path NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'))""")
def not_exists_prune(spark, sf):
    known, _ = _views(spark, sf)
    children = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("path"))
    return lifecycle.prune(known, children, "1998-01-01", 30).select("path")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_join_missing(spark, sf):
    customers, orders = table(spark, sf, "customer"), table(spark, sf, "orders").filter("o_orderstatus = 'P'")
    return customers.join(orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark, sf):
    return lifecycle.latest(table(spark, sf, "events").select("user_id", "event_id", "event_type", "value", "ts"), "user_id", "ts", "event_id").drop("ts")


@query("""WITH a AS (SELECT user_id, max(event_id) FILTER (WHERE event_type <> 'purchase') AS a, max(event_id) FILTER (WHERE event_type = 'purchase') AS b FROM events GROUP BY user_id)
SELECT user_id, greatest(coalesce(a, -1), coalesce(b, -1)) AS event_id FROM a WHERE coalesce(a, -1) > coalesce(b, -1)""")
def merge_latest(spark, sf):
    """Records with a last purchase count as disposed."""
    e = table(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("disposed"))
    return lifecycle.merge_latest(e.filter("disposed IS NULL"), e.filter("disposed IS NOT NULL"), "user_id", "event_id", "disposed").select("user_id", "event_id")


@query("SELECT conv_id, max(turn) AS turn, max_by(text, turn) AS state FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def state_replay(spark, sf):
    log = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.col("text").alias("state"))
    return lifecycle.replay(log, "conv_id", "turn", F.col("role") == "assistant").select("conv_id", "turn", "state")


@query("SELECT user_id, array_to_string(list(event_type ORDER BY s DESC, event_type), ',') AS recent FROM (SELECT user_id, event_type, max(event_id) AS s FROM events GROUP BY user_id, event_type QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY s DESC, event_type) <= 3) GROUP BY user_id")
def recent_list(spark, sf):
    return lifecycle.recent(table(spark, sf, "events"), "user_id", "event_type", "event_id", 3).select("user_id", F.array_join("recent", ",").alias("recent"))


@query("""SELECT doc_id FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE vec_id IS NULL OR label = 3""")
def missing_embeddings(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), (F.col("label") == 3).alias("stale"))
    return lifecycle.needs_embedding(table(spark, sf, "documents"), e, "doc_id").select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings JOIN documents ON doc_id = vec_id WHERE label NOT IN (3, 7) AND len(embedding) = 64)")
def incremental_embed(spark, sf):
    """Label 7 stands for another version of the text."""
    docs = table(spark, sf, "documents")
    base = docs.select("doc_id", F.lit("m").alias("model"), F.lit(64).alias("dimensions"), F.lit(1).alias("version"), F.sha2("text", 256).alias("text_hash"))
    e = table(spark, sf, "embeddings").join(docs, F.col("vec_id") == F.col("doc_id")).select("doc_id", F.lit("m").alias("model"), F.size("embedding").alias("dimensions"), F.lit(1).alias("version"), F.sha2(F.when(F.col("label") == 7, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("text_hash"), (F.col("label") == 3).alias("stale"))
    return lifecycle.unchanged_embeddings(base, e, "doc_id").select("doc_id")


@query("SELECT p_brand, p_partkey, CAST(coalesce(sum(p_size + 1) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS top FROM part WHERE p_size > 10")
def layout_prefix_sum(spark, sf):
    cards = table(spark, sf, "part").select("p_brand", F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("order"), F.col("p_size").alias("height"), (F.col("p_size") > 10).alias("visible"))
    return lifecycle.layout_tops(cards, "p_brand", 1).select("p_brand", F.col("id").alias("p_partkey"), "top")


_STATUS = "CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'click' THEN 'in_progress' ELSE 'pending' END"


@query(f"SELECT user_id, count(*) AS total, count(*) FILTER (WHERE s = 'completed') AS completed, count(*) FILTER (WHERE s = 'in_progress') AS in_progress, count(*) FILTER (WHERE s = 'pending') AS pending FROM (SELECT user_id, {_STATUS} AS s FROM events) GROUP BY user_id")
def todo_rollup(spark, sf):
    return lifecycle.rollup_status(table(spark, sf, "events").select("user_id", F.expr(_STATUS).alias("status")), "user_id")


@query("""SELECT user_id, props AS text, max(event_id) AS seq FROM events e WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-15' AND NOT EXISTS
 (SELECT 1 FROM events o WHERE o.user_id = e.user_id AND o.props = e.props AND o.event_type = 'purchase' AND o.ts < TIMESTAMP '2024-01-15') GROUP BY user_id, props QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) <= 3""")
def newly_completed(spark, sf):
    e = table(spark, sf, "events").filter("event_type = 'purchase'").withColumn("status", F.lit("completed")).withColumnRenamed("props", "text")
    late = F.col("ts").cast("timestamp") >= "2024-01-15"
    now = e.filter(late).groupBy("user_id", "text", "status").agg(F.max("event_id").alias("seq"))
    return lifecycle.newly_completed(now, e.filter(~late), "user_id").select("user_id", "text", "seq")


@query("SELECT trim(p_brand) AS id, min_by(p_name, p_partkey) AS title FROM part GROUP BY 1")
def sanitize_groups(spark, sf):
    g = table(spark, sf, "part").select(F.concat(F.lit(" "), "p_brand", F.lit(" ")).alias("id"), F.col("p_name").alias("title"), F.col("p_partkey").alias("seq"))
    return lifecycle.sanitize_groups(g).select("id", "title")


@query("SELECT p_partkey AS item, p_name AS text, CASE WHEN p_size <= 25 THEN p_brand END AS group_id FROM part WHERE trim(p_name) <> ''")
def sanitize_items(spark, sf):
    items = table(spark, sf, "part").select(F.col("p_partkey").alias("item"), F.concat(F.lit("  "), "p_name").alias("text"), F.when(F.col("p_size") <= 25, F.col("p_brand")).otherwise("nowhere").alias("group_id"))
    return lifecycle.sanitize_items(items, table(spark, sf, "part").select(F.col("p_brand").alias("id")))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) <= INTERVAL 600 SECONDS THEN 0 ELSE 1 END AS n FROM events),
s AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS session FROM g)
SELECT event_type, CAST(session AS BIGINT) AS session, count(*) AS events, min(event_id) AS first_id, max(event_id) AS last_id FROM s GROUP BY event_type, session""")
def debounce_batches(spark, sf):
    s = changes.sessions(table(spark, sf, "events"), "ts", 600, "event_type")
    return s.groupBy("event_type", "session").agg(F.count("*").alias("events"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 3600 SECONDS THEN 0 ELSE 1 END AS n FROM events),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at, count(*) AS events FROM s GROUP BY user_id, session""")
def session_windows(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return changes.debounced(e, "ts", 3600, "user_id").select("user_id", at("first_at"), at("last_at"), "events")


@query("SELECT user_id, CASE event_type WHEN 'error' THEN 'unlink' WHEN 'signup' THEN 'add' ELSE 'change' END AS kind FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def last_event_wins(spark, sf):
    kind = F.when(F.col("event_type") == "error", "unlink").when(F.col("event_type") == "signup", "add").otherwise("change")
    return changes.last_event(table(spark, sf, "events").withColumn("kind", kind), "user_id", "kind", "ts", "event_id")


@query("""WITH t AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
SELECT conv_id, min(turn) FILTER (WHERE role = 'user') AS start_seq, min(turn) FILTER (WHERE role = 'assistant') AS reply_seq, min(turn) FILTER (WHERE role = 'assistant') IS NULL AS open FROM t WHERE n > 0 GROUP BY conv_id, n""")
def turn_pairs(spark, sf):
    return changes.turns(table(spark, sf, "conversations"), "conv_id", "turn")


@query("""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t) AS k FROM (SELECT user_id, event_type, epoch_us(ts) AS t, min(event_id) AS event_id FROM events GROUP BY ALL)),
s AS (SELECT *, t AS lt, true AS shown FROM e WHERE k = 1
 UNION ALL SELECT e.user_id, e.event_type, e.t, e.event_id, e.k, CASE WHEN e.t - lt >= 86400 * 1000000::BIGINT THEN e.t ELSE lt END, e.t - lt >= 86400 * 1000000::BIGINT FROM s JOIN e ON e.user_id = s.user_id AND e.event_type = s.event_type AND e.k = s.k + 1)
SELECT event_id FROM s WHERE shown""")
def emission_dedupe(spark, sf):
    return changes.unrepeated(table(spark, sf, "events"), "ts", 86400, "user_id", "event_type").select("event_id")


@query("SELECT coalesce(event_type, 'total') AS kind, count(*) AS n FROM events GROUP BY ROLLUP (event_type)")
def kind_stats(spark, sf):
    return stats.by_kind(table(spark, sf, "events"), "event_type")


@query(f"WITH known AS ({_KNOWN}) SELECT count(*) AS total, CAST(sum((deleted_at IS NULL)::INT) AS BIGINT) AS active, CAST(sum((deleted_at IS NOT NULL)::INT) AS BIGINT) AS deleted, CAST(sum((deleted_at IS NULL AND is_generated)::INT) AS BIGINT) AS generated, strftime(max(last_indexed_at), '%Y-%m-%d') AS last_day FROM known")
def file_stats(spark, sf):
    return stats.file_stats(_views(spark, sf)[0]).withColumn("last_day", F.date_format("last_indexed_at", "yyyy-MM-dd")).drop("last_indexed_at")


@query("""SELECT CAST(sum((label IS NOT NULL AND label <> 3)::INT) AS BIGINT) AS embedded, CAST(sum((label = 3)::INT) AS BIGINT) AS stale, CAST(sum((label IS NULL)::INT) AS BIGINT) AS missing, count(*) AS total
FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE lang <> 'de'""".replace("sum((label = 3)::INT)", "sum(coalesce(label = 3, false)::INT)"))
def embedding_stats(spark, sf):
    docs = table(spark, sf, "documents")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("path"))
    files = docs.select(F.col("doc_id").alias("path"), F.when(F.col("lang") == "de", F.current_timestamp()).alias("deleted_at"))
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), (F.col("label") == 3).alias("stale"), F.lit(0).alias("updated_at"))
    return stats.embedding_stats(chunks, e, files).drop("last")


@query("SELECT user_id, count(*) AS done, epoch(max(ts)) - epoch(min(ts)) AS secs, count(*) / (epoch(max(ts)) - epoch(min(ts))) AS rate, (1000 - count(*)) / (count(*) / (epoch(max(ts)) - epoch(min(ts)))) AS eta FROM events GROUP BY user_id")
def throughput(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    grouped = e.groupBy("user_id").agg(F.count("*").alias("done"), ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6).alias("secs"))
    rate, eta = stats.throughput(F.col("done"), F.lit(1000), F.col("secs"))
    return grouped.select("user_id", "done", "secs", rate.alias("rate"), eta.alias("eta"))


@query("""WITH d AS (SELECT 'source=' || source || '/lang=' || lang AS dir, source, lang, strlen(coalesce(text, '')) + 1 AS bytes, len(string_split(coalesce(text, ''), chr(10))) AS lines FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL)
SELECT 'source=' || source AS dir, 'ignored' AS skip_reason, CAST(NULL AS BIGINT) AS bytes, CAST(NULL AS BIGINT) AS lines FROM d WHERE source IN ('src1', 'src2', 'src3') GROUP BY source
UNION ALL SELECT dir, 'ignored', NULL, NULL FROM d WHERE source NOT IN ('src1', 'src2', 'src3') AND lang = 'fr' GROUP BY dir
UNION ALL SELECT dir, NULL, CAST(sum(bytes) AS BIGINT), CAST(sum(lines) AS BIGINT) FROM d WHERE source NOT IN ('src1', 'src2', 'src3') AND lang <> 'fr' GROUP BY dir""")
def tree_scan(spark, sf):
    """Documents written as text files by source and language, and read again without some of the directories."""
    ordering.ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/tree-{uuid.uuid4().hex}"
    named = table(spark, sf, "documents").filter("source IS NOT NULL AND lang IS NOT NULL").select("text", "source", "lang")
    named.write.partitionBy("source", "lang").text(root)
    found = tree.read_tree(spark, root, exclude=("source=src{1..3}", "source=*/lang=fr", ".*", "_*"))
    shown = found.filter("kind = 'directory' OR skip_reason IS NULL").withColumn("dir", F.when(F.col("kind") == "directory", F.col("path")).otherwise(paths.dirname(F.col("path"))))
    lines = F.octet_length("content") - F.octet_length(F.replace(F.decode("content", "UTF-8"), F.lit("\n"), F.lit("")))
    return shown.groupBy("dir", "skip_reason").agg(F.sum("size_bytes").alias("bytes"), F.sum(lines).alias("lines"))
