"""Queries on learnings. Messages and learnings are made of parts, so that plain SQL knows what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import knowledge
from .q_graph import _learnings
from . import engine
from .registry import query, table

#: One message of each wording, by part.
_MESSAGE = """CASE p_partkey % 9
 WHEN 0 THEN concat('Don''t use ', p_brand, ', use lib', p_size) WHEN 1 THEN concat('we do not use ', p_brand, ' here. Prefer lib', p_size)
 WHEN 2 THEN concat('please use lib', p_size, ' instead of using ', p_brand) WHEN 3 THEN concat('Prefer lib', p_size, ' over ', p_brand)
 WHEN 4 THEN concat('never edit gen', p_size, '/') WHEN 5 THEN concat('always add tests under tests/m', p_size)
 WHEN 6 THEN concat('let''s make sure we write tests for anything new in m', p_size) WHEN 7 THEN concat('why is ', p_name, ' so slow?') ELSE concat('/run ', p_name, ' always use it') END"""
_SIGNAL = f"SELECT p_partkey, p_partkey % 9 AS k, p_brand AS b, 'lib' || p_size AS l, p_size AS s, {_MESSAGE} AS text FROM part"


def _messages(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.expr(_MESSAGE).alias("text"))


@query(f"SELECT p_partkey, k < 7 AND k <> 4 OR k = 4 AND false AS signal FROM ({_SIGNAL})".replace("k < 7 AND k <> 4 OR k = 4 AND false", "k < 7"))
def correction_signals(spark, sf):
    return _messages(spark, sf).select("p_partkey", knowledge.is_correction(F.col("text")).alias("signal"))


@query(f"SELECT p_partkey, CAST(c AS DOUBLE) AS confidence, CASE WHEN c >= 0.85 THEN 'active' WHEN c >= 0.5 THEN 'draft' ELSE 'ignored' END AS status FROM (SELECT p_partkey, CASE WHEN k = 1 THEN 0.82 WHEN k IN (0, 2, 3, 4, 5, 8) THEN 0.9 ELSE 0.45 END AS c FROM ({_SIGNAL}))")
def correction_confidence(spark, sf):
    c = knowledge.correction_confidence(F.col("text"))
    return _messages(spark, sf).select("p_partkey", c.alias("confidence"), knowledge.status_for(c).alias("status"))


@query(f"""SELECT p_partkey, CASE k WHEN 0 THEN 'Use ' || l || ' instead of ' || b WHEN 1 THEN 'Use ' || l || ' instead of ' || b WHEN 2 THEN 'Prefer ' || l || ' over ' || b WHEN 3 THEN 'Prefer ' || l || ' over ' || b
 WHEN 4 THEN 'Do not edit gen' || s || '/' WHEN 5 THEN 'Add tests under tests/m' || s ELSE 'Add tests for new changes' END AS title,
 CASE WHEN k IN (0, 1) THEN 'avoid_pattern' WHEN k IN (2, 3) THEN 'prefer_pattern' WHEN k = 4 THEN 'generated_code' ELSE 'testing_convention' END AS rule_type,
 CASE WHEN k IN (0, 1, 2, 3) THEN b WHEN k = 4 THEN 'editing gen' || s || '/' END AS avoid, CASE WHEN k <= 3 THEN l WHEN k = 5 THEN 'tests under tests/m' || s WHEN k = 6 THEN 'tests for new or changed behavior' END AS prefer,
 CASE WHEN k = 4 THEN 'gen' || s || '/**' WHEN k = 5 THEN 'tests/m' || s END AS globs, CASE WHEN k = 6 THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END AS confidence, CASE WHEN k = 6 THEN 'draft' ELSE 'active' END AS status
FROM ({_SIGNAL}) WHERE k < 7 AND k <> 1 UNION ALL SELECT p_partkey, 'Use ' || l || ' instead of ' || b, 'avoid_pattern', b, l, NULL, 1.0, 'active' FROM ({_SIGNAL}) WHERE k = 1""")
def learning_extraction(spark, sf):
    found = _messages(spark, sf).filter("p_partkey % 9 < 7").withColumn("l", knowledge.extract_learning(F.col("text")))
    return found.select("p_partkey", *(F.col(f"l.{c}").alias(c) for c in ("title", "rule_type", "avoid", "prefer")), F.array_join("l.path_globs", ",").alias("globs"), "l.confidence", "l.status")


@query(f"SELECT p_partkey, CAST(c AS DOUBLE) AS confidence, CASE WHEN c >= 0.85 THEN 'active' ELSE 'draft' END AS status FROM (SELECT p_partkey, CASE k WHEN 1 THEN 0.82 ELSE 0.9 END AS c FROM ({_SIGNAL}) WHERE k < 6)")
def correction_capture(spark, sf):
    return knowledge.capture(_messages(spark, sf)).select("p_partkey", "confidence", "status")


@query("SELECT p_partkey, 'Rule: ' || p_name || chr(10) || 'Type: style' || chr(10) || 'Summary: Note ' || p_partkey || chr(10) || 'Applies when: always' || chr(10) || 'Avoid: two words' || chr(10) || 'Prefer: one' AS body FROM part WHERE p_size % 5 = 4")
def learning_text(spark, sf):
    made = _learnings(spark, sf).filter("rule_type = 'style'").withColumn("applies_when", F.lit("always"))
    return made.select(F.col("learning_id").alias("p_partkey"), knowledge.embedding_text().alias("body"))


_KEYED = r"""SELECT p_partkey AS id, CASE WHEN ends_with(p_brand, '5') THEN 'draft' ELSE 'active' END AS status, p_partkey % 100 / 100 AS confidence, p_size AS priority,
 lower(regexp_replace(p_brand, '[^A-Za-z0-9]+', ' ', 'g')) || '|' || (p_size % 3) AS key FROM part"""


def _keyed(spark, sf):
    return _learnings(spark, sf).select("learning_id", "repo_key", "status", "confidence", "priority", F.lit("x").alias("rule_type"), F.lit(None).cast("string").alias("avoid"), F.lit(None).cast("string").alias("prefer"), F.col("title")).join(table(spark, sf, "part").select(F.col("p_partkey").alias("learning_id"), F.concat_ws("|", "p_brand", F.col("p_size") % 3).alias("t")), "learning_id").withColumn("avoid", F.col("t")).withColumn("updated_at", F.lit("2024-01-01").cast("timestamp")).drop("t")


@query(f"""WITH k AS ({_KEYED}), n AS (SELECT *, count(*) OVER (PARTITION BY key) AS n, first_value(id) OVER (PARTITION BY key ORDER BY status = 'active' DESC, confidence DESC, priority DESC, id) AS keeper FROM k)
SELECT id AS learning_id, CASE WHEN n > 1 AND keeper <> id THEN 'superseded' ELSE status END AS status, CASE WHEN n > 1 AND keeper <> id THEN keeper END AS superseded_by,
 round(CASE WHEN n > 1 AND keeper = id THEN least(1.0, confidence + least(0.05, 0.02 * (n - 1))) ELSE confidence END, 6) AS confidence, CAST(CASE WHEN n > 1 AND keeper = id THEN least(100, priority + n - 1) ELSE priority END AS BIGINT) AS priority FROM n""")
def consolidate_keeper(spark, sf):
    out = knowledge.consolidate(_keyed(spark, sf).withColumn("superseded_by", F.lit(None).cast("int")).withColumn("learning_id", F.col("learning_id")))
    return out.select("learning_id", "status", "superseded_by", F.round("confidence", 6).alias("confidence"), "priority")


_DATED = """SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'draft' ELSE 'rejected' END AS status, o_orderkey % 100 / 100 AS confidence, CAST(o_orderdate AS TIMESTAMP) AS updated_at, CASE WHEN o_custkey % 3 = 0 THEN o_orderdate + INTERVAL 200 DAYS END AS last_used_at FROM orders"""


def _dated(spark, sf):
    at = F.col("o_orderdate").cast("timestamp")
    status = F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "draft").otherwise("rejected")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("learning_id"), F.lit("r").alias("repo_key"), status.alias("status"), (F.col("o_orderkey") % 100 / 100).alias("confidence"), (F.col("o_custkey") % 100).alias("priority"), at.alias("created_at"), at.alias("updated_at"), F.when(F.col("o_custkey") % 3 == 0, at + F.expr("INTERVAL 200 DAYS")).alias("last_used_at"))


@query(f"SELECT id AS learning_id FROM ({_DATED}) WHERE status IN ('active', 'draft') AND confidence < 0.9 AND coalesce(last_used_at, updated_at) < TIMESTAMP '1997-01-01' - INTERVAL 90 DAYS")
def stale_learnings(spark, sf):
    return knowledge.stale(_dated(spark, sf), "1997-01-01", 90, with_drafts=True).select("learning_id")


_USED = "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01'"


@query(f"SELECT id AS learning_id, round(CASE WHEN hit THEN least(1.0, confidence + 0.01) ELSE confidence END, 6) AS confidence, hit FROM (SELECT *, status = 'active' AND id IN ({_USED}) AS hit FROM ({_DATED}))")
def mark_used(spark, sf):
    used = table(spark, sf, "lineitem").filter("l_shipdate >= TIMESTAMP_NTZ '1998-06-01'").select(F.col("l_orderkey").alias("learning_id"))
    snapshot, _ = knowledge.mark_used(_dated(spark, sf), used, "2030-01-01")
    return snapshot.select("learning_id", F.round("confidence", 6).alias("confidence"), (F.year("last_used_at") == 2030).alias("hit")).withColumn("hit", F.coalesce("hit", F.lit(False)))


@query(f"SELECT id AS learning_id, 'retrieved' AS event_kind, round(confidence, 6) AS before FROM ({_DATED}) WHERE status = 'active' AND id IN ({_USED})")
def usage_events(spark, sf):
    used = table(spark, sf, "lineitem").filter("l_shipdate >= TIMESTAMP_NTZ '1998-06-01'").select(F.col("l_orderkey").alias("learning_id"))
    _, events = knowledge.mark_used(_dated(spark, sf), used, "2030-01-01")
    return events.select("learning_id", "event_kind", F.round(F.get_json_object("payload", "$.confidenceBefore").cast("double"), 6).alias("before"))


@query(f"WITH d AS ({_DATED}) SELECT a.id AS learning_id, CASE WHEN b.id IS NOT NULL AND a.id <> b.id THEN 'superseded' ELSE a.status END AS status, CASE WHEN a.id <> b.id THEN b.id END AS superseded_by FROM d a LEFT JOIN d b ON b.id = a.id // 2 * 2")
def supersede(spark, sf):
    known = _dated(spark, sf).withColumn("superseded_by", F.lit(None).cast("long"))
    pairs = known.select(F.col("learning_id").alias("superseded_id"), (F.floor(F.col("learning_id") / 2) * 2).alias("replacement_id"))
    return knowledge.supersede(known, pairs, "2030-01-01").select("learning_id", "status", "superseded_by")


@query(f"SELECT CASE WHEN status IN ('active', 'draft') THEN 'rejected' ELSE status END AS status, count(*) AS n FROM ({_DATED}) GROUP BY 1")
def forget_all(spark, sf):
    return knowledge.status_histogram(knowledge.forget(_dated(spark, sf)))


@query(f"SELECT status, count(*) AS n FROM ({_DATED}) GROUP BY status")
def status_histogram(spark, sf):
    return knowledge.status_histogram(_dated(spark, sf))


def _rules(spark, sf):
    return table(spark, sf, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("rule_id"), F.col("l_orderkey").alias("learning_id"), F.when(F.col("l_returnflag") == "R", "error").otherwise("warning").alias("severity"), F.col("l_linestatus").alias("rule_kind"), F.when(F.col("l_quantity") > 25, "active").otherwise("disabled").alias("status"))


@query(f"SELECT l_orderkey || ':' || l_linenumber AS rule_id, CASE WHEN r.l_quantity <= 25 THEN 'disabled' WHEN d.status = 'active' THEN 'active' ELSE 'disabled' END AS status FROM lineitem r LEFT JOIN ({_DATED}) d ON d.id = l_orderkey")
def disable_rules(spark, sf):
    return knowledge.disable_rules(_rules(spark, sf), _dated(spark, sf)).select("rule_id", "status")


@query(f"SELECT l_orderkey || ':' || l_linenumber AS rule_id, CASE WHEN l_returnflag = 'R' THEN 'error' ELSE 'warning' END AS severity FROM lineitem JOIN ({_DATED}) d ON d.id = l_orderkey WHERE l_quantity > 25 AND d.status = 'active' AND confidence >= 0.8")
def hard_rules(spark, sf):
    return knowledge.hard_rules(_rules(spark, sf), _dated(spark, sf)).select("rule_id", "severity")


@query(r"""WITH l AS (SELECT p_partkey AS id, trim(regexp_replace(lower(p_brand), '[^a-z0-9_./-]+', ' ', 'g')) AS avoid, trim(regexp_replace(lower(p_type), '[^a-z0-9_./-]+', ' ', 'g')) AS prefer FROM part WHERE p_size <= 25),
c AS (SELECT p_partkey AS id, trim(regexp_replace(lower(p_brand), '[^a-z0-9_./-]+', ' ', 'g')) AS avoid, trim(regexp_replace(lower(p_type), '[^a-z0-9_./-]+', ' ', 'g')) AS prefer FROM part WHERE p_size > 25)
SELECT c.id AS candidate_id, min(l.id) AS learning_id FROM c JOIN l ON c.avoid = l.avoid AND c.prefer = l.prefer GROUP BY c.id""")
def find_duplicates(spark, sf):
    p = table(spark, sf, "part").select(F.lit("r").alias("repo_key"), "p_partkey", "p_size", F.col("p_brand").alias("avoid"), F.col("p_type").alias("prefer"), F.concat(F.lit("title "), "p_partkey").alias("title"))
    known = p.filter("p_size <= 25").withColumnRenamed("p_partkey", "learning_id").withColumn("status", F.lit("active"))
    return knowledge.find_duplicates(p.filter("p_size > 25").withColumnRenamed("p_partkey", "candidate_id"), known)


@query(r"SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_type || '.js, npm: x'), 'npm:\s*', '', 'g'), '\.js\b|,', ' ', 'g')) AS term, lower(p_name) AS symbol FROM part".replace("trim(regexp_replace(regexp_replace(lower(p_type || '.js, npm: x'), 'npm:\\s*', '', 'g'), '\\.js\\b|,', ' ', 'g'))", r"regexp_replace(lower(p_type) || ' x', '\s+', ' ', 'g')"))
def canonical_terms(spark, sf):
    term = text.canonical_term(F.concat("p_type", F.lit(".js, npm: x")))
    return table(spark, sf, "part").select("p_partkey", term.alias("term"), text.symbol_form(F.concat(F.lit("load"), "p_name", F.lit("Screen"))).alias("symbol"))


@query("SELECT conv_id, turn, length(text) >= 12 AND regexp_matches(lower(text), 'the|nicht') AS wanted FROM conversations WHERE role = 'user'")
def planning_trigger(spark, sf):
    """Long enough prompts with a trigger word (here, of the test's invented languages)."""
    body = text.trim(F.col("text"))
    return table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", ((F.length(body) >= 12) & F.lower(body).rlike("the|nicht")).alias("wanted"))


@query("""SELECT p_partkey, k <> 3 AND (k = 0 OR k = 1 OR k = 2) AS wanted FROM (SELECT p_partkey, p_partkey % 5 AS k FROM part)""")
def planning_prompts(spark, sf):
    message = F.expr("CASE p_partkey % 5 WHEN 0 THEN concat('please fix ', p_name) WHEN 1 THEN concat('look into src/x', p_size, '.ts') WHEN 2 THEN concat(p_name, ' has a failing test') WHEN 3 THEN 'looks good.' ELSE concat('zz ', p_size) END")
    return table(spark, sf, "part").select("p_partkey", text.wants_context(message).alias("wanted"))


@query("""WITH p AS (SELECT p_brand, p_partkey, 'brand' || p_brand[7:] || ' size' || p_size AS phrase FROM part)
SELECT a.p_partkey AS a, b.p_partkey AS b FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey
WHERE a.phrase = b.phrase OR (length(a.phrase) >= 12 AND contains(b.phrase, a.phrase)) OR (length(b.phrase) >= 12 AND contains(a.phrase, b.phrase))""")
def phrase_compatibility(spark, sf):
    """Parts of one brand whose phrases (brand and size words) agree."""
    p = table(spark, sf, "part").select("p_brand", "p_partkey", F.concat(F.lit("brand"), F.substr("p_brand", F.lit(7)), F.lit(" size"), "p_size").alias("phrase"))
    return knowledge.compatible_pairs(p, "p_brand", "p_partkey", "phrase")


@query(r"""WITH k AS (SELECT p_partkey AS id, p_partkey % 100 / 100 AS confidence, p_size AS priority, p_name AS title, CASE WHEN ends_with(p_brand, '5') THEN 'draft' ELSE 'active' END AS status, p_size % 5 AS z, p_partkey FROM part),
u AS (SELECT id, confidence, priority, regexp_extract_all(lower(concat_ws(' ', title, 'Note ' || id, CASE z WHEN 0 THEN '''pkg' || id % 7 || '''' WHEN 1 THEN 'tool' || id % 5 || '.js' WHEN 2 THEN 'editing gen' || id % 9 || '/' WHEN 4 THEN 'two words' END, CASE z WHEN 0 THEN 'fetch' WHEN 3 THEN 'add tests under tests/unit' || id % 4 WHEN 4 THEN 'one' END)), '[\p{L}\p{N}]+') AS t FROM k WHERE status = 'active' AND confidence >= 0.5),
s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM u), p AS (SELECT id, dl, w, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS w FROM u) WHERE w IN ('fetch', 'pkg3', 'unit2') GROUP BY ALL),
f AS (SELECT w, CASE WHEN ln((n - count(*) + 0.5) / (count(*) + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - count(*) + 0.5) / (count(*) + 0.5)) END AS idf FROM p, s GROUP BY w, n),
r AS (SELECT id, -sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS rank FROM p JOIN f USING (w), s GROUP BY id)
SELECT id AS learning_id, round(0.45 * (1 + confidence * 0.1 + priority / 1000), 6) AS score FROM r JOIN u USING (id) ORDER BY r.rank, priority DESC, confidence DESC, id LIMIT 8""")
def learning_search(spark, sf):
    return knowledge.search(_learnings(spark, sf), ["fetch", "pkg3", "unit2"]).select("learning_id", F.round("score", 6).alias("score"))


@query()
def learning_search_vectors(spark, sf):
    return engine.search_learnings(_learnings(spark, sf).withColumn("applies_when", F.lit("")), "fetch pkg3 unit2").select("learning_id", F.round("score", 6).alias("score"))


@query("SELECT p_partkey AS finding_id, CASE WHEN p_size % 4 = 0 THEN 0.85::DOUBLE ELSE 0.75::DOUBLE END AS confidence, CAST(CASE WHEN p_size % 4 = 0 THEN 75 ELSE 75 END AS INTEGER) AS priority, CASE WHEN p_size % 4 = 0 THEN 'active' ELSE 'draft' END AS status, 'Prefer lib' || p_size || ' over ' || p_brand AS title FROM part WHERE p_size % 4 IN (0, 3)")
def review_feedback(spark, sf):
    action = F.element_at(F.array(*map(F.lit, ("accepted", "rejected", "false_positive", "whatever"))), (F.col("p_size") % 4 + 1).cast("int"))
    f = table(spark, sf, "part").select(F.col("p_partkey").alias("finding_id"), action.alias("action"), F.col("p_name").alias("title"), F.lit(None).cast("string").alias("evidence"), F.concat(F.lit("Prefer lib"), "p_size", F.lit(" over "), "p_brand").alias("correction"), F.lit(None).cast("array<string>").alias("path_globs"))
    return knowledge.feedback_candidate(f).select("finding_id", "confidence", "priority", "status", "title")
