"""Queries on lexical, vector and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import lexical, ordering, retrieval, similarity, vector_index
from ..sources import corpus
from . import engine
from .q_text import MADE_PATH
from .registry import query, table

TERMS = ["thereou", "tion", "nicht", "les", "herean", "ciónes"]
_TERMS_SQL = "[" + ", ".join(f"'{t}'" for t in TERMS) + "]"


def _bm25_sql(terms: str, docs: str = "SELECT doc_id, text FROM documents") -> str:
    return f"""d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS t FROM ({docs})),
s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
p AS (SELECT doc_id, dl, w, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS w FROM d) WHERE list_contains({terms}, w) GROUP BY ALL),
f AS (SELECT w, CASE WHEN ln((n - count(*) + 0.5) / (count(*) + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - count(*) + 0.5) / (count(*) + 0.5)) END AS idf FROM p, s GROUP BY w, n),
r AS (SELECT doc_id, -sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS rank FROM p JOIN f USING (w), s GROUP BY doc_id)"""


@query(f"WITH {_bm25_sql(_TERMS_SQL)} SELECT doc_id, round(rank, 6) AS rank FROM r")
def bm25_scores(spark, sf):
    return lexical.bm25(table(spark, sf, "documents"), "doc_id", "text", TERMS).select("doc_id", F.round("rank", 6).alias("rank"))


@query(f"WITH {_bm25_sql(_TERMS_SQL)} SELECT doc_id, round(rank, 6) AS rank FROM r ORDER BY r.rank, doc_id LIMIT 12")
def bm25_topk(spark, sf):
    return lexical.top_k(lexical.bm25(table(spark, sf, "documents"), "doc_id", "text", TERMS), 12, "doc_id").select("doc_id", F.round("rank", 6).alias("rank"))


@query()
def bm25_stemmed_topk(spark, sf):
    return lexical.top_k(lexical.bm25_stemmed(table(spark, sf, "documents"), "doc_id", "text", ["thereou", "tions", "erating"]), 12, "doc_id").select("doc_id", F.round("rank", 6).alias("rank"))


@query("SELECT w AS term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM documents) GROUP BY ALL) GROUP BY w")
def postings_stats(spark, sf):
    return lexical.postings(table(spark, sf, "documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


_COSINE = "list_sum(list_transform(list_zip({a}, {b}), lambda x: x[1] * x[2]))"


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT v AS q FROM e WHERE vec_id = 0)
SELECT vec_id, round(list_cosine_similarity(v, q), 6) AS similarity FROM e, q WHERE list_cosine_similarity(v, q) > 0 ORDER BY list_cosine_similarity(v, q) DESC, vec_id LIMIT 12""")
def vector_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    probe = e.filter("vec_id = 0").first()["embedding"]
    return retrieval.vector_top_k(e, probe, 12, "vec_id").select("vec_id", F.round("similarity", 6).alias("similarity"))


_EACH_SQL = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT q.vec_id AS query, e.vec_id, round(list_cosine_similarity(e.v, q.v), 12) AS c FROM e, e q WHERE q.vec_id % 20 = 0)"""


@query(f"{_EACH_SQL} SELECT query, vec_id, round(c, 6) AS similarity FROM p WHERE c > 0 QUALIFY row_number() OVER (PARTITION BY query ORDER BY c DESC, vec_id) <= 12")
def vector_topk_each(spark, sf):
    """Every row whose id is divisible by 20 as a query, against all rows."""
    e = table(spark, sf, "embeddings")
    queries = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "embedding")
    return retrieval.vector_top_k_each(e, queries, 12, "vec_id").withColumn("similarity", F.round("similarity", 6))


def _indexed(spark, sf):
    e = table(spark, sf, "embeddings")
    return vector_index.build(e, "vec_id"), e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "embedding")


@query(f"{_EACH_SQL} SELECT query, vec_id, round(c, 6) AS similarity FROM p WHERE c > 0 QUALIFY row_number() OVER (PARTITION BY query ORDER BY c DESC, vec_id) <= 12")
def vector_index_topk_each(spark, sf):
    """As vector_topk_each, by balls and rings."""
    index, queries = _indexed(spark, sf)
    return vector_index.search(index, queries, 12).select("query", F.col("key").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


@query(f"{_EACH_SQL} SELECT query, vec_id, round(c, 6) AS similarity FROM p WHERE c >= 0.3")
def vector_index_within(spark, sf):
    """Every row whose id is divisible by 20 as a query, and all rows with a cosine of 0.3 or more."""
    index, queries = _indexed(spark, sf)
    return vector_index.within(index, queries, 0.3).select("query", F.col("key").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: 4 * x * x))), 5) AS size, round(1.0::DOUBLE, 5) AS unit FROM embeddings")
def vector_normalize(spark, sf):
    twice = F.transform("embedding", lambda x: x * 2)
    return table(spark, sf, "embeddings").select("vec_id", F.round(vectors.norm(twice), 5).alias("size"), F.round(vectors.norm(vectors.normalize(twice)), 5).alias("unit"))


@query("""WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM benchmark),
h AS (SELECT item_id, CAST(('0x' || sha256(w)[1:8]) AS BIGINT) % 64 AS place, CASE WHEN CAST(('0x' || sha256(w)[9:10]) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END AS s FROM t),
v AS (SELECT item_id, place, sum(s) AS v FROM h GROUP BY ALL), n AS (SELECT item_id, sqrt(sum(v * v)) AS n FROM v GROUP BY item_id)
SELECT item_id, CAST(place AS INTEGER) AS place, round(v / n, 6) AS value FROM v JOIN n USING (item_id) WHERE v <> 0""")
def hash_embedding(spark, sf):
    made = vectors.hash_embedding(table(spark, sf, "benchmark"), "item_id", "text")
    return made.select("item_id", F.posexplode("embedding").alias("place", "value")).filter("value != 0").withColumn("value", F.round("value", 6))


@query("""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.vec_id AS source, b.vec_id AS target, list_cosine_similarity(a.v, b.v) AS c FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id)
SELECT source, target, round(c, 6) AS similarity FROM p WHERE c >= 0.3 QUALIFY row_number() OVER (PARTITION BY source ORDER BY c DESC, target) <= 5""")
def similar_pairs(spark, sf):
    items = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    return similarity.similar_pairs(items, "label", 0.3, 5).withColumn("similarity", F.round("similarity", 6))


_EDGES_SQL = """WITH e AS (SELECT vec_id AS id, 'k' || label AS kind, 'd' || (vec_id % 40) AS dir, 'p' || (vec_id % 25) AS pkg, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.id AS source, b.id AS target, list_cosine_similarity(a.v, b.v) AS c, a.kind = b.kind AS k, a.dir = b.dir AS d, a.pkg = b.pkg AS g, a.kind || '->' || b.kind AS pair FROM e a JOIN e b ON a.id <> b.id AND (a.kind = b.kind OR a.dir = b.dir OR a.pkg = b.pkg)),
s AS (SELECT *, c + 0.05 * k::INT + 0.03 * d::INT + 0.04 * g::INT AS score FROM p WHERE c >= 0.2),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, c DESC, target) AS n FROM s QUALIFY n <= 5),
m AS (SELECT *, row_number() OVER (PARTITION BY source, pair ORDER BY n) AS m FROM n QUALIFY m <= 3)
SELECT source, target, round(least(0.99, score), 4) AS confidence, round(c, 4) AS similarity FROM m ORDER BY source, n LIMIT 2000"""


@query(_EDGES_SQL)
def similar_edges(spark, sf):
    return similarity.similar_edges(_vector_chunks(spark, sf), 0.2).select("source", "target", "confidence", "similarity")


@query("""WITH e AS (SELECT vec_id AS id, 'k' || label AS kind, 'd' || (vec_id % 40) AS dir, 'p' || (vec_id % 25) AS pkg, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.id AS source, b.id AS target, list_cosine_similarity(a.v, b.v) AS c, a.kind = b.kind AS k, a.dir = b.dir AS d, a.pkg = b.pkg AS g FROM e a JOIN e b ON a.id <> b.id AND (a.kind = b.kind OR a.dir = b.dir OR a.pkg = b.pkg))
SELECT source, target, round(least(0.99, c + 0.05 * k::INT + 0.03 * d::INT + 0.04 * g::INT), 4) AS confidence, round(c, 4) AS similarity FROM p WHERE c >= 0.2""")
def similar_edges_all(spark, sf):
    """All links, without the reference's bounds on partners and edges."""
    every = similarity.similar_edges(_vector_chunks(spark, sf), 0.2, per_source=None, per_pair=None, most=None)
    return every.select("source", "target", "confidence", "similarity")


@query(_EDGES_SQL)
def similar_edges_updated(spark, sf):
    """The edges of the table, kept up from an earlier state of it: every eleventh row was not there yet, every
    thirteenth had its components in the opposite order, and a copy of every seventeenth has gone since."""
    now = _vector_chunks(spark, sf)
    of = lambda n: F.col("chunk_id") % n == 0
    before = now.filter(~of(11)).withColumn("embedding", F.when(of(13), F.reverse("embedding")).otherwise(F.col("embedding")))
    copies = now.filter(of(17)).withColumn("chunk_id", -F.col("chunk_id") - 1).withColumn("path", F.concat("path", F.lit("_copy")))
    before = before.unionByName(copies)
    changed, deleted = now.filter(of(11) | of(13)), copies.select("chunk_id")
    pool = ordering.settled(similarity.similar_pool(before, 0.2))
    edges = similarity.pool_edges(similarity.update_pool(pool, now, None, changed, deleted, 0.2))
    return edges.select("source", "target", "confidence", "similarity")


def _vector_chunks(spark, sf):
    e = table(spark, sf, "embeddings")
    v = F.col("vec_id")
    none = F.lit(None).cast("string")
    return e.select(v.alias("chunk_id"), F.concat(F.lit("d"), v % 40, F.lit("/f"), v).alias("path"), F.concat(F.lit("k"), "label").alias("chunk_kind"), none.alias("symbol_kind"), none.alias("symbol_name"), F.concat(F.lit("p"), v % 25).alias("package_key"), "embedding")


@query(f"""WITH {_bm25_sql(_TERMS_SQL)}, l AS (SELECT doc_id, row_number() OVER (ORDER BY rank, doc_id) AS o FROM r ORDER BY rank, doc_id LIMIT 20),
e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT v AS q FROM e WHERE vec_id = 0),
v AS (SELECT vec_id AS doc_id, list_cosine_similarity(v, q) AS c FROM e, q WHERE list_cosine_similarity(v, q) > 0 ORDER BY c DESC, vec_id LIMIT 20),
b AS (SELECT coalesce(l.doc_id, v.doc_id) AS doc_id, coalesce(0.45 * (l.doc_id IS NOT NULL)::INT, 0) + coalesce(0.55 * c, 0) AS score, l.o,
 CASE WHEN l.doc_id IS NULL THEN 'semantic_match' WHEN v.doc_id IS NULL THEN 'fts_match' ELSE 'fts_match,semantic_match' END AS reasons, coalesce(l.o, 1000000 - c) AS place FROM l FULL JOIN v ON l.doc_id = v.doc_id)
SELECT doc_id, round(score, 6) AS score, reasons FROM b ORDER BY b.score DESC, place, doc_id LIMIT 15""")
def hybrid_fusion(spark, sf):
    ranked = lexical.top_k(lexical.bm25(table(spark, sf, "documents"), "doc_id", "text", TERMS), 20, "doc_id")
    order = F.row_number().over(_all(F.col("rank"), F.col("doc_id")))
    lex = ranked.select("doc_id", retrieval.lexical_score(F.col("rank")).alias("score"), F.array(F.lit("fts_match")).alias("reasons"), order.cast("long").alias("ordinal"))
    e = table(spark, sf, "embeddings")
    near = retrieval.vector_top_k(e, e.filter("vec_id = 0").first()["embedding"], 20, "vec_id")
    vec = near.select(F.col("vec_id").alias("doc_id"), F.col("similarity").alias("score"), F.array(F.lit("semantic_match")).alias("reasons"), F.row_number().over(_all(F.desc("similarity"), F.col("vec_id"))).cast("long").alias("ordinal"))
    return retrieval.fuse(lex, vec, "doc_id", 15).select("doc_id", F.round("score", 6).alias("score"), F.array_join("reasons", ",").alias("reasons"))


def _all(*order):
    """Over a result list that a limit has bounded."""
    from pyspark.sql import Window

    return Window.orderBy(*order)


@query(f"""WITH {_bm25_sql("['nicht', 'les']")}, x AS (SELECT doc_id, rank, 'first' AS reason FROM r ORDER BY rank, doc_id LIMIT 30),
{_bm25_sql("['les', 'tion']").replace('d AS (', 'd2 AS (').replace('FROM d)', 'FROM d2)').replace('s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d2)', 's2 AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d2)').replace('unnest(t) AS w FROM d)', 'unnest(t) AS w FROM d2)').replace('FROM d),', 'FROM d2),').replace('s AS (SELECT', 's2 AS (SELECT', 1).replace('p AS (SELECT', 'p2 AS (SELECT', 1).replace('FROM p, s GROUP', 'FROM p2, s2 GROUP').replace('f AS (SELECT w', 'f2 AS (SELECT w', 1).replace('FROM p JOIN f USING (w), s GROUP', 'FROM p2 JOIN f2 USING (w), s2 GROUP').replace('r AS (SELECT doc_id, -sum', 'r2 AS (SELECT doc_id, -sum')},
y AS (SELECT doc_id, rank, 'second' AS reason FROM r2 ORDER BY rank, doc_id LIMIT 30)
SELECT doc_id, round(max(-rank), 6) AS score, array_to_string(list_sort(list(DISTINCT reason)), ',') AS reasons FROM (FROM x UNION ALL FROM y) GROUP BY doc_id""")
def multi_query_merge(spark, sf):
    docs = table(spark, sf, "documents")
    one = lambda terms, reason: lexical.top_k(lexical.bm25(docs, "doc_id", "text", terms), 30, "doc_id").select("doc_id", (-F.col("rank")).alias("score"), F.array(F.lit(reason)).alias("reasons"))
    merged = retrieval.merge_queries(one(["nicht", "les"], "first").unionByName(one(["les", "tion"], "second")), "doc_id")
    return merged.select("doc_id", F.round("score", 6).alias("score"), F.array_join("reasons", ",").alias("reasons"))


@query(f"""SELECT doc_id, round(CASE WHEN ends_with(p, '.md') OR contains(p, '/docs/') OR contains(p, '/readme') THEN -0.22 ELSE 0 END
 + CASE WHEN regexp_matches(p, '(^|/)(tests?|__tests__)(/|$)|\\.(test|spec)\\.[jt]sx?$') THEN -0.1 ELSE 0 END
 + CASE WHEN regexp_matches(p, '(^|/)src/') AND NOT (ends_with(p, '.md') OR contains(p, '/docs/')) THEN 0.12 ELSE 0 END + CASE WHEN lang <> 'en' THEN 0.06 ELSE 0 END + CASE WHEN lang = 'de' THEN -0.08 ELSE 0 END, 6) AS adjustment
FROM (SELECT doc_id, lang, lower({MADE_PATH}) AS p FROM documents)""")
def ranking_adjustment(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.expr(MADE_PATH).alias("path"), F.when(F.col("lang") == "de", "markdown").otherwise("module").alias("chunk_kind"), F.when(F.col("lang") == "en", "heading").otherwise("function").alias("symbol_kind"))
    return docs.select("doc_id", F.round(retrieval.ranking_adjustment("where is the handler called", F.col("path"), F.col("chunk_kind"), F.col("symbol_kind")), 6).alias("adjustment"))


_CHUNKS = "SELECT doc_id * 1000 + i AS chunk_id, source || '/' || lang AS path, i AS start_line, line AS content FROM (SELECT doc_id, source, lang, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS l FROM documents)) WHERE line <> ''"
_SOURCES = {"current_file": ["src1/en", "src2/fr"], "visible_file": ["src1/en", "src3/de"], "changed_file": ["src2/fr"], "source_test_counterpart": ["src4/es"]}


def _chunks(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.concat("source", F.lit("/"), "lang").alias("path"), F.posexplode(F.split("text", "\n")).alias("i", "content"))
    return lines.filter("content != ''").select((F.col("doc_id") * 1000 + F.col("i") + 1).alias("chunk_id"), "path", (F.col("i") + 1).alias("start_line"), (F.col("i") + 1).alias("end_line"), "content")


@query(f"SELECT path, chunk_id, CAST(start_line AS INTEGER) AS start_line FROM ({_CHUNKS}) QUALIFY row_number() OVER (PARTITION BY path ORDER BY start_line, chunk_id) <= 2")
def top_chunks_per_path(spark, sf):
    return retrieval.top_per_path(_chunks(spark, sf), 2).select("path", "chunk_id", "start_line")


_WORKING = f"""WITH c AS ({_CHUNKS}), n AS (SELECT * FROM (VALUES ('current_file', 'src1/en', 1.2, 4), ('current_file', 'src2/fr', 1.2, 4), ('visible_file', 'src1/en', 0.9, 2), ('visible_file', 'src3/de', 0.9, 2), ('changed_file', 'src2/fr', 1.1, 4), ('source_test_counterpart', 'src4/es', 0.85, 3)) AS v(kind, path, base, most)),
w AS (SELECT c.*, kind, base FROM c JOIN n USING (path) QUALIFY row_number() OVER (PARTITION BY kind, path ORDER BY start_line, chunk_id) <= most),
k AS (SELECT w.*, (SELECT count(*) FROM n WHERE n.path = w.path) AS kinds FROM w)"""


@query(_WORKING + " SELECT chunk_id, kind, round(base + 0.15 * (kinds - 1), 6) AS score, kinds FROM k")
def working_set(spark, sf):
    found = retrieval.working_set(_chunks(spark, sf), _SOURCES)
    scored = retrieval.score_chunks(found, "the tion", _SOURCES)
    return scored.select("chunk_id", F.col("reasons")[0].alias("kind"), F.round("score", 6).alias("score"), F.size("reasons").cast("long").alias("kinds"))


@query(_WORKING + " SELECT path, count(*) AS chunks, round(max(base + 0.15 * (kinds - 1)), 6) AS score FROM k GROUP BY path")
def file_rollup(spark, sf):
    scored = retrieval.score_chunks(retrieval.working_set(_chunks(spark, sf), _SOURCES), "the tion", _SOURCES)
    return retrieval.file_rollup(scored).select("path", "chunks", F.round("score", 6).alias("score"))


@query(_WORKING + " SELECT n.kind AS reason, count(*) AS chunks, count(DISTINCT k.path) AS files FROM k JOIN n USING (path) GROUP BY n.kind")
def reason_histogram(spark, sf):
    scored = retrieval.score_chunks(retrieval.working_set(_chunks(spark, sf), _SOURCES), "the tion", _SOURCES)
    return retrieval.reason_histogram(scored)


@query("""WITH d AS (SELECT doc_id AS chunk_id, CASE WHEN lang = 'es' THEN source || '/yarn.lock' ELSE source || '/' || lang END AS path, n_chars / 1000.0 AS score, lang = 'es' AS low FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, chunk_id) AS n FROM d), t AS (SELECT *, CASE WHEN low THEN 2 WHEN n <= 2 THEN 0 ELSE 1 END AS tier FROM n)
SELECT chunk_id, path FROM t ORDER BY tier, score DESC, chunk_id LIMIT 100""")
def balanced_selection(spark, sf):
    docs = table(spark, sf, "documents")
    found = docs.select(F.col("doc_id").alias("chunk_id"), F.concat("source", F.lit("/"), F.when(F.col("lang") == "es", "yarn.lock").otherwise(F.col("lang"))).alias("path"), (F.col("n_chars") / 1000).alias("score"))
    return retrieval.balanced(found, 100).select("chunk_id", "path")


@query("""WITH d AS (SELECT doc_id AS chunk_id, text, n_chars FROM documents),
b AS (SELECT chunk_id, n_chars, CASE WHEN length(text) > 3000 THEN 3000 + length(chr(10) || '... truncated ...') ELSE length(text) END AS size FROM d),
u AS (SELECT chunk_id, CAST(size AS INTEGER) AS size, sum(size) OVER (ORDER BY n_chars DESC, chunk_id) AS used FROM b) SELECT chunk_id, size, CAST(used AS BIGINT) AS used FROM u WHERE used <= 50000""")
def context_budget(spark, sf):
    found = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("n_chars").alias("score"), F.col("text").alias("content"))
    return retrieval.assemble(found, 3000, 50_000).select("chunk_id", F.length("body").alias("size"), "used")


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'indexing' WHEN c_mktsegment = 'MACHINERY' THEN 'partial' WHEN c_nationkey < 10 AND c_nationkey > 0 THEN 'stale' ELSE 'fresh' END AS index_state FROM customer""")
def freshness(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") < 0).alias("running"), F.when(F.col("c_mktsegment") != "MACHINERY", F.lit("2024-01-01")).alias("last_indexed_at"), F.when(F.col("c_nationkey") < 10, F.col("c_nationkey")).otherwise(0).alias("pending_files"))
    return retrieval.freshness(c).select("c_custkey", "index_state")


def flagship(spark, sf):
    """Ranked hybrid search, end to end: chunks, BM25, hash vectors, working set and fusion."""
    files = corpus.documents_as_files(table(spark, sf, "documents"))
    index = engine.chunked(engine.build_index(files))
    request = engine.Request("how is herean thereou tion called", {"current_file": [files.orderBy("doc_id").first()["path"]]}, limit=12)
    return engine.search(index, request).select("path", "start_line", "end_line", F.round("score", 6).alias("score"), F.array_join("reasons", ",").alias("reasons"))


@query()
def hybrid_search(spark, sf):
    return flagship(spark, sf)


_ASKED = "nicht thereou les tion"
_HASHED = """SELECT id, place, sum(s) AS v FROM (SELECT id, CAST(('0x' || sha256(w)[1:8]) AS BIGINT) % 64 AS place, CASE WHEN CAST(('0x' || sha256(w)[9:10]) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END AS s FROM (SELECT id, unnest(regexp_extract_all(lower(t), '[a-z0-9_]+')) AS w FROM ({rows}))) GROUP BY ALL"""


@query(f"""WITH {_bm25_sql("['nicht', 'thereou', 'les', 'tion']")}, l AS (SELECT doc_id, (1::BIGINT << 39) - CAST(round_even(rank * -1000000, 0) AS BIGINT) AS o FROM r ORDER BY rank, doc_id LIMIT 12),
e AS ({_HASHED.format(rows="SELECT doc_id AS id, text AS t FROM documents")}), n AS (SELECT id, sqrt(sum(v * v)) AS n FROM e GROUP BY id),
q AS ({_HASHED.format(rows=f"SELECT 0 AS id, '{_ASKED}' AS t")}), m AS (SELECT sqrt(sum(v * v)) AS m FROM q),
c AS (SELECT e.id AS doc_id, sum(e.v * q.v) / any_value(n * m) AS c FROM e JOIN q USING (place) JOIN n ON n.id = e.id, m GROUP BY e.id),
v AS (SELECT doc_id, c FROM c WHERE c > 0 ORDER BY c DESC, doc_id LIMIT 12),
b AS (SELECT coalesce(l.doc_id, v.doc_id) AS doc_id, 0.45 * (l.doc_id IS NOT NULL)::INT + 0.55 * coalesce(c, 0) AS score, CASE WHEN l.doc_id IS NULL THEN 'semantic_match' WHEN v.doc_id IS NULL THEN 'fts_match' ELSE 'fts_match,semantic_match' END AS reasons,
 coalesce(l.o, CAST(round_even((1 - c) * 1000000, 0) AS BIGINT) + (1::BIGINT << 40)) AS place FROM l FULL JOIN v ON l.doc_id = v.doc_id)
SELECT doc_id, round(score, 6) AS score, reasons FROM b ORDER BY b.score DESC, place, doc_id LIMIT 12""")
def hybrid_documents(spark, sf):
    """The whole search, with each document as one chunk: terms, lexical and vector halves, and their fusion."""
    chunks = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.concat("source", F.lit("/d"), "doc_id").alias("path"), F.col("text").alias("content"))
    index = engine.Index(chunks, chunks, *[None] * 4, embeddings=vectors.hash_embedding(chunks, "chunk_id", "content"))
    found = engine.search(index, engine.Request(_ASKED, limit=12))
    return found.select(F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"), F.array_join("reasons", ",").alias("reasons"))
