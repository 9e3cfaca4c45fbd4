"""Tables that grow with the corpus are merged, whatever their compressed files say."""

import pytest
from pyspark.sql import functions as F

from siftwell.functions import vectors
from siftwell.operators import entities, graph, knowledge, lexical, ordering, retrieval, rules, similarity

from .test_reach import joined_rows


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _files(spark, folder):
    """Files whose table is far larger than what it takes on disk."""
    n = F.col("id").cast("string")
    made = spark.range(300).select(F.lit("r").alias("repo_key"), F.concat(F.lit("src/features/a/f"), n, F.lit(".ts")).alias("path"), F.concat(F.lit("import { x } from './f1'\nexport function f"), n, F.lit("() {\n  return x()\n}\n")).alias("content"), F.lit("typescript").alias("language"))
    made.coalesce(1).write.parquet(f"{folder}/files")
    return spark.read.parquet(f"{folder}/files")


def test_edges_and_vectors_of_stored_files_send_no_table_whole(spark, tmp_path):
    files = _files(spark, tmp_path)
    entities.extract_entities(files).write.parquet(f"{tmp_path}/entities")
    entities.extract_imports(files).write.parquet(f"{tmp_path}/imports")
    found, imports = (spark.read.parquet(f"{tmp_path}/{t}") for t in ("entities", "imports"))
    edges = entities.import_edges(imports, files)
    assert "Broadcast" not in _plan(edges) and edges.count() == 300
    code = entities.code_edges(files, found, imports)
    assert "Broadcast" not in _plan(code) and code.filter("kind = 'calls'").count() == 300
    made = vectors.hash_embedding(files, "path", "content")
    assert "Broadcast" not in _plan(made) and made.count() == 300


def test_a_table_is_sent_whole_only_where_it_has_few_rows(spark, tmp_path, monkeypatch):
    files = _files(spark, tmp_path)
    for held, sent in ((300, True), (299, False)):
        monkeypatch.setattr(ordering, "_HELD", held)
        left = files.join(ordering.met(files.select("path")), "path", "left_semi")
        assert ("Broadcast" in _plan(left)) == sent and left.count() == 300


def test_common_terms_do_not_pair_queries_with_documents(spark, monkeypatch):
    monkeypatch.setattr(lexical, "RARE", 5)
    docs = spark.range(300).selectExpr("id AS k", "concat('common other name', id % 100, IF(id % 7 = 0, ' common', ''), repeat(' x', CAST(id % 3 AS INT))) AS t")
    queries = spark.range(120).selectExpr("id AS query", "array('common', 'other', concat('name', id)) AS terms")  # the last 20 have no rare term
    got = {}
    for r in lexical.bm25_each(docs, "k", "t", queries, 3).collect():
        got.setdefault(r["query"], []).append((round(r["rank"], 9), r["k"]))
    for query in (0, 57, 99, 105):
        every = lexical.bm25(docs, "k", "t", ["common", "other", f"name{query}"])
        assert sorted(got[query]) == sorted((round(r["rank"], 9), r["k"]) for r in every.orderBy("rank", "k").limit(3).collect()), query
    assert len(got) == 120
    assert joined_rows(spark, lexical.bm25_each(docs, "k", "t", queries, 3)) <= 3000  # 36,000 pairs share a common term


def _chunks(spark, n):
    rows = [(k, f"d{k % 3}/f{k}.ts", f"k{k % 2}", None, f"n{k % 4}", "p" if k % 5 else "", [1.0, 0.05 * (k % 11), 0.02 * k]) for k in range(n)]
    return spark.createDataFrame(rows, "chunk_id long, path string, chunk_kind string, symbol_kind string, symbol_name string, package_key string, embedding array<float>")


@pytest.mark.parametrize("per_source", [5, None])
def test_pairs_of_chunks_are_not_shuffled_to_meet_their_chunks(spark, per_source):
    plan = similarity.similar_pool(_chunks(spark, 60), 0.5, per_source)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("FlatMapCoGroups")]


def test_cells_of_chunks_give_what_one_cell_gives(spark, monkeypatch):
    shape = lambda df: sorted((r["source"], r["target"], r["n"], r["similarity"], r["score"], tuple(r["boosts"])) for r in df.collect())
    chunks = _chunks(spark, 60)
    want = shape(similarity.similar_pool(chunks, 0.5))
    monkeypatch.setattr(similarity, "CELL", 7)
    monkeypatch.setattr(similarity, "_PAIRS", 20)
    assert shape(similarity.similar_pool(chunks, 0.5)) == want and len(want) == 300


def test_a_pool_is_kept_up_without_an_index_of_all_vectors(spark):
    shape = lambda df: sorted((r["source"], r["target"], r["n"], r["score"]) for r in df.collect())
    now = _chunks(spark, 60)
    before = now.filter("chunk_id % 7 != 0").unionByName(now.filter("chunk_id % 9 = 1").withColumn("chunk_id", F.col("chunk_id") + 100))
    changed, deleted = now.filter("chunk_id % 7 = 0"), before.filter("chunk_id >= 100").select("chunk_id")
    got = similarity.update_pool(similarity.similar_pool(before, 0.5), now, None, changed, deleted, 0.5)
    assert shape(got) == shape(similarity.similar_pool(now, 0.5))


def test_bm25_tokenizes_each_text_once(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "to run and run"), (2, "walk"), (3, None), (4, ""), (5, "a walk to walk")], "k long, text string")
    ranked = lexical.bm25(docs, "k", "text", ["run", "walk"])
    assert {r["k"]: r["rank"] < 0 for r in ranked.collect()} == {1: True, 2: True, 5: True}
    final = _plan(ranked)[: _plan(ranked).find("Initial Plan")]
    assert final.count("regexp_extract_all") == 1

    written = []
    settled = ordering.settled
    monkeypatch.setattr(ordering, "settled", lambda df: written.append(_plan(df)) or settled(df))
    stemmed = lexical.bm25_stemmed(docs, "k", "text", ["running", "walks"])
    assert _plan(stemmed).count("regexp_extract_all") == 0 and sum("regexp_extract_all" in p for p in written) == 1
    assert {r["k"] for r in stemmed.collect()} == {1, 2, 5}


def test_a_hub_is_cut_before_its_rows_meet(spark):
    edges = spark.createDataFrame([("hub", f"f{k}", "same_feature") for k in range(30)] * 2, "source_path string, target_path string, kind string")
    code = spark.createDataFrame([], "source_path string, target_path string, source_name string, target_name string, kind string")
    found = spark.createDataFrame([("hub", "function", "a")], "path string, kind string, name string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = graph.summaries(found, edges, code, found)
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Join LeftSemi") < plan.index("WindowGroupLimit")
        row = made.first()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert row["same_feature"] == sorted(f"f{k}" for k in range(30))[:8] and row["declarations"] == ["function a"]


def test_rules_of_many_salts_are_not_sent_whole(spark):
    imports = spark.range(20).selectExpr("id AS diff_id", "'a.ts' AS path", "concat('tool', id % 3, '/x') AS source", "concat('from tool', id % 3) AS line", "1 AS line_no")
    made = spark.range(30).selectExpr("concat('r', id) AS rule_id", "'forbidden_import' AS rule_kind", "concat('tool', id % 3) AS pattern", "'m' AS message", "CAST(NULL AS array<string>) AS path_globs", "'error' AS severity", "'active' AS status")
    found = rules.forbidden_imports(imports, made)
    assert "Broadcast" not in _plan(found)  # a rule stands in every salt, which a planner doesn't see
    assert joined_rows(spark, found) == 200
    assert {(r["diff_id"], r["rule_id"]) for r in found.collect()} == {(d, f"r{k}") for d in range(20) for k in range(30) if d % 3 == k % 3}


def _compared(spark, df) -> int:
    """The most rows that an exchange below a cogroup writes."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = df.select("*")
        counts = []

        def walk(node, inside):
            inside = inside or "CoGroups" in node.nodeName()
            if inside and node.nodeName() == "Exchange":
                counts.append(node.metrics().apply("shuffleRecordsWritten").value())
            for k in range(node.children().size()):
                walk(node.children().apply(k), inside)

        list(map(tuple, df.collect()))
        walk(df._jdf.queryExecution().executedPlan(), False)
        return max(counts)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_equal_vectors_are_compared_once(spark):
    items = spark.range(3000).selectExpr("id", "array(CAST(id % 7 AS DOUBLE), CAST(id % 11 AS DOUBLE) - 5, 1.0D) AS embedding")
    queries = items.filter("id < 2000").withColumnRenamed("id", "query")
    found = retrieval.vector_top_k_each(items, queries, 4, "id")
    assert _compared(spark, found) <= 200  # there are 77 vectors
    got = {}
    for r in found.collect():
        got.setdefault(r["query"], []).append((-r["similarity"], r["id"]))
    assert len(got) == 2000
    for q in (0, 5, 76, 1999):
        alone = retrieval.vector_top_k(items, queries.filter(f"query = {q}").first()["embedding"], 3000, "id").collect()
        assert sorted(got[q]) == sorted((-round(r["similarity"], 12), r["id"]) for r in alone)[:4]


def test_rows_of_agreeing_phrases_are_dealt_and_met_once(spark):
    rows = spark.range(300).selectExpr("'g' AS g", "(id * 7) % 300 AS id", "IF(id % 3 = 0, 'brand11 size1', IF(id % 3 = 1, 'brand11 size12', 'brand11 size2')) AS phrase")
    found = knowledge.compatible_pairs(rows, "g", "id", "phrase")
    by = {r["id"]: r["phrase"] for r in rows.collect()}
    want = sorted((a, b) for a in by for b in by if a < b and (by[a] in by[b] or by[b] in by[a]))
    assert sorted(map(tuple, found.collect())) == want
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = _plan(found)
        tasks = [n for _, n in found.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "Broadcast" not in plan[: plan.index("Exchange")] and "SortMergeJoin" in plan  # the planner would take the rows for few
    assert len(tasks) == 4 and max(tasks) < len(want) / 2
