"""Steps that must not pair rows which only share a term, a glob or a phrase: results, and the rows that joins make."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from siftwell.functions import vectors
from siftwell.operators import knowledge, lifecycle, rules
from siftwell.plans import engine
from siftwell.sources import web


def joined_rows(spark, df) -> int:
    """The most rows that any join of df's executed plan puts out."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = df.select("*")
        df._jdf.queryExecution().executedPlan()
        counts = []

        def walk(node):
            if "Join" in node.nodeName():
                counts.append(node.metrics().apply("numOutputRows").value())
            for k in range(node.children().size()):
                walk(node.children().apply(k))

        list(map(tuple, df.collect()))
        walk(df._jdf.queryExecution().executedPlan())
        return max(counts)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_scoped_rules_pair_no_files_with_rules(spark):
    files = spark.range(200).select(F.concat(F.lit("src/f"), "id", F.lit(".ts")).alias("path"))
    made = spark.range(200).select(F.col("id").alias("rule_id"), F.when(F.col("id") % 2 == 0, F.array(F.lit("src/**"))).otherwise(F.array(F.lit("lib/**"))).alias("scope"))
    found = rules.scoped_rules(made, files)
    assert sorted(r[0] for r in found.select("rule_id").collect()) == list(range(0, 200, 2))
    assert joined_rows(spark, found) <= 1000


def test_find_duplicates_meets_one_row_a_term(spark):
    known = spark.range(300).selectExpr("'r' AS repo_key", "id AS learning_id", "'active' AS status", "'Legacy' AS avoid", "concat('new', id) AS prefer", "'same' AS title")
    asked = spark.range(300).selectExpr("'r' AS repo_key", "id AS candidate_id", "CASE WHEN id % 3 = 2 THEN NULL ELSE 'legacy' END AS avoid", "CASE WHEN id % 3 = 0 THEN concat('NEW', id) END AS prefer", "'Same' AS title")
    found = knowledge.find_duplicates(asked, known)
    assert {r["candidate_id"]: r["learning_id"] for r in found.collect()} == {k: k if k % 3 == 0 else 0 for k in range(300)}
    assert joined_rows(spark, found) <= 600


def test_find_duplicates_by_title_needs_another_term(spark):
    columns = "repo_key string, learning_id long, status string, avoid string, prefer string, title string"
    known = spark.createDataFrame([("r", 1, "active", "a", "x", "t"), ("r", 2, "active", "a", "y", "t"), ("r", 3, "draft", "b", "x", "t"), ("r", 0, "ignored", "c", "x", "t"), ("s", 0, "active", "c", "x", "t")], columns)
    asked = spark.createDataFrame([("r", 10, "a", "z", "t"), ("r", 11, "b", "z", "t"), ("r", 12, "c", "z", "t"), ("r", 13, None, None, "t"), ("r", 14, "b", "x", "u"), ("r", 15, "d", None, "u")], "repo_key string, candidate_id long, avoid string, prefer string, title string")
    assert {tuple(r) for r in knowledge.find_duplicates(asked, known).collect()} == {(10, 3), (11, 1), (12, 1), (13, 1), (14, 3)}


def test_compatible_pairs_compares_distinct_phrases(spark):
    rows = spark.range(400).selectExpr("'g' AS g", "id", "concat('a long phrase ', id % 20, ' ') AS phrase")
    found = knowledge.compatible_pairs(rows.withColumn("phrase", F.expr("concat(id % 20, 'zz')")), "g", "id", "phrase")
    assert {tuple(r) for r in found.collect()} == {(a, b) for a in range(400) for b in range(a + 1, 400) if a % 20 == b % 20}
    assert joined_rows(spark, found) <= 10_000  # 160,000 pairs share the group
    inside = spark.createDataFrame([("g", 1, "twelve chars"), ("g", 2, "twelve chars more"), ("h", 3, "twelve chars")], "g string, id long, phrase string")
    assert {tuple(r) for r in knowledge.compatible_pairs(inside, "g", "id", "phrase").collect()} == {(1, 2)}


_RULE = "rule_id string, rule_kind string, pattern string, message string, path_globs array<string>, severity string, status string"


def exchanged(df) -> str:
    """The part of df's plan that is above the first join."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan[: plan.index("Join")]


def test_forbidden_imports_come_out_once_without_a_shuffle(spark):
    lines = [("d1", "a.ts", s, f"from {s}") for s in ("tool", "tool.js", "tool/x/y", "toolbox", "other.JS", "a//b")] + [("d1", "a.ts", "tool", "from tool"), ("d1", "a.ts", "tool/q", "from tool")]
    imports = spark.createDataFrame([(*x, n) for n, x in enumerate(lines)], "diff_id string, path string, source string, line string, line_no int")
    made = spark.createDataFrame([(f"r{k}", "forbidden_import", p, "m", None, "error", "active") for k, p in enumerate(("tool", "tool", "other", "a/", "tool/x", "tool.js"))] + [("r0", "forbidden_import", "tool", "m", None, "error", "active")], _RULE)
    found = rules.forbidden_imports(imports, made)
    got = sorted((r["rule_id"], r["evidence"]) for r in found.collect())
    both = ["from tool", "from tool.js", "from tool/x/y"]
    assert got == sorted([("r0", e) for e in both] + [("r1", e) for e in both] + [("r2", "from other.JS"), ("r3", "from a//b"), ("r4", "from tool/x/y"), ("r5", "from tool"), ("r5", "from tool.js")])
    assert "Aggregate" not in exchanged(found)


def test_rules_of_one_place_are_one_want(spark):
    files = spark.createDataFrame([(f"d{k}", p) for k, ps in enumerate((["src/a.ts"], ["src/a.ts", "tests/u/a.test.ts"], ["src/gen/b.ts", "src/gen/b.ts"], ["tests/u/x.test.ts"])) for p in ps], "diff_id string, path string")
    tests = [(f"t{k}", "required_test_path", "tests/u/**", "m", ["tests/u/**"], "warning", "active") for k in range(100)] + [("n", "required_test_path", "tests/u/**", "m", ["src/gen/**", "tests/u/**"], "warning", "active")]
    edits = [("e", "forbidden_path_edit", "src/gen/**", "m", ["src/gen/**"], "error", "active"), ("f", "forbidden_path_edit", "x", "m", ["src/**", "src/gen/*.ts"], "error", "active")]
    made = spark.createDataFrame(tests + edits, _RULE)
    lost = rules.missing_tests(files, made)
    assert sorted((r["diff_id"], r["rule_id"]) for r in lost.collect()) == sorted([(d, f"t{k}") for d in ("d0", "d2") for k in range(100)] + [("d2", "n")])
    assert "Aggregate" not in exchanged(lost)
    assert sorted((r["diff_id"], r["rule_id"], r["path"]) for r in rules.forbidden_edits(files, made).collect()) == [("d0", "f", "src/a.ts"), ("d1", "f", "src/a.ts"), ("d2", "e", "src/gen/b.ts"), ("d2", "f", "src/gen/b.ts")]


def test_same_feature_edges_are_not_made_distinct_again(spark):
    from siftwell.operators import entities

    files = spark.range(300).select(F.lit("r").alias("repo_key"), F.concat(F.lit("src/features/a/f"), F.lpad(F.col("id").cast("string"), 3, "0"), F.lit(".ts")).alias("path"), F.lit("").alias("content"))
    files = files.unionByName(files)
    edges = entities.file_edges(files, entities.extract_imports(files))
    paths = [f"src/features/a/f{k:03}.ts" for k in range(300)]
    want = sorted((p, q) for p in paths for q in [x for x in paths[:11] if x != p][:10])
    assert sorted((r["source_path"], r["target_path"]) for r in edges.filter("kind = 'same_feature'").collect()) == want
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("Union")


def test_hash_embedding_shuffles_nothing(spark):
    texts = ["the Tion the tion_2", None, "", "?! é", "les nicht " * 40]
    made = vectors.hash_embedding(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t")
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    for key, vector in made.collect():
        want = [0.0] * 64
        for token in re.findall("[a-z0-9_]+", (texts[key] or "").lower()):
            sha = hashlib.sha256(token.encode()).hexdigest()
            want[int(sha[:8], 16) % 64] += 1 if int(sha[8:10], 16) % 2 == 0 else -1
        size = sum(v * v for v in want) ** 0.5
        assert vector == pytest.approx([v / size if size else 0.0 for v in want])


def test_search_cuts_files_once(spark):
    texts = [(f"src/f{k}.ts", f"export function made{k}() {{ return '{{' }}\nexport const handler = {k}\n" * 2) for k in range(8)]
    files = spark.createDataFrame([("r", path, body, "typescript") for path, body in texts], "repo_key string, path string, content string, language string")
    index, request = engine.build_index(files), engine.Request("where is the handler", {"current_file": ["src/f1.ts"]})
    once = engine.search(engine.chunked(index), request)
    assert sorted(once.columns) == sorted(engine.search(index, request).columns)
    assert [r["chunk_id"] for r in once.collect()] == [r["chunk_id"] for r in engine.search(index, request).collect()]
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan and plan.count("MapInArrow") == 1  # the vectors alone


def test_upsert_files_joins_once(spark):
    known = spark.sql("SELECT * FROM VALUES ('a', 1L, true, timestamp'2024-01-01', timestamp'2024-01-01', null), ('b', 2L, false, timestamp'2024-01-01', timestamp'2024-01-01', null), ('c', 3L, true, timestamp'2024-01-01', timestamp'2024-01-01', timestamp'2024-01-02'), ('d', 4L, null, timestamp'2024-01-01', timestamp'2024-01-01', null) AS t(path, file_hash, is_generated, last_indexed_at, updated_at, deleted_at)")
    scanned = spark.sql("SELECT * FROM VALUES ('a', 1L, true), ('b', 9L, false), ('c', 3L, true), ('e', 5L, false), (null, 6L, true) AS t(path, file_hash, is_generated)")
    out = lifecycle.upsert_files(known, scanned, "2030-01-01")
    assert len(re.findall(r"\bJoin\b", out._jdf.queryExecution().optimizedPlan().toString())) == 1
    got = {r["path"]: (r["file_hash"], r["is_generated"], r["last_indexed_at"].year, r["updated_at"].year, r["deleted_at"]) for r in out.collect()}
    assert got == {"a": (1, True, 2030, 2024, None), "b": (9, False, 2030, 2030, None), "c": (3, True, 2030, 2030, None), "d": (4, None, 2024, 2024, None), "e": (5, False, 2030, 2030, None)}


def test_capture_cuts_a_message_up_once(spark):
    said = spark.createDataFrame([("please use dayjs instead of using moment",), ("why is it so slow?",), (None,), ("",)], "text string")
    out = knowledge.capture(said)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan and not any("regexp_extract" in line for line in plan.split("\n") if "Filter" in line)
    assert [(r["avoid"], r["prefer"], r["status"]) for r in out.collect()] == [("moment", "dayjs", "active")]


def test_markdown_holds_no_batch_of_pages(spark):
    pages = spark.createDataFrame([("<h1>a</h1><p>b <b>c</b>",), (None,)], "html string")
    out = pages.select(web.html_to_markdown(F.col("html")).alias("m"), web.html_to_text(F.col("html")).alias("t"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    assert [tuple(r) for r in out.collect()] == [("# a\n\nb **c**", "a\n\nb c"), (None, None)]
