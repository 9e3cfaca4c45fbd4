import sqlite3

import pytest
from pyspark.sql import functions as F

from siftwell.functions import vectors
from siftwell.operators import chunking, entities, graph, knowledge, lexical, lifecycle, retrieval, rules, similarity
from siftwell.plans import engine
from siftwell.sources import corpus, store, web

MODULE = """import { helper as h, other } from './lib/helper'
import React, * as all from "react"
export * from './again'

// Greets.
// Twice.

export function useGreeting(name: string) {
  const q = "{"
  return helper(name)
}

export default class Card extends Base {
  render() { return <Panel.Box title="x" /> }
}
const Theme = () => <Div />
const UserSchema = z.object({})
interface Shape { a: number }
describe('suite name', () => {
  it("works", () => { new Card(); useGreeting('a') })
})
"""


def files(spark, **contents):
    rows = [("r", p.replace("__", "/").replace("_dot_", "."), c) for p, c in contents.items()]
    from siftwell.functions import paths

    return spark.createDataFrame(rows, "repo_key string, path string, content string").withColumn("language", paths.language(F.col("path")))


def test_chunks_of_each_kind(spark):
    doc = "lost intro\n# One\ntext\n## Two  \nmore\n"
    many = "\n".join(f"line {k}" for k in range(300))
    made = files(spark, a_dot_md=doc, b_dot_ts=MODULE, c_dot_json="{}", d_dot_py=many, e_dot_txt="  \n ", f_dot_yaml=many, g_dot_md="no heading")
    got = {}
    for r in chunking.chunk_files(made).orderBy("path", "start_line").collect():
        got.setdefault(r["path"], []).append((r["chunk_kind"], r["symbol_name"], r["symbol_kind"], r["start_line"], r["end_line"]))
    assert got["a.md"] == [("markdown_section", "One", "h1", 2, 3), ("markdown_section", "Two", "h2", 4, 5)]
    assert got["b.ts"][0] == ("function", "useGreeting", "function", 5, 12)
    assert [c[1] for c in got["b.ts"]] == ["useGreeting", "default export", "Theme", "UserSchema", "Shape", "suite name"]
    assert got["c.json"] == [("config", None, None, 1, 1)]
    assert [(c[3], c[4]) for c in got["d.py"]] == [(1, 120), (101, 220), (201, 300)] == [(c[3], c[4]) for c in got["f.yaml"]]
    assert "e.txt" not in got and got["g.md"] == [("markdown_section", None, None, 1, 1)]


def test_long_declarations_become_windows():
    lines = ["function big() {", *["  x()"] * 250, "}"]
    got = chunking.declaration_chunks(lines)
    assert [(c[1], c[3], c[4]) for c in got] == [("big", 1, 120), ("big", 101, 220), ("big", 201, 252)]


def test_brace_depth_is_clamped_and_skips_quotes():
    assert chunking.brace_depths(["}", "a {", "'}' {", "}}}", "x"]) == [0, 0, 1, 2, 0]


def test_entities(spark):
    got = {e["name"]: e for e in entities.entities_of("src/m.tsx", MODULE)}
    assert got["useGreeting"]["kind"] == "hook" and got["useGreeting"]["exported"] and got["useGreeting"]["end_line"] == 11
    assert got["Card"]["kind"] == "class" and got["Card"]["default_export"]
    assert got["Theme"]["kind"] == "component" and got["UserSchema"]["kind"] == "schema"
    assert got["suite name"]["kind"] == "test_suite" and got["works"]["kind"] == "test_case"
    assert "Shape" in got and "Shape" not in {e["name"] for e in entities.entities_of("m.js", MODULE)}
    assert [e["symbol_kind"] for e in entities.entities_of("a.md", "# A\n### B")] == ["h1", "h3"]
    assert entities.entities_of("a.py", "x") == [] and entities.entities_of("a.toml", "x")[0]["symbol_kind"] == "config"


def test_imports():
    got = entities.imports_of(MODULE + "\nconst r = require('r')", with_require=True)
    assert [i["source"] for i in got] == ["./lib/helper", "react", "./again", "r"]
    assert got[0]["specifiers"] == ["helper", "other"] and got[1]["default_import"] == "React" and got[1]["namespace_import"] == "all"


def test_graph_of_a_small_project(spark):
    made = files(spark, src__m_dot_tsx=MODULE, src__lib__helper_dot_ts="export function helper(x) {\n  return x\n}\n", src__again__index_dot_ts="export const z = 1\n", src__m_dot_test_dot_tsx="import { useGreeting } from './m'\ntest('t', () => { useGreeting() })\n", app__home_dot_ts="import { S } from '../features/a/Screen'\n", features__a__Screen_dot_ts="export const S = 1\n", features__a__other_dot_ts="x\n")
    found, imports = entities.extract_entities(made), entities.extract_imports(made)
    edges = {(r["source_path"], r["target_path"], r["kind"]) for r in entities.file_edges(made, imports).collect()}
    assert ("src/m.tsx", "src/lib/helper.ts", "imports") in edges and ("src/m.tsx", "src/again/index.ts", "imports") in edges
    assert ("src/m.tsx", "src/m.test.tsx", "test_counterpart") in edges and ("src/m.test.tsx", "src/m.tsx", "test_counterpart") in edges
    assert ("app/home.ts", "features/a/Screen.ts", "route_screen") in edges and ("features/a/Screen.ts", "features/a/other.ts", "same_feature") in edges
    code = {(r["source_name"], r["target_name"], r["kind"], r["confidence"], r["target_path"]) for r in entities.code_edges(made, found, imports).collect()}
    assert ("useGreeting", "helper", "calls", 0.8, "src/lib/helper.ts") in code
    assert ("Card", "Panel.Box", "renders", 0.4, None) in code and ("suite name", "Card", "constructs", 0.8, "src/m.tsx") in code
    assert ("t", "useGreeting", "uses_hook", 0.8, "src/m.tsx") in code
    index = engine.build_index(made)
    near = {(r["path"], r["hop"]) for r in engine.impact(index, spark.createDataFrame([("src/lib/helper.ts",)], "path string")).collect()}
    assert ("src/m.tsx", 1) in near and ("src/m.test.tsx", 2) in near
    best = engine.search(index, engine.Request("greets helper name", {"current_file": ["src/lib/helper.ts"]}, limit=3)).collect()
    assert best[0]["path"] == "src/lib/helper.ts" and "current_file" in best[0]["reasons"] and len(best) == 3
    newer = engine.update_index(index, files(spark, src__lib__helper_dot_ts="export function other(x) {\n  return x\n}\n"), spark.createDataFrame([("features/a/other.ts",)], "path string"))
    assert newer.files.count() == 6 and newer.chunks.filter("path = 'features/a/other.ts'").count() == 0
    assert {r["name"] for r in newer.entities.filter("path = 'src/lib/helper.ts' AND kind != 'module'").collect()} == {"other"}
    assert newer.code_edges.filter("source_name = 'useGreeting' AND target_name = 'helper' AND confidence = 0.6").count() == 1


@pytest.mark.parametrize("stemmed", [False, True])
def test_bm25_is_sqlite_bm25(spark, stemmed):
    texts = ["the cat runs", "running cats and dogs", "a dog ran fast fast", "nothing here", "cat cat cat dog runner", "hopping happily relational conditional"]
    link = sqlite3.connect(":memory:")
    try:
        link.execute(f"CREATE VIRTUAL TABLE f USING fts5(t, tokenize='{'porter ' * stemmed}unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("this SQLite has no FTS5")
    link.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", list(enumerate(texts)))
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for terms in (["cat"], ["cats", "running"], ["fast", "dog", "missing"], ["happy", "relate"]):
        want = dict(link.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (" OR ".join(f'"{t}"' for t in terms),)).fetchall())
        got = dict(map(tuple, (lexical.bm25_stemmed if stemmed else lexical.bm25)(docs, "k", "t", terms).collect()))
        assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}, terms


def test_fusion_takes_the_last_lexical_row(spark):
    lex = spark.createDataFrame([(1, 1.2, ["current_file"], 1), (1, 1.0, ["fts_match"], 9), (2, 1.0, ["fts_match"], 10)], "id int, score double, reasons array<string>, ordinal long")
    vec = spark.createDataFrame([(2, 0.5, ["semantic_match"], 1), (3, 0.9, ["semantic_match"], 0)], "id int, score double, reasons array<string>, ordinal long")
    got = [(r["id"], round(r["score"], 4), r["reasons"]) for r in retrieval.fuse(lex, vec, "id", 10).collect()]
    assert got == [(2, 0.725, ["fts_match", "semantic_match"]), (3, 0.495, ["semantic_match"]), (1, 0.45, ["fts_match"])]


def test_query_kinds():
    assert retrieval.is_code_query("where is the handler") and not retrieval.is_code_query("usage guide for the handler") and not retrieval.is_code_query("colour")


def test_similar_edges_caps(spark):
    rows = [(k, f"d{k}/f.ts", "function", "function", "loadUser" if k % 2 else "getUser", None, [1.0, 0.01 * k]) for k in range(9)]
    chunks = spark.createDataFrame(rows, "chunk_id long, path string, chunk_kind string, symbol_kind string, symbol_name string, package_key string, embedding array<float>")
    got = similarity.similar_edges(chunks).collect()
    per = {}
    for r in got:
        per.setdefault(r["source"], []).append((r["source_name"], r["target_name"]))
        assert r["confidence"] == 0.99 and "same_normalized_symbol" in r["boosts"]
    assert all(len(v) <= 5 and all(v.count(p) <= 3 for p in v) for v in per.values()) and len(per) == 9


CORRECTIONS = [("don't use moment, use dayjs", True), ("/run always use x", False), ("let's look at this for now", False), ("let's ensure we use zod", True), ("please always run the linter", True), ("the sky is blue", False), ("", False), ("(always add tests for api work)", True)]


def test_corrections(spark):
    frame = spark.createDataFrame([(t,) for t, _ in CORRECTIONS], "t string")
    assert [r[0] for r in frame.select(knowledge.is_correction(F.col("t"))).collect()] == [s for _, s in CORRECTIONS]


def test_learning_of_a_bracket(spark):
    frame = spark.createDataFrame([("Do this (always prefer the shared client for api work) please",), ("keep names short.",), ("   ",)], "t string")
    a, b, c = (r[0] for r in frame.select(knowledge.extract_learning(F.col("t"))).collect())
    assert a["title"] == "Always prefer the shared client for api work" and a["applies_when"] == "When doing api work in this repo." and a["priority"] == 75
    assert b["summary"] == "keep names short." and b["title"] == "Keep names short" and b["rule_type"] == "prefer_pattern" and c is None


def test_rules_of_a_diff(spark):
    diff = "diff --git a/src/a.ts b/src/a.ts\n--- a/src/a.ts\n+++ b/src/a.ts\n@@ -1 +1,2 @@\n+import m from 'moment/min'\n-x\n y\ndiff --git a/gen/z.ts b/gen/z.ts\n--- a/gen/z.ts\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-gone"
    diffs = spark.createDataFrame([(1, diff)], "diff_id long, diff string")
    learned = spark.createDataFrame([("1", "r", "avoid_pattern", "t", "s", "moment.js", "dayjs", None, 0.9, "active"), ("2", "r", "generated_code", "t", "No edits", "editing gen/", None, None, 1.0, "active"), ("3", "r", "testing_convention", "t", "s", None, "add tests under tests/unit", None, 1.0, "active"), ("4", "r", "avoid_pattern", "t", "s", "y", None, None, 0.7, "active")], "learning_id string, repo_key string, rule_type string, title string, summary string, avoid string, prefer string, path_globs array<string>, confidence double, status string")
    index = engine.Index(*[None] * 6)
    got = {(r["rule_kind"], r["path"], r["pattern"]) for r in engine.review(index, diffs, learned).collect()}
    assert got == {("forbidden_import", "src/a.ts", "moment"), ("forbidden_path_edit", "gen/z.ts", "gen/**"), ("required_test_path", None, "tests/unit/**")}
    assert [tuple(r) for r in rules.changed_ranges(diffs).collect()] == [(1, "src/a.ts", 1, 2, 2)]


def test_added_blocks_and_dry_matches(spark):
    lines = ["+export function parseAmount(value: string) {", "+  const normalized = value.replace(/[^0-9.]/g, '')", "+  return Number.parseFloat(normalized)", "+}", " kept", "+short"]
    diffs = spark.createDataFrame([(1, "diff --git a/a.ts b/a.ts\n+++ b/a.ts\n@@ -1 +1 @@\n" + "\n".join(lines))], "diff_id long, diff string")
    blocks = rules.added_blocks(rules.diff_lines(diffs))
    assert blocks.count() == 1
    matches = blocks.select("diff_id", "block", F.lit("lib/money.ts").alias("match_path"), F.lit(1).alias("start_line"), F.lit(4).alias("end_line"), F.lit("function parseAmount(value) { const normalized = value.replace(); return Number.parseFloat(normalized) }").alias("content"), F.lit(0.4).alias("score"), F.array(F.lit("fts_match")).alias("reasons"), F.lit(1).alias("place"))
    assert [r["evidence"] for r in rules.dry_warnings(blocks, matches, blocks).collect()] == ["similar to lib/money.ts:1-4 (fts_match)"]
    assert rules.dry_warnings(blocks, matches.withColumn("match_path", F.lit("a.ts")), blocks).count() == 0


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("x", "y")], "source_path string, target_path string")
    got = dict(map(tuple, graph.closure(spark.createDataFrame([("c",)], "path string"), edges).collect()))
    assert got == {"c": 0, "b": 1, "a": 2, "d": 3}


def test_file_lifecycle(spark, tmp_path):
    root = tmp_path / "repo"
    for name, body in {"a.ts": b"x", "b.md": b"y", "logo.png": b"z", "bin.dat": b"\x00", "node_modules/m.js": b"q", "big.txt": b"w" * 50}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(body)
    config = corpus.load_config(corpus.ScanConfig(max_file_bytes=40), "# c\n!keep\n/build/\n", '{"packages": [{"path": "src", "key": "s"}], "maxFileBytes": 20}', "not json")
    assert "build/**" in config.exclude and config.max_file_bytes == 20
    first = corpus.scan_directory(spark, str(root), config, "r")
    assert {r["path"]: r["skip_reason"] for r in first.collect()} == {"a.ts": None, "b.md": None, "logo.png": "binary", "bin.dat": "binary", "node_modules": "ignored", "big.txt": "too_large"}
    whole = {r["path"]: r["skip_reason"] for r in corpus.scan_store(spark, str(root), config, "r").collect()}
    assert whole == {"a.ts": None, "b.md": None, "logo.png": "binary", "bin.dat": "binary", "node_modules/m.js": "ignored", "big.txt": "too_large"}
    kept = corpus.scanned(first, config)
    tables = store.Store(spark, str(tmp_path / "tables"))
    at = lambda df, day: df.withColumns({"last_indexed_at": F.lit(day).cast("timestamp"), "updated_at": F.lit(day).cast("timestamp"), "deleted_at": F.lit(None).cast("timestamp")})
    tables.write("files", at(kept, "2024-01-01"))
    (root / "a.ts").write_bytes(b"changed")
    (root / "b.md").unlink()
    (root / "c.py").write_bytes(b"new")
    again = corpus.scanned(corpus.scan_directory(spark, str(root), config, "r"), config)
    assert dict(map(tuple, lifecycle.change_classes(tables.read("files"), again).collect())) == {"a.ts": "update", "b.md": "missing", "c.py": "insert"}
    known = lifecycle.mark_missing(lifecycle.upsert_files(tables.read("files"), again, "2024-02-01"), again, "2024-02-01")
    assert tables.write("files", known) == 2 and tables.versions("files") == [1, 2]
    state = {r["path"]: (r["deleted_at"] is not None, r["content"]) for r in tables.read("files").collect()}
    assert state == {"a.ts": (False, "changed"), "b.md": (True, "y"), "c.py": (False, "new")}
    children = spark.createDataFrame([("a.ts",)], "path string")
    assert lifecycle.prune(tables.read("files"), children, "2024-02-20").count() == 3
    assert {r["path"] for r in lifecycle.prune(tables.read("files"), children, "2024-04-01").collect()} == {"a.ts", "c.py"}
    with pytest.raises(KeyError):
        tables.read("absent")


def test_html(spark):
    page = "<html><head><title>T</title></head><body><h1>Big &amp; bold</h1><p>One <b>two</b><br>three</p><script>x</script><ul><li><a href='/u'>link</a></li></ul></body></html>"
    row = spark.createDataFrame([(page,)], "h string").select(web.html_to_text(F.col("h")), web.html_to_markdown(F.col("h")), web.html_words(F.col("h"))).first()
    assert row[0] == "Big & bold\n\nOne two\nthree\n\nlink"
    assert row[1] == "# Big & bold\n\nOne **two**\nthree\n\n- [link](/u)"
    assert row[2] == "Big & bold One two three link"


def test_json_replies(spark):
    frame = spark.createDataFrame([('```json\n{"a": 1}\n```', 'x <<{"b": 2}>> y'), ("none", "none")], "r string, m string")
    got = frame.select(web.fenced_json(F.col("r"), "a int")["a"], web.between_marks(F.col("m"), "<<", ">>").cast("string")).collect()
    assert [tuple(r) for r in got] == [(1, '{"b":2}'), (None, None)]


def test_clamp():
    assert [corpus.clamp(v, 1, 10, 4) for v in (5.9, 0, 99, "x", float("nan"), None, True)] == [5, 1, 10, 4, 4, 4, 4]


def test_learning_search_and_semantic_duplicates(spark):
    learned = spark.createDataFrame([("1", "r", "prefer dayjs over moment", "Prefer dayjs over moment.", "prefer_pattern", "When choosing.", "moment", "dayjs", None, 0.9, 70, "active"), ("2", "r", "tabs", "Use tabs.", "style", "Always.", None, None, None, 0.4, 10, "active"), ("3", "r", "dayjs only", "dayjs", "style", "x", None, None, None, 0.9, 10, "draft")], "learning_id string, repo_key string, title string, summary string, rule_type string, applies_when string, avoid string, prefer string, path_globs array<string>, confidence double, priority long, status string")
    assert [r["learning_id"] for r in engine.search_learnings(learned, "dayjs moment").collect()] == ["1"]
    side = "struct(title, summary, avoid, prefer, rule_type, path_globs)"
    found = learned.filter("learning_id = '1'").selectExpr("'c' AS candidate_id", "learning_id", "0.8D AS score", "1 AS place", f"{side} AS l", "named_struct('title', 't', 'summary', 's', 'avoid', 'moment', 'prefer', 'dayjs', 'rule_type', 'prefer_pattern', 'path_globs', array('a/**')) AS c")
    assert [tuple(r) for r in knowledge.semantic_duplicates(found).collect()] == [("c", "1")]
    assert knowledge.semantic_duplicates(found.withColumn("score", F.lit(0.7))).count() == 0
    feedback = spark.createDataFrame([("f1", "accepted", "Prefer dayjs over moment", None, None, None), ("f2", "rejected", "x", None, None, None)], "finding_id string, action string, title string, evidence string, correction string, path_globs array<string>")
    snapshot, created = engine.record_feedback(learned, feedback)
    assert created.count() == 0 and round(snapshot.filter("learning_id = '1'").first()["confidence"], 2) == 0.95


def test_texts(spark):
    from siftwell.operators import formats

    chunk = spark.createDataFrame([("a.ts", "typescript", "f", "function", "function", 1, 3, "x" * 9000, ["r1", "r2"], ["File imports: b"])], "path string, language string, symbol_name string, symbol_kind string, chunk_kind string, start_line int, end_line int, content string, reasons array<string>, graph_lines array<string>")
    body, shown = chunk.select(formats.embedding_text(), formats.chunk_text(200)).first()
    assert body.startswith("Path: a.ts\nLanguage: typescript\nSymbol: function f\nKind: function\nGraph context:\nFile imports: b\nCode:\nxxx") and len(body) < 6000
    assert shown.startswith("### a.ts:1-3\nWhy retrieved: r1, r2\nSymbol: f\n```\nxxx") and shown.endswith("[Chunk truncated to 200 characters]\n```")
    assert formats.prompt_text(["c"], ["r"], most=30).endswith("[Context truncated to 30 characters]")
    assert formats.review_queries("b", "", ["x.ts"], ["k", "k"])[:2] == ["b", "k\n\nx.ts"]
    ranges = spark.sql("SELECT array(named_struct('start_line', 1, 'end_line', 4), named_struct('start_line', 9, 'end_line', 9)) AS r")
    assert ranges.select(formats.ranges_label(F.col("r"))).first()[0] == "L1-L4, L9"


def test_similar_edges_without_bounds(spark):
    rows = [(k, f"d{k}/f.ts", "function", "function", "loadUser", None, [1.0, 0.01 * k]) for k in range(50)]
    chunks = spark.createDataFrame(rows, "chunk_id long, path string, chunk_kind string, symbol_kind string, symbol_name string, package_key string, embedding array<float>")
    got = similarity.similar_edges(chunks, per_source=None, per_pair=None, most=None)
    assert sorted((r["source"], r["target"]) for r in got.collect()) == [(a, b) for a in range(50) for b in range(50) if a != b]


def test_vector_top_k_each_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    monkeypatch.setattr(retrieval, "ROW_BLOCK", 7)
    items = spark.createDataFrame([(k, [float(k % 5), float(k % 7) - 3, 1.0]) for k in range(40)] + [(40, None), (41, [0.0, 0.0, 0.0])], "id long, embedding array<double>")
    queries = items.filter("id % 4 = 0").withColumnRenamed("id", "query")
    got = {}
    for r in retrieval.vector_top_k_each(items, queries, 5, "id").collect():
        got.setdefault(r["query"], []).append((-r["similarity"], r["id"]))
    for q in queries.filter("query < 40").collect():
        alone = retrieval.vector_top_k(items.withColumn("embedding", F.coalesce("embedding", F.array())), q["embedding"], 42, "id").collect()
        want = sorted((-round(r["similarity"], 12), r["id"]) for r in alone)[:5]
        assert sorted(got[q["query"]]) == want


def test_learning_search_filters_before_it_cuts(spark):
    columns = "learning_id string, repo_key string, title string, summary string, rule_type string, applies_when string, avoid string, prefer string, path_globs array<string>, package_key string, confidence double, priority long, status string"
    near = [(f"a{k:02}", "r", "dayjs moment", "dayjs moment", "style", "x", None, None, None, "other" if k % 2 else None, 0.9, 10, "active" if k % 2 else "superseded") for k in range(40)]
    far = ("z", "r", "formatting", "something else entirely", "style", "x", None, "dayjsx", None, "mine", 0.9, 10, "active")
    learned = spark.createDataFrame([*near, far], columns)
    probe = vectors.hash_embedding(spark.createDataFrame([(0, "style formatting dayjs moment")], "k int, t string"), "k", "t").first()["embedding"]
    bodies = vectors.hash_embedding(learned.withColumn("b", knowledge.embedding_text()), "learning_id", "b")
    assert [r["learning_id"] for r in retrieval.vector_top_k(bodies, probe, 41, "learning_id").collect()].index("z") >= 32
    got = engine.search_learnings(learned, "style formatting dayjs moment", "mine").collect()
    assert [(r["learning_id"], r["reasons"]) for r in got] == [("z", ["fts_match", "semantic_match"])]


def test_closure_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"f{k + 1}", f"f{k}") for k in range(104)], "source_path string, target_path string").coalesce(1)
    seeds = spark.createDataFrame([("f0",)], "path string").coalesce(1)
    assert dict(map(tuple, graph.closure(seeds, edges).collect())) == {f"f{k}": k for k in range(105)}
    with pytest.raises(ValueError):
        graph.closure(seeds, edges, most_rounds=3)
