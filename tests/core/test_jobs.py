import itertools
import re

import pytest
from pyspark.sql import functions as F

from siftwell.functions import paths, text, vectors
from siftwell.operators import entities, jobs, knowledge, lexical, lookups, retrieval, rules
from siftwell.plans import engine
from siftwell.plans import stored as stored_index
from siftwell.sources.store import Store

from .test_operators import MODULE, files
from .test_reach import joined_rows

GLOBS = ["src/**", "./src/gen", "gen", "*.PNG", "**/*.test.ts", "packages/*/src/**", "readme_?.md", "**/gen/*.json", "{a,b}/**", "[ab]*", "**", "*", "", "  ", "src/a.ts", "docs/", "**/.hidden", "*.d.ts", "{src/gen,packages/*/lib}/**", "!src/**", "+(a|b).ts", "**/[[:lower:]].!(js|ts)", "#x", "{a,readme_{1..3}}.{md,test.ts}", "[id].ts", "x/{gen,y.d.ts}"]
PATHS = ["src/a.ts", "./src/gen/x.json", "src\\gen\\y.json", "gen/z.ts", "x/gen", "img/a.PNG", "dir.PNG/f", "a.test.ts", "deep/er/b.test.ts", "packages/en/src/m.js", "packages/en/lib/m.js", "readme_1.md", "docs/readme_22.md", "a/q", "b", "c/.hidden", "t.d.ts", "x/y.d.ts", "app/[id].ts", "d/#x", "b.ts"]


def test_globs_by_keys_are_globs_one_by_one(spark):
    made = spark.createDataFrame([(k, p) for k, p in enumerate(PATHS)], "n int, path string")
    globs = spark.createDataFrame([(g,) for g in [*GLOBS, GLOBS[0], None]], "pattern string")
    got = {(r["path"], r["pattern"]) for r in rules.pattern_hits(made, globs).collect()}
    want = {(r["path"], g) for g in GLOBS for r in made.filter(paths.matches_any(F.col("path"), [g])).collect()}
    assert got == want and len({g for _, g in want}) > 12


def test_required_tests_by_source_globs(spark):
    made = spark.createDataFrame([(1, "src/a.ts"), (2, "lib/b.ts"), (3, "src/c.ts"), (3, "tests/unit/c.ts"), (4, "tests/x.ts"), (5, "src/d.ts"), (5, "tests/e2e/d.ts")], "diff_id int, path string")
    known = spark.createDataFrame([("wide", "tests/unit/**", None), ("narrow", "tests/**", ["src/**", "tests/**"]), ("odd", "src/**", None)], "rule_id string, pattern string, path_globs array<string>")
    known = known.withColumns({"rule_kind": F.lit("required_test_path"), "severity": F.lit("warning"), "message": F.lit("m"), "status": F.lit("active")})
    got = sorted((r["rule_id"], r["diff_id"]) for r in rules.missing_tests(made, known).collect())
    assert got == [("narrow", 1), ("wide", 1), ("wide", 2), ("wide", 5)]


@pytest.mark.parametrize("width", [1, 3, 8, 80])
def test_wrap(spark, width):
    def plain(value):
        lines, line = [], ""
        for word in value.split():
            if line and len(line) + 1 + len(word) <= width or not line and len(word) <= width:
                line = f"{line} {word}" if line else word
                continue
            lines += [line] if line else []
            cut = max(0, (len(word) - 1) // width)
            lines += [word[k * width : (k + 1) * width] for k in range(cut)]
            line = word[cut * width :]
        return lines + [line] if line or not lines else lines

    texts = ["", "  \n", "a", "one two  three", "abcdefghijklmnop q", "x " * 9, "aaaaaaaa bbbbbbbbb cc", "émile ö"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in frame.select(text.wrap(F.col("t"), width)).collect()] == [plain(t) for t in texts]


def test_below(spark):
    rows = [("/r/a/b.ts", "a/b.ts"), ("/r", None), ("/r/", None), ("/rest/x", None), ("/r/../x", None), ("/r/./a//b", "a/b"), ("/r/x/../y", "y"), ("C:\\r", None)]
    frame = spark.createDataFrame([(p,) for p, _ in rows], "p string")
    assert [r[0] for r in frame.select(paths.below(F.col("p"), "/r")).collect()] == [w for _, w in rows]


def test_pending_jobs(spark):
    full, changed, deleted, backfill = jobs.FULL, jobs.CHANGED, jobs.DELETED, jobs.BACKFILL
    asked = [(1, 1, changed, "b"), (1, 2, changed, "a"), (1, 3, changed, "b"), (1, 4, backfill, None), (1, 5, full, None), (1, 6, full, None), (1, 7, deleted, None), (2, 1, full, None), (2, 2, backfill, None), (3, 1, deleted, "x")]
    got = {(r["queue"], r["kind"]): (r["seq"], r["paths"]) for r in jobs.pending(spark.createDataFrame(asked, "queue int, seq int, kind string, path string")).collect()}
    assert got == {(1, changed): (1, ["b", "a"]), (1, backfill): (4, []), (1, full): (5, []), (2, full): (1, []), (3, deleted): (1, ["x"])}


def test_throttle(spark):
    events = [("k", s, n) for s, n in [(0, 0), (1, 5), (4, 6), (5, 7), (5, 30), (6, 131), (9, 132), (11, 133)]]
    made = spark.createDataFrame(events, "k string, s int, n int").withColumn("at", F.timestamp_seconds("s"))
    show = lambda df: [r["at"].second for r in df.orderBy("at").collect()]
    assert show(jobs.throttled(made, "k", "at", 5)) == [0, 5, 11]
    assert show(jobs.throttled(made, "k", "at", 5, "n", 100)) == [0, 5, 6, 11]
    assert jobs.throttled(made.limit(0), "k", "at", 5).count() == 0


def test_low_value_chunks_come_last(spark):
    rows = [(k, f"f{k % 2}", 1.0 - k / 100, ["current_file"], "type" if k % 3 else "function", None, None) for k in range(12)]
    found = spark.createDataFrame(rows, "chunk_id int, path string, score double, reasons array<string>, chunk_kind string, symbol_kind string, symbol_name string")
    pick = lambda limit: [r["chunk_id"] for r in retrieval.representative(found, limit, 1).orderBy("place").collect()]
    assert pick(12) == [0, 3, 6, 9, 1, 2] and pick(3) == [0, 3, 6] and pick(5) == [0, 3, 6, 9, 1]
    more = spark.createDataFrame([(100 + k, "g", 0.5 - k / 100, ["fts_match"], "type", None, "MAX") for k in range(4)], found.schema)
    assert len(retrieval.representative(found.unionByName(more), 12, 1).collect()) == 9


def test_lookups(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", 5), (3, "a", 5)], "k int, name string, v int")
    assert [r["k"] for r in lookups.by_key(rows, name="a", v=None).collect()] == [1]
    assert lookups.by_names(rows, []).count() == 0
    assert not lookups.exists(rows.limit(0), k=1).first()["found"]


def letters(df, key, column):
    """An embedder of its own kind: how often each of four letters occurs."""
    count = lambda c: (F.length(column) - F.length(F.replace(F.col(column), F.lit(c), F.lit("")))).cast("double")
    return df.select(key, F.array(*(count(c) for c in "aeiq")).alias("embedding"))


def test_search_of_a_stored_index_with_an_embedder(spark, tmp_path):
    made = files(spark, src__m_dot_tsx=MODULE, src__q_dot_ts="export function qqqq() {\n  return 'qqqqqqqqqq'\n}\n", lib__x_dot_ts="export function other(x) {\n  return helper(x)\n}\n")
    index = engine.build_index(made, embed=letters)
    stored = stored_index.store_index(Store(spark, str(tmp_path)), index, bucket_rows=20)
    assert stored.buckets > 1
    for mode, query in itertools.product(("hybrid", "lexical", "semantic"), ("where is the helper called", "qqqq", "nothing of it")):
        ask = lambda i: [(r["path"], r["start_line"], round(r["score"], 9), r["reasons"]) for r in engine.search(i, engine.Request(query, mode=mode, limit=5)).collect()]  # noqa: E731, B023
        assert ask(index) == ask(stored)
    best = engine.search(stored, engine.Request("qqqqqq qq", mode="semantic", limit=1)).first()
    assert best["path"] == "src/q.ts"
    posted = stored.postings
    assert "bucket" in posted.columns and lexical.bm25_stored(posted, stored.sizes, "chunk_id", []).count() == 0
    plan = lexical.bm25_stored(posted, stored.sizes, "chunk_id", ["helper"], buckets=stored.buckets)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    again = stored_index.load_index(Store(spark, str(tmp_path)), letters)
    assert again.chunks.count() == index.chunks.count()


def test_bm25_of_many_queries_is_that_of_each(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 17}" for j in range(k % 13))) for k in range(60)], "k int, t string")
    asked = {"one": ["w1", "w2"], "two": ["w3"], "none": ["absent"], "twice": ["w5", "w5"]}
    queries = spark.createDataFrame(list(asked.items()), "query string, terms array<string>")
    got = {(r["query"], r["k"]): round(r["rank"], 9) for r in lexical.bm25_each(docs, "k", "t", queries, 4).collect()}
    want = {(q, r["k"]): round(r["rank"], 9) for q, terms in asked.items() for r in lexical.top_k(lexical.bm25(docs, "k", "t", terms), 4, "k").collect()}
    assert got == want


def test_review_finds_code_that_is_there(spark):
    made = files(spark, lib__money_dot_ts="export function parseAmount(value: string) {\n  const normalized = value.replace(/[^0-9.]/g, '')\n  return Number.parseFloat(normalized)\n}\n", lib__x_dot_ts="export const z = 1\n")
    body = ["+function parseAmount(value: string) {", "+  const normalized = value.replace(/[^0-9.]/g, '')", "+  return Number.parseFloat(normalized)", "+}"]
    diff = "diff --git a/PATH b/PATH\n--- a/PATH\n+++ b/PATH\n@@ -1 +1,4 @@\n" + "\n".join(body)
    diffs = spark.createDataFrame([(k + 1, diff.replace("PATH", p)) for k, p in enumerate(("src/new.ts", "lib/money.ts"))], "diff_id long, diff string")
    none = spark.createDataFrame([], "learning_id string, repo_key string, rule_type string, title string, summary string, avoid string, prefer string, path_globs array<string>, confidence double, status string")
    got = engine.review(engine.build_index(made), diffs, none).collect()
    assert [(r["diff_id"], r["path"]) for r in got] == [(1, "src/new.ts")] and got[0]["evidence"].startswith("similar to lib/money.ts:1-4 (")


def test_review_counts_make_warnings_of_like_rules_once(spark):
    lines = ["+import x from 'moment/min'", "+import y from 'other'", "-old"]
    diffs = spark.createDataFrame([(k, "\n".join([f"diff --git a/{p} b/{p}", f"--- a/{p}", f"+++ b/{p}", "@@ -1 +1,2 @@", *lines])) for k, p in enumerate(f"{d}/f{n}.ts" for d in ("src", "gen", "tests/unit") for n in range(10))], "diff_id long, diff string")
    kinds = [("avoid_pattern", "moment", None), ("avoid_pattern", "other", None), ("generated_code", "editing gen/", None), ("testing_convention", None, "add tests under tests/unit")]
    learned = spark.createDataFrame([(f"{k}", "r", *kinds[k % 4][:1], "t", "s", *kinds[k % 4][1:], None, 0.9, "draft" if k % 10 == 9 else "active") for k in range(200)], "learning_id string, repo_key string, rule_type string, title string, summary string, avoid string, prefer string, path_globs array<string>, confidence double, status string")
    index = engine.Index(*[None] * 6)
    want = sorted(map(tuple, rules.warning_counts(engine.review(index, diffs, learned)).collect()))
    made = engine.review_counts(index, diffs, learned)
    assert sorted(map(tuple, made.collect())) == want and want[0] == (0, 90, 40) and want[10] == (10, 140, 40) and want[20] == (20, 90, 0)
    assert joined_rows(spark, made) <= 200  # all warnings are over 3,000
    one = rules.make_rules(learned.filter("learning_id = '0'"))
    twice = engine.review_counts(index, diffs, learned, rules_extra=one)  # an id that stands for two rules
    assert sorted(map(tuple, twice.collect())) == want


def test_review_finds_what_only_terms_find(spark):
    """Vectors that put five other files first."""
    name = lambda n: f"export function load_{n}(x: number) {{\n  return made_{n}(x) + helper_{n}(x)\n}}\n"
    made = files(spark, **{f"lib__f{n}_dot_ts": name(n) for n in range(20)})
    ranked = F.expr("array(1.0D, IF(content LIKE '%load_19(%', 0.5D, 0.0D))")
    blind = lambda df, key, text: df.withColumn("content", F.col(text)).select(key, ranked.alias("embedding") if key == "chunk_id" else F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    body = "function load_19(x: number) {\n  return made_19(x) + helper_19(x)\n  // ------------------------------------\n}"
    diffs = spark.createDataFrame([(1, "diff --git a/n.ts b/n.ts\n--- a/n.ts\n+++ b/n.ts\n@@ -1 +1,4 @@\n" + "\n".join("+" + x for x in body.split("\n")))], "diff_id long, diff string")
    got = engine.dry_warnings(engine.build_index(made, blind), diffs).collect()
    assert len(got) == 1 and got[0]["evidence"] == "similar to lib/f19.ts:1-3 (fts_match)"


def test_review_without_blocks_makes_no_chunks(spark, monkeypatch):
    diffs = spark.createDataFrame([(1, "diff --git a/a.ts b/a.ts\n--- a/a.ts\n+++ b/a.ts\n@@ -1 +1,2 @@\n+const x = 1")], "diff_id long, diff string")
    index = engine.build_index(files(spark, a_dot_ts="export const z = 1\n"))
    monkeypatch.setattr(engine, "similar_code", lambda *_: pytest.fail("searched"))
    assert engine.dry_warnings(index, diffs).count() == 0


def test_extractors_and_rewriters_of_the_caller(spark):
    made = files(spark, a_dot_py="def f(): pass\ndef g(): pass\n", b_dot_ts="export const z = 1\n")

    def python(path, content, language):
        return [{"name": n, "qualified_name": n, "kind": "function", "symbol_kind": "function", "exported": True, "start_line": k + 1, "end_line": k + 1} for k, n in enumerate(re.findall(r"def (\w+)", content))]

    found = {(r["path"], r["name"]) for r in entities.extract_entities(made, {"python": python}).collect()}
    assert {("a.py", "f"), ("a.py", "g"), ("b.ts", "z")} <= found
    said = spark.createDataFrame([("don't use moment, use dayjs",), ("never use lodash",)], "text string")
    rewrite = lambda m: F.when(m.contains("moment"), F.struct(F.lit("Dates by dayjs").alias("title")))
    got = [(r["title"], r["avoid"]) for r in knowledge.capture(said, rewrite=rewrite).orderBy("text").collect()]
    assert got == [("Dates by dayjs", "moment"), ("Avoid lodash", "lodash")]
    assert vectors.hash_embedding(said, "text", "text").count() == 2


def test_end_lines():
    lines = MODULE.split("\n")
    got = {e["name"]: (e["start_line"], e["end_line"]) for e in entities.entities_of("m.tsx", MODULE) if e["kind"] != "module"}
    assert got["useGreeting"] == (8, 11) and got["Card"] == (13, 15) and got["Shape"] == (18, 18) and got["works"] == (20, 20) and got["suite name"] == (19, 21)
    assert entities._end_line(["type A =", "  | 1", "", "x {"], [0, 0, 0, 0, 1], 0) == 2 and entities._end_line(["f() {", "  x"], [0, 1, 1], 0) == 1
    assert len(lines) > 20
