"""Queries on code structure, edges, impact, diffs and rules. The code files and diffs are made of the documents' ids,
so that plain SQL knows what must be found."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entities, graph, rules
from ..sources import web
from .q_text import MADE_PATH
from .registry import query, table

_PATH = "'src/features/d' || {n} % 20 || '/f' || {n} || '.ts'"
_P = _PATH.format(n="doc_id")
_PREV = _PATH.format(n="(doc_id - 1)")


def _code_files(spark, sf):
    """A module for each document: a function and a class, which use those of the document before."""
    n, p = F.col("doc_id"), F.col("doc_id") - 1
    path = F.concat(F.lit("src/features/d"), n % 20, F.lit("/f"), n, F.lit(".ts"))
    lines = [
        F.concat(F.lit("import { fn_"), p, F.lit(", C_"), p, F.lit(" } from '../d"), p % 20, F.lit("/f"), p, F.lit("'")),
        F.lit(""),
        F.concat(F.lit("// adds one"), F.lit("")),
        F.concat(F.lit("export function fn_"), n, F.lit("(x: number) {")),
        F.concat(F.lit("  return fn_"), p, F.lit("(x) + helper_"), n, F.lit("(x)")),
        F.lit("}"),
        F.lit(""),
        F.concat(F.lit("export class C_"), n, F.lit(" {")),
        F.concat(F.lit("  make() { return new C_"), p, F.lit("() }")),
        F.lit("}"),
        F.lit(""),
    ]
    return table(spark, sf, "documents").select("doc_id", F.lit("r").alias("repo_key"), path.alias("path"), F.concat_ws("\n", *lines).alias("content"), F.lit("typescript").alias("language"))


def _index(spark, sf):
    files = _code_files(spark, sf)
    found, imports = entities.extract_entities(files), entities.extract_imports(files)
    return files, found, imports


@query(f"""SELECT path, name, kind, symbol_kind, exported, CAST(a AS INTEGER) AS start_line, CAST(b AS INTEGER) AS end_line FROM (SELECT doc_id, {_P} AS path FROM documents),
 LATERAL (VALUES (path, 'module', 'module', false, 1, 10), ('fn_' || doc_id, 'function', 'function', true, 4, 6), ('C_' || doc_id, 'class', 'class', true, 8, 10)) AS v(name, kind, symbol_kind, exported, a, b)""")
def code_entities(spark, sf):
    return _index(spark, sf)[1].select("path", "name", "kind", "symbol_kind", "exported", "start_line", "end_line")


@query(f"SELECT {_P} AS path, '../d' || (doc_id - 1) % 20 || '/f' || (doc_id - 1) AS source, 'fn_' || (doc_id - 1) || ',C_' || (doc_id - 1) AS names FROM documents")
def code_imports(spark, sf):
    return _index(spark, sf)[2].select("path", "source", F.array_join("specifiers", ",").alias("names"))


_EDGES = f"""WITH f AS (SELECT doc_id, {_P} AS path, doc_id % 20 AS d FROM documents),
m AS (SELECT a.path AS source_path, b.path AS target_path, row_number() OVER (PARTITION BY a.path ORDER BY b.path) AS n FROM f a JOIN f b ON a.d = b.d AND a.path <> b.path
  AND b.path IN (SELECT path FROM (SELECT path, row_number() OVER (PARTITION BY d ORDER BY path) AS k FROM f) WHERE k <= 11)),
e AS (SELECT {_P} AS source_path, {_PREV} AS target_path, 'imports' AS kind, 1.0 AS confidence FROM documents WHERE doc_id - 1 IN (SELECT doc_id FROM documents)
  UNION ALL SELECT source_path, target_path, 'same_feature', 0.5 FROM m WHERE n <= 10)"""


@query(_EDGES + " SELECT source_path, target_path, kind, CAST(confidence AS DOUBLE) AS confidence FROM e")
def file_edges(spark, sf):
    files, _, imports = _index(spark, sf)
    return entities.file_edges(files, imports).drop("repo_key")


_CODE = f"""WITH f AS (SELECT doc_id AS n, doc_id - 1 AS p, {_P} AS path, {_PREV} AS prev, doc_id - 1 IN (SELECT doc_id FROM documents) AS there FROM documents),
c AS (SELECT path AS source_path, CASE WHEN there THEN prev END AS target_path, 'fn_' || n AS source_name, 'fn_' || p AS target_name, 'calls' AS kind, CASE WHEN there THEN 0.8 ELSE 0.6 END AS confidence FROM f WHERE p >= 0
 UNION ALL SELECT path, NULL, 'fn_' || n, 'helper_' || n, 'calls', 0.4 FROM f
 UNION ALL SELECT path, NULL, 'C_' || n, 'make', 'calls', 0.4 FROM f
 UNION ALL SELECT path, CASE WHEN there THEN prev END, 'C_' || n, 'C_' || p, unnest(['calls', 'constructs']), CASE WHEN there THEN 0.8 ELSE 0.6 END FROM f WHERE p >= 0)"""


@query(_CODE + " SELECT source_path, target_path, source_name, target_name, kind, CAST(confidence AS DOUBLE) AS confidence FROM c")
def code_edges(spark, sf):
    return entities.code_edges(*_index(spark, sf)).drop("repo_key", "source_entity_id", "target_entity_id")


@query(_CODE + " SELECT coalesce(kind, 'total') AS kind, count(*) AS n FROM c GROUP BY ROLLUP (kind)")
def edge_kind_stats(spark, sf):
    from ..operators import stats

    return stats.by_kind(entities.code_edges(*_index(spark, sf)))


_FORMS = """import React from "react"
import { z } from 'zod'

export function useThing_N(x) {
  return useOther_N(x)
}

export function Home_NScreen() {
  return <Panel title="x" />
}

export const Card_N = () => <Panel.Box />
const LIMIT_N = 5
export const user_NSchema = z.object({})
export interface Shape_N {
  a: number
}
type Kind_N = 'a' | 'b'
enum Color_N { Red }

export default class Main_N extends Base {
  go() { return 1 }
}

describe('suite_N', () => {
  it("works_N", () => { useThing_N(1) })
})"""


def _form_files(spark, sf):
    """A module with a declaration of each form for each document."""
    n = F.col("doc_id").cast("string")
    return table(spark, sf, "documents").select("doc_id", F.lit("r").alias("repo_key"), F.concat(F.lit("ui/m"), n, F.lit(".tsx")).alias("path"), F.replace(F.lit(_FORMS), F.lit("_N"), F.concat(F.lit("_"), n)).alias("content"), F.lit("typescriptreact").alias("language"))


@query("""SELECT 'ui/m' || doc_id || '.tsx' AS path, CASE WHEN kind = 'module' THEN 'ui/m' || doc_id || '.tsx' ELSE replace(name, '_N', '_' || doc_id) END AS name, kind, symbol_kind, exported, default_export, CAST(a AS INTEGER) AS start_line, CAST(b AS INTEGER) AS end_line
FROM documents, (VALUES ('', 'module', 'module', false, false, 1, 27), ('useThing_N', 'hook', 'function', true, false, 4, 6), ('Home_NScreen', 'screen', 'function', true, false, 8, 10), ('Card_N', 'component', 'function', true, false, 12, 14), ('LIMIT_N', 'constant', 'constant', false, false, 13, 14), ('user_NSchema', 'schema', 'constant', true, false, 14, 14),
 ('Shape_N', 'interface', 'interface', true, false, 15, 17), ('Kind_N', 'type', 'type', false, false, 18, 19), ('Color_N', 'type', 'enum', false, false, 19, 19), ('Main_N', 'class', 'class', true, true, 21, 23), ('suite_N', 'test_suite', 'describe', false, false, 25, 27), ('works_N', 'test_case', 'it', false, false, 26, 26)) AS v(name, kind, symbol_kind, exported, default_export, a, b)""")
def code_entity_forms(spark, sf):
    return entities.extract_entities(_form_files(spark, sf)).select("path", "name", "kind", "symbol_kind", "exported", "default_export", "start_line", "end_line")


@query("SELECT 'ui/m' || doc_id || '.tsx' AS path, kind, CAST(n AS BIGINT) AS n, CAST(found AS BIGINT) AS found FROM documents, (VALUES ('uses_hook', 3, 2), ('renders', 2, 0), ('calls', 7, 0)) AS v(kind, n, found)")
def code_edge_forms(spark, sf):
    """Hooks, elements and calls of each form; found: those whose target is a declaration."""
    files = _form_files(spark, sf)
    edges = entities.code_edges(files, entities.extract_entities(files), entities.extract_imports(files))
    return edges.groupBy(F.col("source_path").alias("path"), "kind").agg(F.count("*").alias("n"), F.count("target_path").alias("found"))


def _edges(spark, sf):
    files, found, imports = _index(spark, sf)
    return entities.file_edges(files, imports), entities.code_edges(files, found, imports), found


@query(f"""SELECT {_P} AS path, 'class C_' || doc_id || ',function fn_' || doc_id AS declarations, CASE WHEN doc_id - 1 IN (SELECT doc_id FROM documents) THEN {_PREV} ELSE '' END AS imports,
 CASE WHEN doc_id + 1 IN (SELECT doc_id FROM documents) THEN {_PATH.format(n='(doc_id + 1)')} ELSE '' END AS imported_by, CAST(0 AS BIGINT) AS tests FROM documents""")
def graph_summaries(spark, sf):
    file, code, found = _edges(spark, sf)
    made = graph.summaries(found, file, code, found)
    join = lambda c: F.array_join(c, ",").alias(c)
    return made.select("path", join("declarations"), join("imports"), join("imported_by"), F.size("tests").cast("long").alias("tests"))


@query(f"SELECT {_P} AS path, 'missing_candidate' AS status, true AS has_graph_context FROM documents")
def coverage_report(spark, sf):
    file, code, found = _edges(spark, sf)
    changed = _code_files(spark, sf).select("path")
    made = graph.summaries(changed, file, code, found)
    return graph.missing_tests(changed, made).drop("related").join(graph.coverage(changed, made).select("path", "has_graph_context"), "path")


@query(_EDGES + """, b AS (SELECT source_path AS path, 'outgoing' AS direction, kind, source_path, target_path FROM e UNION ALL SELECT target_path, 'incoming', kind, source_path, target_path FROM e)
SELECT path, direction, kind, source_path, target_path FROM b QUALIFY row_number() OVER (PARTITION BY path ORDER BY direction DESC, kind, source_path, target_path) <= 6""")
def edge_details(spark, sf):
    file, _, found = _edges(spark, sf)
    return graph.edge_details(found, file, 6).drop("n")


_LINKS = r"SELECT DISTINCT 'p' || page_id AS source_path, href AS target_path FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a\b[^>]*?\bhref=\"([^\"]*)\"', 1)) AS href FROM pages)"


def _links(spark, sf):
    return table(spark, sf, "pages").select(F.concat(F.lit("p"), "page_id").alias("source_path"), F.explode(web.links(F.col("html"))).alias("target_path"))


@query(f"SELECT target_path AS href, count(*) AS pages FROM ({_LINKS}) GROUP BY target_path")
def link_fan_in(spark, sf):
    return _links(spark, sf).groupBy(F.col("target_path").alias("href")).agg(F.count("*").alias("pages"))


@query(f"""WITH e AS ({_LINKS}), s AS (SELECT DISTINCT 'p' || page_id AS path FROM pages WHERE contains(url, '.example.org/fr/')),
n AS (SELECT target_path AS path FROM e WHERE source_path IN (FROM s) UNION SELECT source_path FROM e WHERE target_path IN (FROM s)),
h AS (SELECT path FROM n WHERE path NOT IN (FROM s)), b AS (FROM h UNION FROM s), f AS (SELECT DISTINCT source_path AS path FROM e WHERE target_path IN (FROM b))
SELECT path, CAST(1 AS INTEGER) AS hop FROM h UNION ALL SELECT path, 2 FROM f WHERE path NOT IN (FROM s) AND path NOT IN (FROM h)""")
def impact_two_hop(spark, sf):
    seeds = table(spark, sf, "pages").filter(F.col("url").contains(".example.org/fr/")).select(F.concat(F.lit("p"), "page_id").alias("path"))
    return graph.impact(seeds, _links(spark, sf))


@query(f"""WITH e AS ({_LINKS}), c AS (SELECT DISTINCT target_path AS path FROM e WHERE target_path LIKE '/a%') SELECT DISTINCT source_path AS path FROM e WHERE target_path IN (FROM c) AND source_path NOT IN (FROM c) AND source_path NOT IN ('p1', 'p2') ORDER BY path LIMIT 50""")
def dependents(spark, sf):
    links = _links(spark, sf)
    gone = spark.createDataFrame([("p1",), ("p2",)], "path string")
    return graph.dependents(links.filter("target_path LIKE '/a%'").select(F.col("target_path").alias("path")), gone, links)


@query("""WITH RECURSIVE t AS (SELECT c_custkey AS k, 0 AS depth FROM customer WHERE c_custkey IN (2, 5) UNION ALL SELECT c_custkey, depth + 1 FROM t JOIN customer ON c_custkey // 2 = k WHERE c_custkey > 1)
SELECT CAST(k AS VARCHAR) AS path, min(depth) AS depth FROM t GROUP BY k""")
def reverse_closure(spark, sf):
    """Customers as a tree: each leads to the one of half its number."""
    c = table(spark, sf, "customer").filter("c_custkey > 1")
    edges = c.select(F.col("c_custkey").cast("string").alias("source_path"), F.floor(F.col("c_custkey") / 2).cast("string").alias("target_path"))
    return graph.closure(spark.createDataFrame([("2",), ("5",)], "path string"), edges)


@query(f"""WITH p AS (SELECT {_P} AS path, doc_id FROM documents) SELECT path FROM p ORDER BY CASE WHEN contains(lower('fn_' || doc_id || ' C_' || doc_id || ' ' || path), '77') THEN 0 ELSE 1 END, path LIMIT 25""")
def paths_by_query(spark, sf):
    return graph.paths_by_query(_index(spark, sf)[1], ["77", "features"], 25)


@query(f"""WITH f AS (SELECT DISTINCT {_P} AS path FROM documents), n AS (SELECT path, CAST((row_number() OVER (ORDER BY path) - 1) // 20 AS INTEGER) AS batch FROM f)
SELECT batch, pass, count(*) AS files, min(path) AS first_path FROM n, (VALUES ('correctness'), ('tests'), ('design')) AS v(pass) GROUP BY batch, pass""")
def review_batches(spark, sf):
    return graph.batches(_code_files(spark, sf).select("path")).select("batch", "pass", F.size("paths").cast("long").alias("files"), F.col("paths")[0].alias("first_path"))


def _diffs(spark, sf):
    """A diff for each document: two added imports, a removed line, and a manifest with a new dependency."""
    n = F.col("doc_id")
    path = F.col("path")
    body = [
        F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path),
        F.concat(F.lit("--- a/"), path),
        F.concat(F.lit("+++ b/"), path),
        F.concat(F.lit("@@ -"), n + 1, F.lit(",2 +"), n + 1, F.lit(",3 @@")),
        F.concat(F.lit("+import x from 'pkg"), n % 7, F.lit("/sub'")),
        F.concat(F.lit("+const y = require('tool"), n % 5, F.lit(".js')")),
        F.lit("-old line"),
        F.lit(" kept line"),
        F.lit("diff --git a/package.json b/package.json"),
        F.lit("--- a/package.json"),
        F.lit("+++ b/package.json"),
        F.lit("@@ -10,3 +10,4 @@"),
        F.lit("   \"devDependencies\": {"),
        F.concat(F.lit("+    \"dep"), n % 3, F.lit("\": \"1.0.0\",")),
        F.lit("   }"),
    ]
    made = table(spark, sf, "documents").select("doc_id", F.expr(MADE_PATH).alias("path"))
    return made.select(F.col("doc_id").alias("diff_id"), F.concat_ws("\n", *body).alias("diff"))


_MADE = f"(SELECT doc_id, {MADE_PATH} AS path FROM documents)"


@query(f"SELECT doc_id AS diff_id, path, count(*) AS lines, count(*) FILTER (WHERE k = 'added') AS added FROM (SELECT doc_id, path, unnest(['added', 'added', 'deleted', 'context']) AS k FROM {_MADE} UNION ALL SELECT doc_id, 'package.json', unnest(['context', 'added', 'context']) FROM documents) GROUP BY ALL")
def diff_parse(spark, sf):
    return rules.diff_lines(_diffs(spark, sf)).groupBy("diff_id", "path").agg(F.count("*").alias("lines"), F.count_if(F.col("kind") == "added").alias("added"))


@query(f"SELECT doc_id AS diff_id, path, CAST(doc_id + 1 AS INTEGER) AS start_line, CAST(doc_id + 3 AS INTEGER) AS end_line, CAST(3 AS INTEGER) AS added_lines FROM {_MADE} UNION ALL SELECT doc_id, 'package.json', 10, 13, 4 FROM documents")
def changed_ranges(spark, sf):
    return rules.changed_ranges(_diffs(spark, sf))


@query(f"SELECT doc_id AS diff_id, path, unnest(['pkg' || doc_id % 7 || '/sub', 'tool' || doc_id % 5 || '.js']) AS source FROM {_MADE}")
def added_imports(spark, sf):
    return rules.added_imports(rules.diff_lines(_diffs(spark, sf))).select("diff_id", "path", "source")


@query("SELECT doc_id AS diff_id, 'package.json' AS path, 'dep' || doc_id % 3 AS name, 'devDependencies' AS section FROM documents")
def added_dependencies(spark, sf):
    return rules.added_dependencies(rules.diff_lines(_diffs(spark, sf))).drop("line_no")


def _learnings(spark, sf):
    """Learnings made of parts: five kinds by size."""
    k = F.col("p_partkey")
    kind = F.col("p_size") % 5
    pick = lambda *values: F.when(kind == 0, values[0]).when(kind == 1, values[1]).when(kind == 2, values[2]).when(kind == 3, values[3]).otherwise(values[4])
    null = F.lit(None).cast("string")
    return table(spark, sf, "part").select(
        k.alias("learning_id"), F.lit("r").alias("repo_key"), F.col("p_name").alias("title"), F.concat(F.lit("Note "), k).alias("summary"),
        pick(F.lit("avoid_pattern"), F.lit("dependency_policy"), F.lit("generated_code"), F.lit("testing_convention"), F.lit("style")).alias("rule_type"),
        pick(F.concat(F.lit("'pkg"), k % 7, F.lit("'")), F.concat(F.lit("tool"), k % 5, F.lit(".js")), F.concat(F.lit("editing gen"), k % 9, F.lit("/")), null, F.lit("two words")).alias("avoid"),
        pick(F.lit("fetch"), null, null, F.concat(F.lit("add tests under tests/unit"), k % 4), F.lit("one")).alias("prefer"),
        F.lit(None).cast("array<string>").alias("path_globs"), (k % 100 / 100).alias("confidence"), F.col("p_size").cast("long").alias("priority"),
        F.when(F.col("p_brand").endswith("5"), "draft").otherwise("active").alias("status"),
    )


_LEARN = "SELECT p_partkey AS id, p_size % 5 AS k, p_partkey % 100 / 100 AS confidence, CASE WHEN ends_with(p_brand, '5') THEN 'draft' ELSE 'active' END AS status FROM part"
_RULES = f"""SELECT CAST(id AS VARCHAR) AS learning_id, CASE k WHEN 0 THEN 'forbidden_import' WHEN 1 THEN 'forbidden_import' WHEN 2 THEN 'forbidden_path_edit' ELSE 'required_test_path' END AS rule_kind,
 CASE k WHEN 0 THEN 'pkg' || id % 7 WHEN 1 THEN 'tool' || id % 5 WHEN 2 THEN 'gen' || id % 9 || '/**' ELSE 'tests/unit' || id % 4 || '/**' END AS pattern, CASE WHEN k = 3 THEN 'warning' ELSE 'error' END AS severity,
 CASE k WHEN 0 THEN 'This repo avoids ''pkg' || id % 7 || '''; use fetch instead.' WHEN 1 THEN 'This repo avoids tool' || id % 5 || '.js.' ELSE 'Note ' || id END AS message
FROM ({_LEARN}) WHERE status = 'active' AND confidence >= 0.8 AND k < 4"""


@query(_RULES)
def rule_generation(spark, sf):
    return rules.make_rules(_learnings(spark, sf)).select(F.col("learning_id").cast("string"), "rule_kind", "pattern", "severity", "message")


@query(f"SELECT count(*) AS total, count(*) AS active, CAST(0 AS BIGINT) AS disabled FROM ({_RULES})")
def rule_stats(spark, sf):
    from ..operators import stats

    return stats.rule_stats(rules.make_rules(_learnings(spark, sf)))


@query(f"""WITH r AS ({_RULES}), i AS (SELECT doc_id AS diff_id, path, 'pkg' || doc_id % 7 AS p, 'tool' || doc_id % 5 AS t FROM {_MADE})
SELECT diff_id, learning_id, path, pattern FROM i JOIN r ON rule_kind = 'forbidden_import' AND (pattern = p OR pattern = t)""")
def rule_eval_forbidden(spark, sf):
    imports = rules.added_imports(rules.diff_lines(_diffs(spark, sf)))
    hit = rules.forbidden_imports(imports, rules.make_rules(_learnings(spark, sf)))
    return hit.select("diff_id", F.substring_index("rule_id", ":", 1).alias("learning_id"), "path", "pattern")


def _rule_rows(spark, kind, rows):
    return spark.createDataFrame([(i, kind, pattern, "m", globs, "error", "active") for i, pattern, globs in rows], "rule_id string, rule_kind string, pattern string, message string, path_globs array<string>, severity string, status string")


@query(f"SELECT doc_id AS diff_id, path, 'r1' AS rule_id FROM {_MADE} WHERE contains(path, '/gen/') UNION ALL SELECT doc_id, path, 'r2' FROM {_MADE} WHERE ends_with(path, '.PNG')")
def rule_eval_paths(spark, sf):
    found = _rule_rows(spark, "forbidden_path_edit", [("r1", "gen", None), ("r2", "x", ["*.PNG"])])
    return rules.forbidden_edits(rules.diff_files(_diffs(spark, sf)), found).select("diff_id", "path", "rule_id")


@query(f"SELECT doc_id AS diff_id, 'r1' AS rule_id FROM documents WHERE doc_id % 6 <> 1 UNION ALL SELECT doc_id, 'r2' FROM documents WHERE doc_id % 6 = 0")
def rule_eval_required(spark, sf):
    found = _rule_rows(spark, "required_test_path", [("r1", "test/**", ["test/**"]), ("r2", "tests/**", ["src/**", "tests/**"])])
    return rules.missing_tests(rules.diff_files(_diffs(spark, sf)), found).select("diff_id", "rule_id")


@query(f"""WITH d AS (SELECT doc_id, {_P} AS path FROM documents), r AS (SELECT path, 1 + doc_id % 9 AS a, 4 + doc_id % 9 AS b FROM d), e AS (SELECT doc_id, path, unnest(['fn_' || doc_id, 'C_' || doc_id]) AS name, unnest([4, 8]) AS line FROM d)
SELECT path, name, CAST(line AS INTEGER) AS start_line FROM e JOIN r USING (path) WHERE line BETWEEN a AND b""")
def declared_range_join(spark, sf):
    files, found, _ = _index(spark, sf)
    ranges = files.select("path", (1 + F.col("doc_id") % 9).alias("start_line"), (4 + F.col("doc_id") % 9).alias("end_line"))
    return graph.in_ranges(found.filter("kind != 'module'").select("path", "name", "start_line"), ranges)


@query(f"""WITH r AS ({_RULES}), m AS {_MADE}, i AS (SELECT doc_id AS diff_id, count(*) AS n FROM m JOIN r ON rule_kind = 'forbidden_import' AND pattern IN ('pkg' || doc_id % 7, 'tool' || doc_id % 5) GROUP BY doc_id),
e AS (SELECT doc_id AS diff_id, count(*) AS n FROM m JOIN r ON rule_kind = 'forbidden_path_edit' AND starts_with(path, replace(pattern, '**', '')) GROUP BY doc_id),
t AS (SELECT doc_id AS diff_id, count(*) AS n FROM m JOIN r ON rule_kind = 'required_test_path' AND NOT starts_with(path, replace(pattern, '**', '')) GROUP BY doc_id)
SELECT diff_id, coalesce(i.n, 0) + coalesce(e.n, 0) AS errors, coalesce(t.n, 0) AS others FROM t FULL JOIN i USING (diff_id) FULL JOIN e USING (diff_id)""")
def change_review(spark, sf):
    """The number of all warnings of all diffs against all learnings."""
    from . import engine

    return engine.review_counts(engine.build_index(_code_files(spark, sf)), _diffs(spark, sf), _learnings(spark, sf))


@query(f"""SELECT path, CAST(CASE WHEN regexp_matches(path, '\\b(src|app|packages|lib)/') THEN 5 ELSE 0 END + CASE WHEN regexp_matches(path, '\\.test\\.ts$') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(path, '\\.(ts|tsx|js)$') THEN 2 ELSE 0 END + CASE WHEN contains(path, 'view') OR contains(path, 'View') THEN 3 ELSE 0 END AS INTEGER) AS priority
FROM {_MADE} WHERE NOT ends_with(path, '.PNG')""")
def review_priority(spark, sf):
    from ..functions import paths

    made = table(spark, sf, "documents").select(F.expr(MADE_PATH).alias("path")).filter(~paths.is_low_value(F.col("path")))
    return made.select("path", paths.review_priority(F.col("path"), "the VIEW of a").alias("priority"))


@query(_CODE + f""", e AS (SELECT DISTINCT source_path, 'Code ' || kind || ': ' || source_name || ' -> ' || target_name || coalesce(' in ' || target_path, '') AS line FROM c WHERE starts_with(source_name, 'fn_')),
i AS (SELECT {_P} AS source_path, 'File imports: ' || {_PREV} AS line FROM documents WHERE doc_id - 1 IN (SELECT doc_id FROM documents))
SELECT source_path AS path, count(*) AS n, min(line) AS first_line FROM (FROM e UNION ALL FROM i) GROUP BY source_path""")
def graph_context_lines(spark, sf):
    from ..operators import formats

    file, code, found = _edges(spark, sf)
    chunks = found.filter("kind = 'function'").select(F.col("entity_id").alias("chunk_id"), "path", F.col("name").alias("symbol_name"))
    made = formats.graph_context(chunks, file.filter("kind = 'imports'"), code)
    return made.join(chunks, "chunk_id").select("path", F.size("graph_lines").cast("long").alias("n"), F.array_min("graph_lines").alias("first_line"))


@query(f"""SELECT {_P} AS path, CASE WHEN doc_id - 1 IN (SELECT doc_id FROM documents) THEN 1 ELSE 0 END + CASE WHEN doc_id + 1 IN (SELECT doc_id FROM documents) THEN 1 ELSE 0 END AS n FROM documents""".replace("AS n FROM", "AS n FROM"))
def summary_sections(spark, sf):
    """Files' summaries as text: how many of the two import lines each has."""
    from ..operators import formats

    file, code, found = _edges(spark, sf)
    made = formats.summary_text(graph.summaries(found, file, code, found))
    has = lambda label: F.col("section").contains(f"\n{label}: ").cast("int")
    return made.select("path", (has("Imports") + has("Imported by")).alias("n"))
