"""Unified diffs, rules made of learnings, and their evaluation."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import globs, paths, text
from . import ordering

# Patterns of diffs and manifests.
_FILE = r"^diff --git a/(.+?) b/(.+)$"
_HUNK = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
_SECTION = r"^\s*\"(dependencies|devDependencies|peerDependencies|optionalDependencies)\"\s*:"
_DEPENDENCY = r"^\s*\"([^\"@][^\"]*|@[^\"]+)\"\s*:"
_DRY_WORDS = r"\b(function|const|class|type|interface|schema|validator|parse|format|normalize|build|create|render|test|describe|it)\b"


def diff_lines(diffs: DataFrame) -> DataFrame:
    """diffs: diff_id, diff. One row each line of a file's body: diff_id, path, line_no, kind (added, deleted, context)
    and text."""
    lines = diffs.select("diff_id", F.posexplode(F.split("diff", "\n")).alias("line_no", "line"))
    w = Window.partitionBy("diff_id").orderBy("line_no")
    named = F.when(F.col("line").startswith("+++ b/"), F.substr("line", F.lit(7))).otherwise(F.nullif(F.regexp_extract("line", _FILE, 2), F.lit("")))
    current = F.last(named, ignorenulls=True).over(w)
    begun = F.last(F.when(F.col("line").rlike(_FILE), F.col("line_no")), ignorenulls=True).over(w)
    line = F.col("line")
    header = line.rlike(_FILE) | line.startswith("+++") | line.startswith("---") | line.startswith("@@")
    kind = F.when(line.startswith("+"), "added").when(line.startswith("-"), "deleted").when(line.startswith(" "), "context")
    out = lines.select("diff_id", "line_no", "line", current.alias("path"), begun.alias("file_no"))
    out = out.filter(F.col("file_no").isNotNull() & ~header & kind.isNotNull())
    return out.select("diff_id", "file_no", "path", "line_no", kind.alias("kind"), F.substr("line", F.lit(2)).alias("text"))


def diff_files(diffs: DataFrame) -> DataFrame:
    """diff_id, path, old_path of each file, in its place."""
    lines = diffs.select("diff_id", F.posexplode(F.split("diff", "\n")).alias("line_no", "line"))
    begun = F.last(F.when(F.col("line").rlike(_FILE), F.col("line_no")), ignorenulls=True).over(Window.partitionBy("diff_id").orderBy("line_no"))
    parts = lines.withColumn("file_no", begun).filter("file_no IS NOT NULL")
    new = F.coalesce(F.max_by(F.when(F.col("line").startswith("+++ b/"), F.substr("line", F.lit(7))), F.when(F.col("line").startswith("+++ b/"), F.col("line_no"))), F.max(F.nullif(F.regexp_extract("line", _FILE, 2), F.lit(""))))
    old = F.coalesce(F.max_by(F.when(F.col("line").startswith("--- a/"), F.substr("line", F.lit(7))), F.when(F.col("line").startswith("--- a/"), F.col("line_no"))), F.max(F.nullif(F.regexp_extract("line", _FILE, 1), F.lit(""))))
    return parts.groupBy("diff_id", "file_no").agg(new.alias("path"), old.alias("old_path"))


def changed_files(diffs: DataFrame, untracked: DataFrame) -> DataFrame:
    """diff_id and path of all files that a diff names or that are new beside it (diff_id, path), each once, trimmed."""
    both = diff_files(diffs).select("diff_id", "path").unionByName(untracked.select("diff_id", "path"))
    return both.withColumn("path", text.trim(F.col("path"))).filter("path != ''").distinct()


def changed_ranges(diffs: DataFrame) -> DataFrame:
    """diff_id, path, start_line, end_line, added_lines of each hunk with new lines; deleted files are left out."""
    lines = diffs.select("diff_id", F.posexplode(F.split("diff", "\n")).alias("line_no", "line"))
    w = Window.partitionBy("diff_id").orderBy("line_no")
    current = F.last(F.when(F.col("line").startswith("+++ "), F.substr("line", F.lit(5))), ignorenulls=True).over(w)
    hunk = lines.withColumn("file", current).filter(F.col("line").rlike(_HUNK))
    start = F.regexp_extract("line", _HUNK, 1).cast("int")
    size = F.coalesce(F.nullif(F.regexp_extract("line", _HUNK, 2), F.lit("")).cast("int"), F.lit(1))
    return hunk.filter(F.col("file").isNotNull() & (F.col("file") != "/dev/null") & (size > 0)).select("diff_id", F.regexp_replace("file", "^b/", "").alias("path"), start.alias("start_line"), (start + size - 1).alias("end_line"), size.alias("added_lines"))


def added_imports(lines: DataFrame) -> DataFrame:
    return lines.filter("kind = 'added'").select("diff_id", "path", text.import_source(F.col("text")).alias("source"), F.col("text").alias("line"), "line_no").filter("source IS NOT NULL")


def added_dependencies(lines: DataFrame) -> DataFrame:
    """Added entries of manifests with their section; a closing brace ends a section."""
    own = lines.filter(F.col("path").rlike(r"(^|/)package\.json$"))
    section = F.regexp_extract("text", _SECTION, 1)
    mark = F.when(section != "", section).when(F.col("text").rlike(r"^\s*\}"), "")
    current = F.last(mark, ignorenulls=True).over(Window.partitionBy("diff_id", "file_no").orderBy("line_no"))
    name = F.regexp_extract("text", _DEPENDENCY, 1)
    hit = own.withColumn("section", F.coalesce(F.nullif(current, F.lit("")), F.lit("dependencies"))).filter((F.col("kind") == "added") & mark.isNull() & (name != ""))
    return hit.select("diff_id", "path", name.alias("name"), "section", "line_no")


def _bare(value: Column) -> Column:
    return F.regexp_replace(value, "^['\"`]|['\"`]$", "")


def _path_pattern(value: Column) -> Column:
    clean = text.trim(_bare(value))
    return F.when(clean.contains("*") | ~clean.endswith("/"), clean).otherwise(F.concat(clean, F.lit("**")))


def _test_path(value: Column) -> Column:
    named = value.rlike(r"(?i)\b(add|write|include|create|under|in)\s+(?:\w+\s+){0,4}tests?\b")
    path = F.nullif(F.regexp_extract(value, r"((?:[\w.-]+/)+[\w.@*/-]+|[\w.-]+/\*\*)", 1), F.lit(""))
    return F.when(named, path)


def make_rules(learnings: DataFrame) -> DataFrame:
    """Rules of active learnings with a confidence of at least 0.8: forbidden imports of single-word avoid terms,
    forbidden edits of generated code, required test locations. learnings: learning_id, rule_type, title, summary,
    avoid, prefer, path_globs, confidence, status."""
    usable = learnings.filter("status = 'active' AND confidence >= 0.8")
    avoid = text.trim(F.col("avoid"))
    single = ~avoid.rlike(r"\s") | avoid.rlike(r"^[@\w.-]+/[\w./-]+$")
    package = text.trim(F.regexp_replace(_bare(avoid), r"(?i)\s+package$", ""))
    package = F.when(package.rlike(r"(?i)^[\w-]+\.js$"), F.regexp_replace(package, r"(?i)\.js$", "")).otherwise(package)
    why = F.concat(F.lit("This repo avoids "), "avoid", F.when(F.col("prefer").isNotNull(), F.concat(F.lit("; use "), "prefer", F.lit(" instead."))).otherwise(F.lit(".")))
    rule = lambda kind, pattern, message, globs, severity: F.struct(F.lit(kind).alias("rule_kind"), pattern.alias("pattern"), message.alias("message"), globs.alias("path_globs"), F.lit(severity).alias("severity"))
    imports = F.when((avoid != "") & F.col("rule_type").isin("avoid_pattern", "dependency_policy") & single, F.array(rule("forbidden_import", package, why, F.col("path_globs"), "error")))
    edited = text.trim(F.regexp_replace("avoid", r"(?i)^editing\s+", ""))
    globs = F.when(F.size("path_globs") > 0, F.transform("path_globs", _path_pattern)).when(edited != "", F.array(_path_pattern(edited)))
    edits = F.when(F.col("rule_type") == "generated_code", F.transform(globs, lambda g: rule("forbidden_path_edit", g, F.coalesce(F.nullif(F.col("summary"), F.lit("")), F.concat(F.lit("Do not edit "), g, F.lit("."))), F.array(g), "error")))
    path = F.coalesce(_test_path(F.col("prefer")), _test_path(F.col("summary")))
    place = _path_pattern(path)
    place = F.when(place.contains("*") | place.rlike(r"\.[A-Za-z0-9]+$"), place).otherwise(F.concat(F.regexp_replace(place, "/$", ""), F.lit("/**")))
    tests = F.when((F.col("rule_type") == "testing_convention") & paths.is_test_requirement(path), F.array(rule("required_test_path", place, F.coalesce(F.nullif(F.col("summary"), F.lit("")), F.concat(F.lit("Changes should include tests under "), place, F.lit("."))), F.array(place), "warning")))
    none = F.filter(F.array(rule("", F.lit(""), F.lit(""), F.array(F.lit("")), "")), lambda r: F.lit(False))
    every = F.concat(*(F.coalesce(x, none) for x in (imports, edits, tests)))
    return usable.select("learning_id", F.posexplode(every).alias("n", "r")).select(F.concat_ws(":", "learning_id", "n").alias("rule_id"), "learning_id", "r.*", F.lit("active").alias("status"))


_SALTS = 64


def _dealt(rows: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """Inner join on key, of which very many rows and rules may share a value: rows are dealt over salts, each of which
    has all rules, so that a value is many tasks' work. The rules are many times what the planner sees of them below the
    salts, so they are merged and never sent whole."""
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(_SALTS)).cast("int")
    every = rules.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return rows.withColumn("__salt", salt).join(ordering.merged(every), [key, "__salt"]).drop("__salt")


def forbidden_imports(imports: DataFrame, rules: DataFrame) -> DataFrame:
    """A source can only match the rule of its first path segments or of its name without .js, so the join is on
    those keys. Lines meet distinct patterns, and a pattern's rules come in at the end. Lines and rules are made distinct
    before they meet, and of the two ways to match one counts, so each warning comes out once and none is shuffled."""
    def keys(source: Column) -> Column:
        parts = F.split(source, "/")
        prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat(F.lit("p:"), F.array_join(F.slice(parts, F.lit(1), k), "/")))
        return F.concat(prefixes, F.array(F.concat(F.lit("j:"), F.regexp_replace(source, r"(?i)\.js$", ""))))

    lines = imports.filter("source IS NOT NULL").groupBy("diff_id", "path", "line").agg(F.collect_set("source").alias("sources"))
    rows = lines.withColumn("__key", F.explode(F.array_distinct(F.flatten(F.transform("sources", keys)))))
    some = rules.filter("status = 'active' AND rule_kind = 'forbidden_import'").select("rule_id", "rule_kind", "severity", "message", "pattern").distinct()
    named = some.select("pattern").distinct().withColumn("__key", F.explode(F.array(F.concat(F.lit("p:"), "pattern"), F.concat(F.lit("j:"), F.regexp_replace("pattern", r"(?i)\.js$", "")))))
    begins = F.exists("sources", lambda x: (x == F.col("pattern")) | x.startswith(F.concat("pattern", F.lit("/"))))
    broken = _dealt(rows, named, "__key").filter(F.col("__key").startswith("p:") | ~begins).select("diff_id", "path", "line", "pattern")
    return _dealt(broken, some, "pattern").select("diff_id", "rule_id", "rule_kind", "severity", "message", "path", "pattern", F.col("line").alias("evidence"))


def forbidden_dependencies(found: DataFrame, rules: DataFrame) -> DataFrame:
    as_imports = found.select("diff_id", "path", F.col("name").alias("source"), F.concat_ws(".", "section", "name").alias("line"))
    return forbidden_imports(as_imports, rules.filter("rule_kind = 'forbidden_dependency'").withColumn("rule_kind", F.lit("forbidden_import"))).withColumn("rule_kind", F.lit("forbidden_dependency"))


def _glob_table(patterns: DataFrame) -> DataFrame:
    """pattern with its regular expressions for paths (w) and base names (b) and a row for each of its keys, for each
    distinct pattern; those without a key stand in every salt. Blank globs fit nothing."""

    @F.pandas_udf("w string, b string, keys array<string>")
    def parse(patterns: pd.Series) -> pd.DataFrame:
        made = [(*paths.regexes(g or ""), globs.keys(g or "")) for g in patterns]
        return pd.DataFrame(made, columns=["w", "b", "keys"])

    made = patterns.select("pattern").filter("pattern IS NOT NULL").distinct().withColumn("g", parse("pattern")).select("pattern", "g.*").filter("w != ''")
    salts = F.transform(F.sequence(F.lit(0), F.lit(_SALTS - 1)), lambda k: F.concat(F.lit("any:"), k.cast("string")))
    return made.withColumn("key", F.explode(F.when(F.array_contains("keys", "any"), salts).otherwise(F.col("keys")))).drop("keys")


def _path_keys(rel: Column) -> Column:
    parts = F.split(rel, "/")
    whole = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat(F.lit("d:"), F.array_join(F.slice(parts, F.lit(1), k), "/")))
    names = F.transform(parts, lambda p: F.concat(F.lit("s:"), p))
    endings = F.transform(parts, lambda p: F.concat(F.lit("e:"), F.regexp_extract(p, r"(\.[^.]*)$", 1)))
    return F.array_distinct(F.concat(whole, names, endings, F.array(F.concat(F.lit("any:"), F.pmod(F.xxhash64(rel), F.lit(_SALTS)).cast("string")))))


def pattern_hits(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """files (path and others) with pattern, a row for each distinct glob of patterns that fits the path. Globs and paths
    meet by a literal part of the glob, so that only likely pairs are made, and the expressions decide; globs
    without any literal part are compared with all paths."""
    rel = paths.single_slashes(F.col("path"))
    rows = files.withColumn("__rel", rel).withColumn("key", F.explode(_path_keys(F.col("__rel"))))
    met = rows.join(_glob_table(patterns), "key")
    fits = F.call_function("rlike", F.col("__rel"), F.col("w")) | ((F.col("b") != "") & F.call_function("rlike", paths.basename(F.col("__rel")), F.col("b")))
    return met.filter(fits).select(*files.columns, "pattern").distinct()


def forbidden_edits(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules of any number against edited files, by their globs (path_globs, else the pattern). Only what rules of
    several globs find is made distinct; rules of one find a file once."""
    about = ["rule_id", "rule_kind", "severity", "message", "pattern"]
    own = rules.filter("status = 'active' AND rule_kind = 'forbidden_path_edit'")
    own = own.select(*about, F.when(F.size("path_globs") > 0, F.col("path_globs")).otherwise(F.array("pattern")).alias("globs"))
    own = own.groupBy(*about).agg(F.array_distinct(F.flatten(F.collect_set("globs"))).alias("globs")).withColumnRenamed("pattern", "shown")
    globs = own.select(*(c for c in own.columns if c != "globs"), (F.size("globs") == 1).alias("one"), F.explode("globs").alias("pattern"))
    met = pattern_hits(files.select("diff_id", "path").distinct(), globs)
    hit = lambda some: _dealt(met, globs.filter(some), "pattern").select("diff_id", "rule_id", "rule_kind", "severity", "message", "path", F.col("shown").alias("pattern"), F.lit("file edited").alias("evidence"))
    return hit("one").unionByName(hit("NOT one").distinct())


def missing_tests(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Required-test rules whose place no file of a diff is in, for diffs that change a source file; where a rule has
    globs of sources (those that name no test place), one that they fit. As every such rule wants a warning for every
    other diff, the result, and nothing else, grows with both: diffs are compared with distinct wants (places and
    globs), and a want's rules come in at the end."""
    own = rules.filter((F.col("status") == "active") & (F.col("rule_kind") == "required_test_path") & paths.is_test_requirement(F.col("pattern")))
    own = own.withColumn("sources", F.filter(F.coalesce("path_globs", F.array().cast("array<string>")), lambda g: ~paths.is_test_requirement(g)))
    needs = own.groupBy("rule_id").agg(F.array_sort(F.collect_set("pattern")).alias("places"), F.array_sort(F.collect_set("sources")).alias("sources"))
    needs = needs.withColumn("want", F.to_json(F.struct("places", "sources")))
    wants = needs.select("want", "places", "sources").distinct()
    source_files = files.filter(~paths.is_test_path(F.col("path"))).select("diff_id", "path")
    narrow = wants.select("want", F.explode(F.flatten("sources")).alias("pattern")).distinct()
    named = pattern_hits(source_files, narrow).join(narrow, "pattern").select("diff_id", "want")
    # Every diff meets every wide want, in the want's salt: the pairs are dealt over tasks, and no row holds all wants.
    wide_wants = wants.filter(F.exists("sources", lambda s: F.size(s) == 0)).select("want", F.pmod(F.xxhash64("want"), F.lit(_SALTS)).cast("int").alias("salt"))
    changed = source_files.select("diff_id").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    wide = changed.join(wide_wants, "salt").select("diff_id", "want")
    placed = wants.select("want", F.explode("places").alias("pattern"))
    there = pattern_hits(files.select("diff_id", "path"), placed).join(placed, "pattern").select("diff_id", "want")
    lost = named.unionByName(wide).distinct().join(there, ["diff_id", "want"], "left_anti")
    hit = _dealt(lost, own.join(needs.select("rule_id", "want"), "rule_id").select("want", "rule_id", "rule_kind", "severity", "message", "pattern"), "want")
    return hit.select("diff_id", "rule_id", "rule_kind", "severity", "message", F.lit(None).cast("string").alias("path"), "pattern", F.concat(F.lit("no changed file matched "), "pattern").alias("evidence"))


def scoped_rules(rules: DataFrame, files: DataFrame) -> DataFrame:
    """Rules (rule_id, scope and others) without a scope, and those with a glob in it that fits a file (path)."""
    scoped = rules.filter(F.coalesce(F.size("scope"), F.lit(0)) > 0).select("rule_id", F.explode("scope").alias("pattern"))
    fitting = pattern_hits(files.select("path").distinct(), scoped).select("pattern").distinct()  # files and rules that share a glob are never paired
    hit = scoped.join(fitting, "pattern", "left_semi").select("rule_id").distinct()
    return rules.filter(F.coalesce(F.size("scope"), F.lit(0)) <= 0).unionByName(rules.join(hit, "rule_id", "left_semi").select(*rules.columns))


def review_messages(warnings: DataFrame, shown: DataFrame) -> DataFrame:
    """diff_id, message_key and warnings (their number) of the diffs that a message after an edit is due for: errors and
    warnings only, and none whose key (all rules, paths and evidence, sorted) was shown before. shown: message_key."""
    grave = warnings.filter("severity IN ('error', 'warning')")
    one = F.concat_ws(":", "rule_id", F.coalesce("path", F.lit("")), F.coalesce("evidence", F.lit("")))
    made = grave.groupBy("diff_id").agg(F.array_join(F.array_sort(F.collect_list(one)), "\n").alias("message_key"), F.count("*").alias("warnings"))
    return made.join(shown.select("message_key").distinct(), "message_key", "left_anti").select("diff_id", "message_key", "warnings")


def duplicate_lines(lines: DataFrame, group: str, path: str, line: str, place: str) -> DataFrame:
    """Long lines that a group has more than once: pattern, count, and the first four places as evidence. Only four
    places of a line are ever held."""
    long = lines.filter(F.length(line) >= 80)  # the form is never longer
    form = long.select(group, path, F.col(place).alias("place"), text.trim(F.col(line)).alias("shown"), text.duplicate_form(F.col(line)).alias("pattern")).filter("pattern IS NOT NULL")
    w = Window.partitionBy(group, "pattern")
    counts = form.groupBy(group, "pattern").agg(F.count("*").alias("n")).filter("n > 1")
    first = form.join(counts, [group, "pattern"], "left_semi").withColumn("k", F.row_number().over(w.orderBy(path, "place"))).filter("k <= 4")
    evidence = first.groupBy(group, "pattern").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat_ws(": ", path, "shown").alias("e")))), lambda x: x["e"]), " | ").alias("evidence"))
    return counts.join(evidence, [group, "pattern"])


def added_blocks(lines: DataFrame) -> DataFrame:
    """Runs of added lines of each file, joined: diff_id, path, block, text. Only blocks worth a search are kept."""
    w = Window.partitionBy("diff_id", "file_no").orderBy("line_no")
    run = F.sum(F.when(F.col("kind") != "added", 1).otherwise(0)).over(w)
    blocks = lines.withColumn("block", F.concat_ws(":", F.col("file_no").cast("string"), run.cast("string"))).filter("kind = 'added'").groupBy("diff_id", "file_no", "path", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("text"))
    body = text.trim(F.col("text"))
    worth = (F.length(body) >= 80) & ~body.rlike(r"^import\s|^export\s+\{") & body.rlike(_DRY_WORDS)
    return blocks.withColumn("text", body).filter(worth)


def first_blocks(blocks: DataFrame, most: int) -> DataFrame:
    """The first blocks of each diff, in the order of its files."""
    place = F.transform(F.split("block", ":"), lambda x: x.cast("long"))
    n = F.row_number().over(Window.partitionBy("diff_id").orderBy(place))
    return blocks.withColumn("n", n).filter(F.col("n") <= most).drop("n")


def dry_match(query: Column, content: Column, score: Column, semantic: Column) -> Column:
    """Enough shared terms, or a near vector and some."""
    share = text.overlap(text.code_terms(query), text.code_terms(content))
    return (share >= 0.55) | (semantic & (score >= 0.7) & (share >= 0.25))


def dry_warnings(candidates: DataFrame, matches: DataFrame, files: DataFrame) -> DataFrame:
    """candidates: diff_id, path, block, text; matches: diff_id, block, match_path, start_line, end_line, content, score,
    reasons, place; files: diff_id, path of all changed files. The first match outside them that resembles a candidate."""
    changed = files.select("diff_id", F.col("path").alias("match_path")).distinct()
    both = candidates.join(matches, ["diff_id", "block"]).join(changed, ["diff_id", "match_path"], "left_anti")
    hit = both.filter(dry_match(F.col("text"), F.col("content"), F.col("score"), F.array_contains("reasons", "semantic_match")))
    first = F.row_number().over(Window.partitionBy("diff_id", "block", "path").orderBy("place"))
    evidence = F.concat(F.lit("similar to "), "match_path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit(" ("), F.array_join("reasons", ", "), F.lit(")"))
    return hit.withColumn("n", first).filter("n = 1").select("diff_id", "path", text.shorten(F.col("text"), 160).alias("pattern"), evidence.alias("evidence")).dropDuplicates(["diff_id", "path", "evidence"])


def dedupe_warnings(warnings: DataFrame) -> DataFrame:
    """One row for each rule, path and evidence of a diff."""
    return warnings.groupBy("diff_id", "rule_id", "path", "evidence").agg(*(F.min(c).alias(c) for c in warnings.columns if c not in ("diff_id", "rule_id", "path", "evidence")))


def alike(rules: DataFrame) -> DataFrame:
    """Rules that differ in id, learning and message only as one of them, with their number n."""
    one = ("rule_id", "learning_id", "message")
    return rules.groupBy(*(c for c in rules.columns if c not in one)).agg(F.count("*").alias("n"), *(F.min_by(c, "rule_id").alias(c) for c in one if c in rules.columns))


def warning_counts(warnings: DataFrame, times: Column | int = 1) -> DataFrame:
    """Errors and others of each diff; times: how often a row counts."""
    n = F.lit(times) if isinstance(times, int) else times
    number = lambda test: F.coalesce(F.sum(F.when(test, n)), F.lit(0)).cast("long")
    return warnings.groupBy("diff_id").agg(number(F.col("severity") == "error").alias("errors"), number(F.col("severity") != "error").alias("others"))
