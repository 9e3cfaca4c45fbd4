"""Declarations, imports and references of source files."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from .chunking import _QUOTED, CODE_EXTENSIONS, brace_depths, split
from .ordering import merged

_NAME = r"([A-Za-z_$][\w$]*)"
# Names that are called without being functions of the corpus.
RESERVED = ("if", "for", "while", "switch", "catch", "return", "function", "typeof", "await", "new")
BUILTINS = ("console", "Math", "String", "Number", "Boolean", "Object", "Array", "JSON", "Promise", "Date", "setTimeout", "clearTimeout", "setInterval", "clearInterval")
# Patterns of markup elements, calls and constructions.
ELEMENT = r"<([A-Z][A-Za-z0-9_$]*(?:\.[A-Z][A-Za-z0-9_$]*)?)(?=[\s/>])"
CALL = r"\b([A-Za-z_$][\w$]*)\s*\("
CONSTRUCT = r"\bnew\s+([A-Za-z_$][\w$]*)\s*\("
# Patterns of imports.
_IMPORT = re.compile(r"import\s+(type\s+)?([^'\";]+?)\s+from\s+['\"]([^'\"]+)['\"]", re.A)
_REEXPORT = re.compile(r"export\s+[^'\";]*\s+from\s+['\"]([^'\"]+)['\"]", re.A)
_REQUIRE = re.compile(r"require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", re.A)
# Declarations after export and default were taken off; kind (None: decided by the name), symbol kind.
_FORMS = [
    (re.compile(rf"(?:async\s+)?function\s+{_NAME}", re.A), None, "function"),
    (re.compile(rf"class\s+{_NAME}", re.A), "class", "class"),
    (re.compile(rf"interface\s+{_NAME}", re.A), "interface", "interface"),
    (re.compile(rf"type\s+{_NAME}", re.A), "type", "type"),
    (re.compile(rf"enum\s+{_NAME}", re.A), "type", "enum"),
]
_VARIABLE = re.compile(rf"(?:const|let|var)\s+{_NAME}\s*(?::[^=]+)?=", re.A)
_TEST = re.compile(r"(describe|it|test)\s*\(\s*(['\"`])(.+?)\2")
_MARKUP = re.compile(r"return\s*\(?\s*<|<[A-Z][A-Za-z0-9.]*[\s/>]")
_HEADING = re.compile(r"(#{1,6})\s+(.+?)\s*$")
JAVASCRIPT_EXTENSIONS = (".js", ".jsx", ".mjs", ".cjs")


def imports_of(content: str, with_require: bool = False) -> list[dict]:
    out = []
    for hit in _IMPORT.finditer(content):
        clause = hit[2].strip()
        named = re.search(r"\{([^}]+)\}", clause)
        space = re.search(rf"\*\s+as\s+{_NAME}", clause, re.A)
        first = clause.split(",")[0].strip()
        names = [re.split(r"\s+as\s+", part.strip())[0] for part in named[1].split(",")] if named else []
        out.append({"source": hit[3], "specifiers": [n for n in names if n], "default_import": first if re.fullmatch(_NAME, first, re.A) else None, "namespace_import": space[1] if space else None, "type_only": bool(hit[1])})
    patterns = [_REEXPORT, *[_REQUIRE] * with_require]
    return out + [{"source": hit[1], "specifiers": [], "default_import": None, "namespace_import": None, "type_only": False} for p in patterns for hit in p.finditer(content)]


def _function_kind(name: str, lines: list[str], at: int) -> str:
    if re.match("use[A-Z0-9]", name):
        return "hook"
    if re.match("[A-Z]", name):
        if name.endswith("Screen"):
            return "screen"
        if any(_MARKUP.search(line) for line in lines[at : at + 25]):
            return "component"
    return "function"


def _end_line(lines: list[str], depths: list[int], at: int) -> int:
    """Where the depth is back at that of the declaration, from its first brace on; without one, the line before the
    next blank one. depths: see brace_depths, with one for the end."""
    for k in range(at, len(lines)):
        if "{" in _QUOTED.sub("", lines[k]):
            return next((j + 1 for j in range(k, len(lines)) if depths[j + 1] <= depths[at]), at + 1)
        if k > at and not lines[k].strip():
            return k
    return at + 1


def _declaration(line: str, lines: list[str], at: int) -> tuple[str, str, str] | None:
    """(name, kind, symbol kind) of what a trimmed line declares."""
    bare = re.sub(r"^export\s+", "", re.sub(r"^export\s+default\s+", "", line))
    for pattern, kind, symbol in _FORMS:
        if hit := pattern.match(bare):
            return hit[1], kind or _function_kind(hit[1], lines, at), symbol
    if hit := _VARIABLE.match(bare):
        if "=>" in bare:
            return hit[1], _function_kind(hit[1], lines, at), "function"
        return hit[1], "schema" if hit[1].endswith("Schema") else "constant", "constant"
    if hit := _TEST.match(bare):
        return hit[3], "test_suite" if hit[1] == "describe" else "test_case", hit[1]
    return ("default export", "module", "export") if re.match(r"export\s+default\b", line) else None


def entities_of(path: str, content: str, language: str | None = None) -> list[dict]:
    """The entities of one file: a row for the file itself and for each declaration of code; headings of markdown; the
    file alone of configuration; nothing of others."""
    lines, ext = split(content), (re.search(r"[^/](\.[^./]*)$", path) or ["", ""])[1].lower()
    whole = {"name": path, "qualified_name": path, "kind": "module", "symbol_kind": "module", "exported": False, "default_export": False, "start_line": 1, "end_line": max(1, len(lines)), "signature": None}
    if (language or "").startswith(("typescript", "javascript")) or ext in CODE_EXTENSIONS:
        out, seen, depths = [whole], {(path, "module", 1)}, brace_depths([*lines, ""])
        for k, (line, depth) in enumerate(zip(lines, depths, strict=False)):
            line = line.strip()
            if depth and not re.match(r"export\s+default\s+|(describe|it|test)\s*\(", line):
                continue
            if (made := _declaration(line, lines, k)) is None or (*made[:2], k + 1) in seen:
                continue
            seen.add((*made[:2], k + 1))
            out.append({"name": made[0], "qualified_name": f"{path}#{made[0]}", "kind": made[1], "symbol_kind": made[2], "exported": bool(re.match(r"export\b", line)), "default_export": bool(re.match(r"export\s+default\b", line)), "start_line": k + 1, "end_line": _end_line(lines, depths, k), "signature": line[:500]})
        script = language in ("javascript", "javascriptreact") or (not (language or "").startswith("typescript") and ext in JAVASCRIPT_EXTENSIONS)
        return [e for e in out if not (script and e["symbol_kind"] in ("interface", "type", "enum"))]
    if language == "markdown" or path.endswith((".md", ".mdx")):
        heads = [(k, hit) for k, line in enumerate(lines) if (hit := _HEADING.match(line))]
        return [whole | {"name": hit[2], "qualified_name": f"{path}#{hit[2]}", "symbol_kind": f"h{len(hit[1])}", "start_line": k + 1, "end_line": k + 1} for k, hit in heads] or [whole]
    if language in ("json", "yaml", "toml") or re.search(r"\.(json|ya?ml|toml)$", path):
        return [whole | {"symbol_kind": "config"}]
    return []


_ENTITY = pa.schema([("repo_key", pa.string()), ("path", pa.string()), ("name", pa.string()), ("qualified_name", pa.string()), ("kind", pa.string()), ("symbol_kind", pa.string()), ("exported", pa.bool_()), ("default_export", pa.bool_()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("signature", pa.string())])
_IMPORTED = pa.schema([("repo_key", pa.string()), ("path", pa.string()), ("source", pa.string()), ("specifiers", pa.list_(pa.string())), ("default_import", pa.string()), ("namespace_import", pa.string()), ("type_only", pa.bool_())])


def _by_file(files: DataFrame, schema: pa.Schema, ddl: str, make) -> DataFrame:
    language = "language" if "language" in files.columns else F.lit(None).cast("string").alias("language")

    def run(batches):
        for batch in batches:
            rows = [{"repo_key": r["repo_key"], "path": r["path"]} | e for r in batch.to_pylist() if r["path"] is not None for e in make(r["path"], r["content"] or "", r["language"])]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("repo_key", "path", "content", language).mapInArrow(run, ddl)


def extract_entities(files: DataFrame, extractors: dict[str, Callable[[str, str, str | None], list[dict]]] | None = None) -> DataFrame:
    """files: repo_key, path, content (language). One row an entity, with a stable entity_id. extractors: for languages,
    functions of (path, content, language) that stand in for entities_of."""
    own = dict(extractors or {})

    def make(path, content, language):
        return own.get(language, entities_of)(path, content, language)

    out = _by_file(files, _ENTITY, "repo_key string, path string, name string, qualified_name string, kind string, symbol_kind string, exported boolean, default_export boolean, start_line int, end_line int, signature string", make)
    return out.withColumn("entity_id", F.xxhash64("repo_key", "path", "name", "kind", "start_line"))


def extract_imports(files: DataFrame) -> DataFrame:
    """One row an import of code files; require() counts in JavaScript only."""

    def make(path, content, language):
        ext = (re.search(r"[^/](\.[^./]*)$", path) or ["", ""])[1].lower()
        if (language or "").startswith("typescript") or ext in (".ts", ".tsx"):
            return imports_of(content)
        if (language or "").startswith("javascript") or ext in JAVASCRIPT_EXTENSIONS:
            return imports_of(content, with_require=True)
        return []

    return _by_file(files, _IMPORTED, "repo_key string, path string, source string, specifiers array<string>, default_import string, namespace_import string, type_only boolean", make)


def referenced_names(content: Column, local_names: Column, most: int = 100) -> Column:
    """Elements, called and constructed names of a text, without reserved, built-in and local ones."""
    elements = F.transform(F.regexp_extract_all(content, F.lit(ELEMENT), 1), lambda n: F.substring_index(n, ".", 1))
    calls = F.array_except(F.regexp_extract_all(content, F.lit(CALL), 1), F.array(*map(F.lit, RESERVED + BUILTINS)))
    made = F.regexp_extract_all(content, F.lit(CONSTRUCT), 1)
    return F.slice(F.array_except(F.array_distinct(F.concat(elements, calls, made)), local_names), 1, most)


def import_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports edges between files (confidence 1): each relative import goes to the first of its candidate paths that
    is there. files: repo_key, path of active files."""
    base = paths.resolve(paths.dirname(F.col("path")), F.col("source"))
    wanted = imports.filter(F.col("source").startswith(".")).select("repo_key", F.col("path").alias("source_path"), "source", F.posexplode(paths.import_candidates(base)).alias("choice", "target_path"))
    found = wanted.join(merged(files.select("repo_key", F.col("path").alias("target_path")).distinct()), ["repo_key", "target_path"])
    best = found.groupBy("repo_key", "source_path", "source").agg(F.min_by("target_path", "choice").alias("target_path"))
    return best.select("repo_key", "source_path", "target_path", F.lit("imports").alias("kind"), F.lit(1.0).alias("confidence")).distinct()


def edge_candidates(files: DataFrame, imports: DataFrame, test_globs: tuple[str, ...] = ()) -> DataFrame:
    """Which paths a file's edges look for: repo_key, target_path and source_path (path of the files). Where such a path
    comes or goes, the edges of source_path can change."""
    base = paths.resolve(paths.dirname(F.col("path")), F.col("source"))
    wanted = imports.filter(F.col("source").startswith(".")).select("repo_key", F.explode(paths.import_candidates(base)).alias("target_path"), F.col("path").alias("source_path"))
    tests = files.select("repo_key", F.explode(paths.test_counterparts(F.col("path"), test_globs)).alias("target_path"), F.col("path").alias("source_path"))
    return wanted.unionByName(tests).distinct()


#: Parts that the files of one feature are dealt over.
_SALTS = 64


def file_edges(files: DataFrame, imports: DataFrame, test_globs: tuple[str, ...] = (), same_feature: int = 10, owners: DataFrame | None = None) -> DataFrame:
    """imports, test_counterpart (0.8), route_screen (0.8) and same_feature (0.5) edges between active files. Of a
    feature's files the first `same_feature` by path are linked to each file of it, so pairs grow with the files. owners
    (repo_key, path): edges from these files only; imports then need only be theirs."""
    known = files.select("repo_key", "path").distinct()
    asked = known if owners is None else known.join(owners.select("repo_key", "path"), ["repo_key", "path"], "left_semi")
    edges = import_edges(imports, known)
    edge = lambda df, kind, value: df.select("repo_key", "source_path", "target_path", F.lit(kind).alias("kind"), F.lit(value).alias("confidence"))
    tests = asked.select("repo_key", F.col("path").alias("source_path"), F.explode(paths.test_counterparts(F.col("path"), test_globs)).alias("target_path"))
    tests = tests.join(merged(known.withColumnRenamed("path", "target_path")), ["repo_key", "target_path"], "left_semi").distinct()
    routes = edges.filter(F.col("source_path").rlike(r"(^|/)(app|pages)/") & F.col("target_path").rlike("Screen|screens/|features/"))
    rooted = lambda df: df.withColumn("root", paths.feature_root(F.col("path"))).filter("root IS NOT NULL AND path != root")
    mine, featured = rooted(asked), rooted(known)
    if owners is not None:
        featured = featured.join(mine.select("repo_key", "root").distinct(), ["repo_key", "root"], "left_semi")
    place = F.row_number().over(Window.partitionBy("repo_key", "root").orderBy("path"))  # cut within each task first
    first = featured.withColumn("place", place).filter(F.col("place") <= same_feature + 1).groupBy("repo_key", "root").agg(F.array_sort(F.collect_list("path")).alias("first"))
    # A feature may have most of the files: they are dealt over salts, each of which has every feature's first files.
    salted = mine.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(_SALTS)).cast("int"))
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    mates = salted.join(first, ["repo_key", "root", "salt"]).select("repo_key", F.col("path").alias("source_path"), F.explode(F.slice(F.array_remove("first", F.col("path")), 1, same_feature)).alias("target_path"))
    # Each kind is distinct by itself.
    return edges.unionByName(edge(tests, "test_counterpart", 0.8)).unionByName(edge(routes, "route_screen", 0.8)).unionByName(edge(mates, "same_feature", 0.5))


def exported_names(entities: DataFrame) -> DataFrame:
    """repo_key, wanted (a name) and other (entity_id and path): the exported declaration that the name means elsewhere."""
    out = entities.filter("kind != 'module' AND (exported OR default_export)")
    return out.groupBy("repo_key", F.col("name").alias("wanted")).agg(F.min(F.struct("entity_id", "path")).alias("other"))


def wanted_name(target_name: Column) -> Column:
    """Of a referenced name, the part that is looked up."""
    return F.substring_index(target_name, ".", 1)


def code_edges(files: DataFrame, entities: DataFrame, imports: DataFrame, most: int = 200, exporters: DataFrame | None = None) -> DataFrame:
    """renders, calls, uses_hook and constructs edges of the declarations of each file, `most` a file by line and
    place. A name means the last declaration of it in the file, else the exported one elsewhere with the least id.
    Confidence: 0.8 found, 0.6 imported by name, 0.4 neither. exporters: the entities of all files, where entities and
    imports are those of the given files only."""
    lines = files.select("repo_key", "path", F.split(F.replace("content", F.lit("\r\n"), F.lit("\n")), "\n").alias("lines"))
    local = entities.filter("kind != 'module'").select("repo_key", "path", "entity_id", "name", "start_line", "end_line", "exported", "default_export")
    snippets = local.join(merged(lines), ["repo_key", "path"]).withColumn("snippet", F.array_join(F.slice("lines", F.col("start_line"), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))), "\n"))
    refs = lambda pattern, kind: F.transform(F.regexp_extract_all("snippet", F.lit(pattern), 1), lambda n: F.struct(kind(n).alias("kind"), n.alias("raw")))
    calls = F.filter(refs(CALL, lambda n: F.when(n.rlike("^use[A-Z0-9]"), "uses_hook").otherwise("calls")), lambda r: ~r["raw"].isin(*RESERVED, *BUILTINS) & (r["raw"] != F.col("name")))
    all_refs = F.array_distinct(F.concat(refs(ELEMENT, lambda n: F.lit("renders")), calls, refs(CONSTRUCT, lambda n: F.lit("constructs"))))
    found = snippets.select("repo_key", "path", "entity_id", F.col("name").alias("source_name"), "start_line", F.posexplode(all_refs).alias("place", "r"))
    found = found.select("repo_key", "path", "entity_id", "source_name", "start_line", "place", "r.kind", "r.raw", wanted_name(F.col("r.raw")).alias("wanted"))
    here = local.groupBy("repo_key", "path", F.col("name").alias("wanted")).agg(F.max_by("entity_id", "start_line").alias("local_id"))
    if exporters is None:
        there = exported_names(entities)
    else:
        there = exported_names(exporters.withColumn("wanted", F.col("name")).join(merged(found.select("repo_key", "wanted").distinct()), ["repo_key", "wanted"], "left_semi"))
    named = imports.select("repo_key", "path", F.explode(F.array_compact(F.concat("specifiers", F.array("default_import", "namespace_import")))).alias("wanted")).distinct().withColumn("imported", F.lit(True))
    joined = found.join(merged(here), ["repo_key", "path", "wanted"], "left").join(merged(named), ["repo_key", "path", "wanted"], "left").join(merged(there), ["repo_key", "wanted"], "left")
    target = F.coalesce("local_id", "other.entity_id")
    made = joined.filter(target.isNull() | (target != F.col("entity_id"))).select(
        "repo_key", F.col("entity_id").alias("source_entity_id"), target.alias("target_entity_id"), F.col("path").alias("source_path"),
        F.when(F.col("local_id").isNotNull(), F.col("path")).otherwise(F.col("other.path")).alias("target_path"), "source_name", F.col("raw").alias("target_name"), "kind",
        F.when(target.isNotNull(), 0.8).when(F.col("imported"), 0.6).otherwise(0.4).alias("confidence"), "start_line", "place",
    )
    order = F.row_number().over(Window.partitionBy("repo_key", "source_path").orderBy("start_line", "source_entity_id", "place"))
    return made.withColumn("n", order).filter(F.col("n") <= most).drop("n", "start_line", "place")
