"""Predicates and functions on relative file paths."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import globs

# File name extensions with their languages, and extensions of binary files.
LANGUAGES = {
    ".ts": "typescript", ".tsx": "typescriptreact", ".js": "javascript", ".jsx": "javascriptreact", ".mjs": "javascript",
    ".cjs": "javascript", ".json": "json", ".md": "markdown", ".mdx": "mdx", ".yml": "yaml", ".yaml": "yaml", ".toml": "toml",
    ".css": "css", ".scss": "scss", ".html": "html", ".py": "python", ".go": "go", ".rs": "rust", ".java": "java",
    ".sh": "shell", ".bash": "shell", ".zsh": "shell",
}
BINARY_EXTENSIONS = (
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".ico", ".pdf", ".zip", ".gz", ".tgz", ".xz", ".7z", ".tar", ".woff",
    ".woff2", ".ttf", ".otf", ".mp3", ".mp4", ".mov", ".avi", ".wasm", ".dylib", ".so", ".dll", ".exe",
)
# What marks a generated file.
GENERATED_DIRECTORIES = ("generated", "__generated__", "gen", "autogen")
GENERATED_NAMES = ("package-lock.json", "pnpm-lock.yaml", "yarn.lock", "bun.lockb", "composer.lock", "poetry.lock", "cargo.lock")
GENERATED_MARKERS = ("@generated", "this file is generated", "code generated by", "do not edit", "generated by openapi", "generated by prisma")
# Patterns of test paths and of required test locations.
TEST_PATH = r"(^|/)(tests?|__tests__)(/|$)|\.(test|spec)\.[jt]sx?$"
TEST_REQUIREMENT = r"^(test|tests|__tests__)/|/__tests__/|\.(test|spec)\.[jt]sx?(?:$|\*)"


def normalized(path: Column) -> Column:
    """Forward slashes, without a leading ./"""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """All before the last slash; empty without one."""
    return F.regexp_extract(path, r"^(.*)/", 1)


def extension(path: Column) -> Column:
    """With its dot, lower case; empty for a name without one or one that only begins with a dot."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))


def language(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.try_element_at(table, extension(path))


def is_binary_path(path: Column) -> Column:
    return extension(path).isin(*BINARY_EXTENSIONS)


def is_binary_content(content: Column) -> Column:
    """A zero byte among the first 4096."""
    return F.hex(F.substring(content, 1, 4096)).rlike("^(..)*?00")


def generated_reason(path: Column, content: Column, configured: Iterable[str] = ()) -> Column:
    """Why a file counts as generated: configured globs, a directory, a lock file, or a mark in its first 4096
    characters, in this order; null if it does not."""
    rel = normalized(path)
    head = F.lower(F.substring(content, 1, 4096))
    marks = [F.when(F.contains(head, F.lit(m)), F.lit(f"header marker: {m}")) for m in GENERATED_MARKERS]
    return F.coalesce(
        F.when(matches_any(path, list(configured)), "configured generatedPaths match"),
        F.when(F.arrays_overlap(F.split(F.lower(rel), "/"), F.array(*map(F.lit, GENERATED_DIRECTORIES))), "generated directory path"),
        F.when(F.lower(basename(rel)).isin(*GENERATED_NAMES), "lockfile/generated artifact"),
        *marks,
    )


def is_test_path(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def is_test_requirement(pattern: Column) -> Column:
    return pattern.rlike(TEST_REQUIREMENT)


def is_doc_path(path: Column) -> Column:
    return path.endswith(".md") | path.contains("/docs/") | path.contains("/readme")


def is_source_path(path: Column) -> Column:
    return path.rlike("(^|/)src/") & ~is_test_path(path) & ~is_doc_path(path)


def feature_root(path: Column) -> Column:
    """The path through the directory below the first `features`; null without one."""
    return F.nullif(F.regexp_extract(path, r"^((?:(?!features/)[^/]*/)*?features/[^/]+)(?:/|$)", 1), F.lit(""))


def single_slashes(path: Column) -> Column:
    """A normalized path without empty segments, for globs."""
    return F.regexp_replace(normalized(path), "//+", "/")


def regexes(pattern: str) -> tuple[str, str]:
    """What a glob means for a path and for its base name, each one expression; empty for what fits nothing."""
    found, base = globs.of_pattern(pattern)
    return globs.whole(found), globs.whole(base)


def matches_any(path: Column, patterns: list[str]) -> Column:
    """A glob fits the path, its base name, or a directory above it; one without a slash may stand at any depth."""
    both = [globs.of_pattern(p) for p in patterns]
    found, base = (list(dict.fromkeys(r for pair in both for r in pair[k])) for k in (0, 1))
    if not found:
        return F.lit(False)
    rel = single_slashes(path)
    fits = rel.rlike(globs.whole(found))
    return fits | basename(rel).rlike(globs.whole(base)) if base else fits


def longest_prefix(path: Column, packages: dict[str, str]) -> Column:
    """Key of the package with the longest path that is the path or a directory above it; packages: path to key."""
    rel = normalized(path)
    out = F.lit(None).cast("string")
    for prefix, key in sorted(packages.items(), key=lambda x: (len(x[0]), x[0])):
        prefix = re.sub(r"^\./", "", prefix.replace("\\", "/")).rstrip("/")
        out = F.when((rel == prefix) | rel.startswith(prefix + "/"), F.lit(key)).otherwise(out)
    return out


def test_counterparts(path: Column, test_globs: Iterable[str] = ()) -> Column:
    """Where the tests of a source file, or the source of a test file, may be."""
    stem = F.regexp_replace(path, r"\.[^./]+$", "")
    ext = F.coalesce(F.nullif(F.regexp_extract(path, r"(\.[^./]+)$", 1), F.lit("")), F.lit(".ts"))
    name = basename(stem)
    configured = F.lit(False)
    for glob in test_globs:
        configured = configured | path.contains(glob.replace("/**", ""))
    source = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "^test/", "src/"), "^tests/", "src/"), r"\.(test|spec)(\.[^.]+)$", "$2")
    of_test = F.array(F.concat(F.regexp_replace(stem, r"\.(test|spec)$", ""), ext), source)
    of_source = F.array(*(F.concat(*p) for p in ((stem, F.lit(".test"), ext), (stem, F.lit(".spec"), ext), (F.lit("test/"), name, F.lit(".test"), ext), (F.lit("tests/"), name, F.lit(".test"), ext))))
    return F.array_remove(F.array_distinct(F.when(stem.rlike(r"\.(test|spec)$") | configured, of_test).otherwise(of_source)), path)


def import_candidates(base: Column) -> Column:
    """Files that an import of a resolved relative path may mean, in order of preference."""
    # Extensions that imports may leave out.
    extensions = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".json")
    forms = [F.concat(base, F.lit(e)) for e in extensions] + [F.concat(base, F.lit(f"/index{e}")) for e in extensions]
    return F.when(extension(base) != "", F.array(base)).otherwise(F.array(*forms))


def resolve(directory: Column, relative: Column) -> Column:
    """directory joined with a relative specifier, with . and .. taken out; a .. above the top stays."""
    parts = F.split(F.concat_ws("/", F.nullif(directory, F.lit("")), relative), "/")
    kept = F.filter(parts, lambda p: (p != "") & (p != "."))
    up = lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("..")) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(kept, F.array().cast("array<string>"), up), "/")


def is_low_value(path: Column) -> Column:
    """Lock files, built and installed code, images and maps: not worth a review."""
    lower = F.lower(path)
    return lower.rlike(r"(^|/)(package-lock\.json|pnpm-lock\.yaml|yarn\.lock|bun\.lockb)$") | lower.rlike(r"(^|/)(dist|build|coverage|node_modules|\.next|\.turbo)/") | lower.rlike(r"\.(png|jpg|jpeg|gif|webp|svg|ico|lock|map)$")


def review_priority(path: Column, focus: str = "") -> Column:
    """How much a whole-repository review wants a file: sources, telling names, tests, code, and the focus's terms."""
    lower = F.lower(path)
    part = lambda test, value: F.when(test, value).otherwise(0)
    score = part(path.rlike(r"\b(src|app|packages|lib)/"), 5) + part(path.rlike(r"(?i)\b(api|route|server|auth|schema|store|hook|component|screen)\b"), 4)
    score = score + part(lower.rlike(r"\.(test|spec)\.[tj]sx?$"), 2) + part(lower.rlike(r"\.(ts|tsx|js|jsx)$"), 2)
    for term in re.split(r"\W+", focus.lower()):
        if len(term) >= 3:
            score = score + part(lower.contains(term), 3)
    return score


def below(path: Column, root: str) -> Column:
    """The path relative to root, with . and .. taken out; null for what lies outside, and for root itself."""
    top, rel = root.replace("\\", "/").rstrip("/"), F.replace(path, F.lit("\\"), F.lit("/"))
    whole = F.concat(F.lit("/"), resolve(F.lit(""), rel))
    return F.when(whole.startswith(f"{top}/"), F.nullif(F.substr(whole, F.lit(len(top) + 2)), F.lit("")))
