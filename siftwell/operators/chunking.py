"""Splitting files into chunks. All but code declarations are plain SQL expressions; declarations need a running,
clamped brace depth and go through one Arrow map over whole files."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text

WINDOW_LINES, OVERLAP_LINES = 120, 20
_HEADING = r"^(#{1,6})\s+(.+?)\s*$"
CODE_LANGUAGES = ("typescript", "typescriptreact", "javascript", "javascriptreact")
CODE_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
CONFIG_LANGUAGES = ("json", "yaml", "toml")
CONFIG_EXTENSIONS = (".json", ".yaml", ".yml", ".toml")
_CHUNK = "struct<chunk_kind:string,symbol_name:string,symbol_kind:string,start_line:int,end_line:int,content:string>"


def _piece(kind, name, symbol, start: Column, end: Column, lines: Column) -> Column:
    content = F.array_join(F.slice(lines, start, F.greatest(end - start + 1, F.lit(0))), "\n")
    return F.struct(kind.alias("chunk_kind"), name.alias("symbol_name"), symbol.alias("symbol_kind"), start.cast("int").alias("start_line"), end.cast("int").alias("end_line"), content.alias("content"))


def window_starts(n: Column, window: int, overlap: int) -> Column:
    """First lines (from 0) of windows over n lines: each begins `overlap` lines before the end of the one before,
    and the first that reaches the last line is the last."""
    step = max(1, window - overlap)
    last = F.greatest(F.lit(0), F.ceil((n - window) / step)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda k: k * step)).otherwise(F.array().cast("array<int>"))


def line_windows(lines: Column, kind: Column, window: int = WINDOW_LINES, overlap: int = OVERLAP_LINES) -> Column:
    """Chunks of an array of lines."""
    n = F.size(lines)
    null = F.lit(None).cast("string")
    return F.transform(window_starts(n, window, overlap), lambda s: _piece(kind, null, null, s + 1, F.least(s + window, n), lines))


def markdown_sections(lines: Column, window: int = WINDOW_LINES, overlap: int = OVERLAP_LINES) -> Column:
    """One chunk for each heading, up to the next; what stands before the first is left out. Without headings, windows."""
    marked = F.filter(F.transform(lines, lambda line, i: F.when(line.rlike(_HEADING), i)), lambda i: i.isNotNull())

    def section(at: Column, k: Column) -> Column:
        line = F.element_at(lines, at + 1)
        end = F.coalesce(F.get(marked, k + 1), F.size(lines))
        return _piece(F.lit("markdown_section"), F.regexp_extract(line, _HEADING, 2), F.concat(F.lit("h"), F.length(F.regexp_extract(line, _HEADING, 1)).cast("string")), at + 1, end, lines)

    return F.when(F.size(marked) > 0, F.transform(marked, section)).otherwise(line_windows(lines, F.lit("markdown_section"), window, overlap))


def config_chunks(lines: Column, content: Column, window: int = WINDOW_LINES, overlap: int = OVERLAP_LINES) -> Column:
    """The whole file, if it has few lines; else windows."""
    null = F.lit(None).cast("string")
    whole = F.struct(F.lit("config").alias("chunk_kind"), null.alias("symbol_name"), null.alias("symbol_kind"), F.lit(1).alias("start_line"), F.greatest(F.lit(1), F.size(lines)).alias("end_line"), content.alias("content"))
    return F.when(F.size(lines) <= window, F.array(whole)).otherwise(line_windows(lines, F.lit("config"), window, overlap))


# How declarations begin, in order; which group names them; kind of chunk and of symbol.
_NAME = r"([A-Za-z_$][\w$]*)"
_DECLARATIONS = [
    (re.compile(rf"(?:export\s+)?(?:async\s+)?function\s+{_NAME}", re.A), 1, "function", "function"),
    (re.compile(rf"(?:export\s+)?class\s+{_NAME}", re.A), 1, "class", "class"),
    (re.compile(rf"(?:export\s+)?interface\s+{_NAME}", re.A), 1, "interface", "interface"),
    (re.compile(rf"(?:export\s+)?type\s+{_NAME}", re.A), 1, "type", "type"),
    (re.compile(rf"(?:export\s+)?(?:const|let|var)\s+{_NAME}\s*=\s*(?:async\s*)?\(?[^=]*?\)?\s*=>", re.A), 1, "function", "function"),
    (re.compile(rf"(?:export\s+)?(?:const|let|var)\s+{_NAME}", re.A), 1, "module", "constant"),
    (re.compile(r"(?:export\s+)?describe\s*\(\s*(['\"`])(.+?)\1"), 2, "test", "describe"),
    (re.compile(r"(?:export\s+)?(?:it|test)\s*\(\s*(['\"`])(.+?)\1"), 2, "test", "test"),
]
_DEFAULT = re.compile(r"export\s+default\s+")
_QUOTED = re.compile(r"(['\"`])(?:\\.|(?!\1).)*\1")
_BRACE = re.compile("[{}]")


def brace_depths(lines: list[str]) -> list[int]:
    """Depth of braces before each line, outside quoted text of one line; it never goes below 0."""
    out, depth = [], 0
    for line in lines:
        out.append(depth)
        for c in _BRACE.findall(_QUOTED.sub("", line)) if _BRACE.search(line) else ():
            depth = depth + 1 if c == "{" else max(0, depth - 1)
    return out


def _line_marks(lines: list[str]) -> str:
    """A letter for each line: c for comments, b for blank ones, x for others."""
    return "".join("c" if line.startswith(("//", "*", "/*")) or line.endswith("*/") else "x" if line else "b" for line in map(str.strip, lines))


def _comment_start(marks: str, at: int) -> int:
    """First line (from 0) of the comment above line `at`; blank lines may part them, but not comments."""
    above = re.search("c+b*$", marks[:at])
    return above.start() if above else at


def declaration_chunks(lines: list[str], window: int = WINDOW_LINES, overlap: int = OVERLAP_LINES) -> list[tuple]:
    """(chunk_kind, symbol_name, symbol_kind, start_line, end_line) of the top-level declarations with the comments
    above them; each goes up to the next declaration. Long ones become windows. Empty without a declaration."""
    found = []
    for k, (line, depth) in enumerate(zip(lines, brace_depths(lines), strict=True)):
        line = line.strip()
        default = _DEFAULT.match(line)
        if depth and not default:
            continue
        for pattern, group, kind, symbol in _DECLARATIONS:
            if hit := pattern.match(line):
                found.append((k, kind, hit[group], symbol))
                break
        else:
            if default:
                found.append((k, "module", "default export", "export"))
    out, marks = [], _line_marks(lines)
    ends = [*(f[0] for f in found[1:]), len(lines)][: len(found)]
    for (at, kind, name, symbol), after in zip(found, ends, strict=True):
        start, end = _comment_start(marks, at), max(at + 1, after)
        size, step = end - start, max(1, window - overlap)
        if size <= window * 1.5:
            out.append((kind, name, symbol, start + 1, end))
        else:
            more = -(-(size - window) // step)
            out += [(kind, name, symbol, start + k * step + 1, min(end, start + k * step + window)) for k in range(more + 1)]
    return out


def split(content: str | None) -> list[str]:
    """Lines as text.split_lines gives them."""
    lines = (content or "").replace("\r\n", "\n").split("\n")
    return lines[:-1] if lines[-1] == "" else lines


def _declared(files: DataFrame, code: Column, window: int, overlap: int) -> DataFrame:
    """files with the declarations of those that are code; the lines of others are not gone through."""

    def run(batches):
        kinds = pa.struct([("chunk_kind", pa.string()), ("symbol_name", pa.string()), ("symbol_kind", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("content", pa.string())])
        for batch in batches:
            rows = []
            for content, is_code in zip(batch.column("content"), batch.column("declared").to_pylist(), strict=True):
                lines = split(content.as_py()) if is_code else []
                rows.append([dict(zip(kinds.names, (*c, "\n".join(lines[c[3] - 1 : c[4]])), strict=True)) for c in declaration_chunks(lines, window, overlap)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, pa.list_(kinds))], names=batch.schema.names)

    return files.withColumn("declared", code).mapInArrow(run, f"{files._jdf.schema().toDDL()}, declared array<{_CHUNK}>")


def chunk_files(files: DataFrame, window: int = WINDOW_LINES, overlap: int = OVERLAP_LINES, with_code: bool = True) -> DataFrame:
    """files: path, content and any other columns, language if known. One row for each chunk with chunk_kind,
    symbol_name, symbol_kind, start_line, end_line, content and content_hash in place of content; blank chunks are left
    out. with_code=False keeps to files without declarations, and without Python."""
    lang = F.coalesce(F.col("language"), F.lit("")) if "language" in files.columns else F.lit("")
    ext = paths.extension(F.col("path"))
    lines = F.col("__lines")  # a column of its own: inside a lambda the expression would be evaluated for each chunk
    is_code = lang.isin(*CODE_LANGUAGES) | ext.isin(*CODE_EXTENSIONS)
    is_doc = (lang == "markdown") | ext.isin(".md", ".mdx")
    is_config = lang.isin(*CONFIG_LANGUAGES) | ext.isin(*CONFIG_EXTENSIONS)
    windows = line_windows(lines, F.lit("module"), window, overlap)
    chunks = F.when(is_doc, markdown_sections(lines, window, overlap))
    source = files
    if with_code:
        source = _declared(files, is_code, window, overlap)
        chunks = chunks.when(is_code & (F.size("declared") > 0), F.col("declared"))
    chunks = chunks.when(~is_code & is_config, config_chunks(lines, F.col("content"), window, overlap)).otherwise(windows)
    rest = [c for c in files.columns if c != "content"]
    source = source.withColumn("__lines", text.split_lines(F.col("content")))
    out = source.select(*rest, F.explode(chunks).alias("c")).select(*rest, "c.*")
    return out.filter(F.col("content").rlike(r"\S")).withColumn("content_hash", F.sha2("content", 256))
