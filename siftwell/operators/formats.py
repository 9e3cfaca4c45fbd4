"""Results as text: what is embedded, and what a reader or a prompt gets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EMBEDDED, GRAPH_LINES, GRAPH_LINE = 6000, 12, 220


def graph_context(chunks: DataFrame, file_edges: DataFrame, code_edges: DataFrame) -> DataFrame:
    """chunk_id and up to twelve distinct lines on the edges of its file, those of other symbols left out. Lines are cut
    to 220 characters; files' edges come first, then by text."""
    files = chunks.select("chunk_id", "path").join(file_edges.select(F.col("source_path").alias("path"), "kind", "target_path"), "path")
    lines = files.select("chunk_id", F.lit(0).alias("part"), F.concat(F.lit("File "), "kind", F.lit(": "), "target_path").alias("line"))
    code = chunks.select("chunk_id", "path", "symbol_name").join(code_edges.select(F.col("source_path").alias("path"), "kind", "source_name", "target_name", F.col("target_path").alias("t")), "path")
    code = code.filter(F.col("symbol_name").isNull() | F.col("source_name").isNull() | (F.col("source_name") == F.col("symbol_name")))
    target = F.coalesce(F.nullif(F.concat_ws(" in ", "target_name", "t"), F.lit("")), F.lit("unknown target"))
    more = code.select("chunk_id", F.lit(1).alias("part"), F.concat(F.lit("Code "), "kind", F.lit(": "), F.coalesce("source_name", "symbol_name", F.lit("chunk")), F.lit(" -> "), target).alias("line"))
    cut = F.when(F.length("line") > GRAPH_LINE, F.concat(F.substring("line", 1, GRAPH_LINE - 1), F.lit("…"))).otherwise(F.col("line"))
    every = lines.unionByName(more).withColumn("line", cut).groupBy("chunk_id", "line").agg(F.min("part").alias("part"))
    n = F.row_number().over(Window.partitionBy("chunk_id").orderBy("part", "line"))
    kept = every.withColumn("n", n).filter(F.col("n") <= GRAPH_LINES)
    return kept.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]).alias("graph_lines"))


def embedding_text(with_context: bool = True) -> Column:
    """A chunk's labelled lines, graph lines (column graph_lines) and content, cut to 6000 characters with a mark."""
    line = lambda label, value: F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{label}: "), value))
    c = F.col
    symbol = F.concat_ws(" ", c("symbol_kind"), c("symbol_name"))
    parts = [F.concat(F.lit("Path: "), c("path")), line("Language", c("language")), line("Symbol", symbol), line("Kind", c("chunk_kind"))]
    if with_context:
        parts.append(F.when(F.size("graph_lines") > 0, F.concat(F.lit("Graph context:\n"), F.array_join("graph_lines", "\n"))))
    whole = F.concat_ws("\n", *parts, F.lit("Code:"), c("content"))
    return F.when(F.length(whole) <= EMBEDDED, whole).otherwise(F.concat(F.substring(whole, 1, EMBEDDED - 96), F.lit(f"\n\n[Embedding input truncated to {EMBEDDED} characters]")))


def ranges_label(ranges: Column, most: int = 5) -> Column:
    """The first ranges (start_line, end_line) as L1-L4, L9."""
    one = lambda r: F.when(r["start_line"] == r["end_line"], F.concat(F.lit("L"), r["start_line"].cast("string"))).otherwise(F.concat(F.lit("L"), r["start_line"].cast("string"), F.lit("-L"), r["end_line"].cast("string")))
    return F.array_join(F.transform(F.slice(ranges, 1, most), one), ", ")


def summary_text(made: DataFrame) -> DataFrame:
    """path and a markdown section of each file with graph data (see graph.summaries)."""
    labels = (("declarations", "Declarations"), ("imports", "Imports"), ("imported_by", "Imported by"), ("tests", "Tests/counterparts"), ("route_screens", "Route/screens"), ("same_feature", "Same feature"), ("calls", "Calls/constructs"), ("called_by", "Called by"), ("renders", "Renders"), ("hooks", "Hooks"), ("similar", "Similar patterns"))
    lines = [F.when(F.size(c) > 0, F.concat(F.lit(f"{label}: "), F.array_join(c, ", "))) for c, label in labels]
    body = F.concat_ws("\n", *lines)
    return made.select("path", F.concat(F.lit("### "), "path", F.lit("\n"), body).alias("section")).filter(body != "")


def chunk_text(most: int = 6000) -> Column:
    """A retrieved chunk for a prompt: place, reasons, symbol and fenced content."""
    body = F.when(F.length("content") <= most, F.col("content")).otherwise(F.concat(F.substring("content", 1, max(0, most - 80)), F.lit(f"\n\n[Chunk truncated to {most} characters]")))
    head = F.concat(F.lit("### "), "path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    return F.concat_ws("\n", head, F.concat(F.lit("Why retrieved: "), F.array_join("reasons", ", ")), F.when(F.col("symbol_name").isNotNull(), F.concat(F.lit("Symbol: "), "symbol_name")), F.lit("```"), body, F.lit("```"))


def rule_line() -> Column:
    return F.concat(F.lit("- ["), "severity", F.lit("] "), "message", F.lit(" ("), "rule_kind", F.lit(": "), "pattern", F.lit(")"))


def warning_line() -> Column:
    place = F.when(F.col("path").isNotNull(), F.concat("path", F.lit(": "))).otherwise("")
    why = F.when(F.col("evidence").isNotNull() & (F.col("evidence") != ""), F.concat(F.lit("; "), "evidence")).otherwise("")
    return F.concat(F.lit("- ["), "severity", F.lit("] "), place, "message", F.lit(" ("), "rule_kind", F.lit(": "), "pattern", why, F.lit(")"))


def prompt_text(chunks: list[str], rules: list[str] = (), learnings: list[str] = (), most: int = 50_000) -> str:
    """The whole context of a request, of its few result rows, cut to `most` characters."""
    parts = ["# Local Codebase Context"]
    for title, rows in (("## Hard Rules", rules), ("## Relevant Codebase Learnings", learnings), ("## Relevant Code", chunks)):
        if rows:
            parts += ["", title, *rows]
    whole = "\n".join(parts)
    return whole if len(whole) <= most else f"{whole[: max(0, most - 80)]}\n\n[Context truncated to {most} characters]"


def review_queries(base: str, focus: str, changed: list[str], categories: list[str]) -> list[str]:
    """The searches of a review: the base, one for each category, one for each of the first eight files; each once."""
    listed = "\n".join(changed)
    each = [f"Context for a review of {path}: declarations, callers, tests and similar code.\n{focus}" for path in changed[:8]]
    return list(dict.fromkeys(q for q in (base, *("\n".join((c, focus, listed)) for c in categories), *each) if q.strip()))
