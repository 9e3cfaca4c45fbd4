"""Neighbourhoods, impact and coverage over file and code edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import ordering


def summaries(paths: DataFrame, file_edges: DataFrame, code_edges: DataFrame, entities: DataFrame, most: int = 8) -> DataFrame:
    """For each path: declarations and the neighbours by kind, each list distinct, sorted and capped.

    All edges become tagged rows of (path, section, value), so one aggregation serves every section."""
    out = file_edges.select(F.col("source_path").alias("path"), "kind", F.col("target_path").alias("other"), F.lit("out").alias("way"))
    back = file_edges.select(F.col("target_path").alias("path"), "kind", F.col("source_path").alias("other"), F.lit("in").alias("way"))
    section = F.when((F.col("kind") == "imports") & (F.col("way") == "out"), "imports").when(F.col("kind") == "imports", "imported_by").when(F.col("kind") == "test_counterpart", "tests").when(F.col("kind") == "route_screen", "route_screens").when(F.col("kind") == "same_feature", "same_feature")
    files = out.unionByName(back).select("path", section.alias("section"), F.col("other").alias("value")).filter("value != path")
    calls = F.col("kind").isin("calls", "constructs")
    code_out = code_edges.select(F.col("source_path").alias("path"), F.when(calls, "calls").when(F.col("kind") == "renders", "renders").when(F.col("kind") == "uses_hook", "hooks").alias("section"), text.endpoint(F.col("target_path"), F.col("target_name")).alias("value"))
    code_in = code_edges.filter(calls & F.col("target_path").isNotNull()).select(F.col("target_path").alias("path"), F.lit("called_by").alias("section"), text.endpoint(F.col("source_path"), F.col("source_name")).alias("value"))
    similar = code_edges.filter("kind = 'similar_to' AND target_path IS NOT NULL AND target_path != source_path")
    alike = similar.select(F.col("source_path").alias("path"), F.lit("similar").alias("section"), F.col("target_path").alias("value")).unionByName(similar.select(F.col("target_path").alias("path"), F.lit("similar").alias("section"), F.col("source_path").alias("value")))
    declared = entities.filter("kind != 'module'").select("path", F.lit("declarations").alias("section"), F.concat_ws(" ", "kind", "name").alias("value"))
    rows = files.unionByName(code_out).unionByName(code_in).unionByName(alike).unionByName(declared).filter("section IS NOT NULL AND value IS NOT NULL")
    wanted = paths.select("path").distinct()
    names = ["declarations", "imports", "imported_by", "tests", "route_screens", "same_feature", "calls", "called_by", "renders", "hooks", "similar"]
    place = F.dense_rank().over(Window.partitionBy("path", "section").orderBy("value"))
    # A task keeps the rows of `most` values of a path before any of them are sent: a hub's rows never meet in one task.
    first = rows.withColumn("__place", place).filter(F.col("__place") <= most).select("path", "section", "value").distinct().join(wanted, "path", "left_semi")
    made = first.groupBy("path").agg(*(F.array_sort(F.collect_list(F.when(F.col("section") == n, F.col("value")))).alias(n) for n in names))
    empty = F.array().cast("array<string>")
    return wanted.join(made, "path", "left").select("path", *(F.coalesce(n, empty).alias(n) for n in names), F.coalesce("tests", empty).alias("counterparts"))


def has_graph_data(*lists: str) -> Column:
    total = F.lit(0)
    for name in lists:
        total = total + F.size(name)
    return total > 0


def edge_details(paths: DataFrame, edges: DataFrame, most: int = 40) -> DataFrame:
    """Outgoing, then incoming edges of each path, `most` each path."""
    out = edges.select(F.col("source_path").alias("path"), F.lit("outgoing").alias("direction"), "kind", "source_path", "target_path")
    back = edges.select(F.col("target_path").alias("path"), F.lit("incoming").alias("direction"), "kind", "source_path", "target_path")
    n = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("direction"), "kind", "source_path", "target_path"))
    both = out.unionByName(back).join(paths.select("path").distinct(), "path", "left_semi")
    return both.withColumn("n", n).filter(F.col("n") <= most)


def impact(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """Files within two hops of changed ones (path): hop 1 has every neighbour by any edge; hop 2 files with an edge to
    a changed file or a neighbour. edges: source_path, target_path. Rows: path, hop; changed files are left out."""
    seeds = changed.select("path").distinct()
    s = seeds.withColumnRenamed("path", "s")
    near = edges.join(s, edges["source_path"] == s["s"], "left_semi").select(F.col("target_path").alias("path")).union(edges.join(s, edges["target_path"] == s["s"], "left_semi").select(F.col("source_path").alias("path"))).distinct().join(seeds, "path", "left_anti")
    base = near.union(seeds).select(F.col("path").alias("s")).distinct()
    far = edges.join(base, edges["target_path"] == base["s"], "left_semi").select(F.col("source_path").alias("path")).distinct()
    far = far.join(seeds, "path", "left_anti").join(near, "path", "left_anti")
    return near.withColumn("hop", F.lit(1)).union(far.withColumn("hop", F.lit(2)))


def dependents(changed: DataFrame, deleted: DataFrame, edges: DataFrame, most: int = 50) -> DataFrame:
    """Files with an edge to a changed one, changed and deleted ones left out; the first `most` by path."""
    hit = edges.join(changed.select(F.col("path").alias("target_path")), "target_path", "left_semi").select(F.col("source_path").alias("path")).distinct()
    return hit.join(changed.select("path"), "path", "left_anti").join(deleted.select("path"), "path", "left_anti").orderBy("path").limit(most)


def closure(seeds: DataFrame, edges: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """path and depth of all files that reach a seed along edges (source_path to target_path). Each round joins the
    frontier only, until none is new; reached files are kept in the shared checkpoint folder. More than most_rounds
    rounds, where given, are an error."""
    spark = seeds.sparkSession
    ordering.ensure_checkpoint_dir(spark)
    frontier = seeds.select("path").distinct().withColumn("depth", F.lit(0)).checkpoint()
    reached, depth = frontier, 0
    while True:
        depth += 1
        step = edges.join(frontier.select(F.col("path").alias("target_path")), "target_path", "left_semi").select(F.col("source_path").alias("path")).distinct()
        frontier = step.join(reached.select("path"), "path", "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        if frontier.isEmpty():
            return reached
        if most_rounds is not None and depth > most_rounds:
            raise ValueError(f"files more than {most_rounds} edges away")
        reached = reached.unionByName(frontier)
        if depth % 16 == 0:  # the plan stays small on long chains
            reached = reached.checkpoint()


def coverage(changed: DataFrame, made: DataFrame) -> DataFrame:
    """For each changed file: whether the graph and tests cover it, and the files to look at. made: summaries()."""
    lists = ["imports", "imported_by", "tests", "same_feature", "similar"]
    joined = changed.select("path").distinct().join(made, "path", "left")
    empty = F.array().cast("array<string>")
    related = F.array_distinct(F.concat(*(F.coalesce(c, empty) for c in lists)))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    graph = sum((size(c) for c in ["declarations", "imports", "imported_by", "tests", "route_screens", "same_feature", "calls", "called_by", "renders", "hooks", "similar"]), F.lit(0)) > 0
    return joined.select("path", graph.alias("has_graph_context"), (size("tests") > 0).alias("has_tests"), related.alias("related_files"))


def missing_tests(changed: DataFrame, made: DataFrame) -> DataFrame:
    """path, status (found, missing_candidate for source files without tests, unknown) and five related files."""
    covered = coverage(changed, made)
    status = F.when(F.col("has_tests"), "found").when(F.col("path").rlike(r"\.[jt]sx?$") & ~F.col("path").rlike(r"(^|/)(tests?|__tests__)(/|$)|\.(test|spec)\.[jt]sx?$"), "missing_candidate").otherwise("unknown")
    return covered.select("path", status.alias("status"), F.slice("related_files", 1, 5).alias("related"))


def in_ranges(declarations: DataFrame, ranges: DataFrame) -> DataFrame:
    """Declarations (path, name, start_line) that begin in a changed range (path, start_line, end_line) of their file;
    an equality join on the path, then the range."""
    r = ranges.select("path", F.col("start_line").alias("r_start"), F.col("end_line").alias("r_end"))
    return declarations.join(r, "path").filter("start_line BETWEEN r_start AND r_end").drop("r_start", "r_end").distinct()


def paths_by_query(entities: DataFrame, tokens: list[str], most: int) -> DataFrame:
    """Paths of entities whose name, qualified name or path contains a token (any case); the first by token order and path."""
    hit = F.lit(None).cast("int")
    for k in range(len(tokens) - 1, -1, -1):
        like = f"%{tokens[k]}%"
        hit = F.when(F.col("name").ilike(like) | F.col("qualified_name").ilike(like) | F.col("path").ilike(like), k).otherwise(hit)
    return entities.select("path", hit.alias("k")).filter("k IS NOT NULL").groupBy("path").agg(F.min("k").alias("k")).orderBy("k", "path").limit(most).select("path")


def batches(files: DataFrame, size: int = 20, passes: tuple[str, ...] = ("correctness", "tests", "design")) -> DataFrame:
    """Review units: files in batches of `size` by path, times each pass."""
    placed = ordering.numbered(files.select("path").distinct(), ["path"], "__n").withColumn("batch", F.floor(F.col("__n") / size).cast("int"))
    units = placed.groupBy("batch").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    return units.withColumn("pass", F.explode(F.array(*map(F.lit, passes))))
