"""Ranking chunks: vectors, the working set, fusion, merging of several queries, and the budgeted context."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, text, vectors
from . import ordering

LEXICAL_SHARE, VECTOR_SHARE = 0.45, 0.55
#: Most distinct vectors of queries, and of rows, that a task of vector_top_k_each compares at once, on average, and the blocks
#: that fewer are dealt over, if each gets LEAST_BLOCK.
QUERY_BLOCK, ROW_BLOCK = 20_000, 20_000
LEAST_BLOCK, LEAST_BLOCKS = 500, 8
#: Queries that a task multiplies with its rows at once.
BATCH = 100
#: Rows of which only the best is looked at for what a query's least place takes.
SHARE = 32
# Words that make a query ask for documentation, or for code.
_DOC_QUERY = r"\b(readme|docs?|documentation|guide|usage|overview)\b"
_CODE_QUERY = r"\b(where|how|built|implemented?|implementation|code|function|class|method|call|calls|prompt|review|graph|context|changed files?|handler|command|tool|worker|index(?:ed|er|ing)?|retriev(?:e|al)|rank(?:ing)?)\b"
#: Working-set source: base score and chunks for each path.
WORKING_SET = {"current_file": (1.2, 4), "visible_file": (0.9, 2), "changed_file": (1.1, 4), "source_test_counterpart": (0.85, 3)}


def is_code_query(query: str) -> bool:
    lower = query.lower()
    return not re.search(_DOC_QUERY, lower) and bool(re.search(_CODE_QUERY, lower))


def ranking_adjustment(query: str | Column, path: Column, chunk_kind: Column, symbol_kind: Column) -> Column:
    """Added to a chunk's score for queries that ask for code: less for documentation and tests, more for sources and
    symbols. query: one text, or a column of them."""
    if isinstance(query, Column):
        asks = ~F.lower(query).rlike(_DOC_QUERY) & F.lower(query).rlike(_CODE_QUERY)
        return F.when(asks, _adjustment(path, chunk_kind, symbol_kind)).otherwise(0.0)
    return _adjustment(path, chunk_kind, symbol_kind) if is_code_query(query) else F.lit(0.0)


def _adjustment(path: Column, chunk_kind: Column, symbol_kind: Column) -> Column:
    lower = F.lower(path)
    part = lambda test, value: F.when(test, value).otherwise(0.0)
    symbol = symbol_kind.isNotNull() & (symbol_kind != "") & (symbol_kind != "heading")
    return part(paths.is_doc_path(lower), -0.22) + part(paths.is_test_path(lower), -0.1) + part(paths.is_source_path(lower), 0.12) + part(F.coalesce(symbol, F.lit(False)), 0.06) + part(chunk_kind == "markdown", -0.08)


def lexical_score(rank: Column) -> Column:
    """1 for every match, as ranks are never above 0: lexical rank decides what is found, not how it is fused."""
    return 1 / (1 + F.greatest(F.lit(0.0), rank))


def vector_top_k(items: DataFrame, query: list[float], k: int, key: str, embedding: str = "embedding") -> DataFrame:
    """key and similarity of the k nearest rows with a positive cosine; ties by key. The plan keeps k rows a task."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return items.select(key, vectors.cosine(F.col(embedding), q).alias("similarity")).filter("similarity > 0").orderBy(F.desc("similarity"), key).limit(k)


def vector_top_k_each(items: DataFrame, queries: DataFrame, k: int, key: str, embedding: str = "embedding") -> DataFrame:
    """query, key and similarity of the k nearest rows of items with a positive cosine, for each row of queries (query,
    and a vector of the same length in `embedding`); similarities are rounded to 12 digits, ties go by key.

    Equal vectors are compared once, under the least key of each side; what comes out is then given to all queries of a
    vector, and a row's vector stands for its k first keys, so nothing of the k best is lost. Distinct vectors are dealt over
    blocks; a task compares one block of each side, so none holds more, and hands on k rows a query. As a vector is
    sent once to each block of the other side, blocks are as large as a task holds well."""
    vector = F.col(embedding).cast("array<double>").alias("v")
    asked = queries.filter(F.col(embedding).isNotNull()).select("query", vector)
    some = ordering.settled(asked.groupBy("v").agg(F.min("query").alias("query")))
    first = Window.partitionBy("v").orderBy("key")
    rows = items.filter(F.col(embedding).isNotNull()).select(F.col(key).alias("key"), vector)
    rows = rows.select("key", "v", F.row_number().over(first).alias("n"), F.first("key").over(first).alias("of")).filter(F.col("n") <= k)
    rows = ordering.settled(rows.select("of", "key", F.when(F.col("n") == 1, F.col("v")).alias("v")))
    rare = rows.filter("v IS NOT NULL").select("key", "v")

    def cut(df: DataFrame, most: int) -> int:
        n = df.count()
        return max(1, -(-n // most), min(LEAST_BLOCKS, -(-n // LEAST_BLOCK)))

    ps, qs = cut(some, QUERY_BLOCK), cut(rare, ROW_BLOCK)
    slot = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = some.select(slot("query", ps).alias("p"), each(qs).alias("q"), "query", "v")
    right = rare.select(each(ps).alias("p"), slot("key", qs).alias("q"), "key", "v")

    def unit(vectors: pd.Series, width: int) -> np.ndarray:
        out = np.zeros((len(vectors), width))
        for row, v in zip(out, vectors, strict=True):
            if v is not None:
                row[: len(v)] = np.nan_to_num(np.asarray(v, float))
        size = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, size, out=np.zeros_like(out), where=size > 0)

    def compare(some: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key", kind="stable")
        width = max((len(v) for s in (some["v"], rows["v"]) for v in s if v is not None), default=0)
        one, two = unit(some["v"], width), unit(rows["v"], width)
        two = np.vstack([two, np.zeros((-len(two) % SHARE, two.shape[1]))])  # cosines of 0 never come out
        keys, found = rows["key"].to_numpy(), []
        for start in range(0, len(some), BATCH):
            names, all_near = some["query"].to_numpy()[start : start + BATCH], one[start : start + BATCH] @ two.T
            # What may be among the k best after rounding: most rows are neither rounded nor sorted. The k-th of the best of
            # each share of the rows is never above the k-th of all.
            tops = all_near.reshape(len(names), SHARE, -1).max(axis=1)
            least = np.partition(tops, -k, axis=1)[:, -k] if k < tops.shape[1] else np.full(len(names), -np.inf)
            for name, near, least_near in zip(names, all_near, least, strict=True):
                some_rows = np.flatnonzero(near >= max(least_near - 1e-11, 0.0))
                rounded = np.round(near[some_rows], 12)
                order = np.argsort(-rounded, kind="stable")[:k]
                order = order[rounded[order] > 0]
                found.append((np.full(len(order), name, some["query"].dtype), keys[some_rows[order]], rounded[order]))
        return pd.DataFrame({c: np.concatenate(v) if found else [] for c, v in zip(("query", "key", "similarity"), zip(*found, strict=True) if found else ([], [], []), strict=True)})

    schema = f"query {queries.schema['query'].dataType.simpleString()}, key {items.schema[key].dataType.simpleString()}, similarity double"
    made = left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInPandas(compare, schema)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "key"))
    best = lambda df: df.withColumn("n", place).filter(F.col("n") <= k).drop("n")
    near = best(made).withColumnRenamed("key", "of").join(ordering.merged(rows.select("of", "key")), "of")
    near = best(near.select("query", "key", "similarity")).join(ordering.merged(some), "query").drop("query")
    return asked.join(ordering.merged(near), "v").select("query", F.col("key").alias(key), "similarity")


def top_per_path(chunks: DataFrame, most: int, path: str = "path", order: tuple[str, ...] = ("start_line", "chunk_id")) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(path).orderBy(*order))
    return chunks.withColumn("__n", n).filter(F.col("__n") <= most).drop("__n")


def working_set(chunks: DataFrame, sources: dict[str, list[str]]) -> DataFrame:
    """chunks (chunk_id, path, start_line, ...) of the request's files: a row for each source that names the file, with
    score, reasons and ordinal (source order, path order, line order). sources: keys of WORKING_SET to paths."""
    rows = [(o, kind, k, p) for o, kind in enumerate(WORKING_SET) for k, p in enumerate(dict.fromkeys(sources.get(kind, [])))]
    named = chunks.sparkSession.createDataFrame(rows, "__o int, kind string, __k int, path string")
    hit = chunks.join(F.broadcast(named), "path")  # the request's paths
    n = F.row_number().over(Window.partitionBy("kind", "path").orderBy("start_line", "chunk_id"))
    limits = F.create_map(*(F.lit(x) for kind, (_, most) in WORKING_SET.items() for x in (kind, most)))
    scores = F.create_map(*(F.lit(x) for kind, (base, _) in WORKING_SET.items() for x in (kind, base)))
    kept = hit.withColumn("__n", n).filter(F.col("__n") <= F.element_at(limits, F.col("kind")))
    ordinal = (F.col("__o") * 1_000_000 + F.col("__k") * 1000 + F.col("__n")).cast("long")
    return kept.withColumn("base", F.element_at(scores, F.col("kind"))).withColumn("reasons", F.array("kind")).withColumn("ordinal", ordinal).drop("__o", "__k", "__n", "kind")


def score_chunks(found: DataFrame, query: str, sources: dict[str, list[str]], package_key: str | None = None) -> DataFrame:
    """found has base and reasons; adds score: base, 0.15 for each further reason that the request gives for the
    chunk, and the ranking adjustment."""
    extra = [F.when(F.col("package_key") == package_key, "same_package")] if package_key and "package_key" in found.columns else []
    extra += [F.when(F.col("path").isin(*sources[kind]), kind) for kind in WORKING_SET if sources.get(kind)]
    every = F.array_distinct(F.concat("reasons", F.array_compact(F.array(*extra)) if extra else F.array().cast("array<string>")))
    more = F.size(every) - F.size(F.array_distinct("reasons"))
    none = F.lit(None).cast("string")
    kind = lambda c: F.col(c) if c in found.columns else none
    score = F.col("base") + 0.15 * more + ranking_adjustment(query, F.col("path"), kind("chunk_kind"), kind("symbol_kind"))
    return found.withColumn("score", score).withColumn("reasons", every)


def fuse(lexical: DataFrame, vector: DataFrame, key: str, limit: int) -> DataFrame:
    """key, score and reasons of the best `limit` rows: 0.45 of the lexical and 0.55 of the vector score.

    Of several lexical rows of one key (working set and matches) the last by ordinal gives score and reasons, the
    first gives the place in ties. Inputs: key, score, reasons, ordinal."""
    lex = lexical.groupBy(key).agg(F.max_by("score", "ordinal").alias("ls"), F.max_by("reasons", "ordinal").alias("lr"), F.min("ordinal").alias("lo"))
    vec = vector.select(key, F.col("score").alias("vs"), F.col("reasons").alias("vr"), F.col("ordinal").alias("vo"))
    both = lex.join(vec, key, "full_outer")
    score = F.coalesce(F.col("ls") * LEXICAL_SHARE, F.lit(0.0)) + F.coalesce(F.col("vs") * VECTOR_SHARE, F.lit(0.0))
    none = F.array().cast("array<string>")
    reasons = F.array_distinct(F.concat(F.coalesce("lr", none), F.coalesce("vr", none)))
    place = F.coalesce("lo", F.col("vo") + F.lit(1 << 40))
    return both.select(key, score.alias("score"), reasons.alias("reasons"), place.alias("__p")).orderBy(F.desc("score"), "__p", key).limit(limit).drop("__p")


def fuse_each(found: DataFrame, queries: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """query, chunk_id, score, reasons and place of the best `limit` rows of each query. found: query, chunk_id, base,
    reason (fts_match or semantic_match) and order (less is nearer); queries: query, text; chunks: chunk_id, path, and
    chunk_kind and symbol_kind where there are any."""
    none = F.lit(None).cast("string")
    kind = lambda c: F.col(c) if c in chunks.columns else none
    about = chunks.select("chunk_id", "path", kind("chunk_kind").alias("chunk_kind"), kind("symbol_kind").alias("symbol_kind"))
    placed = found.join(about, "chunk_id").join(queries.select("query", "text"), "query")
    score = F.col("base") + ranking_adjustment(F.col("text"), F.col("path"), F.col("chunk_kind"), F.col("symbol_kind"))
    is_lex = F.col("reason") == "fts_match"
    pick = lambda test, value: F.max(F.when(test, value))
    both = placed.groupBy("query", "chunk_id").agg(pick(is_lex, score).alias("ls"), pick(~is_lex, score).alias("vs"), pick(is_lex, F.col("order")).alias("lo"), pick(~is_lex, F.col("order")).alias("vo"))
    whole = F.coalesce(F.col("ls") * LEXICAL_SHARE, F.lit(0.0)) + F.coalesce(F.col("vs") * VECTOR_SHARE, F.lit(0.0))
    reasons = F.array_compact(F.array(F.when(F.col("ls").isNotNull(), "fts_match"), F.when(F.col("vs").isNotNull(), "semantic_match")))
    n = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("lo").asc_nulls_last(), F.col("vo").asc_nulls_last(), "chunk_id"))
    return both.select("query", "chunk_id", whole.alias("score"), reasons.alias("reasons"), "lo", "vo").withColumn("place", n).filter(F.col("place") <= limit).drop("lo", "vo")


def merge_queries(found: DataFrame, key: str) -> DataFrame:
    """Rows of several queries by key: the best score, and all reasons in order of their names."""
    return found.groupBy(key).agg(F.max("score").alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("reasons")))).alias("reasons"))


# Terms that a search proposes to look up literally.
EXACT_TERMS = ("refetchInterval", "staleTime", "invalidateQueries", "queryKey", "queryKeys", "useQuery", "AppState", "setInterval", "poll", "refresh")


def exact_terms(found_text: Column, candidates: tuple[str, ...] = EXACT_TERMS, most: int = 6) -> Column:
    """The first candidates that a text holds."""
    return F.slice(F.filter(F.array(*map(F.lit, candidates)), lambda c: F.contains(found_text, c)), 1, most)


def is_useful_symbol(symbol: Column) -> Column:
    """Names worth proposing: of three characters at least, no test blocks, no constants in capitals."""
    good = ~symbol.isin("default export", "describe", "test") & ~symbol.rlike("^[A-Z0-9_]+$") & (F.length(symbol) > 2)
    return F.coalesce(good, F.lit(False))


def seed_paths(found: DataFrame, sources: dict[str, list[str]], most: int = 8) -> DataFrame:
    """path and place of the files that a graph summary starts from: the request's current, changed and visible ones,
    then those of the best `most` chunks; each once, trimmed. found: path, score, chunk_id."""
    spark = found.sparkSession
    named = [p for kind in ("current_file", "changed_file", "visible_file") for p in sources.get(kind, [])]
    given = spark.createDataFrame(list(enumerate(named)), "place long, path string")
    top = found.orderBy(F.desc("score"), "chunk_id").limit(most)
    order = F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")) + len(named)  # over `most` rows
    both = given.unionByName(top.select(order.cast("long").alias("place"), "path")).withColumn("path", text.trim(F.col("path"))).filter("path != ''")
    first = both.groupBy("path").agg(F.min("place").alias("place"))
    return first.withColumn("place", F.row_number().over(Window.orderBy("place")))  # the request's few paths


def is_low_value_chunk(reasons: Column, chunk_kind: Column, symbol_kind: Column, symbol_name: Column) -> Column:
    """Types, constants and names in capitals that only the working set brought in."""
    brought = F.forall(reasons, lambda r: r.isin("current_file", "visible_file", "changed_file"))
    some = lambda test: F.coalesce(test, F.lit(False))
    return some(brought) & (some(chunk_kind.isin("type", "interface")) | some(symbol_kind.isin("type", "interface", "constant")) | some(symbol_name.rlike("^[A-Z0-9_]+$")))


def representative(found: DataFrame, limit: int, per_file: int) -> DataFrame:
    """Of a result list (chunk_id, path, score, reasons, chunk_kind, symbol_kind, symbol_name), in its order, `limit`
    chunks: per_file of each file, then more of these files; chunks of low value only where fewer than six others are
    there (one at least, if there is room)."""
    low = is_low_value_chunk(F.col("reasons"), F.col("chunk_kind"), F.col("symbol_kind"), F.col("symbol_name"))
    order = (F.desc("score"), "chunk_id")
    n = F.row_number().over(Window.partitionBy("path", "__low").orderBy(*order))
    ranked = found.withColumn("__low", low).withColumn("__n", n).filter(F.col("__n") <= limit)  # a file has no more places
    marked = ranked.withColumn("__tier", F.when(F.col("__low"), 2).when(F.col("__n") <= per_file, 0).otherwise(1))
    first = marked.orderBy("__tier", *order).limit(limit)  # all good ones, if they are fewer
    place = F.row_number().over(Window.orderBy("__tier", *order))  # at most `limit` rows
    good = F.count_if(F.col("__tier") < 2).over(Window.partitionBy())
    room = F.least(F.lit(limit), F.greatest(good + F.when(good < limit, 1).otherwise(0), F.least(F.lit(min(limit, 6)), F.lit(limit))))
    return first.withColumn("__place", place).withColumn("__room", room).filter("__place <= __room").withColumn("place", F.col("__place")).drop("__low", "__n", "__tier", "__place", "__room")


def balanced(found: DataFrame, limit: int, per_file: int = 2, low_share: int = 6) -> DataFrame:
    """A choice that spreads over files: up to two chunks of each file that is worth it, then the rest of those, then
    up to six of low-value files, within the limit. found: chunk_id, path, score."""
    low = paths.is_low_value(F.col("path"))
    n = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("score"), "chunk_id"))
    tier = F.when(low, 2).when(F.col("__n") <= per_file, 0).otherwise(1)
    tiered = found.withColumn("__n", n).withColumn("__tier", tier)
    place = F.row_number().over(Window.partitionBy("__tier").orderBy(F.desc("score"), "chunk_id"))
    first = tiered.orderBy("__tier", F.desc("score"), "chunk_id").limit(limit * 2)  # bounded before the window over a tier
    return first.withColumn("__place", place).filter((F.col("__tier") < 2) | (F.col("__place") <= min(limit, low_share))).orderBy("__tier", F.desc("score"), "chunk_id").limit(limit).drop("__n", "__tier", "__place")


def file_rollup(found: DataFrame) -> DataFrame:
    """For each file: chunks, line ranges, reasons and best score; best first."""
    ranges = F.transform(F.array_sort(F.collect_list(F.struct("start_line", "end_line"))), lambda r: F.concat(F.lit("L"), r["start_line"].cast("string"), F.lit("-L"), r["end_line"].cast("string")))
    rolled = found.groupBy("path").agg(F.count("*").alias("chunks"), ranges.alias("ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("reasons")))).alias("reasons"), F.max("score").alias("score"))
    return rolled.orderBy(F.desc("score"), F.desc("chunks"), "path")


def reason_histogram(found: DataFrame) -> DataFrame:
    return found.select("path", F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("chunks"), F.countDistinct("path").alias("files")).orderBy(F.desc("chunks"), "reason")


def assemble(found: DataFrame, per_chunk: int = 6000, total: int = 50_000) -> DataFrame:
    """The chunks (chunk_id, score, content) with body: content cut to per_chunk characters while the running total, used,
    fits. The total runs over ids and sizes in parts of the ordered list, so the list may be of any length."""
    sized = found.withColumn("body", text.cut_with_mark(F.col("content"), per_chunk))
    order = {"__none": F.col("score").isNull(), "__down": -F.col("score"), "__size": F.coalesce(F.length("body"), F.lit(0))}
    ran = ordering.running_sum(sized.withColumns(order).select("chunk_id", *order), ["__none", "__down", "chunk_id"], "__size", "used")
    return sized.join(ran.filter(F.col("used") <= total).select("chunk_id", "used"), "chunk_id")


def freshness(state: DataFrame) -> DataFrame:
    """state: running, phase, pending_files, last_indexed_at. Adds index_state: indexing, partial, stale or fresh."""
    kind = F.when(F.col("running"), "indexing").when(F.col("last_indexed_at").isNull(), "partial").when(F.col("pending_files") > 0, "stale").otherwise("fresh")
    return state.withColumn("index_state", kind)
