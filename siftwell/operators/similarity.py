"""Similar pairs of chunks by their vectors, compared only where they could be related."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, text
from . import ordering, vector_index

LEAST, PER_SOURCE, PER_PAIR, MOST = 0.72, 5, 3, 2000
#: Rows of a block that a task compares with as many others, on average: where the best of each are kept, and where all are.
CELL, CELL_ALL = 8000, 2000
#: Pairs that a task holds the cosines of at once.
_PAIRS = 4_000_000


# What each shared property adds to a similarity.
_BOOSTS = {"same_symbol_kind": 0.08, "same_chunk_kind": 0.05, "same_package": 0.04, "same_feature_directory": 0.03, "same_normalized_symbol": 0.02}
_BLOCKS = ["chunk_kind", "symbol_kind", "package_key", "directory"]


def _filled(c: Column) -> Column:
    return F.nullif(c.cast("string"), F.lit(""))


def _keyed(chunks: DataFrame) -> DataFrame:
    """Chunks as _linked takes them: blocks, what is compared for each boost, and what a pair tells of both sides."""
    path = F.col("path")
    directory = paths.dirname(path)
    marks = [_filled(F.col("symbol_kind")), _filled(F.col("chunk_kind")), _filled(F.col("package_key")), F.when(path.contains("/"), directory), text.symbol_form(F.col("symbol_name"))]
    return chunks.select(F.col("chunk_id").alias("id"), "embedding", *_BLOCKS[:3], directory.alias("directory"), *(m.alias(f"m{k}") for k, m in enumerate(marks)), "path", F.coalesce("symbol_name", "chunk_kind").alias("name"))


def _linked(sources: DataFrame, targets: DataFrame | None, blocks: list[str], least: float, per_source: int | None, scored: bool) -> DataFrame:
    """source, target, similarity (rounded to 12 digits) of a row of sources and one of targets (None: sources again) that
    share the value of a block column (id, embedding, blocks) and have a cosine of at least `least`; each ordered pair once.
    scored: rows as of _keyed, pairs of different paths only, with paths, names, score and boosts of both.

    A block value's rows are dealt over cells of bounded size, with all that a pair needs, so no pair is shuffled: a task
    multiplies two matrices, and keeps a row's best per_source of its cell, or all. Of several shared blocks a pair
    belongs to the first."""
    cell = CELL_ALL if per_source is None else CELL
    keys, marks = [f"b{k}" for k in range(len(blocks))], [f"m{k}" for k in range(len(_BOOSTS))] if scored else []
    told = [*marks, "path", "name"] if scored else []

    def spread(items: DataFrame) -> DataFrame:
        held = items.filter("id IS NOT NULL").select("id", F.col("embedding").alias("v"), *(_filled(F.col(b)).alias(k) for b, k in zip(blocks, keys, strict=True)), *told)
        return held.select("*", F.posexplode(F.array(*keys)).alias("block", "value")).filter("value IS NOT NULL")

    some = spread(sources)
    others = some if targets is None else spread(targets)
    count = lambda rows, name: rows.groupBy("block", "value").agg(F.count("*").alias(name))
    sizes = count(some, "p").filter("p > 1").withColumn("q", F.col("p")) if targets is None else count(some, "p").join(count(others, "q"), ["block", "value"])
    cells = ordering.met(sizes.select("block", "value", *(F.ceil(F.col(c) / cell).cast("int").alias(f"{c}s") for c in "pq")))
    slot = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    side = lambda rows, p, q: rows.join(cells, ["block", "value"]).select("block", "value", p.alias("p"), q.alias("q"), "id", "v", *keys, *told).toDF("block", "value", "p", "q", "id", "v", *keys, *told)
    left, right = side(some, slot("ps"), every("qs")), side(others, every("ps"), slot("qs"))
    values = list(_BOOSTS.values())

    def unit(column: pa.ChunkedArray, width: int) -> np.ndarray:
        out = np.zeros((len(column), width))
        held = column.combine_chunks()
        sizes = pc.fill_null(pc.list_value_length(held), 0).to_numpy(zero_copy_only=False).astype(int)
        flat = np.nan_to_num(held.flatten().to_numpy(zero_copy_only=False).astype(float))
        at = np.repeat(np.arange(len(sizes)), sizes)
        out[at, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        size = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, size, out=np.zeros_like(out), where=size > 0)

    def codes(one: pa.Table, two: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of equal values on both sides; nulls equal nothing."""
        both = pa.chunked_array([*one[name].chunks, *two[name].chunks], one.schema.field(name).type).combine_chunks().dictionary_encode()
        number = pc.fill_null(both.indices, -1).to_numpy(zero_copy_only=False)
        a, b = number[: one.num_rows], number[one.num_rows :].copy()
        b[b < 0] = -2
        return a, b

    def compare(key: tuple, one: pa.Table, two: pa.Table) -> pa.Table:
        block = key[0].as_py()
        found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0))]
        same = {}
        if one.num_rows and two.num_rows:
            width = max((pc.max(pc.list_value_length(t["v"])).as_py() or 0) for t in (one, two))
            rows, columns = unit(one["v"], width), unit(two["v"], width)
            same = {c: codes(one, two, c) for c in ["id", *keys[:block], *marks, *(["path"] if scored else [])]}
            rank = np.empty(two.num_rows, int)
            rank[pc.sort_indices(two["id"]).to_numpy()] = np.arange(two.num_rows)
            step = max(1, _PAIRS // two.num_rows)
            for start in range(0, one.num_rows, step):
                near = rows[start : start + step] @ columns.T
                i, j = np.nonzero(near >= least - 1e-9)
                similarity, i = np.round(near[i, j], 12), i + start
                ok = similarity >= least
                for c in ["id", *(["path"] if scored else []), *keys[:block]]:  # pairs that share an earlier block are that one's
                    a, b = same[c]
                    ok &= a[i] != b[j]
                i, j, similarity = i[ok], j[ok], similarity[ok]
                boost = np.zeros(len(i))
                for m, value in zip(marks, values, strict=False):
                    a, b = same[m]
                    boost[a[i] == b[j]] += value
                score = similarity + boost
                if per_source is not None:
                    order = np.lexsort((rank[j], -similarity, -score, i))
                    first = np.searchsorted(i[order], i[order])  # where a source's pairs begin
                    order = order[np.arange(len(order)) - first < per_source]
                    i, j, similarity, score = i[order], j[order], similarity[order], score[order]
                found.append((i, j, similarity, score))
        i, j, similarity, score = (np.concatenate(c) for c in zip(*found, strict=True))
        out = {"source": one["id"].take(pa.array(i)), "target": two["id"].take(pa.array(j)), "similarity": pa.array(similarity)}
        if scored:
            shared = np.zeros(len(i), np.int32)
            for k, m in enumerate(marks):
                if same:
                    a, b = same[m]
                    shared |= (a[i] == b[j]).astype(np.int32) << k
            out |= {"source_path": one["path"].take(pa.array(i)), "target_path": two["path"].take(pa.array(j)), "source_name": one["name"].take(pa.array(i)), "target_name": two["name"].take(pa.array(j)), "score": pa.array(score), "shared": pa.array(shared)}
        return pa.table(out)

    kind = sources.schema["id"].dataType.simpleString()
    schema = f"source {kind}, target {kind}, similarity double" + ", source_path string, target_path string, source_name string, target_name string, score double, shared int" * scored
    grouped = lambda df: df.groupBy("block", "value", "p", "q")
    pairs = grouped(left).cogroup(grouped(right)).applyInArrow(compare, schema)
    if not scored:
        return pairs
    names = F.array_compact(F.array(*(F.when(F.col("shared").bitwiseAND(1 << k) != 0, name) for k, name in enumerate(_BOOSTS))))
    return pairs.select("source", "target", "source_path", "target_path", "source_name", "target_name", "similarity", "score", names.alias("boosts"))


def similar_pairs(items: DataFrame, block: str, least: float = LEAST, per_source: int | None = PER_SOURCE) -> DataFrame:
    """source, target, similarity of rows (id, block, embedding) with one block value and a cosine of at least
    `least`; the best per_source of each (None: all), ties by target. Every pair of a block is compared, in cells, so
    the work is the square of a block's rows, and what comes out is the links only."""
    scored = _linked(items, None, [block], least, per_source, False)
    if per_source is None:
        return scored
    best = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("similarity"), "target"))
    return scored.withColumn("n", best).filter(F.col("n") <= per_source).drop("n")


def _best_of_source(scored: DataFrame, per_source: int | None) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), F.desc("similarity"), "target"))
    ranked = scored.withColumn("n", first)
    return ranked if per_source is None else ranked.filter(F.col("n") <= per_source)


def similar_pool(chunks: DataFrame, least: float = LEAST, per_source: int | None = PER_SOURCE) -> DataFrame:
    """The best per_source scored pairs of each source, with their rank n: what similar_edges are taken from, and what
    update_pool keeps up. Only rows that share a chunk kind, symbol kind, package or directory are compared, in cells."""
    scored = _linked(_keyed(chunks), None, _BLOCKS, least, per_source, True)
    return scored if per_source is None else _best_of_source(scored, per_source)


def update_pool(pool: DataFrame, chunks: DataFrame, index: vector_index.VectorIndex | None, changed: DataFrame, deleted: DataFrame, least: float = LEAST, per_source: int = PER_SOURCE) -> DataFrame:
    """The pool of `chunks`, made of the pool before a change. changed and deleted: chunk_id; chunks: as they are after it,
    and `least` and `per_source` as the pool was made with. index is not read any more: pairs share a block, and an index
    of all vectors finds many that share none.

    Changed rows are compared with all of their blocks. So are sources that lost a partner of their best, as the one that
    follows it was not kept. The best of any other source are the best of those it had and of its pairs with changed rows."""
    touched = ordering.settled(changed.select("chunk_id").unionByName(deleted.select("chunk_id")).distinct())
    lost = pool.join(touched.select(F.col("chunk_id").alias("target")), "target", "left_semi").select(F.col("source").alias("chunk_id"))
    again = ordering.settled(changed.select("chunk_id").unionByName(lost).distinct())  # a source that is gone is not in chunks
    of = lambda how, ids: _keyed(chunks.join(ids, "chunk_id", how))
    anew = _linked(of("left_semi", again), _keyed(chunks), _BLOCKS, least, per_source, True)
    back = _linked(of("left_anti", again), of("left_semi", changed.select("chunk_id").distinct()), _BLOCKS, least, per_source, True)
    stays = pool.join(again.unionByName(touched).distinct().select(F.col("chunk_id").alias("source")), "source", "left_anti").drop("n")
    return _best_of_source(stays.unionByName(anew).unionByName(back), per_source)


def pool_edges(pool: DataFrame, per_pair: int | None = PER_PAIR, most: int | None = MOST) -> DataFrame:
    """similar_to edges of a pool: at most per_pair of a source for a pair of names, and `most` in all."""
    kept = pool
    if per_pair is not None:
        pair = F.row_number().over(Window.partitionBy("source", "source_name", "target_name").orderBy("n"))
        kept = kept.withColumn("m", pair).filter(F.col("m") <= per_pair)
    if most is not None:
        kept = kept.orderBy("source", "n").limit(most)
    return kept.select("source", "target", "source_path", "target_path", "source_name", "target_name", F.lit("similar_to").alias("kind"), F.round(F.least(F.lit(0.99), "score"), 4).alias("confidence"), F.round("similarity", 4).alias("similarity"), "boosts")


def similar_edges(chunks: DataFrame, least: float = LEAST, per_source: int | None = PER_SOURCE, per_pair: int | None = PER_PAIR, most: int | None = MOST) -> DataFrame:
    """similar_to edges between chunks (chunk_id, path, chunk_kind, symbol_kind, symbol_name, package_key, embedding)
    of different files. Kept are the best per_source edges of a source, of these per_pair for a pair of names, and `most`
    edges in all; None for any of them sets no bound."""
    pool = similar_pool(chunks, least, per_source)
    if per_source is None and not per_pair is most is None:
        pool = _best_of_source(pool, None)
    return pool_edges(pool, per_pair, most)
