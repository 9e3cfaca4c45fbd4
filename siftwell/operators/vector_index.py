"""An exact index of vectors: balls around centres, cut into rings, of which a search reads those that can hold a result.

Angles between unit vectors obey the triangle inequality: a row at angle r from its centre is at least |a - r| away from a
query at angle a from that centre. Each row belongs to its nearest centre's ball and to a ring of it by r, so the least and
largest r of a ring bound the cosine of all its rows. A search compares each query with its nearest balls first; the k-th
best cosine found there is the least that counts, and only rings whose bound reaches it are compared after that.

Centres steer how much is read, never what is found. They are spread over a sample of at most SPREAD * MAX_BALLS distinct
vectors; every row is indexed. What the driver and each task hold (centres, and a row for each ring) is bounded by
MAX_BALLS. Rings that follow each other are groups of bounded size: a query is sent once to each group that it needs a
ring of, with a bit for each ring, and a task compares the queries of a ring by one matrix product. A ring with many rows
is a group of its own and dealt over parts, so a vector that very many rows share is no task of its own.

Null, empty and zero vectors have no direction: they are neither indexed nor found, and as queries find nothing.
Components that are not finite count as 0, and a shorter vector as filled up with zeros.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import Manifest, Store
from . import ordering

#: Most balls; rings of half a turn; sampled vectors for each ball.
MAX_BALLS, RINGS, SPREAD = 4096, 32, 4
#: Queries and rows that a task compares, on average.
QUERY_BLOCK, ROW_BLOCK = 4000, 5000
#: Pairs that a task holds the cosines or bounds of at once.
_PAIRS = 2_000_000
#: Rows of the nearest balls that a query meets first, for each result wanted.
FIRST = 4
#: Bounds are loosened by this for the rounding of angles; similarities are rounded to PLACES digits.
SLACK, PLACES = 1e-7, 12


@dataclass
class VectorIndex:
    """rows: key, v (of unit length), ball, ring; rings: ball, ring, lo, hi (angles to the centre), n; centres: one row
    of unit length for each ball."""

    rows: DataFrame
    rings: DataFrame
    centres: np.ndarray

    @property
    def width(self) -> int:
        return self.centres.shape[1]


def _units(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors, strict=True):
        if v is not None:
            v = np.asarray(v, float)[:width]
            row[: len(v)] = np.where(np.isfinite(v), v, 0)
    largest = np.abs(out).max(axis=1, keepdims=True, initial=0)
    out = np.divide(out, largest, out=np.zeros_like(out), where=largest > 0)  # squares neither vanish nor overflow
    size = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, size, out=np.zeros_like(out), where=size > 0)


def _angles(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centres.T, -1, 1))


def _spread(units: np.ndarray, most: int) -> np.ndarray:
    """Rows far from each other: each next one is the farthest from those taken."""
    taken, near = [0], units @ units[0]
    while len(taken) < min(most, len(units)):
        far = int(np.argmin(near))
        if near[far] > 1 - 1e-12:
            break
        taken.append(far)
        near = np.maximum(near, units @ units[far])
    return units[taken]


def _held(items: DataFrame, key: str, embedding: str) -> DataFrame:
    return items.select(F.col(key).alias("key"), F.col(embedding).cast("array<double>").alias("v")).filter(F.size("v") > 0)


def _centres(held: DataFrame, balls: int | None) -> np.ndarray:
    n, width = held.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return np.zeros((0, 0))
    balls = min(MAX_BALLS, balls or math.ceil(math.sqrt(n)))
    marked = held.withColumn("h", F.xxhash64("v"))
    least = marked.select("h").distinct().orderBy("h").limit(SPREAD * balls)
    sample = marked.join(F.broadcast(least), "h", "left_semi").groupBy("h").agg(F.first("v").alias("v")).toPandas().sort_values("h")
    units = _units(sample["v"], width)
    units = units[np.abs(units).max(axis=1) > 0]
    return _spread(units, balls) if len(units) else np.zeros((0, width))


def _assigned(held: DataFrame, centres: np.ndarray) -> DataFrame:
    """key, v, ball, ring and angle of all rows with a direction."""
    kind = held.schema["key"].dataType.simpleString()
    width = centres.shape[1]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            units = _units(batch["v"], width)
            there = np.abs(units).max(axis=1, initial=0) > 0
            units = units[there]
            angles = _angles(units, centres)
            ball = angles.argmin(axis=1)
            angle = angles[np.arange(len(ball)), ball]
            ring = np.minimum((angle * RINGS / np.pi).astype(int), RINGS - 1)
            yield pd.DataFrame({"key": batch["key"][there].to_numpy(), "v": list(units), "ball": ball, "ring": ring, "angle": angle})

    return held.mapInPandas(assign, f"key {kind}, v array<double>, ball int, ring int, angle double")


def _rings(rows: DataFrame) -> DataFrame:
    return rows.groupBy("ball", "ring").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.count("*").alias("n"))


def build(items: DataFrame, key: str, embedding: str = "embedding", balls: int | None = None) -> VectorIndex:
    """Indexes all rows of items. balls: the root of the number of rows by default. The rows are written to the
    checkpoint folder, so that they are assigned once."""
    held = _held(items, key, embedding)
    centres = _centres(held, balls)
    if not len(centres):
        rows = held.limit(0).select("key", "v", F.lit(0).alias("ball"), F.lit(0).alias("ring"), F.lit(0.0).alias("angle"))
    else:
        rows = ordering.settled(_assigned(held, centres))
    return VectorIndex(rows, ordering.settled(_rings(rows)), centres)


def update(index: VectorIndex, changed: DataFrame, deleted: DataFrame, key: str, embedding: str = "embedding") -> VectorIndex:
    """The index with the rows of changed added, in place of those of equal keys, and without the keys of deleted.
    Centres stay, so only changed rows are assigned; a change that outgrows them is found as exactly, but read more of.
    Vectors longer than those of the index need a new one."""
    held = _held(changed, key, embedding)
    longest = held.agg(F.max(F.size("v"))).first()[0]
    if longest and longest > index.width:
        raise ValueError(f"vectors of {longest} components, the index has {index.width}: build it anew")
    gone = changed.select(F.col(key).alias("key")).unionByName(deleted.select(F.col(key).alias("key"))).distinct()
    rows = index.rows.join(gone, "key", "left_anti").unionByName(_assigned(held, index.centres))
    return replace(index, rows=rows, rings=ordering.settled(_rings(rows)))


def save(store: Store, name: str, index: VectorIndex, base: Manifest | None = None) -> VectorIndex:
    """Commits the index's three tables at once and gives it as read from there; rows lie in a folder for each ball."""
    centres = store.spark.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(index.centres)], "ball int, v array<double>")
    tables = {f"{name}_rows": index.rows.repartition("ball", "ring"), f"{name}_rings": index.rings, f"{name}_centres": centres}
    return load(store, name, store.commit(tables, partition_by={f"{name}_rows": ("ball",)}, base=base))


def load(store: Store, name: str, at: Manifest | None = None) -> VectorIndex:
    at = at or store.manifest()
    centres = [r["v"] for r in store.read(f"{name}_centres", at).orderBy("ball").collect()]  # at most MAX_BALLS
    return VectorIndex(store.read(f"{name}_rows", at), store.read(f"{name}_rings", at), np.array(centres, float).reshape(len(centres), -1))


#: Angles of queries to all centres and to the centre of each ring, rings, and the least that counts, a row a query: which rings.
_Choice = Callable[[np.ndarray, np.ndarray, pd.DataFrame, np.ndarray], np.ndarray]


def _home(k: int) -> _Choice:
    """The rings of the nearest balls, as many balls as hold FIRST rows for each result."""

    def choose(to_centres: np.ndarray, ring_angles: np.ndarray, rings: pd.DataFrame, least: np.ndarray) -> np.ndarray:
        sizes = np.bincount(rings["ball"], rings["n"], minlength=to_centres.shape[1])
        order = np.argsort(to_centres, axis=1, kind="stable")
        enough = (np.cumsum(sizes[order], axis=1) < FIRST * k).sum(axis=1, keepdims=True) + 1
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
        return place[:, rings["ball"].to_numpy()] < enough

    return choose


def _reachable(to_centres: np.ndarray, ring_angles: np.ndarray, rings: pd.DataFrame, least: np.ndarray) -> np.ndarray:
    """The rings that can hold a cosine of least."""
    gap = np.maximum(ring_angles - rings["hi"].to_numpy(), rings["lo"].to_numpy() - ring_angles)
    return gap <= np.arccos(np.clip(least - SLACK, -1, 1))[:, None]


def _grouped(index: VectorIndex) -> pd.DataFrame:
    """All rings in order, with their group, their place in it, and the parts that the group's rows are dealt over."""
    rings = index.rings.select("ball", "ring", "lo", "hi", "n").toPandas().sort_values(["ball", "ring"], ignore_index=True)  # at most MAX_BALLS * RINGS
    group, held, groups, places = -1, ROW_BLOCK, [], []
    for n in rings["n"]:
        if held + n > ROW_BLOCK:
            group, held, place = group + 1, 0, 0
        held += n
        groups.append(group)
        places.append(place)
        place += 1
    return rings.assign(group=groups, place=places, parts=np.ceil(rings["n"] / ROW_BLOCK).astype(int))


def _needs(index: VectorIndex, queries: DataFrame, choose: _Choice, but: _Choice | None = None) -> DataFrame:
    """A row for each query (query, v, least) and group with rings chosen for it and not chosen by `but`: query, v, least,
    group, wanted (a bit for each of the group's rings), and n, the rows of these rings."""
    rings = _grouped(index)
    centres, width = index.centres, index.width
    kind = queries.schema["query"].dataType.simpleString()
    schema = f"query {kind}, v array<double>, least double, group int, wanted binary, n long"
    if rings.empty:
        return queries.sparkSession.createDataFrame([], schema)
    shared = queries.sparkSession.sparkContext.broadcast((centres, rings))

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, rings = shared.value
        ball, n = rings["ball"].to_numpy(), rings["n"].to_numpy()
        groups, starts = np.unique(rings["group"].to_numpy(), return_index=True)
        ends = [*starts[1:], len(rings)]
        step = max(1, _PAIRS // (len(rings) + len(centres)))
        for batch in batches:
            units = _units(batch["v"], width)
            there = np.flatnonzero(np.abs(units).max(axis=1, initial=0) > 0)
            for some in (there[k : k + step] for k in range(0, len(there), step)):
                names, unit, least = batch["query"].iloc[some], units[some], batch["least"].to_numpy()[some]
                angles = _angles(unit, centres)
                to_rings = angles[:, ball]
                chosen = choose(angles, to_rings, rings, least)
                if but is not None:
                    chosen &= ~but(angles, to_rings, rings, least)
                for group, start, end in zip(groups, starts, ends, strict=True):
                    part = chosen[:, start:end]
                    if (asks := part.any(axis=1)).any():
                        part = part[asks]
                        yield pd.DataFrame({"query": names[asks], "v": list(unit[asks]), "least": least[asks], "group": group, "wanted": [w.tobytes() for w in np.packbits(part, axis=1)], "n": part @ n[start:end]})

    return queries.mapInPandas(pick, schema)


def _wanted(needs: DataFrame) -> DataFrame:
    """group, place and ps of the rings that any query needs; ps: the parts that the group's queries are dealt over."""

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, count, size = {}, {}, {}
        for batch in batches:
            for group, wanted in zip(batch["group"].to_pylist(), batch["wanted"].to_pylist(), strict=True):
                seen[group] = seen.get(group, 0) | int.from_bytes(wanted)
                count[group] = count.get(group, 0) + 1
                size[group] = len(wanted)
        places = [np.flatnonzero(np.unpackbits(np.frombuffer(w.to_bytes(size[g]), np.uint8))).tolist() for g, w in seen.items()]
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(list(count.values()), pa.int64()), pa.array(places, pa.list_(pa.int32()))], ["group", "n", "places"])

    parts = needs.select("group", "wanted").mapInArrow(drawn, "group int, n long, places array<int>")  # of each task, at most a row a group
    groups = parts.groupBy("group").agg(F.ceil(F.sum("n") / QUERY_BLOCK).cast("int").alias("ps"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    return groups.select("group", "ps", F.explode("places").alias("place")).filter("ps > 0")


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)[:, :width]


def _compared(index: VectorIndex, needs: DataFrame, k: int | None) -> DataFrame:
    """query, key and similarity of the rows in the rings that a query needs, with a similarity of its least at the
    least and above 0; a task hands on k rows a query, or all."""
    spark, width = needs.sparkSession, index.width
    rings = _grouped(index)[["ball", "ring", "group", "place", "parts"]]
    rings = spark.createDataFrame([tuple(map(int, r)) for r in rings.itertuples(index=False)], "ball int, ring int, group int, place int, qs int")
    cells = F.broadcast(_wanted(needs).join(F.broadcast(rings), ["group", "place"]))  # at most MAX_BALLS * RINGS rows
    load = F.broadcast(cells.groupBy("group").agg(F.first("ps").alias("ps"), F.first("qs").alias("qs")))
    slot = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = needs.join(load, "group").select("group", slot("query", "ps").alias("p"), each("qs").alias("q"), "query", "v", "least", "wanted")
    right = index.rows.join(cells, ["ball", "ring"]).select("group", each("ps").alias("p"), slot("key", "qs").alias("q"), "place", "key", "v")

    def compare(some: pa.Table, rows: pa.Table) -> pa.Table:
        found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        if some.num_rows and rows.num_rows:
            rows = rows.sort_by([("place", "ascending"), ("key", "ascending")])
            asked, held, least = _matrix(some["v"], width), _matrix(rows["v"], width), some["least"].to_numpy()
            wanted = np.unpackbits(np.frombuffer(b"".join(some["wanted"].to_pylist()), np.uint8).reshape(some.num_rows, -1), axis=1)
            places, starts = np.unique(rows["place"].to_numpy(), return_index=True)
            for place, start, end in zip(places, starts, [*starts[1:], rows.num_rows], strict=True):
                asks, step = np.flatnonzero(wanted[:, place]), max(1, _PAIRS // (end - start))
                for which in (asks[n : n + step] for n in range(0, len(asks), step)):
                    near = asked[which] @ held[start:end].T
                    i, j = np.nonzero(near >= least[which, None] - 1e-9)
                    similarity = np.round(near[i, j], PLACES)
                    hit = (similarity >= least[which[i]]) & (similarity > 0)
                    found.append((which[i[hit]], start + j[hit], similarity[hit]))
        i, j, similarity = (np.concatenate(c) for c in zip(*found, strict=True))
        if k is not None and len(i):
            rank = np.empty(rows.num_rows, int)
            rank[pc.sort_indices(rows["key"]).to_numpy()] = np.arange(rows.num_rows)
            order = np.lexsort((rank[j], -similarity, i))
            first = np.searchsorted(i[order], i[order])  # where a query's rows begin
            order = order[np.arange(len(order)) - first < k]
            i, j, similarity = i[order], j[order], similarity[order]
        return pa.table({"query": some["query"].take(pa.array(i)), "key": rows["key"].take(pa.array(j)), "similarity": pa.array(similarity)})

    schema = f"query {needs.schema['query'].dataType.simpleString()}, key {index.rows.schema['key'].dataType.simpleString()}, similarity double"
    grouped = lambda df: df.groupBy("group", "p", "q")
    return grouped(left).cogroup(grouped(right)).applyInArrow(compare, schema)


def _asked(queries: DataFrame, embedding: str, least: float) -> DataFrame:
    return queries.select("query", F.col(embedding).cast("array<double>").alias("v"), F.lit(float(least)).alias("least"))


def _two_passes(index: VectorIndex, queries: DataFrame, k: int, embedding: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the nearest balls give, and what each query needs of them and of the others."""
    asked = _asked(queries, embedding, 0)
    home = _needs(index, asked, _home(k))
    first = ordering.settled(_best(_compared(index, home, k), k))
    kth = first.filter(F.col("n") == k).select("query", F.col("similarity").alias("kth"))
    raised = asked.join(kth, "query", "left").select("query", "v", F.coalesce("kth", "least").alias("least"))
    return first, home, _needs(index, raised, _reachable, but=_home(k))


def _best(scored: DataFrame, k: int) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "key"))
    return scored.withColumn("n", n).filter(F.col("n") <= k)


def search(index: VectorIndex, queries: DataFrame, k: int, embedding: str = "embedding") -> DataFrame:
    """query, key and similarity of the k nearest rows with a positive cosine for each row of queries (query, and its
    vector); ties go by key. The same rows as a comparison of all with all gives. `query` is unique."""
    first, _, rest = _two_passes(index, queries, k, embedding)
    return _best(first.drop("n").unionByName(_compared(index, rest, k)), k).drop("n")


def within(index: VectorIndex, queries: DataFrame, least: float, embedding: str = "embedding") -> DataFrame:
    """query, key and similarity of all rows with a cosine of at least `least`, which is above 0, for each row of
    queries."""
    if not least > 0:
        raise ValueError("least has to be above 0")
    return _compared(index, _needs(index, _asked(queries, embedding, least), _reachable), None)


def share_read(index: VectorIndex, queries: DataFrame, k: int | None = None, least: float | None = None, embedding: str = "embedding") -> float:
    """The part of all pairs of a query and a row that search (k) or within (least) compares."""
    if k is not None:
        _, home, rest = _two_passes(index, queries, k, embedding)
        needs = home.select("n").unionByName(rest.select("n"))
    else:
        needs = _needs(index, _asked(queries, embedding, least), _reachable)
    read = needs.agg(F.sum("n")).first()[0] or 0
    return read / max(1, queries.count() * index.rows.count())
