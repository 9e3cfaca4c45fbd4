"""A stored index that takes changes as segments.

Every table's rows bear the number of the commit that wrote them. A change adds a segment: the rows made of the changed
files, and tombstones for the keys whose earlier rows no longer count. A row counts if no later tombstone names its key,
so what a change writes is in proportion to the change. Document frequencies follow from the live postings of the terms
that a search reads, and the corpus's size from a sum of differences. `compact` writes the live rows as one segment.
All tables of a commit are published by one manifest, see sources.store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import entities, lexical, ordering
from ..sources.store import Manifest, Store
from .engine import KEYS, Change, Embedder, Extractor, Index, change_of

_SEGMENT = "segment"


def _tombs(kind: str) -> str:
    return f"gone_{kind}"


def _live(rows: DataFrame, gone: DataFrame | None, columns: tuple[str, ...]) -> DataFrame:
    if gone is None:
        return rows.drop(_SEGMENT)
    last = gone.toDF(*columns, _SEGMENT).groupBy(*columns).agg(F.max(_SEGMENT).alias("__last"))
    return rows.join(ordering.merged(last), list(columns), "left").filter(F.col("__last").isNull() | (F.col(_SEGMENT) >= F.col("__last"))).drop("__last", _SEGMENT)


def load_index(store: Store, embed: Embedder = vectors.hash_embedding, extractors: dict[str, Extractor] | None = None, at: Manifest | None = None) -> Index:
    """The live rows of all tables as one manifest has them. embed and extractors have to be those that the stored rows
    were made with."""
    at = at or store.manifest()
    table = lambda name: store.read(name, at) if store.exists(name, at) else None
    found = {name: None if (rows := table(name)) is None else _live(rows, table(_tombs(kind)), columns) for name, (kind, columns) in KEYS.items()}
    totals = store.read("totals", at).agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"))
    return Index(**found, totals=totals, embed=embed, extractors=extractors, buckets=store.read("layout", at).first()["buckets"])


def _as_segment(df: DataFrame, number: int) -> DataFrame:
    return df.withColumn(_SEGMENT, F.lit(number).cast("long"))


def _by_term(postings: DataFrame) -> DataFrame:
    """For files that a search reads few row groups of."""
    return postings.repartition("bucket").sortWithinPartitions("bucket", "term")


def store_index(store: Store, index: Index, bucket_rows: int = lexical.BUCKET_ROWS) -> Index:
    """Commits all tables of an index, with the postings of its chunks in buckets of terms, as many as their number asks
    for, and gives it as read from there. What other tables are made of is written first and read again, so nothing is
    made twice."""
    base = store.manifest()
    number = base.version + 1
    staged, read = {}, {}
    for name in ("files", "chunks", "entities", "imports", "embeddings"):
        if (rows := getattr(index, name)) is not None:
            staged[name], read[name] = store.stage(name, _as_segment(rows, number))
    files, imports = read["files"], read["imports"]
    tables = {"candidates": entities.edge_candidates(files, imports), "file_edges": entities.file_edges(files, imports), "code_edges": entities.code_edges(files, read["entities"], imports)}
    _, posted = store.stage("postings", lexical.postings(read["chunks"], "chunk_id", "content"))
    buckets = max(1, -(-posted.count() // bucket_rows))
    tables["postings"] = _by_term(posted.withColumn("bucket", lexical.bucket_of(F.col("term"), buckets)))
    final = {name: _as_segment(rows, number) for name, rows in tables.items()}
    final |= {"totals": lexical.corpus_totals(read["chunks"], "content"), "layout": store.spark.createDataFrame([(buckets,)], "buckets int")}
    stale = tuple(t for t in {_tombs(kind) for kind, _ in KEYS.values()} if store.exists(t, base))
    store.commit(staged | final, partition_by={"postings": ("bucket",)}, base=base, dropped=stale)
    return load_index(store, index.embed, index.extractors)


def update_index(store: Store, changed: DataFrame, deleted: DataFrame, embed: Embedder = vectors.hash_embedding, extractors: dict[str, Extractor] | None = None) -> Index:
    """Commits what a change does to a stored index as one segment, see engine.change_of. A second writer that started
    from the same commit gets a Conflict."""
    base = store.manifest()
    change = change_of(load_index(store, embed, extractors, base), changed, deleted)
    store.commit(added=_segment(change, base.version + 1), base=base)
    return load_index(store, embed, extractors)


def _segment(change: Change, number: int) -> dict[str, DataFrame]:
    rows = {name: _as_segment(_by_term(df) if name == "postings" else df, number) for name, df in change.added.items()}
    gone = {_tombs(kind): _as_segment(df, number) for kind, df in change.gone.items()}
    return rows | gone | ({"totals": change.totals} if change.totals is not None else {})


def compact(store: Store, embed: Embedder = vectors.hash_embedding, extractors: dict[str, Extractor] | None = None) -> Index:
    """The live rows of all tables as one segment, without tombstones. store.vacuum() then removes the earlier folders."""
    base = store.manifest()
    index = load_index(store, embed, extractors, base)
    tables = {name: _as_segment(_by_term(rows) if name == "postings" else rows, base.version + 1) for name in KEYS if (rows := getattr(index, name)) is not None}
    stale = tuple(t for t in {_tombs(kind) for kind, _ in KEYS.values()} if store.exists(t, base))
    store.commit(tables | {"totals": index.totals}, partition_by={"postings": ("bucket",)}, base=base, dropped=stale)
    return load_index(store, embed, extractors)
