"""The vector index finds what a comparison of all with all finds, and reads little of what lies in clusters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.operators import similarity, vector_index
from siftwell.sources.store import Store

KEYED = "id long, embedding array<double>"


def clusters(seed, centres, each, width=16, noise=0.05):
    rng = np.random.default_rng(seed)
    heart = rng.normal(size=(centres, width))
    return [heart[k % centres] + noise * rng.normal(size=width) for k in range(centres * each)]


def frame(spark, vectors, start=0):
    return spark.createDataFrame([(start + k, None if v is None else [float(x) for x in v]) for k, v in enumerate(vectors)], KEYED)


def units(vectors):
    out = {}
    for k, v in enumerate(vectors):
        v = np.zeros(1) if v is None else np.array([x if np.isfinite(x) else 0 for x in v], float)
        if np.linalg.norm(v) > 0:
            out[k] = v / np.linalg.norm(v)
    return out


def cosine(a, b):
    n = min(len(a), len(b))
    return round(float(a[:n] @ b[:n]), 12)


def brute(vectors, asked, k=None, least=0.0):
    rows = units(vectors)
    found = {}
    for q in asked:
        if q in rows:
            near = sorted((-cosine(rows[q], v), key) for key, v in rows.items() if cosine(rows[q], v) > 0 and cosine(rows[q], v) >= least)
            found[q] = [(key, -c) for c, key in near[:k]]
    return {q: r for q, r in found.items() if r}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query"], -r["similarity"], r["key"])):
        out.setdefault(r["query"], []).append((r["key"], r["similarity"]))
    return out


def same(got, want):
    assert {q: [k for k, _ in r] for q, r in got.items()} == {q: [k for k, _ in r] for q, r in want.items()}
    for q, r in got.items():
        assert np.allclose([c for _, c in r], [c for _, c in want[q]], atol=1e-9)


def queries(items, ids):
    return items.filter(F.col("id").isin(ids)).select(F.col("id").alias("query"), "embedding")


def test_as_brute_force_and_few_read(spark):
    vectors = clusters(1, 20, 30)
    items, ids = frame(spark, vectors), list(range(0, 600, 20))
    index = vector_index.build(items, "id")
    same(found(vector_index.search(index, queries(items, ids), 5)), brute(vectors, ids, 5))
    same(found(vector_index.within(index, queries(items, ids), 0.9)), brute(vectors, ids, None, 0.9))
    assert vector_index.share_read(index, queries(items, ids), 5) < 0.2
    assert vector_index.share_read(index, queries(items, ids), least=0.9) < 0.2


def test_vectors_without_clusters(spark):
    vectors = list(np.random.default_rng(2).normal(size=(300, 8)))
    items, ids = frame(spark, vectors), list(range(0, 300, 10))
    index = vector_index.build(items, "id", balls=9)
    same(found(vector_index.search(index, queries(items, ids), 7)), brute(vectors, ids, 7))
    assert vector_index.share_read(index, queries(items, ids), 7) <= 1


def test_copies_odd_vectors_and_parts(spark, monkeypatch):
    """A third of the rows share one vector, which is dealt over parts; ties go by key."""
    monkeypatch.setattr(vector_index, "ROW_BLOCK", 10)
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", 4)
    vectors = clusters(3, 5, 16, 4) + [np.array([1.0, 2, 3, 4])] * 40
    vectors += [None, [], [0.0, 0, 0, 0], [1.0], [2.0, 0, 0, 0], [float("nan"), 1, 0, 0], [float("inf"), 0, 0, 0], [1e-200, 0, 0, 0], [1e200, 1e200, 0, 0]]
    items, ids = frame(spark, vectors), list(range(0, len(vectors), 3)) + list(range(120, len(vectors)))
    index = vector_index.build(items, "id")
    want = brute([None if v is None else [x / max(1e-300, np.nanmax(np.abs([y for y in v if np.isfinite(y)]))) if np.isfinite(x) else 0 for x in v] if len(v) else [0] for v in vectors], set(ids), 6)
    same(found(vector_index.search(index, queries(items, ids), 6)), want)


def test_few_rows_and_none(spark):
    empty = frame(spark, [])
    one = frame(spark, [[1.0, 0]])
    ask = one.select(F.col("id").alias("query"), "embedding")
    assert found(vector_index.search(vector_index.build(empty, "id"), ask, 3)) == {}
    assert found(vector_index.within(vector_index.build(frame(spark, [[0.0, 0], None]), "id"), ask, 0.5)) == {}
    assert found(vector_index.search(vector_index.build(one, "id"), ask, 3)) == {0: [(0, 1.0)]}
    assert found(vector_index.search(vector_index.build(one, "id"), frame(spark, [None, [0.0], [-1.0, 0]]).withColumnRenamed("id", "query"), 3)) == {}
    with pytest.raises(ValueError):
        vector_index.within(vector_index.build(one, "id"), ask, 0)


def test_stored_and_changed(spark, tmp_path):
    old, new = clusters(4, 8, 10), clusters(5, 3, 10)
    index = vector_index.save(Store(spark, str(tmp_path / "s")), "near", vector_index.build(frame(spark, old), "id"))
    changed = frame(spark, new, start=70)  # ten rows in place of others, twenty more
    gone = spark.createDataFrame([(k,) for k in range(0, 30, 2)], "id long")
    after = {k: v for k, v in enumerate(old) if k not in range(0, 30, 2)} | {70 + k: v for k, v in enumerate(new)}
    store = Store(spark, str(tmp_path / "s"))
    vector_index.save(store, "near", vector_index.update(vector_index.load(store, "near"), changed, gone, "id"))
    index = vector_index.load(store, "near")
    vectors = [after.get(k) for k in range(100)]
    ids = list(range(0, 100, 7))
    asked = queries(frame(spark, vectors), ids)
    same(found(vector_index.search(index, asked, 6)), brute(vectors, ids, 6))
    with pytest.raises(ValueError):
        vector_index.update(index, frame(spark, [list(range(17))]), gone, "id")


def test_a_search_reads_the_folders_of_its_balls(spark, tmp_path):
    vectors = clusters(6, 12, 20)
    items = frame(spark, vectors)
    index = vector_index.save(Store(spark, str(tmp_path / "s")), "near", vector_index.build(items, "id"))
    needs = vector_index._needs(index, vector_index._asked(queries(items, [0]), "embedding", 0.9), vector_index._reachable)
    plan = vector_index._compared(index, needs, None)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_a_query_is_sent_once_to_a_group_of_rings(spark, monkeypatch):
    vectors = list(np.random.default_rng(7).normal(size=(300, 8)))
    items, ids = frame(spark, vectors), list(range(0, 300, 10))
    index = vector_index.build(items, "id")
    needs = vector_index._needs(index, vector_index._asked(queries(items, ids), "embedding", 0.1), vector_index._reachable)
    assert needs.count() == len(ids) and index.rings.count() > 10
    monkeypatch.setattr(vector_index, "_PAIRS", 50)  # of a task's pairs, few at once
    same(found(vector_index.within(index, queries(items, ids), 0.1)), brute(vectors, ids, None, 0.1))


@pytest.mark.parametrize("seed", [1, 2])
def test_pool_after_changes_is_that_of_the_new_table(spark, seed):
    rng = np.random.default_rng(seed)
    vectors = clusters(seed, 4, 12, 6, 0.3)
    row = lambda k, v: (k, f"d{rng.integers(3)}/f{rng.integers(12)}", f"k{rng.integers(2)}", None, f"n{rng.integers(5)}", "p" if rng.integers(2) else None, [float(x) for x in v])
    schema = "chunk_id long, path string, chunk_kind string, symbol_kind string, symbol_name string, package_key string, embedding array<double>"
    old = [row(k, v) for k, v in enumerate(vectors)]
    gone, other = set(range(0, 48, 6)), {k: row(k, vectors[(k + 5) % 48]) for k in (1, 9, 20, 33, 48, 49)}
    now = [r for r in old if r[0] not in gone and r[0] not in other] + list(other.values())
    before, after = spark.createDataFrame(old, schema), spark.createDataFrame(now, schema)
    changed, deleted = after.filter(F.col("chunk_id").isin(list(other))), spark.createDataFrame([(k,) for k in gone], "chunk_id long")
    index = vector_index.update(vector_index.build(before, "chunk_id"), changed, deleted, "chunk_id")
    got = similarity.update_pool(similarity.similar_pool(before, 0.5), after, index, changed, deleted, 0.5)
    shape = lambda df: sorted((r["source"], r["n"], r["target"], r["target_name"], round(r["score"], 9), tuple(r["boosts"])) for r in df.collect())
    want = shape(similarity.similar_pool(after, 0.5))
    assert shape(got) == want and len(want) > 60
