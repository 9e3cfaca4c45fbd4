import math
from collections import Counter, defaultdict

import numpy as np

from siftwell.llm import near_dup

from .helpers import DOCS, frame, prose, words2


def edited(text, *places):
    w = text.split()
    for p in places:
        w[p] = f"edit{p}"
    return " ".join(w)


BASE = prose(70, 200)
ROWS = DOCS + [(200, BASE), (201, edited(BASE, 50)), (202, edited(BASE, 150)), (203, edited(BASE, 10, 60, 110, 160)), (204, prose(71, 200)), (205, "?!"), (206, "!?"), (207, "one, TWO three")]


def brute(rows):
    """Classes by equal texts and by weighted Jaccard similarity of all pairs."""
    n = sum(1 for _, t in rows if words2(t))
    sets, df = [], Counter()
    for _, t in rows:
        w = words2(t)
        s = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
        sets.append(s)
        df.update(s.keys())
    weight = lambda s: {x: c * math.log1p(1 / (math.floor(df[x] / n * 64) / 64 + near_dup.SMOOTH)) for x, c in s.items()}
    weighted = [weight(s) for s in sets]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = sum(min(v, weighted[b].get(x, 0)) for x, v in weighted[a].items())
            total = sum(weighted[a].values()) + sum(weighted[b].values()) - both
            equal = rows[a][1] is not None and rows[a][1] == rows[b][1]
            if equal or (total and both / total >= 0.8):
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(k)
    return [min((rows[j][0] for j in groups[find(k)] if rows[j][0] is not None), default=None) for k in range(len(rows))]


def test_classes(spark):
    got = near_dup.near_duplicates(frame(spark, ROWS)).collect()
    want = [(i, c) for (i, _), c in zip(ROWS, brute(ROWS), strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {c for i, c in want if i in (200, 201, 202)} == {200}


def test_keep_one(spark):
    docs = frame(spark, ROWS)
    out = near_dup.keep_one(docs)
    assert out.columns == docs.columns
    kept = Counter((r["doc_id"], r["text"]) for r in out.collect())
    classes = defaultdict(list)
    for row, c in zip(ROWS, brute(ROWS), strict=True):
        if row[1] is None:
            assert kept[row] == 1
        else:
            classes[c].append(row)
    for c, rows in classes.items():
        texts = {r[1] for r in rows}
        assert sum(kept[r] for r in set(rows)) == (1 if c != 9 and len({*texts}) else 2), (c, rows)


def test_empty_table(spark):
    assert near_dup.near_duplicates(frame(spark, [])).count() == 0
    assert near_dup.keep_one(frame(spark, [(1, None), (2, ""), (3, "")])).count() == 2


def test_components_of_a_chain_and_a_star(spark):
    node = lambda k: bytes([k // 256, k % 256])
    pairs = [(node(k), node(k + 1)) for k in range(1, 40)] + [(node(500), node(500 + k)) for k in range(1, 60)]
    got = dict(map(tuple, near_dup.components(spark.createDataFrame(pairs, "a binary, b binary")).collect()))
    assert {bytes(v) for k, v in got.items() if bytes(k) <= node(40)} == {node(1)}
    assert {bytes(v) for k, v in got.items() if bytes(k) > node(40)} == {node(500)} and len(got) == 39 + 59


def test_samples_estimate_weighted_jaccard():
    draw = np.random.default_rng(3)
    values = np.sort(draw.integers(0, 2**63, 3000).astype(np.uint64))
    one, two = draw.random(3000) * 4 + 0.5, draw.random(3000) * 4 + 0.5
    a, b = near_dup.signature(values, one, 2000), near_dup.signature(values, two, 2000)
    want = np.minimum(one, two).sum() / np.maximum(one, two).sum()
    assert abs((a == b).mean() - want) < 0.04


def test_samples_by_looked_up_keys_are_the_same():
    draw = np.random.default_rng(4)
    for m in (1, 7, 300, 9000):
        values = np.unique(draw.integers(0, 2**63, m).astype(np.uint64))
        weight = draw.choice([3.0, 3.0, 3.0, 2.5, 6.0], len(values))
        plain = near_dup.signature(values, weight, 120)
        assert (plain == near_dup.signature(values, weight, 120, 3.0)).all()
        assert (plain == near_dup.signature(values, weight, 120, 99.0)).all()


def test_twins_within_a_family(spark):
    """Texts that share a long template (0.76 to each other) each with one twin at 0.83: no end of a bucket links them."""
    template, rows = prose(80, 400, 4000), []
    for k in range(30):
        shared = " ".join(f"s{k}x{j}" for j in range(4))
        rows += [(1000 + 2 * k + t, f"{template} {shared} " + " ".join(f"t{k}x{t}x{j}" for j in range(10))) for t in (0, 1)]
    want = [(i, c) for (i, _), c in zip(rows, brute(rows), strict=True)]
    assert len({c for _, c in want}) == 30
    assert sorted(map(tuple, near_dup.near_duplicates(frame(spark, rows)).collect())) == want


def test_pairs_in_cells(spark):
    """All links of a bucket's inner texts across components, though the bucket is cut into many cells."""
    node = lambda k: bytes([k])
    families = [prose(90 + f, 120) for f in range(4)]
    body = {k: edited(families[k % 4], 5 + 3 * k) for k in range(20)}
    met = spark.createDataFrame([(1, node(k), 20, node(0), node(19)) for k in range(20)] + [(2, node(k), 3, node(0), node(2)) for k in range(3)], "band long, key binary, n long, mid binary, side binary")
    root = {k: 1 if k < 8 else 8 if k < 11 else k for k in range(1, 19)}
    joined = spark.createDataFrame([(node(k), node(r)) for k, r in root.items() if k != r], "node binary, root binary")
    texts = spark.createDataFrame([(node(k), t) for k, t in body.items()], "key binary, text string")
    sizes = spark.createDataFrame([(node(k), len(t.encode())) for k, t in body.items()], "key binary, size long")
    shares = spark.sparkContext.broadcast(np.zeros(near_dup.DF_BUCKETS, np.float32))
    want = {(a, b) for a in root for b in root if a < b and root[a] != root[b] and a % 4 == b % 4}
    for cell in (700, 3000, 1 << 20):
        got = [tuple(sorted((r["a"][0], r["b"][0]))) for r in near_dup._in_cells(met, joined, sizes, texts, shares, 0.8, cell).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_the_middle_of_a_family_is_its_star(spark):
    rows = [(k, b) for k in range(1, 30) for b in {k, 100, 200 + k % 2}] + [(0, b) for b in (100, 200, 201, 5, 6, 7)]
    met = near_dup._met(spark.createDataFrame([(bytes([k]), b) for k, b in rows], "key binary, band long"))
    got = {(r["band"], bytes(r["mid"]), bytes(r["side"]), r["n"]) for r in met.collect()}
    assert {(100, bytes([0]), bytes([29]), 30), (200, bytes([0]), bytes([28]), 15), (5, bytes([0]), bytes([5]), 2)} <= got
    assert met.count() == 30 + 15 + 16 + 6
