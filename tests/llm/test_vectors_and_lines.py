"""Whitening, line dedup and vector codes against brute force."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from siftwell.llm import frames, line_dedup, vector_codes, vectors, whitening
from siftwell.llm.perfect_hash import PerfectHash

from .helpers import DOCS, LOWER, frame

NAN, INF = float("nan"), float("inf")


def vector_rows(n=60, d=8, seed=3):
    draw = random.Random(seed)
    rows = [(k, [draw.gauss(0, 1 + j) for j in range(d)], k % 3) for k in range(n)]
    hot = rows[5][1]
    rows += [(1000 + k, hot, 1) for k in range(n // 2)]
    rows += [(5, hot, 2), (5, hot, 2), (None, rows[7][1], None), (77, rows[8][1], None)]
    rows += [(2000, None, 1), (2001, [*hot[:-1], None], 1), (2002, [*hot[:-1], NAN], 1), (2003, [*hot[:-1], -INF], 1), (-1, hot[:-1], 0), (-2, [], 0)]
    return rows


def vector_frame(spark, rows, extra=True):
    columns = "vec_id long, embedding array<double>, label int"
    if not extra:
        return spark.createDataFrame(rows, columns)
    clash = "n string, whitened int, deviation string, explained int, position string, key int, weight int, codes int, error string, x int"
    return spark.createDataFrame([(*r, "n", 7, "d", 7, "p", 7, 7, 7, "e", 7) for r in rows], f"{columns}, {clash}")


def usable(rows, d):
    return [r for r in rows if r[1] is not None and len(r[1]) == d and all(c is not None and math.isfinite(c) for c in r[1])]


@pytest.mark.parametrize("flat", [False, True])
def test_whitening(spark, flat):
    rows = vector_rows()
    if flat:  # two dimensions say the same, one says nothing
        rows = [(i, None if v is None or len(v) < 8 else [*v[:6], v[0] if v[5] is not None else None, 0.5 if v[7] is not None and math.isfinite(v[7]) else v[7]], g) for i, v, g in rows]
    kept = usable(rows, 8)
    found = whitening.whiten(vector_frame(spark, rows), components=16).collect()
    assert len(found) == len(kept)
    x_of = lambda v: tuple(math.floor(64 * c) + 1000000 for c in v)
    fit = sorted({x_of(v) for _, v, _ in kept})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[float(Fraction(c * n - t, n)) for c, t in zip(x, s, strict=True)] for x in fit])
    cov = centred.T @ centred / n
    values = np.sort(np.linalg.eigvalsh(cov))[::-1]
    rank = 6 if flat else 8
    total = Fraction(sum((n * c - t) ** 2 for x in fit for c, t in zip(x, s, strict=True)), n**3)
    white = {}
    for r in found:
        assert r.n == n and len(r.whitened) == rank and r.x == 7 and r.identity_error < 1e-9
        assert r.deviation == r.deviation_exact == sum((n * c - t) ** 2 for c, t in zip(x_of(r.embedding), s, strict=True))
        np.testing.assert_allclose(r.explained, values[:rank] / float(total), rtol=1e-9)
        assert white.setdefault(x_of(r.embedding), r.whitened) == r.whitened
    w = np.array([white[x] for x in fit])
    np.testing.assert_allclose(w.T @ w / n, np.eye(rank), atol=1e-9)
    axes = np.linalg.lstsq(centred, w * np.sqrt(values[:rank]), rcond=None)[0]
    np.testing.assert_allclose(cov @ axes, axes * values[:rank], atol=1e-6 * values[0])


def test_whitening_edges(spark):
    rows = vector_rows()
    assert whitening.whiten(vector_frame(spark, rows[-6:-2])).count() == 0
    assert whitening.whiten(vector_frame(spark, [])).count() == 0
    one = whitening.whiten(vector_frame(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).collect()
    assert [(r.n, r.deviation, r.whitened) for r in one] == [(1, 0, [])] * 2
    large = whitening.whiten(vector_frame(spark, [(1, [1e12, 2.0], 0), (2, [-1e12, 2.5], 0), (3, [1e300, 0.0], 0)]), components=1).collect()
    wide = [(2 * math.floor(64e12) * k, 32 * -k) for k in (1, -1)]
    assert [(r.vec_id, r.deviation, int(r.deviation_exact)) for r in large] == [(k + 1, None, sum(v * v for v in wide[k])) for k in range(2)]


def plain_codes(rows, d, parts=4, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * c) for c in v], g) for i, v, g in usable(rows, d)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    at = [k * d // parts for k in range(parts + 1)]
    part = lambda x, p: x[at[p] : at[p + 1]]
    books = [[part(x, p) for _, x, _ in first] for p in range(parts)]
    far = lambda a, b: sum((u - v) ** 2 for u, v in zip(a, b, strict=True))
    best = lambda x, p: min((far(part(x, p), b), k) for k, b in enumerate(books[p]))
    for _ in range(rounds):
        groups = {}
        for _, x, _ in kept:
            for p in range(parts):
                groups.setdefault((p, best(x, p)[1]), []).append(part(x, p))
        books = [[[sum(c) // len(g) for c in zip(*g, strict=True)] if (g := groups.get((p, k))) else b for k, b in enumerate(books[p])] for p in range(parts)]
    out, by_label = [], {}
    for i, x, g in kept:
        found = [best(x, p) for p in range(parts)]
        by_label[g] = by_label.get(g, 0) + sum(f for f, _ in found)
        out.append((i, g, "".join(f"{k:02x}" for _, k in found), sum(f for f, _ in found)))
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted(((*r, by_label[r[1]]) for r in out), key=str), digest


@pytest.mark.parametrize("entries,few,d", [(5, 1 << 16, 8), (20, 0, 8), (256, 1 << 16, 7)])
def test_vector_codes(spark, monkeypatch, entries, few, d):
    monkeypatch.setattr(vector_codes, "FEW_LABELS", few)
    rows = vector_rows(d=d)
    found, books = vector_codes.compress(vector_frame(spark, rows), entries=entries)
    plain, digest = plain_codes(rows, d, entries=entries)
    assert sorted([(r.vec_id, r.label, r.code, r.error, r.label_error) for r in found.collect()], key=str) == plain
    assert vector_codes.codebooks_digest(books) == digest


def test_vector_codes_edges(spark):
    found, books = vector_codes.compress(vector_frame(spark, []))
    assert found.count() == 0 and [b.size for b in books] == [0] * 4
    wide = [(1, [1e9, -1e9, 5.0, 0.0], 1), (2, [-1e9, 1e9, 5.0, 0.0], None), (3, [3e4, 3.0, 5.0, 0.0], 1), (4, [40.0, 3.0, 5.0, -0.0001], 1)]
    found, _ = vector_codes.compress(vector_frame(spark, wide).drop("label"), entries=2)
    plain, _ = plain_codes([(i, v, None) for i, v, _ in wide], 4, entries=2)
    shown = lambda n: n if n < 2**63 else None
    assert sorted([(r.vec_id, r.label, r.code, r.error, r.label_error) for r in found.collect()], key=str) == [(*r[:3], shown(r[3]), shown(r[4])) for r in plain]


def test_nearest_is_exact():
    draw = np.random.default_rng(5)
    for scale in (900, 2**24, 2**40):
        x, book = draw.integers(-scale, scale, (50, 4)), draw.integers(-scale, scale, (9, 4))
        book[7] = book[2]
        code, error = vector_codes.nearest(x, book)
        for row, c, e in zip(x, code, error, strict=True):
            assert (int(e), int(c)) == min((sum((int(a) - int(b)) ** 2 for a, b in zip(row, entry, strict=True)), k) for k, entry in enumerate(book))


def test_perfect_hash():
    draw = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 5000):
        keys = np.unique(draw.integers(0, 2**64, n, dtype=np.uint64))
        table, slots = PerfectHash.build(keys)
        assert sorted(slots) == list(range(len(keys))) and (table.slots(keys) == slots).all()
        if n == 5000:
            assert len(table.words) * 64 < 5 * n and not len(table.rest)
    hashed = np.array([[7, 1], [7, 2], [7, 3], [8, 1], [9, 4]], np.uint64)
    index = line_dedup.LineIndex.build(hashed, np.arange(5) + 5, np.arange(5))
    index = line_dedup.LineIndex.unpack(index.pack())
    assert index.keepers[index.find(hashed)].tolist() == [0, 1, 2, 3, 4]
    assert index.find(np.array([[7, 4], [8, 2], [10, 1]], np.uint64)).tolist() == [-1, -1, -1]
    strange = draw.integers(0, 2**64, (1000, 2), dtype=np.uint64)
    assert (index.find(strange) == -1).all()


def plain_lines(rows, least_chars=40, least_docs=5):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= least_chars:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(h := holders.get(key(x), ())) < least_docs or i == max(h)]
        out.append((i, t, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


LONG = "This line, which É says, is long enough to count"
EDGE = "é" * 39
LINES = [
    *DOCS,
    *[(100 + k, f"{LONG if k % 2 else '  ' + LONG.replace('T', 't') + chr(9)}\nown {k}\n{EDGE}\n{EDGE}x") for k in range(6)],
    *[(200 + k, f"{LONG}\r\n{LONG}\n" * 3) for k in range(2)],
    (300, LONG.upper()), (301, LONG.lower().replace("É", "é")), (None, f"{LONG}\nb"), (100, LONG), (400, f"{LONG}\x00"), (401, f"\x0b\x0c{LONG}\n\n" + "x" * 200000),
]


@pytest.mark.parametrize("shard_lines,pass_lines", [(1 << 18, 1 << 21), (1, 1)])
def test_line_dedup(spark, shard_lines, pass_lines):
    docs = frame(spark, LINES).withColumn("n_lines", frames.F.lit("mine")).repartition(3)
    found = line_dedup.dedup_lines(docs, shard_lines=shard_lines, pass_lines=pass_lines)
    assert found.columns == [*[c for c in docs.columns if c != "n_lines"], "n_lines", "n_dropped", "kept_text"]
    assert sorted([(r.doc_id, r.text, r.n_lines, r.n_dropped, r.kept_text) for r in found.collect()], key=str) == plain_lines(LINES)


@pytest.mark.parametrize("shard_lines,pass_lines", [(1 << 18, 1 << 21), (2, 4)])
def test_line_dedup_settings(spark, shard_lines, pass_lines):
    found = line_dedup.dedup_lines(frame(spark, LINES, extra=False), 3, 2, shard_lines, pass_lines)
    assert sorted([(r.doc_id, r.text, r.n_lines, r.n_dropped, r.kept_text) for r in found.collect()], key=str) == plain_lines(LINES, 3, 2)
    assert line_dedup.dedup_lines(frame(spark, []), 3, 2, shard_lines, pass_lines).count() == 0


def test_exact_sums():
    values = np.array([[2**61, -5], [2**61, 6]])
    assert vectors.int_sum(values, vectors.magnitude(values)) == [2**62, 1]
    assert vectors.int_sum(values[:0], 0) == [0, 0]
