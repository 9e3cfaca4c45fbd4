from collections import defaultdict

import pytest

from siftwell.llm import substring_dedup

from .helpers import DOCS, SHARED, frame, prose, words7


def brute(rows, window=13):
    first = defaultdict(lambda: 1 << 63)
    order = [(1 << 63) - 1 if i is None else i for i, _ in rows]
    for i, (_, t) in zip(order, rows, strict=True):
        w = words7(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first[key], i)
    out = []
    for i, (doc, t) in zip(order, rows, strict=True):
        w = words7(t)
        gone = {k + j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for j in range(window)}
        out.append((doc, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone), gone))
    return out


@pytest.mark.parametrize("shard_bytes,common", [(1 << 20, 512), (900, 512), (900, 2)])
def test_against_brute_force(spark, shard_bytes, common):
    rows = DOCS + [(100 + k, prose(k, 20) + " " + SHARED + " " + prose(500 + k, 20)) for k in range(12)]
    got = substring_dedup.find_repeats(frame(spark, rows, extra=False), shard_bytes=shard_bytes, common=common).collect()
    want = brute(rows)
    key = lambda r: tuple(map(str, r))
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got), key=key) == sorted((w[:4] for w in want), key=key)
    spans = {(r["doc_id"], r["text"]): {k for s in r["spans"] for k in range(s["start"], s["end"])} for r in got}
    for (doc, t), w in zip(rows, want, strict=True):
        assert spans[doc, t] == w[4]


def test_stage_keeps_columns_and_clean_texts(spark):
    docs = frame(spark)
    out = substring_dedup.remove_repeats(docs)
    assert out.columns == docs.columns
    rows = {(r["doc_id"], r["n_chars"]): r for r in out.collect()}
    want = [w for w in brute(DOCS) if not (w[1] and w[1] == w[2])]
    assert len(want) == out.count()
    for r in rows.values():
        if r["text"]:
            assert r["n_chars"] == len(r["text"])
    assert any(r["text"] == "   \n\t " for r in rows.values())


def test_empty_table(spark):
    assert substring_dedup.find_repeats(frame(spark, [])).count() == 0
    assert substring_dedup.find_repeats(frame(spark, [(1, None), (2, "")], extra=False)).filter("n_removed = 0 AND n_words = 0 AND kept_text = ''").count() == 2
