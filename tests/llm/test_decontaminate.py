import hashlib
import re

import pytest

from siftwell.llm import decontaminate

from .helpers import DOCS, LOWER, SHARED, frame, prose, words2

ITEMS = [(1, " ".join(SHARED.split()[10:40])), (2, "one two three"), (3, None), (4, ""), (5, "X"), (5, "x x"), (None, " ".join(SHARED.split()[:20])), (7, prose(55, 30)), (8, "?!")]


def brute(text, items, window=13):
    words = words2(text)
    hit, found = set(), set()
    for item, body in items:
        w = words2(body)
        m = min(window, len(w))
        for j in range(len(w) - m + 1 if m else 0):
            for k in range(len(words) - m + 1):
                if words[k : k + m] == w[j : j + m]:
                    hit |= set(range(k, k + m))
                    if item is not None:
                        found.add(str(item))
    return len(words), hit, sorted(found)


@pytest.mark.parametrize("blocks", [1 << 20, 60])
def test_against_brute_force(spark, blocks):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = decontaminate.find_benchmark(frame(spark, extra=False), bench, block_bytes=blocks, shard_bytes=3000).collect()
    assert len(rows) == len(DOCS)
    for r in rows:
        n, hit, items = brute(r["text"], ITEMS)
        inside = {k for s in r["spans"] for k in range(s["start"], s["end"])}
        assert (r["n_words"], inside, r["n_hit"], r["item_ids"]) == (n, hit, len(hit), items)
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:], strict=False))
        assert decontaminate.items_digest(items) == hashlib.sha256(",".join(items).encode()).hexdigest()


@pytest.mark.parametrize("window", [1, 3, 13])
def test_windows_and_their_items(window):
    items = [*ITEMS, (8, "one two three one two three one two"), (9, "two three one"), (10, "three")]
    want = {}
    for item, body in items:
        w = words2(body)
        m = min(window, len(w))
        for j in range(len(w) - m + 1 if m else 0):
            want.setdefault(tuple(w[j : j + m]), set()).update([] if item is None else [str(item)])
    made = decontaminate.phrases(items, window)
    words, got = [w.decode() for w in made.vocabulary.to_pylist()], {}
    for m, (starts, item_at, owners) in made.by_length.items():
        for k, start in enumerate(starts):
            window_words = tuple(words[n - 1] for n in made.numbers[start : start + m])
            assert window_words not in got
            got[window_words] = {made.item_ids[i] for i in owners[item_at[k] : item_at[k + 1]]}
    assert got == want


def plain_stage(rows, items):
    """The rows that are not contaminated, their texts without the words of all windows."""
    out = []
    for i, t in rows:
        n, hit, _ = brute(t, items)
        if hit and 20 * len(hit) >= n:
            continue
        if hit:
            places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))]
            keep, runs = "", sorted(hit)
            at = 0
            for k in runs:
                if k - 1 not in hit:
                    keep += t[at : places[k][0]]
                if k + 1 not in hit:
                    at = places[k][1]
            t = keep + t[at:]
        out.append((i, t))
    return out


def test_stage_drops_contaminated_rows_and_cuts_the_rest(spark):
    bench = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    rows = DOCS + [(50, prose(61, 300) + "\n" + SHARED + " " + prose(62, 900)), (51, " ".join(SHARED.split()[12:30]) + "! " + prose(63, 700) + " " + " ".join(SHARED.split()[20:38]))]
    docs = frame(spark, rows)
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    got = kept.collect()
    want = plain_stage(rows, ITEMS[:1])
    assert sorted(((r[0], r[1]) for r in got), key=str) == sorted(want, key=str)
    assert len(want) < len(rows) and len({*want} - {*rows}) == 2
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)


def test_empty_tables(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.find_benchmark(frame(spark, []), bench).count() == 0
    rows = decontaminate.find_benchmark(frame(spark, extra=False), bench.limit(0)).collect()
    assert len(rows) == len(DOCS) and not any(r["n_hit"] for r in rows)


def test_cut_spans():
    assert decontaminate.cut_spans("Aé b, C d! e", [{"start": 1, "end": 3}]) == "Aé  d! e"
    assert decontaminate.cut_spans(None, []) is None
