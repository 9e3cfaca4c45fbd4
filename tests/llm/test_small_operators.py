import itertools
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwell.llm import packing, quality_rules, queries, sharding, url_filter, warc

from .helpers import DOCS, frame, prose, words7

SF = "/root/testdata/sf0.01"


def test_jump_hash_is_the_published_one():
    def plain(key, n):
        b, j = -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
        return b

    keys = np.random.default_rng(0).integers(0, 2**63, 400).astype(np.uint64)
    for n in (1, 2, 16, 17, 1000):
        assert sharding.jump_hash(keys.copy(), n).tolist() == [plain(int(k), n) for k in keys]


def test_shards(spark):
    rows = sharding.shard_table(frame(spark), 4).collect()
    texts = defaultdict(list)
    for i, t in DOCS:
        texts[i].append((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())))
    by_id, slots = defaultdict(set), defaultdict(list)
    for r in rows:
        by_id[r["doc_id"]].add((r["shard"], r["grown_shard"]))
        slots[r["shard"]].append(r["slot"])
        assert (r["size"], r["text_crc32"]) in texts[r["doc_id"]]
        assert r["grown_shard"] in (r["shard"], 4)
    assert len(rows) == len(DOCS) and all(len(s) == 1 for s in by_id.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_table(frame(spark, []), 4).count() == 0


def test_quality_counts(spark):
    rows = [*DOCS, (20, "a b c a b c\nx\nx\n\n x\na b"), (21, prose(8, 300)), (22, "\n\n"), (23, "line\nline\rline\n")]
    got = quality_rules.judge(frame(spark, rows, extra=False).select("doc_id", "text")).collect()
    assert len(got) == len(rows)
    for r in got:
        t, w = r["text"] or "", words7(r["text"])
        seen, dup = set(), 0
        for line in t.split("\n"):
            if words7(line):
                dup += line in seen
                seen.add(line)
        count = Counter(zip(w, w[1:], w[2:], strict=False))
        repeated = {k + j for k in range(len(w) - 2) if count[tuple(w[k : k + 3])] > 1 for j in range(3)}
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(repeated)), r
        assert r["base_failed"] == (len(w) < 50 or 100 * len(repeated) > 50 * len(w))
        assert not (r["kept"] and r["base_failed"])


def test_compression_bands(spark):
    import base64
    import random

    noise = base64.b85encode(random.Random(1).randbytes(6000)).decode()
    noise = " ".join(noise[k : k + 9] for k in range(0, len(noise), 9))
    mixed = prose(1, 12000, 5000) + " " + " ".join(f"k{k % 37}" for k in range(1500)) + " " + prose(2, 12000, 5000)
    rows = {r["doc_id"]: r for r in quality_rules.judge(frame(spark, [(1, prose(3, 900, 5000)), (2, noise), (3, mixed)], extra=False)).collect()}
    assert rows[1]["kept"] and not rows[2]["kept"] and not rows[3]["kept"]
    assert rows[3]["chunk_low"] < 0.3 and 0.385 < rows[3]["ratio"] < 0.68
    docs = frame(spark, [(1, prose(3, 900, 5000)), (2, noise), (4, None)])
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [1]
    assert quality_rules.judge(frame(spark, [])).count() == 0


def _limits(knots, size):
    """The limits at a length, straight over its logarithm between two knots; None below the first."""
    if size < knots[0][0]:
        return None
    for (a, low_a, high_a), (b, low_b, high_b) in itertools.pairwise(knots):
        if size < b:
            part = math.log(size / a) / math.log(b / a)
            return low_a + part * (low_b - low_a), high_a + part * (high_b - high_a)
    return knots[-1][1:]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_quality_query_on_table_rows(spark):
    """All base counts by SQL, the verdict by a plain compression of each text; the bands reject no row that is
    labelled good. (Their limits come from other texts, and leave what the base counts pass here alone.)"""
    import duckdb
    import zstandard

    bands, squeeze = quality_rules.Bands(), zstandard.ZstdCompressor(level=3).compress

    def inside(raw, knots):
        limits = _limits(knots, len(raw))
        return limits is None or limits[0] <= len(squeeze(raw)) / len(raw) <= limits[1]

    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    verdict = {i: inside(t.encode(), bands.document) and all(inside(t.encode()[k : k + 4096], bands.chunk) for k in range(0, len(t.encode()), 4096)) for i, t in docs}
    sql = r"""
WITH d AS (SELECT doc_id, text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM '{0}/documents.parquet'),
x AS (SELECT doc_id, j, array_to_string(w[j:j + 2], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 1)) AS j FROM d WHERE len(w) > 2)),
m AS (SELECT doc_id, j, count(*) OVER (PARTITION BY doc_id, s) AS n FROM x),
r AS (SELECT doc_id, count(DISTINCT j + k) AS n FROM m, range(0, 3) AS q(k) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id)
SELECT doc_id, len(w), list_sum(list_transform(w, lambda v: length(v)))::BIGINT,
       length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')), coalesce(l.n, 0), coalesce(r.n, 0)
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)""".replace("{0}", SF)
    want = {}
    for i, n, chars, symbols, lines, repeats in duckdb.sql(sql).fetchall():
        failed = n < 50 or 100 * repeats > 50 * n
        want[i] = (i, n, chars or 0, symbols, lines, repeats, failed, not failed and verdict[i])
    got = {r["doc_id"]: tuple(r) for r in queries.op6_quality_rules(spark, SF).collect()}
    assert got == want
    good = {i for (i,) in duckdb.sql(f"SELECT doc_id FROM '{SF}/labels.parquet' WHERE quality = 1").fetchall()}
    rejected = {i for i, r in want.items() if not r[6] and not r[7]}
    assert not rejected & good


URLS = ["http://a.Example.NET/en/x?q", "https://example.net/de/", "http://notexample.net/en/", "x://net", "y://net/", "no scheme", None, "", "http://b.example.com/de/1#f", "http://example.com/fr/", "http://q.org/fr/", "http://org/fr", "http://q.org/fr/?a/b", "http://net.evil.com/", "http://USER@x.net:80/p", "ftp://é.net/ü", "://example.net/en/"]


def test_url_rules(spark):
    pages = spark.createDataFrame([(k, u, "old") for k, u in enumerate([*URLS, *URLS])], "page_id long, url string, rule string")

    def brute(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        return host, path, best and best.name, best.verdict if best else "allow"

    got = url_filter.filter_urls(pages, queries.URL_RULES).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(r["url"])
    in_parts = url_filter.filter_urls(pages, queries.URL_RULES, most_bits=16).collect()
    assert sorted(map(str, in_parts)) == sorted(map(str, got))
    assert url_filter.filter_urls(pages.limit(0), queries.URL_RULES).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(pages, []).collect()} == {"allow"}


def test_hosts_of_many_labels(spark):
    """40 KB of labels: candidates depend on the rules, not on the url."""
    long = "http://" + "a." * 20000 + "net/x"
    pages = spark.createDataFrame([(1, long), (2, "http://" + "n" * 30000 + ".example.net/en/" + "p/" * 9000)], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, queries.URL_RULES).collect()}
    assert got == {1: ("net/", "block"), 2: ("example.net/en/", "allow")}


def test_cascade_is_exact_over_its_universe(spark):
    keys = [f"k{k}" for k in range(3000)]
    universe = spark.createDataFrame([(k,) for k in [*keys, *keys[:500]]], "key string")
    listed = spark.createDataFrame([(k,) for k in keys[::10]], "key string")
    cascade = url_filter.build_cascade(listed, universe, per_key=2.0, later=1.5)
    assert len(cascade.levels) > 2
    from pyspark.sql import functions as F

    got = {r[0] for r in universe.filter(url_filter.contains(F.col("key"), cascade)).collect()}
    assert got == set(keys[::10])


@given(st.lists(st.integers(1, 64), max_size=200))
@settings(max_examples=60, deadline=None)
def test_plan_places_every_piece(lengths):
    histogram = np.bincount(np.array(lengths, np.int64), minlength=65)
    runs = packing.plan(histogram, 64)
    fill, seen = defaultdict(list), Counter()
    for length in range(1, 65):
        own = [r for r in runs if r[0] == length]
        for (_, first, sequence, offset), after in zip(own, [*(r[1] for r in own[1:]), int(histogram[length])], strict=False):
            for k in range(after - first):
                fill[sequence + k].append((offset, length))
                seen[length] += 1
    assert all(seen[n] == histogram[n] for n in range(1, 65))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    if len(lengths) > 50:
        assert len(fill) <= -(-sum(lengths) // 64) * 1.25 + 2


def test_plan_is_near_the_least(spark):
    draw = np.random.default_rng(5)
    lengths = np.minimum(1024, draw.lognormal(5.2, 0.9, 20000).astype(int) + 1)
    histogram = np.bincount(lengths, minlength=1025)
    used = {}
    for length, first, sequence, _ in packing.plan(histogram, 1024):
        used[sequence] = length
    total = packing.plan(histogram, 1024)
    assert total
    sequences = set()
    for length in range(1, 1025):
        own = [r for r in total if r[0] == length]
        for (_, first, sequence, _), after in zip(own, [*(r[1] for r in own[1:]), int(histogram[length])], strict=False):
            sequences |= set(range(sequence, sequence + after - first))
    assert len(sequences) <= 1.02 * -(-int((np.arange(1025) * histogram).sum()) // 1024)


def test_pieces_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    special = ["漢字 and кириллица <|endoftext|> ok", "hello <|endoftext|> there", "<|endoftext|><|endoftext|>", " <|endoftext", "x<|ENDOFTEXT|>", prose(10, 1500) + "<|endoftext|>"]
    rows = [*DOCS, (30, prose(9, 2500)), (32, "a\u0301 \u00a0 \u2028 x\r\n"), *((40 + k, t) for k, t in enumerate(special))]
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert plain.encode("hello <|endoftext|> there", add_special_tokens=False).ids == [31373, 220, 50256, 612]
    got = packing.token_pieces(frame(spark, rows), packing.public_vocabulary(), with_ids=True).collect()
    want = Counter()
    for i, t in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        for k, (start, n) in enumerate(packing.cut(len(ids), 1024)):
            want[i, k, start, n, tuple(ids[start : start + n])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], tuple(r["ids"])) for r in got) == want
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in got)
    packed = packing.pack(frame(spark, rows)).collect()
    by = defaultdict(list)
    for r in packed:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    assert len(packed) == len(got)
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(frame(spark, [])).count() == 0


WARC = b"".join(
    b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <%s>\r\nWARC-Target-URI: %s\r\nWARC-Date: 2024-01-0%dT00:00:00Z\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, name, url, day, len(body), body)
    for kind, name, url, day, body in [
        (b"warcinfo", b"i", b"", 1, b"x: y"),
        (b"response", b"a", b"http://H.com/p?utm_source=1&b=2&a=1#f", 1, b"HTTP/1.1 200 OK\r\nETag: \"1\"\r\nContent-Length: 4\r\nVary: x\r\n\r\nbody"),
        (b"response", b"b", b"http://h.com/p?a=1&b=2", 2, b"HTTP/1.1 200 OK\r\nETag: \"2\"\r\n\r\nnew"),
        (b"revisit", b"c", b"https://h.com:443/p?b=2&a=1", 2, b"HTTP/1.1 304 Not Modified\r\nETag: W/\"1\"\r\nContent-Length: 0\r\nDate: d\r\n\r\n"),
        (b"revisit", b"d", b"http://h.com/p?a=1&b=2", 3, b"HTTP/1.1 304 Not Modified\r\nETag: \"1\"\r\n\r\n"),
        (b"revisit", b"e", b"http://h.com/p?a=1&b=2", 1, b"HTTP/1.1 304 Not Modified\r\n\r\n"),
        (b"revisit", b"f", b"http://h.com/p?a=1&b=2", 9, b"HTTP/1.1 304 Not Modified\r\n\r\n"),
        (b"revisit", b"g", b"", 9, b""),
    ]
)


def test_reader_goes_on_after_what_is_no_record():
    import gzip

    parts = [WARC[a:b] for a, b in itertools.pairwise([m.start() for m in re.finditer(b"WARC/1.0", WARC)] + [len(WARC)])]
    whole = [r["record_id"] for r in warc.parse_warc(WARC)]
    kinds = lambda data: [(r["record_id"] or r["record_type"]) for r in warc.parse_warc(data)]
    assert whole == [f"<{c}>" for c in "abcdefg"]
    junk = parts[1] + b"junk WARC/ line\r\n" + parts[2]
    assert kinds(junk) == ["<a>", "unreadable", "<b>"] and sum(r["skipped"] for r in warc.parse_warc(junk)) == 17
    wrong = parts[2].replace(b"Content-Length: ", b"Content-Length: 9", 1)
    assert kinds(parts[1] + wrong + parts[4]) == ["<a>", "unreadable", "<d>"]
    assert kinds(parts[1] + parts[2][:50]) == ["<a>", "unreadable"]
    assert kinds(b"") == [] and kinds(b"\r\n\r\n") == []
    packed = [gzip.compress(p) for p in parts[1:4]]
    broken = packed[1][:20] + b"\x00\xff\x00" + packed[1][23:]
    found = kinds(packed[0] + broken + packed[2])
    assert found[0] == "<a>" and found[-1] == "<c>" and "unreadable" in found


def test_one_url_many_captures_at_one_time(spark):
    """Ties, repeated rows and null ids; a revisit at a response's own time takes an earlier one."""
    from pyspark.sql import functions as F

    rows = [(f"r{t}-{k}" if k else None, "response", t, f"d{t}") for t in (0, 10, 7200) for k in range(4)]
    rows += [(f"v{t}", "revisit", t, "d10") for t in (0, 10, 11, 11, 3700, 7200, 9000)]
    records = spark.createDataFrame([(i, kind, "http://h/x", t, d, 1) for i, kind, t, d in rows], "record_id string, record_type string, url string, t long, payload_digest string, info int")
    records = records.withColumn("ts", F.timestamp_seconds("t")).withColumn("headers", F.lit(None).cast("map<string,string>"))
    for span in (5, 3600, 10**6):
        got = sorted((r["record_id"], r["resolved_id"], r["outcome"]) for r in warc.resolve_revisits(records, span).collect())
        assert got == [("v0", None, "missing"), ("v10", "r0-3", "changed"), ("v11", "r10-3", "resolved"), ("v11", "r10-3", "resolved"), ("v3700", "r10-3", "resolved"), ("v7200", "r10-3", "resolved"), ("v9000", "r7200-3", "changed")]


@pytest.mark.parametrize("packed", [False, True])
def test_warc(spark, tmp_path, packed):
    import gzip

    (tmp_path / "x.warc").write_bytes(gzip.compress(WARC) if packed else WARC + b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 99")
    records = warc.read_warc(spark, str(tmp_path))
    assert records.filter("record_type = 'response' AND payload IS NOT NULL").count() >= 2
    for span in (86400, warc.SPAN):
        got = {r["record_id"]: (r["resolved_id"], r["outcome"], r["headers"]) for r in warc.resolve_revisits(records, span).collect()}
        assert got["<c>"] == ("<a>", "resolved", {"etag": 'W/"1"', "content-length": "4", "vary": "x", "date": "d"})
        assert got["<d>"][:2] == ("<b>", "changed")
        assert got["<e>"][:2] == (None, "missing") and got["<g>"][:2] == (None, "missing")
        assert got["<f>"][:2] == ("<b>", "unvalidated")
        assert len(got) == 5
    assert warc.resolve_revisits(records.limit(0)).count() == 0


def _prose():
    """Licence texts of this machine, if they are there: each alone, and one of each family joined (over 100 KB)."""
    folder, texts = "/usr/share/common-licenses", {}
    for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
        with open(f"{folder}/{name}", encoding="utf-8") as f:
            texts[name] = f.read()
    families = {name.split("-")[0]: text for name, text in texts.items() if not name.startswith("LGPL")}
    return [*dict.fromkeys(texts.values()), *(["\n\n".join(dict.fromkeys(families.values()))] if texts else [])]


@pytest.mark.skipif(not _prose(), reason="no licence texts")
def test_real_prose_is_kept():
    texts = _prose()
    ratio, _, _, good = quality_rules.compression(pa.array(texts), quality_rules.Bands())
    assert good.all(), list(zip(map(len, texts), ratio, good, strict=True))
    assert min(map(len, texts)) < 2048 and max(map(len, texts)) > 100_000


def test_what_the_bands_reject():
    draw = random.Random(4)
    words = ["".join(draw.choice("etaoinshrdlu") for _ in range(draw.randrange(2, 9))) for _ in range(2000)]
    free = " ".join(draw.choice(words) for _ in range(3000))
    menu = "Home | About | Contact | Privacy policy\n"
    noise = "".join(draw.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(6000))
    ordered = "\n".join(f"Item {k} of the list that goes on" for k in range(300))
    texts = [free, menu * 100, noise, free + noise, free + menu * 150, ordered, "", "short"]
    good = quality_rules.compression(pa.array(texts), quality_rules.Bands())[3]
    assert good.tolist() == [True, False, False, False, False, False, True, True]
