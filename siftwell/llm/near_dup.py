"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

1. One pass counts, for each of a fixed number of hash buckets, the share of all documents that have a shingle in it.
   The weight of a shingle is its count in the text times ln(1 + 1 / (share + 0.05)), with the share rounded down to
   a 64th. The addend keeps weights of rare shingles level (buckets need to tell common shingles only, so their number
   need not grow with the corpus) and keeps a large group of copies from making its own shared words light.
2. One pass draws a weighted sample for each of bands x rows hash functions (Ioffe, 2010). The random variates of a
   shingle are a row of a fixed table, chosen by its hash; ties go to the lesser hash.
3. Texts with equal bands meet in a bucket. Each is a candidate pair with two of the bucket's texts, one of them the
   text that meets most others over all bands, so pairs grow with the texts, not with the square of a bucket. Equal
   texts count once.
4. Candidates are verified by exact weighted Jaccard similarity: for each text first the pair with most bands in
   common; then all other pairs whose texts are not connected yet.
5. Where a bucket's texts are then still in several components, all pairs across these are compared too, in cells of
   a bounded size of text. So every pair that meets in a bucket is verified or connected. Only buckets of four texts or
   more with unlike texts cost anything here, but a large one of them costs its texts times those outside its largest
   component. Connected texts form a class.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import own, settle, sweep
from .vectors import summed
from .words import ALNUM, Words, blocks, column_bytes, mix64, release, rows_of, run_hash, split_words

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 24, 5
DF_BUCKETS, SMOOTH, LEVELS = 1 << 17, 0.05, 64
_TABLE, _SEED = 1 << 14, 20100101
_BLOCK = 1 << 20
_FILTER_BITS = 1 << 26
_CELL_BYTES = 1 << 19
_LAST = (1 << 63) - 1


def text_key(column: str = "text") -> Column:
    """16 bytes of SHA-256: stands for a text (null for null)."""
    return F.substring(F.unhex(F.sha2(F.col(column), 256)), 1, 16)


def shingles(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: hash, count, and text, ordered by text and hash. A text with fewer words than a
    shingle has one of all its words; a text without words has none."""
    hashes = words.hashes()[words.ids] if words.n else np.zeros(0, np.uint64)
    room, counts = words.room(), words.counts
    starts = np.flatnonzero(room >= size)
    values, docs = run_hash(hashes, size)[starts] if len(starts) else np.zeros(0, np.uint64), words.doc[starts]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = [run_hash(hashes[words.first[d] : words.first[d + 1]], int(counts[d]), int(counts[d]))[0] for d in short]
        values, docs = np.concatenate([values, np.array(extra, np.uint64)]), np.concatenate([docs, short])
        by = np.argsort(docs, kind="stable")
        values, docs = values[by], docs[by]
    cuts = np.searchsorted(docs, np.arange(len(counts) + 1))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (docs[1:] != docs[:-1])
    heads = np.flatnonzero(new)
    return values[heads], np.diff(np.append(heads, len(values))), docs[heads]


def bucket_shares(docs: DataFrame) -> np.ndarray:
    """For each bucket, the share of the documents with a word that have a shingle there (the sum over all rows)."""

    def totals(batches):
        out = np.zeros(DF_BUCKETS + 1)
        for batch in batches:
            for part in blocks(batch, "text", _BLOCK):
                words = split_words(part.column("text"), ALNUM, lower=True)
                values, _, of = shingles(words)
                pairs = of * DF_BUCKETS + (values >> np.uint64(47)).astype(np.int64)  # ascending, as buckets are a hash's first bits
                pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])] if len(pairs) else pairs
                out[:DF_BUCKETS] += np.bincount(pairs % DF_BUCKETS, minlength=DF_BUCKETS)
                out[DF_BUCKETS] += np.count_nonzero(words.counts)
        return out

    found = summed(docs.select("text"), totals, DF_BUCKETS + 1)
    return (found[:-1] / max(found[-1], 1.0)).astype(np.float32)


def weights(values: np.ndarray, counts: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Counts times the inverse document frequency, which falls in steps of the share: all shingles of a rarer bucket
    than the first step weigh alike."""
    level = np.floor(shares[(values >> np.uint64(47)).astype(np.int64)].astype(np.float64) * LEVELS) / LEVELS
    return counts * np.log1p(1.0 / (level + SMOOTH))


_tables: dict = {}
_common: dict = {}


def _variates(n: int) -> tuple[np.ndarray, ...]:
    """1 / r, b, ln c and r of consistent weighted sampling, a row for each entry and a column for each function."""
    if n not in _tables:
        draw = np.random.Generator(np.random.PCG64(_SEED))
        shape = (_TABLE, n)
        r, ln_c = draw.gamma(2.0, 1.0, shape), np.log(draw.gamma(2.0, 1.0, shape))
        _tables[n] = tuple(x.astype(np.float32) for x in (1.0 / r, draw.random(shape), ln_c, r))
    return _tables[n]


def _order_keys(ln_weight, inverse, b, ln_c, r) -> np.ndarray:
    """Integers in the order of ln a, the value of which the least one is sampled."""
    t = np.floor(ln_weight * inverse + b)
    ln_a = ln_c - r * (t + np.float32(1) - b)
    return np.maximum(ln_a + np.float32(64), np.float32(0)).view(np.int32)


def _ranked(weight: float, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At one weight, for each function: the rank of each entry, the entry of each rank, and the entries' order keys.
    Those of the last two weights are kept."""
    if (n, weight) not in _common:
        if len(_common) >= 2:
            del _common[next(iter(_common))]
        keys = _order_keys(np.float32(np.log(weight)), *_variates(n))
        entries = np.argsort(keys, axis=0, kind="stable").astype(np.uint16)
        ranks = np.empty_like(entries)
        np.put_along_axis(ranks, entries.astype(np.int64), np.arange(_TABLE, dtype=np.uint16)[:, None], axis=0)
        _common[n, weight] = ranks, entries, keys
    return _common[n, weight]


def signature(values: np.ndarray, weight: np.ndarray, n: int, common: float | None = None) -> np.ndarray:
    """n weighted samples of a set of shingles (ascending), as 64-bit values that are equal for equal samples. Of
    shingles at one order key, that with the least table entry and value is sampled. common: a weight that many
    shingles have; these are compared by the entries' ranks, which gives the same samples."""
    rows = (values >> np.uint64(32)).astype(np.int64) % _TABLE
    every, best = np.arange(n), None
    usual = weight == common if common is not None else np.zeros(len(values), bool)
    if usual.any():
        (ranks, entries, keys), some, row = _ranked(common, n), values[usual], rows[usual]
        least = np.minimum.reduce([ranks[row[k : k + 2048]].min(axis=0) for k in range(0, len(row), 2048)])
        entry = entries[least, every].astype(np.int64)
        first = np.zeros(_TABLE, np.int64)
        first[row[::-1]] = np.arange(len(row))[::-1]
        best = keys[entry, every].astype(np.int64), entry, some[first[entry]]
    if not usual.all():
        some, row, ln_w = values[~usual], rows[~usual], np.log(weight[~usual]).astype(np.float32)
        by = np.argsort(row, kind="stable")
        some, row, ln_w = some[by], row[by], ln_w[by, None]
        for k in range(0, len(some), 2048):
            keys = _order_keys(ln_w[k : k + 2048], *(x[row[k : k + 2048]] for x in _variates(n)))
            at = keys.argmin(axis=0)
            new = keys[at, every].astype(np.int64), row[k : k + 2048][at], some[k : k + 2048][at]
            if best is None:
                best = new
            else:
                same = new[0] == best[0]
                better = (new[0] < best[0]) | (same & (new[1] < best[1])) | (same & (new[1] == best[1]) & (new[2] < best[2]))
                best = tuple(np.where(better, x, y) for x, y in zip(new, best, strict=True))
    return best[0] << 32 | (best[2] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def most_common(weight: np.ndarray) -> float | None:
    if not len(weight):
        return None
    found, counts = np.unique(weight, return_counts=True)
    return float(found[counts.argmax()])


def band_keys(samples: np.ndarray, bands: int) -> np.ndarray:
    rows = mix64(samples.view(np.uint64)).reshape(bands, -1)
    factors = run_hash(np.arange(rows.shape[1], dtype=np.uint64), 1, 11) | np.uint64(1)
    return mix64((rows * factors).sum(axis=1, dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _signed(docs: DataFrame, shares, bands: int, rows: int) -> DataFrame:
    """doc_id, key, size (bytes) and the bands of each text with a word."""

    def run(batches):
        for batch in rows_of(batches):
            for part in blocks(batch, "text", _BLOCK):
                values, counts, of = shingles(split_words(part.column("text"), ALNUM, lower=True))
                weight = weights(values, counts, shares.value)
                cuts, common = np.searchsorted(of, np.arange(part.num_rows + 1)), most_common(weight)
                made = [band_keys(signature(values[a:b], weight[a:b], bands * rows, common), bands) if b > a else np.zeros(0, np.int64) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                offsets = np.append(0, np.cumsum([len(m) for m in made])).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(made)))
                sizes = pa.array(np.diff(column_bytes(part.column("text"))[1]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), sizes, lists], names=["doc_id", "key", "size", "bands"])

    return docs.mapInArrow(run, "doc_id long, key binary, size long, bands array<long>").filter(F.size("bands") > 0)


def similarity(left: Words, right: Words, shares: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of each text of one block with that of the other block in the same row."""
    n = len(left.first) - 1
    keyed = []
    for words in (left, right):
        values, counts, of = shingles(words)
        key = mix64(values + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        keyed.append((key, weights(values, counts, shares), of))
    (ka, wa, oa), (kb, wb, ob) = keyed
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    same = oa[ia] == ob[ib]
    both = np.bincount(oa[ia[same]], weights=np.minimum(wa[ia[same]], wb[ib[same]]), minlength=n)
    total = np.bincount(oa, weights=wa, minlength=n) + np.bincount(ob, weights=wb, minlength=n) - both
    return np.divide(both, total, out=np.zeros(n), where=total > 0)


def _verified(pairs: DataFrame, texts: DataFrame, shares, threshold: float) -> DataFrame:
    """The pairs (a, b) with similar texts."""

    def run(batches):
        for batch in rows_of(batches):
            for part in blocks(batch, "text_a", _BLOCK):
                one, two = (split_words(part.column(c), ALNUM, lower=True) for c in ("text_a", "text_b"))
                good = pa.array(similarity(one, two, shares.value) >= threshold)
                yield pa.RecordBatch.from_arrays([part.column("a").filter(good), part.column("b").filter(good)], names=["a", "b"])

    side = lambda c: texts.select(F.col("key").alias(c), F.col("text").alias(f"text_{c}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def _dealt_anew(sums: DataFrame, key: str) -> DataFrame:
    """Sums by key, with the key under another name that the planner takes for a new value. So the join on it gets an
    exchange of its own on both sides, and the adaptive planner can split a node with very many links over tasks."""
    return sums.withColumn(own(key), F.concat(key, F.lit(bytearray()))).drop(key)


def components(links: DataFrame) -> DataFrame:
    """node and root (its component's least node) of all nodes but the roots, from links (a, b), by alternating large
    and small stars (Kiveris and others, 2014). Only least neighbours are gathered for a node, so one with any number
    of links is safe. Merge joins, as a broadcast in each round fills the driver."""
    edges = settle(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi != lo").distinct())
    mark = None
    while True:
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if new == mark:
            sweep(links.sparkSession)
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        mark = new
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(_dealt_anew(least, "u").hint("merge"), F.col("u") == F.col(own("u"))).filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).filter("hi != lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(_dealt_anew(least, "hi").hint("merge"), F.col("hi") == F.col(own("hi"))).select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionAll(least.select("hi", F.col("m").alias("lo")))
        edges = settle(small.filter("hi != lo").distinct())


def maybe_in(keys: DataFrame) -> Column:
    """True for a `key` of the given keys, and for a few others: a filter of fixed size, so that rows that surely
    have no partner need no shuffle. With too many keys it lets all rows through."""
    place = F.pmod(F.xxhash64("key"), F.lit(_FILTER_BITS))
    word = F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))")
    found = keys.select(place.alias("p")).groupBy((F.col("p") / 64).cast("int").alias("at")).agg(word.alias("word"))
    bits = np.zeros(_FILTER_BITS // 64, np.int64)
    for batch in found.toArrow().to_batches():  # at most 2^20 rows
        bits[batch.column("at").to_numpy()] = batch.column("word").to_numpy()
    held = keys.sparkSession.sparkContext.broadcast(bits.view(np.uint64))

    @F.pandas_udf("boolean")
    def test(places: pd.Series) -> pd.Series:
        p = places.fillna(0).to_numpy().astype(np.int64)
        return pd.Series(((held.value[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1)).astype(bool))

    return F.col("key").isNotNull() & test(place)


def _order_id() -> Column:
    """doc_id, with a null one after all others."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))


def _met(banded: DataFrame) -> DataFrame:
    """Texts that share a bucket: band, key, n (texts of the bucket) and mid and side, the two that its others are
    compared with. mid is the text that meets most others over all its bands, so that it stands in the middle of a
    family and links most of it at once; side has the least key but for mid's. banded: key, band."""
    shared = settle(banded.join(banded.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"), "band"))
    weighed = shared.join(shared.groupBy("key").agg(F.sum("n").alias("c")), "key")
    ends = weighed.groupBy("band").agg(F.max(F.struct("c", "key"))["key"].alias("mid"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    return settle(shared.join(ends, "band").select("band", "key", "n", "mid", F.when(F.col("lo") != F.col("mid"), F.col("lo")).otherwise(F.col("hi")).alias("side")))


def _in_cells(met: DataFrame, joined: DataFrame, sizes: DataFrame, texts: DataFrame, shares, threshold: float, cell: int = 0) -> DataFrame:
    """The pairs (a, b) of similar texts in one bucket that are both not its mid or side, and not of one component. A
    bucket's largest component needs no pairs within, so only texts outside of it are compared with all. Both sides are
    dealt over cells of a bounded size of text and compared there, so no task holds a bucket, and only links come out.
    joined: node, root; sizes: key, size; texts: key, text."""
    inner = met.filter("n > 3 AND key != mid AND key != side").select("band", "key")
    rooted = settle(inner.join(joined.hint("merge"), F.col("key") == F.col("node"), "left").select("band", "key", F.coalesce("root", "key").alias("root")))
    counts = rooted.groupBy("band", "root").agg(F.count("*").alias("n"))
    main = counts.groupBy("band").agg(F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("n")).filter("m.n < n").select("band", F.col("m.root").alias("main"))
    many = settle(rooted.join(main, "band").join(sizes, "key"))
    cells = lambda c: F.ceil(c / (cell or _CELL_BYTES)).cast("int")
    cut = many.groupBy("band").agg(cells(F.sum(F.when(F.col("root") != F.col("main"), F.col("size")))).alias("ps"), cells(F.sum("size")).alias("qs"))
    slot = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    places = lambda n, p, q, first: F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda k: F.struct(F.lit(first).alias("first"), (slot("ps") if p else k).alias("p"), (k if p else slot("qs")).alias("q")))
    firsts = F.when(F.col("root") != F.col("main"), places("qs", True, False, True)).otherwise(F.array().cast("array<struct<first:boolean,p:int,q:int>>"))
    held = many.join(cut, "band").join(texts, "key").select("band", "key", "root", "main", "text", F.explode(F.concat(firsts, places("ps", False, True, False))).alias("at"))
    dealt = held.select("band", "at.p", "at.q", "at.first", "key", "root", "main", "text")

    def compare(table: pa.Table) -> pa.Table:
        keys, roots = table.column("key").to_pylist(), table.column("root").to_pylist()
        number = {r: k for k, r in enumerate(sorted({*roots, *keys}))}
        key, root = (np.array([number[x] for x in column], np.int64) for column in (keys, roots))
        main = number.get(table.column("main")[0].as_py(), -1)
        values, times, of = shingles(split_words(table.column("text"), ALNUM, lower=True))
        weight = weights(values, times, shares.value)
        total = np.bincount(of, weights=weight, minlength=len(keys))
        _, ids = np.unique(values, return_inverse=True)
        at = np.searchsorted(of, np.arange(len(keys) + 1))
        first = table.column("first").to_numpy(zero_copy_only=False)
        second = np.flatnonzero(~first)
        span = np.concatenate([np.arange(at[j], at[j + 1]) for j in second]) if len(second) else np.zeros(0, np.int64)
        heads = np.cumsum(np.diff(at)[second]) - np.diff(at)[second]
        mark, found = np.zeros(int(ids.max()) + 1 if len(ids) else 1), []
        for i in np.flatnonzero(first):
            mine = slice(at[i], at[i + 1])
            mark[ids[mine]] = weight[mine]
            both = np.add.reduceat(np.minimum(mark[ids[span]], weight[span]), heads)
            mark[ids[mine]] = 0
            other = (root[second] != root[i]) & ((root[second] == main) | (key[i] < key[second]))
            alike = second[other & (both >= threshold * (total[i] + total[second] - both))]
            found += [(keys[i], keys[j]) for j in alike]
        return pa.table({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([x for _, x in found], pa.binary())})

    return dealt.groupBy("band", "p", "q").applyInArrow(lambda table: _freed(compare, table), "a binary, b binary").distinct()


def _freed(step, table: pa.Table) -> pa.Table:
    out = step(table)
    release()
    return out


def text_classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """For each distinct text of docs (doc_id, text) that has a class of two rows or more: key, class_id (its least
    doc_id; 2^63 - 1 stands for null) and the key of the text that stands for the class (rep_key, the row with class_id)."""
    spark = docs.sparkSession
    plain = docs.select(_order_id().alias("doc_id"), "text").withColumn("key", text_key())
    shares = spark.sparkContext.broadcast(bucket_shares(plain))
    distinct = settle(_signed(plain, shares, bands, rows).groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("size").alias("size")))
    met = _met(distinct.select("key", F.explode("bands").alias("band")))
    stars = met.select("key", F.explode(F.array("mid", "side")).alias("mate")).filter("key != mate")
    candidates = settle(stars.groupBy("key", "mate").agg(F.count("*").alias("votes")))
    best = candidates.groupBy("key").agg(F.max(F.struct("votes", "mate")).alias("m")).select("key", F.col("m.mate").alias("mate"))
    pair = lambda df: df.select(F.least("key", "mate").alias("a"), F.greatest("key", "mate").alias("b")).distinct()
    nodes = candidates.select("key").union(candidates.select(F.col("mate").alias("key"))).distinct().join(distinct.select("key", "doc_id"), "key")
    texts = plain.filter(maybe_in(nodes)).join(nodes, ["key", "doc_id"], "left_semi").select("key", "text")
    texts = settle(texts.dropDuplicates(["key"]))
    sweep(spark)
    first_pairs = settle(pair(best))
    links = settle(_verified(first_pairs, texts, shares, threshold))
    joined = components(links)
    root = lambda c: F.coalesce(F.col(f"root_{c}"), F.col(c))
    of = lambda c: joined.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    rest = pair(candidates).join(first_pairs, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left").filter(root("a") != root("b"))
    more = settle(_verified(rest, texts, shares, threshold))
    joined = components(joined.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    more = settle(_in_cells(met, joined, distinct.select("key", "size"), texts, shares, threshold))
    sweep(spark)
    if not more.isEmpty():
        joined = components(joined.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    copies = plain.filter("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    every = copies.join(joined, copies["key"] == joined["node"], "left").select("key", "doc_id", "n", F.coalesce("root", "key").alias("root"))
    every = settle(every)
    heads = every.groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("head"), F.sum("n").alias("n")).filter("n > 1")
    return every.join(heads.select("root", "head"), "root").select("key", F.col("head.doc_id").alias("class_id"), F.col("head.key").alias("rep_key"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and class_id of each row of docs: the least doc_id among all rows that equal texts and verified links
    connect with it.

    Equal texts are one class whatever they hold; beyond that, a text without words has no near-duplicates, and a text
    with fewer words than a shingle has those with the same words. A null text is in a class of its own, which its
    doc_id names. A null doc_id names a class only if no other row does. Repeated rows each get a row.
    """
    members = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"))
    classes = text_classes(docs, threshold).select("key", "class_id")
    return members.join(classes, "key", "left").select("doc_id", F.nullif(F.coalesce("class_id", "doc_id"), F.lit(_LAST)).alias("class_id"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class: that with the least doc_id (of several with this doc_id, the one whose text
    has the least key; of equal ones any). Null texts stay."""
    classes = settle(text_classes(docs, threshold).withColumnRenamed("class_id", own("id")).withColumnRenamed("rep_key", own("rep")))
    columns = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]
    keyed = docs.select(*columns, _order_id().alias(own("doc")), text_key().alias("key"))
    grouped = keyed.withColumn(own("maybe"), maybe_in(classes))
    alone = grouped.filter(~F.col(own("maybe")))
    met = grouped.filter(own("maybe")).join(classes, "key", "left")
    is_rep = (F.col("key") == F.col(own("rep"))) & (F.col(own("doc")) == F.col(own("id")))
    heads = met.filter(is_rep).dropDuplicates(["key"])
    back = [F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)]
    return alone.select(*back).unionAll(met.filter(F.col(own("rep")).isNull()).select(*back)).unionAll(heads.select(*back))
