"""Inverted index and BM25 ranking."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordering

K1, B = 1.2, 0.75
TOKEN = r"([\p{L}\p{N}]+)"


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 1)


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf and dl (all tokens of the document)."""
    split = docs.select(key, tokens(F.col(text)).alias("t")).withColumn("dl", F.size("t"))
    return split.select(key, "dl", F.explode("t").alias("term")).groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))


def corpus_size(docs: DataFrame, text: str) -> DataFrame:
    """One row: n (all documents) and avgdl."""
    return docs.select(F.size(tokens(F.col(text))).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def _idf(n: Column, df: Column) -> Column:
    idf = F.ln((n - df + 0.5) / (df + 0.5))
    return F.when(idf <= 0, 1e-6).otherwise(idf)


def _part(idf: Column, tf: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def bm25(docs: DataFrame, key: str, text: str, terms: list[str], k1: float = K1, b: float = B) -> DataFrame:
    """key and rank (lower is better, never above 0) of documents with any of the terms; key names a document. Only
    counts of the query's terms are made; an inverse document frequency at or below 0 counts as 1e-6.

    One pass over the texts: documents with a term come out by their key, all others as one row of sums, and both the
    statistics and the ranks read that small table."""
    wanted = sorted(set(terms))
    if not wanted:
        return docs.select(key, F.lit(0.0).alias("rank")).limit(0)
    split = docs.select(F.col(key).alias("k"), tokens(F.col(text)).alias("t")).withColumn("dl", F.size("t"))
    names = [f"tf{k}" for k in range(len(wanted))]
    counted = split.select("k", "dl", *((F.col("dl") - F.size(F.array_remove("t", w))).alias(n) for n, w in zip(names, wanted, strict=True)))
    any_hit = F.greatest(*names, F.lit(0)) > 0
    small = counted.groupBy(F.when(any_hit, F.col("k")).alias("k"), any_hit.alias("hit")).agg(F.count("*").alias("n"), F.sum("dl").alias("dl"), *(F.max(c).alias(c) for c in names))
    stats = small.agg(F.sum("n").alias("n"), (F.sum("dl") / F.sum("n")).alias("avgdl"), F.count("k").alias("hits"), F.count_if("hit").alias("hit"), *(F.count_if(F.col(c) > 0).alias(f"df{c}") for c in names))
    # A filter on sums stays above them: one on `hit` would go below, with tokens made again for each term, in a pass of its own.
    found = small.filter((F.greatest(*names, F.lit(0)) > 0) & (F.col("n") > 0)).select("k", F.col("n").alias("own"), "dl", *names).join(F.broadcast(stats.drop("hit")), how="cross")  # one row
    rank = F.lit(0.0)
    for c in names:
        rank = rank - _part(_idf(F.col("n"), F.col(f"df{c}")), F.col(c), F.col("dl") / F.col("own"), F.col("avgdl"), k1, b)
    return found.select(F.col("k").alias(key), rank.alias("rank"))


#: Documents of a term up to which all of them are scored for a query.
RARE = 1000


def bm25_each(docs: DataFrame, key: str, text: str, queries: DataFrame, most: int, k1: float = K1, b: float = B) -> DataFrame:
    """query, key and rank of the `most` best documents of each row of queries (query, terms): as bm25, for any number
    of queries in one pass. Only postings of the queries' terms are made; ties go by key.

    Documents with a term of at most RARE documents are scored for each query. Any other document of a query has its common
    terms only, and no more than the sum of what these give at most: queries whose `most` best are all above that are
    done. For the others, documents are ranked once by each distinct set of common terms, so pairs grow with these sets
    and not with the queries."""
    asked = queries.select("query", F.explode(F.array_distinct("terms")).alias("term"))
    split = docs.select(F.col(key).alias("k"), tokens(F.col(text)).alias("t")).withColumn("dl", F.size("t"))
    wanted = split.select("k", "dl", F.explode("t").alias("term")).join(asked.select("term").distinct(), "term", "left_semi").groupBy("k", "dl", "term").agg(F.count("*").alias("tf"))
    posted = ordering.settled(wanted.join(F.broadcast(corpus_size(docs, text)), how="cross").select("k", "term", "n", _part(F.lit(1.0), F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b).alias("weight")))  # one row
    terms = posted.groupBy("term").agg(F.count("*").alias("df"), F.first("n").alias("n"), F.max("weight").alias("weight"))
    terms = terms.select("term", "df", _idf(F.col("n"), F.col("df")).alias("idf"), "weight")
    weighed = ordering.settled(asked.join(terms, "term").select("query", "term", "df", "idf", (F.col("idf") * F.col("weight")).alias("bound")))

    def best(pairs: DataFrame, by: str, n: int) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(by).orderBy("rank", "k"))
        return pairs.withColumn("place", place).filter(F.col("place") <= n)

    rank = (-F.sum(F.col("idf") * F.col("weight"))).alias("rank")
    near = ordering.settled(posted.join(weighed.filter(F.col("df") <= RARE).select("query", "term"), "term").select("query", "k").distinct())
    scored = near.join(weighed.select("query", "term", "idf"), "query").join(posted, ["k", "term"]).groupBy("query", "k").agg(rank)
    first = ordering.settled(best(scored, "query", most).drop("place"))
    least = first.groupBy("query").agg(F.count("*").alias("found"), (-F.max("rank")).alias("least"))
    common = F.col("df") > RARE
    rest = weighed.groupBy("query").agg(F.coalesce(F.sum(F.when(common, F.col("bound"))), F.lit(0.0)).alias("rest"), F.array_sort(F.collect_list(F.when(common, F.struct("term", "idf")))).alias("common"))
    done = (F.col("rest") == 0) | ((F.col("found") >= most) & (F.col("least") > F.col("rest") * (1 + 1e-9)))
    left = rest.join(least, "query", "left").filter(~F.coalesce(done, F.lit(False))).join(near.groupBy("query").agg(F.count("*").alias("near")), "query", "left")
    # Of a set's ranking, a query needs as many more as it has documents that are scored already.
    left = ordering.settled(left.select("query", "common", F.sha2(F.to_json("common"), 256).alias("set"), (F.coalesce("near", F.lit(0)) + most).alias("need")))
    deepest = left.agg(F.max("need")).first()[0]
    if deepest is None:
        return best(first, "query", most).select("query", F.col("k").alias(key), "rank")
    sets = left.groupBy("set").agg(F.first("common").alias("common")).select("set", F.explode("common").alias("c")).select("set", "c.term", "c.idf")
    lists = ordering.met(best(posted.join(sets, "term").groupBy("set", "k").agg(rank), "set", deepest))
    others = left.join(lists, "set").filter(F.col("place") <= F.col("need")).select("query", "k", "rank").join(near, ["query", "k"], "left_anti")
    return best(first.unionByName(others), "query", most).select("query", F.col("k").alias(key), "rank")


POSTING_BUCKETS = 64
#: Postings that a bucket of a stored index is made for.
BUCKET_ROWS = 5_000_000


def bucket_of(term: Column, buckets: int = POSTING_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def stored_postings(docs: DataFrame, key: str, text: str, buckets: int = POSTING_BUCKETS) -> DataFrame:
    """Postings with the bucket of their term, to be written partitioned by it: a search then reads its terms' buckets."""
    return postings(docs, key, text).withColumn("bucket", bucket_of(F.col("term"), buckets))


def corpus_totals(docs: DataFrame, text: str) -> DataFrame:
    """One row: n (all documents) and tokens (of all), which can be added and taken off."""
    return docs.select(F.size(tokens(F.col(text))).cast("long").alias("dl")).agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("tokens"))


def bm25_stored(posted: DataFrame, size: DataFrame, key: str, terms: list[str], k1: float = K1, b: float = B, buckets: int = POSTING_BUCKETS) -> DataFrame:
    """As bm25, from stored postings and the corpus's size (one row: n and avgdl); no text is read. buckets: as the
    postings were stored with."""
    wanted = sorted(set(terms))
    if not wanted:
        return posted.select(key, F.lit(0.0).alias("rank")).limit(0)
    spark = posted.sparkSession
    found = sorted({r[0] for r in spark.createDataFrame([(w,) for w in wanted], "term string").select(bucket_of(F.col("term"), buckets)).collect()})
    hits = posted.filter(F.col("bucket").isin(*found) & F.col("term").isin(*wanted))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    scored = hits.join(F.broadcast(df), "term").join(F.broadcast(size), how="cross")  # a row a query term; one row
    return scored.groupBy(key).agg((-F.sum(_part(_idf(F.col("n"), F.col("df")), F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b))).alias("rank"))


def top_k(ranked: DataFrame, k: int, *tie: str) -> DataFrame:
    """The k best rows by rank; ties by the given columns."""
    return ranked.orderBy(F.col("rank").asc(), *tie).limit(max(1, min(k, 50)))


_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")


def _is_consonant(word: str, k: int) -> bool:
    c = word[k]
    return c not in "aeiou" and (c != "y" or k == 0 or not _is_consonant(word, k - 1))


def _measure(stem: str) -> int:
    form = "".join("c" if _is_consonant(stem, k) else "v" for k in range(len(stem)))
    return sum(a == "v" and b == "c" for a, b in zip(form, form[1:], strict=False))


def _short(stem: str) -> bool:
    n = len(stem)
    return n >= 3 and _is_consonant(stem, n - 1) and not _is_consonant(stem, n - 2) and _is_consonant(stem, n - 3) and stem[-1] not in "wxy"


# Suffixes and replacements of Porter's algorithm (1980), steps 2 to 4.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def porter(word: str) -> str:
    """Porter's stem of a lower-case English word; words with other letters stay."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    has_vowel = lambda s: any(not _is_consonant(s, k) for k in range(len(s)))
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]):
            word = word[:-1]
    else:
        for end in ("ed", "ing"):
            if word.endswith(end):
                if has_vowel(stem := word[: -len(end)]):
                    word = stem
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif word.endswith(_DOUBLES):
                        word = word[:-1]
                    elif _measure(word) == 1 and _short(word):
                        word += "e"
                break
    if word.endswith("y") and has_vowel(word[:-1]):
        word = word[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end in sorted(table, key=len, reverse=True):
            if word.endswith(end):
                if _measure(word[: -len(end)]):
                    word = word[: -len(end)] + table[end]
                break
    for end in sorted(_STEP4, key=len, reverse=True):
        if word.endswith(end):
            stem = word[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _short(stem)):
            word = stem
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def _fold(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def stem_vocabulary(terms: DataFrame) -> DataFrame:
    """term and stem of each distinct term: Python sees the vocabulary, not the postings."""

    @F.pandas_udf("string")
    def stem(words: pd.Series) -> pd.Series:
        return words.map(lambda w: porter(_fold(w)))

    return terms.select("term").distinct().withColumn("stem", stem("term"))


def bm25_stemmed(docs: DataFrame, key: str, text: str, terms: list[str], k1: float = K1, b: float = B) -> DataFrame:
    """As bm25, over stems of accent-free terms."""
    wanted = sorted({porter(_fold(t.lower())) for t in terms})
    if not wanted:
        return docs.select(key, F.lit(0.0).alias("rank")).limit(0)
    # A stem but for its last letter begins every word that has it, accents aside: only such words are counted and stemmed.
    likely = F.lit(False)
    for n in {max(1, len(stem) - 1) for stem in wanted}:
        begin = F.substring("term", 1, n)
        likely = likely | begin.isin(*(stem[:n] for stem in wanted if max(1, len(stem) - 1) == n)) | begin.rlike(r"[^\x00-\x7F]")
    # One pass over the texts: each document also gives a row with the empty term, of which the corpus's size is made.
    split = docs.select(key, tokens(F.col(text)).alias("t")).withColumn("dl", F.size("t"))
    every = split.select(key, "dl", F.explode(F.concat(F.coalesce("t", F.array().cast("array<string>")), F.array(F.lit("")))).alias("term"))
    posted = ordering.settled(every.filter(likely | (F.col("term") == "")).groupBy(key, "dl", "term").agg(F.count("*").alias("tf")))
    size = posted.filter("term = ''").agg(F.sum("tf").alias("n"), (F.sum(F.col("dl") * F.col("tf")) / F.sum(F.when(F.col("dl").isNotNull(), F.col("tf")))).alias("avgdl"))
    # Written down, as a filter on stems would go below the distinct terms, and each posting be stemmed.
    stems = ordering.met(ordering.settled(stem_vocabulary(posted.filter("term != ''"))).filter(F.col("stem").isin(*wanted)))
    hits = posted.join(stems, "term").groupBy(key, "dl", "stem").agg(F.sum("tf").alias("tf"))
    df = hits.groupBy("stem").agg(F.count("*").alias("df"))
    scored = hits.join(F.broadcast(df), "stem").join(F.broadcast(size), how="cross")  # a row a query term; one row
    part = _part(_idf(F.col("n"), F.col("df")), F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)
    return scored.groupBy(key).agg((-F.sum(part)).alias("rank"))
