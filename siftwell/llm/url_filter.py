"""URL rules by Bloom filter cascades, in DataFrame and SQL functions only.

A rule is a host and a path prefix. The candidate keys of a url are the suffixes of its host at label borders with
the prefixes of its path that are as long as some rule's path. A cascade tells which candidates are listed: level 1
encodes the listed keys; level 2 those keys of the corpus that level 1 takes wrongly; level 3 the listed keys that
level 2 takes, and so on until no false positive is left. A key belongs to the list if the first level that misses it
is an even one. As the false positives are taken over every key that the corpus has, the answer is exact for all of
them, and the lookup needs no join: the levels' bits are literals of the plan, of a size that the list bounds. A long
list is cut by its keys' hash into several cascades; each is looked up in a plan of its own, so that no plan holds the
bits of two.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import own, settle

#: Bits in the first level of a cascade; a longer list is cut into several ones.
MAX_BITS = 1 << 26


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass
class Cascade:
    """levels: (bits as 64-bit words, number of bits, hashes, seed) each."""

    levels: list[tuple[list[int], int, int, int]] = field(default_factory=list)


def _places(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    """Bit places by double hashing of two seeded 64-bit hashes."""
    a, b = F.xxhash64(F.lit(2 * seed), key), F.xxhash64(F.lit(2 * seed + 1), key)
    low = F.shiftrightunsigned(a, 33)
    step = F.shiftrightunsigned(b, 33).bitwiseOR(F.lit(1).cast("long"))
    return [F.pmod(low + step * F.lit(k).cast("long"), F.lit(bits).cast("long")) for k in range(hashes)]


def _level(keys: DataFrame, n: int, per_key: float, seed: int) -> tuple[list[int], int, int, int]:
    bits = max(64, 64 * -(-int(n * per_key) // 64))
    hashes = max(1, round(0.693 * bits / max(n, 1))) if per_key < 4 else max(1, round(0.693 * per_key))
    hashes = min(hashes, 7)
    spread = keys.select(F.explode(F.array(*_places(F.col("key"), bits, hashes, seed))).alias("bit"))
    word = F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))")
    words = [0] * (bits // 64)
    for at, value in spread.groupBy((F.col("bit") / 64).cast("long").alias("at")).agg(word.alias("value")).collect():
        words[at] = value
    return words, bits, hashes, seed


def _in_level(key: Column, level: tuple[list[int], int, int, int]) -> Column:
    words, bits, hashes, seed = level
    table = F.lit(words).cast("array<bigint>")
    found = F.lit(True)
    for place in _places(key, bits, hashes, seed):
        word = F.element_at(table, ((place / 64).cast("int") + 1))
        found = found & (F.call_function("shiftrightunsigned", word, (place % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
    return found


def contains(key: Column, cascade: Cascade) -> Column:
    """Exact for every listed key and every key of the universe that the cascade was built over."""
    if not cascade.levels:
        return F.lit(False)
    inside = F.lit(len(cascade.levels) % 2 == 1)
    for k in range(len(cascade.levels) - 1, -1, -1):
        inside = F.when(~_in_level(key, cascade.levels[k]), F.lit(k % 2 == 1)).otherwise(inside)
    return inside


def build_cascade(listed: DataFrame, universe: DataFrame, per_key: float = 10.0, later: float = 3.0) -> Cascade:
    """listed and universe: one column, key (string). Only keys of the universe that a level takes wrongly are ever
    gathered, each once. Every level has hash functions of its own and takes a fixed share wrongly at most; after many
    levels it gets more bits for each key, so the cascade ends."""
    listed = listed.select("key").filter(F.col("key").isNotNull()).distinct()
    n = listed.count()
    out = Cascade()
    if not n:
        return out
    out.levels.append(_level(listed, n, per_key, 1))
    wrong = settle(universe.select("key").filter(_in_level(F.col("key"), out.levels[0])).distinct().join(listed, "key", "left_anti"))
    inner, outer = wrong, listed  # to encode next; what the next level may take wrongly
    while (n := inner.count()) > 0:
        level = _level(inner, n, later * (1 + len(out.levels) // 16), len(out.levels) + 1)
        out.levels.append(level)
        inner, outer = settle(outer.filter(_in_level(F.col("key"), level))), inner
    return out


def parts_of(n: int, per_key: float = 10.0, most: int | None = None) -> int:
    """Into how many cascades a list of n keys is cut."""
    return max(1, -(-int(n * per_key) // (most or MAX_BITS)))


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("part"), key), F.lit(parts))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def _candidates(host: Column, path: Column, lengths: list[int], labels: int) -> Column:
    """All keys of a url that a rule could have: the suffixes of its host with as many labels as some rule's host has
    at most, with the prefixes of its path. However long a url is, their number depends on the rules alone."""
    found = F.split(host, r"\.")
    last = F.slice(found, -F.least(F.size(found), F.lit(labels)), F.lit(labels))
    suffixes = F.transform(F.sequence(F.lit(1), F.size(last)), lambda k: F.array_join(F.slice(last, k, F.size(last)), "."))

    def with_prefix(n: int) -> Column:
        fitting = F.when(F.length(path) >= n, suffixes).otherwise(F.array().cast("array<string>"))
        return F.transform(fitting, lambda s: F.concat(s, F.lit("\n"), F.substr(path, F.lit(1), F.lit(n))))

    return _longest_first(F.concat(*(with_prefix(n) for n in lengths)))


def _longest_first(keys: Column) -> Column:
    """Of equally long keys that with the longer host comes first."""
    rank = F.transform(keys, lambda k: F.struct((-F.length(k)).alias("size"), F.instr(k, "\n").alias("host") * -1, k.alias("key")))
    return F.transform(F.array_sort(rank), lambda x: x["key"])


def filter_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", url: str = "url", most_bits: int | None = None) -> DataFrame:
    """The rows of pages with host, path, rule (host and path of the longest rule that fits the url; null: none) and
    verdict (the rule's; else the default). Columns of these names are replaced. Of rules with one host and path the
    last counts. A null url, or one without ://, has an empty host and path and no rule but one for the empty host.
    Urls of any length and repeated rows are judged alike. most_bits: see MAX_BITS."""
    spark = pages.sparkSession
    by_key = {f"{r.host}\n{r.path}": r for r in rules}
    lengths = sorted({len(r.path) for r in rules})
    names = {"host": host_of(F.col(url)), "path": path_of(F.col(url))}
    parted = pages.drop("rule", "verdict").withColumns(names)
    if not rules:
        return parted.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    keys, hits, blocks = own("keys"), own("hits"), own("blocks")
    labels = max(r.host.count(".") + 1 for r in rules)
    found = parted.withColumn(keys, _candidates(F.col("host"), F.col("path"), lengths, labels))
    universe = found.select(F.explode(keys).alias("key"))
    listed = _keys(spark, list(by_key))
    block = _keys(spark, [k for k, r in by_key.items() if r.verdict == "block"])
    parts = parts_of(len(by_key), most=most_bits)
    for k in range(parts):
        mine = (lambda key, k=k: _part(key, parts) == k) if parts > 1 else (lambda key: F.lit(True))
        any_rule = build_cascade(listed.filter(mine(F.col("key"))), universe.filter(mine(F.col("key"))))
        blocked = build_cascade(block.filter(mine(F.col("key"))), listed.filter(mine(F.col("key"))))
        if parts == 1:  # the first hit is the longest
            found = found.withColumn(hits, F.slice(F.filter(keys, lambda key: contains(key, any_rule)), 1, 1))
            found = found.withColumn(blocks, F.when(F.size(hits) > 0, contains(F.get(hits, F.lit(0)), blocked)))
        else:
            new = F.filter(keys, lambda key: mine(key) & contains(key, any_rule))
            old = F.col(hits) if k else F.array().cast("array<string>")
            found = found.withColumn(hits, F.slice(_longest_first(F.concat(old, new)), 1, 1))
            best = F.get(hits, F.lit(0))
            found = settle(found.withColumn(blocks, F.when(mine(best), contains(best, blocked)).otherwise(F.col(blocks) if k else F.lit(None).cast("boolean"))))
    verdict = F.when(F.size(hits) == 0, F.lit(default)).when(F.col(blocks), F.lit("block")).otherwise(F.lit("allow"))
    return found.withColumns({"rule": F.replace(F.get(hits, F.lit(0)), F.lit("\n"), F.lit("")), "verdict": verdict}).drop(keys, hits, blocks)


def _keys(spark: SparkSession, keys: list[str]) -> DataFrame:
    return spark.createDataFrame([(k,) for k in keys], "key string")
