"""Language identification as inference of a mixture: a document may hold several languages.

Each language is a distribution over hashed byte trigrams of lower-cased words, counted over all training documents.
A word's likelihood in a language is that of its trigrams. Expectation-maximisation finds the language proportions of
each document from its words' likelihoods; the languages kept are those for which the penalised likelihood is best.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pu_classifier import fold
from .vectors import summed
from .words import Words, blocks, rows_of, split_words

_B = np.arange(256)
#: Words are runs of a-z and of characters from U+0080 up.
LETTERS = ((_B >= 0x61) & (_B <= 0x7A)) | (_B >= 0x80)
BUCKETS = 1 << 16
#: Entries of a model's table. With very many languages each has fewer buckets, so that the table keeps this size.
TABLE = 1 << 24
#: Entries of the matrix of words and languages that are held at once.
_CELLS = 1 << 21
UNKNOWN = "und"


def buckets_for(languages: int) -> int:
    """2^16 up to 256 languages, half of it for twice as many, and so on."""
    return max(1 << 8, min(BUCKETS, 1 << ((TABLE // max(languages, 1)).bit_length() - 1)))


def trigram_buckets(words: Words, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each trigram of each distinct word, a space on both sides; and the word of each trigram. buckets: a
    power of two."""
    sizes = np.diff(np.frombuffer(words.distinct.buffers()[1], np.int64)[words.distinct.offset : words.distinct.offset + len(words.distinct) + 1]) if len(words.distinct) else np.zeros(0, np.int64)
    total = int((sizes + 2).sum())
    data = np.full(total + 2, 32, np.uint32)
    head = np.cumsum(sizes + 2) - sizes - 2
    if len(sizes):
        raw = np.frombuffer(words.distinct.buffers()[2], np.uint8)[: int(sizes.sum())]
        at = np.arange(len(raw)) + np.repeat(2 * np.arange(len(sizes)) + 1, sizes)
        data[at] = raw
    of = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(head, sizes)
    gram = data[at] << 16 | data[at + 1] << 8 | data[at + 2]
    return ((gram * np.uint32(0x9E3779B1)) >> np.uint32(33 - buckets.bit_length())).astype(np.int64), of


def train(docs: DataFrame, languages: list[str]) -> np.ndarray:
    """Log probabilities (languages x buckets) from all rows of docs (lang, text) with one of the languages."""
    number = {name: k for k, name in enumerate(languages)}
    m, size = len(languages), buckets_for(len(languages))

    def totals(batches):
        out = np.zeros(m * size)
        for batch in batches:
            for part in blocks(batch, "text", 4 << 20):
                words = split_words(part.column("text"), LETTERS, lower=True)
                bucket, of = trigram_buckets(words, size)
                lang = np.array([number.get(x, -1) for x in part.column("lang").to_pylist()], np.int64)[words.doc]
                v = len(words.distinct)
                for k in np.unique(lang[lang >= 0]):
                    times = np.bincount(words.ids[lang == k], minlength=v)
                    out[k * size : (k + 1) * size] += np.bincount(bucket, weights=times[of], minlength=size)
        return out

    counts = summed(docs.select("lang", "text"), totals, m * size).reshape(m, size) + 0.5
    return np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


class _Likelihoods:
    """Of some distinct words, their likelihood in each language, scaled to a largest one of 1."""

    def __init__(self, words: Words, table: np.ndarray):
        self.table = table
        self.bucket, of = trigram_buckets(words, table.shape[1])
        self.heads = np.searchsorted(of, np.arange(len(words.distinct) + 1))

    def __call__(self, some: np.ndarray) -> np.ndarray:
        sizes = (self.heads[1:] - self.heads[:-1])[some]
        begin = np.cumsum(sizes) - sizes
        grams = self.bucket[np.arange(int(sizes.sum())) + np.repeat(self.heads[some] - begin, sizes)]
        out = np.stack([np.add.reduceat(row[grams], begin) for row in self.table], 1)
        return np.exp(np.maximum(out - out.max(axis=1, keepdims=True), -30.0))


def _em(parts, total: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log likelihood of each text. parts(): the texts' distinct words in order, as likelihoods, text
    and count of each; total: words of each text."""
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        new = np.zeros_like(share)
        for like, of, count in parts():
            joint = like * share[of]
            joint *= (count / joint.sum(axis=1))[:, None]
            heads = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            new[of[heads]] += np.add.reduceat(joint, heads, axis=0)
        share = new / total[:, None]
    fit = np.zeros(len(total))
    for like, of, count in parts():
        heads = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        fit[of[heads]] += np.add.reduceat(count * np.log((like * share[of]).sum(axis=1)), heads)
    return share, fit


def _sets(parts_of, total: np.ndarray, m: int, rounds: int, penalty: float) -> np.ndarray:
    """The proportions of each text's language set. parts_of(some): parts of these texts, see _em."""
    n = len(total)
    share, _ = _em(parts_of(np.arange(n)), total, np.ones((n, m)), rounds)
    order = np.argsort(-share, axis=1, kind="stable")
    best, value = np.zeros((n, m)), np.full(n, -np.inf)
    for size in range(1, m + 1):
        cost = penalty * (size - 1) * np.log(np.maximum(total, 2))
        left = np.flatnonzero(-cost > value - 1e-6)
        if not len(left):
            break
        allowed = np.zeros((len(left), m))
        np.put_along_axis(allowed, order[left, :size], 1.0, axis=1)
        some, fit = _em(parts_of(left), total[left], allowed, rounds if size > 1 else 0)
        fit = fit - cost[left]
        better = fit > value[left]
        best[left[better]], value[left[better]] = (some * allowed)[better], fit[better]
    return best / best.sum(axis=1, keepdims=True)


def infer(words: Words, table: np.ndarray, rounds: int = 8, penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """For each text its language set's proportions (texts x languages; 0 for languages outside), and whether it has
    any word. Sets are nested, by the proportions that all languages together give; the set's size is that with the
    best log likelihood less penalty x (size - 1) x ln(words). A text's search ends where a larger set's penalty alone
    is below the best value, as log likelihoods are never above 0.

    Texts are taken some at a time, by their distinct words; of a text with more words than fit, the likelihoods are
    made anew in parts for each round, so that memory does not grow with it.
    """
    n, m = len(words.first) - 1, len(table)
    out = np.zeros((n, m))
    if not words.n:
        return out, words.counts > 0
    v = len(words.distinct)
    keys, count = np.unique(words.doc * v + words.ids, return_counts=True)
    text, word = keys // v, keys % v
    likelihood, step = _Likelihoods(words, table), max(1, _CELLS // m)
    full = np.flatnonzero(words.counts > 0)
    cuts = np.append(np.searchsorted(text, full), len(text))
    begin = 0
    while begin < len(full):
        end = max(begin + 1, int(np.searchsorted(cuts, cuts[begin] + step, "right")) - 1)
        a, b = cuts[begin], cuts[end]
        if b - a <= step:
            distinct, at = np.unique(word[a:b], return_inverse=True)
            like, of = likelihood(distinct)[at], np.repeat(np.arange(end - begin), np.diff(cuts[begin : end + 1]))

            def parts_of(some, like=like, of=of, counts=count[a:b], k=end - begin):
                if len(some) == k:
                    return lambda: [(like, of, counts)]
                number = np.full(k, -1)
                number[some] = np.arange(len(some))
                at = number[of] >= 0
                chosen = like[at], number[of][at], counts[at]
                return lambda: [chosen]

        else:

            def parts_of(some, a=a, b=b):
                def parts():
                    for k in range(a, b, step):
                        e = min(b, k + step)
                        yield likelihood(word[k:e]), np.zeros(e - k, np.int64), count[k:e]

                return parts

        out[full[begin:end]] = _sets(parts_of, words.counts[full[begin:end]], m, rounds, penalty)
        begin = end
    return out, words.counts > 0


def identify(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the predicted language's proportion) and langs (the set, largest share
    first) of each row of docs (doc_id, text, lang).

    Learns from text and non-null lang of rows outside the held-out fold; a prediction sees the text only. Null texts
    and those without a letter are `und`, with score 0, as are all if there is nothing to learn from. Repeated rows
    count and are answered each by itself; texts of any length are read whole, in bounded memory; other columns do not
    matter. The driver holds one name for each language.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    languages = sorted(r[0] for r in known.select("lang").distinct().collect())
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    held = docs.sparkSession.sparkContext.broadcast(train(known, languages) if languages else None)

    def run(batches):
        table = held.value
        for batch in rows_of(batches):
            for part in blocks(batch, "text", 3 << 20):
                lettered = part.column("lettered").to_numpy(zero_copy_only=False)
                if table is None:
                    shares, has = np.zeros((part.num_rows, 1)), np.zeros(part.num_rows, bool)
                else:
                    shares, has = infer(split_words(part.column("text"), LETTERS, lower=True), table)
                has = has & lettered
                top = shares.argmax(axis=1)
                pred = [languages[k] if ok else UNKNOWN for k, ok in zip(top, has, strict=True)]
                sets = [[languages[k] for k in np.argsort(-row, kind="stable") if row[k] > 0] if ok else [] for row, ok in zip(shares, has, strict=True)]
                score = np.where(has, shares.max(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(pred, pa.string()), pa.array(np.clip(score, 0.0, 1.0)), pa.array(sets, pa.list_(pa.string()))], names=["doc_id", "lang_pred", "score", "langs"])

    found = chosen.mapInArrow(run, "doc_id long, lang_pred string, score double, langs array<string>")
    return found.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "lang_pred", "score", "langs")
