"""A quality classifier by positive-unlabelled learning.

Texts become a few dozen counts and shares, kept as a small table. A piecewise-linear basis of them feeds a linear
model g that minimises the non-negative unbiased risk (du Plessis and others, 2015; Kiryo and others, 2017) with
squared loss: trusted positives are rows labelled 1, and every document is unlabelled text. With this loss the risk
needs the first and second moments of the basis only, and they are taken over all rows.

The class prior is estimated from the same two sets, as the proportion of the positives in the mixture: a linear
score tells half of the positives from the unlabelled text, and over its thresholds the least ratio of the shares of
unlabelled text and of the other positives above it bounds the prior (the best bin of Garg and others, 2021). Rows
labelled 0 are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import settle
from .quality_rules import _dup_lines, _repeat_words
from .vectors import summed
from .words import NON_SPACE, blocks, column_bytes, per_doc, rows_of, split_words

_B = np.arange(256)
_CLASSES = {
    "upper": (_B >= 65) & (_B <= 90),
    "lower": (_B >= 97) & (_B <= 122),
    "digit": (_B >= 48) & (_B <= 57),
    "wide": _B >= 0xC0,
    "space": (_B == 32) | (_B == 9),
    "line": _B == 10,
    "stop": _B == 46,
    "comma": _B == 44,
    "bar": _B == 124,
    "shout": _B == 33,
    "ask": _B == 63,
    "symbol": np.isin(_B, np.frombuffer(b"#*$%&<>@^~=+\\/_", np.uint8)),
    "bracket": np.isin(_B, np.frombuffer(b"()[]{}", np.uint8)),
    "other": np.isin(_B, np.frombuffer(b"-:;\"'`", np.uint8)),
}
_SHARE_KNOTS = np.array([0.0, 0.002, 0.006, 0.015, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.45, 0.6, 0.8, 1.0])
_SIZE_KNOTS = np.arange(0.0, 15.0)
STATS = [*_CLASSES, "short_words", "capital_words", "ended_words", "odd_words", "dup_lines", "repeat_words", "top_word", "ratio", "distinct", "log_bytes", "log_words", "word_length", "log_line_words", "log_sentence_words"]
_SIZES = {"log_bytes", "log_words", "word_length", "log_line_words", "log_sentence_words"}
_KNOTS = [_SIZE_KNOTS if s in _SIZES else _SHARE_KNOTS for s in STATS]
DIMENSION = 1 + sum(map(len, _KNOTS))


def _top_share(ids: np.ndarray, words) -> tuple[np.ndarray, np.ndarray]:
    """For each text, the share of its most frequent word, and of distinct words."""
    n = len(words.first) - 1
    if not words.n:
        return np.zeros(n), np.zeros(n)
    pairs, counts = np.unique(words.doc * (int(ids.max()) + 1) + ids, return_counts=True)
    of = pairs // (int(ids.max()) + 1)
    top = np.zeros(n)
    np.maximum.at(top, of, counts)
    size = np.maximum(words.counts, 1)
    return top / size, np.bincount(of, minlength=n) / size


def text_stats(texts) -> np.ndarray:
    """A row of STATS for each text; all 0 for empty and null ones but for what is a constant."""
    words = split_words(texts, NON_SPACE)
    data, at = column_bytes(texts)
    n = len(at) - 1
    size, count = np.maximum(np.diff(at), 1), np.maximum(words.counts, 1)
    lengths = words.ends - words.starts
    first, last = (data[words.starts], data[words.ends - 1]) if words.n else (data, data)
    share = {c: per_doc(t[data], at) / size for c, t in _CLASSES.items()}
    by_word = lambda flag: per_doc(flag, words.first) / count
    share["short_words"] = by_word(lengths <= 3)
    share["capital_words"] = by_word(_CLASSES["upper"][first])
    share["ended_words"] = by_word(np.isin(last, np.frombuffer(b".!?", np.uint8)))
    share["odd_words"] = by_word(~(_CLASSES["lower"] | _CLASSES["upper"] | (_B >= 0x80))[first])
    lines = per_doc(data == 10, at) + 1
    share["dup_lines"] = _dup_lines(words, at) / lines
    share["repeat_words"] = _repeat_words(words) / count
    share["top_word"], share["distinct"] = _top_share(words.ids, words)
    squeeze, view = zstandard.ZstdCompressor(level=1).compress, memoryview(data)
    share["ratio"] = np.array([min(1.0, len(squeeze(view[a:b])) / (b - a)) if b > a else 0.0 for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
    share["log_bytes"], share["log_words"] = np.log(size), np.log(count)
    share["word_length"] = np.minimum(14.0, per_doc(NON_SPACE[data], at) / count)
    share["log_line_words"] = np.log(count / lines)
    share["log_sentence_words"] = np.log(count / (per_doc(_CLASSES["stop"][data], at) + 1))
    return np.stack([np.asarray(share[s], np.float64).reshape(n) for s in STATS], 1).astype(np.float32)


def basis(stats: np.ndarray) -> np.ndarray:
    """Hat functions at fixed knots for each count or share, and a constant."""
    out = [np.ones((len(stats), 1))]
    for k, knots in enumerate(_KNOTS):
        x = np.clip(stats[:, k].astype(np.float64), knots[0], knots[-1])
        at = np.clip(np.searchsorted(knots, x, "right") - 1, 0, len(knots) - 2)
        part = (x - knots[at]) / (knots[at + 1] - knots[at])
        hat = np.zeros((len(x), len(knots)))
        rows = np.arange(len(x))
        hat[rows, at], hat[rows, at + 1] = 1 - part, part
        out.append(hat)
    return np.concatenate(out, axis=1)


def _moments(stats: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, and the means of the basis and of its products."""
    d = DIMENSION

    def totals(batches):
        out = np.zeros(1 + d + d * d)
        for batch in batches:
            flat = batch.column("stats").flatten().to_numpy().reshape(batch.num_rows, -1)
            for k in range(0, len(flat), 4096):
                x = basis(flat[k : k + 4096])
                out[0] += len(x)
                out[1 : 1 + d] += x.sum(axis=0)
                out[1 + d :] += (x.T @ x).ravel()
        return out

    found = summed(stats.select("stats"), totals, 1 + d + d * d)
    n = max(found[0], 1.0)
    return int(found[0]), found[1 : 1 + d] / n, found[1 + d :].reshape(d, d) / n


@dataclass
class Model:
    weights: np.ndarray
    prior: float
    positives: int

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((basis(stats) @ self.weights + 1) / 2, 0.0, 1.0)


def risks(w: np.ndarray, prior: float, mean_p, square_p, mean_u, square_u) -> tuple[float, float]:
    """The estimated risk on positives (times the prior) and on negatives, with loss (1 - y g)^2 / 4."""
    loss = lambda y, m, s: (w @ s @ w - 2 * y * (w @ m) + 1) / 4
    return prior * loss(1, mean_p, square_p), loss(-1, mean_u, square_u) - prior * loss(-1, mean_p, square_p)


def minimise(prior: float, mean_p: np.ndarray, square_p: np.ndarray, mean_u: np.ndarray, square_u: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """The weights of least non-negative risk: that on positives plus that on negatives, where the latter counts as 0
    if its estimate is less. As max(0, b) is the largest share x b for shares of 0 to 1, the weights are those of least
    a + share x b: with share 1 (the unbiased risk) where b is not negative there, else with the largest share, found
    by halving, at which it is not."""
    d = len(mean_p)

    def least(share):
        system = prior * (1 - share) * square_p + share * square_u + ridge * np.eye(d)
        return np.linalg.solve(system, prior * (1 + share) * mean_p - share * mean_u)

    negative = lambda w: risks(w, prior, mean_p, square_p, mean_u, square_u)[1]
    w = least(1.0)
    if negative(w) >= 0:
        return w
    low, high = 0.0, 1.0
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if negative(least(middle)) >= 0 else (low, middle)
    return least(low)


def best_bin(positive: np.ndarray, unlabelled: np.ndarray, certainty: float = 0.1, slack: float = 0.01) -> float:
    """An upper estimate of the share of positives in unlabelled text, from histograms of both over one score: the
    ratio of their shares above the threshold at which the ratio's upper confidence bound is least."""
    n_p, n_u = positive.sum(), unlabelled.sum()
    tail_p, tail_u = (np.cumsum(x[::-1])[::-1] / max(x.sum(), 1.0) for x in (positive, unlabelled))
    doubt = sum((np.log(4 / certainty) / (2 * max(n, 1.0))) ** 0.5 for n in (n_p, n_u))
    has = tail_p > 0
    bound = (tail_u[has] + (1 + slack) * doubt) / tail_p[has]
    return float(np.clip((tail_u[has] / tail_p[has])[bound.argmin()], 0.01, 0.99)) if has.any() else 0.5


_BINS = 4096


def _histogram(stats: DataFrame, weights: np.ndarray) -> np.ndarray:
    """Rows in bins of equal width over scores from -2 to 2."""

    def totals(batches):
        out = np.zeros(_BINS)
        for batch in batches:
            flat = batch.column("stats").flatten().to_numpy().reshape(batch.num_rows, -1)
            for k in range(0, len(flat), 4096):
                score = basis(flat[k : k + 4096]) @ weights
                out += np.bincount(np.clip((score + 2) * (_BINS / 4), 0, _BINS - 1).astype(np.int64), minlength=_BINS)
        return out

    return summed(stats.select("stats"), totals, _BINS)


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """stats: doc_id and stats of all documents (the unlabelled text); labels: doc_id and a 0/1 label. Only rows
    labelled 1 are read, each doc_id once, however often it is labelled; each document row with such a doc_id is a
    positive. Without any, every score is one half."""
    trusted = labels.filter(F.col(label).cast("int") == 1).select("doc_id").filter(F.col("doc_id").isNotNull()).distinct()
    positives = settle(stats.join(trusted, "doc_id"))
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)) == 0
    n_a, mean_a, square_a = _moments(positives.filter(half))
    n_b, mean_b, square_b = _moments(positives.filter(~half))
    n_p = n_a + n_b
    if not n_p:
        return Model(np.zeros(DIMENSION), 0.5, 0)
    _, mean_u, square_u = _moments(stats)
    mean_p, square_p = ((n_a * a + n_b * b) / n_p for a, b in ((mean_a, mean_b), (square_a, square_b)))
    if not n_a or not n_b:  # a single positive or so: nothing to tell a mixture by
        return Model(minimise(0.5, mean_p, square_p, mean_u, square_u), 0.5, n_p)
    telling = np.linalg.solve(square_a + square_u + 1e-2 * np.eye(DIMENSION), mean_a - mean_u)
    prior = best_bin(_histogram(positives.filter(~half), telling), _histogram(stats, telling))
    return Model(minimise(prior, mean_p, square_p, mean_u, square_u), prior, n_p)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def stats_table(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in rows_of(batches):
            for part in blocks(batch, "text", 4 << 20):
                flat = text_stats(part.column("text"))
                offsets = pa.array(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(flat.ravel()))], names=["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, stats array<float>")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out (fold 0), score and predicted of each row of docs. Labels of fold 0 are never read.

    Every whole text gets a score, null and empty ones too (their stats are 0), and every repeated row its own. Without
    any positive label all scores are one half. Of labels only doc_id and the label are read."""
    stats = settle(stats_table(docs))
    model = fit(stats, labels.filter(fold(F.col("doc_id"), folds) != 0), label)

    def run(batches):
        for batch in rows_of(batches):
            flat = batch.column("stats").flatten().to_numpy().reshape(batch.num_rows, -1)
            score = np.concatenate([model.score(flat[k : k + 4096]) for k in range(0, len(flat), 4096)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
