"""Brute-force versions and small corpora for the tests of this folder."""

import random
import re

LOWER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def words2(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def words7(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(seed, n, vocabulary=400):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}é" if k % 9 == 0 else f"W{draw.randrange(vocabulary)}" for k in range(n))


#: doc_id, text: nulls, empty and odd texts, ties, repeated rows and ids, shared passages.
SHARED = prose(99, 60)
DOCS = [
    (1, prose(1, 120)),
    (2, prose(1, 120)),
    (3, prose(3, 40) + " " + SHARED + "\n" + prose(4, 40)),
    (4, SHARED + " tail words here"),
    (5, None),
    (6, ""),
    (7, "   \n\t "),
    (8, "one"),
    (9, "one two three"),
    (9, "one two three"),
    (9, prose(5, 30) + " " + SHARED),
    (None, SHARED),
    (10, "x " * 400),
    (11, "!!! ### $$$"),
    (12, prose(6, 3000, 50)),
    (-3, prose(7, 20) + " " + " ".join(prose(1, 120).split()[30:60])),
]


def frame(spark, rows=DOCS, extra=True):
    """A documents table; extra: with columns whose names operators might use too."""
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    if not extra:
        return spark.createDataFrame(full, columns)
    clash = "shard long, home int, key string, anchor long, n_words string, kept string, spans string, c0 int, length string, bands int"
    return spark.createDataFrame([(*r, 7, 7, "k", 7, "n", "k", "s", 7, "l", 7) for r in full], f"{columns}, {clash}")
