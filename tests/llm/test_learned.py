import zlib

import numpy as np

from siftwell.llm import language_id, pu_classifier

from .helpers import DOCS, frame, prose


def test_quality_held_out_accuracy(spark):
    rows, labels = [], []
    for k in range(240):
        good = k % 4 != 0
        text = prose(k, 80 + k % 50) + "." if good else " | ".join(prose(k, 80).upper().split()) + " ###"
        rows.append((k, text))
        labels.append((k, int(good), 0))
    rows += [(i, t) for i, t in DOCS if i is None or i >= 240 or not t]
    label = spark.createDataFrame([*labels, (1, None, None)], "doc_id long, quality int, toxic int")
    got = pu_classifier.classify(frame(spark, rows), label).collect()
    assert len(got) == len(rows)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth and r["doc_id"] not in (5, 6, 7)]
    assert len(held) > 20 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.9
    for r in got:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["held_out"] == (zlib.crc32(key.encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_quality_ignores_held_out_labels_and_empty_tables(spark):
    rows = [(k, prose(k, 60)) for k in range(40)]
    labels = [(k, 1 if k % 3 else 0) for k in range(40)]
    other = [(k, 1 - q if zlib.crc32(str(k).encode()) % 5 == 0 else q) for k, q in labels]
    run = lambda some: sorted(map(tuple, pu_classifier.classify(frame(spark, rows), spark.createDataFrame(some, "doc_id long, quality int")).collect()))
    assert run(labels) == run(other)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in pu_classifier.classify(frame(spark, rows), none).collect()} == {0.5}
    assert pu_classifier.classify(frame(spark, []), none).count() == 0


def test_risk_stays_non_negative():
    """Where the unbiased risk would go below 0 on negatives, the fit stops at 0, and no other weights do better. Only
    with so few rows that the fit of the positives alone has it below 0 does that fit stand."""
    draw = np.random.default_rng(0)
    moments = lambda a: (a.mean(axis=0), a.T @ a / len(a))
    held, alone = 0, 0
    for rows, prior in ((6, 0.9), (12, 0.7), (60, 0.95), (80, 0.9), (150, 0.97), (400, 0.5)):
        x = draw.normal(size=(2 * rows, 40)) + 0.3
        given = (prior, *moments(x[:rows]), *moments(x))
        w = pu_classifier.minimise(*given, ridge=1e-6)
        positive, negative = pu_classifier.risks(w, *given)
        plain = np.linalg.solve(given[4] + 1e-6 * np.eye(40), 2 * prior * given[1] - given[3])
        of_positives = np.linalg.solve(prior * given[2] + 1e-6 * np.eye(40), prior * given[1])
        if pu_classifier.risks(of_positives, *given)[1] < 0:
            alone += 1
        else:
            assert negative >= -1e-9
            held += pu_classifier.risks(plain, *given)[1] < 0
        value = positive + max(0.0, negative) + 5e-7 * w @ w / 2
        for other in (plain, of_positives, 0 * w, *(w + draw.normal(size=(200, 40)) * 10.0 ** draw.uniform(-4, 0, (200, 1)))):
            a, b = pu_classifier.risks(other, *given)
            assert a + max(0.0, b) + 5e-7 * other @ other / 2 >= value - 1e-7
    assert held >= 2 and alone >= 1


def test_risks_are_those_of_the_rows():
    draw = np.random.default_rng(1)
    x, y, w = draw.normal(size=(30, 5)), draw.normal(size=(80, 5)), draw.normal(size=5)
    moments = lambda a: (a.mean(axis=0), a.T @ a / len(a))
    positive, negative = pu_classifier.risks(w, 0.6, *moments(x), *moments(y))
    assert np.isclose(positive, 0.6 * np.mean((1 - x @ w) ** 2) / 4)
    assert np.isclose(negative, np.mean((1 + y @ w) ** 2) / 4 - 0.6 * np.mean((1 + x @ w) ** 2) / 4)


def test_prior_is_that_of_the_mixture():
    draw = np.random.default_rng(2)
    for prior in (0.2, 0.5, 0.9):
        good, bad = draw.normal(1, 0.4, 60000), draw.normal(-1, 0.4, 60000)
        mixed = np.where(draw.random(60000) < prior, good, bad)
        bins = lambda a: np.histogram(a, 400, (-4, 4))[0].astype(float)
        assert abs(pu_classifier.best_bin(bins(draw.normal(1, 0.4, 20000)), bins(mixed)) - prior) < 0.03
    assert pu_classifier.best_bin(np.zeros(5), np.ones(5)) == 0.5


def test_labels_of_bad_documents_are_not_read(spark):
    """Zeros, repeated labels and other columns of labels change nothing."""
    rows = [(k, prose(k, 60) if k % 5 else "| x " * 60) for k in range(200)]
    ones = [(k, 1, "a") for k in range(0, 200, 3) if k % 5]
    more = ones + ones + [(k, 0, "b") for k in range(0, 200, 5)] + [(None, 1, "c"), (10**6, 1, "d")]
    run = lambda some: sorted(map(tuple, pu_classifier.classify(frame(spark, rows + rows[:9]), spark.createDataFrame(some, "doc_id long, quality int, text string")).collect()))
    got = run(ones)
    assert len(got) == 209
    assert np.allclose([r[2] for r in got], [r[2] for r in run(more)], atol=1e-6)


WORDS = {"aa": "the of and thing with that ing tion", "bb": "les des une ment eau oui dans", "cc": "und der nicht ung schen ich"}


def speech(lang, seed, n=60):
    draw = np.random.default_rng(seed)
    return " ".join(draw.choice(WORDS[lang].split()) for _ in range(n))


def test_languages(spark):
    docs = [(k, speech(lang, k, 5 + k % 60), lang) for k, lang in enumerate(["aa", "bb", "cc"] * 60)]
    docs += [(900, None, "aa"), (901, "", "bb"), (902, "123 !!", "cc"), (903, "the of and", None), (904, speech("aa", 5, 40) + " " + speech("bb", 6, 60), "bb"), (904, "éàü", "aa"), (None, "der nicht", None)]
    table = spark.createDataFrame([(i, t, lang, "x") for i, t, lang in docs], "doc_id long, text string, lang string, langs string")
    got = language_id.identify(table).collect()
    assert len(got) == len(docs)
    by = {r["doc_id"]: r for r in got if r["doc_id"] != 904}
    held = [(by[i]["lang_pred"], lang) for i, t, lang in docs if i is not None and i < 900 and by[i]["held_out"]]
    assert held and np.mean([a == b for a, b in held]) > 0.95
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (900, 901, 902))
    assert by[903]["lang_pred"] == "aa" and by[None]["lang_pred"] == "cc"
    mixed = next(r for r in got if r["doc_id"] == 904 and len(r["langs"]) > 1)
    assert mixed["langs"] == ["bb", "aa"] and 0.5 < mixed["score"] < 0.7
    for r in got:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["held_out"] == (zlib.crc32(key.encode()) % 4 == 2) and 0 <= r["score"] <= 1


def test_nothing_to_learn_from(spark):
    assert language_id.identify(frame(spark, [])).count() == 0
    from pyspark.sql import functions as F

    none = frame(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.identify(none).collect()} == {"und"}


def test_long_texts_in_parts_and_many_languages(monkeypatch):
    import pyarrow as pa

    from siftwell.llm.words import split_words

    split = lambda texts: split_words(pa.array(texts, pa.large_string()), language_id.LETTERS, lower=True)
    draw = np.random.default_rng(1)
    table = np.log(draw.dirichlet(np.ones(language_id.BUCKETS), 5)).astype(np.float32)
    texts = ["", *(" ".join("".join(draw.choice(list("abcdefé"), 4)) for _ in range(n)) for n in (1, 3, 40, 900)), "12", "abc abc abc"]
    whole, has = language_id.infer(split(texts), table)
    for cells in (5, 60, 700):
        monkeypatch.setattr(language_id, "_CELLS", cells)
        some, _ = language_id.infer(split(texts), table)
        assert np.allclose(whole, some)
    assert has.tolist() == [False, True, True, True, True, False, True]
    assert language_id.buckets_for(4) == 1 << 16 and language_id.buckets_for(7000) * 7000 <= language_id.TABLE


def plain_mixture(text, table, rounds=8):
    """The mixture of one text word by word, without vectors."""
    import math

    from .helpers import LOWER

    raw = text.translate(LOWER).encode()
    found = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in raw).split()
    if not found:
        return [0.0] * len(table)
    rows = []
    for w in found:
        g = b" " + w + b" "
        gram = [((g[k] << 16 | g[k + 1] << 8 | g[k + 2]) * 0x9E3779B1 % 2**32) >> 16 for k in range(len(w))]
        logs = [math.fsum(float(lang[x]) for x in gram) for lang in table]
        rows.append([math.exp(max(x - max(logs), -30)) for x in logs])

    def em(allowed, rounds):
        share = [1 / len(allowed) if k in allowed else 0.0 for k in range(len(table))]
        for _ in range(rounds):
            total = [0.0] * len(table)
            for r in rows:
                joint = [a * b for a, b in zip(r, share, strict=True)]
                for k, x in enumerate(joint):
                    total[k] += x / sum(joint)
            share = [x / len(rows) for x in total]
        return share, sum(math.log(sum(a * b for a, b in zip(r, share, strict=True))) for r in rows)

    share, _ = em(range(len(table)), rounds)
    order = sorted(range(len(table)), key=lambda k: (-share[k], k))
    best, value = None, -math.inf
    for size in range(1, len(table) + 1):
        some, fit = em(order[:size], rounds if size > 1 else 0)
        fit -= (size - 1) * math.log(max(len(rows), 2))
        if fit > value:
            best, value = some, fit
    return [x / sum(best) for x in best]


def test_mixtures_against_brute_force(spark):
    docs = [(k, speech(lang, k, 5 + k % 40), lang) for k, lang in enumerate(["aa", "bb", "cc"] * 30)] + [(300, speech("aa", 1, 9) + " " + speech("cc", 2, 12), None), (301, "é", None), (302, "and und eau", None)]
    frame_ = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    known = [(t, lang) for i, t, lang in docs if lang and zlib.crc32(str(i).encode()) % 4 != 2]
    table = language_id.train(spark.createDataFrame(known, "text string, lang string"), ["aa", "bb", "cc"])
    got = {r["doc_id"]: r for r in language_id.identify(frame_).collect()}
    for i, t, _ in docs:
        want = plain_mixture(t, table)
        order = sorted(range(3), key=lambda k: (-want[k], k))
        assert abs(got[i]["score"] - max(want)) < 1e-6 and got[i]["langs"] == [("aa", "bb", "cc")[k] for k in order if want[k] > 0]


def test_set_of_six_languages():
    import pyarrow as pa

    from siftwell.llm import language_id
    from siftwell.llm.words import split_words

    letters = ["abc", "def", "ghi", "jkl", "mno", "pqr"]
    split = lambda texts: split_words(pa.array(texts, pa.large_string()), language_id.LETTERS, lower=True)
    words = [[x + y + z + x for x in s for y in s for z in s] for s in letters]
    counts = np.full((6, language_id.BUCKETS), 0.5)
    for row, own in zip(counts, words, strict=True):
        np.add.at(row, language_id.trigram_buckets(split([" ".join(own)]))[0], 1)
    table = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)
    shares, has = language_id.infer(split([" ".join(sum(words, [])), " ".join(words[2])]), table)
    assert has.all() and (shares[0] > 0).all() and np.allclose(shares[0], 1 / 6, atol=0.01)
    assert (shares[1] > 0).tolist() == [k == 2 for k in range(6)]
