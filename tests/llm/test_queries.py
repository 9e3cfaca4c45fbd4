import itertools
import os
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from siftwell.llm import frames, quality_rules

from .helpers import frame, words7
from .test_decontaminate import plain_stage
from .test_near_dup import brute as near_classes
from .test_near_dup import edited
from .test_small_operators import _limits as limits
from .test_substring_dedup import brute as without_repeats

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert corpus_pipeline.run(spark, SF).count() > 0


def plain_quality(rows):
    """Base counts and compression bands, one text at a time."""
    squeeze, bands, out = zstandard.ZstdCompressor(level=3).compress, quality_rules.Bands(), []
    inside = lambda raw, knots: (x := limits(knots, len(raw))) is None or x[0] <= len(squeeze(raw)) / len(raw) <= x[1]
    for i, t in rows:
        w, raw = words7(t), (t or "").encode()
        count = Counter(zip(w, w[1:], w[2:], strict=False))
        repeated = {k + j for k in range(len(w) - 2) if count[tuple(w[k : k + 3])] > 1 for j in range(3)}
        good = len(w) >= 50 and 100 * len(repeated) <= 50 * len(w)
        if good and inside(raw, bands.document) and all(inside(raw[k : k + 4096], bands.chunk) for k in range(0, len(raw), 4096)):
            out.append((i, t))
    return out


def plain_near(rows):
    classes = near_classes(rows)
    heads = {}
    for row, c in zip(rows, classes, strict=True):
        heads[c] = min(heads.get(c, row), row)
    return list(heads.values())


def plain_passages(rows):
    out = []
    for (i, t), (_, n, gone, kept, _) in zip(rows, without_repeats(rows), strict=True):
        if gone < n or not n:
            out.append((i, kept if gone else t))
    return out


def plain_pieces(rows):
    tokens, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []
    for i, t in rows:
        ids = [*tokens.encode(t or "", add_special_tokens=False).ids, 2]
        head = len(ids) % 1024 or 1024
        for k, (a, b) in enumerate(itertools.pairwise([0, *range(head, len(ids) + 1, 1024)])):
            out.append((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return sorted(out)


def speech(seed, n):
    """Words that the compression bands take for prose."""
    draw = random.Random(seed)
    return " ".join("".join(draw.choices("etaoinshrdlucmf", k=draw.randint(2, 8))) for _ in range(n))


def corpus():
    """Documents that each stage changes: junk, copies, shared passages, benchmark passages, nulls and repeated ids."""
    passage, item = speech(900, 60), speech(901, 40)
    base = [speech(910 + k, 260 + 40 * k) for k in range(14)]
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(20, base[3]), (21, edited(base[4], 30)), (22, edited(base[4], 200)), (23, base[5] + " " + passage), (24, base[6] + "\n" + passage + "\n" + base[7][:300])]
    rows += [(25, item + " " + speech(930, 150)), (26, speech(931, 900) + " " + item + " " + speech(932, 300)), (27, "menu | home | " * 90), (28, None), (29, ""), (30, "short text"), (31, speech(940, 2600))]
    return rows, [(1, item), (2, None), (3, speech(941, 30))]


def test_pipeline_against_plain_stages(spark, tmp_path):
    """Every stage gives the rows of its plain version on what the one before kept; columns that operators might use
    themselves pass through."""
    import corpus_pipeline

    rows, items = corpus()
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    plain = [plain_quality, plain_near, plain_passages, lambda r: plain_stage(r, items), plain_pieces]
    docs, want = frame(spark, rows), rows
    for k, ((_, stage), alike) in enumerate(zip(corpus_pipeline.STAGES, plain, strict=True)):
        before, docs, want = want, stage(spark, docs, str(tmp_path)), alike(want)
        assert len(want) != len(before) or want != before, corpus_pipeline.STAGES[k][0]
        if k < 4:
            assert docs.columns == frame(spark, rows).columns
            got = docs.collect()
            assert sorted((r["doc_id"], r["text"]) for r in got) == sorted(want), corpus_pipeline.STAGES[k][0]
            assert all(r["n_chars"] == len(r["text"]) and r["kept"] == "k" for r in got)
            docs = spark.createDataFrame(got, docs.schema)
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in last) == want
    held = {}
    for r in last:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        assert [a for a, _ in sorted(parts)] == [0, *itertools.accumulate(n for _, n in sorted(parts))][:-1] and sum(n for _, n in parts) <= 1024


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, some in (("a", []), ("b", [(1, None), (None, ""), (2, " \n"), (3, "x")])):
        frame(spark, some).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
        assert corpus_pipeline.run(spark, str(tmp_path / name)).count() == 0


def test_checkpoint_folder_is_required_on_a_cluster():
    class Context:
        master, folder = "spark://host:7077", None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, path):
            self.folder = path

    class Session:
        sparkContext = Context()

        class conf:
            named = None

            @classmethod
            def get(cls, key, other):
                return cls.named or other

    with pytest.raises(RuntimeError):
        frames.ensure_checkpoint_dir(Session())
    Session.conf.named = "hdfs:///shared"
    frames.ensure_checkpoint_dir(Session())
    assert Session.sparkContext.folder == "hdfs:///shared"


def test_contract_names():
    import __spark_entry__

    found = __spark_entry__.queries()
    assert {name.split("_")[0] for name in found if name.startswith("op")} >= {f"op{n}" for n in range(1, 11)}
    assert set(__spark_entry__.oracle_sql()) <= set(found)
