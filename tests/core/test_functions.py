import pytest
from pyspark.sql import functions as F

from siftwell.functions import paths, text, vectors


def values(spark, column, *inputs, kind="string"):
    frame = spark.createDataFrame([(x,) for x in inputs], f"x {kind}")
    return [r[0] for r in frame.select(column(F.col("x")).alias("y")).collect()]


def test_split_lines(spark):
    assert values(spark, text.split_lines, "", "a", "a\n", "a\r\nb\n\n", "\n") == [[], ["a"], ["a"], ["a", "b", ""], [""]]


def test_trim_takes_all_white_space(spark):
    assert values(spark, text.trim, "\t a b \n") == ["a b"]


@pytest.mark.parametrize(
    "glob,path,fits",
    [
        ("src/**", "src/a/b.ts", True), ("src/**", "lib/src/a.ts", False), ("*.ts", "a/b/c.ts", True), ("*.ts", "a/b.tsx", False), ("dist", "a/dist/b.js", True),
        ("dist", "distant/b.js", False), ("a/b", "a/b/c/d", True), ("**/gen/*.json", "x/y/gen/a.json", True), ("**/gen/*.json", "gen/a.json", True), ("?.md", "docs/a.md", True),
        ("{a,b}/*.py", "b/x.py", True), ("[ab].c", "x/a.c", True), ("[!ab].c", "x/a.c", False), (".env*", "app/.env.local", True), ("./src/", "src/x", True), ("*", ".hidden", True), ("A.ts", "a.ts", False), ("  ", "a", False),
    ],
)
def test_globs(spark, glob, path, fits):
    assert values(spark, lambda p: paths.matches_any(p, [glob]), path) == [fits]


def test_path_parts(spark):
    inputs = ("a/b/C.Test.TSX", ".env", "Makefile", "x/y.tar.gz")
    assert values(spark, paths.extension, *inputs) == [".tsx", "", "", ".gz"]
    assert values(spark, paths.language, "a.TSX", "b.rs", "c.unknown", "d") == ["typescriptreact", "rust", None, None]
    assert values(spark, paths.normalized, "./a\\b", "././c") == ["a/b", "./c"]
    assert values(spark, paths.is_test_path, "tests/a.ts", "a/test/b", "a.spec.jsx", "contest/a.ts", "a/__tests__/b") == [True, True, True, False, True]
    assert values(spark, paths.feature_root, "src/features/x/y.ts", "features/z", "a/features", "my-features/x/a") == ["src/features/x", "features/z", None, None]
    assert values(spark, paths.is_binary_path, "a.PNG", "a.ts") == [True, False]


def test_binary_content(spark):
    assert values(spark, paths.is_binary_content, b"abc", b"a\x00b", b"\x10\x01", b"x" * 5000 + b"\x00", kind="binary") == [False, True, False, False]


def test_generated(spark):
    frame = spark.createDataFrame([("gen/a.ts", ""), ("a/Yarn.lock", ""), ("a.ts", "// CODE Generated By x"), ("a.ts", "plain"), ("out/x.ts", "")], "p string, c string")
    got = [r[0] for r in frame.select(paths.generated_reason(F.col("p"), F.col("c"), ["out"])).collect()]
    assert got == ["generated directory path", "lockfile/generated artifact", "header marker: code generated by", None, "configured generatedPaths match"]


def test_resolve(spark):
    frame = spark.createDataFrame([("a/b", "../c/d"), ("", "./x"), ("a", "../../y"), ("a/b", "./../../z.ts")], "d string, r string")
    assert [r[0] for r in frame.select(paths.resolve(F.col("d"), F.col("r"))).collect()] == ["a/c/d", "x", "../y", "z.ts"]


def test_remote_keys_of_one_repository(spark):
    same = ["git@Host.com:Team/Repo.git", "https://host.com/team/repo", "https://user:pw@host.com/team/repo.git/", "ssh://git@host.com/team/repo.git", "http://host.com:8080/team/repo/"]
    assert set(values(spark, text.remote_key, *same)) == {"host.com/team/repo"}
    assert values(spark, text.remote_key, "  ", "/srv/Repos/x.git") == ["", "srv/repos/x"]


def test_search_terms(spark):
    got = values(spark, text.match_expression, "  find `src/app.ts` & (foo-bar) a é!! ", " ".join(f"t{k}" for k in range(30)))
    assert got == ['"find" OR "src/app.ts" OR "foo-bar"', " OR ".join(f'"t{k}"' for k in range(10)) + ' OR "t10" OR "t11"']


def test_mentioned_paths(spark):
    assert values(spark, text.mentioned_paths, "see `src/a.ts`, (./lib/b.py) and README.md or http://x.y/z.html") == [["src/a.ts", "lib/b.py", "README.md"]]


def test_import_source(spark):
    lines = ["import a from 'x/y'", "export { b } from \"z\"", "import 'side'", "const c = require( 'w' )", "import type { T } from './t'", "no import"]
    assert values(spark, text.import_source, *lines) == ["x/y", "z", "side", "w", "./t", None]


def test_duplicate_form(spark):
    long = "const x = " + "abc " * 30
    assert values(spark, text.duplicate_form, long + "  ", "short", "import " + long, "{}" * 50) == [long.strip(), None, None, None]


def test_labels(spark):
    assert values(spark, text.bytes_label, 5, 2048, 3 << 20, kind="long") == ["5 B", "2.0 KB", "3.0 MB"]
    assert values(spark, text.duration_label, 59, 125, 7260, kind="long") == ["59s", "2m 5s", "2h 1m"]
    assert values(spark, text.rate_label, 12.4, 3.25, kind="double") == ["12/s", "3.3/s"]


def test_vectors(spark):
    frame = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0, 9.0]), ([0.0, 0.0], [1.0, 1.0]), ([], [1.0])], "a array<float>, b array<float>")
    got = frame.select(vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.normalize(F.col("a")).alias("n")).collect()
    assert [round(r["c"], 6) for r in got] == [0.96, 0.0, 0.0]
    assert [round(x, 6) for x in got[0]["n"]] == [0.6, 0.8] and got[1]["n"] == [0.0, 0.0] and got[2]["n"] == []


def test_hash_embedding(spark):
    import hashlib
    import math

    texts = ["Hello hello_world 42!", "", None, "x x x"]
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r["k"]: r["embedding"] for r in vectors.hash_embedding(frame, "k", "t", 16).collect()}
    import re

    for k, t in enumerate(texts):
        v = [0.0] * 16
        for token in re.findall("[a-z0-9_]+", (t or "").lower()):
            h = hashlib.sha256(token.encode()).hexdigest()
            v[int(h[:8], 16) % 16] += 1 if int(h[8:10], 16) % 2 == 0 else -1
        size = math.sqrt(sum(x * x for x in v))
        assert [round(x, 9) for x in got[k]] == [round(x / size, 9) if size else 0.0 for x in v]
