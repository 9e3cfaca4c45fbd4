"""Globs: what each form fits, by Java's engine and by Python's."""

import re

import pytest
import regex as engine
from pyspark.sql import functions as F

from siftwell.functions import globs, paths

BRACES = [
    ("a{b,c}d", ["abd", "acd"]), ("{src/a,lib}/**", ["src/a/**", "lib/**"]), ("{a,b{c,d}}e", ["ae", "bce", "bde"]), ("{1..3}", ["1", "2", "3"]), ("{3..1}x", ["3x", "2x", "1x"]),
    ("{08..10}", ["08", "09", "10"]), ("{1..7..3}", ["1", "4", "7"]), ("{a..e..2}", ["a", "c", "e"]), ("{c..a}", ["c", "b", "a"]), ("{-2..0}", ["-2", "-1", "0"]), ("{a}", ["{a}"]),
    ("{a}{b,c}", ["{a}b", "{a}c"]), ("{}x", ["{}x"]), ("${a,b}", ["${a,b}"]), ("${a,b}{c,d}", ["${a,b}c", "${a,b}d"]), ("{a,b", ["{a,b"]), ("a}b", ["a}b"]), ("{{a,b}}", ["{a}", "{b}"]),
    ("{a,}b", ["ab", "b"]), ("{,}", []), ("x{,}", ["x", "x"]), ("{a,b}{1..2}", ["a1", "a2", "b1", "b2"]), ("{x,{a..c}}", ["x", "a", "b", "c"]), ("{a{b,c}", ["{ab", "{ac"]), ("{a,b}}", ["a}", "b}"]), ("{1..a}", ["{1..a}"]),
]
#: pattern, paths that it fits, paths that it does not.
FITS = [
    ("{src/a,lib}/**", ["src/a/f.ts", "lib/x/y"], ["src/b/f.ts", "src/a"]), ("{a/b,c}/x", ["a/b/x", "c/x", "c/x/deep"], ["b/x", "d/c/x"]), ("**/{x/y,z}/*.ts", ["q/x/y/f.ts", "z/f.ts"], ["q/x/f.ts"]),
    ("part-{08..11}.csv", ["d/part-09.csv", "part-11.csv"], ["part-9.csv", "part-12.csv"]), ("+(a|b).ts", ["a.ts", "x/abba.ts"], [".ts", "c.ts"]), ("?(a)b", ["b", "ab"], ["aab", "cb"]),
    ("*(ab|c)d", ["d", "ababcd"], ["ad"]), ("@(foo|b*r).js", ["foo.js", "bar.js", "p/beer.js"], ["foobar.js", "fo.js"]), ("x!(.d|.test).ts", ["x.ts", "xy.ts", "x.spec.ts"], ["x.d.ts", "x.test.ts", "y.ts"]),
    ("**/!(*.md|*.txt)", ["a/b.ts", ".x"], []), ("src/!(gen)/*.ts", ["src/a/b.ts", "src/gene/b.ts"], ["src/gen/b.ts", "src/b.ts"]), ("a@(b|c(d))", ["ab)", "ac(d)"], ["ab", "acd"]), ("a+(b", ["a+(b"], ["ab"]),
    ("+(a|+(b|c)d)e", ["ae", "bcde", "abde"], ["be", "e"]), ("!(a)b", ["b", "x", "(a)b"], []), ("!src/**", ["lib/a"], []), ("!!src/**", ["src/a"], ["lib/a"]), ("!*.md", ["a.ts", "docs/b.ts"], []),
    ("# all", ["x/# all/y"], ["all"]), ("#src/**", [], ["#src/a", "src/a"]), ("[[:digit:]]*.js", ["7x.js", "a/0.js"], ["x7.js"]), ("[[:upper:][:digit:]_]x", ["Ax", "_x", "5x", "Éx"], ["ax"]),
    ("[^[:alpha:]]x", ["5x"], ["ax", "éx"]), ("[!a-c]x", ["dx"], ["bx"]), ("a[]]b", ["a]b"], ["ab"]), ("[a-]x", ["-x", "ax"], ["bx"]), ("[z-a]x", ["[z-a]x"], ["zx", "bx"]), ("[[:graph:]]", ["a", "#"], [" "]),
    ("[id].tsx", ["app/[id].tsx", "i.tsx"], ["id.tsx"]), ("[abc", ["[abc", "x/[abc/y"], ["a"]), ("a[b/c]d", ["a[b/c]d"], ["abd"]), ("a**b", ["axxb", "d/ab"], ["a/b"]), ("a/**/**/b", ["a/b", "a/x/y/b"], ["ab"]),
    ("a/../b", ["b", "b/c", "a/b"], ["a/c"]), ("a//b", ["a/b", "a///b"], ["ab"]), ("**", ["a", ".x/y"], []), ("*", [".hidden", "a/b"], []), (".*", [".env", "x/.env"], ["env"]), ("*.*", ["a.b", ".b"], ["ab"]), ("???.md", ["abc.md", "x/abc.md"], ["ab.md", "a/b.md"]),
    ("a|b", ["a|b"], ["a", "b"]), ("(a)", ["(a)"], ["a"]), ("a$^.b", ["a$^.b"], ["a$^xb"]), ("src/**/*.{ts,tsx}", ["src/a.ts", "src/x/y/b.tsx"], ["src/a.js", "a.ts"]), ("*.ts\n", ["a.ts"], ["a.ts\n"]),
]


@pytest.mark.parametrize("glob,expansions", BRACES)
def test_braces(glob, expansions):
    assert globs.expand(glob) == expansions


def test_many_braces():
    assert len(globs.expand("{1..999}{1..999}")) == globs.MOST


def test_both_engines(spark):
    rows = [(n, p, path, fits) for n, (p, yes, no) in enumerate(FITS) for fits, some in ((True, yes), (False, no)) for path in some]
    for n, p, path, fits in rows:
        whole, base = paths.regexes(p)
        rel = re.sub("//+", "/", path)
        assert bool(whole and engine.search(whole, rel)) or bool(base and engine.search(base, rel.rsplit("/", 1)[-1])) == fits, (p, path)
    made = spark.createDataFrame(rows, "n int, pattern string, path string, fits boolean")
    cases = F.lit(False)
    for n, (p, _, _) in enumerate(FITS):
        cases = F.when(F.col("n") == n, paths.matches_any(F.col("path"), [p])).otherwise(cases)
    assert [tuple(r) for r in made.withColumn("found", cases).filter("found != fits").collect()] == []
