"""The pruning directory source."""

import os

import pytest
from pyspark.sql import functions as F

from siftwell.sources import corpus, tree

FILES = {"a.ts": b"x", "src/b.ts": b"yy", "src/deep/er/c.ts": b"zzz", "src/deep/d.md": b"d", "src/gen/e.ts": b"e", "node_modules/m/x.js": b"q", "img/l.PNG": b"p", "img/raw.dat": b"a\0b", "big.txt": b"w" * 50, "src/.env": b"k"}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    for name, body in FILES.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(body)
    os.symlink(top / "src", top / "link")
    return top


def reasons(found):
    return {r["path"]: r["skip_reason"] for r in found.select("path", "skip_reason").collect()}


@pytest.mark.parametrize("partitions", [1, 4, 100])
def test_listing(spark, root, partitions):
    found = tree.read_tree(spark, f"file://{root}", (), ("node_modules", "**/gen"), 40, partitions)
    assert reasons(found) == {"a.ts": None, "src/b.ts": None, "src/deep/er/c.ts": None, "src/deep/d.md": None, "src/gen": "ignored", "node_modules": "ignored", "img/l.PNG": "binary", "img/raw.dat": "binary", "big.txt": "too_large", "src/.env": None}
    assert {r["path"]: bytes(r["content"]) for r in found.filter("skip_reason IS NULL").collect()} == {p: FILES[p] for p in ("a.ts", "src/b.ts", "src/deep/er/c.ts", "src/deep/d.md", "src/.env")}
    assert [r["kind"] for r in found.filter("path = 'node_modules'").collect()] == ["directory"]
    assert found.rdd.getNumPartitions() == {1: 1, 4: 4, 100: 5}[partitions]
    assert found.count() == 10


def test_include(spark, root):
    assert reasons(tree.read_tree(spark, str(root), ("*.{ts,md}", "!**"), ("node_modules",))) == {p: None if p.endswith((".ts", ".md")) else "excluded" for p in FILES if "node" not in p} | {"node_modules": "ignored"}


def test_what_is_skipped_is_never_opened(root, monkeypatch):
    opened, listed = [], []
    read, entries = tree.Tree.read, tree.Tree.entries
    monkeypatch.setattr(tree.Tree, "read", lambda self, path: opened.append(path) or read(self, path))
    monkeypatch.setattr(tree.Tree, "entries", lambda self, path: listed.append(path) or entries(self, path))

    def scan(**options):
        opened.clear(), listed.clear()
        reader = tree.TreeReader({"path": str(root), "exclude": '["node_modules", "src/gen/**", "src/gen"]', "maxFileBytes": "40", "partitions": "1"} | options)
        return [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]

    scan()
    assert sorted(opened) == ["a.ts", "img/raw.dat", "src/.env", "src/b.ts", "src/deep/d.md", "src/deep/er/c.ts"]
    assert not [d for d in listed if d.startswith(("node_modules", "src/gen", "link"))]
    rows = scan(below='["src/deep/"]')
    assert {r["path"] for r in rows} == {"src/deep/d.md", "src/deep/er/c.ts"} and sorted(opened) == ["src/deep/d.md", "src/deep/er/c.ts"]
    assert set(listed) == {"", "src", "src/deep", "src/deep/er"}
    rows = scan(below='["src/b.ts", "node_modules/m/x.js", "absent/"]', keptOnly="true")
    assert [r["path"] for r in rows] == opened == ["src/b.ts"] and set(listed) == {"", "src"}
    scan(leastBytes="2")
    assert sorted(opened) == ["img/raw.dat", "src/b.ts", "src/deep/er/c.ts"]
    assert not any(r["content"] for r in scan(content="false")) and not opened


def test_absent_and_empty(spark, tmp_path):
    assert tree.read_tree(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="absent"):
        tree.read_tree(spark, str(tmp_path / "absent")).count()
    assert corpus.scan_directory(spark, str(tmp_path)).columns == ["repo_key", "path", "size_bytes", "content", "skip_reason"]
