"""A stored index after changes has the tables that a new index of the same files has."""

import pytest
from pyspark.sql import functions as F

from siftwell.functions import vectors
from siftwell.operators import entities
from siftwell.plans import engine, stored
from siftwell.sources.store import Conflict, Store


def shout(path, content, language):
    """An extractor of a language of its own: a declaration for each line in capitals."""
    whole = {"kind": "function", "symbol_kind": "function", "exported": True, "default_export": False, "signature": ""}
    return [whole | {"name": line, "qualified_name": f"{path}#{line}", "start_line": k + 1, "end_line": k + 1} for k, line in enumerate(content.split("\n")) if line.isupper()]


LANGUAGES = {".ts": "typescript", ".tsx": "typescriptreact", ".up": "shout", ".md": "markdown"}
FIRST = {
    "src/a.ts": "import { b } from './b'\nimport { c } from './lib'\nexport function a() {\n  b()\n  c()\n  shared()\n}\n",
    "src/b.ts": "export function b() {\n  return new Maker()\n}\n",
    "src/b.test.ts": "import { b } from './b'\ntest('b', () => { b() })\n",
    "src/lib/index.ts": "export function c() {\n  return 1\n}\nexport function shared() {\n  return 2\n}\n",
    "src/maker.ts": "export class Maker {\n}\n",
    "src/z.ts": "export function z() {\n  shared()\n  later()\n}\n",
    "features/x/one.ts": "export const one = 1\n",
    "features/x/two.ts": "export const two = 2\n",
    "app/home.tsx": "import { HomeScreen } from '../features/x/HomeScreen'\nexport default function Home() {\n  return <HomeScreen />\n}\n",
    "LOUD.up": "quiet\nLOUD\n",
    "read.md": "# Read\n\nmore of it\n",
}
#: What changes and what goes, one step after the other.
STEPS = [
    ({"src/b.ts": "export function b() {\n  return other()\n}\nexport function later() {\n  return 1\n}\n", "LOUD.up": "LOUD\nlouder\nLOUDEST\n", "features/x/HomeScreen.tsx": "export function HomeScreen() {\n  return one\n}\n"}, ["src/maker.ts"]),
    ({"src/b.ts": FIRST["src/b.ts"], "src/lib.ts": "export function c() {\n  return 3\n}\n", "src/maker.ts": "\nexport class Maker {\n}\n"}, ["src/lib/index.ts", "absent.ts", "features/x/one.ts", "src/z.ts", "read.md"]),
]
TABLES = ["files", "chunks", "entities", "imports", "candidates", "file_edges", "code_edges", "embeddings", "postings"]


def frame(spark, texts):
    rows = [("r", p, t, LANGUAGES[p[p.rindex(".") :]]) for p, t in texts.items()]
    return spark.createDataFrame(rows, "repo_key string, path string, content string, language string")


def rows(table):
    return sorted(str(tuple(r[c] for c in sorted(table.columns) if c != "bucket")) for r in table.collect())


def same(index, texts, spark):
    new = engine.build_index(frame(spark, texts), extractors={"shout": shout})
    for name in ("chunks", "entities", "imports"):
        setattr(new, name, getattr(new, name).cache())
    new.postings = engine.lexical.postings(new.chunks, "chunk_id", "content")
    new.file_edges, new.code_edges = entities.file_edges(new.files, new.imports), entities.code_edges(new.files, new.entities, new.imports)
    for name in TABLES:
        assert rows(getattr(index, name)) == rows(getattr(new, name)), name
    n, tokens = index.totals.first()
    assert (n, tokens) == tuple(engine.lexical.corpus_totals(new.chunks, "content").first())


def test_segments(spark, tmp_path):
    store, texts = Store(spark, str(tmp_path)), dict(FIRST)
    own = {"shout": shout}
    stored.store_index(store, engine.build_index(frame(spark, texts), extractors=own), bucket_rows=10)
    edges_of = lambda table, at: {r["source_path"] for r in store.read(table).filter(F.col("segment") == at).collect()}
    for k, (changed, gone) in enumerate(STEPS):
        base = store.manifest()
        index = stored.update_index(store, frame(spark, changed), spark.createDataFrame([("r", p) for p in gone], "repo_key string, path string"), extractors=own)
        texts = {p: t for p, t in (texts | changed).items() if p not in gone}
        if k == 0:
            same(index, texts, spark)
        at = store.manifest().version
        for name in ("files", "chunks", "entities", "imports", "candidates"):
            column = "source_path" if name == "candidates" else "path"
            assert {r[0] for r in store.read(name).filter(F.col("segment") == at).select(column).collect()} <= set(changed)
        if k == 0:  # z calls later(), which is declared now; home's screen is there now; others' edges are not written again
            assert edges_of("code_edges", at) == {"src/b.ts", "src/z.ts", "app/home.tsx"}
            assert {"app/home.tsx", "features/x/HomeScreen.tsx", "features/x/two.ts"} <= edges_of("file_edges", at) and "src/a.ts" not in edges_of("file_edges", at)
            with pytest.raises(Conflict):
                store.commit(added={"files": store.read("files").limit(1)}, base=base)
    ask = lambda i, q: [(r["path"], round(r["score"], 9)) for r in engine.search(i, engine.Request(q, limit=5)).collect()]
    before = [ask(index, q) for q in ("shared", "LOUDEST")]
    index = stored.compact(store, extractors=own)
    assert store.vacuum() and all(len(t["folders"]) == 1 for t in store.manifest().tables.values())
    same(index, texts, spark)
    assert [ask(index, q) for q in ("shared", "LOUDEST")] == before


def test_in_memory(spark):
    texts, own = dict(FIRST), {"shout": shout}
    index = engine.build_index(frame(spark, texts), extractors=own)
    index.postings, index.totals = engine.lexical.stored_postings(index.chunks, "chunk_id", "content"), engine.lexical.corpus_totals(index.chunks, "content")
    changed, gone = STEPS[0]
    index = engine.update_index(index, frame(spark, changed), spark.createDataFrame([(p,) for p in gone], "path string"))
    same(index, {p: t for p, t in (texts | changed).items() if p not in gone}, spark)
    assert index.extractors is own and index.embed is vectors.hash_embedding
    assert entities.extract_entities(frame(spark, {"LOUD.up": "A"}), index.extractors).count() == 1
