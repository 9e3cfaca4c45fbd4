"""A directory tree as a Spark data source that prunes while it lists.

The driver lists directories from the top until there are enough of them; each is then walked by a task of its own. A
directory that an exclude glob fits is named and not entered. What is asked of paths and sizes is looked at before a
file is opened, and only files that nothing speaks against are opened at all.

These conditions are options, not Spark's pushed filters: Spark 4.1 keeps the filters that one query pushed to a Python
source for all later queries of the same DataFrame.
"""

from __future__ import annotations

import json
import os
from collections import deque
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import globs
from ..functions.paths import BINARY_EXTENSIONS

SCHEMA = "path string, kind string, size_bytes long, modified timestamp, skip_reason string, content binary"
_ARROW = pa.schema([("path", pa.string()), ("kind", pa.string()), ("size_bytes", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("skip_reason", pa.string()), ("content", pa.binary())])
#: Bytes of content, and rows, that a task hands over at once.
_BATCH_BYTES, _BATCH_ROWS = 8 << 20, 4096


def matcher(patterns: list[str]) -> Callable[[str], bool]:
    """paths.matches_any for one path after the other."""
    both = [globs.of_pattern(p) for p in patterns]
    found, base = (list(dict.fromkeys(r for pair in both for r in pair[k])) for k in (0, 1))
    if not found:
        return lambda path: False
    whole, name = regex.compile(globs.whole(found)), regex.compile(globs.whole(base)) if base else None
    return lambda path: bool(whole.match(path) or (name and name.match(path.rpartition("/")[2])))


class Subtree(InputPartition):
    """A directory; deep: with all below it, else its own entries only."""

    def __init__(self, path: str, deep: bool):
        super().__init__(path)
        self.path, self.deep = path, deep


class Entry:
    __slots__ = ("is_dir", "modified", "name", "size")

    def __init__(self, name: str, is_dir: bool, size: int | None, modified: float | None):
        self.name, self.is_dir, self.size, self.modified = name, is_dir, size, modified


class Tree:
    """A root in any file system that Arrow knows. Links are not followed."""

    def __init__(self, root: str):
        plain = root.removeprefix("file:") if root.startswith("file:") else root
        self.local = "://" not in plain
        if self.local:
            self.files, self.root = None, os.path.abspath("/" + plain.lstrip("/") if plain.startswith("//") else plain)
        else:
            self.files, self.root = pyarrow.fs.FileSystem.from_uri(root)
            self.root = self.root.rstrip("/")

    def at(self, path: str) -> str:
        return f"{self.root}/{path}" if path else self.root

    def entries(self, path: str) -> Iterator[Entry]:
        if self.local:
            try:
                with os.scandir(self.at(path)) as found:
                    for e in found:
                        if e.is_dir(follow_symlinks=False):
                            yield Entry(e.name, True, None, None)
                        elif e.is_file(follow_symlinks=False):
                            stat = e.stat(follow_symlinks=False)
                            yield Entry(e.name, False, stat.st_size, stat.st_mtime)
            except FileNotFoundError:
                if not path:
                    raise
            return
        for e in self.files.get_file_info(pyarrow.fs.FileSelector(self.at(path), allow_not_found=bool(path))):
            if e.type in (pyarrow.fs.FileType.Directory, pyarrow.fs.FileType.File):
                is_dir = e.type == pyarrow.fs.FileType.Directory
                yield Entry(e.base_name, is_dir, None if is_dir else e.size, e.mtime.timestamp() if e.mtime and not is_dir else None)

    def read(self, path: str) -> bytes | None:
        """None for a file that has gone since it was listed."""
        try:
            if self.local:
                with open(self.at(path), "rb") as f:
                    return f.read()
            with self.files.open_input_stream(self.at(path)) as f:
                return f.read()
        except FileNotFoundError:
            return None


class TreeSource(DataSource):
    """Options: path (the root), include and exclude (JSON lists of globs), maxFileBytes, below (a JSON list of paths and
    of directories with a slash at their end; only these are listed), leastBytes, keptOnly (true: no rows of what is
    skipped), partitions (how many directories to list on the driver at least), content (false: no file is opened, so none
    is found to be binary by what it holds).

    Columns: path (below the root), kind (file, or directory for one that was not entered), size_bytes, modified,
    skip_reason (as corpus.classify has it, or null) and content (of files without skip_reason)."""

    @classmethod
    def name(cls) -> str:
        return "siftwell_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        low = {k.lower(): v for k, v in options.items()}
        self.root = low["path"]
        self.include, self.exclude, below = (json.loads(low.get(k, "[]")) for k in ("include", "exclude", "below"))
        self.most_bytes, self.least_bytes, self.enough = int(low.get("maxfilebytes", 1 << 62)), int(low.get("leastbytes", 0)), int(low.get("partitions", 64))
        self.open_files, self.kept_only = low.get("content", "true").lower() != "false", low.get("keptonly", "false").lower() == "true"
        self.some = bool(below)
        self.names, self.tops = {p for p in below if not p.endswith("/")}, tuple(p for p in below if p.endswith("/"))

    def _may_hold(self, directory: str) -> bool:
        """Whether a path that is asked for can lie below the directory."""
        top = directory + "/"
        return not self.some or top.startswith(self.tops) or any(p.startswith(top) for p in (*self.names, *self.tops))

    def _asked(self, path: str) -> bool:
        return not self.some or path in self.names or path.startswith(self.tops)

    def partitions(self) -> list[Subtree]:
        tree, ignored = Tree(self.root), matcher(self.exclude)
        waiting, listed = deque([""]), []
        while waiting and len(waiting) + len(listed) < self.enough:
            directory = waiting.popleft()
            listed.append(directory)
            for e in tree.entries(directory):
                path = f"{directory}/{e.name}" if directory else e.name
                if e.is_dir and not ignored(path) and self._may_hold(path):
                    waiting.append(path)
        return [Subtree(d, False) for d in listed] + [Subtree(d, True) for d in waiting]

    def read(self, partition: Subtree) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for row in self._rows(partition):
            rows.append(row)
            held += len(row["content"] or b"")
            if held >= _BATCH_BYTES or len(rows) >= _BATCH_ROWS:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    def _rows(self, partition: Subtree) -> Iterator[dict]:
        tree, ignored, wanted = Tree(self.root), matcher(self.exclude), matcher(self.include)
        waiting = [partition.path]
        while waiting:
            directory = waiting.pop()
            for e in tree.entries(directory):
                path = f"{directory}/{e.name}" if directory else e.name
                row = {"path": path, "kind": "directory" if e.is_dir else "file", "size_bytes": e.size, "modified": datetime.fromtimestamp(e.modified, timezone.utc) if e.modified is not None else None, "skip_reason": None, "content": None}
                if e.is_dir:
                    if not ignored(path):
                        if partition.deep and self._may_hold(path):
                            waiting.append(path)
                    elif not self.kept_only and (self._asked(path) or self._may_hold(path)):
                        yield row | {"skip_reason": "ignored"}
                    continue
                if not self._asked(path) or e.size < self.least_bytes:
                    continue
                reason = "ignored" if ignored(path) else "excluded" if self.include and not wanted(path) else "binary" if _extension(e.name) in BINARY_EXTENSIONS else "too_large" if e.size > self.most_bytes else None
                if reason is None and self.open_files:
                    content = tree.read(path)
                    if content is None:
                        continue
                    if b"\0" in content[:4096]:
                        reason = "binary"
                    else:
                        row["content"] = content
                if reason is None or not self.kept_only:
                    yield row | {"skip_reason": reason}


def _extension(name: str) -> str:
    stem, dot, tail = name.rpartition(".")
    return f".{tail}".lower() if dot and stem else ""


def read_tree(
    spark: SparkSession, root: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), most_bytes: int = 1 << 62, partitions: int = 64, content: bool = True, below: tuple[str, ...] = (), least_bytes: int = 0, kept_only: bool = False
) -> DataFrame:
    """A tree as a table, see TreeSource."""
    spark.dataSource.register(TreeSource)
    lists = {"include": list(include), "exclude": list(exclude), "below": list(below)}
    plain = {"maxFileBytes": most_bytes, "leastBytes": least_bytes, "partitions": partitions, "content": str(content).lower(), "keptOnly": str(kept_only).lower()}
    return spark.read.format(TreeSource.name()).options(**{k: json.dumps(v) for k, v in lists.items()}, **plain).load(root)
