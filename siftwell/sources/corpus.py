"""Files of a directory tree, or any table of documents, as the corpus."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from . import tree

MAX_FILE_BYTES = 300_000


@dataclass(frozen=True)
class ScanConfig:
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ("node_modules", ".git", "dist", "build", "coverage")
    generated: tuple[str, ...] = ()
    test_paths: tuple[str, ...] = ("test/**", "tests/**")
    packages: dict[str, str] = field(default_factory=dict)
    max_file_bytes: int = MAX_FILE_BYTES
    max_code_chunks: int = 12
    max_learnings: int = 8


def clamp(value, low: int, high: int, fallback: int) -> int:
    """A finite number cut to whole and into the range; anything else gives the fallback."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value != value or value in (float("inf"), float("-inf")):
        return fallback
    return max(low, min(high, int(value)))


def parse_ignore(content: str) -> list[str]:
    """Globs of an ignore file: comments and negations go, a leading slash goes, directories get /**"""
    lines = [line.strip() for line in content.splitlines()]
    kept = [line.lstrip("/") for line in lines if line and not line.startswith(("#", "!"))]
    return [f"{line}**" if line.endswith("/") else line for line in kept]


def load_config(base: ScanConfig, ignore: str = "", *documents: str) -> ScanConfig:
    """base with the ignore file's globs and JSON documents over it; later ones win, lists are replaced as a whole,
    entries of a wrong kind are left out."""
    out = replace(base, exclude=(*base.exclude, *parse_ignore(ignore)))
    texts = lambda v, old: tuple(x for x in v if isinstance(x, str)) if isinstance(v, list) else old
    for document in documents:
        try:
            found = json.loads(document)
        except ValueError:
            continue
        if not isinstance(found, dict):
            continue
        packages = found.get("packages")
        out = replace(
            out,
            include=texts(found.get("include"), out.include),
            exclude=texts(found.get("exclude"), out.exclude),
            generated=texts(found.get("generatedPaths"), out.generated),
            test_paths=texts(found.get("testPaths"), out.test_paths),
            packages={p["path"]: p["key"] for p in packages if isinstance(p, dict) and {"path", "key"} <= set(p)} if isinstance(packages, list) else out.packages,
            max_file_bytes=clamp(found.get("maxFileBytes"), 1, 1 << 31, out.max_file_bytes),
            max_code_chunks=clamp(found.get("maxCodeChunks"), 1, 50, out.max_code_chunks),
            max_learnings=clamp(found.get("maxLearnings"), 1, 20, out.max_learnings),
        )
    return out


def classify(files: DataFrame, config: ScanConfig) -> DataFrame:
    """files: path, size_bytes and content (binary). Adds skip_reason: ignored (an exclude glob), excluded (no include
    glob), binary (by name or a zero byte), too_large, or null. Names and sizes are looked at first."""
    path, content = F.col("path"), F.col("content")
    reason = F.when(paths.matches_any(path, list(config.exclude)), "ignored")
    if config.include:
        reason = reason.when(~paths.matches_any(path, list(config.include)), "excluded")
    return files.withColumn("skip_reason", reason.when(paths.is_binary_path(path), "binary").when(F.col("size_bytes") > config.max_file_bytes, "too_large").when(paths.is_binary_content(content), "binary"))


def scanned(classified: DataFrame, config: ScanConfig) -> DataFrame:
    """The files kept: path, language, file_hash, size_bytes, content (text), generated_reason, is_generated, package_key."""
    kept = classified.filter("skip_reason IS NULL")
    body = F.decode("content", "UTF-8")
    reason = paths.generated_reason(F.col("path"), body, config.generated)
    return kept.select(
        *(c for c in kept.columns if c not in ("content", "skip_reason")),
        paths.language(F.col("path")).alias("language"),
        F.sha2("content", 256).alias("file_hash"),
        body.alias("content"),
        reason.alias("generated_reason"),
        reason.isNotNull().alias("is_generated"),
        paths.longest_prefix(F.col("path"), config.packages).alias("package_key"),
    )


def scan_directory(spark: SparkSession, root: str, config: ScanConfig = ScanConfig(), repo: str | None = None, partitions: int = 64) -> DataFrame:
    """Files below root: repo_key, path relative to it, size_bytes, content and skip_reason, see tree.TreeSource. Pass the
    result to scanned() and stats.scan_counters(). Directories that an exclude glob fits are one row each, ignored and
    without size, and nothing in them is listed; files that are skipped by name or size are never opened."""
    found = tree.read_tree(spark, root, config.include, config.exclude, config.max_file_bytes, partitions)
    return found.select(F.lit(repo or root.rstrip("/")).alias("repo_key"), "path", "size_bytes", "content", "skip_reason")


def scan_store(spark: SparkSession, root: str, config: ScanConfig = ScanConfig(), repo: str | None = None) -> DataFrame:
    """As scan_directory, by Spark's binary reader, for stores that only Spark's file systems reach. It lists all, and
    reads ignored files too; files over the size limit come without content, which is not read."""
    base = root.rstrip("/")
    source = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    # The reader leaves files out by their length, so the content of large ones is never read.
    small = source.filter(F.col("length") <= config.max_file_bytes).select("path", "length", "content")
    large = source.filter(F.col("length") > config.max_file_bytes).select("path", "length", F.lit(None).cast("binary").alias("content"))
    tail = F.substring_index("path", base.rsplit("/", 1)[-1] + "/", -1) if "/" not in base else F.regexp_replace("path", "^.*?" + _quoted(base.split("://", 1)[-1].lstrip("/")) + "/", "")
    return classify(small.unionByName(large).select(F.lit(repo or base).alias("repo_key"), tail.alias("path"), F.col("length").alias("size_bytes"), "content"), config)


def _quoted(value: str) -> str:
    return "\\Q" + value + "\\E"


def documents_as_files(documents: DataFrame) -> DataFrame:
    """A documents table (doc_id, text, lang, source) as files: repo_key, path, content, language. The name's ending
    follows the language column, so that every chunking strategy sees some."""
    # Endings for the test languages.
    table = F.create_map(*(F.lit(x) for pair in {"en": ".md", "fr": ".ts", "de": ".json"}.items() for x in pair))
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.coalesce(F.try_element_at(table, F.col("lang")), F.lit(".py")))
    return documents.select("doc_id", F.col("source").alias("repo_key"), path.alias("path"), F.col("text").alias("content"), paths.language(path).alias("language"))
