"""Functions on texts: lines, query terms, term sets, normal forms, display forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words left out of term sets.
CODE_STOP_WORDS = ("const", "function", "return", "type", "interface", "string", "number", "boolean", "undefined", "export", "import", "from", "true", "false")
# A mentioned file path, and what may follow it.
_PATH = r"(?:^|[\s`'\"(])((?:[\w.-]+/)+[\w.@-]+\.[A-Za-z0-9]+|[\w.@-]+\.(?:ts|tsx|js|jsx|mjs|cjs|json|md|mdx|yaml|yml|toml|css|scss|html|py|go|rs|java|sh))(?=$|[\s`'\"),:])"


def trim(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def split_lines(text: Column) -> Column:
    """Lines; \\r\\n counts as \\n, one empty last line goes, and an empty text has none."""
    lines = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n")
    last_empty = F.element_at(lines, -1) == ""
    return F.when(last_empty, F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)


def clean_list(values: Column) -> Column:
    """Trimmed, without empty ones, each once in order of first place."""
    return F.array_distinct(F.filter(F.transform(values, trim), lambda v: v != ""))


def search_terms(query: Column, most: int = 12) -> Column:
    """Terms of a lexical query: split at white space, stripped to letters, digits and _ . / : -, of two characters at
    least, the first twelve."""
    terms = F.transform(F.split(trim(query), r"\s+"), lambda t: F.regexp_replace(t, r"[^\p{L}\p{N}_./:-]", ""))
    return F.slice(F.filter(terms, lambda t: F.length(t) >= 2), 1, most)


def code_search_terms(code: Column, most: int = 12) -> Column:
    """search_terms of code: names are cut where brackets and signs stand between them, and not drawn together over these."""
    return search_terms(F.regexp_replace(code, r"[^\p{L}\p{N}_./:-]+", " "), most)


def match_expression(query: Column) -> Column:
    """The terms, quoted and joined by OR."""
    return F.array_join(F.transform(search_terms(query), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def path_tokens(query: Column, most: int = 20) -> Column:
    tokens = F.split(query, r"[^A-Za-z0-9_./-]+")
    return F.slice(F.filter(tokens, lambda t: F.length(t) >= 2), 1, most)


def code_terms(text: Column) -> Column:
    """Distinct identifiers of four characters at least, without keywords, in order of first place."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z_][a-z0-9_]{3,})"), 1)
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, CODE_STOP_WORDS)))


def key_terms(text: Column, stop_words: tuple[str, ...]) -> Column:
    words = F.filter(F.split(F.lower(text), r"\W+"), lambda w: F.length(w) >= 4)
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, stop_words)))


def overlap(query_terms: Column, content_terms: Column) -> Column:
    """Share of the query's terms that the content has."""
    return F.size(F.array_intersect(query_terms, content_terms)) / F.greatest(F.lit(1), F.size(query_terms))


# Words left out when phrases are compared.
PHRASE_STOP_WORDS = ("the", "and", "for", "with", "when", "this", "that", "use", "using", "always", "never", "prefer", "avoid", "should", "work", "repo")
# Prompts that want context, and those that never do.
_PLANNING = r"(?i)\b(implement|add|create|change|modify|update|refactor|fix|debug|test|failing|error|route|component|api|endpoint|feature|bug|edit|rewrite|migrate|rename|remove|find|trace|where|when|why|how often|what controls|refresh|poll|refetch|invalidate|query)\b"
_TRIVIAL = r"(?i)^(thanks|thank you|ok|okay|yes|no|nice|looks good|continue|go on|proceed)\.?$"


def wants_context(prompt: Column) -> Column:
    """Prompts of twelve characters at least that ask for work or mention a file."""
    body = trim(prompt)
    return (F.length(body) >= 12) & ~body.rlike(_TRIVIAL) & (body.rlike(_PLANNING) | (F.size(mentioned_paths(body)) > 0))


def phrases_compatible(a: Column, b: Column) -> Column:
    """Equal, one inside the other (of twelve characters at least), or with most terms shared."""
    x, y = key_terms(a, PHRASE_STOP_WORDS), key_terms(b, PHRASE_STOP_WORDS)
    shared = F.size(F.array_intersect(x, y))
    least = F.greatest(F.lit(2), F.ceil(F.least(F.size(x), F.size(y)) * 0.6))
    inside = ((F.length(a) >= 12) & b.contains(a)) | ((F.length(b) >= 12) & a.contains(b))
    return (a == b) | inside | ((F.size(x) > 0) & (F.size(y) > 0) & (shared >= least))


def mentioned_paths(text: Column) -> Column:
    found = F.filter(F.regexp_extract_all(text, F.lit(_PATH), 1), lambda p: ~p.startswith("http"))
    return F.array_distinct(F.transform(found, lambda p: F.regexp_replace(p, r"^\./", "")))


def plain(text: Column) -> Column:
    """Lower case, everything but a-z 0-9 _ . / - as single spaces: for comparing titles and terms."""
    return trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9_./-]+", " "))


def canonical_term(term: Column) -> Column:
    out = F.regexp_replace(F.lower(F.coalesce(term, F.lit(""))), r"\b(npm:|package:)\s*", "")
    out = F.regexp_replace(F.regexp_replace(out, r"\.js\b", ""), r"[^a-z0-9_./*-]+", " ")
    return trim(F.regexp_replace(out, r"\s+", " "))


def compact(text: Column) -> Column:
    return trim(F.regexp_replace(text, r"\s+", " "))


def shorten(text: Column, most: int) -> Column:
    """In one line, cut to `most` characters with an ellipsis."""
    line = compact(text)
    return F.when(F.length(line) <= most, line).otherwise(F.concat(F.substring(line, 1, most - 3), F.lit("...")))


def cut_with_mark(text: Column, most: int, mark: str = "\n... truncated ...") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def duplicate_form(line: Column) -> Column:
    """The form under which long lines count as equal; null for short ones, bare punctuation and imports."""
    form = compact(line)
    usable = (F.length(form) >= 80) & ~form.rlike(r"^[{}()\[\],;]+$") & ~form.rlike(r"^(import|export)\s")
    return F.when(usable, form)


def symbol_form(name: Column) -> Column:
    """A symbol without a leading verb and a trailing role, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, "(?i)^(format|load|get|set|create|update|delete|use)", ""), "(?i)(Screen|Component|View|Hook)$", ""))


def endpoint(path: Column, name: Column) -> Column:
    return F.concat_ws("#", F.nullif(path, F.lit("")), F.nullif(name, F.lit("")))


def remote_key(url: Column) -> Column:
    """host/path of a repository address (scp form or URL), lower case, without .git and outer slashes."""
    text = trim(url)
    is_url = text.contains("://")
    scp = r"^(?:[^@/:]+@)?([^:]+):(.+)$"
    is_scp = ~is_url & text.rlike(scp)
    host = F.when(is_scp, F.regexp_extract(text, scp, 1)).when(is_url, F.regexp_extract(text, r"^[A-Za-z][\w+.-]*://(?:[^@/]*@)?([^:/?#]*)", 1)).otherwise("")
    path = F.when(is_scp, F.regexp_extract(text, scp, 2)).when(is_url, F.regexp_extract(text, r"^[A-Za-z][\w+.-]*://[^/?#]*([^?#]*)", 1)).otherwise(text)
    path = F.regexp_replace(F.replace(trim(path), F.lit("\\"), F.lit("/")), r"^/+|/+$", "")
    path = F.regexp_replace(F.regexp_replace(path, r"(?i)\.git$", ""), "/+$", "")
    return F.lower(F.when(host != "", F.concat(F.lower(trim(host)), F.lit("/"), path)).otherwise(path))


def repo_key(url: Column) -> Column:
    return F.sha2(remote_key(url), 256)


def import_source(line: Column) -> Column:
    """What an added line imports: ES import or export from, or require; null if nothing."""
    text = trim(line)
    es = F.nullif(F.regexp_extract(text, r"^(?:import|export)\s+(?:type\s+)?(?:.+?\s+from\s+)?['\"]([^'\"]+)['\"]", 1), F.lit(""))
    return F.coalesce(es, F.nullif(F.regexp_extract(text, r"require\(\s*['\"]([^'\"]+)['\"]\s*\)", 1), F.lit("")))


def import_matches(source: Column, pattern: Column) -> Column:
    """The same package, a path below it, or the same but for .js"""
    bare = lambda c: F.regexp_replace(c, r"(?i)\.js$", "")
    return (source == pattern) | source.startswith(F.concat(pattern, F.lit("/"))) | (bare(source) == bare(pattern))


def bytes_label(n: Column) -> Column:
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1048576, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.1f MB", n / 1048576))


def duration_label(seconds: Column) -> Column:
    s = F.floor(seconds)
    return F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm %ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%dh %dm", F.floor(s / 3600), F.floor(s % 3600 / 60)))


def rate_label(rate: Column) -> Column:
    return F.when(rate >= 10, F.format_string("%d/s", F.round(rate).cast("long"))).otherwise(F.format_string("%.1f/s", rate))


def file_progress_label(kind: Column, done: Column, total: Column) -> Column:
    """Files done so far, as each kind of work shows them."""
    n, of = done.cast("string"), total.cast("string")
    full = F.concat(F.lit("Files "), n, F.lit("/"), F.coalesce(of, F.lit("?")))
    changed, deleted = F.concat(F.lit("Changed files "), n), F.concat(F.lit("Deleted files "), n)
    backfill = F.concat(F.lit("Files "), F.coalesce(of, n))
    return F.when(kind == "fullRepoIndex", full).when(kind == "changedFilesIndex", changed).when(kind == "deletedFileCleanup", deleted).when(kind == "embeddingBackfill", backfill).otherwise(F.concat(F.lit("Files "), n))


def table_cell(value: Column) -> Column:
    """For a cell of a markdown table."""
    return F.replace(F.replace(value, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def one_of(value: Column, allowed: tuple[str, ...], fallback: str | None = None) -> Column:
    """The trimmed, lower-case value if it is allowed, else the fallback."""
    word = F.lower(trim(value))
    return F.when(word.isin(*allowed), word).otherwise(F.lit(fallback))


def counts_label(counts: Column) -> Column:
    """Entries (n, kind) as kind=n, largest first."""
    order = F.array_sort(F.transform(counts, lambda c: F.struct((-c["n"]).alias("n"), c["kind"].alias("kind"))))
    joined = F.array_join(F.transform(order, lambda c: F.concat(c["kind"], F.lit("="), (-c["n"]).cast("string"))), ", ")
    return F.when(F.size(counts) > 0, joined).otherwise("(none)")


def wrap(value: Column, width: int) -> Column:
    """Lines of at most `width` characters, as many words in each as fit; longer words are cut. One empty line for blank
    text."""
    words = F.filter(F.split(trim(value), r"\s+"), lambda w: w != "")
    line = "struct<lines:array<string>,line:string>"

    def put(state, word):
        joined = F.when(state["line"] == "", word).otherwise(F.concat(state["line"], F.lit(" "), word))
        done = F.when(state["line"] == "", state["lines"]).otherwise(F.concat(state["lines"], F.array(state["line"])))
        cuts = F.greatest(F.floor((F.length(word) - 1) / width).cast("int"), F.lit(0))
        whole = F.transform(F.sequence(F.lit(1), F.greatest(cuts, F.lit(1))), lambda k: F.substr(word, (k - 1) * width + 1, F.lit(width)))
        broken = F.struct(F.concat(done, F.when(cuts > 0, whole).otherwise(F.array().cast("array<string>"))).alias("lines"), F.substr(word, cuts * width + 1).alias("line"))
        return F.when(F.length(joined) <= width, F.struct(state["lines"].alias("lines"), joined.alias("line"))).otherwise(broken).cast(line)

    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line")).cast(line)
    return F.aggregate(words, start, put, lambda s: F.when((s["line"] != "") | (F.size(s["lines"]) == 0), F.concat(s["lines"], F.array(s["line"]))).otherwise(s["lines"]))


def clamped(value: Column, low: float, high: float, fallback: float, whole: bool = True) -> Column:
    """A finite number brought into the range, and cut to a whole one if asked; anything else gives the fallback."""
    number = value.cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
    cut = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).cast("double") if whole else number
    return F.when(finite, F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), cut))).otherwise(F.lit(float(fallback)))


# Tools that an agent started by another one does not inherit.
RESERVED_TOOLS = ("subagent_run", "subagent_resume", "subagent_dispose", "subagent_list")


def allowed_tools(parent: Column, asked: Column, reserved: tuple[str, ...] = RESERVED_TOOLS) -> Column:
    """The tools asked for, each once, if there is a list; else those of the parent but for the reserved ones."""
    inherited = F.array_except(clean_list(F.coalesce(parent, F.array().cast("array<string>"))), F.array(*map(F.lit, reserved)))
    return F.when(asked.isNotNull(), clean_list(asked)).otherwise(inherited)
