"""Learnings: from corrections in conversations to a curated, ranked and ageing knowledge base.

Updates return new snapshots and the events they cause; nothing is changed in place.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, text
from . import lexical, ordering, retrieval

# Wording that marks a correction, in any case.
_ACTS = r"(?:use|prefer|add|run|keep|write|put|place|check|look\s+up|validate|call|name|import|export|mock|edit|modify|include)"
CORRECTION_PATTERNS = (
    r"\bdon['’]?t\s+use\b",
    r"\bdo\s+not\s+use\b",
    r"\bstop\s+using\b",
    r"\bwe\s+don['’]?t\s+use\b",
    r"\bwe\s+do\s+not\s+use\b",
    r"\buse\s+.+\s+instead\b",
    r"\buse\s+.+\s+instead\s+of\b",
    r"\bprefer\s+.+\s+(?:over|to|instead\s+of)\b",
    r"\bfavor\s+.+\s+(?:over|instead\s+of)\b",
    r"\bavoid\s+.+\s+(?:use|prefer|in\s+favor\s+of)\b",
    r"\blet['’]?s\s+(?:ensure|make\s+sure)\s+(?:we\s+)?use\b",
    r"\blet['’]?s\s+(?:ensure|make\s+sure)\s+(?:we(?:'re|\s+are)?\s+)?(?:write|writing|add|adding|include|including)\s+tests\b",
    r"\bwe\s+should\s+use\b",
    r"\bwe\s+should\s+(?:write|add|include)\s+tests\b",
    rf"\b(?:please\s+)?(?:always|never)\s+{_ACTS}\b",
    r"\b(?:make\s+sure|ensure)\s+(?:we\s+)?(?:use|write|add|include|check|validate)\b",
    r"\bnot\s+the\s+pattern\b",
    r"\bthat['’]?s\s+wrong\s+here\b",
    r"\bthis\s+repo\s+uses\b",
    r"\bshould\s+be\s+integration\b",
    r"\bshould\s+not\s+be\s+mocked\b",
    r"\bgenerated\s+file\b",
    r"\bdon['’]?t\s+edit\b",
)
# Chat that is no guidance, and what makes it guidance all the same.
_STILL_GUIDANCE = (
    r"\b(let's|lets)\s+(?:ensure|make\s+sure)\s+(?:we\s+)?use\b",
    r"\b(let's|lets)\s+(?:ensure|make\s+sure)\s+(?:we(?:'re|\s+are)?\s+)?(?:write|writing|add|adding|include|including)\s+tests\b",
    rf"\([^)]*\balways\s+{_ACTS}\b[^)]*\)",
)
_CHAT = (
    r"\b(let's|lets|can we|could we|why is|what else|is there|seems logical|interestingly|looks good|never mind|for now)\b",
    r"\b(message to you|my message|your message|you in there|without any context)\b",
)
# Wording that sets how sure a correction is.
_STRONG = r"\b(always|never|this repo|we don't|we do not|do not|don't|prefer .+ (?:over|to|instead of)|favor .+ over|use .+ instead)\b"
_SOFT = r"(?i)\b(let['’]?s|should|make sure|ensure)\b"
RULE_TYPES = ("avoid_pattern", "prefer_pattern", "testing_convention", "dependency_policy", "generated_code", "style", "domain_rule", "workflow")


def is_chat(message: Column) -> Column:
    lower = F.lower(message)
    guidance = lower.rlike("|".join(f"(?:{p})" for p in _STILL_GUIDANCE))
    return ~guidance & lower.rlike("|".join(f"(?:{p})" for p in _CHAT))


def is_correction(message: Column) -> Column:
    """One pass of one alternation over the trimmed text; commands and chat are none."""
    body = text.trim(message)
    return (body != "") & ~body.startswith("/") & ~is_chat(body) & body.rlike("(?i)" + "|".join(f"(?:{p})" for p in CORRECTION_PATTERNS))


def correction_confidence(message: Column) -> Column:
    lower = F.lower(text.trim(message))
    strong = lower.rlike(_STRONG)
    return F.when(strong & lower.rlike(r"\bhere\b"), 0.82).when(strong, 0.9).when(lower.rlike(r"\b(let's|lets)\s+ensure\s+.*\btests\b"), 0.75).when(lower.rlike(r"\bshould\b|\bnot the pattern\b|\bwrong here\b"), 0.65).otherwise(0.45)


def status_for(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "active").when(confidence >= 0.5, "draft").otherwise("ignored")


def _term(value: Column) -> Column:
    """Without one outer quote at each end and a trailing "here"."""
    return F.regexp_replace(F.regexp_replace(text.trim(value), "^['\"`]|['\"`]$", ""), r"(?i)\s+here$", "")


def _globs(value: Column) -> Column:
    like = value.rlike(r"[/*.]|\w+/\w+")
    whole = F.when(~value.contains("*") & value.endswith("/"), F.concat(value, F.lit("**"))).otherwise(value)
    return F.when(like, F.array(whole))


def rule_type_of(body: Column) -> Column:
    # Words that decide a rule's type, first match first.
    table = (("test", "testing_convention"), ("dependenc|import|package", "dependency_policy"), ("generated|do not edit|don't edit", "generated_code"), ("style|format|naming", "style"), ("auth|domain|business", "domain_rule"), ("workflow|process|review", "workflow"))
    out = F.lit("prefer_pattern")
    for pattern, kind in reversed(table):
        out = F.when(body.rlike(f"(?i){pattern}"), kind).otherwise(out)
    return out


def title_of(body: Column) -> Column:
    words = F.array_join(F.slice(F.split(F.regexp_replace(body, "[.。]$", ""), r"\s+"), 1, 10), " ")
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substr(words, F.lit(2)))


def extract_learning(message: Column) -> Column:
    """A struct (title, summary, rule_type, applies_when, avoid, prefer, path_globs, confidence, priority, status) of a
    note: the first of seven wordings that fits, else the note itself. Null for blank text. All that is cut out of the
    note is found first, once, and the forms are made of these pieces."""
    # The wordings.
    never_use = r"(?:do not|don't|dont|never)\s+use\s+"
    use_comma, use_stop, use_only = never_use + r"(.+?)\s*[,;]\s*(?:use|prefer)\s+(.+)$", never_use + r"(.+?)(?:\s+here)?\.\s*(?:we\s+use|use|prefer)\s+(.+)$", never_use + r"(.+)$"
    instead = r"(?:(?:let['’]?s\s+(?:ensure|make\s+sure)\s+(?:we\s+)?)|(?:we\s+should\s+)|(?:ensure\s+(?:we\s+)?))?use\s+(.+?)\s+instead\s+of\s+(?:using\s+)?(.+)$"
    over = r"(?:prefer|favor)\s+([^.;,]+?)\s+(?:over|to|instead\s+of)\s+([^.;]+)$"
    edit = r"(?:never|do not|don't|dont)\s+edit\s+(.+)$"
    tests_for = r"(?:write|writing|add|adding|include|including)\s+tests\s+for\s+(?:anything|any|all|new|every|changes?|changed)"
    under = r"always\s+add\s+tests\s+under\s+([^.;]+)$"
    bracket = rf"\((always\s+{_ACTS}\b[^)]*)\)"
    wordings = {"use_comma": (use_comma, 2), "use_stop": (use_stop, 2), "use_only": (use_only, 1), "instead": (instead, 2), "over": (over, 2), "edit": (edit, 1), "tests_for": (tests_for, 0), "under": (under, 1), "bracket": (bracket, 1)}
    whole = text.compact(message)
    found = [whole.alias("body")]
    for name, (pattern, groups) in wordings.items():
        found.append(whole.rlike("(?i)" + pattern).alias(f"{name}_fits"))
        found += [_term(F.regexp_extract(whole, "(?i)" + pattern, k)).alias(f"{name}_{k}") for k in range(1, groups + 1)]
    return F.get(F.transform(F.array(F.struct(*found)), _learning_of), F.lit(0))


def _learning_of(p: Column) -> Column:
    """The learning that a note's pieces give."""
    body = p["body"]
    null = F.lit(None).cast("string")
    no_globs = F.lit(None).cast("array<string>")
    soft = body.rlike(_SOFT)

    def made(title, summary, kind, when, avoid=null, prefer=null, globs=no_globs, confidence=None, priority=50, status=None):
        return F.struct(title.alias("title"), summary.alias("summary"), kind.alias("rule_type"), when.alias("applies_when"), avoid.alias("avoid"), prefer.alias("prefer"), globs.alias("path_globs"), (F.lit(1.0) if confidence is None else confidence).cast("double").alias("confidence"), F.lit(priority).alias("priority"), (F.lit("active") if status is None else status).alias("status"))

    avoid = F.when(p["use_comma_fits"], p["use_comma_1"]).when(p["use_stop_fits"], p["use_stop_1"]).otherwise(p["use_only_1"])
    prefer = F.when(p["use_comma_fits"], p["use_comma_2"]).when(p["use_stop_fits"], p["use_stop_2"]).otherwise(F.lit(""))
    has = prefer != ""
    case_avoid = made(
        F.when(has, F.concat(F.lit("Use "), prefer, F.lit(" instead of "), avoid)).otherwise(F.concat(F.lit("Avoid "), avoid)),
        F.when(has, F.concat(F.lit("Avoid "), avoid, F.lit("; prefer "), prefer, F.lit("."))).otherwise(F.concat(F.lit("Avoid "), avoid, F.lit("."))),
        F.lit("avoid_pattern"),
        F.concat(F.lit("When working in this repo, avoid "), avoid, F.when(has, F.concat(F.lit(" and use "), prefer, F.lit(" instead"))).otherwise(F.lit("")), F.lit(".")),
        avoid, F.nullif(prefer, F.lit("")), priority=80,
    )

    def preferred(name, priority, confidence=None, status=None):
        better, worse = p[f"{name}_1"], p[f"{name}_2"]
        named = F.concat(F.lit("Prefer "), better, F.lit(" over "), worse)
        return made(named, F.concat(named, F.lit(".")), F.lit("prefer_pattern"), F.concat(F.lit("When choosing between "), better, F.lit(" and "), worse, F.lit(" in this repo.")), worse, better, priority=priority, confidence=confidence, status=status)

    path = p["edit_1"]
    case_edit = made(F.concat(F.lit("Do not edit "), path), F.concat(F.lit("Do not edit "), path, F.lit(".")), F.lit("generated_code"), F.concat(F.lit("When changes would touch "), path, F.lit(".")), F.concat(F.lit("editing "), path), null, _globs(path), priority=90)
    gentle = soft & ~body.rlike(r"(?i)\balways\b")
    case_tests = made(F.lit("Add tests for new changes"), F.lit("Write tests for anything added or changed when behavior is introduced or modified."), F.lit("testing_convention"), F.lit("When adding or changing behavior in this repo."), null, F.lit("tests for new or changed behavior"), confidence=F.when(gentle, 0.75).otherwise(1.0), priority=75, status=F.when(gentle, "draft").otherwise("active"))
    place = p["under_1"]
    case_under = made(F.concat(F.lit("Add tests under "), place), F.concat(F.lit("Always add tests under "), place, F.lit(" when relevant changes are made.")), F.lit("testing_convention"), F.lit("When implementing or changing behavior that needs test coverage."), null, F.concat(F.lit("tests under "), place), _globs(place), priority=70)
    advice = p["bracket_1"]
    scope = _term(F.regexp_extract(advice, r"(?i)\bfor\s+([\w\s/-]+?)(?:\s+work|\s+changes|\s+tasks)?(?:[).]|$)", 1))
    case_bracket = made(title_of(advice), F.concat(F.upper(F.substring(advice, 1, 1)), F.regexp_replace(F.substr(advice, F.lit(2)), "[.。]?$", "."), F.lit("")), rule_type_of(advice), F.when(scope != "", F.concat(F.lit("When doing "), scope, F.lit(" work in this repo."))).otherwise("When working in this repo and this guidance is relevant."), null, advice, priority=75)
    plain = made(title_of(body), body, rule_type_of(body), F.lit("When working in this repo and this guidance is relevant."))
    return (
        F.when(body == "", None).when(p["use_only_fits"], case_avoid)
        .when(p["instead_fits"], preferred("instead", 70, F.when(soft, 0.75).otherwise(1.0), F.when(soft, "draft").otherwise("active")))
        .when(p["over_fits"], preferred("over", 75)).when(p["edit_fits"], case_edit).when(p["tests_for_fits"], case_tests).when(p["under_fits"], case_under).when(p["bracket_fits"], case_bracket).otherwise(plain)
    )


def scope_globs(message: Column, globs: Column) -> Column:
    """Path globs of a learning: its own, else the directories of mentioned files, unless the wording is for all."""
    wide = message.rlike(r"(?i)\b(in this repo|this repo|always|never|we use|we don't|we do not)\b")
    mentioned = text.mentioned_paths(message)
    places = F.array_distinct(F.transform(mentioned, lambda p: F.when(p.contains("/"), F.concat(paths.dirname(p), F.lit("/**"))).otherwise(p)))
    return F.when(wide | (F.size(mentioned) == 0) | (F.coalesce(F.size(globs), F.lit(0)) > 0), globs).otherwise(places)


def capture(messages: DataFrame, message: str = "text", rewrite: Callable[[Column], Column] | None = None) -> DataFrame:
    """Learning candidates of user messages: corrections only, with the lesser of the two confidences, the status that
    follows from it, and scoped globs. Candidates that only repeat the message are left out. rewrite: makes a struct
    with fields of extract_learning of a message; what it leaves null comes from the wordings."""
    # A message takes long for its bytes, so messages are dealt over all cores, whatever the files they come from. Rows of
    # a generator: a filter on a plain column would go below the dealing, and cut the message up again for each field.
    dealt = messages.repartition(4 * messages.sparkSession.sparkContext.defaultParallelism)
    hit = dealt.select("*", F.explode(F.array(is_correction(F.col(message)))).alias("__is")).filter("__is").drop("__is")
    hit = hit.select("*", F.explode(F.array(extract_learning(F.col(message)))).alias("l"))
    if rewrite is not None:
        hit = hit.withColumn("w", rewrite(F.col(message)))
        given = hit.schema["w"].dataType.names
        hit = hit.withColumn("l", F.struct(*(F.coalesce(F.col(f"w.{n}"), F.col(f"l.{n}")).alias(n) if n in given else F.col(f"l.{n}").alias(n) for n in hit.schema["l"].dataType.names))).drop("w")
    sure = F.least(F.col("l.confidence"), correction_confidence(F.col(message)))
    generic = (F.col("l.summary") == text.compact(F.col(message))) & F.col("l.avoid").isNull() & F.col("l.prefer").isNull() & F.col("l.path_globs").isNull()
    out = hit.filter(~generic).select("*", F.explode(F.array(sure)).alias("c")).withColumn("g", scope_globs(F.col(message), F.col("l.path_globs")))
    fields = ["title", "summary", "rule_type", "applies_when", "avoid", "prefer", "priority"]
    return out.select(*messages.columns, *(F.col(f"l.{f}").alias(f) for f in fields), F.col("g").alias("path_globs"), F.col("c").alias("confidence"), status_for(F.col("c")).alias("status")).filter("status != 'ignored'")


def embedding_text() -> Column:
    """Labelled lines of a learning's fields."""
    line = lambda label, value: F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{label}: "), value))
    c = F.col
    return F.concat_ws("\n", F.concat(F.lit("Rule: "), c("title")), F.concat(F.lit("Type: "), c("rule_type")), F.concat(F.lit("Summary: "), c("summary")), F.concat(F.lit("Applies when: "), c("applies_when")), line("Avoid", c("avoid")), line("Prefer", c("prefer")), line("Paths", F.array_join("path_globs", ", ")))


def find_duplicates(candidates: DataFrame, learnings: DataFrame) -> DataFrame:
    """candidate_id and learning_id of the first (by id) active or draft learning of the repo with the same avoid term,
    and the same prefer term if the candidate has one; without an equal avoid term, the same title."""
    live = learnings.filter("status IN ('active', 'draft')").select("repo_key", "learning_id", *(text.plain(F.col(c)).alias(c) for c in ("avoid", "prefer", "title")))
    mine = candidates.select("repo_key", "candidate_id", *(text.plain(F.col(c)).alias(c) for c in ("avoid", "prefer", "title")))
    # Learnings are drawn together by their terms first, so a candidate meets one row, however many share its terms.
    first = lambda *keys: live.groupBy("repo_key", *keys).agg(F.min("learning_id").alias("learning_id"))
    by_both = mine.filter("avoid != '' AND prefer != ''").join(first("avoid", "prefer"), ["repo_key", "avoid", "prefer"])
    by_avoid = mine.filter("avoid != '' AND prefer = ''").join(first("avoid"), ["repo_key", "avoid"])
    by_title = mine.filter("avoid = ''").join(first("title"), ["repo_key", "title"])
    # Of a title, the first learnings of two avoid terms: one of them has another term than the candidate.
    place = F.row_number().over(Window.partitionBy("repo_key", "title").orderBy(F.col("learning_id").asc_nulls_last(), "avoid"))
    two = first("title", "avoid").withColumn("__n", place).filter("__n <= 2").select("repo_key", "title", F.col("avoid").alias("o_avoid"), "learning_id")
    by_other = mine.filter("avoid != ''").join(two, ["repo_key", "title"]).filter("avoid != o_avoid")
    both = reduce(DataFrame.unionByName, (df.select("candidate_id", "learning_id") for df in (by_both, by_avoid, by_title, by_other)))
    return both.groupBy("candidate_id").agg(F.min("learning_id").alias("learning_id"))


def boost_duplicates(learnings: DataFrame, duplicates: DataFrame) -> DataFrame:
    """A learning that was found again is 0.05 surer each time, up to 1."""
    n = duplicates.groupBy("learning_id").agg(F.count("*").alias("__n"))
    joined = learnings.join(n, "learning_id", "left")
    return joined.withColumn("confidence", F.when(F.col("__n").isNull(), F.col("confidence")).otherwise(F.least(F.lit(1.0), F.col("confidence") + 0.05 * F.col("__n")))).drop("__n")


def consolidation_key() -> Column:
    avoid, prefer, title = (text.canonical_term(F.col(c)) for c in ("avoid", "prefer", "title"))
    terms = F.concat(F.col("rule_type"), F.lit("|avoid:"), avoid, F.lit("|prefer:"), prefer)
    return F.when((avoid != "") | (prefer != ""), terms).when(title != "", F.concat(F.col("rule_type"), F.lit("|title:"), title))


def consolidate(learnings: DataFrame) -> DataFrame:
    """The snapshot after live learnings of one key were merged: the keeper (active first, then surest, of highest
    priority, newest, least id) gains 0.02 of confidence for each other, 0.05 at most, and a priority step each; the
    others are superseded by it. The keeper comes from one aggregation, so a key of any size is safe."""
    live = learnings.filter("status IN ('active', 'draft')").select("repo_key", "learning_id", "status", "confidence", "priority", "updated_at", consolidation_key().alias("key")).filter("key IS NOT NULL")
    rank = F.struct((F.col("status") == "active").cast("int").alias("a"), "confidence", "priority", "updated_at")
    best = live.groupBy("repo_key", "key").agg(F.max(rank).alias("best"), F.count("*").alias("n")).filter("n > 1")
    tied = live.join(best, ["repo_key", "key"]).filter(rank.eqNullSafe(F.col("best"))).groupBy("repo_key", "key").agg(F.min("learning_id").alias("keeper"), F.first("n").alias("n"))
    fate = live.join(tied, ["repo_key", "key"]).select("learning_id", "keeper", "n")
    joined = learnings.join(fate, "learning_id", "left")
    kept = F.col("keeper") == F.col("learning_id")
    others = F.col("n") - 1
    return joined.select(
        *(c for c in learnings.columns if c not in ("confidence", "priority", "status", "superseded_by")),
        F.when(kept, F.least(F.lit(1.0), F.col("confidence") + F.least(F.lit(0.05), others * 0.02))).otherwise(F.col("confidence")).alias("confidence"),
        F.when(kept, F.least(F.lit(100), F.col("priority") + others)).otherwise(F.col("priority")).cast("long").alias("priority"),
        F.when(F.col("keeper").isNotNull() & ~kept, "superseded").otherwise(F.col("status")).alias("status"),
        F.when(F.col("keeper").isNotNull() & ~kept, F.col("keeper")).otherwise(F.col("superseded_by") if "superseded_by" in learnings.columns else F.lit(None)).alias("superseded_by"),
    )


def stale(learnings: DataFrame, now: str, days: int = 90, with_drafts: bool = False) -> DataFrame:
    """Unsure learnings (below 0.9) unused for so many days, oldest first."""
    seen = F.coalesce("last_used_at", "updated_at", "created_at")
    kinds = ["active", "draft"] if with_drafts else ["active"]
    cutoff = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
    return learnings.filter(F.col("status").isin(*kinds) & (F.col("confidence") < 0.9) & (seen < cutoff)).orderBy(seen, "confidence", "learning_id")


def mark_used(learnings: DataFrame, used: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """Active learnings that were retrieved gain 0.01 and a priority step; returns the snapshot and the events."""
    ids = used.select("learning_id").distinct().withColumn("__used", F.lit(True))
    joined = learnings.join(ids, "learning_id", "left").withColumn("__hit", F.coalesce("__used", F.lit(False)) & (F.col("status") == "active"))
    events = joined.filter("__hit").select("learning_id", F.lit("retrieved").alias("event_kind"), F.to_json(F.struct(F.col("confidence").alias("confidenceBefore"), F.col("priority").alias("priorityBefore"))).alias("payload"), F.lit(at).cast("timestamp").alias("created_at"))
    new = {"confidence": F.least(F.lit(1.0), F.col("confidence") + 0.01), "priority": F.least(F.lit(100), F.col("priority") + 1), "last_used_at": F.lit(at).cast("timestamp"), "updated_at": F.lit(at).cast("timestamp")}
    snapshot = joined.select(*((F.when(F.col("__hit"), new[c]).otherwise(F.col(c))).alias(c) if c in new else c for c in learnings.columns))
    return snapshot, events


def supersede(learnings: DataFrame, pairs: DataFrame, at: str) -> DataFrame:
    """pairs: superseded_id, replacement_id. Only pairs of two different learnings of one repo take effect."""
    known = learnings.select("learning_id", "repo_key")
    ok = pairs.filter("superseded_id != replacement_id").join(known.toDF("superseded_id", "r1"), "superseded_id").join(known.toDF("replacement_id", "r2"), "replacement_id").filter("r1 = r2")
    fate = ok.groupBy(F.col("superseded_id").alias("learning_id")).agg(F.min("replacement_id").alias("__by"))
    joined = learnings.join(fate, "learning_id", "left")
    new = {"status": F.lit("superseded"), "superseded_by": F.col("__by"), "updated_at": F.lit(at).cast("timestamp")}
    return joined.select(*((F.when(F.col("__by").isNotNull(), new[c]).otherwise(F.col(c))).alias(c) if c in new else c for c in learnings.columns))


def forget(learnings: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """Rejects the named learnings, or all live ones."""
    hit = F.col("learning_id").isin(*ids) if ids else (F.lit(False) if ids is not None else F.col("status").isin("active", "draft"))
    return learnings.withColumn("status", F.when(hit, "rejected").otherwise(F.col("status")))


def disable_rules(rules: DataFrame, learnings: DataFrame) -> DataFrame:
    """Rules of learnings that are no longer active are disabled."""
    live = learnings.filter("status = 'active'").select("learning_id").withColumn("__live", F.lit(True))
    return rules.join(live, "learning_id", "left").withColumn("status", F.when((F.col("status") == "active") & F.col("__live").isNull(), "disabled").otherwise(F.col("status"))).drop("__live")


def hard_rules(rules: DataFrame, learnings: DataFrame) -> DataFrame:
    """Active rules of active learnings with a confidence of at least 0.8, by severity, priority and kind."""
    sure = learnings.filter("status = 'active' AND confidence >= 0.8").select("learning_id", "confidence", "priority")
    return rules.filter("status = 'active'").join(sure, "learning_id").orderBy("severity", F.desc("priority"), "rule_kind", "rule_id")


def learning_score(base: Column) -> Column:
    """A hit's score, with a little for confidence and priority."""
    return base + F.col("confidence") * 0.1 + F.col("priority") / 1000


def usable(learnings: DataFrame, package_key: str | None = None) -> DataFrame:
    """Active learnings with a confidence of 0.5 at least, of no package or the given one."""
    found = learnings.filter("status = 'active' AND confidence >= 0.5")
    if package_key and "package_key" in learnings.columns:
        found = found.filter(F.col("package_key").isNull() | (F.col("package_key") == package_key))
    return found


def search(learnings: DataFrame, terms: list[str], near: DataFrame | None = None, package_key: str | None = None, limit: int = 8) -> DataFrame:
    """The best usable learnings for a query: lexical hits
    over the learning's text by rank, priority and confidence, fused with vector neighbours (near: learning_id,
    similarity; of usable ones only, or a cut made before counts others). Usage is a step of its own, see mark_used."""
    chosen = usable(learnings, package_key)
    body = chosen.withColumn("__t", F.concat_ws(" ", "title", "summary", "avoid", "prefer"))
    hits = lexical.bm25(body, "learning_id", "__t", terms).join(chosen.select("learning_id", "priority", "confidence"), "learning_id")
    best = hits.orderBy("rank", F.desc("priority"), F.desc("confidence"), "learning_id").limit(limit)
    lex = best.select("learning_id", learning_score(F.lit(1.0)).alias("score"), F.array(F.lit("fts_match")).alias("reasons"), F.rint(F.col("rank") * 1_000_000).cast("long").alias("ordinal"))
    vec = lex.limit(0)
    if near is not None:
        positive = near.filter("similarity > 0").join(chosen.select("learning_id", "priority", "confidence"), "learning_id").orderBy(F.desc("similarity"), "learning_id").limit(limit)
        vec = positive.select("learning_id", learning_score(F.col("similarity")).alias("score"), F.array(F.lit("semantic_match")).alias("reasons"), F.rint(F.col("similarity") * -1_000_000).cast("long").alias("ordinal"))
    return retrieval.fuse(lex, vec, "learning_id", limit).join(chosen, "learning_id").orderBy(F.desc("score"), "learning_id")


def terms_overlap(a: str, b: str) -> Column:
    """Whether learning a and candidate b (aliases of structs with title, summary, avoid, prefer) are about the same:
    compatible avoid or prefer phrases, a long phrase of a in b's text, or enough of b's key terms in a's text."""
    low = lambda side, c: F.lower(text.trim(F.coalesce(F.col(f"{side}.{c}"), F.lit(""))))
    whole = lambda side: F.concat_ws(" ", low(side, "title"), low(side, "summary"), low(side, "avoid"), low(side, "prefer"))
    both = lambda c: (low(a, c) != "") & (low(b, c) != "") & text.phrases_compatible(low(a, c), low(b, c))
    inside = lambda c: (F.length(low(a, c)) >= 12) & whole(b).contains(low(a, c))
    key = text.key_terms(F.concat_ws(" ", low(b, "avoid"), low(b, "prefer")), text.PHRASE_STOP_WORDS)
    shared = F.size(F.array_intersect(key, text.key_terms(whole(a), text.PHRASE_STOP_WORDS)))
    need = F.when(F.size(key) <= 3, F.size(key)).otherwise(F.greatest(F.lit(2), F.ceil(F.size(key) * 0.5)))
    return both("avoid") | both("prefer") | inside("avoid") | inside("prefer") | ((F.size(key) > 0) & (shared >= need))


#: Tasks that the pairs of two phrases are at least dealt over.
_SALTS = 16


def compatible_pairs(rows: DataFrame, group: str, key: str, phrase: str) -> DataFrame:
    """a and b, keys of rows of one group, a below b, whose phrases agree. Distinct phrases are compared, each two once, so
    only pairs that come out are ever made of rows. Neither side of these is sent whole: rows of one phrase are dealt
    over salts, each of which has the other's, and a task holds the rows of one phrase."""
    said = rows.select(F.col(group).alias("g"), F.col(phrase).alias("x")).distinct()
    agree = said.join(said.withColumnRenamed("x", "y"), "g").filter((F.col("x") <= F.col("y")) & text.phrases_compatible(F.col("x"), F.col("y")))
    side = lambda k, x: rows.select(F.col(group).alias("g"), F.col(phrase).alias(x), F.col(key).alias(k))
    one = side("a", "x").join(ordering.merged(agree), ["g", "x"]).select("g", "y", "a", (F.col("x") == F.col("y")).alias("same"), F.pmod(F.xxhash64("a"), F.lit(_SALTS)).cast("int").alias("salt"))
    two = side("b", "y").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    met = one.join(ordering.merged(two), ["g", "y", "salt"]).filter((F.col("a") < F.col("b")) | (~F.col("same") & (F.col("a") > F.col("b"))))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def semantic_duplicates(found: DataFrame) -> DataFrame:
    """Of retrieved pairs (candidate_id, learning_id, score, place and structs l and c with title, summary, avoid,
    prefer, rule_type, path_globs) the first good one of each candidate: score 0.78 at least, one rule type, the same
    subject, and a shared glob where both have any."""
    size = lambda side: F.coalesce(F.size(F.col(f"{side}.path_globs")), F.lit(0))
    scoped = (size("l") <= 0) | (size("c") <= 0) | F.coalesce(F.arrays_overlap("l.path_globs", "c.path_globs"), F.lit(False))
    good = found.filter((F.col("score") >= 0.78) & (F.col("l.rule_type") == F.col("c.rule_type")) & scoped & terms_overlap("l", "c"))
    return good.groupBy("candidate_id").agg(F.min_by("learning_id", "place").alias("learning_id"))


def feedback_candidate(feedback: DataFrame) -> DataFrame:
    """feedback: finding_id, action, title, evidence, correction, path_globs. The learning that a reviewer's word gives:
    made of the correction, else title, else evidence; accepted ones active with at most 0.85, the others drafts with
    at most 0.75. Rejected findings and false positives give none."""
    known = F.when(F.col("action").isin("accepted", "rejected", "false_positive"), F.col("action")).otherwise("needs_changes")
    first = lambda c: F.nullif(text.trim(F.col(c)), F.lit(""))
    body = F.coalesce(first("correction"), first("title"), first("evidence"), F.concat(F.lit("Review finding "), "finding_id", F.lit(" was useful.")))
    made = feedback.withColumn("action", known).filter("action IN ('accepted', 'needs_changes')").withColumn("__l", extract_learning(body))
    accepted = F.col("action") == "accepted"
    fields = ("title", "summary", "rule_type", "applies_when", "avoid", "prefer")
    globs = F.when(F.coalesce(F.size("path_globs"), F.lit(0)) > 0, F.col("path_globs")).otherwise(F.col("__l.path_globs"))
    return made.select("finding_id", "action", *(F.col(f"__l.{c}").alias(c) for c in fields), globs.alias("path_globs"), F.least(F.col("__l.confidence"), F.when(accepted, 0.85).otherwise(0.75)).alias("confidence"), F.greatest(F.col("__l.priority"), F.when(accepted, 65).otherwise(55)).alias("priority"), F.when(accepted, "active").otherwise("draft").alias("status"))


def status_histogram(learnings: DataFrame) -> DataFrame:
    return learnings.groupBy("status").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "status")
