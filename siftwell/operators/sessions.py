"""The events of agents' sessions folded to one record each: state, last response, errors, tools and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordering

#: Characters of a response or error that a record keeps.
PREVIEW = 12_000
#: Types of events. PROMPT_END is the last of a session, with its final text or error.
THINKING, DELTA, MESSAGE_END, TOOL_START, TOOL_END, AGENT_END, PROMPT_END = "thinking_delta", "text_delta", "message_end", "tool_execution_start", "tool_execution_end", "agent_end", "prompt_end"
_COLUMNS = {"role": "string", "tool": "string", "text": "string", "error": "string", "is_error": "boolean", "aborted": "boolean", "input_tokens": "long", "output_tokens": "long"}


def preview(text: Column, most: int = PREVIEW) -> Column:
    """White space drawn together, and cut to `most` characters with dots at the end."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(?U)[\s\x{FEFF}]+", " "), "^ | $", "")
    return F.when(F.length(plain) > most, F.concat(F.substring(plain, 1, most - 3), F.lit("..."))).otherwise(plain)


def fold_sessions(events: DataFrame, key: str = "session", seq: str = "seq", most: int = PREVIEW) -> DataFrame:
    """One row a key: status, thinking, last_activity, last_response, last_error, messages, tools_started, tools_failed,
    input_tokens, output_tokens and last_seq, after all events of it in order of seq (unique within a key; ties are taken
    in any order). events: key, seq, type and those of role, tool, text, error, is_error, aborted, input_tokens and
    output_tokens that there are. Unknown types change counts of nothing; null keys are one session; no events give no
    row.

    A text delta adds to the message that is open, an assistant's message end closes it. What a field holds is the last
    value that an event gave it, and usage is summed: both are aggregates that tasks make for their parts of a log and
    that are then merged. Which message a delta belongs to is a running sum over the whole log, cut into parts, so no key is
    gathered; of the last open message only as many deltas are put together as the preview shows."""
    for column, kind in _COLUMNS.items():
        if column not in events.columns:
            events = events.withColumn(column, F.lit(None).cast(kind))
    e = events.select(F.col(key).alias("k"), F.col(seq).alias("s"), "type", *_COLUMNS)
    of = lambda *types: F.coalesce(F.col("type").isin(*types), F.lit(False))
    assistant, result = of(MESSAGE_END) & F.col("role").eqNullSafe("assistant"), of(MESSAGE_END) & F.col("role").eqNullSafe("toolResult")
    failed, empty = F.col("error").isNotNull(), F.lit("")
    text, tool = F.coalesce("text", empty), F.coalesce("tool", empty)
    said = assistant & ~failed & (preview(text, most) != "")
    activity = (
        F.when(of(THINKING), "thinking").when(of(DELTA), "responding").when(assistant & failed, "assistant error").when(said, "assistant message complete")
        .when(result, F.concat(F.lit("tool "), tool)).when(of(TOOL_START), F.concat(F.lit("running "), tool))
        .when(of(TOOL_END), F.concat(F.when(F.col("is_error"), "failed ").otherwise("finished "), tool))
        .when(of(PROMPT_END), F.when(F.col("aborted"), "aborted").when(failed, "error").otherwise("completed"))
    )
    status = F.when(of(PROMPT_END), F.when(F.col("aborted"), "aborted").when(failed, "error").otherwise("completed")).when(assistant & failed, "error")
    thinking = F.when(of(THINKING), True).when(of(DELTA, TOOL_START, AGENT_END, PROMPT_END) | assistant | result, False)
    error = F.when(assistant & failed, preview(F.col("error"), most)).when(of(PROMPT_END) & (failed | F.col("aborted")), F.coalesce("error", empty))
    whole = F.when(said | (of(PROMPT_END) & ~failed & ~F.coalesce("aborted", F.lit(False))), preview(text, most))

    # How many messages of the whole log, and how many characters of deltas, come before each event.
    signs = F.length(F.regexp_replace(text, r"(?U)[\s\x{FEFF}]+", ""))
    ran = ordering.running_sums(e.withColumns({"__end": assistant.cast("int"), "__signs": F.when(of(DELTA), signs).otherwise(0)}), ["k", "s"], {"__end": "message", "__signs": "upto"})
    told = F.when(of(DELTA) | whole.isNotNull(), F.struct("s", F.when(of(DELTA), F.col("message")).alias("message"), whole.alias("whole")))
    last = lambda value: F.max(F.when(value.isNotNull(), F.struct("s", value.alias("value"))))["value"]
    folded = ran.groupBy("k").agg(
        F.coalesce(last(status), F.lit("running")).alias("status"), F.coalesce(last(thinking), F.lit(False)).alias("thinking"), F.coalesce(last(activity), F.lit("starting")).alias("last_activity"),
        last(error).alias("last_error"), F.max(told).alias("__told"), F.count(F.when(assistant, 1)).alias("messages"), F.count(F.when(of(TOOL_START), 1)).alias("tools_started"),
        F.count(F.when(of(TOOL_END) & F.col("is_error"), 1)).alias("tools_failed"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"), F.max("s").alias("last_seq"),
    )
    folded = ordering.settled(folded)

    # The deltas of the message that the last response comes from, where that is still open or ended without a text.
    opened = folded.filter("__told.message IS NOT NULL").select(F.col("k").alias("ok"), F.col("__told.message").alias("om"))
    deltas = ran.filter(of(DELTA)).join(opened, F.col("k").eqNullSafe(F.col("ok")) & (F.col("message") == F.col("om"))).select("k", "s", "upto", F.col("upto") - F.col("__signs"), F.regexp_replace(text, r"(?U)[\s\x{FEFF}]+", " ").alias("part"), "__signs").toDF("k", "s", "upto", "before", "part", "signs")
    start = deltas.groupBy("k").agg(F.min("before").alias("first")).withColumnRenamed("k", "fk")
    near = deltas.join(start, F.col("k").eqNullSafe(F.col("fk"))).filter(F.col("before") - F.col("first") <= most)
    blank = near.filter("signs = 0 AND part != ''").dropDuplicates(["k", "upto"])  # neighbours that hold white space only
    parts = near.filter("signs > 0").unionByName(blank).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("s", "part"))).alias("parts"))
    joined = parts.select(F.col("k").alias("pk"), preview(F.array_join(F.transform("parts", lambda p: p["part"]), ""), most).alias("typed"))
    response = F.when(F.col("__told.message").isNotNull(), F.coalesce("typed", empty)).otherwise(F.col("__told.whole"))
    out = folded.join(joined, F.col("k").eqNullSafe(F.col("pk")), "left").withColumn("last_response", response)
    return out.select(F.col("k").alias(key), "status", "thinking", "last_activity", "last_response", "last_error", "messages", "tools_started", "tools_failed", "input_tokens", "output_tokens", F.col("last_seq"))
