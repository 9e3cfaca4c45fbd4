"""The fold of session events against one that goes through them in order."""

import random
import re

import pytest

from siftwell.operators import sessions

COLUMNS = "session string, seq long, type string, role string, tool string, text string, error string, is_error boolean, aborted boolean, input_tokens long, output_tokens long"


def preview(text, most):
    plain = re.sub(r"\s+", " ", text).strip()
    return plain[: most - 3] + "..." if len(plain) > most else plain


def plain(events, most):
    out = {}
    for key, seq, kind, role, tool, text, error, is_error, aborted, tokens_in, tokens_out in sorted(events, key=lambda e: (e[0] or "", e[1])):
        r = out.setdefault(key, {"status": "running", "thinking": False, "last_activity": "starting", "last_response": None, "last_error": None, "messages": 0, "tools_started": 0, "tools_failed": 0, "input_tokens": 0, "output_tokens": 0, "open": ""})
        r["input_tokens"] += tokens_in or 0
        r["output_tokens"] += tokens_out or 0
        r["last_seq"] = seq
        text, name = text or "", tool or ""
        if kind == "thinking_delta":
            r |= {"thinking": True, "last_activity": "thinking"}
        elif kind == "text_delta":
            r["open"] += text
            r |= {"thinking": False, "last_activity": "responding", "last_response": preview(r["open"], most)}
        elif kind == "message_end" and role == "assistant":
            r |= {"thinking": False, "open": "", "messages": r["messages"] + 1}
            if error is not None:
                r |= {"status": "error", "last_error": preview(error, most), "last_activity": "assistant error"}
            elif preview(text, most):
                r |= {"last_response": preview(text, most), "last_activity": "assistant message complete"}
        elif kind == "message_end" and role == "toolResult":
            r |= {"thinking": False, "last_activity": f"tool {name}"}
        elif kind == "tool_execution_start":
            r |= {"thinking": False, "last_activity": f"running {name}", "tools_started": r["tools_started"] + 1}
        elif kind == "tool_execution_end":
            r |= {"last_activity": f"{'failed' if is_error else 'finished'} {name}", "tools_failed": r["tools_failed"] + bool(is_error)}
        elif kind == "agent_end":
            r["thinking"] = False
        elif kind == "prompt_end":
            state = "aborted" if aborted else "error" if error is not None else "completed"
            r |= {"status": state, "last_activity": state, "thinking": False}
            r |= {"last_error": error or ""} if state != "completed" else {"last_response": preview(text, most)}
    for r in out.values():
        del r["open"]
    return out


def log(seed, n):
    draw = random.Random(seed)
    kinds = ["thinking_delta", *["text_delta"] * 6, "message_end", "message_end", "tool_execution_start", "tool_execution_end", "agent_end", "prompt_end", "other", None]
    rows = []
    for k in range(n):
        kind = draw.choices(kinds, [4, *[3] * 6, 2, 1, 2, 2, 1, 0.3, 1, 1])[0]
        text = draw.choice([None, "", " ", "\n\t", "word ", "é and more\n", " x", "long " * 6])
        rows.append((draw.choice(["hot"] * 6 + ["a", "b", None]), k, kind, draw.choice(["assistant", "assistant", "toolResult", "user", None]), draw.choice(["read", None]), text, draw.choice([None, None, None, " b  ad "]), draw.choice([True, False, None]), draw.choice([True, False, None]), draw.choice([None, 3]), draw.choice([None, 5])))
    return rows


@pytest.mark.parametrize("seed,n,most", [(1, 400, 12), (2, 60, 30), (3, 60, 5), (4, 300, 10_000)])
def test_fold(spark, seed, n, most):
    rows = log(seed, n)
    found = sessions.fold_sessions(spark.createDataFrame(rows, COLUMNS).repartition(3), most=most).collect()
    assert {r["session"]: {c: r[c] for c in r.asDict() if c != "session"} for r in found} == plain(rows, most)


def test_few_columns_and_none(spark):
    events = spark.createDataFrame([("a", 1, "text_delta", "hi"), ("a", 2, "text_delta", " you")], "session string, seq int, type string, text string")
    row = sessions.fold_sessions(events).first()
    assert (row["last_response"], row["status"], row["last_activity"], row["input_tokens"]) == ("hi you", "running", "responding", 0)
    assert sessions.fold_sessions(events.limit(0)).count() == 0
