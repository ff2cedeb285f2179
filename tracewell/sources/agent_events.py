"""Events of agents: raw lines of a protocol as task events, and what they make of a task's record and thread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Requests that ask a person, the mark of a notice that is kept (a host may put its name before it), and the limits of a thread.
DIALOGS = ("select", "confirm", "input", "editor")
MISSING_TOOLS = "requested tools missing in child:"
MOST_ITEMS, OUTPUT_CHARS, TEXT_CHARS = 400, 16_000, 20_000
#: What is said of an answer that failed.
NO_REPORT, REPORTED_ERROR, ABORTED = "assistant returned no final report", "assistant reported an error", "assistant aborted"
DENIED, DENIED_SAID = "Upstream request failed: Model access is disabled", "model access denied (HTTP 403); choose a model available to this account"

FIELDS = {"kind": "string", "text": "string", "call_id": "string", "is_error": "boolean", "tokens": "double", "cost": "double", "outcome": "string", "diagnostic": "string"}
CONTENT = "array<struct<type: string, text: string>>"
MESSAGES = f"array<struct<role: string, stopReason: string, errorMessage: string, content: {CONTENT}>>"


def clean(text: Column) -> Column:
    """Text without terminal sequences and control characters, but for line ends and tabs; null is empty."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), "\x1b\\[[0-?]*[ -/]*[@-~]|\x1b\\][^\x07\x1b]*(?:\x07|\x1b\\\\)?|\x1b.", "")
    return F.regexp_replace(bare, r"[\p{Cc}&&[^\n\t]]", "")


def _content(parts: Column) -> Column:
    """The texts of content parts, a line each."""
    texts = F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: clean(p["text"]))
    return F.coalesce(F.array_join(F.filter(texts, lambda t: t != ""), "\n"), F.lit(""))


def _denied(message: Column) -> Column:
    """What may be said of a provider's error: a known denial, else null, so that no payload is copied."""
    known = F.get_json_object(F.regexp_extract(message, r"(?s)^403:\s*(\{.*\})$", 1), "$.message") == DENIED
    return F.when((F.char_length(message) <= 2048) & known, DENIED_SAID)


def tail(text: Column, most: int) -> Column:
    """``text``, or an ellipsis and its last characters, ``most`` together."""
    return F.when(F.char_length(text) > most, F.concat(F.lit("…"), F.right(text, F.lit(most - 1)))).otherwise(text)


def task_events(raw: DataFrame, mark: str = MISSING_TOOLS) -> DataFrame:
    """(task, pos, n, kind, text, call_id, is_error, tokens, cost, outcome, diagnostic) of raw lines (task, pos, raw): none, one or several each.

    Deltas carry their chunk only; usage counts for assistants; a request counts if it
    asks a person; a notice only if it begins with ``mark``.  Lines that are no JSON or of another
    type give nothing.
    """
    j = lambda p: F.get_json_object("raw", p)
    some = lambda x: F.nullif(x, F.lit(""))

    def event(kind: str, **given: Column) -> Column:
        cells = {"kind": F.lit(kind)} | given
        return F.struct(*[cells.get(c, F.lit(None)).cast(t).alias(c) for c, t in FIELDS.items()])

    one = lambda *a, **k: F.array(event(*a, **k))
    kind, inner, method = j("$.type"), j("$.assistantMessageEvent.type"), j("$.method")
    delta = clean(j("$.assistantMessageEvent.delta"))
    failed = F.coalesce(_denied(j("$.assistantMessageEvent.error.message")), some(clean(j("$.assistantMessageEvent.error.message"))), some(clean(j("$.assistantMessageEvent.reason"))), F.lit("unknown error"))
    call = F.coalesce(j("$.toolCallId"), F.lit(""))
    said = lambda p: _content(F.from_json(j(p), CONTENT))
    assistant = j("$.message.role") == "assistant"
    usage = F.when(assistant & j("$.message.usage").isNotNull(), event("usage", tokens=F.coalesce(j("$.message.usage.totalTokens").try_cast("double"), F.lit(0.0)), cost=F.coalesce(j("$.message.usage.cost.total").try_cast("double"), F.lit(0.0))))
    fatal = F.when(assistant & (j("$.message.stopReason") == "error") & _denied(j("$.message.errorMessage")).isNotNull(), event("fatal_error", text=_denied(j("$.message.errorMessage"))))
    last = F.try_element_at(F.filter(F.from_json(j("$.messages"), MESSAGES), lambda m: m["role"] == "assistant"), F.lit(-1))
    stop, report = F.lower(clean(last["stopReason"])), _content(last["content"])
    outcome = F.when(last.isNull(), "empty").when(stop == "error", "error").when(stop == "aborted", "aborted").when(report != "", "success").otherwise("empty")
    told = F.when(outcome == "error", F.coalesce(_denied(last["errorMessage"]), F.lit(REPORTED_ERROR))).when(outcome == "aborted", ABORTED).when(outcome == "empty", NO_REPORT)
    title = F.coalesce(some(clean(j("$.title"))), some(clean(j("$.message"))), clean(method))
    attempt = lambda p: F.coalesce(j(p), F.lit("?"))
    made = (
        F.when((kind == "message_update") & (inner == "text_delta"), one("text", text=delta)).when((kind == "message_update") & (inner == "thinking_delta"), one("thinking", text=delta))
        .when((kind == "message_update") & (inner == "error"), one("error", text=failed))
        .when(kind == "tool_execution_start", one("tool_start", call_id=call, text=clean(j("$.toolName"))))
        .when(kind == "tool_execution_update", one("tool_update", call_id=call, text=said("$.partialResult.content")))
        .when(kind == "tool_execution_end", one("tool_end", call_id=call, text=said("$.result.content"), is_error=F.coalesce(j("$.isError") == "true", F.lit(False))))
        .when(kind == "message_end", F.array_compact(F.array(usage, fatal))).when(kind == "turn_end", one("turn_end"))
        .when(kind == "agent_end", one("agent_end", text=F.when(outcome == "success", report).otherwise(""), outcome=outcome, diagnostic=told)).when(kind == "agent_settled", one("agent_settled"))
        .when((kind == "extension_ui_request") & (method == "notify") & j("$.message").startswith(mark), one("note", text=clean(j("$.message"))))
        .when((kind == "extension_ui_request") & method.isin(*DIALOGS), one("ask", text=title))
        .when(kind == "auto_retry_start", one("note", text=F.concat(F.lit("retrying ("), attempt("$.attempt"), F.lit("/"), attempt("$.maxAttempts"), F.lit(")"))))
        .when(kind == "extension_error", one("note", text=F.concat(F.lit("extension error: "), clean(j("$.error")))))
    )
    return raw.select("task", "pos", F.posexplode(made).alias("n", "e")).select("task", "pos", "n", "e.*")


def task_records(tasks: DataFrame, events: DataFrame) -> DataFrame:
    """The records of tasks (task, status, last_step) after their events: status, last_step, tool_calls, turns, tokens, cost, result, error.

    A question makes a task wait, and any other event makes a waiting one run.  The
    last tool, end, error or question is the last step; text makes "writing" of a step
    that is "queued" or "starting".  A task without events stays as it is.
    """
    kind, at = F.col("kind"), F.struct("pos", "n")
    label = (
        F.when(kind == "tool_start", F.col("text")).when((kind == "agent_end") & (F.col("outcome") == "success"), "responded").when(kind == "agent_end", F.coalesce("diagnostic", F.lit("assistant failed")))
        .when(kind.isin("error", "fatal_error"), F.concat(F.lit("error: "), "text")).when(kind == "ask", F.concat(F.lit("asked: "), "text"))
    )
    newest = lambda test, **cells: F.max(F.when(test, F.struct(at.alias("at"), *[c.alias(k) for k, c in cells.items()])))
    found = events.groupBy("task").agg(
        F.count_if(kind == "tool_start").alias("tool_calls"), F.count_if(kind == "turn_end").alias("turns"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"), newest(F.lit(True), kind=kind).alias("last"),
        F.bool_or(kind == "ask").alias("asked"), newest(label.isNotNull(), label=label).alias("step"), newest(kind == "text", text=F.lit(1)).alias("wrote"), newest(kind == "agent_end", outcome=F.col("outcome"), text=F.col("text"), diagnostic=F.col("diagnostic")).alias("end"),
    )
    rows = tasks.select("task", "status", "last_step").join(found, "task", "left")
    step = F.coalesce("step.label", "last_step")
    writes = step.isin("queued", "starting") & F.col("wrote").isNotNull() & (F.col("step").isNull() | (F.col("wrote.at") > F.col("step.at")))
    status = F.when(F.col("last.kind") == "ask", "waiting").when(F.col("asked") | (F.col("last").isNotNull() & (F.col("status") == "waiting")), "running").otherwise(F.col("status"))
    good = F.col("end.outcome") == "success"
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("task", status.alias("status"), F.when(writes, "writing").otherwise(step).alias("last_step"), count("tool_calls"), count("turns"), count("tokens"), count("cost"), F.when(good, F.col("end.text")).alias("result"), F.when(~good, F.col("end.diagnostic")).alias("error"))


def task_threads(events: DataFrame, most: int = MOST_ITEMS, output_chars: int = OUTPUT_CHARS, text_chars: int = TEXT_CHARS) -> DataFrame:
    """The last ``most`` items of each task's thread: task, item (from 0), kind, text, call_id, output, running, is_error, dropped.

    Text, and thinking, that no other item interrupts is one item, of which the last
    ``text_chars`` characters are kept.  A tool's output is that of its last update, its
    last ``output_chars`` characters; of tools with one call id the first takes the
    updates, and those before it are lost.  Errors, questions and notes are notes.
    dropped is how many items went before.  No more of an item's chunks are gathered
    than its kept characters need.
    """
    at, kind = F.struct("pos", "n"), F.col("kind")
    flow = kind.isin("text", "thinking")
    made = events.where((flow & (F.col("text") != "")) | kind.isin("tool_start", "error", "fatal_error", "ask", "note")).withColumn("at", at)
    step = W.partitionBy("task").orderBy("at")
    begins = F.when(flow & F.coalesce(F.lag("kind").over(step) == kind, F.lit(False)), 0).otherwise(1)
    rows = made.withColumn("begins", begins).withColumn("item", F.sum("begins").over(step) - 1)
    rows = rows.withColumn("items", F.max("item").over(W.partitionBy("task")) + 1).where(F.col("item") >= F.col("items") - most)
    after = F.coalesce(F.sum(F.char_length("text")).over(W.partitionBy("task", "item").orderBy(F.desc("at")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    kept = rows.withColumn("after", after).where(F.col("after") <= text_chars)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "")
    items = kept.groupBy("task", "item").agg(F.min("kind").alias("of"), F.min("at").alias("at"), F.min("call_id").alias("call_id"), F.min("items").alias("items"), text.alias("text"))
    first = made.where("kind = 'tool_start'").groupBy("task", "call_id").agg(F.min("at").alias("at"))
    changes = events.where(kind.isin("tool_update", "tool_end")).withColumn("u_at", at).join(first, ["task", "call_id"]).where(F.col("u_at") > F.col("at"))
    newest = changes.groupBy("task", "call_id", "at").agg(F.max_by("text", "u_at").alias("output"), F.bool_or(kind == "tool_end").alias("ended"), F.max(F.when(kind == "tool_end", F.struct("u_at", "is_error")))["is_error"].alias("failed"))
    out = items.join(newest, ["task", "call_id", "at"], "left")
    tool = F.col("of") == "tool_start"
    note = F.when(F.col("of").isin("error", "fatal_error"), F.concat(F.lit("error: "), "text")).when(F.col("of") == "ask", F.concat(F.lit("asked: "), "text")).otherwise(F.col("text"))
    return out.select(
        "task", "item", F.when(tool, "tool").when(F.col("of").isin("text", "thinking"), F.col("of")).otherwise("note").alias("kind"), F.when(F.col("of").isin("text", "thinking"), tail(F.col("text"), text_chars)).otherwise(note).alias("text"), F.when(tool, F.col("call_id")).alias("call_id"),
        F.when(tool, tail(F.coalesce("output", F.lit("")), output_chars)).alias("output"), F.when(tool, ~F.coalesce("ended", F.lit(False))).alias("running"), F.when(tool, F.coalesce("failed", F.lit(False))).alias("is_error"), F.greatest(F.lit(0), F.col("items") - most).alias("dropped"),
    )
