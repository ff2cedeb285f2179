"""Overlap of path scopes: globs that two writers claim, and which of them could name one file.

A scope is a relative path with ``*``, ``?``, one level of braces, and ``**`` as a
whole part.  A shorter scope covers what lies below it.  What cannot be read as such
(null, absolute, with "..", classes, groups, nested braces) overlaps everything.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .spread import dealt, lists

#: Characters that make a part a pattern, and those that are never read.
WILD, OPAQUE = re.compile(r"[*?{}]"), re.compile(r"[\[\]()\\]")
BULLET = re.compile(r"^(?:[-*+]|\d+[.)]) +")


def parts_of(scope: str | None) -> list[str] | None:
    """Lower-case parts of a scope; None where it cannot be read."""
    text = BULLET.sub("", (scope or "").strip())
    if len(text) > 1 and text[0] == text[-1] == "`" and "`" not in text[1:-1]:
        text = text[1:-1]
    if not text or re.match(r"/|~|[A-Za-z]:", text) or OPAQUE.search(text):
        return None
    parts = [p.lower() for p in text.split("/") if p not in ("", ".")]
    flat = [re.sub(r"\{[^{}]*\}", "", p) for p in parts]
    return None if not parts or ".." in parts or any("{" in p or "}" in p for p in flat) else parts


def _pattern(part: str) -> re.Pattern:
    out, inside = [], False
    for token in re.split(r"([*?{},])", part):
        inside = token == "{" or (inside and token != "}")
        out.append({"*": ".*", "?": ".", "{": "(?:", "}": ")"}.get(token) or ("|" if token == "," and inside else re.escape(token)))
    return re.compile("".join(out), re.S)


def _meet(a: str, b: str) -> bool:
    """Whether one name could match both parts."""
    wild = [bool(WILD.search(x)) for x in (a, b)]
    if not any(wild):
        return a == b
    if not (a + b).isascii():
        return True
    if all(wild):
        head, tail = [WILD.split(x)[0] for x in (a, b)], [WILD.split(x)[-1] for x in (a, b)]
        return (head[0].startswith(head[1]) or head[1].startswith(head[0])) and (tail[0].endswith(tail[1]) or tail[1].endswith(tail[0]))
    pattern, name = (a, b) if wild[0] else (b, a)
    return _pattern(pattern).fullmatch(name) is not None


def overlap(a: str | None, b: str | None) -> bool:
    left, right = parts_of(a), parts_of(b)
    if left is None or right is None:
        return True
    for x, y in zip(left, right, strict=False):
        if "**" in (x, y):
            return True
        if not _meet(x, y):
            return False
    return True


PART = "array<struct<part: string, wild: boolean, pattern: string, head: string, tail: string, ascii: boolean>>"


def _told(scope: str | None) -> str | None:
    parts = parts_of(scope)
    if parts is None:
        return None
    wild = [bool(WILD.search(p)) for p in parts]
    return json.dumps([{"part": p, "wild": w, "pattern": f"^(?s:{_pattern(p).pattern})$" if w else None, "head": WILD.split(p)[0], "tail": WILD.split(p)[-1], "ascii": p.isascii()} for p, w in zip(parts, wild, strict=True)])


def _read(scopes: DataFrame, key: str, name: str) -> DataFrame:
    """Distinct (key, name, ``name``_parts, ``name``_plain): each scope read once; plain is how many of its first parts are no patterns, 0 where it cannot be read."""
    told = F.pandas_udf(lambda s: s.map(_told), StringType())
    rows = scopes.select(F.col("id").alias(key), F.col("scope").alias(name)).distinct().withColumn(f"{name}_parts", F.from_json(told(name), PART))
    first = F.array_position(F.transform(f"{name}_parts", lambda x: x["wild"]), True)
    return rows.withColumn(f"{name}_plain", F.coalesce(F.when(first > 0, first - 1).otherwise(F.size(f"{name}_parts")), F.lit(0)).cast("int")).withColumn(f"{name}_plain", F.when(F.col(f"{name}_parts").isNull(), 0).otherwise(F.col(f"{name}_plain")))


def _meets(x: Column, y: Column) -> Column:
    """Whether one name could match both parts, as ``_meet``."""
    either = lambda test: test(x, y) | test(y, x)
    both = either(lambda a, b: a["head"].startswith(b["head"])) & either(lambda a, b: a["tail"].endswith(b["tail"]))
    return (
        F.when(~x["wild"] & ~y["wild"], x["part"] == y["part"]).when(~x["ascii"] | ~y["ascii"], True).when(x["wild"] & y["wild"], both)
        .when(x["wild"], F.call_function("rlike", y["part"], x["pattern"])).otherwise(F.call_function("rlike", x["part"], y["pattern"]))
    )


def overlapping(asked: DataFrame, scopes: DataFrame) -> DataFrame:
    """(id, scope, other_id, other) of each asked scope (id, scope) with each of ``scopes`` that it overlaps.

    Scopes are paths in a trie of parts.  Two of them can overlap only if the plain
    beginning of one leads along that of the other: each scope stands at the node of
    its whole plain beginning and asks at this node and all above, so that scopes
    meet by equality, each pair once.  What is left of a pair - patterns, and parts up
    to the first ``**`` - is decided by expressions.  A scope that begins with a
    pattern or cannot be read stands at the root, which all ask.  All this is done once
    for each distinct text; the ids of a pair of texts come last, from arrays.
    """
    text = lambda df: df.select("id", "scope", F.to_json(F.array("scope")).alias("text")).distinct()
    of, others = text(asked), text(scopes)
    a, b = [_read(x.select(F.col("text").alias("id"), "scope").distinct(), key, name) for x, key, name in ((of, "id", "scope"), (others, "other_id", "other"))]
    node = lambda name, n: F.to_json(F.transform(F.slice(F.coalesce(f"{name}_parts", F.array().cast(PART)), F.lit(1), n), lambda x: x["part"]))
    stands = lambda df, name: df.withColumn("node", node(name, F.col(f"{name}_plain")))
    asks = lambda df, name, least: df.withColumn("up", F.explode(F.sequence(F.lit(0), F.col(f"{name}_plain") - least))).withColumn("node", node(name, F.col("up"))).drop("up")
    # The asked scope's beginning is the shorter one or as long, or else it is the longer one.
    pairs = stands(a, "scope").join(asks(b, "other", 0), "node").unionByName(asks(a.where("scope_plain > 0"), "scope", 1).join(stands(b, "other"), "node"))
    till = lambda name: F.coalesce(F.nullif(F.array_position(F.transform(f"{name}_parts", lambda x: x["part"]), F.lit("**")) - 1, F.lit(-1)), F.size(f"{name}_parts"))
    both = F.arrays_zip(F.slice("scope_parts", F.lit(1), F.least(till("scope"), till("other")).cast("int")).alias("x"), F.slice("other_parts", F.lit(1), F.least(till("scope"), till("other")).cast("int")).alias("y"))
    hit = F.forall(both, lambda p: _meets(p["x"], p["y"]))
    met = pairs.where(F.coalesce(hit, F.lit(True))).select(F.col("id").alias("text"), "scope", F.col("other_id").alias("other_text"), "other").distinct()
    found = met.join(lists(of, ["text"], F.col("id"), "ids"), "text").drop("text")
    both = dealt(found, lists(others.withColumnRenamed("text", "other_text"), ["other_text"], F.col("id"), "others"), ["other_text"], "others", 4)
    return both.select("ids", "scope", F.explode("others").alias("other_id"), "other").select(F.explode("ids").alias("id"), "scope", "other_id", "other")
