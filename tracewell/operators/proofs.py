"""Reuse of earlier test results: validity layers, coverage, fingerprints, transitions.

Tables: proofs (fingerprint, status, confidence, observed - the files a complete run
touched, null where none was recorded), coverage (fingerprint, path, digest), digests
(path, digest: the current state), changed (fingerprint, pos, path), reach (changed,
covered, reaches; null and missing pairs are unknown).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HERMETIC = ("hermetic_static", "hermetic_unit")
#: Which status may follow which, and what may be reused.
TRANSITIONS = (
    ("running", "passed"), ("running", "failed"), ("running", "aborted"), ("passed", "stale"), ("passed", "expired"), ("passed", "invalidated"), ("failed", "stale"), ("failed", "invalidated"),
)
HARMLESS = ("pure_validation", "reproducible_build")


def validity(proofs: DataFrame, coverage: DataFrame, digests: DataFrame, changed: DataFrame, reach: DataFrame, trust_hermetic: bool = False) -> DataFrame:
    """(fingerprint, valid, layer, reason) of each proof, by the first layer that decides.

    expired, not-passed, covered-changed, unknown-reach, reached, hermetic, observed,
    conservative, unaffected - in this order; unknown-reach and reached by the first
    changed file that decides.  The files that a proof covers meet its changed files, and
    only these pairs meet reachability; a pair that meets nothing is unknown.
    """
    # Covered and changed files are dealt by fingerprint once; what is grouped or joined by it needs no other shuffle.
    coverage, changed = (x.where("fingerprint is not null") for x in (coverage, changed))
    of = coverage.select("fingerprint", "path", "digest").repartition("fingerprint").dropDuplicates(["fingerprint", "path"])
    files = coverage.select("fingerprint", "path").repartition("fingerprint").distinct()
    asked = changed.select("fingerprint", F.col("path").alias("changed"), "pos").repartition("fingerprint")
    now = digests.select("path", F.col("digest").alias("now")).dropDuplicates(["path"])
    stale = of.join(now, "path", "left").where(~F.col("digest").eqNullSafe(F.col("now"))).groupBy("fingerprint").agg(F.count("*").alias("stale"))
    known = reach.where("reaches is not null").select("changed", F.col("covered").alias("path"), "reaches").dropDuplicates(["changed", "path"])
    pairs = files.join(asked.groupBy("fingerprint", "changed").agg(F.min("pos").alias("pos")), "fingerprint").join(known, ["changed", "path"], "left")
    rows = pairs.select("fingerprint", "changed", "pos", "reaches").repartition("fingerprint").groupBy("fingerprint", "changed", "pos").agg(F.bool_or(F.col("reaches").isNull()).alias("unknown"), F.bool_or("reaches").alias("reached"))
    of_change = rows.withColumn("why", F.when(F.col("unknown"), "unknown-reach").when(F.col("reached"), "reached")).groupBy("fingerprint").agg(F.min(F.when(F.col("why").isNotNull(), F.struct("pos", "why")))["why"].alias("why"))
    n = asked.groupBy("fingerprint").agg(F.count("*").alias("n"))
    seen = asked.join(proofs.select("fingerprint", "observed"), "fingerprint").where(F.array_contains("observed", F.col("changed"))).groupBy("fingerprint").agg(F.count("*").alias("seen"))
    all_ = proofs.join(stale, "fingerprint", "left").join(n, "fingerprint", "left").join(of_change, "fingerprint", "left").join(seen, "fingerprint", "left").na.fill(0, ["stale", "n", "seen"])
    ladder = [
        (F.col("status") == "expired", False, "policy-expiry", F.lit("expired")),
        (~F.coalesce(F.col("status") == "passed", F.lit(False)), False, "policy-expiry", F.lit("not-passed")),
        (F.col("stale") > 0, False, "exact-input", F.lit("covered-changed")),
        (F.col("why").isNotNull(), False, "static-reachability", F.col("why")),
        (F.col("n") == 0, True, "exact-input", F.lit("unaffected")),
        (F.lit(trust_hermetic) & F.col("confidence").isin(*HERMETIC), True, "static-reachability", F.lit("hermetic")),
        (F.col("observed").isNotNull() & (F.col("seen") == 0), True, "runtime-observation", F.lit("observed")),
    ]
    last = F.struct(F.lit(False).alias("valid"), F.lit("static-reachability").alias("layer"), F.lit("conservative").alias("reason"))
    for test, valid, layer, reason in reversed(ladder):
        last = F.when(test, F.struct(F.lit(valid).alias("valid"), F.lit(layer).alias("layer"), reason.alias("reason"))).otherwise(last)
    return all_.select("fingerprint", last.alias("v")).select("fingerprint", "v.valid", "v.layer", "v.reason")


def covering(proofs: DataFrame, files: DataFrame) -> DataFrame:
    """(path, fingerprint): proofs whose observation holds each of ``files`` (path)."""
    return proofs.select("fingerprint", F.explode("observed").alias("path")).join(files.select("path").distinct(), "path").select("path", "fingerprint").distinct()


def by_prefix(proofs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(prefix, fingerprint) of prefixes of 12 to 63 hexadecimal digits that exactly one fingerprint begins with."""
    asked = prefixes.select("prefix").where(F.col("prefix").rlike("^[0-9a-f]{12,63}$")).distinct().withColumn("head", F.substring("prefix", 1, 12))
    have = proofs.select("fingerprint", F.substring("fingerprint", 1, 12).alias("head")).distinct()
    hits = asked.join(have, "head").where(F.expr("startswith(fingerprint, prefix)"))
    return hits.groupBy("prefix").agg(F.count("*").alias("n"), F.min("fingerprint").alias("fingerprint")).where("n = 1").select("prefix", "fingerprint")


def transitions(moves: DataFrame) -> DataFrame:
    """``moves`` (before, after) with allowed: whether the second status may follow the first; null ends are not allowed."""
    pair = F.array([F.lit(f"{a}>{b}") for a, b in TRANSITIONS])
    return moves.withColumn("allowed", F.coalesce(F.array_contains(pair, F.concat("before", F.lit(">"), "after")), F.lit(False)))


def reuse(asked: DataFrame, proofs: DataFrame, now: int) -> DataFrame:
    """(id, decision, reason, age) for each of ``asked`` (id, fingerprint) by its proof: execute, no_reuse or reuse.

    proofs: the current view (id, fingerprint, status, confidence, side_effects,
    invalidation, finished); one proof an id.  No proof, another fingerprint, and any
    status but passed execute; a failed proof is evidence and never blocks.  What
    passed is reused only if its effects are HARMLESS and its confidence HERMETIC.
    age is ``now`` less the time it finished, null without one.
    """
    p = proofs.select("id", F.col("fingerprint").alias("of"), "status", "confidence", "side_effects", "invalidation", "finished", F.lit(True).alias("found"))
    rows = asked.join(p, "id", "left")
    status = F.col("status")
    ladder = [
        (F.col("found").isNull(), "execute", F.lit("no-proof")),
        (~F.col("of").eqNullSafe(F.col("fingerprint")), "execute", F.lit("mismatch")),
        (status == "running", "execute", F.lit("in-flight")),
        (status == "failed", "execute", F.lit("failed")),
        (status.isin("stale", "expired", "invalidated"), "execute", F.concat_ws(": ", status, "invalidation")),
        (status == "aborted", "execute", F.lit("aborted")),
        (~F.coalesce(F.col("side_effects").isin(*HARMLESS), F.lit(False)), "no_reuse", F.lit("side-effects")),
        (~F.coalesce(F.col("confidence").isin(*HERMETIC), F.lit(False)), "no_reuse", F.lit("confidence")),
    ]
    found = F.struct(F.lit("reuse").alias("decision"), F.lit("reusable").alias("reason"))
    for test, decision, reason in reversed(ladder):
        found = F.when(test, F.struct(F.lit(decision).alias("decision"), reason.alias("reason"))).otherwise(found)
    return rows.select("id", found.alias("d"), (F.lit(now) - F.col("finished")).alias("age")).select("id", "d.decision", "d.reason", "age")


def select_tests(inventory: DataFrame, proofs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(suite, name, action, reason, fallback): which tests of each suite may reuse their proof, and which run.

    inventory: suite, name, fingerprint.  proofs: fingerprint, status.  verdicts: what
    ``validity`` tells of each fingerprint (a test without a proof is judged by what it
    covers).  A proof that passed and is valid is reused; all else executes.  fallback
    is true for a whole suite where the reach of a change is unknown for any of its
    tests that execute.  Every test of the inventory is told once.
    """
    has = proofs.select("fingerprint", "status").dropDuplicates(["fingerprint"])
    rows = inventory.join(has, "fingerprint", "left").join(verdicts.select("fingerprint", "valid", F.col("reason").alias("why")), "fingerprint", "left")
    kept = F.coalesce(F.col("valid") & (F.col("status") == "passed"), F.lit(False))
    rows = rows.select("suite", "name", F.when(kept, "reuse").otherwise("execute").alias("action"), F.when(F.col("status").isNull(), "no-proof").otherwise(F.coalesce("why", F.lit("no-verdict"))).alias("reason"), (~kept & F.coalesce(F.col("why") == "unknown-reach", F.lit(False))).alias("unknown"))
    # A window, so that the verdicts are not made once for the suites and once for their tests.
    return rows.where("suite is not null").withColumn("fallback", F.bool_or("unknown").over(W.partitionBy("suite"))).drop("unknown")


def broken_chains(events: DataFrame, key: str = "chain") -> DataFrame:
    """(chain, seq) of events (chain, seq, event_id, previous) that do not name the event before them; the first must name none."""
    before = F.lag("event_id").over(W.partitionBy(key).orderBy("seq"))
    return events.withColumn("__want", before).where(~F.col("previous").eqNullSafe(F.col("__want"))).select(key, "seq")
