"""Rollups of measures that are reported, unavailable or unsupported, and other summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import half_up
from ..functions.strings import extension, path_tokens
from .snapshots import _cut

#: Lines of a large change, most lines of a correction, and the lenses of a full review.
SLICE_LINES, MOST_BUDGET = 400, 200
LENSES = ("review-risk", "review-resilience", "review-readability", "review-reliability")
#: Patterns over paths that decide a change's size, route and risk.
GENERATED = r"(^|/)(pnpm-lock\.yaml|package-lock\.json|yarn\.lock|bun\.lockb?|Cargo\.lock|go\.sum|poetry\.lock|composer\.lock|Gemfile\.lock)$|\.min\.(js|css)$"
GOLDEN = r"^testdata/golden(?:/|$)"
DOCUMENT = r"(?i)(?:^|/)(?:readme|changelog|contributing|license)(?:\.(?:md|mdx|rst|adoc|txt))?$|(?:^|/)(?:docs?|documentation)/.+\.(?:md|mdx|rst|adoc|txt)$"
CONFIGURATION = r"(?i)(?:^|/)(?:requirements(?:-[^/]*)?\.txt|cmakelists\.txt|package(?:-lock)?\.json|pnpm-lock\.yaml|yarn\.lock|tsconfig(?:\.[^/]*)?\.json|dockerfile|makefile|\.env(?:\.[^/]*)?|[^/]+\.(?:jsonc?|ya?ml|toml|ini|conf|config|lock))$"
SENSITIVE = r"(?i)(?:^|/)(?:\.env(?:\.[^/]*)?|(?:env(?:ironment)?|credentials?|secrets?|tokens?|permissions?|polic(?:y|ies)|security)\.(?:jsonc?|ya?ml|toml|ini|conf|config))$"
RUNTIME_MARKDOWN = r"(?i)(?:^|/)(?:assets/agents/[^/]+\.md|skills/[^/]+/skill\.md)$"
HOT = r"(?i)(?:^|/)(?:auth|update|security|payments)(?:/|$)"
RISK = r"(?i)(?:^|/)(?:auth|security|payments|permissions?|secrets?|credentials?|tokens?|polic(?:y|ies))(?:/|$)|(?:package(?:-lock)?\.json|pnpm-lock\.yaml|yarn\.lock)$"
RESILIENCE = r"(?i)(?:^|/)(?:update|deploy|deployment|infra|infrastructure|ops|migrations?|rollback|recovery)(?:/|$)"
RELIABILITY = r"(?i)(?:^|/)(?:tests?|specs?|runtime|api)(?:/|$)|(?:\.test|\.spec)\.[^/]+$"
RISK_WORD = r"^(?:auth|authentication|authorization|update|updater|security|payments?|permissions?|shell|process|processes|secrets?|credentials?|tokens?)$"
RISK_PHRASE = r"(?i)(?:data[-_/ ]?(?:exposure|loss)|privilege[-_/ ]?escalation)"


def first_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; a minimum with map-side combination."""
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.groupBy(F.col(key).alias("__key")).agg(F.min_by(whole, order).alias("__row")).select("__row.*")


MOST_TOKENS, MOST_MS = 1_000_000_000, 86_400_000


def valid(tokens: list[str], headers: str = "headers", full: str = "full"):
    """Whether a response's measures are sound; each measure m has columns m_state and m.

    A token count is a whole number from 0 to 10**9 where reported, a time from 0 to a
    day where measured; unavailable and unsupported ones have no value.  Headers do
    not come after the full response where both are measured.
    """

    def sound(m: str, present: str, most: int):
        state, value = F.col(f"{m}_state"), F.col(m)
        inside = (value >= 0) & (value <= most)
        if present == "reported":
            inside = inside & (value == F.floor(value))
        return F.coalesce(F.when(state == present, inside).when(state.isin("unavailable", "unsupported"), value.isNull()), F.lit(False))

    out = sound(headers, "measured", MOST_MS) & sound(full, "measured", MOST_MS)
    for m in tokens:
        out = out & sound(m, "reported", MOST_TOKENS)
    both = (F.col(f"{headers}_state") == "measured") & (F.col(f"{full}_state") == "measured")
    return out & F.coalesce(~both | (F.col(headers) <= F.col(full)), F.lit(False))


def rollup_all(responses: DataFrame, dims: list[str], measures: list[str], arrival: str, key: str) -> DataFrame:
    """Per group of all ``dims``: responses, and of each measure the count of each state and the sum of what is reported or measured.

    One response per key, the first to arrive; null dims are a group of their own.
    There is no capacity: nothing is refused or evicted.
    """
    aggregates = []
    for m in measures:
        state = F.col(f"{m}_state")
        aggregates += [F.count_if(state.isin("reported", "measured")).alias(f"{m}_present"), F.count_if(state == "unavailable").alias(f"{m}_unavailable"), F.count_if(state == "unsupported").alias(f"{m}_unsupported"), F.sum(F.when(state.isin("reported", "measured"), F.col(m)).otherwise(0)).alias(f"{m}_sum")]
    return first_of(responses, key, arrival).groupBy(*dims).agg(F.count("*").alias("responses"), *aggregates)


def evidence(response: str, selected: str, observed: str):
    """(model, source): the response's model, else the selected, else the observed, which is labelled selected, else unknown."""
    r, s, o = F.col(response), F.col(selected), F.col(observed)
    model = F.coalesce(r, s, o, F.lit("unknown"))
    source = F.when(r.isNotNull(), "response").when(s.isNotNull() | o.isNotNull(), "selected").otherwise("unknown")
    return model, source


def composition(launches: DataFrame, dims: list[str], status: str = "status") -> DataFrame:
    """Launches by ``dims``, with how many are settled and a count of each status."""
    kinds = ("running", "queued", "waiting", "finished")
    known = F.when(F.col(status).isin("running", "queued", "waiting"), F.col(status)).otherwise("finished")
    return launches.groupBy(*dims).agg(F.count("*").alias("launches"), *[F.count_if(known == k).alias(k) for k in kinds])


def rollup(responses: DataFrame, dims: list[str], measure: str, state: str, arrival: str, key: str) -> DataFrame:
    """Per group: responses, each state's count, and the sum of what was reported; one response per key, the first."""
    once = first_of(responses, key, arrival)
    states = [F.count_if(F.col(state) == s).alias(s) for s in ("reported", "unavailable", "unsupported")]
    return once.groupBy(*dims).agg(F.count("*").alias("responses"), *states, F.sum(F.when(F.col(state) == "reported", F.col(measure)).otherwise(0)).alias("total"))


def allowance(limits: DataFrame) -> DataFrame:
    """Per family: sum of used over sum of budget in percent - only where every member has a budget above 0; a null use counts as 0."""
    percent = F.when(F.every(F.coalesce(F.col("budget") > 0, F.lit(False))), half_up(F.try_divide(F.sum(F.coalesce("used", F.lit(0))), F.sum("budget")) * 100, 4))
    return limits.groupBy("family").agg(F.count("*").alias("members"), percent.alias("percent"))


def nearest_rank(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Nearest-rank percentiles and the upper median of each group, selected from sorted ranges.

    Equal values are counted first.  Distinct values are dealt by ranges of (keys,
    value), so that a group of any number of them spreads over many tasks; the counts
    of the ranges before give each range its first rank, and only the ranges' own
    values are summed in a task.  Null keys are a group of their own.
    """
    counts = _cut(rows.groupBy(*keys, value).agg(F.count("*").alias("__n")).repartitionByRange(*keys, value).withColumn("__part", F.spark_partition_id()))
    of = W.partitionBy(*keys)
    spans = counts.groupBy(*keys, "__part").agg(F.sum("__n").alias("__sum"))
    spans = spans.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p"), F.sum("__sum").over(of).alias("n"), F.coalesce(F.sum("__sum").over(of.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    placed = counts.join(spans, same).withColumn("upto", F.col("__before") + F.sum("__n").over(W.partitionBy(*keys, "__part").orderBy(value)))
    at = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col(value)))
    p = lambda q: at(F.greatest(F.lit(1), F.ceil(F.col("n") * q)))
    return placed.groupBy(*keys).agg(F.min(value).alias("least"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.max(value).alias("most"), at(F.floor(F.col("n") / 2) + 1).alias("upper_median"))


def flood(lines: DataFrame, key: str, ms: str, window_ms: int, most: int) -> DataFrame:
    """Lines at which more than ``most`` lines of the key fall into the last ``window_ms`` milliseconds; adds recent, their number."""
    recent = W.partitionBy(key).orderBy(ms).rangeBetween(-(window_ms - 1), 0)
    return lines.withColumn("recent", F.count("*").over(recent)).where(F.col("recent") > most)


def latch(values: DataFrame, key: str, order: list[str], value: str, at: float) -> DataFrame:
    """Rows that fire: the first at or over ``at`` since the last below it; null leaves the state as it is."""
    step = W.partitionBy(key).orderBy(*order)
    high = F.when(F.col(value).isNotNull(), F.col(value) >= at)
    before = F.last(high, ignorenulls=True).over(step.rowsBetween(W.unboundedPreceding, -1))
    return values.withColumn("__fires", high & ~F.coalesce(before, F.lit(False))).where("__fires").drop("__fires")


def risk(changes: DataFrame, keys: list[str], most_lines: int = SLICE_LINES) -> DataFrame:
    """Per key of changes (keys, path, added, deleted, opaque): lines, tier, budget and lenses by the paths' own risk.

    Generated goldens count nowhere, opaque changes (binaries and modes) have no lines.
    high where the lines are more than ``most_lines`` or a path has a word or phrase of
    high risk; low where nothing is opaque or configuration and all is documentation,
    as where nothing is left; else medium.  The budget is half of the lines, at most
    MOST_BUDGET.
    """
    path, authored = F.col("path"), ~F.col("path").rlike(GOLDEN)
    opaque = F.coalesce(F.col("opaque"), F.lit(False))
    grave = path.rlike(RISK_PHRASE) | F.exists(path_tokens(path), lambda x: x.rlike(RISK_WORD))
    some = lambda test: F.coalesce(F.bool_or(authored & test), F.lit(False))
    lines = F.sum(F.when(authored & ~opaque, F.coalesce("added", F.lit(0)) + F.coalesce("deleted", F.lit(0))).otherwise(0)).cast("long")
    document = path.rlike(DOCUMENT) | extension(path).isin(".md", ".mdx", ".rst", ".adoc")
    flags = changes.groupBy(*keys).agg(
        lines.alias("lines"), some(grave).alias("grave"), some(opaque).alias("opaque"), some(path.rlike(CONFIGURATION)).alias("configuration"), some(~document).alias("other"), some(path.rlike(RESILIENCE)).alias("resilience"), some(path.rlike(RELIABILITY)).alias("reliability")
    )
    high = (F.col("lines") > most_lines) | F.col("grave")
    low = ~high & ~F.col("opaque") & ~F.col("configuration") & ~F.col("other")
    lens = F.when(F.col("resilience"), "review-resilience").when(F.col("reliability"), "review-reliability").otherwise("review-readability")
    budget = F.least(F.lit(MOST_BUDGET), F.ceil(F.col("lines") / 2)).cast("long")
    return flags.select(*keys, "lines", F.when(high, "high").when(low, "low").otherwise("medium").alias("tier"), budget.alias("budget"), F.when(high, ",".join(LENSES)).when(low, "").otherwise(lens).alias("lenses"))


def latest(records: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The latest record per key."""
    whole, at = F.struct(*[F.col(f"`{c}`") for c in records.columns]), F.struct(*[F.col(c) for c in order])
    return records.groupBy(F.col(key).alias("__key")).agg(F.max_by(whole, at).alias("__row")).select("__row.*")


def routing(members: DataFrame) -> DataFrame:
    """Per model: how many members, and their names sorted (a bounded configuration table)."""
    return members.groupBy("model").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("member")), ",").alias("members"))


def families(limits: DataFrame) -> DataFrame:
    """Limits (name, used, budget) with family (leading letters of the name, in lower case), percent and the order in which a panel lists them.

    Families come by their own percent, or their first member's where they have
    none, and members by percent; equals by name.  place counts from 1 within the
    family, family_percent is null where a member has no budget.
    """
    named = limits.withColumn("family", F.lower(F.regexp_extract("name", r"^([A-Za-z]*)", 1)))
    own = half_up(F.try_divide(F.coalesce("used", F.lit(0)), F.when(F.col("budget") > 0, F.col("budget"))) * 100, 4)
    rows = named.withColumn("percent", own).join(allowance(named).select("family", F.col("percent").alias("family_percent")), "family")
    step = W.partitionBy("family").orderBy(F.desc_nulls_last("percent"), "name")
    return rows.withColumn("place", F.row_number().over(step).cast("long")).select("family", "name", "percent", "family_percent", "place")


def status_histogram(tasks: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """Per key: running, queued, waiting, and all others as finished."""
    is_ = lambda k: F.count_if(F.coalesce(F.col(status) == k, F.lit(False)))
    rest = F.count_if(~F.coalesce(F.col(status).isin("running", "queued", "waiting"), F.lit(False)))
    return tasks.groupBy(*keys).agg(is_("running").alias("running"), is_("queued").alias("queued"), is_("waiting").alias("waiting"), rest.alias("finished"))


def usage_counters(asked: DataFrame, keys: list[str], most_shapes: int = 5) -> DataFrame:
    """Per key: answered, empty, unavailable and failed queries (outcome), the bytes of distinct (path, sha) answers, tokens saved, and the last empty shapes.

    saved is (baseline - response) / 4 without its fraction, null where there is no baseline.
    """
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in ("answered", "empty", "unavailable", "error")]
    base = asked.where("path is not null").groupBy(*keys, "path", "sha").agg(F.max("baseline").alias("b")).groupBy(*keys).agg(F.sum("b").alias("baseline"))
    shapes = asked.where("outcome = 'empty'").groupBy(*keys, "shape").agg(F.max("seq").alias("seq"))
    last = W.partitionBy(*keys).orderBy(F.desc("seq"))
    few = shapes.withColumn("__at", F.row_number().over(last)).where(F.col("__at") <= most_shapes).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__at", "shape"))), lambda x: x["shape"]), ",").alias("shapes"))
    out = asked.groupBy(*keys).agg(*counts, F.sum("response").alias("response")).join(base, keys, "left").join(few, keys, "left")
    quarter = (F.col("baseline") - F.col("response")) / 4
    return out.withColumn("saved", F.when(quarter < 0, F.ceil(quarter)).otherwise(F.floor(quarter)).cast("long"))


def slice_size(changes: DataFrame, keys: list[str], most: int = SLICE_LINES) -> DataFrame:
    """Per key: added and deleted lines but for generated paths (GENERATED) and binaries (null counts), and whether they are more than ``most``."""
    counted = F.sum(F.when(~F.col("path").rlike(GENERATED) & F.col("added").isNotNull() & F.col("deleted").isNotNull(), F.col("added") + F.col("deleted")).otherwise(0)).cast("long")
    return changes.groupBy(*keys).agg(counted.alias("lines"), (counted > most).alias("large"))


def _document(path: Column) -> Column:
    """Whether a path is documentation by its place and name, and no configuration, nor markdown that a package reads when it runs."""
    return path.rlike(DOCUMENT) & ~path.rlike(CONFIGURATION) & ~path.rlike(RUNTIME_MARKDOWN)


def review_route(changes: DataFrame, keys: list[str], most: int = SLICE_LINES, complete: str | None = None) -> DataFrame:
    """Per key of changes (keys, path, lines): lines, route, lenses and reason of an ordinary review.

    trivial where all paths are documentation and the evidence is complete
    (``complete``, a boolean column; without one it is), full-4R where a path is hot or
    the lines are more than ``most``, else standard with the one lens of the gravest
    signal: risk, resilience, reliability, readability.
    """
    path = F.col("path")
    some = lambda p: F.bool_or(path.rlike(p))
    lines = F.sum(F.coalesce("lines", F.lit(0))).cast("long")
    whole = F.every(F.coalesce(F.col(complete), F.lit(False))) if complete else F.lit(True)
    flags = changes.groupBy(*keys).agg(
        lines.alias("lines"), (F.every(_document(path)) & whole).alias("trivial"), some(HOT).alias("hot"), (some(RISK) | some(SENSITIVE)).alias("risk"), some(RESILIENCE).alias("resilience"), some(RELIABILITY).alias("reliability")
    )
    large = F.col("lines") > most
    lens = F.when(F.col("risk"), "review-risk").when(F.col("resilience"), "review-resilience").when(F.col("reliability"), "review-reliability").otherwise("review-readability")
    full = F.col("hot") | large
    trivial = F.coalesce("trivial", F.lit(False))
    return flags.select(
        *keys, "lines", F.when(trivial, "trivial").when(full, "full-4R").otherwise("standard").alias("route"), F.when(trivial, "").when(full, ",".join(LENSES)).otherwise(lens).alias("lenses"),
        F.when(trivial, "objective triviality proven for every changed path").when(F.col("hot"), "non-trivial hot-path diff requires full 4R").when(large, f"diff exceeds {most} changed lines").otherwise("non-trivial or unproven diff uses one dominant-risk lens").alias("reason"),
    )


def verdict(executed: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Per key of ``expected`` (keys, test): tests without a run in ``executed`` (keys, test, passed), and green where there are none and all runs passed."""
    runs = executed.groupBy(*keys, "test").agg(F.every(F.coalesce("passed", F.lit(False))).alias("passed"))
    both = expected.select(*keys, "test").distinct().join(runs, [*keys, "test"], "left")
    missing = F.count_if(F.col("passed").isNull())
    return both.groupBy(*keys).agg(F.count("*").alias("tests"), missing.alias("unaccounted"), F.every(F.coalesce("passed", F.lit(False))).alias("green"))
