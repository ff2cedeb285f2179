"""Impact, targets, budgets, ledgers and scopes on small rows, with nulls, ties and empty inputs."""

import random

from pyspark.sql import functions as F

from tracewell.functions.scalars import dedup_key
from tracewell.operators import facts, history, ledger, metrics, ordering, proofs, snapshots, stats

EDGE = "edge_index long, importer string, specifier string, target string, evidence string, reason string"


def database(spark, files, edges, entities=(), relations=()):
    return {
        "files": spark.createDataFrame([(p, s) for p, s in files.items()], "path string, sha string"),
        "edges": spark.createDataFrame([(i, a, b or "x", b, "typescript" if b else "unresolved", None) for i, (a, b) in enumerate(edges)], EDGE),
        "entities": spark.createDataFrame(list(entities), "id string, kind string, name string, path string"),
        "relations": spark.createDataFrame(list(relations), "from_id string, to_id string, kind string"),
    }


def plain_impact(files, edges, seeds):
    reverse, seen, queue, out = {}, set(seeds), [(f, 0, f) for f in sorted(seeds)], {}
    for a, b in edges:
        if a in files and b in files:
            reverse.setdefault(b, set()).add(a)
    for file, depth, origin in queue:
        for importer in sorted(reverse.get(file, ())):
            if importer not in seen:
                seen.add(importer)
                out[importer] = (depth + 1, file, origin)
                queue.append((importer, depth + 1, origin))
    return out


def test_impact_equals_a_plain_queue(spark):
    rng = random.Random(9)
    for _ in range(2):
        names = [f"f{i:02}" for i in range(14)]
        base, cand = {n: "1" for n in names if rng.random() < 0.9}, {n: "1" if rng.random() < 0.85 else "2" for n in names if rng.random() < 0.9}
        eb = [(rng.choice(names), rng.choice([*names, None])) for _ in range(25)]
        ec = [e for e in eb if rng.random() < 0.9] + [("f01", "f02"), ("f02", "f01")]
        got = facts.impact(database(spark, base, eb), database(spark, cand, ec)).collect()
        sign = lambda es: {a: {(y or "x", y) for x, y in es if x == a} for a, _ in es}
        seeds = {n for n in {*base, *cand} if base.get(n) != cand.get(n)} | {a for a in {*sign(eb), *sign(ec)} if sign(eb).get(a) != sign(ec).get(a)}
        want = {("base", f): v for f, v in plain_impact(base, eb, seeds).items()} | {("candidate", f): v for f, v in plain_impact(cand, ec, seeds).items()}
        assert {(r.side, r.file): (r.depth, r.via, r.origin) for r in got} == want
    one = facts.impact(database(spark, base, eb), database(spark, cand, ec), transitive=False).collect()
    assert {r.depth for r in one} <= {1}
    same = database(spark, base, eb)
    assert facts.impact(same, same).count() == 0


def test_relations_count_as_edges_but_not_within_a_file(spark):
    db = database(spark, {"a": "1", "b": "1"}, [], [("x", "k", "X", "a"), ("y", "k", "Y", "b"), ("z", "k", "Z", "b")], [("x", "y", "consumes"), ("y", "z", "serves"), ("x", "gone", "serves")])
    assert [tuple(r) for r in facts.reverse_adjacency(*[db[k] for k in ("files", "edges", "entities", "relations")]).collect()] == [("a", "b")]
    assert tuple(facts.coverage(*[db[k] for k in ("files", "edges", "entities", "relations")]).first()) == (2, 2, 0)
    rows = {r.id: (r.relations, r.n) for r in facts.entity_rows(db["entities"], db["relations"]).collect()}
    assert rows["x"] == ("consumes > Y; serves > gone", 2) and rows["y"] == ("serves > Z; consumes < X", 2) and rows["z"] == ("serves < Y", 1)


def test_targets_members_and_evidence(spark):
    files = spark.createDataFrame([("src/a.ts",), ("lib/b.ts",), ("x/b.ts",), ("c.ts",)], "path string")
    symbols = spark.createDataFrame([("src/a.ts", "Box", "class", "class Box {\n  static async Open(x)\n}", True), ("c.ts", "b.ts", "const", "", True), ("c.ts", "hid", "const", "", False), ("c.ts", None, "const", None, True)], "path string, name string, kind string, signature string, is_exported boolean")
    paths = lambda name: sorted(r.path for r in facts.resolve_targets(files, symbols, name).collect())
    assert paths("./src\\a.ts") == ["src/a.ts"] and paths("a.ts") == ["src/a.ts"] and paths("b.ts") == ["c.ts"] and paths("hid") == [] and paths("Box") == ["src/a.ts"] and paths("") == []
    assert [tuple(r)[1:3] for r in facts.members(symbols, "box.open").collect()] == [("Box.Open", "method")]
    assert facts.members(symbols, "box.open.x").count() == 0 and facts.members(symbols, "BOX").count() == 1
    edges = spark.createDataFrame([(1, "m", "./a", "src/a.ts", "typescript", "r1"), (2, "m", "a", "src/a.ts", "typescript", "r2"), (3, "n", "m", "m", "typescript", None), (4, "n", "lodash", None, "unresolved", "no"), (5, "src/a.ts", "n", "n", "typescript", None)], EDGE)
    got = {r.file: tuple(r)[1:] for r in facts.dependency_evidence(files, symbols, edges, "Box", True).collect()}
    assert got == {"m": (1, "src/a.ts", "typescript", "r2"), "n": (2, "m", "typescript", None)}
    assert [tuple(r) for r in facts.dependency_evidence(files, symbols, edges, "lodash").collect()] == [("n", 1, "lodash", "syntactic", "no")]
    assert facts.dependency_evidence(files, symbols, edges, "none").count() == 0


def test_usage_sites(spark):
    symbols = spark.createDataFrame([("a", "Foo", "function", ""), ("b", "C", "class", "class C { bar(x) }"), ("z", None, "class", None)], "path string, name string, kind string, signature string")
    refs = spark.createDataFrame([("a", "foo"), ("c", "foo"), ("d", "foo"), ("d", "Foo"), ("b", "bar"), ("c", "bar"), (None, "foo")], "path string, name string")
    edges = spark.createDataFrame([("c", "a"), ("c", None), ("d", "q")], "importer string, target string")
    got = {(r.name, r.file): r.imports_declaration for r in facts.usage_sites(spark.createDataFrame([("foo",), ("foo",), ("bar",), (None,)], "name string"), symbols, refs, edges).collect() if r.file}
    assert got == {("foo", "c"): True, ("foo", "d"): False, ("bar", "c"): False}


def test_dependents_go_beyond_fifty_levels(spark):
    edges = spark.createDataFrame([(i, f"n{i + 1}", f"n{i}") for i in range(20)], "edge_index long, importer string, target string")
    got = snapshots.dependents(edges, spark.createDataFrame([("n0",)], "path string"))
    assert got.agg(F.max("depth")).first()[0] == 20


def test_keep_first_cuts_the_key_before_lower_case(spark):
    long = "Ab " * 50
    rows = spark.createDataFrame([(2, long + "x", 1), (1, long.lower() + "y", 2), (3, None, 3), (4, " \t ", 4), (5, "q", 5)], "pos long, text string, rank long")
    got = history.keep_first(rows, ["pos"])
    assert got.columns == rows.columns and sorted(r.pos for r in got.collect()) == [1, 5]
    assert history.keep_first(rows.limit(0), ["pos"]).count() == 0


def test_continuity_with_nulls(spark):
    rows = spark.createDataFrame([("a", 1, "x", None), ("a", 2, "y", "z"), ("b", 3, "x", None), ("b", 4, None, "z"), ("b", 5, "z", "z"), ("b", 4, "other", "w")], "k string, id long, before string, after string").withColumn("at", F.col("id") * 10 + F.when(F.col("after") == "w", 5).otherwise(0))
    got = {r.k: (r.before, r.after, r.steps, r.continuous) for r in history.continuity(rows, ["k"], "at", "id").collect()}
    assert got == {"a": ("x", "z", 2, False), "b": ("x", "z", 2, True)}


def test_prompts_of_session_logs(spark):
    log = ['{"type":"session","version":3,"timestamp":"2024-01-01T00:00:00Z"}', '{"type":"message","timestamp":"2024-01-01T00:00:02Z","message":{"role":"user","content":"hi"}}', '{"type":"message","message":{"role":"user","timestamp":5,"content":[{"type":"text","text":" a"},{"type":"image"},{"type":"text","text":"b "}]}}', '{"type":"message","message":{"role":"user","content":"late"}}', '{"type":"message","message":{"role":"assistant","content":"no"}}', '{"type":"message","message":{"role":"user","content":"  "}}', '{"role":"user" broken', '{"type":"message","message":{"role":"user","content":"' + "x" * 16_385 + '"}}', None]
    rows = [("f", i, x, 9) for i, x in enumerate(log)] + [("new", 0, '{"type":"session","version":4}', 9), ("new", 1, log[1], 9), ("bare", 0, log[1], 9), ("old", 0, " ", 9), ("old", 1, '{"type":"session"}', 9), ("old", 2, log[3], 9)]
    table = spark.createDataFrame(rows, "file string, line_no long, raw string, mtime long")
    base = 1_704_067_200_000
    assert {(r.file, r.line_no, r.text, r.ts) for r in history.prompts(table).collect()} == {("f", 1, "hi", base + 2000), ("f", 2, "a b", 5), ("f", 3, "late", base), ("old", 2, "late", 9)}
    assert [tuple(r) for r in history.skipped_lines(table).collect()] == [("f", 1)]


def test_allowance_needs_every_budget(spark):
    rows = spark.createDataFrame([("f", 1, 10), ("f", None, 10), ("g", 5, 10), ("g", 5, None), ("h", 1, 0)], "family string, used long, budget long")
    assert {r.family: (r.members, r.percent) for r in metrics.allowance(rows).collect()} == {"f": (2, 5.0), "g": (2, None), "h": (1, None)}


def test_overlay_takes_the_last_count(spark):
    counts = spark.createDataFrame([("a", 1, 5, 5), ("a", 2, 1, 0), ("gone", 1, 9, 9)], "path string, pos long, added long, deleted long")
    status = spark.createDataFrame([("a", "M"), ("b", "??"), ("node_modules.backup-1/x", "??")], "path string, state string")
    assert sorted(tuple(r) for r in snapshots.overlay(status, counts).select("path", "added", "deleted").collect()) == [("a", 1, 0), ("b", 0, 0)]


def test_fitting_skips_and_goes_on(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 9), ("a", 3, 4), ("a", 4, None), ("a", 5, 1), ("b", 1, 11)], "k string, pos long, n long")
    assert sorted((r.k, r.pos) for r in ordering.fitting(rows, ["k"], ["pos"], "n", 10).collect()) == [("a", 1), ("a", 3), ("a", 4), ("a", 5)]


def test_pages_and_ranges(spark):
    rows = spark.range(7)
    found, more = ordering.page_of(rows, ["id"], 2, 3)
    assert [r.id for r in found.collect()] == [2, 3, 4] and more == 5
    assert ordering.page_of(rows, ["id"], 5, 99)[1] is None
    shown = lambda sel, n, most: [r.place for r in ordering.visible(spark.range(n).selectExpr("0 as k", "id", f"id = {sel} as sel"), ["k"], ["id"], "sel", most).orderBy("place").collect()]
    assert shown(0, 10, 4) == [0, 1, 2, 3] and shown(9, 10, 4) == [6, 7, 8, 9] and shown(5, 3, 9) == [0, 1, 2]


def test_findings_move_and_are_marked(spark):
    cols = "key string, identity string, manifest string, location string, status string, occurrences long, last_seen long"
    old = spark.createDataFrame([("k1", "i1", "m1", "l1", "open", 2, 5), ("k2", "i2", "m1", "l2", "open", 1, 4)], cols)
    new = ledger.record_findings(old, spark.createDataFrame([("k9", "i1", "l1"), ("k2", "i2", "l2"), ("k3", None, None)], "key string, identity string, location string"), "m2", 9)
    assert {r.key: (r.manifest, r.occurrences, r.last_seen) for r in new.collect()} == {"k9": ("m2", 3, 9), "k2": ("m1", 1, 9), "k3": ("m2", 1, 9)}
    fixed = ledger.mark_fixed(old, spark.createDataFrame([("i2",)], "identity string"), spark.createDataFrame([("l1",), ("l2",)], "location string"), "m2")
    assert {r.key: r.status for r in fixed.collect()} == {"k1": "fixed", "k2": "open"}


def test_validity_ladder(spark):
    p = spark.createDataFrame([("a", "passed", "open", None), ("b", "expired", "open", None), ("c", "passed", "hermetic_unit", ["y"]), ("d", None, "open", None), ("e", "passed", "open", ["y"]), ("f", "passed", "open", ["q"])], "fingerprint string, status string, confidence string, observed array<string>")
    cover = spark.createDataFrame([(x, "c1", "1") for x in "acdef"], "fingerprint string, path string, digest string")
    changed = spark.createDataFrame([("c", 1, "q"), ("e", 1, "q"), ("f", 1, "q")], "fingerprint string, pos long, path string")
    reach = spark.createDataFrame([("q", "c1", False)], "changed string, covered string, reaches boolean")
    now = spark.createDataFrame([("c1", "1")], "path string, digest string")
    got = {r.fingerprint: r.reason for r in proofs.validity(p, cover, now, changed, reach).collect()}
    assert got == {"a": "unaffected", "b": "expired", "c": "observed", "d": "not-passed", "e": "observed", "f": "conservative"}
    assert {r.reason for r in proofs.validity(p, cover, now, changed, reach.limit(0)).collect()} == {"unaffected", "expired", "not-passed", "unknown-reach"}


def test_empty_tables(spark):
    usage = spark.createDataFrame([], "tokens long, cost double, session string, day date, model string")
    assert tuple(stats.totals(usage).first()) == (0, 0.0, 0, 0, 0)
    none = spark.createDataFrame([], "text string, ts long")
    assert ledger.seed(none, none, none, dedup_key, 5).count() == 0
