"""Workspace scans, branches, cursors, collation, monitors, and rules over paths, by written cases."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tracewell.functions import scalars, strings
from tracewell.operators import branches, cursors, facts, history, ledger, metrics, ordering, proofs, search, work
from tracewell.sources import agent_events, sessions, workspace
from tracewell.streaming import framing, timers


def blob(content: bytes) -> str:
    return hashlib.sha1(b"blob %d\0" % len(content) + content).hexdigest()


def listing(spark, *values):
    return workspace.framed(spark.createDataFrame([("r", "\0".join(values) + "\0")], "root string, text string"), "text")


def test_index_and_status_records(spark):
    index = workspace.index_entries(listing(spark, "100644 aaa 0\tsrc/a b.ts", "100644 one 1\tx", "100644 two 2\tx", "no tab", "alone\tpath"))
    assert sorted((r.path, r.sha) for r in index.collect()) == [("src/a b.ts", "aaa"), ("x", "two")]
    rows = workspace.status_entries(listing(spark, " M a", "R  new", "CR looks like one", "C  c2", "R2", "?? z", "RM again", "M  old", "D  gone"))
    assert [(r.path, r.code) for r in rows.orderBy("pos").collect()] == [("a", " M"), ("new", "R "), ("c2", "C "), ("z", "??"), ("again", "RM"), ("gone", "D ")]
    # Four renames in a row, each with a former path that looks like a rename too, then a plain one.
    rows = workspace.status_entries(listing(spark, *[x for i in range(4) for x in (f"R  n{i}", f"RR o{i}")], " M m"))
    assert [r.path for r in rows.orderBy("pos").collect()] == ["n0", "n1", "n2", "n3", "m"]


def test_scan_overlays_status_on_the_index(spark):
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    index = frame([("r", "kept", "1"), ("r", "changed", "2"), ("r", "lost", "3"), ("r", "gone", "4"), ("r", "skip.bin", "5"), ("s", "changed", "9")], "root string, path string, sha string")
    status = frame([("r", 0, "changed", " M"), ("r", 1, "lost", "M "), ("r", 2, "gone", " D"), ("r", 3, "new", "??"), ("r", 4, "unreadable", "??"), ("r", 5, "never", "AD"), ("r", 6, "skip.bin", " M")], "root string, pos int, path string, code string")
    working = frame([("r", "changed", "22"), ("r", "new", "n"), ("r", "gone", "old"), ("r", "ignored", "i")], "root string, path string, sha string")
    got = workspace.scan(index, status, working, ~F.col("path").endswith(".bin"))
    assert sorted(tuple(r) for r in got.collect()) == [
        ("r", "changed", "22", "modified"), ("r", "gone", "4", "deleted"), ("r", "kept", "1", "tracked"), ("r", "lost", "", "modified"), ("r", "never", "", "deleted"), ("r", "new", "n", "untracked"), ("s", "changed", "9", "tracked"),
    ]


def test_files_of_a_workspace(spark, tmp_path):
    root = tmp_path / "w (1)"
    (root / "sub").mkdir(parents=True)
    (root / "sub" / "a.bin").write_bytes(b"\x00\xff\n")
    (root / "empty").write_bytes(b"")
    got = {r.path: r.sha for r in workspace.working_files(spark, str(root)).collect()}
    assert got == {"sub/a.bin": blob(b"\x00\xff\n"), "empty": blob(b"")}
    with pytest.raises(Exception, match="source too large"):
        workspace.working_files(spark, str(root), most=2).collect()
    lists = tmp_path / "lists"
    lists.mkdir()
    (lists / "index").write_bytes(b"100644 aaa 0\tone\n line\x00100644 bbb 0\ttwo\x00")
    index = workspace.index_entries(workspace.nul_records(spark, str(lists / "index")))
    assert sorted((r.path, r.sha) for r in index.collect()) == [("one\n line", "aaa"), ("two", "bbb")]


def test_nearest_manifest(spark):
    commands = spark.createDataFrame([(1, "r", "packages/web/src"), (2, "r", ""), (3, "r", "./tools/"), (4, "other", "a"), (5, "r", "bad/x"), (6, "r", "apps/x")], "id int, root string, folder string")
    files = spark.createDataFrame([("r", "yarn.lock"), ("r", "package-lock.json"), ("r", "packages/web/bun.lockb"), ("r", "tools/x.ts")], "root string, path string")
    web = '{"scripts": {"test": "run", "build": " "}}'
    top = '{"packageManager": "pnpm@9.1", "scripts": {"lint": "x", "test": "y"}}'
    manifests = spark.createDataFrame([("r", "packages/web/package.json", web), ("r", "package.json", top), ("r", "bad/package.json", "[]"), ("r", "apps/package.json", '{"scripts": {"build": "x"}}'), ("other", "b/package.json", "{}")], "root string, path string, text string")
    got = {r.id: tuple(r)[1:] for r in workspace.receipts(commands, files, manifests).collect()}
    assert got == {
        1: ("packages/web/package.json", "bun", "bun test", None, None), 2: ("package.json", "pnpm@9.1", "pnpm test", None, "pnpm run lint"), 3: ("package.json", "pnpm@9.1", "pnpm test", None, "pnpm run lint"),
        4: (None, None, None, None, None), 5: ("package.json", "pnpm@9.1", "pnpm test", None, "pnpm run lint"),
        6: ("apps/package.json", "pnpm@9.1", None, "pnpm run build", None),
    }


def test_closure_takes_logarithmic_rounds(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(branches, "_cut", lambda df, f=branches._cut: cuts.append(1) or f(df))
    chain = spark.range(1, 10_001).selectExpr("id", "id - 1 as parent")
    got = branches.closure(chain, spark.createDataFrame([(10_000,)], "id long"))
    assert got.count() == 10_001 and len(cuts) <= 2 + 3 * 15
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 8), (7, 9), (None, 1), (4, None)], "id long, parent long")
    assert sorted(r.id for r in branches.closure(ring, spark.createDataFrame([(1,), (7,), (None,)], "id long")).collect()) == [1, 2, 3, 7, 8, 9]


def test_receipts_as_of_an_entry(spark):
    rows = [(i, i - 1 if i else None, {0: None, 3: "r3", 40: "r40"}.get(i)) for i in range(100)] + [(200, 201, None), (201, 200, None), (300, 999, None), (301, 3, None)]
    got = {r.id: (r.receipt, r.steps) for r in branches.as_of(spark.createDataFrame(rows, "id long, parent long, receipt string")).collect()}
    assert got[2] == (None, None) and got[3] == ("r3", 0) and got[39] == ("r3", 36) and got[99] == ("r40", 59) and got[301] == ("r3", 1)
    assert got[200] == got[201] == got[300] == (None, None) and len(got) == len(rows)


def test_history_of_branches(spark):
    entries = spark.createDataFrame([(1, None, "s1"), (2, 1, None), (3, 1, "s3"), (9, None, None)], "id long, parent long, receipt string")
    heads = spark.createDataFrame([("a", 2), ("b", 3), ("c", 9), ("d", 77)], "head string, id long")
    files = spark.createDataFrame([("s1", "a.ts"), ("s1", "b"), ("s3", "a.ts")], "receipt string, path string")
    symbols = spark.createDataFrame([("s1", "a.ts", "Run", "class", 3), ("s1", "a.ts", "x", "const", 9), ("s3", "a.ts", "RUN", "class", 4)], "receipt string, path string, name string, kind string, start_line int")
    got = sorted((r.head, r.status, r.path, r.symbols, r.language) for r in branches.history(heads, entries, files, symbols).collect())
    assert got == [("a", "historical", "a.ts", 2, "typescript"), ("a", "historical", "b", 0, "unknown"), ("b", "historical", "a.ts", 1, "typescript"), ("c", "unavailable", None, None, None), ("d", "unavailable", None, None, None)]
    named = branches.history(heads, entries, files, symbols, spark.createDataFrame([("run",)], "name string"))
    assert sorted((r.head, r.name, r.start_line) for r in named.collect() if r.path) == [("a", "Run", 3), ("b", "RUN", 4)]


def test_frozen_rows_and_cursors(spark, tmp_path):
    rows = spark.createDataFrame([(i % 7, i) for i in range(500)] + [(3, 3)] * 20, "k int, v long")
    got = sorted((r.row_no, r.k, r.v) for r in cursors.numbered(rows.repartition(9), ["k"]).collect())
    assert [r[0] for r in got] == list(range(520)) and [r[1:] for r in got] == sorted((r.k, r.v) for r in rows.collect())
    store = str(tmp_path)
    generation, total = cursors.freeze(rows, ["k"], store)
    assert total == 520 and cursors.freeze(rows.repartition(3), ["k"], store) == (generation, 520)
    changed = cursors.content_digest(rows.where("v <> 499"))
    assert changed != generation and cursors.content_digest(rows.unionByName(rows.limit(1))) != generation
    asked = spark.createDataFrame([(1, 0), (2, 515), (3, 520), (4, 7)], "id int, at int").select("id", cursors.cursor(F.when(F.col("id") == 4, changed).otherwise(generation), "q", F.col("at")).alias("cursor"))
    asked = asked.unionByName(spark.createDataFrame([(5, "x"), (6, None), (7, "")], "id int, cursor string"))
    frozen = spark.read.parquet(f"{store}/generation={generation}")
    pages = cursors.resume(asked, "q", generation, frozen, total, 10).collect()
    by = {i: [r for r in pages if r.id == i] for i in range(1, 8)}
    assert [len(by[i]) for i in range(1, 8)] == [10, 5, 1, 1, 1, 1, 1] and [by[i][0].status for i in range(3, 8)] == ["invalid"] + ["unknown"] * 4
    assert {r.next for r in by[2]} == {None} and sorted(r.row_no for r in by[1]) == list(range(10))
    follow = spark.createDataFrame([(1, by[1][0].next)], "id int, cursor string")
    assert sorted(r.row_no for r in cursors.resume(follow, "q", generation, frozen, total, 10).collect()) == list(range(10, 20))
    assert {r.status for r in cursors.resume(follow, "other", generation, frozen, total, 10).collect()} == {"unknown"}


def test_retained_results(spark):
    rows = spark.createDataFrame([("s", t, 10 if t != 5 else 100) for t in range(1, 9)] + [("t", 1, 5)], "s string, started long, bytes long")
    keep = lambda **k: sorted((r.s, r.started) for r in cursors.retained(rows, 8, ["s"], **k).collect())
    assert keep(ttl=100, most=3) == [("s", 6), ("s", 7), ("s", 8), ("t", 1)] and keep(ttl=3) == [("s", 6), ("s", 7), ("s", 8)]
    assert keep(ttl=100, most_bytes=60) == [("s", 6), ("s", 7), ("s", 8), ("t", 1)]


def test_catalog_cursors_are_bound_to_content(spark):
    rows = [("s", "a", "tasks", i, f"t{i}") for i in range(10)] + [("s", "a", "registered", i, f"r{i}") for i in range(3)] + [("u", "a", "tasks", 0, "only")]
    kind = "session string, activation string, list string, pos long, public string"
    pages = cursors.catalog_pages(spark.createDataFrame(rows, kind)).collect()
    ends = {(r.session, r.page): r.cursor for r in pages}
    assert ends[("s", 1)] is None and ends[("u", 0)] is None and "=" not in ends[("s", 0)]
    asked = spark.createDataFrame([(1, "s", ends[("s", 0)]), (2, "u", ends[("s", 0)]), (3, "s", "x")], "id int, session string, cursor string")
    led = lambda table: sorted((r.id, r.public) for r in cursors.catalog_resume(asked, spark.createDataFrame(table, kind)).collect())
    assert led(rows) == [(1, "t8"), (1, "t9"), (2, None), (3, None)]
    assert led([("s", "a", "tasks", 0, "T0"), *rows[1:]]) == [(1, None), (2, None), (3, None)] and led([(a, "b", *r) for a, _, *r in rows]) == [(1, None), (2, None), (3, None)]


def test_collated_order(spark):
    names = ["Zeta", "zeta", "Éa", "ea", "Ea", "eb", "a-b", "ab", "10", "9"]
    rows = spark.createDataFrame([("g", n, i) for i, n in enumerate(names)], "g string, name string, i int")
    assert [r.name for r in ordering.collated(rows, ["g"], ["name"], ["i"]).orderBy("place").collect()] == ["10", "9", "a-b", "ab", "ea", "Ea", "Éa", "eb", "zeta", "Zeta"]


def test_kinds_are_chosen_before_the_limit(spark):
    rows = spark.createDataFrame([(i, "path" if i < 5 else "symbol", "f", "blue rod") for i in range(8)], "entry_index int, kind string, file string, name string")
    asked = spark.createDataFrame([("q", "blue rod")], "query string, text string")
    got = search.lexical_ranked(rows, asked, 2, F.col("kind") == "symbol").collect()
    assert sorted((r.entry_index, r.place) for r in got) == [(5, 1), (6, 2)]


def test_view_and_budget_of_lists(spark):
    rows = spark.createDataFrame([("a", i, i == 4) for i in range(10)] + [("b", i, False) for i in range(3)] + [(None, 0, True)], "k string, i int, sel boolean")
    got = sorted(((r.k or "", r.place) for r in ordering.visible(rows, ["k"], ["i"], "sel", 4).collect()))
    assert got == [("", 0), ("a", 2), ("a", 3), ("a", 4), ("a", 5), ("b", 0), ("b", 1), ("b", 2)]
    many = spark.range(50_000).selectExpr("1 as k", "id as pos", "case when id % 3 = 0 then null else id % 5 end as n")
    kept = ordering.fitting(many.repartition(6), ["k"], ["pos"], "n", 1000).collect()
    used, want = 0, []
    for i in range(50_000):
        n = 0 if i % 3 == 0 else i % 5
        if used + n <= 1000:
            used += n
            want.append(i)
    assert sorted(r.pos for r in kept) == want


@pytest.mark.parametrize("n", [1, 2, 99, 5000])
def test_percentiles_of_distinct_values(spark, n):
    rows = spark.range(n).selectExpr("cast(null as string) as k", "id * 7 % 100003 as v").unionByName(spark.createDataFrame([("x", 5)] * 10, "k string, v long"))
    values = sorted(i * 7 % 100003 for i in range(n))
    got = {r.k: r for r in metrics.nearest_rank(rows.repartition(5), ["k"], "v").collect()}
    rank = lambda q: values[max(1, -(-n * q // 100)) - 1]
    r = got[None]
    assert (r.least, r.p50, r.p95, r.p99, r.most, r.upper_median) == (values[0], rank(50), rank(95), rank(99), values[-1], values[n // 2])
    assert got["x"].p99 == 5 and len(got) == 2


def run_monitor(*rows):
    m, out = timers.Monitor(), []
    for r in rows:
        out += m.take(*r)
    return [(x[0], x[1], x[2], len(x[3]), x[4]) for x in out + m.reach(1 << 62)]


def test_monitor_rules():
    line = lambda ms: ("line", ms, "x")
    assert run_monitor(("start", 0, "1"), line(10), line(150), ("line", 160, "  "), line(211)) == [("events", None, 210, 2, 0), ("events", None, 411, 1, 0), ("stopped", "timeout", 1000, 0, 0)]
    # The timeout flushes what is held; what comes later is not heard.
    assert run_monitor(("start", 0, "1"), line(900), line(1000), line(1001)) == [("events", None, 1000, 1, 0), ("stopped", "timeout", 1000, 0, 0)]
    # An exit gives held lines only, and wins over a timeout of the same time.
    assert run_monitor(("start", 0, "1"), line(900), ("exit", 1000, None)) == [("events", None, 1000, 1, 0)]
    assert run_monitor(("start", 0, "1"), line(900), ("cancel", 950, None), line(960)) == []
    flood = run_monitor(("start", 0, "60"), *[line(i) for i in range(121)], line(130))
    assert flood == [("events", None, 120, 20, 101), ("stopped", "flood", 120, 0, 0)]
    assert run_monitor(("start", 0, "0"), line(1)) == run_monitor(("start", 0, "1801"), line(1)) == run_monitor(("start", 0, "x"), line(1)) == run_monitor(line(1)) == []


def test_monitors_of_a_stream_equal_those_of_a_table(spark, tmp_path):
    rows = []
    for j in range(4):
        rows += [(f"j{j}", "start", 0, str(j + 1))] + [(f"j{j}", "line", 37 * i + j, f"l{i}") for i in range(60)]
    rows += [("j3", "exit", 2300, None), ("late", "start", 90_000, "1"), (None, "line", 5, "x"), ("j0", None, 5, "x")]
    # Times well after the first watermark, below which rows are late.
    frame = spark.createDataFrame(rows, "job string, kind string, ms long, value string").withColumn("ms", F.col("ms") + 10_000).withColumn("ts", F.timestamp_millis("ms"))
    source, old = tmp_path / "in", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    for i, part in enumerate((frame.where("ms < 10700"), frame.where("ms >= 10700 and ms < 90000"), frame.where("ms >= 90000"))):
        part.coalesce(1).write.parquet(f"{source}/{i}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
        q = timers.monitors(stream.withWatermark("ts", "0 seconds")).writeStream.format("memory").queryName("notices").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        got = spark.table("notices").where("job <> 'late'").collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if old is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    show = lambda r: (r.job, r.kind, r.reason or "", r.at_ms, tuple(r.lines), r.omitted)
    want = [show(r) for r in timers.monitors_batch(frame.drop("ts")).where("job <> 'late'").collect()]
    assert sorted(map(show, got)) == sorted(want) and {r[1] for r in want} == {"events", "stopped"} and len(want) > 20


def test_white_space_and_composed_letters(spark):
    texts = ["\t\n", "  x﻿", "\t/cmd x", "ok", None, "​"]
    prompts = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r.text for r in ledger.append_prompts(prompts).collect()] == ["  x﻿", "ok", "​"]
    nodes = [(1, "caf\u00e9", None), (2, " CAFE\u0301 ", None), (3, None, ["Cafe\u0301", None, " "]), (4, None, ["caf\u00e9"])]
    rows = spark.createDataFrame([(n, a, None, t) for n, a, t in nodes], "node int, area string, topic string, tags array<string>")
    got = {(r.source, r.node): r.reasons for r in work.related_all(rows, rows.select("node")).collect()}
    assert got == {(1, 2): "area", (2, 1): "area", (3, 4): "tag", (4, 3): "tag"}
    folded = spark.createDataFrame([("E\u0301a\u00a0",), (None,)], "t string").select(scalars.fold(F.col("t")).alias("t")).collect()
    assert [r.t for r in folded] == ["\u00e9a", None]


def test_a_log_that_begins_with_white_space(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.jsonl").write_text('\t\n{"type": "session", "id": "s", "cwd": "/"}\n{"type":"message","timestamp":"2024-01-01T00:00:00Z","message":{"role":"assistant","usage":{"input":3}}}\n')
    assert [r.input for r in sessions.session_usage(sessions.session_lines(spark, str(tmp_path))).collect()] == [3.0]


def test_numbers_as_a_reader_writes_them(spark):
    n = [999, 1250, 1450, 1950, 2650, 8350, 9990, 12_499, 12_500, 999_999, 1_250_000, 1_450_000, 10_500_000]
    rows = spark.createDataFrame([(x,) for x in n], "n long").select(strings.tokens_text(F.col("n")).alias("t")).collect()
    assert [r.t for r in rows] == ["999", "1.3k", "1.4k", "1.9k", "2.6k", "8.3k", "10.0k", "12k", "13k", "1000k", "1.3M", "1.4M", "11M"]
    rows = spark.createDataFrame([(x,) for x in (1.005, 0.0625, 1234.565, 0.0)], "x double").select(strings.cost_text(F.col("x")).alias("t")).collect()
    assert [r.t for r in rows] == ["$1.00", "$0.063", "$1234.57", "$0.000"]


def changes(spark, *rows):
    return spark.createDataFrame([("c", p, a, d, o) for p, a, d, o in rows], "c string, path string, added long, deleted long, opaque boolean")


def route(spark, *paths, lines=1, **k):
    r = metrics.review_route(spark.createDataFrame([("c", p, lines, True) for p in paths], "c string, path string, lines long, complete boolean"), ["c"], **k).first()
    return r.route, r.lenses


def test_review_routes(spark):
    assert route(spark, "README.md", "docs/a/b.rst", "LICENSE") == ("trivial", "")
    assert route(spark, "notes.md")[0] == route(spark, "docs/requirements.txt")[0] == route(spark, "README.md", "src/a.ts")[0] == "standard"
    assert route(spark, "docs/skills/a/SKILL.md") == ("standard", "review-readability")
    assert route(spark, "src/auth/x.ts")[0] == route(spark, "a.ts", lines=401)[0] == "full-4R" and route(spark, "a.ts", lines=400)[0] == "standard"
    assert route(spark, "config/secrets.yaml") == ("standard", "review-risk") and route(spark, "infra/x.tf") == ("standard", "review-resilience")
    assert route(spark, "lib/x.spec.ts") == ("standard", "review-reliability") and route(spark, "src/x.ts") == ("standard", "review-readability")


def test_risk_tiers(spark):
    tier = lambda *rows: (lambda r: (r.lines, r.tier, r.budget, r.lenses))(metrics.risk(changes(spark, *rows), ["c"]).first())
    assert tier(("notes.md", 5, 2, False)) == (7, "low", 4, "") and tier(("testdata/golden/x", 900, 0, False)) == (0, "low", 0, "")
    assert tier(("src/a.ts", 400, 0, False))[:3] == (400, "medium", 200) and tier(("src/a.ts", 401, 0, False))[1] == "high"
    assert tier(("bin/Shell_utils.go", 1, 0, False))[1] == tier(("a/data-loss.md", 1, 0, False))[1] == "high"
    assert tier(("a.png", 900, 0, True)) == (0, "medium", 0, "review-readability") and tier(("README.md", 1, 0, True))[1] == "medium" and tier(("package.json", 1, 0, False))[1] == "medium"


def test_slice_size_counts_authored_lines(spark):
    rows = changes(spark, ("build/x.ts", 10, 0, False), ("app.min.css", 7, 0, False), ("sub/go.sum", 7, 0, False), ("a.lock", 1, 0, False), ("bin", None, None, True))
    assert metrics.slice_size(rows, ["c"]).first().lines == 11


def test_tiers_and_their_rationale(spark):
    changed = spark.createDataFrame([(1, "tests/a.ts"), (1, "docs/x.yaml"), (1, "n.md"), (2, "src/a.ts"), (3, "src/b.ts"), (4, "notes.txt")], "change int, path string")
    edges = spark.createDataFrame([("src/u.ts", "src/a.ts"), ("src/b.ts", "src/c.ts"), ("src/v.ts", None)], "importer string, target string")
    notes = spark.createDataFrame([(2, 3, 0), (4, 0, 2)], "change int, open int, fixed int")
    got = {r.change: r for r in facts.tier_proposal(changed, edges, ["change"], notes).collect()}
    assert {k: (r.tier, r.dependents, r.boundary) for k, r in got.items()} == {1: ("low", 0, 0), 2: ("high", 1, 1), 3: ("medium", 0, 1), 4: ("medium", 0, 0)}
    assert got[2].rationale.split("\n") == ["1 module-boundary edge(s) touched (context; high tier already applies)", "3 prior open advisories in ledger", "changed files outside tests/docs affect 1 unchanged dependents: proposing high tier"]
    assert got[4].rationale.split("\n") == ["1 changed file(s) outside tests/docs with no other signal: proposing medium tier", "2 prior advisories fixed in ledger"]


def test_languages(spark):
    paths = ["a.js", "a.mts", "a.CTS", "x/a.py", "a.go", "a.rs", ".py", "ts", "a.d.ts", "a.jsx"]
    got = [r.l for r in spark.createDataFrame([(p,) for p in paths], "p string").select(facts.language(F.col("p")).alias("l")).collect()]
    assert got == ["javascript", "typescript", "typescript", "python", "go", "unknown", "unknown", "unknown", "typescript", "javascript"]


def test_proof_ladder_and_lifecycle(spark):
    asked = spark.createDataFrame([(i, "f") for i in range(9)], "id int, fingerprint string")
    kind = "id int, fingerprint string, status string, confidence string, side_effects string, invalidation string, finished long"
    rows = [(1, "g", "passed"), (2, "f", "running"), (3, "f", "failed"), (4, "f", "stale"), (5, "f", "aborted"), (6, "f", "passed"), (7, "f", "passed"), (8, "f", "passed")]
    more = {4: ("hermetic_unit", "pure_validation", "inputs", 5), 6: ("hermetic_unit", "deploys", None, 5), 7: ("sandboxed", "pure_validation", None, 5), 8: ("hermetic_static", "reproducible_build", None, 5)}
    found = spark.createDataFrame([(*r, *more.get(r[0], ("hermetic_unit", "pure_validation", None, None))) for r in rows], kind)
    got = {r.id: (r.decision, r.reason, r.age) for r in proofs.reuse(asked, found, 12).collect()}
    assert got == {
        0: ("execute", "no-proof", None), 1: ("execute", "mismatch", None), 2: ("execute", "in-flight", None), 3: ("execute", "failed", None), 4: ("execute", "stale: inputs", 7), 5: ("execute", "aborted", None),
        6: ("no_reuse", "side-effects", 7), 7: ("no_reuse", "confidence", 7), 8: ("reuse", "reusable", 7),
    }
    moves = spark.createDataFrame([("running", "aborted"), ("passed", "invalidated"), ("failed", "stale"), ("failed", "expired"), ("aborted", "passed"), (None, "passed"), ("passed", "passed")], "before string, after string")
    assert [r.allowed for r in proofs.transitions(moves).collect()] == [True, True, True, False, False, False, False]


def test_selection_of_tests(spark):
    inventory = spark.createDataFrame([("s", "a", "1"), ("s", "b", "2"), ("s", "c", "3"), ("t", "d", "1"), ("t", "e", "9")], "suite string, name string, fingerprint string")
    have = spark.createDataFrame([("1", "passed"), ("2", "passed"), ("3", "failed")], "fingerprint string, status string")
    told = spark.createDataFrame([("1", True, "unaffected"), ("2", False, "unknown-reach"), ("3", False, "not-passed"), ("9", True, "unaffected")], "fingerprint string, valid boolean, reason string")
    got = sorted(tuple(r) for r in proofs.select_tests(inventory, have, told).select("suite", "name", "action", "reason", "fallback").collect())
    assert got == [("s", "a", "reuse", "unaffected", True), ("s", "b", "execute", "unknown-reach", True), ("s", "c", "execute", "not-passed", True), ("t", "d", "reuse", "unaffected", False), ("t", "e", "execute", "no-proof", False)]


def test_consumers_of_contracts(spark):
    imports = spark.createDataFrame([("src/a.ts", "../api/x.json"), ("src/__tests__/b.ts", "../../api/x.json"), ("src/c.test.mts", "../api/x.json"), ("src/d.test.helper.ts", "../api/x.json"), ("api/x.json", "./x.json"), ("src/a.ts", "lib")], "path string, specifier string")
    entities = spark.createDataFrame([("e1", "schema", "X", "api/x.json")], "id string, kind string, name string, path string")
    got = sorted((r.from_id, r.to_id, r.kind) for r in facts.contract_edges(imports, entities).collect())
    assert got == [("consumer:src/a.ts", "e1", "consumes"), ("consumer:src/d.test.helper.ts", "e1", "consumes"), ("test:src/__tests__/b.ts", "e1", "validates"), ("test:src/c.test.mts", "e1", "validates")]
    assert sorted((r.id, r.name) for r in facts.contract_entities(imports, entities).collect())[0] == ("consumer:src/a.ts", "a.ts")



def told(spark, *lines, **k):
    raw = spark.createDataFrame([("t", i, x if isinstance(x, str) else json.dumps(x)) for i, x in enumerate(lines)], "task string, pos long, raw string")
    return agent_events.task_events(raw)


def update(**inner):
    return {"type": "message_update", "assistantMessageEvent": inner}


DENIAL = '403: {"type":"server_error","message":"Upstream request failed: Model access is disabled","secret":"never"}'


def test_lines_of_agents_become_events(spark):
    say = lambda text: {"content": [{"type": "text", "text": text}, {"type": "image"}]}
    end = lambda **m: {"type": "agent_end", "messages": [{"role": "assistant", "content": [], **m}, {"role": "user"}]}
    rows = told(
        spark, update(type="text_delta", delta="Hi\u001b[31m!"), update(type="thinking_delta", delta="hm"), {"type": "tool_execution_start", "toolCallId": "c", "toolName": "bash"}, {"type": "tool_execution_update", "toolCallId": "c", "partialResult": say("a\nb")},
        {"type": "tool_execution_end", "toolCallId": "c", "isError": True, "result": say("boom")}, {"type": "turn_end"}, end(stopReason="stop", content=[{"type": "text", "text": "done."}]), end(stopReason="error", errorMessage="payload"), end(stopReason="aborted"), end(stopReason="stop"),
        {"type": "agent_end"}, {"type": "agent_settled"}, update(type="error", reason="error", error={"message": "limited"}), update(type="error", error={"message": DENIAL}), {"type": "extension_ui_request", "method": "confirm", "title": "Delete?"}, {"type": "extension_ui_request", "method": "setStatus"},
        {"type": "extension_ui_request", "method": "notify", "message": "hi"}, {"type": "extension_ui_request", "method": "notify", "message": agent_events.MISSING_TOOLS + " x"}, {"type": "auto_retry_start", "attempt": 1, "maxAttempts": 3},
        {"type": "message_end", "message": {"role": "assistant", "usage": {"totalTokens": 9, "cost": {"total": 0.5}}, "stopReason": "error", "errorMessage": DENIAL}}, {"type": "message_end", "message": {"role": "user", "usage": {"totalTokens": 9}}}, {"type": "queue_update"}, "garbage", "[1]",
    ).orderBy("pos", "n").collect()
    assert [(r.kind, r.text) for r in rows] == [
        ("text", "Hi!"), ("thinking", "hm"), ("tool_start", "bash"), ("tool_update", "a\nb"), ("tool_end", "boom"), ("turn_end", None), ("agent_end", "done."), ("agent_end", ""), ("agent_end", ""), ("agent_end", ""), ("agent_end", ""), ("agent_settled", None),
        ("error", "limited"), ("error", agent_events.DENIED_SAID), ("ask", "Delete?"), ("note", agent_events.MISSING_TOOLS + " x"), ("note", "retrying (1/3)"), ("usage", None), ("fatal_error", agent_events.DENIED_SAID),
    ]
    assert [(r.outcome, r.diagnostic) for r in rows if r.kind == "agent_end"] == [("success", None), ("error", agent_events.REPORTED_ERROR), ("aborted", agent_events.ABORTED), ("empty", agent_events.NO_REPORT), ("empty", agent_events.NO_REPORT)]
    assert rows[4].is_error and (rows[17].tokens, rows[17].cost) == (9.0, 0.5)


def test_records_and_threads_of_tasks(spark):
    tool = lambda i, **k: {"type": f"tool_execution_{k.pop('step')}", "toolCallId": i, **k}
    out = lambda text: {"content": [{"type": "text", "text": text}]}
    events = told(
        spark, tool("a", step="update", partialResult=out("early")), update(type="text_delta", delta="one "), tool("z", step="update", partialResult=out("lost")), update(type="text_delta", delta="two"), tool("a", step="start", toolName="ls"), tool("a", step="update", partialResult=out("x")),
        tool("a", step="end", isError=True, result=out("0123456789")), update(type="text_delta", delta=""), update(type="text_delta", delta="three"), {"type": "extension_ui_request", "method": "input", "title": "Go?"},
    )
    show = lambda rows: [(r.item, r.kind, r.text, r.output, r.running, r.is_error, r.dropped) for r in rows.orderBy("item").collect()]
    assert show(agent_events.task_threads(events, output_chars=5)) == [(0, "text", "one two", None, None, None, 0), (1, "tool", "ls", "…6789", False, True, 0), (2, "text", "three", None, None, None, 0), (3, "note", "asked: Go?", None, None, None, 0)]
    assert show(agent_events.task_threads(events, most=2, text_chars=4)) == [(2, "text", "…ree", None, None, None, 2), (3, "note", "asked: Go?", None, None, None, 2)]
    tasks = spark.createDataFrame([("t", "starting", "queued"), ("idle", "queued", "queued")], "task string, status string, last_step string")
    record = lambda e: {r.task: (r.status, r.last_step, r.tool_calls, r.result, r.error) for r in agent_events.task_records(tasks, e).collect()}
    assert record(events) == {"t": ("waiting", "asked: Go?", 1, None, None), "idle": ("queued", "queued", 0, None, None)}
    assert record(told(spark, update(type="text_delta", delta="x")))["t"] == ("starting", "writing", 0, None, None)
    assert record(told(spark, {"type": "extension_ui_request", "method": "input", "title": "Go?"}, {"type": "turn_end"}, {"type": "agent_end"}))["t"] == ("running", agent_events.NO_REPORT, 0, None, agent_events.NO_REPORT)


def test_lines_span_chunks(spark):
    width = framing.WIDTH
    chunks = ["a", "b\nc\r", "\n", "", None, "x" * width, "yz\r\n", "é\n\nlast"]
    rows = spark.createDataFrame([("j", i, c) for i, c in enumerate(chunks)] + [("k", 0, "one\n"), ("l", 0, None)], "job string, seq int, chunk string")
    got = [(r.job, r.line_no, r.line) for r in framing.lines_of(rows.repartition(3)).orderBy("job", "line_no").collect()]
    want, partial = [], ""
    for i, c in enumerate(chunks):
        done, partial = framing.frame(partial, c or "", i == len(chunks) - 1)
        want += done
    assert got == [("j", i, x) for i, x in enumerate(want)] + [("k", 0, "one"), ("k", 1, ""), ("l", 0, "")]
    assert want == ["ab", "c", "…" + "x" * (width - 2) + "yz", "é", "", "last"] and partial == ""


def test_a_stream_of_chunks(spark, tmp_path):
    text = "first\nsecond line\r\n\n" + "w" * 5000 + "\nend"
    rows = [("j", i, text[i * 7 : i * 7 + 7], i * 7 + 7 >= len(text)) for i in range(-(-len(text) // 7))]
    frame = spark.createDataFrame(rows, "job string, seq int, chunk string, end boolean")
    for i, part in enumerate((frame.where("seq < 3"), frame.where("seq >= 3 and seq < 400"), frame.where("seq >= 400"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        q = framing.line_stream(stream).writeStream.format("memory").queryName("framed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        got = [r.line for r in spark.table("framed").collect()]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted(got) == sorted(["first", "second line", "", "…" + "w" * framing.WIDTH, "end"])


def test_candidates_of_searches_leave_nothing_out(spark):
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 5)))
    names = [" ".join(word() for _ in range(rng.randint(1, 4))) for _ in range(150)] + ["", "a", "ab"]
    entries = spark.createDataFrame(list(enumerate(names)), "entry_index long, name string").selectExpr("*", "'k' AS kind").coalesce(1)
    asked = names[::6] + ["A", "", "b-c", "zzz", "a b c"]
    got = sorted((r.query, r.entry_index, r.score) for r in search.lexical_all(entries, spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "query int, text string")).collect())
    low = [n.lower() for n in names]
    grams = lambda t: {t[i : i + 3] for i in range(len(t) - 2)}

    def score(name: str, q: str) -> float:
        own, want = grams(name), grams(q) or {q}
        words = scalars.query_tokens(q)
        jaccard = len(own & want) / len(own | want)
        return max(1.0 * (name == q), 0.75 * name.startswith(q), 0.6 * (bool(words) and all(w in name for w in words)), 0.5 * jaccard if own and jaccard >= 0.35 else 0)

    want = sorted((i, k, int(score(n, q.lower()) * 1e4 + 0.5) / 1e4) for i, q in enumerate(asked) for k, n in enumerate(low) if score(n, q.lower()) > 0)
    assert [x[:2] for x in got] == [x[:2] for x in want] and all(abs(a[2] - b[2]) < 2e-4 for a, b in zip(got, want, strict=True))


def test_reasons_of_prices_and_contexts(spark):
    rows = spark.createDataFrame([("a", 2.0, 6.0, 1.0, 2.0), ("b", None, None, 1.0, 2.0), ("c", 0.0, 1.0, 1.0, 2.0), ("d", 1.0, 1.0, None, None), ("e", 1.0, float("inf"), 1.0, 1.0)], "id string, input double, output double, base_input double, base_output double")
    got = {r.id: (r.blended, r.reason) for r in work.price_ratio(rows.withColumn("base_id", F.lit("w"))).collect()}
    assert got == {"a": (3.0, None), "b": (None, "no catalog price for b"), "c": (None, "zero or invalid price for c"), "d": (None, "no catalog price for w"), "e": (None, "zero or invalid price for e")}
    said = spark.createDataFrame([("x", "user", "é"), ("x", "odd", "b"), ("y", "system", "c" * 400)], "ctx string, role string, text string")
    got = {r.ctx: r for r in history.context_status(said, ["ctx"], 110, 20, 500).collect()}
    assert (got["x"].user_bytes, got["x"].other_messages, got["x"].bytes) == (len('{"role":"user","text":"é"}'.encode()), 1, len('{"messages":[{"role":"user","text":"é"},{"role":"odd","text":"b"}]}'.encode())) and got["x"].status == "within_target"
    assert got["y"].status == "overflow" and got["y"].headroom == 0 and got["y"].excess == got["y"].tokens - 90
