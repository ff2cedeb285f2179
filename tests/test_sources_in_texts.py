"""Parsers of contracts, command outputs and Python files, string functions, and path scopes."""

import json

from pyspark.sql import functions as F

from tracewell.functions import strings
from tracewell.operators import surfaces
from tracewell.sources import contracts, python_files, texts


def test_contracts(spark):
    api = json.dumps({"paths": {"/pets": {"get": {"x": {"$ref": "#/components/schemas/Pet"}}, "summary": "s"}, "/a": {"post": {}}}, "components": {"schemas": {"Pet": {"type": "object"}, "Err": {}}}})
    schema = json.dumps({"title": "User", "definitions": {"Name": {}}, "$defs": {"Age": {}}})
    files = spark.createDataFrame([
        ("api/openapi.json", api), ("u.schema.json", schema), ("s.graphql", "type User {\n} enum Role { A } input  X"), ("p.proto", "message A { message B {} }"), ("db/migrations/1.sql", "CREATE TABLE users (x);\ncreate table if not exists `app`.Orders (y); CREATE TABLE users (z)"),
        ("broken.schema.json", "{"), ("none.sql", None), ("empty.proto", ""),
    ], "path string, content string")
    got = {(r.kind, r.name, r.path) for r in contracts.entities(files).collect()}
    assert got == {
        ("api-route", "GET /pets", "api/openapi.json"), ("api-route", "POST /a", "api/openapi.json"), ("openapi-schema", "Pet", "api/openapi.json"), ("openapi-schema", "Err", "api/openapi.json"),
        ("json-schema", "User", "u.schema.json"), ("json-schema", "Name", "u.schema.json"), ("json-schema", "Age", "u.schema.json"), ("graphql-type", "User", "s.graphql"), ("graphql-type", "Role", "s.graphql"), ("graphql-type", "X", "s.graphql"),
        ("protobuf-message", "A", "p.proto"), ("protobuf-message", "B", "p.proto"), ("sql-table", "users", "db/migrations/1.sql"), ("sql-table", "Orders", "db/migrations/1.sql"), ("sql-migration", "1.sql", "db/migrations/1.sql"),
    }
    assert [tuple(r) for r in contracts.relations(files).collect()] == [("api-route:api/openapi.json:GET /pets", "openapi-schema:api/openapi.json:Pet", "serves")]
    names = ["a.yml", "pnpm-lock.yaml", "x.lock.yaml", "package-lock.json", "OpenAPI.json", "b.json", "q.SQL", "u.schema.json", None]
    flags = spark.createDataFrame([(n,) for n in names], "path string").select(contracts.is_contract(F.col("path")).alias("y")).collect()
    assert [r.y for r in flags] == [True, False, False, False, True, False, True, True, None]


def test_command_outputs(spark):
    one = lambda t: spark.createDataFrame([("r", t)], "repo string, text string")
    got = texts.numstat(one("1\t2\ta.ts\n-\t-\tbin\n3\t0\tsrc/{old => new}/x\n4\t1\tb => c\nnoise\n\n")).collect()
    assert [(r.path, r.added, r.deleted) for r in got] == [("a.ts", 1, 2), ("bin", 0, 0), ("src/new/x", 3, 0), ("c", 4, 1)]
    rec = "\0".join([" M a", "R  new", "R  old", "?? u", "?? nested/", "A  a", ""])
    assert {r.path: r.status for r in texts.porcelain(one(rec)).collect()} == {"a": "added", "new": "renamed", "u": "untracked"}
    trees = "worktree /a\0HEAD 1\0branch refs/heads/main\0\0worktree /b\0bare\0\0worktree /c\0detached\0\0worktree /d\0prunable x\0\0"
    assert sorted((r.root, r.branch) for r in texts.worktrees(one(trees)).collect()) == [("/a", "main"), ("/c", None)]
    assert texts.numstat(one(None)).count() == texts.porcelain(one("")).count() == texts.worktrees(one(None)).count() == 0


def test_limits_and_others(spark):
    raw = json.dumps({"rate_limit": {"primary_window": {"used_percent": 5, "limit_window_seconds": 3600, "reset_at": 9}, "secondary_window": {"used_percent": 1, "limit_window_seconds": 0}}})
    got = texts.rate_limits(spark.createDataFrame([(1, raw), (2, "{"), (3, None)], "snapshot long, raw string")).collect()
    assert [tuple(r) for r in got] == [(1, "primary", 5.0, 3600.0, 9.0)]
    heads = spark.createDataFrame([(1, {"x-primary-used-percent": "7", "x-primary-window-minutes": "60", "x-secondary-used-percent": "q"})], "snapshot long, headers map<string,string>")
    assert [tuple(r) for r in texts.header_limits(heads, "x").collect()] == [(1, "primary", 7.0, 3600.0)]
    rows = spark.createDataFrame([(1, "a", True, 1, 2), (1, "b", False, None, None), (2, "a", True, 1, 2), (2, "b", True, 1, None)], "snapshot long, name string, metered boolean, used long, budget long")
    assert [(r.snapshot, r.name) for r in texts.quota_rows(rows).collect()] == [(1, "a")]
    urls = spark.createDataFrame([("r", f"file:///w/{p}") for p in ("b.ts", "a.ts", "a.ts", "node_modules/x", "zz.ts")] + [("r", "http://x"), ("r", None)], "run string, url string")
    assert [(r.path, r.truncated) for r in texts.coverage(urls, "/w", 9).orderBy("path").collect()] == [("a.ts", True), ("b.ts", True)]
    listing = spark.createDataFrame([("package.json", "yarn@4"), ("a/package.json", None), ("a/pnpm-lock.yaml", None), ("a/package-lock.json", None), ("b/package.json", None), ("c/yarn.lock", None)], "path string, declared string")
    assert {r.dir: r.manager for r in texts.package_managers(listing).collect()} == {"": "yarn", "a": "pnpm", "b": "npm"}
    beats = spark.createDataFrame([(100,), (16_000,), (85,), (None,)], "heartbeat long")
    assert [r.recent for r in texts.presence(beats, 15_100).collect()] == [True, False, False, False]
    events = spark.createDataFrame([("t", 1, '{"type":"agent_start"}'), ("t", 2, '{"type":"message_end","message":{"text":"hi","usage":{"totalTokens":5}}}'), ("t", 3, "{"), ("t", 4, None)], "task string, pos long, raw string")
    assert [(r.pos, r.n, r.kind, r.text) for r in texts.task_events(events).orderBy("pos", "n").collect()] == [(1, 0, "status", "running"), (2, 0, "message", "hi"), (2, 1, "usage", "5")]
    lines = spark.createDataFrame([("f", 2, "tool", "tool", "x" * 2005), ("f", 1, "user", "text", "hello"), ("f", 3, "assistant", "thinking", "hm")], "file string, pos long, role string, kind string, text string")
    assert texts.transcript(lines).first().markdown == "## user\n\nhello\n\n## tool\n\n```\n" + "x" * 2000 + "\n```"
    done = spark.createDataFrame([(i, i, i == 0) for i in range(5)], "id long, ended long, legacy boolean")
    newest, gone = texts.finished_tasks(done, 2)
    assert [r.id for r in newest.collect()] == [4, 3, 2, 1, 0] and sorted(r.id for r in gone.collect()) == [1, 2]
    sizes = spark.createDataFrame([("a", 5), ("b", 50), ("c", 4), ("d", 9)], "path string, size long")
    assert [r.path for r in texts.readable(sizes, 10, 10).collect()] == ["a", "c"]


def test_python_symbols(spark):
    files = spark.createDataFrame([("a.py", "import os\nX = 1\n_y: int = 2\ndef f():\n  pass\nclass C: pass\n"), ("b.py", "__all__ = ['_g']\ndef _g(): pass\ndef h(): pass\n"), ("bad.py", "def ("), ("none.py", None)], "path string, content string")
    got = {(r.path, r.name, r.kind, r.line, r.exported) for r in python_files.python_symbols(files).collect()}
    assert got == {("a.py", "X", "constant", 2, True), ("a.py", "_y", "variable", 3, False), ("a.py", "f", "function", 4, True), ("a.py", "C", "class", 6, True), ("b.py", "_g", "function", 2, True), ("b.py", "h", "function", 3, False)}


def test_string_functions(spark):
    def of(column, value, kind="string"):
        return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y

    assert [of(strings.tokens_text, n, "long") for n in (1234, 12_500, 1_250_001, 12_500_000)] == ["1.2k", "13k", "1.3M", "13M"]
    assert [of(strings.tokens_text, n, "long") for n in (0, 999, 1000, 999_499, 1_000_000)] == ["0", "999", "1.0k", "999k", "1.0M"]
    assert [of(strings.cost_text, x, "double") for x in (0.1234, 1.0, 12.345)][:2] == ["$0.123", "$1.00"]
    assert [of(strings.window_label, s, "long") for s in (604_800, 172_800, 18_000, 5400)] == ["week", "2d", "5h", "90m"]
    assert [of(strings.reset_text, s, "long") for s in (None, 0, 20, 3700, 90_000)] == ["", "resets now", "resets in 1m", "resets in 1h 1m", "resets in 1d 1h"]
    assert [of(strings.provider, p) for p in (None, " ", "OpenAI ", "a b")] == ["unknown", "unknown", "openai", "custom"]
    model = lambda p, i: tuple(spark.createDataFrame([(p, i)], "p string, i string").select(strings.model(F.col("p"), F.col("i")).alias("m")).first().m)
    assert [model("Ab", "x/GPT-4"), model("ab", "my model"), model("opencode", "my model"), model(None, "x")] == [("ab", "gpt-4"), ("custom", "custom"), ("opencode", "custom"), ("unknown", "unknown")]
    assert [of(strings.extension, p) for p in ("a/b.TS", ".env", "x", "a.b/c", "d.tar.gz")] == [".ts", "", "", "", ".gz"]
    assert [of(strings.dirname, p) for p in ("a/b/c", "c")] == ["a/b", "."] and of(strings.path_tokens, "Src/my_file-x.ts") == ["src", "my", "file", "x", "ts"]
    assert of(strings.display_label, " a\u0007​  b\n") == "a b" and len(of(strings.display_label, "x" * 200)) == 120


def test_scopes_overlap(spark):
    yes = [("src", "src/a.ts"), ("src/**", "src/x/y"), ("*.ts", "a.ts"), ("src/{a,b}.ts", "src/b.ts"), ("src/a*.ts", "src/*b.ts"), ("/abs", "x"), (None, "x"), ("a[bc]", "x"), ("- `Src/A.ts`", "src/a.ts"), ("../x", "y"), ("a?c", "abc"), ("{a,{b}}", "z")]
    no = [("src/a.ts", "src/b.ts"), ("lib", "src"), ("*.ts", "a.js"), ("src/{a,b}.ts", "src/c.ts"), ("src/a*", "src/b*"), ("a?c", "ac")]
    assert all(surfaces.overlap(a, b) and surfaces.overlap(b, a) for a, b in yes) and not any(surfaces.overlap(a, b) or surfaces.overlap(b, a) for a, b in no)
    names = sorted({x for pair in yes + no for x in pair if x}) + [None]
    table = spark.createDataFrame(list(enumerate(names)), "id long, scope string")
    got = {(r.id, r.other_id) for r in surfaces.overlapping(table, table).collect()}
    assert got == {(i, j) for i, a in enumerate(names) for j, b in enumerate(names) if surfaces.overlap(a, b)}
