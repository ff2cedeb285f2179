"""Results that are far larger than their input: repeated rows against plain loops, and no shuffle above what takes classes apart."""

import re

from pyspark.sql import functions as F

from tracewell.operators import facts, proofs, search, spread, surfaces, work
from tracewell.sources import workspace


def above(df, node: str) -> list[str]:
    """Operators of the optimized plan above the first one named ``node``."""
    names = [line.lstrip(" :+-").split(" ")[0] for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    return names[: names.index(node)]


def unshuffled(df) -> bool:
    return not {"Aggregate", "Window", "Join", "Sort", "RepartitionByExpression"} & set(above(df, "Generate"))


def entries_of(spark):
    rows = [(i, "symbol" if i % 3 else "file", f"f{i % 4}", f"{'big' if i % 2 else 'small'} ring") for i in range(400)]
    return spark.createDataFrame(rows, "entry_index long, kind string, file string, name string")


def test_ranked_search_ranks_texts_once(spark):
    entries = entries_of(spark)
    asked = spark.createDataFrame([(i, "Big Ring" if i % 2 else "ring") for i in range(30)] + [(99, None)], "query int, text string")
    got = search.lexical_ranked(entries, asked, 3, F.col("kind") == "symbol")
    assert "Window" not in above(got, "Join")  # queries come after the ranks of their texts
    chosen = entries.where("kind = 'symbol'")
    of = {r.entry_index: (r.file, r.name, r.entry_index) for r in chosen.collect()}
    want = set()
    for half, text in enumerate(("ring", "big ring")):
        best = sorted((-r.score, *of[r.entry_index]) for r in search.lexical(chosen, text).collect())[:3]
        want |= {(q, "symbol", x[-1], -x[0], at + 1) for q in range(half, 30, 2) for at, x in enumerate(best)}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_related_nodes_are_not_shuffled(spark):
    rows = [(i, f"A{i % 3}", f"T{i % 2}", [f"x{i % 5}"], None) for i in range(90)] + [(7, "A2", "T0", ["x1"], None), (7, "A2", "T0", ["x1"], None)]
    nodes = spark.createDataFrame(rows, "node int, area string, topic string, tags array<string>, refs array<struct<kind: string, repository: string, id: string>>")
    got = work.related_all(nodes, nodes.where("node % 10 = 7"))
    assert unshuffled(got)

    def why(a, b):
        both = a[1] == b[1]
        return ",".join([*["area"] * both, *["tag"] * bool(set(a[3]) & set(b[3])), *["topic"] * (both and a[2] == b[2])])

    want = {(a[0], b[0], why(a, b)) for a in rows if a[0] % 10 == 7 for b in rows if a[0] != b[0] and why(a, b)}
    found = [tuple(r) for r in got.collect()]
    assert set(found) == want and len(found) == len(want)


def test_profiles_of_equal_tags_and_refs_meet_together(spark, monkeypatch):
    """Nodes of which no two have the same traits: what meets is far less than the pairs that are told."""
    met = []
    monkeypatch.setattr(work, "dealt", lambda *a: met.append(spread.dealt(*a)) or met[-1])
    rows = [(i, f"A{i % 4}\nb", f"T{i // 8}", [f"x{i % 3}", "Y "], [("k", "r", str(i % 2))]) for i in range(240)] + [(None, "A0", "T0", ["y"], None), (240, "a0", "b\nt0", ["y", "", None], []), (248, None, "t0", None, [("k", "r", "0"), None])]
    nodes = spark.createDataFrame(rows, "node int, area string, topic string, tags array<string>, refs array<struct<kind: string, repository: string, id: string>>")

    def why(a, b):
        area, ref = a[1] is not None and b[1] is not None and a[1].lower() == b[1].lower(), set(a[4] or []) & set(b[4] or []) - {None}
        tags = [{t.strip().lower() for t in x[3] or [] if t and t.strip()} for x in (a, b)]
        return ",".join([*["area"] * area, *["ref"] * bool(ref), *["tag"] * bool(tags[0] & tags[1]), *["topic"] * (area and a[2].lower() == b[2].lower())])

    want = {(a[0], b[0], why(a, b)) for a in rows if a[0] is not None and a[0] % 8 == 0 for b in rows if b[0] is not None and a[0] != b[0] and why(a, b)}
    got = work.related_all(nodes, nodes.where("node % 8 = 0"))
    found = [tuple(r) for r in got.collect()]
    assert set(found) == want and len(found) == len(want)
    assert sum(m.count() for m in met) < len(want) / 10


def test_scopes_of_equal_text_are_read_once(spark):
    texts = ["src/a/**", "src/a/x*.ts", "src/b/y.ts", None, "src/a/xy.ts"]
    table = spark.createDataFrame([(i, texts[i % 5]) for i in range(60)] + [(0, texts[0])], "id int, scope string")
    got = surfaces.overlapping(table.where("id < 6"), table)
    assert unshuffled(got)
    want = sorted((i, j) for i in range(6) for j in range(60) if surfaces.overlap(texts[i % 5], texts[j % 5]))
    assert sorted((r.id, r.other_id) for r in got.collect()) == want


def test_entries_of_one_name_are_not_shuffled(spark):
    entries = entries_of(spark).drop("file")
    asked = spark.createDataFrame([(i, "Big Ring") for i in range(20)] + [(None, "small ring")], "query int, text string")
    got = search.lexical_all(entries, asked)
    assert unshuffled(got)
    found = [(r.query, r.entry_index, r.score) for r in got.collect()]
    want = {(r.entry_index, r.score) for r in search.lexical(entries, "big ring").collect()}
    assert len(found) == len(set(found)) and all({(e, s) for q, e, s in found if q == i} == want for i in range(20))
    assert {(e, s) for q, e, s in found if q is None} == {(r.entry_index, r.score) for r in search.lexical(entries, "small ring").collect()}


def test_alike_names_meet_without_their_pairs_being_kept(spark, monkeypatch):
    """Names that all share their grams: each pair is told once where it is met, whatever its ways, in parts, and for large sets too."""
    names = [f"Part#{i:05d}" for i in range(0, 300, 7)] + ["big ring", "Ring big", "big", "", "ri", "a ring of the big king"]
    entries = spark.createDataFrame([(i, "k", x) for i, x in enumerate(names)] + [(900, "k", "big ring"), (901, "k", None)], "entry_index long, kind string, name string")
    texts = ["Part#00014", "part#00014 part", "ring big", "big ring", "ri", "", "g", "the big king"]
    asked = spark.createDataFrame(list(enumerate([*texts, "Big Ring", None])), "query int, text string")
    want = {t: {(r.entry_index, r.score) for r in search.lexical(entries, t).collect()} for t in {*map(str.lower, texts)}}
    for most, small in ((1 << 16, 128), (40, 9)):
        monkeypatch.setattr(search, "MOST", most)
        monkeypatch.setattr(search, "SMALL", small)
        got = search.lexical_all(entries, asked)
        found = [(r.query, r.entry_index, r.score) for r in got.collect()]
        assert len(found) == len(set(found))
        for q, t in enumerate([*texts, "Big Ring"]):
            assert {(e, s) for n, e, s in found if n == q} == want[t.lower()], t
    assert not re.search(r"Aggregate \[q#\d+, name#\d+\]", plan_of(got)) and {q for q, _, _ in found} <= set(range(9))


def test_pairs_are_counted_before_what_scores_higher_is_looked_for(spark, monkeypatch):
    """All words are looked for at the meeting by words alone, and what is taken apart at once stays small."""
    met, matches = [], search.matches
    monkeypatch.setattr(search, "matches", lambda *a: met.append(matches(*a)) or met[-1])
    names = ["a big ring", "big ring", "ring of the big", "bigring x", "big-ring", "the big ringing"]
    entries = spark.createDataFrame([(i, "k", names[0]) for i in range(700)] + [(1000 + i, "k", x) for i, x in enumerate(names)], "entry_index long, kind string, name string")
    texts = [names[0]] * 300 + ["ring big", "big rin", "g", "", "xx big ring"]
    got = search.lexical_all(entries, spark.createDataFrame(list(enumerate(texts)), "query int, text string"))
    assert sum("forall(" in line for line in plan_of(got).splitlines() if "Join Inner" in line) == 1
    assert met[0].selectExpr("max(size(held) * size(asking))").first()[0] <= 1 << 14
    want = {t: {(r.entry_index, r.score) for r in search.lexical(entries, t).collect()} for t in set(texts)}
    found = [(r.query, r.entry_index, r.score) for r in got.collect()]
    assert len(found) == len(set(found)) == sum(len(want[t]) for t in texts)
    assert set(found) == {(q, *x) for q, t in enumerate(texts) for x in want[t]}


def test_symbols_of_one_name_are_not_shuffled(spark):
    entries = entries_of(spark)
    asked = spark.createDataFrame([(1, "BIG ring", None, None), (2, "BIG ring", None, None), (3, None, "f1", "file"), (4, None, None, None), (5, "big ring", "f1", None)], "query int, name string, file string, kind string")
    got = work.symbols_all(entries, asked)
    assert unshuffled(got)
    want = [(q.query, e.entry_index) for q in asked.collect() for e in entries.collect() if (q.name is None or q.name.lower() == e.name) and q.file in (None, e.file) and q.kind in (None, e.kind)]
    assert sorted((r.query, r.entry_index) for r in got.collect()) == sorted(want) and got.columns == ["query", *entries.columns]


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_reach_is_asked_by_pairs_of_files(spark):
    """A path that very many proofs cover, and of which very many pairs are known, does not meet by itself."""
    n = 60
    proof = spark.createDataFrame([(i, "passed", "open", None) for i in range(n)], "fingerprint int, status string, confidence string, observed array<string>")
    covered = spark.createDataFrame([(i, "hot", "d") for i in range(n)], "fingerprint int, path string, digest string")
    now = spark.createDataFrame([("hot", "d")], "path string, digest string")
    changed = spark.createDataFrame([(i, f"c{i}", 0) for i in range(n - 1)], "fingerprint int, path string, pos int")
    reach = spark.createDataFrame([(f"c{i}", "hot", i % 2 == 0) for i in range(n - 2)], "changed string, covered string, reaches boolean")
    got = proofs.validity(proof, covered, now, changed, reach)
    assert "Join Inner, (path#" not in plan_of(got)
    want = {i: "reached" if i % 2 == 0 else "conservative" for i in range(n - 2)} | {n - 2: "unknown-reach", n - 1: "unaffected"}
    assert {r.fingerprint: r.reason for r in got.collect()} == want


def test_verdicts_are_made_once(spark):
    """Each suite takes its fallback where its tests are, and coverage is dealt once for what it is counted and met by."""
    have = spark.createDataFrame([(i, "passed", "open", [f"c{i % 4}"] if i % 2 else None) for i in range(12)], "fingerprint int, status string, confidence string, observed array<string>")
    covered = spark.createDataFrame([(i, p, "d") for i in range(12) for p in ("x", "y", "x")] + [(None, "x", "d")], "fingerprint int, path string, digest string")
    now = spark.createDataFrame([("x", "d"), ("y", "d")], "path string, digest string")
    changed = spark.createDataFrame([(i, f"c{(i + j) % 4}", j) for i in range(8) for j in (0, 1, 1)] + [(None, "c0", 0)], "fingerprint int, path string, pos int")
    reach = spark.createDataFrame([(f"c{i}", p, i == 1) for i in range(3) for p in "xy"] + [("c3", "x", False), ("c3", "y", None)], "changed string, covered string, reaches boolean")
    told = proofs.validity(have, covered, now, changed, reach)
    first = {0: "reached", 1: "reached", 2: "unknown-reach", 3: "unknown-reach"}
    want = {i: first[i % 4] if i < 8 else "unaffected" for i in range(12)}
    assert {r.fingerprint: r.reason for r in told.collect()} == want
    inventory = spark.createDataFrame([(i % 4 if i else None, f"t{i}", i) for i in range(12)], "suite int, name string, fingerprint int")
    got = proofs.select_tests(inventory, have, told)
    assert sorted(tuple(r) for r in got.select("suite", "name", "action", "fallback").collect()) == sorted((i % 4, f"t{i}", "reuse" if i >= 8 else "execute", i % 4 > 1) for i in range(1, 12))
    read = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert read(got) == read(told) + 2


def test_relations_are_distinct_between_their_ends(spark):
    files = spark.createDataFrame([("a",), ("b",)], "path string")
    edges = spark.createDataFrame([("a", "b", "typescript"), ("a", "gone", "typescript"), ("b", "a", "unresolved")], "importer string, target string, evidence string")
    entities = spark.createDataFrame([(f"p{i}", f"part{i % 2}") for i in range(20)] + [("s", "server"), ("none", None)], "id string, path string")
    relations = spark.createDataFrame([(f"p{i}", to, k) for i in range(20) for to in ("s", "gone", "p0", "none") for k in ("serves", "consumes")], "from_id string, to_id string, kind string")
    got = facts.reverse_adjacency(files, edges, entities, relations)
    assert re.search(r"Aggregate \[importer#\d+, to_id#\d+\]", plan_of(got))
    assert sorted(tuple(r) for r in got.collect()) == [("a", "b"), ("part0", "server"), ("part1", "part0"), ("part1", "server")]


def test_paths_meet_all_edges_at_once(spark):
    """Edges of several kinds, few of some: the paths are not gathered again for each kind, nor held where they can't spill."""
    files = spark.createDataFrame([(f"f{i}",) for i in range(30)] + [("f1",), (None,)], "path string")
    kinds = [[(f"f{i}", f"f{i % 4}", k) for i in range(0, 40, step)] for step, k in ((1, "typescript"), (7, "filesystem"), (20, "unresolved"), (5, "typescript"))]
    edges, rows = None, [*sum(kinds, []), (None, "f1", "typescript"), ("f1", None, "typescript"), ("f1", "gone", "typescript")]
    for part in (*kinds, rows[-3:]):
        one = spark.createDataFrame(part, "importer string, target string, evidence string")
        edges = one if edges is None else edges.unionByName(one)
    got = facts.local_edges(edges, files)
    assert plan_of(got).count("Join ") == 2 and "shuffle_hash" not in plan_of(got)
    want = sorted(r for r in rows if r[2] != "unresolved" and all(p and p != "gone" and int(p[1:]) < 30 for p in r[:2]))
    assert sorted(tuple(r) for r in got.collect()) == want and got.columns == edges.columns


def test_resolutions_of_a_file_are_not_gathered(spark):
    edge = "importer string, specifier string, target string, evidence string, reason string"
    rows = [(f, f"./{i}", f"t{i}", "typescript", None) for f in ("hot", "same", "less", "more") for i in range(50)] + [(None, "x", None, "unresolved", None)]
    old, new = spark.createDataFrame(rows, edge), spark.createDataFrame([r for r in rows if r[:2] not in (("less", "./7"), ("hot", "./7"))] + [("hot", "./7", None, "unresolved", "not found"), ("more", "./50", "t50", "typescript", None), rows[60], ("fresh", "a", None, "unresolved", "")], edge)
    entities = spark.createDataFrame([(f"p{i}", f"part{i % 3}") for i in range(30)], "id string, path string")
    relation = "from_id string, to_id string, kind string"
    both = [(f"p{i}", f"p{j}", "serves") for i in range(30) for j in range(5)]
    one, two = spark.createDataFrame([*both, ("p1", "p9", "serves")], relation), spark.createDataFrame([*both, ("p2", "gone", "serves")], relation)
    got = facts.resolution_changes(facts.signatures(old, entities, one), facts.signatures(new, entities, two))
    assert "collect" not in plan_of(got)
    assert sorted(r.path for r in got.collect()) == ["fresh", "hot", "less", "more", "part1"]


def test_folders_are_asked_once_for_all_commands(spark):
    commands = spark.createDataFrame([(i, "r", "a/b" if i % 2 else "c") for i in range(50)] + [(1, "r", "a"), (None, "r", "a")], "id int, root string, folder string")
    files = spark.createDataFrame([("r", "yarn.lock")], "root string, path string")
    manifests = spark.createDataFrame([("r", "a/package.json", '{"scripts": {"test": "x"}}')], "root string, path string, text string")
    got = workspace.receipts(commands, files, manifests)
    assert re.search(r"Aggregate \[root#\d+, (folder|from)#\d+\]", plan_of(got))
    rows = [(r.id, r.package_path, r.package_manager, r.test_command) for r in got.collect()]
    one = ("a/package.json", "yarn", "yarn test")
    assert sorted(rows, key=str) == sorted([*[(i, *(one if i % 2 else (None, None, None))) for i in range(50)], (1, *one), (None, None, None, None)], key=str)
