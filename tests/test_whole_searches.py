"""Searches without a bound on depth, and tables of queries."""

from tracewell.operators import search, snapshots, work


def test_dependents_go_as_deep_as_the_graph(spark):
    deep = 55
    edges = spark.createDataFrame([(i, f"n{i + 1}", f"n{i}") for i in range(deep)], "edge_index long, importer string, target string").coalesce(1)
    got = {r.importer: (r.depth, r.via) for r in snapshots.dependents(edges, spark.createDataFrame([("n0",)], "path string")).collect()}
    assert got == {f"n{i + 1}": (i + 1, f"n{i}") for i in range(deep)}


def test_a_table_of_sources_relates_as_single_ones_and_refs_count(spark):
    ref = lambda *ids: [("issue", "r", i) for i in ids]
    rows = [(1, "A", "t", ["x"], ref("7")), (2, "a ", "T", None, None), (3, None, None, [" X"], None), (4, "b", "t", [], ref("7", "8")), (5, "", "", [""], ref("8")), (6, None, None, None, None)]
    nodes = spark.createDataFrame(rows, "node int, area string, topic string, tags array<string>, refs array<struct<kind string, repository string, id string>>").coalesce(1)
    assert {r.node: r.reasons for r in work.related(nodes, 1).collect()} == {2: "area,topic", 3: "tag", 4: "ref"}
    got = {(r.source, r.node, r.reasons) for r in work.related_all(nodes, nodes.where("node in (1, 4, 6)")).collect()}
    assert got == {(1, 2, "area,topic"), (1, 3, "tag"), (1, 4, "ref"), (4, 1, "ref"), (4, 5, "ref")}


def test_a_table_of_texts_finds_as_single_ones(spark):
    names = ["steel", "Steel rod", "old steel", "stel", "tee", None, "xx", "", "a-b", "stee1 x"]
    entries = spark.createDataFrame(list(enumerate(names)), "entry_index long, name string").selectExpr("*", "'k' AS kind").coalesce(1)
    texts = ["Steel", "rod STEEL", "x", "", "b a", "--", "stee"]
    want = {(t, r.entry_index, r.score) for t in texts for r in search.lexical(entries, t).collect()}
    got = [(r.query, r.entry_index, r.score) for r in search.lexical_all(entries, spark.createDataFrame([(t, t) for t in [*texts, None]], "query string, text string")).collect()]
    assert set(got) == want and len(got) == len(want)


def test_a_table_of_symbols_finds_as_single_ones(spark):
    entries = spark.createDataFrame([("f", "a", "k"), ("F", "b", "k"), (None, "b", "m")], "name string, file string, kind string").coalesce(1)
    asked = [(1, "F", None, None), (2, None, "b", "k"), (3, None, None, None), (4, "f", "a", "m"), (5, None, None, "m")]
    got = sorted((r.query, str(r.name), r.file, r.kind) for r in work.symbols_all(entries, spark.createDataFrame(asked, "query int, name string, file string, kind string")).collect())
    assert got == sorted((q, str(r.name), r.file, r.kind) for q, *x in asked for r in work.symbols(entries, *x).collect())
