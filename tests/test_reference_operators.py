"""Operators on small rows: tie-breaks, nulls, empty inputs; and every query against its SQL."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tracewell.functions.scalars import half_up, identity, query_tokens, trigrams
from tracewell.operators import history, metrics, search, snapshots, stats
from tracewell.plans import facts, more, texts  # noqa: F401 - they add their queries
from tracewell.plans.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return float(f"{float(v):.10g}") if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = QUERIES[name](spark, sf)
    cur = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(map(plain, r)) for r in cur.fetchall())


def test_scalars(spark):
    row = spark.range(1).selectExpr("'  A  b\\n' AS t", "-2.5D AS x", "'Abcd' AS w").select(identity("t"), half_up(F.col("x"), 0), trigrams(F.col("w"))).first()
    assert tuple(row) == ("a b", -2.0, ["Abc", "bcd"])
    assert query_tokens("Ünï x-9") == ["n", "x", "9"]


def test_dependents_equal_a_plain_search(spark):
    rng = random.Random(4)
    for seed in range(2):
        edges = [(i, f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for i in range(20)] + [(50, "n1", "n0"), (51, "n1", "n0")]
        seen, level, want, depth = {"n0"}, {"n0"}, {}, 0
        while level:
            depth += 1
            nxt = {}
            for i, a, b in sorted(edges):
                if b in level and a not in seen:
                    nxt[a] = b
            want |= {a: (depth, b) for a, b in nxt.items()}
            seen |= set(nxt)
            level = set(nxt)
        table = spark.createDataFrame(edges, "edge_index long, importer string, target string")
        got = snapshots.dependents(table, spark.createDataFrame([("n0",)], "path string")).collect()
        assert {r.importer: (r.depth, r.via) for r in got} == want
    assert snapshots.dependents(table, spark.createDataFrame([("none",)], "path string")).count() == 0


def test_history(spark):
    rows = spark.createDataFrame([(1, " Fix  it"), (2, "fix it"), (3, "  "), (4, None), (5, "other")], "pos long, text string")
    assert [r.pos for r in history.keep_first(rows, ["pos"]).orderBy("pos").collect()] == [1, 5]
    old = spark.createDataFrame([("other",)], "key string")
    assert [r.pos for r in history.visible(rows, old).orderBy("pos").collect()] == [1, 2, 3, 4]
    assert history.token_filter(rows, " ").count() == 5


def test_latch_and_flood(spark):
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate([80, 95, None, 96, 10, 91])], "k string, ms long, v int")
    assert [r.ms for r in metrics.latch(rows, "k", ["ms"], "v", 90).orderBy("ms").collect()] == [1, 5]
    assert [r.ms for r in metrics.flood(rows, "k", "ms", 3, 2).orderBy("ms").collect()] == [2, 3, 4, 5]


def test_empty_inputs(spark):
    usage = spark.createDataFrame([], "session string, model string, day date, tokens long, cost double, second long")
    assert stats.by_model(usage).count() == 0 and stats.streaks(usage, ["model"], "2024-01-31").count() == 0
    assert search.lexical(spark.createDataFrame([], "entry_index long, kind string, name string"), "x").count() == 0
    assert snapshots.delta(*[spark.createDataFrame([], "path string, sha string")] * 2).count() == 0


def test_search_scores(spark):
    names = ["steel", "Steel rod", "old steel", "stel", "tee", None, "xx"]
    got = search.lexical(spark.createDataFrame(list(enumerate(names)), "entry_index long, name string").selectExpr("*", "'k' AS kind"), "Steel").collect()
    assert [(r.name, r.score) for r in got] == [("steel", 1.0), ("Steel rod", 0.75), ("old steel", 0.6)]


def test_entry_imports_without_the_corpus_operators(tmp_path):
    import shutil
    import subprocess
    import sys

    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(top, "tracewell"), tmp_path / "tracewell", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(top, "__spark_entry__.py"), tmp_path)
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and 'pipeline' not in e.queries()"], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})
