"""Queries of the facts operators over the driver tables: rows as files, foreign keys as imports, parts and suppliers as entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import facts
from .registry import query, read

#: The same tables in DuckDB: fb, fc (files), eb, ec (edges), en (entities), re (relations), sy (symbols), rf (references).
SQL = """k AS (
  SELECT 'orders/' || o_orderkey || '.ts' AS a, o_orderkey AS n, 'customer/' || o_custkey || '.ts' AS b, 1 AS t FROM orders
  UNION ALL SELECT 'customer/' || c_custkey || '.ts', c_custkey, 'nation/' || c_nationkey || '.ts', 2 FROM customer
  UNION ALL SELECT 'supplier/' || s_suppkey || '.ts', s_suppkey, 'nation/' || s_nationkey || '.ts', 3 FROM supplier
  UNION ALL SELECT 'nation/' || n_nationkey || '.ts', n_nationkey, 'region/' || n_regionkey || '.ts', 4 FROM nation
), f AS (
  SELECT DISTINCT a AS path, n, t FROM k UNION ALL SELECT DISTINCT 'region/' || r_regionkey || '.ts', r_regionkey::BIGINT, 5 FROM region
  UNION ALL SELECT DISTINCT 'part/' || p_size || '.ts', p_size::BIGINT, 6 FROM part
), fb AS (SELECT path, t || ':' || n AS sha FROM f WHERE NOT (t = 2 AND n % 10 = 0)),
fc AS (SELECT path, t || ':' || n || CASE WHEN t = 2 AND n % 7 = 0 THEN 'x' ELSE '' END AS sha FROM f WHERE NOT (t = 2 AND n % 10 = 1)),
eb AS (
  SELECT n * 10 + t AS edge_index, a AS importer, CASE WHEN n % 10 <> 3 THEN '../' || b WHEN n % 3 = 0 THEN 'node:fs' WHEN n % 3 = 1 THEN './gone' || n % 4 ELSE 'lodash' END AS specifier,
         CASE WHEN n % 10 <> 3 THEN b END AS target, CASE n % 10 WHEN 3 THEN 'unresolved' WHEN 4 THEN 'filesystem' ELSE 'typescript' END AS evidence, CASE WHEN n % 10 = 3 THEN 'not found' END AS reason FROM k
), ec AS (SELECT edge_index, importer, specifier, CASE WHEN importer LIKE 'supplier/%' AND edge_index % 50 = 3 AND target IS NOT NULL THEN 'nation/0.ts' ELSE target END AS target, evidence, reason FROM eb),
en AS (SELECT 's:' || s_suppkey AS id, 'server' AS kind, s_name AS name, 'supplier/' || s_suppkey || '.ts' AS path FROM supplier UNION ALL SELECT 'p:' || p_partkey, 'client', p_name, 'part/' || p_size || '.ts' FROM part),
re AS (SELECT DISTINCT 'p:' || l_partkey AS from_id, 's:' || CASE WHEN l_suppkey % 10 = 0 THEN 999999 ELSE l_suppkey END AS to_id, CASE WHEN l_linenumber = 1 THEN 'consumes' ELSE 'serves' END AS kind FROM lineitem WHERE l_linenumber < 3),
sy AS (SELECT 'part/' || p_size || '.ts' AS path, replace(p_name, ' ', '_') AS name, CASE WHEN p_size % 2 = 0 THEN 'class' ELSE 'function' END AS kind, 'class A {' || chr(10) || '  static ' || replace(lower(p_type), ' ', '_') || '(x)' || chr(10) || '}' AS signature, p_size AS start_line, p_partkey % 3 <> 0 AS is_exported FROM part),
rf AS (SELECT DISTINCT 'orders/' || l_orderkey % 500 || '.ts' AS path, replace(p_name, ' ', '_') AS name FROM lineitem JOIN part ON l_partkey = p_partkey UNION SELECT DISTINCT 'part/' || p_size || '.ts', replace(lower(p_type), ' ', '_') FROM part)"""
REVERSE = """rv AS (
  SELECT DISTINCT side, importer, target FROM (SELECT 'base' AS side, * FROM eb UNION ALL SELECT 'candidate', * FROM ec) e
  WHERE evidence IN ('typescript', 'filesystem') AND EXISTS (SELECT 1 FROM ff WHERE ff.side = e.side AND path = importer) AND EXISTS (SELECT 1 FROM ff WHERE ff.side = e.side AND path = target)
  UNION SELECT side, a.path, b.path FROM re JOIN en a ON a.id = from_id JOIN en b ON b.id = to_id, (SELECT unnest(['base', 'candidate']) AS side) WHERE a.path <> b.path
)"""
SIDES = "ff AS (SELECT 'base' AS side, path FROM fb UNION ALL SELECT 'candidate', path FROM fc)"


def database(spark, d) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Base and candidate: files, edges, entities, relations, symbols and references."""
    ts = lambda kind, k: F.concat(F.lit(f"{kind}/"), F.col(k).cast("string"), F.lit(".ts"))
    key = lambda t, kind, k, to, b, n: read(spark, d, t).select(ts(kind, k).alias("a"), F.col(k).cast("long").alias("n"), ts(to, b).alias("b"), F.lit(n).alias("t"))
    k = key("orders", "orders", "o_orderkey", "customer", "o_custkey", 1)
    for x in (("customer", "customer", "c_custkey", "nation", "c_nationkey", 2), ("supplier", "supplier", "s_suppkey", "nation", "s_nationkey", 3), ("nation", "nation", "n_nationkey", "region", "n_regionkey", 4)):
        k = k.unionByName(key(*x))
    part, region = read(spark, d, "part"), read(spark, d, "region")
    f = k.select(F.col("a").alias("path"), "n", "t").unionByName(region.select(ts("region", "r_regionkey").alias("path"), F.col("r_regionkey").cast("long").alias("n"), F.lit(5).alias("t"))).unionByName(part.select(ts("part", "p_size").alias("path"), F.col("p_size").cast("long").alias("n"), F.lit(6).alias("t"))).distinct()
    sha = F.concat_ws(":", "t", "n")
    fb = f.where("not (t = 2 and n % 10 = 0)").select("path", sha.alias("sha"))
    fc = f.where("not (t = 2 and n % 10 = 1)").select("path", F.concat(sha, F.when((F.col("t") == 2) & (F.col("n") % 7 == 0), "x").otherwise("")).alias("sha"))
    odd = F.col("n") % 10 == 3
    spec = F.when(~odd, F.concat(F.lit("../"), "b")).when(F.col("n") % 3 == 0, "node:fs").when(F.col("n") % 3 == 1, F.concat(F.lit("./gone"), F.col("n") % 4)).otherwise("lodash")
    eb = k.select((F.col("n") * 10 + F.col("t")).alias("edge_index"), F.col("a").alias("importer"), spec.alias("specifier"), F.when(~odd, F.col("b")).alias("target"), F.when(odd, "unresolved").when(F.col("n") % 10 == 4, "filesystem").otherwise("typescript").alias("evidence"), F.when(odd, "not found").alias("reason"))
    ec = eb.withColumn("target", F.when(F.col("importer").startswith("supplier/") & (F.col("edge_index") % 50 == 3) & F.col("target").isNotNull(), "nation/0.ts").otherwise(F.col("target")))
    supplier, line = read(spark, d, "supplier"), read(spark, d, "lineitem")
    en = supplier.select(F.concat(F.lit("s:"), "s_suppkey").alias("id"), F.lit("server").alias("kind"), F.col("s_name").alias("name"), ts("supplier", "s_suppkey").alias("path"))
    en = en.unionByName(part.select(F.concat(F.lit("p:"), "p_partkey").alias("id"), F.lit("client").alias("kind"), F.col("p_name").alias("name"), ts("part", "p_size").alias("path")))
    re = line.where("l_linenumber < 3").select(F.concat(F.lit("p:"), "l_partkey").alias("from_id"), F.concat(F.lit("s:"), F.when(F.col("l_suppkey") % 10 == 0, 999999).otherwise(F.col("l_suppkey"))).alias("to_id"), F.when(F.col("l_linenumber") == 1, "consumes").otherwise("serves").alias("kind")).distinct()
    name, method = F.replace("p_name", F.lit(" "), F.lit("_")), F.replace(F.lower("p_type"), F.lit(" "), F.lit("_"))
    sy = part.select(ts("part", "p_size").alias("path"), name.alias("name"), F.when(F.col("p_size") % 2 == 0, "class").otherwise("function").alias("kind"), F.concat(F.lit("class A {\n  static "), method, F.lit("(x)\n}")).alias("signature"), F.col("p_size").alias("start_line"), (F.col("p_partkey") % 3 != 0).alias("is_exported"))
    rf = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.concat(F.lit("orders/"), F.col("l_orderkey") % 500, F.lit(".ts")).alias("path"), name.alias("name")).unionByName(part.select(ts("part", "p_size").alias("path"), method.alias("name"))).distinct()
    both = {"entities": en, "relations": re, "symbols": sy, "references": rf}
    return {"files": fb, "edges": eb} | both, {"files": fc, "edges": ec} | both


CHANGED = """ch AS (SELECT coalesce(fb.path, fc.path) AS path FROM fb FULL JOIN fc USING (path) WHERE fb.sha IS DISTINCT FROM fc.sha),
sg AS (SELECT DISTINCT importer AS path FROM ((SELECT importer, specifier, target, evidence, reason FROM eb EXCEPT SELECT importer, specifier, target, evidence, reason FROM ec) UNION ALL (SELECT importer, specifier, target, evidence, reason FROM ec EXCEPT SELECT importer, specifier, target, evidence, reason FROM eb)))"""


@query(f"""WITH RECURSIVE {SQL}, {SIDES}, {REVERSE}, {CHANGED},
r AS (SELECT side, path AS file, [path] AS chain FROM (SELECT path FROM ch UNION SELECT path FROM sg), (SELECT unnest(['base', 'candidate']) AS side)
  UNION ALL SELECT r.side, importer, list_append(chain, importer) FROM r JOIN rv ON rv.side = r.side AND target = file WHERE len(chain) < 6),
o AS (SELECT *, row_number() OVER (PARTITION BY side, file ORDER BY len(chain), chain) AS x FROM r)
SELECT file, side, (len(chain) - 1)::BIGINT AS depth, chain[len(chain) - 1] AS via, chain[1] AS origin FROM o WHERE x = 1 AND len(chain) > 1""")
def facts_impact(spark, d):
    return facts.impact(*database(spark, d))


@query(f"WITH {SQL}, {CHANGED} SELECT path FROM sg")
def facts_resolution_changes(spark, d):
    b, c = database(spark, d)
    return facts.resolution_changes(*[facts.signatures(x["edges"], x["entities"], x["relations"]) for x in (b, c)])


@query(f"""WITH {SQL}, {SIDES}, {REVERSE} SELECT importer, target FROM rv WHERE side = 'base'""")
def facts_reverse_adjacency(spark, d):
    b, _ = database(spark, d)
    return facts.reverse_adjacency(b["files"], b["edges"], b["entities"], b["relations"])


LOCAL = "evidence IN ('typescript', 'filesystem') AND importer IN (SELECT path FROM fb) AND target IN (SELECT path FROM fb)"


@query(f"""WITH {SQL}, l AS (SELECT count(*) AS n FROM eb WHERE {LOCAL}), w AS (SELECT count(*) AS n FROM re JOIN en a ON a.id = from_id JOIN en b ON b.id = to_id)
SELECT (SELECT count(*) FROM fb) AS files, l.n + w.n AS resolved, (SELECT count(*) FROM eb) - l.n AS unresolved FROM l, w""")
def facts_coverage(spark, d):
    b, _ = database(spark, d)
    return facts.coverage(b["files"], b["edges"], b["entities"], b["relations"])


@query(f"WITH {SQL}, h AS MATERIALIZED (SELECT DISTINCT path FROM fb), b AS MATERIALIZED (SELECT edge_index, importer, target FROM eb WHERE evidence IN ('typescript', 'filesystem')) SELECT b.edge_index, b.importer, b.target FROM b JOIN h AS i ON i.path = b.importer JOIN h AS t ON t.path = b.target")
def facts_local_edges(spark, d):
    b, _ = database(spark, d)
    return facts.local_edges(b["edges"], b["files"]).select("edge_index", "importer", "target")


@query(f"""WITH {SQL}, a AS (SELECT DISTINCT name FROM sy UNION SELECT DISTINCT replace(lower(p_type), ' ', '_') FROM part), x AS (SELECT DISTINCT importer, 'part/' || substr(split_part(importer, '/', 2), 1, 1) || '.ts' AS target FROM eb WHERE importer LIKE 'orders/%'),
dc AS (SELECT DISTINCT a.name, path FROM a JOIN sy ON lower(sy.name) = lower(a.name) UNION SELECT DISTINCT a.name, path FROM a JOIN sy ON sy.kind = 'class' AND contains(signature, ' ' || a.name || '('))
SELECT name, path AS file, EXISTS (SELECT 1 FROM x JOIN dc ON dc.path = x.target WHERE x.importer = rf.path AND dc.name = rf.name) AS imports_declaration
FROM rf WHERE name IN (SELECT name FROM a) AND NOT EXISTS (SELECT 1 FROM dc WHERE dc.name = rf.name AND dc.path = rf.path)""")
def facts_usage_sites(spark, d):
    """Every name of a symbol or method; orders import the part file of their number's first digit."""
    b, _ = database(spark, d)
    first = F.concat(F.lit("part/"), F.substring(F.split_part("importer", F.lit("/"), F.lit(2)), 1, 1), F.lit(".ts"))
    edges = b["edges"].where("importer like 'orders/%'").select("importer", first.alias("target"))
    names = b["symbols"].select("name").unionByName(read(spark, d, "part").select(F.replace(F.lower("p_type"), F.lit(" "), F.lit("_")).alias("name")))
    return facts.usage_sites(names, b["symbols"], b["references"], edges)


@query(f"""WITH RECURSIVE {SQL}, r AS (SELECT importer AS file, 1 AS depth, target AS via, reason FROM eb WHERE target = 'region/1.ts' UNION ALL SELECT importer, r.depth + 1, target, eb.reason FROM r JOIN eb ON target = r.file)
SELECT file, depth::BIGINT AS depth, via, 'typescript' AS evidence, reason FROM r""")
def facts_dependency_evidence(spark, d):
    """By a bare file name: 1.ts is the name of many files, region/1.ts of one."""
    b, _ = database(spark, d)
    return facts.dependency_evidence(b["files"], b["symbols"], b["edges"], "./region/1.ts", True)


@query(f"WITH {SQL} SELECT importer AS file, 1::BIGINT AS depth, arg_max(coalesce(target, specifier), edge_index) AS via, 'syntactic' AS evidence, arg_max(reason, edge_index) AS reason FROM eb WHERE specifier = 'lodash' GROUP BY importer")
def facts_dependency_specifier(spark, d):
    b, _ = database(spark, d)
    return facts.dependency_evidence(b["files"], b["symbols"], b["edges"], "lodash")


@query(f"WITH {SQL} SELECT DISTINCT path FROM sy WHERE is_exported AND name = (SELECT min(name) FROM sy WHERE is_exported)")
def facts_targets(spark, d):
    b, _ = database(spark, d)
    least = b["symbols"].where("is_exported").agg(F.min("name")).first()[0]
    return facts.resolve_targets(b["files"], b["symbols"], least)


@query(f"""WITH {SQL}, m AS (SELECT replace(p_name, ' ', '_') AS o FROM part WHERE p_partkey = 1), t AS (SELECT replace(lower(p_type), ' ', '_') AS t FROM part WHERE p_partkey = 1)
SELECT path, name || '.' || t AS name, 'method' AS kind, 'static ' || t || '(x)' AS signature FROM sy, m, t WHERE name = o AND contains(signature, 'static ' || t || '(x)')""")
def facts_members(spark, d):
    b, _ = database(spark, d)
    owner, member = (x.replace(" ", "_") for x in read(spark, d, "part").where("p_partkey = 1").select("p_name", "p_type").first())
    return facts.members(b["symbols"], f"{owner.upper()}.{member.upper()}")


@query(f"WITH {SQL} SELECT id, name, path FROM en WHERE kind = 'client' AND lower(name) = (SELECT min(lower(p_name)) FROM part)")
def facts_entities(spark, d):
    b, _ = database(spark, d)
    name = read(spark, d, "part").agg(F.min(F.lower("p_name"))).first()[0]
    return facts.entities_where(b["entities"], name=name.upper(), kind="client").select("id", "name", "path")


@query(f"WITH {SQL} SELECT from_id, kind FROM re WHERE to_id = 's:1' AND kind = 'serves'")
def facts_relations(spark, d):
    b, _ = database(spark, d)
    return facts.relations_where(b["relations"], to_id="s:1", kind="serves").select("from_id", "kind")


@query(f"""WITH {SQL}, s AS (SELECT from_id AS id, to_id AS other, '>' AS way, kind FROM re UNION ALL SELECT to_id, from_id, '<', kind FROM re),
t AS (SELECT DISTINCT s.id, way = '<' AS incoming, s.kind || ' ' || way || ' ' || coalesce(en.name, other) AS text FROM s LEFT JOIN en ON en.id = other),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY incoming, text) AS x, count(*) OVER (PARTITION BY id) AS n FROM t)
SELECT en.id, en.name, coalesce(string_agg(text, '; ' ORDER BY x) FILTER (x <= 4), '') AS relations, coalesce(max(n), 0)::BIGINT AS n FROM en LEFT JOIN o ON o.id = en.id GROUP BY en.id, en.name""")
def facts_entity_rows(spark, d):
    b, _ = database(spark, d)
    return facts.entity_rows(b["entities"], b["relations"])


@query(f"""WITH {SQL}, x AS (SELECT 'path' AS kind, path AS name, path FROM fb UNION ALL SELECT 'symbol', name, path FROM sy UNION ALL SELECT 'docstring', signature, path FROM sy UNION ALL SELECT 'entity', name, path FROM en)
SELECT kind, name, path, count(*) AS n FROM x GROUP BY ALL""")
def facts_index_entries(spark, d):
    b, _ = database(spark, d)
    docs = b["symbols"].select("path", F.col("signature").alias("docstring"))
    return facts.index_entries(b["files"], b["symbols"], b["entities"], docs).groupBy("kind", "name", "path").agg(F.count("*").alias("n"))


@query(f"WITH {SQL} SELECT path, name, kind, count(*) AS n FROM sy WHERE is_exported GROUP BY ALL")
def facts_exported(spark, d):
    b, _ = database(spark, d)
    return facts.exported(b["symbols"]).groupBy("path", "name", "kind").agg(F.count("*").alias("n"))


IMPORTS = "im AS (SELECT 'user/' || user_id AS importer, event_type || '-' || (props->>'$.k') AS specifier, CASE WHEN (props->>'$.k')::BIGINT % 3 > 0 THEN 'lib/' || event_type END AS target, event_id AS edge_index FROM events UNION ALL SELECT 'user/' || user_id, ['node:fs', './x', 'lodash'][event_id % 3 + 1], NULL, event_id FROM events)"


def imports(spark, d) -> DataFrame:
    e = read(spark, d, "events")
    k = F.get_json_object("props", "$.k").try_cast("long")
    own = e.select(F.concat(F.lit("user/"), "user_id").alias("importer"), F.concat_ws("-", "event_type", k).alias("specifier"), F.when(k % 3 > 0, F.concat(F.lit("lib/"), "event_type")).alias("target"), F.col("event_id").alias("edge_index"))
    more = e.select(F.concat(F.lit("user/"), "user_id").alias("importer"), F.element_at(F.array(F.lit("node:fs"), F.lit("./x"), F.lit("lodash")), (F.col("event_id") % 3 + 1).cast("int")).alias("specifier"), F.lit(None).cast("string").alias("target"), F.col("event_id").alias("edge_index"))
    return own.unionByName(more)


@query(f"""WITH {IMPORTS}, l AS (SELECT importer, specifier, arg_max(struct_pack(t := target), edge_index).t AS target FROM im GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY importer ORDER BY target IS NULL, specifier) AS x FROM l)
SELECT importer, specifier, target, CASE WHEN target IS NOT NULL THEN NULL WHEN specifier LIKE 'node:%' THEN 'builtin' WHEN specifier LIKE '.%' THEN 'relative' ELSE 'external' END AS category FROM o WHERE x <= 20""")
def facts_import_rows(spark, d):
    return facts.import_rows(imports(spark, d))


@query(f"""WITH {SQL}, r AS (SELECT CASE WHEN evidence IN ('typescript', 'filesystem') THEN 'resolved' WHEN specifier LIKE 'node:%' THEN 'builtin' WHEN specifier LIKE '.%' OR specifier LIKE '/%' THEN 'relative' ELSE 'external' END AS category, importer, specifier FROM eb WHERE evidence IN ('typescript', 'filesystem', 'unresolved'))
SELECT category, count(*) AS n, CASE WHEN category = 'relative' THEN (SELECT string_agg(importer || ' -> ' || specifier, chr(10) ORDER BY importer, specifier) FROM (SELECT * FROM r WHERE category = 'relative' ORDER BY importer, specifier LIMIT 3)) ELSE '' END AS examples FROM r GROUP BY category""")
def facts_resolution_summary(spark, d):
    b, _ = database(spark, d)
    return facts.resolution_summary(b["edges"])


@query(f"""WITH {SQL}, {CHANGED} SELECT importer, target, CASE WHEN importer IN (SELECT path FROM ch) THEN 'importer' ELSE 'target' END AS side FROM eb
WHERE target IS NOT NULL AND (importer IN (SELECT path FROM ch)) <> (target IN (SELECT path FROM ch))""")
def facts_boundary_edges(spark, d):
    from ..operators.snapshots import delta

    b, c = database(spark, d)
    return facts.boundary_edges(b["edges"], delta(b["files"], c["files"]).where("change <> 'untouched'"))


@query(f"""WITH {SQL}, c AS (SELECT DISTINCT n % 40 AS change, CASE WHEN n % 40 = 0 THEN 'docs/' || n || '.yaml' WHEN n % 40 = 1 THEN 'tests/' || n || '.ts' WHEN n % 40 = 2 THEN n || '.md' WHEN n % 40 = 3 THEN 'notes' || n || '.txt' ELSE path END AS path FROM f WHERE t IN (1, 2)),
ed AS (SELECT DISTINCT importer, target FROM eb WHERE target IS NOT NULL),
x AS (SELECT c.change, importer, target, true AS dep FROM c JOIN ed ON ed.target = c.path ANTI JOIN c AS i ON i.change = c.change AND i.path = ed.importer UNION ALL SELECT c.change, importer, target, false FROM c JOIN ed ON ed.importer = c.path ANTI JOIN c AS i ON i.change = c.change AND i.path = ed.target),
y AS (SELECT change, count(DISTINCT CASE WHEN dep THEN importer END) AS dependents, count(*) AS boundary FROM x GROUP BY change),
z AS (SELECT change, count(*) AS files, count_if(NOT regexp_matches(path, '^(tests|docs)/') AND NOT ends_with(path, '.md')) AS outside FROM c GROUP BY change),
w AS (SELECT change, files, coalesce(dependents, 0) AS dependents, coalesce(boundary, 0) AS boundary, outside, CASE WHEN change % 3 = 0 THEN change ELSE 0 END AS open, CASE WHEN change % 3 = 0 THEN change % 2 ELSE 0 END AS fixed FROM z LEFT JOIN y USING (change))
SELECT change, files, dependents, boundary, CASE WHEN outside = 0 THEN 'low' WHEN dependents > 0 THEN 'high' ELSE 'medium' END AS tier,
array_to_string(list_sort(list_filter([CASE WHEN outside = 0 THEN 'all changed files are tests/docs/markdown: fixture or documentation-only change' WHEN dependents > 0 THEN 'changed files outside tests/docs affect ' || dependents || ' unchanged dependents: proposing high tier' WHEN boundary > 0 THEN boundary || ' module-boundary edge(s) touched: proposing at least medium tier' ELSE outside || ' changed file(s) outside tests/docs with no other signal: proposing medium tier' END,
CASE WHEN outside > 0 AND dependents > 0 AND boundary > 0 THEN boundary || ' module-boundary edge(s) touched (context; high tier already applies)' END, CASE WHEN open > 0 THEN open || ' prior open advisories in ledger' END, CASE WHEN fixed > 0 THEN fixed || ' prior advisories fixed in ledger' END], lambda l: l IS NOT NULL)), chr(10)) AS rationale FROM w""")
def facts_tier_proposal(spark, d):
    """Forty changes over all orders and customers, four of them outside the code; every third has advisories."""
    b, _ = database(spark, d)
    rows = read(spark, d, "orders").select(F.col("o_orderkey").alias("n"), F.concat(F.lit("orders/"), "o_orderkey", F.lit(".ts")).alias("path")).unionByName(read(spark, d, "customer").select(F.col("c_custkey").alias("n"), F.concat(F.lit("customer/"), "c_custkey", F.lit(".ts")).alias("path")))
    m = F.col("n") % 40
    rows = rows.select(m.alias("change"), F.when(m == 0, F.concat(F.lit("docs/"), "n", F.lit(".yaml"))).when(m == 1, F.concat(F.lit("tests/"), "n", F.lit(".ts"))).when(m == 2, F.concat("n", F.lit(".md"))).when(m == 3, F.concat(F.lit("notes"), "n", F.lit(".txt"))).otherwise(F.col("path")).alias("path"))
    ledger = rows.select("change").distinct().where("change % 3 = 0").select("change", F.col("change").alias("open"), (F.col("change") % 2).alias("fixed"))
    return facts.tier_proposal(rows, b["edges"], ["change"], ledger)


@query(f"WITH {SQL} SELECT (SELECT count(*) FROM fb) AS files, (SELECT count(*) FROM sy) AS symbols")
def facts_summary(spark, d):
    b, _ = database(spark, d)
    return facts.summary(b["files"], b["symbols"])


IMPORTERS = """i AS (SELECT CASE o_orderkey % 7 WHEN 0 THEN 'test/o' WHEN 1 THEN 'src/__tests__/o' WHEN 2 THEN 'latest/o' ELSE 'src/o' END || o_orderkey || CASE o_orderkey % 5 WHEN 0 THEN '.test.mts' WHEN 1 THEN '.spec.helper.ts' ELSE '.ts' END AS importer, o_orderkey % 7 < 2 OR o_orderkey % 5 = 0 AS test, 'supplier/' || (o_orderkey % 150) || '.ts' AS path, o_orderkey % 7 = 1 AS deep FROM orders)"""


def importers(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    path = F.concat(F.when(k % 7 == 0, "test/o").when(k % 7 == 1, "src/__tests__/o").when(k % 7 == 2, "latest/o").otherwise("src/o"), k, F.when(k % 5 == 0, ".test.mts").when(k % 5 == 1, ".spec.helper.ts").otherwise(".ts"))
    return read(spark, d, "orders").select(path.alias("path"), F.concat(F.when(k % 7 == 1, "../../").otherwise(".././"), F.lit("supplier/x/../"), k % 150, F.lit(".ts")).alias("specifier"))


@query(f"""WITH {SQL}, {IMPORTERS} SELECT DISTINCT CASE WHEN test THEN 'test:' ELSE 'consumer:' END || importer AS from_id, importer, id AS to_id, CASE WHEN test THEN 'validates' ELSE 'consumes' END AS kind FROM i JOIN en USING (path)""")
def facts_contract_edges(spark, d):
    b, _ = database(spark, d)
    return facts.contract_edges(importers(spark, d), b["entities"])


@query(f"""WITH {SQL}, {IMPORTERS} SELECT DISTINCT CASE WHEN test THEN 'test:' ELSE 'consumer:' END || importer AS id, CASE WHEN test THEN 'test' ELSE 'consumer' END AS kind, regexp_extract(importer, '[^/]*$') AS name, importer AS path FROM i SEMI JOIN en USING (path)""")
def facts_contract_consumers(spark, d):
    b, _ = database(spark, d)
    return facts.contract_entities(importers(spark, d), b["entities"])


EXTENSIONS = (".ts", ".MTS", ".cjs", ".jsx", ".py", ".go", ".rs", "", ".d.cts", "/.py", ".mjs")


@query(f"""WITH {SQL}, a AS (SELECT path FROM fb UNION ALL SELECT 'doc/' || doc_id || {list(EXTENSIONS)}[(doc_id % {len(EXTENSIONS)} + 1)::INT] FROM documents)
SELECT CASE WHEN path LIKE '%/.py' THEN 'unknown' WHEN lower(path) SIMILAR TO '.*\\.(ts|tsx|mts|cts)' THEN 'typescript' WHEN lower(path) SIMILAR TO '.*\\.(js|jsx|mjs|cjs)' THEN 'javascript' WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.go' THEN 'go' ELSE 'unknown' END AS language, count(*) AS files FROM a GROUP BY 1""")
def facts_languages(spark, d):
    b, _ = database(spark, d)
    i = F.col("doc_id")
    docs = read(spark, d, "documents").select(F.concat(F.lit("doc/"), i, F.element_at(F.array(*map(F.lit, EXTENSIONS)), (i % len(EXTENSIONS) + 1).cast("int"))).alias("path"))
    return b["files"].select("path").unionByName(docs).groupBy(facts.language(F.col("path")).alias("language")).agg(F.count("*").alias("files"))
