"""Queries of workspace scans, branches, cursors, collated order and monitors over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import blob_sha
from ..operators import branches, cursors, ordering, search
from ..operators.snapshots import shared_dir
from ..sources import agent_events, workspace
from ..streaming import framing, timers
from .registry import query, read


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _listing(rows: DataFrame) -> DataFrame:
    """One NUL-framed listing per root from rows (root, k, value)."""
    return rows.groupBy("root").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda x: x["value"]), "\0").alias("text"))


@query("""WITH o AS (SELECT 'c' || o_custkey AS root, o_orderkey AS k, 'orders/' || o_orderkey AS path, o_orderstatus || o_orderkey AS content FROM orders),
s AS (SELECT *, CASE WHEN k % 10 = 0 THEN '?' WHEN k % 7 = 0 THEN 'M' WHEN k % 11 = 0 THEN 'R' WHEN k % 13 = 0 THEN 'D' END AS code, CASE WHEN k % 3 > 0 THEN sha1('blob ' || strlen(content) || chr(0) || content) END AS got, CASE WHEN k % 10 > 0 THEN sha1('i' || k) END AS sha FROM o)
SELECT root, path, CASE WHEN code IS NULL OR code = 'D' THEN sha ELSE coalesce(got, '') END AS sha, CASE WHEN code IS NULL THEN 'tracked' WHEN code = '?' THEN 'untracked' WHEN code = 'D' THEN 'deleted' ELSE 'modified' END AS status
FROM s WHERE NOT (code = '?' AND got IS NULL) OR code IS NULL""")
def workspace_scan(spark, d):
    """Each customer is a workspace with a listing of its index and one of its status; renamed files leave former paths that look like records."""
    k = F.col("k")
    o = read(spark, d, "orders").select(_text("c", F.col("o_custkey")).alias("root"), F.col("o_orderkey").alias("k"), _text("orders/", F.col("o_orderkey")).alias("path"), _text(F.col("o_orderstatus"), F.col("o_orderkey")).alias("content"))
    index = _listing(o.where(k % 10 > 0).select("root", "k", F.concat(F.lit("100644 "), F.sha1(_text("i", k)), F.lit(" 0\t"), "path").alias("value")))
    code = F.when(k % 10 == 0, F.concat(F.lit("?? "), "path")).when(k % 7 == 0, F.concat(F.lit(" M "), "path")).when(k % 11 == 0, F.concat(F.lit("R  "), "path", F.lit("\0CR old/"), k.cast("string"))).when(k % 13 == 0, F.concat(F.lit(" D "), "path"))
    status = _listing(o.select("root", "k", code.alias("value")).where("value is not null"))
    working = o.where(k % 3 > 0).select("root", "path", blob_sha(F.col("content")).alias("sha"))
    return workspace.scan(workspace.index_entries(workspace.framed(index, "text")), workspace.status_entries(workspace.framed(status, "text")), working)


MANIFESTS = """c AS (SELECT p_partkey AS id, 'r' || p_size % 5 AS root, 'a' || p_size || '/b' || p_partkey % 7 || '/c' || p_partkey % 3 AS folder FROM part),
s AS (SELECT s_suppkey AS s, 'r' || s_suppkey % 5 AS root, CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'a' || s_suppkey % 50 WHEN 2 THEN 'a' || s_suppkey % 50 || '/b' || s_suppkey % 7 ELSE 'a' || s_suppkey % 50 || '/b' || s_suppkey % 7 || '/c' || s_suppkey % 3 END AS folder FROM supplier),
m AS (SELECT root, folder, min(s) AS s FROM s WHERE s % 6 <> 5 GROUP BY ALL), l AS (SELECT root, folder, min(s % 3) AS lock FROM s WHERE s % 5 > 2 GROUP BY ALL)"""


@query(f"""WITH {MANIFESTS}, t AS (SELECT root, folder, m.s, CASE WHEN m.s % 9 = 0 THEN 'pnpm@8.' || m.s ELSE ['pnpm', 'yarn', 'npm'][(lock + 1)::INT] END AS manager FROM m FULL JOIN l USING (root, folder)),
a AS (SELECT id, root, up, array_to_string(string_split(folder, '/')[1:3 - up], '/') AS folder FROM c, unnest(range(0, 4)) AS u(up)),
n AS (SELECT id, arg_min(s, up) FILTER (s IS NOT NULL) AS s, arg_min(CASE WHEN folder = '' THEN 'package.json' ELSE folder || '/package.json' END, up) FILTER (s IS NOT NULL) AS path, coalesce(arg_min(manager, up) FILTER (manager IS NOT NULL), 'npm') AS manager FROM a JOIN t USING (root, folder) GROUP BY id)
SELECT id, path AS package_path, CASE WHEN s IS NOT NULL THEN manager END AS package_manager, CASE WHEN s % 2 = 0 THEN string_split(manager, '@')[1] || ' test' END AS test_command, CASE WHEN s IS NOT NULL THEN string_split(manager, '@')[1] || ' run build' END AS build_command, CAST(NULL AS VARCHAR) AS lint_command FROM c LEFT JOIN n USING (id)""")
def nearest_manifests(spark, d):
    """Each part is a command in a folder; suppliers place manifests and lock files in folders above."""
    p, s = F.col("p_partkey"), F.col("s_suppkey")
    commands = read(spark, d, "part").select(p.alias("id"), _text("r", F.col("p_size") % 5).alias("root"), _text("a", F.col("p_size"), "/b", p % 7, "/c", p % 3).alias("folder"))
    a, b = _text("a", s % 50), _text("/b", s % 7)
    rows = read(spark, d, "supplier").select(s.alias("s"), _text("r", s % 5).alias("root"), F.when(s % 4 == 0, "").when(s % 4 == 1, a).when(s % 4 == 2, F.concat(a, b)).otherwise(F.concat(a, b, _text("/c", s % 3))).alias("folder"))
    of = lambda name: F.when(F.col("folder") == "", name).otherwise(F.concat("folder", F.lit("/"), name))
    m = rows.where("s % 6 <> 5").groupBy("root", "folder").agg(F.min("s").alias("s"))
    text = F.to_json(F.struct(F.when(F.col("s") % 9 == 0, _text("pnpm@8.", F.col("s"))).alias("packageManager"), F.struct(F.when(F.col("s") % 2 == 0, "run").otherwise(" ").alias("test"), F.lit("x").alias("build")).alias("scripts")))
    locks = rows.where("s % 5 > 2").select("root", of(F.element_at(F.array(F.lit("pnpm-lock.yaml"), F.lit("yarn.lock"), F.lit("package-lock.json")), (F.col("s") % 3 + 1).cast("int"))).alias("path"))
    return workspace.receipts(commands, locks, m.select("root", of(F.lit("package.json")).alias("path"), text.alias("text")))


TREE = """o AS (SELECT o_custkey AS head, o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN o_orderkey END AS receipt FROM orders),
h AS (SELECT head, id, last_value(receipt IGNORE NULLS) OVER (PARTITION BY head ORDER BY id) AS receipt, row_number() OVER (PARTITION BY head ORDER BY id DESC) AS x FROM o), b AS (SELECT head, receipt FROM h WHERE x = 1),
sy AS (SELECT l_orderkey AS receipt, 'p' || l_partkey || CASE l_linenumber % 4 WHEN 0 THEN '.PY' WHEN 1 THEN '.mts' WHEN 2 THEN '.cjs' ELSE '' END AS path, 'S' || l_suppkey % 20 AS name, l_linenumber AS line FROM lineitem)"""


def _branch(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A customer's orders are entries of one branch, each below the one before; every ninth records its lines as a snapshot."""
    o = read(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("id"))
    entries = o.select("id", F.lag("id").over(W.partitionBy("o_custkey").orderBy("id")).alias("parent"), F.when(F.col("id") % 9 == 0, F.col("id")).alias("receipt"))
    heads = o.groupBy(F.col("o_custkey").alias("head")).agg(F.max("id").alias("id"))
    n = F.col("l_linenumber") % 4
    symbols = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("receipt"), F.concat(_text("p", F.col("l_partkey")), F.when(n == 0, ".PY").when(n == 1, ".mts").when(n == 2, ".cjs").otherwise("")).alias("path"), _text("S", F.col("l_suppkey") % 20).alias("name"), F.lit("class").alias("kind"), F.col("l_linenumber").alias("start_line"))
    return heads, entries, symbols.select("receipt", "path").distinct(), symbols


@query(f"""WITH {TREE}, f AS (SELECT receipt, path, count(*) AS symbols FROM sy GROUP BY ALL)
SELECT head, CASE WHEN b.receipt IS NULL THEN 'unavailable' ELSE 'historical' END AS status, b.receipt, path, symbols, CASE WHEN path LIKE '%.PY' THEN 'python' WHEN path LIKE '%.mts' THEN 'typescript' WHEN path LIKE '%.cjs' THEN 'javascript' WHEN path IS NOT NULL THEN 'unknown' END AS language FROM b LEFT JOIN f ON f.receipt = b.receipt""")
def facts_history(spark, d):
    heads, entries, files, symbols = _branch(spark, d)
    return branches.history(heads, entries, files, symbols)


@query(f"""WITH {TREE} SELECT head, CASE WHEN b.receipt IS NULL THEN 'unavailable' ELSE 'historical' END AS status, b.receipt, name, path, CASE WHEN path IS NOT NULL THEN 'class' END AS kind, line AS start_line
FROM b LEFT JOIN (SELECT * FROM sy WHERE name IN ('S0', 'S7')) AS s ON s.receipt = b.receipt WHERE b.receipt IS NULL OR path IS NOT NULL""")
def facts_history_symbols(spark, d):
    heads, entries, files, symbols = _branch(spark, d)
    names = read(spark, d, "supplier").where("s_suppkey % 7 = 0 and s_suppkey < 14").select(_text("s", F.col("s_suppkey")).alias("name"))
    return branches.history(heads, entries, files, symbols, names.unionByName(names.limit(1).select(F.lit("S0").alias("name"))))


LINES = ["l_shipdate", "l_orderkey", "l_linenumber", "l_quantity"]
NUMBERED = "n AS (SELECT l_shipdate, l_orderkey, l_linenumber, l_quantity, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_quantity) - 1 AS row_no FROM lineitem)"


@query(f"WITH {NUMBERED} SELECT * FROM n")
def frozen_lines(spark, d):
    return cursors.numbered(read(spark, d, "lineitem").select(*LINES), ["l_shipdate"])


@query(f"""WITH {NUMBERED}, c AS (SELECT count(*) AS total FROM n), a AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 300 = 0 THEN 'unknown' WHEN o_orderkey % 500 = 0 THEN 'unknown' WHEN o_orderkey * 7 % 90000 >= total THEN 'invalid' ELSE 'page' END AS status, o_orderkey * 7 % 90000 AS spot FROM orders, c WHERE o_orderkey % 100 = 0)
SELECT id, status, row_no, CASE WHEN status = 'page' THEN spot + 10 < total END AS more, l_shipdate, l_orderkey, l_linenumber, l_quantity FROM a CROSS JOIN c LEFT JOIN n ON status = 'page' AND row_no >= spot AND row_no < spot + 10""")
def cursor_pages(spark, d):
    """A cursor for every order whose key is divisible by 100; some are of a table that has changed since, some of no result."""
    lines = read(spark, d, "lineitem").select(*LINES)
    store = f"{shared_dir(spark)}/tracewell/cursors"
    generation, total = cursors.freeze(lines, ["l_shipdate"], store)
    last = lines.agg(F.max("l_orderkey")).first()[0]
    changed = cursors.content_digest(lines.where(F.col("l_orderkey") != last))
    k = F.col("o_orderkey")
    of = F.when(k % 300 == 0, changed).otherwise(generation)
    token = F.when(k % 500 == 0, "x").otherwise(cursors.cursor(of, "lines", k * 7 % 90000))
    asked = read(spark, d, "orders").where(k % 100 == 0).select(k.alias("id"), token.alias("cursor"))
    frozen = spark.read.parquet(f"{store}/generation={generation}")
    found = cursors.resume(asked, "lines", generation, frozen, total, 10)
    return found.select("id", "status", "row_no", F.when(F.col("status") == "page", F.col("next").isNotNull()).alias("more"), *LINES)


@query("""WITH r AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS started, (props->>'$.k')::BIGINT * 100 AS bytes FROM events), l AS (SELECT * FROM r WHERE started + 1296000000 > 1706659200000),
n AS (SELECT *, count(*) OVER w AS n, sum(bytes) OVER w AS b FROM l WINDOW w AS (PARTITION BY user_id ORDER BY started DESC, event_id DESC, bytes DESC ROWS UNBOUNDED PRECEDING)) SELECT user_id, event_id, started, bytes FROM n WHERE n <= 20 AND b <= 80000""")
def retained_results(spark, d):
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    results = read(spark, d, "events").select("user_id", "event_id", ms.alias("started"), (F.get_json_object("props", "$.k").try_cast("long") * 100).alias("bytes"))
    return cursors.retained(results, 1_706_659_200_000, ["user_id"], 1_296_000_000, 20, 80_000)


def _catalog(spark, d) -> DataFrame:
    o = read(spark, d, "orders")
    pos = F.row_number().over(W.partitionBy("o_custkey", "o_orderstatus").orderBy("o_orderkey")) - 1
    return o.select(F.col("o_custkey").alias("session"), _text("a", F.col("o_custkey") % 3).alias("activation"), F.col("o_orderstatus").alias("list"), pos.alias("pos"), F.col("o_orderkey").cast("string").alias("public"))


CATALOG = """e AS (SELECT o_custkey AS session, 'a' || o_custkey % 3 AS activation, o_orderstatus AS list, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) - 1 AS pos, o_orderkey::VARCHAR AS public FROM orders),
b AS (SELECT session, sha256(string_agg(h, ',' ORDER BY h)) AS digest, max(pos) AS last FROM (SELECT session, pos, sha256(list || chr(10) || pos || chr(10) || public) AS h FROM e) GROUP BY session),
p AS (SELECT session, list, pos, public, pos // 4 AS page, CASE WHEN (pos // 4 + 1) * 4 <= last THEN replace(translate(to_base64(encode(session || chr(10) || activation || chr(10) || digest || chr(10) || (pos // 4 + 1) * 4)), '+/', '-_'), '=', '') END AS cursor FROM e JOIN b USING (session))"""


@query(f"WITH {CATALOG} SELECT * FROM p")
def catalog_pages(spark, d):
    return cursors.catalog_pages(_catalog(spark, d), 4)


@query(f"""WITH {CATALOG}, a AS (SELECT DISTINCT session, page FROM p WHERE cursor IS NOT NULL)
SELECT a.session || '-' || a.page AS id, p.list, p.pos, p.public FROM a LEFT JOIN p ON p.session = a.session AND p.page = a.page + 1 AND a.session % 5 > 0""")
def catalog_resume(spark, d):
    """Cursors of all pages; the catalogs of every fifth session have changed since."""
    entries = _catalog(spark, d)
    asked = cursors.catalog_pages(entries, 4).where("cursor is not null").select(_text(F.col("session"), "-", F.col("page")).alias("id"), "session", "cursor").distinct()
    now = entries.withColumn("public", F.when((F.col("session") % 5 == 0) & (F.col("pos") == 0), F.concat("public", F.lit("!"))).otherwise(F.col("public")))
    return cursors.catalog_resume(asked, now, 4)


ACCENTED = "CASE WHEN p_partkey % 3 = 0 THEN translate(p_name, 'aeiou', 'áèîõü') WHEN p_partkey % 3 = 1 THEN upper(p_name) ELSE p_name END"


def _accented() -> object:
    k = F.col("p_partkey")
    return F.when(k % 3 == 0, F.translate("p_name", "aeiou", "áèîõü")).when(k % 3 == 1, F.upper("p_name")).otherwise(F.col("p_name"))


@query(f"WITH s AS (SELECT p_partkey, p_type AS kind, {ACCENTED} AS file, p_size AS start_line FROM part) SELECT p_partkey, kind, row_number() OVER (PARTITION BY kind ORDER BY file COLLATE en, start_line, p_partkey) AS place FROM s WHERE kind <> (SELECT min(p_type) FROM part)")
def collated_symbols(spark, d):
    """Symbols of all kinds but the first, by file as a reader sorts it and by line; names differ in case and accents."""
    p = read(spark, d, "part")
    s = p.select("p_partkey", F.col("p_type").alias("kind"), _accented().alias("file"), F.col("p_size").alias("start_line"))
    first = p.agg(F.min("p_type").alias("kind"))
    return ordering.collated(s.join(F.broadcast(first), "kind", "left_anti"), ["kind"], ["file"], ["start_line", "p_partkey"]).select("p_partkey", "kind", "place")


@query(f"""WITH e AS (SELECT p_partkey AS entry_index, p_type AS kind, p_brand AS file, {ACCENTED} AS name FROM part), q AS (SELECT entry_index AS query, lower(name) AS q FROM e WHERE entry_index % 100 = 0),
n AS (SELECT entry_index, kind, file, name, lower(name) AS l FROM e), t AS (SELECT *, list_distinct(CASE WHEN length(l) >= 3 THEN [substr(l, i, 3) for i in range(1, length(l) - 1)] ELSE [] END) AS g FROM n),
u AS (SELECT query, q, list_distinct(CASE WHEN length(q) >= 3 THEN [substr(q, i, 3) for i in range(1, length(q) - 1)] ELSE [q] END) AS u, [x for x in string_split_regex(q, '[^a-z0-9]+') if x <> ''] AS w FROM q),
j AS (SELECT *, len(list_intersect(g, u)) AS m FROM t, u), k AS (SELECT *, m / (len(u) + len(g) - m) AS jac FROM j),
x AS (SELECT query, kind, file, name, entry_index, floor(greatest(CASE WHEN l = q THEN 1.0 ELSE 0 END, CASE WHEN starts_with(l, q) THEN 0.75 ELSE 0 END, CASE WHEN len(w) > 0 AND len([y for y in w if contains(l, y)]) = len(w) THEN 0.6 ELSE 0 END, CASE WHEN len(g) > 0 AND jac >= 0.35 THEN 0.5 * jac ELSE 0 END)::DOUBLE * 1e4 + 0.5) / 1e4 AS score FROM k)
SELECT query, kind, entry_index, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, kind, file, name COLLATE en, entry_index) AS place FROM x WHERE score > 0 AND kind > 'F') WHERE place <= 5""")
def search_ranked(spark, d):
    """The five best entries of some kinds for each name whose key is divisible by 100; kinds are chosen before the limit."""
    e = read(spark, d, "part").select(F.col("p_partkey").alias("entry_index"), F.col("p_type").alias("kind"), F.col("p_brand").alias("file"), _accented().alias("name"))
    asked = e.where("entry_index % 100 = 0").select(F.col("entry_index").alias("query"), F.col("name").alias("text"))
    return search.lexical_ranked(e, asked, 5, F.col("kind") > "F")


def _jobs(spark, d) -> DataFrame:
    """Jobs of users, which end by their timeouts or exits, and jobs of event types, which flood."""
    e = read(spark, d, "events").select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").try_cast("long").alias("k"))
    rows = e.select("event_id", "k", F.explode(F.array(_text("u", F.col("user_id")), F.concat(F.lit("t"), "event_type"))).alias("job"))
    ms = F.sum(F.col("k") % 150).over(W.partitionBy("job").orderBy("event_id"))
    lines = rows.select("job", F.lit("line").alias("kind"), ms.alias("ms"), F.when(F.col("k") % 11 > 0, F.col("event_id").cast("string")).otherwise(" ").alias("value"))
    last = lines.groupBy("job").agg(F.max("ms").alias("ms"))
    number = F.regexp_extract("job", "([0-9]+)$", 1).try_cast("int")
    starts = last.select("job", F.lit("start").alias("kind"), F.lit(0).cast("long").alias("ms"), F.coalesce(number % 4 + 1, F.lit(1800)).cast("string").alias("value"))
    exits = last.where(number % 3 == 0).select("job", F.lit("exit").alias("kind"), (F.floor(F.col("ms") / 2)).alias("ms"), F.lit(None).cast("string").alias("value"))
    return starts.unionByName(lines).unionByName(exits)


@query(r"""WITH RECURSIVE e AS (SELECT event_id, (props->>'$.k')::BIGINT AS k, unnest(['u' || user_id, 't' || event_type]) AS job FROM events),
l AS (SELECT job, 'line' AS kind, sum(k % 150) OVER (PARTITION BY job ORDER BY event_id)::BIGINT AS ms, CASE WHEN k % 11 > 0 THEN event_id::VARCHAR ELSE ' ' END AS value FROM e),
z AS (SELECT job, max(ms) AS ms, TRY_CAST(regexp_extract(job, '([0-9]+)$', 1) AS INT) AS n FROM l GROUP BY job),
a AS (SELECT job, 'start' AS kind, 0::BIGINT AS ms, coalesce(n % 4 + 1, 1800)::VARCHAR AS value FROM z UNION ALL SELECT * FROM l UNION ALL SELECT job, 'exit', ms // 2, NULL FROM z WHERE n % 3 = 0),
m AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY ms, kind DESC, value) AS pos, count_if(kind = 'line' AND value <> ' ') OVER (PARTITION BY job ORDER BY ms, kind DESC, value ROWS UNBOUNDED PRECEDING) AS c FROM a),
f AS (SELECT m.*, m.c - coalesce((SELECT max(o.c) FROM m AS o WHERE o.job = m.job AND o.ms <= m.ms - 60000), 0) AS recent FROM m),
v AS (SELECT * FROM f UNION ALL SELECT job, 'end', 1000000000000, NULL, max(pos) + 1, 0, 0 FROM f GROUP BY job),
r AS (
  SELECT job, 0::BIGINT AS pos, NULL::BIGINT AS ends, NULL::BIGINT AS due, 0::BIGINT AS n, []::STRUCT(kind VARCHAR, reason VARCHAR, at_ms BIGINT, n BIGINT)[] AS told FROM (SELECT DISTINCT job FROM m)
  UNION ALL
  SELECT job, pos, CASE WHEN flood OR (kind = 'exit') THEN NULL ELSE ends2 END, CASE WHEN flood OR kind = 'exit' THEN NULL ELSE due2 END, CASE WHEN flood OR kind = 'exit' THEN 0 ELSE n2 END,
    list_concat(list_concat(told1, CASE WHEN (flood OR (kind = 'exit' AND ends1 IS NOT NULL)) AND due2 IS NOT NULL THEN [{'kind': 'events', 'reason': NULL, 'at_ms': ms, 'n': n2}] ELSE [] END), CASE WHEN flood THEN [{'kind': 'stopped', 'reason': 'flood', 'at_ms': ms, 'n': 0}] ELSE [] END)
  FROM (SELECT *, CASE WHEN kind = 'start' AND ends1 IS NULL THEN ms + value::BIGINT * 1000 ELSE ends1 END AS ends2, CASE WHEN hit AND due1 IS NULL THEN ms + 200 ELSE due1 END AS due2, CASE WHEN hit THEN n1 + 1 ELSE n1 END AS n2, hit AND recent > 120 AS flood
    FROM (SELECT *, kind = 'line' AND ends1 IS NOT NULL AND value <> ' ' AS hit
      FROM (SELECT job, pos, kind, ms, value, recent, CASE WHEN over THEN NULL ELSE ends END AS ends1, CASE WHEN over OR closed THEN NULL ELSE due END AS due1, CASE WHEN over OR closed THEN 0 ELSE n END AS n1,
          list_concat(list_concat(CASE WHEN closed THEN [{'kind': 'events', 'reason': NULL, 'at_ms': due, 'n': n}] ELSE [] END, CASE WHEN over AND due IS NOT NULL AND NOT closed THEN [{'kind': 'events', 'reason': NULL, 'at_ms': ends, 'n': n}] ELSE [] END), CASE WHEN over THEN [{'kind': 'stopped', 'reason': 'timeout', 'at_ms': ends, 'n': 0}] ELSE [] END) AS told1
        FROM (SELECT v.job, v.pos, v.kind, v.ms, v.value, v.recent, r.ends, r.due, r.n, coalesce(r.due <= v.ms - (v.kind = 'exit')::INT AND (r.ends IS NULL OR r.due < r.ends), false) AS closed, coalesce(r.ends <= v.ms - (v.kind = 'exit')::INT, false) AS over
          FROM r JOIN v ON v.job = r.job AND v.pos = r.pos + 1))))
), t AS (SELECT job, unnest(told) AS x FROM r)
SELECT job, x.kind AS kind, x.reason AS reason, x.at_ms AS at_ms, least(x.n, 20)::BIGINT AS lines, greatest(x.n - 20, 0)::BIGINT AS omitted FROM t""")
def monitor_notices(spark, d):
    return timers.monitors_batch(_jobs(spark, d)).withColumn("lines", F.size("lines").cast("long"))


def _raw_events(spark, d) -> DataFrame:
    """Events as lines of a protocol; a tool's id follows from its number, so that some repeat."""
    e = read(spark, d, "events").select(F.col("user_id").alias("task"), F.col("event_id").alias("pos"), "event_type", F.get_json_object("props", "$.k").try_cast("long").alias("k"))
    k = F.col("k")
    obj = lambda **c: F.to_json(F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(n) for n, v in c.items()]))
    sub = lambda **c: F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(n) for n, v in c.items()])
    call = lambda by: F.concat(F.lit("c"), (k - by).cast("string"))
    content = lambda t: sub(content=F.array(sub(type="text", text=t), sub(type="image", text="no")))
    usage = sub(role=F.when(k % 24 == 5, "user").otherwise("assistant"), usage=sub(totalTokens=k, cost=sub(total=k / 4)))
    last = F.array(sub(role="assistant", stopReason=F.when(k % 36 == 7, "error").when(k % 36 == 19, "aborted").otherwise("stop"), content=F.array(sub(type="text", text=F.concat(F.lit("r"), k)))))
    raw = (
        F.when(k % 12 == 0, obj(type="message_update", assistantMessageEvent=sub(type="text_delta", delta=F.when(k % 24 == 0, "").otherwise(F.concat(F.lit("t"), k)))))
        .when(k % 12 == 1, obj(type="message_update", assistantMessageEvent=sub(type="thinking_delta", delta=F.concat(F.lit("h"), k))))
        .when(k % 12 == 2, obj(type="tool_execution_start", toolCallId=call(0), toolName=F.col("event_type"))).when(k % 12 == 3, obj(type="tool_execution_update", toolCallId=call(1), partialResult=content(F.concat(F.lit("u"), "pos"))))
        .when(k % 12 == 4, obj(type="tool_execution_end", toolCallId=call(2), isError=k % 24 == 4, result=content(F.concat(F.lit("e"), "pos")))).when(k % 12 == 5, obj(type="message_end", message=usage)).when(k % 12 == 6, obj(type="turn_end"))
        .when(k % 12 == 7, obj(type="agent_end", messages=last)).when(k % 12 == 8, obj(type="extension_ui_request", method=F.when(k % 24 == 8, "confirm").otherwise("setStatus"), title=F.concat(F.lit("q"), k)))
        .when(k % 12 == 9, obj(type="auto_retry_start", attempt=k)).when(k % 12 == 10, obj(type="message_update", assistantMessageEvent=sub(type="error", reason=F.concat(F.lit("x"), k)))).otherwise("{")
    )
    return e.select("task", "pos", raw.alias("raw"))


AGENT_EVENTS = """r AS (SELECT user_id AS task, event_id AS pos, event_type, (props->>'$.k')::BIGINT AS k FROM events),
ev AS (SELECT task, pos, k, CASE k % 12 WHEN 0 THEN 'text' WHEN 1 THEN 'thinking' WHEN 2 THEN 'tool_start' WHEN 3 THEN 'tool_update' WHEN 4 THEN 'tool_end' WHEN 5 THEN CASE WHEN k % 24 <> 5 THEN 'usage' END WHEN 6 THEN 'turn_end' WHEN 7 THEN 'agent_end' WHEN 8 THEN CASE WHEN k % 24 = 8 THEN 'ask' END WHEN 9 THEN 'note' WHEN 10 THEN 'error' END AS kind,
CASE k % 12 WHEN 0 THEN CASE WHEN k % 24 = 0 THEN '' ELSE 't' || k END WHEN 1 THEN 'h' || k WHEN 2 THEN event_type WHEN 3 THEN 'u' || pos WHEN 4 THEN 'e' || pos WHEN 7 THEN CASE WHEN k % 36 = 31 THEN 'r' || k ELSE '' END WHEN 8 THEN 'q' || k WHEN 9 THEN 'retrying (' || k || '/?)' WHEN 10 THEN 'x' || k END AS text,
CASE WHEN k % 12 IN (2, 3, 4) THEN 'c' || k - (k % 12 - 2) END AS call, k % 24 = 4 AS err, CASE k % 36 WHEN 7 THEN 'assistant reported an error' WHEN 19 THEN 'assistant aborted' END AS bad FROM r)"""


@query(f"""WITH {AGENT_EVENTS}, v AS (SELECT *, CASE kind WHEN 'tool_start' THEN text WHEN 'agent_end' THEN coalesce(bad, 'responded') WHEN 'error' THEN 'error: ' || text WHEN 'ask' THEN 'asked: ' || text END AS label FROM ev WHERE kind IS NOT NULL),
g AS (SELECT task, count_if(kind = 'tool_start') AS tool_calls, count_if(kind = 'turn_end') AS turns, coalesce(sum(CASE WHEN kind = 'usage' THEN k END), 0)::DOUBLE AS tokens, coalesce(sum(CASE WHEN kind = 'usage' THEN k / 4.0::DOUBLE END), 0) AS cost, arg_max(kind, pos) AS last, bool_or(kind = 'ask') AS asked, arg_max(label, pos) FILTER (label IS NOT NULL) AS step, bool_or(kind = 'text') AS wrote, arg_max(struct_pack(t := text, b := bad), pos) FILTER (kind = 'agent_end') AS e FROM v GROUP BY task)
SELECT task, CASE WHEN last = 'ask' THEN 'waiting' WHEN asked OR task % 3 = 0 THEN 'running' ELSE 'starting' END AS status, coalesce(step, CASE WHEN wrote THEN 'writing' ELSE 'queued' END) AS last_step, tool_calls::BIGINT AS tool_calls, turns::BIGINT AS turns, tokens, cost, CASE WHEN e.b IS NULL THEN e.t END AS result, e.b AS error FROM g""")
def agent_records(spark, d):
    tasks = read(spark, d, "events").select(F.col("user_id").alias("task")).distinct().select("task", F.when(F.col("task") % 3 == 0, "waiting").otherwise("starting").alias("status"), F.lit("queued").alias("last_step"))
    return agent_events.task_records(tasks, agent_events.task_events(_raw_events(spark, d)))


@query(f"""WITH {AGENT_EVENTS}, m AS (SELECT * FROM ev WHERE (kind IN ('text', 'thinking') AND text <> '') OR kind IN ('tool_start', 'error', 'ask', 'note')),
b AS (SELECT *, CASE WHEN kind IN ('text', 'thinking') AND lag(kind) OVER (PARTITION BY task ORDER BY pos) = kind THEN 0 ELSE 1 END AS begins FROM m),
i AS (SELECT *, sum(begins) OVER (PARTITION BY task ORDER BY pos) - 1 AS item FROM b), j AS (SELECT *, max(item) OVER (PARTITION BY task) + 1 AS items FROM i),
g AS (SELECT task, item, min(kind) AS kind, min(pos) AS pos, min(call) AS call, min(items) AS items, string_agg(text, '' ORDER BY pos) AS text FROM j WHERE item >= items - 20 GROUP BY task, item),
f AS (SELECT task, call, min(pos) AS pos FROM m WHERE kind = 'tool_start' GROUP BY ALL),
u AS (SELECT f.task, f.call, f.pos, arg_max(ev.text, ev.pos) AS output, bool_or(ev.kind = 'tool_end') AS ended, arg_max(ev.err, ev.pos) FILTER (ev.kind = 'tool_end') AS failed FROM f JOIN ev ON ev.task = f.task AND ev.call = f.call AND ev.kind IN ('tool_update', 'tool_end') AND ev.pos > f.pos GROUP BY ALL)
SELECT g.task, item::BIGINT AS item, CASE kind WHEN 'tool_start' THEN 'tool' WHEN 'text' THEN 'text' WHEN 'thinking' THEN 'thinking' ELSE 'note' END AS kind, CASE kind WHEN 'error' THEN 'error: ' || text WHEN 'ask' THEN 'asked: ' || text WHEN 'text' THEN CASE WHEN length(text) > 8 THEN '…' || right(text, 7) ELSE text END WHEN 'thinking' THEN CASE WHEN length(text) > 8 THEN '…' || right(text, 7) ELSE text END ELSE text END AS text,
CASE WHEN kind = 'tool_start' THEN g.call END AS call_id, CASE WHEN kind = 'tool_start' THEN CASE WHEN length(output) > 4 THEN '…' || right(output, 3) ELSE coalesce(output, '') END END AS output, CASE WHEN kind = 'tool_start' THEN NOT coalesce(ended, false) END AS running, CASE WHEN kind = 'tool_start' THEN coalesce(failed, false) END AS is_error, greatest(0, items - 20)::BIGINT AS dropped
FROM g LEFT JOIN u ON u.task = g.task AND u.call = g.call AND u.pos = g.pos""")
def agent_threads(spark, d):
    """Threads of twenty items, texts of eight characters and outputs of four, so that all limits are met."""
    return agent_events.task_threads(agent_events.task_events(_raw_events(spark, d)), 20, 4, 8)


@query(r"""WITH c AS (SELECT conv_id AS job, string_agg(CASE WHEN turn % 3 = 0 THEN replace(text, ' ', chr(10)) ELSE text || chr(13) || chr(10) END, '' ORDER BY turn, role) AS x FROM conversations GROUP BY conv_id)
SELECT job, i - 1 AS line_no, CASE WHEN length(regexp_replace(l[i], '\r$', '')) > 2000 THEN '…' || right(regexp_replace(l[i], '\r$', ''), 2000) ELSE regexp_replace(l[i], '\r$', '') END AS line FROM (SELECT job, string_split(x, chr(10)) AS l FROM c), unnest(range(1, len(l) + 1)) AS u(i)""")
def framed_output(spark, d):
    """Turns as chunks of a job's output, cut where turns end."""
    c = read(spark, d, "conversations")
    seq = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role"))
    chunk = F.when(F.col("turn") % 3 == 0, F.replace("text", F.lit(" "), F.lit("\n"))).otherwise(F.concat("text", F.lit("\r\n")))
    return framing.lines_of(c.select(F.col("conv_id").alias("job"), seq.alias("seq"), chunk.alias("chunk")))
