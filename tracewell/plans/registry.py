"""Queries over the driver tables, bound through small adapter views, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import history, metrics, search, snapshots, stats, work

TODAY = "2024-01-31"
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def usage(spark, sf_dir: str) -> DataFrame:
    """Events as usage: model=event_type, tokens=props.k, cost=value, session=user and day."""
    e = read(spark, sf_dir, "events")
    day = F.to_date("ts")
    return e.select(
        "event_id", "ts", "user_id", F.col("event_type").alias("model"), F.get_json_object("props", "$.k").try_cast("long").alias("tokens"), F.col("value").cast("decimal(18,9)").alias("cost"),
        day.alias("day"), F.concat_ws("/", "user_id", day).alias("session"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("second"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("ms"),
    )


USAGE = "u AS (SELECT event_id, ts, user_id, event_type AS model, (props->>'$.k')::BIGINT AS tokens, value AS cost, ts::DATE AS day, user_id || '/' || ts::DATE AS session, epoch(date_trunc('second', ts))::BIGINT AS second, epoch_ms(ts) AS ms FROM events)"


@query(f"WITH {USAGE} SELECT sum(tokens)::BIGINT AS tokens, floor(sum(cost::DECIMAL(18,9))::DOUBLE * 1e9 + 0.5) / 1e9 AS cost, count(*) AS messages, count(DISTINCT session) AS sessions, count(DISTINCT day) AS active_days FROM u")
def stats_totals(spark, d):
    return stats.totals(usage(spark, d))


@query(f"WITH {USAGE}, g AS (SELECT model, sum(tokens)::BIGINT AS tokens, floor(sum(cost::DECIMAL(18,9))::DOUBLE * 1e9 + 0.5) / 1e9 AS cost, count(*) AS messages FROM u GROUP BY model) SELECT *, floor(tokens / sum(tokens) OVER () * 1e6 + 0.5) / 1e6 AS share FROM g")
def stats_by_model(spark, d):
    return stats.by_model(usage(spark, d))


@query(f"WITH {USAGE} SELECT day, sum(tokens)::BIGINT AS tokens FROM u WHERE day >= DATE '{TODAY}' - 6 GROUP BY day")
def stats_by_day_7d(spark, d):
    return stats.by_day(stats.in_range(usage(spark, d), TODAY, 7))


@query(f"WITH {USAGE} SELECT day, sum(tokens)::BIGINT AS tokens FROM u GROUP BY day ORDER BY tokens DESC, day LIMIT 1")
def stats_top_day(spark, d):
    return stats.top_day(usage(spark, d))


@query(f"WITH {USAGE} SELECT session, max(second) - min(second) AS seconds FROM u GROUP BY session ORDER BY seconds DESC, session LIMIT 10")
def stats_longest_sessions(spark, d):
    return stats.longest_sessions(usage(spark, d))


@query(f"""WITH {USAGE}, days AS (SELECT DISTINCT user_id, day FROM u), r AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day)::INT AS run FROM days),
i AS (SELECT user_id, min(day) AS f, max(day) AS l, count(*) AS n FROM r GROUP BY user_id, run)
SELECT user_id, max(n) AS longest, max(CASE WHEN l >= DATE '{TODAY}' - 1 THEN (least(l, DATE '{TODAY}') - f) + 1 ELSE 0 END)::BIGINT AS current FROM i GROUP BY user_id""")
def stats_streaks(spark, d):
    return stats.streaks(usage(spark, d), ["user_id"], TODAY)


@query(f"WITH {USAGE}, g AS (SELECT day, sum(tokens)::BIGINT AS tokens FROM u GROUP BY day) SELECT day, tokens, least(4, greatest(1, ceil(4.0 * tokens / max(tokens) OVER ())))::BIGINT AS level FROM g")
def stats_heat(spark, d):
    return stats.heat(usage(spark, d))


KEY = r"lower(substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 120))"
IDENTITY = r"lower(trim(regexp_replace(text, '\s+', ' ', 'g')))"


@query(f"""WITH c AS (SELECT conv_id, turn, CASE WHEN conv_id % 13 > 0 THEN CASE WHEN conv_id % 3 = 0 THEN repeat('Long prompt. ', 12) || turn ELSE text END END AS text FROM conversations)
SELECT conv_id, turn FROM (SELECT conv_id, turn, {KEY} AS k, row_number() OVER (PARTITION BY {KEY} ORDER BY conv_id, turn) AS r FROM c) WHERE r = 1 AND k <> ''""")
def history_keep_first(spark, d):
    """Turns, some without a text and some of more than 120 characters that differ only at their ends."""
    text = F.when(F.col("conv_id") % 13 > 0, F.when(F.col("conv_id") % 3 == 0, F.concat(F.repeat(F.lit("Long prompt. "), 12), F.col("turn"))).otherwise(F.col("text")))
    return history.keep_first(read(spark, d, "conversations").withColumn("text", text), ["conv_id", "turn"]).select("conv_id", "turn")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'license') AND contains(lower(text), 'the')")
def history_token_filter(spark, d):
    return history.token_filter(read(spark, d, "documents"), "  THE  license ").select("doc_id")


@query(f"SELECT conv_id, turn FROM conversations WHERE {IDENTITY} NOT IN (SELECT {IDENTITY} FROM conversations WHERE conv_id % 7 = 0)")
def history_visible(spark, d):
    c = read(spark, d, "conversations")
    from ..functions.scalars import identity

    hidden = c.where("conv_id % 7 = 0").select(F.concat(F.lit("sha256:"), F.sha2(identity(F.col("text")), 256)).alias("key")).distinct()
    return history.visible(c, hidden).select("conv_id", "turn")


@query("""WITH g AS (SELECT conv_id, role, count(*) AS messages, sum(strlen(text))::BIGINT AS bytes FROM conversations GROUP BY ALL)
SELECT conv_id, role, messages, bytes, ceil(bytes / 4)::BIGINT AS tokens, greatest(0, 500 - ceil(bytes / 4))::BIGINT AS headroom, ceil(bytes / 4) > 500 AS exceeded FROM g""")
def history_context_budget(spark, d):
    return history.context_budget(read(spark, d, "conversations"), ["conv_id"], 500)


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1")
def history_last_record(spark, d):
    return history.last_record(read(spark, d, "conversations"), ["conv_id"], ["turn", "text"]).select("conv_id", "turn", "role")


@query(f"""WITH {USAGE}, s AS (SELECT user_id, event_id, CASE WHEN tokens % 10 > 0 THEN tokens % 5 END AS before, CASE WHEN tokens // 10 > 1 THEN tokens // 10 % 5 END AS after FROM u), m AS (SELECT * FROM s WHERE before IS DISTINCT FROM after),
l AS (SELECT *, row_number() OVER w AS n, lag(after) OVER w AS prev FROM m WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, arg_min(struct_pack(x := before), event_id).x AS before, arg_max(struct_pack(x := after), event_id).x AS after, count(*) AS steps, NOT bool_or(n > 1 AND prev IS DISTINCT FROM before) AS continuous FROM l GROUP BY user_id""")
def history_continuity(spark, d):
    """States with nulls; every event comes twice under one id."""
    t = F.col("tokens")
    u = usage(spark, d).select("user_id", "event_id", F.when(t % 10 > 0, t % 5).alias("before"), F.when(F.floor(t / 10) > 1, F.floor(t / 10) % 5).alias("after"))
    return history.continuity(u.unionByName(u.withColumn("event_id", F.col("event_id"))), ["user_id"], "event_id", "event_id")


def _snapshots(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus")
    at = lambda status: F.sha1(F.concat_ws("#", "k", status))
    path = F.concat(F.lit("orders:"), "k").alias("path")
    base = o.where("k % 10 <> 0").select(path, at(F.col("o_orderstatus")).alias("sha"))
    new = o.where("k % 10 <> 1").select(path, at(F.when(F.col("k") % 7 == 0, "X").otherwise(F.col("o_orderstatus"))).alias("sha"))
    return base, new


@query("""WITH b AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 10 <> 0), c AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 10 <> 1)
SELECT 'orders:' || coalesce(b.k, c.k) AS path, CASE WHEN b.k IS NULL THEN 'added' WHEN c.k IS NULL THEN 'deleted' WHEN b.s <> c.s THEN 'modified' ELSE 'untouched' END AS change FROM b FULL JOIN c USING (k)""")
def snapshot_delta(spark, d):
    return snapshots.delta(*_snapshots(spark, d))


@query("""SELECT 'customer:' || c_custkey AS path, coalesce(n, 0)::BIGINT AS added, coalesce(m, 0)::BIGINT AS deleted FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderkey % 100, o_orderkey) AS n, arg_max(o_orderkey % 7, o_orderkey) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def snapshot_overlay(spark, d):
    """Every order is a line of counts for its customer; the last holds."""
    status = read(spark, d, "customer").select(F.concat(F.lit("customer:"), "c_custkey").alias("path"))
    k = F.col("o_orderkey")
    return snapshots.overlay(status, read(spark, d, "orders").select(F.concat(F.lit("customer:"), "o_custkey").alias("path"), k.alias("pos"), (k % 100).alias("added"), (k % 7).alias("deleted")))


def lineage(spark, d) -> DataFrame:
    """Foreign keys as edges importer -> target; edge_index is the importer's key."""
    edge = lambda t, a, ak, b, bk: read(spark, d, t).select(F.col(ak).cast("long").alias("edge_index"), F.concat(F.lit(f"{a}:"), ak).alias("importer"), F.concat(F.lit(f"{b}:"), bk).alias("target"))
    out = edge("orders", "orders", "o_orderkey", "customer", "o_custkey")
    for e in (("customer", "customer", "c_custkey", "nation", "c_nationkey"), ("supplier", "supplier", "s_suppkey", "nation", "s_nationkey"), ("nation", "nation", "n_nationkey", "region", "n_regionkey")):
        out = out.unionByName(edge(*e))
    return out


@query("""WITH RECURSIVE e AS (SELECT 'orders:' || o_orderkey AS importer, 'customer:' || o_custkey AS target FROM orders UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation),
r AS (SELECT importer, target AS via, 1 AS depth FROM e WHERE target = 'region:1' UNION ALL SELECT e.importer, e.target, r.depth + 1 FROM r JOIN e ON e.target = r.importer WHERE r.depth < 10)
SELECT importer, depth::BIGINT AS depth, via FROM r""")
def graph_dependents(spark, d):
    return snapshots.dependents(lineage(spark, d), spark.createDataFrame([("region:1",)], "path string"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 'lineitem:' || l_orderkey || '-' || l_linenumber AS importer, 'orders:' || l_orderkey AS target FROM lineitem UNION ALL SELECT 'orders:' || o_orderkey, 'customer:' || o_custkey FROM orders
UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation),
r AS (SELECT importer, target AS via, 1 AS depth FROM e WHERE target = 'region:1' UNION ALL SELECT e.importer, e.target, r.depth + 1 FROM r JOIN e ON e.target = r.importer)
SELECT importer, depth::BIGINT AS depth, via FROM r""")
def graph_dependents_lines(spark, d):
    """The graph with its largest table; lines that repeat an order and a number are one importer."""
    line = F.concat_ws("-", "l_orderkey", "l_linenumber")
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").cast("long").alias("edge_index"), F.concat(F.lit("lineitem:"), line).alias("importer"), F.concat(F.lit("orders:"), "l_orderkey").alias("target"))
    return snapshots.dependents(lineage(spark, d).unionByName(lines), spark.createDataFrame([("region:1",)], "path string"))


@query("""WITH e AS (SELECT p_partkey AS entry_index, p_type AS kind, p_name AS name, lower(p_name) AS l FROM part), q AS (SELECT 'blue rod' AS q), g AS (SELECT *, list_distinct(CASE WHEN length(l) >= 3 THEN [substr(l, i, 3) for i in range(1, length(l) - 1)] ELSE [] END) AS t FROM e),
s AS (SELECT *, len(list_intersect(t, ['blu', 'lue', 'ue ', 'e r', ' ro', 'rod'])) AS n FROM g), j AS (SELECT *, n / (6 + len(t) - n) AS j FROM s),
x AS (SELECT entry_index, kind, name, greatest(CASE WHEN l = 'blue rod' THEN 1.0 ELSE 0 END, CASE WHEN starts_with(l, 'blue rod') THEN 0.75 ELSE 0 END, CASE WHEN (contains(l, 'blue') AND contains(l, 'rod')) THEN 0.6 ELSE 0 END, CASE WHEN j >= 0.35 THEN 0.5 * j ELSE 0 END)::DOUBLE AS score FROM j)
SELECT entry_index, kind, name, floor(score * 1e4 + 0.5) / 1e4 AS score FROM x WHERE score > 0""")
def search_lexical(spark, d):
    return search.lexical(read(spark, d, "part").select(F.col("p_partkey").alias("entry_index"), F.col("p_type").alias("kind"), F.col("p_name").alias("name")), "Blue rod")


STATE = "CASE WHEN tokens % 10 = 0 THEN 'unavailable' WHEN tokens % 10 = 1 THEN 'unsupported' ELSE 'reported' END"


@query(f"WITH {USAGE}, s AS (SELECT *, {STATE} AS state FROM u) SELECT model, user_id % 4 AS class, count(*) AS responses, count_if(state = 'reported')::BIGINT AS reported, count_if(state = 'unavailable')::BIGINT AS unavailable, count_if(state = 'unsupported')::BIGINT AS unsupported, sum(CASE WHEN state = 'reported' THEN tokens ELSE 0 END)::BIGINT AS total FROM s GROUP BY ALL")
def metrics_rollup(spark, d):
    u = usage(spark, d).withColumn("class", F.col("user_id") % 4).withColumn("state", F.expr(STATE))
    return metrics.rollup(u.unionByName(u.where("event_id % 5 = 0").withColumn("ms", F.col("ms") + 1)), ["model", "class"], "tokens", "state", "ms", "event_id")


@query("""WITH l AS (SELECT p_name, regexp_extract(lower(p_name), '^[a-z]+') AS family, sum(p_size) AS used, sum(p_retailprice) AS budget FROM part GROUP BY 1, 2)
SELECT family, count(*) AS members, floor(sum(used) / sum(budget) * 100 * 1e4 + 0.5) / 1e4 AS percent FROM l GROUP BY family""")
def allowance_by_family(spark, d):
    limits = read(spark, d, "part").groupBy("p_name").agg(F.sum("p_size").alias("used"), F.sum("p_retailprice").alias("budget"))
    return metrics.allowance(limits.withColumn("family", F.regexp_extract(F.lower("p_name"), "^[a-z]+", 0)))


@query("""WITH s AS (SELECT l_returnflag, list_sort(list(l_quantity)) AS v, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_returnflag, v[1] AS least, v[ceil(n * 0.5)::INT] AS p50, v[ceil(n * 0.95)::INT] AS p95, v[ceil(n * 0.99)::INT] AS p99, v[n] AS most, v[(n // 2 + 1)::INT] AS upper_median FROM s""")
def metrics_percentiles(spark, d):
    return metrics.nearest_rank(read(spark, d, "lineitem"), ["l_returnflag"], "l_quantity")


@query(f"WITH {USAGE}, c AS (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ms RANGE BETWEEN 86399999 PRECEDING AND CURRENT ROW) AS recent FROM u) SELECT * FROM c WHERE recent > 5")
def monitor_flood(spark, d):
    return metrics.flood(usage(spark, d), "user_id", "ms", 86_400_000, 5).select("user_id", "event_id", "recent")


@query(f"WITH {USAGE}, h AS (SELECT user_id, event_id, tokens >= 90 AS high, lag(tokens >= 90) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS before FROM u) SELECT user_id, event_id FROM h WHERE high AND NOT coalesce(before, false)")
def monitor_latch(spark, d):
    return metrics.latch(usage(spark, d), "user_id", ["ms", "event_id"], "tokens", 90).select("user_id", "event_id")


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def proofs_latest(spark, d):
    return metrics.latest(read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT 'region ' || n_regionkey AS model, count(*) AS n, string_agg(n_name, ',' ORDER BY n_name) AS members FROM nation GROUP BY n_regionkey")
def routing_summary(spark, d):
    return metrics.routing(read(spark, d, "nation").select(F.concat(F.lit("region "), "n_regionkey").alias("model"), F.col("n_name").alias("member")))


@query("""WITH n AS (SELECT p_partkey AS node, p_brand AS area, p_type AS topic, string_split(p_name, ' ') AS tags FROM part), s AS (SELECT * FROM n WHERE node = 1),
r AS (SELECT n.node, concat_ws(',', CASE WHEN n.area = s.area THEN 'area' END, CASE WHEN len(list_intersect(n.tags, s.tags)) > 0 THEN 'tag' END, CASE WHEN n.area = s.area AND n.topic = s.topic THEN 'topic' END) AS reasons FROM n, s WHERE n.node <> 1)
SELECT node, reasons FROM r WHERE reasons <> ''""")
def work_related(spark, d):
    return work.related(read(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("area"), F.col("p_type").alias("topic"), F.split("p_name", " ").alias("tags")), 1)


@query("SELECT p_partkey, p_name AS name, p_brand AS file, p_type AS kind FROM part WHERE lower(p_name) = 'blue rod'")
def symbol_lookup(spark, d):
    return work.symbols(read(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("file"), F.col("p_type").alias("kind")), name="Blue ROD")


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_orderkey LIMIT 50 OFFSET 100")
def page_of_orders(spark, d):
    return work.page(read(spark, d, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority", "o_orderkey"], 100, 60)


@query("SELECT event_type, count(*) AS n, floor(sum(value) * 1e4 + 0.5) / 1e4 AS total, max(value) AS most FROM events GROUP BY 1")
def phase_metrics(spark, d):
    return work.phases(read(spark, d, "events"), "event_type", "value")


@query("""WITH p AS (SELECT p_partkey AS id, CASE WHEN p_size % 11 > 0 THEN CASE WHEN p_size > 5 THEN p_size ELSE 0 END END::DOUBLE AS i, CASE WHEN p_size % 11 > 0 THEN p_retailprice END::DOUBLE AS o, CASE WHEN p_size % 13 > 0 THEN 10 ELSE 0 END::DOUBLE AS b FROM part),
r AS (SELECT *, CASE WHEN i IS NULL THEN 'no catalog price for ' || id WHEN i = 0 THEN 'zero or invalid price for ' || id WHEN b = 0 THEN 'zero or invalid price for base' END AS reason FROM p)
SELECT id, CASE WHEN reason IS NULL THEN floor(i / b * 1e6 + 0.5) / 1e6 END AS input, CASE WHEN reason IS NULL THEN floor(o / 900.0::DOUBLE * 1e6 + 0.5) / 1e6 END AS output, CASE WHEN reason IS NULL THEN greatest(floor(i / b * 1e6 + 0.5) / 1e6, floor(o / 900.0::DOUBLE * 1e6 + 0.5) / 1e6) END AS blended, reason FROM r""")
def price_ratios(spark, d):
    """Some models have no price, some one of zero, and so has the base at times."""
    size = F.col("p_size")
    priced = lambda c: F.when(size % 11 > 0, c)
    return work.price_ratio(read(spark, d, "part").select(F.col("p_partkey").alias("id"), priced(F.when(size > 5, size).otherwise(0).cast("double")).alias("input"), priced(F.col("p_retailprice")).alias("output"), F.lit("base").alias("base_id"), F.when(size % 13 > 0, 10.0).otherwise(0.0).alias("base_input"), F.lit(900.0).alias("base_output")))


@query("""WITH m AS (SELECT conv_id % 7 AS ctx, conv_id, turn, role, strlen(json_object('conv_id', conv_id, 'turn', turn, 'role', r, 'text', text)) AS n, r FROM (SELECT *, CASE turn % 5 WHEN 3 THEN 'system' WHEN 4 THEN 'toolResult' WHEN 2 THEN 'note' ELSE role END AS r FROM conversations)),
g AS (SELECT ctx, count_if(r = 'system')::BIGINT AS system_messages, coalesce(sum(n) FILTER (r = 'system'), 0)::BIGINT AS system_bytes, count_if(r = 'user')::BIGINT AS user_messages, coalesce(sum(n) FILTER (r = 'user'), 0)::BIGINT AS user_bytes, count_if(r = 'assistant')::BIGINT AS assistant_messages, coalesce(sum(n) FILTER (r = 'assistant'), 0)::BIGINT AS assistant_bytes,
count_if(r = 'toolResult')::BIGINT AS tool_results_messages, coalesce(sum(n) FILTER (r = 'toolResult'), 0)::BIGINT AS tool_results_bytes, count_if(r = 'note')::BIGINT AS other_messages, coalesce(sum(n) FILTER (r = 'note'), 0)::BIGINT AS other_bytes, (sum(n) + count(*) + 14)::BIGINT AS bytes FROM m GROUP BY ctx), t AS (SELECT *, ceil(bytes / 4)::BIGINT AS tokens FROM g)
SELECT *, greatest(0, 13000 - tokens) AS headroom, greatest(0, tokens - 11500) AS excess, CASE WHEN tokens <= 11500 THEN 'within_target' WHEN tokens <= 13000 THEN 'above_target' ELSE 'overflow' END AS status FROM t""")
def context_statuses(spark, d):
    """Seven contexts of all conversations, with limits that some of them pass."""
    turn = F.col("turn") % 5
    role = F.when(turn == 3, "system").when(turn == 4, "toolResult").when(turn == 2, "note").otherwise(F.col("role"))
    rows = read(spark, d, "conversations").select((F.col("conv_id") % 7).alias("ctx"), "conv_id", "turn", role.alias("role"), "text")
    return history.context_status(rows, ["ctx"], 15_000, 2_000, 11_500)


@query("SELECT conv_id, turn, running FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM conversations) WHERE running <= 500")
def budgeted_turns(spark, d):
    return work.char_budget(read(spark, d, "conversations").withColumn("size", F.length("text")), ["conv_id"], ["turn", "text"], "size", 500).select("conv_id", "turn", "running")


@query("""WITH n AS (SELECT p_partkey AS node, p_brand AS area, p_type AS topic, string_split(p_name, ' ') AS tags, p_size AS ref FROM part),
r AS (SELECT s.node AS source, n.node, concat_ws(',', CASE WHEN n.area = s.area THEN 'area' END, CASE WHEN n.ref = s.ref THEN 'ref' END, CASE WHEN len(list_intersect(n.tags, s.tags)) > 0 THEN 'tag' END, CASE WHEN n.area = s.area AND n.topic = s.topic THEN 'topic' END) AS reasons FROM n, n AS s WHERE s.node % 100 = 0 AND n.node <> s.node)
SELECT source, node, reasons FROM r WHERE reasons <> ''""")
def work_related_all(spark, d):
    """Every part whose key is divisible by 100 against all parts; the size is a declared reference."""
    ref = F.struct(F.lit("size").alias("kind"), F.lit("part").alias("repository"), F.col("p_size").cast("string").alias("id"))
    nodes = read(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("area"), F.col("p_type").alias("topic"), F.split("p_name", " ").alias("tags"), F.when(F.col("p_size").isNotNull(), F.array(ref)).alias("refs"))
    return work.related_all(nodes, nodes.where("node % 100 = 0"))


@query("""WITH e AS (SELECT p_partkey AS entry_index, 'part' AS kind, p_name AS name FROM part UNION ALL SELECT s_suppkey, 'supplier', s_name FROM supplier UNION ALL SELECT item_id, 'benchmark', text FROM benchmark),
n AS (SELECT DISTINCT name, lower(name) AS l FROM e WHERE name IS NOT NULL), g AS (SELECT *, list_distinct(CASE WHEN length(l) >= 3 THEN [substr(l, i, 3) for i in range(1, length(l) - 1)] ELSE [] END) AS t FROM n),
d AS (SELECT DISTINCT lower(name) AS q FROM e WHERE entry_index % 100 = 0 AND name IS NOT NULL), w AS (SELECT q, list_distinct(CASE WHEN length(q) >= 3 THEN [substr(q, i, 3) for i in range(1, length(q) - 1)] ELSE [q] END) AS u, [x for x in string_split_regex(q, '[^a-z0-9]+') if x <> ''] AS words FROM d),
s AS (SELECT *, len(list_intersect(t, u)) AS m FROM g, w), j AS (SELECT *, m / (len(u) + len(t) - m) AS j FROM s),
x AS (SELECT q, name, greatest(CASE WHEN l = q THEN 1.0 ELSE 0 END, CASE WHEN starts_with(l, q) THEN 0.75 ELSE 0 END, CASE WHEN len(words) > 0 AND len([y for y in words if contains(l, y)]) = len(words) THEN 0.6 ELSE 0 END, CASE WHEN len(t) > 0 AND j >= 0.35 THEN 0.5 * j ELSE 0 END)::DOUBLE AS score FROM j)
SELECT a.kind || ':' || a.entry_index AS query, e.kind, e.entry_index, floor(score * 1e4 + 0.5) / 1e4 AS score FROM e AS a JOIN x ON lower(a.name) = q JOIN e ON e.name = x.name WHERE a.entry_index % 100 = 0 AND score > 0""")
def search_lexical_all(spark, d):
    """Every part, supplier and benchmark item whose id is divisible by 100 against all of them, by their whole names and texts."""
    entry = lambda t, key, kind, name: read(spark, d, t).select(F.col(key).cast("long").alias("entry_index"), F.lit(kind).alias("kind"), F.col(name).alias("name"))
    entries = entry("part", "p_partkey", "part", "p_name").unionByName(entry("supplier", "s_suppkey", "supplier", "s_name")).unionByName(entry("benchmark", "item_id", "benchmark", "text"))
    return search.lexical_all(entries, entries.where("entry_index % 100 = 0").select(F.concat_ws(":", "kind", "entry_index").alias("query"), F.col("name").alias("text")))


@query("SELECT q.p_partkey AS query, e.p_partkey, e.p_name AS name, e.p_brand AS file, e.p_type AS kind FROM part AS q JOIN part AS e ON lower(e.p_name) = lower(q.p_name) WHERE q.p_partkey % 100 = 0")
def symbol_lookup_all(spark, d):
    """The upper-cased name of every part whose key is divisible by 100 against all parts."""
    entries = read(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("file"), F.col("p_type").alias("kind"))
    nothing = F.lit(None).cast("string")
    return work.symbols_all(entries, entries.where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query"), F.upper("name").alias("name"), nothing.alias("file"), nothing.alias("kind")))
