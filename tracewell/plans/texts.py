"""Queries of string functions, text sources, scopes and coalescing over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import strings
from ..operators import history, surfaces
from ..sources import contracts, texts
from ..streaming import coalesce
from .more import E, ev
from .registry import query, read

HALF = "floor({} + 0.5)::BIGINT"


@query(f"""WITH o AS (SELECT o_orderkey, o_orderkey * (o_orderkey % 97) * (o_orderkey % 13) AS n FROM orders UNION ALL SELECT -o_orderkey, 1000 + o_orderkey % 180 * 50 FROM orders)
SELECT o_orderkey, CASE WHEN n < 1000 THEN n::VARCHAR WHEN n < 10000 THEN CASE WHEN n % 500 = 250 THEN format('{{:.1f}}', (n + 50) / 1000.0::DOUBLE) ELSE format('{{:.1f}}', n / 1000.0::DOUBLE) END || 'k' WHEN n < 1000000 THEN {HALF.format('n / 1000')} || 'k'
WHEN n < 10000000 THEN CASE WHEN n % 500000 = 250000 THEN format('{{:.1f}}', (n + 50000) / 1000000.0::DOUBLE) ELSE format('{{:.1f}}', n / 1000000.0::DOUBLE) END || 'M' ELSE {HALF.format('n / 1000000')} || 'M' END AS tokens FROM o""")
def format_tokens(spark, d):
    """All magnitudes, and every half of a tenth of a thousand."""
    k = F.col("o_orderkey")
    n = k * (k % 97) * (k % 13)
    o = read(spark, d, "orders").select(k, n.alias("n"))
    return o.unionByName(o.select((-k).alias("o_orderkey"), (1000 + k % 180 * 50).alias("n"))).select("o_orderkey", strings.tokens_text(F.col("n")).alias("tokens"))


@query("""WITH o AS (SELECT o_orderkey, o_orderkey * (o_orderkey % 101) * 37 - 5000 AS ms FROM orders), a AS (SELECT *, greatest(ms, 0) AS x, greatest(ms // 1000, 0) AS s FROM o)
SELECT o_orderkey, CASE WHEN x < 1000 THEN x || 'ms' WHEN x < 60000 THEN x // 1000 || 's' WHEN x < 3600000 THEN x // 60000 || 'm' WHEN x < 86400000 THEN x // 3600000 || 'h' ELSE x // 86400000 || 'd' END AS age,
CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm' || lpad((s % 60)::VARCHAR, 2, '0') || 's' ELSE s // 3600 || 'h' || lpad((s // 60 % 60)::VARCHAR, 2, '0') || 'm' END AS elapsed FROM a""")
def ages(spark, d):
    k = F.col("o_orderkey")
    ms = k * (k % 101) * 37 - 5000
    return read(spark, d, "orders").select(k, strings.age_text(ms).alias("age"), strings.elapsed_text(ms).alias("elapsed"))


@query("SELECT o_orderkey, CASE WHEN s = 604800 THEN 'week' WHEN s >= 86400 AND s % 86400 = 0 THEN s // 86400 || 'd' WHEN s >= 3600 AND s % 3600 = 0 THEN s // 3600 || 'h' ELSE floor(s / 60 + 0.5)::BIGINT || 'm' END AS label FROM (SELECT o_orderkey, (o_orderkey % 200) * 3600 + (o_orderkey % 3) * 1800 AS s FROM orders)")
def window_labels(spark, d):
    k = F.col("o_orderkey")
    return read(spark, d, "orders").select(k, strings.window_label((k % 200) * 3600 + (k % 3) * 1800).alias("label"))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS p FROM pages)
SELECT page_id, regexp_extract(p, '([^/]*)$', 1) AS name, CASE WHEN contains(p, '/') THEN regexp_replace(p, '/[^/]*$', '') ELSE '.' END AS dir, lower(regexp_extract(regexp_extract(p, '([^/]*)$', 1), '^.+(\.[^.]*)$', 1)) AS ext, array_to_string([x for x in regexp_split_to_array(lower(p), '[/._-]+') if x <> ''], ' ') AS tokens FROM p""")
def path_parts(spark, d):
    p = F.regexp_replace("url", "^[a-z]+://", "")
    return read(spark, d, "pages").select("page_id", strings.basename(p).alias("name"), strings.dirname(p).alias("dir"), strings.extension(p).alias("ext"), F.array_join(strings.path_tokens(p), " ").alias("tokens"))


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_brand END AS b, p_name || CASE WHEN p_size % 3 = 0 THEN '/' || replace(p_name, ' ', '-') ELSE '' END AS m FROM part), q AS (SELECT *, lower(list_extract(string_split(m, '/'), -1)) AS l FROM p), r AS (SELECT *, regexp_full_match(l, '[a-z0-9][a-z0-9._:-]*') AS pub, regexp_full_match(lower(b), '[a-z0-9][a-z0-9._:-]*') AS ok FROM q)
SELECT p_partkey, CASE WHEN b IS NULL THEN 'unknown' WHEN pub AND ok THEN lower(b) ELSE 'custom' END AS provider, CASE WHEN b IS NULL THEN 'unknown' WHEN pub THEN l ELSE 'custom' END AS id FROM r""")
def model_names(spark, d):
    size = F.col("p_size")
    name = F.concat("p_name", F.when(size % 3 == 0, F.concat(F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-")))).otherwise(""))
    m = strings.model(F.when(size % 7 > 0, F.col("p_brand")), name)
    return read(spark, d, "part").select("p_partkey", m["provider"].alias("provider"), m["id"].alias("id"))


@query(f"WITH {E} SELECT user_id, 'src/new/' || event_type || '.ts' AS path, count(*) AS n, sum(k)::BIGINT AS added, sum(CASE WHEN k % 5 > 0 THEN k % 7 ELSE 0 END)::BIGINT AS deleted FROM e GROUP BY ALL")
def numstat_rows(spark, d):
    k = F.col("k")
    line = F.concat_ws("\t", k.cast("string"), F.when(k % 5 > 0, (k % 7).cast("string")).otherwise("-"), F.concat(F.lit("src/{old => new}/"), "event_type", F.lit(".ts")))
    each = ev(spark, d).groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    return texts.numstat(each).groupBy("user_id", "path").agg(F.count("*").alias("n"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))


@query(f"WITH {E}, r AS (SELECT user_id, 'f' || k AS path, CASE k % 5 WHEN 0 THEN 'renamed' WHEN 1 THEN 'modified' WHEN 2 THEN 'untracked' WHEN 3 THEN 'added' ELSE 'deleted' END AS status FROM e) SELECT DISTINCT * FROM r")
def porcelain_rows(spark, d):
    k = F.col("k")
    code = F.when(k % 5 == 0, "R ").when(k % 5 == 1, " M").when(k % 5 == 2, "??").when(k % 5 == 3, "A ").otherwise(" D")
    line = F.concat(code, F.lit(" f"), k, F.when(k % 5 == 0, F.concat(F.lit("\0"), F.lit("R  old"))).otherwise(""))
    each = ev(spark, d).groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))), lambda x: x["line"]), "\0").alias("text"))
    return texts.porcelain(each)


@query("""SELECT 'sql-table:db/' || p_size || '.sql:t' || p_partkey AS id, 'sql-table' AS kind, 't' || p_partkey AS name, 'db/' || p_size || '.sql' AS path FROM part UNION ALL SELECT 'graphql-type:g/' || p_partkey || '.gql:T' || p_size, 'graphql-type', 'T' || p_size, 'g/' || p_partkey || '.gql' FROM part""")
def contract_entities(spark, d):
    p = read(spark, d, "part")
    sql = p.groupBy(F.concat(F.lit("db/"), "p_size", F.lit(".sql")).alias("path")).agg(F.array_join(F.collect_list(F.concat(F.lit("create table if not exists \"app\".t"), "p_partkey", F.lit(" (x int);"))), "\n").alias("content"))
    gql = p.select(F.concat(F.lit("g/"), "p_partkey", F.lit(".gql")).alias("path"), F.concat(F.lit("type T"), "p_size", F.lit(" { x: Int }")).alias("content"))
    return contracts.entities(sql.unionByName(gql))


@query("""WITH s AS (SELECT p_partkey AS id, p_size, CASE WHEN p_size % 49 = 0 THEN '*/x' ELSE replace('src/' || lower(p_brand) || CASE p_size % 5 WHEN 0 THEN '/**' WHEN 1 THEN '/' || substr(p_type, 1, 3) || '*.ts' ELSE '/' || p_type || '.ts' END, '#', '-') END AS scope FROM part),
p AS (SELECT id, scope, string_split(lower(scope), '/') AS x FROM s), q AS (SELECT a.id, a.scope, b.id AS other_id, b.scope AS other, a.x, b.x AS y, least(coalesce(nullif(list_position(a.x, '**'), 0) - 1, len(a.x)), coalesce(nullif(list_position(b.x, '**'), 0) - 1, len(b.x))) AS n FROM p AS a, p AS b WHERE a.id % 100 = 0)
SELECT id, scope, other_id, other FROM q WHERE len(list_filter(range(1, n + 1), lambda i: NOT CASE WHEN NOT contains(x[i], '*') AND NOT contains(y[i], '*') THEN x[i] = y[i]
  WHEN contains(x[i], '*') AND contains(y[i], '*') THEN (starts_with(string_split(x[i], '*')[1], string_split(y[i], '*')[1]) OR starts_with(string_split(y[i], '*')[1], string_split(x[i], '*')[1])) AND (ends_with(string_split(x[i], '*')[-1], string_split(y[i], '*')[-1]) OR ends_with(string_split(y[i], '*')[-1], string_split(x[i], '*')[-1]))
  WHEN contains(x[i], '*') THEN regexp_full_match(y[i], replace(replace(x[i], '.', '[.]'), '*', '.*')) ELSE regexp_full_match(x[i], replace(replace(y[i], '.', '[.]'), '*', '.*')) END)) = 0""")
def scope_overlap(spark, d):
    """Every scope with an id divisible by 100 against all; tests hold it against all pairs."""
    size = F.col("p_size")
    scope = F.concat(F.lit("src/"), F.lower("p_brand"), F.when(size % 5 == 0, "/**").when(size % 5 == 1, F.concat(F.lit("/"), F.substring("p_type", 1, 3), F.lit("*.ts"))).otherwise(F.concat(F.lit("/"), "p_type", F.lit(".ts"))))
    scopes = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(size % 49 == 0, "*/x").otherwise(F.replace(scope, F.lit("#"), F.lit("-"))).alias("scope"))
    return surfaces.overlapping(scopes.where("id % 100 = 0"), scopes)


@query()
def notifications(spark, d):
    """Events of a user as occurrences, hours as if they were tenths of a second; no SQL: tests hold it against written cases."""
    at = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 36)
    return coalesce.coalesced_batch(ev(spark, d).select(F.col("user_id").cast("string").alias("session"), at.alias("now_ms"), F.col("event_id").cast("string").alias("key"), (F.col("k") % 4).cast("int").alias("priority"), (at - F.col("k") * 30).alias("occurred_ms")))


@query("SELECT 'c' || conv_id AS file, turn + 1 AS line_no, trim(text) AS text, 1704067200000 + conv_id AS ts FROM conversations WHERE role = 'user' AND trim(text) <> '' AND length(text) <= 16384 AND conv_id % 7 > 0")
def session_prompts(spark, d):
    """Conversations as session logs; every seventh has a header of a version that is not read."""
    c, conv = read(spark, d, "conversations"), F.col("conv_id")
    file = F.concat(F.lit("c"), conv).alias("file")
    head = F.to_json(F.struct(F.lit("session").alias("type"), F.when(conv % 7 > 0, 3).otherwise(4).alias("version"), (F.lit(1_704_067_200_000) + conv).alias("timestamp")))
    said = F.to_json(F.struct(F.lit("message").alias("type"), F.struct("role", F.col("text").alias("content")).alias("message")))
    rows = c.select(file, (F.col("turn") + 1).alias("line_no"), said.alias("raw")).unionByName(c.select(file, F.lit(0).cast("long").alias("line_no"), head.alias("raw")).distinct())
    return history.prompts(rows.withColumn("mtime", F.lit(7).cast("long")))
