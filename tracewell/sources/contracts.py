"""Contract files (path, content) as entities and relations, by JVM-side patterns and JSON.

entities: (id, kind, name, path); id is kind:path:name, each once.  relations:
(from_id, to_id, kind).  OpenAPI and JSON Schema are read from JSON; what does not
parse gives nothing.  Null contents give nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns of declarations, and the methods of a route.
GRAPHQL = r"(?:type|interface|union|input|enum|scalar)\s+([A-Za-z0-9_]+)"
PROTOBUF = r"(?:message)\s+([A-Za-z0-9_]+)"
TABLE = r"""(?i)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(?:[`"']?[a-zA-Z0-9_]+[`"']?\.)?[`"']?([a-zA-Z0-9_]+)[`"']?"""
REF = r'"\$ref"\s*:\s*"([^"]+)"'
METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")


def is_contract(path: Column) -> Column:
    """YAML but for lock files, *.schema.json, JSON named after OpenAPI, GraphQL, protobuf and SQL."""
    low = F.lower(path)
    lock = low.rlike(r"(^|/)(package-lock\.json|yarn\.lock|[^/]*[-.]lock\.ya?ml)$")
    return ~lock & (low.rlike(r"\.(ya?ml|graphql|gql|proto|sql)$") | low.endswith(".schema.json") | (low.endswith(".json") & low.rlike("openapi|swagger")))


def _rows(found: DataFrame, kind: str) -> DataFrame:
    return found.where("name is not null and name <> ''").select(F.concat_ws(":", F.lit(kind), "path", "name").alias("id"), F.lit(kind).alias("kind"), "name", "path").distinct()


def _all(files: DataFrame, pattern: str, kind: str) -> DataFrame:
    return _rows(files.select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)))).alias("name")), kind)


def _json(files: DataFrame) -> DataFrame:
    low = F.lower("path")
    return files.where(low.endswith(".json")).withColumn("doc", F.from_json("content", "title string, definitions map<string,string>, `$defs` map<string,string>, paths map<string,map<string,string>>, components struct<schemas:map<string,string>>"))


def routes(files: DataFrame) -> DataFrame:
    """(path, name, refs) of OpenAPI files: each method of each path, with the schemas it refers to."""
    each = _json(files).where("doc.paths is not null").select("path", F.explode("doc.paths").alias("url", "methods")).select("path", "url", F.explode("methods").alias("method", "operation"))
    return each.where(F.lower("method").isin(*METHODS)).select("path", F.concat_ws(" ", F.upper("method"), "url").alias("name"), F.array_distinct(F.regexp_extract_all("operation", F.lit(REF), F.lit(1))).alias("refs"))


def entities(files: DataFrame) -> DataFrame:
    low = F.lower("path")
    docs = _json(files)
    keys = lambda c: docs.select("path", F.explode(F.map_keys(c)).alias("name"))
    schema = docs.where(low.endswith(".schema.json"))
    sql = files.where(low.endswith(".sql"))
    parts = [
        _all(files.where(low.rlike(r"\.(graphql|gql)$")), GRAPHQL, "graphql-type"),
        _all(files.where(low.endswith(".proto")), PROTOBUF, "protobuf-message"),
        _all(sql, TABLE, "sql-table"),
        _rows(sql.where(low.contains("migration")).select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name")), "sql-migration"),
        _rows(schema.select("path", F.col("doc.title").alias("name")), "json-schema"),
        _rows(schema.select("path", F.explode(F.array_distinct(F.concat(F.coalesce(F.map_keys("doc.definitions"), F.array().cast("array<string>")), F.coalesce(F.map_keys("doc.`$defs`"), F.array().cast("array<string>"))))).alias("name")), "json-schema"),
        _rows(routes(files).select("path", "name"), "api-route"),
        _rows(keys("doc.components.schemas"), "openapi-schema"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def relations(files: DataFrame) -> DataFrame:
    """A route serves each schema of its file that it refers to."""
    refs = routes(files).select("path", "name", F.explode("refs").alias("ref")).where(F.col("ref").startswith("#/components/schemas/"))
    to = F.regexp_extract("ref", r"([^/]*)$", 1)
    return refs.select(F.concat_ws(":", F.lit("api-route"), "path", "name").alias("from_id"), F.concat_ws(":", F.lit("openapi-schema"), F.col("path"), to).alias("to_id"), F.lit("serves").alias("kind")).distinct()
