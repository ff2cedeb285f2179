"""Facts about a repository: files, symbols, import edges, entities and relations between them.

Tables, by column names:
    files      path, sha
    symbols    path, name, kind, signature, start_line, is_exported
    edges      edge_index, importer, specifier, target, evidence, reason (target null where unresolved)
    entities   id, kind, name, path
    relations  from_id, to_id, kind
    references path, name
Null paths and names match nothing; columns other than those named are left alone.
"""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.strings import extension
from .snapshots import MERGE_LEVELS, _cut, delta

LOCAL = ("typescript", "filesystem")
MEMBER = r"^\s*(?:(?:static|async)\s+)*([A-Za-z_$][A-Za-z0-9_$]*)"
#: Display names by file extension.
LANGUAGES = {".mjs": "javascript", ".js": "javascript", ".cjs": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript", ".py": "python", ".go": "go"}
#: What a tier does not count, and which importers are tests.
ASIDE = r"^(tests|docs)/|\.md$"
TEST_FILE = r"(^|/)(tests?|__tests__)/|\.(test|spec)\.[cm]?[jt]sx?$"


def category(specifier: Column) -> Column:
    """Why a specifier may be unresolved: builtin, relative or external; empty and null count as external."""
    return F.when(specifier.startswith("node:"), "builtin").when(specifier.startswith(".") | specifier.startswith("/"), "relative").otherwise("external")


def language(path: Column) -> Column:
    """Display language by extension, in any case; "unknown" where it has none that is listed."""
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, extension(path)), F.lit("unknown"))


def local_edges(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges that resolve inside the index: both ends indexed, evidence of the compiler or the file system.

    Paths are dealt once, over a given number of partitions, and met by joins that can
    spill.  A semi-join would go below a union of edges, and few edges of one kind would
    gather all paths in few tasks.
    """
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = files.select("path").repartition(n, "path").distinct()
    here = edges.where(F.col("evidence").isin(*LOCAL))
    for end in ("importer", "target"):
        here = here.repartition(n, end).join(known.withColumnRenamed("path", end), end).select(edges.columns)
    return here


def entity_edges(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """importer, target, kind, from_id, to_id of relations whose two entities exist, mapped to the entities' files."""
    of = lambda end: entities.select(F.col("id").alias(f"{end}_id"), F.col("path").alias(f"{end}_path")).dropDuplicates([f"{end}_id"])
    both = relations.join(of("from"), "from_id").join(of("to"), "to_id")
    return both.select(F.col("from_path").alias("importer"), F.col("to_path").alias("target"), "kind", "from_id", "to_id")


def reverse_adjacency(files: DataFrame, edges: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Distinct (importer, target) over local import edges and relations between entities of different files.

    Relations are made distinct after each end is mapped to its file, so that an id that
    very many name comes to the next join once for each file.
    """
    of = lambda end, path: entities.select(F.col("id").alias(end), F.col("path").alias(path)).dropDuplicates([end]).where(F.col(path).isNotNull())
    one = relations.select("from_id", "to_id").join(of("from_id", "importer"), "from_id").select("importer", "to_id").distinct()
    two = one.join(of("to_id", "target"), "to_id").where("importer <> target").select("importer", "target")
    return local_edges(edges.select("importer", "target", "evidence"), files).select("importer", "target").unionByName(two).distinct()


def coverage(files: DataFrame, edges: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """One row: files, resolved (local edges and whole relations) and unresolved edges."""
    counts = [files.select("path").distinct().agg(F.count("*").alias("files")), local_edges(edges, files).agg(F.count("*").alias("own")), edges.agg(F.count("*").alias("n")), entity_edges(entities, relations).agg(F.count("*").alias("whole"))]
    one = counts[0]
    for c in counts[1:]:
        one = one.crossJoin(F.broadcast(c))  # one row each
    return one.select("files", (F.col("own") + F.col("whole")).alias("resolved"), (F.col("n") - F.col("own")).alias("unresolved"))


def signatures(edges: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(importer, signature): a row for each resolution of a file's imports and relations; rows may repeat."""
    text = lambda *c: F.to_json(F.array(*[F.coalesce(F.col(x).cast("string"), F.lit("\u0000")) for x in c]))
    rows = edges.select("importer", text("specifier", "target", "evidence", "reason").alias("signature"))
    return rows.unionByName(entity_edges(entities, relations).select("importer", text("kind", "from_id", "to_id").alias("signature")))


def resolution_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path) of importers whose sets of ``signatures`` differ between two tables.

    Rows are compared one by one, so that the resolutions of a file that has very many
    never come together.  They are dealt first, as hardly any repeats in the task that
    made it.
    """
    n = int(before.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = before.withColumn("side", F.lit(1)).unionByName(after.withColumn("side", F.lit(2)))
    return sides.repartition(n, "importer", "signature").groupBy("importer", "signature").agg(F.bit_or("side").alias("side")).where("side <> 3").select(F.col("importer").alias("path")).distinct()


def impact(base: dict[str, DataFrame], candidate: dict[str, DataFrame], transitive: bool = True) -> DataFrame:
    """(file, side, depth, via, origin): what may depend on a file that differs between two databases.

    base and candidate hold files, edges, entities and relations.  Seeds are files
    added, deleted or modified and importers whose resolutions changed.  Both graphs
    are searched at once, level by level.  A file found twice takes the parent that a
    queue over sorted seeds and sorted importers meets first: the least chain of
    names from its seed.
    """
    seeds = delta(base["files"], candidate["files"]).where("change <> 'untouched'").select("path")
    sign = [signatures(x["edges"], x["entities"], x["relations"]) for x in (base, candidate)]
    seeds = seeds.unionByName(resolution_changes(*sign)).distinct()
    graph = lambda x, side: reverse_adjacency(x["files"], x["edges"], x["entities"], x["relations"]).select(F.lit(side).alias("side"), "importer", "target")
    graphs = _cut(graph(base, "base").unionByName(graph(candidate, "candidate")))
    sides = F.explode(F.array(F.lit("base"), F.lit("candidate"))).alias("side")
    frontier = _cut(seeds.select(sides, F.col("path").alias("file"), F.array("path").alias("chain")))
    seen, found, depth = frontier.select("side", "file"), None, 0
    while True:
        depth += 1
        step = graphs.join(frontier.select("side", F.col("file").alias("target"), "chain"), ["side", "target"])
        level = step.groupBy("side", F.col("importer").alias("file")).agg(F.min("chain").alias("chain")).join(seen, ["side", "file"], "left_anti")
        level = _cut(level.select("side", "file", F.concat("chain", F.array("file")).alias("chain")))
        if level.isEmpty():
            break
        found = level if found is None else found.unionByName(level)
        seen, frontier = seen.unionByName(level.select("side", "file")), level
        if not transitive:
            break
        if depth % MERGE_LEVELS == 0:
            found, seen = _cut(found), _cut(seen)
    found = frontier.limit(0) if found is None else found
    return found.select("file", "side", (F.size("chain") - 1).cast("long").alias("depth"), F.element_at("chain", -2).alias("via"), F.element_at("chain", 1).alias("origin"))


def resolve_targets(files: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """(path) that a path, a bare file name or an exported symbol names.

    An indexed path stands for itself alone; else a name with an extension and no
    slash stands for the one file that ends so, and the files that export exactly
    this symbol come besides.
    """
    path = posixpath.normpath(name.replace("\\", "/").removeprefix("./")) if name else ""
    exact = files.where(F.col("path") == path).select("path").distinct()
    if not exact.isEmpty():
        return exact
    found = symbols.where(F.col("is_exported") & (F.col("name") == name)).select("path")
    if "/" not in path and posixpath.splitext(path)[1]:
        same = files.where(F.col("path").endswith("/" + path)).select("path").distinct().limit(2)
        if same.count() == 1:
            found = found.unionByName(same)
    return found.distinct()


def dependency_evidence(files: DataFrame, symbols: DataFrame, edges: DataFrame, name: str, transitive: bool = False) -> DataFrame:
    """(file, depth, via, evidence, reason) of what imports what ``name`` resolves to.

    Importers come at their least depth; within a level the last edge counts.  Where
    nothing resolves, a bare specifier equal to the name is taken literally, at depth 1.
    """
    targets = resolve_targets(files, symbols, name)
    row = lambda df, depth, how: df.groupBy("importer").agg(F.max_by(F.struct(F.coalesce("target", "specifier").alias("via"), "reason"), "edge_index").alias("x")).select(F.col("importer").alias("file"), F.lit(depth).cast("long").alias("depth"), "x.via", F.lit(how).alias("evidence"), "x.reason")
    if targets.isEmpty():
        return row(edges.where((F.col("specifier") == name) & ~F.col("specifier").startswith(".")), 1, "syntactic")
    seen = frontier = _cut(targets)
    found, depth = None, 0
    while True:
        depth += 1
        step = edges.join(frontier.withColumnRenamed("path", "target"), "target").join(seen.withColumnRenamed("path", "importer"), "importer", "left_anti")
        level = _cut(row(step, depth, "typescript"))
        if level.isEmpty():
            break
        found = level if found is None else found.unionByName(level)
        frontier = level.select(F.col("file").alias("path"))
        seen = seen.unionByName(frontier)
        if not transitive:
            break
        if depth % MERGE_LEVELS == 0:
            found, seen = _cut(found), _cut(seen)
    return row(edges.limit(0), 0, "typescript") if found is None else found


def members(symbols: DataFrame, name: str) -> DataFrame:
    """Symbols (path, name, kind, signature) for Owner.member, where no symbol has that very name.

    The member is the first line of the owner's signature that begins with it, but
    for case; it is named as written there.
    """
    exact = symbols.where(F.lower("name") == name.lower()).select("path", "name", "kind", "signature")
    owner, _, member = name.partition(".")
    if not owner or not member or "." in member:
        return exact
    line = F.filter(F.split("signature", "\n"), lambda x: F.lower(F.regexp_extract(x, MEMBER, 1)) == member.lower())
    owned = symbols.where(F.lower("name") == owner.lower()).withColumn("line", F.get(line, F.lit(0))).where("line is not null")
    owned = owned.select("path", F.concat("name", F.lit("."), F.regexp_extract("line", MEMBER, 1)).alias("name"), F.lit("method").alias("kind"), F.trim("line").alias("signature"))
    return owned if exact.isEmpty() else exact


def usage_sites(names: DataFrame, symbols: DataFrame, references: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, file, imports_declaration) for each of ``names`` (name): files that refer to it and do not declare it.

    A file declares a name by a symbol of it, in any case, or by a class whose
    signature holds " name(".  References are taken case and all.
    """
    asked = names.select("name").where("name is not null").distinct()
    low = asked.select("name", F.lower("name").alias("low"))
    by_symbol = low.join(symbols.select("path", F.lower(F.col("name")).alias("low")), "low").select("name", "path")
    held = symbols.where("kind = 'class'").select("path", F.explode(F.regexp_extract_all("signature", F.lit(r" ([^ (]+)\("), F.lit(1))).alias("name"))
    declared = by_symbol.unionByName(held.join(asked, "name").select("name", "path")).distinct()
    sites = references.select("name", F.col("path").alias("file")).distinct().join(asked, "name").join(declared.withColumnRenamed("path", "file"), ["name", "file"], "left_anti")
    # From the sites, not from the edges: a file that declares very many names multiplies nothing.
    imported = edges.where("target is not null").select(F.col("importer").alias("file"), F.col("target").alias("path")).distinct()
    hits = sites.join(imported, "file").join(declared, ["name", "path"], "left_semi").select("name", "file").distinct().withColumn("hit", F.lit(True))
    return sites.join(hits, ["name", "file"], "left").select("name", "file", F.coalesce("hit", F.lit(False)).alias("imports_declaration"))


def entities_where(entities: DataFrame, name: str | None = None, path: str | None = None, kind: str | None = None) -> DataFrame:
    """Entities whose name is equal but for case, whose path and kind are equal; None asks nothing."""
    for column, want in ((F.lower("name"), name and name.lower()), (F.col("path"), path), (F.col("kind"), kind)):
        entities = entities.where(column == want) if want is not None else entities
    return entities


def relations_where(relations: DataFrame, from_id: str | None = None, to_id: str | None = None, kind: str | None = None) -> DataFrame:
    for column, want in (("from_id", from_id), ("to_id", to_id), ("kind", kind)):
        relations = relations.where(F.col(column) == want) if want is not None else relations
    return relations


def entity_rows(entities: DataFrame, relations: DataFrame, most: int = 4) -> DataFrame:
    """Per entity: its first ``most`` relations, outgoing before incoming, as "kind > name" and "kind < name"; an unknown end keeps its id."""
    names = entities.select(F.col("id").alias("other"), F.col("name").alias("other_name")).dropDuplicates(["other"])
    sides = relations.select(F.col("from_id").alias("id"), F.col("to_id").alias("other"), F.lit(False).alias("incoming"), F.concat("kind", F.lit(" >")).alias("how"))
    sides = sides.unionByName(relations.select(F.col("to_id").alias("id"), F.col("from_id").alias("other"), F.lit(True).alias("incoming"), F.concat("kind", F.lit(" <")).alias("how")))
    told = sides.join(names, "other", "left").select("id", "incoming", F.concat_ws(" ", "how", F.coalesce("other_name", "other")).alias("text")).distinct()
    # The limit of a group applies before its rows are shuffled: no more than ``most`` of an id leave a task.
    first = told.withColumn("at", F.row_number().over(W.partitionBy("id").orderBy("incoming", "text"))).where(F.col("at") <= most)
    lists = first.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "; ").alias("relations"))
    counts = told.groupBy("id").agg(F.count("*").alias("n"))
    return entities.join(lists, "id", "left").join(counts, "id", "left").select("id", "name", F.coalesce("relations", F.lit("")).alias("relations"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def index_entries(files: DataFrame, symbols: DataFrame, entities: DataFrame, docs: DataFrame) -> DataFrame:
    """(kind, name, path): what lexical search covers - paths, symbols, doc strings (path, docstring) and entities."""
    row = lambda df, kind, name: df.select(F.lit(kind).alias("kind"), F.col(name).alias("name"), "path").where("name is not null and name <> ''")
    return row(files, "path", "path").unionByName(row(symbols, "symbol", "name")).unionByName(row(docs, "docstring", "docstring")).unionByName(row(entities, "entity", "name"))


def exported(symbols: DataFrame) -> DataFrame:
    """Exported symbols, by name."""
    return symbols.where("is_exported").select("path", "name", "kind").orderBy("name", "path")


def import_rows(edges: DataFrame, most: int = 20) -> DataFrame:
    """(importer, specifier, target, category): each file's imports, the resolved first, at most ``most`` a file.

    Of edges that repeat a specifier the last counts; category is null where it is resolved.
    """
    last = edges.groupBy("importer", "specifier").agg(F.max_by(F.struct("target"), "edge_index")["target"].alias("target"))
    one = F.struct(F.col("target").isNull().alias("open"), F.col("specifier"), F.col("target"))
    lists = last.groupBy("importer").agg(F.slice(F.array_sort(F.collect_list(one)), 1, most).alias("rows"))
    out = lists.select("importer", F.explode("rows").alias("r")).select("importer", "r.specifier", "r.target")
    return out.withColumn("category", F.when(F.col("target").isNull(), category(F.col("specifier"))))


def resolution_summary(edges: DataFrame, examples: int = 3) -> DataFrame:
    """(category, n, examples): edges resolved, and unresolved by category; examples are the first relative ones as "importer -> specifier".

    What is resolved is told by its evidence, which the compiler or the file system
    gives; what has none of the known kinds counts nowhere.
    """
    unresolved = F.when(F.col("evidence") == "unresolved", category(F.col("specifier")))
    rows = edges.select(F.when(F.col("evidence").isin(*LOCAL), "resolved").otherwise(unresolved).alias("category"), "importer", "specifier").where("category is not null")
    few = rows.where("category = 'relative'").orderBy("importer", "specifier").limit(examples)
    line = F.concat_ws(" -> ", "importer", "specifier")
    shown = few.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("importer", "specifier", line.alias("line")))), lambda x: x["line"]), "\n").alias("shown"))  # a few rows
    return rows.groupBy("category").agg(F.count("*").alias("n")).crossJoin(F.broadcast(shown)).select("category", "n", F.when(F.col("category") == "relative", F.col("shown")).otherwise("").alias("examples"))


def boundary_edges(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(importer, target, side): edges of which exactly one end is in ``changed`` (path); side tells which."""
    mark = lambda end: changed.select(F.col("path").alias(end), F.lit(True).alias(f"{end}_changed")).distinct()
    both = edges.where("target is not null").select("importer", "target").distinct().join(mark("importer"), "importer", "left").join(mark("target"), "target", "left")
    both = both.na.fill(False, ["importer_changed", "target_changed"]).where("importer_changed <> target_changed")
    return both.select("importer", "target", F.when(F.col("importer_changed"), "importer").otherwise("target").alias("side"))


def tier_proposal(changed: DataFrame, edges: DataFrame, keys: list[str], ledger: DataFrame | None = None) -> DataFrame:
    """Per group of ``changed`` (keys, path): files, dependents, boundary, tier and rationale, a proposal that decides nothing.

    low where all files are tests, documents or markdown; else high where files
    outside the change depend on it, else medium.  dependents: distinct importers
    outside the change; boundary: distinct edges of which one end is in the change.
    rationale: all rules that hold, sorted, one a line.  ledger: (keys, open, fixed)
    advisories, which are told and change nothing.
    """
    links = edges.where("target is not null").select("importer", "target").distinct()
    touched = changed.select(*keys, "path").distinct()
    end = lambda name, other: touched.withColumnRenamed("path", name).join(links, name).join(touched.withColumnRenamed("path", other), [*keys, other], "left_anti").select(*keys, "importer", "target", F.lit(other).alias("outside"))
    crossing = end("target", "importer").unionByName(end("importer", "target"))
    depend = crossing.groupBy(*keys).agg(F.count_distinct(F.when(F.col("outside") == "importer", F.col("importer"))).alias("dependents"), F.count("*").alias("boundary"))
    aside = F.col("path").rlike(ASIDE)
    files = touched.groupBy(*keys).agg(F.count("*").alias("files"), F.count_if(~aside).alias("outside"))
    out = files.join(depend, keys, "left")
    if ledger is not None:
        out = out.join(ledger.select(*keys, "open", "fixed"), keys, "left")
    out = out.na.fill(0)
    low, high, edge = F.col("outside") == 0, F.col("dependents") > 0, F.col("boundary") > 0
    said = lambda test, *parts: F.when(test, F.concat(*[F.lit(p) if isinstance(p, str) and p[0] != "$" else F.col(p[1:]).cast("string") for p in parts]))
    lines = [
        said(low, "all changed files are tests/docs/markdown: fixture or documentation-only change"),
        said(~low & high, "changed files outside tests/docs affect ", "$dependents", " unchanged dependents: proposing high tier"),
        said(~low & ~high & edge, "$boundary", " module-boundary edge(s) touched: proposing at least medium tier"),
        said(~low & ~high & ~edge, "$outside", " changed file(s) outside tests/docs with no other signal: proposing medium tier"),
        said(~low & high & edge, "$boundary", " module-boundary edge(s) touched (context; high tier already applies)"),
    ]
    if ledger is not None:
        lines += [said(F.col("open") > 0, "$open", " prior open advisories in ledger"), said(F.col("fixed") > 0, "$fixed", " prior advisories fixed in ledger")]
    tier = F.when(low, "low").when(high, "high").otherwise("medium")
    return out.select(*keys, "files", "dependents", "boundary", tier.alias("tier"), F.array_join(F.array_sort(F.array_compact(F.array(*lines))), "\n").alias("rationale"))


def summary(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row: indexed files and symbols."""
    return files.agg(F.count_distinct("path").alias("files")).crossJoin(F.broadcast(symbols.agg(F.count("*").alias("symbols"))))


def _imported(imports: DataFrame, entities: DataFrame) -> DataFrame:
    """(importer, path, test): relative imports (path, specifier) that lead to a file with entities."""
    joined = F.concat_ws("/", F.regexp_replace("path", r"/?[^/]*$", ""), "specifier")
    # "." parts go, and ".." takes the part before it along.
    parts = F.filter(F.split(joined, "/"), lambda x: (x != "") & (x != "."))
    whole = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))), lambda acc: F.array_join(acc, "/"))
    named = imports.where(F.col("specifier").startswith(".")).select(F.col("path").alias("importer"), whole.alias("path")).distinct()
    contracts = entities.select("path").distinct()
    return named.join(contracts, "path").join(contracts.withColumnRenamed("path", "importer"), "importer", "left_anti").withColumn("test", F.col("importer").rlike(TEST_FILE))


def contract_entities(imports: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, kind, name, path): a consumer, or a test, for each file that imports a contract and is none itself."""
    kind = F.when(F.col("test"), "test").otherwise("consumer")
    return _imported(imports, entities).select(F.concat_ws(":", kind, "importer").alias("id"), kind.alias("kind"), F.regexp_extract("importer", "([^/]*)$", 1).alias("name"), F.col("importer").alias("path")).distinct()


def contract_edges(imports: DataFrame, entities: DataFrame) -> DataFrame:
    """(from_id, importer, to_id, kind): imports of contract files as relations to their entities; tests validate, others consume."""
    kind = F.when(F.col("test"), "validates").otherwise("consumes")
    of = F.concat_ws(":", F.when(F.col("test"), "test").otherwise("consumer"), "importer")
    return _imported(imports, entities).join(entities.select("path", F.col("id").alias("to_id")), "path").select(of.alias("from_id"), "importer", "to_id", kind.alias("kind")).distinct()
