"""Scans of version-controlled workspaces: index, status and working files, and the manifest nearest to a file.

    records  root, pos, value       one record of a NUL-framed listing
    index    root, path, sha        what is tracked
    status   root, pos, path, code  what differs in the working tree
    working  root, path, sha        blob hashes of the files that could be read
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import blob_sha
from ..operators.spread import dealt

#: The largest source that is hashed, and lock files in the order in which they tell the package manager.
MOST_BYTES = 1024 * 1024
LOCK_FILES = (("pnpm-lock.yaml", "pnpm"), ("yarn.lock", "yarn"), ("bun.lock", "bun"), ("bun.lockb", "bun"), ("package-lock.json", "npm"))
MANIFEST = "package.json"


def nul_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(root, pos, value) of files of NUL-framed records; root is the file's folder, pos orders a file's records.

    Files are read in splits: a record's place is its split's first byte and its row in it.
    """
    rows = spark.read.option("lineSep", "\0").text(paths).select("value", "_metadata.file_path", "_metadata.file_block_start").withColumn("at", F.monotonically_increasing_id())
    return rows.select(F.regexp_replace("file_path", "/[^/]*$", "").alias("root"), F.struct("file_block_start", "at").alias("pos"), "value")


def framed(texts: DataFrame, text: str) -> DataFrame:
    """(root, pos, value) of listings (root, ``text``) that are held as one string each."""
    return texts.select("root", F.posexplode(F.split(text, "\0")).alias("pos", "value"))


def index_entries(records: DataFrame) -> DataFrame:
    """(root, path, sha) of "<mode> <sha> <stage>\\t<path>"; of a path's stages the last holds, what has another form is left out."""
    meta, path = F.split(F.substring_index("value", "\t", 1), " "), F.expr("substring(value, instr(value, '\t') + 1)")
    rows = records.where(F.contains("value", F.lit("\t")) & (F.size(meta) >= 2)).select("root", "pos", path.alias("path"), meta[1].alias("sha"))
    return rows.groupBy("root", "path").agg(F.max_by("sha", "pos").alias("sha"))


def status_entries(records: DataFrame) -> DataFrame:
    """(root, pos, path, code) of "XY <path>"; a rename or copy takes the next record, its former path, along.

    A former path may look like a record itself.  In an unbroken row of records that
    look like renames the first is one - nothing before it took it - and so are the
    third, the fifth and so on; what follows an odd number of them is a former path.
    """
    step = W.partitionBy("root").orderBy("pos")
    looks = F.coalesce(F.length("value") >= 3, F.lit(False)) & F.substring("value", 1, 2).rlike("[RC]")
    rows = records.select("root", "pos", "value", looks.alias("looks")).withColumn("run", F.count_if(~F.col("looks")).over(step))
    # A run is a plain record and the renames after it: how many stand before this one since then.
    before = F.count_if("looks").over(W.partitionBy("root", "run").orderBy("pos").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("before", F.coalesce(before, F.lit(0)))
    last = F.lag(F.struct("looks", "before")).over(step)
    former = F.coalesce(last["looks"] & (last["before"] % 2 == 0), F.lit(False))
    return rows.withColumn("former", former).where(~F.col("former") & (F.length("value") >= 3)).select("root", "pos", F.expr("substring(value, 4)").alias("path"), F.substring("value", 1, 2).alias("code"))


def working_files(spark: SparkSession, folder: str, root: Column | str = "root", most: int = MOST_BYTES) -> DataFrame:
    """(root, path, sha) of all files below ``folder``, from their bytes; a larger one than ``most`` ends the scan with an error.

    The reader passes empty files over: what its listing has and no row tells is empty.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    bare = lambda c: F.regexp_replace(c, "^file:/+", "/")
    content = F.when(F.col("length") > most, F.raise_error(F.concat(F.lit("source too large: "), "path")).cast("binary")).otherwise(F.col("content"))
    read = files.select(bare("path").alias("path"), blob_sha(content).alias("sha"))
    listed = spark.createDataFrame([(unquote(f),) for f in files.inputFiles()], "path string").select(bare("path").alias("path"))
    empty = listed.join(files.select(bare("path").alias("path")), "path", "left_anti").select("path", blob_sha(F.lit("")).alias("sha"))
    below = len(re.sub("^file:/+", "/", folder.rstrip("/"))) + 2
    return read.unionByName(empty).select((F.lit(root) if isinstance(root, str) else root).alias("root"), F.expr(f"substring(path, {below})").alias("path"), "sha")


def scan(index: DataFrame, status: DataFrame, working: DataFrame, include: Column | None = None) -> DataFrame:
    """(root, path, sha, status) of a workspace: tracked, modified, untracked or deleted.

    Status overlays the index.  What is untracked is there only if it can be read;
    what is changed has the hash of its bytes, or "" where it cannot be read, so that
    no former hash stands for it; what is deleted keeps its tracked hash, else "".  Of
    a path's records the last holds.  include: a condition over ``path``.
    """
    if include is not None:
        index, status = index.where(include), status.where(include)
    last = status.groupBy("root", "path").agg(F.max_by("code", "pos").alias("code"))
    rows = index.join(last, ["root", "path"], "full_outer").join(working.select("root", "path", F.col("sha").alias("read")), ["root", "path"], "left")
    # Unreadable untracked files change nothing.
    code = F.when((F.col("code") == "??") & F.col("read").isNull(), None).otherwise(F.col("code"))
    kind = F.when(code.isNull(), "tracked").when(code == "??", "untracked").when(code.contains("D"), "deleted").otherwise("modified")
    sha = F.when(kind == "tracked", F.col("sha")).when(kind == "deleted", F.coalesce("sha", F.lit(""))).otherwise(F.coalesce("read", F.lit("")))
    return rows.where(F.col("sha").isNotNull() | code.isNotNull()).select("root", "path", sha.alias("sha"), kind.alias("status"))


def ancestors(folder: Column) -> Column:
    """Array of (up, folder) of a relative folder and all above it; the topmost is ""."""
    parts = F.filter(F.split(folder, "/"), lambda x: (x != "") & (x != "."))
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda up: F.struct(up.alias("up"), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - up), "/").alias("folder")))


def receipts(commands: DataFrame, files: DataFrame, manifests: DataFrame) -> DataFrame:
    """Per command (id, root, folder): package_path, package_manager and the commands of the nearest manifest above its folder.

    files: root, path of all files.  manifests: root, path, text of the manifests.
    Each distinct folder and those above it are asked for by a join, and the least
    distance wins.  The package manager is the nearest that a manifest declares or a lock file
    tells, a declaration before lock files in one folder, else npm.  Null where no
    manifest is found, or where the nearest one is not an object.
    """
    folder_of = lambda p: F.regexp_replace(p, "/?[^/]*$", "")
    field = lambda path: F.get_json_object("text", path)
    script = lambda name: F.length(F.trim(F.coalesce(field(f"$.scripts.{name}"), F.lit("")))) > 0
    known = manifests.where((F.element_at(F.split("path", "/"), -1) == MANIFEST) & F.coalesce(F.startswith(F.ltrim("text"), F.lit("{")), F.lit(False))).select(
        "root", folder_of("path").alias("folder"), F.struct("path", field("$.packageManager").alias("declared"), *[script(x).alias(x) for x in ("test", "build", "lint")]).alias("manifest")
    )
    name = F.element_at(F.split("path", "/"), -1)
    rank = F.element_at(F.create_map(*[F.lit(x) for i, (f, _) in enumerate(LOCK_FILES) for x in (f, i)]), name)
    manager = F.element_at(F.create_map(*[F.lit(x) for pair in LOCK_FILES for x in pair]), name)
    locks = files.where(name.isin([f for f, _ in LOCK_FILES])).groupBy("root", folder_of("path").alias("folder")).agg(F.min(F.struct(rank.alias("rank"), manager.alias("manager")))["manager"].alias("locked"))
    told = known.join(locks, ["root", "folder"], "full_outer").select("root", "folder", "manifest", F.coalesce("manifest.declared", "locked").alias("manager"))
    least = lambda rows, *keys: rows.groupBy(*keys).agg(*[F.min(F.when(F.col(c).isNotNull(), F.struct("up", c))).alias(c) for c in ("manifest", "manager")])
    asked = commands.select("root", F.col("folder").alias("from")).distinct().select("root", "from", F.inline(ancestors(F.col("from"))))
    folders = least(asked.join(told, ["root", "folder"]), "root", "from").where("manifest is not null or manager is not null")
    # Commands of one folder may be very many: each is dealt with its folder's answer, and an id that repeats takes the nearest of all.
    met = dealt(folders, commands.select("id", "root", F.col("folder").alias("from")), ["root", "from"], "id", 1 << 16)
    pick = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.up").alias("up"), F.col(f"{c}.{c}").alias(c))))[c]
    near = met.groupBy("id").agg(pick("manifest").alias("m"), pick("manager").alias("manager"))
    full = F.coalesce("manager", F.lit("npm"))
    run = lambda x, words: F.when(F.col(f"m.{x}"), F.concat(F.substring_index(full, "@", 1), F.lit(words)))
    some = F.col("m").isNotNull()
    return commands.select("id").join(near, "id", "left").select("id", F.col("m.path").alias("package_path"), F.when(some, full).alias("package_manager"), run("test", " test").alias("test_command"), run("build", " run build").alias("build_command"), run("lint", " run lint").alias("lint_command"))
