"""Readers with explicit schemas. Records that do not parse are left out; payloads are read only where they are used."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.schemas import SCHEMAS


def json_records(spark: SparkSession, folder: str, table: str, multi_line: bool = True) -> DataFrame:
    """One JSON document per file, below any depth, with the file's path and size; corrupt files are skipped."""
    schema = f"{SCHEMAS[table]}, _corrupt_record STRING"
    raw = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").option("multiLine", str(multi_line).lower()).json(folder)
    return raw.select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_size").alias("file_size")).where("_corrupt_record IS NULL").drop("_corrupt_record")


def cache_records(spark: SparkSession, folder: str) -> DataFrame:
    """Cache records; a record without a key takes the name of its file."""
    named = F.regexp_replace(F.regexp_extract("file_path", r"([^/]*)\.json$", 1), "%2F", "/")
    return json_records(spark, folder, "cache_records").withColumn("key", F.coalesce("key", named))


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshots, newest first."""
    return json_records(spark, folder, "snapshots").orderBy(F.desc("timestamp"), "id")


def store_listing(spark: SparkSession, folder: str) -> DataFrame:
    """(name, path, size, mtime) of all files below a folder, from metadata alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def either(local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    """Local rows, and remote rows whose key is not local."""
    return local.unionByName(remote.join(local.select(key), key, "left_anti"))


def cargo_metadata(spark: SparkSession, path: str, include_dev: bool = False) -> tuple[DataFrame, DataFrame]:
    """nodes(name), edges(dependency, dependent) of a workspace metadata document; edges that only tests need are left out.

    An edge to itself and an edge that would close a cycle with those before it are left out.
    """
    schema = "workspace_members ARRAY<STRING>, resolve STRUCT<nodes: ARRAY<STRUCT<id: STRING, deps: ARRAY<STRUCT<pkg: STRING, dep_kinds: ARRAY<STRUCT<kind: STRING>>>>>>>"
    doc = spark.read.schema(schema).option("multiLine", "true").json(path)
    members = doc.select(F.explode("workspace_members").alias("name"))
    deps = doc.select(F.posexplode("resolve.nodes").alias("i", "n")).select("i", F.col("n.id").alias("dependent"), F.posexplode("n.deps").alias("j", "d"))
    if not include_dev:
        deps = deps.where(~F.forall("d.dep_kinds", lambda k: F.coalesce(k["kind"] == "dev", F.lit(False))))
    edges = deps.select(F.col("d.pkg").alias("dependency"), "dependent", "i", "j").where("dependency <> dependent")
    m = members.select(F.col("name").alias("m"))
    inside = edges.join(m, F.col("dependency") == F.col("m"), "left_semi").join(m, F.col("dependent") == F.col("m"), "left_semi")
    return members, inside.groupBy(F.lit(1).alias("document")).applyInPandas(_without_cycles, "dependency string, dependent string")


def _without_cycles(pdf: pd.DataFrame) -> pd.DataFrame:
    """One document's edges in its order, without those that close a cycle. A document is read as one row, so it fits a task."""
    above: dict[str, set[str]] = {}
    kept = []
    for a, b in pdf.sort_values(["i", "j"])[["dependency", "dependent"]].itertuples(index=False):
        seen, front = {a}, [a]
        while front and b not in seen:
            fresh = above.get(front.pop(), set()) - seen
            seen |= fresh
            front += fresh
        if b not in seen:
            above.setdefault(b, set()).add(a)
            kept.append((a, b))
    return pd.DataFrame(kept, columns=["dependency", "dependent"])


# Manifests that name an ecosystem, lock files by precedence, folders that are not entered.
MANIFESTS = {
    "Cargo.toml": ("Rust", ("Cargo.lock",)), "package.json": ("TypeScript", ("pnpm-lock.yaml", "yarn.lock", "package-lock.json")), "go.mod": ("Go", ("go.sum",)), "pyproject.toml": ("Python", ("poetry.lock",)),
    "pom.xml": ("Java", ()), "build.gradle": ("Java", ()), "build.gradle.kts": ("Java", ()), "CMakeLists.txt": ("Cpp", ()), "Package.swift": ("Swift", ()), "pubspec.yaml": ("Dart", ()), "build.zig": ("Zig", ()), "Dockerfile": ("Docker", ()),
}
SKIPPED_FOLDERS = ("target", "node_modules", ".git", ".venv", "__pycache__", "dist", "build", "fixtures", "editors", ".github")


def ecosystems(files: DataFrame, skipped: tuple[str, ...] = SKIPPED_FOLDERS) -> DataFrame:
    """files(path): (dir, ecosystem, manifest, lockfile) of every folder with a manifest; one manifest and one lock file each, by precedence."""
    spark = files.sparkSession
    entered = files.where(~F.arrays_overlap(F.slice(F.split("path", "/"), F.lit(1), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0))), F.array(*[F.lit(x) for x in skipped])))
    split = entered.select(F.regexp_extract("path", r"^(.*?)/?[^/]*$", 1).alias("dir"), tx.file_name(F.col("path")).alias("name"))
    order = {m: k for k, m in enumerate(MANIFESTS)}
    manifests = spark.createDataFrame([(m, e, order[m]) for m, (e, _) in MANIFESTS.items()], "name string, ecosystem string, rank int")
    locks = spark.createDataFrame([(lock, e, k) for e, ls in {e: ls for e, ls in MANIFESTS.values() if ls}.items() for k, lock in enumerate(ls)], "name string, ecosystem string, rank int")
    best = lambda t, out: split.join(F.broadcast(t), "name").groupBy("dir", "ecosystem").agg(F.min_by("name", "rank").alias(out))
    return best(manifests, "manifest").join(best(locks, "lockfile"), ["dir", "ecosystem"], "left").select("dir", "ecosystem", "manifest", "lockfile")


def workspace_kind(files: DataFrame, names: tuple[str, ...] = ("Cargo.toml", "package.json", "go.mod", "pyproject.toml")) -> DataFrame:
    """files(root, name): the first of the manifests that each root holds."""
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("name"))
    return files.where(rank > 0).groupBy("root").agg(F.min_by("name", rank).alias("manifest"))


def depfiles(files: DataFrame, escaped_spaces: bool = True) -> DataFrame:
    """files(path, source): (path, target, dep) of make-style dependency files; continued lines are joined, a backslash may keep a space."""
    joined = F.regexp_replace("source", r"\\\r?\n", " ")
    lines = files.select("path", F.explode(F.split(joined, r"\r?\n")).alias("line")).where(F.col("line").rlike(r"^[^:]+:(?:\s|$)"))
    target, rest = F.trim(F.regexp_extract("line", r"^([^:]+):", 1)), F.trim(F.regexp_extract("line", r"^[^:]+:(.*)$", 1))
    if not escaped_spaces:
        return lines.select("path", target.alias("target"), F.explode(F.filter(F.split(rest, r"\s+"), lambda d: (d != "") & (d != "\\"))).alias("dep"))
    deps = F.transform(F.filter(F.split(F.regexp_replace(rest, r"\\ ", "\u0000"), r"[ \t]+"), lambda d: d != ""), lambda d: F.translate(d, "\u0000", " "))
    return lines.select("path", target.alias("target"), F.explode(deps).alias("dep"))


def cargo_lock(files: DataFrame) -> DataFrame:
    """files(path, source): (path, package, version) of name lines followed by version lines."""
    found = F.regexp_extract_all("source", F.lit(r'(?m)^name = "([^"]*)"\s*\nversion = "[^"]*"'), F.lit(1))
    versions = F.regexp_extract_all("source", F.lit(r'(?m)^name = "[^"]*"\s*\nversion = "([^"]*)"'), F.lit(1))
    return files.select("path", F.inline(F.arrays_zip(found.alias("package"), versions.alias("version"))))


def npm_lock(files: DataFrame) -> DataFrame:
    """files(path, source): entries of dependencies and of packages, both, without removing doubles."""
    entry = "MAP<STRING, STRUCT<version: STRING>>"
    parsed = files.select("path", F.from_json("source", f"dependencies {entry}, packages {entry}").alias("j"))
    deps = parsed.select("path", F.explode("j.dependencies").alias("package", "v"))
    packages = parsed.select("path", F.explode("j.packages").alias("package", "v")).where("package <> ''").withColumn("package", F.regexp_replace("package", r"^.*node_modules/", ""))
    return deps.unionByName(packages).select("path", "package", F.col("v.version").alias("version")).where("version IS NOT NULL")


def pom_dependencies(files: DataFrame) -> DataFrame:
    """files(path, source): (path, package, version) of the dependency elements."""
    blocks = files.select("path", F.explode(F.regexp_extract_all("source", F.lit(r"(?s)<dependency>(.*?)</dependency>"), F.lit(1))).alias("b"))
    tag = lambda t: F.regexp_extract("b", rf"<{t}>\s*([^<]*?)\s*</{t}>", 1)
    return blocks.select("path", F.concat_ws(":", tag("groupId"), tag("artifactId")).alias("package"), tag("version").alias("version"))


def compilation_database(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMAS["compile_commands"]).option("multiLine", "true").json(path)


def find_command(commands: DataFrame, wanted: str) -> DataFrame:
    """The first command, by file, whose file is or ends with the wanted one."""
    return commands.where((F.col("file") == wanted) | F.col("file").endswith(wanted)).orderBy("file").limit(1)


def rules(files: DataFrame) -> DataFrame:
    """files(path, source): the rules of build files, (path, name, command, args, inputs, outputs, depends_on, env)."""
    blocks = files.select("path", F.explode(tx.rule_blocks(F.col("source"))).alias("block"))
    return blocks.select("path", tx.rule_fields(F.col("block")).alias("rule")).select("path", "rule.*")


def whole_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, source) of text files below a folder."""
    read = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(folder)
    return read.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("source"))


def list_directory(entries: DataFrame, folder: str) -> DataFrame:
    """entries(path, is_dir, size): immediate children of a folder; a file or a path that is not there is an error."""
    inner = folder.strip("/")
    if inner:
        here = F.rtrim(F.col("path"), F.lit("/"))
        known = entries.agg(F.bool_or((here == folder.rstrip("/")) & ~F.col("is_dir")).alias("file"), F.bool_or((here == folder.rstrip("/")) | F.col("path").startswith(folder.rstrip("/") + "/")).alias("there")).first()
        if known.file:
            raise NotADirectoryError(folder)
        if not known.there:
            raise FileNotFoundError(folder)
    prefix = folder.rstrip("/") + "/" if folder not in ("", "/") else ("/" if folder == "/" else "")
    below = entries.where(F.col("path").startswith(prefix) & (F.col("path") != prefix))
    rest = F.expr(f"substring(path, {len(prefix) + 1})")
    return below.select(F.split(rest, "/").getItem(0).alias("name"), F.contains(rest, F.lit("/")).alias("deep"), "is_dir", "size").groupBy("name").agg((F.bool_or("deep") | F.bool_or("is_dir")).alias("is_dir"), F.sum("size").alias("bytes"))


def upsert(base: DataFrame, updates: DataFrame, key: str, order: str) -> DataFrame:
    """Newest row of each key; the batch step of an ingesting stream."""
    both = base.unionByName(updates)
    rest = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("v")).select(key, "v.*")


