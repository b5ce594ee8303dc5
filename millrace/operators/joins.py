"""Joins the domain needs: path owners, lookups with precedence, missing blobs, snapshot differences, advisories, worker choice.

Equi joins wherever a condition can be turned into one: prefixes meet as cut texts, substrings by their rarest gram.
Where every row of a small side counts, it is counted first and broadcast in blocks of MAX_PATTERNS rows; whole products go tile by tile.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators import graph
from millrace.operators.tables import settle, side

MAX_PATTERNS = 100_000

#: Right and left values in a tile of a product; Parquet has a dictionary for up to 131,072 numbers.
RUN, TILE = 256, 65_536


def in_blocks(small: DataFrame, key: str, most: int = MAX_PATTERNS) -> list[DataFrame]:
    """small as tables of about `most` rows at the most, each safe to broadcast."""
    blocks = max(1, -(-small.count() // most))
    return [small] if blocks == 1 else [small.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b) for b in range(blocks)]


def match_patterns(rows: DataFrame, patterns: DataFrame, key: str, condition: Column) -> DataFrame:
    """rows joined with patterns on any condition, block by block of the patterns."""
    return reduce(DataFrame.unionByName, [rows.join(F.broadcast(b), condition) for b in in_blocks(patterns, key)])


#: Longest gram; patterns up to this length are their own.
GRAM = 8


def _grams(text: Column, n: int) -> Column:
    """Distinct substrings of n characters; of none for n = 0 the empty one."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))) if n else F.when(text.isNotNull(), F.array(F.lit("")))


def occurring(texts: DataFrame, patterns: DataFrame, text: str, pattern: str) -> DataFrame:
    """(pattern): the distinct patterns that occur in some text.

    A pattern meets the texts that hold the rarest of its grams of GRAM letters, a shorter one those that hold it
    as a gram, and is looked for in these. Texts are cut only at the lengths that the patterns' grams have.
    """
    wanted = patterns.select(F.col(pattern).alias("pattern")).where("pattern IS NOT NULL").distinct()
    each = F.least(F.length("pattern"), F.lit(GRAM))
    lengths = sorted(r["n"] for r in wanted.select(each.alias("n")).distinct().collect())  # GRAM + 1 at the most
    if not lengths:
        return wanted
    own = reduce(lambda w, n: w.when(each == n, _grams(F.col("pattern"), n)), lengths, F.when(F.lit(False), F.array().cast("array<string>")))
    parts = wanted.select("pattern", F.explode(own).alias("gram"))
    held = texts.select(F.col(text).alias("text")).where("text IS NOT NULL").distinct()
    found = held.select("text", F.explode(F.concat(*[_grams(F.col("text"), n) for n in lengths])).alias("gram"))
    counts = found.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = parts.join(side(counts), "gram", "left").groupBy("pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
    rarest = settle(rarest.where("r.n > 0").select("pattern", "r.gram"))
    asked = settle(rarest.select("gram").distinct())
    return found.join(side(asked, asked.count()), "gram", "left_semi").join(side(rarest), "gram").where(F.col("text").contains(F.col("pattern"))).select("pattern").distinct()


def beginning(texts: DataFrame, prefixes: DataFrame, text: str, prefix: str) -> DataFrame:
    """(prefix): the distinct prefixes that some text begins with. Texts are cut at the lengths that prefixes have and meet them by equality."""
    wanted = prefixes.select(F.col(prefix).alias("prefix")).where("prefix IS NOT NULL").distinct()
    lengths = wanted.agg(F.collect_set(F.length("prefix")).alias("lengths"))  # as many as the longest prefix has letters
    cut = texts.select(F.col(text).alias("text")).crossJoin(F.broadcast(lengths)).select("text", F.explode(F.filter("lengths", lambda n: n <= F.length("text"))).alias("n"))
    return wanted.join(cut.select(F.substring(F.col("text"), F.lit(1), F.col("n")).alias("prefix")).distinct(), "prefix", "left_semi")


def ancestors(path: Column) -> Column:
    """A path and the directories above it, deepest first; the empty path is the root."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def path_owners(paths: DataFrame, packages: DataFrame) -> DataFrame:
    """paths(path), packages(package, dir, ord): (path, package) of the deepest package directory around each path, null if none.

    Whole components count. Each path explodes into its directories, which join by equality; of packages in
    the same directory the one with the least ord stands.
    """
    first = packages.groupBy("dir").agg(F.min_by("package", "ord").alias("package"))
    around = paths.select("path").distinct().select("path", F.posexplode(ancestors(F.col("path"))).alias("up", "dir"))
    hit = around.join(first, "dir").groupBy("path").agg(F.min_by("package", "up").alias("package"))
    return paths.select("path").distinct().join(hit, "path", "left")


def packages_for_paths(paths: DataFrame, packages: DataFrame) -> DataFrame:
    """(package, everything): the owners once each in workspace order; if any path has no owner, all packages with everything set."""
    owned = path_owners(paths, packages)
    lost = owned.agg(F.coalesce(F.bool_or(F.col("package").isNull()), F.lit(False)).alias("everything"))
    touched = owned.where("package IS NOT NULL").select("package", F.lit(True).alias("hit")).distinct()
    return packages.join(touched, "package", "left").crossJoin(F.broadcast(lost)).where("everything OR hit").orderBy("ord").select("package", "everything")


def recommend_tasks(changed: DataFrame, patterns: DataFrame, edges: DataFrame) -> DataFrame:
    """changed(file), patterns(package, pattern), edges: packages whose pattern occurs in a file, and all that depend on them."""
    hits = patterns.join(side(occurring(changed, patterns, "file", "pattern")), "pattern", "left_semi").select(F.col("package").alias("id")).distinct()
    return graph.closure(edges, hits, reverse=True).orderBy("id")


def dependent_targets(changed: DataFrame, deps: DataFrame, edges: DataFrame) -> DataFrame:
    """changed(file), deps(target, dep): targets that list the file or a prefix of it, and what depends on them."""
    hits = deps.join(beginning(changed, deps, "file", "dep").withColumnRenamed("prefix", "dep"), "dep", "left_semi").select(F.col("target").alias("id")).distinct()
    return graph.closure(edges, hits, reverse=True).orderBy("id")


def composite_lookup(requests: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """requests(key, fingerprint): the artifact of an equal fingerprint, local before remote, and where it came from."""
    a = local.select("key", F.col("fingerprint").alias("lf"), F.col("artifact").alias("la"))
    b = remote.select("key", F.col("fingerprint").alias("rf"), F.col("artifact").alias("ra"))
    near, far = F.col("lf") == F.col("fingerprint"), F.col("rf") == F.col("fingerprint")
    return requests.join(a, "key", "left").join(b, "key", "left").select(
        "key", "fingerprint", F.when(near, F.col("la")).when(far, F.col("ra")).alias("artifact"), F.when(near, "local").when(far, "remote").otherwise("miss").alias("source")
    )


def missing_blobs(requested: DataFrame, present: DataFrame, key: str = "digest") -> DataFrame:
    """Requested digests that are not present; repeated requests stay repeated."""
    return requested.join(present.select(key), key, "left_anti")


def unreferenced(blobs: DataFrame, refs: DataFrame, key: str = "digest") -> DataFrame:
    return blobs.join(refs.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("removed"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("freed_bytes"))


def cache_hits(requests: DataFrame, records: DataFrame, hit: bool = True) -> DataFrame:
    return requests.join(records.select("key", "fingerprint"), ["key", "fingerprint"], "left_semi" if hit else "left_anti")


def changed_symbols(old: DataFrame, new: DataFrame) -> DataFrame:
    """old, new(file, symbol, hash): (file, symbol, change) of new, changed and removed symbols."""
    joined = old.select("file", "symbol", F.col("hash").alias("h0")).join(new.select("file", "symbol", F.col("hash").alias("h1")), ["file", "symbol"], "full")
    change = F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "removed").otherwise("changed")
    return joined.where(~F.col("h0").eqNullSafe(F.col("h1"))).select("file", "symbol", change.alias("change"))


def snapshot_states(old: DataFrame, new: DataFrame) -> DataFrame:
    """old, new(path, size, hash): Created, Modified, Deleted or Clean; only size and hash decide."""
    a, b = old.select("path", F.struct("size", "hash").alias("a")), new.select("path", F.struct("size", "hash").alias("b"))
    state = F.when(F.col("a").isNull(), "Created").when(F.col("b").isNull(), "Deleted").when(~F.col("a").eqNullSafe(F.col("b")), "Modified").otherwise("Clean")
    return a.join(b, "path", "full").select("path", state.alias("state"))


def impacted_tests(symbols: DataFrame, uses: DataFrame) -> DataFrame:
    return uses.join(symbols.select("symbol").distinct(), "symbol", "left_semi").select("test").distinct().orderBy("test")


def version_key(version: Column) -> Column:
    """major, minor, patch as comparable numbers, null if the text is no such version."""
    ok = version.rlike(r"^\d+\.\d+\.\d+(?:[-+][0-9A-Za-z.-]+)?$")
    numbers = F.transform(F.split(F.regexp_extract(version, r"^(\d+\.\d+\.\d+)", 1), r"\."), lambda p: p.cast("bigint"))
    final = F.when(version.rlike(r"^\d+\.\d+\.\d+-"), F.lit(0)).otherwise(F.lit(1)).cast("bigint")  # a pre-release stands before its release
    return F.when(ok, F.concat(numbers, F.array(final)))


def vulnerable(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """packages(package, version), advisories(package, fixed_version, id, severity): versions below the fix; unreadable ones are dropped."""
    joined = packages.join(advisories, "package").withColumns({"_v": version_key(F.col("version")), "_f": version_key(F.col("fixed_version"))})
    return joined.where(F.col("_v") < F.col("_f")).drop("_v", "_f")


def pipeline_edges(tasks: DataFrame, package_edges: DataFrame) -> DataFrame:
    """tasks(package, task, depends_on): edges between (package, task); ^task means that task in the package's dependencies, missing ones are skipped.

    A cycle is an error.
    """
    wanted = tasks.select("package", "task", F.explode("depends_on").alias("d"))
    known = tasks.select(F.col("package").alias("dep_package"), F.col("task").alias("dep_task"))
    own = wanted.where(~F.col("d").startswith("^")).select("package", "task", F.col("package").alias("dep_package"), F.col("d").alias("dep_task"))
    up = wanted.where(F.col("d").startswith("^")).join(side(package_edges.select(F.col("dependent").alias("package"), F.col("dependency").alias("dep_package"))), "package")
    upstream = up.select("package", "task", "dep_package", F.expr("substring(d, 2)").alias("dep_task"))
    found = settle(own.unionByName(upstream).join(side(known), ["dep_package", "dep_task"]).select("dep_package", "dep_task", "package", "task"))
    numbers = settle(graph.number_rows(tasks.select("package", "task").distinct(), "package", "task").withColumnRenamed("number", "id"))
    ends = found.join(side(numbers.withColumnsRenamed({"package": "dep_package", "task": "dep_task", "id": "dependency"})), ["dep_package", "dep_task"]).join(side(numbers.withColumnRenamed("id", "dependent")), ["package", "task"])
    if graph.longest_levels(numbers, ends).count() < numbers.count():
        raise ValueError("the pipeline has a cycle")
    return found


def product(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every value of left's column with every value of right's, in tiles of about TILE by RUN: tasks follow the rows of the result.

    In a tile each left value stands RUN times on end and the same RUN right values return for each, so that Parquet
    writes runs and repeats. Nothing is broadcast; both sides are shuffled once, copies of them are not.
    """
    a, b = left.columns[0], right.columns[0]
    strips = graph.number_rows(right, b).groupBy(F.floor(F.col("number") / RUN).alias("strip")).agg(F.array_sort(F.collect_list(b)).alias("strip_of"))
    strips = strips.repartitionByRange(max(1, -(-right.count() // RUN)), "strip").select("strip_of")
    tiles = left.repartitionByRange(max(1, -(-left.count() // TILE)), a).hint("shuffle_replicate_nl").crossJoin(strips)
    return tiles.select(a, F.explode("strip_of").alias(b))


def fan_in(nodes: DataFrame, kind: str) -> DataFrame:
    """nodes(id, ecosystem): every node of another ecosystem before every node of this one."""
    ids = lambda which, name: nodes.where(which).select(F.col("id").alias(name))
    return product(ids(F.col("ecosystem") != kind, "dependency"), ids(F.col("ecosystem") == kind, "dependent"))


def eligible_workers(workers: DataFrame, toolchain: str, tags: dict[str, str]) -> DataFrame:
    """Healthy workers with the toolchain and all the tags, least busy first, then the least id."""
    fits = F.array_contains("supported_toolchains", toolchain) | F.array_contains("supported_toolchains", "*") | F.lit(toolchain == "")
    for k, v in tags.items():
        fits &= F.coalesce(F.try_element_at("tags", F.lit(k)) == v, F.lit(False))
    return workers.where(F.col("healthy") & fits).orderBy("active_jobs", "id")


def artifact_peers(requests: DataFrame, announced: DataFrame) -> DataFrame:
    return requests.join(announced, "digest").select("digest", "peer").distinct()


def first_peer(announced: DataFrame) -> DataFrame:
    return announced.groupBy("digest").agg(F.min_by("peer", F.struct("seq", "peer")).alias("peer"))


def first_modified(sources: DataFrame, last_build: Column) -> DataFrame:
    """sources(target, pos, path, mtime): the first source newer than the last build, else that there is no previous record."""
    newer = F.when(F.col("mtime") > last_build, F.col("pos"))
    return sources.groupBy("target").agg(F.min_by("path", newer).alias("path")).select("target", F.when(F.col("path").isNull(), "NoPreviousCache").otherwise("SourceModified").alias("reason"), "path")


def verify_attestation(recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """recorded(statement, name, digest), actual(name, digest): whether all recorded digests exist and match."""
    return recorded.join(actual.withColumnRenamed("digest", "found"), "name", "left").groupBy("statement").agg(F.coalesce(F.bool_and(F.col("digest").eqNullSafe(F.col("found"))), F.lit(True)).alias("valid"))


def hermeticity(events: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """events(task, kind, path): reads that are no declared input and writes that are no declared output, once each."""
    reads = events.where("kind = 'Read'").join(inputs.select("task", "path"), ["task", "path"], "left_anti").withColumn("problem", F.lit("undeclared input"))
    writes = events.where("kind = 'Write'").join(outputs.select("task", "path"), ["task", "path"], "left_anti").withColumn("problem", F.lit("undeclared output"))
    return reads.unionByName(writes).select("task", "problem", "path").distinct()


def without_system_paths(events: DataFrame, prefixes: tuple[str, ...] = ("/usr/", "/lib/", "/lib64/", "/etc/", "/proc/", "/sys/", "/dev/")) -> DataFrame:
    return events.where(~reduce(lambda a, b: a | b, [F.col("path").startswith(p) for p in prefixes]))


def traced_files(before: DataFrame, after: DataFrame, started: Column) -> DataFrame:
    """before, after(path, mtime): output if new, newer than before or changed since the start, else input."""
    joined = after.select("path", F.col("mtime").alias("now")).join(before.select("path", F.col("mtime").alias("old")), "path", "left")
    return joined.select("path", F.when(F.col("old").isNull() | (F.col("now") > F.col("old")) | (F.col("now") >= started), "output").otherwise("input").alias("role"))


def allowed(requests: DataFrame, grants: DataFrame, as_of: Column) -> DataFrame:
    """requests(subject, roles, expires_at, permission), grants(role, permission): whether any role grants it, expired claims aside."""
    hit = requests.withColumn("role", F.explode_outer("roles")).join(grants.withColumn("granted", F.lit(True)), ["role", "permission"], "left")
    return hit.groupBy("subject", "permission").agg(F.bool_or(F.coalesce("granted", F.lit(False)) & (F.col("expires_at") > as_of)).alias("allowed"))


def compatible_environments(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, ["os", "arch", "toolchain_hash"])
