"""Small cases with known results."""

import datetime as dt
import hashlib
import itertools
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions import scalar as sc
from millrace.functions import text as tx
from millrace.operators import analytics as an
from millrace.operators import graph, joins, ordered, scheduling, store, tables
from millrace.plans import algebra, extension
from millrace.sources import readers, sinks
from millrace.streaming import rpc, state


def graph_of(spark, names, links, states=None, weights=None):
    n = list(names)
    nodes = spark.createDataFrame([(i, x, (states or {}).get(x, "Pending"), (weights or {}).get(x)) for i, x in enumerate(n)], "id long, name string, state string, weight long")
    return nodes, spark.createDataFrame([(n.index(a), n.index(b)) for a, b in links], "dependency long, dependent long")


def named(nodes, found):
    return {r.name for r in nodes.join(found, "id", "left_semi").collect()}


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_query_language(spark):
    nodes, edges = graph_of(spark, ["util", "backend", "app", "other"], [("util", "backend"), ("backend", "app")])
    run = lambda q: named(nodes, algebra.evaluate(q, nodes, edges))
    assert run("deps(app)") == {"app", "backend", "util"} == run("rdeps(//util)") == run("allpaths(app, util)") == run("somepath(app, util)")
    assert run("filter('back', deps(app))") == {"backend"} and run("nothing") == set() and run("//...") == {"util", "backend", "app", "other"}
    assert run("union(other, intersect(deps(app), rdeps(backend)))") == {"other", "app", "backend"}
    assert run("allpaths(util, app)") == set() == run("somepath(util, app)")
    for bad in ("deps(", "deps(a) + deps(b)", "", "allpaths(a)", "foo(a)", "a b", ")", "filter(,a)"):
        with pytest.raises(algebra.QueryError):
            algebra.parse(bad)


def test_rewrites():
    a, b = algebra.Target("a"), algebra.Target("b")
    assert algebra.optimise(algebra.parse("deps(deps(a))")) == algebra.Deps(a)
    assert algebra.optimise(algebra.parse("union(deps(a), deps(b))")) == algebra.Deps(algebra.Union(a, b))
    assert algebra.optimise(algebra.parse("allpaths(a, b)")) == algebra.Intersect(algebra.Deps(a), algebra.RDeps(b))
    assert algebra.optimise(algebra.parse("intersect(*, a)")) == a and algebra.optimise(algebra.parse("union(a, //...)")) == algebra.All()


def random_dag(rng, n):
    links = [(rng.randrange(i), i) for i in range(1, n) for _ in range(rng.randrange(3))]
    return links + links[: len(links) // 5]


def test_graph_against_models(spark):
    rng = random.Random(7)
    for n in (1, 12, 40):
        links = random_dag(rng, n)
        nodes = spark.createDataFrame([(i, f"n{i}", rng.randrange(1, 9)) for i in range(n)], "id long, name string, weight long")
        weight = {r.id: r.weight for r in nodes.collect()}
        edges = spark.createDataFrame(links, "dependency long, dependent long")
        below = {i: {a for a, b in links if b == i} for i in range(n)}
        reach = {i: {i}.union(*[set()]) for i in range(n)}
        level, cost = {}, {}
        for i in range(n):
            for a in below[i]:
                reach[i] |= reach[a]
            level[i] = max((level[a] + 1 for a in below[i]), default=0)
            cost[i] = weight[i] + max((cost[a] for a in below[i]), default=0)
        seeds = spark.createDataFrame([(n - 1,), (n // 2,), (10**6,), (None,)], "id long")
        want = reach[n - 1] | reach[n // 2] | {10**6}
        assert {r.id for r in graph.closure(edges, seeds).collect()} == want
        assert {r.id for r in graph.bfs_rounds(edges, seeds).collect()} == want
        assert {(r.id, r.level) for r in graph.bfs(edges, seeds).collect()} == {(r.id, r.level) for r in graph.bfs_rounds(edges, seeds).collect()}
        got = graph.longest_levels(nodes, edges, F.col("weight")).collect()
        assert {r.id: (r.level, r.cost) for r in got} == {i: (level[i], cost[i]) for i in range(n)}
        ids = nodes.select("id", F.col("weight").cast("double").alias("w"))
        slow = graph.longest_level_rounds(ids, edges.select(F.col("dependency").alias("src"), F.col("dependent").alias("dst"))).collect()
        assert sorted(map(tuple, slow)) == sorted(map(tuple, got))
        path = [r.id for r in graph.critical_path(nodes, edges).orderBy("step").collect()]
        assert sum(weight[i] for i in path) == max(cost.values()) and all(a in below[b] for a, b in zip(path, path[1:]))
        prints = {}
        for r in graph.merkle(nodes.withColumn("fingerprint", F.col("name")), edges).collect():
            prints[r.id] = r.fingerprint
        assert len(set(prints.values())) == n


def test_cycles_self_loops_and_ladders(spark):
    nodes = spark.createDataFrame([(i, str(i)) for i in range(40)], "id long, name string")
    ladder = spark.createDataFrame([(a, b) for i in range(18) for a in (2 * i, 2 * i + 1) for b in (2 * i + 2, 2 * i + 3)], "dependency long, dependent long")
    assert graph.closure(ladder, nodes.where("id = 37")).count() == 37
    looped = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (2, 4), (5, 99)], "dependency long, dependent long")
    assert {r.id for r in graph.closure(looped, nodes.where("id = 1")).collect()} == {1, 2}
    assert {r.id for r in graph.closure(looped, nodes.where("id = 1"), reflexive=False).collect()} == {1, 2}
    assert {(r.problem, r.dependency, r.dependent) for r in graph.validate(nodes, looped).collect()} == {("missing node", 5, 99), ("self dependency", 3, 3), ("cycle", 1, 2), ("cycle", 2, 1), ("cycle", 2, 4)}
    assert graph.longest_levels(nodes.where("id < 5"), looped.where("dependent < 5")).count() == 1
    none = spark.createDataFrame([], "dependency long, dependent long")
    assert graph.closure(none, nodes.limit(0)).count() == 0 and graph.longest_levels(nodes.limit(0), none).count() == 0 and graph.critical_path(nodes.limit(0).withColumn("weight", F.lit(1)), none).count() == 0


def test_levels_subgraph_and_cancelling(spark):
    nodes, edges = graph_of(spark, "01234", [("0", "2"), ("1", "2"), ("2", "3")])
    assert {(r.id, r.level) for r in graph.longest_levels(nodes, edges).collect()} == {(0, 0), (1, 0), (4, 0), (2, 1), (3, 2)}
    keep = spark.createDataFrame([(2, 0), (3, 1), (4, 2)], "id long, position long")
    sub, links = graph.subgraph(nodes, edges, keep)
    assert [tuple(r) for r in links.collect()] == [(0, 1)] and sub.count() == 3
    assert graph.subgraph(nodes, edges, spark.createDataFrame([(0, 0), (3, 1)], "id long, position long"))[1].count() == 0
    nodes, edges = graph_of(spark, "abcd", [("a", "b"), ("b", "c"), ("c", "d")], {"b": "Running"})
    assert named(nodes, graph.cancelled_by(nodes, edges, nodes.where("name = 'a'"))) == {"b", "c", "d"}
    for terminal in ("Failed", "Succeeded", "Cached", "Skipped"):
        nodes, edges = graph_of(spark, "abc", [("a", "b"), ("b", "c")], {"b": terminal})
        assert named(nodes, graph.cancelled_by(nodes, edges, nodes.where("name = 'a'"))) == set()
    for s, ready in (("Cached", True), ("Skipped", True), ("Pending", False)):
        nodes, edges = graph_of(spark, "ab", [("a", "b")], {"a": s})
        assert graph.readiness(nodes, edges).where("id = 1").first().ready is ready


def test_critical_paths(spark):
    nodes, edges = graph_of(spark, "abcde", [("a", "c"), ("c", "e"), ("b", "d"), ("d", "e")], weights=dict(a=1, b=1, c=1, d=100, e=1))
    assert [r.id for r in graph.critical_path(nodes, edges).orderBy("step").collect()] == [1, 3, 4]
    nodes, edges = graph_of(spark, "abc", [("a", "b"), ("a", "c"), ("b", "c")], weights=dict(a=1, b=3, c=1))
    got = graph.critical_path(nodes, edges, "last").orderBy("step").collect()
    assert [r.id for r in got] == [0, 1, 2] and got[-1].cost == 5
    nodes, edges = graph_of(spark, "ab", [], weights=dict(a=1, b=1))
    assert [r.id for r in graph.critical_path(nodes, edges).collect()] == [0]
    nodes, edges = graph_of(spark, "abc", [("a", "b"), ("b", "c")], weights=dict(a=500, b=1000, c=200))
    assert {r.id: r.critical_weight for r in graph.downstream_weights(nodes, edges).collect()} == {0: 1700, 1: 1200, 2: 200}


def test_schedules(spark):
    tasks = spark.createDataFrame([("r", f"t{d}", d) for d in (10, 8, 6, 4)], "run_id string, task_id string, duration long")
    assert {r.load for r in scheduling.pack_tasks(tasks, 2).collect()} == {14} and scheduling.pack_tasks(tasks, 0).select("agent").distinct().count() == 1
    plan = spark.createDataFrame([("g", "app", ["core", "utils"], 3.0, 256), ("g", "core", ["db"], 5.0, 256), ("g", "utils", [], 2.0, 256), ("g", "db", [], 10.0, 256)], "graph string, name string, deps array<string>, weight double, memory long")
    got = scheduling.list_schedule(plan).orderBy("position").collect()
    assert [r.name for r in got] == ["db", "utils", "core", "app"] and got[0].speedup == round(20 / 18, 2)
    assert [r.name for r in scheduling.build_order(plan).orderBy("position").collect()] == ["db", "core", "utils", "app"]
    cyclic = spark.createDataFrame([("g", "a", ["b"]), ("g", "b", ["a"]), ("g", "c", [])], "graph string, name string, deps array<string>")
    assert [r.name for r in scheduling.build_order(cyclic).orderBy("position").collect()] == ["c", "a", "b"]
    with pytest.raises(Exception, match="cycle"):
        scheduling.build_order(cyclic, strict=True).collect()
    assert one(spark, r=scheduling.desired_replicas(F.lit(10), F.lit(2.0), F.lit(1.0))).r == 20


def runs_table(spark, rows):
    return spark.createDataFrame(rows, "seq long, tasks_count long, cache_hits long, cache_misses long, failed_count long, bottleneck_tasks array<string>")


def test_run_analytics(spark):
    runs = runs_table(spark, [(1, 10, 8, 2, 0, ["heavy"]), (2, 10, 6, 4, 1, ["heavy", "link"])])
    assert an.cache_efficiency(runs).first()[0] == 70.0 and an.failure_rate(runs).first()[0] == 5.0 and an.time_saved(runs, 1000).first()[0] == 14000
    assert an.bottlenecks(runs, 1).first().task == "heavy" and an.run_summary(runs).first().bottlenecks == ["heavy", "link"]
    none = runs_table(spark, [])
    assert tuple(an.run_summary(none).first()) == (0, 0.0, 0.0, 0, [])
    empty = an.percentiles(none, "tasks_count").first()
    assert set(empty.asDict().values()) == {0, 0.0}
    ties = runs_table(spark, [(1, 1, 0, 0, 0, ["b", "a"]), (2, 1, 0, 0, 0, ["a", "b"])])
    assert [r.task for r in an.bottlenecks(ties).collect()] == ["b", "a"]
    assert an.health_report(spark.createDataFrame([], "level string"), spark.createDataFrame([], "status string")).first().overall_health == "Unknown"
    assert an.health_report(spark.createDataFrame([], "level string"), spark.createDataFrame([("Unknown",)], "status string")).first().overall_health == "Healthy"
    uses = spark.createDataFrame([("syn", "1.0.109", ["x"]), ("syn", "2.0.48", ["y"]), ("serde", "1.0.195", [])], "crate string, version string, features array<string>")
    assert [(r.crate, r.features) for r in an.duplicate_versions(uses).collect()] == [("syn", ["x", "y"])]
    profiles = spark.createDataFrame([("t", 1, ["-O0"], 10.0, 100), ("t", 2, ["-O3"], 5.0, 100), ("t", 3, ["-Os"], 5.0, 100), ("z", 1, ["-O1"], 0.0, 0)], "target string, seq long, flags array<string>, duration_sec double, binary_size_bytes long")
    assert {r.target: r.flags for r in an.best_profiles(profiles).collect()} == {"t": ["-O3"], "z": ["-O1"]}
    meta = spark.createDataFrame([("slow", 0, 5000, 0.0), ("fast", 3, 50, 0.0)], "name string, recent_failure_count int, avg_duration_ms long, complexity_score double")
    assert an.top_k(an.test_priority(meta), 1, F.desc("score")).first().name == "fast"


def test_histories(spark):
    h = spark.createDataFrame([(t, i, c == "T") for t, s in {"flip": "TFTF", "good": "TTTT", "one": "T", "tft": "TFT"}.items() for i, c in enumerate(s)], "test_id string, seq long, passed boolean")
    assert {r.test_id: (r.score, r.quarantined) for r in ordered.flakiness(h, 0.3).collect()} == {"flip": (1.0, True), "good": (0.0, False), "one": (0.0, False), "tft": (1.0, True)}
    assert {r.test_id for r in ordered.flaky_candidates(h).collect()} == {"flip", "tft"}
    assert {r.test_id for r in ordered.is_flaky(h).where("flaky").collect()} == {"flip", "tft"}
    touches = spark.createDataFrame(list(enumerate(["core", None, "utils", "cli", "core", "core", None, "utils"])), "seq long, package string")
    moves = ordered.transitions(touches)
    packages = spark.createDataFrame([("core",), ("utils",), ("cli",)], "package string")
    assert [r.package for r in ordered.warmup_candidates(moves, packages.where("package = 'core'"), packages).collect()] == ["utils"]
    samples = spark.createDataFrame([("t", 1, 10.0, 1000), ("t", 2, 12.0, 1000)], "task_name string, seq long, duration_sec double, source_bytes long")
    asked = spark.createDataFrame([("t", 2000), ("new", 2000)], "task_name string, source_bytes long")
    assert {r.task_name: r.predicted_sec for r in ordered.predict_duration(ordered.ema(samples), asked).collect()} == {"t": 21.2, "new": 2.0}
    rng = random.Random(3)
    series = [(k, i, rng.randrange(1000)) for k in range(5) for i in range(rng.randrange(1, 30))]
    df = spark.createDataFrame(series, "k long, seq long, duration_ms long")
    ema, mean = {k: 100 for k in range(5)}, {k: (0, 0) for k in range(5)}
    for k, _, d in series:
        ema[k] = (ema[k] * 8 + d * 2) // 10
        a, n = mean[k]
        mean[k] = ((a * n + d) // (n + 1), n + 1)
    assert {r.k: r.folded for r in ordered.integer_ema(df, "k").collect()} == ema
    assert {r.k: r.mean for r in ordered.running_mean(df, "k").collect()} == {k: a for k, (a, _) in mean.items()}
    at = spark.createDataFrame([("x", 0), ("x", 100), ("x", 100), ("x", 300)], "k string, ts_ms long")
    assert ordered.interval_ema(at, "k").first().interval_ms == pytest.approx(100 * 0.2 * 0.8 + 200 * 0.2)
    builds = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x"), ("a", 3, "y"), ("c", 4, "x")], "id string, seq long, status string")
    assert [(r.id, r.status) for r in ordered.last_n_builds(builds, 2).collect()] == [("c", "x"), ("b", "x")]


def test_logs(spark):
    def told(log):
        return one(spark, c=tx.error_category(F.lit(log)), f=tx.affected_files(F.lit(log)), k=tx.confidence(F.lit(log)), e=tx.error_code(F.lit(log)))

    r = told("error[E0425]: cannot find value\n --> src/main.rs:10:5")
    assert (r.c, r.f, r.k, r.e) == ("COMPILATION_ERROR", ["src/main.rs"], 0.95, "E0425")
    assert told("WARNING: DATA RACE").c == "CONCURRENCY_ERROR" and told("fatal error: runtime: out of memory").c == "MEMORY_LIMIT" and told("ModuleNotFoundError: x").c == "DEPENDENCY_ERROR"
    assert told("error[E0308]: mismatched types").e == "E0308" and told("fine").k == 0.5 and told("see package.json").f == ["package.js"]
    got = one(spark, a=tx.suggestions(F.lit("Rust"), F.lit("DEPENDENCY_ERROR")), b=tx.suggestions(F.lit("zig"), F.lit("TIMEOUT")), c=tx.suggestions(F.lit("x"), F.lit("y")))
    assert len(got.a) == 2 and got.b[0].startswith("Increase timeout") and got.c == list(tx.OTHER_ADVICE)
    one_hit = one(spark, s=tx.pr_risk(F.array(F.lit("Cargo.lock")), F.lit(0), F.lit(0)))
    assert one_hit.s == 0.35 and one(spark, s=tx.risk_severity(F.lit(0.35))).s == "LOW"


def test_paths_and_sources(spark):
    relevant = lambda p: one(spark, r=tx.build_relevant(F.lit(p))).r
    assert [relevant(p) for p in ("src/main.rs", "Cargo.toml", "README.md", ".gitignore", "target/debug/app", "src/rebuild.rs", "Dockerfile", "a/noext")] == [True, True, False, False, False, False, True, False]
    glob = lambda p: one(spark, r=tx.glob_matches(F.lit(p), ["src/**/*.rs", "Cargo.toml"], ["**/*.tmp", "src/legacy/**"])).r
    assert [glob(p) for p in ("src/main.rs", "src/a/b.rs", "Cargo.toml", "README.md", "src/legacy/old.rs")] == [True, True, True, False, False]
    same = one(spark, a=tx.interface_hash(F.lit("pub fn a() { 1 }\nfn x() {}")), b=tx.interface_hash(F.lit("  pub fn a() { 2 }")), c=tx.interface_hash(F.lit("pub fn a(x: u8) {")))
    assert same.a == same.b != same.c
    assert tx.strip_c("int x; // c\nint y;") == tx.strip_c("int x; /* c\n c */\n\n int y;") == "int x;\nint y;" and tx.strip_c('s = "// no \\" /*";') == 's = "// no \\" /*";'
    clean = one(spark, a=sc.sanitize_path(F.lit("../a/./b\\..//c/../../..")), b=sc.sanitize_path(F.lit("/x//y/")))
    assert (clean.a, clean.b) == ("", "x/y")
    assert [one(spark, h=sc.human_bytes(F.lit(n))).h for n in (0, 1023, 1536, 5 * 1024**2, 3 * 1024**5)] == ["0 B", "1023 B", "1.5 KB", "5.0 MB", "3072.0 TB"]
    assert [one(spark, d=sc.parse_duration(F.lit(t))).d for t in ("30m", "7d", "12", " 2h ")] == [1800, 604800, 12, 7200]
    assert [one(spark, d=sc.parse_size(F.lit(t))).d for t in ("500MB", "2g", "10kb", "7")] == [500 * 2**20, 2**31, 10240, 7]
    for f, t in ((sc.parse_duration, "5x"), (sc.parse_size, "MB")):
        with pytest.raises(Exception, match="invalid"):
            one(spark, d=f(F.lit(t)))


def test_joins(spark):
    owners = spark.createDataFrame([("core", "packages/core", 0), ("sub", "packages/core/sub", 1), ("web", "packages/web", 2)], "package string, dir string, ord int")
    paths = lambda *ps: spark.createDataFrame([(p,) for p in ps], "path string")
    assert [tuple(r) for r in joins.packages_for_paths(paths("packages/core/sub/x.rs", "packages/web/y"), owners).collect()] == [("sub", False), ("web", False)]
    assert [r.package for r in joins.packages_for_paths(paths("packages/core-other/x"), owners).collect()] == ["core", "sub", "web"]
    nodes, edges = graph_of(spark, ["core", "web"], [("core", "web")])
    files = spark.createDataFrame([("packages/core/src/index.ts",)], "file string")
    assert {r.id for r in joins.recommend_tasks(files, spark.createDataFrame([(0, "packages/core")], "package long, pattern string"), edges).collect()} == {0, 1}
    versions = spark.createDataFrame([("a", "1.2.3"), ("b", "1.2.4-rc1"), ("c", "1.10.0"), ("d", "x")], "package string, version string")
    fixes = spark.createDataFrame([(p, "1.2.4", "ID", "High") for p in "abcd"], "package string, fixed_version string, id string, severity string")
    assert {r.package for r in joins.vulnerable(versions, fixes).collect()} == {"a", "b"}
    uses = spark.createDataFrame([("calculate_tax", "t1"), ("calculate_tax", "t2"), ("format_user_name", "t3")], "symbol string, test string")
    assert [r.test for r in joins.impacted_tests(spark.createDataFrame([("calculate_tax",)], "symbol string"), uses).collect()] == ["t1", "t2"]
    workers = spark.createDataFrame([("w2", ["rust"], {"zone": "us-east-1"}, 1, True), ("w1", ["*"], {"zone": "us-east-1"}, 1, True), ("w0", ["rust"], {}, 0, False)], "id string, supported_toolchains array<string>, tags map<string,string>, active_jobs int, healthy boolean")
    assert joins.eligible_workers(workers, "rust", {"zone": "us-east-1"}).first().id == "w1"
    assert joins.eligible_workers(workers, "rust", {"zone": "eu-central-1"}).count() == 0


def test_substrings_and_prefixes_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab/") for _ in range(rng.randrange(n)))
    texts, patterns = [word(12) for _ in range(60)] + [None, ""], [word(7) for _ in range(80)] + [None, "", "b"]
    t, p = spark.createDataFrame([(x,) for x in texts], "file string"), spark.createDataFrame([(x,) for x in patterns], "pattern string")
    known = [x for x in texts if x is not None]
    assert sorted(r[0] for r in joins.occurring(t, p, "file", "pattern").collect()) == sorted({x for x in patterns if x is not None and any(x in y for y in known)})
    assert sorted(r[0] for r in joins.beginning(t, p, "file", "pattern").collect()) == sorted({x for x in patterns if x is not None and any(y.startswith(x) for y in known)})
    assert joins.occurring(t.limit(0), p, "file", "pattern").count() == 0 == joins.beginning(t, p.limit(0), "file", "pattern").count()


def test_percentiles_against_ranks(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(50)])) for _ in range(2000)] + [("lone", 7), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v long")
    got = {r.g: r for r in an.percentiles(df, "v", "g").collect()}
    assert set(got) == {"a", "b", None, "lone"}
    for g, r in [*got.items(), ("all", an.percentiles(df, "v").first())]:
        values = sorted(v for k, v in rows if v is not None and (g == "all" or k == g))
        assert [r.p50, r.p90, r.p95, r.p99] == [values[-(-len(values) * p // 100) - 1] for p in (50, 90, 95, 99)]
        assert (r.min, r.max) == (values[0], values[-1]) and abs(r.avg - sum(values) / len(values)) <= 0.005


def test_store(spark):
    rng = random.Random(11)
    for data in (b"", b"abc", rng.randbytes(9000), b"\0" * 3000):
        for least, mean, most in ((64, 128, 512), (16, 0, 64), (100, 1000, 100)):
            want, offset, n = [], 0, len(data)
            while offset < n or not want:
                rest = n - offset
                if rest <= least:
                    cut = rest
                else:
                    cut, limit = least, min(rest, most)
                    while cut < limit:
                        h = 0
                        for b in data[offset + cut : offset + cut + 8]:
                            h = (h * 0x5BD1E995 + b) % 2**64
                        if h % max(mean, 1) == 0:
                            break
                        cut += 1
                offset += cut
                want.append(offset)
                if not n:
                    break
            assert store.cut_points(data, least, mean, most) == want
    records = spark.createDataFrame([(1, 10, 5, "a"), (2, 20, 5, "a"), (3, 90, 5, "b"), (4, 95, 5, None)], "key long, stored_at long, size long, artifact string")
    objects = spark.createDataFrame([("a", 15, 100), ("b", 90, 100), ("orphan", 1, 7), ("fresh", 99, 7), ("x.tmp", 1, 3)], "name string, mtime long, size long")
    by_age = {(r.kind, r.name) for r in store.prune_plan(records, objects, 100, 50, None).collect()}
    assert by_age == {("record", "1"), ("record", "2"), ("object", "a"), ("object", "orphan"), ("temporary", "x.tmp")}
    full = store.prune_plan(records, objects, 100, None, 130).collect()
    assert sorted((r.kind, r.name) for r in full) == [("object", "a"), ("record", "1"), ("record", "2")]
    with pytest.raises(Exception, match="missing chunk"):
        store.reassemble(spark.createDataFrame([("p", ["h"])], "path string, hashes array<string>"), spark.createDataFrame([], "hash string, data binary")).collect()


def test_queue_and_workers(spark):
    q = spark.createDataFrame([("low", "rust", 1, 1.0, None), ("high", "rust", 10, 1.0, None), ("medium", "go", 5, 1.0, None), ("late", "rust", 99, 1.0, 5)], "task_id string, toolchain string, priority int, weight double, deadline long")
    assert scheduling.queue_order(q, F.lit(50), "rust").first().task_id == "high" and scheduling.queue_order(q, F.lit(50), "go").first().task_id == "medium"
    w = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 0, 0, 50)), ("b", dt.datetime(2024, 1, 1, 0, 0, 30))], "id string, last_heartbeat timestamp_ntz")
    now = F.lit(dt.datetime(2024, 1, 1, 0, 1, 0)).cast("timestamp_ntz")
    assert {r.id: r.healthy for r in state.healthy(w, now, "30 SECONDS").collect()} == {"a": True, "b": False}


def test_states(spark):
    events = spark.createDataFrame([("k", 0, "b"), ("k", 30, "a"), ("k", 49, "a"), ("k", 50, "c"), ("j", 7, "x")], "key string, ts_ms long, path string")
    assert {(r.key, r.window_start): r.paths for r in state.debounce(events, "key", 10).collect()} == {("k", 0): ["a", "b"], ("k", 50): ["c"], ("j", 7): ["x"]}
    calls = spark.createDataFrame([("k", 0.0, 1, 2), ("k", 0.0, 2, 2), ("k", 0.0, 3, 2), ("k", 10.0, 4, 5)], "key string, ts_s double, seq long, n long")
    assert [(r.allowed, r.left) for r in state.token_bucket(calls, "key", 5, 1).orderBy("seq").collect()] == [(True, 3.0), (True, 1.0), (False, 1.0), (True, 0.0)]
    c = spark.createDataFrame([("w", 1, True), ("w", 2, False), ("w", 3, False), ("w", 4, False), ("v", 1, False), ("v", 2, True)], "worker string, ts_s long, ok boolean")
    assert {r.worker: r.open for r in state.circuit_state(c, "worker", F.lit(10)).collect()} == {"w": True, "v": False}
    assert {r.worker: r.open for r in state.circuit_state(c, "worker", F.lit(20)).collect()} == {"w": False, "v": False}


def test_fan_in_is_written_in_runs(spark, tmp_path):
    nodes = spark.range(10_500).select("id", F.when(F.col("id") < 10_000, "Docker").otherwise("Rust").alias("ecosystem"))
    joins.fan_in(nodes, "Docker").write.parquet(f"{tmp_path}/out")
    found = spark.read.parquet(f"{tmp_path}/out")
    assert found.columns == ["dependency", "dependent"] and found.count() == 500 * 10_000
    each = found.groupBy("dependency").agg(F.count_distinct("dependent").alias("n"), F.min("dependent").alias("a"), F.max("dependent").alias("b"))
    assert sorted(map(tuple, each.collect())) == [(10_000 + k, 10_000, 0, 9_999) for k in range(500)]
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 1_500_000
    same = spark.createDataFrame([(7, "Rust"), (7, "Rust"), (1, "Docker"), (1, "Docker"), (2, None), (3, "Docker")], "id long, ecosystem string")
    assert sorted(map(tuple, joins.fan_in(same, "Docker").collect())) == [(7, 1)] * 4 + [(7, 3)] * 2
    assert joins.fan_in(same, "Go").count() == 0


def test_renderings(spark, tmp_path):
    nodes, edges = graph_of(spark, ["app", "core", "db", "lone"], [("core", "app"), ("db", "app"), ("db", "core")])
    assert [r.line for r in sinks.graph_tree(nodes, edges).collect()] == ["app", "  core", "    db", "  db", "lone"]
    timings = spark.createDataFrame([("a", 0, 0, 5), ("b", 1, 3, 2)], "task string, worker long, start_us long, duration_us long")
    sinks.write_events(sinks.chrome_trace(timings), f"{tmp_path}/trace")
    lines = [r.value for r in spark.read.text(f"{tmp_path}/trace").collect()]
    assert len(lines) == 5 and sum('"ph":"X"' in x for x in lines) == 2
    m = spark.createDataFrame([(1, "a", "-a"), (2, "b", "-b"), (3, "c", "-c")], "version long, up string, down string")
    assert sinks.migration_script(m, 1, 3).first().script == "b\nc" and sinks.migration_script(m, 3, 1).first().script == "-c\n-b"


def test_graph_tree_is_followed_to_its_end(spark):
    names = [f"n{k:02}" for k in range(68)]
    nodes, edges = graph_of(spark, names, list(zip(names, names[1:])))
    assert [r.line for r in sinks.graph_tree(nodes, edges).collect()] == ["  " * k + n for k, n in enumerate(reversed(names))]
    nodes, edges = graph_of(spark, ["top", "a", "b"], [("a", "top"), ("b", "a"), ("a", "b")])
    with pytest.raises(ValueError, match="cycle"):
        sinks.graph_tree(nodes, edges)


def test_graph_paths_sorts_and_writes_no_way_of_a_repeated_tree(spark, monkeypatch):
    names = [f"{side}{k}" for k in range(10) for side in "ab"]
    nodes, edges = graph_of(spark, names, [(f"{x}{k + 1}", f"{y}{k}") for k in range(9) for x in "ab" for y in "ab"])
    written = []
    monkeypatch.setattr(sinks, "settle", lambda df, *folders: written.append(tables.settle(df, *folders)) or written[-1])
    monkeypatch.setattr(sinks, "PART_ROWS", 300, raising=False)
    found = [r.path for r in sinks.graph_paths(nodes, edges, ">").collect()] if hasattr(sinks, "graph_paths") else [">".join(r.path) for r in sinks.graph_tree(nodes, edges).collect()]
    ways = [">".join(f"{c}{k}" for k, c in enumerate(w)) for n in range(1, 11) for w in itertools.product("ab", repeat=n)]
    assert found == sorted(ways, key=lambda w: w.split(">")) and len(found) == 2046
    assert sum(df.count() for df in written) < 500
    monkeypatch.setattr(sinks, "BRANCHES", 0)
    assert [">".join(r.path) for r in sinks.graph_tree(nodes, edges).collect()] == found


def test_readers(spark, tmp_path):
    folder = tmp_path / "records" / "ab"
    folder.mkdir(parents=True)
    (folder / "good.json").write_text('{"key": "k", "fingerprint": "f", "stored_at": 5, "size": 3}')
    (folder / "bad.json").write_text("{broken")
    (folder / "old%2Fkey.json").write_text('{"fingerprint": "g", "stored_at": 6, "size": 4}')
    got = {r.key: r.fingerprint for r in readers.cache_records(spark, str(tmp_path / "records")).collect()}
    assert got.get("k") == "f" and len(got) == 2
    listing = readers.store_listing(spark, str(tmp_path / "records"))
    assert "content" not in listing.columns and listing.count() == 3
    (tmp_path / "meta.json").write_text('{"workspace_members": ["a", "b"], "resolve": {"nodes": [{"id": "a", "deps": [{"pkg": "b", "dep_kinds": [{"kind": null}]}, {"pkg": "ext", "dep_kinds": [{"kind": null}]}]}, {"id": "b", "deps": [{"pkg": "a", "dep_kinds": [{"kind": "dev"}]}]}]}}')
    for dev, want in ((False, {("b", "a")}), (True, {("b", "a")})):  # the second edge would close a cycle
        assert {tuple(r) for r in readers.cargo_metadata(spark, str(tmp_path / "meta.json"), dev)[1].collect()} == want
    (tmp_path / "cc.json").write_text('[{"directory": "/x", "file": "/x/b.c", "arguments": ["cc"]}, {"directory": "/x", "file": "/x/a.c", "command": "cc a.c"}]')
    assert readers.find_command(readers.compilation_database(spark, str(tmp_path / "cc.json")), "a.c").first().command == "cc a.c"
    with pytest.raises(Exception, match="without a name"):
        readers.rules(spark.createDataFrame([("f", "rule(\n cmd = 'x'\n)")], "path string, source string")).collect()
    assert sc.LANGUAGES["rs"] == "Rust" and isinstance(pd.__version__, str)


def test_streams(spark, tmp_path):
    spark.createDataFrame([("k", 0, "b"), ("k", 30, "a"), ("j", 7, "x")], "key string, ts_ms long, path string").coalesce(1).write.parquet(f"{tmp_path}/in")
    schema = "key string, ts_ms long, path string"
    source = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = state.progress_stream(source().withColumnRenamed("key", "state")).writeStream.outputMode("complete").format("memory").queryName("progress").option("checkpointLocation", f"{tmp_path}/c1").start()
    q.processAllAvailable()
    q.stop()
    assert {r.state: r.tasks for r in spark.table("progress").collect()} == {"k": 2, "j": 1}
    q = source().writeStream.foreachBatch(state.upsert_sink(f"{tmp_path}/sink", "key", "ts_ms")).option("checkpointLocation", f"{tmp_path}/c2").start()
    q.processAllAvailable()
    q.stop()
    assert {r.key: r.path for r in spark.read.parquet(f"{tmp_path}/sink/v0").collect()} == {"k": "a", "j": "x"}


def test_streaming_debounce(spark, tmp_path):
    spark.createDataFrame([("k", 0, "b"), ("k", 30, "a"), ("k", 60, "c"), ("j", 7, "x")], "key string, ts_ms long, path string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("key string, ts_ms long, path string").parquet(f"{tmp_path}/in")
    q = state.debounce_stream(stream).writeStream.outputMode("append").format("memory").queryName("debounced").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):  # timers keep the query busy, so it never says that all is processed
            if spark.table("debounced").count() >= 3 or q.awaitTermination(1):
                break
        assert {(r.key, r.window_start): r.paths for r in spark.table("debounced").collect()} == {("k", 0): ["a", "b"], ("k", 60): ["c"], ("j", 7): ["x"]}
    finally:
        q.stop()


def rows_of(spark, stream, name, folder, enough):
    """Rows that a stream has written once there are enough; timers keep a query busy, so it never says that all is processed."""
    q = stream.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"{folder}/{name}").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            if spark.table(name).count() >= enough or q.awaitTermination(1):
                break
        return spark.table(name).collect()
    finally:
        q.stop()


def test_streaming_limits_breakers_and_health(spark, tmp_path):
    calls = spark.createDataFrame([("k", 0.0, 1, 2.0), ("k", 0.0, 2, 2.0), ("k", 0.0, 3, 2.0), ("k", 10.0, 4, 5.0), ("j", 3.0, 5, 6.0)], "key string, ts_s double, seq long, n double")
    for k, part in enumerate((calls.where("seq < 3"), calls.where("seq >= 3"))):  # a level lives on from one batch to the next
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/calls")
    source = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/calls")
    got = rows_of(spark, state.token_bucket_stream(source, 5, 1), "allowed", tmp_path, 5)
    assert sorted(map(tuple, got)) == sorted(map(tuple, state.token_bucket(calls, "key", 5, 1).collect())) and len(got) == 5
    tries = spark.createDataFrame([("w", 1.0, True), ("w", 2.0, False), ("w", 3.0, False), ("v", 1.0, False), ("v", 2.0, True)], "key string, ts_s double, ok boolean")
    tries.coalesce(1).write.parquet(f"{tmp_path}/tries")
    source = spark.readStream.schema(tries.schema).parquet(f"{tmp_path}/tries")
    got = rows_of(spark, state.circuit_stream(source, failures=2, seconds=1), "breakers", tmp_path, 3)
    assert sorted(map(tuple, got)) == [("v", 0, False), ("w", 2, False), ("w", 2, True)]
    got = rows_of(spark, state.healthy_stream(source.select("key"), seconds=1), "health", tmp_path, 4)
    assert sorted(map(tuple, got)) == [("v", False), ("v", True), ("w", False), ("w", True)]


def test_token_bucket_of_a_long_key(spark):
    n = 200_000
    calls = spark.range(n).select(F.lit("k").alias("key"), (F.col("id") / 1000).alias("ts_s"), F.col("id").alias("seq"), F.lit(1).alias("n"))
    assert state.token_bucket(calls, "key", 10, 100).where("allowed").count() == 10 + (n - 1) // 10


def test_long_chain_by_rounds_of_its_length_in_bits(spark):
    n = 1000
    nodes = spark.range(n).select("id", F.col("id").cast("string").alias("name"), F.lit(2).alias("weight"))
    edges = spark.range(n - 1).select(F.col("id").alias("dependency"), (F.col("id") + 1).alias("dependent"))
    path = graph.critical_path(nodes, edges).orderBy("step").collect()
    assert [r.id for r in path] == list(range(n)) and path[-1].cost == 2 * n
    way = graph.some_path(edges, nodes.where(f"id = {n - 1}"), nodes.where("id = 3")).orderBy("step").collect()
    assert [(r.step, r.id) for r in way] == [(k, n - 1 - k) for k in range(n - 3)]
    looped = edges.union(spark.createDataFrame([(9, 4)], edges.schema))
    with pytest.raises(ValueError, match="cycle"):
        graph.critical_path(nodes, looped)


def test_rounds_equal_the_walk(spark):
    rng = random.Random(8)
    links = sorted({(a, b) for _ in range(60) for a, b in [sorted(rng.sample(range(30), 2))]})
    nodes = spark.createDataFrame([(i, f"n{i}", i % 5) for i in range(30)], "id long, name string, weight long")
    edges = spark.createDataFrame(links, "dependency long, dependent long")
    for reverse in (False, True):
        rows = [sorted(map(tuple, graph.longest_levels(nodes, edges, F.col("weight"), reverse, small).collect())) for small in (0, 1000)]
        assert rows[0] == rows[1]
    assert sorted(map(tuple, graph.bfs(edges, nodes.where("id = 29"), small=0).collect())) == sorted(map(tuple, graph.bfs(edges, nodes.where("id = 29")).collect()))
    prints: dict = {}
    for i in range(30):
        below = sorted(prints[a] for a, b in links if b == i)
        framed = f"{len(f'n{i}')}:n{i}" + "".join(f"{len(p)}:{p}" for p in below)
        prints[i] = hashlib.sha256(framed.encode()).hexdigest()
    for small in (0, 1000):
        assert {r.id: r.fingerprint for r in graph.merkle(nodes.withColumn("fingerprint", F.col("name")), edges, small).collect()} == prints


def test_task_order_in_passes(spark):
    tasks = [("z", ["a"]), ("a", []), ("m", ["z"]), ("k", ["m", "q"]), ("q", [])]
    df = spark.createDataFrame([(1, n, d, k) for k, (n, d) in enumerate(tasks)], "graph long, name string, deps array<string>, position long")
    assert [r.name for r in scheduling.task_order(df).orderBy("position").collect()] == ["a", "q", "z", "m", "k"]
    for bad in (df.where("name <> 'a'"), df.withColumn("deps", F.array(F.when(F.col("name") == "z", "m").when(F.col("name") == "m", "z").otherwise("a")))):
        with pytest.raises(Exception, match="unknown|cycle"):
            scheduling.task_order(bad).collect()


def test_schedule_against_a_plain_model(spark):
    rng = random.Random(4)
    for workers, room in ((1, 500), (3, 1000), (8, 10_000)):
        names = [f"t{i:02}" for i in range(20)]
        rows = [(1, n, sorted(rng.sample(names[:i], min(i, rng.randrange(3)))), float(rng.randrange(1, 9)), rng.choice([100, 400, 900])) for i, n in enumerate(names)]
        got = scheduling.list_schedule(spark.createDataFrame(rows, "graph long, name string, deps array<string>, weight double, memory long"), workers, room).orderBy("position").collect()
        done, left, want, batch = set(), {r[1]: r for r in rows}, [], 0
        while left:
            picked, used = [], 0
            for n in sorted((n for n, r in left.items() if set(r[2]) <= done), key=lambda n: (-left[n][3], n)):
                if len(picked) < workers and (not picked or used + left[n][4] <= room):
                    picked.append(n)
                    used += left[n][4]
            want += [(n, batch) for n in picked]
            done |= set(picked)
            left = {n: r for n, r in left.items() if n not in done}
            batch += 1
        assert [(r.name, r.batch) for r in got] == want


def test_pipeline_cycles_are_errors(spark):
    tasks = spark.createDataFrame([("p", "a", ["b"]), ("p", "b", ["a"])], "package string, task string, depends_on array<string>")
    with pytest.raises(ValueError, match="cycle"):
        joins.pipeline_edges(tasks, spark.createDataFrame([], "dependency string, dependent string"))


def test_names_folders_and_rules(spark):
    ok = {r.n: r.ok for r in spark.createDataFrame([("a\\b",), ("a.b",), ("a..b",), ("a;b",), ("a b",)], "n string").select("n", sc.valid_filename(F.col("n")).alias("ok")).collect()}
    assert ok == {"a\\b": False, "a.b": True, "a..b": False, "a;b": False, "a b": False}
    entries = spark.createDataFrame([("/a/f", False, 1), ("/a/d", True, 0), ("/a/d/g", False, 2)], "path string, is_dir boolean, size long")
    assert {r.name for r in readers.list_directory(entries, "/a").collect()} == {"f", "d"}
    with pytest.raises(NotADirectoryError):
        readers.list_directory(entries, "/a/f")
    with pytest.raises(FileNotFoundError):
        readers.list_directory(entries, "/b")
    source = "# x\ncc_binary(\n  name = 'one',\n  args = [-c, \"a b\"],\n  env = {\"A\": \"1\", 'B': '2:3'},\n),\nother(\n  name = 'no',\n)\ngenrule(\n  name = \"two\",\n  cmd = \"cp x\",\n  deps = [':one'],\n"
    one, two = readers.rules(spark.createDataFrame([("f", source), ("g", ""), ("h", None)], "path string, source string")).collect()
    assert (one.name, one.command, one.args, one.env) == ("one", "echo", ["-c", "a b"], {"A": "1", "B": "2:3"})
    assert (two.name, two.command, two.depends_on, two.env) == ("two", "cp x", [":one"], {})


def test_whole_sources(spark):
    texts = ["import a\nimport b.c\n", "x = 1 # y\n\t# z\n", "a /* b */ c // d\n'//' \"/*\"", "*/ odd /* open", "", None, "  lead\r\ntrail  \r\n", "use x::y;\nuse crate::z;"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    rows = {r.i: r for r in df.select("i", tx.strip_python_comments(F.col("t")).alias("py"), tx.semantic_hash(F.lit("f.cc"), F.col("t")).alias("cc"), tx.inferred_imports(F.lit("a/b.rs"), F.col("t")).alias("rs"), tx.inferred_imports(F.lit("b.py"), F.col("t")).alias("imports"), tx.inferred_imports(F.lit("b.md"), F.col("t")).alias("md")).collect()}

    def bare_c(s):
        out, k = "", 0
        while k < len(s):
            if s.startswith("//", k):
                k = (s.find("\n", k) + len(s) + 1) % (len(s) + 1) if s.find("\n", k) < 0 else s.find("\n", k)
            elif s.startswith("/*", k):
                k = s.find("*/", k + 2) + 2 if s.find("*/", k + 2) >= 0 else len(s)
            elif s[k] in "\"'`":
                end = k + 1
                while end < len(s) and s[end] != s[k]:
                    end += 2 if s[end] == "\\" else 1
                out, k = out + s[k : end + 1], end + 1
            else:
                out, k = out + s[k], k + 1
        return "\n".join(x.strip() for x in out.split("\n") if x.strip())

    for i, t in enumerate(texts):
        if t is not None:
            assert rows[i].py == "\n".join(x.split("#")[0].strip() for x in t.split("\n") if x.strip() and not x.strip().startswith("#"))
            assert rows[i].cc == hashlib.sha256(bare_c(t).encode()).hexdigest()
            assert rows[i].md == []
    assert rows[0].imports == ["a", "b"] and rows[7].rs == ["x"]


def test_paths_are_cleaned_like_a_stack(spark):
    rng = random.Random(6)
    paths = ["/".join(rng.choice(["a", "b", ".", "..", "", "c.d"]) for _ in range(rng.randrange(8))) for _ in range(200)]
    got = {r.p: r.s for r in spark.createDataFrame([(p,) for p in set(paths)], "p string").select("p", sc.sanitize_path(F.col("p")).alias("s")).collect()}
    for p in paths:
        stack: list[str] = []
        for part in p.replace("\\", "/").split("/"):
            if part == "..":
                stack[-1:] = []
            elif part not in ("", "."):
                stack.append(part)
        assert got[p] == "/".join(stack), p


def test_extension_points(spark):
    extension.register_script(spark, "shout", lambda s: s.str.upper())
    assert spark.sql("SELECT shout('ab') AS x").first().x == "AB"
    found = extension.scan(spark.range(1), [lambda p: p.select(F.lit("p").alias("package"), F.lit("1").alias("id"), F.lit("Low").alias("severity"))], "Medium")
    assert found.count() == 0


def test_rpc_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [
        '{"id": "1", "method": "ping"}', '{"id": "2", "method": "record_run", "params": {"run_id": "r", "tasks_count": 4, "cache_hits": 3, "cache_misses": 1}}', "{broken", "",
        '{"id": "3", "method": "analytics_summary"}', '{"id": "4", "method": "nothing"}', '{"id": "5", "method": "doctor_advice", "params": {"missing_toolchains": ["go"], "installed_count": 1, "total_count": 2}}',
    ]
    (folder / "a.txt").write_text("\n".join(lines))
    query = spark.readStream.text(str(folder)).writeStream.foreachBatch(rpc.rpc_step(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = [json.loads(r.response) for r in spark.read.json(str(tmp_path / "out" / "responses")).collect()]
    by_id = {r.get("id"): r for r in got}
    assert by_id["1"]["result"] == {"status": "pong"} and by_id["2"]["result"] == {"status": "recorded"}
    assert by_id["3"]["result"]["total_runs"] == 1 and by_id["3"]["result"]["cache_efficiency"] == 75.0
    assert by_id["4"]["error"]["code"] == -32601 and [r["error"]["code"] for r in got if "error" in r and r.get("id") is None] == [-32700]
    assert len(by_id["5"]["result"]["tips"]) == 4 and len(got) == 6


def test_graph_joins_broadcast_only_what_was_counted(spark, monkeypatch):
    """Sizes of files and shuffles say little about rows: no join of a graph operator may be left to them."""
    plans, write = [], tables.settle

    def noted(df, *folders):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, *folders)

    for module in (graph, joins):
        monkeypatch.setattr(module, "settle", noted)
    monkeypatch.setattr(tables, "FEW_ROWS", -1)
    nodes, edges = graph_of(spark, ["a", "b", "c", "d"], [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c")])
    named = nodes.select("id", F.sha2("name", 256).alias("fingerprint"))
    weighted = nodes.withColumn("weight", F.lit(1))
    assert graph.bfs_rounds(edges, nodes.where("name = 'a'").select("id")).count() == 4
    assert sorted(r.level for r in graph.longest_levels(nodes, edges, small=0).collect()) == [0, 1, 1, 2]
    assert graph.merkle(named, edges, small=0).join(graph.merkle(named, edges), ["id", "fingerprint"]).count() == 4
    assert graph.critical_path(weighted, edges, small=0).count() == 3
    valid = graph.validate(nodes, edges)
    assert valid.count() == 0
    plans.append(valid._jdf.queryExecution().executedPlan().toString())
    tasks = nodes.select(F.col("name").alias("package"), F.lit("build").alias("task"), F.array(F.lit("^build")).alias("depends_on"))
    by_name = spark.createDataFrame([("d", "b"), ("b", "a")], "dependency string, dependent string")
    assert joins.pipeline_edges(tasks, by_name).count() == 2
    assert not [p for p in plans if "BroadcastExchange" in p and "_before" not in p]  # the offsets of ranges are one row a range
