"""Log classification, import inference, path filters: column expressions that stay inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Categories in the order in which they are tried, with their patterns (case ignored).
CATEGORY_PATTERNS = {
    "CONCURRENCY_ERROR": (
        r"WARNING: DATA RACE", r"all goroutines are asleep - deadlock", r"fatal error: concurrent map", r"panic: sync: negative WaitGroup counter",
        r"panic: send on closed channel", r"panic: close of closed channel",
    ),
    "COMPILATION_ERROR": (
        r"error\[E\d+\]:", r"cannot borrow .* as mutable", r"value borrowed here after move", r"borrowed value does not live long enough", r"syntax error",
        r"cannot find symbol", r"undefined reference to", r"SyntaxError:", r"TypeError:", r"IndentationError:", r"NameError:", r"fatal error: .* file not found",
        r"CS\d{4}:", r"TS\d{4}:", r"error: unknown type name", r"cannot use .* as .* in assignment",
    ),
    "DEPENDENCY_ERROR": (
        r"could not resolve dependency", r"package .* not found", r"ModuleNotFoundError:", r"ImportError:", r"cannot find module", r"failed to fetch",
        r"unresolved import", r"NuGet package .* not found", r"go: .* no required module",
    ),
    "MEMORY_LIMIT": (
        r"out of memory", r"fatal error: runtime: out of memory", r"JavaScript heap out of memory", r"Killed.*OOM", r"MemoryError", r"std::bad_alloc", r"STATUS_STACK_BUFFER_OVERRUN",
    ),
    "TIMEOUT": (r"timed out after", r"command timeout exceeded", r"deadline exceeded", r"SIGXCPU", r"Execution timed out"),
    "PERMISSION_ERROR": (r"permission denied", r"EACCES", r"Access is denied", r"operation not permitted"),
    "TEST_FAILURE": (r"FAILED \(failures=\d+\)", r"FAIL: Test", r"test result: FAILED", r"AssertionError", r"Expected .* but got"),
}
# Advice by toolchain and category, then by category alone, then for anything else.
TOOLCHAIN_ADVICE = {
    ("rust", "COMPILATION_ERROR"): ("Run `cargo check` locally with `RUST_BACKTRACE=1`.", "Review borrow checker lifetime and trait bounds.", "Use `rustc --explain <ERROR_CODE>` for detailed diagnostics."),
    ("rust", "DEPENDENCY_ERROR"): ("Check `Cargo.toml` and run `cargo update -p <crate>`.", "Verify workspace dependencies resolver = 2."),
    ("rust", "CONCURRENCY_ERROR"): ("Verify sync primitives (Arc, Mutex, RwLock, channels).", "Ensure types sent across threads implement Send and Sync."),
    ("go", "COMPILATION_ERROR"): ("Run `go vet ./...` to detect structural errors.", "Verify type signatures and imported package identifiers."),
    ("go", "DEPENDENCY_ERROR"): ("Run `go mod tidy` or `go mod download`.", "Verify module path in `go.mod` matches remote repository."),
    ("go", "CONCURRENCY_ERROR"): ("Run `go test -race ./...` to pinpoint concurrent data races.", "Check goroutine channel lifecycles and sync.WaitGroup counters."),
    ("typescript", "COMPILATION_ERROR"): ("Run `tsc --noEmit` to verify type definitions.", "Check `tsconfig.json` compilerOptions strict settings."),
    ("typescript", "DEPENDENCY_ERROR"): ("Run `npm install` or `pnpm install` to sync lockfile.", "Verify `@types/*` declarations are installed in devDependencies."),
    ("python", "COMPILATION_ERROR"): ("Run `ruff check .` and `mypy .` for static type and lint checking.", "Verify syntax compatibility for Python 3.10+."),
    ("python", "DEPENDENCY_ERROR"): ("Verify virtual environment is activated.", "Run `uv pip install -r requirements.txt` or `pip install -e .`."),
    ("cc", "COMPILATION_ERROR"): ("Verify include paths and header file availability.", "Check compile_commands.json configuration."),
    ("docker", "COMPILATION_ERROR"): ("Verify Dockerfile base image availability.", "Check multi-stage build target names and file copy paths."),
}
CATEGORY_ADVICE = {
    "CONCURRENCY_ERROR": ("Inspect thread/goroutine synchronization primitives and race conditions.",),
    "COMPILATION_ERROR": ("Check source syntax for compiler errors.", "Run local compiler diagnostic."),
    "DEPENDENCY_ERROR": ("Verify package manifest and lockfile integrity.", "Ensure package registry connectivity."),
    "MEMORY_LIMIT": ("Increase memory limit in {manifest}.", "Reduce build parallelism with --jobs."),
    "TIMEOUT": ("Increase timeout_ms in task configuration.", "Inspect slow test suites or deadlocks."),
    "PERMISSION_ERROR": ("Check file permissions in build output directories.",),
    "TEST_FAILURE": ("Run failing test locally in isolation with verbose logging.",),
}
OTHER_ADVICE = ("Inspect full execution logs with --verbose.",)
# What counts as a file and as an error code in a log.
FILE_PATTERN = r"([a-zA-Z0-9_\-./\\]+\.(?:rs|go|ts|js|py|cpp|c|h|hpp|java|cs|swift|dart|zig|dockerfile|toml|json))"
CODE_PATTERN = r"error\[(E\d+)\]|CS(\d{4})|TS(\d{4})"


def error_category(log: Column) -> Column:
    """The first category one of whose patterns occurs; UNKNOWN_ERROR for others."""
    chain = F
    for category, patterns in CATEGORY_PATTERNS.items():
        chain = chain.when(log.rlike("(?i)(?:" + "|".join(patterns) + ")"), category)
    return chain.otherwise("UNKNOWN_ERROR")


def error_code(log: Column) -> Column:
    """The first error code in the text; of CS and TS codes only the digits."""
    group = lambda k: F.nullif(F.regexp_extract(log, CODE_PATTERN, k), F.lit(""))
    return F.coalesce(group(1), group(2), group(3))


def confidence(log: Column) -> Column:
    return F.when(error_category(log) == "UNKNOWN_ERROR", 0.5).when(error_code(log).isNotNull(), 0.95).otherwise(0.88)


def affected_files(log: Column) -> Column:
    """The first eight file names in sorted order."""
    return F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(log, F.lit("(?i)" + FILE_PATTERN), F.lit(1)))), 1, 8)


def suggestions(toolchain: Column, category: Column, manifest: str = "the project manifest") -> Column:
    """Advice for a toolchain and category, else for the category, else in general; manifest names the tool's own configuration file."""
    told = lambda x: F.array(*[F.lit(s.format(manifest=manifest) if "{manifest}" in s else s) for s in x])
    chain = F
    for (tool, cat), advice in TOOLCHAIN_ADVICE.items():
        chain = chain.when((F.lower(toolchain) == tool) & (category == cat), told(advice))
    for cat, advice in CATEGORY_ADVICE.items():
        chain = chain.when(category == cat, told(advice))
    return chain.otherwise(told(OTHER_ADVICE))


def diagnosis(toolchain: Column, log: Column, exit_code: Column) -> Column:
    """Category of a compiler's output by plain substrings, toolchain by toolchain."""
    low = F.lower(log)
    has = lambda *xs: _any(log, xs)
    has_low = lambda *xs: _any(low, xs)
    rust = (toolchain == "rust") | has_low("rustc", "cargo")
    return (
        F.when(rust & has("cannot find", "E0425", "E0433"), "UNDEFINED_SYMBOL_ERROR").when(rust & has("mismatched types", "E0308"), "TYPE_MISMATCH_ERROR")
        .when(rust & has("borrow", "E0502", "E0382"), "BORROW_CHECKER_ERROR")
        .when((toolchain.isin("ts", "node") | has_low("tsc", "typescript")) & has_low("cannot find module", "ts2307"), "MISSING_MODULE_ERROR")
        .when(((toolchain == "go") | has_low("go build")) & has_low("undefined:"), "GO_UNDEFINED_IDENTIFIER")
        .when((toolchain.isin("cc", "cpp") | has_low("clang", "gcc")) & has_low("fatal error:", "no such file or directory"), "MISSING_HEADER_ERROR")
        .when(exit_code != 0, "BUILD_FAILURE").otherwise("UNKNOWN")
    )


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | text.contains(p)
    return found


#: Lock files and manifests whose change is risky; a tool adds its own.
CRITICAL_FILES = ("Cargo.lock", "package-lock.json", "pnpm-lock.yaml", "CMakeLists.txt")


def pr_risk(files: Column, added: Column, deleted: Column, own_manifests: tuple[str, ...] = ()) -> Column:
    """Risk from 0 to 1: critical files, churn, breadth."""
    names = F.array(*[F.lit(x) for x in (*CRITICAL_FILES, *own_manifests)])
    critical = F.aggregate(files, F.lit(0), lambda n, f: n + F.size(F.filter(names, lambda c: f.endswith(c))))
    churn = added + deleted
    score = critical * 0.35 + F.when(churn > 1000, 0.30).when(churn > 300, 0.15).otherwise(0.0) + F.when(F.size(files) > 15, 0.25).otherwise(0.0)
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6)


def risk_severity(score: Column) -> Column:
    return F.when(score > 0.65, "HIGH").when(score > 0.35, "MEDIUM").otherwise("LOW")


def missing_import_fix(source: Column, message: Column) -> Column:
    """The source with the import that the message misses in front."""
    lost = message.contains("cannot find") | message.contains("E0433")
    return F.when(lost & message.contains("PathBuf"), F.concat(F.lit("use std::path::PathBuf;\n"), source)).when(lost & message.contains("HashMap"), F.concat(F.lit("use std::collections::HashMap;\n"), source)).otherwise(source)


def prewarm_targets(path: Column, backend_prefix: str = "backend") -> Column:
    """Targets to warm up for an edited file; the tool's own backends carry its prefix."""
    return (
        F.when(path.endswith(".rs"), F.array(F.lit("cargo-check"), F.lit(f"{backend_prefix}-rust"))).when(path.endswith(".ts") | path.endswith(".js"), F.array(F.lit("tsc-check"), F.lit(f"{backend_prefix}-ts")))
        .when(path.endswith(".go"), F.array(F.lit("go-vet"))).otherwise(F.array().cast("array<string>"))
    )


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _lines(source: Column) -> Column:
    return F.transform(F.split(source, r"\r?\n"), lambda x: _bare(x))


def _distinct(found: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull() & (x != ""))))


def rust_imports(source: Column) -> Column:
    """Crates that use and extern lines name, those of the language itself left out."""

    def crate(line: Column) -> Column:
        used = F.trim(F.regexp_replace(F.split(F.regexp_replace(line, r"^(?:pub )*(?:use )*", ""), "::").getItem(0), ";+$", ""))
        extern = F.trim(F.regexp_replace(F.regexp_replace(line, r"^(?:extern crate )+", ""), ";+$", ""))
        return F.when(line.rlike(r"^(?:pub )?use "), F.when(~used.isin("crate", "self", "super", "std", "core", "alloc"), used)).when(line.startswith("extern crate "), F.when(extern != "std", extern))

    return _distinct(F.transform(_lines(source), lambda x: crate(x)))


def ts_imports(source: Column) -> Column:
    """Packages of import, export and require lines; relative and absolute paths left out, a required path kept whole."""
    quotes = lambda x: F.regexp_replace(F.regexp_replace(x, "^'+|'+$", ""), '^"+|"+$', "")

    def package(line: Column) -> Column:
        name = quotes(F.trim(F.regexp_replace(F.trim(F.regexp_extract(line, r"from (.*)$", 1)), ";+$", "")))
        parts = F.split(name, "/")
        named = F.when(name.startswith("@"), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(F.get(parts, F.lit(0)))
        required = quotes(F.trim(F.regexp_extract(line, r"require\(([^)]*)\)", 1)))
        return F.when(line.rlike(r"^(?:import|export) "), F.when(line.contains("from ") & ~name.rlike(r"^[./]"), named)).when(line.rlike(r"require\([^)]*\)"), F.when(~required.rlike(r"^[./]"), required))

    return _distinct(F.transform(_lines(source), package))


def python_imports(source: Column) -> Column:
    """Top modules of import and from lines."""
    top = lambda x: F.split(F.get(F.split(F.trim(x), r"\s+"), F.lit(0)), r"\.").getItem(0)

    def modules(line: Column) -> Column:
        return (
            F.when(line.startswith("import "), F.transform(F.split(F.regexp_extract(line, r"^import (.*)$", 1), ","), lambda x: top(x)))
            .when(line.startswith("from ") & line.contains(" import "), F.array(top(F.regexp_extract(line, r"^from (.*?) import ", 1)))).otherwise(F.array().cast("array<string>"))
        )

    return _distinct(F.flatten(F.transform(_lines(source), modules)))


def go_imports(source: Column) -> Column:
    """Paths of single imports and of import blocks."""
    bare = lambda x: _bare(F.regexp_replace(_bare(x), '^"+|"+$', ""))
    blocks = F.regexp_extract_all(source, F.lit(r"(?ms)^[ \t]*import \([ \t]*\r?\n(.*?)(?:^[ \t]*\)[ \t]*\r?$|\z)"), F.lit(1))
    inside = F.flatten(F.transform(blocks, lambda b: F.transform(F.split(b, r"\r?\n"), lambda x: bare(x))))
    rest = F.regexp_replace(source, r"(?ms)^[ \t]*import \([ \t]*\r?\n.*?(?:^[ \t]*\)[ \t]*\r?$|\z)", "")
    single = F.transform(F.filter(_lines(rest), lambda x: x.startswith("import ")), lambda x: bare(F.regexp_replace(x, "^import ", "")))
    return _distinct(F.concat(inside, single))


def extension(path: Column) -> Column:
    """Text after the last dot of the file name, empty if there is none or the name only begins with it."""
    return F.regexp_extract(path, r"[^/]\.([^./]*)$", 1)


def inferred_imports(path: Column, source: Column) -> Column:
    ext = extension(path)
    return F.when(ext == "rs", rust_imports(source)).when(ext.isin("ts", "tsx", "js", "jsx"), ts_imports(source)).when(ext == "py", python_imports(source)).when(ext == "go", go_imports(source)).otherwise(F.array().cast("array<string>"))


# What a build does not depend on.
IRRELEVANT_PARTS = (".git", ".github", ".gitlab", ".vscode", ".idea", "target", "node_modules", ".venv", "__pycache__", "dist", "build")
IRRELEVANT_NAMES = (".gitignore", ".gitattributes", ".editorconfig", ".prettier", ".eslint", "license", "contributing", "changelog")
IRRELEVANT_EXTENSIONS = ("md", "markdown", "txt", "rst", "png", "jpg", "jpeg", "gif", "svg", "ico")
BARE_NAMES = ("dockerfile", "makefile", "gemfile", "rakefile")
LOCKFILES = ("Cargo.lock", "pnpm-lock.yaml", "yarn.lock", "package-lock.json", "go.sum", "poetry.lock")
ECOSYSTEM_EXTENSIONS = {
    "Rust": ("rs",), "TypeScript": ("ts", "tsx", "js", "jsx", "json"), "Go": ("go",), "Python": ("py",), "Java": ("java", "kt", "kts"), "DotNet": ("cs", "fs"), "Cpp": ("c", "cpp", "cc", "h", "hpp"),
}
WATCH_NAMES = ("Cargo.toml", "Cargo.lock", "go.mod", "go.sum")
WATCH_EXTENSIONS = ("rs", "c", "cpp", "cc", "cxx", "h", "hpp", "hxx", "go", "s", "asm")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def build_relevant(path: Column) -> Column:
    """Whether a change of the path can matter to a build; parts are substrings anywhere in the path."""
    name, ext = F.lower(file_name(path)), F.lower(extension(path))
    bare = ~file_name(path).rlike(r"^.+\.")
    return ~path.rlike("|".join(re.escape(x) for x in IRRELEVANT_PARTS)) & ~name.rlike("^(?:" + "|".join(re.escape(x) for x in IRRELEVANT_NAMES) + ")") & F.when(bare, name.isin(*BARE_NAMES)).otherwise(~ext.isin(*IRRELEVANT_EXTENSIONS))


def watch_relevant(path: Column, own_names: tuple[str, ...] = (), own_folder: str = "") -> Column:
    """Whether a watched path matters: no build folder, no hidden or temporary file, a manifest or a source file."""
    folders = ["target", "build", r"\.git", *([re.escape(own_folder)] if own_folder else [])]
    name = file_name(path)
    return ~path.rlike(r"[/\\](?:" + "|".join(folders) + r")[/\\]") & ~name.rlike(r"^\.|~$|\.tmp$") & (name.isin(*WATCH_NAMES, *own_names) | extension(path).isin(*WATCH_EXTENSIONS))


def ecosystem_of(path: Column) -> Column:
    ext, chain = F.lower(extension(path)), F
    for name, extensions in ECOSYSTEM_EXTENSIONS.items():
        chain = chain.when(ext.isin(*extensions), name)
    return chain.otherwise(F.lit(None).cast("string"))


def change_impact(changes: DataFrame, by: str | None = None) -> DataFrame:
    """changes(path): counts of meaningful and ignored files, ecosystems, and whether a lock file demands a full rebuild."""
    relevant = build_relevant(F.col("path"))
    marked = changes.withColumns({"_r": relevant, "_e": F.when(relevant, ecosystem_of(F.col("path"))), "_l": relevant & file_name(F.col("path")).isin(*LOCKFILES)})
    return (marked.groupBy(by) if by else marked.groupBy()).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("_r").alias("meaningful"), F.count_if(~F.col("_r")).alias("ignored"), F.array_sort(F.collect_set("_e")).alias("ecosystems"), F.coalesce(F.bool_or("_l"), F.lit(False)).alias("full_rebuild")
    )


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression: **/ is any folders, * and ? stay within one."""
    out, at = "", 0
    while at < len(pattern):
        if pattern.startswith("**/", at):
            out, at = out + "(?:.*/)?", at + 3
        elif pattern.startswith("**", at):
            out, at = out + ".*", at + 2
        else:
            c = pattern[at]
            out, at = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)), at + 1
    return f"^{out}$"


def glob_matches(path: Column, include: list[str], exclude: list[str]) -> Column:
    """An exclude wins; without an include everything is in."""
    hit = lambda ps: path.rlike("|".join(map(glob_regex, ps)))
    return (hit(include) if include else F.lit(True)) & (~hit(exclude) if exclude else F.lit(True))


def interface_hash(source: Column) -> Column:
    """Digest of the sorted distinct public headers, each up to its brace."""
    headers = F.transform(F.filter(_lines(source), lambda x: x.startswith("pub ")), lambda x: F.trim(F.split(x, r"\{").getItem(0)))
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(headers)), "\n"), 256)


def strip_python_comments(source: Column) -> Column:
    """Lines without what follows the first #, even in strings, and without blank lines and comments."""
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    kept = F.filter(F.transform(F.split(source, r"\r?\n"), bare), lambda x: (x != "") & ~x.startswith("#"))
    return F.array_join(F.transform(kept, lambda x: bare(F.split(x, "#").getItem(0))), "\n")


_C_TOKEN = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|(\"(?:\\.|[^\"\\])*(?:\"|\\?\Z)|'(?:\\.|[^'\\])*(?:'|\\?\Z)|`(?:\\.|[^`\\])*(?:`|\\?\Z))", re.S)


def strip_c(source: str) -> str:
    """A source without its // and block comments, strings kept, lines trimmed, blank lines dropped."""
    plain = _C_TOKEN.sub(lambda m: m[1] or "", source)
    return "\n".join(x for x in (line.strip() for line in plain.split("\n")) if x)


@F.pandas_udf(T.StringType())
def strip_c_comments(source: pd.Series) -> pd.Series:
    return source.map(lambda s: None if s is None else strip_c(s))


def semantic_hash(path: Column, source: Column) -> Column:
    """Digest that comments and spacing do not change."""
    return F.sha2(F.when(extension(path).isin("py", "sh", "rb", "toml", "yaml", "yml"), strip_python_comments(source)).otherwise(strip_c_comments(source)), 256)


def test_list(output: Column) -> Column:
    """Names of a terse test listing."""
    return F.transform(F.filter(_lines(output), lambda x: x.endswith(": test")), lambda x: F.regexp_replace(x, ": test$", ""))


# Which names open a rule, and the fields that its keys set.
RULE_OPENS = r"(?:genrule|rule|[A-Za-z0-9_]+_(?:rule|binary))"
RULE_KEYS = {
    "name": ("name",), "command": ("cmd", "command", "executable"), "args": ("args", "arguments"), "inputs": ("srcs", "inputs", "sources"), "outputs": ("outs", "outputs"), "depends_on": ("deps", "depends_on"),
}


def rule_blocks(source: Column) -> Column:
    """The bodies of a build file's rules: from a line that opens one to the line that closes it, comments left out."""
    plain = F.regexp_replace(F.regexp_replace(source, r"\r\n?", "\n"), r"(?m)^[ \t]*#.*$", "")
    return F.regexp_extract_all(plain, F.lit(rf"(?ms)^[ \t]*{RULE_OPENS}\([^\n]*\n(.*?)(?=^[ \t]*\),?[ \t]*$|^[ \t]*{RULE_OPENS}\(|\z)"), F.lit(1))


def _unquoted(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"""^(["'])(.*)\1$""", "$2")


def rule_fields(block: Column) -> Column:
    """name, command, args, inputs, outputs, depends_on and env of a rule's body; the last line that sets a field counts.

    Items of a list may stand without quotes. The default command is echo; env is a map from an env = {"K": "v"}
    line. A rule without a name is an error.
    """
    lines = F.transform(F.split(block, "\n"), lambda x: F.regexp_replace(F.trim(x), r",$", ""))

    def value(field: str) -> Column:
        keys = "|".join(RULE_KEYS.get(field, (field,)))
        hits = F.filter(lines, lambda x: x.rlike(rf"^(?:{keys})\s*="))
        return F.regexp_replace(F.try_element_at(hits, F.lit(-1)), r"^\w+\s*=\s*", "")

    def items(field: str) -> Column:
        inner = F.regexp_replace(value(field), r"^\[|\]$", "")
        return F.coalesce(F.filter(F.transform(F.split(inner, ","), _unquoted), lambda x: x != ""), F.array().cast("array<string>"))

    pairs = F.filter(F.split(F.regexp_replace(value("env"), r"^\{|\}$", ""), ","), lambda x: x.contains(":"))
    env = F.map_from_entries(F.transform(pairs, lambda x: F.struct(_unquoted(F.split(x, ":", 2).getItem(0)).alias("key"), _unquoted(F.split(x, ":", 2).getItem(1)).alias("value"))))
    name = F.coalesce(_unquoted(value("name")), F.raise_error(F.lit("a rule without a name")).cast("string"))
    return F.struct(
        name.alias("name"), F.coalesce(_unquoted(value("command")), F.lit("echo")).alias("command"), *[items(f).alias(f) for f in ("args", "inputs", "outputs", "depends_on")],
        F.coalesce(env, F.create_map().cast("map<string,string>")).alias("env"),
    )
