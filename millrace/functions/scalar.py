"""Scalar functions: sizes, durations, paths, quoting, validation, messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KB", "MB", "GB", "TB")


def human_bytes(n: Column) -> Column:
    """1536 as 1.5 KB; whole bytes below 1024, TB at most."""
    chain = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for k, unit in enumerate(UNITS[1:], 1):
        text = F.concat(F.format_string("%.1f", F.bround(n / float(1024**k), 1)), F.lit(f" {unit}"))
        chain = chain.when(n < 1024 ** (k + 1), text) if k < len(UNITS) - 1 else chain.otherwise(text)
    return chain


def _scaled(text: Column, pattern: str, factors: dict[str, int], what: str) -> Column:
    number, unit = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    chain = F
    for u, f in factors.items():
        chain = chain.when(unit == u, F.lit(f).cast("long"))
    good = text.rlike(pattern)
    return F.when(good, F.try_to_number(number, F.lit("9" * 18)).cast("long") * chain.otherwise(F.lit(None))).when(text.isNotNull(), F.raise_error(F.concat(F.lit(f"invalid {what}: "), text)).cast("long"))


def parse_duration(text: Column) -> Column:
    """Seconds of 30m, 2h, 7d; bare numbers are seconds; other texts raise."""
    return _scaled(F.trim(text), r"^(\d+)\s*([smhd]?)$", {"": 1, "s": 1, "m": 60, "h": 3600, "d": 86400}, "duration")


def parse_size(text: Column) -> Column:
    """Bytes of 500MB, 2G, 10kb; binary multiples; other texts raise."""
    return _scaled(F.upper(F.trim(text)), r"^(\d+)\s*([KMG]?)B?$", {"": 1, "K": 1024, "M": 1024**2, "G": 1024**3}, "size")


def sanitize_path(path: Column) -> Column:
    """A path without ., .. and doubled or backward slashes, never above its root."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    step = lambda done, p: F.when(p.isin("", "."), done).when(p == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def command_line(program: Column, args: Column) -> Column:
    """Program and arguments; those with spaces or shell characters in single quotes."""
    quoted = F.transform(args, lambda a: F.when(a.rlike(r"[\s\"$`\;|&<>()\[\]{}*?!~]"), F.concat(F.lit("'"), a, F.lit("'"))).otherwise(a))
    return F.array_join(F.concat(F.array(program), quoted), " ")


def cache_key(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def namespace(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 12)


# The messages of the next function.
def dirty_reason(kind: Column, target: Column, detail: Column, extra: Column) -> Column:
    """Why a target is rebuilt, or that it is clean."""
    rebuilt = F.concat(F.lit("rebuilding `"), target, F.lit("`: "))
    return (
        F.when(kind == "Clean", F.concat(F.lit("target `"), target, F.lit("` is clean (CAS hit: "), detail, F.lit(")")))
        .when(kind == "MissingOutput", F.concat(rebuilt, F.lit("output `"), detail, F.lit("` is missing")))
        .when(kind == "SourceModified", F.concat(rebuilt, F.lit("source `"), detail, F.lit("` was modified "), extra, F.lit("s ago")))
        .when(kind == "DependencyChanged", F.concat(rebuilt, F.lit("dependency `"), detail, F.lit("` changed ("), extra, F.lit(")")))
        .when(kind == "EnvMismatch", F.concat(rebuilt, F.lit("environment variable `"), detail, F.lit("` changed")))
        .otherwise(F.concat(rebuilt, F.lit("no previous fingerprint record found")))
    )


# The tips of the next function.
def doctor_advice(missing: Column, installed: Column, total: Column, tool: str = "the build tool") -> Column:
    """Tips from what is missing; the first six names are listed."""
    few = F.concat(F.lit("Install missing toolchains to unlock polyglot builds: "), F.array_join(F.slice(missing, 1, 6), ", "))
    only = F.concat(F.lit("Only "), installed.cast("string"), F.lit("/"), total.cast("string"), F.lit(" toolchains detected; install the rest via your OS package manager."))
    return F.array_compact(
        F.array(
            F.when(F.size(missing) > 0, few), F.when(installed < total, only),
            F.lit("Keep the local CAS on a fast disk (SSD) and enable `critical_path = true` to prioritize the longest dependency chain."),
            F.lit(f"Let the doctor command of {tool} create the configuration, set cache permissions, and sweep stale temporary files."),
        )
    )


def valid_filename(name: Column) -> Column:
    """No folders and no shell characters."""
    return ~name.contains("..") & ~name.rlike(r"[/\\;&|`$()<> ]")


#: Hosts that are never fetched.
PRIVATE_HOSTS = r"^(?:localhost|127\.|0\.0\.0\.0|\[::1\]|::1|169\.254\.|10\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.)"


def valid_url(url: Column) -> Column:
    """http or https to a host outside the private ranges."""
    return url.rlike("^https?://") & ~F.get(F.split(url, "://"), F.lit(1)).rlike(PRIVATE_HOSTS)


def suspicious_argument(arg: Column) -> Column:
    """Substitutions always, chaining and redirection too: an operator makes no path."""
    return arg.rlike(r"\$\([^)]*\)|`[^`]*`|\$\{[^}]*\}") | arg.rlike(r"[;&|<>]")


#: Languages by extension.
LANGUAGES = {"rs": "Rust", "c": "C", "h": "C", "cpp": "Cpp", "cc": "Cpp", "cxx": "Cpp", "hpp": "Cpp", "hxx": "Cpp", "go": "Go", "ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "py": "Python", "zig": "Zig"}


def source_language(ext: Column) -> Column:
    chain = F
    for e, name in LANGUAGES.items():
        chain = chain.when(ext == e, name)
    return chain.otherwise("Unknown")
