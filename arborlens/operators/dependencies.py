"""Dependencies of every directory: manifests and lock files merged by name, and lookups among them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import wildcard_match
from ..sources.manifests import MANAGERS, ORDER, READERS, manifest_key, python_tool, read_manifest

ENTRIES = "repo string, path string, manager string, file string, seq bigint, role string, vendor string, name string, version_constraint string, version string, is_direct boolean, is_dev_only boolean, hint string, error string"
DEPS = ["repo", "path", "manager", "vendor", "name", "version_constraint", "version", "is_direct", "is_dev_only", "tool_name"]


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, by `order`; aggregated map-side, without a sort of the whole."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def is_specific_version(version: Column) -> Column:
    """No range: not empty, not opening with a bracket, without comparison, caret, tilde or star."""
    return F.coalesce(version.rlike(r"^[^\[(><=^~*][^><=^~*]*$"), F.lit(False))


# Manifests


def manifest_entries(files: DataFrame) -> DataFrame:
    """Entries of all manifests and lock files in a `files` table. Only their rows, and only the columns needed, leave the scan; files of which there
    are equal repeated rows count once. A file that can't be read gives a row with `error`; unreadable project files (.csproj) give none."""
    names = [n.rpartition("/")[2] for n in READERS if n != ".csproj"]
    own = files.filter(~F.col("is_dir") & ~F.col("is_symlink") & F.col("content").isNotNull() & (F.col("name").isin(*names) | F.col("name").endswith(".csproj")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for repo, path, content in zip(*(batch.column(c).to_pylist() for c in range(3))):
                key = manifest_key(path)
                if not key:
                    continue
                manager, entries, error = read_manifest(path, content)
                where = path.rpartition("/")[0]
                where = (where.rpartition("/")[0] if key.startswith(".meteor/") else where) or "."
                hint = python_tool(content.decode("utf-8", "replace")) if key == "pyproject.toml" else ""
                at = (ORDER[key] + 1) * 10_000_000
                for n, e in enumerate(entries):
                    rows.append((repo, where, manager, key, at + n, e.role, e.vendor, e.name, e.constraint, e.version, e.is_direct, e.is_dev_only, hint, ""))
                rows.append((repo, where, manager, key, at, "file", "", "", "", "", False, False, hint, error))
            kinds = [pa.string()] * 4 + [pa.int64()] + [pa.string()] * 5 + [pa.bool_(), pa.bool_(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names=[c.split()[0] for c in ENTRIES.split(", ")])

    return own.select("repo", "path", "content").distinct().mapInArrow(run, ENTRIES)


def all_dependencies(files: DataFrame, dirs: DataFrame | None = None) -> DataFrame:
    """Every dependency a directory has for lookups: the columns of `dependencies`, `found` (whether listing shows it), `get_version` and `gettable` (what a
    lookup by name sees), and `seq`, the order within a directory."""
    entries = manifest_entries(files)
    if dirs is not None:
        entries = entries.join(dirs.select("repo", "path").distinct(), ["repo", "path"], "left_semi")
    present = entries.groupBy("repo", "path", "manager").agg(F.collect_set("file").alias("present"), F.max(F.when(F.col("file") == "pyproject.toml", F.col("hint"))).alias("hint"))
    e = entries.filter("role <> 'file'").drop("hint", "error").join(present, ["repo", "path", "manager"])
    has = lambda n: F.array_contains("present", n)
    python = F.when(has("uv.lock"), "uv").when(has("poetry.lock"), "poetry").when(has("pyproject.toml"), F.when(F.col("hint") != "", F.col("hint")).otherwise("python")).when(has("requirements.txt"), "pip").when(has("Pipfile"), "pipenv")
    npm = F.when(has("pnpm-lock.yaml"), "pnpm").when(has("bun.lock"), "bun").otherwise("npm")
    f, m = F.col("file"), F.col("manager")
    e = e.withColumn(
        "tool_name",
        F.when(m == "js", F.when(f.startswith(".meteor/"), "meteor").when(f.startswith("deno."), "deno").otherwise(npm))
        .when(m == "python", python)
        .when(m == "java", F.when(f == "pom.xml", "maven").when(f == "build.sbt", "sbt").otherwise("gradle"))
        .otherwise(F.element_at(F.create_map(*(F.lit(x) for x in ("go", "go", "php", "composer", "ruby", "bundler", "rust", "cargo", "elixir", "mix", "dotnet", "dotnet"))), m)),
    )
    tool = F.col("tool_name")
    # a lock file counts only beside its manifest, and of Python's files only those of the directory's tool
    needs = {"deno.lock": "deno.json", "package-lock.json": "package.json", "pnpm-lock.yaml": "package.json", "bun.lock": "package.json", "Gemfile.lock": "Gemfile", "mix.lock": "mix.exs", "Cargo.lock": "Cargo.toml", "composer.lock": "composer.json"}
    counts = F.lit(True)
    for lock, manifest in needs.items():
        counts = counts & ((f != lock) | has(manifest))
    own = F.when(tool.isin("uv", "poetry", "python"), (f == "pyproject.toml") | (f == F.concat(tool, F.lit(".lock")))).when(tool == "pip", f == "requirements.txt").otherwise(f == "Pipfile")
    e = e.filter(counts & ((m != "python") | own))
    merged = ~(m.isin("java", "go") | ((m == "python") & ~(has("uv.lock") | has("poetry.lock"))))
    # php lists a name that is in both sections twice
    e = e.withColumn("part", F.when(~merged, F.col("seq")).when((m == "php") & (F.col("role") == "set") & F.col("is_dev_only"), F.lit(1)).otherwise(F.lit(0)).cast("bigint"))
    php_lock = e.filter((m == "php") & (F.col("role") == "lock")).groupBy("repo", "path", "name").agg(F.min_by("version", "seq").alias("locked"))
    keep = F.struct("version_constraint", "is_direct", "is_dev_only", "tool_name", "vendor")
    is_set, last_wins = F.col("role") == "set", ~m.isin("python", "dotnet")
    folded = e.groupBy("repo", "path", "manager", "name", "part").agg(
        F.min("seq").alias("seq"),
        F.max(is_set).alias("declared"),
        F.max_by(keep, F.when(is_set & last_wins, F.col("seq"))).alias("last_set"),
        F.min_by(keep, "seq").alias("first"),
        F.max_by(keep, F.when((m == "python") & (F.col("version_constraint") != ""), F.col("seq"))).alias("constrained"),
        F.max_by("version", F.when(last_wins, F.col("seq"))).alias("last_version"),
        F.max_by("version", F.when(F.col("version") != "", F.when(m == "dotnet", -F.col("seq")).otherwise(F.col("seq")))).alias("some_version"),
    )
    m = F.col("manager")
    folded = folded.join(php_lock, ["repo", "path", "name"], "left")
    chosen = F.coalesce("last_set", "constrained", "first")
    version = F.when(m == "php", F.coalesce("locked", F.lit(""))).when(m.isin("python", "dotnet"), F.coalesce("some_version", F.lit(""))).otherwise(F.coalesce("last_version", F.lit("")))
    out = folded.select(
        "repo", "path", "manager", F.when(m == "python", F.col("first.vendor")).otherwise(chosen["vendor"]).alias("vendor"), "name", chosen["version_constraint"].alias("version_constraint"), version.alias("version"),
        chosen["is_direct"].alias("is_direct"), chosen["is_dev_only"].alias("is_dev_only"), F.when(m == "python", F.col("first.tool_name")).otherwise(chosen["tool_name"]).alias("tool_name"), "declared", "seq", "part",
    )
    m = F.col("manager")
    shown = F.col("declared") | ~m.isin("php", "elixir")
    get_version = F.when((m == "dotnet") & (F.col("version") == "") & is_specific_version(F.col("version_constraint")), F.col("version_constraint")).otherwise(F.col("version"))
    # a lookup sees php's lock-only packages but neither Go's indirect ones nor Elixir's undeclared ones, and php's first section before the second
    gettable = F.when(m == "go", F.col("is_direct")).when(m == "elixir", F.col("declared")).otherwise(True)
    return out.select(*DEPS, shown.alias("found"), get_version.alias("get_version"), gettable.alias("gettable"), "seq")


def dependencies(files: DataFrame, dirs: DataFrame | None = None) -> DataFrame:
    """The dependencies that listing shows, in the columns of the `deps` table; only of `dirs` (repo, path) where given. Missing texts are empty, never null."""
    return all_dependencies(files, dirs).filter("found").select(*DEPS)


def manifest_errors(files: DataFrame) -> DataFrame:
    """Rows (repo, path, file, error) of the manifests that can't be read."""
    return manifest_entries(files).filter("role = 'file' AND error <> ''").select("repo", "path", "file", "error")


def find_deps(deps: DataFrame, manager: str, pattern: str) -> DataFrame:
    """The manager's dependencies whose name matches a wildcard."""
    check_manager(manager)
    return deps.filter((F.col("manager") == manager) & wildcard_match(F.col("name"), pattern))


def get_dep(everything: DataFrame, manager: str, name: str) -> DataFrame:
    """One row per directory that has `name`, from `all_dependencies`: the first that a lookup sees."""
    check_manager(manager)
    own = everything.filter((F.col("manager") == manager) & (F.col("name") == name) & F.col("gettable")).withColumn("version", F.col("get_version"))
    return first_seen(own.select(*DEPS, "seq"), ["repo", "path"], ["seq"]).select(*DEPS)


def direct_only(deps: DataFrame, include_indirect: bool = False, include_dev: bool = False) -> DataFrame:
    """Without indirect and development dependencies, unless asked for; a null flag counts as false."""
    out = deps if include_indirect else deps.filter(F.coalesce("is_direct", F.lit(False)))
    return out if include_dev else out.filter(~F.coalesce("is_dev_only", F.lit(False)))


def check_manager(manager: str) -> None:
    if manager not in MANAGERS:
        raise ValueError(f"manager type not supported: {manager}")
