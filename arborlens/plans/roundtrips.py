"""Queries that write the rows of `deps` as manifests and lock files, and read these back through the library's own readers, merges and rules; SQL says from `deps` alone
what must come out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dependencies import dependencies
from ..operators.rules import Rule, analyze
from ..sources.manifests import NAME_AT_VERSION
from .tables import table

Query = Callable[[SparkSession, str], DataFrame]
OUT = ("repo", "path", "name", "version_constraint", "version", "is_direct", "is_dev_only", "tool_name", "vendor")
#: What a requirement may begin with so that it isn't taken for a part of the name.
SIGNED = "^[=<>~^!*]"


def declared(spark: SparkSession, sf_dir: str, manager: str, form: str) -> DataFrame:
    """One row (repo, path, name, c, v, direct, dev) for each name of a directory that has the form: `deps` without its repetitions."""
    d = table(spark, sf_dir, "deps").filter((F.col("manager") == manager) & F.col("name").rlike(form))
    text = lambda c: F.coalesce(F.min(F.when(F.col(c).rlike(r"^[\w.+~^<>=!*\- ]+\z"), F.col(c))), F.lit(""))
    return d.groupBy("repo", "path", "name").agg(text("version_constraint").alias("c"), text("version").alias("v"), F.max("is_direct").alias("direct"), F.max("is_dev_only").alias("dev"))


def base_sql(manager: str, form: str) -> str:
    text = lambda c: f"coalesce(min({c}) FILTER (regexp_matches({c}, '^[\\w.+~^<>=!*\\- ]+\\z')), '')"
    return f"b AS (SELECT repo, path, name, {text('version_constraint')} AS c, {text('version')} AS v, max(is_direct) AS direct, max(is_dev_only) AS dev FROM deps WHERE manager = '{manager}' AND regexp_matches(name, '{form}') GROUP BY ALL)"


def listed(cond: Column, line: Column, between: str = "\n") -> Column:
    """Aggregate: the lines of the rows that meet the condition, in order."""
    return F.array_join(F.array_sort(F.collect_list(F.when(cond, line))), between)


def q(c: str | Column) -> Column:
    return F.concat(F.lit('"'), F.col(c) if isinstance(c, str) else c, F.lit('"'))


def text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def written(rows: DataFrame, **files: Column) -> DataFrame:
    """A `files` table: for each directory the files named, with `__` for a dot, from aggregates over its rows."""
    made = rows.groupBy("repo", "path").agg(*(content.alias(name) for name, content in files.items()))
    each = F.explode(F.array(*(F.struct(F.lit(name.replace("__", ".").replace("_", "-") if name.startswith(("package_l", "pnpm_")) else name.replace("__", ".")).alias("name"), F.col(name).alias("content")) for name in files)))
    out = made.select("repo", F.col("path").alias("dir"), each.alias("f")).select("repo", "dir", "f.name", F.col("f.content").cast("binary").alias("content"))
    where = F.when(F.col("dir").isin(".", ""), F.col("name")).otherwise(F.concat_ws("/", "dir", "name"))
    return out.select("repo", where.alias("path"), F.when(F.col("dir") == "", ".").otherwise(F.col("dir")).alias("dir"), "name", F.lit(False).alias("is_dir"), F.lit(False).alias("is_symlink"), F.octet_length("content").cast("bigint").alias("size"), "content")


def read_back(files: DataFrame) -> DataFrame:
    return dependencies(files).select(*OUT)


FORMS = {"js": "^[@a-z][\\w@/.-]*\\z", "go": "^[a-z][\\w.-]*/[\\w./-]+\\z", "pip": "^[A-Za-z][\\w.-]*\\z", "php": "^[a-z][\\w.-]*/[\\w.-]+\\z", "java": "^[a-z][\\w.-]*:[\\w.-]+\\z", "ruby": "^[a-zA-Z0-9_-]+\\z", "rust": "^[A-Za-z][\\w.-]*\\z", "elixir": "^[a-z]\\w*\\z", "dotnet": "^[A-Za-z][\\w.-]*\\z"}


def npm_files(rows: DataFrame) -> DataFrame:
    lock = text(q(text("node_modules/", F.col("name"))), ": {", q(F.lit("version")), ": ", q("v"), "}")
    return written(rows, package__json=package_json(), package_lock__json=text('{"packages": {"": {"name": "x"}, ', listed(F.lit(True), lock, ", "), "}}"))


def manifests_npm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(npm_files(declared(spark, sf_dir, "js", FORMS["js"]))).filter("name <> ''")


def named_lock() -> Column:
    return text(F.col("name"), "@", F.col("v"))


def package_json() -> Column:
    d, dev = F.col("direct"), F.col("dev")
    pair = text(q("name"), ": ", q("c"))
    return text('{"dependencies": {', listed(d & ~dev, pair, ", "), '}, "devDependencies": {', listed(d & dev, pair, ", "), "}}")


def manifests_pnpm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = declared(spark, sf_dir, "js", FORMS["js"])
    return read_back(written(rows, package__json=package_json(), pnpm_lock__yaml=text("lockfileVersion: '9.0'\npackages:\n", listed(F.lit(True), text("  '", named_lock(), "': {}")), "\n")))


def manifests_bun(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = declared(spark, sf_dir, "js", FORMS["js"])
    return read_back(written(rows, package__json=package_json(), bun__lock=text('{\n  // made\n  "packages": {\n', listed(F.lit(True), text("    ", q("name"), ": [", q(named_lock()), ', "", {},],'), "\n"), "\n  },\n}\n")))


def manifests_pipenv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = declared(spark, sf_dir, "python", "^[A-Za-z][\\w-]*\\z")
    return read_back(written(rows, Pipfile=text("[packages]\n", listed(F.col("c") != "", text(q("name"), " = ", q("c"))), "\n")))


def manifests_uv(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = q(text(F.col("name"), F.when(F.col("c").rlike(SIGNED), F.col("c")).otherwise("")))
    d, dev = F.col("direct"), F.col("dev")
    manifest = text("[project]\nname = 'x'\ndependencies = [", listed(d & ~dev, spec, ", "), "]\n[dependency-groups]\ndev = [", listed(d & dev, spec, ", "), "]\n")
    lock = text("[[package]]\nname = ", q("name"), "\nversion = ", q("v"), "\n")
    return read_back(written(declared(spark, sf_dir, "python", FORMS["pip"]), pyproject__toml=manifest, uv__lock=text("version = 1\n", listed(F.lit(True), lock))))


def manifests_go(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(go_files(spark, sf_dir))


def go_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each directory also requires `code.example/anchor`, in a version that tells its number of modules."""
    line = text("\t", F.col("name"), " v", F.when(F.col("v") == "", "0").otherwise(F.replace("v", F.lit(" "), F.lit(""))), F.when(F.col("direct"), "").otherwise(" // indirect"))
    rows = declared(spark, sf_dir, "go", FORMS["go"])
    return written(rows, go__mod=text("module m\n\nrequire code.example/anchor v", F.count("*").cast("string"), "\n\nrequire (\n", listed(F.lit(True), line), "\n)\n"))


def manifests_pip(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = text(F.col("name"), F.when(F.col("c").rlike(SIGNED), F.col("c")).otherwise(""))
    return read_back(written(declared(spark, sf_dir, "python", FORMS["pip"]), requirements__txt=text("# made\n\n", listed(F.lit(True), line), "\n")))


def poetry_text() -> dict[str, Column]:
    line = text(q("name"), " = ", q("c"))
    lock = text("[[package]]\nname = ", q("name"), "\nversion = ", q("v"), "\n")
    section = lambda name, cond: text(f"[tool.poetry.{name}]\n", listed(cond, line), "\n")
    return {"pyproject__toml": text(section("dependencies", F.col("direct") & ~F.col("dev")), section("group.dev.dependencies", F.col("direct") & F.col("dev"))), "poetry__lock": text("# made\n", listed(F.lit(True), lock))}


def manifests_poetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(written(declared(spark, sf_dir, "python", FORMS["pip"]), **poetry_text()))


def manifests_composer(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, dev = F.col("direct"), F.col("dev")
    pair = text(q("name"), ": ", q("c"))
    lock = text('{"name": ', q("name"), ', "version": ', q("v"), "}")
    manifest = text('{"require": {', listed(d & ~dev, pair, ", "), '}, "require-dev": {', listed(d & dev, pair, ", "), "}}")
    return read_back(written(declared(spark, sf_dir, "php", FORMS["php"]), composer__json=manifest, composer__lock=text('{"packages": [', listed(F.lit(True), lock, ", "), "]}")))


def manifests_maven(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda n: F.element_at(F.split("name", ":"), n)
    escaped = F.replace(F.replace("v", F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    line = text("<dependency><groupId>", part(1), "</groupId><artifactId>", part(2), "</artifactId><version>", F.trim(escaped), "</version></dependency>")
    return read_back(written(declared(spark, sf_dir, "java", FORMS["java"]), pom__xml=text('<?xml version="1.0"?><project><dependencies>', listed(F.lit(True), line), "</dependencies></project>")))


def manifests_gradle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = declared(spark, sf_dir, "java", FORMS["java"]).filter("v <> ''")
    line = lambda a, b: text(f"  implementation{a}", F.col("name"), ":", F.col("v"), b)
    return read_back(written(rows, build__gradle=text("dependencies {\n", listed(F.col("direct"), line(" '", "'")), "\n}"), build__gradle__kts=text("dependencies {\n", listed(~F.col("direct"), line('("', '")')), "\n}")))


def manifests_sbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = declared(spark, sf_dir, "java", FORMS["java"]).filter("v <> ''")
    part = lambda n: q(F.element_at(F.split("name", ":"), n))
    line = text("  ", part(1), F.when(F.col("direct"), " %% ").otherwise(" % "), part(2), " % ", q("v"))
    return read_back(written(rows, build__sbt=text('name := "x" // (made)\n\nlibraryDependencies ++= Seq(\n', listed(F.lit(True), line, ",\n"), "\n)\n")))


def manifests_bundler(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = text("gem '", F.col("name"), "'", F.when(F.col("c") != "", text(", '", F.col("c"), "'")).otherwise(""))
    lock = text("    ", F.col("name"), " (", F.col("v"), ")")
    return read_back(written(declared(spark, sf_dir, "ruby", FORMS["ruby"]), Gemfile=text("source 'x'\n", listed(F.col("direct"), line)), Gemfile__lock=text("GEM\n", listed(F.col("v") != "", lock))))


def manifests_cargo(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, dev = F.col("direct"), F.col("dev")
    line = text(q("name"), " = ", q("c"))
    lock = text("[[package]]\nname = ", q("name"), "\nversion = ", q("v"), "\n")
    manifest = text("[package]\nname = \"x\"\n[dependencies]\n", listed(d & ~dev, line), "\n[dev-dependencies]\n", listed(d & dev, line), "\n")
    return read_back(written(declared(spark, sf_dir, "rust", FORMS["rust"]), Cargo__toml=manifest, Cargo__lock=text("version = 3\n", listed(F.lit(True), lock))))


def manifests_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = text("      {:", F.col("name"), ", ", q("c"), "},")
    lock = text("  ", q("name"), ": {:hex, :", F.col("name"), ", ", q("v"), ', "x", [:mix]}')
    return read_back(written(declared(spark, sf_dir, "elixir", FORMS["elixir"]), mix__exs=text("  defp deps do\n    [\n", listed(F.col("c") != "", line), "\n    ]\n"), mix__lock=text("%{\n", listed(F.col("v") != "", lock), "\n}\n")))


def manifests_dotnet(spark: SparkSession, sf_dir: str) -> DataFrame:
    escaped = F.replace(F.replace("c", F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    line = text('<PackageReference Include="', F.col("name"), '" Version="', escaped, '"/>')
    lock = text(q(text(F.col("name"), "/", F.col("v"))), ': {"type": "Direct"}')
    files = written(declared(spark, sf_dir, "dotnet", FORMS["dotnet"]), App__csproj=text("<Project><ItemGroup>", listed(F.col("direct"), line), "</ItemGroup></Project>"), packages__lock__json=text('{"version": 1, "targets": {"net8": {', listed(F.col("v") != "", lock, ", "), "}}}"))
    return read_back(files)


# Rules over what was written

GO_RULES = [
    Rule("probes", "exists", 'fs.fileExists("go.mod") && !fs.fileExists("go.sum") && fs.isDir(".")', ("module",)),
    Rule("probes", "dep-wild", 'fs.depExists("go", "code.*/*or*")', ("code",), metadata=(("anchor", 'fs.depVersion("go", "code.example/anchor")'), ("none", 'fs.depVersion("go", "code.example/nothing")'))),
    Rule("probes", "contains", 'fs.fileContains("go.mod", "// indirect")', ("indirect",)),
    Rule("probes", "glob", 'fs.glob("*.mod").size() == 1 && fs.glob("*.mod")[0].endsWith("go.mod")', ("globbed",)),
    Rule("probes", "read", 'string(fs.read("go.mod")).size() > 200 && fs.read("go.mod").size() < 100000', ("long",)),
]


def rule_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every probe of the rules, over the modules of `deps` written as files; directories that a walk leaves out give no reports, and those without a module only errors, which are left out here."""
    got = analyze(go_files(spark, sf_dir), GO_RULES, fail_fast=False).filter("error IS NULL")
    value = lambda k: F.coalesce(F.col("with_values")[k]["value"], F.lit("-"))
    return got.select("repo", "path", "result", F.array_join("rules", ",").alias("rules"), value("anchor").alias("anchor"), value("none").alias("none"))


def lock_sql(manager: str, form: str, tool: str, vendor: str, more: str = "direct OR v <> ''", version: str = "v") -> str:
    return f"WITH {base_sql(manager, form)} SELECT repo, path, name, CASE WHEN direct THEN c ELSE '' END AS version_constraint, {version} AS version, direct AS is_direct, direct AND dev AS is_dev_only, '{tool}' AS tool_name, {vendor} AS vendor FROM b WHERE {more}"


def plain_sql(manager: str, form: str, tool: str, constraint: str, version: str, vendor: str, more: str = "true", direct: str = "true") -> str:
    return f"WITH {base_sql(manager, form)} SELECT repo, path, name, {constraint} AS version_constraint, {version} AS version, {direct} AS is_direct, false AS is_dev_only, '{tool}' AS tool_name, {vendor} AS vendor FROM b WHERE {more}"


NAME_AT = NAME_AT_VERSION.pattern
GROUP = "string_split(name, ':')[1]"
GO_VERSION = "'v' || CASE WHEN v = '' THEN '0' ELSE replace(v, ' ', '') END"


def sql(walked: Callable[[str], str]) -> dict[str, str]:
    """`walked`: SQL that tells whether a walk with the default patterns visits a directory."""
    go = base_sql("go", FORMS["go"])
    texts = f"""SELECT repo, path, count(*) AS n, bool_or(name LIKE 'code.%/%or%') OR 'code.example/anchor' LIKE 'code.%/%or%' AS code, bool_or(NOT direct) AS indirect,
 'module m' || chr(10) || chr(10) || 'require code.example/anchor v' || count(*) || chr(10) || chr(10) || 'require (' || chr(10) || string_agg(chr(9) || name || ' ' || {GO_VERSION} || CASE WHEN direct THEN '' ELSE ' // indirect' END, chr(10)) || chr(10) || ')' || chr(10) AS content FROM b GROUP BY ALL"""
    row = lambda result, rule, cond, anchor="'-'", none="'-'": f"SELECT repo, path, '{result}' AS result, '{rule}' AS rules, {anchor} AS anchor, {none} AS none FROM w WHERE {cond}"
    return {
        "manifests_npm": lock_sql("js", FORMS["js"], "npm", "CASE WHEN name LIKE '@%/%' THEN string_split(name[2:], '/')[1] ELSE '' END", "true"),
        "manifests_go": f"WITH {go} SELECT repo, path, name, '' AS version_constraint, {GO_VERSION} AS version, direct AS is_direct, false AS is_dev_only, 'go' AS tool_name, '' AS vendor FROM b UNION ALL SELECT repo, path, 'code.example/anchor', '', 'v' || count(*), true, false, 'go', '' FROM b GROUP BY ALL",
        **{
            f"manifests_{tool}": f"WITH {base_sql('js', FORMS['js'])}, s AS (SELECT *, regexp_extract(name || '@' || v, '{NAME_AT}', 1) = name AS locked, regexp_extract(name || '@' || v, '{NAME_AT}', 2) AS version FROM b) SELECT repo, path, name, CASE WHEN direct THEN c ELSE '' END AS version_constraint, CASE WHEN locked THEN version ELSE '' END AS version, direct AS is_direct, direct AND dev AS is_dev_only, '{tool}' AS tool_name, CASE WHEN name LIKE '@%/%' THEN string_split(name[2:], '/')[1] ELSE '' END AS vendor FROM s WHERE direct OR locked"
            for tool in ("pnpm", "bun")
        },
        "manifests_pipenv": plain_sql("python", "^[A-Za-z][\\w-]*\\z", "pipenv", "c", "''", "''", "c <> ''"),
        "manifests_uv": lock_sql("python", FORMS["pip"], "uv", "''", "true").replace("CASE WHEN direct THEN c ELSE", f"CASE WHEN direct AND regexp_matches(c, '{SIGNED}') THEN rtrim(c) ELSE"),
        "manifests_pip": plain_sql("python", FORMS["pip"], "pip", f"CASE WHEN regexp_matches(c, '{SIGNED}') THEN rtrim(c) ELSE '' END", "''", "''"),
        "manifests_poetry": lock_sql("python", FORMS["pip"], "poetry", "''", "true"),
        "manifests_composer": lock_sql("php", FORMS["php"], "composer", "string_split(name, '/')[1]", "direct"),
        "manifests_maven": plain_sql("java", FORMS["java"], "maven", "''", "trim(v)", GROUP),
        "manifests_gradle": plain_sql("java", FORMS["java"], "gradle", "''", "v", GROUP, "v <> ''"),
        "manifests_sbt": plain_sql("java", FORMS["java"], "sbt", "''", "v", GROUP, "v <> ''"),
        "manifests_bundler": lock_sql("ruby", FORMS["ruby"], "bundler", "''").replace("direct AND dev AS", "false AS"),
        "manifests_cargo": lock_sql("rust", FORMS["rust"], "cargo", "''", "true"),
        "manifests_mix": plain_sql("elixir", FORMS["elixir"], "mix", "c", "v", "''", "c <> ''"),
        "manifests_dotnet": lock_sql("dotnet", FORMS["dotnet"], "dotnet", "''").replace("direct AND dev AS", "false AS"),
        "rule_probes": f"WITH {go}, t AS ({texts}), w AS (SELECT * FROM t WHERE {walked('path')}) " + " UNION ALL ".join([
            row("module", "exists", "true"), row("code", "dep-wild", "code", "'v' || n", "''"), row("indirect", "contains", "indirect"), row("globbed", "glob", "true"), row("long", "read", "length(content) > 200 AND strlen(content) < 100000"),
        ]),
    }


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (manifests_npm, manifests_pnpm, manifests_bun, manifests_pipenv, manifests_uv, manifests_go, manifests_pip, manifests_poetry, manifests_composer, manifests_maven, manifests_gradle, manifests_sbt, manifests_bundler, manifests_cargo, manifests_mix, manifests_dotnet, rule_probes)}
