"""Rules over directories: model, loader, probes and analysis."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import PROBES, Compiler, Registry, Value, parse, probes_of
from ..functions.patterns import glob_regex, wildcard_regex
from ..plans.tables import stage
from .dependencies import all_dependencies, check_manager
from .ignore import ignored, parse_patterns, walked_dirs
from .matches import combine_matches

DEFAULT_RULES = Path(__file__).parent.parent / "plans" / "rules"
NAME = re.compile(r"^[a-z0-9][a-z0-9_.-]*[a-z0-9]$")
KEYS = {"when": str, "then": list, "maybe": list, "with": dict, "group": str, "groups": list, "ignore": list, "read_files": list}


class RuleError(ValueError):
    """A rule or ruleset that isn't valid."""


@dataclass(frozen=True)
class Rule:
    ruleset: str
    name: str
    when: str
    then: tuple[str, ...] = ()
    maybe: tuple[str, ...] = ()
    metadata: tuple[tuple[str, str], ...] = ()
    groups: tuple[str, ...] = ()
    ignore: tuple[str, ...] = ()
    read_files: tuple[str, ...] = ()


def validate_name(name: str) -> str:
    """Two characters or more: lower case, digits, and `_ . -` inside."""
    if not NAME.match(name):
        raise RuleError(f"invalid name: {name!r}")
    return name


def rule_from(ruleset: str, name: str, spec: Any) -> Rule:
    """A rule from its mapping; texts stand for lists of one."""
    where = f"{ruleset}/{name}"
    if not isinstance(spec, dict):
        raise RuleError(f"{where}: not a mapping")
    if unknown := set(spec) - set(KEYS):
        raise RuleError(f"{where}: additional keys {sorted(unknown)}")
    listed = {k: [v] if KEYS[k] is list and isinstance(v, str) else v for k, v in spec.items()}
    for k, v in listed.items():
        if not isinstance(v, KEYS[k]) or KEYS[k] is list and not all(isinstance(x, str) for x in v):
            raise RuleError(f"{where}: {k} has the wrong type")
    if not listed.get("when"):
        raise RuleError(f"{where}: when is required")
    if not listed.get("then") and not listed.get("maybe"):
        raise RuleError(f"{where}: then or maybe is required")
    groups = [listed["group"]] if listed.get("group") else listed.get("groups", [])
    metadata = tuple(sorted((k, str(v)) for k, v in listed.get("with", {}).items()))
    return Rule(validate_name(ruleset), validate_name(name), listed["when"], tuple(listed.get("then", ())), tuple(listed.get("maybe", ())), metadata, tuple(groups), tuple(listed.get("ignore", ())), tuple(listed.get("read_files", ())))


def rules_from_yaml(text: str) -> list[Rule]:
    """Rules of a document `rulesets: name: rules: name: {...}`, or the same without the outer key."""
    whole = yaml.safe_load(text)
    if isinstance(whole, dict) and set(whole) == {"rulesets"}:
        whole = whole["rulesets"]
    if not isinstance(whole, dict) or not whole:
        raise RuleError("no rulesets")
    out = []
    for ruleset, body in whole.items():
        rules = body.get("rules") if isinstance(body, dict) and set(body) == {"rules"} else body
        if not isinstance(rules, dict) or not rules:
            raise RuleError(f"{ruleset}: no rules")
        out += [rule_from(str(ruleset), str(name), spec) for name, spec in rules.items()]
    return out


def load_rules(folder: str | Path) -> list[Rule]:
    """All rules of the `*.yml` and `*.yaml` files of a folder; a ruleset may be in one file only."""
    out: list[Rule] = []
    for path in sorted(p for p in Path(folder).iterdir() if p.suffix in (".yml", ".yaml")):
        new = rules_from_yaml(path.read_text())
        if double := {r.ruleset for r in new} & {r.ruleset for r in out}:
            raise RuleError(f"duplicate ruleset: {sorted(double)[0]}")
        out += new
    return out


def rules_from_table(df: DataFrame) -> list[Rule]:
    """Rules of a table with the columns of the `rules` table; the rules are few and configure the job, so the driver reads them."""
    many = lambda v: tuple(v or ())
    return [
        Rule(r["ruleset"], r["name"], r["when_expr"], many(r["then_results"]), many(r["maybe_results"]), tuple(sorted((r["with_exprs"] or {}).items())), many(r["group_names"]), many(r["ignore_dirs"]), many(r["read_files"]))
        for r in df.collect()
        if r["ruleset"] is not None and r["name"] is not None and r["when_expr"]
    ]


@dataclass
class Probes:
    """All distinct calls on `fs` of a set of rules, evaluated in one pass per kind and brought to the directories in one shuffle."""

    registry: Registry = field(default_factory=Registry.default)
    numbers: dict[tuple, int] = field(default_factory=dict)

    def add(self, text: str) -> None:
        for p in probes_of(parse(text), self.registry):
            if p[0].startswith("dep"):
                check_manager(p[1])
            self.numbers.setdefault(p, len(self.numbers))

    def column(self, function: str, *args: str) -> Column:
        n = self.numbers[(function, *args)]
        flag, text = F.try_element_at("flags", F.lit(n)), F.try_element_at("texts", F.lit(n))
        own = self.registry.probes[function][1] if function not in PROBES else None
        if own in ("bool", "string", "bytes"):
            return {"bool": flag, "string": text, "bytes": F.try_element_at("contents", F.lit(n))}[own]
        if function == "read":
            return F.try_element_at("contents", F.lit(n))
        if function == "glob":
            return F.coalesce(F.split(text, "\0"), F.array().cast("array<string>"))
        if function == "depVersion":
            return F.coalesce(text, F.lit(""))
        return flag if function == "fileContains" else F.coalesce(flag, F.lit(False))

    def of(self, *functions: str) -> list[tuple[tuple, int]]:
        return [(p, n) for p, n in self.numbers.items() if p[0] in functions]

    def evaluate(self, files: DataFrame, dirs: DataFrame, deps: DataFrame | None) -> DataFrame:
        """Rows (repo, path, flags map, texts map, contents map) of every directory.

        Each file finds the directory it answers for by cutting the probe's path off its own, so no directory meets every probe. Where an
        answer is missing the map has no key.
        """
        spark = files.sparkSession
        found: list[DataFrame] = []
        wanted = "repo", "path", "n", "flag", "text", "content"
        table = lambda rows, schema: F.broadcast(spark.createDataFrame(rows, schema))  # noqa: E731 - as long as the rules are
        exact = [(re.sub(r"^(\./)+|/+$", "", p[1]), p[0], p[2] if len(p) > 2 else None, n) for p, n in self.of("fileExists", "isDir", "fileContains", "read") if p[1] not in (".", "")]
        if exact:
            probe = table([(a.rpartition("/")[2], a, f, s, n) for a, f, s, n in exact], "base string, arg string, fn string, needle string, n int")
            own = files.select("repo", F.col("path").alias("file"), "name", "is_dir", "content").filter(F.col("name").isin(*sorted({a.rpartition("/")[2] for a, *_ in exact})))
            # directories that are only implied by what lies in them exist as well
            implied = dirs.filter("path <> '.'").select("repo", F.col("path").alias("file"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.lit(True).alias("is_dir"), F.lit(None).cast("binary").alias("content"))
            own = own.unionByName(implied.filter(F.col("name").isin(*sorted({a.rpartition("/")[2] for a, *_ in exact}))))
            hit = own.join(probe, own["name"] == probe["base"]).filter((F.col("file") == F.col("arg")) | F.endswith(F.col("file"), F.concat(F.lit("/"), F.col("arg"))))
            where = F.when(F.col("file") == F.col("arg"), F.lit(".")).otherwise(F.expr("substring(file, 1, length(file) - length(arg) - 1)"))
            bytes_ = F.coalesce("content", F.lit(b""))
            flag = F.when(F.col("fn") == "fileExists", F.lit(True)).when(F.col("fn") == "isDir", F.col("is_dir")).when((F.col("fn") == "fileContains") & ~F.col("is_dir"), F.contains(bytes_, F.col("needle").cast("binary")))
            found.append(hit.select("repo", where.alias("path"), "n", flag.alias("flag"), F.lit(None).cast("string").alias("text"), F.when((F.col("fn") == "read") & ~F.col("is_dir"), bytes_).alias("content")))
        here = [n for p, n in self.of("isDir", "fileExists") if p[1] in (".", "")]
        if here:
            found.append(dirs.select("repo", "path", F.explode(F.array(*map(F.lit, here))).alias("n"), F.lit(True).alias("flag"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("binary").alias("content")))
        globs = [(p[1].count("/"), glob_regex(p[1]), n) for p, n in self.of("glob")]
        for depth in sorted({d for d, _, _ in globs}):
            probe = table([(r, n) for d, r, n in globs if d == depth], "form string, n int")
            parts = F.split("path", "/")
            tail = F.array_join(F.slice(parts, F.greatest(F.size(parts) - depth, F.lit(1)), depth + 1), "/")
            top = F.when(F.size(parts) > depth + 1, F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - depth - 1, F.lit(0))), "/")).otherwise(F.lit("."))
            named = files.select("repo", "path", tail.alias("tail"), top.alias("top")).distinct()
            hit = named.filter(reduce(lambda a, b: a | b, (F.col("tail").rlike(r) for d, r, _ in globs if d == depth))).join(probe, F.expr("tail RLIKE form"))
            names = hit.groupBy("repo", F.col("top").alias("path"), "n").agg(F.array_join(F.array_sort(F.collect_set("path")), "\0").alias("text"))
            found.append(names.select("repo", "path", "n", F.lit(None).cast("boolean").alias("flag"), "text", F.lit(None).cast("binary").alias("content")))
        exists, versions = self.of("depExists"), self.of("depVersion")
        if (exists or versions) and deps is not None:
            if exists:
                probe = table([(p[1], p[2], wildcard_regex(p[2]) if "*" in p[2] else None, n) for p, n in exists], "m string, exact string, form string, n int")
                hit = deps.filter("found").join(probe, (F.col("manager") == F.col("m")) & ((F.col("name") == F.col("exact")) | F.expr("name RLIKE form")))
                found.append(hit.select("repo", "path", "n", F.lit(True).alias("flag"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("binary").alias("content")))
            if versions:
                probe = table([(p[1], p[2], n) for p, n in versions], "m string, exact string, n int")
                hit = deps.filter("gettable").join(probe, (F.col("manager") == F.col("m")) & (F.col("name") == F.col("exact")))
                first = hit.groupBy("repo", "path", "n").agg(F.min_by("get_version", "seq").alias("text"))
                found.append(first.select("repo", "path", "n", F.lit(None).cast("boolean").alias("flag"), "text", F.lit(None).cast("binary").alias("content")))
        for (name, *arguments), n in [(p, n) for p, n in self.numbers.items() if p[0] not in PROBES]:
            _, kind, rows = self.registry.probes[name]
            value = lambda t, c: F.col("value").cast(t).alias(c) if kind == c else F.lit(None).cast(t).alias(c)
            own = rows(files, *arguments).select("repo", "path", "value")
            found.append(own.select("repo", "path", F.lit(n).alias("n"), value("boolean", "bool").alias("flag"), value("string", "string").alias("text"), value("binary", "bytes").alias("content")))
        empty = dirs.select("repo", "path", F.lit(-1).alias("n"), F.lit(None).cast("boolean").alias("flag"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("binary").alias("content"))
        answers = reduce(lambda a, b: a.unionByName(b), [d.select(*wanted) for d in found], empty)
        one = answers.groupBy("repo", "path", "n").agg(F.max("flag").alias("flag"), F.max("text").alias("text"), F.max("content").alias("content"))
        pick = lambda c: F.map_from_entries(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("n", c))))
        maps = one.groupBy("repo", "path").agg(F.max(F.col("n") == -1).alias("walked"), pick("flag").alias("flags"), pick("text").alias("texts"), pick("content").alias("contents"))
        # answers for nested directories of files that no walked directory holds are not asked for
        return maps.filter("walked").drop("walked")


def rule_hits(files: DataFrame, rules: Iterable[Rule], ignore: Iterable[str] = (), use_gitignore: bool = True, metadata: bool = True, fail_fast: bool = True, registry: Registry | None = None) -> DataFrame:
    """Rows (repo, path, ruleset, rule, then, maybe, groups, read_files, with_values, error) of the rules that hold in a directory, and of those that end
    in an error; with `fail_fast` such an error ends the job."""
    rules = sorted(rules, key=lambda r: (r.ruleset, r.name))
    registry = registry or Registry.default()
    probes = Probes(registry)
    for r in rules:
        for text in (r.when, *(e for _, e in r.metadata)):
            probes.add(text)
    dirs = stage(walked_dirs(files, ignore, use_gitignore), "dirs")  # read by every kind of probe
    deps = stage(all_dependencies(files, dirs), "deps") if probes.of("depExists", "depVersion") else None
    answers = probes.evaluate(files, dirs, deps)
    compiler = Compiler({"path": Value(F.col("path"), "string")}, probes.column, registry)
    value = "map<string,struct<value:string,error:string>>"
    none, no_error = F.lit(None).cast(value), F.lit(None).cast("string")
    out = []
    for n, r in enumerate(rules):
        cond = compiler.compile(r.when).try_cast("boolean")  # a condition must be a boolean, or the text of one
        if r.ignore:
            cond = ~ignored(F.col("path"), F.lit(True), parse_patterns(r.ignore)) & cond
        with_ = none
        if metadata and r.metadata:
            texts = [(k, compiler.compile(e).cast("string")) for k, e in r.metadata]
            with_ = F.create_map(*(x for k, c in texts for x in (F.lit(k), F.struct(c.alias("value"), F.when(c.isNull(), F.lit("evaluation error")).alias("error"))))).cast(value)
        error = F.lit(f"{r.ruleset}/{r.name}: evaluation error")
        out.append(F.when(cond, F.struct(F.lit(n).alias("n"), with_.alias("with_values"), no_error.alias("error"))).when(cond.isNull(), F.struct(F.lit(n).alias("n"), none.alias("with_values"), (F.raise_error(error).cast("string") if fail_fast else error).alias("error"))))
    if not out:
        raise RuleError("no rules")
    hits = answers.select("repo", "path", F.explode(F.array_compact(F.array(*out))).alias("hit")).select("repo", "path", "hit.*")
    rows = [(n, r.ruleset, r.name, list(r.then), list(r.maybe), list(r.groups), list(r.read_files)) for n, r in enumerate(rules)]
    table = files.sparkSession.createDataFrame(rows, "n int, ruleset string, rule string, then array<string>, maybe array<string>, groups array<string>, read_files array<string>")
    return hits.join(F.broadcast(table), "n").select("repo", "path", "ruleset", "rule", "then", "maybe", "groups", "read_files", "with_values", "error")


def reports_of(hits: DataFrame) -> DataFrame:
    """Reports (repo, path, ruleset, result, error, rules, maybe, group_names, read_files, with_values) from rule hits, one per directory, ruleset and
    result, and one per error. Arrays are sorted; of equal metadata keys the last rule's by name counts."""
    keys = ["repo", "path", "ruleset"]
    good = hits.filter("error IS NULL")
    combined = combine_matches(good, keys)
    extras = good.select(*keys, "rule", "read_files", "with_values")
    each = combined.select(*keys, "result", F.explode("rules").alias("rule")).join(extras, [*keys, "rule"])
    more = each.groupBy(*keys, "result").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("read_files")))).alias("read_files"),
        F.aggregate(
            F.array_sort(F.collect_list(F.when(F.col("with_values").isNotNull(), F.struct("rule", F.map_entries("with_values").alias("e"))))),
            F.expr("cast(map() as map<string,struct<value:string,error:string>>)"),
            lambda acc, x: F.map_concat(F.map_filter(acc, lambda k, v: ~F.exists(x["e"], lambda p: p["key"] == k)), F.map_from_entries(x["e"])),
        ).alias("with_values"),
    )
    rows = combined.join(more, [*keys, "result"]).select(*keys, "result", F.lit(None).cast("string").alias("error"), "rules", "maybe", F.col("groups").alias("group_names"), "read_files", "with_values")
    bad = hits.filter("error IS NOT NULL").select(*keys, F.lit(None).cast("string").alias("result"), "error", F.array("rule").alias("rules"), F.lit(False).alias("maybe"), F.col("groups").alias("group_names"), "read_files", "with_values")
    return rows.unionByName(bad)


def analyze(files: DataFrame, rules: Iterable[Rule], ignore: Iterable[str] = (), use_gitignore: bool = True, metadata: bool = True, fail_fast: bool = True, registry: Registry | None = None) -> DataFrame:
    """Reports of a `files` table (repo, path, dir, name, is_dir, is_symlink, size, content), by rules."""
    return reports_of(stage(rule_hits(files, rules, ignore, use_gitignore, metadata, fail_fast, registry), "hits"))


def load_default_rules() -> list[Rule]:
    """The rules that ship with the package."""
    return load_rules(DEFAULT_RULES)



def rule_problems(folder: str | Path = DEFAULT_RULES) -> list[str]:
    """What is wrong with the rules of a folder: files that can't be read, names, keys and types, expressions that don't compile, managers that don't exist. Empty where all is well."""
    try:
        rules = load_rules(folder)
    except (OSError, RuleError, yaml.YAMLError) as e:
        return [str(e)]
    out = []
    for r in rules:
        for what, text in (("when", r.when), *((f"with {k}", e) for k, e in r.metadata)):
            probes = Probes()
            try:
                probes.add(text)
                Compiler({"path": Value(F.col("path"), "string")}, probes.column).compile(text)
            except ValueError as e:
                out.append(f"{r.ruleset}/{r.name}: {what}: {e}")
    return out
