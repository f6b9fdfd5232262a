"""Command line: digest, analyze, deps, tree, validate, functions.

    python -m arborlens.cli analyze PATH [--ignore PATTERN]... [--plain]
"""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.expressions import Registry
from .operators.dependencies import dependencies, direct_only
from .operators.digest import certain_reports, digest, digest_json
from .operators.ignore import global_patterns, walked_dirs
from .operators.rules import analyze, load_default_rules, load_rules, rule_problems
from .operators.tree import MINIMAL, tree_lines
from .sources.repofs import is_local, scan


def deps_table(deps: DataFrame) -> DataFrame:
    return deps.orderBy("path", "manager", "name").select(F.col("path").alias("Path"), F.col("tool_name").alias("Tool"), F.col("name").alias("Name"), F.col("version_constraint").alias("Constraint"), F.col("version").alias("Version"))


def reports_table(reports: DataFrame) -> DataFrame:
    """Certain reports; metadata as `key: value` parted by `; `, in the order of keys."""
    r = F.col("report")
    with_ = F.array_join(F.transform(F.array_sort(F.map_entries(r["with"])), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")
    return certain_reports(reports).select(F.col("path").alias("Path"), r["ruleset"].alias("Ruleset"), r["result"].alias("Result"), F.array_join(r["groups"], ", ").alias("Groups"), with_.alias("With")).orderBy("Path", "Ruleset", "Result")


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def show(df: DataFrame, plain: bool, nothing: str) -> None:
    """One repo's rows on a terminal, all of them, as they arrive: tab-separated with a header, or in columns as wide as their longest value; `nothing` goes to the error
    output where there are none."""
    df = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns)).persist()
    widths = df.agg(F.count("*").alias("rows"), *(F.coalesce(F.max(F.length(c)), F.lit(0)).alias(c) for c in df.columns)).first()
    if not widths["rows"]:
        print(nothing, file=sys.stderr)
        return
    wide = [max(len(c), widths[c]) for c in df.columns]
    line = "+" + "+".join("-" * (w + 2) for w in wide) + "+"
    framed = lambda row: "|" + "|".join(f" {v}{' ' * (w - len(v))} " for v, w in zip(row, wide)) + "|"
    print("\t".join(df.columns) if plain else "\n".join((line, framed(df.columns), line)))
    for row in df.toLocalIterator():
        print("\t".join(row) if plain else framed(row))
    if not plain:
        print(line)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="arborlens")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("digest", "analyze", "deps", "tree"):
        c = sub.add_parser(name)
        c.add_argument("path", nargs="?", default=".")
        c.add_argument("--ref")
        c.add_argument("--ignore", action="append", default=[])
        c.add_argument("--rules")
        c.add_argument("--plain", action="store_true")
        c.add_argument("--yaml", action="store_true")
        c.add_argument("--no-metadata", action="store_true")
        c.add_argument("--include-indirect", action="store_true")
        c.add_argument("--include-dev", action="store_true")
    lint = sub.add_parser("validate", help="read rules and compile their expressions")
    lint.add_argument("path", nargs="?")
    sub.add_parser("functions", help="the reference of functions and operators, as Markdown")
    a = p.parse_args(argv)
    if a.command == "functions":
        print(Registry.default().reference())
        return 0
    spark = SparkSession.builder.appName("arborlens").getOrCreate()
    if a.command == "validate":
        problems = rule_problems(a.path) if a.path else rule_problems()
        for problem in problems:
            print(problem, file=sys.stderr)
        print("The rules are not valid." if problems else "The rules are valid.", file=sys.stderr)
        return 1 if problems else 0
    files = scan(spark, a.path, a.ref).persist()
    rules = load_rules(a.rules) if a.rules else load_default_rules()
    use = is_local(a.path)
    everywhere = global_patterns()
    if a.command == "tree":
        config = replace(MINIMAL, ignore=(*(everywhere if use else ()), *a.ignore), use_gitignore=use)
        for row in tree_lines(files, config).orderBy("line_no").toLocalIterator():
            print(row["line"])
    elif a.command == "deps":
        dirs = walked_dirs(files, a.ignore, use)
        found = direct_only(dependencies(files, dirs), a.include_indirect, a.include_dev)
        show(deps_table(found), a.plain, "No dependencies found." if a.include_indirect else "No direct dependencies found.")
    elif a.command == "analyze":
        show(reports_table(analyze(files, rules, [*everywhere, *a.ignore], use, not a.no_metadata)), a.plain, "No results found.")
    else:
        config = replace(MINIMAL, ignore=tuple(everywhere if use else ()), use_gitignore=use)
        parts = digest(files, rules, [*everywhere, *a.ignore], config, use_gitignore=use, metadata=not a.no_metadata)
        for row in digest_json(parts).toLocalIterator():
            print(yaml.safe_dump(json.loads(row["document"]), allow_unicode=True, sort_keys=False) if a.yaml else row["document"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
