"""Digests: a repo's tree, its reports and its selected, cleaned files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import glob_regex_of
from ..functions.text import LIMIT, clean, head, is_text, truncated
from ..plans.tables import salted_join, stage
from .ignore import ancestors, file_matches, file_patterns
from .rules import Rule, analyze
from .tree import MINIMAL, TreeConfig, tree_lines

# Files that every reported directory shows.
DEFAULT_READ_FILES = ("docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml", "Dockerfile", "Makefile", "README", "README.md", "AGENT.md", "AGENTS.md", "CLAUDE.md")


def read_files(files: DataFrame, wanted: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Rows (repo, name, content, truncated, size) of the text files matching the globs `wanted` (repo, path, pattern), a pattern counting from its path. Left out are
    directories, links, files without content, binary files, and what a root-level `.aiignore` or `.aiexclude` ignores. A file appears once
    however many patterns match; empty files are text."""
    own = files.filter(~F.col("is_dir") & ~F.col("is_symlink") & F.col("content").isNotNull()).select("repo", "path", "size", "content")
    plain = ~F.col("pattern").rlike(r"[*?\[\\]")
    full = F.when(F.col("path") == ".", F.col("pattern")).otherwise(F.concat_ws("/", "path", "pattern"))
    names = wanted.filter(plain).select("repo", full.alias("path")).distinct()
    # a glob counts from one directory: a file asks for its own last parts, as many as the glob has, in the directory above them
    globs = wanted.filter(~plain).withColumn("depth", F.size(F.split("pattern", "/"))).withColumn("form", glob_regex_of(F.col("pattern")))
    depths = [r["depth"] for r in globs.select("depth").distinct().collect()]  # as few as the numbers of parts of globs
    if depths:
        parts, depth = F.split("path", "/"), F.col("depth")
        top = F.when(F.size(parts) > depth, F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - depth, F.lit(0))), "/")).otherwise(F.lit("."))
        tail = F.array_join(F.slice(parts, F.greatest(F.size(parts) - depth + 1, F.lit(1)), depth), "/")
        asking = own.select("repo", "path", F.explode(F.array(*map(F.lit, depths))).alias("depth")).select("repo", "path", "depth", top.alias("top"), tail.alias("tail"))
        forms = globs.groupBy("repo", F.col("path").alias("top"), "depth").agg(F.collect_set("form").alias("forms"))
        met = salted_join(asking, forms, ["repo", "top", "depth"])
        names = names.unionByName(met.filter(F.exists("forms", lambda form: F.rlike(F.col("tail"), form))).select("repo", "path"))
    out = own.join(names.distinct(), ["repo", "path"], "left_semi").distinct()
    rules = None
    for seq, name in enumerate((".aiignore", ".aiexclude")):
        root = file_patterns(files.filter(F.col("dir") == "."), name)
        root = root.withColumn("patterns", F.transform("patterns", lambda x: x.withField("seq", x["seq"] + seq * 100_000_000)))
        rules = root if rules is None else rules.unionByName(root)
    rules = rules.groupBy("repo", "domain").agg(F.flatten(F.collect_list("patterns")).alias("patterns"))
    # a file below an ignored directory is ignored as well
    parts = F.split("path", "/")
    asked = F.explode(F.transform(ancestors(F.col("path")), lambda p: F.struct(p.alias("path"), (p != F.col("path")).alias("is_dir"))))
    paths = out.select("repo", F.col("path").alias("file"), asked.alias("p")).select("repo", "file", "p.path", "p.is_dir")
    hidden = file_matches(paths, rules, more=("file",)).filter(~F.col("negated")).select("repo", F.col("file").alias("path")).distinct()
    shown = out.join(hidden, ["repo", "path"], "left_anti").filter(is_text(F.substring("content", 1, limit + 1)) | truncated(F.col("content"), limit) & is_text(head(F.col("content"), limit + 1).cast("binary")))
    size = F.coalesce(F.col("size"), F.octet_length("content").cast("bigint"))
    return shown.select("repo", F.col("path").alias("name"), head(F.col("content"), limit).alias("content"), truncated(F.col("content"), limit).alias("truncated"), size.alias("size"))


def cleaned(selected: DataFrame) -> DataFrame:
    """Selected files with comments, secrets and e-mail addresses taken out, and whether that changed anything."""
    new = clean(F.col("name"), F.col("content"))
    return selected.select("repo", "name", new.alias("content"), "truncated", (new != F.col("content")).alias("cleaned"), "size")


def wanted_files(files: DataFrame, reports: DataFrame) -> DataFrame:
    """Rows (repo, path, pattern): the default files at the root and in every reported directory, and the files that reports name."""
    defaults = F.explode(F.array(*map(F.lit, DEFAULT_READ_FILES)))
    own = reports.select("repo", "path", F.explode("read_files").alias("pattern"))
    # directories first, of which each has many reports
    shown = reports.select("repo", "path").unionByName(files.select("repo", F.lit(".").alias("path"))).distinct()
    return shown.select("repo", "path", defaults.alias("pattern")).unionByName(own).distinct()


def certain_reports(reports: DataFrame) -> DataFrame:
    """Reports as a digest shows them: only certain ones, and of their metadata only what has a value."""
    with_ = F.map_filter(F.coalesce("with_values", F.expr("cast(map() as map<string,struct<value:string,error:string>>)")), lambda k, v: v["error"].isNull() & (v["value"] != ""))
    return reports.filter(~F.col("maybe")).select("repo", "path", F.struct("result", "ruleset", F.transform_values(with_, lambda k, v: v["value"]).alias("with"), F.col("group_names").alias("groups")).alias("report"))


def reports_by_path(reports: DataFrame) -> DataFrame:
    """Rows (repo, path, reports array of JSON): the certain reports of each directory, in order of ruleset and result."""
    lists = certain_reports(reports).groupBy("repo", "path").agg(F.array_sort(F.collect_list(F.struct(F.col("report.ruleset").alias("k1"), F.col("report.result").alias("k2"), F.to_json("report").alias("json")))).alias("l"))
    return lists.select("repo", "path", F.transform("l", lambda x: x["json"]).alias("reports"))


def digest_rows(files: DataFrame, rules: Iterable[Rule], ignore: Iterable[str] = (), config: TreeConfig = MINIMAL, limit: int = LIMIT, fail_fast: bool = True, use_gitignore: bool = True, metadata: bool = True) -> DataFrame:
    """Rows (repo, section, key, value): the digests of all repositories in parts, so that no repository needs to fit one row. `tree`: a line of the tree by its number (as a text of
    ten digits); `report`: a report as JSON by its path; `file`: a selected file as JSON by its name. In the order of key, and of value for one key, the parts make up the digest."""
    reports = stage(analyze(files, rules, ignore, use_gitignore, metadata, fail_fast=fail_fast), "reports")
    selected = cleaned(read_files(files, wanted_files(files, reports), limit))
    tree = tree_lines(files, config).select("repo", F.lit("tree").alias("section"), F.lpad(F.col("line_no").cast("string"), 10, "0").alias("key"), F.col("line").alias("value"))
    told = certain_reports(reports).select("repo", F.lit("report").alias("section"), F.col("path").alias("key"), F.to_json("report").alias("value"))
    shown = selected.select("repo", F.lit("file").alias("section"), F.col("name").alias("key"), F.to_json(F.struct("name", "content", "truncated", "cleaned", "size")).alias("value"))
    return tree.unionByName(told).unionByName(shown)


def digest(files: DataFrame, rules: Iterable[Rule], ignore: Iterable[str] = (), config: TreeConfig = MINIMAL, limit: int = LIMIT, fail_fast: bool = True, use_gitignore: bool = True, metadata: bool = True) -> DataFrame:
    """Rows (repo, tree, reports, selected_files): one digest per repo, from `digest_rows`; for repositories whose digest is one document. Reports are JSON texts by path, in order of
    ruleset and result; selected files are JSON texts in order of their names."""
    rows = stage(digest_rows(files, rules, ignore, config, limit, fail_fast, use_gitignore, metadata), "digest")
    part = lambda section: F.array_sort(F.collect_list(F.when(F.col("section") == section, F.struct("key", "order", "value"))))
    order = F.when(F.col("section") == "report", F.concat(F.get_json_object("value", "$.ruleset"), F.lit("\x01"), F.get_json_object("value", "$.result")))
    whole = rows.withColumn("order", order).groupBy("repo").agg(part("tree").alias("t"), part("report").alias("r"), part("file").alias("f"))
    paths = F.array_distinct(F.transform("r", lambda x: x["key"]))
    by_path = F.map_from_entries(F.transform(paths, lambda p: F.struct(p.alias("path"), F.transform(F.filter("r", lambda x: x["key"] == p), lambda x: x["value"]).alias("reports"))))
    return whole.select("repo", F.array_join(F.transform("t", lambda x: x["value"]), "\n").alias("tree"), by_path.alias("reports"), F.transform("f", lambda x: x["value"]).alias("selected_files"))


def digest_json(digests: DataFrame) -> DataFrame:
    """Rows (repo, document): each digest as one JSON document."""
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"(?s)^\[|\]$", "")
    listed = F.transform(F.map_entries("reports"), lambda e: F.concat(quoted(e["key"]), F.lit(":["), F.array_join(e["value"], ","), F.lit("]")))
    parts = (F.lit('{"tree":'), quoted(F.col("tree")), F.lit(',"reports":{'), F.array_join(listed, ","), F.lit('},"selected_files":['), F.array_join("selected_files", ","), F.lit("]}"))
    return digests.select("repo", F.concat(*parts).alias("document"))
