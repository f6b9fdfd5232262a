"""Ignore patterns with the semantics of git: the last match wins, `!` takes back, a slash inside anchors, a slash at the end means directories."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import groupby
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import salted_join

# Patterns that are ignored by default.
DEFAULT_PATTERNS = [
    ".idea/",
    ".vscode/",
    ".vs/",
    "/.ddev",
    ".build/",
    "bower_components",
    "elm-stuff/",
    ".workspace/",
    "node_modules/",
    ".next",
    ".nuxt",
    "tests/",
    "testdata/",
    "fixtures/",
    "Fixtures/",
    "__fixtures__/",
    "__pycache__/",
    "venv/",
    "virtualenv/",
    ".virtualenv/",
    ".github/",
    ".gitlab/",
    ".hg/",
    ".svn/",
    ".bzr/",
    ".cache/",
    "_asm/",
    "vendor/",
]
NEVER_WALKED = (".git", "node_modules")
MAX_DEPTH = 16


@dataclass(frozen=True)
class IgnorePattern:
    regex: str
    negated: bool
    dir_only: bool


def parse_pattern(line: str, domain: str = "") -> IgnorePattern | None:
    """A line of an ignore file in the directory `domain` (relative to the root, "" or "." for the root); None for blank lines and comments."""
    line = line.rstrip("\r\n")
    line = re.sub(r"(?<!\\)\s+$", "", line)
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated or line.startswith(("\\#", "\\!")) else line
    dir_only = line.endswith("/")
    line = line.rstrip("/")
    if not line:
        return None
    anchored = "/" in line
    body = "".join(_segment(s) for s in re.split(r"(^\*\*/|/\*\*/|/\*\*$)", line.lstrip("/")))
    root = re.escape(domain.strip("/")) + "/" if domain not in ("", ".") else ""
    return IgnorePattern(f"(?s)^{root}{'' if anchored else '(?:.*/)?'}{body}$", negated, dir_only)


def _segment(text: str) -> str:
    if text == "**/":
        return "(?:.*/)?"
    if text == "/**/":
        return "/(?:.*/)?"
    if text == "/**":
        return "/.+"
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (end := text.find("]", i + 2)) > 0:
            body = text[i + 1 : end]
            out.append("[" + ("^" if body[0] in "!^" else "") + body.lstrip("!^").replace("[", "\\[") + "]")
            i = end
        elif c == "\\" and i + 1 < len(text):
            i += 1
            out.append(re.escape(text[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def parse_patterns(lines: Iterable[str], domain: str = "") -> list[IgnorePattern]:
    return [p for line in lines if (p := parse_pattern(line, domain))]


def ignored(path: Column, is_dir: Column, patterns: list[IgnorePattern]) -> Column:
    """Whether the last matching pattern ignores the path; false where none matches. A fixed list is part of the projection: no join."""
    chain = None
    for (negated, dir_only), run in groupby(reversed(patterns), key=lambda p: (p.negated, p.dir_only)):
        # neighbours of one kind are one regex
        cond = path.rlike("|".join(p.regex for p in run))
        cond = cond & is_dir if dir_only else cond
        chain = F.when(cond, F.lit(not negated)) if chain is None else chain.when(cond, F.lit(not negated))
    return F.lit(False) if chain is None else chain.otherwise(F.lit(False))


def ancestors(path: Column) -> Column:
    """The path itself and the directories above it, but the root: `a/b/c` gives `a`, `a/b`, `a/b/c`."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def global_patterns() -> list[str]:
    """The lines of the user's own ignore file: `.gitignore` in the home folder, else what git's `core.excludesFile` names; none where there is no such file."""
    home = Path.home()
    path = home / ".gitignore"
    if not path.is_file():
        try:
            named = subprocess.run(["git", "config", "--global", "--get", "core.excludesFile"], capture_output=True, text=True, timeout=10).stdout.strip()
        except (OSError, subprocess.SubprocessError):
            return []
        path = Path(named).expanduser() if named else home / ".gitignore"
    try:
        return path.read_text(errors="replace").splitlines()
    except OSError:
        return []


def file_patterns(files: DataFrame, name: str = ".gitignore") -> DataFrame:
    """One row (repo, domain, patterns array of (seq, regex, negated, dir_only)) for each ignore file in a `files` table. Patterns of deeper directories come later, and so
    win; for `.gitignore`, a repository's own `.git/info/exclude` counts behind it. A pruned directory's own file needs no special care: its patterns match only
    below it."""
    exclude = F.endswith(F.concat(F.lit("/"), "path"), F.lit("/.git/info/exclude"))
    own = (F.col("name") == name) | ((F.col("name") == "exclude") & exclude) if name == ".gitignore" else F.col("name") == name
    where = F.when(F.col("name") == name, F.col("dir")).otherwise(F.regexp_replace("path", r"/?\.git/info/exclude$", ""))
    rows = files.filter(own & ~F.col("is_dir") & F.col("content").isNotNull()).select("repo", where.alias("domain"), (F.col("name") != name).cast("int").alias("second"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("seq", pa.int64()), ("regex", pa.string()), ("negated", pa.bool_()), ("dir_only", pa.bool_())]))
        for batch in batches:
            out = []
            for repo, where, second, text in zip(*(batch.column(c).to_pylist() for c in range(4))):
                depth = 0 if where in ("", ".") else where.count("/") + 1
                at = (2 * depth + second + 1) * 1_000_000
                found = [{"seq": at + n, "regex": p.regex, "negated": p.negated, "dir_only": p.dir_only} for n, line in enumerate((text or "").split("\n")) if (p := parse_pattern(line, where))]
                if found:
                    out.append((repo, where or ".", found))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], kind)], names=["repo", "domain", "patterns"])

    lists = rows.mapInArrow(run, "repo string, domain string, patterns array<struct<seq: bigint, regex: string, negated: boolean, dir_only: boolean>>")
    return lists.groupBy("repo", "domain").agg(F.flatten(F.collect_list("patterns")).alias("patterns"))


def last_match(path: Column, is_dir: Column, patterns: Column) -> Column:
    """(seq, negated) of the pattern of highest seq that matches; NULL where none does. `patterns`: an array of (seq, regex, negated, dir_only)."""
    hit = F.filter(patterns, lambda p: F.rlike(path, p["regex"]) & (~p["dir_only"] | is_dir))
    return F.array_max(F.transform(hit, lambda p: F.struct(p["seq"].alias("seq"), p["negated"].alias("negated"))))


def file_matches(paths: DataFrame, patterns: DataFrame, path: str = "path", is_dir: str = "is_dir", more: tuple[str, ...] = ()) -> DataFrame:
    """Rows (repo, path, *more, negated) of the paths that a pattern of an ignore file matches, by the last one. A path meets only the ignore files of the
    directories above it, found by equality, each as one row whose patterns are tested within it; the paths of a large repository are dealt out over tasks."""
    parts = F.split(path, "/")
    above = F.concat(F.array(F.lit(".")), F.when(F.size(parts) > 1, F.slice(ancestors(F.col(path)), F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<string>")))
    each = paths.select("repo", path, F.col(is_dir).alias("_dir"), *more, F.explode(above).alias("domain"))
    met = salted_join(each, patterns, ["repo", "domain"]).withColumn("_hit", last_match(F.col(path), F.col("_dir"), F.col("patterns")))
    return met.filter("_hit IS NOT NULL").groupBy("repo", path, *more).agg(F.max("_hit").alias("_hit")).select("repo", path, *more, F.col("_hit.negated").alias("negated"))


def walked_dirs(files: DataFrame, ignore: Iterable[str] = (), use_gitignore: bool = True, defaults: bool = True, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Rows (repo, path) of the directories a walk visits: the root `.` of each repo, every directory above a file or listed itself, without those that
    are too deep, never walked, ignored, or below such a one."""
    every = files.select("repo", F.explode(ancestors(F.when(F.col("is_dir") & ~F.col("is_symlink"), F.col("path")).otherwise(F.col("dir")))).alias("path")).filter("path <> ''").distinct()
    fixed = parse_patterns([*(sorted(DEFAULT_PATTERNS, key=lambda p: p.endswith("/")) if defaults else ()), *ignore])
    marked = every.withColumn("is_dir", F.lit(True))
    base = ignored(F.col("path"), F.lit(True), fixed)
    if use_gitignore:
        hit = marked.join(file_matches(marked, file_patterns(files)), ["repo", "path"], "left")
        marked = hit.withColumn("out", F.coalesce(~F.col("negated"), base))
    else:
        marked = marked.withColumn("out", base)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    pruned = marked.filter((F.col("path") != ".") & (F.col("out") | name.isin(*NEVER_WALKED) | (F.size(F.split("path", "/")) > max_depth))).select("repo", F.col("path").alias("above"))
    below = salted_join(every.select("repo", "path", F.explode(ancestors(F.col("path"))).alias("above")), pruned, ["repo", "above"], "left_semi").select("repo", "path").distinct()
    return every.join(below, ["repo", "path"], "left_anti").unionByName(files.select("repo", F.lit(".").alias("path")).distinct()).distinct()
