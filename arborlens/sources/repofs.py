"""A Spark data source of file trees, `repofs`: dotfiles included, links seen as links, pruned while walking.

    spark.dataSource.register(RepoSource)
    spark.read.format("repofs").option("path", "/src/app").load()

Options: path (a directory), paths (directories, one a line), repos (directories whose children are repos), limit (bytes read of a file; 0: all), names (read
content only of these, comma-separated globs), ignore (patterns, one a line), gitignore (false: don't use ignore files), split (levels of directories that become
partitions of their own, 1 unless given, so that one large repository is read by many tasks).
"""

from __future__ import annotations

import atexit
import fnmatch
import os
import re
import shutil
import stat
import subprocess
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.ignore import MAX_DEPTH, NEVER_WALKED, IgnorePattern, parse_patterns
from ..plans.tables import shared_dir

SCHEMA = "repo string, path string, dir string, name string, is_dir boolean, is_symlink boolean, size bigint, content binary"


def is_local(location: str) -> bool:
    """Neither a URL nor a remote of the form git@host:path."""
    return "//" not in location and not location.startswith("git@")


def ignored_by(patterns: list[IgnorePattern], path: str, is_dir: bool) -> bool:
    for p in reversed(patterns):
        if (is_dir or not p.dir_only) and re.match(p.regex.replace("$", r"\Z") if p.regex.endswith("$") else p.regex, path):
            return not p.negated
    return False


class Tree(InputPartition):
    """A directory of a repository, with all below it or only its own entries."""

    def __init__(self, repo: str, root: str, where: str = ".", deep: bool = True):
        self.repo, self.root, self.where, self.deep = repo, root, where, deep


def folder_of(root: str, where: str) -> str:
    return root if where == "." else os.path.join(root, where)


def directories(root: str, where: str) -> list[str]:
    """The directories in a directory, by path from the root."""
    try:
        names = sorted(e.name for e in os.scandir(folder_of(root, where)) if e.is_dir(follow_symlinks=False) and e.name not in NEVER_WALKED)
    except OSError:
        return []
    return [n if where == "." else f"{where}/{n}" for n in names]


class RepoReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Tree]:
        o = self.options
        roots = [p for p in [o.get("path"), *(o.get("paths") or "").split("\n")] if p]
        for parent in (o.get("repos") or "").split("\n"):
            roots += sorted(e.path for e in os.scandir(parent) if e.is_dir(follow_symlinks=False)) if parent else []
        levels = int(o.get("split") or 1)
        out: list[Tree] = []
        for r in roots:
            repo, root, at = os.path.basename(os.path.abspath(r)), os.path.abspath(r), ["."]
            for _ in range(levels):
                out += [Tree(repo, root, where, deep=False) for where in at]
                at = [d for where in at for d in directories(root, where)]
            out += [Tree(repo, root, where) for where in at]
        return out

    def read(self, partition: Tree) -> Iterator[tuple]:
        o = self.options
        limit = int(o.get("limit") or 0)
        names = [n for n in (o.get("names") or "").split(",") if n]
        use_gitignore = (o.get("gitignore") or "true").lower() != "false"
        root = partition.root

        def with_files(patterns: list[IgnorePattern], where: str) -> list[IgnorePattern]:
            for extra in (".gitignore", ".git/info/exclude") if use_gitignore else ():
                try:
                    with open(os.path.join(folder_of(root, where), extra), encoding="utf-8", errors="replace") as f:
                        patterns = patterns + parse_patterns(f, where)
                except OSError:
                    pass
            return patterns

        def walk(where: str, depth: int, patterns: list[IgnorePattern]) -> Iterator[tuple]:
            patterns = with_files(patterns, where)
            try:
                entries = sorted(os.scandir(folder_of(root, where)), key=lambda e: os.fsencode(e.name))
            except PermissionError:
                return
            for e in entries:
                path = e.name if where == "." else f"{where}/{e.name}"
                info = e.stat(follow_symlinks=False)
                link = stat.S_ISLNK(info.st_mode)
                if e.is_dir(follow_symlinks=False):
                    if e.name in NEVER_WALKED or ignored_by(patterns, path, True):
                        continue
                    yield partition.repo, path, where, e.name, True, False, None, None
                    if partition.deep and depth < MAX_DEPTH:
                        yield from walk(path, depth + 1, patterns)
                    continue
                content = None
                if not link and (not names or any(fnmatch.fnmatchcase(e.name, n) for n in names)):
                    try:
                        with open(e.path, "rb") as f:
                            content = f.read(limit) if limit else f.read()
                    except OSError:
                        content = None
                yield partition.repo, path, where, e.name, False, link, info.st_size, content

        # the directories above tell whether this one is walked at all
        patterns, above = parse_patterns((o.get("ignore") or "").split("\n")), []
        for name in [] if partition.where == "." else partition.where.split("/"):
            patterns = with_files(patterns, "/".join(above) or ".")
            above.append(name)
            if name in NEVER_WALKED or ignored_by(patterns, "/".join(above), True) or len(above) > MAX_DEPTH:
                return
        yield from walk(partition.where, len(above), patterns)


class RepoSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repofs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RepoReader:
        return RepoReader(dict(self.options))


def clone_folder(spark: SparkSession) -> str:
    """A new folder that all executors can read: below the session's shared folder, which must be a mounted one."""
    base = shared_dir(spark)
    if not base.startswith(("file:", "/")):
        raise RuntimeError(f"a clone needs a mounted folder that all executors share, not {base}")
    into = os.path.join(re.sub(r"^file:/*", "/", base), f"clone-{uuid.uuid4().hex}")
    os.makedirs(into)
    atexit.register(shutil.rmtree, into, ignore_errors=True)
    return into


def clone(url: str, into: str, ref: str | None = None, token: str | None = None) -> str:
    """A shallow clone into an empty folder; needs git and, for remote addresses, a network."""
    command = ["git", "clone", "--quiet", "--depth", "1", "--single-branch", "--shallow-submodules", "--recurse-submodules", *(["--branch", ref] if ref else []), url, into]
    env = os.environ | {"GIT_TERMINAL_PROMPT": "0"}
    if token and url.startswith("https://github.com/"):
        env |= {"GIT_CONFIG_COUNT": "1", "GIT_CONFIG_KEY_0": "http.extraHeader", "GIT_CONFIG_VALUE_0": f"Authorization: Bearer {token}"}
    subprocess.run(command, check=True, env=env, capture_output=True)
    return into


def scan(spark: SparkSession, location: str, ref: str | None = None, **options: str) -> DataFrame:
    """The `files` table of a directory or a git address; ignore files of a clone are not used, since what is committed counts."""
    spark.dataSource.register(RepoSource)
    local = is_local(location)
    reader = spark.read.format("repofs").option("path", location if local else clone(location, clone_folder(spark), ref, os.environ.get("GITHUB_TOKEN")))
    if not local:
        reader = reader.option("gitignore", "false")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()
