"""Text trees of repositories, as relational steps: rank, cut, prune, connect, order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import SALTS, numbered, salted_join, stage
from .ignore import DEFAULT_PATTERNS, NEVER_WALKED, ancestors, file_matches, file_patterns, ignored, parse_patterns


@dataclass(frozen=True)
class TreeConfig:
    """`max_entries` (0: no limit) shrinks by `factor` a level; `max_depth` 0: no limit; empty connectors: the usual ones."""

    max_depth: int = 0
    max_entries: int = 0
    factor: float = 0.0
    entry: str = "├"
    last: str = "└"
    line: str = "│"
    suffix: str = ""
    ignore: tuple[str, ...] = ()
    use_gitignore: bool = True


# The tree of a digest.
MINIMAL = TreeConfig(max_depth=8, max_entries=32, factor=0.5, entry=" ", last=" ", line=" ")


def limit_at(depth, config: TreeConfig):
    """The number of entries a directory of this depth may show."""
    factor = config.factor if config.factor > 0 else 1.0
    return F.floor(F.lit(float(config.max_entries)) * F.pow(F.lit(factor), depth)).cast("int")


def top_per_group(df: DataFrame, group: list[str], order: list[str], limit, salts: int = SALTS) -> DataFrame:
    """`df` with `position` and `removed` in each group: a group of more than limit + 1 rows keeps its first `limit`, and `removed` counts the others; rows beyond are dropped. Ties in
    `order` are broken by the other columns. A hot group is ranked in `salts` parts first, of which only the first rows meet each other."""
    columns = df.columns
    rest = [c for c in columns if c not in order and c not in group]
    full = [*(F.col(c) for c in order), *(F.col(c) for c in rest)]
    bound = (F.lit(limit) if isinstance(limit, int) else limit).cast("bigint")
    rows = df.withColumn("_limit", bound).withColumn("_part", F.pmod(F.xxhash64(*columns), F.lit(salts)))
    part = Window.partitionBy(*group, "_part")
    dealt = rows.withColumn("_place", F.row_number().over(part.orderBy(*full))).withColumn("_rows", F.count(F.lit(1)).over(part)).filter(F.col("_place") <= F.col("_limit") + 1)
    # each part's first row tells how many rows it had
    whole = Window.partitionBy(*group)
    ranked = dealt.withColumn("position", F.row_number().over(whole.orderBy(*full))).withColumn("_size", F.sum(F.when(F.col("_place") == 1, F.col("_rows"))).over(whole))
    over = F.col("_size") > F.col("_limit") + 1
    return ranked.withColumn("removed", F.when(over, F.col("_size") - F.col("_limit")).otherwise(0).cast("bigint")).filter(~over | (F.col("position") <= F.col("_limit"))).select(*columns, "position", "removed")


def tree_nodes(files: DataFrame) -> DataFrame:
    """Rows (repo, path, dir, name, is_dir) of all files and of all directories, listed or implied."""
    listed = files.select("repo", "path", (F.col("is_dir") & ~F.col("is_symlink")).alias("is_dir"))
    implied = files.select("repo", F.explode(ancestors(F.col("dir"))).alias("path")).filter("path NOT IN ('.', '')").select("repo", "path", F.lit(True).alias("is_dir"))
    every = listed.filter("path NOT IN ('.', '')").unionByName(implied).groupBy("repo", "path").agg(F.max("is_dir").alias("is_dir"))
    where = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return every.select("repo", "path", F.when(where == "", ".").otherwise(where).alias("dir"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "is_dir")


def tree_lines(files: DataFrame, config: TreeConfig = TreeConfig()) -> DataFrame:
    """Rows (repo, line_no, line): each repo's tree, depth first, names in byte order.

    A directory is cut to its limit before ignored entries are left out, so those use up the limit, too, and a marker tells how many were cut; one
    entry too many is let pass. The last entry has its own connector unless entries were cut. Repos without files give only the root line.
    """
    nodes = stage(tree_nodes(files).withColumn("depth", F.size(F.split("path", "/")) - 1), "nodes")
    if config.max_depth:
        nodes = nodes.filter(F.col("depth") <= config.max_depth)
    if config.max_entries:
        shown = top_per_group(nodes, ["repo", "dir"], ["name"], limit_at(F.col("depth"), config)).drop("position")
    else:
        shown = nodes.withColumn("removed", F.lit(0).cast("bigint"))
    more = nodes.groupBy("repo", "dir", "depth").agg(F.count("*").alias("size"))
    if config.max_entries:
        limit = limit_at(F.col("depth"), config)
        more = more.withColumn("removed", F.when(F.col("size") > limit + 1, F.col("size") - limit).otherwise(0).cast("bigint")).filter("removed > 0")
    else:
        more = more.withColumn("removed", F.lit(0).cast("bigint")).filter(F.lit(False))
    base = ignored(F.col("path"), F.col("is_dir"), parse_patterns([*sorted(DEFAULT_PATTERNS, key=lambda p: p.endswith("/")), *config.ignore]))
    if config.use_gitignore:
        hit = file_matches(shown, file_patterns(files))
        shown = shown.join(hit, ["repo", "path"], "left").withColumn("out", F.coalesce(~F.col("negated"), base)).drop("negated")
    else:
        shown = shown.withColumn("out", base)
    shown = shown.filter(~F.col("out") & ~F.col("name").isin(*NEVER_WALKED)).drop("out")
    shown = stage(shown, "shown")  # read for the last entries, the prefixes and the lines
    ends = shown.groupBy("repo", "dir").agg(F.max("name").alias("end"))
    shown = salted_join(shown, ends, ["repo", "dir"], salts=4).withColumn("is_last", (F.col("name") == F.col("end")) & (F.col("removed") == 0)).drop("end")
    # a line appears where all directories above it do; their connectors make its prefix
    above = shown.filter("is_dir").select("repo", F.col("path").alias("above"), F.col("is_last").alias("above_last"))
    at = F.when(F.col("dir") == ".", F.lit("")).otherwise(F.concat("dir", F.lit("/")))
    entry = F.concat(F.when(F.col("is_last"), F.lit(config.last)).otherwise(F.lit(config.entry)), F.lit(" "), "name", F.when(F.col("is_dir"), F.lit(config.suffix)).otherwise(""))
    marker = F.concat(F.lit(config.last + " ... ("), F.col("removed").cast("string"), F.lit(" more)"))
    rows = shown.select("repo", "dir", F.col("path").alias("key"), entry.alias("text")).unionByName(more.select("repo", "dir", F.concat(at, F.lit("\U0010ffff")).alias("key"), marker.alias("text")))
    up = F.when(F.col("dir") == ".", F.array().cast("array<string>")).otherwise(ancestors(F.col("dir")))
    each = rows.withColumn("needed", F.size(up)).withColumn("above", F.explode_outer(up))
    joined = salted_join(each, above, ["repo", "above"], "left", salts=4)
    chain = F.array_sort(F.collect_list(F.when(F.col("above_last").isNotNull(), F.struct(F.length("above").alias("n"), "above_last"))))
    got = joined.groupBy("repo", "key", "text", "needed").agg(chain.alias("chain")).filter(F.size("chain") == F.col("needed"))
    prefix = F.array_join(F.transform("chain", lambda x: F.when(x["above_last"], F.lit("  ")).otherwise(F.lit(config.line + " "))), "")
    # directories before what is in them, and in the order of names: the slash counts as the least character
    entries = got.select("repo", F.translate("key", "/", "\x01").alias("key"), F.concat(prefix, F.col("text")).alias("line"))
    roots = files.select("repo").distinct().select("repo", F.lit("").alias("key"), F.lit("." + config.suffix).alias("line"))
    whole = roots.unionByName(entries)
    return numbered(whole, ["repo"], ["key"], "line_no").select("repo", "line_no", "line")


def tree_text(files: DataFrame, config: TreeConfig = MINIMAL) -> DataFrame:
    """Rows (repo, tree): the lines of `tree_lines` in one text, for configurations whose limits bound its length."""
    lines = tree_lines(files, config)
    return lines.groupBy("repo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("tree"))
