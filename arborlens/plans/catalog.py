"""The queries over the driver's tables, one or more for each operator, with SQL that gives the same rows where SQL can."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.expressions import Compiler
from ..functions.patterns import glob_match, wildcard_match
from ..operators.dependencies import dependencies, direct_only, find_deps, first_seen, is_specific_version
from ..operators.digest import DEFAULT_READ_FILES, certain_reports, cleaned, digest_rows, read_files, reports_by_path
from ..operators.ignore import DEFAULT_PATTERNS, MAX_DEPTH, NEVER_WALKED, ancestors, ignored, last_match, parse_patterns, walked_dirs
from ..operators.matches import combine_matches, sorted_set, suppressed_groups, suppressed_results
from ..operators.rules import NAME, Rule, analyze, load_default_rules, rules_from_table
from ..operators.tree import MINIMAL, TreeConfig, limit_at, top_per_group, tree_lines, tree_text
from . import roundtrips
from .tables import numbered, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return QUERIES | roundtrips.queries()


def oracle_sql() -> dict[str, str]:
    return SQL | roundtrips.sql(walked_sql)


def walked_sql(path: str) -> str:
    """Whether a walk with the default patterns visits a directory: neither it nor one above it is ignored, never walked, or too deep."""
    forms = "|".join(p.regex.removeprefix("(?s)^").removesuffix("$") for p in parse_patterns(DEFAULT_PATTERNS))
    never = "|".join(map(re.escape, NEVER_WALKED))
    return f"{path} = '.' OR NOT regexp_matches({path}, {quoted(f'(?s)^(?:{forms})(?:/|$)')}) AND NOT regexp_matches({path}, {quoted(f'(?:^|/)(?:{never})(?:/|$)')}) AND len(string_split({path}, '/')) <= {MAX_DEPTH}"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Text

HASH_SQL = r"regexp_replace({0}, '(?m)[\t\n\f\r ]*#.*$', '', 'g')"
SLASH_SQL = r"regexp_replace(regexp_replace({0}, '(?m)[\t\n\f\r ]*//.*$', '', 'g'), '(?s)/\*.*?\*/', '', 'g')"
HTML_SQL = "regexp_replace({0}, '(?s)<!--.*?-->', '', 'g')"
EMAIL_SQL = f"regexp_replace({{0}}, {quoted(T.EMAIL.replace('{', '{{').replace('}', '}}'))}, '{T.EMAIL_MARK}', 'g')"


def secrets_sql(column: str) -> str:
    for p in T.SECRETS:
        column = f"regexp_replace({column}, {quoted(p)}, '{T.SECRET_MARK}', 'g')"
    return f"regexp_replace({column}, {quoted(T.NAMED_SECRET)}, '\\1{T.SECRET_MARK}', 'g')"


def dispatch_sql(name: str, content: str) -> str:
    base = f"lower(regexp_extract({name}, '([^/]*)$', 1))"
    ending = f"regexp_extract({base}, '\\.([^.]*)$', 1)"
    among = lambda xs: "(" + ", ".join(map(quoted, xs)) + ")"
    return (
        f"CASE WHEN {base} IN {among(T.HASH_NAMES)} OR {ending} IN {among(T.HASH_ENDINGS)} THEN {HASH_SQL.format(content)} WHEN {ending} IN {among(T.SLASH_ENDINGS)} THEN {SLASH_SQL.format(content)} "
        f"WHEN {ending} IN {among(T.BOTH_ENDINGS)} THEN {HASH_SQL.format(SLASH_SQL.format(content))} WHEN {ending} IN {among(T.HTML_ENDINGS)} THEN {HTML_SQL.format(content)} ELSE {content} END"
    )


def dispatch_and_more(name: str, content: str) -> str:
    return EMAIL_SQL.format(secrets_sql(dispatch_sql(name, content)))


@query(f"SELECT file_id, {EMAIL_SQL.format('content')} AS content FROM selected_files")
def redact_emails(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "selected_files").select("file_id", T.redact_emails(F.col("content")).alias("content"))


@query(f"SELECT doc_id, {HASH_SQL.format('text')} AS text FROM documents")
def strip_hash_comments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.strip_hash_comments(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {SLASH_SQL.format('text')} AS text FROM documents")
def strip_slash_comments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.strip_slash_comments(F.col("text")).alias("text"))


@query(f"SELECT file_id, {HTML_SQL.format('content')} AS content FROM selected_files")
def strip_html_comments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "selected_files").select("file_id", T.strip_html_comments(F.col("content")).alias("content"))


@query(f"SELECT file_id, {dispatch_sql('name', 'content')} AS content FROM selected_files")
def comment_dispatch(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "selected_files").select("file_id", T.remove_comments(F.col("name"), F.col("content")).alias("content"))


@query(f"SELECT file_id, {secrets_sql('content')} AS content FROM selected_files")
def redact_secrets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "selected_files").select("file_id", T.redact_secrets(F.col("content")).alias("content"))


@query(f"WITH c AS (SELECT file_id, content, {dispatch_sql('name', 'content')} AS c1 FROM selected_files), s AS (SELECT file_id, content, {secrets_sql('c1')} AS c2 FROM c) SELECT file_id, {EMAIL_SQL.format('c2')} AS content, {EMAIL_SQL.format('c2')} <> content AS cleaned FROM s")
def clean_pipeline(spark: SparkSession, d: str) -> DataFrame:
    new = T.clean(F.col("name"), F.col("content"))
    return table(spark, d, "selected_files").select("file_id", new.alias("content"), (new != F.col("content")).alias("cleaned"))


@query("SELECT doc_id, strlen(text) > 2048 AS truncated, strlen(text) AS size FROM documents")
def truncated_flag(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.truncated(F.col("text").cast("binary")).alias("truncated"), F.octet_length("text").cast("bigint").alias("size"))


@query("SELECT repo, path, count(*) AS n FROM files WHERE content IS NOT NULL AND NOT regexp_matches(hex(content), '^(..)*00') AND TRY(decode(content)) IS NOT NULL GROUP BY ALL")
def is_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").filter(T.is_text(F.col("content"))).groupBy("repo", "path").agg(F.count("*").alias("n"))


# Patterns


@query("SELECT dep_id, name FROM deps WHERE name LIKE 'org.%:%or%'")
def wildcard_find(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "deps").filter(wildcard_match(F.col("name"), "org.*:*or*")).select("dep_id", "name")


@query("SELECT DISTINCT repo, path FROM files WHERE regexp_full_match(path, '[^/]*/[^/]*/[^/]*\\.[a-p][^/]')")
def glob_find(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").filter(glob_match(F.col("path"), "*/*/*.[a-p]?")).select("repo", "path").distinct()


@query("SELECT repo, path FROM files WHERE regexp_full_match(name, '[^/]*\\.py') UNION SELECT repo, path FROM files WHERE regexp_full_match(name, 'g[^/]*')")
def glob_union_distinct(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files")
    return f.filter(glob_match(F.col("name"), "*.py")).unionByName(f.filter(glob_match(F.col("name"), "g*"))).select("repo", "path").distinct()


@query("SELECT DISTINCT repo, path, CASE WHEN regexp_matches(path, '(^|/)keep[^/]*$') THEN false WHEN regexp_matches(path, '(^|/)[^/]*\\.rb$') THEN true WHEN is_dir AND regexp_matches(path, '(^|/)fixtures$') THEN true ELSE false END AS ignored FROM files")
def ignore_fixed_list(spark: SparkSession, d: str) -> DataFrame:
    patterns = parse_patterns(["fixtures/", "*.rb", "!keep*"])
    return table(spark, d, "files").select("repo", "path", ignored(F.col("path"), F.col("is_dir"), patterns).alias("ignored")).distinct()


@query("WITH n AS (SELECT DISTINCT repo, CASE WHEN is_dir AND NOT is_symlink THEN path ELSE dir END AS p FROM files), a AS (SELECT DISTINCT repo, array_to_string(list_slice(string_split(p, '/'), 1, i), '/') AS path FROM (SELECT repo, p, unnest(range(1, len(string_split(p, '/')) + 1)) AS i FROM n)) SELECT repo, path FROM a WHERE NOT regexp_matches(path, '(^|/)(legacy|fixtures)(/|$)') UNION SELECT DISTINCT repo, '.' FROM files")
def ignore_prune_ancestors(spark: SparkSession, d: str) -> DataFrame:
    return walked_dirs(table(spark, d, "files"), ["legacy/", "fixtures/"], use_gitignore=False, defaults=False)


@query("SELECT repo, path, count(*) AS n FROM (SELECT DISTINCT repo, path AS p, unnest(list_transform(range(1, len(string_split(path, '/')) + 1), lambda i: array_to_string(list_slice(string_split(path, '/'), 1, i), '/'))) AS path FROM files) GROUP BY ALL")
def ancestor_counts(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files").select("repo", "path").distinct()
    return f.select("repo", F.explode(ancestors(F.col("path"))).alias("path")).groupBy("repo", "path").agg(F.count("*").alias("n"))


# Rules

def event_hits(spark: SparkSession, d: str) -> DataFrame:
    """Users as directories, their event types as rules that hold there: the first type in the alphabet promises a certain result, the second an uncertain one, and so on."""
    e = table(spark, d, "events").select(F.col("user_id").alias("path"), F.col("event_type").alias("rule"))
    n = F.length("rule") % 3
    one = lambda s: F.array(F.concat(F.lit(s), F.substring("rule", 1, 1)))
    none = F.array().cast("array<string>")
    return e.select("path", "rule", F.when(n != 1, one("r-")).otherwise(none).alias("then"), F.when(n != 0, F.array(F.lit("r-a"), F.concat(F.lit("m-"), F.col("rule")))).otherwise(none).alias("maybe"), F.when(n == 2, none).otherwise(F.array(F.concat(F.lit("g"), (F.length("rule") % 2).cast("string")))).alias("groups"))


EVENT_SQL = """h AS (SELECT user_id AS path, event_type AS rule, CASE WHEN length(event_type) % 3 <> 1 THEN ['r-' || event_type[1]] ELSE [] END AS thens, CASE WHEN length(event_type) % 3 <> 0 THEN ['r-a', 'm-' || event_type] ELSE [] END AS maybes,
 CASE WHEN length(event_type) % 3 = 2 THEN [] ELSE ['g' || CAST(length(event_type) % 2 AS VARCHAR)] END AS groups FROM (SELECT DISTINCT user_id, event_type FROM events)),
c AS (SELECT path, rule, groups, unnest(thens) AS result FROM h), m AS (SELECT path, rule, groups, unnest(maybes) AS result FROM h)"""


@query(f"WITH {EVENT_SQL} SELECT path, result, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules FROM c GROUP BY ALL")
def match_group(spark: SparkSession, d: str) -> DataFrame:
    h = event_hits(spark, d).select("path", "rule", F.explode("then").alias("result"))
    return h.groupBy("path", "result").agg(F.array_join(sorted_set("rule"), ",").alias("rules"))


@query(f"WITH {EVENT_SQL} SELECT DISTINCT path, result FROM m WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.path = m.path AND c.result = m.result)")
def maybe_anti_result(spark: SparkSession, d: str) -> DataFrame:
    h = event_hits(spark, d)
    return suppressed_results(h.select("path", F.explode("maybe").alias("result")), h.select("path", F.explode("then").alias("result")), ["path"]).distinct()


@query(f"WITH {EVENT_SQL} SELECT DISTINCT path, result FROM m WHERE NOT EXISTS (SELECT 1 FROM m m2, c WHERE m2.path = m.path AND m2.result = m.result AND c.path = m.path AND list_has_any(m2.groups, c.groups))")
def maybe_anti_group(spark: SparkSession, d: str) -> DataFrame:
    h = event_hits(spark, d)
    return suppressed_groups(h.select("path", "groups", F.explode("maybe").alias("result")), h.select("path", "groups", F.explode("then").alias("result")), ["path"]).select("path", "result").distinct()


@query(
    f"""WITH {EVENT_SQL}, k AS (SELECT path, rule, groups, result, true AS maybe FROM m WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.path = m.path AND c.result = m.result)
 AND NOT EXISTS (SELECT 1 FROM m m2, c WHERE m2.path = m.path AND m2.result = m.result AND c.path = m.path AND list_has_any(m2.groups, c.groups)) UNION ALL SELECT path, rule, groups, result, false FROM c)
SELECT path, result, maybe, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules, array_to_string(list_sort(list_distinct(flatten(list(groups)))), ',') AS groups FROM k GROUP BY path, result, maybe"""
)
def maybe_exclusion(spark: SparkSession, d: str) -> DataFrame:
    c = combine_matches(event_hits(spark, d), ["path"])
    return c.select("path", "result", "maybe", F.array_join("rules", ",").alias("rules"), F.array_join("groups", ",").alias("groups"))


@query("SELECT o_orderkey, o_totalprice > 150000 AND (o_orderstatus = 'F' OR NOT (o_orderpriority LIKE '1-%')) AS hit FROM orders")
def rule_predicate(spark: SparkSession, d: str) -> DataFrame:
    v = {c: F.col(c) for c in ("o_totalprice", "o_orderstatus", "o_orderpriority")}
    hit = Compiler(v).compile('o_totalprice > 150000.0 && (o_orderstatus == "F" || !o_orderpriority.startsWith("1-"))')
    return table(spark, d, "orders").select("o_orderkey", hit.alias("hit"))


@query("WITH o AS (SELECT o_orderkey, CASE WHEN o_custkey % 3 <> 0 THEN o_totalprice > 100000 END AS a, CASE WHEN o_custkey % 5 <> 0 THEN o_orderstatus = 'O' END AS b FROM orders) SELECT o_orderkey, a AND b AS both, a OR b AS either, NOT a AS neg FROM o")
def kleene_error_logic(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 3 != 0, F.col("o_totalprice") > 100000).alias("a"), F.when(F.col("o_custkey") % 5 != 0, F.col("o_orderstatus") == "O").alias("b"))
    c = Compiler({"a": F.col("a"), "b": F.col("b")})
    return o.select("o_orderkey", c.compile("a && b").alias("both"), c.compile("a || b").alias("either"), c.compile("!a").alias("neg"))


@query("SELECT rule_id, regexp_full_match(name, '[a-z0-9][a-z0-9_.-]*[a-z0-9]') AS valid, regexp_full_match(upper(name), '[a-z0-9][a-z0-9_.-]*[a-z0-9]') AS upper_valid FROM rules")
def validate_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rules").select("rule_id", F.col("name").rlike(NAME.pattern).alias("valid"), F.upper("name").rlike(NAME.pattern).alias("upper_valid"))


# Dependencies


@query("SELECT repo, name, dep_id, version FROM deps QUALIFY row_number() OVER (PARTITION BY repo, name ORDER BY dep_id, loaded_at) = 1")
def first_seen_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return first_seen(table(spark, d, "deps").select("repo", "name", "dep_id", "version", "loaded_at"), ["repo", "name"], ["dep_id", "loaded_at"]).drop("loaded_at")


@query("SELECT dep_id, name FROM deps WHERE is_direct AND NOT is_dev_only")
def dep_filter_direct_dev(spark: SparkSession, d: str) -> DataFrame:
    return direct_only(table(spark, d, "deps")).select("dep_id", "name")


@query("SELECT dep_id, repo, path, name, version FROM deps WHERE manager = 'go' AND name LIKE 'code.%'")
def find_go_modules(spark: SparkSession, d: str) -> DataFrame:
    return find_deps(table(spark, d, "deps"), "go", "code.*").select("dep_id", "repo", "path", "name", "version")


@query("SELECT dep_id, coalesce(regexp_matches(version_constraint, '^[^\\[(><=^~*][^><=^~*]*$'), false) AS specific FROM deps")
def specific_version(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "deps").select("dep_id", is_specific_version(F.col("version_constraint")).alias("specific"))


@query(f"SELECT repo, name, {dispatch_and_more('name', 'content')} AS content, truncated, {dispatch_and_more('name', 'content')} <> content AS cleaned, size FROM selected_files")
def clean_selected(spark: SparkSession, d: str) -> DataFrame:
    return cleaned(table(spark, d, "selected_files").select("repo", "name", "content", "truncated", "size"))


@query(f"SELECT doc_id, coalesce({', '.join(f'TRY(decode(unhex(left(hex(encode(text)), {2 * n}))))' for n in range(T.LIMIT, T.LIMIT - 4, -1))}) AS content FROM documents")
def truncate_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.head(F.col("text").cast("binary")).alias("content"))


@query("SELECT repo, path, NOT coalesce(arg_max(negated, seq), true) AS ignored FROM (SELECT DISTINCT repo, path, is_dir FROM files) f LEFT JOIN (VALUES (1, '(^|/)[^/]*\\.go$', false, false), (2, '^tools(/|$)', false, false), (3, '(^|/)go\\.mod$', true, false), (4, '(^|/)apps$', false, true)) p(seq, regex, negated, dir_only) ON regexp_matches(path, regex) AND (NOT dir_only OR is_dir) GROUP BY repo, path, is_dir")
def ignore_last_match(spark: SparkSession, d: str) -> DataFrame:
    rows = [(1, r"(^|/)[^/]*\.go$", False, False), (2, "^tools(/|$)", False, False), (3, r"(^|/)go\.mod$", True, False), (4, "(^|/)apps$", False, True)]
    patterns = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(row, ("seq", "regex", "negated", "dir_only")))) for row in rows))
    hit = last_match(F.col("path"), F.col("is_dir"), patterns)
    return table(spark, d, "files").select("repo", "path", "is_dir").distinct().select("repo", "path", (~F.coalesce(hit["negated"], F.lit(True))).alias("ignored"))


#: All directories of the `files` table; and those that a walk visits, by the default patterns and the lines of ignore files (names, `*`, `!`, a slash at the end).
DIRS_SQL = """n AS (SELECT DISTINCT repo, CASE WHEN is_dir AND NOT is_symlink THEN path ELSE dir END AS p FROM files),
a AS (SELECT DISTINCT repo, array_to_string(list_slice(string_split(p, '/'), 1, i), '/') AS path FROM (SELECT repo, p, unnest(range(1, len(string_split(p, '/')) + 1)) AS i FROM n) WHERE p <> ''),
l AS (SELECT repo, dir, CASE WHEN dir = '.' THEN 0 ELSE len(string_split(dir, '/')) END AS depth, unnest(string_split(decode(content), chr(10))) AS line, generate_subscripts(string_split(decode(content), chr(10)), 1) AS line_no
  FROM files WHERE name = '.gitignore' AND NOT is_dir AND TRY(decode(content)) IS NOT NULL),
g AS (SELECT repo, dir, depth * 1000000 + line_no AS seq, line LIKE '!%' AS negated, rtrim(ltrim(rtrim(line), '!'), '/') AS form FROM l WHERE trim(line) <> '' AND line NOT LIKE '#%'),
h AS (SELECT a.repo, a.path, arg_max(negated, seq) AS negated FROM a JOIN g ON a.repo = g.repo AND (g.dir = '.' OR starts_with(a.path, g.dir || '/'))
  AND CASE WHEN contains(form, '/') THEN a.path = CASE WHEN g.dir = '.' THEN '' ELSE g.dir || '/' END || ltrim(form, '/') ELSE regexp_full_match(regexp_extract(a.path, '([^/]*)$', 1), replace(regexp_escape(form), '\\*', '.*')) END GROUP BY ALL),
o AS (SELECT a.repo, a.path FROM a LEFT JOIN h USING (repo, path) WHERE a.path <> '.' AND (coalesce(NOT negated, NOT ({alone})) OR NOT ({never}))),
w AS (SELECT repo, path FROM a WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.repo = a.repo AND (o.path = a.path OR starts_with(a.path, o.path || '/'))) UNION SELECT DISTINCT repo, '.' FROM files)"""


def dirs_sql() -> str:
    forms = "|".join(p.regex.removeprefix("(?s)^").removesuffix("$") for p in parse_patterns(DEFAULT_PATTERNS))
    never = "|".join(map(re.escape, NEVER_WALKED))
    alone = f"NOT regexp_matches(a.path, {quoted(f'(?s)^(?:{forms})$')})"
    return DIRS_SQL.replace("{alone}", alone).replace("{never}", f"NOT regexp_matches(a.path, {quoted(f'(?:^|/)(?:{never})$')}) AND len(string_split(a.path, '/')) <= {MAX_DEPTH}")


@query(f"WITH {dirs_sql()} SELECT repo, path FROM w")
def walk_with_ignore_files(spark: SparkSession, d: str) -> DataFrame:
    return walked_dirs(table(spark, d, "files"))


@query(f"WITH {DIRS_SQL[: DIRS_SQL.index('l AS (SELECT')].rstrip().rstrip(',')} SELECT repo, path FROM a WHERE len(string_split(path, '/')) <= 2 AND NOT regexp_matches(path, '(^|/)(\\.git|node_modules)(/|$)') UNION SELECT DISTINCT repo, '.' FROM files")
def walk_to_a_depth(spark: SparkSession, d: str) -> DataFrame:
    return walked_dirs(table(spark, d, "files"), use_gitignore=False, defaults=False, max_depth=2)


KEPT_SQL = "len(list_filter(map_entries(coalesce(with_values, MAP {})), lambda e: e.value.error IS NULL AND e.value.value <> ''))"


@query(f"SELECT repo, path, ruleset, coalesce(result, '') AS result, {KEPT_SQL} AS n_with, count(*) AS n FROM reports WHERE NOT maybe GROUP BY ALL")
def reports_of_digests(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("report")
    own = certain_reports(table(spark, d, "reports")).select("repo", "path", r["ruleset"].alias("ruleset"), F.coalesce(r["result"], F.lit("")).alias("result"), F.size(r["with"]).cast("bigint").alias("n_with"))
    return own.groupBy(*own.columns).agg(F.count("*").alias("n"))


@query("SELECT repo, path, string_agg(ruleset || ':' || result, ',' ORDER BY ruleset, result) AS results FROM (SELECT DISTINCT ON (report_id) * FROM reports) WHERE NOT maybe AND result IS NOT NULL GROUP BY ALL")
def group_reports_by_path(spark: SparkSession, d: str) -> DataFrame:
    own = reports_by_path(table(spark, d, "reports").filter("result IS NOT NULL").dropDuplicates(["report_id"]))
    name = lambda x: F.concat(F.get_json_object(x, "$.ruleset"), F.lit(":"), F.get_json_object(x, "$.result"))
    return own.select("repo", "path", F.array_join(F.transform("reports", name), ",").alias("results"))


@query()
def repo_digest(spark: SparkSession, d: str) -> DataFrame:
    """The digests of all repos in parts: one repo holds a tenth of all files."""
    return digest_rows(table(spark, d, "files"), rules_from_table(table(spark, d, "rules")), fail_fast=False)


#: What the two kinds of manifests hold that the `files` table has in a form that any reader takes: npm's, and pip's where no project file takes its place.
FOUND_SQL = """pj AS (SELECT DISTINCT repo, dir AS path, decode(content)::JSON AS j FROM files WHERE name = 'package.json' AND NOT is_dir AND NOT is_symlink AND TRY(decode(content)) IS NOT NULL AND json_valid(decode(content)) AND json_type(decode(content)) = 'OBJECT'),
js AS (SELECT repo, path, name, arg_max(c, dev) AS c, max(dev) AS dev FROM (SELECT repo, path, unnest(json_keys(j, '$.dependencies')) AS name, json_extract_string(j, '$.dependencies."' || unnest(json_keys(j, '$.dependencies')) || '"') AS c, false AS dev FROM pj
  UNION ALL SELECT repo, path, unnest(json_keys(j, '$.devDependencies')), json_extract_string(j, '$.devDependencies."' || unnest(json_keys(j, '$.devDependencies')) || '"'), true FROM pj) GROUP BY ALL),
rq AS (SELECT repo, dir AS path, trim(unnest(string_split(decode(content), chr(10))), ' ' || chr(9) || chr(13)) AS line FROM (SELECT DISTINCT repo, dir, content FROM files f WHERE name = 'requirements.txt' AND NOT is_dir AND NOT is_symlink AND TRY(decode(content)) IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM files p WHERE p.repo = f.repo AND p.dir = f.dir AND p.name IN ('pyproject.toml', 'uv.lock', 'poetry.lock') AND p.content IS NOT NULL AND NOT p.is_dir AND NOT p.is_symlink))),
found AS (SELECT repo, path, 'js' AS manager, CASE WHEN name LIKE '@%/%' THEN string_split(name[2:], '/')[1] ELSE '' END AS vendor, name, c AS version_constraint, '' AS version, true AS is_direct, dev AS is_dev_only, 'npm' AS tool_name FROM js
  UNION ALL SELECT repo, path, 'python', '', regexp_extract(line, '^([\\w\\-.]+(?:\\[[^\\]]+\\])?)(.*)$', 1), regexp_extract(line, '^([\\w\\-.]+(?:\\[[^\\]]+\\])?)(.*)$', 2), '', true, false, 'pip' FROM rq WHERE line <> '' AND line NOT LIKE '#%' AND regexp_matches(line, '^[\\w\\-.]'))"""


@query(f"WITH {FOUND_SQL} SELECT * FROM found")
def repo_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return dependencies(table(spark, d, "files"))


# Expressions


def compiled(df: DataFrame, ids: list[str], expressions: dict[str, str]) -> DataFrame:
    c = Compiler({n: F.col(n) for n in df.columns}, schema=df.schema)
    return df.select(*ids, *(c.compile(e).alias(n) for n, e in expressions.items()))


@query("SELECT json_extract_string(props, '$.k') AS k, event_id FROM events")
def jq_path(spark: SparkSession, d: str) -> DataFrame:
    return compiled(table(spark, d, "events").select("event_id", F.col("props")), ["event_id"], {"k": 'jq(props, ".k")'})


@query(
    """SELECT p_partkey, length(p_name) AS n, contains(p_name, 'a') AS has_a, starts_with(p_type, 'S') AS starts, ends_with(p_type, 'L') AS ends, regexp_matches(p_brand, '#[1-3]') AS matches, instr(p_name, 'e') - 1 AS first_e,
 CASE WHEN contains(p_name, 'e') THEN length(p_name) - instr(reverse(p_name), 'e') ELSE -1 END AS last_e, lower(p_type) AS lower, upper(p_name) AS upper, replace(p_name, 'a', '_') AS replaced, array_to_string(string_split(p_type, ' '), '+') AS split_join,
 substring(p_name, 2, 3) AS sub, substring(p_name, 3, 1) AS at, trim('  ' || p_name || ' ') AS trimmed, reverse(p_name) AS reversed, '"' || p_name || '"' AS quoted, 'part ' || p_name || ' of ' || p_brand AS formatted, p_name || '/' || p_brand AS joined FROM part"""
)
def string_fns(spark: SparkSession, d: str) -> DataFrame:
    return compiled(
        table(spark, d, "part"), ["p_partkey"],
        {"n": "size(p_name)", "has_a": 'p_name.contains("a")', "starts": 'p_type.startsWith("S")', "ends": 'p_type.endsWith("L")', "matches": 'p_brand.matches("#[1-3]")', "first_e": 'p_name.indexOf("e")', "last_e": 'p_name.lastIndexOf("e")', "lower": "p_type.lowerAscii()", "upper": "p_name.upperAscii()",
         "replaced": 'p_name.replace("a", "_")', "split_join": 'p_type.split(" ").join("+")', "sub": "p_name.substring(1, 4)", "at": "p_name.charAt(2)", "trimmed": '("  " + p_name + " ").trim()', "reversed": "p_name.reverse()", "quoted": "strings.quote(p_name)", "formatted": '"part %s of %s".format([p_name, p_brand])', "joined": 'p_name + "/" + p_brand'},
    )


@query(
    """WITH l AS (SELECT o_orderkey, [o_custkey % 7, o_orderkey % 5, o_custkey % 3, o_orderkey % 5] AS x FROM orders) SELECT o_orderkey, array_to_string(list_transform(list_sort(x), lambda v: CAST(v AS VARCHAR)), ',') AS sorted, len(list_distinct(x)) AS n_distinct, array_to_string(list_transform(x[2:3], lambda v: CAST(v AS VARCHAR)), ',') AS sliced, list_contains(x, 4) AS has4,
 array_to_string(list_transform(list_reverse(x), lambda v: CAST(v AS VARCHAR)), ',') AS reversed, len(list_filter(x, lambda v: v > 1)) AS n_big, len(list_filter(x, lambda v: v > 1)) = len(x) AS all_big, len(list_filter(x, lambda v: v > 5)) > 0 AS any_huge, array_to_string(list_transform(x, lambda v: CAST(v + 1 AS VARCHAR)), ',') AS more, x[1] AS first, array_to_string(list_transform(range(x[2]), lambda v: CAST(v AS VARCHAR)), ',') AS counted FROM l"""
)
def list_fns(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.array(F.col("o_custkey") % 7, F.col("o_orderkey") % 5, F.col("o_custkey") % 3, F.col("o_orderkey") % 5).alias("x"))
    text = lambda e: f"{e}.map(v, string(v)).join(',')"
    return compiled(o, ["o_orderkey"], {
        "sorted": text("x.sort()"), "n_distinct": "x.distinct().size()", "sliced": text("x.slice(1, 3)"), "has4": "4 in x", "reversed": text("x.reverse()"), "n_big": "x.filter(v, v > 1).size()", "all_big": "x.all(v, v > 1)", "any_huge": "x.exists(v, v > 5)",
        "more": text("x.map(v, v + 1)"), "first": "x[0]", "counted": text("lists.range(x[1])"),
    })


@query("SELECT event_id, year(ts) AS y, month(ts) - 1 AS mo, day(ts) AS dm, day(ts) - 1 AS d0, dayofweek(ts) AS dow, dayofyear(ts) - 1 AS doy, hour(ts) AS h, minute(ts) AS mi, CAST(floor(second(ts)) AS BIGINT) AS s FROM events")
def date_fns(spark: SparkSession, d: str) -> DataFrame:
    return compiled(table(spark, d, "events"), ["event_id"], {"y": "ts.getFullYear()", "mo": "ts.getMonth()", "dm": "ts.getDate()", "d0": "ts.getDayOfMonth()", "dow": "ts.getDayOfWeek()", "doy": "ts.getDayOfYear()", "h": "ts.getHours()", "mi": "ts.getMinutes()", "s": "ts.getSeconds()"})


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(trunc(l_extendedprice) AS BIGINT) AS whole, CAST(l_linenumber AS DOUBLE) AS real, CAST(l_partkey AS VARCHAR) AS text, CAST(CAST(l_suppkey AS VARCHAR) AS BIGINT) AS again, l_quantity > 25 AS flag, CASE WHEN l_quantity > 25 THEN 'many' ELSE 'few' END AS word FROM lineitem")
def cast_fns(spark: SparkSession, d: str) -> DataFrame:
    return compiled(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"], {"whole": "int(l_extendedprice)", "real": "double(l_linenumber)", "text": "string(l_partkey)", "again": "int(string(l_suppkey))", "flag": "bool(l_quantity > 25.0)", "word": 'l_quantity > 25.0 ? "many" : "few"'})


@query("SELECT o_orderkey, o_custkey + o_orderkey AS a, o_custkey - o_orderkey AS b, o_custkey * 3 AS c, o_orderkey // 7 AS d, o_orderkey % 7 AS e, -o_custkey AS f, o_totalprice / 4.0 AS g FROM orders")
def arith_ops(spark: SparkSession, d: str) -> DataFrame:
    return compiled(table(spark, d, "orders"), ["o_orderkey"], {"a": "o_custkey + o_orderkey", "b": "o_custkey - o_orderkey", "c": "o_custkey * 3", "d": "o_orderkey / 7", "e": "o_orderkey % 7", "f": "-o_custkey", "g": "o_totalprice / 4.0"})


@query("SELECT o_orderkey, o_custkey = o_orderkey AS a, o_custkey <> o_orderkey AS b, o_custkey < o_orderkey AS c, o_totalprice <= 1000 AS d, o_custkey > 500 AS e, o_orderstatus >= 'O' AS f, o_orderstatus IN ('F', 'P') AS g FROM orders")
def compare_ops(spark: SparkSession, d: str) -> DataFrame:
    return compiled(table(spark, d, "orders"), ["o_orderkey"], {"a": "o_custkey == o_orderkey", "b": "o_custkey != o_orderkey", "c": "o_custkey < o_orderkey", "d": "o_totalprice <= 1000.0", "e": "o_custkey > 500", "f": 'o_orderstatus >= "O"', "g": 'o_orderstatus in ["F", "P"]'})


# Sorted output


@query("SELECT repo, path, name, manager, row_number() OVER (PARTITION BY repo, path, manager ORDER BY name, dep_id, loaded_at) AS position FROM deps WHERE name IS NOT NULL")
def deps_in_order(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "deps").filter("name IS NOT NULL").select("repo", "path", "manager", "name", "dep_id", "loaded_at")
    return numbered(own, ["repo", "path", "manager"], ["name", "dep_id", "loaded_at"], "position").select("repo", "path", "name", "manager", "position")


@query("SELECT repo, path, report_id, row_number() OVER (PARTITION BY repo ORDER BY path, ruleset, coalesce(result, ''), report_id, loaded_at) AS position FROM reports")
def reports_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Places in the order of reports, though one repo has a tenth of all."""
    own = table(spark, d, "reports").select("repo", "path", "ruleset", F.coalesce("result", F.lit("")).alias("result"), "report_id", "loaded_at")
    return numbered(own, ["repo"], ["path", "ruleset", "result", "report_id", "loaded_at"], "position").select("repo", "path", "report_id", "position")


@query(
    """SELECT event_id, strlen(event_type) AS n_bytes, 'string' AS kind, 'google.protobuf.Timestamp' AS stamp_kind, CAST(floor(epoch(ts)) AS BIGINT) AS stamp, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS written, CAST(event_id + 5 AS VARCHAR) AS unsigned, extract(millisecond FROM ts) % 1000 AS ms,
 CAST(user_id % 100 * 60 + 30 AS BIGINT) AS minutes, CAST((user_id % 100 * 3600 + 1800) // 3600 AS BIGINT) AS hours, json_extract_string(props, '$.k') AS yaml_k, event_type = 'click' OR event_type = 'view' AS listed, value IS NULL OR value > 50 AS not_false, CAST(date_part('hour', ts - INTERVAL 5 HOUR) AS BIGINT) AS hour_there,
 strftime(ts + INTERVAL 90 MINUTE, '%Y-%m-%dT%H:%M:%SZ') AS later, hex(encode(event_type)) AS hexed, bin(user_id) AS bits FROM events"""
)
def other_fns(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("stamp_text", F.date_format(F.date_trunc("second", "ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).withColumn("length", F.concat((F.col("user_id") % 100).cast("string"), F.lit("h30m")))
    plain = {
        "n_bytes": "bytes(event_type).size()", "kind": "type(dyn(event_type))", "stamp_kind": "type(timestamp(stamp_text))", "stamp": "int(timestamp(stamp_text))", "written": "string(timestamp(stamp_text))", "unsigned": "string(uint(event_id) + 5u)", "minutes": "duration(length).getMinutes()", "hours": "duration(length).getHours()",
        "yaml_k": 'yq(bytes(props), ".k")', "listed": '@in(event_type, ["click", "view"])', "not_false": "@not_strictly_false(value > 50.0)", "hour_there": 'timestamp(stamp_text).getHours("-05:00")', "later": 'string(timestamp(stamp_text) + duration("1h30m"))', "hexed": '"%X".format([event_type])', "bits": '"%b".format([user_id])', "ms": "ts.getMilliseconds()",
    }
    return compiled(e, ["event_id"], plain)


@query(
    """SELECT o_orderkey, array_to_string(list_transform(flatten([[o_custkey % 3], [o_orderkey % 5, 7]]), lambda v: CAST(v AS VARCHAR)), ',') AS flat, array_to_string(list_transform(list_sort([{'k': o_custkey % 7, 'i': 0, 'v': 10}, {'k': o_orderkey % 7, 'i': 1, 'v': 20}, {'k': 3, 'i': 2, 'v': 30}]), lambda p: CAST(p.v AS VARCHAR)), ',') AS by_key,
 len(list_filter([o_custkey % 3, o_orderkey % 3, 1], lambda v: v = 1)) = 1 AS one, o_custkey % 4 = 0 OR o_totalprice > 200000 AS absorbed, CASE WHEN o_custkey % 4 <> 0 THEN o_orderkey // (o_custkey % 4) END AS quotient, CAST(o_custkey % 3 AS VARCHAR) || '/' || CAST(o_orderkey % 5 AS VARCHAR) AS shown, o_orderstatus || o_orderpriority AS joined, o_totalprice / (o_custkey + 0.5) AS ratio,
 CASE WHEN length(o_orderpriority) >= 6 THEN substring(o_orderpriority, 6, 1) END AS sixth, TRY_CAST(o_orderpriority[1] AS BIGINT) AS first_digit, o_orderpriority = '1-URGENT' AS urgent FROM orders"""
)
def typed_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns only: types come from the table, and errors are null."""
    o = table(spark, d, "orders").withColumn("nested", F.array(F.array(F.col("o_custkey") % 3), F.array(F.col("o_orderkey") % 5, F.lit(7)))).withColumn("keys", F.array(F.col("o_custkey") % 7, F.col("o_orderkey") % 7, F.lit(3))).withColumn("rest", F.col("o_custkey") % 4).withColumn("half", F.col("o_custkey") + F.lit(0.5).cast("double"))
    return compiled(o, ["o_orderkey"], {
        "flat": "nested.flatten().map(v, string(v)).join(',')", "by_key": "[10, 20, 30].@sortByAssociatedKeys(keys).map(v, string(v)).join(',')", "one": "[o_custkey % 3, o_orderkey % 3, 1].exists_one(v, v == 1)", "absorbed": "o_totalprice > 200000.0 || !(rest != 0 && o_orderkey / rest >= 0)", "quotient": "o_orderkey / rest", "shown": '"%d/%s".format([o_custkey % 3, o_orderkey % 5])',
        "joined": "o_orderstatus + o_orderpriority", "ratio": "o_totalprice / half", "sixth": "o_orderpriority.size() >= 6 ? o_orderpriority.charAt(5) : [\"\"][7]", "first_digit": "int(o_orderpriority.substring(0, 1))", "urgent": 'o_orderpriority.split("-")[1] == "URGENT"',
    })


#: Of the files f (repo, path, size, content): those that no root-level `.aiignore` or `.aiexclude` hides and that are text.
SELECTED_SQL = """l AS (SELECT repo, CASE name WHEN '.aiignore' THEN 0 ELSE 1000000 END AS base, unnest(string_split(decode(content), chr(10))) AS line, generate_subscripts(string_split(decode(content), chr(10)), 1) AS line_no FROM files WHERE name IN ('.aiignore', '.aiexclude') AND dir = '.' AND NOT is_dir AND TRY(decode(content)) IS NOT NULL),
g AS (SELECT repo, base + line_no AS seq, line LIKE '!%' AS negated, rtrim(line) LIKE '%/' AS dir_only, rtrim(ltrim(rtrim(line), '!'), '/') AS form FROM l WHERE trim(line) <> '' AND line NOT LIKE '#%'),
a AS (SELECT repo, path AS file, unnest(list_transform(range(1, len(string_split(path, '/')) + 1), lambda i: array_to_string(list_slice(string_split(path, '/'), 1, i), '/'))) AS path FROM f),
h AS (SELECT a.repo, a.file, a.path, arg_max(negated, seq) AS negated FROM a JOIN g ON a.repo = g.repo AND (NOT dir_only OR a.path <> a.file)
  AND CASE WHEN contains(form, '/') THEN a.path = ltrim(form, '/') ELSE regexp_full_match(regexp_extract(a.path, '([^/]*)$', 1), replace(regexp_escape(form), '\\*', '.*')) END GROUP BY ALL),
t AS (SELECT repo, path AS name, decode(content) AS content, octet_length(content) > 2048 AS truncated, coalesce(size, octet_length(content)) AS size FROM f WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.repo = f.repo AND h.file = f.path AND NOT negated) AND NOT regexp_matches(hex(content), '^(..)*00') AND TRY(decode(content)) IS NOT NULL)"""


@query(
    f"""WITH f AS (SELECT DISTINCT repo, path, size, content FROM files WHERE NOT is_dir AND NOT is_symlink AND content IS NOT NULL AND (regexp_full_match(path, '[^/]*\\.md') OR path = 'Makefile' OR regexp_full_match(path, '[^/]*/[^/]*\\.toml') OR regexp_full_match(path, '[^/]*/[^/]*/[a-m][^/]*\\.(json|mod)'))),
{SELECTED_SQL} SELECT * FROM t"""
)
def selected_by_globs(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files")
    globs = F.explode(F.array(*map(F.lit, ("*.md", "Makefile", "*/*.toml", "*/*/[a-m]*.json", "*/*/[a-m]*.mod"))))
    return read_files(f, f.select("repo").distinct().select("repo", F.lit(".").alias("path"), globs.alias("pattern")))


# Trees


@query("WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, count(*) OVER (PARTITION BY l_orderkey) AS size, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS position FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, position, CASE WHEN size > 3 THEN size - 2 ELSE 0 END AS removed FROM r WHERE size <= 3 OR position <= 2")
def topk_with_more(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")  # noqa: E741
    return top_per_group(l, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], 2).drop("l_suppkey")


@query("WITH e AS (SELECT 1 AS depth, CAST(n_regionkey AS BIGINT) AS parent, n_name AS name FROM nation UNION ALL SELECT 2, s_nationkey, s_name FROM supplier), r AS (SELECT *, count(*) OVER (PARTITION BY depth, parent) AS size, row_number() OVER (PARTITION BY depth, parent ORDER BY name) AS position FROM e) SELECT depth, parent, name, position FROM r WHERE size <= floor(8 * 0.5 ** depth) + 1 OR position <= floor(8 * 0.5 ** depth)")
def tree_levels_decay(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.lit(1).alias("depth"), F.col("n_regionkey").cast("bigint").alias("parent"), F.col("n_name").alias("name"))
    s = table(spark, d, "supplier").select(F.lit(2).alias("depth"), F.col("s_nationkey").cast("bigint").alias("parent"), F.col("s_name").alias("name"))
    config = TreeConfig(max_entries=8, factor=0.5)
    return top_per_group(n.unionByName(s), ["depth", "parent"], ["name"], limit_at(F.col("depth"), config)).select("depth", "parent", "name", "position")


@query("WITH n AS (SELECT r_name AS path, '' AS dir, r_name AS name, 0 AS depth FROM region UNION ALL SELECT r_name || '/' || n_name, r_name, n_name, 1 FROM nation JOIN region ON n_regionkey = r_regionkey), l AS (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY name DESC) = 1 AS is_last FROM n) SELECT 'world' AS repo, CASE WHEN l.depth = 0 THEN '' WHEN p.is_last THEN '  ' ELSE '│ ' END || CASE WHEN l.is_last THEN '└ ' ELSE '├ ' END || l.name AS line, 1 + row_number() OVER (ORDER BY replace(l.path, '/', chr(1))) AS line_no FROM l LEFT JOIN l p ON l.dir = p.path UNION ALL SELECT 'world', '.', 1")
def tree_render(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    files = n.select(F.lit("world").alias("repo"), F.concat("r_name", F.lit("/"), "n_name").alias("path"), F.col("r_name").alias("dir"), F.col("n_name").alias("name"), F.lit(False).alias("is_dir"), F.lit(False).alias("is_symlink"), F.lit(0).cast("bigint").alias("size"), F.lit(None).cast("binary").alias("content"))
    return tree_lines(files, TreeConfig(use_gitignore=False))


def tree_sql() -> str:
    """The tree of a digest, whose connectors are all blanks: a name stands by two blanks for each level. Patterns as in `DIRS_SQL`."""
    forms = lambda dir_only: "|".join(p.regex.removeprefix("(?s)^").removesuffix("$") for p in parse_patterns(DEFAULT_PATTERNS) if p.dir_only is dir_only)
    base = f"(regexp_matches(s.path, {quoted(f'(?s)^(?:{forms(False)})$')}) OR s.is_dir AND regexp_matches(s.path, {quoted(f'(?s)^(?:{forms(True)})$')}))"
    patterns = DIRS_SQL[DIRS_SQL.index("l AS (SELECT repo, dir") : DIRS_SQL.index("h AS (SELECT a.repo")].replace("AS negated, rtrim(ltrim", "AS negated, rtrim(line) LIKE '%/' AS dir_only, rtrim(ltrim")
    limit = lambda depth: f"CAST(floor({MINIMAL.max_entries} * {MINIMAL.factor} ** {depth}) AS BIGINT)"
    return f"""WITH {patterns} i AS (SELECT DISTINCT repo, dir AS p FROM files WHERE dir NOT IN ('.', '')),
n AS (SELECT repo, path, max(is_dir) AS is_dir FROM (SELECT repo, path, is_dir AND NOT is_symlink AS is_dir FROM files WHERE path NOT IN ('.', '')
  UNION ALL SELECT repo, array_to_string(list_slice(string_split(p, '/'), 1, k), '/'), true FROM (SELECT repo, p, unnest(range(1, len(string_split(p, '/')) + 1)) AS k FROM i)) GROUP BY ALL),
m AS (SELECT *, len(string_split(path, '/')) - 1 AS depth, regexp_extract(path, '([^/]*)$', 1) AS name, CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/', 1) ELSE '.' END AS dir FROM n WHERE len(string_split(path, '/')) - 1 <= {MINIMAL.max_depth}),
q AS (SELECT *, count(*) OVER (PARTITION BY repo, dir) AS size, row_number() OVER (PARTITION BY repo, dir ORDER BY name) AS position FROM m),
s AS (SELECT * FROM q WHERE size <= {limit('depth')} + 1 OR position <= {limit('depth')}),
h AS (SELECT s.repo, s.path, arg_max(negated, seq) AS negated FROM s JOIN g ON s.repo = g.repo AND (g.dir = '.' OR starts_with(s.path, g.dir || '/')) AND (NOT dir_only OR s.is_dir)
  AND CASE WHEN contains(form, '/') THEN s.path = CASE WHEN g.dir = '.' THEN '' ELSE g.dir || '/' END || ltrim(form, '/') ELSE regexp_full_match(regexp_extract(s.path, '([^/]*)$', 1), replace(regexp_escape(form), '\\*', '.*')) END GROUP BY ALL),
v AS (SELECT s.* FROM s LEFT JOIN h USING (repo, path) WHERE NOT coalesce(NOT negated, {base}) AND name NOT IN ({', '.join(map(quoted, NEVER_WALKED))})),
e AS (SELECT repo, dir, path AS key, repeat('  ', depth + 1) || name AS line FROM v UNION ALL
  SELECT repo, dir, CASE WHEN dir = '.' THEN '' ELSE dir || '/' END || chr(1114111), repeat('  ', any_value(depth)) || '  ... (' || (any_value(size) - any_value({limit('depth')})) || ' more)' FROM q GROUP BY repo, dir HAVING any_value(size) > any_value({limit('depth')}) + 1),
f AS (SELECT e.* FROM e WHERE dir = '.' OR len(list_filter(range(1, len(string_split(dir, '/')) + 1), lambda k: true)) = (SELECT count(*) FROM v WHERE v.repo = e.repo AND v.is_dir AND (v.path = e.dir OR starts_with(e.dir, v.path || '/'))))
SELECT repo, string_agg(line, chr(10) ORDER BY replace(key, '/', chr(1))) AS tree FROM (SELECT repo, key, line FROM f UNION ALL SELECT DISTINCT repo, '', '.' FROM files) GROUP BY ALL"""


@query(tree_sql())
def repo_tree(spark: SparkSession, d: str) -> DataFrame:
    return tree_text(table(spark, d, "files"), MINIMAL)


#: Every directory with every rule of the `rules` table, and whether the rule holds there: true, false, or null for an error.
RULES_SQL = f"""{dirs_sql()}, {FOUND_SQL},
r AS (SELECT ruleset, name, coalesce(then_results, []) AS thens, coalesce(maybe_results, []) AS maybes, coalesce(group_names, []) AS groups, coalesce(ignore_dirs, []) AS ignores, when_expr, regexp_extract_all(when_expr, '"([^"]*)"', 1) AS args FROM rules),
x AS (SELECT w.repo, w.path, r.* FROM w, r WHERE len(list_filter(ignores, lambda i: regexp_extract(w.path, '([^/]*)$', 1) = rtrim(i, '/'))) = 0),
y AS (SELECT repo, path, bool_or(is_dir) AS is_dir, arg_max(content, content IS NOT NULL) AS content FROM (SELECT repo, path, is_dir AND NOT is_symlink AS is_dir, content FROM files UNION ALL SELECT repo, path, true, NULL FROM a) GROUP BY ALL),
z AS (SELECT x.*, CASE
  WHEN when_expr LIKE 'fs.fileExists(%' THEN f.path IS NOT NULL
  WHEN when_expr LIKE 'fs.isDir(%) || fs.fileExists(%' THEN coalesce(f.is_dir, false) OR g.path IS NOT NULL
  WHEN when_expr LIKE 'fs.fileContains(%' THEN CASE WHEN f.path IS NOT NULL AND NOT f.is_dir THEN contains(coalesce(TRY(decode(f.content)), ''), args[2]) END
  WHEN when_expr LIKE 'fs.depExists(%' THEN EXISTS (SELECT 1 FROM found d WHERE d.repo = x.repo AND d.path = x.path AND d.manager = args[1] AND (d.name = args[2] OR d.name LIKE replace(args[2], '*', '%') AND args[2] LIKE '%*%')) END AS holds
  FROM x LEFT JOIN y f ON f.repo = x.repo AND f.path = CASE WHEN x.path = '.' THEN '' ELSE x.path || '/' END || args[1] LEFT JOIN y g ON g.repo = x.repo AND g.path = CASE WHEN x.path = '.' THEN '' ELSE x.path || '/' END || args[2]),
c AS (SELECT repo, path, ruleset, name, groups, unnest(thens) AS result FROM z WHERE holds), m AS (SELECT repo, path, ruleset, name, groups, unnest(maybes) AS result FROM z WHERE holds),
k AS (SELECT *, true AS maybe FROM m WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.repo = m.repo AND c.path = m.path AND c.ruleset = m.ruleset AND c.result = m.result)
  AND NOT EXISTS (SELECT 1 FROM m m2, c WHERE m2.repo = m.repo AND m2.path = m.path AND m2.ruleset = m.ruleset AND m2.result = m.result AND c.repo = m.repo AND c.path = m.path AND c.ruleset = m.ruleset AND list_has_any(m2.groups, c.groups)) UNION ALL SELECT *, false FROM c)
SELECT repo, path, ruleset, result, '' AS error, string_agg(DISTINCT name, ',' ORDER BY name) AS rules, maybe FROM k GROUP BY ALL
UNION ALL SELECT repo, path, ruleset, '', ruleset || '/' || name || ': evaluation error', name, false FROM z WHERE holds IS NULL"""


def reports_shown(reports: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return reports.select("repo", "path", "ruleset", text("result"), text("error"), F.array_join("rules", ",").alias("rules"), "maybe")


@query(f"WITH {RULES_SQL}")
def repo_reports(spark: SparkSession, d: str) -> DataFrame:
    return reports_shown(analyze(table(spark, d, "files"), rules_from_table(table(spark, d, "rules")), fail_fast=False))


#: Rules of the same forms that the files of the test tables do meet, against a made `rules` table.
OWN_RULES = [
    Rule("frameworks", "alpha", 'fs.fileExists("README.md")', ("documented",), ("plain",), groups=("docs",)),
    Rule("frameworks", "beta", 'fs.fileContains("package.json", "dependencies")', ("listed",), groups=("js",)),
    Rule("frameworks", "gamma", 'fs.isDir("src") || fs.fileExists("Makefile")', (), ("plain", "built"), groups=("docs", "make")),
    Rule("frameworks", "delta", 'fs.depExists("python", "*or*")', ("snake",), ("built",), groups=("py",)),
    Rule("managers", "eps", 'fs.fileExists("go.mod")', ("documented", "listed"), ("snake",), ignore=("apps/",)),
    Rule("managers", "zeta", 'fs.depExists("js", "*")', (), ("snake", "npm"), groups=("js",)),
]


def rules_sql(rules: list[Rule]) -> str:
    array = lambda xs: "[" + ", ".join(map(quoted, xs)) + "]::VARCHAR[]"
    rows = " UNION ALL ".join(f"SELECT {quoted(r.ruleset)} AS ruleset, {quoted(r.name)} AS name, {quoted(r.when)} AS when_expr, {array(r.then)} AS then_results, {array(r.maybe)} AS maybe_results, {array(r.groups)} AS group_names, {array(r.ignore)} AS ignore_dirs" for r in rules)
    return RULES_SQL.replace("FROM rules)", f"FROM ({rows}))")


@query(f"WITH {rules_sql(OWN_RULES)}")
def repo_reports_own_rules(spark: SparkSession, d: str) -> DataFrame:
    return reports_shown(analyze(table(spark, d, "files"), OWN_RULES, fail_fast=False))


@query()
def default_rule_reports(spark: SparkSession, d: str) -> DataFrame:
    return certain_reports(analyze(table(spark, d, "files"), load_default_rules(), fail_fast=False)).select("repo", "path", "report.*")


@query(
    f"""WITH rep AS (SELECT DISTINCT repo, path FROM (WITH {rules_sql(OWN_RULES)}) UNION SELECT DISTINCT repo, '.' FROM files),
f AS (SELECT DISTINCT files.repo, files.path, size, content FROM files JOIN rep ON rep.repo = files.repo AND rep.path = files.dir WHERE NOT is_dir AND NOT is_symlink AND content IS NOT NULL AND name IN ({', '.join(map(quoted, DEFAULT_READ_FILES))})),
{SELECTED_SQL} SELECT repo, 'file' AS section, name AS key, {dispatch_and_more('name', 'content')} AS content, {dispatch_and_more('name', 'content')} <> content AS cleaned, size FROM t
UNION ALL SELECT repo, 'report', path, ruleset || ':' || result, false, NULL FROM (WITH {rules_sql(OWN_RULES)}) WHERE NOT maybe AND error = ''"""
)
def digest_sections(spark: SparkSession, d: str) -> DataFrame:
    """Selected files and reports of the digests of all repos."""
    rows = digest_rows(table(spark, d, "files"), OWN_RULES, fail_fast=False).filter("section <> 'tree'")
    value = lambda k: F.get_json_object("value", f"$.{k}")
    told = F.col("section") == "report"
    own = rows.filter(~told | value("result").isNotNull())
    return own.select("repo", "section", "key", F.when(told, F.concat(value("ruleset"), F.lit(":"), value("result"))).otherwise(value("content")).alias("content"), F.coalesce(value("cleaned").cast("boolean"), F.lit(False)).alias("cleaned"), value("size").cast("bigint").alias("size"))
