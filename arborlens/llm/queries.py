"""Queries over the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import table
from .cooccurrence import pair_counts
from .credentials import credentials, redact_credentials
from .frequent import frequent_values
from .leakage import leaks
from .lookalike import lookalikes, parsed_records
from .personal import personal_items, redact_personal
from .stuffing import stuffed_pages
from .tokenise import decode_corpus, encode_corpus

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_items(table(spark, sf_dir, "selected_files")).select("file_id", "line_no", "kind").distinct()


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact_personal(table(spark, sf_dir, "selected_files").select("file_id", "name", "content"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials(table(spark, sf_dir, "selected_files")).select("file_id", "line_no").distinct()


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact_credentials(table(spark, sf_dir, "selected_files").select("file_id", "name", "content"))


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = pair_counts(table(spark, sf_dir, "deps"), "manager", ["repo", "path"], "name", min_count=6, one_in=50)
    results = pair_counts(table(spark, sf_dir, "reports"), None, ["repo"], "result", min_count=6, one_in=50)
    return names.withColumn("field", F.lit("name")).unionByName(results.withColumn("field", F.lit("result")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = {c: F.col(c).cast("decimal(18,0)") for c in ("n_ab", "n_a", "n_b", "n_baskets")}
    often = 2 * wide["n_ab"] * wide["n_baskets"] >= 5 * wide["n_a"] * wide["n_b"]
    return p3_pairs(spark, sf_dir).filter(often).select("field", "item_a", "item_b").distinct()


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent_values(table(spark, sf_dir, "deps"), ["name", "vendor"], {"name": 200, "vendor": 100})


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_counts(spark, sf_dir).select("field", "item")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    deps = table(spark, sf_dir, "deps").filter(F.col("name").isNotNull())
    copies = lookalikes(deps, "dep_id", ["name", "tool_name"], ["repo", "path", "manager", "version", "version_constraint"])
    records = parsed_records(table(spark, sf_dir, "dep_records"))
    others = lookalikes(records, "id", ["name", "tool_name"], ["repo", "path", "version"])
    return copies.select(F.lit("deps").alias("source_table"), "kept_id", "copy_id").unionByName(others.select(F.lit("dep_records").alias("source_table"), "kept_id", "copy_id"))


def p5_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_found(spark, sf_dir).filter("source_table = 'deps'").select("kept_id", "copy_id")


def p5_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept record of each group of two or more and its number of copies."""
    return p5_found(spark, sf_dir).groupBy("source_table", "kept_id").agg((F.count("*") + 1).alias("n_copies"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_corpus(p6_ids(spark, sf_dir))


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).filter("exact").select("doc_id", "item_id").distinct()


def p8_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffed_pages(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_pages(spark, sf_dir).select("doc_id").distinct()


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_redacted, p2_found, p2_redacted, p3_found, p3_pairs, p4_found, p4_counts, p5_found, p5_copies, p5_deps, p6_ids, p6_decoded, p7_found, p7_leaks, p8_found, p8_pages)}

PAIRS_SQL = """
WITH b AS (
  SELECT DISTINCT 'name' AS field, manager AS g, repo, path, name AS item FROM deps WHERE name IS NOT NULL
  UNION ALL SELECT DISTINCT 'result', 'all', repo, NULL, result FROM reports WHERE result IS NOT NULL
), s AS (SELECT field, g, count(*) AS n_baskets FROM (SELECT DISTINCT field, g, repo, path FROM b) GROUP BY ALL),
i AS (SELECT b.field, b.g, item, count(*) AS n, any_value(n_baskets) AS n_baskets FROM b JOIN s ON b.field = s.field AND b.g = s.g
      GROUP BY ALL HAVING count(*) >= 6 AND count(*) * 50 >= any_value(n_baskets)),
f AS (SELECT b.* FROM b JOIN i ON b.field = i.field AND b.g = i.g AND b.item = i.item),
p AS (SELECT x.field, x.g, x.item AS item_a, y.item AS item_b, count(*) AS n_ab FROM f x JOIN f y
      ON x.field = y.field AND x.g = y.g AND x.repo = y.repo AND x.path IS NOT DISTINCT FROM y.path AND x.item < y.item GROUP BY ALL)
SELECT p.field, p.g AS "group", item_a, item_b, n_ab, a.n AS n_a, c.n AS n_b, a.n_baskets, n_ab * a.n_baskets / (a.n * c.n) AS lift
FROM p JOIN i a ON p.field = a.field AND p.g = a.g AND item_a = a.item JOIN i c ON p.field = c.field AND p.g = c.g AND item_b = c.item
WHERE n_ab >= 6 AND n_ab * 50 >= a.n_baskets
"""

COUNTS_SQL = """
WITH v AS (SELECT 'name' AS field, name AS item, 200 AS one_in FROM deps UNION ALL SELECT 'vendor', vendor, 100 FROM deps),
t AS (SELECT field, item, count(*) AS n, any_value(one_in) AS one_in FROM v WHERE item <> '' GROUP BY ALL)
SELECT field, item, n, total FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY field) AS BIGINT) AS total FROM t) WHERE n * one_in >= total
"""

LOOKS_SQL = """
WITH o AS (SELECT DISTINCT dep_id, repo, path, manager, version, version_constraint, regexp_replace(lower(name), '[^\\p{L}\\p{Nd}]', '', 'g') AS n, regexp_replace(lower(tool_name), '[^\\p{L}\\p{Nd}]', '', 'g') AS t FROM deps WHERE name IS NOT NULL),
g AS (SELECT dep_id, min(dep_id) OVER (PARTITION BY repo, path, manager, version, version_constraint, n, t) AS kept_id FROM o)
SELECT DISTINCT kept_id, dep_id AS copy_id FROM g WHERE dep_id <> kept_id
"""

RECORDS_SQL = r"""
WITH raw AS (SELECT DISTINCT record_id, payload, CASE WHEN ltrim(payload, E' \t\r\n') LIKE '{%' THEN 'json' END AS form FROM dep_records WHERE payload IS NOT NULL),
jv AS (SELECT record_id, payload::JSON AS j FROM raw WHERE form = 'json' AND json_valid(payload)),
jp AS (SELECT record_id, 'json' AS cut, unnest(json_keys(j)) AS key, unnest(list_transform(json_keys(j), lambda k: coalesce(json_extract_string(j, '$."' || replace(k, '"', '\"') || '"'), ''))) AS value FROM jv),
pc AS (SELECT record_id, cut, unnest(CASE cut WHEN ';' THEN string_split(payload, ';') WHEN '|' THEN string_split(payload, '|') ELSE string_split(regexp_replace(payload, '\r\n|\r', chr(10), 'g'), chr(10)) END) AS piece FROM raw, (VALUES (';'), ('|'), ('line')) c(cut) WHERE form IS NULL),
tp AS (SELECT record_id, cut, string_split(piece, CASE cut WHEN ';' THEN '=' ELSE ':' END)[1] AS key, substring(piece, length(string_split(piece, CASE cut WHEN ';' THEN '=' ELSE ':' END)[1]) + 2) AS value FROM pc WHERE contains(piece, CASE cut WHEN ';' THEN '=' ELSE ':' END)),
kv AS (SELECT record_id, cut, lower(regexp_replace(key, '[^\p{L}\p{N}]', '', 'g')) AS key, value FROM (SELECT * FROM jp UNION ALL SELECT * FROM tp)),
one AS (SELECT record_id, cut, max(value) FILTER (key = 'repo') AS repo, max(value) FILTER (key = 'path') AS path, max(value) FILTER (key = 'name') AS name, max(value) FILTER (key = 'toolname') AS tool, max(value) FILTER (key = 'version') AS version, count(DISTINCT key) FILTER (key IN ('repo', 'path', 'name', 'toolname', 'version')) AS n FROM kv GROUP BY ALL),
rec AS (SELECT record_id, trim(repo, E' \t\r\n') AS repo, trim(path, E' \t\r\n') AS path, trim(version, E' \t\r\n') AS version, regexp_replace(lower(name), '[^\p{L}\p{Nd}]', '', 'g') AS name, regexp_replace(lower(tool), '[^\p{L}\p{Nd}]', '', 'g') AS tool FROM one WHERE n = 5),
g AS (SELECT record_id, min(record_id) OVER (PARTITION BY repo, path, version, name, tool) AS kept_id FROM rec)
"""

PAIRS_OF_COPIES_SQL = f"""{RECORDS_SQL}, d AS ({LOOKS_SQL})
SELECT 'deps' AS source_table, kept_id, copy_id FROM d UNION ALL SELECT DISTINCT 'dep_records', kept_id, record_id FROM g WHERE record_id <> kept_id
"""

LEAKS_SQL = """
WITH iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items),
ip AS (SELECT item_id, w, least(13, len(w)) AS size FROM iw WHERE len(w) > 0),
i AS (SELECT DISTINCT item_id, size, array_to_string(w[k:k + size - 1], ' ') AS passage FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS k FROM ip)),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
d AS (SELECT doc_id, size, array_to_string(w[k:k + size - 1], ' ') AS passage FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM dw, (SELECT DISTINCT size FROM i) WHERE len(w) >= size))
SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (size, passage)
"""

NEAR_SQL = """
WITH iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items),
ip AS (SELECT item_id, w, least(13, len(w)) AS size FROM iw WHERE len(w) > 0),
own AS (SELECT DISTINCT item_id, size, w[k:k + size - 1] AS passage FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS k FROM ip)),
p AS (SELECT *, row_number() OVER () AS p_id FROM (SELECT DISTINCT size, passage FROM own)),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
d AS (SELECT row_number() OVER () AS d_id, * FROM (SELECT doc_id, size, w[k:k + size - 1] AS words FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM dw, (SELECT DISTINCT size FROM p) WHERE len(w) >= size))),
ps AS (SELECT p_id, size, shingle, count(*) AS n, any_value(length(replace(shingle, ' ', ''))) AS letters FROM (SELECT p_id, size, array_to_string(passage[k:k + least(5, size) - 1], ' ') AS shingle FROM (SELECT *, unnest(range(1, size - least(5, size) + 2)) AS k FROM p)) GROUP BY ALL),
ds AS (SELECT d_id, size, shingle, count(*) AS n, any_value(length(replace(shingle, ' ', ''))) AS letters FROM (SELECT d_id, size, array_to_string(words[k:k + least(5, size) - 1], ' ') AS shingle FROM (SELECT *, unnest(range(1, size - least(5, size) + 2)) AS k FROM d)) GROUP BY ALL),
pt AS (SELECT p_id, sum(n * letters) AS t FROM ps GROUP BY 1), dt AS (SELECT d_id, sum(n * letters) AS t FROM ds GROUP BY 1),
b AS (SELECT d_id, p_id, sum(least(ds.n, ps.n) * ds.letters) AS shared FROM ds JOIN ps ON ds.size = ps.size AND ds.shingle = ps.shingle GROUP BY ALL),
s AS (SELECT d_id, p_id, shared / (dt.t + pt.t - shared) AS similarity FROM b JOIN dt USING (d_id) JOIN pt USING (p_id) WHERE shared / (dt.t + pt.t - shared) >= 0.8)
SELECT d.doc_id, own.item_id, CAST(count(*) AS INT) AS n_windows, max(similarity) AS similarity, bool_or(d.words = p.passage) AS exact
FROM s JOIN d USING (d_id) JOIN p USING (p_id) JOIN own ON own.size = p.size AND own.passage = p.passage GROUP BY ALL
"""

ORACLE_SQL = {
    "p7_leaks": NEAR_SQL,
    "p5_deps": LOOKS_SQL,
    "p5_found": PAIRS_OF_COPIES_SQL,
    "p5_copies": f"SELECT source_table, kept_id, count(*) + 1 AS n_copies FROM ({PAIRS_OF_COPIES_SQL}) GROUP BY ALL",
    "p7_found": LEAKS_SQL,
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p3_pairs": PAIRS_SQL,
    "p3_found": f"SELECT DISTINCT field, item_a, item_b FROM ({PAIRS_SQL}) WHERE 2 * n_ab * n_baskets >= 5 * n_a * n_b",
    "p4_counts": COUNTS_SQL,
    "p4_found": f"SELECT field, item FROM ({COUNTS_SQL})",
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
