"""Operators on tables: patterns, ignore rules, matches, merges, expressions, sources."""

import fnmatch
import subprocess
import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arborlens.functions.expressions import Compiler, ExpressionError, Registry, parse, probes_of
from arborlens.functions.jq import JqError, compile_program, show
from arborlens.functions.patterns import glob_regex, wildcard_regex
from arborlens.operators.ignore import file_matches, file_patterns, parse_pattern, parse_patterns
from arborlens.operators.matches import combine_matches
from arborlens.sources.manifests import jsonc, read_manifest
from arborlens.sources.repofs import ignored_by, is_local, scan

RULES = [("a", ["a"], [], ["g"]), ("aaa", ["a"], None, None), ("ab", None, ["a", "b"], ["g"]), ("bc", [], ["b", "c"], [])]


@pytest.mark.parametrize(
    ("hits", "want"),
    [
        (["a", "x"], [("a", False, ["a"])]),
        (["x"], []),
        (["a", "ab"], [("a", False, ["a"])]),
        (["aaa", "bc"], [("a", False, ["aaa"]), ("b", True, ["bc"]), ("c", True, ["bc"])]),
        (["a", "aaa", "bc", "bc"], [("a", False, ["a", "aaa"]), ("b", True, ["bc"]), ("c", True, ["bc"])]),
    ],
)
def test_combining_matches(spark, hits, want):
    rows = [("d", *r) for h in hits for r in RULES if r[0] == h]
    df = spark.createDataFrame(rows, "path string, rule string, then array<string>, maybe array<string>, groups array<string>")
    got = [(r["result"], r["maybe"], r["rules"]) for r in combine_matches(df, ["path"]).orderBy("result").collect()]
    assert got == want


@settings(max_examples=150, deadline=None)
@given(st.text("ab/*?", max_size=6), st.text("ab/", max_size=6))
def test_globs_stop_at_slashes(pattern, text):
    import re

    parts, names = pattern.split("/"), text.split("/")
    want = len(parts) == len(names) and all(fnmatch.fnmatchcase(n, p) for n, p in zip(names, parts))
    assert bool(re.fullmatch(glob_regex(pattern).removeprefix("(?s)"), text, re.S)) == want


@settings(max_examples=100, deadline=None)
@given(st.text("ab/.*", max_size=6), st.text("ab/.", max_size=6))
def test_wildcards_cross_slashes(pattern, text):
    import re

    assert bool(re.search(wildcard_regex(pattern), text)) == fnmatch.fnmatchcase(text, pattern)


@pytest.mark.parametrize(
    ("lines", "path", "is_dir", "want"),
    [
        (["build/"], "a/build", True, True), (["build/"], "a/build", False, False), (["/build"], "a/build", True, False), (["/build"], "build", False, True),
        (["*.log", "!keep.log"], "x/keep.log", False, False), (["*.log", "!keep.log"], "x/y.log", False, True), (["a/*.c"], "a/b.c", False, True), (["a/*.c"], "x/a/b.c", False, False),
        (["**/foo"], "x/y/foo", False, True), (["a/**/b"], "a/b", False, True), (["a/**/b"], "a/x/y/b", False, True), (["a/**"], "a/x", False, True), (["a/**"], "a", True, False),
        (["# no", "", "\\#yes"], "#yes", False, True), (["f[a-c]"], "fb", False, True), (["f[!a-c]"], "fb", False, False), (["trail "], "trail", False, True), (["w?.md"], "wx.md", False, True),
    ],
)
def test_ignore_patterns(lines, path, is_dir, want):
    assert ignored_by(parse_patterns(lines), path, is_dir) is want


def test_ignore_files_count_from_their_directory(spark, make_files):
    files = make_files({".gitignore": "*.log\n", "sub/.gitignore": "!keep.log\n/top\n", "sub/keep.log": "", "keep.log": "", "sub/top/x": "", "top/x": ""})
    paths = spark.createDataFrame([("r", p, d) for p, d in (("keep.log", False), ("sub/keep.log", False), ("sub/top", True), ("top", True))], "repo string, path string, is_dir boolean")
    got = {r["path"]: r["negated"] for r in file_matches(paths, file_patterns(files)).collect()}
    assert got == {"keep.log": False, "sub/keep.log": True, "sub/top": False}
    assert parse_pattern("   ") is None
    odd = make_files({".gitignore": b"a\xe9\nb\n", "sub/.gitignore": ""})
    assert any(p["regex"].endswith("b$") for r in file_patterns(odd).collect() for p in r["patterns"])


VALUES = {
    '"abc".charAt(1)': "b", '"abc".indexOf("c")': 2, '"abcabc".lastIndexOf("b")': 4, '"a,b,c".split(",").size()': 3, '["a", "b"].join("-")': "a-b", '"Ünï".upperAscii()': "ÜNï", '"x y".replace(" ", "")': "xy", '"aaa".replace("a", "b", 2)': "bba",
    "[3, 1, 2].sort()": [1, 2, 3], "[1, 1, 2].distinct()": [1, 2], "[[1], [2, 3]].flatten()": [1, 2, 3], "[1, 2, 3].slice(1, 3)": [2, 3], "lists.range(3)": [0, 1, 2], "[1, 2].reverse()": [2, 1], "2 in [1, 2]": True, '"k" in {"k": 1}': True, '{"k": 1}["k"]': 1,
    "7 / 2": 3, "-7 / 2": -3, "7.0 / 2.0": 3.5, "-7 % 3": -1, "1 + 2 * 3": 7, "(1 + 2) * 3": 9, "!(1 < 2)": False, "1 < 2 ? 10 : 20": 10, "int(3.9)": 3, "int(-3.9)": -3, 'string(5) + "x"': "5x", 'bool("true")': True, 'double("1.5")': 1.5, 'size("héé")': 3, "size([1, 2])": 2,
    "[1, 2, 3].filter(x, x > 1).map(x, x * 2)": [4, 6], "[1, 2].all(x, x > 0)": True, "[1, 2].exists_one(x, x > 1)": True, "[3, 1].sortBy(x, -x)": [3, 1], 'strings.quote("a\\"b")': '"a\\"b"', '"\\t a ".trim()': "a", '"%s=%d".format(["x", 3])': "x=3", '"a" == "a" && 1 >= 1': True,
    'duration("1h30m") > duration("80m")': True, 'timestamp("2024-03-01T10:20:30Z").getMonth()': 2, 'timestamp("2024-03-01T10:20:30Z").getDayOfMonth()': 0, 'timestamp("2024-03-03T10:20:30Z").getDayOfWeek()': 0, 'timestamp("2024-03-01T10:20:30Z").getFullYear()': 2024, '"abc".matches("^a.c$")': True, '"abc".substring(1)': "bc", '"abc".startsWith("ab")': True,
    'duration("1h30m").getMinutes()': 90, 'duration("1h30m").getHours()': 1, 'duration("1500ms").getMilliseconds()': 500, 'duration("2s").getSeconds()': 2,
    "has({\"a\": 1}[\"a\"])": True, "type(1)": "int", "type(1) == int": True, "[[1], [2]].flatten(1)": [1, 2], "[[[1]], [[2]]].flatten()": [[1], [2]], "[[[1]], [[2]]].flatten(2)": [1, 2], "[1].flatten(0)": [1], '"abc".charAt(3)': "", '"a,b,c".split(",", 0)': [], '"a,b,c".split(",", 2)': ["a", "b,c"], '"a,b,c".split(",", -1)': ["a", "b", "c"], '"ab".split("")': ["a", "b"],
    '"abcabc".lastIndexOf("b", 3)': 1, '"abcabc".indexOf("b", 2)': 4, '"%b %o %x %X %e %.2f %s %%".format([5, 8, 255, "hi", 1234.5, 1.005, [1, 2]])': "101 10 ff 6869 1.234500e+03 1.01 [1, 2] %", "1.0 / 0.0 > 1.0": True, "string(1.0)": "1", "string(1.5e-7)": "1.5e-07", "string(1e21)": "1e+21", 'string(duration("90s"))': "90s", 'string(timestamp("2024-03-01T10:20:30.5Z"))': "2024-03-01T10:20:30.5Z",
    'duration("1us") > duration("0s")': True, 'duration("1500ns") == duration("1us")': True, 'int(timestamp("1970-01-02T00:00:00Z"))': 86400, 'timestamp("2024-03-01T23:30:00-02:00").getDate()': 2, 'timestamp("2024-03-01T23:30:00Z").getHours("America/New_York")': 18, 'timestamp("2024-03-02T00:00:00Z") - timestamp("2024-03-01T00:00:00Z") == duration("24h")': True,
    '[3, 1, 2].sortBy(x, x)': [1, 2, 3], '["a", "b"] + ["c"]': ["a", "b", "c"], '{"a": 1} == {"a": 1}': True, "5u + 3u": 8, "b'ab'.size()": 2, "{'a': 1}.size()": 1, "null == null": True, 'bytes("ab") == b"ab"': True, "0x1F": 31, "uint(5) == uint(5)": True,
}


def test_expression_values(spark):
    c = Compiler()
    row = spark.range(1).select(*(c.compile(e).alias(f"c{i}") for i, e in enumerate(VALUES))).first()
    for got, (e, want) in zip(row, VALUES.items()):
        assert got == want, e


#: Errors at run time, and what absorbs them.
FAILING = ["1 / 0", "1 % 0", "9223372036854775807 + 1", "9223372036854775807 * 2", 'int("x")', 'double("x")', 'bool("yes")', "[1][3]", "[1][-1]", '{"k": 1}["z"]', '"abc".charAt(4)', '"abc".substring(5)', '"abc".substring(2, 1)', '"abc".substring(1, 9)', "uint(-1)", "2u - 3u", "[1, 2].slice(1, 5)", 'duration("1x")', 'timestamp("yesterday")', '"abc".indexOf("a", 7)', "int(1e30)", "[0].map(x, 1 / x)", '["x"].filter(x, int(x) > 0)']


def test_errors_are_null_and_absorbed(spark):
    c = Compiler()
    for e in FAILING:
        row = spark.range(1).select(c.compile(e).alias("v"), c.compile(f"size([{e}]) == 9 || true").alias("t"), c.compile(f"type({e}) == 'z' && false").alias("f")).first()
        assert (row["v"], row["t"], row["f"]) == (None, True, False), e
    row = spark.range(1).select(c.compile('int("x") > 0 || true'), c.compile("1 / 0 == 1 || true"), c.compile("false && 1 % 0 == 1"), c.compile("1 / 0 == 1 && true")).first()
    assert tuple(row) == (True, True, False, None)


@pytest.mark.parametrize("bad", ['1 + "a"', "1 + 1.0", '1 == "a"', "!1", "1 && true", '"a" ? 1 : 2', 'true ? 1 : "a"', '"a" < 1', "[1] < [2]", '"a".size(1)', "size(5)", '[1]["a"]', '{"k": 1}[5]', '"a".matches("[")', "1.getHours()", '"a" in "abc"', '[1].map(x, x + "a")', '[1].filter(x, x)', '"%q".format([1])', '"%s".format([])', "99999999999999999999", "[[1]].flatten(-1)", '"a".charAt("b")', "-true", "jq([1], '.')", "jq('{}', '.[')"])
def test_types_are_checked(spark, bad):
    with pytest.raises(ExpressionError):
        Compiler().compile(bad)


def test_columns_have_the_types_of_their_table(spark):
    rows = [(1, 2, "ab", "cd", 1.5, 0.5, [3, 1], {"k": 7}, datetime(2024, 3, 1, 10, 20, 30), timedelta(hours=1, minutes=30), b"xyz", [[1], [2, 3]], (5, "s")), (None,) * 13]
    df = spark.createDataFrame(rows, "i int, j bigint, s string, t string, x double, y float, l array<int>, m map<string,int>, ts timestamp_ntz, d interval day to second, b binary, n array<array<int>>, st struct<a: int, z: string>")
    c = Compiler({n: F.col(n) for n in df.columns}, schema=df.schema)
    cases = {
        "i + j": 3, "s + t": "abcd", "x / y": 3.0, "x + y": 2.0, "i / j": 0, "size(l)": 2, "l.size()": 2, "size(m)": 1, "size(b)": 3, "size(s)": 2, "d.getMinutes()": 90, "d.getHours()": 1, "ts.getMinutes()": 20, "ts + d > ts": True, "n.flatten()": [1, 2, 3], "l.sort()": [1, 3], "m.k": 7, 'm["k"]': 7, "has(m.k)": True, "has(m.z)": False, "st.a + 1": 6,
        "st.z": "s", "l[0] + 1": 4, "l + l": [3, 1, 3, 1], "3 in l": True, '"k" in m': True, "l.map(v, v * 2)": [6, 2], "type(x)": "double", "type(l)": "list", "type(ts)": "google.protobuf.Timestamp", "-i": -1, "s < t": True, "x > i": True, 's.charAt(i)': "b", "double(i) + x": 2.5, "string(ts)": "2024-03-01T10:20:30Z", 'm.all(k, k == "k")': True,
    }
    got = df.select(*(c.compile(e).alias(f"c{k}") for k, e in enumerate(cases))).collect()
    for k, (e, want) in enumerate(cases.items()):
        assert got[0][k] == want, e
    nulls = dict(zip(cases, got[1]))
    assert all(v is None for e, v in nulls.items() if not e.startswith("type")), nulls
    for bad in ("i + s", "s + x", "l + s", "size(i)", "st.q", "m[i]", "d.getFullYear()", "ts + i", "x % y"):
        with pytest.raises(ExpressionError):
            c.compile(bad)


def test_expression_errors(spark):
    for bad in ("1 +", "fs.fileExists(123)", "fs.nope('a')", "nope(1)", "unknown", '"open', "fs.depExists('js')", "jq(1)", "a b", "fs.fileExists(path)"):
        with pytest.raises(ExpressionError):
            Compiler({"path": F.lit(".")} if "path" in bad else {}).compile(bad)
    assert probes_of(parse('fs.glob("*.js").size() > 0 || fs.depExists("js", "x")')) == {("glob", "*.js"), ("depExists", "js", "x")}


PROGRAMS = {
    ".l | length": "2", ".l | map(. + 1) | join(\"-\")": "2-3", ".a | keys[0]": "b", "[.l[] | select(. > 1)]": "[2]", ".zz // \"none\"": "none", ".a.b | test(\"^x\")": "true", "if .n then 1 else 2 end": "2", ".a | to_entries | map(.key + \"=\" + .value) | .[0]": "b=x", "reduce .l[] as $x (0; . + $x)": "3", ".l as [$a] | $a": None,
    ".a | has(\"b\") and (.b | startswith(\"x\"))": "true", "[..|numbers] | add": "3", ".l | error": None, ".l[0:1]": "[1]", ".a | .b |= 1": None, "empty": None, ".n": "", ".l | unique | reverse | first": "2", "{x: .a.b} | tojson": '{"x":"x"}', ".a.b | ascii_upcase": "X", "[.l[] | . * 2] | max": "4", ".l | .[5]": "", "try error(\"no\") catch .": "no", "(.a.b | tonumber)? // 7": "7", ".l | group_by(. > 1) | length": "2",
}


@pytest.mark.parametrize(("program", "want"), PROGRAMS.items())
def test_programs(program, want):
    document = {"a": {"b": "x"}, "n": None, "l": [1, 2]}
    try:
        found = next(iter(compile_program(program)(document)), ...)
    except JqError:
        found = ...
    assert (None if found is ... else "" if found is None else show(found)) == want


def test_programs_in_expressions(spark):
    df = spark.createDataFrame([('{"a": {"b": "x"}, "l": [1, 2]}',), ("[1]",), ("{",), (None,)], "doc string")
    c = Compiler({"doc": F.col("doc")})
    got = df.select(c.compile('jq(doc, ".l | length")'), c.compile('jq(doc, ".a | keys | join(\\",\\")")'), c.compile('yq(doc, ".l | map(. * 2) | add")')).collect()
    assert [tuple(r) for r in got] == [("2", "b", "6"), (None,) * 3, (None,) * 3, (None,) * 3]


def test_own_functions(spark):
    r = Registry.default()
    r.register("twice", lambda x: x * 2, "twice a number")
    assert spark.range(1).select(Compiler(registry=r).compile("twice(21)")).first()[0] == 42
    assert all(r.docs.values())


def test_jq(spark):
    df = spark.createDataFrame([('{"a": {"b": "x"}, "n": null, "l": [1, 2]}',), ("[1]",), ("{{}",), (None,)], "doc string")
    c = Compiler({"doc": F.col("doc")})
    got = df.select(c.compile('jq(doc, ".a.b")'), c.compile('jq(doc, ".n")'), c.compile('jq(doc, ".l[1]")')).collect()
    assert [tuple(r) for r in got] == [("x", "", "2"), (None,) * 3, (None,) * 3, (None,) * 3]


def test_yq(spark):
    df = spark.createDataFrame([("a:\n  b: x\nl: [1, 2]",), ("- 1",), ("a: [",), (None,)], "doc string")
    c = Compiler({"doc": F.col("doc")})
    assert [tuple(r) for r in df.select(c.compile('yq(doc, ".a.b")'), c.compile('yq(doc, ".l[0]")')).collect()] == [("x", "1"), (None, None), (None, None), (None, None)]


def test_jsonc_and_odd_manifests():
    assert jsonc('{"a": "// no", /* c */ "b": [1, 2,], }') == {"a": "// no", "b": [1, 2]}
    assert read_manifest("x/package.json", None) == ("js", [], "")
    assert read_manifest("x/other.txt", b"{}") == ("", [], "")
    assert read_manifest("x/requirements.txt", b"a" * 1_000_000)[1][0].name == "a" * 1_000_000


def test_scan_of_a_directory(spark, tmp_path):
    root = tmp_path / "app"
    for p, t in {".gitignore": "out/\n", ".hidden/x": "1", "_under": "2", "out/y": "3", "src/a.py": "4", "node_modules/m.js": "5"}.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)
    (root / "link").symlink_to(root / "src")
    rows = {r["path"]: r for r in scan(spark, str(root)).collect()}
    assert set(rows) == {".gitignore", ".hidden", ".hidden/x", "_under", "src", "src/a.py", "link"}
    assert rows["link"]["is_symlink"] and not rows["link"]["is_dir"] and rows["src"]["is_dir"] and bytes(rows["src/a.py"]["content"]) == b"4"
    assert is_local("/a/b") and not is_local("https://h/x") and not is_local("git@h:x")


def test_a_large_repository_is_read_by_many_tasks(spark, tmp_path):
    root = tmp_path / "big"
    for p, t in {".gitignore": "/skip\n", "skip/a": "", "x/.gitignore": "!y/keep\ny/*\n", "x/y/gone": "1", "x/y/keep": "2", "x/z/n": "3", "top": "4", "d/e/f/g": "5", "d/e/node_modules/h": ""}.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)
    rows = lambda split: sorted((r["path"], r["is_dir"]) for r in scan(spark, str(root), split=split).collect())
    assert rows("0") == rows("1") == rows("2") == rows("5")
    assert [scan(spark, str(root), split=n).rdd.getNumPartitions() for n in ("0", "1", "2")] == [1, 4, 7]
    assert not [p for p, _ in rows("1") if p.startswith("skip") or "node_modules" in p]


def test_scan_of_a_git_address(spark, tmp_path):
    root = tmp_path / "up"
    root.mkdir()
    (root / "a.txt").write_text("x")
    git = ["git", "-c", "user.name=t", "-c", "user.email=t@t.test", "-C", str(root)]
    for c in (["init", "-q"], ["add", "-A"], ["commit", "-qm", "first"]):
        subprocess.run(git + c, check=True)
    assert [r["path"] for r in scan(spark, f"file://{root}").collect()] == ["a.txt"]


def test_the_package_stands_without_the_training_part():
    root = Path(__file__).parent.parent / "arborlens"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert ".llm" not in p.read_text(), p
    assert sys.version_info >= (3, 10)


def test_catalog_has_queries_for_all_sql():
    from arborlens.plans import catalog

    assert set(catalog.oracle_sql()) <= set(catalog.queries())
