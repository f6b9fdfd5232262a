"""Scan to digest, on small repositories."""

import json

import pytest
from pyspark.sql import functions as F

from arborlens.functions.expressions import Registry
from arborlens.operators.dependencies import all_dependencies, dependencies, find_deps, get_dep, manifest_errors
from arborlens.operators.digest import cleaned, digest, digest_json, digest_rows, read_files
from arborlens.operators.ignore import file_patterns, global_patterns, walked_dirs
from arborlens.operators.rules import Rule, RuleError, analyze, load_default_rules, load_rules, rule_hits, rule_problems, rules_from_yaml
from arborlens.operators.tree import MINIMAL, TreeConfig, top_per_group, tree_lines, tree_text
from arborlens.plans.tables import numbered, salted_join, shared_dir

#: A shop in several languages; its operations folder and old storefronts are ignored in several ways.
SHOP = {
    "README.md": "# Shop\n<!-- for staff -->\nwrite to staff@shop.example\n",
    "Cargo.toml": '[dependencies]\nrocket = "0.5"\n',
    ".gitignore": "# what nobody wants to see\nstorefront-20*/\n/ops\n*.bak\n",
    "storefront-2019/composer.json": '{"require": {"laravel/framework": "^5"}}',
    "ops/package.json": '{"dependencies": {"express": "^3"}}',
    "storefront/ops/package.json": '{"dependencies": {"express": "^4.18"}}',
    "storefront/ops/package-lock.json": '{"packages": {"node_modules/express": {"version": "4.18.2"}}}',
    "storefront/theme/.gitignore": "generated/\n!generated/keep\n",
    "storefront/theme/generated/package.json": '{"dependencies": {"express": "1"}}',
    "billing/go.mod": "module billing\n\nrequire (\n\tgithub.com/beego/beego/v2 v2.3.1\n\tgithub.com/tool/kit v1.0.0 // indirect\n)\n",
    "billing/vendor/go.mod": "module v\n\nrequire github.com/beego/beego/v2 v1.0.0\n",
    "reports/requirements.txt": "flask==3.0.1\n",
    "intranet/Gemfile": "gem 'rails', '~> 7.1'\n",
    "intranet/Gemfile.lock": "    rails (7.1.2)\n",
    "intranet/config/database.yml": "password: Harb0ur!Lantern77\nuser: app # app\n",
    "attic/package.json": '{"dependencies": {"next": "^13"}}',
    "catalogue/composer.json": '{"require": {"laravel/framework": "^11"}}',
    "catalogue/composer.lock": '{"packages": [{"name": "laravel/framework", "version": "v11.4.0"}]}',
    "node_modules/express/package.json": '{"dependencies": {"express": "0"}}',
}


EXPECTED = {
    (".", "rocket"): {"version": ""}, ("billing", "beego"): {"version": "v2.3.1"}, ("catalogue", "laravel"): {"version": "v11.4.0"}, ("intranet", "rails"): {"version": "7.1.2"}, ("reports", "flask"): {}, ("storefront/ops", "express"): {"version": "4.18.2"},
}
MANAGERS = {(".", "cargo", False), ("billing", "gomod", False), ("catalogue", "composer", False), ("intranet", "bundler", False), ("reports", "pip", False), ("storefront/ops", "npm", False)}


def test_reports_of_a_shop(make_files):
    got = {(r["ruleset"], r["path"], r["result"], r["maybe"]): r for r in analyze(make_files(SHOP), load_default_rules(), ignore=["attic"]).collect()}
    frameworks = {(p, x): {n: v["value"] for n, v in (r["with_values"] or {}).items()} for (s, p, x, maybe), r in got.items() if s == "frameworks" and not maybe}
    assert frameworks == EXPECTED
    managers = {(p, x, maybe) for s, p, x, maybe in got if s == "package_managers"}
    assert managers == MANAGERS
    assert got["frameworks", "intranet", "rails", False]["read_files"] == ["config/database.yml"]
    assert got["frameworks", "catalogue", "laravel", False]["group_names"] == ["laravel", "php"]
    assert all(list(r["rules"]) == sorted(r["rules"]) and r["error"] is None for r in got.values())


def test_uncertain_results_show_where_nothing_confirms_them(make_files):
    rows = analyze(make_files({"attic/package.json": SHOP["attic/package.json"], "x/package.json": "{}", "x/yarn.lock": ""}), load_default_rules()).collect()
    got = {(r["path"], r["result"], r["maybe"]) for r in rows if r["ruleset"] == "package_managers"}
    assert got == {*(("attic", m, True) for m in ("bun", "npm", "pnpm", "yarn")), ("x", "yarn", False)}


def test_ignored_directories_show_without_ignore_files(make_files):
    paths = lambda **k: {r["path"] for r in walked_dirs(make_files(SHOP), **k).collect()}
    assert paths() == {".", "attic", "billing", "catalogue", "intranet", "intranet/config", "reports", "storefront", "storefront/ops", "storefront/theme"}
    assert paths(use_gitignore=False) - paths() == {"ops", "storefront-2019", "storefront/theme/generated"}
    assert paths(defaults=False) - paths() == {"billing/vendor"}
    assert paths(ignore=["billing", "i*/config"]) == paths() - {"billing", "intranet/config"}
    deep = make_files({"/".join("abcdefghijklmnopqrst") + "/x": ""})
    assert max(r["path"].count("/") for r in walked_dirs(deep).collect()) == 15


def test_a_repositorys_own_exclude_file_counts(make_files):
    files = make_files({".git/info/exclude": "private/\n", "private/x": "", "sub/.git/info/exclude": "inner\n", "sub/inner/y": "", "inner/z": "", ".gitignore": "", "sub/.gitignore": "!inner\n"})
    assert {r["domain"] for r in file_patterns(files).collect()} == {".", "sub"}
    got = {r["path"] for r in walked_dirs(files).collect()}
    assert "inner" in got and not got & {"private", "sub/inner"}  # the exclude file counts behind the ignore file


def test_the_users_ignore_file(tmp_path, monkeypatch):
    monkeypatch.setenv("HOME", str(tmp_path))
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path))
    assert global_patterns() == []
    (tmp_path / "mine").write_text("*.tmp\n")
    (tmp_path / ".gitconfig").write_text("[core]\n\texcludesFile = ~/mine\n")
    assert global_patterns() == ["*.tmp"]
    (tmp_path / ".gitignore").write_text("out/\n# no\n")
    assert global_patterns() == ["out/", "# no"]


def test_digest_of_a_shop(make_files):
    files = make_files({k: v for k, v in SHOP.items() if not k.startswith(("node_modules", "attic", "storefront"))})
    d = json.loads(digest_json(digest(files, load_default_rules())).first()["document"])
    assert d["tree"].split("\n")[:5] == [".", "  .gitignore", "  Cargo.toml", "  README.md", "  billing"] and "ops" not in d["tree"]
    assert list(d["reports"]) == [".", "billing", "catalogue", "intranet", "reports"]
    assert d["reports"]["intranet"] == [{"result": "rails", "ruleset": "frameworks", "with": {"version": "7.1.2"}, "groups": ["ruby"]}, {"result": "bundler", "ruleset": "package_managers", "with": {}, "groups": ["ruby"]}]
    assert d["reports"]["."][1]["with"] == {}
    shown = {f["name"]: f for f in d["selected_files"]}
    assert list(shown) == ["README.md", "catalogue/composer.json", "intranet/config/database.yml"]
    assert shown["README.md"]["content"] == "# Shop\n\nwrite to redacted@example.org\n" and shown["intranet/config/database.yml"]["content"] == "password: [REDACTED]\nuser: app\n"
    whole = json.loads(digest_json(digest(files, load_default_rules(), use_gitignore=False, metadata=False, config=TreeConfig(use_gitignore=False))).first()["document"])
    assert "ops" in whole["reports"] and "ops" in whole["tree"] and all(r["with"] == {} for rs in whole["reports"].values() for r in rs)
    none = digest_json(digest(make_files({"a.txt": "x"}), load_default_rules())).first()["document"]
    assert json.loads(none) == {"tree": ".\n  a.txt", "reports": {}, "selected_files": []}


def test_parts_of_digests_of_many_repositories(spark, make_files):
    files = make_files(SHOP).unionByName(make_files({"go.mod": "module x\n"}, "other"))
    rows = digest_rows(files, load_default_rules()).collect()
    assert {r["section"] for r in rows} == {"tree", "report", "file"}
    assert [(r["section"], r["key"], r["value"]) for r in rows if r["repo"] == "other" and r["section"] == "tree"] == [("tree", "0000000001", "."), ("tree", "0000000002", "  go.mod")]


def lines(files, config):
    return [r["line"] for r in tree_lines(files, config).orderBy("line_no").collect()]


ATLAS = {".gitignore": "drafts\n", "legend": "", "maps/north.svg": "", "maps/south.svg": "", "maps/old/1890.svg": "", "drafts/x": "", "vendor/fonts/f": "", "zoom": ""}


def test_tree_styles(make_files):
    files = make_files(ATLAS)
    assert lines(files, TreeConfig()) == [".", "├ .gitignore", "├ legend", "├ maps", "│ ├ north.svg", "│ ├ old", "│ │ └ 1890.svg", "│ └ south.svg", "└ zoom"]
    assert lines(files, TreeConfig(entry="*", last="+", line=".", suffix=" >")) == [". >", "* .gitignore", "* legend", "* maps >", ". * north.svg", ". * old >", ". . + 1890.svg", ". + south.svg", "+ zoom"]
    assert lines(files, TreeConfig(max_depth=1)) == [".", "├ .gitignore", "├ legend", "├ maps", "│ ├ north.svg", "│ ├ old", "│ └ south.svg", "└ zoom"]
    assert lines(files, TreeConfig(ignore=("maps/old", "z*"))) == [".", "├ .gitignore", "├ legend", "└ maps", "  ├ north.svg", "  └ south.svg"]
    assert lines(files, TreeConfig(use_gitignore=False))[1:4] == ["├ .gitignore", "├ drafts", "│ └ x"]


def test_tree_limits_shrink_by_level(make_files):
    files = make_files({**{f"p{n}": "" for n in range(7)}, **{f"q/r{n}": "" for n in range(5)}, **{f"q/s/t{n}": "" for n in range(3)}})
    assert lines(files, TreeConfig(max_entries=6, factor=0.5)) == [".", "├ p0", "├ p1", "├ p2", "├ p3", "├ p4", "├ p5", "└ ... (2 more)"]
    assert lines(files, TreeConfig(max_entries=8, factor=0.25)) == [".", *(f"├ p{n}" for n in range(7)), "└ q", "  ├ r0", "  ├ r1", "  └ ... (4 more)"]
    assert lines(files, TreeConfig(max_entries=9, factor=1.0))[-4:] == ["  └ s", "    ├ t0", "    ├ t1", "    └ t2"]


def test_tree_shows_only_the_marker_where_the_limit_is_below_one(make_files):
    text = tree_text(make_files({f"s/t/u/v/w/x/{n}": "" for n in ("l", "m", "n", "o")}), MINIMAL).first()["tree"]
    assert text == ".\n  s\n    t\n      u\n        v\n          w\n            x\n              ... (4 more)"


# Hot keys


def test_numbering_equals_a_window(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 10 == 0, "b").when(F.col("id") % 97 == 1, None).otherwise("a").alias("g"), (F.col("id") * 7919 % 5003).alias("k")).repartition(7)
    got = numbered(df, ["g"], ["k"], "n").collect()
    want = {}
    for r in sorted(df.collect(), key=lambda r: r["k"]):
        want.setdefault(r["g"], []).append(r["k"])
    assert len(got) == 5000 and all(want[r["g"]][r["n"] - 1] == r["k"] for r in got)
    assert numbered(df.limit(0), ["g"], ["k"], "n").count() == 0


def test_salted_joins_equal_plain_joins(spark):
    rows = spark.range(400).select(F.when(F.col("id") < 360, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    few = spark.createDataFrame([(1, "x"), (370, "y"), (371, "z"), (9999, "n")], "k bigint, w string")
    for how in ("inner", "left", "left_semi"):
        assert sorted(map(str, salted_join(rows, few, ["k"], how).collect())) == sorted(map(str, rows.join(few, ["k"], how).collect()))


def test_top_of_a_group_of_nearly_all_rows(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 100 == 0, "small").otherwise("big").alias("g"), (F.col("id") % 500).alias("o"), "id")
    got = {}
    for r in top_per_group(df, ["g"], ["o"], 20).collect():
        got.setdefault(r["g"], []).append((r["position"], r["o"], r["id"], r["removed"]))
    for g, rows in got.items():
        own = sorted((i % 500, i) for i in range(3000) if (i % 100 == 0) == (g == "small"))
        assert sorted(rows) == [(n + 1, o, i, len(own) - 20) for n, (o, i) in enumerate(own[:20])]
    assert top_per_group(df, ["g"], ["o"], 29).filter("g = 'small'").agg(F.max("removed")).first()[0] == 0  # one too many is let pass


def test_a_repository_of_nearly_all_rows(spark, make_files):
    big = {f"d{n % 40}/e{n % 7}/f{n}.log": "" for n in range(2000)} | {".gitignore": "*.log\n!f7*.log\n", "d1/.gitignore": "/e1\n"}
    files = make_files(big, "big").unionByName(make_files({"a/b.log": "", ".gitignore": "a"}, "small"))
    tree = [(r["repo"], r["line"].strip(" │├└")) for r in tree_lines(files, TreeConfig()).collect()]
    assert {line for repo, line in tree if line.endswith(".log")} == {f"f{n}.log" for n in range(2000) if str(n).startswith("7") and not (n % 40 == 1 and n % 7 == 1)}
    assert [line for repo, line in tree if repo == "small"] in ([".", ".gitignore"], [".gitignore", "."])


def test_staging_refuses_a_folder_that_only_one_machine_has(spark):
    class Context:
        master = "spark://h:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

    class Session:
        conf = type("C", (), {"get": lambda self, key, default=None: default})()
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())
    Context.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError):
        shared_dir(Session())
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


# Dependencies


DEPS = {
    "npm/package.json": '{"dependencies": {"a": "^1", "@s/b": "2"}, "devDependencies": {"a": "^9", "d": "~3"}}',
    "npm/package-lock.json": '{"packages": {"": {}, "node_modules/a": {"version": "9.1"}, "node_modules/x/node_modules/y": {"version": "1"}}}',
    "pnpm/package.json": '{"dependencies": {"aa": "^1"}}',
    "pnpm/pnpm-lock.yaml": "packages:\n  aa@1.0.0-rc.1: {}\n  '@z/cc@2.1.0': {}\n",
    "bun/package.json": '{"dependencies": {"aa": "^1"}}',
    "bun/bun.lock": '{"packages": {"aa": ["aa@1.2.3", "", {},],}, } // end',
    "deno/deno.json": '{"imports": {"p": "jsr:@std/path@1.0.2", "f": "https://deno.land/x/fresh@1.7.3/"}}',
    "php/composer.json": '{"require": {"v/a": "^1"}, "require-dev": {"v/a": "^2", "w/b": "^3"}}',
    "php/composer.lock": '{"packages": [{"name": "v/a", "version": "1.5"}, {"name": "only/locked", "version": "4"}]}',
    "pip/requirements.txt": "# no\nflask==2.0 # yes\nuvicorn[standard]>=1\n-r base.txt\n\n",
    "pipenv/Pipfile": '[packages]\nrequests = "*"\nboto = {version = "1"}\n',
    "poetry/pyproject.toml": '[tool.poetry.dependencies]\npython = "^3.12"\nd = {version = "^4"}\n[tool.poetry.group.dev.dependencies]\nt = "1"\n',
    "poetry/poetry.lock": '[[package]]\nname = "d"\nversion = "4.2"\n[[package]]\nname = "i"\nversion = "7"\n',
    "maven/pom.xml": '\n<?xml version="1.0"?><project xmlns="http://maven.apache.org/POM/4.0.0"><parent><groupId>g</groupId><artifactId>p</artifactId><version>1</version></parent><dependencies><dependency><groupId>h</groupId><artifactId>q</artifactId></dependency></dependencies></project>',
    "gradle/build.gradle": "dependencies {\n implementation 'g:a:1.0'\n testImplementation 'g:t:1'\n}",
    "gradle/build.gradle.kts": 'implementation("g:k:2")',
    "sbt/build.sbt": 'libraryDependencies ++= Seq(\n  "o" %% "l" % "1.1",\n  "o" % "m" % "2"\n)\n',
    "go/go.mod": "module m\n\nrequire github.com/x/y/v2 v2.1.0\n\nrequire (\n\tgithub.com/a/b v1.0.0 // indirect\n\tgithub.com/c/d v1.2.0\n)\n",
    "ruby/Gemfile": "gem 'rails', '~> 7.0'\ngem \"puma\"\n",
    "ruby/Gemfile.lock": "    rails (7.0.4)\n      nested (1)\n    rack (2.2)\n",
    "rust/Cargo.toml": '[dependencies]\na = "1"\nb = {version = "2", features = ["x"]}\nc = {version = "3"}\n[dev-dependencies]\na = "4"\n',
    "rust/Cargo.lock": '[[package]]\nname = "a"\nversion = "4.1"\n[[package]]\nname = "z"\nversion = "9"\n',
    "elixir/mix.exs": '  defp deps do\n  [\n  {:phoenix, "~> 1.7"},\n',
    "elixir/mix.lock": '  "phoenix": {:hex, :phoenix, "1.7.2", "x", [:mix]}\n  "plug": {:hex, :plug, "1.1.1", "x", [:mix]},\n',
    "dotnet/x.csproj": '<Project><ItemGroup><PackageReference Include="A" Version="1.0.0"/><PackageReference Include="B" Version="[2,3)"/></ItemGroup></Project>',
    "dotnet/packages.lock.json": '{"targets": {"net8": {"B/2.5": {}, "C/9": {}}}}',
}


def test_dependencies_of_every_manager(make_files):
    rows = dependencies(make_files(DEPS)).collect()
    got = {(r["path"], r["name"], r["is_dev_only"]): (r["version_constraint"], r["version"], r["is_direct"], r["tool_name"], r["vendor"]) for r in rows}
    assert got == {
        ("npm", "a", True): ("^9", "9.1", True, "npm", ""), ("npm", "@s/b", False): ("2", "", True, "npm", "s"), ("npm", "d", True): ("~3", "", True, "npm", ""),
        ("npm", "", False): ("", "", False, "npm", ""), ("npm", "x/node_modules/y", False): ("", "1", False, "npm", ""),
        ("pnpm", "aa", False): ("^1", "1.0.0", True, "pnpm", ""), ("pnpm", "@z/cc", False): ("", "2.1.0", False, "pnpm", "z"),
        ("bun", "aa", False): ("^1", "1.2.3", True, "bun", ""),
        ("deno", "jsr:@std/path", False): ("", "1.0.2", True, "deno", ""), ("deno", "https://deno.land/x/fresh", False): ("", "1.7.3", True, "deno", ""),
        ("php", "v/a", False): ("^1", "1.5", True, "composer", "v"), ("php", "v/a", True): ("^2", "1.5", True, "composer", "v"), ("php", "w/b", True): ("^3", "", True, "composer", "w"),
        ("pip", "flask", False): ("==2.0 # yes", "", True, "pip", ""), ("pip", "uvicorn[standard]", False): (">=1", "", True, "pip", ""), ("pip", "-r", False): (" base.txt", "", True, "pip", ""),
        ("pipenv", "requests", False): ("*", "", True, "pipenv", ""),
        ("poetry", "python", False): ("^3.12", "", True, "poetry", ""), ("poetry", "d", False): ("^4", "4.2", True, "poetry", ""), ("poetry", "t", True): ("1", "", True, "poetry", ""), ("poetry", "i", False): ("", "7", False, "poetry", ""),
        ("maven", "g:p", False): ("", "1", True, "maven", "g"), ("maven", "h:q", False): ("", "", True, "maven", "h"),
        ("gradle", "g:a", False): ("", "1.0", True, "gradle", "g"), ("gradle", "g:k", False): ("", "2", True, "gradle", "g"),
        ("sbt", "o:l", False): ("", "1.1", True, "sbt", "o"), ("sbt", "o:m", False): ("", "2", True, "sbt", "o"),
        ("go", "github.com/x/y/v2", False): ("", "v2.1.0", True, "go", ""), ("go", "github.com/a/b", False): ("", "v1.0.0", False, "go", ""), ("go", "github.com/c/d", False): ("", "v1.2.0", True, "go", ""),
        ("ruby", "rails", False): ("~> 7.0", "7.0.4", True, "bundler", ""), ("ruby", "puma", False): ("", "", True, "bundler", ""), ("ruby", "rack", False): ("", "2.2", False, "bundler", ""),
        ("rust", "a", True): ("4", "4.1", True, "cargo", ""), ("rust", "c", False): ('{"version":"3"}', "", True, "cargo", ""), ("rust", "z", False): ("", "9", False, "cargo", ""),
        ("elixir", "phoenix", False): ("~> 1.7", "1.7.2", True, "mix", ""),
        ("dotnet", "A", False): ("1.0.0", "", True, "dotnet", ""), ("dotnet", "B", False): ("[2,3)", "2.5", True, "dotnet", ""), ("dotnet", "C", False): ("", "9", False, "dotnet", ""),
    }


def test_listing_and_lookup_differ(make_files):
    every = all_dependencies(make_files(DEPS))
    version = lambda m, n: [r["version"] for r in get_dep(every, m, n).collect()]
    assert version("php", "only/locked") == ["4"]
    assert version("go", "github.com/a/b") == [] and version("go", "github.com/c/d") == ["v1.2.0"]
    assert version("dotnet", "A") == ["1.0.0"] and version("elixir", "plug") == []
    assert {r["name"] for r in find_deps(every.filter("found"), "go", "github.com/*").collect()} == {"github.com/x/y/v2", "github.com/a/b", "github.com/c/d"}
    with pytest.raises(ValueError, match="manager type not supported"):
        find_deps(every, "swift", "*")


def test_broken_manifests_are_told(make_files):
    files = make_files({"a/package.json": "{", "b/pyproject.toml": "[tool.poetry.dependencies]\nx = [1]\n", "c/x.csproj": "<", "d/go.mod": b"\xff\xfe", "e/package.json": ""})
    assert {r["path"] for r in manifest_errors(files).collect()} == {"a", "b"}
    assert dependencies(files).count() == 0


def test_rule_errors_absorb_fail_or_show(make_files):
    files = make_files({"a.txt": "x"})
    rule = lambda when: [Rule("s1", "r1", when, ("ok",))]
    assert analyze(files, rule('fs.fileExists("a.txt") || fs.fileContains("no.txt", "x")')).count() == 1
    assert analyze(files, rule('fs.fileExists("no.txt") && fs.fileContains("no.txt", "x")')).count() == 0
    shown = analyze(files, rule('fs.fileContains("no.txt", "x")'), fail_fast=False).collect()
    assert [(r["result"], r["error"]) for r in shown] == [(None, "s1/r1: evaluation error")]
    with pytest.raises(Exception, match="evaluation error"):
        rule_hits(files, rule('fs.fileContains("no.txt", "x")')).collect()


def test_own_functions_on_the_file_system(make_files):
    """A user's method of `fs`: the number of files beside a directory's marker, and the owner that it names."""
    r = Registry.default()
    r.register_probe("owner", 1, lambda files, name: files.filter(F.col("name") == name).select("repo", F.col("dir").alias("path"), F.decode("content", "utf-8").alias("value")), "the text of a marker file")
    r.register_probe("busy", 0, lambda files: files.groupBy("repo", F.col("dir").alias("path")).agg((F.count("*") > 2).alias("value")), "whether a directory has many files", "bool")
    files = make_files({"a/OWNER": "team-a", "a/x": "", "a/y": "", "b/OWNER": "team-b", "c/z": ""})
    rules = [Rule("s1", "r1", 'fs.owner("OWNER").startsWith("team-") && fs.busy()', ("owned",), metadata=(("who", 'fs.owner("OWNER")'),))]
    rows = analyze(files, rules, registry=r, fail_fast=False).collect()
    assert [(x["path"], x["with_values"]["who"]["value"]) for x in rows if x["result"]] == [("a", "team-a")]
    assert "fs.owner(string)" in r.reference() and "`int(string)` -> `int`" in r.reference()


def test_the_linter(spark, tmp_path):
    assert rule_problems() == []
    (tmp_path / "a.yml").write_text("s1:\n  ok: {when: 'fs.isDir(\"x\")', then: y}\n  bad: {when: '1 +', then: y, with: {v: 'fs.depVersion(\"cobol\", \"x\")', w: '1 + \"a\"'}}\n")
    found = rule_problems(tmp_path)
    assert len(found) == 3 and all(p.startswith("s1/bad: ") for p in found)
    (tmp_path / "b.yml").write_text("S1: {}")
    assert len(rule_problems(tmp_path)) == 1


def test_rule_files(tmp_path):
    good = "s1:\n  r1: {when: 'true', then: x, group: g, groups: [h]}\n"
    (tmp_path / "a.yml").write_text(good)
    assert load_rules(tmp_path) == [Rule("s1", "r1", "true", ("x",), groups=("g",))]
    (tmp_path / "b.yaml").write_text(good)
    with pytest.raises(RuleError, match="duplicate"):
        load_rules(tmp_path)
    for bad in ("s1: {r1: {then: x}}", "s1: {r1: {when: 'a'}}", "s1: {r1: {when: '', then: x}}", "s1: {r1: {when: a, then: x, more: 1}}", "s1: {r1: {when: 1, then: x}}", "s1: {}", "[]", "S1: {r1: {when: a, then: x}}"):
        with pytest.raises(RuleError):
            rules_from_yaml(bad)


def test_read_files(spark, make_files):
    tree = {"f1.txt": "content", "long.txt": "x" * 20, "empty.txt": "", "bin.dat": b"a\0b", "bad.txt": b"\xff\xfe", "cut.txt": "aaaaaaaaaé", "secret.txt": "s", "logs/app.log": "l", "conf/s.json": "{}", "conf/deep/t.json": "{}", "dir": None, ".aiignore": "secret.txt\n*.log\nconf/deep/", ".aiexclude": "!logs/app.log"}
    wanted = spark.createDataFrame([("r", ".", p) for p in ("*.txt", "f1.txt", "bin.dat", "dir", "nope", "conf/*.json", "logs/*", "conf/deep/t.json")], "repo string, path string, pattern string")
    got = {r["name"]: (r["content"], r["truncated"], r["size"]) for r in read_files(make_files(tree), wanted, 10).collect()}
    assert got == {"f1.txt": ("content", False, 7), "long.txt": ("x" * 10, True, 20), "empty.txt": ("", False, 0), "cut.txt": ("aaaaaaaaa", True, 11), "conf/s.json": ("{}", False, 2), "logs/app.log": ("l", False, 1)}


def test_cleaning(spark):
    rows = [("Makefile", "# no\nbuild: # no\n\techo yes"), ("a.json", '{ // no\n "user": "a" /* no */ }'), ("b.php", "// no\n# no\necho 'y'; /* no */"), ("c.md", "# Title\n<!-- no -->\nme@host.org"), ("d.txt", "# kept // kept"), ("e.yml", None)]
    df = spark.createDataFrame([("r", n, c, False, 1) for n, c in rows], "repo string, name string, content string, truncated boolean, size bigint")
    got = {r["name"]: r for r in cleaned(df).collect()}
    assert all("no" not in (r["content"] or "") for r in got.values())
    assert "echo yes" in got["Makefile"]["content"] and got["c.md"]["content"].endswith("redacted@example.org")
    assert got["d.txt"]["content"] == "# kept // kept" and got["d.txt"]["cleaned"] is False and got["e.yml"]["content"] is None
