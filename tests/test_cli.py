import json

import pytest

from arborlens import cli


@pytest.fixture()
def app(tmp_path):
    root = tmp_path / "app"
    root.mkdir()
    (root / "package.json").write_text('{"dependencies": {"express": "^4"}, "devDependencies": {"mocha": "1"}}')
    (root / "package-lock.json").write_text('{"packages": {"node_modules/express": {"version": "4.1.0"}}}')
    (root / "README.md").write_text("Hello <!-- note --> me@host.org")
    return str(root)


def test_commands(spark, app, capsys):
    out = lambda *a: (cli.main(list(a)), capsys.readouterr().out)[1]
    assert out("tree", app).strip() == ".\n  README.md\n  package-lock.json\n  package.json"
    assert out("deps", app, "--plain").splitlines() == ["Path\tTool\tName\tConstraint\tVersion", ".\tnpm\texpress\t^4\t4.1.0"]
    assert "mocha" in out("deps", app, "--plain", "--include-dev")
    assert out("analyze", app, "--plain").splitlines() == ["Path\tRuleset\tResult\tGroups\tWith", ".\tframeworks\texpress\tjs\tversion: 4.1.0", ".\tpackage_managers\tnpm\tjs\t"]
    document = json.loads(out("digest", app))
    assert [f["name"] for f in document["selected_files"]] == ["README.md", "package.json"]
    assert document["selected_files"][0]["content"] == "Hello  redacted@example.org" and document["selected_files"][0]["cleaned"]
