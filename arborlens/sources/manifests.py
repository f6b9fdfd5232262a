"""Readers of dependency manifests and lock files: one file's bytes to entries.

An entry is (role, seq, vendor, name, constraint, version, is_direct, is_dev_only). The role says what it does to the
dependency of that name in its directory: `set` puts it in place, `lock` only brings a version (and an indirect dependency where there is none).
"""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple
from xml.etree import ElementTree

import yaml


class Entry(NamedTuple):
    role: str
    name: str
    constraint: str = ""
    version: str = ""
    vendor: str = ""
    is_direct: bool = True
    is_dev_only: bool = False


# The forms of names and versions in manifests.
NAME_AT_VERSION = re.compile(r"^((?:jsr:|npm:)?(?:@[\w-]+/)?[a-z0-9._](?:[a-z0-9\-.]*[a-z0-9]))?@([\dvx*]+(?:[-.](?:[\dx*]+|alpha|beta))*)", re.A)
URL_PACKAGE = re.compile(r"^(https://(?:deno\.land/x|esm\.sh)/[^/@]+)@([\dvx*]+(?:[-.](?:[\dx*]+|alpha|beta))*)/$", re.A)
REQUIREMENT = re.compile(r"^([\w\-.]+(?:\[[^\]]+\])?)(.*)$", re.A)
PIPFILE_LINE = re.compile(r'^\s*"?([\w-]+)"?\s*=\s*"([^"]+)"', re.A)
GRADLE = re.compile(r"""^(?:implementation|compileOnly|runtimeOnly) ['"]?([^'":]+):([^'":]+):([^'"]+)['"]?$""")
GRADLE_KTS = re.compile(r"""^(?:implementation|compileOnly|runtimeOnly)\(['"]?([^'":]+):([^'":]+):([^'"]+)['"]?\)$""")
SBT = re.compile(r"""['"]([^'"]+)['"]\s*%{1,2}\s*['"]([^'"]+)['"]\s*%\s*['"]([^'"]+)['"]""")
GEM = re.compile(r"""^gem\s+['"]([a-zA-Z0-9_-]+)['"](?:,\s*['"]([^'"]+)['"])?""")
GEM_LOCK = re.compile(r"^\s{4}([a-zA-Z0-9_-]+) \(([^)]+)\)$")
MIX = re.compile(r'^\{\s*:(\w+),\s*"([^"]+)"', re.A)
MIX_LOCK = re.compile(r'^\s{2}"([a-zA-Z0-9_-]+)": \{:(\w+), :(\w+), "([^"]+)", .*\}$', re.A)
GO_REQUIRE = re.compile(r"^(\S+)\s+(v\S+)(?:\s*//\s*(.*))?$")


class ManifestError(ValueError):
    """A manifest that can't be read."""


def js_vendor(name: str) -> str:
    return name[1:].split("/")[0] if name.startswith("@") and "/" in name else ""


def before_slash(name: str) -> str:
    return name.split("/", 1)[0] if "/" in name else ""


def as_map(value: Any) -> dict:
    return value if isinstance(value, dict) else {}


def field(value: dict, key: str) -> Any:
    """A key of a JSON object, in the exact case first and else in any."""
    return value[key] if key in value else next((v for k, v in value.items() if k.lower() == key.lower()), None)


def texts(value: Any) -> dict[str, str]:
    return {k: v for k, v in as_map(value).items() if isinstance(v, str)}


def json_object(text: str) -> dict:
    return as_map(json.loads(text)) if text.strip() else {}


def jsonc(text: str) -> dict:
    """JSON with comments and commas before closing brackets; texts stay as they are."""
    out = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or " ", text, flags=re.S)
    return as_map(json.loads(re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", out, flags=re.S)))


def at_version(spec: str, vendor: Callable[[str], str], role: str = "lock", direct: bool = False) -> Iterator[Entry]:
    if (m := NAME_AT_VERSION.match(spec)) and m[1]:
        yield Entry(role, m[1], version=m[2], vendor=vendor(m[1]), is_direct=direct)


def package_json(text: str) -> Iterator[Entry]:
    o = json_object(text)
    dev = texts(field(o, "devDependencies"))
    for name, c in {**texts(field(o, "dependencies")), **dev}.items():
        yield Entry("set", name, c, vendor=js_vendor(name), is_dev_only=name in dev)


def package_lock(text: str) -> Iterator[Entry]:
    o = json_object(text)
    for part, cut in (("dependencies", ""), ("packages", "node_modules/")):
        for name, info in as_map(field(o, part)).items():
            name = name.removeprefix(cut) if cut else name
            yield Entry("lock", name, version=str(as_map(info).get("version") or ""), vendor=js_vendor(name), is_direct=False)


def pnpm_lock(text: str) -> Iterator[Entry]:
    for spec in as_map(as_map(yaml.safe_load(text)).get("packages")):
        yield from at_version(str(spec), js_vendor)


def bun_lock(text: str) -> Iterator[Entry]:
    for info in as_map(jsonc(text).get("packages")).values():
        if isinstance(info, list) and info and isinstance(info[0], str):
            yield from at_version(info[0], js_vendor)


def deno_json(text: str) -> Iterator[Entry]:
    for spec in texts(json_object(text).get("imports")).values():
        if spec.startswith(("jsr:", "npm:")):
            yield from at_version(spec, lambda _: "", "set", True)
        elif m := URL_PACKAGE.match(spec):
            yield Entry("set", m[1], version=m[2])


def deno_lock(text: str) -> Iterator[Entry]:
    o = json_object(text)
    for part in ("jsr", "npm"):
        for spec in as_map(o.get(part)):
            yield from at_version(spec, lambda _: "")


def lines(text: str) -> list[str]:
    return text.replace("\r\n", "\n").split("\n")


def meteor_packages(text: str) -> Iterator[Entry]:
    for line in map(str.strip, lines(text)):
        if line and not line.startswith("#"):
            yield Entry("set", line)


def meteor_versions(text: str) -> Iterator[Entry]:
    for line in map(str.strip, lines(text)):
        name, at, version = line.partition("@")
        if at:
            yield Entry("lock", name, version=version, is_direct=False)


def composer_json(text: str) -> Iterator[Entry]:
    o = json_object(text)
    for part, dev in (("require", False), ("require-dev", True)):
        for name, c in texts(o.get(part)).items():
            yield Entry("set", name, c, vendor=before_slash(name), is_dev_only=dev)


def composer_lock(text: str) -> Iterator[Entry]:
    for p in json_object(text).get("packages") or ():
        if isinstance(p, dict) and isinstance(p.get("name"), str):
            yield Entry("lock", p["name"], version=str(p.get("version") or ""), vendor=before_slash(p["name"]), is_direct=False)


def requirement(spec: str, dev: bool = False) -> Iterator[Entry]:
    spec = spec.strip()
    if m := REQUIREMENT.match(spec):
        yield Entry("set", m[1], m[2], is_dev_only=dev)


def requirements_txt(text: str) -> Iterator[Entry]:
    for line in map(str.strip, lines(text)):
        if line and not line.startswith("#"):
            yield from requirement(line)


def pipfile(text: str) -> Iterator[Entry]:
    for line in lines(text):
        if m := PIPFILE_LINE.match(line.strip()):
            yield Entry("set", m[1], m[2])


def poetry_table(table: Any, dev: bool) -> Iterator[Entry]:
    for name, spec in as_map(table).items():
        if isinstance(spec, str):
            yield Entry("set", name, spec, is_dev_only=dev)
        elif isinstance(spec, dict):
            if isinstance(spec.get("version"), str):
                yield Entry("set", name, spec["version"], is_dev_only=dev)
        else:
            raise ManifestError(f"unrecognized poetry version {spec!r}")


def pyproject(text: str) -> Iterator[Entry]:
    o = tomllib.loads(text)
    project, poetry = as_map(o.get("project")), as_map(as_map(o.get("tool")).get("poetry"))
    yield from poetry_table(poetry.get("dependencies"), False)
    for spec in project.get("dependencies") or ():
        yield from requirement(spec)
    for spec in as_map(o.get("dependency-groups")).get("dev") or ():
        if isinstance(spec, str):
            yield from requirement(spec, True)
    yield from poetry_table(poetry.get("dev-dependencies"), True)
    yield from poetry_table(as_map(as_map(poetry.get("group")).get("dev")).get("dependencies"), True)
    for spec in as_map(project.get("optional-dependencies")).get("dev") or ():
        yield from requirement(spec, True)


def toml_lock(text: str) -> Iterator[Entry]:
    for p in tomllib.loads(text).get("package") or ():
        if p.get("name"):
            yield Entry("lock", p["name"], version=str(p.get("version") or ""), is_direct=False)


def escaped(document: str) -> str:
    """JSON with the signs of HTML written as escapes."""
    for sign in "<>&":
        document = document.replace(sign, f"\\u{ord(sign):04x}")
    return document


def cargo_toml(text: str) -> Iterator[Entry]:
    o = tomllib.loads(text)
    for part, dev in (("dependencies", False), ("dev-dependencies", True)):
        for name, spec in as_map(o.get(part)).items():
            if isinstance(spec, str):
                yield Entry("set", name, spec, is_dev_only=dev)
            elif isinstance(spec, dict) and all(isinstance(v, str) for v in spec.values()):
                yield Entry("set", name, escaped(json.dumps(spec, sort_keys=True, separators=(",", ":"), ensure_ascii=False)), is_dev_only=dev)


def local(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def child_texts(element: ElementTree.Element) -> dict[str, str]:
    return {local(e): (e.text or "").strip() for e in element}


def pom_xml(text: str) -> Iterator[Entry]:
    root = ElementTree.fromstring(text.strip())
    found = [e for e in root if local(e) == "parent"] + [d for e in root if local(e) == "dependencies" for d in e if local(d) == "dependency"]
    for e in found:
        t = child_texts(e)
        if local(e) == "dependency" or t.get("groupId"):
            group = t.get("groupId", "")
            yield Entry("set", f"{group}:{t.get('artifactId', '')}", version=t.get("version", ""), vendor=group)


def gradle(text: str, form: re.Pattern = GRADLE) -> Iterator[Entry]:
    for line in lines(text):
        if m := form.match(line.strip()):
            yield Entry("set", f"{m[1]}:{m[2]}", version=m[3], vendor=m[1])


def build_sbt(text: str) -> Iterator[Entry]:
    """Every `group % artifact % version` in the value of a `libraryDependencies` setting: the brackets that open there up to where they close, or else the rest of the line."""
    plain = re.sub(r"(?m)(?<![:\"'])//.*$", "", text)
    for setting in re.finditer(r"\blibraryDependencies\s*\+{1,2}=\s*", plain):
        end = plain.find("\n", setting.end())
        end = len(plain) if end < 0 else end
        opening = plain.find("(", setting.end(), end)
        if opening >= 0:
            depth = 0
            for bracket in re.finditer(r"[()]", plain[opening:]):
                depth += 1 if bracket[0] == "(" else -1
                if not depth:
                    end = opening + bracket.end()
                    break
            else:
                end = len(plain)
        for m in SBT.finditer(plain, setting.end(), end):
            yield Entry("set", f"{m[1]}:{m[2]}", version=m[3], vendor=m[1])


def go_mod(text: str) -> Iterator[Entry]:
    inside = False
    for line in map(str.strip, lines(text)):
        if inside and line.startswith(")"):
            inside = False
        elif re.match(r"require\s*\($", line):
            inside = True
        elif m := GO_REQUIRE.match(line if inside else line.removeprefix("require ").strip() if line.startswith("require ") else ""):
            yield Entry("set", m[1].strip('"'), version=m[2], is_direct=not re.match(r"indirect\b", m[3] or ""))


def csproj(text: str) -> Iterator[Entry]:
    try:
        root = ElementTree.fromstring(text.strip().lstrip("\ufeff"))
    except ElementTree.ParseError:
        return
    for group in root:
        for e in group if local(group) == "ItemGroup" else ():
            if local(e) == "PackageReference":
                yield Entry("set", e.get("Include") or "", e.get("Version") or "")


def nuget_lock(text: str) -> Iterator[Entry]:
    for target in as_map(json_object(text).get("targets")).values():
        for key in as_map(target):
            name, slash, version = key.partition("/")
            if slash:
                yield Entry("lock", name, version=version, is_direct=False)


def gemfile(text: str) -> Iterator[Entry]:
    for line in lines(text):
        if m := GEM.match(line.strip()):
            yield Entry("set", m[1], m[2] or "")


def gemfile_lock(text: str) -> Iterator[Entry]:
    for line in lines(text):
        if m := GEM_LOCK.match(line):
            yield Entry("lock", m[1], version=m[2], is_direct=False)


def mix_exs(text: str) -> Iterator[Entry]:
    for line in lines(text):
        if m := MIX.match(line.strip()):
            yield Entry("set", m[1], m[2])


def mix_lock(text: str) -> Iterator[Entry]:
    for line in lines(text):
        if m := MIX_LOCK.match(line):
            yield Entry("lock", m[1], version=m[4], is_direct=False)


#: By file name, in the order in which a directory's files count: manager, reader.
READERS: dict[str, tuple[str, Callable[[str], Iterator[Entry]]]] = {
    ".meteor/packages": ("js", meteor_packages),
    ".meteor/versions": ("js", meteor_versions),
    "deno.json": ("js", deno_json),
    "deno.lock": ("js", deno_lock),
    "package.json": ("js", package_json),
    "package-lock.json": ("js", package_lock),
    "pnpm-lock.yaml": ("js", pnpm_lock),
    "bun.lock": ("js", bun_lock),
    "composer.json": ("php", composer_json),
    "composer.lock": ("php", composer_lock),
    "pyproject.toml": ("python", pyproject),
    "uv.lock": ("python", toml_lock),
    "poetry.lock": ("python", toml_lock),
    "requirements.txt": ("python", requirements_txt),
    "Pipfile": ("python", pipfile),
    "pom.xml": ("java", pom_xml),
    "build.gradle": ("java", gradle),
    "build.gradle.kts": ("java", lambda text: gradle(text, GRADLE_KTS)),
    "build.sbt": ("java", build_sbt),
    "go.mod": ("go", go_mod),
    ".csproj": ("dotnet", csproj),
    "packages.lock.json": ("dotnet", nuget_lock),
    "Gemfile": ("ruby", gemfile),
    "Gemfile.lock": ("ruby", gemfile_lock),
    "mix.exs": ("elixir", mix_exs),
    "mix.lock": ("elixir", mix_lock),
    "Cargo.toml": ("rust", cargo_toml),
    "Cargo.lock": ("rust", toml_lock),
}
ORDER = {name: i for i, name in enumerate(READERS)}
MANAGERS = ("dotnet", "elixir", "go", "java", "js", "php", "python", "ruby", "rust")


def manifest_key(path: str) -> str:
    """The name under which a file is read, or nothing: meteor files count with their directory, project files by their ending."""
    name = path.rpartition("/")[2]
    if name in ("packages", "versions"):
        return f".meteor/{name}" if path.endswith(f".meteor/{name}") else ""
    return ".csproj" if name.endswith(".csproj") else name if name in READERS else ""


def python_tool(text: str) -> str:
    """The tool that a pyproject.toml names."""
    try:
        tool = as_map(tomllib.loads(text).get("tool"))
    except ValueError:
        return ""
    return "poetry" if "poetry" in tool else "uv" if "uv" in tool else ""


def read_manifest(path: str, content: bytes | None) -> tuple[str, list[Entry], str]:
    """(manager, entries, error) of a file. Null and empty content gives no entries."""
    key = manifest_key(path)
    if not key:
        return "", [], ""
    manager, reader = READERS[key]
    try:
        text = (content or b"").decode("utf-8", "replace")
        return manager, list(reader(text)) if text.strip() else [], ""
    except Exception as e:  # noqa: BLE001 - what the formats' readers raise differs
        return manager, [], f"{path}: {e}"[:500]
