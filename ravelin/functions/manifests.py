"""Parsers of manifest texts that keep state or need a TOML or XML reader, as Arrow-batched functions.

A text that can't be read gives an empty list, never an error.
"""

from __future__ import annotations

import json
import re
import tomllib
import xml.etree.ElementTree as ElementTree
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import requirement_name
from .uris import relative_repo, repo_of_url, URL_READINGS

#: Extras that serve work on a project, not its use.
DEV_GROUPS = frozenset(
    "dev devel develop development test tests testing doc docs documentation lint linting typecheck typing build ci style format benchmark "
    "bench coverage release publish check checks static-analysis".split()
)
#: Gradle configurations that are real dependencies.
GRADLE_CONFIGS = frozenset(("implementation", "api", "compile", "runtimeOnly", "runtime"))


def _udf(fn: Callable, kind: str) -> Callable[[Column], Column]:
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: fn(t) if t is not None else [])

    return run


def _toml(text: str) -> dict:
    try:
        return tomllib.loads(text)
    except ValueError:
        return {}


def _at(node, *path):
    for p in path:
        node = node.get(p) if isinstance(node, dict) else None
    return node


def _strings(x) -> list[str]:
    return [v for v in x if isinstance(v, str)] if isinstance(x, list) else []


def pyproject_specs(text: str) -> list[str]:
    doc = _toml(text)
    specs = _strings(_at(doc, "project", "dependencies"))
    extras = _at(doc, "project", "optional-dependencies")
    for group, reqs in extras.items() if isinstance(extras, dict) else ():
        specs += _strings(reqs) if str(group).strip().lower() not in DEV_GROUPS else []
    poetry = _at(doc, "tool", "poetry", "dependencies")
    return specs + [k for k in poetry if k.lower() != "python"] if isinstance(poetry, dict) else specs


def cargo_specs(text: str) -> list[dict]:
    """name and, of git dependencies, the URL; path dependencies are the project's own."""
    doc = _toml(text)
    tables = [_at(doc, "dependencies"), _at(doc, "workspace", "dependencies")]
    targets = _at(doc, "target")
    tables += [_at(t, "dependencies") for t in targets.values()] if isinstance(targets, dict) else []
    out = []
    for name, spec in ((n, s) for t in tables if isinstance(t, dict) for n, s in t.items()):
        if isinstance(spec, str):
            out.append({"name": name, "package": name, "git": None})
        elif isinstance(spec, dict) and "path" not in spec:
            git = spec.get("git") if isinstance(spec.get("git"), str) else None
            out.append({"name": name, "package": str(spec.get("package") or name), "git": git or None})
    return out


def go_requires(text: str) -> list[str]:
    """Module paths required directly: outside blocks as 'require path version', inside as 'path version'."""
    found, inside = [], False
    for line in map(str.strip, text.splitlines()):
        if inside and line == ")":
            inside = False
        elif not inside and re.fullmatch(r"require\s*\(", line):
            inside = True
        elif m := re.match(r"(\S+)\s+\S+(.*)" if inside else r"require\s+(\S+)\s+\S+(.*)", line):
            if not (inside and line.startswith("//")) and "indirect" not in m[2].lower():
                found.append(m[1])
    return found


def _children(node, name):
    return [c for c in node if c.tag.rpartition("}")[2] == name]


def _text(node, name):
    got = _children(node, name)
    return (got[-1].text or "").strip() if got else ""


def _xml(text: str):
    try:
        return ElementTree.fromstring(text)
    except (ElementTree.ParseError, ValueError):
        return None


def pom_dependencies(text: str) -> list[dict]:
    """Coordinates directly under the project's dependencies, without test scope and templates."""
    root, out = _xml(text), []
    for dep in [d for block in _children(root, "dependencies") for d in _children(block, "dependency")] if root is not None else []:
        g, a = _text(dep, "groupId"), _text(dep, "artifactId")
        if g and a and _text(dep, "scope") != "test" and "${" not in g + a:
            out.append({"group": g, "artifact": a})
    return out


def pom_coordinate(text: str) -> list[dict]:
    """What the project publishes: its own group, else the parent's."""
    root = _xml(text)
    if root is None:
        return []
    g = _text(root, "groupId") or next((t for p in _children(root, "parent") if (t := _text(p, "groupId"))), "")
    a = _text(root, "artifactId")
    return [{"group": g, "artifact": a}] if g and a else []


_GRADLE = (
    re.compile(r"""(\w+)\s*[(\s]\s*["']([\w.\-]+):([\w.\-]+)(?::[^"']*)?["']"""),
    re.compile(r"""(\w+)\s*\(?\s*group:\s*["']([\w.\-]+)["']\s*,\s*name:\s*["']([\w.\-]+)["']"""),
)


def gradle_dependencies(text: str) -> list[dict]:
    """Coordinates inside a top-level dependencies block, whose end is told by counting braces."""
    out, depth = [], 0
    for line in map(str.strip, text.splitlines()):
        if not line or line.startswith("//"):
            continue
        rise = line.count("{") - line.count("}")
        if depth <= 0:
            depth = max(0, rise) if re.match(r"dependencies\s*\{", line) else 0
            continue
        depth += rise
        hit = next((m for p in _GRADLE if (m := p.match(line)) and m[1] in GRADLE_CONFIGS), None) if depth > 0 else None
        if hit:
            out.append({"group": hit[2], "artifact": hit[3]})
    return out


def maven_versions(text: str) -> list[str]:
    """[the latest version] of a metadata document: the first release or latest, else the last listed."""
    root = _xml(text)
    if root is None:
        return []
    tags = [(e.tag.rpartition("}")[2], (e.text or "").strip()) for e in root.iter()]
    named = [t for tag, t in tags if tag in ("release", "latest") and t]
    return named[:1] or [t for tag, t in tags if tag == "version" and t][-1:]


def submodules(text: str) -> list[dict]:
    """(section, path, url) of each submodule."""
    out: list[dict] = []
    for line in map(str.strip, text.splitlines()):
        if m := re.match(r'\[submodule\s+"?(.*?)"?\]', line):
            out.append({"section": m[1], "path": None, "url": None})
        elif out and (m := re.match(r"(\w+)\s*=\s*(.*)", line)) and m[1].lower() in ("path", "url"):
            out[-1][m[1].lower()] = m[2].strip()
    return [s for s in out if s["url"]]


def vcpkg_names(text: str) -> list[str]:
    try:
        doc = json.loads(text)
    except ValueError:
        return []
    features = _at(doc, "features")
    blocks = [_at(doc, "dependencies")] + [_at(f, "dependencies") for f in (features.values() if isinstance(features, dict) else features if isinstance(features, list) else [])]
    entries = [e for b in blocks if isinstance(b, list) for e in b]
    names = [e if isinstance(e, str) else e.get("name") if isinstance(e, dict) and not e.get("host") else None for e in entries]
    return [n for n in names if isinstance(n, str) and n and not n.startswith("vcpkg-")]


def conan_txt_names(text: str) -> list[str]:
    out, section = [], ""
    for line in (x.split("#", 1)[0].strip() for x in text.splitlines()):
        if line.startswith("["):
            section = line.lower()
        elif line and section == "[requires]" and (name := line.split("/", 1)[0].strip()):
            out.append(name)
    return out


def conan_py_names(text: str) -> list[str]:
    named = r"""["']([A-Za-z0-9_.+-]+)/"""
    calls = re.findall(r"self\.requires\(\s*" + named, text)
    return calls + [n for rest in re.findall(r"(?m)^\s*requires\s*=\s*(.+?)$", text) for n in re.findall(named, rest)]


STRINGS, COORDS = "array<string>", "array<struct<group:string,artifact:string>>"


def _named(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return f


pyproject = _named(lambda text: F.filter(F.transform(_udf(pyproject_specs, STRINGS)(text), requirement_name), lambda x: x.isNotNull()))
go_mod = lambda text: _udf(go_requires, STRINGS)(text)
pom = lambda text: _udf(pom_dependencies, COORDS)(text)
pom_own = lambda text: F.get(_udf(pom_coordinate, COORDS)(text), F.lit(0))
gradle = lambda text: _udf(gradle_dependencies, COORDS)(text)
maven_latest = lambda text: F.get(_udf(maven_versions, STRINGS)(text), F.lit(0))
vcpkg = lambda text: _udf(vcpkg_names, STRINGS)(text)
conan_txt = lambda text: _udf(conan_txt_names, STRINGS)(text)
conan_py = lambda text: _udf(conan_py_names, STRINGS)(text)


def cargo(text: Column) -> Column:
    """array<struct<name, repo>>: registry names (renames followed), and with repo those that come straight from the forge."""
    specs = _udf(cargo_specs, "array<struct<name:string,package:string,git:string>>")(text)
    read = F.transform(specs, lambda s: F.struct(F.when(repo_of_url(s["git"], **URL_READINGS["maven"]).isNull(), s["package"]).otherwise(s["name"]).alias("name"), repo_of_url(s["git"], **URL_READINGS["maven"]).alias("repo"), s["git"].alias("git")))
    return F.transform(F.filter(read, lambda s: s["git"].isNull() | s["repo"].isNotNull()), lambda s: F.struct(s["name"].alias("name"), s["repo"].alias("repo")))


def gitmodules(text: Column, source: Column) -> Column:
    """array<struct<label, repo>> of submodules on the forge, relative URLs read against the source repository."""
    mods = _udf(submodules, "array<struct<section:string,path:string,url:string>>")(text)
    repo = lambda s: F.coalesce(repo_of_url(s["url"], **URL_READINGS["maven"]), F.when(s["url"].startswith(".."), relative_repo(s["url"], source)))
    read = F.transform(mods, lambda s: F.struct(F.coalesce(F.nullif(s["path"], F.lit("")), F.nullif(s["section"], F.lit("")), repo(s)).alias("label"), repo(s).alias("repo")))
    return F.filter(read, lambda s: s["repo"].isNotNull())


def package_json(text: Column) -> Column:
    """Names under 'dependencies' of a JSON object; [] for anything else."""
    return F.coalesce(F.json_object_keys(F.get_json_object(text, "$.dependencies")), F.array().cast("array<string>"))
