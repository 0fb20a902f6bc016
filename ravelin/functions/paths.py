"""Column functions over manifest paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directories whose manifests belong to other projects or to build output.
VENDORED = (
    "node_modules", "bower_components", "jspm_packages", "vendor", "vendored", "third_party", "thirdparty", "third-party", "3rdparty",
    "external", "externals", "extern", "deps", "subprojects", "Godeps", "site-packages", "dist-packages", "venv", ".venv", "virtualenv",
    ".tox", ".nox", "build", "_build", "dist", "out", "target", "cmake-build-debug", "cmake-build-release", ".git", ".gradle", ".idea", ".cache",
)
#: Directories of a project's own peripheral code.
PERIPHERAL = (
    "example", "examples", "sample", "samples", "demo", "demos", "showcase", "test", "tests", "testdata", "test-data", "fixtures", "__tests__",
    "e2e", "spec", "benchmark", "benchmarks", "bench", "docs", "doc", "website", "www", "site",
)
#: Directories that are no module of the project.
NON_PROJECT = ("buildSrc", "build-logic", "node_modules", "vendor", "third_party", "third-party", "archetype-resources")
#: The manifest names of each ecosystem, in order of priority.
ECOSYSTEMS = {
    "go": ("go.mod",),
    "js": ("package.json",),
    "java": ("pom.xml", "build.gradle", "build.gradle.kts"),
    "rust": ("Cargo.toml",),
    "python": ("pyproject.toml", "requirements.txt"),
    "cpp": (".gitmodules", "vcpkg.json", "conanfile.py", "conanfile.txt"),
}


def directories(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def directory(path: Column) -> Column:
    return F.array_join(directories(path), "/")


def is_vendored(path: Column) -> Column:
    return F.arrays_overlap(directories(path), F.array(*map(F.lit, VENDORED)))


def manifest_kind(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.when(name.isin(*[k for ks in ECOSYSTEMS.values() for k in ks]), name)


def ecosystem(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind.isin(*ks), F.lit(e)) for e, ks in ECOSYSTEMS.items()])


def kind_priority(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, F.lit(i)) for ks in ECOSYSTEMS.values() for i, k in enumerate(ks)])


def is_project_module(path: Column) -> Column:
    d = directories(path)
    return (
        ~F.arrays_overlap(d, F.array(*map(F.lit, NON_PROJECT)))
        & ~F.coalesce(F.get(d, F.lit(0)) == "gradle", F.lit(False))
        & ~path.rlike(r"(?:^|/)src/[^/]*[Tt]est[^/]*/")
    )


def fetch_key(path: Column) -> Column:
    """Order in which a fetch budget is spent: depth, peripheral last, path."""
    d = directories(path)
    outer = F.exists(d, lambda x: F.lower(x).isin(*PERIPHERAL))
    return F.struct(F.size(d).alias("depth"), outer.alias("peripheral"), path.alias("path"))
