"""Column functions over resource URIs, repository URLs and slugs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def short_predicate(p: Column) -> Column:
    """What follows the last '/', and in that the last '#'."""
    return F.substring_index(F.substring_index(p, "/", -1), "#", -1)


def subject_name(s: Column, prefix: str) -> Column:
    return F.when(s.startswith(prefix), F.substr(s, F.lit(len(prefix) + 1))).otherwise(s)


def reference_subject(s: Column, kind: str = "contributorreference", to: str = "repository") -> Column:
    """.../<kind>/owner/name/<n> as the subject it belongs to: .../<to>/owner/name."""
    return F.regexp_replace(s, rf"(?i)/{kind}/([^/]+/[^/]+)/[^/]+$", f"/{to}/$1")


def object_kind(o: Column, base: str) -> tuple[Column, Column]:
    """(type, label) of an object URI; the first rule that holds decides."""
    path = F.replace(o, F.lit(base), F.lit(""))
    tail = F.substring_index(path, "/", -1)
    after = lambda n: F.substr(path, F.lit(n + 1))
    rules = [
        (path.startswith("person/"), "person", after(7)),
        (path.startswith("forkedRepo/"), "forkedRepo", after(11)),
        (path.rlike("^contributor[rR]eference/"), "contributorReference", F.concat(F.lit("contributorRef #"), tail)),
        (path.startswith("package/"), "package", after(8)),
        (F.contains(path, F.lit("/issue/")) | path.startswith("issue/"), "issue", F.concat(F.lit("issue/"), F.substring_index(path, "issue/", -1))),
    ]
    kind = F.coalesce(*[F.when(c, F.lit(k)) for c, k, _ in rules], F.lit("other"))
    label = F.coalesce(*[F.when(c, x) for c, _, x in rules], path)
    return kind, label


def is_forge_node(node: Column) -> Column:
    """A first segment with a dot is a host, as owners have none."""
    return F.contains(F.substring_index(node, "/", 1), F.lit("."))


#: First path segments of the forge that are no owners.
NOT_OWNERS = ("orgs", "sponsors", "apps", "marketplace")


def _pair(c: Column, pattern: str) -> Column:
    a, b = F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2)
    return F.when(a != "", F.concat(a, F.lit("/"), b))


def repo_of_url(url: Column, tail: str = "#", guard: bool = True, lead: str = "anchored", shorthand: bool = False) -> Column:
    """owner/name named by a URL of the forge, or null. The uses differ and are not interchangeable:

    tail: what may follow the name, one of '#' or '#?' as a class, or '' for nothing. lead: 'anchored' wants http(s) at the start, 'search' finds
    the host anywhere with ':' or '/' after it, 'path' only with '/'. guard refuses segments that are no owners. shorthand reads
    'github:' prefixes and bare owner/name.
    """
    c = F.regexp_replace(url, r"^\s+|\s+$", "")
    head = {"anchored": r"^https?://github\.com/", "search": r"github\.com[:/]", "path": r"github\.com/"}[lead]
    owner = r"([^/\s#]+)" if lead == "anchored" else r"([^/\s]+)"
    name = r"([^/\s]+?)" if tail == "" and lead == "anchored" else r"([^/\s#?]+?)"
    rest = rf"(?:[{tail}].*)?" if tail else ""
    if shorthand:
        c = F.regexp_replace(c, r"^github:", "")
    found = _pair(c, rf"{head}{owner}/{name}(?:\.git)?/?{rest}$")
    if guard:
        found = F.when(~F.lower(F.substring_index(found, "/", 1)).isin(*NOT_OWNERS), found)
    if shorthand:
        short = F.when(~F.contains(c, F.lit("://")) & ~F.contains(c, F.lit("@")), some(F.regexp_extract(c, r"^[\w.-]+/[\w.-]+$", 0)))
        found = F.coalesce(short, found)
    return found


#: The named readings of repo_of_url.
URL_READINGS = {
    "pypi": dict(tail="#", guard=True, lead="anchored"),
    "python": dict(tail="#?", guard=True, lead="anchored"),
    "npm": dict(tail="#?", guard=False, lead="search", shorthand=True),
    "maven": dict(tail="#?", guard=False, lead="search"),
    "debian": dict(tail="", guard=False, lead="path"),
}

#: The names under which a package index lists the source repository, best first.
URL_KEYS = ("repository", "source", "source code", "code", "github", "homepage", "home")


def package_repo(project_urls: Column, home_page: Column, download_url: Column, keys: Sequence[str] = URL_KEYS) -> Column:
    """owner/name of a package: the listed names by priority, then any listed URL in order, then the home page and the download URL."""
    read = lambda u: repo_of_url(u, **URL_READINGS["pypi"])
    entries = F.map_entries(project_urls)

    def listed(k: str) -> Column:
        urls = F.transform(F.filter(entries, lambda e: F.lower(F.trim(e["key"])) == k), lambda e: read(e["value"]))
        return F.get(F.filter(urls, lambda x: x.isNotNull()), F.lit(0))

    named = [listed(k) for k in keys]
    anyone = F.get(F.filter(F.transform(entries, lambda e: read(e["value"])), lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(*named, anyone, read(home_page), read(download_url))


def module_repo(path: Column) -> Column:
    """owner/name of a module path on the forge itself, which needs three segments; null for others."""
    parts = F.split(path, "/")
    return F.when(path.startswith("github.com/") & (F.size(parts) >= 3), F.concat_ws("/", F.get(parts, F.lit(1)), F.get(parts, F.lit(2))))


def go_import_repo(html: Column) -> Column:
    """owner/name in a page's go-import tag: the third word, if it is a URL of the forge."""
    flat = F.regexp_replace(html, r"\s+", " ")
    content = F.regexp_extract(flat, r'(?i)<meta\s+name="go-import"\s+content="([^"]*)"', 1)
    words = F.split(F.trim(content), r"\s+")
    return repo_of_url(F.get(words, F.lit(2)), tail="", guard=False, lead="anchored")


def forge_node(url: Column) -> Column:
    """host/path of an origin elsewhere: no scheme, no .git, no leading git/ mount point."""
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"^https://", ""), r"^http://", ""), r"\.git$", "")
    host = F.substring_index(rest, "/", 1)
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.substr(rest, F.length(host) + 2), r"^git/", ""), r"^/+", ""), r"/+$", "")
    return F.when(path != "", F.concat_ws("/", host, path)).otherwise(host)


def origin_url(node: Column, *recorded: Column) -> Column:
    """The first recorded origin, else the one the id's form implies."""
    implied = F.when(is_forge_node(node), F.concat(F.lit("https://"), node)).otherwise(F.concat(F.lit("https://github.com/"), node))
    return F.coalesce(*[some(r) for r in recorded], implied)


def relative_repo(url: Column, source: Column) -> Column:
    """owner/name that a relative submodule URL means under a repository owner/name: each leading ../ drops a segment of the source,
    and only two remaining segments are a repository."""
    ups = F.length(F.regexp_extract(url, r"^((?:\.\./)*)", 1)) / 3
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"^(?:\.\./)+", ""), r"^\./", ""), r"\.git$", "")
    have = F.split(source, "/")
    left = F.greatest(F.size(have) - ups, F.lit(0)).cast("int")
    whole = F.filter(F.concat(F.slice(have, 1, left), F.split(rest, "/")), lambda p: p != "")
    return F.when((ups <= F.size(have)) & (F.size(whole) == 2), F.array_join(whole, "/"))
