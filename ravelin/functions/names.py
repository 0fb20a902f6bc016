"""Column functions over package names, requirements and versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .uris import some


def normalized(name: Column) -> Column:
    """Lower, runs of '-', '_' and '.' as one '-'."""
    return F.lower(F.regexp_replace(name, r"[-_.]+", "-"))


def requirement_name(spec: Column) -> Column:
    """The project of a requirement line; null for comments, flags and bare URLs."""
    s = F.regexp_replace(F.substring_index(spec, "#", 1), r"^\s+|\s+$", "")
    bare_url = F.contains(F.substring_index(s, "@", 1), F.lit("://"))
    return F.when((s != "") & ~s.startswith("-") & ~bare_url, some(F.regexp_extract(s, r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1)))


def requirement_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), requirement_name), lambda x: x.isNotNull())


def depends_names(field: Column) -> Column:
    """Package names of a Depends field; of alternatives the first."""
    first = lambda g: some(F.regexp_extract(F.trim(F.substring_index(g, "|", 1)), r"^([a-z0-9][a-z0-9+.-]*)", 1))
    return F.filter(F.transform(F.split(field, ","), first), lambda x: x.isNotNull())


def upstream_version(v: Column) -> Column:
    """Without epoch, packaging revision and repackaging suffix."""
    no_epoch = F.regexp_replace(v, r"^[^:]*:", "")
    no_revision = F.regexp_replace(no_epoch, r"-[^-]*$", "")
    return F.trim(F.get(F.split(no_revision, r"[+~](?:really|dfsg|ds|git|repack|orig)"), F.lit(0)))


#: The ways versions are written into tags, each scanned by itself.
VERSION_FORMS = (r"(\d+(?:[._]\d+)+)", r"(\d+(?:-\d+)+)", r"(?<!\d)(\d{6,8})(?!\d)")


def version_candidates(tag: Column) -> Column:
    """Distinct versions a tag may encode, dotted, with the compact form of dates."""
    t = F.coalesce(tag, F.lit(""))
    found = F.flatten(F.array(*[F.regexp_extract_all(t, F.lit(p), 1) for p in VERSION_FORMS]))
    dotted = F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, "[_-]", "."), r"^\.+|\.+$", ""))
    dates = F.transform(F.filter(dotted, lambda x: x.rlike(r"^\d{4}\.\d{2}\.\d{2}$")), lambda x: F.replace(x, F.lit("."), F.lit("")))
    return F.array_distinct(F.filter(F.concat(dotted, dates), lambda x: x != ""))


def version_core(version: Column) -> Column:
    """The longest candidate, of equally long the greatest; empty if there is none."""
    best = F.array_max(F.transform(version_candidates(version), lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))
    return F.coalesce(best["x"], F.lit(""))


def version_matches(core: Column, candidate: Column) -> Column:
    dot = lambda c: F.concat(c, F.lit("."))
    return (core != "") & ((candidate == core) | candidate.startswith(dot(core)) | core.startswith(dot(candidate)))


#: Prefixes and suffixes by which distributions alter a project's name.
NAME_PREFIX = r"^(?:python3?-|node-|golang-|ruby-|r-cran-|rust-|lib)"
NAME_SUFFIX = r"(?:[0-9._]+|-dev|-bin|-utils|-tools)$"


def name_variants(package: Column) -> Column:
    """The names a package may be known by upstream, in order of preference."""
    bare = F.regexp_replace(package, NAME_PREFIX, "")
    cut = lambda c: F.regexp_replace(c, NAME_SUFFIX, "")
    clean = lambda c: F.lower(F.regexp_replace(c, r"^[-.]+|[-.]+$", ""))
    return F.array_distinct(F.filter(F.transform(F.array(package, cut(package), bare, cut(bare)), clean), lambda x: x != ""))
