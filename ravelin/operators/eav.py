"""Entity-attribute-value rows to one wide, typed row per entity."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import stored


@dataclass(frozen=True)
class Attribute:
    """field: output column. names: attribute names that feed it. parse: raw string to a typed value,
    null where the text is not such a value."""

    field: str
    names: tuple[str, ...]
    parse: Callable[[Column], Column]


def local_name(uri: Column) -> Column:
    """What follows the last '/' or '#'."""
    return F.regexp_extract(uri, r"([^/#]*)$", 1)


def bare_literal(o: Column) -> Column:
    """A literal without outer blanks, datatype suffix and quotes."""
    o = F.regexp_replace(o, r"^\s+|\s+$", "")
    o = F.regexp_replace(o, r"\^\^\S*$", "")
    return F.regexp_replace(o, r'^"?\s*|\s*"?$', "")


def whole_number(o: Column) -> Column:
    """long, for any notation of a whole number >= 0: sign, quotes, datatype, blanks, thousands separators,
    zero fractions and exponents are read; null for anything else, for negatives and beyond 64 bits."""
    t = F.regexp_replace(bare_literal(o), r"(?<=\d)[,_' ](?=\d{3}(\D|$))", "")
    plain = F.regexp_extract(t, r"^(?:\+|-(?=0+(?:\.0*)?$))?(\d+)(?:\.0*)?$", 1).try_cast("long")
    power = F.regexp_extract(t, r"^\+?(?:\d+(?:\.\d*)?|\.\d+)[eE][+-]?\d{1,2}$", 0).try_cast("decimal(38,9)")
    return F.coalesce(plain, F.regexp_extract(power.cast("string"), r"^(\d+)\.0+$", 1).try_cast("long"))


def decimal_number(o: Column) -> Column:
    t = bare_literal(o)
    return F.when(t.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d{1,3})?$"), t).try_cast("double")


def text_value(o: Column) -> Column:
    return F.nullif(F.trim(o), F.lit(""))


def wide_rows(
    df: DataFrame,
    entity: Column,
    attribute: Column,
    value: Column,
    order: Sequence[Column],
    attributes: Sequence[Attribute],
    key: str = "entity",
) -> DataFrame:
    """One row per entity with a typed, nullable column per attribute.

    One pass reduces the rows to the last usable value of every (entity, attribute) cell, combined before
    the shuffle, so an entity or an attribute that holds a third of the rows is no hot key. The cells are
    written partitioned by attribute: one narrow typed table each, read by partition pruning. The narrow
    tables, one row per entity, meet by entity in a balanced tree of full outer joins (depth log2 of the
    number of attributes, not a chain).

    Cases: rows with a null entity, attribute or value, or a value its parse rejects, give no cell; equal
    rows count once; of several values in a cell the greatest order wins; an attribute nobody states is a
    column of nulls; an empty input gives no rows; extra columns of the input are ignored.
    """
    by_name = {n: a for a in attributes for n in a.names}
    field = F.coalesce(*[F.when(attribute == n, F.lit(a.field)) for n, a in by_name.items()])
    raw = value.cast("string")
    parses = list(dict.fromkeys(a.parse for a in attributes))
    rows = df.select(entity.alias("_e"), field.alias("_f"), raw.alias("_v"), F.struct(*order).alias("_o")).where(
        F.col("_e").isNotNull() & F.col("_f").isNotNull() & F.col("_v").isNotNull()
    )
    # a typed column per parse; only the one of the row's attribute has a value
    of = {f: [a.field for a in attributes if a.parse is f] for f in parses}
    typed = rows.select("_e", "_f", "_o", F.struct(*[F.when(F.col("_f").isin(of[f]), f(F.col("_v"))).alias(f"_t{i}") for i, f in enumerate(parses)]).alias("_t"))
    some = reduce(or_, [F.col(f"_t._t{i}").isNotNull() for i in range(len(parses))])
    cells = (
        typed.groupBy("_e", "_f")
        .agg(F.max_by("_t", F.when(some, F.col("_o"))).alias("_t"))  # a value that does not parse has no order and never wins
        .where(F.col("_t").isNotNull())
        .select("_e", *[F.col(f"_t._t{i}").alias(f"_t{i}") for i in range(len(parses))], "_f")
    )
    narrow = stored(cells, ["_f"])
    level = [
        narrow.where(F.col("_f") == a.field).select(F.col("_e").alias(key), F.col(f"_t{parses.index(a.parse)}").alias(a.field))
        for a in attributes
    ]
    while len(level) > 1:
        level = [
            level[i].join(level[i + 1], key, "full_outer") if i + 1 < len(level) else level[i]
            for i in range(0, len(level), 2)
        ]
    return level[0].select(key, *[a.field for a in attributes])


#: The dump's count attributes.
REPO_COUNTS = (
    Attribute("stargazers", ("hasTotalStargazers",), whole_number),
    Attribute("forks", ("hasTotalForks",), whole_number),
    Attribute("contributors", ("hasTotalContributor",), whole_number),
    Attribute("open_issues", ("hasTotalOpenIssues",), whole_number),
)


def repo_slug(s: Column) -> Column:
    """lower owner/name of '<scheme>://.../repository/owner/name[/]', else null."""
    m = F.regexp_extract(s, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/]+/)+?repository/([^/]+/[^/]+?)/?$", 1)
    return F.when(m != "", F.lower(m))


def repo_counts(triples: DataFrame) -> DataFrame:
    """(repo, stargazers, forks, contributors, open_issues) from triples (line_no, s, p, o, kind, loaded_at)."""
    wanted = [n for a in REPO_COUNTS for n in a.names]
    near = F.lit(False)
    for n in wanted:
        near = near | F.col("p").endswith(n)
    lit = triples.where((F.col("kind") == "literal") & near)
    return wide_rows(
        lit, repo_slug(F.col("s")), local_name(F.col("p")), F.col("o"), [F.col("line_no"), F.col("loaded_at")], REPO_COUNTS, "repo"
    )


def cells(wide: DataFrame, key: str, fields: Sequence[str], name: str = "field", value: str = "value") -> DataFrame:
    """The non-null cells of a wide table as rows."""
    pairs = ", ".join(f"'{f}', `{f}`" for f in fields)
    return wide.selectExpr(f"`{key}`", f"stack({len(fields)}, {pairs}) as (`{name}`, `{value}`)").where(F.col(value).isNotNull())
