"""N-Triples text as rows, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.uris import reference_subject, subject_name


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value): line_no grows in file order; it is a position, not a count."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), "value")


#: What a literal can't hold as it is, and its escape; the backslash first.
ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))


def escape(o: Column) -> Column:
    for c, e in ESCAPES:
        o = F.replace(o, F.lit(c), F.lit(e))
    return o


def unescape(o: Column) -> Column:
    """Undoes escape(); other escapes stay as written."""
    o = F.replace(o, F.lit("\\\\"), F.lit("\0"))  # no text of a triple holds a zero
    for c, e in ESCAPES[1:]:
        o = F.replace(o, F.lit(e), F.lit(c))
    return F.replace(o, F.lit("\0"), F.lit("\\"))


def parse(lines: DataFrame, value: str = "value", escaped: bool = False) -> DataFrame:
    """Lines as (other columns, s, p, o, kind): kind 'uri' or 'literal', the literal's escapes kept as written, or undone if `escaped`, its datatype and language dropped.

    A line that is no triple or does not end in '.' has no row.
    """
    t = F.trim(F.regexp_replace(value, r"^\s+|\s+$", ""))
    head = r"^<([^>]*)>\s+<([^>]*)>\s+"
    uri, literal = head + r"<([^>]*)>\s*\.$", head + r'"((?:[^"\\]|\\.)*)"(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^<[^>]*>)?\s*\.$'
    is_uri, is_literal = t.rlike(uri), t.rlike(literal)
    read = F.regexp_extract(t, literal, 3)
    rest = [c for c in lines.columns if c != value]
    return lines.where(is_uri | is_literal).select(
        *rest,
        F.regexp_extract(t, head, 1).alias("s"),
        F.regexp_extract(t, head, 2).alias("p"),
        F.when(is_uri, F.regexp_extract(t, uri, 3)).otherwise(unescape(read) if escaped else read).alias("o"),
        F.when(is_uri, "uri").otherwise("literal").alias("kind"),
    )


def render(s: Column, p: Column, o: Column, kind: Column, escaped: bool = False) -> Column:
    """A triple's line; a literal is written as it is, with the escapes it came with, or if `escaped` is text that gets its escapes here."""
    o = F.when(kind == "uri", o).otherwise(escape(o)) if escaped else o
    return F.concat(F.lit("<"), s, F.lit("> <"), p, F.lit("> "), F.when(kind == "uri", F.concat(F.lit("<"), o, F.lit(">"))).otherwise(F.concat(F.lit('"'), o, F.lit('"'))), F.lit(" ."))


def write_lines(triples: DataFrame, path: str) -> None:
    triples.select(render(F.col("s"), F.col("p"), F.col("o"), F.col("kind")).alias("value")).write.mode("overwrite").text(path)


def of_cohort(triples: DataFrame, cohort: DataFrame, prefix: str, key: str = "repo") -> DataFrame:
    """Triples whose subject is a cohort member, with the member's own casing as `key`. The size of the cohort decides the join, not a hint."""
    ids = cohort.select(F.col(key)).where(F.col(key).isNotNull()).groupBy(F.lower(key).alias("_k")).agg(F.min(key).alias(key))
    return triples.withColumn("_k", F.lower(subject_name(F.col("s"), prefix))).join(ids, "_k").drop("_k")


def with_predicates(triples: DataFrame, pattern: str) -> DataFrame:
    return triples.where(F.col("p").rlike(pattern))


def referenced(triples: DataFrame) -> DataFrame:
    """Contributor references as triples of the repository they name: the URI holds it, so no join is needed."""
    return triples.withColumn("s", reference_subject(F.col("s")))


def bipartite(triples: DataFrame, predicate: str, key: Column, item: Column) -> DataFrame:
    """Distinct (left, item) of one predicate."""
    return triples.where(F.col("p") == predicate).select(key.alias("left"), item.alias("item")).where(F.col("left").isNotNull() & F.col("item").isNotNull()).distinct()
