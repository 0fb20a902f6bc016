"""Lists, tables and stanzas kept as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def commented(line: Column, fields: int = 2) -> Column:
    """The fields of a line without its comment, or null if their number differs."""
    parts = F.split(F.trim(F.regexp_replace(F.substring_index(line, "#", 1), r"\s+", " ")), " ")
    return F.when(F.size(parts) == fields, parts)


def read_commented(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    rows = spark.read.text(path).select(commented(F.col("value"), len(names)).alias("f")).where(F.col("f").isNotNull())
    return rows.select(*[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names)])


def read_cohort(spark: SparkSession, *paths: str) -> DataFrame:
    """Distinct ids of one-per-line lists."""
    return spark.read.text(list(paths)).select(F.trim("value").alias("repo")).where(F.col("repo") != "").distinct()


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=schema)


def stanzas(text: Column) -> Column:
    """Blank-line separated 'Key: value' paragraphs of a text as array<map<string,string>>; indented lines continue the line
    before, of a repeated key the last holds."""
    paragraphs = F.filter(F.split(F.regexp_replace(text, r"\r\n?", "\n"), r"\n(?:[ \t]*\n)+"), lambda p: F.trim(p) != "")
    return F.transform(paragraphs, stanza)


def stanza(paragraph: Column) -> Column:
    joined = F.regexp_replace(F.regexp_replace(paragraph, r"^\n+", ""), r"\n[ \t]+", " ")
    lines = F.filter(F.split(joined, "\n"), lambda x: F.contains(x, F.lit(":")) & ~x.rlike(r"^[ \t]"))
    pair = lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.substr(x, F.length(F.substring_index(x, ":", 1)) + 2)).alias("v"))
    pairs = F.transform(lines, pair)
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)


def read_stanzas(spark: SparkSession, path: str) -> DataFrame:
    """One row per paragraph of a large index: the reader splits at blank lines, so files are read in parallel. Compressed indexes
    that Spark has no codec for must be unpacked before."""
    raw = spark.read.option("lineSep", "\n\n").text(path)
    return raw.where(F.trim("value") != "").select(stanza(F.col("value")).alias("fields"))
