"""Column functions over prose."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(text: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the UTF-8 text."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def pseudonym(person: Column, salt: str) -> Column:
    """'person-' and 12 hex digits of a salted 16-byte BLAKE2b. Spark has no BLAKE2b; the salt is the caller's secret."""

    @F.pandas_udf("string")
    def hashed(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else "person-" + hashlib.blake2b(f"{salt}:{x}".encode(), digest_size=16).hexdigest()[:12])

    return hashed(person)


def pseudonym_sha(person: Column, salt: str) -> Column:
    """The same with SHA-256, inside the JVM."""
    return F.concat(F.lit("person-"), F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), person), 256), 1, 12))


def decoded_base64(text: Column) -> Column:
    """UTF-8 text of base64 with line breaks; null where it is no base64."""
    return F.decode(F.expr("try_to_binary(x, 'base64')") if isinstance(text, str) else F.try_to_binary(F.regexp_replace(text, r"\s", ""), F.lit("base64")), "UTF-8")


#: Function words that are never terms.
STOPWORDS = (
    "a an and are as at be been being but by can do does for from has have having in into is it its of on or our over such that the their then "
    "there these this to under up used using very was we were which while with you your about across after against all also among any around "
    "based both each either further here how if just like more most not now one only other out per same so some than them through when where "
    "who will within without"
).split()


def tokens(text: Column) -> Column:
    """Lower words of three or more letters or digits that begin with a letter, stopwords left out, repeats kept."""
    words = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([a-zA-Z][a-zA-Z0-9]{2,})"), 1), lambda x: F.lower(x))
    return F.filter(words, lambda w: ~w.isin(*STOPWORDS))


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


#: Lines that are no prose (headings, rules, badges, directives, markup).
SKIP_LINES = (
    r"^\s{0,3}#{1,6}\s",
    r"^\s*([-*_=]\s?){3,}\s*$",
    r"^\s*(\[!\[.*?\]\(.*?\)\]\(.*?\)\s*)+$",
    r"^\s*\.\.\s",
    r"^(<p|<img|<a |<div|<table|<tr|<td|\|)",
)
#: Markup inside a paragraph and what stands for it.
MARKUP = ((r"<[^>]+>", ""), (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"[*_`]{1,3}", ""), (r"https?://\S+", ""))


def first_paragraph(text: Column, min_words: int = 8, max_chars: int = 600, ascii_part: float = 0.7) -> Column:
    """The first paragraph of prose, cleaned of markup and cut; '' if there is none.

    Blank lines part paragraphs; lines that are no prose are left out without parting them.
    """
    body = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)```.*?```", ""), r"(?s)<!--.*?-->", "")
    lines = F.transform(F.split(body, r"\r\n|[\n\r\x0b\x0c]"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    prose = F.filter(lines, lambda x: ~x.rlike("|".join(f"(?:{p})" for p in SKIP_LINES)))
    paragraphs = F.transform(F.split(F.array_join(prose, "\n"), r"\n{2,}"), lambda x: F.replace(F.regexp_replace(x, r"^\n+|\n+$", ""), F.lit("\n"), F.lit(" ")))

    def clean(p: Column) -> Column:
        for pattern, to in MARKUP:
            p = F.regexp_replace(p, pattern, to)
        return squeezed(p)

    def good(p: Column) -> Column:
        words = F.split(p, " ")
        ascii_ = F.size(F.filter(words, lambda w: w.rlike(r"^[A-Za-z][A-Za-z0-9\-'.,;:!?]*$")))
        return (p != "") & (F.size(words) >= min_words) & (F.length(F.regexp_replace(p, r"[^|]", "")) < 2) & (ascii_ >= F.size(words) * ascii_part)

    return F.coalesce(F.substring(F.get(F.filter(F.transform(paragraphs, clean), good), F.lit(0)), 1, max_chars), F.lit(""))


#: Opening formulas of research code that say nothing of the subject.
PAPER_FORMULAS = (
    r"here\s+is\s+the\s+official\s+code\s+of\s+\S+\s+for\s+paper\s*:?\s*",
    r"this\s+is\s+the\s+repository\s+for\s*:?\s*",
    r"this\s+is\s+the\s+official\s+(pytorch\s+)?(code|implementation|repository)\s+(of|for)\s*:?\s*",
    r"this\s+repo(sitory)?\s+is\s+the\s+official\s+(implementation|code)\s+of\s+.*?paper\s*:?\s*",
    r"this\s+repo(sitory)?\s+(includes?|contains?)\s+(the\s+|our\s+)?(code|implementation)\s*(to\s+reproduce)?\s*(our\s+|the\s+)?paper\s*:?\s*",
    r"this\s+repo(sitory)?\s+contains\s+our\s+implementation\s+of\s+(the\s+)?paper\s*:?\s*",
    r"(this\s+repo(sitory)?\s+)?(code|codes)\s+(for|of)\s+(reproducing\s+)?(the\s+|our\s+)?paper\s*:?\s*",
    r"repo\s+for\s+\S*\s*paper\s*:?\s*",
    r"official\s+(pytorch\s+)?(code|implementation)\s+(of|for)\s*:?\s*",
)


def without_formulas(text: Column) -> Column:
    out = F.regexp_replace(text, r"^\[[^\]]{0,40}\]\s*", "")
    for p in PAPER_FORMULAS:
        out = F.regexp_replace(out, f"(?i){p}", " ")
    return squeezed(out)


def subject_text(description: Column, topics: Column, paragraph: Column, titles: Column, max_titles: int = 20, max_chars: int = 400) -> Column:
    """What is embedded of a repository: the parts that say something, in order."""
    some = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    heads = F.substring(F.array_join(F.slice(F.coalesce(titles, F.array().cast("array<string>")), 1, max_titles), " "), 1, max_chars)
    parts = [without_formulas(description), F.array_join(F.coalesce(topics, F.array().cast("array<string>")), " "), without_formulas(paragraph), heads]
    return F.trim(F.concat_ws(" ", *[some(p) for p in parts]))


def heuristic_label(terms: Column) -> Column:
    """The first three terms capitalised, or 'Miscellaneous'."""
    cap = lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substr(t, F.lit(2))))
    t = F.coalesce(terms, F.array().cast("array<string>"))
    return F.when(F.size(t) == 0, "Miscellaneous").otherwise(F.array_join(F.transform(F.slice(t, 1, 3), cap), " "))


def sanitized_label(raw: Column, most: int = 48) -> Column:
    """The first line without quotes; null if nothing is left or it is too long."""
    line = F.regexp_replace(F.get(F.split(F.regexp_replace(raw, r"^\s+|\s+$", ""), r"\r\n|\n|\r"), F.lit(0)), r"^[\"'`. ]+|[\"'`. ]+$", "")
    return F.when((line != "") & (F.length(line) <= most), line)


def cosine(a: Column, b: Column) -> Column:
    """Dot product over norms; a zero norm counts as 1."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.coalesce(F.nullif(F.sqrt(dot(x, x)), F.lit(0.0)), F.lit(1.0))
    return dot(a, b) / (norm(a) * norm(b))
