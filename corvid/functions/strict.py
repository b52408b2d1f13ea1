"""Strict queries: quoted phrases and patterns in a query, and the phrases as patterns."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.functions import text as T

#: "exact words" anywhere, and /pattern/ as a word of its own (fixed value).
STRICT = r'"([^"]+)"|(?:(?<=\s)|^)/((?:\\.|[^/\\])+)/(?=\s|$)'
MOST_PATTERN = 200


class Strict(NamedTuple):
    rest: str
    phrases: list[str]
    patterns: list[str]


def parse(q: str) -> Strict:
    """What is left of a query, its phrases and its patterns."""
    found = re.findall(STRICT, q)
    rest = re.sub(STRICT, " ", q)
    return Strict(" ".join(rest.split()), [p for p, r in found if p.strip() and not r], [r for p, r in found if r])


def parsed(q: Column) -> Column:
    """The same as a struct column."""
    rest = F.trim(F.regexp_replace(F.regexp_replace(q, STRICT, " "), r"\s+", " "))
    of = lambda group: F.filter(F.regexp_extract_all(q, F.lit(STRICT), group), lambda x: F.trim(x) != "")
    return F.struct(rest.alias("rest"), of(1).alias("phrases"), of(2).alias("patterns"))


def phrase_pattern(phrase: str) -> str:
    """A phrase as a Java pattern: its words with any white space between, whole words at its ends,
    in any case unless it holds a capital."""
    words = phrase.split()
    escaped = [re.sub(r"([^\w])", r"\\\1", w, flags=re.ASCII) for w in words]
    start = r"(?<!\w)" if re.match(r"\w", words[0]) else ""
    end = r"(?!\w)" if re.search(r"\w$", words[-1]) else ""
    case = "" if any(c.isupper() for c in phrase) else "(?iu)"
    return f"{case}(?U){start}" + r"\s+".join(escaped) + end


def matching(entries: DataFrame, query: Strict, postings: DataFrame | None = None) -> DataFrame:
    """The entries (id, title, text, is_api) that hold every phrase in title or text and whose name
    matches every pattern. postings (term, id): where all tokens of all phrases have to stand, so
    that the texts of other entries aren't read. A pattern that is none raises ValueError."""
    for p in query.patterns:
        if len(p) > MOST_PATTERN:
            raise ValueError(f"a /pattern/ may be at most {MOST_PATTERN} characters")
        try:
            re.compile(p)
        except re.error as e:
            raise ValueError(f"not a valid /pattern/: {e}") from None
    out = entries
    terms = sorted({t for p in query.phrases for t in re.findall("[a-z0-9]+", p.lower())})
    if postings is not None and terms:
        having = postings.where(F.col("term").isin(terms)).groupBy("id").agg(F.countDistinct("term").alias("n")).where(F.col("n") == len(terms))
        out = out.join(having.select("id"), "id", "left_semi")
    name = F.when(F.col("is_api"), T.api_name(F.col("title"))).otherwise(F.col("title"))
    for p in query.patterns:
        out = out.where(name.rlike(p))
    for p in map(phrase_pattern, query.phrases):
        out = out.where(F.col("title").rlike(p) | F.col("text").rlike(p))
    return out
