"""Versions and standards: what a text says of them, and how they compare, as column expressions."""

from __future__ import annotations

import pandas as pd
import re
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Names of standards; marks of declarations, of rows of tables, and of entries.
STANDARD = r"^(C\+\+|C)(\d\d)$"
DECLARATION_MARK = r"\((since|until|deprecated in|removed in) (C\+\+\d\d|C\d\d)\)"
ROW_MARK = r"\((since |until |removed in )?(C\+\+\d\d|C\d\d)\)"
ENTRY_MARK = r"\b(Added in|New in|Deprecated since|Removed in) version (\d+(?:\.\d+)*)(:[^\n]{0,80}|\.?)"
A_PART = r"(?i)^:\s*(the\s+)?[*`]|parameter|argument|option|keyword|attribute"
RELEASE_REF = r"^[A-Za-z_.-]*?v?(\d+(?:\.\d+)+[\w.+-]*)$"
#: Characters of a page in which its own marks stand (fixed value).
PAGE_HEAD = 400


def release_of(ref: Column) -> Column:
    """The release that a source reference names; empty for a branch or a commit."""
    return F.when(ref.rlike("^[0-9a-f]{7,40}$"), "").otherwise(F.coalesce(F.regexp_extract(ref, RELEASE_REF, 1), F.lit("")))


def standard_year(name: Column) -> Column:
    """The year of a standard of C or C++; null for other names."""
    two = F.nullif(F.regexp_extract(name, STANDARD, 2), F.lit("")).cast("int")
    return two + F.when(two >= 80, 1900).otherwise(2000)


def number(version: Column) -> Column:
    """A version's leading numbers; an empty array if it has none."""
    return F.transform(F.filter(F.split(F.coalesce(F.regexp_extract(version, r"^v?(\d+(?:\.\d+)*)", 1), F.lit("")), r"\."), lambda x: x != ""), lambda x: x.cast("long"))


def newer(mark: Column, than: Column) -> Column:
    """Whether a version or standard is newer than another, on the parts both have; false if they can't be compared."""
    a, b = standard_year(mark), standard_year(than)
    language = lambda x: F.regexp_extract(x, STANDARD, 1)
    x, y = number(mark), number(than)
    n = F.least(F.size(x), F.size(y))
    numbers = (n > 0) & (F.slice(x, F.lit(1), n) > F.slice(y, F.lit(1), n))
    return F.when(a.isNotNull() & b.isNotNull(), (language(mark) == language(than)) & (a > b)).when(a.isNotNull() | b.isNotNull(), False).otherwise(F.coalesce(numbers, F.lit(False)))


def _all_marks(text: Column, pattern: str) -> Column:
    """kind, name and what follows, of every mark of a text."""
    groups = [F.regexp_extract_all(text, F.lit(pattern), i) for i in (1, 2)]
    return F.arrays_zip(groups[0].alias("kind"), groups[1].alias("name"))


def entry_marks(text: Column, page: Column | None = None) -> Column:
    """since, deprecated and removed (or null) as an entry's text says of the entry itself: the first
    of each that is about no part of it. page: whether only the head of the text counts."""
    head = text if page is None else F.when(page, F.substring(text, 1, PAGE_HEAD)).otherwise(text)
    groups = [F.regexp_extract_all(head, F.lit(ENTRY_MARK), i) for i in (1, 2, 3)]
    marks = F.arrays_zip(groups[0].alias("kind"), groups[1].alias("name"), groups[2].alias("after"))
    added = lambda m: m["kind"].isin("Added in", "New in")
    own = F.filter(marks, lambda m: F.when(added(m), ~F.startswith(m["after"], F.lit(":"))).otherwise(~m["after"].rlike(A_PART)))
    first = lambda keep: F.get(F.filter(own, keep), F.lit(0))["name"]
    return F.struct(first(added).alias("since"), first(lambda m: m["kind"] == "Removed in").alias("removed"), first(lambda m: m["kind"] == "Deprecated since").alias("deprecated"))


def declaration_marks(text: Column, language: str) -> Column:
    """The same of an entry that begins with a table of declarations of one language: since the
    earliest standard if all rows name one, removed at the latest if all are, deprecated if all are."""
    lines = F.split(text, "\n")
    bar = F.transform(lines, lambda x: x.rlike(r"^\s*\|"))
    declared = F.zip_with(lines, bar, lambda x, b: b & F.contains(x, F.lit("```")))
    first = F.array_position(declared, True)
    after = F.slice(bar, F.greatest(first, F.lit(1)).cast("int"), F.size(bar))
    size = F.when(F.array_position(after, False) > 0, F.array_position(after, False) - 1).otherwise(F.size(after))
    table = F.when(first > 0, F.slice(lines, first.cast("int"), size.cast("int"))).otherwise(F.array().cast("array<string>"))
    rows = F.transform(F.filter(table, lambda x: F.contains(x, F.lit("```"))), lambda x: F.substring_index(x, "```", -1))
    named = F.lit("^" + re.escape(language) + r"\d\d$")
    marks = F.transform(rows, lambda x: F.filter(_all_marks(x, DECLARATION_MARK), lambda m: F.regexp_like(m["name"], named)))
    years = lambda m, *kinds: F.transform(F.filter(m, lambda x: x["kind"].isin(*kinds)), lambda x: F.struct(standard_year(x["name"]).alias("y"), x["name"].alias("name")))
    since = F.transform(marks, lambda m: F.array_min(years(m, "since")))
    ends = F.transform(marks, lambda m: F.array_max(years(m, "until", "removed in")))
    gone = F.flatten(F.transform(marks, lambda m: years(m, "deprecated in")))
    every = lambda a: (F.size(a) > 0) & F.forall(a, lambda x: x.isNotNull())
    return F.struct(F.when(every(since), F.array_min(since)["name"]).alias("since"), F.when(every(ends), F.array_max(ends)["name"]).alias("removed"), F.when((F.size(gone) > 0) & (F.size(gone) == F.size(rows)), F.array_min(gone)["name"]).alias("deprecated"))


def flags(marks: Column, project: Column) -> Column:
    """What a project of some version should know of an entry: newer, removed, deprecated."""
    known = F.coalesce(standard_year(marks["removed"]).isNotNull(), F.lit(False)) | (F.size(number(marks["removed"])) > 0)
    is_newer = marks["since"].isNotNull() & newer(marks["since"], project)
    removed = marks["removed"].isNotNull() & ~newer(marks["removed"], project) & known
    deprecated = ~removed & marks["deprecated"].isNotNull() & ~newer(marks["deprecated"], project)
    each = F.array(F.when(is_newer, "newer"), F.when(removed, "removed"), F.when(deprecated, "deprecated"))
    return F.when(F.coalesce(project, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.filter(each, lambda x: x.isNotNull()))


def in_standard(marks: Column, year: Column) -> Column:
    """Whether an entry is part of the standard of a year."""
    since, removed = standard_year(marks["since"]), standard_year(marks["removed"])
    return F.coalesce(since <= year, F.lit(True)) & F.coalesce(removed > year, F.lit(True))


def row_in(row: Column, language: str, year: Column) -> Column:
    """Whether a row of a table is part of the standard of a year, by its marks."""
    named = F.lit("^" + re.escape(language) + r"\d\d$")
    marks = F.filter(_all_marks(row, ROW_MARK), lambda m: F.regexp_like(m["name"], named))
    ends = lambda m: m["kind"].isin("until ", "removed in ")
    of = lambda keep: F.transform(F.filter(marks, keep), lambda m: standard_year(m["name"]))
    return F.coalesce(F.array_min(of(lambda m: ~ends(m))) <= year, F.lit(True)) & F.coalesce(F.array_max(of(ends)) > year, F.lit(True))


class _Row:
    """A row of a table cut to one standard."""

    def __init__(self, language: str, year: int):
        self.language, self.year, self.mark = language, year, re.compile(ROW_MARK)

    def holds(self, text: str) -> bool:
        first, last = [], []
        for kind, name in self.mark.findall(text):
            if re.fullmatch(re.escape(self.language) + r"\d\d", name):
                two = int(name[-2:])
                (last if kind in ("until ", "removed in ") else first).append(two + (1900 if two >= 80 else 2000))
        return (not first or min(first) <= self.year) and (not last or max(last) > self.year)

    def cut(self, row: str) -> str | None:
        if "```" in row:
            return row if self.holds(row) else None
        kept: list[str] = []
        for cell in row.split("|"):
            alone = self.mark.search(cell) and not self.mark.sub("", cell).strip()
            if self.holds(cell):
                kept.append(cell)
            elif alone:  # a mark on its own speaks of the last cell that says something
                said = [i for i, x in enumerate(kept) if x.strip()]
                kept = kept[: said[-1] if said else 0] or kept[:1]
        return "|".join(kept) if any(x.strip() for x in kept) else None


def standard_text(text: Column, language: str, year: int) -> Column:
    """A text without the rows and cells of tables that other standards have."""

    @F.pandas_udf(StringType())
    def cut(texts: pd.Series) -> pd.Series:
        row = _Row(language, year)
        lines = lambda t: [row.cut(x) if x.lstrip().startswith("|") else x for x in t.splitlines()]
        return texts.map(lambda t: None if t is None else "\n".join(x for x in lines(t) if x is not None))

    return cut(text)
