"""What the titles of pages say of them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a whole plain title says a page is, in the order they are tried. A page that
#: begins a part of the docs is named by PARTS too.
ORDER = ("removed", "learn", "do", "lookup", "understand")
LABELS = {
    "removed": r"(.* )?release notes?( .*)?|(.* )?(what'?s|what is) new( in( .*)?)?|whatsnew|(.* )?change ?log( .*)?|release history|contributing( .*)?|(.* )?contributor'?s? guide|how to contribute( .*)?|code of conduct|(.* )?licen[cs]e|copyright|history and licen[cs]e|about( this| these)? (documents?|documentation|docs)|dealing with bugs|reporting bugs|search( page)?|download( .*)? documentation|improve( a| this)? documentation( page)?",
    "learn": r"(.* )?tutorials?|getting started( .*)?|quick ?start( guide)?|absolute basics( .*)?|(\d+ )?minutes to( .*)?|first steps( .*)?|(an? )?(intro|introduction) to( .*)?",
    "do": r"(.* )?how-?tos?|(.* )?howtos?|(.* )?cookbook|(.* )?faqs?|(.* )?frequently asked questions|installing( .*)?|installation( .*)?|(.* )?migration guide|setup and usage",
    "lookup": r"glossary|(.* )?index",
    "understand": r"fundamentals|(key |core |basic )?concepts|internals|under[- ]the[- ]hood( .*)?|explanations?|background|overview|architecture|philosophy|what is .*",
}
PARTS = {
    "removed": r"changes|history|news|development|developers?|(.* )?developer'?s? guide|governance( .*)?|roadmap|building( .*)? from source|build(ing)? from source( .*)?",
    "learn": r"(.* )?tutorials?( .*)?|(.* )?quick ?start( guide)?|(.* )?for (absolute )?beginners|(.* )?tour( of .*)?|learn( .*)?",
    "do": r"(.* )?how-?tos?( .*)?|(.* )?howtos?( .*)?|how to .*|(.* )?user'?s? guide( .*)?|(.* )?recipes|install( .*)?|migrating( .*)?|porting( .*)?|(.* )?examples|(.* )?gallery|(.* )?guides?",
    "lookup": r"(.* )?reference( manual| guide)?|(.* )?api( reference| documentations?| docs)?|(.* )?standard library|(.* )?module index|(.* )?appendix|(.* )?appendices",
    "understand": r"(.* )?fundamentals|(.* )?internals|(.* )?concepts|design( .*)?",
}
RELEASES = r"(.* )?release notes?( .*)?|(.* )?(what'?s|what is) new( in( .*)?)?|whatsnew|(.* )?change ?log( .*)?|release history"
#: Folders whose name says what they hold.
FOLDERS = {
    "learn": ["tutorial", "tutorials", "getting_started", "getting-started", "quickstart", "learn"],
    "do": ["howto", "howtos", "how-to", "how_to", "user_guide", "user-guide", "userguide", "user", "guide", "guides", "faq", "using", "installing", "install", "installation", "distributing", "extending", "examples", "cookbook", "usage"],
    "lookup": ["reference", "api", "library", "c-api", "capi", "builtins", "std", "ref", "generated", "cpp", "c"],
    "understand": ["concepts", "explanation", "explanations", "background", "internals"],
    "removed": ["whatsnew", "whats-new", "release", "releases", "changelog", "changes", "dev", "development", "contributing", "contribute", "building", "blog", "release_notes", "release-notes"],
}
#: Fixed value: a line that is a link, with a word on it at most.
LINK_LINE = r"^\s*(?:[-*+]|\d+\.)?\s*\[[^\]]+\]\([^)]+\)\s*(?:[:—–-]?\s*.{0,200})?$"


def plain_title(title: Column, names: Column) -> Column:
    """Lower case, without the kind in brackets, a number in front, punctuation, articles and the project's names (an array)."""
    t = F.replace(F.lower(F.regexp_replace(title, r" \((page|section)\)$", "")), F.lit("’"), F.lit("'"))
    t = F.regexp_replace(F.regexp_replace(F.trim(t), r"^\d+(\.\d+)*\.?\s+", ""), r"(?U)[^\w\s'+./-]", " ")
    words = F.filter(F.split(t, r"\s+"), lambda w: (w != "") & ~F.array_contains(names, w) & ~w.isin("the", "a", "an"))
    return F.array_join(words, " ")


def label_of(title: Column, names: Column, part: Column | bool = True) -> Column:
    """removed, a purpose or null; part: whether the page begins a part of the docs."""
    part = F.lit(part) if isinstance(part, bool) else part

    def first(t: Column) -> Column:
        out = F.when(t == "", None)
        for purpose in ORDER:
            out = out.when(t.rlike(f"^(?:{LABELS[purpose]})$") | (part & t.rlike(f"^(?:{PARTS[purpose]})$")), purpose)
        return out

    # an array of one, so that the plain title is worked out once and not for each pattern
    return F.get(F.transform(F.array(plain_title(title, names)), first), F.lit(0))


def folder_label(path: Column) -> Column:
    """What the first folder of a path that says so holds."""
    folders = F.transform(F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1), lambda x: F.lower(x))
    known = F.create_map(*[F.lit(x) for purpose, names in FOLDERS.items() for name in names for x in (name, purpose)])
    return F.get(F.filter(F.transform(folders, lambda f: F.element_at(known, f)), lambda x: x.isNotNull()), F.lit(0))


def section_body(text: Column) -> Column:
    """A section's text without its heading, up to 300 characters."""
    return F.substring(F.regexp_replace(F.trim(text), r"\A#+ [^\n]*(\n+|\z)", ""), 1, 300)


def links_only(text: Column) -> Column:
    """Whether a section holds only links to other pages: two or more, and four fifths of its lines
    are links, or a short line of words right after one."""
    lines = F.filter(F.split(F.regexp_replace(F.trim(text), r"\A#+ [^\n]*(\n+|\z)", ""), "\n"), lambda x: (F.trim(x) != "") & ~x.rlike(r"^\s*#"))
    zero = F.struct(F.lit(0).alias("links"), F.lit(0).alias("linked"), F.lit(False).alias("after"))

    def step(acc: Column, x: Column) -> Column:
        link = x.rlike(LINK_LINE)
        beside = ~link & acc["after"] & (F.char_length(x) < 200) & ~x.rlike(r"^\s*([-*+]|\d+\.)\s")
        return F.struct((acc["links"] + link.cast("int")).alias("links"), (acc["linked"] + (link | beside).cast("int")).alias("linked"), link.alias("after"))

    return F.aggregate(lines, zero, step, lambda acc: (acc["links"] >= 2) & (acc["linked"] >= 0.8 * F.size(lines)))


def heading_id(title: Column, location: Column) -> Column:
    """Whether a section's anchor is what its heading's words give."""
    head = F.regexp_replace(F.element_at(F.split(title, " › "), -1), r" \((section|page)\)$", "")
    slug = F.regexp_replace(F.regexp_replace(F.lower(head), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(F.contains(location, F.lit("#")), F.regexp_replace(location, "^[^#]*#", "")).otherwise("") == slug
