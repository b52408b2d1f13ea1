"""How a copy's pages and entries are organised: purposes of pages, folding of entries, contents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvid.functions import text as T
from corvid.functions import titles
from corvid.operators import graph
from corvid.operators.index import PAGE_KINDS


def unread(pages: DataFrame, api_pages: DataFrame, names: list[str]) -> DataFrame:
    """page of the pages (page, title) that are about the project itself, and of all in a folder whose
    index page is release notes; pages that document API objects (page) are read all the same."""
    own = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    plain = titles.plain_title(F.col("title"), own)
    folders = pages.where(F.endswith("page", F.lit("/index.html")) & plain.rlike(f"^(?:{titles.RELEASES})$")).select(F.regexp_replace("page", "[^/]*$", "").alias("folder"))
    ups = F.transform(F.sequence(F.lit(1), F.size(F.split("page", "/")) - 1), lambda i: F.concat(F.array_join(F.slice(F.split("page", "/"), F.lit(1), i), "/"), F.lit("/")))
    inside = pages.where(F.contains("page", F.lit("/"))).select("page", F.explode(ups).alias("folder")).join(folders, "folder", "left_semi").select("page")
    about = pages.where(titles.label_of(F.col("title"), own, F.endswith("page", F.lit("index.html"))) == "removed").select("page")
    return inside.unionByName(about).distinct().join(api_pages.select("page"), "page", "left_anti")


def purposes(pages: DataFrame, parents: DataFrame, names: list[str]) -> DataFrame:
    """page, purpose of pages (page, title, starts): what the own title says, else that of the nearest
    page above (parents: page, parent), else the folder's, else lookup; below what is removed, all is."""
    own = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    labelled = pages.select(F.col("page").alias("id"), titles.label_of(F.col("title"), own, F.col("starts")).alias("label"))
    up = parents.select(F.col("page").alias("id"), "parent")
    near = graph.nearest_label(labelled, up).select(F.col("id").alias("page"), "label")
    gone = labelled.where("label = 'removed'").select("id")
    below = graph.reachable(gone, up.select(F.col("parent").alias("src"), F.col("id").alias("dst"))).select(F.col("id").alias("page"), F.lit("removed").alias("gone"))
    j = pages.select("page").join(near, "page", "left").join(below, "page", "left")
    return j.select("page", F.coalesce("gone", "label", titles.folder_label(F.col("page")), F.lit("lookup")).alias("purpose"))


def folded(entries: DataFrame) -> DataFrame:
    """id, why of the entries (id, page, kind, title, text) that another one holds: sections that only
    part their page and whose text another entry of the page has, labels that repeat a page's title,
    equal titles and texts but the first of a page, and pages named as an API object is."""
    prose = F.col("kind").isin(*PAGE_KINDS)
    bare = F.regexp_replace("title", r" \((page|section)\)$", "")
    body = titles.section_body(F.col("text"))
    part = F.col("kind").isin("section", "label") & F.contains("title", F.lit(" › ")) & (titles.links_only(F.col("text")) | F.lower(F.element_at(F.split("title", " › "), -1)).isin(*PARTS_OF_PAGES))
    e = entries.select("id", "page", "kind", "title", "text", bare.alias("bare"), body.alias("body"), part.alias("part"), prose.alias("prose"))
    other = e.where("not part").select("page", F.col("id").alias("in"), F.col("text").alias("whole"))
    held = e.where("part").join(other, "page").where(F.contains("whole", F.col("body")) & (F.col("id") != F.col("in"))).select("id").distinct()
    empty = e.where("part and body = ''").select("id")
    first = Window.partitionBy("page", "title", "text").orderBy("id")
    twins = e.where("prose and kind != 'example'").withColumn("n", F.row_number().over(first)).where("n > 1").select("id")
    titled = e.where("kind in ('page', 'doc') and not part").select("page", F.col("bare").alias("of")).distinct()
    labels = e.where("kind = 'label'").join(titled, "page").where("bare = of").select("id")
    api = e.where("not prose").select(F.lower(T.api_name(F.col("title"))).alias("name")).distinct()
    objects = e.where("kind = 'doc'").withColumn("name", F.lower("bare")).join(api, "name", "left_semi").select("id")
    reasons = {"part": held.unionByName(empty), "label": labels, "twin": twins, "object": objects}
    every = [x.select("id", F.lit(i).alias("n"), F.lit(why).alias("why")) for i, (why, x) in enumerate(reasons.items())]
    out = every[0]
    for x in every[1:]:
        out = out.unionByName(x)
    return out.groupBy("id").agg(F.min_by("why", "n").alias("why"))


#: Headings of sections that only part their page (fixed values).
PARTS_OF_PAGES = (
    "parameters", "return value", "return values", "returns", "exceptions", "complexity", "notes", "note", "defect reports", "see also", "references", "external links", "template parameters", "member types", "member functions",
    "non-member functions", "data members", "member constants", "member objects", "nested types", "nested classes", "helper classes", "helper types", "helper variable template", "helper variable templates", "helper templates", "helper concepts",
    "deduction guides", "specializations", "protected member functions", "public member functions", "member variables", "types", "constants", "functions", "classes", "macros", "macro constants", "objects", "keywords", "includes", "type requirements",
    "requirements", "error handling", "next steps", "what's next", "related", "related pages", "related content", "learn more", "further reading", "additional resources", "resources", "signature", "description", "properties", "extends", "constructors",
)


def contents(entries: DataFrame, most: int = 80) -> DataFrame:
    """purpose, part, entries, kids, more: the parts of each purpose with their first titles, in order, and
    how many are left out. entries: id, purpose, part, title, place."""
    w = Window.partitionBy("purpose", "part").orderBy("place", "id")
    one = entries.groupBy("purpose", "part", "title").agg(F.min("place").alias("place"), F.min("id").alias("id"), F.count("*").alias("n"))
    numbered = one.withColumn("i", F.row_number().over(w))
    kids = F.array_sort(F.collect_list(F.when(F.col("i") <= most, F.struct("i", "title"))))
    return numbered.groupBy("purpose", "part").agg(F.sum("n").alias("entries"), kids["title"].alias("kids"), F.greatest(F.count("*") - most, F.lit(0)).alias("more")).where(~F.lower("part").isin("index", "") & ~F.col("part").rlike(r"^[^ ]*(/|\.html$|\.md$)"))


def counts(entries: DataFrame, by: list[str]) -> DataFrame:
    """Entries of each purpose, as columns, by copy, page or nothing."""
    return entries.groupBy(*by).pivot("purpose", ["learn", "do", "lookup", "understand"]).count().na.fill(0)


def in_standard(entries: DataFrame) -> DataFrame:
    """The entries (id, page, ord, is_page, inside) of one standard: those inside it, and not on a page,
    from its entry on, that isn't."""
    out = entries.where("is_page and not inside").select("page", F.col("ord").alias("from"))
    left = entries.where("inside").join(out.groupBy("page").agg(F.min("from").alias("from")), "page", "left")
    return left.where("`from` is null or ord < `from`").drop("from")


def kept_vectors(old: DataFrame, new: DataFrame) -> DataFrame:
    """id, v: entries (id, was) with the vectors (id, v) they had before; null for new ones, to be made."""
    return new.join(old.select(F.col("id").alias("was"), "v"), "was", "left").select("id", "v")
