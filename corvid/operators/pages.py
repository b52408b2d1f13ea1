"""Operators over page addresses, crawl results and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvid.functions import text as T


#: Segments that name a language or a version; sections of other languages than a
#: package's; addresses that are no page; copies for printing.
LANGUAGE = r"(?i)^(ar|bg|bn|ca|cs|da|de|el|es|et|fa|fi|fr|he|hi|hr|hu|id|it|ja|ko|lt|lv|ms|nb|nl|no|pl|pt|ro|ru|sk|sl|sr|sv|th|tr|uk|vi|zh)([-_][a-z0-9]{2,4}){0,2}$"
VERSION_SEGMENT = r"^v?\d+(\.\d+)+$"
OTHER_LANGUAGES = ["javascript", "typescript", "js", "ts", "node", "nodejs", "node.js", "java", "kotlin", "swift", "go", "golang", "rust", "ruby", "php", "csharp", "c#", ".net", "dotnet", "scala"]
NOT_A_PAGE = r"(?i)\.(json|ya?ml|xml|png|jpe?g|gif|svg|webp|pdf|zip|gz|ipynb|py|csv)(\?|$)"
ALL_IN_ONE = "/_print/"


def variants(urls: DataFrame) -> DataFrame:
    """place, values: where in an address, languages take each other's place (two or more of them)."""
    segments = urls.select(F.posexplode(F.split(T.normal_url(F.col("url")), "/")).alias("i", "s"), F.split(T.normal_url(F.col("url")), "/").alias("all"))
    lang = segments.where((F.col("i") > 0) & F.col("s").rlike("^[a-z]{2}(-[a-z]{2})?$"))
    place = F.array_join(F.slice("all", F.lit(1), F.col("i")), "/")
    return lang.select(place.alias("place"), "s").groupBy("place").agg(F.countDistinct("s").alias("values")).where("values >= 2")


def copies_of_pages(urls: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """url of the addresses that are another language's or version's copy of a page: with another such
    segment in the same place of the same address; segments in keep make none."""
    parts = urls.select("url", F.split(F.regexp_extract("url", r"^[^:]*://([^?#]*)", 1), "/").alias("p")).distinct()
    each = parts.select("url", "p", F.posexplode("p").alias("i", "s")).where("i > 0").withColumn("s", F.lower("s"))
    named = each.where((F.col("s").rlike(LANGUAGE) | F.col("s").rlike(VERSION_SEGMENT)) & ~F.col("s").isin(*(keep or [""])))
    place = [F.array_join(F.slice("p", F.lit(1), F.col("i")), "/").alias("before"), F.array_join(F.slice("p", F.col("i") + 2, F.size("p")), "/").alias("after")]
    placed = named.select("url", "s", *place)
    shared = placed.groupBy("before", "after").agg(F.countDistinct("s").alias("n")).where("n > 1").select("before", "after")
    return placed.join(shared, ["before", "after"], "left_semi").select("url").distinct()


def is_page(url: Column) -> Column:
    """Whether an address can be a page: no file of data, no copy for printing."""
    return ~url.rlike(NOT_A_PAGE) & ~F.contains(url, F.lit(ALL_IN_ONE))


def other_language(page: Column, root: Column, crumbs: Column) -> Column:
    """Whether a page lies in a section of another programming language, by its crumbs or folders."""
    rest = F.substr(page, F.char_length(root) + 1, F.char_length(page))
    folders = F.slice(F.split(rest, "/"), F.lit(1), F.size(F.split(rest, "/")) - 1)
    names = F.transform(F.concat(F.coalesce(crumbs, F.array().cast("array<string>")), folders), lambda x: F.lower(x))
    return F.arrays_overlap(names, F.array(*map(F.lit, OTHER_LANGUAGES)))


def sections(pages: DataFrame, depth: int = 0) -> DataFrame:
    """section, n: a site's own sections (pages: page, crumbs) at the first level from depth on where
    three or more are big (a fiftieth of the pages, two at least), else at the fourth; where under half
    the pages have crumbs, the first folders under the root (pages: also rest)."""
    n = pages.count()
    outlined = pages.where(F.size(F.coalesce("crumbs", F.array().cast("array<string>"))) > 0)
    if 2 * outlined.count() >= n:
        for level in range(depth or 1, 5):
            key = F.array_join(F.slice("crumbs", 1, level), " / ").alias("section")
            big = outlined.where(F.size("crumbs") >= level).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= max(2, n // 50))
            if level == 4 or big.limit(3).count() == 3:
                return big
    folder = F.regexp_extract("rest", "^/*([^/]+)/", 1)
    return pages.select(folder.alias("f")).where("f != ''").groupBy(F.concat("f", F.lit("/")).alias("section")).agg(F.count("*").alias("n"))


def expected_pages(lists: DataFrame) -> DataFrame:
    """site, expected: the most pages that a complete list of a site names (lists: site, list, page, whole)."""
    return lists.where("whole").groupBy("site", "list").agg(F.countDistinct("page").alias("n")).groupBy("site").agg(F.max("n").alias("expected"))


def longest_site(urls: DataFrame, sites: DataFrame) -> DataFrame:
    """page_id, site: the longest site (prefix of whole segments) that an address lies under, by
    equality with its prefixes, not by comparing all pairs."""
    parts = F.split(T.normal_url(F.col("url")), "/")
    prefixes = urls.select("page_id", parts.alias("p")).select("page_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.array_join(F.slice("p", 1, i), "/"))).alias("site"))
    return prefixes.join(sites, "site").groupBy("page_id").agg(F.max_by("site", F.char_length("site")).alias("site"))


def failures(log: DataFrame) -> DataFrame:
    """kind, n, first of a log (kind, at, what)."""
    return log.groupBy("kind").agg(F.count("*").alias("n"), F.min_by("what", F.struct("at", "what")).alias("first"))


def missed(failures: DataFrame) -> DataFrame:
    """sid, failed: pages that another try may get, of failures (sid, kind, n)."""
    gone = F.substring_index("kind", ":", 1).isin("not-found", "gone", "robots", "empty")
    return failures.groupBy("sid").agg(F.coalesce(F.sum(F.when(~gone, F.col("n"))), F.lit(0)).alias("failed"))


def coverage(copies: DataFrame) -> DataFrame:
    """Adds replace: whether a new copy (pages, failed, listed, read, entries, old) may replace the old
    one: at most a twentieth of its pages failed; nine in ten of the pages that lists name are read, if
    they name 20 or more; else seven in ten of the old entries are there, if there are any."""
    failed = F.col("failed") > 0.05 * (F.col("failed") + F.col("pages"))
    enough = F.when(F.col("listed") >= 20, F.col("read") >= 0.9 * F.col("listed")).otherwise(F.coalesce(F.col("entries") >= 0.7 * F.col("old"), F.lit(True)))
    return copies.withColumn("replace", ~failed & enough)


def shortfall(copies: DataFrame) -> DataFrame:
    """Adds short: in words, how far a copy fell short of what lists name; empty if it didn't."""
    far = (F.col("listed") >= 20) & (F.col("read") < 0.9 * F.col("listed"))
    said = F.format_string("read %,d of the %,d pages the site's own lists name", "read", "listed")
    return copies.withColumn("short", F.when(far, said).otherwise(""))


def nearest_version(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """package, want, have: the copy of the same version or a dotted prefix either way, the longest
    label first; never one that is no release yet. wanted: package, version; have: package, version
    (a copy's label)."""
    label = F.col("version")
    h = have.where(T.channel_of(F.concat(F.lit("x@"), label)).isNull() & (label != "")).select("package", label.alias("have"))
    w = wanted.select("package", label.alias("want"), T.label_text(label).alias("v"))
    fits = (F.col("v") == F.col("have")) | F.startswith(F.col("v"), F.concat("have", F.lit("."))) | F.startswith(F.col("have"), F.concat("v", F.lit(".")))
    return w.join(h, "package").where(fits).groupBy("package", "want").agg(F.max_by("have", F.struct(F.char_length("have"), F.col("have"))).alias("have"))


def newest_first(copies: DataFrame) -> DataFrame:
    """sid, package, place: the copies of each package, releases before others, by their numbers."""
    package = F.substring_index("sid", "@", 1).alias("package")
    w = Window.partitionBy("package").orderBy(F.desc("key"), "sid")
    return copies.select("sid", package, T.version_key(F.col("sid")).alias("key")).select("sid", "package", F.row_number().over(w).alias("place"))
