"""URL filters with a path-template tree (operator 10); DataFrame functions only.

Rules decide the URLs they fit. For the others, the paths of each host form a tree: numbers and
hexadecimal names become wildcards, which keep a segment's ending. Sibling branches are merged into
a wildcard branch, with all that is below them, where they are alike: most of their pages have the
same template beneath, all spread over the templates beneath as those of the others do, and their
labelled shares of blocked URLs differ no more than chance. URLs that a rule decided, or a table of labels, are the labelled ones. A template
is rejected if, once merged, it holds labelled URLs and its purity, smoothed from the root down,
says so. Paths of any depth are read whole.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.llm.text import bounded_broadcast
from corvid.session import scratch, shared_table


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


#: Rules of the registered query (fixed values): verdict, host, start of the path.
RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]
#: Labelled URLs that the purity one level up weighs as much as.
WEIGHT = 4.0
#: Least purity of a rejected template.
REJECT = 0.8
#: Standard deviations up to which siblings count as alike.
ALIKE = 2.0
#: Rejected templates, and branches that are merged, up to which they are broadcast (about 100 bytes each).
BROADCAST_ROWS = 100_000


def host_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty for null and without "://"."""
    parts = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, parts, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, parts, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule (host and path) that fits, as struct(rule, verdict), else null; rules are a bounded configuration."""
    ordered = sorted(rules, key=lambda r: (-len(r.host + r.path), r))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in reversed(ordered):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def template(path: Column) -> Column:
    """The segments, with hexadecimal names and numbers in them as wildcards."""
    hexed = F.regexp_replace(path, "[0-9a-fA-F]{8,}", "*")
    return F.array_remove(F.split(F.regexp_replace(hexed, "[0-9]+", "*"), "/"), "")


def branches(leaves: DataFrame) -> DataFrame:
    """host, t, i, parent, segment, rest, pages, n, b: each leaf under the branch it takes at level i."""
    placed = leaves.select("host", "t", "pages", "n", "b", F.posexplode("t").alias("i", "segment"))
    parent, rest = F.slice("t", F.lit(1), F.col("i")), F.slice("t", F.col("i") + 2, F.size("t"))
    return placed.select("host", "t", "i", F.array_join(parent, "/").alias("parent"), "segment", F.array_join(rest, "/").alias("rest"), "pages", "n", "b")


def alike(leaves: DataFrame) -> DataFrame:
    """host, parent, segment, wild of the branches that are merged with siblings, and as what."""
    counts, level = ("pages", "n", "b"), ["host", "i", "parent"]
    per = branches(leaves).groupBy(*level, "segment", "rest").agg(*[F.sum(c).alias(c) for c in counts])
    branch = per.groupBy(*level, "segment").agg(*[F.sum(c).alias(c) for c in counts], F.max(F.struct("pages", "rest"))["rest"].alias("shape"))
    per = per.select(*level, "segment", "rest", F.col("pages").alias("part")).join(branch.select(*level, "segment", "shape"), [*level, "segment"])
    pool = per.groupBy(*level, "shape", "rest").agg(F.sum("part").alias("like"))
    totals = pool.groupBy(*level, "shape").agg(F.sum("like").alias("all_pages"), (F.count("*") - 1).cast("double").alias("free"))
    # chi squared of the branch's spread over what is beneath, against the spread of all of its shape
    squares = per.join(pool, [*level, "shape", "rest"]).groupBy(*level, "segment").agg(F.sum(F.col("part") * F.col("part") / F.col("like")).alias("squares"))
    chi = F.col("squares") * F.col("all_pages") / F.col("pages") - F.col("pages")
    spread = branch.join(squares, [*level, "segment"]).join(totals, [*level, "shape"]).where(chi <= F.col("free") + ALIKE * F.sqrt(2 * F.col("free")) + 1e-6)
    labelled = spread.groupBy(*level, "shape").agg((F.sum("b") / F.greatest(F.sum("n"), F.lit(1))).alias("share"))
    own = F.col("b") / F.greatest("n", F.lit(1))
    off = (own - F.col("share")) * (own - F.col("share")) * F.col("n")
    found = spread.join(labelled, [*level, "shape"]).where((F.col("n") == 0) | (off <= ALIKE * ALIKE * F.col("share") * (1 - F.col("share")) + 1e-9)).select(*level, "segment", "shape")
    several = found.groupBy(*level, "shape").agg(F.count("*").alias("siblings")).where("siblings > 1").select(*level, "shape")
    return found.join(several, [*level, "shape"]).select("host", "parent", "segment", F.concat(F.lit("*{"), F.col("shape"), F.lit("}")).alias("wild"))


def generalised(leaves: DataFrame, merged: DataFrame) -> DataFrame:
    """host, t, g, n, b: each leaf with its template in the merged tree."""
    each = branches(leaves).select("host", "t", "i", "parent", "segment")
    each = each.join(bounded_broadcast(merged, BROADCAST_ROWS), ["host", "parent", "segment"], "left").withColumn("segment", F.coalesce("wild", "segment"))
    whole = each.groupBy("host", "t").agg(F.array_sort(F.collect_list(F.struct("i", "segment"))).alias("s"))
    g = F.coalesce(F.col("s.segment"), F.array().cast("array<string>"))
    return leaves.join(whole, ["host", "t"], "left").select("host", "t", g.alias("g"), "n", "b")


def template_purity(pages: DataFrame) -> DataFrame:
    """host, t (a path's template), n (labelled URLs at or below its merged template), purity; pages:
    host, path, label (1 blocked, 0 allowed, null unlabelled)."""
    leaves = pages.groupBy("host", template(F.col("path")).alias("t")).agg(F.count("*").alias("pages"), F.count("label").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("b"))
    leaves = shared_table(leaves, "templates")
    tree = shared_table(generalised(leaves, shared_table(alike(leaves), "templates-alike")), "templates-merged")
    level = F.explode(F.sequence(F.lit(0), F.size("g")))
    node = lambda g: F.array_join(F.slice(g, F.lit(1), F.col("depth")), "/").alias("node")
    nodes = tree.select("host", "g", "n", "b", level.alias("depth")).groupBy("host", "depth", node("g")).agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    nodes = shared_table(nodes, "template-nodes")
    overall = nodes.where("depth = 0").agg((F.coalesce(F.sum("b"), F.lit(0)) / F.greatest(F.coalesce(F.sum("n"), F.lit(1)), F.lit(1))).alias("prior"))
    merged = tree.select("host", "g").distinct()
    path = merged.select("host", "g", level.alias("depth")).select("host", "g", "depth", node("g")).join(nodes, ["host", "depth", "node"])
    path = path.groupBy("host", "g").agg(F.array_sort(F.collect_list(F.struct("depth", "n", "b"))).alias("levels"))
    smooth = F.aggregate("levels", F.col("prior"), lambda p, x: (x["b"] + WEIGHT * p) / (x["n"] + WEIGHT))
    judged = path.crossJoin(F.broadcast(overall)).select("host", "g", F.element_at("levels", -1)["n"].alias("n"), smooth.alias("purity"))
    return tree.select("host", "t", "g").join(judged, ["host", "g"]).select("host", "t", "n", "purity")


def judge(pages: DataFrame, rules: list[Rule] | None = None, labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages (page_id, url).

    verdict is that of the longest fitting rule, else block for templates with labelled URLs and a
    smoothed purity of REJECT or more, else allow. labels (page_id, label: 1 bad, 0 good) adds labelled
    pages to those that rules decide; of several labels for a page the largest holds. A null url, or one without "://", has an empty
    host and path, fits no rule and is left to the method. Null or repeated page_ids and repeated rows keep a
    row each (repeated rows weigh as often as they occur); other columns are dropped, whatever
    their names; an empty table gives an empty one. A host with a third of all rows is counted
    where it is read; only its templates are shuffled.
    """
    host, path = host_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    parsed = parsed.withColumn("found", longest_rule(F.col("host"), F.col("path"), rules if rules is not None else RULES))
    label = F.when(F.col("found.verdict") == "block", 1).when(F.col("found.verdict") == "allow", 0)
    labelled = parsed.select("page_id", "host", "path", label.alias("label"))
    if labels is not None:
        known = labels.groupBy("page_id").agg(F.max("label").alias("known"))
        labelled = labelled.join(known, "page_id", "left").select("host", "path", F.coalesce("label", F.col("known").cast("int")).alias("label"))
    with scratch(pages.sparkSession) as keep:
        purity = template_purity(labelled)
        rejected = purity.where((F.col("n") > 0) & (F.col("purity") >= REJECT)).select("host", F.array_join("t", "/").alias("t"), F.lit("block").alias("no"))
        rejected = keep(shared_table(rejected, "templates-rejected"))
    # only pages that no rule decided are joined, so a hot host's decided pages stay where they are
    decided = parsed.where("found is not null").select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("verdict"))
    open_pages = parsed.where("found is null").select("page_id", "host", "path", F.array_join(template(F.col("path")), "/").alias("t"))
    joined = open_pages.join(bounded_broadcast(rejected, BROADCAST_ROWS), ["host", "t"], "left")
    return decided.unionByName(joined.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.coalesce("no", F.lit("allow")).alias("verdict")))


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
rules(verdict, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
x AS (SELECT page_id, host, path, (SELECT max_by({'rule': rh || rp, 'verdict': verdict}, length(rh || rp)) FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS f,
  list_filter(string_split(regexp_replace(regexp_replace(path, '[0-9a-fA-F]{8,}', '*', 'g'), '[0-9]+', '*', 'g'), '/'), lambda s: s <> '') AS t FROM p),
leaves AS (SELECT host, t, count(*) AS pages, count(f.verdict) AS n, count(*) FILTER (f.verdict = 'block') AS b FROM x GROUP BY host, t),
e AS (SELECT host, t, pages, n, b, unnest(generate_series(1, len(t))) AS i FROM leaves),
br AS (SELECT host, t, i, array_to_string(t[1:i-1], '/') AS parent, t[i] AS segment, array_to_string(t[i+1:], '/') AS rest, pages, n, b FROM e),
per AS (SELECT host, i, parent, segment, rest, sum(pages) AS pages, sum(n) AS n, sum(b) AS b FROM br GROUP BY ALL),
branch AS (SELECT host, i, parent, segment, sum(pages) AS own, sum(n) AS n, sum(b) AS b, max({'p': pages, 'r': rest}).r AS shape FROM per GROUP BY ALL),
shaped AS (SELECT host, i, parent, segment, shape, rest, per.pages FROM per JOIN branch USING (host, i, parent, segment)),
pool AS (SELECT host, i, parent, shape, rest, sum(pages) AS alike FROM shaped GROUP BY ALL),
totals AS (SELECT host, i, parent, shape, sum(alike) AS all_pages, CAST(count(*) - 1 AS DOUBLE) AS free FROM pool GROUP BY ALL),
squares AS (SELECT host, i, parent, segment, sum(pages * pages / alike) AS squares FROM shaped JOIN pool USING (host, i, parent, shape, rest) GROUP BY ALL),
spread AS (SELECT * FROM branch JOIN squares USING (host, i, parent, segment) JOIN totals USING (host, i, parent, shape) WHERE squares * all_pages / own - own <= free + 2 * sqrt(2 * free) + 1e-6),
labelled AS (SELECT host, i, parent, shape, sum(b) / greatest(sum(n), 1) AS share FROM spread GROUP BY ALL),
found AS (SELECT host, i, parent, segment, shape FROM spread JOIN labelled USING (host, i, parent, shape) WHERE n = 0 OR (b / n - share) ** 2 * n <= 4 * share * (1 - share) + 1e-9),
merged AS (SELECT * FROM found WHERE (host, i, parent, shape) IN (SELECT (host, i, parent, shape) FROM found GROUP BY host, i, parent, shape HAVING count(*) > 1)),
whole AS (SELECT host, t, list(CASE WHEN merged.host IS NULL THEN br.segment ELSE '*{' || merged.shape || '}' END ORDER BY br.i) AS g FROM br LEFT JOIN merged USING (host, i, parent, segment) GROUP BY host, t),
tree AS (SELECT host, t, coalesce(g, []) AS g, n, b FROM leaves LEFT JOIN whole USING (host, t)),
lv AS (SELECT host, g, n, b, unnest(generate_series(0, len(g))) AS depth FROM tree),
nodes AS (SELECT host, depth, g[1:depth] AS node, sum(n) AS n, sum(b) AS b FROM lv GROUP BY ALL),
overall AS (SELECT coalesce(sum(b), 0) / greatest(coalesce(sum(n), 1), 1) AS prior FROM leaves),
gs AS (SELECT host, g, unnest(generate_series(0, len(g))) AS depth FROM (SELECT DISTINCT host, g FROM tree)),
lists AS (SELECT gs.host, gs.g, list({'n': CAST(n AS DOUBLE), 'b': CAST(b AS DOUBLE)} ORDER BY gs.depth) AS levels FROM gs JOIN nodes ON nodes.host = gs.host AND nodes.depth = gs.depth AND nodes.node = gs.g[1:gs.depth] GROUP BY gs.host, gs.g),
judged AS (SELECT host, g, levels[len(levels)].n AS n, list_reduce(list_prepend({'n': CAST(0 AS DOUBLE), 'b': CAST(prior AS DOUBLE)}, levels), lambda a, y: {'n': CAST(0 AS DOUBLE), 'b': (y.b + 4 * a.b) / (y.n + 4)}).b AS purity FROM lists, overall)
SELECT page_id, x.host, path, f.rule AS rule, coalesce(f.verdict, CASE WHEN j.n > 0 AND purity >= 0.8 THEN 'block' ELSE 'allow' END) AS verdict FROM x JOIN tree ON tree.host = x.host AND tree.t = x.t JOIN judged j ON j.host = tree.host AND j.g = tree.g
"""
