"""WARC records and a Merkle fixity audit of their replicas (operator 5).

Records are ordered by id and digest and lie in segments at known offsets. The tree follows the
ids, not the order of arrival: a leaf is a record, one level up stand the leaves whose id and
beginning of the digest are the same, then the id, a block of ids, the segment. A node's digest
covers its children's digests with the ranges of offsets they take up within it, so two replicas
agree where their roots do, and a lost record changes the nodes above it but none beside it. Below
roots that differ, only children of nodes that differ are compared, down to single records.

Records that are the same in every byte are one leaf with a count, and the records of an id that
very many rows share are dealt by the beginning of their digests, so no node gathers a hot id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvid.session import scratch, shared_table

#: Ids of one segment and of one block in it.
SEGMENT, BLOCK = 4096, 64
#: Hexadecimal digits of the digest that deal the records of one id.
DEALT = 4
#: The levels of the tree from the root down: the columns that name a node.
LEVELS = (["segment"], ["segment", "block"], ["segment", "block", "id"], ["segment", "block", "id", "deal"])


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC response record as text; null fields count as empty."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def parse(records: DataFrame) -> DataFrame:
    """url and html of the text column record; both null where it isn't a response record."""
    at = F.instr("record", "\r\n\r\n")
    ok = F.startswith("record", F.lit("WARC/")) & (at > 0)
    length = F.regexp_extract(F.substring_index("record", "\r\n\r\n", 1), r"(?i)\r\nContent-Length: *([0-9]+)", 1)
    body = F.substring("record", at + 4, F.char_length("record") - at - 7)
    whole = F.octet_length(body) == length.try_cast("int")
    return records.withColumns({"url": F.when(ok & whole, F.regexp_extract("record", r"(?i)\r\nWARC-Target-URI: ([^\r\n]*)", 1)), "html": F.when(ok & whole, body)})


def leaves(pages: DataFrame) -> DataFrame:
    """segment, block, id, deal, digest, page_id, length, copies of each distinct record of pages (page_id, url, html).

    Pages without an id take negative ids, dealt by a hash of their bytes.
    """
    text = record(F.col("page_id"), F.col("url"), F.col("html"))
    hashed = pages.select("page_id", text.alias("r")).select("page_id", F.octet_length("r").cast("long").alias("length"), F.sha2("r", 256).alias("digest"))
    one = hashed.groupBy("digest", "page_id", "length").agg(F.count("*").alias("copies"))
    dealt = -1 - F.conv(F.substring("digest", 1, 8), 16, 10).cast("long")
    named = one.withColumn("id", F.coalesce(F.col("page_id").cast("long"), dealt))
    return named.select(F.floor(F.col("id") / SEGMENT).alias("segment"), F.floor(F.col("id") / BLOCK).alias("block"), "id", F.substring("digest", 1, DEALT).alias("deal"), "digest", "page_id", "length", "copies")


def nodes(below: DataFrame, names: list[str], key: str) -> DataFrame:
    """names, length, digest of the nodes one level up; key orders the children of a node."""
    child = F.struct(F.col(key).alias("key"), F.col("length"), F.col("digest"))
    grouped = below.groupBy(*names).agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(child)).alias("c"))
    # each child's digest is hashed with the range it takes up within its parent
    ranges = F.aggregate("c", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")), lambda acc, x: F.struct((acc["at"] + x["length"]).alias("at"), F.array_append(acc["out"], F.concat_ws(":", acc["at"], x["length"], x["digest"])).alias("out")), lambda acc: F.array_join(acc["out"], ","))
    return grouped.select(*names, "length", F.sha2(ranges, 256).alias("digest"))


def tree(of_leaves: DataFrame) -> list[DataFrame]:
    """Levels from the roots down to the leaves, each a shared table."""
    counted = of_leaves.withColumn("length", F.col("length") * F.col("copies")).withColumn("digest", F.concat_ws("*", "digest", "copies"))
    levels, below = [of_leaves], counted
    for names, key in zip(reversed(LEVELS), ("digest", "deal", "id", "block")):
        below = shared_table(nodes(below, names, key), "merkle")
        levels.insert(0, below)
    return levels


def differing(a: list[DataFrame], b: list[DataFrame]) -> DataFrame:
    """The lowest nodes (their names) that differ between two trees. Each step joins only the
    children of nodes that differed one level up."""
    suspects = None
    for x, y, names in zip(a[:-1], b[:-1], LEVELS):
        x, y = x.select(*names, "digest"), y.select(*names, F.col("digest").alias("other"))
        if suspects is not None:
            x, y = (t.join(suspects, names[:-1], "left_semi") for t in (x, y))
        suspects = shared_table(x.join(y, names, "full").where(~F.col("digest").eqNullSafe(F.col("other"))).select(*names), "merkle-suspects")
    return suspects


def audit(a: list[DataFrame], b: list[DataFrame]) -> DataFrame:
    """id, deal, digest, page_id, length, ok, corrupt, missing, extra: the records below nodes that
    differ, with how many copies of each are the same in the replica, have other bytes there, or
    are in one of the two alone. Within an id, a record without its like on one side stands for a
    corrupted one without its like on the other side, in order; what is over is missing or extra."""
    names = LEVELS[-1]
    suspects = differing(a, b).select("id").distinct()  # a corrupted record may be dealt elsewhere
    x = a[-1].join(suspects, "id", "left_semi").select(*names, "digest", "page_id", "length", F.col("copies").alias("here"))
    y = b[-1].join(suspects, "id", "left_semi").select(*names, "digest", F.col("page_id").alias("page_id_b"), F.col("length").alias("length_b"), F.col("copies").alias("there"))
    both = x.join(y, [*names, "digest"], "full").withColumns({"page_id": F.coalesce("page_id", "page_id_b"), "length": F.coalesce("length", "length_b"), "here": F.coalesce("here", F.lit(0)), "there": F.coalesce("there", F.lit(0))})
    both = both.withColumns({"lost": F.greatest(F.col("here") - F.col("there"), F.lit(0)), "new": F.greatest(F.col("there") - F.col("here"), F.lit(0))})
    per_id = both.groupBy("id").agg(F.sum("lost").alias("all_lost"), F.sum("new").alias("all_new"))
    # running counts by id, first over the parts of an id and then within one, so that a hot id is dealt
    part = both.groupBy("id", "deal").agg(F.sum("lost").alias("l"), F.sum("new").alias("n"))
    w = Window.partitionBy("id").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select("id", "deal", F.coalesce(F.sum("l").over(w), F.lit(0)).alias("l0"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n0"))
    v = Window.partitionBy("id", "deal").orderBy("digest").rowsBetween(Window.unboundedPreceding, -1)
    run = both.withColumns({"l1": F.coalesce(F.sum("lost").over(v), F.lit(0)), "n1": F.coalesce(F.sum("new").over(v), F.lit(0))})
    j = run.join(part, ["id", "deal"]).join(per_id, "id")
    within = lambda before, own, most: F.greatest(F.lit(0), F.least(own, most - before))
    corrupt = within(F.col("l0") + F.col("l1"), F.col("lost"), F.col("all_new"))
    matched = within(F.col("n0") + F.col("n1"), F.col("new"), F.col("all_lost"))
    return j.select("id", "deal", "digest", "page_id", "length", F.least("here", "there").alias("ok"), corrupt.alias("corrupt"), (F.col("lost") - corrupt).alias("missing"), (F.col("new") - matched).alias("extra"))


def placed(levels: list[DataFrame]) -> DataFrame:
    """The leaves with start, where their first copy begins in the segment, and seq, its number there."""
    w = lambda up, key: Window.partitionBy(*up).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, up, key: F.coalesce(F.sum(c).over(w(up, key)), F.lit(0))
    out = levels[-1].withColumns({"start": before(F.col("length") * F.col("copies"), LEVELS[3], "digest"), "seq": before("copies", LEVELS[3], "digest")})
    counts = levels[-1].groupBy(*LEVELS[3]).agg(F.sum(F.col("length") * F.col("copies")).alias("l"), F.sum("copies").alias("c"))
    for names in reversed(LEVELS[1:]):
        own = counts.select(*names, before("l", names[:-1], names[-1]).alias("l0"), before("c", names[:-1], names[-1]).alias("c0"))
        out = out.join(own, names).withColumns({"start": F.col("start") + F.col("l0"), "seq": F.col("seq") + F.col("c0")}).drop("l0", "c0")
        counts = counts.groupBy(*names[:-1]).agg(F.sum("l").alias("l"), F.sum("c").alias("c"))
    return out


def fixity(pages: DataFrame, replica: DataFrame) -> DataFrame:
    """page_id, segment, seq, start, length, record_sha256, root_sha256, status for every row of pages,
    and for every record that only the replica has.

    pages and replica: page_id, url, html. status: ok, corrupt (other bytes in the replica), missing
    (the replica lacks a record of this id) or extra (the replica has one too many: seq, start and
    root_sha256 are null). Of equal records, the first are ok, then corrupt, then missing. Null
    fields count as empty, pages without an id have segments of their own; repeated rows are records
    of their own. Records are ordered by id and digest. Other columns are dropped, whatever their
    names; an empty table gives an empty one, apart from what the replica has.
    """
    with scratch(pages.sparkSession) as keep:
        a = tree(shared_table(leaves(pages), "warc-leaves"))
        b = tree(shared_table(leaves(replica), "warc-leaves"))
        found = keep(shared_table(audit(a, b), "warc-audit"))
        roots = a[0].select("segment", F.col("digest").alias("root_sha256"))
        every = keep(shared_table(placed(a).join(roots, "segment").select("page_id", "id", "segment", "seq", "start", "length", "digest", "root_sha256", "copies"), "warc-placed"))
    counts = found.select("id", "digest", "ok", "corrupt")
    each = every.join(counts, ["id", "digest"], "left").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    ok, corrupt = F.coalesce("ok", "copies"), F.coalesce("corrupt", F.lit(0))
    status = F.when(F.col("k") < ok, "ok").when(F.col("k") < ok + corrupt, "corrupt").otherwise("missing")
    digest = F.col("digest").alias("record_sha256")
    out = each.select("page_id", "segment", (F.col("seq") + F.col("k")).alias("seq"), (F.col("start") + F.col("k") * F.col("length")).alias("start"), "length", digest, "root_sha256", status.alias("status"))
    none = lambda c: F.lit(None).cast(out.schema[c].dataType).alias(c)
    more = found.where("extra > 0").withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("extra"))))
    return out.unionByName(more.select("page_id", F.floor(F.col("id") / SEGMENT).alias("segment"), none("seq"), none("start"), "length", digest, none("root_sha256"), F.lit("extra").alias("status")))


def damaged(pages: DataFrame, every: int = 20, lost: int = 97, doubled: int = 89) -> DataFrame:
    """A replica to audit against: records with page_id divisible by `every` have another first byte,
    others divisible by `lost` are gone, and others divisible by `doubled` are there twice."""
    of = lambda n: F.coalesce(F.col("page_id") % n == 0, F.lit(False))
    html = F.when(of(every), F.concat(F.lit("!"), F.substring("html", 2, 1 << 30))).otherwise(F.col("html"))
    left = pages.where(of(every) | ~of(lost))
    times = F.when(~of(every) & of(doubled), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return left.select("page_id", "url", html.alias("html"), F.explode(times).alias("n")).drop("n")


ORACLE_SQL = r"""
WITH r AS (SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS rec FROM pages),
l AS (SELECT page_id, page_id // 4096 AS segment, page_id // 64 AS block, strlen(rec) AS length, sha256(rec) AS digest FROM r),
p AS (SELECT *, row_number() OVER w - 1 AS seq, sum(length) OVER w - length AS start FROM l WINDOW w AS (PARTITION BY segment ORDER BY page_id)),
n3 AS (SELECT segment, block, page_id, length, sha256('0:' || length || ':' || digest || '*1') AS digest FROM p),
n2 AS (SELECT segment, block, page_id, length, sha256('0:' || length || ':' || digest) AS digest FROM n3),
o2 AS (SELECT *, CAST(sum(length) OVER (PARTITION BY segment, block ORDER BY page_id) - length AS BIGINT) AS off FROM n2),
n1 AS (SELECT segment, block, CAST(sum(length) AS BIGINT) AS length, sha256(string_agg(off || ':' || length || ':' || digest, ',' ORDER BY page_id)) AS digest FROM o2 GROUP BY segment, block),
o1 AS (SELECT *, CAST(sum(length) OVER (PARTITION BY segment ORDER BY block) - length AS BIGINT) AS off FROM n1),
root AS (SELECT segment, sha256(string_agg(off || ':' || length || ':' || digest, ',' ORDER BY block)) AS root_sha256 FROM o1 GROUP BY segment)
SELECT page_id, CAST(segment AS BIGINT) AS segment, CAST(seq AS BIGINT) AS seq, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, digest AS record_sha256, root_sha256, CASE WHEN page_id % 20 = 0 THEN 'corrupt' WHEN page_id % 97 = 0 THEN 'missing' ELSE 'ok' END AS status
FROM p JOIN root USING (segment)
UNION ALL SELECT page_id, CAST(segment AS BIGINT), NULL, NULL, CAST(length AS BIGINT), digest, NULL, 'extra' FROM p WHERE page_id % 89 = 0 AND page_id % 20 <> 0 AND page_id % 97 <> 0
"""
