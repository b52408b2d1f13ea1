"""Rankers: each gives qid, id, rank (and a score) for a batch of queries (qid, q).

The query side is a few terms a query; it is broadcast where its size is bounded by the
caller's batch, and ranks are cut per query by a group-limited window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvid.functions import distance
from corvid.functions import text as T
from corvid.operators import index as I

K1, B, CANDIDATES, GRAM_TITLES = 1.2, 0.75, 200, 5000
BROADCAST_TERMS = 100_000
#: Terms of a batch of queries up to which a stored index is read by name.
MOST_TERMS = 2_000


def query_terms(queries: DataFrame) -> DataFrame:
    terms = queries.select("qid", F.explode(F.array_distinct(T.tokens(F.col("q")))).alias("term"))
    return F.broadcast(terms) if terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else terms


def top(scored: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    """The first of each query by order, with their rank; all without a limit."""
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def bm25(e: DataFrame, queries: DataFrame, limit: int = CANDIDATES, mask: Column | None = None) -> DataFrame:
    """qid, id, score, rank. Statistics span all entries; mask keeps entries before the cut."""
    toks = I.entry_tokens(e).select("id", "toks", F.size("toks").alias("len"))
    totals = toks.agg(F.count("*").alias("n"), F.greatest(F.avg("len"), F.lit(1e-9)).alias("avgdl"))
    terms = query_terms(queries)
    # only query terms leave the entry: tf is counted from the matching tokens alone
    hits = toks.select("id", "len", F.explode("toks").alias("term")).join(terms, "term").groupBy("qid", "term", "id", "len").agg(F.count("*").alias("tf"))
    df = hits.groupBy("qid", "term").agg(F.count("*").alias("df"))
    joined = hits.join(df, ["qid", "term"]).crossJoin(F.broadcast(totals))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    scored = joined.groupBy("qid", "id").agg(F.round(F.sum(weight), 6).alias("score"))
    if mask is not None:
        scored = scored.join(e.where(mask).select("id"), "id", "left_semi")
    return top(scored, [F.desc("score"), F.asc("id")], limit)


def bm25_stored(index: I.Stored, queries: DataFrame, limit: int = CANDIDATES, mask: DataFrame | None = None) -> DataFrame:
    """The same from a stored index; mask: id of the entries that may be ranked."""
    terms = queries.select("qid", F.explode(F.array_distinct(T.tokens(F.col("q")))).alias("term"))
    few = [r[0] for r in terms.select("term").distinct().limit(MOST_TERMS + 1).collect()]
    hits = index.postings(few if len(few) <= MOST_TERMS else None).join(query_terms(queries), "term")
    idf = F.log((index.n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / index.average))
    scored = hits.groupBy("qid", "id").agg(F.round(F.sum(weight), 6).alias("score"))
    if mask is not None:
        scored = scored.join(mask, "id", "left_semi")
    return top(scored, [F.desc("score"), F.asc("id")], limit)


def _wanted(queries: DataFrame, q: Column, name: str = "want") -> DataFrame:
    """qid and one more column of a batch of queries, broadcast if they are few."""
    out = queries.select("qid", q.alias(name)).where(F.col(name).isNotNull())
    return F.broadcast(out) if out.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else out


_NAME_ORDER = lambda: [T.dots(T.api_name(F.col("name"))).asc(), F.char_length(T.api_name(F.col("name"))).asc(), F.asc("id")]


def by_name(names: DataFrame, queries: DataFrame, prefix: bool = False, limit: int | None = CANDIDATES) -> DataFrame:
    """Entries with the query's key among theirs, or a key that starts with it (of three characters
    or more, which are joined by equality); fewest dots, then shortest, first."""
    keys = I.name_keys(names)
    wanted = _wanted(queries, T.name_key(F.col("q")))
    if not prefix:
        return top(keys.join(wanted, F.col("key") == F.col("want")).select("qid", "id", "name").distinct(), _NAME_ORDER(), limit)
    start = lambda c: F.substring(c, 1, 3)
    near = keys.withColumn("start", start("key")).join(wanted.where(F.char_length("want") >= 3).withColumn("start", start("want")), "start")
    near = near.where(F.startswith(F.col("key"), F.col("want"))).groupBy("qid", "id", "name").agg(F.max(F.col("key") == F.col("want")).alias("exact"))
    return top(near.where("not exact").drop("exact"), _NAME_ORDER(), limit)


def by_grams(e: DataFrame, queries: DataFrame, limit: int = GRAM_TITLES, index: I.Stored | None = None) -> DataFrame:
    """Titles by the number of trigrams shared with the query."""
    wanted = queries.select("qid", F.explode(T.trigrams(T.processed(F.col("q")))).alias("gram"))
    few = [r[0] for r in wanted.select("gram").distinct().limit(MOST_TERMS + 1).collect()]
    grams = I.title_grams(e) if index is None else index.grams(few if len(few) <= MOST_TERMS else None)
    shared = grams.join(F.broadcast(wanted) if len(few) <= MOST_TERMS else wanted, "gram").groupBy("qid", "id").agg(F.count("*").alias("shared"))
    return top(shared, [F.desc("shared"), F.asc("id")], limit)


def by_spelling(e: DataFrame, queries: DataFrame, limit: int = CANDIDATES, least: float = 45.0, index: I.Stored | None = None) -> DataFrame:
    """Of the titles that share most trigrams with the query, those of a weighted ratio of 45 or more."""
    near = by_grams(e, queries, GRAM_TITLES, index).select("qid", "id")
    titled = near.join(e.select("id", T.processed(F.col("title")).alias("title")), "id").join(_wanted(queries, T.processed(F.col("q"))), "qid")
    scored = titled.select("qid", "id", F.round(distance.wratio_score("title", "want"), 6).alias("score")).where(F.col("score") >= least)
    return top(scored, [F.desc("score"), F.asc("id")], limit)


def edits_of(length: Column) -> Column:
    """How many letters of a name may be wrong: none of three, one of five, else two."""
    return F.when(length < 4, 0).when(length < 6, 1).otherwise(2)


def _of_like_length(keys: DataFrame, wanted: DataFrame) -> DataFrame:
    """Keys beside the wanted ones, joined on the lengths within the edits a wanted one may have."""
    most = edits_of(F.char_length("want"))
    dealt = wanted.withColumn("most", most).withColumn("size", F.explode(F.sequence(F.char_length("want") - most, F.char_length("want") + most)))
    return keys.withColumn("size", F.char_length("key")).join(dealt, "size").drop("size")


def by_edits(names: DataFrame, queries: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """Names within the edits their length allows: none under four characters, one under six, else two."""
    near = _of_like_length(names.select("id", "name", F.lower("name").alias("key")), _wanted(queries, F.lower("q")))
    scored = near.withColumn("distance", F.levenshtein("key", "want", 2)).where((F.col("distance") >= 0) & (F.col("distance") <= F.col("most")))
    return top(scored.drop("most"), [F.asc("distance"), F.asc("key"), F.asc("id")], limit)


def by_typo(names: DataFrame, queries: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """Names that a query misspells, where no name has its key: those with the nearest key first,
    swapped neighbours being one edit, then by key, dots and length."""
    keys = I.name_keys(names)
    wanted = _wanted(queries, T.name_key(F.col("q")))
    open_ = wanted.join(keys.select(F.col("key").alias("want")).distinct(), "want", "left_anti").where(edits_of(F.char_length("want")) > 0)
    distinct = _of_like_length(keys.select("key").distinct(), open_)
    near = distinct.withColumn("distance", distance.osa_distance("key", "want", F.col("most"))).where("distance <= most").select("qid", "key", "distance")
    best = near.join(keys, "key").groupBy("qid", "id", "name").agg(F.min(F.struct("distance", "key")).alias("best"))
    return top(best.select("qid", "id", "name", "best.distance", "best.key"), [F.asc("distance"), F.asc("key"), *_NAME_ORDER()], limit)


def by_abbreviation(e: DataFrame, queries: DataFrame, limit: int = CANDIDATES, most: int = 5000) -> DataFrame:
    """Titles that hold the query's letters in order, by how well; of over 5,000 the shortest. Ties go to the later entry."""
    letters = _wanted(queries, F.regexp_replace(F.lower("q"), r"\s+", "")).where(F.char_length("want") >= 3)
    held = e.select("id", "title", F.lower("title").alias("low")).crossJoin(F.broadcast(letters))
    left = F.aggregate(F.split("want", ""), F.col("low"), lambda rest, c: F.when(F.contains(rest, c), F.substr(rest, F.instr(rest, c) + 1, F.char_length(rest))))
    short = top(held.where(left.isNotNull()).select("qid", "id", "title", "want"), [F.char_length("title").asc(), F.asc("id")], most)
    scored = short.select("qid", "id", F.round(distance.subsequence_score("want", "title"), 6).alias("score")).where("score > 0")
    return top(scored, [F.desc("score"), F.desc("id")], limit)


def by_symbols(e: DataFrame, queries: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """Of queries of symbols alone: titles that show the run of symbols; in brackets first, pages before sections, shorter first."""
    wanted = _wanted(queries.where(~F.col("q").rlike(r"(?U)\w")), F.regexp_replace("q", r"\s+", ""))
    runs = e.select("id", "title", F.explode(F.array_distinct(F.regexp_extract_all("title", F.lit(r"(?U)([^\w\s()\[\]{},]+)"), 1))).alias("run"))
    found = runs.join(wanted, F.col("run") == F.col("want"))
    bracketed = F.contains(F.col("title"), F.concat(F.lit("("), F.col("want"), F.lit(")")))
    return top(found.select("qid", "id", "title", "want"), [bracketed.desc(), F.contains(F.col("title"), F.lit(" › ")).asc(), F.char_length("title").asc(), F.asc("id")], limit).select("qid", "id", "rank")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def by_meaning(vectors: DataFrame, queries: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """Cosine of unit vectors; queries: qid, v (a batch of bounded size)."""
    scored = vectors.select("id", "v").join(F.broadcast(queries.select("qid", F.col("v").alias("qv")))).select("qid", "id", F.round(dot(F.col("v"), F.col("qv")), 6).alias("score"))
    return top(scored, [F.desc("score"), F.asc("id")], limit)


def fuse(lists: list[tuple[str, float, DataFrame]], k: int = 60, limit: int = 100) -> DataFrame:
    """Weighted reciprocal ranks: qid, id, score, ranks, rank. Ties go to the first list, then the better rank."""
    every = None
    for n, (name, weight, ranked) in enumerate(lists):
        one = ranked.select("qid", "id", F.lit(name).alias("ranker"), F.lit(n).alias("n"), F.lit(float(weight)).alias("w"), "rank")
        every = one if every is None else every.unionByName(one)
    summed = every.groupBy("qid", "id").agg(F.round(F.sum(F.col("w") / (k + F.col("rank"))), 9).alias("score"), F.min(F.struct("n", "rank")).alias("first"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("ranker", "rank")))).alias("ranks"))
    return top(summed, [F.desc("score"), F.asc("first"), F.asc("id")], limit).drop("first")


def ndcg_term(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / (F.log(rank + 1) / math.log(2))
