"""Search: rankers fused by reciprocal ranks, modes, duplicates, corrections, strict queries and browsing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvid.functions import strict
from corvid.functions import text as T
from corvid.operators import index as I
from corvid.operators import rankers as R
from corvid.session import shared_table

#: Results shown, and the purposes that plain search and search how cover (fixed values).
SHOW = 100
MODES = {"what": ("lookup", "understand", ""), "how": ("learn", "do", "")}
PURPOSES = ("learn", "do", "lookup", "understand")
#: Votes of the rankers (fixed values).
WEIGHTS = {"name": 3.0, "prefix": 1.0, "typo": 2.0, "edit": 0.5, "abbrev": 0.5, "words": 1.0, "meaning": 1.0, "symbols": 3.0}


@dataclass(frozen=True)
class Corpus:
    """entries: id, title, kind, text, source, purpose; vectors (id, v) and a stored index if there are any."""

    entries: DataFrame
    index: I.Stored | None = None
    vectors: DataFrame | None = None

    def is_api(self) -> Column:
        return ~F.col("kind").isin(*I.PAGE_KINDS)

    def names(self) -> DataFrame:
        return self.entries.where(self.is_api()).select("id", F.col("title").alias("name"))


def covered(corpus: Corpus, mode: str) -> DataFrame:
    """id of the entries that a mode covers: those of its purposes, for how-own the API objects too."""
    wanted = MODES.get(mode.split("-")[0], (mode,))
    own = F.coalesce("purpose", F.lit("")).isin(*wanted)
    return corpus.entries.where(own | corpus.is_api() if mode == "how-own" else own).select("id")


def without_duplicates(corpus: Corpus, hits: DataFrame) -> DataFrame:
    """hits without pages that are named as an API object is in full (names parted by :: are kept with it)."""
    e = corpus.entries
    full = e.where(corpus.is_api()).select(F.replace(F.lower(T.api_name(F.col("title"))), F.lit("::"), F.lit(".")).alias("name")).distinct()
    double = e.where(~corpus.is_api()).select("id", F.lower(T.api_name(F.col("title"))).alias("name")).join(full, "name", "left_semi")
    return hits.join(double.select("id"), "id", "left_anti")


def lists(corpus: Corpus, queries: DataFrame, mode: str | None = None, meaning: DataFrame | None = None) -> list[tuple[str, float, DataFrame]]:
    """The rankers' lists. Queries of symbols alone are left to names and symbols. Rankers of words,
    spelling and meaning choose among the covered entries; the others' lists are cut to them.
    meaning: qid, v of the queries' vectors."""
    mask = covered(corpus, mode) if mode else None
    e = corpus.entries if mask is None else corpus.entries.join(mask, "id", "left_semi")
    named = corpus.names()
    worded = queries.where(F.col("q").rlike(r"(?U)\w"))
    words = R.bm25_stored(corpus.index, worded, mask=mask) if corpus.index is not None else R.bm25(corpus.entries, worded, mask=None if mask is None else F.coalesce("purpose", F.lit("")).isin(*MODES.get(mode.split("-")[0], (mode,))))
    index = corpus.index if mask is None else None
    found = {
        "name": R.by_name(named, queries),
        "prefix": R.by_name(named, queries, prefix=True),
        "typo": R.by_typo(named, worded),
        "edit": R.by_spelling(e, worded, index=index),
        "abbrev": R.by_abbreviation(e, worded),
        "words": words,
        "symbols": R.by_symbols(corpus.entries, queries),
    }
    if corpus.vectors is not None and meaning is not None:
        v = corpus.vectors if mask is None else corpus.vectors.join(mask, "id", "left_semi")
        found["meaning"] = R.by_meaning(v, meaning)
    order = ("name", "prefix", "typo", "edit", "abbrev", "words", "meaning", "symbols")
    cut = lambda ranked: ranked if mask is None else ranked.join(mask, "id", "left_semi")
    return [(n, WEIGHTS[n], cut(found[n]) if n in ("name", "prefix", "typo", "symbols") else found[n]) for n in order if n in found]


def reranked(hits: DataFrame, limit: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy("rank")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def as_typed(corpus: Corpus, queries: DataFrame, limit: int = SHOW, mode: str | None = None, meaning: DataFrame | None = None) -> DataFrame:
    """qid, id, score, ranks, rank: all lists fused, without duplicates."""
    fused = R.fuse(lists(corpus, queries, mode, meaning), limit=10**9)
    return reranked(without_duplicates(corpus, fused), limit)


def search(corpus: Corpus, queries: DataFrame, limit: int = SHOW, mode: str | None = None, corrected: DataFrame | None = None, meaning: DataFrame | None = None) -> DataFrame:
    """As typed, and where corrected (qid, q) has another spelling, fused with its results. Mode how
    fuses what it covers itself with everything."""
    if mode == "how":
        both = [search(corpus, queries, limit, m, corrected, meaning) for m in ("how-own", None)]
        return R.fuse([(n, 1.0, shared_table(x.select("qid", "id", "rank"), f"search-{n}")) for n, x in zip(("how", "all"), both)], limit=limit)
    typed = as_typed(corpus, queries, limit, mode, meaning)
    if corrected is None:
        return typed
    other = corrected.withColumnRenamed("q", "fixed").join(queries, "qid").where("fixed != q").select("qid", F.col("fixed").alias("q"))
    typed = shared_table(typed.select("qid", "id", "score", "ranks", "rank"), "search-typed")
    again = as_typed(corpus, other, limit, mode, meaning)
    fused = R.fuse([("typed", 1.0, typed.join(other, "qid", "left_semi").select("qid", "id", "rank")), ("corrected", 1.0, again.select("qid", "id", "rank"))], limit=limit)
    alone = typed.join(other, "qid", "left_anti")
    return fused.unionByName(alone.select(*fused.columns))


def browse(corpus: Corpus) -> DataFrame:
    """id, place: what is listed before a query: by source, purpose and order; a page and its first
    heading, which share title and address, once."""
    e = corpus.entries
    address = F.substring_index("location", "#", 1) if "location" in e.columns else F.lit("")
    key = F.struct(F.regexp_replace("title", r" \((page|section)\)$", "").alias("title"), address.alias("address"))
    purpose = F.array_position(F.array(*map(F.lit, PURPOSES)), F.coalesce("purpose", F.lit("")))
    w = Window.partitionBy("source").orderBy("id")
    kept = e.select("id", "source", key.alias("key"), F.when(purpose == 0, len(PURPOSES) + 1).otherwise(purpose).alias("p")).withColumn("before", F.lag("key").over(w))
    kept = kept.where("before is null or before != key")
    return kept.select("id", "source", F.row_number().over(Window.partitionBy("source").orderBy("p", "id")).alias("place"))


def strict_search(corpus: Corpus, q: str, limit: int = SHOW) -> DataFrame:
    """id, rank of a query with phrases or patterns: the ranked results that match, then all other
    matches as they are browsed."""
    query = strict.parse(q)
    e = corpus.entries.withColumn("is_api", corpus.is_api())
    posts = None if corpus.index is None else corpus.index.postings().select("term", "id")
    match = shared_table(strict.matching(e, query, posts).select("id"), "strict")
    spark = e.sparkSession
    asked = spark.createDataFrame([(0, " ".join([query.rest, *query.phrases]).strip())], "qid int, q string")
    ranked = as_typed(corpus, asked, limit).select("id", F.lit(0).alias("part"), F.col("rank").cast("long").alias("place"), F.lit("").alias("source"))
    rest = browse(corpus).select("id", F.lit(1).alias("part"), F.col("place").cast("long"), "source")
    first = ranked.unionByName(rest).join(match, "id", "left_semi").groupBy("id").agg(F.min(F.struct("part", "source", "place")).alias("at"))
    return first.select("id", F.row_number().over(Window.orderBy("at", "id")).alias("rank")).where(F.col("rank") <= limit)


def rerank(hits: DataFrame, scores: DataFrame, exact: DataFrame, top: int = 20, pin: bool = True) -> DataFrame:
    """qid, id, rank with the first hits in the order of a model's scores (qid, id, model; any
    callable's), exact names (qid, id) pinned before them as they were, the rest unchanged."""
    marked = exact.select("qid", "id", F.lit(True).alias("pinned"))
    j = hits.select("qid", "id", "rank").join(scores.select("qid", "id", "model"), ["qid", "id"], "left").join(marked, ["qid", "id"], "left")
    head = F.col("rank") <= top
    first = F.when(~head, 2).when(F.coalesce("pinned", F.lit(False)) & F.lit(pin), 0).otherwise(1)
    within = F.when(first == 1, -F.coalesce("model", F.lit(float("-inf")))).otherwise(F.col("rank").cast("double"))
    w = Window.partitionBy("qid").orderBy(first, within, "rank")
    return j.select("qid", "id", F.row_number().over(w).alias("rank"))


def where_from(hits: DataFrame, places: list[str]) -> DataFrame:
    """id, place of results that share their name and source: the first of the columns places that
    tells them all apart, else that which tells most apart. hits: id, name, source and places."""
    w = Window.partitionBy("name", "source")
    counted = hits.withColumns({"_same": F.count("*").over(w), **{f"_{c}": F.size(F.collect_set(F.coalesce(c, F.lit(""))).over(w)) for c in places}})
    most = F.greatest(*[F.col(f"_{c}") for c in places]) if len(places) > 1 else F.col(f"_{places[0]}")
    chosen = F.when(F.lit(False), None)
    for c in places:
        chosen = chosen.when(F.col(f"_{c}") == most, F.coalesce(c, F.lit("")))
    return counted.where("_same > 1").select("id", chosen.alias("place"))
