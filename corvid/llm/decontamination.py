"""Benchmark decontamination by a prefix-filtered set join (operator 2); DataFrame functions only.

A benchmark item is cut into windows of consecutive words. A document can hold a window only if
it holds every word of it, so for exact containment the necessary prefix is one token: the word
of the window that is rarest in the documents. Occurrences of those words alone are joined to
the windows; their place inside the window bounds where it starts and ends in the document
(position and length filter), and the words between are then compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.llm.text import NOT_ALNUM_CLASS, ascii_lower, bounded_broadcast, free_names, split_words, text_key
from corvid.session import scratch, shared_table

WINDOW = 10
#: Windows (or words of windows) up to which the benchmark's side is broadcast; about 100 bytes each.
BROADCAST_ROWS = 200_000


def alnum_words(text: Column) -> Column:
    return split_words(ascii_lower(text), NOT_ALNUM_CLASS)


def item_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """w (array of words) and items (ids as strings): each distinct window with the items that hold it."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), alnum_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - size + 1)))
    return items.select("item", "words", starts.alias("at")).select("item", F.slice("words", F.col("at"), size).alias("w")).groupBy("w").agg(F.collect_set("item").alias("items"))


def with_prefix(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds token and lead (words before it): the rarest word of each window over all documents.

    Windows with a word that no document holds can't occur and are left out.
    """
    vocabulary = shared_table(windows.select(F.explode("w").alias("token")).distinct(), "benchmark-words")
    occurring = docs.select(F.explode(alnum_words(F.col("text"))).alias("token")).join(bounded_broadcast(vocabulary, BROADCAST_ROWS), "token").groupBy("token").count()
    placed = windows.select("w", "items", F.posexplode("w").alias("lead", "token"))
    ranked = placed.join(occurring, "token", "left").groupBy("w", "items").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), F.col("token"), F.col("lead"))).alias("rarest"))
    return ranked.where("rarest.count > 0").select("w", "items", "rarest.token", "rarest.lead")


def occurrences(docs: DataFrame, prefixed: DataFrame) -> DataFrame:
    """doc_id, key, start, stop (word positions), items: each verified occurrence of a window.

    prefixed has to be cheap to count.
    """
    held = docs.select("doc_id", text_key(F.col("text")).alias("key"), alnum_words(F.col("text")).alias("words"))
    start = F.col("at") - F.col("lead")
    fits = (start >= 0) & (start + F.size("w") <= F.col("n"))
    if prefixed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        placed = held.select("doc_id", "key", "words", F.size("words").alias("n"), F.posexplode("words").alias("at", "token"))
        found = placed.join(F.broadcast(prefixed), "token").where(fits & (F.slice("words", start + 1, F.size("w")) == F.col("w")))
    else:  # each place travels with as many words on both sides as a window can take up
        tokens = prefixed.select("token").distinct()
        reach = prefixed.agg(F.max(F.size("w"))).first()[0]
        placed = held.select("doc_id", "key", F.size("words").alias("n"), F.posexplode("words").alias("at", "token"), "words").select(
            "doc_id", "key", "n", "at", "token", F.slice("words", F.greatest(F.lit(1), F.col("at") + 2 - reach), 2 * reach).alias("near"), F.least(F.col("at"), F.lit(reach - 1)).alias("before")
        )
        found = placed.join(tokens, "token", "left_semi").join(prefixed, "token").where(fits & (F.slice("near", F.col("before") - F.col("lead") + 1, F.size("w")) == F.col("w")))
    return found.select("doc_id", "key", start.alias("start"), (start + F.size("w")).alias("stop"), "items")


def covered(spans: Column) -> Column:
    """How many positions the [start, stop) spans of an array cover together."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(acc["to"], s["start"]))).alias("n"), F.greatest(acc["to"], s["stop"]).alias("to"))
    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs.

    docs: doc_id, text; benchmark: item_id, text. Words are runs of ASCII letters and digits and of
    all characters beyond ASCII, with A-Z lower-cased. n_hit counts the words inside occurrences of
    any window, n_items the items with one; items_sha256 digests their ids. Null texts have no
    words, items without words no window, and null item_ids give no id. The result hangs on the
    text alone: rows with null or repeated doc_ids, and repeated rows, keep a row each. Other
    columns are dropped, whatever their names. With no documents there are no rows, with no items no hits.
    """
    windows = shared_table(item_windows(benchmark, size), "benchmark-windows")
    prefixed = shared_table(with_prefix(windows, docs), "benchmark-prefixes")
    hits = occurrences(docs, prefixed).groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    hits = hits.select(F.col("doc_id").alias("hit_id"), F.col("key").alias("hit_key"), covered(F.col("spans")).cast("long").alias("hit"), "items")
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"), F.size(alnum_words(F.col("text"))).cast("long").alias("n_words"))
    joined = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key")), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select("doc_id", "n_words", F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), F.coalesce(F.col("hit") > 0, F.lit(False)).alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of docs, with all their columns, whatever their names, that hold no window of the benchmark."""
    two = docs.select("doc_id", "text")
    with scratch(docs.sparkSession) as keep:
        windows = shared_table(item_windows(benchmark, size), "benchmark-windows")
        prefixed = shared_table(with_prefix(windows, two), "benchmark-prefixes")
        hit = keep(shared_table(occurrences(two, prefixed).select("doc_id", "key").distinct(), "contaminated"))
    of, key = free_names(docs, "of", "key")
    gone = bounded_broadcast(hit.toDF(of, key), BROADCAST_ROWS)
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(of)) & (text_key(F.col("text")) == F.col(key)), "left_anti")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, array_to_string(w[i:i+9], ' ') AS s, least(len(w), 10) AS n FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, i, n, array_to_string(w[i:i+n-1], ' ') AS s FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT r, i, dw.n, item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY r),
its AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN its USING (r)
"""
