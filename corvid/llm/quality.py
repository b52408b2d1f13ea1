"""Quality rules with adaptive thresholds (operator 4); DataFrame functions only.

Each ratio of a document is compared with a threshold of its language and source, taken from a
mergeable quantile sketch: a histogram of counts over integer buckets whose width grows with the
value (128 buckets for each power of two, so a quantile is off by 1/128 at most). Sketches
merge by adding counts, so each task sketches what it reads and a source with a third of all rows
sends no more than its buckets. Thresholds join the documents as a table of one row a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvid.llm.text import bounded_broadcast, split_words
from corvid.session import shared_table

#: Ratios are kept in ten-thousandths.
SCALE = 10_000
#: Thresholds lie at q75 + SPREAD * (q75 - q25), for LOW also at q25 - SPREAD * (q75 - q25).
SPREAD = 4
#: metric -> the quantile (per cent) that a threshold takes where the quartiles are equal: a ratio
#: that is mostly zero has no spread, but its sketch still has a tail.
HIGH = {"symbols": 90, "dup_lines": 99, "repeats": 99, "mean_length": 99}
LOW = {"mean_length": 1}
#: metric -> least upper threshold, in ten-thousandths: a symbol in 100 characters is never too many.
FLOOR = {"symbols": 100}
#: Groups of fewer documents don't resolve such a quantile and take their language's, then that of all.
TAIL_DOCS = 500
#: Groups of fewer documents take the thresholds of their language, then of all documents.
LEAST_DOCS = 30
#: Quantiles (per cent) that are read from a sketch.
QUANTILES = sorted({25, 75, *HIGH.values(), *LOW.values()})
#: Groups up to which thresholds are broadcast, about 100 bytes each.
BROADCAST_ROWS = 100_000


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base counts of every row; all within the row, without a shuffle."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    a = docs.select("doc_id", "lang", "source", split_words(text).alias("words"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), lines.alias("lines"))
    n_triples = F.greatest(F.lit(0), F.size("words") - 2)
    triples = F.arrays_zip(F.slice("words", 1, n_triples).alias("a"), F.slice("words", 2, n_triples).alias("b"), F.slice("words", 3, n_triples).alias("c"))
    b = a.select(
        "doc_id", "lang", "source", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform(triples, lambda t: F.xxhash64(t["a"], t["b"], t["c"])).alias("h"),
    )
    some = F.size(F.array_distinct("h")) < F.size("h")
    empty = F.array().cast("array<struct<h:bigint,i:int>>")
    c = b.withColumn("s", F.when(some, F.array_sort(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(empty)).drop("h")
    # neighbours in the sorted array tell which windows occur twice
    same = lambda x, i: ((i > 0) & (F.get("s", i - 1)["h"] == x["h"])) | (F.coalesce(F.get("s", i + 1)["h"] == x["h"], F.lit(False)))
    d = c.withColumn("p", F.when(F.size("s") > 0, F.array_sort(F.transform(F.filter("s", same), lambda x: x["i"]))).otherwise(F.array().cast("array<int>"))).drop("s")
    zero = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    words_in = F.aggregate("p", zero, lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")), lambda acc: acc["n"])
    return d.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", words_in.cast("long").alias("n_repeat_words"))


def ratios() -> dict[str, Column]:
    per = lambda a, b: F.when(F.col(b) > 0, F.floor(F.col(a) * SCALE / F.col(b))).otherwise(0).cast("long")
    return {"mean_length": per("word_chars", "n_words"), "symbols": per("n_symbols", "word_chars"), "dup_lines": per("n_dup_lines", "n_lines"), "repeats": per("n_repeat_words", "n_words")}


def _low_bits(value: Column) -> Column:
    return F.greatest(F.length(F.bin(value)) - 8, F.lit(0))


def bucket(value: Column) -> Column:
    """The least integer of a value's bucket: exact below 256, then 128 buckets a power of two."""
    return F.call_function("shiftleft", F.call_function("shiftright", value, _low_bits(value)), _low_bits(value))


def bucket_end(low: Column) -> Column:
    """The greatest integer of the bucket whose least is low."""
    return low + F.call_function("shiftleft", F.lit(1).cast("long"), _low_bits(low)) - 1


def sketch(measured: DataFrame) -> DataFrame:
    """lang, source, metric, low (a bucket's least value), n: mergeable by adding n."""
    named = F.array(*[F.struct(F.lit(k).alias("metric"), bucket(v).alias("low")) for k, v in ratios().items()])
    return measured.where("not base_failed").select("lang", "source", F.explode(named).alias("m")).groupBy("lang", "source", "m.metric", "m.low").agg(F.count("*").alias("n"))


def merge(*sketches: DataFrame) -> DataFrame:
    """One sketch for what several were made of, such as days or shards."""
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return out.groupBy("lang", "source", "metric", "low").agg(F.sum("n").alias("n"))


def quantiles(merged: DataFrame, by: list[str]) -> DataFrame:
    """by, metric, docs, q1, q25, q75, q90, q99: the first bucket where the running count reaches the share."""
    grouped = merged.groupBy(*by, "metric", "low").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by, "metric")
    running = grouped.withColumns({"run": F.sum("n").over(w.orderBy("low")), "docs": F.sum("n").over(w)})
    at = lambda q: F.min(F.when(F.col("run") * 100 >= F.col("docs") * q, F.col("low"))).alias(f"q{q}")
    return running.groupBy(*by, "metric").agg(F.max("docs").alias("docs"), *map(at, QUANTILES))


def thresholds(merged: DataFrame) -> DataFrame:
    """lang, source and high_<metric>, low_<metric>; small groups back off to language, then to all."""
    own = quantiles(merged, ["lang", "source"])
    of_lang, of_all = quantiles(merged, ["lang"]), quantiles(merged, [])
    of_lang = of_lang.select(F.col("lang").alias("lang_"), F.col("metric").alias("metric_l"), *[F.col(c).alias(f"{c}_l") for c in of_lang.columns[2:]])
    of_all = of_all.select("metric", *[F.col(c).alias(f"{c}_a") for c in of_all.columns[1:]])
    j = own.join(of_lang, F.col("lang").eqNullSafe(F.col("lang_")) & (F.col("metric") == F.col("metric_l"))).join(F.broadcast(of_all), "metric")
    pick = lambda q, least: F.when(F.col("docs") >= least, F.col(q)).when(F.col("docs_l") >= least, F.col(q + "_l")).otherwise(F.col(q + "_a"))
    j = j.select("lang", "source", "metric", *[pick(f"q{q}", LEAST_DOCS if q in (25, 75) else TAIL_DOCS).alias(f"q{q}") for q in QUANTILES])
    reach = SPREAD * (F.col("q75") - F.col("q25"))
    # no document in a tail quantile's own bucket is beyond it, nor one that is like the quartiles
    high = lambda k: F.when(reach > 0, F.col("q75") + reach).otherwise(F.greatest(bucket_end(F.col(f"q{HIGH[k]}")), bucket_end(F.col("q75"))))
    low = lambda k: F.when(reach > 0, F.col("q25") - reach).otherwise(F.least(f"q{LOW[k]}", "q25"))
    limits = [F.max(F.when(F.col("metric") == k, F.greatest(high(k), F.lit(FLOOR.get(k, 0))))).alias(f"high_{k}") for k in HIGH]
    limits += [F.max(F.when(F.col("metric") == k, low(k))).alias(f"low_{k}") for k in LOW]
    return j.groupBy("lang", "source").agg(*limits)


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for every row.

    Base counts are of the whole text: words are runs without ASCII white space, a null text has
    none. base_failed: fewer than 50 words, or over half of them in three-word windows that occur
    twice. Documents that pass are kept unless a ratio (mean word length, symbols, repeated lines,
    repeated windows) lies beyond the threshold of their language and source, computed over all
    documents that pass. Null languages or sources form groups of their own. Null or repeated
    doc_ids and repeated rows keep a row each; ties at a threshold are kept; other columns are
    dropped, whatever their names; an empty table gives an empty one.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    measured = shared_table(measures(docs).withColumn("base_failed", failed), "quality")
    limits = shared_table(thresholds(sketch(measured)), "quality-thresholds")
    limits = limits.withColumnsRenamed({"lang": "lang_t", "source": "source_t"})
    joined = measured.join(bounded_broadcast(limits, BROADCAST_ROWS), F.col("lang").eqNullSafe(F.col("lang_t")) & F.col("source").eqNullSafe(F.col("source_t")), "left")
    r = ratios()
    beyond = F.lit(False)
    for k in HIGH:
        beyond = beyond | F.coalesce(r[k] > F.col(f"high_{k}"), F.lit(False))
    for k in LOW:
        beyond = beyond | F.coalesce(r[k] < F.col(f"low_{k}"), F.lit(False))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~beyond).alias("kept"))


def _oracle() -> str:
    """The same in DuckDB's SQL, from the same constants."""
    space, metrics = r"[\x20\x09-\x0D]", {"mean_length": ("word_chars", "n_words"), "symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words")}
    ratio = {k: f"CASE WHEN {b} > 0 THEN {a} * {SCALE} // {b} ELSE 0 END" for k, (a, b) in metrics.items()}
    bits = "greatest(length(bin({0})) - 8, 0)"
    points = lambda by, t: f"SELECT {by}metric, max(docs) AS docs, " + ", ".join(f"min(CASE WHEN run * 100 >= docs * {q} THEN low END) AS q{q}" for q in QUANTILES) + f" FROM (SELECT {by}metric, low, sum(n) OVER (PARTITION BY {by}metric ORDER BY low) AS run, sum(n) OVER (PARTITION BY {by}metric) AS docs FROM (SELECT {by}metric, low, sum(n) AS n FROM sketch GROUP BY ALL)) GROUP BY {by}metric"
    pick = ", ".join(f"CASE WHEN o.docs >= {(least := LEAST_DOCS if q in (25, 75) else TAIL_DOCS)} THEN o.q{q} WHEN l.docs >= {least} THEN l.q{q} ELSE a.q{q} END AS q{q}" for q in QUANTILES)
    end = lambda c: f"{c} + (CAST(1 AS BIGINT) << {bits.format(c)}) - 1"
    reach = f"{SPREAD} * (q75 - q25)"
    high = ", ".join(f"max(CASE WHEN metric = '{k}' THEN greatest(CASE WHEN {reach} > 0 THEN q75 + {reach} ELSE greatest({end(f'q{q}')}, {end('q75')}) END, {FLOOR.get(k, 0)}) END) AS high_{k}" for k, q in HIGH.items())
    low = ", ".join(f"max(CASE WHEN metric = '{k}' THEN CASE WHEN {reach} > 0 THEN q25 - {reach} ELSE least(q{q}, q25) END END) AS low_{k}" for k, q in LOW.items())
    beyond = " OR ".join([f"coalesce({ratio[k]} > high_{k}, false)" for k in HIGH] + [f"coalesce({ratio[k]} < low_{k}, false)" for k in LOW])
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '{space}+'), lambda x: x <> '') AS w FROM documents),
tri AS (SELECT r, k, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS s FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS k FROM d)),
twice AS (SELECT r, k FROM (SELECT r, k, count(*) OVER (PARTITION BY r, s) AS c FROM tri) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([k, k + 1, k + 2]) AS p FROM twice) GROUP BY r),
ln AS (SELECT r, count(*) AS n, count(DISTINCT s) AS u FROM (SELECT r, unnest(string_split(text, chr(10))) AS s FROM d) WHERE regexp_matches(s, '[^\\x20\\x09-\\x0D]') GROUP BY r),
m AS (SELECT d.r, doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(ln.n, 0) AS n_lines, coalesce(ln.n - ln.u, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM d LEFT JOIN rep USING (r) LEFT JOIN ln USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
v AS ({" UNION ALL ".join(f"SELECT lang, source, '{k}' AS metric, CAST({x} AS BIGINT) AS v FROM f WHERE NOT base_failed" for k, x in ratio.items())}),
sketch AS (SELECT lang, source, metric, (v >> {bits.format('v')}) << {bits.format('v')} AS low, count(*) AS n FROM v GROUP BY ALL),
o AS ({points('lang, source, ', 'o')}), l AS ({points('lang, ', 'l')}), a AS ({points('', 'a')}),
q AS (SELECT o.lang, o.source, o.metric, {pick} FROM o JOIN l ON o.lang IS NOT DISTINCT FROM l.lang AND o.metric = l.metric JOIN a ON o.metric = a.metric),
t AS (SELECT lang, source, {high}, {low} FROM q GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({beyond}) AS kept FROM f LEFT JOIN t ON f.lang IS NOT DISTINCT FROM t.lang AND f.source IS NOT DISTINCT FROM t.source
"""


ORACLE_SQL = _oracle()
