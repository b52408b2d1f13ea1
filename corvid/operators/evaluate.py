"""Retrieval measures and tests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvid.operators.rankers import ndcg_term


def per_query(ranked: DataFrame, gold: DataFrame, questions: DataFrame, k: int = 10) -> DataFrame:
    """qid, mrr, strict_mrr, r1, r5, r10, r50, ndcg of ranked (qid, id, rank) against gold (qid, id, grade)."""
    hit = ranked.join(gold, ["qid", "id"])
    ideal = gold.withColumn("i", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("grade"), "id"))).where(F.col("i") <= k).groupBy("qid").agg(F.sum(ndcg_term(F.col("grade"), F.col("i"))).alias("ideal"))
    found = hit.groupBy("qid").agg(F.min(F.when(F.col("grade") > 0, F.col("rank"))).alias("first"), F.min(F.when(F.col("grade") > 1, F.col("rank"))).alias("strict"), F.sum(F.when(F.col("rank") <= k, ndcg_term(F.col("grade"), F.col("rank"))).otherwise(0.0)).alias("dcg"))
    j = questions.select("qid").join(found, "qid", "left").join(ideal, "qid", "left")
    recip = lambda c: F.when(F.col(c) <= k, 1.0 / F.col(c)).otherwise(0.0)
    within = lambda n: F.when(F.col("first") <= n, 1).otherwise(0)
    return j.select("qid", F.round(recip("first"), 6).alias("mrr"), F.round(recip("strict"), 6).alias("strict_mrr"), within(1).alias("r1"), within(5).alias("r5"), within(10).alias("r10"), within(50).alias("r50"), F.round(F.coalesce(F.col("dcg") / F.col("ideal"), F.lit(0.0)), 6).alias("ndcg"))


def holm(p: DataFrame) -> DataFrame:
    """name, p, adjusted: Holm's step-down correction of a bounded table of tests (name, p)."""
    w = Window.orderBy("p", "name")
    stepped = p.withColumns({"i": F.row_number().over(w), "m": F.count("*").over(Window.partitionBy())})
    raw = F.least(F.lit(1.0), F.col("p") * (F.col("m") - F.col("i") + 1))
    return stepped.withColumn("raw", raw).select("name", "p", F.round(F.max("raw").over(w.rowsBetween(Window.unboundedPreceding, 0)), 6).alias("adjusted"))


def _resampled(spark: SparkSession, rows: int, one, seed: int) -> np.ndarray:
    """one(generator) for each of so many resamples, dealt over tasks; a resample hangs on its number alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"v": [one(np.random.default_rng([seed, int(i)])) for i in batch["id"]]})

    return spark.range(rows).mapInPandas(run, "v double").toPandas()["v"].to_numpy()


def bootstrap_ci(values: DataFrame, column: str, resamples: int = 10_000, seed: int = 0) -> tuple[float, float]:
    """The middle 95 per cent of the means of resamples of a measure (one value a question, a bounded table)."""
    v = values.select(F.col(column).cast("double")).toPandas()[column].to_numpy()
    means = _resampled(values.sparkSession, resamples, lambda g: float(v[g.integers(0, len(v), len(v))].mean()), seed)
    return float(np.percentile(means, 2.5)), float(np.percentile(means, 97.5))


def paired_p(a: DataFrame, b: DataFrame, column: str, resamples: int = 10_000, seed: int = 0) -> float:
    """How often random signs of the differences of two systems (qid and a measure) give a mean at
    least as large as theirs, two-sided; one is added to both counts."""
    d = a.select("qid", F.col(column).alias("x")).join(b.select("qid", F.col(column).alias("y")), "qid").select((F.col("y") - F.col("x")).alias("d")).toPandas()["d"].to_numpy()
    least = abs(d.mean()) - 1e-12
    beyond = _resampled(a.sparkSession, resamples, lambda g: float(abs((g.choice([-1.0, 1.0], len(d)) * d).mean()) >= least), seed)
    return float((beyond.sum() + 1) / (resamples + 1))


def page_key(location: Column) -> Column:
    """A page's address without index page, and its anchor, as a struct."""
    page = F.regexp_replace(F.substring_index(location, "#", 1), r"/index\.html$", "/")
    bare = page.rlike(r"pkg\.go\.dev/|mozilla\.org|cppreference")
    return F.struct(F.when(bare, F.regexp_replace(page, "/+$", "")).otherwise(page).alias("page"), F.when(F.contains(location, F.lit("#")), F.regexp_replace(location, "^[^#]*#", "")).otherwise("").alias("anchor"))


def gold(links: DataFrame, entries: DataFrame) -> DataFrame:
    """qid, id, grade: what answers questions whose accepted answers link to documentation.

    links: qid, sid, page, anchor; entries: id, sid, location. A page that isn't there any more is
    the one page of its source with the same file name. Entries at the very anchor have grade 2, the
    page itself 2 without an anchor, all else on the page 1. If nothing is at the anchor, entries of
    the source with this anchor do, if they are all on one page.
    """
    e = entries.select("id", "sid", page_key(F.col("location")).alias("k")).select("id", "sid", "k.page", "k.anchor")
    name = F.substring_index(F.regexp_replace("page", "/+$", ""), "/", -1)
    there = e.select("page").distinct().withColumn("there", F.lit(True))
    files = e.select("sid", name.alias("name"), "page").distinct().groupBy("sid", "name").agg(F.min("page").alias("new"), F.count("*").alias("n")).where("n = 1").drop("n")
    asked = links.select("qid", "sid", "page", F.col("anchor").alias("want")).join(there, "page", "left").withColumn("name", name).join(files, ["sid", "name"], "left")
    asked = asked.select("qid", "sid", "want", F.when(F.col("there"), F.col("page")).otherwise(F.coalesce("new", "page")).alias("page"))
    exact = (F.col("want") != "") & (F.col("anchor") == F.col("want"))
    grade = F.when(exact, 2).when(F.col("anchor") == "", F.when(F.col("want") != "", 1).otherwise(2)).otherwise(1)
    on_page = asked.join(e.select("id", "page", "anchor"), "page").select("qid", "sid", "want", "page", "id", grade.alias("grade"))
    link = ["qid", "sid", "want", "page"]
    hit = on_page.groupBy(*link).agg(F.max("grade").alias("best"))
    missed = asked.where("want != ''").join(hit, link, "left").where("coalesce(best, 0) < 2").select("qid", "sid", "want")
    alone = e.where("anchor != ''").groupBy("sid", F.col("anchor").alias("want")).agg(F.countDistinct("page").alias("pages")).where("pages = 1").drop("pages")
    anchored = missed.join(alone, ["sid", "want"]).join(e.select("id", "sid", F.col("anchor").alias("want")), ["sid", "want"]).select("qid", "id", F.lit(2).alias("grade"))
    return on_page.select("qid", "id", "grade").unionByName(anchored).groupBy("qid", "id").agg(F.max("grade").alias("grade"))


def shingle_scores(mine: DataFrame, other: DataFrame) -> DataFrame:
    """id, recall, precision of texts as sets of shingles (id, s) against another reading of them."""
    j = mine.join(other.select("id", F.col("s").alias("t")), "id")
    both = F.size(F.array_intersect("s", "t"))
    share = lambda c: F.when(F.size(c) > 0, F.round(both / F.size(c), 6)).otherwise(1.0)
    return j.select("id", share("t").alias("recall"), share("s").alias("precision"))


def report(results: dict[str, DataFrame], baseline: str, title: str, resamples: int = 10_000) -> str:
    """A Markdown table of per_query() results by system: means, the interval of the first measure, and
    how each differs from the baseline with Holm's correction."""
    spark = results[baseline].sparkSession
    measures = [c for c in results[baseline].columns if c != "qid"]
    tested = [(n, paired_p(results[baseline], r, "mrr", resamples)) for n, r in results.items() if n != baseline]
    adjusted = {r.name: r.adjusted for r in holm(spark.createDataFrame(tested, "name string, p double")).collect()} if tested else {}
    means = {n: r.agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in measures]).first() for n, r in results.items()}
    lines = [f"### {title} (n = {means[baseline]['n']})", "", "| System | " + " | ".join(measures) + " | mrr 95 % | difference |", "|" + "---|" * (len(measures) + 3)]
    for n, r in results.items():
        low, high = bootstrap_ci(r, "mrr", resamples)
        change = "baseline" if n == baseline else f"{means[n]['mrr'] - means[baseline]['mrr']:+.3f} (p={adjusted[n]:.4f})"
        lines.append(f"| {n} | " + " | ".join(f"{means[n][m]:.3f}" for m in measures) + f" | [{low:.3f}, {high:.3f}] | {change} |")
    return "\n".join(lines) + "\n"
