"""Crawl rounds as a file stream, and pacing state per host."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvid.session import new_table_path

#: Seconds between requests after a refusal, doubled each time in a row up to the most (fixed values).
FIRST_GAP, MOST_GAP = 0.5, 10.0


def pacing(log: DataFrame) -> DataFrame:
    """host, n, refused, streak, gap of a request log (host, ts, n, ok): the longest run of refusals
    in a row and the gap it leads to. A run is found by windows over the host's log alone."""
    w = Window.partitionBy("host").orderBy("ts", "n")
    runs = log.withColumn("run", F.sum(F.col("ok").cast("int")).over(w))
    streaks = runs.where(~F.col("ok")).groupBy("host", "run").agg(F.count("*").alias("s")).groupBy("host").agg(F.max("s").alias("streak"))
    totals = log.groupBy("host").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("refused"))
    j = totals.join(streaks, "host", "left").withColumn("streak", F.coalesce("streak", F.lit(0)))
    gap = F.when(F.col("streak") == 0, 0.0).otherwise(F.least(F.lit(MOST_GAP), FIRST_GAP * F.pow(F.lit(2.0), F.col("streak") - 1)))
    return j.select("host", "n", "refused", "streak", gap.alias("gap"))


def rounds(spark: SparkSession, path: str, schema: str, key: str, checkpoint: str | None = None, out: str | None = None, files: int = 1) -> DataFrame:
    """Read a folder of fetched pages round by round, each page once, appending to a table keyed by batch.

    A stopped run continues from its checkpoint and ends with the rows of one that never stopped:
    a batch that is repeated replaces its own folder, and looks only at folders before it for pages
    that were there already. An empty or missing folder gives an empty table.
    """
    out = out or new_table_path(spark, "rounds")
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    there = lambda p: (f := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(f)
    with_batch = f"{schema}, batch int"

    def written() -> DataFrame:
        return spark.read.schema(with_batch).option("basePath", out).parquet(out) if there(out) else spark.createDataFrame([], with_batch)

    if not there(path):
        return written()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)

    def append(batch: DataFrame, number: int) -> None:
        seen = written().where(F.col("batch") < number).select(key)
        batch.dropDuplicates([key]).join(seen, key, "left_anti").select(*batch.columns).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint or new_table_path(spark, "rounds-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return written()


def plan_name(plan: dict) -> str:
    """A name for how docs are read; state of another plan is never continued."""
    return hashlib.sha256(json.dumps(plan, sort_keys=True).encode()).hexdigest()[:16]


def retries(log: DataFrame, most: int = 3) -> DataFrame:
    """url, tries, state of a fetch log (url, ts, kind; null kind: read): read, given up (a failure that
    stays, or so many that may pass), or again."""
    lasting = F.substring_index("kind", ":", 1).isin("not-found", "gone", "robots", "empty")
    each = log.groupBy("url").agg(F.count("*").alias("tries"), F.max(F.col("kind").isNull()).alias("read"), F.max(F.coalesce(lasting, F.lit(False))).alias("lasting"))
    state = F.when(F.col("read"), "read").when(F.col("lasting") | (F.col("tries") >= most), "given up").otherwise("again")
    return each.select("url", "tries", state.alias("state"))


#: How a host's gap shrinks after an answer (requests a second), and the longest wait that is kept.
RECOVERY, MOST_WAIT = 0.1, 300.0


def pace(log: DataFrame) -> DataFrame:
    """host, n, gap, next, paused: how a log of answers (host, ts in seconds, busy, retry_after, left,
    reset, floor) leaves each host. A refusal doubles the gap (half a second to ten, once in a gap), an
    answer lets it shrink, never under the host's floor; what a window of requests has left is spread
    over its time; a wait that a host asks for holds, and beyond five minutes pauses it. A host's
    answers are one group."""
    import pandas as pd

    def follow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        gap = quota = until = 0.0
        slowed, paused = float("-inf"), None
        for r in rows.sort_values("ts", kind="stable").itertuples(index=False):
            floor = 0.0 if pd.isna(r.floor) else r.floor
            gap, wait = max(gap, floor), 0.0 if pd.isna(r.retry_after) else r.retry_after
            if not pd.isna(r.left) and not pd.isna(r.reset) and r.reset > 0:
                quota = r.reset / max(r.left, 1)
                wait = max(wait, r.reset) if r.left == 0 or r.busy else wait
            if not r.busy:
                if gap > floor:
                    faster = 1 / (1 / gap + RECOVERY)
                    gap = max(floor, faster if faster >= 0.05 else 0.0)
                if not (wait and r.left == 0):
                    continue
            elif r.ts - slowed > max(1.0, gap):
                gap, slowed = max(floor, min(MOST_GAP, max(FIRST_GAP, gap * 2))), r.ts
            if wait > MOST_WAIT:
                paused = r.ts + wait
            until = max(until, r.ts + min(wait, MOST_WAIT))
        return pd.DataFrame([(key[0], len(rows), max(gap, quota), until, paused)], columns=["host", "n", "gap", "next", "paused"])

    return log.groupBy("host").applyInPandas(follow, f"host {log.schema['host'].dataType.simpleString()}, n long, gap double, next double, paused double")
