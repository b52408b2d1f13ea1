"""Inverted, name and trigram indexes as DataFrames keyed by the entry's id, and an index of them that is stored."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.functions import text as T
from corvid.session import new_table_path

TITLE_WEIGHT = 3
#: Kinds of entries that are prose; all others are API objects (fixed values).
PAGE_KINDS = ("doc", "label", "page", "section", "man", "help", "usage", "term", "example")
#: Folders that the terms of stored postings are dealt to by hash, so that a query reads few.
BUCKETS = 64


def entries(documents: DataFrame) -> DataFrame:
    """id, title, text, source, lang of the documents table."""
    return documents.select(F.col("doc_id").alias("id"), T.title_of(F.col("text")).alias("title"), "text", "source", "lang")


def entry_tokens(e: DataFrame) -> DataFrame:
    """id, toks: the title's tokens three times, then the plain body's."""
    return e.select("id", F.concat(F.flatten(F.array_repeat(T.tokens(F.col("title")), TITLE_WEIGHT)), T.tokens(T.unfenced(F.col("text")))).alias("toks"))


def postings(e: DataFrame) -> DataFrame:
    """term, id, tf; counted where the entry is read before anything is shuffled."""
    return entry_tokens(e).select("id", F.explode("toks").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))


def lengths(e: DataFrame) -> DataFrame:
    return entry_tokens(e).select("id", F.size("toks").cast("long").alias("len"))


def document_frequency(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count("*").alias("df"))


def name_keys(names: DataFrame) -> DataFrame:
    """key, id, name: every key that a name (id, name) is found by."""
    return names.select("id", "name", F.explode(T.api_keys(F.col("name"))).alias("key"))


def title_grams(e: DataFrame) -> DataFrame:
    return e.select("id", F.explode(T.trigrams(T.processed(F.col("title")))).alias("gram"))


def snapshot(df: DataFrame) -> str:
    """What a table's files are: a digest of their names, sizes and times."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = hashlib.sha256()
    for f in sorted(df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(f)
        status = path.getFileSystem(conf).getFileStatus(path)
        found.update(f"{f} {status.getLen()} {status.getModificationTime()}\n".encode())
    return found.hexdigest()


@dataclass(frozen=True)
class Stored:
    """Postings, document frequencies, lengths and title trigrams of some entries, written once.

    Postings carry the entry's length, lie in folders by a hash of the term, and are sorted by term,
    so a query reads the row groups of its own terms alone.
    """

    spark: SparkSession
    path: str
    of: str
    n: int
    average: float

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def fits(self, source: DataFrame) -> bool:
        """Whether the entries' files are still what the index was built from."""
        return self.of == snapshot(source)

    def _of_keys(self, name: str, column: str, keys: list[str] | None) -> DataFrame:
        found = self.table(name)
        if keys is None:
            return found
        buckets = {r[0] for r in self.spark.createDataFrame([(k,) for k in keys], f"{column} string").select(bucket(column)).distinct().collect()} if keys else set()
        return found.where(F.col("bucket").isin(*buckets) & F.col(column).isin(*keys)) if keys else found.where(F.lit(False))

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """term, id, tf, len, df; of these terms alone if they are given (a bounded list)."""
        return self._of_keys("postings", "term", terms)

    def grams(self, grams: list[str] | None = None) -> DataFrame:
        """gram, id."""
        return self._of_keys("grams", "gram", grams)


def bucket(column: str):
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int").alias("bucket")


def build(e: DataFrame, source: DataFrame, path: str | None = None) -> Stored:
    """Store the index of entries e (id, title, text) that come from the files of source."""
    spark = e.sparkSession
    path = path or new_table_path(spark, "index")
    toks = entry_tokens(e).select("id", "toks", F.size("toks").cast("long").alias("len"))
    toks.select("id", "len").write.mode("overwrite").parquet(f"{path}/lengths")
    posts = toks.select("id", "len", F.explode("toks").alias("term")).groupBy("term", "id", "len").agg(F.count("*").alias("tf"))
    posts.write.mode("overwrite").parquet(f"{path}/counted")
    posts = spark.read.parquet(f"{path}/counted")
    dealt = posts.join(document_frequency(posts), "term").withColumn("bucket", bucket("term"))
    dealt.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(4))).sortWithinPartitions("term", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    grams = title_grams(e).withColumn("bucket", bucket("gram"))
    grams.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(4))).sortWithinPartitions("gram", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/grams")
    n, average = spark.read.parquet(f"{path}/lengths").agg(F.count("*"), F.avg("len")).first()
    return Stored(spark, path, snapshot(source), n, average or 1.0)
