"""Near-duplicate texts by the similarity of their shingle sets, with SimHash links first (operator 6).

Texts are equal, or linked, if the Jaccard similarity of their sets of shingles reaches a bound.
Three steps find all links up to reachability, each verified on the sets themselves:

1. SimHash fingerprints within two bits of each other, through pivot distance tables (simhash.py);
2. a prefix filter: in any common order of the shingles, two similar texts share one of their first
   few. Those that are uncommon over all texts come first. Each text is compared with one text of each shared prefix
   shingle: that which holds it earliest, so the one least changed of a group of near copies;
3. whatever is still in different components and shares a prefix shingle is compared, within the
   bounds on lengths and places that the similarity implies.

The third step alone would find every pair; the first two leave it what isn't linked to the middle
of its group, so that work doesn't grow with the square of a group of copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.llm.components import components
from corvid.llm.simhash import links, of_hashes, shingle_hashes, words_of
from corvid.llm.text import bounded_broadcast, free_names, give_back, small_batches
from corvid.session import scratch, shared_table

SHINGLE, SIMILARITY = 5, 0.8
#: Shingles are counted by so many first bits of their hashes, and the counts passed on in pieces. Those
#: of one bucket share a count; it only decides in which order prefixes are taken, so no pair hangs on it.
BUCKET_BITS, PIECE = 22, 1 << 13
#: Rows (of some 40 bytes) up to which keys are broadcast.
BROADCAST_ROWS = 150_000
#: Rows of a shingle that one task joins; shingles with more are dealt over several.
SPLIT = 4_000
#: Shingle hashes that a worker keeps while it verifies pairs; beyond, it starts afresh. Results don't depend on it.
SETS_HELD = 200_000


def row_name() -> list[Column]:
    """128 bits that stand for a row: its doc_id and text."""
    return [F.xxhash64("doc_id", "text"), F.xxhash64(F.lit(1), "doc_id", "text")]


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.uint64) >> np.uint64(64 - BUCKET_BITS)


def shingle_levels(docs: DataFrame, shingle: int) -> np.ndarray:
    """How common shingles are, by bucket_of() their hashes: eight times the binary logarithm of one
    more than the number of texts that hold one of the bucket, a text once for each; over all docs (text)."""
    buckets = 1 << BUCKET_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.uint32)
        for batch in batches:
            for text in batch.column(0):
                np.add.at(n, bucket_of(np.fromiter(set(shingle_hashes(text.as_py(), shingle)), np.uint64)), 1)
        pieces = n.astype(np.min_scalar_type(n.max())).reshape(-1, PIECE)
        some = np.flatnonzero(pieces.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([pieces[i].tobytes() for i in some], pa.binary())], ["piece", "n"])
        give_back()

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[piece] = sums.get(piece, 0) + np.frombuffer(n, f"u{len(n) // PIECE}").astype(np.int64)
        out = [np.minimum(8 * np.log2(1 + n), 255).astype(np.uint8).tobytes() for n in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(out, pa.binary())], ["piece", "level"])

    counted = docs.select("text").mapInArrow(count, "piece int, n binary").repartition("piece")
    levels = np.zeros((buckets // PIECE, PIECE), np.uint8)
    for row in counted.mapInArrow(level, "piece int, level binary").toArrow().to_pylist():
        levels[row["piece"]] = np.frombuffer(row["level"], np.uint8)
    return levels.reshape(-1)


def prefix_size(n: int, similarity: float) -> int:
    """Of n shingles in order, how many have to be looked at so that no similar text is missed."""
    return n - math.ceil(n * similarity - 1e-9) + 1 if n else 0


def read(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """r1, r2 (row_name()), doc_id, key (16 bytes of the normalised words), fp, n (shingles) and
    tokens (hashes of the prefix's shingles, in order) of every row of docs (doc_id, text)."""
    levels = docs.sparkSession.sparkContext.broadcast(shingle_levels(docs, shingle))

    def prefix(own: np.ndarray) -> np.ndarray:
        return own[np.lexsort((own, levels.value[bucket_of(own)]))][: prefix_size(len(own), similarity)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                texts = [t.as_py() for t in part.column(3)]
                keys = [xxhash.xxh3_128_digest(b" ".join(words_of(t))) for t in texts]
                sets = [np.fromiter(set(shingle_hashes(t, shingle)), np.uint64) for t in texts]
                tokens = [prefix(np.sort(s.view(np.int64))) for s in sets]
                out = [pa.array(keys, pa.binary()), pa.array(of_hashes(sets)), pa.array([len(s) for s in sets], pa.int32()), pa.array(tokens, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), *out], ["r1", "r2", "doc_id", "key", "fp", "n", "tokens"])
        give_back()

    r1, r2 = row_name()
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(r1.alias("r1"), r2.alias("r2"), "doc_id", "text")
    return rows.mapInArrow(run, f"r1 long, r2 long, doc_id {id_type}, key binary, fp long, n int, tokens array<long>")


def may_be_similar(a: str, b: str, similarity: float) -> Column:
    """Whether two texts with <a>_n and <b>_n shingles that share the <a>_at-th and <b>_at-th in
    order, and none before, can be similar enough."""
    a_n, b_n = F.col(f"{a}_n"), F.col(f"{b}_n")
    most = F.least(a_n - F.col(f"{a}_at"), b_n - F.col(f"{b}_at")) + 1
    return (most >= (a_n + b_n) * (similarity / (1 + similarity)) - 1e-9) & (F.least(a_n, b_n) >= F.greatest(a_n, b_n) * similarity - 1e-9)


def shared_tokens(texts: DataFrame) -> DataFrame:
    """token, held (by so many texts), key, n, at (from 1): prefix shingles that several texts hold.

    texts: key, n, tokens. The hashes alone are shuffled to see which are shared.
    """
    each = texts.select("key", "n", F.posexplode("tokens").alias("at", "token")).withColumn("at", F.col("at") + 1)
    several = shared_table(each.groupBy("token").agg(F.count("*").alias("held")).where("held > 1"), "near-tokens-shared")
    return each.join(bounded_broadcast(several, BROADCAST_ROWS), "token").select("token", "held", "key", "n", "at")


def named(rows: DataFrame, side: str, *also: str) -> DataFrame:
    return rows.select("token", *also, *[F.col(c).alias(f"{side}_{c}") for c in rows.columns if c not in ("token", "held", *also)])


def star_pairs(shared: DataFrame, similarity: float) -> DataFrame:
    """a, b: each text that holds a shared token with the one that holds it earliest, if they may be similar."""
    first = shared.groupBy("token").agg(F.min(F.struct("at", "n", "key")).alias("f")).select("token", F.col("f.key").alias("b_key"), F.col("f.n").alias("b_n"), F.col("f.at").alias("b_at"))
    both = named(shared, "a").join(bounded_broadcast(shared_table(first, "near-firsts"), BROADCAST_ROWS), "token")
    return both.where("a_key != b_key").where(may_be_similar("a", "b", similarity)).select(F.col("a_key").alias("a"), F.col("b_key").alias("b")).distinct()


def rest_pairs(shared: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """a, b: texts of different components (roots: key, root) that share a token and may be similar.

    The token's largest component isn't paired within itself, nor is any other. A token that many
    texts hold is dealt over several tasks by one side's key.
    """
    rooted = shared.join(bounded_broadcast(roots, BROADCAST_ROWS), "key", "left").withColumn("root", F.coalesce("root", "key"))
    rooted = shared_table(rooted, "near-tokens-rooted")
    main = rooted.groupBy("token", "root").count().groupBy("token").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count("*").alias("several")).where("several > 1")
    main = shared_table(main.select("token", "main"), "near-main")
    open_ = shared_table(rooted.join(bounded_broadcast(main, BROADCAST_ROWS), "token"), "near-tokens-open")
    parts = F.greatest(F.lit(1), F.ceil(F.col("held") / SPLIT)).cast("int")
    x = open_.where("root != main").withColumn("deal", F.pmod(F.xxhash64("key"), parts)).drop("main")
    y = open_.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1)))
    pairs = named(y, "b", "deal", "main").join(named(x, "a", "deal"), ["token", "deal"])
    pairs = pairs.where("a_root != b_root and (b_root = main or a_key < b_key)").where(may_be_similar("a", "b", similarity))
    return pairs.select(F.col("a_key").alias("a"), F.col("b_key").alias("b")).distinct()


def similar(pairs: DataFrame, docs: DataFrame, one_row: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs a, b of keys whose texts are similar enough; one_row: key, r1, r2 of a row with the text."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[bytes, set[int]] = {}
        held = 0

        def shingles(key: bytes, text: pa.StringScalar) -> set[int]:
            nonlocal held
            if (found := sets.get(key)) is None:
                if held > SETS_HELD:
                    sets.clear()
                    held = 0
                found = sets[key] = set(shingle_hashes(text.as_py(), shingle))
                held += len(found)
            return found

        for batch in batches:
            keep = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                s, t = shingles(a, x), shingles(b, y)
                both = len(s & t)
                keep.append(both >= similarity * (len(s) + len(t) - both) - 1e-9 if s or t else True)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
        sets.clear()
        give_back()

    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    wanted = shared_table(keys.join(one_row, "key"), "near-pair-rows")
    r1, r2 = row_name()
    texts = docs.select(r1.alias("r1"), r2.alias("r2"), "text").join(bounded_broadcast(wanted, BROADCAST_ROWS), ["r1", "r2"])
    # repeated rows have one name
    texts = shared_table(texts.select("key", "text").dropDuplicates(["key"]), "near-pair-texts")
    of = lambda side: texts.select(F.col("key").alias(side), F.col("text").alias(f"text_{side}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(verify, "a binary, b binary")


def classes(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """rows (r1, r2, doc_id, key of every row of docs) and, of the texts that others are linked to, roots (key, root).

    docs: doc_id, text. Both are shared tables.
    """
    small_batches(docs.sparkSession)
    with scratch(docs.sparkSession) as keep:
        every = shared_table(read(docs, shingle, similarity), "near-read")
        rows = keep(shared_table(every.select("r1", "r2", "doc_id", "key"), "near-rows"))
        of_key = [F.count("*").alias("copies"), F.min(F.struct("r1", "r2")).alias("r"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("tokens").alias("tokens")]
        texts = shared_table(every.groupBy("key").agg(*of_key).select("key", "copies", "r.r1", "r.r2", "fp", "n", "tokens"), "near-texts")
        one_row = texts.select("key", "r1", "r2")
        check = lambda pairs, name: shared_table(similar(shared_table(pairs, f"{name}-pairs"), docs, one_row, shingle, similarity), f"{name}-links")

        middle = shared_table(texts.groupBy("fp").agg(F.max_by("key", F.struct("copies", "key")).alias("middle")), "near-middles")
        same = texts.join(middle, "fp").where("key != middle").select(F.col("key").alias("a"), F.col("middle").alias("b"))
        beside = links(middle.select("fp")).withColumnRenamed("a", "x").withColumnRenamed("b", "y")
        beside = beside.join(middle.select(F.col("fp").alias("x"), F.col("middle").alias("a")), "x").join(middle.select(F.col("fp").alias("y"), F.col("middle").alias("b")), "y")
        found = check(same.unionByName(beside.select("a", "b")).distinct(), "near-simhash")

        shared = shared_table(shared_tokens(texts.select("key", "n", "tokens")), "near-tokens")
        roots = components(found)
        apart = star_pairs(shared, similarity)
        for side in ("a", "b"):
            apart = apart.join(bounded_broadcast(roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), BROADCAST_ROWS), side, "left")
        apart = apart.where("not coalesce(root_a, a) <=> coalesce(root_b, b)").select("a", "b")
        found = found.unionByName(check(apart, "near-stars"))
        roots = components(found)
        found = found.unionByName(check(rest_pairs(shared, roots.select(F.col("node").alias("key"), "root"), similarity), "near-rest"))
        roots = keep(shared_table(components(found).select(F.col("node").alias("key"), "root"), "near-roots"))
    return rows, roots


def near_dedup(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, with all their columns, that stay: one of each group of near-duplicates.

    Two texts are linked if the sets of their shingles (runs of words, A-Z lower-cased; the whole of
    a shorter text) have a Jaccard similarity of at least similarity; equal word sequences always,
    the empty one and null included. No such link is lost and no other text linked; texts and sets go by
    128-bit and 64-bit hashes. Of a group the smallest doc_id stays (null only if all are), of
    repeated rows one. All columns pass, whatever their names. An empty table gives an empty one.
    """
    rows, roots = classes(docs.select("doc_id", "text"), shingle, similarity)
    with scratch(docs.sparkSession) as keep:
        copied = rows.groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1").select("key")
        linked = roots.select("key").unionByName(copied).distinct()
        linked = shared_table(linked.join(roots, "key", "left").select("key", F.coalesce("root", "key").alias("root")), "near-linked")
        members = shared_table(rows.join(bounded_broadcast(linked, BROADCAST_ROWS), "key").select("root", "r1", "r2", "doc_id"), "near-members")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r1", "r2")).alias("w")
        winners = shared_table(members.groupBy("root").agg(first).select("root", F.col("w.r1").alias("w1"), F.col("w.r2").alias("w2")), "near-winners")
        losers = members.join(bounded_broadcast(winners, BROADCAST_ROWS), "root").where("r1 != w1 or r2 != w2").select("r1", "r2").distinct()
        losers = keep(shared_table(losers, "near-losers"))
        repeated = keep(shared_table(rows.groupBy("r1", "r2").count().where("count > 1").select("r1", "r2"), "near-repeated"))
    a, b, x, y = free_names(docs, "r1", "r2", "x1", "x2")
    r1, r2 = row_name()
    left = docs.withColumns({a: r1, b: r2})

    def among(names: DataFrame, how: str, of: DataFrame) -> DataFrame:
        other = bounded_broadcast(names.toDF(x, y), BROADCAST_ROWS)
        return of.join(other, (F.col(a) == F.col(x)) & (F.col(b) == F.col(y)), how)

    left = among(losers, "left_anti", left)
    if repeated.limit(1).count():
        left = among(repeated, "left_anti", left).unionByName(among(repeated, "left_semi", left).dropDuplicates([a, b]))
    return left.drop(a, b)
