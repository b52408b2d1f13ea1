"""SimHash near-duplicates found through pivot distance tables (operator 6).

Each distinct fingerprint gets a row of Hamming distances to reference fingerprints (pivots).
The distances to the axis pivots (the origin and the unit vectors) are the fingerprint's own
bits; equal runs of those coordinates bring candidates together. The distances to the other
pivots discard a candidate pair whose largest coordinate difference exceeds the bound (by the
triangle inequality no true link is lost); survivors are verified on all bits.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.llm.components import components
from corvid.session import shared_table

PIVOTS = 12
#: Fingerprints in one candidate bucket up to which all its pairs are compared; larger buckets
#: are linked through shared midpoints instead, which is exact and linear in their size.
PAIRS_UP_TO = 48
_SLICE = 150_000


def pivot_fingerprints(count: int = PIVOTS, seed: int = 7) -> list[int]:
    """Fixed random reference fingerprints as signed 64-bit words."""
    draw = random.Random(seed)
    return [draw.getrandbits(64) - (1 << 63) for _ in range(count)]


def words_of(text: str | None) -> list[bytes]:
    """Runs without ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_ASCII_LOWER).split()


def shingle_hashes(text: str | None, n: int) -> list[int]:
    """XXH64 (seed 42) of each run of n words, repeats included; of the whole if it is shorter."""
    words = words_of(text)
    if len(words) <= n:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends.tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a : b - 1], 42) for a, b in zip(starts, starts[n:])]


_ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def of_hashes(hashes: list[list[int]]) -> np.ndarray:
    """The fingerprint of each list of unsigned 64-bit hashes."""
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in hashes])]).astype(np.int64)
    h = np.fromiter((x for each in hashes for x in each), np.uint64, int(bounds[-1]))
    out = np.zeros(len(bounds) - 1, np.int64)
    first = 0
    while first < len(out):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + _SLICE, "right")) - 1)
        last = min(last, len(out))
        at, n = bounds[first:last] - bounds[first], np.diff(bounds[first : last + 1])
        full = n > 0
        if full.any():
            totals = np.zeros((last - first, 64), np.int64)
            stop = int(bounds[last])
            pos = int(bounds[first])
            if last - first > 1:
                bits = np.unpackbits(h[pos:stop].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                totals[full] = np.add.reduceat(bits, at[full], axis=0, dtype=np.int32)
            else:
                while pos < stop:
                    bits = np.unpackbits(h[pos : min(stop, pos + _SLICE)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    totals[0] += bits.sum(0, dtype=np.int64)
                    pos += _SLICE
            out[first:last] = np.packbits(2 * totals > n[:, None], axis=1, bitorder="little").view("<i8")[:, 0]
        first = last
    return out


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (64 bits) for every row of docs.

    A bit is 1 if it is set in over half of the hashes of the shingles, repeats included. A null
    text, or one without words, has the fingerprint zero. Texts of any length are read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.int64)]
            for at in range(0, batch.num_rows, 400):
                found.append(of_hashes([shingle_hashes(t.as_py(), shingle) for t in batch.column(1).slice(at, 400)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def pivot_table(fps: DataFrame, pivots: list[int], fp: str = "fp", prefix: str = "d") -> DataFrame:
    """Adds d0, d1, ... (or another prefix): the Hamming distances of fp to the pivots, as bytes."""
    return fps.withColumns({f"{prefix}{i}": hamming(F.col(fp), F.lit(p)).cast("tinyint") for i, p in enumerate(pivots)})


def survivors(pairs: DataFrame, refs: list[int], most_bits: int) -> DataFrame:
    """The pairs a, b that no pivot tells apart by over most_bits and whose bits differ in most_bits at most."""
    table = pivot_table(pivot_table(pairs.select("a", "b"), refs, "a", "x"), refs, "b", "y")
    near = reduce(Column.__and__, [F.abs(F.col(f"x{i}") - F.col(f"y{i}")) <= most_bits for i in range(len(refs))])
    return table.where(near).where(hamming(F.col("a"), F.col("b")) <= most_bits).select("a", "b")


def links(fps: DataFrame, most_bits: int = 2, pivots: int = PIVOTS, pairs_up_to: int = PAIRS_UP_TO) -> DataFrame:
    """Edges a, b between distinct 64-bit fingerprints (column fp) that join exactly those within
    most_bits (1 or 2) of each other, directly or through others that are. Every candidate, of
    buckets of any size, passes the pivot distances and is verified on its bits.

    With four runs of 16 coordinates and two differing bits, two runs are the same, so each
    fingerprint is listed under its six pairs of runs. Buckets of up to pairs_up_to fingerprints
    compare all pairs. In larger ones, each fingerprint is listed under itself and its 64
    neighbours at one bit; two share such a midpoint exactly if they are within two bits, and the
    candidates are the pairs of a midpoint's members with its least one (for one bit, neighbours
    themselves), which is linear.
    """
    if not 0 < most_bits <= 2:
        raise ValueError("most_bits has to be 1 or 2")
    refs = pivot_fingerprints(pivots)
    runs = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    keys = [F.struct(F.lit(n).cast("tinyint").alias("n"), (F.shiftleft(runs[i], 16).bitwiseOR(runs[j])).alias("k")) for n, (i, j) in enumerate(combinations(range(4), 2))]
    listed = shared_table(fps.select("fp", F.explode(F.array(*keys)).alias("key")).select("key.n", "key.k", "fp"), "bands")
    sizes = listed.groupBy("n", "k").agg(F.count("*").alias("size")).where("size > 1")
    sizes = shared_table(sizes, "bands-shared")
    shared = shared_table(listed.join(sizes, ["n", "k"]), "bands-candidates")
    table = pivot_table(shared.where(F.col("size") <= pairs_up_to), refs)
    x, y = table.alias("x"), table.alias("y")
    near = reduce(Column.__and__, [F.abs(F.col(f"x.d{i}") - F.col(f"y.d{i}")) <= most_bits for i in range(pivots)])
    pairs = x.join(y, [F.col("x.n") == F.col("y.n"), F.col("x.k") == F.col("y.k"), F.col("x.fp") < F.col("y.fp"), near, hamming(F.col("x.fp"), F.col("y.fp")) <= most_bits])
    pairs = pairs.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    crowded = shared.where(F.col("size") > pairs_up_to).select("fp").distinct()
    beside = [F.col("fp").bitwiseXOR(F.lit((1 << i) - ((1 << 64) if i == 63 else 0))) for i in range(64)]
    if most_bits == 2:
        points = crowded.select("fp", F.explode(F.array(F.col("fp"), *beside)).alias("z"))
        firsts = points.groupBy("z").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
        stars = points.join(firsts, "z").where("fp != a").select("a", F.col("fp").alias("b"))
    else:  # each is a neighbour of the other
        stars = crowded.select(F.col("fp").alias("b"), F.explode(F.array(*beside)).alias("a")).join(crowded.withColumnRenamed("fp", "a"), "a")
    return pairs.unionByName(survivors(stars, refs, most_bits)).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, most_bits: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id for every row of docs.

    component_id is the smallest doc_id among the rows whose fingerprints are reachable by links
    of most_bits or fewer differing bits; rows of equal fingerprints, zero included, are linked.
    Null and repeated doc_ids keep a row each; component_id is null only where all doc_ids of a
    component are. Other columns are dropped, whatever their names; an empty table gives an
    empty one. Groups of copies are one fingerprint from the start and are never paired.
    """
    of_docs = shared_table(fingerprints(docs, shingle), "fingerprints")
    distinct = shared_table(of_docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints-distinct")
    roots = components(links(distinct.select("fp"), most_bits))
    labelled = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    labelled = shared_table(labelled, "fingerprints-roots")
    named = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = shared_table(labelled.select("fp", "root").join(named, "root").select("fp", "component_id"), "fingerprints-classes")
    return of_docs.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
