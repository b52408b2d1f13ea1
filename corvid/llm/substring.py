"""Substring dedup with a log-structured fingerprint index (operator 7).

A window of WINDOW words stands under its anchor: the run of GRAM words in it with the least
hash (the first of equals). Equal windows have equal anchors at equal places, so only windows
whose anchor occurs more than once can repeat. A batch of documents becomes an immutable run of
the index: the hashes of its anchors, each once with a count, sorted, and where they stand. The
hashes of a new batch are merge-joined with those of the runs before it, which tells the anchors
that the batch repeats, within itself or from history; these are recorded, and the runs are
compacted into one sorted run when there are many. Anchors met more than once are verified with
96-bit digests of the words themselves.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm.text import bounded_broadcast, dealt_join
from corvid.session import new_table_path, scratch, shared_table

WINDOW = 35
#: Words of an anchor; any value up to the window's gives the same results.
GRAM = 7
#: Runs that are merged into one before a further batch is added.
FAN_IN = 3
#: Batches that a corpus is added in where the caller names none.
BATCHES = 4
#: Words of eight bytes up to which the spans to remove are broadcast.
BROADCAST_WORDS = 2_000_000
#: Rows (of eight to forty bytes) up to which keys are broadcast, and rows of one key that are too many for a task.
BROADCAST_ROWS, HOT_ROWS = 100_000, 20_000
_SLICE_BYTES = 1 << 22
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _power_table(base: int, n: int) -> np.ndarray:
    return _tables(base, 1 << max(16, (n - 1).bit_length()))[:n]


@lru_cache(4)
def _tables(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words (runs without ASCII white space) begin and end in bytes."""
    inside = np.concatenate([[False], ~((data == 32) | ((data >= 9) & (data <= 13))), [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def hashes_of_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of the words, from one running sum over all bytes."""
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, len(data)), dtype=np.uint64)])
    return _mix((running[ends] - running[starts]) * _power_table(_INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64))


def rolling(values: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each run of n values."""
    out = np.zeros(max(0, len(values) - n + 1), np.uint64)
    for i in range(n):
        out = out * np.uint64(_BASE) + values[i : len(values) - n + 1 + i]
    return _mix(out)


def sliding_argmin(values: np.ndarray, n: int) -> np.ndarray:
    """The place of the first least of each run of n values, by doubling."""
    least, width = np.arange(len(values)), 1
    while width < n:
        step = min(width, n - width)
        a, b = least[:-step], least[step:]
        least = np.where(values[b] < values[a], b, a)
        width += step
    return least


def anchors(data: np.ndarray, window: int, gram: int, breaks: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of all windows within the texts that data holds: hash, hash of the stretch, the
    anchor's word, the first and last window under it, by words counted over data. breaks: the
    byte at which each text begins."""
    starts, ends = word_bounds(data)
    none = np.zeros(0, np.int64)
    if len(starts) < window:
        return (none.astype(np.uint64),) * 2 + (none,) * 3
    words = hashes_of_words(data, starts, ends)
    text_of = np.searchsorted(breaks, starts, "right")
    windows = np.flatnonzero(text_of[: len(starts) - window + 1] == text_of[window - 1 :])
    if not len(windows):
        return (none.astype(np.uint64),) * 2 + (none,) * 3
    grams = rolling(words, gram)
    least = sliding_argmin(grams, window - gram + 1)[windows]
    new = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (windows[1:] != windows[:-1] + 1)]))
    first, last = windows[new], windows[np.concatenate([new[1:] - 1, [len(windows) - 1]])]
    anchor = least[new]
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _power_table(_BASE, len(words)), dtype=np.uint64)])
    stop = last + window
    stretch = (running[stop] - running[first]) * _power_table(_INVERSE, len(words) + 1)[first]
    return grams[anchor], _mix(stretch + ((anchor - first) * 1_000_003 + (last - first)).astype(np.uint64)), anchor, first, last


def _batched(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= _SLICE_BYTES):
            size += len(texts[to]) + 1
            to += 1
        yield at, to
        at = to


def row_key() -> Column:
    """64 bits that stand for a row: its doc_id and text. Repeated rows share it, and all results."""
    return F.xxhash64("doc_id", "text")


def run_of(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """h, stretch, row, place (first window, windows before and after the anchor) for each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column(1)]
            for a, b in _batched(texts):
                joined = b"\n".join(texts[a:b])
                data = np.frombuffer(joined, np.uint8)
                breaks = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[a : b - 1]], dtype=np.int64)])
                h, stretch, anchor, first, last = anchors(data, window, gram, breaks)
                if not len(h):
                    continue
                starts, _ = word_bounds(data)
                text = np.searchsorted(breaks, starts[anchor], "right") - 1
                begin = np.searchsorted(starts, breaks)  # the first word of each text
                packed = (first - begin[text]) << 16 | (anchor - first) << 8 | (last - first)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(stretch.view(np.int64)), batch.column(0).take(pa.array(text + a)), pa.array(packed)], ["h", "stretch", "row", "place"])

    return docs.select(row_key().alias("row"), "text").mapInArrow(run, "h long, stretch long, row long, place long")


class FingerprintIndex:
    """Sorted immutable runs of window fingerprints in the shared folder.

    A run's hashes lie in buckets, each sorted, with the same bounds in all runs, so runs are merged
    bucket by bucket without a shuffle.
    """

    def __init__(self, spark: SparkSession, window: int = WINDOW, gram: int = GRAM, fan_in: int = FAN_IN):
        if window - gram > 250 or gram > window:
            raise ValueError("a window has to exceed its anchor, by 250 words at most")
        self.spark, self.window, self.gram, self.fan_in = spark, window, gram, fan_in
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[str] = []
        self.places: list[DataFrame] = []
        self.met: list[DataFrame] = []

    def _write_run(self, hashes: DataFrame) -> str:
        """A table of h and n (how often it occurs), sorted within buckets of h."""
        name = f"corvid_run_{uuid.uuid4().hex}"
        writer = hashes.repartition(self.buckets, "h").write.bucketBy(self.buckets, "h").sortBy("h")
        writer.option("path", new_table_path(self.spark, "fingerprint-run")).saveAsTable(name)
        return name

    def add(self, docs: DataFrame) -> None:
        """Add a new batch as a run, and record which of its hashes the index then holds twice or more."""
        if len(self.runs) >= self.fan_in:
            self.compact()
        places = shared_table(run_of(docs, self.window, self.gram), "fingerprint-places")
        name = self._write_run(places.groupBy("h").agg(F.count("*").alias("n")))
        new = self.spark.table(name)
        met = [new.where("n > 1").select("h")]
        met += [new.join(self.spark.table(run).select("h").hint("merge"), "h").select("h") for run in self.runs]
        self.met.append(shared_table(reduce(DataFrame.unionByName, met), "fingerprints-repeated"))
        self.places.append(places)
        self.runs.append(name)

    def compact(self) -> None:
        """Merge all runs into one sorted run. What was recorded stays."""
        every = reduce(DataFrame.unionByName, [self.spark.table(run) for run in self.runs])
        merged = self._write_run(every.groupBy("h").agg(F.sum("n").alias("n")))
        self.close()
        self.runs = [merged]

    def close(self) -> None:
        """Forget the runs; their files lie in the shared folder."""
        for run in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")
        self.runs = []

    def repeated(self) -> DataFrame:
        """row, place, whole, parts for all anchors that occur twice or more over all runs.

        whole: the stretch of windows around the anchor occurs elsewhere too, so all of its windows
        do. parts: the anchor also stands in other stretches, with which single windows may be
        shared; of anchors with the same stretch, one is enough to tell.
        """
        twice = shared_table(reduce(DataFrame.unionByName, self.met).distinct(), "fingerprints-twice")
        met = [p.join(bounded_broadcast(twice, BROADCAST_ROWS), "h", "left_semi") for p in self.places]
        met = shared_table(reduce(DataFrame.unionByName, met), "fingerprints-met")
        me = F.xxhash64("row", "place")
        classes = shared_table(met.groupBy("h", "stretch").agg(F.count("*").alias("same"), F.min(me).alias("one")), "fingerprints-classes")
        mixed = classes.groupBy("h").agg((F.count("*") > 1).alias("mixed"))
        classes = shared_table(classes.join(mixed, "h"), "fingerprints-mixed")
        joined = dealt_join(met, classes, ["h", "stretch"], "same", HOT_ROWS, BROADCAST_ROWS)
        return joined.select("row", "place", (F.col("same") > 1).alias("whole"), (F.col("mixed") & (me == F.col("one"))).alias("parts")).where("whole or parts")


def digests(docs: DataFrame, wanted: DataFrame, window: int = WINDOW) -> DataFrame:
    """d, e (96 bits of the words), row, span (start * 2^32 + stop): of the stretch of each wanted
    anchor and of the single windows in it, as repeated() asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                d, row, span = [], [], []
                for i, (text, places) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                    words = text.encode("utf-8", "surrogatepass").split()
                    for place in places:
                        whole, parts, first, before, after = place & 2, place & 1, place >> 18, place >> 10 & 255, place >> 2 & 255
                        spans = [(first, first + after + window, b"s%d,%d" % (before, after))] if whole else []
                        if parts:
                            spans += [(first + k, first + k + window, b"w") for k in range(after + 1)]
                        for a, b, tag in spans:
                            d.append(hashlib.blake2b(b" ".join(words[a:b]), digest_size=12, person=tag).digest())
                            row.append(i)
                            span.append(a << 32 | b)
                both = np.frombuffer(b"".join(d), np.dtype([("d", "<i8"), ("e", "<i4")]))
                yield pa.RecordBatch.from_arrays([pa.array(both["d"]), pa.array(both["e"]), part.column(0).take(pa.array(row, pa.int64())), pa.array(span, pa.int64())], ["d", "e", "row", "span"])

    per_row = wanted.groupBy("row").agg(F.collect_set(F.col("place") * 4 + F.col("whole").cast("int") * 2 + F.col("parts").cast("int")).alias("places"))
    per_row = shared_table(per_row, "places-met")
    # texts without a wanted place need not be shuffled
    texts = docs.select(row_key().alias("row"), "text").join(bounded_broadcast(per_row.select("row"), BROADCAST_ROWS), "row", "left_semi")
    both = texts.join(per_row.hint("merge"), "row").select("row", "text", "places")
    return both.mapInArrow(run, "d long, e int, row long, span long")


def repeated_spans(docs: DataFrame, index: FingerprintIndex) -> DataFrame:
    """row, spans (start * 2^32 + stop, sorted and apart): words of docs covered by windows that
    occur elsewhere too. docs: all documents whose runs the index holds."""
    found = shared_table(digests(docs, index.repeated(), index.window), "window-digests")
    twice = shared_table(found.groupBy("d", "e").agg(F.count("*").alias("times")).where("times > 1"), "window-digests-twice")
    spans = dealt_join(found, twice, ["d", "e"], "times", HOT_ROWS, BROADCAST_ROWS).groupBy("row").agg(F.array_sort(F.collect_set("span")).alias("s"))
    start, stop = lambda x: F.shiftright(x, 32), lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))
    # runs of overlapping spans become one
    none = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(-1).cast("long").alias("a"), F.lit(-1).cast("long").alias("b"))
    done = lambda acc: F.concat(acc["out"], F.array(F.shiftleft(acc["a"], 32) + acc["b"]))
    grow = lambda acc, x: F.when(start(x) <= acc["b"], F.struct(acc["out"].alias("out"), acc["a"].alias("a"), F.greatest(acc["b"], stop(x)).alias("b"))).otherwise(F.struct(F.when(acc["b"] < 0, acc["out"]).otherwise(done(acc)).alias("out"), start(x).alias("a"), stop(x).alias("b")))
    return spans.select("row", F.aggregate("s", none, grow, done).alias("spans"))


def _kept(words: list[bytes], spans: list[int] | None) -> list[bytes]:
    if not spans:
        return words
    out, to = [], 0
    for s in spans:
        a, b = s >> 32, s & 0xFFFFFFFF
        if a > to:
            out += words[to:a]
        to = max(to, b)
    return out + words[to:]


def in_batches(docs: DataFrame, batches: int = BATCHES) -> list[DataFrame]:
    """Parts of docs by a hash of doc_id, as if they had come one after the other."""
    return [docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == i) for i in range(batches)]


def remove_repeats(docs: DataFrame, window: int = WINDOW, batches: list[DataFrame] | None = None, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and text (the kept words joined by one space) for every row of docs.

    A word goes if it lies in a window of consecutive words of one document whose word sequence
    also starts anywhere else, in the same document or another; windows are judged on the input.
    batches: parts of docs, which are added to the index one by one (in_batches() if not given).
    Null texts have no words; texts shorter than a window lose nothing. Null doc_ids are a value of
    their own. Repeated rows repeat each other's windows and keep a row each. Other columns are
    dropped, whatever their names; an empty table gives an empty one. digest: kept_sha256 in place of text.
    """
    with scratch(docs.sparkSession) as keep:
        index = FingerprintIndex(docs.sparkSession, window, min(GRAM, window))
        try:
            for part in batches or in_batches(docs.select("doc_id", "text")):
                index.add(part)
            spans = keep(shared_table(repeated_spans(docs, index), "repeated-spans"))
        finally:
            index.close()
    most = spans.agg(F.coalesce(F.sum(F.size("spans") + 4), F.lit(0))).first()[0]  # words of eight bytes
    spans = F.broadcast(spans) if most <= BROADCAST_WORDS else spans
    both = docs.select("doc_id", row_key().alias("row"), "text").join(spans, "row", "left").select("doc_id", "text", "spans")

    def run(record_batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in record_batches:
            n, removed, kept = [], [], []
            for text, own in zip(batch.column(1), batch.column(2)):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                left = _kept(words, own.as_py())
                n.append(len(words))
                removed.append(len(words) - len(left))
                rest = b" ".join(left)
                kept.append(hashlib.sha256(rest).hexdigest() if digest else rest.decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", name])

    name = "kept_sha256" if digest else "text"
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(run, f"doc_id {id_type}, n_words long, n_removed long, {name} string")
