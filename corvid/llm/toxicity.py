"""Toxicity by class-conditional Kneser-Ney models (operator 9).

Two models, of the words of toxic and of ordinary texts, spell a word character by character:
each character given the word's beginning so far (its last CONTEXT characters), with absolute
discounting. What is discounted goes to backoff counts that both classes share and that are
gathered from all documents, labelled or not: how often the same beginning goes on like that, and
below them continuation counts of a character after the last two (after how many beginnings it
occurs). A beginning that is rare in a class is thus smoothed by counts that are equal for both,
and tells little. Spelling rather than listing words lets inflected forms of an expression count
together. The score is a logistic calibration of the difference of the log-likelihoods over the
number of words, whole and from the marked words alone, whose difference no ordinary word comes
near.

Beginnings go by 64-bit hashes, worked out for many words at once. Those of the labelled rows are
all kept; their number is bounded by the bound on these rows, not by the corpus.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.llm.text import give_back, small_batches
from corvid.session import scratch, shared_table

#: Labelled rows of each class that the classifier is fitted on, chosen by a hash of doc_id.
TRAIN_ROWS = 20_000
#: Characters of a context; words of any length are spelled to their end mark.
CONTEXT = 7
DISCOUNT = 0.75
#: Occurrences that the shared counts weigh as much as, beside the discounted mass.
SHARED = 3.0
#: A word's difference beyond which it counts as an expression of the toxic class.
MARKED = 2.5
#: Words that the length is raised by, so that a few words can't decide alone.
STEADY = 20.0
#: Words whose scores or counts a worker holds; beyond, it starts afresh. Results don't depend on it.
MOST_WORDS = 150_000
#: Texts that are scored at once, and characters of words that are spelled at once.
TEXTS_AT_ONCE = 256
SPELLED_AT_ONCE = 1 << 17
_START, _END = "\t", "\n"
#: Scripts without spaces between words: Thai to Myanmar, Khmer, kana, Han.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[{_UNSPACED}]+|[^\W_{_UNSPACED}]+")
_RUN = re.compile(rf"[{_UNSPACED}]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits; in scripts without spaces, each two neighbouring characters of a run."""
    if not text:
        return []
    found = _WORD.findall(text.lower())
    if text.isascii() or not _RUN.search(text):
        return found
    return [x for w in found for x in ((w[i : i + 2] for i in range(max(1, len(w) - 1))) if _RUN.match(w) else (w,))]


def _mix(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A hash of a hash and a character."""
    h = (h ^ (c + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Steps:
    """The characters of many words, in order, by their hashes.

    of: which word; char: the character; given: its context, the last CONTEXT characters with the
    start mark; step: context and character; two: the last two characters of the context;
    follows: these two and the character.
    """

    def __init__(self, words: list[str]):
        joined = "".join([_START + w + _END for w in words]).encode("utf-32-le", "surrogatepass")
        c = np.frombuffer(joined, "<u4").astype(np.uint64)
        sizes = np.array([len(w) + 2 for w in words], np.int64)
        starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = np.arange(len(c)) - starts
        # the hash of the last CONTEXT characters that end at each place, the nearest first
        ending, two = _mix(np.zeros(len(c), np.uint64), c), None
        for back in range(1, min(CONTEXT, len(c))):
            inside = place >= back
            ending[back:] = np.where(inside[back:], _mix(ending[back:], c[: len(c) - back]), ending[back:])
            if back == 1:
                two = ending.copy()
        at = np.flatnonzero(place > 0)
        self.of = np.repeat(np.arange(len(words)), sizes)[at]
        self.char = c[at]
        self.given, self.two = ending[at - 1], two[at - 1]
        self.step, self.follows = _mix(self.given, ~self.char), _mix(self.two, ~self.char)


def parts_of(words: Iterable[str]) -> Iterator[list[str]]:
    """The words in lists of SPELLED_AT_ONCE characters or a little more."""
    part, size = [], 0
    for w in words:
        part.append(w)
        size += len(w) + 2
        if size >= SPELLED_AT_ONCE:
            yield part
            part, size = [], 0
    if part:
        yield part


def remainder(doc_id: Column) -> Column:
    """crc32 of the decimal doc_id modulo 5; 0 marks held-out rows. Null for null."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % 5).cast("int")


def training_rows(labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, toxic, fold of at most most labelled rows a class, never held-out ones."""
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("fold", remainder(F.col("doc_id"))).where("fold != 0")
    draw = lambda c: one.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return draw(0).unionByName(draw(1))


def class_counts(texts: DataFrame) -> DataFrame:
    """step, given, two, follows, n0, n1: how often ordinary and toxic texts (text, toxic) take each step."""
    names = ["step", "given", "two", "follows", "n0", "n1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4 * TEXTS_AT_ONCE):
                some = batch.slice(start, 4 * TEXTS_AT_ONCE)
                words: tuple[Counter, Counter] = Counter(), Counter()
                for text, toxic in zip(some.column(0), some.column(1).to_pylist()):
                    words[toxic].update(words_of(text.as_py()))
                for toxic, counts in enumerate(words):
                    for part in parts_of(counts):
                        s = Steps(part)
                        step, first, at = np.unique(s.step, return_index=True, return_inverse=True)
                        n = np.zeros((2, len(step)), np.int64)
                        n[toxic] = np.bincount(at, np.array([counts[w] for w in part])[s.of]).astype(np.int64)
                        columns = [step, s.given[first], s.two[first], s.follows[first]]
                        yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in columns), pa.array(n[0]), pa.array(n[1])], names)

    found = texts.select("text", "toxic").mapInArrow(run, ", ".join(f"{x} long" for x in names))
    return found.groupBy("step").agg(*[F.min(x).alias(x) for x in names[1:4]], F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def with_lower(counts: DataFrame) -> DataFrame:
    """step, given, n0, n1 and lower, the share of the step's character among what follows two
    characters, by the number of contexts that it follows in; sorted by step. counts: a shared table."""
    follows = counts.groupBy("follows", "two").agg(F.count("*").alias("contexts"))
    after = follows.groupBy("two").agg(F.sum("contexts").alias("all"), F.count("*").alias("kinds"))
    shares = follows.join(after, "two").select("follows", ((F.col("contexts") + 1) / (F.col("all") + F.col("kinds") + 1)).cast("float").alias("lower"))
    return counts.join(shares, "follows").select("step", "given", F.col("n0").cast("int").alias("n0"), F.col("n1").cast("int").alias("n1"), "lower").orderBy("step")


class Hashes:
    """Sorted 64-bit hashes that are looked up by their first bits: about one starts with each."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(1, len(keys).bit_length() - 1)
        firsts = np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)
        self.starts = np.append(np.searchsorted(keys, (firsts ^ np.uint64(1 << 63)).view(np.int64)), len(keys)).astype(np.int32)

    def find(self, asked: np.ndarray) -> np.ndarray:
        """The place of each, and -1 of those that aren't there."""
        out = np.full(len(asked), -1, np.int32)
        first = ((asked ^ np.uint64(1 << 63)) >> np.uint64(64 - self.bits)).astype(np.int64)
        asked = asked.view(np.int64)
        at, stop = self.starts[first], self.starts[first + 1]
        open_ = np.flatnonzero(at < stop)
        at, stop, asked = at[open_], stop[open_], asked[open_]
        while len(open_):
            found = self.keys[at]
            hit = found == asked
            out[open_[hit]] = at[hit]
            at += 1
            more = np.flatnonzero((found < asked) & (at < stop))
            open_, at, stop, asked = open_[more], at[more], stop[more], asked[more]
        return out


def corpus_counts(docs: DataFrame, given: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often all texts of docs stand in the contexts, and take the steps, of these (sorted) hashes.

    Each task adds up what it reads in one array of their size; these arrays are added up.
    """
    known = docs.sparkSession.sparkContext.broadcast((Hashes(given), Hashes(step)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts, taken = known.value
        most = len(contexts.keys)
        total, words = None, Counter()

        def add() -> None:
            for part in parts_of(words):
                s = Steps(part)
                n = np.array([words[w] for w in part])[s.of]
                at = contexts.find(s.given)
                hit = np.flatnonzero(at >= 0)
                np.add.at(total, at[hit], n[hit])
                where = taken.find(s.step[hit])
                also = where >= 0
                np.add.at(total, where[also] + most, n[hit][also])
            words.clear()

        for batch in batches:
            if total is None:
                total = np.zeros(most + len(taken.keys), np.int64)
            for text in batch.column(0):
                words.update(words_of(text.as_py()))
                if len(words) > MOST_WORDS:
                    add()
        if total is not None:
            add()
            give_back()
            at = np.flatnonzero(total)
            for first in range(0, len(at), 1 << 16):
                part = at[first : first + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], ["at", "n"])

    found = docs.select("text").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    known.unpersist()
    out = np.zeros(len(given) + len(step))
    out[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return out[: len(given)], out[len(given) :]


class WordScores(dict):
    """word -> log p(word | toxic) - log p(word | ordinary), of the words met lately."""

    def __init__(self, models: Models):
        super().__init__()
        self.models = models

    def learn(self, texts: list[list[str]]) -> None:
        """Work out what is missing for the words of some texts; scores met before may go."""
        every = set().union(*texts)
        new = every.difference(self)
        if len(self) + len(new) > MOST_WORDS:
            self.clear()
            new = every
        for part in parts_of(new):
            self.update(zip(part, self.models.of_words(part).tolist()))


class Models:
    """Both models, as tables of all contexts and steps of the training texts, however rare.

    Of a step, seen is log q1 - log q0; of a context, unseen is that of any character that doesn't
    follow it in the training texts: there the shared part cancels out.
    """

    def __init__(self, given: np.ndarray, unseen: np.ndarray, step: np.ndarray, seen: np.ndarray):
        self.given, self.unseen, self.step, self.seen = Hashes(given), unseen.astype(np.float32), Hashes(step), seen.astype(np.float32)
        self.weights = (0.0, 1.0, 1.0)  # constant, all words, marked words
        self._scores: WordScores | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_scores": None}

    def of_words(self, words: list[str]) -> np.ndarray:
        """The difference of the log-likelihoods of each word."""
        s = Steps(words)
        at = self.given.find(s.given)
        hit = np.flatnonzero(at >= 0)  # after an unknown beginning, both classes back off to the same
        where = self.step.find(s.step[hit])
        return np.bincount(s.of[hit], np.where(where >= 0, self.seen[where], self.unseen[at[hit]]), len(words))

    def differences(self, texts: list[str | None] | pa.Array) -> np.ndarray:
        """Of each text the difference of the length-normalised log-likelihoods, and its part from marked words."""
        if self._scores is None:
            self._scores = WordScores(self)
        out = np.zeros((len(texts), 2))
        for start in range(0, len(texts), TEXTS_AT_ONCE):
            part = texts[start : start + TEXTS_AT_ONCE]
            words = [words_of(t) for t in (part if isinstance(part, list) else part.to_pylist())]
            self._scores.learn(words)
            for i, own in enumerate(words, start):
                if own:
                    each = np.fromiter(map(self._scores.__getitem__, own), float, len(own))
                    out[i] = each.sum(), np.maximum(each - MARKED, 0).sum()
                    out[i] /= len(own) + STEADY
        return out

    def forget(self) -> None:
        """Give back what a worker holds beside the model."""
        self._scores = None
        give_back()

    def scores(self, texts: list[str | None] | pa.Array) -> np.ndarray:
        constant, whole, marked = self.weights
        found = self.differences(texts)
        return 1 / (1 + np.exp(-np.clip(constant + whole * found[:, 0] + marked * found[:, 1], -500, 500)))


def kneser_ney(counts: DataFrame, docs: DataFrame) -> Models:
    """Models of class_counts() (a shared table), none left out, with shared counts of all docs; the
    training rows bound their size."""
    table = with_lower(counts).toArrow()
    column = lambda c: table.column(c).to_numpy()
    step = column("step")
    given, of = np.unique(column("given"), return_inverse=True)
    of = of.astype(np.int32)
    stood, taken = corpus_counts(docs, given, step)
    add = lambda x: np.bincount(of, x, len(given))
    n = [column(f"n{c}").astype(float) for c in (0, 1)]
    total = [add(x) for x in n]
    # docs may lack a training text
    taken, stood = np.maximum(taken, n[0] + n[1]), np.maximum(stood, total[0] + total[1])
    discounted = np.maximum(taken - DISCOUNT, 0)
    shared = (discounted + (stood - add(discounted))[of] * column("lower")) / stood[of]
    del taken, discounted
    log_q, log_left = [], []
    for c in (0, 1):
        discounted = np.maximum(n[c] - DISCOUNT, 0)
        left = total[c] - add(discounted)
        log_q.append(np.log((discounted + (left + SHARED)[of] * shared) / (total[c] + SHARED)[of]))
        log_left.append(np.log((left + SHARED) / (total[c] + SHARED)))
    return Models(given, log_left[1] - log_left[0], step, log_q[1] - log_q[0])


def _calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Constant and weights of a logistic regression by Newton's steps, with a slight pull to zero."""
    centre, scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
    z = np.concatenate([np.ones((len(x), 1)), (x - centre) / scale], axis=1)
    beta, pull = np.zeros(z.shape[1]), 0.1
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -500, 500)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + pull * np.eye(len(beta)), z.T @ (y - p) - pull * beta)
        beta += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return (float(beta[0] - (beta[1:] * centre / scale).sum()), *map(float, beta[1:] / scale))


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Models | None:
    """Fit on folds 1-3 of the training rows, with shared counts of all docs, and calibrate on fold 4
    (on all of them if it lacks a class); None if the training rows have no text of one of the classes."""
    small_batches(docs.sparkSession)
    with scratch(docs.sparkSession):
        rows = shared_table(training_rows(labels, most), "toxicity-training")
        texts = shared_table(docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").select("text", "toxic", "fold"), "toxicity-texts")
        have = {(r[0], r[1]) for r in texts.where(F.col("text").rlike(r"[\p{L}\p{N}]")).select((F.col("fold") == 4).alias("late"), "toxic").distinct().collect()}
        split = all((late, c) in have for late in (True, False) for c in (0, 1))
        if not split and not all(any((late, c) in have for late in (True, False)) for c in (0, 1)):
            return None
        models = kneser_ney(shared_table(class_counts(texts.where("fold != 4") if split else texts), "toxicity-counts"), docs)
        known = docs.sparkSession.sparkContext.broadcast(models)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = known.value.differences(batch.column(0))
                yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), *(pa.array(found[:, i]) for i in (0, 1))], ["toxic", "a", "b"])

        seen = (texts.where("fold = 4") if split else texts).select("text", "toxic").mapInArrow(run, "toxic int, a double, b double").toArrow()
        known.unpersist()
    y, a, b = (seen.column(i).to_numpy().astype(float) for i in range(3))
    order = np.lexsort((y, b, a))
    models.weights = _calibrated(np.stack([a[order], b[order]], axis=1), y[order])
    return models


def scored(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text).

    labels (doc_id, toxic) teach only where crc32(doc_id as text) mod 5 is not 0, at most `most`
    rows a class; of several labels of a doc_id the largest holds, null ones teach nothing. The
    score hangs on the text alone. A null text scores as an empty one; a null doc_id isn't held out.
    Without training texts of both classes every score is 0. Repeated rows and doc_ids keep a row
    each; other columns are dropped, whatever their names; an empty table gives an empty one.
    """
    models = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows) if models.value is None else models.value.scores(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["doc_id", "score"])
        if models.value is not None:
            models.value.forget()

    id_type = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, score double")
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs, with all their columns, whatever their names, whose text scores under 0.5; see scored()."""
    models = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, most))
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch if models.value is None else batch.filter(pa.array(models.value.scores(batch.column(at)) < 0.5))
        if models.value is not None:
            models.value.forget()

    return docs.mapInArrow(run, docs.schema)
