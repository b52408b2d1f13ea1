"""String scores that Spark lacks, in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType


def osa(a: str, b: str, most: int) -> int:
    """Edits between a and b, a swap of neighbours counting once; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, above = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, above = above, row
    return min(above[-1], most + 1)


def subsequence(query: str, title: str) -> float:
    """How well a query's letters (lower-cased) occur in order in a title; -1 if not at all.

    The match ends where it first can and begins as late as it then can. Within, each letter met
    scores 16, 8 more at the start of a word or of a capitalised part, 4 more next to the last
    letter met, and what is skipped costs 1; longer titles lose a hundredth a character.
    """
    t = title.lower()
    at = -1
    for c in query:
        at = t.find(c, at + 1)
        if at < 0:
            return -1.0
    stop, first = at + 1, at + 1
    for c in reversed(query):
        first = t.rfind(c, 0, first)
    score, wanted, last = 0.0, 0, None
    for i in range(first, stop):
        if wanted == len(query) or t[i] != query[wanted]:
            score -= 1
            continue
        begins = not i or not t[i - 1].isalnum() or (title[i].isupper() and title[i - 1].islower())
        score += 16 + 8 * begins + 4 * (last == i - 1)
        wanted, last = wanted + 1, i
    return score - 0.01 * len(t)


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table held as the bits of one number."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for c in b:
        met = row & places.get(c, 0)
        row = (row + met | row - met) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """100 less the share of characters to delete or insert; 100 for two empty strings."""
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a stretch of the other, at most as long as it."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    best = 0.0
    for stop in range(1, len(long) + len(short)):
        best = max(best, indel_ratio(short, long[max(0, stop - len(short)) : stop]))
        if best == 100.0:
            break
    return best


def _sorted_words(s: str) -> str:
    return " ".join(sorted(s.split()))


def _set_strings(a: str, b: str) -> tuple[str, str, str]:
    x, y = set(a.split()), set(b.split())
    return tuple(" ".join(sorted(w)) for w in (x & y, x - y, y - x))


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio of the common words, and of them with the rest of either side."""
    if not a.split() or not b.split():
        return 0.0
    both, one, other = _set_strings(a, b)
    if both and not (one and other):
        return 100.0
    x, y = (f"{both} {rest}".strip() for rest in (one, other))
    found = indel_ratio(x, y)
    return max(found, indel_ratio(both, x), indel_ratio(both, y)) if both else found


def wratio(a: str, b: str) -> float:
    """A weighted ratio after the published description: whole strings, words in order and as sets;
    stretches of the longer one if it is half as long again."""
    if not a or not b:
        return 0.0
    lengths = max(len(a), len(b)) / min(len(a), len(b))
    whole = indel_ratio(a, b)
    if lengths < 1.5:
        return max(whole, 0.95 * max(indel_ratio(_sorted_words(a), _sorted_words(b)), token_set_ratio(a, b)))
    scale = 0.9 if lengths <= 8.0 else 0.6
    both, one, other = _set_strings(a, b)
    words = 100.0 if both else max(partial_ratio(_sorted_words(a), _sorted_words(b)), partial_ratio(one, other))
    return max(whole, scale * partial_ratio(a, b), 0.95 * scale * words)


@F.pandas_udf(IntegerType())
def osa_distance(a: pd.Series, b: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else osa(x, y, m) for x, y, m in zip(a, b, most)], dtype="Int32")


@F.pandas_udf(DoubleType())
def subsequence_score(query: pd.Series, title: pd.Series) -> pd.Series:
    return pd.Series([-1.0 if q is None or t is None else subsequence(q.lower(), t) for q, t in zip(query, title)])


@F.pandas_udf(DoubleType())
def wratio_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([0.0 if x is None or y is None else wratio(x, y) for x, y in zip(a, b)])


@F.pandas_udf(DoubleType())
def ratio_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([0.0 if x is None or y is None else indel_ratio(x, y) for x, y in zip(a, b)])


def register(spark) -> None:
    """Make the scores available to SQL."""
    spark.udf.register("osa_distance", osa_distance)
    spark.udf.register("subsequence_score", subsequence_score)
    spark.udf.register("wratio", wratio_score)
    spark.udf.register("indel_ratio", ratio_score)
