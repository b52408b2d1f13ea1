"""Misspelled words of queries: the documents' words they most likely mean, by letters, pieces and sound."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from corvid.functions import distance
from corvid.functions import text as T

#: Means, scales and weights of the features, fitted on real misspellings elsewhere.
FEATURES = ("edits", "edits_per_letter", "similarity", "shared_pieces", "same_first_letter", "length_change", "log_frequency", "same_metaphone", "same_nysiis", "metaphone_similarity", "same_soundex", "same_match_rating", "nysiis_similarity")
MEAN = (3.64369, 0.5649, 0.53933, 0.17184, 0.40855, 0.24234, 3.42872, 0.0183, 0.0122, 0.6315, 0.05281, 0.0079, 0.604)
SCALE = (0.64412, 0.19509, 0.16311, 0.15304, 0.49031, 0.20721, 2.13195, 0.13337, 0.10936, 0.16378, 0.22436, 0.08832, 0.16919)
WEIGHTS = (-0.8306, 1.72099, 1.67324, 0.50566, 0.43082, -0.44661, 0.5586, -0.01637, -0.05009, 0.94525, 0.12457, 0.0565, 1.05421)
#: Entries a word has to be in, and letters a corrected word has at least.
MIN_FREQUENCY, MIN_LENGTH = 3, 4
MOST_EDITS = 4  # edits beyond three count as four


def match_rating(word: str) -> str:
    """The Match Rating codex: the first letter, then consonants, doubled ones once; three of either end."""
    w = word.upper()
    out = w[:1] + re.sub("[AEIOU]", "", w[1:])
    out = re.sub(r"(.)\1+", r"\1", out)
    return out if len(out) <= 6 else out[:3] + out[-3:]


def nysiis(word: str) -> str:
    """The New York State code, after its published rules."""
    w = word.upper()
    for start, new in (("MAC", "MCC"), ("KN", "N"), ("K", "C"), ("PH", "FF"), ("PF", "FF"), ("SCH", "SSS")):
        if w.startswith(start):
            w = new + w[len(start) :]
            break
    for end, new in (("EE", "Y"), ("IE", "Y"), ("DT", "D"), ("RT", "D"), ("RD", "D"), ("NT", "D"), ("ND", "D")):
        if w.endswith(end):
            w = w[: -len(end)] + new
            break
    out, i, vowels = w[:1], 1, "AEIOU"
    while i < len(w):
        c, before, after = w[i], w[i - 1], w[i + 1 : i + 2]
        step = 1
        if w.startswith("EV", i):
            new, step = "AF", 2
        elif c in vowels:
            new = "A"
        elif c in "QZM":
            new = {"Q": "G", "Z": "S", "M": "N"}[c]
        elif w.startswith("KN", i):
            new, step = "N", 2
        elif c == "K":
            new = "C"
        elif w.startswith("SCH", i):
            new, step = "SSS", 3
        elif w.startswith("PH", i):
            new, step = "FF", 2
        elif c == "H" and (before not in vowels or (after and after not in vowels) or not after):
            new = "A" if before in vowels else before
        elif c == "W" and before in vowels:
            new = "A"
        else:
            new = c
        w = w[:i] + new.ljust(step)[:step].replace(" ", "") + w[i + step :] if len(new) == step else w[:i] + new + w[i + step :]
        if new and new[-1] != out[-1:]:
            out += new[-1] if len(set(new)) == 1 else new
        i += max(1, len(new))
    out = re.sub("S$", "", out) if len(out) > 1 else out
    out = re.sub("AY$", "Y", out)
    out = re.sub("A$", "", out) if len(out) > 1 else out
    return re.sub(r"(.)\1+", r"\1", out)


#: What letters sound like, the longest spelling first (rules of the published Metaphone, as patterns).
_SOUNDS = [
    (r"^(?:KN|GN|PN|AE|WR)", lambda m: m.group()[1]), (r"^X", "S"), (r"^WH", "W"), (r"MB$", "M"), (r"SCH", "SK"),
    (r"CIA", "XA"), (r"CH", "X"), (r"C(?=[IEY])", "S"), (r"CK", "K"), (r"C", "K"), (r"DG(?=[IEY])", "J"), (r"D", "T"),
    (r"GH(?=[^AEIOU]|$)", ""), (r"GN(?:ED)?$", "N"), (r"(?<!G)G(?=[IEY])", "J"), (r"GG?", "K"), (r"PH", "F"), (r"Q", "K"),
    (r"S(?=I[OA])", "X"), (r"SH", "X"), (r"T(?=I[OA])", "X"), (r"TH", "0"), (r"TCH", "X"), (r"V", "F"), (r"X", "KS"), (r"Z", "S"),
    (r"(?<=[AEIOU])H(?![AEIOU])", ""), (r"(?<=[CGPSTK0])H", ""), (r"[WY](?![AEIOU])", ""),
]


def metaphone(word: str) -> str:
    """A Metaphone code by rewriting, not letter by letter; vowels stay at the start alone."""
    w = re.sub(r"([^C])\1+", r"\1", re.sub("[^A-Z]", "", word.upper()))
    for pattern, sound in _SOUNDS:
        w = re.sub(pattern, sound, w)
    return w[:1] + re.sub("[AEIOU]", "", w[1:])


def _codes(words: pd.Series, code) -> pd.Series:
    return words.map(lambda w: None if w is None else code(w))


@F.pandas_udf(StringType())
def metaphone_code(words: pd.Series) -> pd.Series:
    return _codes(words, metaphone)


@F.pandas_udf(StringType())
def nysiis_code(words: pd.Series) -> pd.Series:
    return _codes(words, nysiis)


@F.pandas_udf(StringType())
def match_rating_code(words: pd.Series) -> pd.Series:
    return _codes(words, match_rating)


def coded(words: DataFrame) -> DataFrame:
    """Adds the codes of column word."""
    return words.withColumns({"m": metaphone_code("word"), "n": nysiis_code("word"), "sx": F.soundex("word"), "mr": match_rating_code("word")})


def vocabulary(df: DataFrame) -> DataFrame:
    """word, df and codes of the words (term, df) that may be offered."""
    return coded(df.where((F.col("df") >= MIN_FREQUENCY) & F.col("term").rlike("^[a-z]{3,}$")).select(F.col("term").alias("word"), "df"))


def unknown_words(queries: DataFrame, df: DataFrame) -> DataFrame:
    """typed: the distinct words of queries (qid, q) of four letters or more that no entry uses."""
    words = queries.select(F.explode(F.regexp_extract_all("q", F.lit("([A-Za-z]+)"), 1)).alias("w")).select(F.lower("w").alias("typed")).distinct()
    return words.where(F.char_length("typed") >= MIN_LENGTH).join(df.select(F.col("term").alias("typed")), "typed", "left_anti")


def suggestions(typed: DataFrame, vocabulary: DataFrame, k: int = 3) -> DataFrame:
    """typed, word, probability, rank: the likeliest words for each typed one (a bounded batch), among
    the 120 most similar, the commonest within two edits, and those that sound alike."""
    mine = coded(typed.select(F.col("typed").alias("word"))).select(F.col("word").alias("typed"), *[F.col(c).alias(f"t_{c}") for c in ("m", "n", "sx", "mr")])
    pairs = vocabulary.crossJoin(F.broadcast(mine))
    edits = F.least(distance.osa_distance("word", "typed", F.lit(3)), F.lit(MOST_EDITS))
    pairs = pairs.withColumns({"similarity": distance.ratio_score("word", "typed") / 100, "edits": edits})
    by = lambda *order, where=None: F.row_number().over(Window.partitionBy("typed", *([where] if where is not None else [])).orderBy(*order, "word"))
    common = F.desc("df")
    ranked = pairs.withColumns(
        {
            "like": by(F.desc("similarity")), "close": by(common, where=F.col("edits") <= 2), "same_m": by(common, where=F.col("m") == F.col("t_m")), "same_n": by(common, where=F.col("n") == F.col("t_n")),
            "each_m": F.row_number().over(Window.partitionBy("typed", "m").orderBy(common, "word")), "m_edits": distance.osa_distance("m", "t_m", F.lit(1)),
        }
    )
    kept = ranked.where("like <= 120 or (edits <= 2 and close <= 40) or (m = t_m and same_m <= 40) or (n = t_n and same_n <= 40) or (m_edits <= 1 and each_m <= 10)")
    a, b = T.trigrams(F.col("typed")), T.trigrams(F.col("word"))
    length = F.char_length("typed")
    flag = lambda c: c.cast("double")
    values = [
        F.col("edits").cast("double"), F.col("edits") / length, F.col("similarity"), 2 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)),
        flag(F.substring("typed", 1, 1) == F.substring("word", 1, 1)), F.abs(length - F.char_length("word")) / length, F.log(F.col("df").cast("double")),
        flag(F.col("m") == F.col("t_m")), flag(F.col("n") == F.col("t_n")), distance.ratio_score("m", "t_m") / 100, flag(F.col("sx") == F.col("t_sx")), flag(F.col("mr") == F.col("t_mr")), distance.ratio_score("n", "t_n") / 100,
    ]
    z = sum(((v - F.lit(m)) / F.lit(s) * F.lit(w) for v, m, s, w in zip(values, MEAN, SCALE, WEIGHTS)), F.lit(0.0))
    of = Window.partitionBy("typed")
    scored = kept.select("typed", "word", z.alias("z")).withColumn("e", F.exp(F.col("z") - F.max("z").over(of)))
    out = scored.select("typed", "word", F.round(F.col("e") / F.sum("e").over(of), 6).alias("probability"), F.row_number().over(of.orderBy(F.desc("z"), "word")).alias("rank"))
    return out.where(F.col("rank") <= k)


def corrected(queries: DataFrame, best: DataFrame) -> DataFrame:
    """qid, q with every misspelled word replaced by the first suggestion (typed, word); the rest as typed."""
    fixes = best.where("rank = 1").agg(F.map_from_entries(F.collect_list(F.struct("typed", "word"))).alias("fix"))
    parts = F.regexp_extract_all("q", F.lit("([A-Za-z]+|[^A-Za-z]+)"), 1)
    fixed = F.transform(parts, lambda p: F.coalesce(F.element_at("fix", F.lower(p)), p))
    return queries.crossJoin(F.broadcast(fixes)).select("qid", F.array_join(fixed, "").alias("q"))
