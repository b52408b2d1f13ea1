"""Line dedup by a deletion-neighbourhood join (operator 3); DataFrame functions only.

Lines are sequences of words. Two lines are within one word edit if one word is replaced, added
or missing. Each line emits its variants with one word deleted as hashed keys:

- lines with equal variants and the word deleted at the same place differ by that word alone;
- a line that equals a variant of another lacks one of its words.

So the earliest line of each key suffices to tell which others go, and no pairs are emitted.
Only lines that share one of their halves with another line can be within one edit (the edit
lies in the other half), so the others emit no variants.

The edit bound is relative: one word in WORDS_AN_EDIT, and one at most. Shorter lines have to be
equal, as one word is too large a part of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.llm.text import bounded_broadcast, free_names, split_words
from corvid.session import scratch, shared_table

#: Words that a line must have for one of them to differ.
WORDS_AN_EDIT = 10
#: Rows up to which the candidate lines, and the documents that lose lines, are broadcast (about 200 bytes each).
BROADCAST_ROWS = 150_000
#: Places fit into one long if texts have fewer bytes, and doc_ids lie from 0 to below the rest of its bits.
PLACE_BITS = 25


def _hash2(text: Column, salt: Column | int) -> Column:
    """A second, independent hash, chained behind a salt."""
    return F.xxhash64(F.lit(salt) if isinstance(salt, int) else salt, text)


def line_words(line: Column) -> Column:
    """The words of a line joined by one space; most lines are that already."""
    return F.when(line.rlike(r"[\x09-\x0D]|  |^ | $"), F.array_join(split_words(line), " ")).otherwise(line)


def tidy(text: Column) -> Column:
    """Whether every line of a text has its words joined by one space already, from a few quick looks at the whole."""
    odd = F.startswith(text, F.lit(" ")) | F.endswith(text, F.lit(" "))
    for part in ("  ", " \n", "\n ", "\t", "\x0b", "\x0c", "\r"):
        odd = odd | F.contains(text, F.lit(part))
    return ~odd


def n_words(joined: Column) -> Column:
    """How many words a joined line that isn't empty has."""
    return F.octet_length(joined) - F.octet_length(F.replace(joined, F.lit(" "), F.lit(""))) + 1


@dataclass(frozen=True)
class Names:
    """How documents are named and places of lines ordered: by doc_id, those without one last, then
    by hashes of the text, then by position. short: doc_id tells all texts apart, and it and a
    position fit into one long, which is quicker to compare."""

    short: bool

    def of_row(self) -> Column:
        return self.of_facts(*text_hashes())

    def of_facts(self, t: Column | str = "t", u: Column | str = "u") -> Column:
        if self.short:
            return F.col("doc_id").cast("long")
        t, u = (F.col(x) if isinstance(x, str) else x for x in (t, u))
        return F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), t.alias("t"), u.alias("u"))

    def place(self, name: Column, position: Column) -> Column:
        if self.short:
            return F.shiftleft(name, PLACE_BITS).bitwiseOR(position.cast("long"))
        return F.struct(name.alias("name"), position.alias("pos"))

    def name(self, place: Column) -> Column:
        return F.shiftright(place, PLACE_BITS) if self.short else place["name"]

    def position(self, place: Column) -> Column:
        return (place.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) if self.short else place["pos"]).cast("int")


def text_hashes() -> tuple[Column, Column]:
    return F.xxhash64("text"), F.xxhash64(F.lit(1), "text")


def count_lines(text: Column) -> Column:
    """Lines that hold a word: each match begins at the first and reaches to the line's end."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D][^\n]*")), F.lit(0)).cast("long")


def facts(docs: DataFrame) -> DataFrame:
    """doc_id, t and u (hashes of the text), bytes and n (lines with a word) of every row of docs."""
    t, u = text_hashes()
    return docs.select("doc_id", t.alias("t"), u.alias("u"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"), count_lines(F.col("text")).alias("n"))


def names(known: DataFrame) -> Names:
    """Whether short names do for the documents of which facts() are known."""
    of_id = known.groupBy("doc_id").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.max("bytes").alias("bytes"))
    fits = F.col("doc_id").between(0, (1 << (63 - PLACE_BITS)) - 1) & (F.col("a") == F.col("b")) & (F.col("bytes") < 1 << PLACE_BITS)
    return Names(bool(of_id.agg(F.coalesce(F.every(F.coalesce(fits, F.lit(False))), F.lit(True))).first()[0]))


def distinct_lines(docs: DataFrame, naming: Names, words_an_edit: int) -> DataFrame:
    """h, h2, first (the earliest place) of each distinct line with a word, and its half keys if it is long enough."""
    # what is worked out beside an explode() is worked out again for each of its rows
    whole = docs.select(naming.of_row().alias("name"), tidy(F.col("text")).alias("tidy"), F.split("text", "\n", -1).alias("lines"))
    placed = whole.select("name", "tidy", F.posexplode("lines").alias("pos", "line"))
    joined = placed.select(naming.place(F.col("name"), F.col("pos")).alias("at"), F.when(F.col("tidy"), F.col("line")).otherwise(line_words(F.col("line"))).alias("s")).where("s != ''").withColumn("n", n_words(F.col("s")))
    halves = []
    for base in (F.col("n"), F.col("n") - 1):  # the line as the shorter of a pair, and as the longer
        half = F.shiftright(base, 1)
        head = F.call_function("substring_index", "s", F.lit(" "), half)
        tail = F.call_function("substring_index", "s", F.lit(" "), half - base)
        halves += [F.xxhash64(base * 2, head), F.xxhash64(base * 2 + 1, tail)]
    keyed = joined.select("at", F.xxhash64("s").alias("h"), _hash2(F.col("s"), 1).alias("h2"), *[F.when(F.col("n") >= words_an_edit, x).alias(f"half{i}") for i, x in enumerate(halves)])
    return keyed.groupBy("h", "h2").agg(F.min("at").alias("first"), *[F.min(f"half{i}").alias(f"half{i}") for i in range(4)])


def candidates(lines: DataFrame) -> DataFrame:
    """The distinct lines that share a half with another one."""
    listed = lines.where("half0 is not null").select("h", "h2", "first", F.explode(F.array("half0", "half1", "half2", "half3")).alias("half"))
    shared = listed.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    return listed.join(shared, "half", "left_semi").select("h", "h2", "first").distinct()


def with_words(docs: DataFrame, naming: Names, chosen: DataFrame) -> DataFrame:
    """s (the words, joined) of the chosen lines, read where each occurs first."""
    first = F.col("first")
    of_doc = chosen.groupBy(naming.name(first).alias("name")).agg(F.collect_list(F.struct("h", "h2", "first")).alias("wanted"))
    of_doc = bounded_broadcast(shared_table(of_doc, "lines-wanted"), BROADCAST_ROWS)
    lines = docs.select(naming.of_row().alias("name"), "text").join(of_doc, "name").select(F.split("text", "\n", -1).alias("lines"), "wanted")
    read = lines.select("lines", F.explode("wanted").alias("w")).select("w.*", F.get("lines", naming.position(F.col("w.first"))).alias("line")).select("h", "h2", "first", line_words(F.col("line")).alias("s"))
    return read.dropDuplicates(["h", "h2"])  # repeated rows have one name


def variants(lines: DataFrame) -> DataFrame:
    """h, h2, first, whole, anywhere, k, k2: hashed keys of each line (whole) and of its variants,
    by the deleted place and, once a variant, by any place (anywhere)."""
    placed = lines.withColumn("n", n_words(F.col("s"))).select("h", "h2", "first", "s", "n", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("i"))
    head = F.call_function("substring_index", "s", F.lit(" "), F.col("i"))
    tail = F.call_function("substring_index", "s", F.lit(" "), F.col("i") + 1 - F.col("n"))
    whole = F.col("i") == F.col("n")
    left = F.when(whole, F.col("s")).when(F.col("i") == 0, tail).when(F.col("i") == F.col("n") - 1, head).otherwise(F.concat(head, F.lit(" "), tail))
    hashed = placed.select("h", "h2", "first", "i", whole.alias("whole"), left.alias("left")).select("h", "h2", "first", "whole", F.xxhash64("left").alias("k"), F.when(~F.col("whole"), _hash2(F.col("left"), F.col("i"))).alias("by_place"), _hash2(F.col("left"), -1).alias("by_any"))
    # deleting either of two equal words in a row gives one variant twice, which does no harm
    keys = F.explode(F.array(F.struct(F.lit(False).alias("anywhere"), F.col("by_place").alias("k2")), F.struct(F.lit(True).alias("anywhere"), F.col("by_any").alias("k2"))))
    return hashed.select("h", "h2", "first", "whole", "k", keys.alias("key")).select("h", "h2", "first", "whole", "k", "key.anywhere", "key.k2").where("k2 is not null")


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether two arrays of words differ by at most one replaced, added or missing word."""
    swap = F.size(a) < F.size(b)
    longer, shorter = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    n = F.size(shorter)
    differ = F.array_position(F.zip_with(F.slice(longer, F.lit(1), n), shorter, lambda x, y: x != y), True).cast("int")
    at = F.when(differ == 0, n + 1).otherwise(differ)
    rest = F.slice(longer, at + 1, F.size(longer))
    return F.when(F.size(longer) == n, rest == F.slice(shorter, at + 1, n)).when(F.size(longer) == n + 1, rest == F.slice(shorter, at, n)).otherwise(False)


def outrun(lines: DataFrame) -> DataFrame:
    """h, h2, first, earlier: lines and the earliest line that one of their keys shows within one edit.

    lines: h, h2, first, s.
    """
    emitted = variants(lines)
    firsts = emitted.groupBy("k", "k2", "anywhere").agg(F.min("first").alias("any_first"), F.min(F.when(F.col("whole"), F.col("first"))).alias("whole_first"), F.max("first").alias("last_first"))
    firsts = shared_table(firsts.where("any_first < last_first and (not anywhere or whole_first is not null)").drop("last_first"), "line-variants-shared")
    joined = emitted.join(bounded_broadcast(firsts, BROADCAST_ROWS), ["k", "k2", "anywhere"])
    # two variants that are equal wherever a word was deleted may be two edits apart
    earlier = F.when(F.col("anywhere") & ~F.col("whole"), F.col("whole_first")).otherwise(F.col("any_first"))
    return joined.select("h", "h2", "first", earlier.alias("earlier")).where("earlier < first").distinct()


def kept_places(docs: DataFrame, naming: Names, words_an_edit: int = WORDS_AN_EDIT) -> DataFrame:
    """at of the lines that stay: the first of equal lines, if no earlier line is within the bound."""
    lines = shared_table(distinct_lines(docs, naming, words_an_edit), "lines")
    near = shared_table(candidates(lines), "lines-sharing-halves")
    worded = shared_table(with_words(docs, naming, near), "lines-worded")
    late = outrun(worded)
    one, other = worded.select("h", "h2", F.split("s", " ").alias("wa")), worded.select(F.col("first").alias("earlier"), F.split("s", " ").alias("wb"))
    pairs = late.join(one, ["h", "h2"]).join(other, "earlier")
    gone = shared_table(pairs.where(within_one_edit(F.col("wa"), F.col("wb"))).select("h", "h2").distinct(), "lines-gone")
    return lines.join(bounded_broadcast(gone, BROADCAST_ROWS), ["h", "h2"], "left_anti").select(F.col("first").alias("at"))


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def dedup_lines(docs: DataFrame, words_an_edit: int = WORDS_AN_EDIT) -> DataFrame:
    """docs with their text cut to the lines that stay, and n_lines, n_kept (lines with a word).

    A line goes if an equal line (same words) comes earlier, by doc_id and position, or one within
    one word edit, both of at least words_an_edit words; whether that one goes too doesn't matter.
    Lines without a word stay where they are. A text that loses no line is left as it is. Null
    texts stay null. doc_id has to be integral; rows without one come last, and rows that share
    one are documents of their own, ordered by hashes of their text. Repeated rows are one
    document: they lose the same lines. All columns pass, whatever their names; n_lines and n_kept
    replace columns of these names. An empty table gives an empty one.
    """
    two = docs.select("doc_id", "text")
    with scratch(docs.sparkSession) as keep:
        known = shared_table(facts(two), "lines-facts")
        naming = names(known)
        kept = kept_places(two, naming, words_an_edit)
        of_doc = kept.groupBy(naming.name(F.col("at")).alias("name")).agg(F.array_sort(F.collect_set(naming.position(F.col("at")))).alias("kept"))
        # only documents that lose a line have to be told which stay
        worded = known.where("n > 0").groupBy(naming.of_facts().alias("name")).agg(F.max("n").alias("n"))
        losing = worded.join(of_doc, "name", "left").withColumn("kept", F.coalesce("kept", F.array().cast("array<int>"))).where(F.size("kept") < F.col("n"))
        losing = keep(shared_table(losing.select("name", "kept"), "lines-kept"))
    out = docs.drop("n_lines", "n_kept")
    name, of, kept, lines = free_names(out, "name", "of", "kept", "lines")
    joined = out.withColumn(name, naming.of_row()).join(bounded_broadcast(losing.toDF(of, kept), BROADCAST_ROWS), F.col(name) == F.col(of), "left").withColumn(lines, F.split("text", "\n", -1))
    n = count_lines(F.col("text"))
    stays = F.filter(lines, lambda x, i: F.array_contains(F.col(kept), i) | ~has_word(x))
    text = F.when(F.col(kept).isNull(), F.col("text")).otherwise(F.array_join(stays, "\n"))
    joined = joined.withColumns({"n_lines": n, "n_kept": F.coalesce(F.size(kept).cast("long"), n)})
    return joined.withColumn("text", text).drop(name, of, kept, lines)


def line_digests(docs: DataFrame, words_an_edit: int = WORDS_AN_EDIT) -> DataFrame:
    """doc_id, n_lines, n_kept, kept_sha256 (of the kept text) for every row of docs; see dedup_lines()."""
    out = dedup_lines(docs.select("doc_id", "text"), words_an_edit)
    return out.select("doc_id", "n_lines", "n_kept", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: For doc_ids that are unique and not null.
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, pos, ls[pos] AS raw, array_to_string(list_filter(regexp_split_to_array(ls[pos], '[\x20\x09-\x0D]+'), lambda x: x <> ''), ' ') AS s FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS pos FROM d)),
f AS (SELECT s, min({{'d': doc_id, 'p': pos}}) AS first FROM l WHERE s <> '' GROUP BY s),
w AS (SELECT s, first, string_split(s, ' ') AS w FROM f WHERE len(string_split(s, ' ')) >= {WORDS_AN_EDIT}),
v AS (SELECT s, first, i, len(w) AS n, array_to_string(list_concat(w[1:i-1], w[i+1:]), ' ') AS k FROM (SELECT s, first, w, unnest(generate_series(1, len(w))) AS i FROM w)),
gone AS (SELECT a.s FROM v a JOIN v b ON a.k = b.k AND a.i = b.i AND a.n = b.n WHERE b.first < a.first
  UNION SELECT a.s FROM v a JOIN w b ON b.s = a.k WHERE b.first < a.first UNION SELECT a.s FROM w a JOIN v b ON a.s = b.k WHERE b.first < a.first),
kept AS (SELECT first.d AS doc_id, first.p AS pos FROM f WHERE s NOT IN (SELECT s FROM gone)),
g AS (SELECT l.doc_id, count(*) FILTER (s <> '') AS n_lines, count(kept.pos) AS n_kept, string_agg(raw, chr(10) ORDER BY l.pos) FILTER (s = '' OR kept.pos IS NOT NULL) AS left_over FROM l LEFT JOIN kept USING (doc_id, pos) GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_kept, 0) AS n_kept, sha256(coalesce(CASE WHEN n_kept = n_lines THEN text ELSE left_over END, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)
"""
