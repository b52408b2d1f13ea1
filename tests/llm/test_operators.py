"""Operators against libraries, brute force and SQL twins, on small and awkward tables."""

import collections
import hashlib
import random
import re
import zlib

import base64

import duckdb
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import numpy as np

from corvid.llm import bpe, catalog, components, decontamination, line_dedup, near_dedup, quality, simhash, substring, token_counts, toxicity, url_filter, warc

SF = "/root/testdata/sf0.001"
JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
SPACE = "[\x20\x09-\x0d]+"
#: Names that operators use inside, in columns of the caller.
CLASHES = ["n_words", "key", "_KEY", "Name", "kept", "lines", "h", "row", "r1", "host", "t", "hit_id", "n_lines", "rank"]
AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (None, "a b c"), (None, "a b c"), (7, "x " * 3000 + "\n" + "é日𝒳 " * 500), (7, "x"), (9, "one\ntwo\none")]


def table(spark, rows, schema="doc_id long, text string"):
    """With extra columns whose names clash with results and with names used inside."""
    return spark.createDataFrame([(*r, *CLASHES) for r in rows], schema + "".join(f", {c} string" for c in CLASHES))


def words(text):
    return [w for w in re.split(SPACE, text or "") if w]


@pytest.fixture(scope="module")
def ranks():
    found = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=found, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "\x1c", "\x85", "'s", "'", "a", "the", "é", "1", "²", "#", "<|endoftext|>", "​", "日", "😀", "'ll"]), max_size=40).map("".join), st.integers(1, 9))
def test_chunked_counts_and_codes(text, size):
    library = Tokenizer.from_file(JSON) if not hasattr(test_chunked_counts_and_codes, "t") else test_chunked_counts_and_codes.t
    test_chunked_counts_and_codes.t = library
    assert token_counts.count_text(text, token_counts.compiled(JSON), size) == len(library.encode(text, add_special_tokens=False).ids)
    c = bpe.codec(RANKS, P.PATTERN)
    ids = c.encode(text, size)
    assert ids.tolist() == c.encoding.encode_ordinary(text) and c.decode(ids) == text.encode()


def test_prefix_scan_is_composition():
    t = token_counts.compiled(JSON)
    text = "It's the  end,\n\n of a text that is cut anywhere 123"
    for size in (1, 3, 5, 8):
        maps = [token_counts.state_map(text[i : i + size], t.emitted) for i in range(0, len(text), size)]
        scan = token_counts.prefix_scan(maps, t.emitted)
        assert [token_counts.closed(m, t.emitted) for m in scan] == [t.emitted(text[: size * (i + 1)]) for i in range(len(maps))]


def test_counts_come_from_the_compiled_merges():
    """Without the library: of bytes that no text holds, of merges that overlap, with caches that start afresh."""
    t = token_counts.Transducer(JSON)
    library = Tokenizer.from_file(JSON)
    draw = random.Random(2)
    for text in ["aaaaaaaaaaaaaaa", "   " * 50, "\n" * 77, "ÿþ日本語" * 9, *("".join(draw.choice("ab th ein123,.!é") for _ in range(60)) for _ in range(60))]:
        assert t.emitted(text) == len(library.encode(text, add_special_tokens=False).ids)
    assert len(t.states) > 100 and sum(n for _, n in t.moves[0].values()) == len(t.moves[0])
    for a, b in [(draw.choice(list(t.merges.bytes)), draw.choice(list(t.merges.bytes))) for _ in range(3000)]:
        assert t.merges.side_by_side(a, b) == (t.merges.encode(t.merges.bytes[a] + t.merges.bytes[b]) == [a, b])


def test_toy_merges_overlap():
    """Rules of "aaa" and crossing merges, against the definition."""
    vocabulary = {c: i for i, c in enumerate(["a", "b", "c", "aa", "ab", "aab", "bc", "abc"])}
    m = token_counts.Merges(vocabulary, ["a a", "a b", "aa b", "b c", "ab c"])
    for x in m.bytes:
        for y in m.bytes:
            if m.alone(x):
                assert m.side_by_side(x, y) == (m.encode(m.bytes[x] + m.bytes[y]) == [x, y]), (x, y)


def test_token_counts_awkward(spark):
    library = Tokenizer.from_file(JSON)
    got = token_counts.count_tokens(table(spark, AWKWARD), JSON).collect()
    expected = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in AWKWARD]
    assert sorted([tuple(r)[:3] for r in got], key=str) == sorted(expected, key=str)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert token_counts.count_tokens(table(spark, AWKWARD).limit(0), JSON).count() == 0


def test_bpe_awkward(spark, ranks):
    out = bpe.encode_digests(table(spark, AWKWARD), RANKS, P.PATTERN).collect()
    expected = []
    for i, t in AWKWARD:
        ids = ranks.encode_ordinary(t or "")
        expected.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, out), key=str) == sorted(expected, key=str)
    encoded = bpe.encode(table(spark, AWKWARD), RANKS, P.PATTERN)
    assert {bytes(r.decoded).decode() for r in bpe.decode(encoded, RANKS, P.PATTERN).collect()} == {t or "" for _, t in AWKWARD}


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_twins(spark, name):
    d = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        d.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    res = d.execute(catalog.oracle_sql()[name])
    at = {c[0]: i for i, c in enumerate(res.description)}
    assert sorted([tuple(r[at[c]] for c in cols) for r in res.fetchall()], key=str) == sorted([tuple(r[c] for c in cols) for r in df.collect()], key=str)


def test_decontamination_awkward(spark, monkeypatch):
    docs = table(spark, [*AWKWARD, (20, "A B-C a b c"), (21, "b c d e f g h i j k l m")])
    items = spark.createDataFrame([(1, "a b c"), (2, "b c d e f g h i j k l"), (3, None), (4, "?!"), (None, "m")], "item_id long, text string")
    for most in (decontamination.BROADCAST_ROWS, 0):
        monkeypatch.setattr(decontamination, "BROADCAST_ROWS", most)
        got = {(r.doc_id, r.n_words): (r.n_hit, r.n_items, r.contaminated) for r in decontamination.contamination(docs, items).collect()}
        assert got[20, 6] == (6, 1, True) and got[21, 12] == (12, 1, True) and got[None, 3] == (3, 1, True) and got[1, 0] == (0, 0, False)
        assert {r.doc_id for r in decontamination.without_contaminated(docs, items).collect()} == {1, 2, 3, 7, 9}
    assert decontamination.contamination(docs, items.limit(0)).where("contaminated").count() == 0
    assert decontamination.contamination(docs.limit(0), items).count() == 0


def near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1:
        return False
    j = 0
    while j < len(b) and a[j] == b[j]:
        j += 1
    return a[j + 1 :] == b[j + 1 :] if len(a) == len(b) else a[j + 1 :] == b[j:]


@pytest.mark.parametrize(("fuzzy", "most", "short"), [(3, 10**6, True), (2, 0, False)])
def test_line_dedup_brute_force(spark, monkeypatch, fuzzy, most, short):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", most)
    if not short:
        monkeypatch.setattr(line_dedup, "PLACE_BITS", 3)
    draw = random.Random(fuzzy)
    rows = [(i, "\n".join(" ".join(draw.choice("abc") for _ in range(draw.randint(0, 6))) for _ in range(draw.randint(0, 5)))) for i in range(80)] + [(900, None), (901, "")]
    got = {r.doc_id: (r.n_lines, r.n_kept, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), fuzzy).collect()}
    seen = []
    for i, text in rows:
        lines, kept, n = (text or "").split("\n"), [], 0
        for line in lines:
            w = words(line)
            if not w:
                kept.append(line)
                continue
            n += 1
            if w not in seen and not any(len(w) >= fuzzy and len(o) >= fuzzy and near(o, w) for o in seen):
                kept.append(line)
            seen.append(w)
        assert got[i] == (n, sum(bool(words(x)) for x in kept), None if text is None else "\n".join(kept))


def test_line_dedup_awkward(spark):
    docs = table(spark, AWKWARD)
    out = line_dedup.dedup_lines(docs).collect()
    assert len(out) == len(AWKWARD) and {r.text for r in out if r.doc_id == 9} == {"one\ntwo"}
    assert all(r[c] == c for r in out for c in CLASHES if c != "n_lines") and {r.n_lines for r in out} == {0, 1, 2, 3}
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_line_dedup_rows_that_share_a_doc_id(spark):
    rows = [(8, "a\nb"), (8, "c"), (5, "z"), (7, "x y"), (7, "z"), (10, "n\nm"), (10, "n\nm")]
    got = [tuple(r)[:4] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_lines", "n_kept", "text").collect()]
    assert got == [(8, 2, 2, "a\nb"), (8, 1, 1, "c"), (5, 1, 1, "z"), (7, 1, 1, "x y"), (7, 1, 0, ""), (10, 2, 2, "n\nm"), (10, 2, 2, "n\nm")]


def test_quality_brute_force(spark):
    rows = [*AWKWARD, (30, "a b c a b c\na b c\n#x"), (31, " ".join(f"w{i}" for i in range(60)))]
    docs = spark.createDataFrame([(i, t, None if i == 9 else "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, kept int")
    out = quality.quality(docs).collect()
    assert len(out) == len(rows)
    got = collections.Counter(tuple(r)[:7] for r in out)
    expected = collections.Counter()
    for i, t in rows:
        w = words(t)
        c = collections.Counter(zip(w, w[1:], w[2:]))
        cov = {k + x for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for x in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        expected[i, len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), len(lines) - len(set(lines)), len(cov), len(w) < 50 or 100 * len(cov) > 50 * len(w)] += 1
    assert got == expected and [r.kept for r in out if r.doc_id == 31] == [True]


def test_quality_rejects_outliers_and_merges(spark):
    text = lambda i: " ".join(f"word{(i * 7 + k) % 997}" for k in range(80))
    rows = [(i, text(i), "en", "s") for i in range(60)] + [(99, " ".join(f"w{k}###$$$" for k in range(80)), "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {r.doc_id for r in quality.quality(docs).where("not kept").collect()} == {99}
    measured = quality.measures(docs).selectExpr("*", "false as base_failed")
    a, b = measured.where("doc_id < 30"), measured.where("doc_id >= 30")
    assert sorted(map(tuple, quality.merge(quality.sketch(a), quality.sketch(b)).collect())) == sorted(map(tuple, quality.sketch(measured).collect()))


def test_quality_thresholds_follow_the_sketch(spark):
    """Ratios that are mostly zero and a narrow spread of word lengths still set the cuts."""
    draw = random.Random(5)
    text = lambda i: [f"{'abcdefgh'[: 4 + (i + k) % 2 + (draw.random() < 0.3)]}{draw.randrange(10**3):03}" for k in range(80)]
    rows = [(i, " ".join(text(i))) for i in range(600)]
    rows += [(900, " ".join([*text(0)[:60], *["##"] * 20])), (901, "\n".join([*map(" ".join, zip(*[iter(text(1))] * 8)), *["the same line"] * 5])), (902, " ".join(w + "xyz" for w in text(2)))]
    docs = spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string")
    gone = {r.doc_id for r in quality.quality(docs).where("not kept").collect()}
    assert {900, 901, 902} <= gone and len(gone) <= 12


def warc_rows():
    return [(i, f"http://h/{i}", f"<p>é{i}") for i in range(700)] + [(None, None, None)] * 2 + [(5, "http://h/5", "again")] * 3 + [(7, "u", str(k)) for k in range(300)]


def audited(spark, pages, replica):
    schema = "page_id long, url string, html string"
    out = warc.fixity(table(spark, pages, schema), table(spark, replica, schema)).collect()
    return out, collections.Counter(r.status for r in out)


def test_warc_locates_what_differs(spark):
    rows = warc_rows()
    out, status = audited(spark, rows, rows)
    assert status == {"ok": len(rows)}
    by_segment = collections.defaultdict(list)
    for r in out:
        by_segment[r.segment].append((r.seq, r.start, r.length))
    for placed in by_segment.values():  # every byte of a segment lies in one record
        placed.sort()
        assert [p[0] for p in placed] == list(range(len(placed))) and all(a[1] + a[2] == b[1] for a, b in zip(placed, placed[1:])) and placed[0][1] == 0
    _, status = audited(spark, rows, [r for r in rows if r[0] != 100])
    assert status == {"ok": len(rows) - 1, "missing": 1}
    _, status = audited(spark, rows, [r for r in rows if (r[0] or 0) < 650])
    assert status == {"ok": len(rows) - 50, "missing": 50}
    replica = [r for r in rows if r[0] != 10]
    replica[replica.index((5, "http://h/5", "again"))] = (5, "http://h/5", "other")
    replica[replica.index((7, "u", "44"))] = (7, "u", "x")
    out, status = audited(spark, rows, [*replica, (7, "u", "x"), (7, "u", "x"), (9999, "a", "b")])
    assert status == {"ok": len(rows) - 3, "corrupt": 2, "missing": 1, "extra": 3}
    assert sorted(r.page_id for r in out if r.status == "extra") == [7, 7, 9999] and {r.page_id for r in out if r.status == "corrupt"} == {5, 7}


def test_warc_empty_and_whole(spark):
    rows = warc_rows()[:20]
    assert audited(spark, [], [])[1] == {} and audited(spark, rows, [])[1] == {"missing": 20} and audited(spark, [], rows)[1] == {"extra": 20}
    pages = spark.createDataFrame([*rows, (None, None, None)], "page_id long, u string, h string")
    F = __import__("pyspark").sql.functions
    records = pages.withColumn("record", warc.record(F.col("page_id"), F.col("u"), F.col("h")))
    assert all((r.url or "") == (r.u or "") and (r.html or "") == (r.h or "") for r in warc.parse(records).collect())


def test_warc_roots_tell_offsets(spark):
    """The same bytes, cut into records elsewhere, have another root."""
    a = [(1, "u", "x" * 10), (2, "u", "y" * 4)]
    b = [(1, "u", "x" * 9), (2, "u", "y" * 5)]
    root = lambda rows: {r.root_sha256 for r in audited(spark, rows, rows)[0]}
    assert root(a) != root(b) and root(a) == root(a[::-1])


def test_simhash_brute_force(spark):
    draw = random.Random(4)
    base = [" ".join(draw.choice("abcdefgh") * draw.randint(1, 3) for _ in range(draw.randint(1, 40))) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(base + [b + " a" for b in base] + base[:5])] + [(100, None), (101, ""), (102, " \n")]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(table(spark, rows)).collect()}
    fp = {}
    for i, t in rows:
        h = simhash.shingle_hashes(t, 3)
        fp[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    root = {i: i for i in fp}
    changed = True
    while changed:
        changed = False
        for a in fp:
            for b in fp:
                if root[a] < root[b] and (fp[a] ^ fp[b]).bit_count() <= 2:
                    root[b], changed = root[a], True
    assert got == {i: (f"{fp[i]:016x}", root[i]) for i in fp}


def test_crowded_buckets_give_the_same_components(spark):
    draw = random.Random(3)
    points = {(b ^ sum(1 << draw.randrange(64) for _ in range(draw.randint(0, 3)))) & (2**64 - 1) for b in [draw.getrandbits(64) for _ in range(3)] for _ in range(80)}
    df = spark.createDataFrame([(p - 2**64 if p >> 63 else p,) for p in points], "fp long")
    classes = []
    for most in (2, 10**6):
        groups = collections.defaultdict(set)
        for r in components.components(simhash.links(df, 2, pairs_up_to=most)).collect():
            groups[r.root].add(r.node)
        classes.append(set(map(frozenset, groups.values())))
    assert classes[0] == classes[1]


def shingle_sets(texts, n):
    return [{tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} for w in map(str.split, texts)]


def one_of_each(rows, shingle, similarity=0.8):
    """doc_ids that stay, by comparing all pairs."""
    sets = shingle_sets([t.lower() for _, t in rows], shingle)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for k in range(i):
            if len(sets[i] & sets[k]) >= similarity * len(sets[i] | sets[k]) - 1e-9:
                root[find(i)] = find(k)
    best = {}
    for i, (d, _) in enumerate(rows):
        best[find(i)] = min(best.get(find(i), d), d)
    return sorted(best.values())


def gradual(draw, texts, steps, words, edits):
    rows = []
    for _ in range(texts):
        t = [f"w{draw.randrange(5000)}" for _ in range(words)]
        for _ in range(steps):
            rows.append(" ".join(t))
            for _ in range(draw.randint(0, edits)):
                at = draw.randrange(len(t))
                t = [*t[:at], *draw.choice([[], [f"w{draw.randrange(5000)}"], [t[at], f"w{draw.randrange(9)}"]]), *t[at + 1 :]]
    draw.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("most", [10**6, 0])
def test_near_dedup_is_what_all_pairs_give(spark, monkeypatch, seed, most):
    """Chains of gradual changes, whose ends don't resemble each other, stars around one text, short texts and copies."""
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", most)
    monkeypatch.setattr(near_dedup, "SPLIT", 7)
    draw = random.Random(seed)
    rows = gradual(draw, 6, 12, draw.choice([20, 80, 200]), 3)
    base = [f"w{draw.randrange(5000)}" for _ in range(150)]
    for _ in range(60):
        t = list(base)
        for _ in range(draw.randint(1, 9)):
            t[draw.randrange(150)] = f"x{draw.randrange(10**6)}"
        rows.append((len(rows), " ".join(t)))
    rows += [(len(rows) + i, " ".join(draw.choice("abc") for _ in range(draw.randint(1, 9)))) for i in range(60)]
    got = sorted(r.doc_id for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == one_of_each(rows, 5)


def test_near_dedup_awkward(spark):
    rows = [(200, "a b"), (201, "A  b"), (202, None), (203, ""), (200, "a b"), (200, "a  b"), (None, "q r"), (5, "q\tr"), (None, None), (300, "x y " * 40_000), (301, "x y " * 40_001)]
    out = near_dedup.near_dedup(table(spark, rows)).collect()
    assert sorted(r.doc_id for r in out) == [5, 200, 202, 300] and out[0].asDict().keys() == {"doc_id", "text", *CLASHES}
    assert near_dedup.near_dedup(table(spark, rows).limit(0)).count() == 0
    assert len(near_dedup.near_dedup(table(spark, [(None, "s t"), (None, "s t"), (None, "s  t")])).collect()) == 1


def test_near_dedup_finds_lone_pairs_at_the_threshold(spark):
    """Each text has one near copy, of similarity 86/106 or with a passage repeated, and no crowd around it."""
    draw = random.Random(12)
    base = [[f"w{draw.randrange(50_000)}" for _ in range(100)] for _ in range(160)]
    copies = [[*t[:20], "one", *t[21:60], "two", *t[61:]] for t in base[:150]] + [t + t[-20:] * 30 for t in base[150:]]
    rows = [(i, " ".join(t)) for i, t in enumerate(base + copies)]
    sets = shingle_sets([t for _, t in rows], 5)
    assert all(len(sets[i] & sets[i + 160]) >= 0.8 * len(sets[i] | sets[i + 160]) for i in range(160))
    assert sorted(r.doc_id for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == list(range(160))


def test_rest_pairs_dont_pair_a_template_all_with_all(spark):
    """200 texts of 120 common and 80 own words each, as many components: no two are similar."""
    common = [f"c{i}" for i in range(120)]
    rows = [(i, " ".join(common + [f"w{i}_{j}" for j in range(80)])) for i in range(200)]
    read = near_dedup.read(spark.createDataFrame(rows, "doc_id long, text string"), 5, 0.8).cache()
    shared = near_dedup.shared_tokens(read.select("key", "n", "tokens"))
    none = spark.createDataFrame([], "key binary, root binary")
    assert near_dedup.rest_pairs(shared, none, 0.8).count() == 0 and near_dedup.star_pairs(shared, 0.8).count() == 0


def test_prefixes_follow_the_counts_of_all_texts(spark):
    """24,000 texts of 20 own words each; two and two share six words, whose shingles no prefix needs."""
    own = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.concat_ws("_", F.lit("w"), "doc_id", i)), " ")
    pair = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.concat_ws("_", F.lit("p"), F.expr("doc_id div 2"), i)), " ")
    docs = spark.range(24_000).withColumnRenamed("id", "doc_id").withColumn("text", F.concat_ws(" ", own, pair))
    read = near_dedup.read(docs, 5, 0.8)
    assert near_dedup.shared_tokens(read.select("key", "n", "tokens")).count() == 0


def test_shingle_levels(spark):
    """Levels are of the texts that hold a bucket's shingles, whatever the sizes of counts; null and empty texts have none."""
    texts = [None, "", *["a b c d e a b c d e"] * 300, *[f"k{i} l m n o p q" for i in range(70)]]
    levels = near_dedup.shingle_levels(spark.createDataFrame([(t,) for t in texts], "text string"), 5)
    counts = np.zeros(1 << near_dedup.BUCKET_BITS, np.int64)
    for t in texts:
        for h in set(simhash.shingle_hashes(t, 5)):
            counts[h >> (64 - near_dedup.BUCKET_BITS)] += 1
    assert np.array_equal(levels, np.minimum(8 * np.log2(1 + counts), 255).astype(np.uint8)) and counts.max() == 300
    assert not near_dedup.shingle_levels(spark.createDataFrame([], "text string"), 5).any()


@pytest.mark.parametrize(("window", "batches"), [(8, None), (13, 6), (20, 2)])
def test_substring_brute_force(spark, monkeypatch, window, batches):
    draw = random.Random(window)
    rows = [(i, " ".join(draw.choice("ab") for _ in range(draw.randint(0, 60)))) for i in range(60)] + AWKWARD
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    parts = [docs.where(f"pmod(xxhash64(doc_id, text), {batches}) = {i}") for i in range(batches)] if batches else None
    monkeypatch.setattr(substring, "FAN_IN", 2)
    got = sorted(map(tuple, substring.remove_repeats(docs, window, parts).collect()), key=str)
    count, expected = collections.Counter(), []
    for _, t in rows:
        w = words(t)
        count.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    for i, t in rows:
        w = words(t)
        gone = {k + x for k in range(len(w) - window + 1) if count[tuple(w[k : k + window])] > 1 for x in range(window)}
        expected.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert got == sorted(expected, key=str)


def test_toxicity_held_out(spark):
    draw = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        w = [f"{draw.choice(['lan', 'mer', 'tol', 'sup'])}{draw.choice(['a', 'en', 'is', 'o'])}" for _ in range(80)]
        toxic = i % 4 == 0
        for k in range(3 * toxic):
            w[draw.randrange(80)] = f"vile{draw.choice(['a', 'en', 'is'])}"
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (None, None), (1000, "")], "doc_id long, text string")
    out = toxicity.scored(docs, spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")).collect()
    assert len(out) == 602 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    held = [r for r in out if r.doc_id is not None and r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.held_out for r in held) and sum(r.predicted == dict(labels)[r.doc_id] for r in held) >= 0.97 * len(held)
    nothing = toxicity.scored(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert {r.score for r in nothing} == {0.0}


def models_of(spark, rows, docs=None):
    """rows: text, toxic."""
    df = spark.createDataFrame(rows, "text string, toxic int")
    counts = near_dedup.shared_table(toxicity.class_counts(df), "test-counts")
    return toxicity.kneser_ney(counts, df if docs is None else spark.createDataFrame(docs, "text string"))


def test_toxicity_is_kneser_ney(spark):
    """Against dictionaries: class counts of the labelled texts, backoff counts of all texts."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcd") for _ in range(draw.randint(1, 11)))
    texts = [" ".join(word() for _ in range(30)) for _ in range(40)]
    rows = [(t, i % 2) for i, t in enumerate(texts[:20])]
    models = models_of(spark, rows, [(t,) for t in texts])
    D, S, K = toxicity.DISCOUNT, toxicity.SHARED, toxicity.CONTEXT

    def steps(text):
        for w in text.split():
            t = "<" + w + ">"
            for i in range(1, len(t)):
                yield t[max(0, i - K) : i], t[i]

    n = [collections.Counter(x for t, y in rows if y == c for x in steps(t)) for c in (0, 1)]
    stood = [collections.Counter() for _ in n]
    for c in (0, 1):
        for (given, _), k in n[c].items():
            stood[c][given] += k
    known = set(n[0]) | set(n[1])
    every = collections.Counter(x for t in texts for x in steps(t))
    all_stood = collections.Counter()
    for (given, _), k in every.items():
        all_stood[given] += k
    follows = collections.Counter((given[-2:], x) for given, x in known)
    after = collections.Counter()
    for (two, _), k in follows.items():
        after[two] += k
    kinds = collections.Counter(two for two, _ in follows)

    def q(c, given, x):
        lower = (follows[given[-2:], x] + 1) / (after[given[-2:]] + kinds[given[-2:]] + 1)
        left = all_stood[given] - sum(max(every[g] - D, 0) for g in known if g[0] == given)
        shared = (max(every[given, x] - D, 0) + left * lower) / all_stood[given]
        own_left = stood[c][given] - sum(max(n[c][g] - D, 0) for g in known if g[0] == given)
        return (max(n[c][given, x] - D, 0) + (own_left + S) * shared) / (stood[c][given] + S)

    contexts = {g for g, _ in known}

    def of_word(w):
        out = 0.0
        for given, x in steps(w):
            if (given, x) in known:
                out += np.log(q(1, given, x)) - np.log(q(0, given, x))
            elif given in contexts:
                u = [(stood[c][given] - sum(max(n[c][g] - D, 0) for g in known if g[0] == given) + S) / (stood[c][given] + S) for c in (0, 1)]
                out += np.log(u[1]) - np.log(u[0])
        return out

    asked = [word() for _ in range(100)] + texts[0].split()
    assert np.allclose(models.of_words(asked), [of_word(w) for w in asked], atol=1e-4)


def test_toxicity_counts_grow_with_all_documents(spark):
    """Backoff counts of unlabelled texts change what a rare expression tells."""
    rows = [("plain words " + ("vile" if i < 3 else "kind"), int(i < 3)) for i in range(6)]
    few, many = models_of(spark, rows), models_of(spark, rows, [(t,) for t, _ in rows] + [("vilify villa vilnius",)] * 50)
    assert few.of_words(["vile"])[0] > 0 and abs(few.of_words(["vile"])[0] - many.of_words(["vile"])[0]) > 1e-3


def test_toxicity_keeps_rare_beginnings(spark):
    """Two expressions, which seven texts of either class hold once each, tell the classes apart."""
    rows = [(" ".join(f"plain{c}" for c in "abcdefgh") + ([" kind", " vile"][i % 2] if i < 14 else ""), i % 2) for i in range(60)]
    vile, kind, plain = models_of(spark, rows).of_words(["vile", "kind", "plaina"])
    assert vile > 1 > -1 > kind and abs(plain) < 0.5


def test_toxicity_reads_whole_words(spark):
    """Words that share seven characters, joined words, and clauses without spaces are told apart by what follows."""
    vile, fine = "consternvile _vilest_ 今日は天気悪党", "consternfine _finest_ 今日は天気良好"
    models = models_of(spark, [(vile if i < 30 else fine, int(i < 30)) for i in range(60)])
    assert toxicity.words_of("a_b 今日は c1") == ["a", "b", "今日", "日は", "c1"]
    for a, b in (("consternvile", "consternfine"), ("x_vilest", "x_finest"), ("明日も天気悪党", "明日も天気良好")):
        assert models.differences([a])[0, 0] > 0 > models.differences([b])[0, 0]


def test_toxicity_awkward(spark, monkeypatch):
    """Very long texts, repeated rows, clashing columns and caches that start afresh."""
    rows = [(i, ("good plain text here " if i % 2 else "vile text here ") * 30) for i in range(80)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(80)], "doc_id long, toxic int")
    docs = table(spark, [*rows, *AWKWARD, (500, "vile " * 60_000), (501, "vile text here " * 30), (501, "vile text here " * 30)])
    first = sorted(map(tuple, toxicity.scored(docs, labels).collect()), key=str)
    assert len(first) == 83 + len(AWKWARD) and {r[3] for r in first if r[0] in (500, 501)} == {1}
    monkeypatch.setattr(toxicity, "MOST_WORDS", 2)
    monkeypatch.setattr(toxicity, "SPELLED_AT_ONCE", 5)
    assert sorted(map(tuple, toxicity.scored(docs, labels).collect()), key=str) == first
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r[3] == 0 for r in first)
    assert toxicity.scored(docs.limit(0), labels).count() == 0 and toxicity.without_toxic(docs.limit(0), labels.limit(0)).count() == 0


def test_url_rules_and_templates(spark):
    urls = [None, "no host", "HTTP://Www.Example.com/en/1", "http://a.example.com/en/1?x", "http://x.net/es/2", "http://x.com#f", "://h", "http://x.net/es"]
    out = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [(out[i].host, out[i].path, out[i].rule, out[i].verdict) for i in range(8)] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("www.example.com", "/en/1", "www.example.com/en/", "allow"), ("a.example.com", "/en/1", "example.com/en/", "block"),
        ("x.net", "/es/2", "net/es/", "block"), ("x.com", "", None, "allow"), ("h", "", None, "allow"), ("x.net", "/es", None, "allow"),
    ]
    pages = table(spark, [(i, f"http://h.org/{'spam' if i % 2 else 'fine'}/{i}.html") for i in range(200)], "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 200, 3)], "page_id long, label int")
    assert {r.page_id % 2 for r in url_filter.judge(pages, [], labels).where("verdict = 'block'").collect()} == {1}
    assert url_filter.judge(pages.limit(0)).count() == 0 and url_filter.judge(pages.unionByName(pages)).count() == 400


def test_url_branches_are_merged(spark):
    """Slugs without a label are judged by their like; a branch of another shape stands alone, at any depth."""
    deep = "a/b/c/d/e/f"
    urls = [f"http://h.org/{deep}/slug-{chr(97 + i)}/{k}.html" for i in range(20) for k in range(6)]
    urls += [f"http://h.org/{deep}/help/page/{k}/about" for k in range(60)] + [f"http://h.org/{deep}/good/{k}/about/us" for k in range(60)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(i, 0) for i in range(180, 240)], "page_id long, label int")
    blocked = {r.page_id for r in url_filter.judge(pages, [], labels).where("verdict = 'block'").collect()}
    assert blocked == set(range(120))


def test_registered_urls_without_a_rule_are_judged(spark):
    out = catalog.queries()["op10_url_filter"](spark, SF.replace("0.001", "0.01"))
    assert out.where("rule is null and verdict = 'block'").count() > 0 and out.where("rule is null and verdict = 'allow'").count() > 0


@pytest.mark.parametrize("name", ["op1", "op2", "op4", "op6", "op7", "op8"])
def test_empty_and_clashing(spark, name):
    """No rows give no rows; repeated rows, nulls and clashing columns keep a row each."""
    extra = [c for c in CLASHES if c not in ("source", "lang")]
    F = __import__("pyspark").sql.functions
    docs = table(spark, [*AWKWARD, (400, "long words " * 30_000)]).withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string")})
    run = {
        "op1": lambda d: token_counts.count_tokens(d, JSON),
        "op2": lambda d: decontamination.contamination(d, spark.createDataFrame([(1, "a b c")], "item_id long, text string")),
        "op4": quality.quality,
        "op6": simhash.near_duplicates,
        "op7": substring.remove_repeats,
        "op8": lambda d: bpe.encode(d, RANKS, P.PATTERN),
    }[name]
    out = run(docs)
    assert out.count() == len(AWKWARD) + 1 and run(docs.limit(0)).count() == 0 and len(set(out.columns)) == len(out.columns) and extra


def test_stages_pass_clashing_columns(spark):
    docs = table(spark, [*AWKWARD, (500, "alpha beta gamma delta"), (501, "other words of some document")])
    items = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    out = decontamination.without_contaminated(docs, items)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {1, 2, 3, None, 7, 9, 501}


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.shared_table(stage(spark, docs, SF), name)
        assert 0.5 * before < docs.count() <= before
        assert name == "byte_bpe" or docs.columns == names
    assert all(r.n_tokens == len(r.ids) for r in docs.collect())
