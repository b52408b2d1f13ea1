"""Registered queries against their SQL twins on the smallest tables, and unit cases."""

import duckdb
import pytest
from pyspark.sql import functions as F

from corvid.functions import distance, strict, titles, versions
from corvid.functions import text as T
from corvid.operators import evaluate, examples, graph, organize, pages, search, speller
from corvid.operators import index as I
from corvid.operators import rankers as R
from corvid.plans import catalog
from corvid.sources import files, html
from corvid.streaming import crawl

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"shingle_overlap", "mrr_ndcg"}


@pytest.fixture(scope="module")
def duck():
    d = duckdb.connect()
    for t in TABLES:
        d.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return d


def norm(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    return round(float(v), 6)


@pytest.mark.parametrize("name", sorted(set(catalog.oracle_sql()) - SLOW))
def test_twin(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted([tuple(norm(r[c]) for c in cols) for r in df.collect()], key=str)
    res = duck.execute(catalog.oracle_sql()[name])
    at = {c[0]: i for i, c in enumerate(res.description)}
    assert sorted([tuple(norm(r[at[c]]) for c in cols) for r in res.fetchall()], key=str) == got


def test_exact_names_beyond_the_candidates(spark, tmp_path):
    rows = [(i, "one name" if i % 2 else "two names", f"Brand#{i % 25}") for i in range(2 * R.CANDIDATES + 100)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(tuple(r) for r in catalog.queries()["name_exact"](spark, str(tmp_path)).select("id", "name", "rank").collect())
    d = duckdb.connect()
    d.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert got == sorted(d.execute(catalog.oracle_sql()["name_exact"]).fetchall()) and len(got) == R.CANDIDATES + 50


def test_names(spark):
    cases = {"Vec<T>": "vec", "std::vec::Vec": "std.vec.vec", "Path()": "path", "read csv": "read_csv", "(*Builder).WriteString": "builder.writestring", "std::map<K,V>": "std.map", "List[T].append": "list.append", "&str": "str", "@property": "property",
             "#define": "define", "operator()": "operator()", "( + )": "(+)", "np.sum": "numpy.sum", "vec!": "vec!", "nn.Linear": "torch.nn.linear", "  ": None, "np": "np"}
    rows = spark.createDataFrame([(q,) for q in cases], "q string").select("q", T.name_key(F.col("q")).alias("k")).collect()
    assert {r.q: r.k for r in rows} == cases
    keys = spark.createDataFrame([("std::println!",), ("git commit --amend (command)",)], "t string").select(T.api_keys(F.col("t")).alias("k")).collect()
    assert set(keys[0].k) == {"std.println!", "println!", "std.println", "println"} and set(keys[1].k) == {"git commit --amend", "git_commit_--amend"}


def test_distance():
    assert distance.osa("ca", "abc", 3) == 3 and distance.osa("ab", "ba", 2) == 1 and distance.osa("abcd", "a", 2) == 3
    assert distance.subsequence("np", "numpy") > 0 and distance.subsequence("xz", "numpy") == -1
    assert round(distance.subsequence("fb", "fooBar"), 2) == 45.94
    assert distance.indel_ratio("kitten", "sitting") == 200 * 4 / 13 and distance.indel_ratio("", "") == 100
    assert distance.common_length("ABCBDAB", "BDCABA") == 4 and distance.partial_ratio("abc", "xxabcxx") == 100
    assert distance.wratio("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == 95 and distance.wratio("", "a") == 0 and distance.wratio("same", "same") == 100


def test_fuse_ties(spark):
    one = spark.createDataFrame([(0, 1, 1), (0, 2, 2)], "qid int, id int, rank int")
    two = spark.createDataFrame([(0, 3, 1), (0, 2, 2)], "qid int, id int, rank int")
    assert [r.id for r in R.fuse([("a", 1.0, one), ("b", 1.0, two)]).orderBy("rank").collect()] == [2, 1, 3]


def test_reachable_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6)], "src long, dst long")
    got = graph.reachable(spark.createDataFrame([(1,)], "id long"), edges).collect()
    assert {(r.id, r.depth) for r in got} == {(1, 0), (2, 1), (3, 2)}


def test_html():
    page = html.read("<title>T</title><nav><a href=x>m</a></nav><script>'</p>'</script><h1>A</h1><p>one<p>two <a href='y'>l</a><h2>B</h2>three")
    assert [s[1] for s in page.sections] == ["", "A", "B"]
    assert html._tidy(page.sections[1][2]) == "one\ntwo l" and page.links == [("x", "m", True), ("y", "l", False)]
    html.read("<div>" * 6000 + "deep")


def test_resumed_rounds_equal_uninterrupted(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}") for i in range(20)], "page_id long, url string")
    pages.repartition(4).write.parquet(str(tmp_path / "in"))
    run = lambda: crawl.rounds(spark, str(tmp_path / "in"), "page_id long, url string", "page_id", str(tmp_path / "state"), str(tmp_path / "out"))
    assert run().count() == 20
    spark.createDataFrame([(99, "late")], "page_id long, url string").write.mode("append").parquet(str(tmp_path / "in"))
    assert run().count() == 21


def test_entry_imports_without_llm():
    import __spark_entry__

    assert "bm25_topk" in __spark_entry__.queries()


def test_cosine_batch_blocks(spark, monkeypatch):
    """Every vec_id divisible by 20 is a query, whatever the size of a block."""
    found = []
    for block in (7, 4_096):
        monkeypatch.setattr(catalog, "BLOCK", block)
        found.append(sorted(map(tuple, catalog.queries()["cosine_batch_topk"](spark, SF).collect())))
    expected = {r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 20 = 0").collect()}
    assert found[0] == found[1] and {r[0] for r in found[0]} == expected


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_snippet(spark):
    text = "First one here. The words of a query stand here! " + "x" * 200 + " query words y."
    cut = lambda t, q: one(spark, T.snippet(F.col("t"), F.col("q")), t=t, q=q)
    assert cut(text, "query words") == "The words of a query stand here!" and cut("", "a") == ""
    long = cut("a " * 100 + "needle" + " b" * 100, "needle")
    assert long.startswith("…") and "needle" in long and long.endswith("…") and len(long) <= 172


def test_strict(spark):
    assert strict.parse('pandas "keep=" first /^a.b$/ cpp/x/y') == ("pandas first cpp/x/y", ["keep="], ["^a.b$"])
    assert one(spark, strict.parsed(F.col("q"))["phrases"], q='a "b c" "d"') == ["b c", "d"]
    e = spark.createDataFrame([(1, "sum", "the cumsum", True), (2, "b.sum (method)", "x", True), (3, "page", "a  Sum\nof", False), (4, "p", "sum_x", False)], "id long, title string, text string, is_api boolean")
    ids = lambda q: sorted(r.id for r in strict.matching(e, strict.parse(q)).collect())
    assert ids('"sum"') == [1, 2, 3] and ids('"Sum of"') == [3] and ids("/sum$/") == [1, 2]
    with pytest.raises(ValueError):
        strict.matching(e, strict.parse("/(/"))


def test_versions(spark):
    for mark, than, newer in [("C++20", "C++17", True), ("3.13", "3.12.4", True), ("2.0", "2.0.1", False), ("C11", "C++98", False), ("C++98", "C++11", False), ("C++20", "3", False), ("x", "1", False)]:
        assert one(spark, versions.newer(F.col("a"), F.col("b")), a=mark, b=than) is newer, (mark, than)
    for ref, release in [("v2.5.0", "2.5.0"), ("py-2.0.0", "2.0.0"), ("main", ""), ("0123abc", "")]:
        assert one(spark, versions.release_of(F.col("r")), r=ref) == release
    marks = lambda t: one(spark, versions.entry_marks(F.col("t")), t=t)
    assert tuple(marks("New in version 3.8.\nDeprecated since version 3.9: the *x* parameter.\nRemoved in version 4.0.")) == ("3.8", "4.0", None)
    assert tuple(marks("Added in version 3.9: the *x* parameter.")) == (None, None, None)
    table = "| ```cpp void f();``` (since C++11) (until C++17) |\n| ```cpp int f();``` (since C++17) |\n\ntext"
    assert tuple(one(spark, versions.declaration_marks(F.col("t"), "C++"), t=table)) == ("C++11", None, None)
    assert one(spark, versions.standard_text(F.col("t"), "C++", 2017), t=table) == "| ```cpp int f();``` (since C++17) |\n\ntext"
    m = F.struct(F.lit("3.9").alias("since"), F.lit(None).cast("string").alias("removed"), F.lit("3.5").alias("deprecated"))
    assert one(spark, versions.flags(m, F.col("p")), p="3.7") == ["newer", "deprecated"]


def test_titles(spark):
    cases = {"NumPy 2.5.0 Release Notes": "removed", "2.1. Intro to CUDA": "learn", "Logging HOWTO": "do", "Glossary": "lookup", "What is life (page)": "understand", "Some thing": None, "API reference": "lookup"}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", titles.label_of(F.col("t"), F.array(F.lit("numpy"))).alias("l")).collect()
    assert {r.t: r.l for r in rows} == cases
    assert one(spark, titles.label_of(F.col("t"), F.array(F.lit("x")), False), t="API reference") is None
    assert one(spark, titles.links_only(F.col("t")), t="## Next\n- [a](b)\n- [c](d): more\n") is True and one(spark, titles.links_only(F.col("t")), t="- [a](b)\ntext\ntext\ntext") is False


def test_scalars(spark):
    assert one(spark, T.import_line(F.col("n"), F.col("k")), n="a.B.c", k="method") == "from a import B" and one(spark, T.import_line(F.col("n"), F.col("k")), n="a.b", k="module") == "import a.b"
    assert one(spark, T.image_type(F.col("d")), d=bytearray(b"GIF89a...")) == "image/gif" and one(spark, T.image_type(F.col("d")), d=bytearray(b"  <svg>")) == "image/svg+xml" and one(spark, T.image_type(F.col("d")), d=bytearray(b"x")) is None
    assert one(spark, T.moved(F.col("u"), F.col("r"), F.col("b")), u="https://a.x.com/docs/p", r="https://new.x.com/docs/p", b="https://a.x.com/docs/") == "https://new.x.com/docs/"
    assert one(spark, T.below(F.col("p"), F.col("c")), p="a/index.html", c="a/b.html") is True and one(spark, T.rel_of(F.col("u"), F.col("r")), u="https://x/d/?q", r="https://x/d/") == "index.html"
    assert one(spark, T.channel_of(F.col("s")), s="max@nightly-2026-10-09") == "nightly" and one(spark, T.channel_of(F.col("s")), s="numpy@2.5") is None
    order = pages.newest_first(spark.createDataFrame([("n@2.10",), ("n@2.9",), ("n@3.0-beta",), ("m",)], "sid string")).orderBy("package", "place").collect()
    assert [r.sid for r in order] == ["m", "n@2.10", "n@2.9", "n@3.0-beta"]
    c = spark.createDataFrame([("a", 95, 5, 0, 0, 10, 10), ("b", 94, 6, 0, 0, 10, 10), ("c", 30, 0, 40, 30, 9, 9), ("d", 5, 0, 0, 0, 6, 10)], "sid string, pages int, failed int, listed int, read int, entries int, old int")
    assert {r.sid: r.replace for r in pages.coverage(c).collect()} == {"a": True, "b": False, "c": False, "d": False}


def corpus(spark):
    rows = [(1, "numpy.sum (function)", "function", "Add up values.", "a", "lookup"), (2, "numpy.ma.sum (function)", "function", "Masked.", "a", "lookup"), (3, "torch.nn.Linear (class)", "class", "A layer.", "b", "lookup"),
            (4, "numpy.sum", "page", "the page of sum", "a", "lookup"), (5, "Adding things", "page", "How to sum a list of values.", "a", "do"), (6, "Optional chaining (?.)", "page", "with ?. in it", "b", "understand"), (7, "A ?. B › part", "section", "x", "b", "")]
    return search.Corpus(spark.createDataFrame(rows, "id long, title string, kind string, text string, source string, purpose string"))


def test_search(spark):
    c = corpus(spark)
    q = spark.createDataFrame([(0, "np.sum"), (1, "torch.nn.Lienar"), (2, "?."), (3, "sum values")], "qid int, q string")
    found = {}
    for r in search.as_typed(c, q).orderBy("qid", "rank").collect():
        found.setdefault(r.qid, []).append(r.id)
    assert found[0][0] == 1 and found[1][0] == 3 and found[2] == [6, 7] and 4 not in found[0] + found[3] and set(found[3]) >= {1, 5}
    how = search.search(c, spark.createDataFrame([(0, "sum values")], "qid int, q string"), mode="how")
    assert how.orderBy("rank").first().id in (1, 5) and {r.id for r in how.collect()} >= {1, 5}
    strictly = [r.id for r in search.strict_search(c, '"sum" list').orderBy("rank").collect()]
    assert sorted(strictly) == [1, 2, 4, 5] and strictly[-1] == 4
    assert [r.id for r in search.browse(c).where("source = 'a'").orderBy("place").collect()] == [5, 1, 2, 4]
    hits = spark.createDataFrame([(0, i, i) for i in range(1, 6)], "qid int, id long, rank int")
    scores = spark.createDataFrame([(0, 1, 0.1), (0, 2, 0.9), (0, 3, 0.5)], "qid int, id long, model double")
    assert [r.id for r in search.rerank(hits, scores, spark.createDataFrame([(0, 3)], "qid int, id long"), 3).orderBy("rank").collect()] == [3, 2, 1, 4, 5]
    same = spark.createDataFrame([(1, "x", "a", "p", "f1"), (2, "x", "a", "p", "f2"), (3, "y", "a", "p", "f")], "id long, name string, source string, page string, folder string")
    assert {r.id: r.place for r in search.where_from(same, ["page", "folder"]).collect()} == {1: "f1", 2: "f2"}


def test_stored_index_gives_the_same(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    e = I.entries(docs)
    index = I.build(e, docs)
    q = spark.createDataFrame([(0, catalog.QUERY), (1, "nothing of this zzz")], "qid int, q string")
    assert sorted(map(tuple, R.bm25_stored(index, q).collect())) == sorted(map(tuple, R.bm25(e, q).collect())) and index.fits(docs)


def test_speller(spark):
    words = ["concatenate", "duplicates", "argument", "arguments", "merge", "values", "frame"]
    df = spark.createDataFrame([(w, 10 + i) for i, w in enumerate(words)], "term string, df long")
    q = spark.createDataFrame([(0, "concatinate the Arguement!"), (1, "merge")], "qid int, q string")
    unknown = speller.unknown_words(q, df)
    best = speller.suggestions(unknown, speller.vocabulary(df))
    first = {r.typed: r.word for r in best.where("rank = 1").collect()}
    assert first["concatinate"] == "concatenate" and first["arguement"] == "argument"
    assert [r.q for r in speller.corrected(q, best.where("typed != 'the'")).orderBy("qid").collect()][0].endswith("argument!")
    assert speller.match_rating("smith") == "SMTH" and speller.nysiis("knight")[0] == "N" and speller.metaphone("phone") == speller.metaphone("fone")


def test_evaluation(spark):
    q = spark.createDataFrame([(i, float(i % 3 == 0)) for i in range(60)], "qid int, mrr double")
    low, high = evaluate.bootstrap_ci(q, "mrr", 500)
    assert low < 1 / 3 < high and evaluate.bootstrap_ci(q, "mrr", 500) == (low, high)
    better = q.withColumn("mrr", F.least(F.lit(1.0), F.col("mrr") + 0.5))
    assert evaluate.paired_p(q, better, "mrr", 500) < 0.01 and evaluate.paired_p(q, q, "mrr", 200) == 1.0
    assert "| a |" in evaluate.report({"a": q, "b": better}, "a", "t", 100)
    e = spark.createDataFrame([(1, "s", "https://x/a.html"), (2, "s", "https://x/a.html#f"), (3, "s", "https://x/a.html#g"), (4, "s", "https://x/new/m.html"), (5, "s", "https://x/o.html#h")], "id long, sid string, location string")
    links = spark.createDataFrame([(0, "s", "https://x/a.html", "f"), (1, "s", "https://x/a.html", ""), (2, "s", "https://x/old/m.html", ""), (3, "s", "https://x/a.html", "h")], "qid int, sid string, page string, anchor string")
    got = {(r.qid, r.id): r.grade for r in evaluate.gold(links, e).collect()}
    assert got == {(0, 1): 1, (0, 2): 2, (0, 3): 1, (1, 1): 2, (1, 2): 1, (1, 3): 1, (2, 4): 2, (3, 1): 1, (3, 2): 1, (3, 3): 1, (3, 5): 2}


def test_organising(spark):
    p = spark.createDataFrame([("index.html", "Docs", True), ("user/index.html", "User guide", True), ("user/x.html", "About x", False), ("whatsnew/index.html", "Release notes", True), ("whatsnew/1.html", "v1", False), ("api/y.html", "y", False)], "page string, title string, starts boolean")
    up = spark.createDataFrame([("user/x.html", "user/index.html"), ("whatsnew/1.html", "whatsnew/index.html"), ("user/index.html", "index.html")], "page string, parent string")
    assert {r.page: r.purpose for r in organize.purposes(p, up, ["proj"]).collect()} == {"index.html": "lookup", "user/index.html": "do", "user/x.html": "do", "whatsnew/index.html": "removed", "whatsnew/1.html": "removed", "api/y.html": "lookup"}
    api = spark.createDataFrame([("whatsnew/1.html",)], "page string")
    assert {r.page for r in organize.unread(p, api, ["proj"]).collect()} == {"whatsnew/index.html"}
    e = spark.createDataFrame([(1, "p", "page", "f", "# f\nreturns a thing"), (2, "p", "section", "f › Returns", "## Returns\nreturns a thing"), (3, "p", "label", "f (section)", "z"), (4, "p", "section", "g", "t"), (5, "p", "section", "g", "t"), (6, "q", "doc", "n.f (page)", "u"), (7, "q", "function", "n.f (function)", "v")], "id long, page string, kind string, title string, text string")
    assert {r.id: r.why for r in organize.folded(e).collect()} == {2: "part", 3: "label", 5: "twin", 6: "object"}
    tree = spark.createDataFrame([("s", x) for x in ("a", "b", "c", "d", "e/f2", "e/f10")], "site string, page string")
    edges = spark.createDataFrame([("s", "a", "c", 1), ("s", "a", "b", 2), ("s", "c", "a", 1)], "site string, src string, dst string, pos int")
    order = graph.reading_order(tree, edges, spark.createDataFrame([("s", "a", 1), ("s", "d", 2)], "site string, page string, pos int")).orderBy("place").collect()
    assert [r.page for r in order] == ["a", "c", "b", "d", "e/f2", "e/f10"]


def test_far_labels_and_circles(spark):
    n = spark.createDataFrame([(i, "top" if i == 0 else None) for i in range(40)] + [(100, None), (101, None)], "id long, label string")
    up = spark.createDataFrame([(i, i - 1) for i in range(1, 40)] + [(100, 101), (101, 100)], "id long, parent long")
    got = {r.id: (r.label, r.steps) for r in graph.nearest_label(n, up).collect()}
    assert got[39] == ("top", 39) and len(got) == 40


def test_sources(spark, tmp_path):
    import zlib

    inv = b"# Sphinx inventory version 2\n# Project: p\n# Version: 0.0.0\n# x\n" + zlib.compress(b"p.f py:function 1 api.html#$ -\nidx std:label -1 api.html#p.f Title here\nanon std:label -1 z.html anon\nbad\n")
    objects = files.inventories(spark.createDataFrame([("i", bytearray(inv))], "path string, content binary"))
    assert [(r.name, r.uri, r.version) for r in objects.orderBy("n").collect()] == [("p.f", "api.html#p.f", ""), ("idx", "api.html#p.f", ""), ("anon", "z.html", "")]
    assert [r.title for r in files.documented(objects).collect()] == ["p.f (function)"]
    maps = spark.createDataFrame([("s", bytearray(b"<loc>t.xml</loc><loc> https://x/a </loc>")), ("t.xml", bytearray(b"<loc>https://x/b</loc><loc>https://y/c</loc><loc>s.xml</loc>"))], "url string, content binary")
    assert {r.url for r in files.all_sitemaps(maps, "s", ["https://x/"]).collect()} == {"https://x/a", "https://x/b"}
    lists = [("https://x/llms.txt", "# T\n## One\n[a](https://x/a.md) [Sec / Sub (3 pages)](https://x/_llms/s.txt)\n### Two\n[d](https://x/d.json) [b](/b)"), ("https://x/_llms/s.txt", "## Sub\n[c](https://x/c) [a](https://x/a)")]
    got = {r.page: (r.markdown, r.crumbs) for r in files.all_page_lists(spark.createDataFrame(lists, "url string, content string"), "https://x/llms.txt").collect()}
    assert got == {"https://x/a": ("https://x/a.md", ["One"]), "https://x/b": (None, ["One", "Two"]), "https://x/c": (None, ["Sec", "Sub"])}
    index = spark.createDataFrame([("https://x/", '{"docs":[{"location":"a/","title":"A","path":["P","A"]},{"location":"a/#s"}]}')], "root string, content string")
    assert [tuple(r) for r in files.search_index(index).collect()] == [("https://x/a/", ["P"])]
    assert files.read_toctree("- sections:\n  - local: q\n    title: Quick\n  - sections:\n    - local: r\n    title: Deep\n  title: Start\n") == [(["Start"], "q"), (["Start", "Deep"], "r")]
    md = files.read_markdown("https://x/p", "---\na: b\n---\n# T\n## A[[pkg.A]]\ntext\n```\n## no\n```\n## B\none\n### B\ntwo")
    assert [(t, k, at.partition("#")[2]) for t, k, at, _ in md] == [("T", "page", ""), ("pkg.A", "api", "pkg.A"), ("T › B", "section", "b"), ("T › B", "section", "b-1")]
    tags = b"<tagfile><compound kind='group'><name>g</name><member kind='function'><type>int</type><name>f</name><anchorfile>p.html</anchorfile><anchor>a1</anchor><arglist>(int)</arglist></member></compound><compound kind='namespace'><name>cv</name><member kind='function'><type>int</type><name>f</name><anchorfile>p.html</anchorfile><anchor>a1</anchor><arglist>(int)</arglist></member></compound><compound kind='class'><name>cv::M</name><filename>m</filename></compound></tagfile>"
    assert sorted(files.read_tags(tags)) == [("m.html", "", "cv::M", "class", ""), ("p.html", "a1", "cv::f", "function", "int cv::f(int)")]
    man = "LS(1)      User      LS(1)\n\nNAME\n       ls - list\n\nOPTIONS\n       -a, --all\n              every one\n\n       -b\n              bytes\n\nSEE ALSO\n       cp(1)\n"
    assert [t for t, _ in files.read_man("ls", man)] == ["ls › Name", "ls › Options › -a, --all", "ls › Options › -b", "ls › See also"] and files.read_man("x", "text") == []
    assert [len(c) for c in files.paragraphs(["a" * 30, "", "b" * 30, "", "c"], 40)] == [2, 4]
    project = spark.createDataFrame([("p", 0, "requirements.txt", "Num_py[x]==1.2\nb >= 3"), ("p", 1, "uv.lock", '[[package]]\nname = "num-py"\nversion = "9"\n[[package]]\nname = "c"\nversion = "4.0"\n'), ("p", 1, "go.mod", "go 1.22")], "project string, folder int, file string, content string")
    assert {r.name: r.version for r in files.project_versions(project).collect()} == {"num-py": "1.2", "c": "4.0", "go": "1.22"}
    rows = spark.createDataFrame([("t\x1b", "page", "l", "text\x00 of it", "s", None)], files.ENTRY)
    files.save(rows, str(tmp_path / "e"))
    assert [tuple(r) for r in files.entries(spark, str(tmp_path / "e"), 4).collect()] == [("t", "page", "l", "text", "s", "")]


def test_examples(spark):
    assert examples.needs("```python\nimport x\ny = x.f()\nprint(y)\n```") == [] and examples.needs("no code") is None
    assert examples.needs("```\n>>> np.sum(a)\n3\n```", name="numpy.sum") == ["a (from earlier)", "import numpy as np"]
    assert examples.needs("```cpp\n#include <x>\nint f();\n```") == ["a main function"]
    e = spark.createDataFrame([(1, "n.f (function)", "function", "Says.\n\n## Examples\n```\nx\n```\n## Notes\nz"), (2, "g", "function", "## Examples\nThis section is incomplete")], "id long, title string, kind string, text string")
    assert [tuple(r) for r in examples.example_entries(e).collect()] == [(1, "n.f › Example", "```\nx\n```")]


def test_crawl_state(spark, tmp_path):
    a, b = (spark.createDataFrame([(i, f"u{i}") for i in r], "page_id long, url string") for r in (range(5), range(3, 8)))
    a.coalesce(1).write.parquet(str(tmp_path / "in"))
    b.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = "page_id long, url string"
    assert crawl.rounds(spark, str(tmp_path / "in"), schema, "page_id", str(tmp_path / "s"), str(tmp_path / "o")).count() == 8
    assert crawl.rounds(spark, str(tmp_path / "none"), schema, "page_id").count() == 0
    log = spark.createDataFrame([("a", 1, "busy"), ("a", 2, None), ("b", 1, "not-found"), ("c", 1, "busy"), ("d", 1, "busy"), ("d", 2, "busy"), ("d", 3, "busy")], "url string, ts int, kind string")
    assert {r.url: r.state for r in crawl.retries(log).collect()} == {"a": "read", "b": "given up", "c": "again", "d": "given up"}
    schema = "host string, ts double, busy boolean, retry_after double, left int, reset double, floor double"
    rows = [("h", 0.0, True, None, None, None, None), ("h", 10.0, True, 20.0, None, None, None), ("h", 40.0, False, None, None, None, None), ("k", 0.0, False, None, 10, 50.0, 1.0), ("l", 0.0, True, 900.0, None, None, None)]
    got = {r.host: r for r in crawl.pace(spark.createDataFrame(rows, schema)).collect()}
    assert got["h"].gap == 1 / 1.1 and got["h"].next == 30.0 and got["k"].gap == 5.0 and got["l"].paused == 900.0
    assert crawl.plan_name({"a": 1, "b": 2}) == crawl.plan_name({"b": 2, "a": 1}) != crawl.plan_name({"a": 2})
