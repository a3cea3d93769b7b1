"""Places where an operator once did less than the whole job, with the production defaults."""

import random
import tracemalloc

from marlstone.llm import jaccard_join, line_dedup, page_diff, substring_dedup, url_trust

DOCS = "doc_id long, text string"


def test_repeated_runs_of_lines_go_whole(spark):
    rng = random.Random(12)
    fresh = lambda: f"line {rng.random()}"
    rows, want = [], {}
    for k in range(60):
        passage = [fresh() for _ in range(2 + k % 5)]
        for copy in range(2):
            before, after = ([fresh() for _ in range(rng.randint(0, 4))] for _ in range(2))
            rows.append((1000 * copy + k, "\n".join(before + passage + after)))
            want[rows[-1][0]] = "\n".join(before + (passage if copy == 0 else []) + after)
    rows += [(5000, "a\na\na\na"), (5001, "a\nb"), (5002, "a"), (5003, None), (None, rows[0][1]), (5004, "a\nc"), (5004, "x\na\nb"), (5004, "x\na\nb")]
    df = spark.createDataFrame(rows, DOCS)
    out = line_dedup.passages_removed(df)
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert {k: got[k] for k in want} == {k: [t] for k, t in want.items()}
    assert got[5000] == ["a\na"] and got[5001] == ["a\nb"] and got[5002] == ["a"] and got[5003] == [None] and got[None] == [rows[0][1]]
    assert sorted(got[5004]) == ["a\nc", "x", "x"]
    assert line_dedup.passages_removed(df.limit(0)).isEmpty()


def test_chunks_have_two_lines_and_come_back_after_an_insertion(spark):
    from pyspark.sql import functions as F

    rng = random.Random(14)
    lines = [f"line {rng.random()}" for _ in range(400)]
    rows = [(0, "\n".join(lines)), (1, "\n".join(["new", *lines])), (2, "\n".join(lines[:150] + ["new"] + lines[150:])), (3, "one"), (4, "a\nb"), (5, "a\nb\nc")]
    df = spark.createDataFrame(rows, DOCS).select("doc_id", F.explode(line_dedup.line_chunks(F.col("text"))).alias("c")).select("doc_id", "c.lines", "c.body")
    got = {}
    for r in df.collect():
        got.setdefault(r.doc_id, []).append((r.lines, r.body))
    assert all(n >= 2 for k, found in got.items() if k != 3 for n, _ in found) and got[3] == [(1, "one")] and len(got[4]) == len(got[5]) == 1
    assert 110 < len(got[0]) < 160
    bodies = {k: {b for _, b in found} for k, found in got.items()}
    assert len(bodies[0] - bodies[1]) <= 2 and len(bodies[0] - bodies[2]) <= 3
    long_passage = [f"p {k}" for k in range(20)]
    two = [(k, "\n".join([f"{k} own {i}" for i in range(5)] + long_passage + [f"{k} more {i}" for i in range(5)])) for k in (1, 2)]
    out = {r.doc_id: r.text.count("\n") for r in line_dedup.line_dedup(spark.createDataFrame(two, DOCS)).collect()}
    assert out[1] == 29 and out[2] <= 29 - 10


def test_the_pipeline_removes_whole_runs(spark):
    import corpus_pipeline

    text = "\n".join(f"shared {i}" for i in range(3))
    df = spark.createDataFrame([(1, f"{text}\nown one"), (2, f"own two\n{text}\nown three")], DOCS)
    assert {r.doc_id: r.text for r in corpus_pipeline.lines(spark, df, "").collect()}[2] == "own two\nown three"


def test_rows_without_an_id_are_judged_by_their_texts(spark):
    words = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcde"]
    rows = [(None, words[0]), (None, words[1]), (None, words[1]), (None, None), (None, None), (3, words[2]), (3, words[3]), (3, words[3]),
            (None, words[2]), (2, words[4]), (7, words[4] + " more"), (7, None), (None, words[4])]
    kept = jaccard_join.near_duplicates_removed(spark.createDataFrame(rows, DOCS)).collect()
    want = [(None, words[0]), (None, words[1]), (None, None), (None, None), (3, words[2]), (3, words[3]), (2, words[4]), (7, None)]
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, want))


def test_distrust_reaches_the_end_of_a_long_chain(spark):
    n = 14
    pages = [(k, f"http://h{k}.net/x", f'<a href="http://h{k + 1}.net/">') for k in range(n - 1)] + [(n - 1, f"http://h{n - 1}.net/", '<a href="http://bad.com/">'), (n, "http://bad.com/de/1", "")]
    out = {r.page_id: r.verdict for r in url_trust.url_verdicts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert set(out.values()) == {"block"} and len(out) == n + 1


def test_ranks_of_a_cycle_converge(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, links double")
    seeds = spark.createDataFrame([("a", 1.0, 0.0)], "host string, good double, bad double")
    got = {r.host: r.trust for r in url_trust.spread(edges, seeds).collect()}
    d = url_trust.DAMPING
    assert abs(got["a"] - (1 - d) / (1 - d * d)) < 1e-5 and abs(got["b"] - d * (1 - d) / (1 - d * d)) < 1e-5


def test_cards_do_not_switch_off_the_body():
    html = "<body><div><p>Body</p></div><aside><article><p>teaser</p></article></aside><article class='comment'><p>c</p></article><p>End</p></body>"
    assert [t for t, kind in page_diff.page_lines(html) if kind == page_diff.PLAIN] == ["Body", "End"]
    assert all(kind != page_diff.ARTICLE for _, kind in page_diff.page_lines(html))
    left_open = "<nav>n<article><p>Text</p></article><article class='comment'><p>c</p></article>"
    assert [t for t, kind in page_diff.page_lines(left_open) if kind == page_diff.ARTICLE] == ["Text"]


def test_copies_are_no_neighbours(spark):
    page = "<body><p>Welcome to the site</p><p>{0}</p><p>Imprint and contact</p></body>"
    rows = [(k, f"http://a.com/{k:02}", page.format("the same words " * 3 if 2 <= k < 9 else f"unique words of page number {k} " * 3)) for k in range(12)]
    out = {r.page_id: r.text for r in page_diff.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [out[k] for k in range(2, 9)] == [("the same words " * 3).strip()] * 7


def test_differencing_decides_pages_without_an_article(spark):
    page = "<body><p>Welcome to the site</p><p>{0}</p><p>Imprint and contact</p></body>"
    rows = [(k, f"http://a.com/{k % 3}", page.format(f"unique words of page number {k} " * 3)) for k in range(6)]  # neighbours tie by path
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    on = {r.page_id: r.text for r in page_diff.main_text(pages).collect()}
    off = {r.page_id: r.text for r in page_diff.main_text(pages, copy=0).collect()}
    for k in range(6):
        own = (f"unique words of page number {k} " * 3).strip()
        assert on[k] == own and off[k] == f"Welcome to the site\n{own}\nImprint and contact"


def test_differencing_decides_pages_that_declare_articles(spark):
    page = ("<body><nav>menu {0}</nav><main><p>Welcome to the site</p><article><p>unique words of page {0} and more</p><p>a line that all quote</p></article>"
            "<article><p>Latest post</p><p>everywhere the same</p></article></main></body>")
    rows = [(k, f"http://a.com/{k}", page.format(k)) for k in range(5)]
    rows += [(k, f"http://d.com/{k}", f"<p>menu {k} {k}</p><article>the text of a copied article</article><article>teaser {k}</article>") for k in (12, 13)]
    rows += [(9, "http://b.com/", page.format(9)), *((k, f"http://c.com/{k}", f"<article>same short text</article><p>other words of page {k}</p>") for k in (10, 11))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    on = {r.page_id: r for r in page_diff.main_text(pages).collect()}
    off = {r.page_id: r for r in page_diff.main_text(pages, copy=0).collect()}
    for k in range(5):
        assert (on[k].text, on[k].n_shared) == (f"unique words of page {k} and more\na line that all quote", 3)
        assert on[k].n_chars == len(on[k].text) and off[k].n_shared == 0 and off[k].text.startswith("Welcome") and off[k].text.endswith("the same")
    assert on[9].text == off[9].text and on[9].n_shared == 0  # no neighbour
    assert on[10].text == on[11].text == "same short text"  # no other article
    assert [on[k].text for k in (12, 13)] == [f"the text of a copied article\nteaser {k}" for k in (12, 13)]


def test_lines_lost_by_the_check():
    def lost(places, articles, shared, sizes=(9,) * 10):
        return page_diff.lines_lost(places, articles, list(sizes), shared)

    assert lost([1, 3, 5], None, {0, 3, 5}) == [1, 2]  # no article
    assert lost([1, 3, 5], [1, 1, 1], {1, 3}) == []  # an article with a line left gets the others back
    assert lost([1, 3, 5], [1, 1, 1], {1, 3, 5}) == []  # nothing left of the only article
    assert lost([1, 3, 5], [0, 0, 0], {1, 3}) == []  # a main element alone
    assert lost([1, 3, 5, 7, 9], [0, 1, 1, 2, 0], {1, 3, 7}) == [0, 3]  # a repeated article, and a line of main
    assert lost([1, 3, 5], [0, 1, 2], {3, 5}) == []  # of the articles none is left
    assert lost([1, 3], [1, 2], {1}, [0, 50, 0, 20]) == []  # a copied text beside a new teaser
    assert lost([1, 3], [1, 2], {1}, [0, 20, 0, 50]) == [0]
    assert lost([], [], {1}) == lost([], None, {1}) == []


def test_common_lines_of_long_pages_in_little_memory():
    rng = random.Random(6)
    a = [rng.randint(0, 4000) for _ in range(8000)]
    b = [v if k % 3 else -k - 1 for k, v in enumerate(a)]
    tracemalloc.start()
    found = page_diff.common_lines(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    rest = iter(b)
    assert len(found) >= sum(v >= 0 for v in b) and all(a[i] in rest for i in found)
    assert peak < 5_000_000


def test_passages_without_white_space_are_cut(spark):
    rng = random.Random(13)
    signs = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(n))
    rows, passages = [], [signs(300) for _ in range(40)]
    for copy in range(2):
        rows += [(1000 * copy + k, signs(200) + p + signs(200)) for k, p in enumerate(passages)]
    out = substring_dedup.substring_dedup(spark.createDataFrame(rows, DOCS)).collect()
    cut = [r.cut_chars for r in out if r.doc_id >= 1000]
    assert all(c > 150 for c in cut) and sum(cut) > 0.8 * 300 * 40
    assert all(r.cut_chars == 0 for r in out if r.doc_id < 1000)


def test_native_operators_keep_python_off_their_plans(spark):
    sf = "/root/testdata/sf0.001"
    docs, pages = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/pages.parquet")
    for df in (line_dedup.line_dedup(docs), line_dedup.passages_removed(docs), url_trust.url_verdicts(pages)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"))
        assert "Scan parquet" in plan
