import os
import sqlite3

import duckdb
from pyspark.sql import functions as F

from marlstone.llm import packing
from marlstone.operators import corpus, ledger, manifest, ranges
from marlstone.plans.execute import Result, sample
from marlstone.queries import corpus as corpus_queries
from marlstone.queries import relational
from marlstone.sources import catalog, web


def test_tables_and_selection(spark):
    html = "<table><tr><th>Title</th><th>Kind</th></tr><tr><td><a href='x'>SQL  guide</a></td><td>db</td></tr><tr><td>Other</td><td>x</td></tr></table>"
    rows = web.table_rows(spark.createDataFrame([(1, html)], "id int, html string"), "id").orderBy("row").collect()
    assert [r.cells for r in rows] == [["Title", "Kind"], ["SQL guide", "db"], ["Other", "x"]]
    entries = spark.createDataFrame([("SQL guide", "db"), ("SQL draft", "db"), ("SQL", "x"), ("Z", "x")], "title string, category string")
    got = {r.title: (r.selected, r.reason) for r in web.catalog_selection(entries, ("db",), "SQL", "draft").collect()}
    assert got == {"SQL guide": (True, "category"), "SQL draft": (False, "excluded title"), "SQL": (True, "title"), "Z": (False, "no match")}


def test_urls(spark):
    urls = spark.createDataFrame([("https://a.b/news/7",), ("https://a.b/news/8",), ("https://a.b/x",)], "url string")
    known = spark.createDataFrame([("https://a.b/api/8",)], "url string")
    assert [tuple(r) for r in web.derived_urls(urls, r"^(https://[^/]+)/news/(\d+)$", "$1/api/$2", known).collect()] == [("https://a.b/news/7", "https://a.b/api/7")]
    page = spark.createDataFrame([("http://S.org/p", "T", '<a href="/q#f"><a href="https://s.org/q"><a href="mailto:x">')], "url string, title string, html string")
    assert [tuple(r) for r in web.discovered(page, "url", "title").collect()] == [("https://s.org/q", "T")]


def test_catalogs(tmp_path):
    path = tmp_path / "chroma.sqlite3"
    with sqlite3.connect(path) as db:
        db.execute("create table collections (name text, dimension integer)")
        db.executemany("insert into collections values (?, ?)", [("papers", 384), ("no", 3), ("odd name", 1), ("notes", -5)])
    assert catalog.vector_catalog(str(path)) == [("notes", None), ("papers", 384)]
    assert catalog.candidate_engines(3306)[0] == "mysql" and len(catalog.candidate_engines(1)) == 3
    assert catalog.first_difference({"a": [1, {"b": 2}]}, {"a": [1, {"b": 3}]}) == "$.a[1].b"
    assert catalog.first_difference({"a": [1]}, {"a": [1, 2]}) == "$.a[1]"
    assert catalog.first_difference([1, "x"], [1, "x"]) is None


def test_metadata_and_rollup(spark):
    snaps = spark.createDataFrame([("ok-1", "a" * 40, "https://x.org/r"), ("../x", "z", None)], "directory string, commit string, url string")
    assert [(r.directory, r.errors) for r in manifest.metadata_errors(snaps).collect()] == [("../x", ["directory", "commit", "url"])]
    docs = spark.createDataFrame([("d1", "g", "train", ["pg"], ["s1"], [], True), ("d2", "g", "train", ["ts", "pg"], ["s2"], ["f"], False)],
                                 "id string, group_id string, split string, dialects array<string>, source_ids array<string>, quality_flags array<string>, training_eligible boolean")
    made = corpus.chunks(spark.createDataFrame([("d1", "same"), ("d2", "same")], "doc_id string, text string"))
    row = corpus.chunk_rollup(made, docs).first()
    assert (row.group_id, row.split, row.dialects, row.source_ids, row.quality_flags, row.training_eligible) == ("g", "train", ["pg", "ts"], ["s1", "s2"], ["f"], False)
    assert row.spans == 2 and sorted(r.doc_id for r in corpus.chunk_spans(made).filter(F.col("id") == row.id).collect()) == ["d1", "d2"]
    have = spark.createDataFrame([(1, "a")], "k int, v string")
    assert sorted(manifest.seed_missing(have, spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string"), "k").collect()) == [(1, "a"), (2, "c")]
    assert have.filter(F.col("k") == 1).count() == 1


def test_sample():
    kept, note = sample(Result(["a"], [[1], [2], [3]], 5, False), 2)
    assert kept.rows == [[1], [2]] and kept.truncated and note.startswith("2 of 3 kept rows; the original result was not truncated")


def test_a_conversion_whose_product_is_larger_than_a_long(spark):
    amounts = spark.createDataFrame([("a", 14_621_730_071_160), ("b", -(1 << 62)), ("c", None), ("d", -1)], "pair string, amount long")
    rates = spark.createDataFrame([("a", 1, 1), ("a", 2, 990_338), ("b", 1, 999_999), ("d", 1, 999_999)], "pair string, at int, rate long")
    got = {r.pair: r.converted_minor for r in ledger.convert_latest(amounts, rates, ["pair"], "at", "amount", "rate").collect()}
    assert got == {"a": 14_621_730_071_160 * 990_338 // 1_000_000, "b": -((1 << 62) * 999_999 // 1_000_000), "c": None, "d": 0}


def test_page_titles_equals_its_sql_whatever_the_title(spark, tmp_path):
    text = "<article><p>" + "word " * 40 + "</p></article>"
    pages = [(1, "u", "<title>Call +1 (404) 555-9676</title>" + text), (2, "u", "<title>Access Denied</title>" + text), (3, "u", "<title>t</title><main>" + "x" * 300 + "</main>"),
             (4, "u", None), (5, "u", "<title> a \n b</title><article>short</article>"), (6, "u", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = db.execute(corpus_queries.ORACLE_SQL["page_titles"]).fetchall()
    assert sorted(tuple(r) for r in corpus_queries.QUERIES["page_titles"](spark, str(tmp_path)).collect()) == sorted(want)


def test_percentiles_over_ranges_equal_sql_and_hold_no_group(spark, sf_small):
    rows = [("a", float(k * k % 37)) for k in range(200)] + [("b", 5.0)] * 9 + [("b", None), ("c", None), (None, 2.0), (None, 3.0), ("d", -1.5)]
    table = spark.createDataFrame(rows, "g string, x double").repartition(3)
    got = sorted((tuple(r) for r in ranges.percentiles(table, "g", "x", {"p": 0.25, "q": 0.9, "r": 1.0}).collect()), key=str)
    db = duckdb.connect()
    db.execute("create table t (g varchar, x double)")
    db.executemany("insert into t values (?, ?)", rows)
    want = sorted(db.execute("select g, quantile_cont(x, 0.25), quantile_cont(x, 0.9), quantile_cont(x, 1.0) from t group by 1").fetchall(), key=str)
    assert [r[0] for r in got] == [r[0] for r in want]
    assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for g, w in zip(got, want, strict=True) for a, b in zip(g[1:], w[1:], strict=True))
    plan = relational.QUERIES["percentiles"](spark, sf_small)._jdf.queryExecution().toString()
    assert "percentile(" not in plan and "median(" not in plan


def test_near_pairs_takes_copies_and_hashes_of_the_same_texts_once(spark):
    words = [f"w{k}" for k in range(120)]
    texts = [(f"t{k}", " ".join([*words[:100 - k], *(f"x{k}-{i}" for i in range(k))])) for k in range(6)] + [("far", " ".join(f"y{i}" for i in range(100)))]
    once = spark.createDataFrame(texts, "id string, text string")
    wanted = {(r.a, r.b): r.sampled_jaccard for r in corpus.near_pairs(once, 0.6).collect()}
    sets = {name: {" ".join(t.split()[i:i + 5]) for i in range(96)} for name, t in texts}
    assert wanted == {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 4) for a in sets for b in sets if a > b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    assert wanted and {(r.a, r.b): r.sampled_jaccard for r in corpus.near_pairs(once.union(once).union(once), 0.6).collect()} == wanted
    plan = corpus_queries.QUERIES["near_dup_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "text" not in plan


def test_packing_encodes_on_the_tasks_own_core(monkeypatch):
    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    packing._coder.cache_clear()
    packing._coder(None)
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"
    packing._coder.cache_clear()
