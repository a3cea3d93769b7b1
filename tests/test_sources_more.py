"""Databases, catalogs, archives, inventories and collections on small fixtures."""

import io
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from marlstone.operators import corpus, dml, inventory, manifest, search
from marlstone.plans.gate import Refused
from marlstone.sources import database, files, sinks, web


@pytest.fixture
def shop(tmp_path):
    path = tmp_path / "shop.db"
    with sqlite3.connect(path) as db:
        db.executescript("""
            create table region (id integer primary key, name text not null unique);
            create table shop (region_id int references region(id) on delete cascade, no int, price real default 1.5, note blob, made as (no * 2), primary key (region_id, no));
            create index shop_price on shop (price desc) where price > 1;
            create view dear as select no, price from shop where price > 2;
            create trigger keep before delete on region begin select raise(abort, 'no'); end;""")
        db.executemany("insert into region values (?, ?)", [(k, f"r{k}") for k in range(40)])
        db.executemany("insert into shop (region_id, no, price, note) values (?, ?, ?, ?)", [(k % 40, k, k / 4, b"\x00\xff" if k % 2 else None) for k in range(100)])
    return str(path)


def test_sqlite_statements(shop):
    db = database.SQLite(shop)
    db.test()
    found = db.execute("select id, name from region order by id", cap=3)
    assert (found.columns, found.rows, found.truncated) == (["id", "name"], [[0, "r0"], [1, "r1"], [2, "r2"]], True)
    assert not db.execute("select * from region where id < 3", cap=3).truncated
    assert db.execute("select note from shop where no = 1 and region_id = 1").rows == [["<2 byte blob>"]]
    assert db.execute("explain query plan select * from region").columns[0] == "id"
    for sql in ("delete from shop", "attach 'x' as y", "select 1; select 2", "pragma writable_schema = 1"):
        with pytest.raises(Refused):
            db.execute(sql)
    with pytest.raises(sqlite3.OperationalError):
        db.execute("select * from missing")
    writer = database.SQLite(shop, allow_writes=True)
    with pytest.raises(Refused):
        writer.execute("update shop set price = 0 where no < 10")
    assert writer.execute("update shop set price = 0 where no < 10", confirmed=True).rows == [["Update rows", 10]]
    assert writer.execute("create table t (a int)", confirmed=True).rows == [["Schema change", 0]]
    with pytest.raises(TimeoutError):
        db.execute("with recursive n(x) as (select 1 union all select x + 1 from n) select count(*) from n", timeout_s=0.3)
    with pytest.raises(FileNotFoundError):
        database.SQLite(shop + "x").test()


def test_sqlite_tables_come_in_as_frames(spark, shop):
    whole = database.read_sqlite(spark, shop, "shop", parts=4)
    assert whole.dtypes == [("region_id", "bigint"), ("no", "bigint"), ("price", "double"), ("note", "binary")]
    assert whole.rdd.getNumPartitions() == 4 and whole.count() == 100
    assert whole.agg(F.sum("no"), F.sum("price"), F.count("note")).first()[:] == (4950, 4950 / 4, 50)
    assert database.read_sqlite(spark, shop, "dear", parts=4).count() == 91
    with pytest.raises(Exception, match="no table"):
        database.read_sqlite(spark, shop, "missing").count()


def test_sqlite_catalogs(shop):
    db = database.SQLite(shop)
    flat = db.introspect()
    assert [(r[1], r[2], r[4], r[7]) for r in flat if r[7]] == [("region", "table", "id", "PK"), ("shop", "table", "region_id", "PK")]
    assert [r[4] for r in flat if r[1] == "dear"] == ["no", "price"]
    made = db.full_catalog()
    region, shop_ = made["tables"]
    assert shop_["primaryKey"] == ["region_id", "no"] and region["primaryKey"] == ["id"]
    assert [(c["name"], c["default"], c["hidden"]) for c in shop_["columns"] if c["default"] or c["hidden"]] == [("price", "1.5", 0), ("made", None, 2)]
    assert [(f["table"], f["from"], f["onDelete"]) for f in shop_["foreignKeys"]] == [("region", "region_id", "CASCADE")]
    own = next(i for i in shop_["indexes"] if i["name"] == "shop_price")
    assert own["partial"] and own["columns"][0]["descending"] and own["sql"].startswith("CREATE INDEX")
    assert made["views"][0]["columns"] == ["no", "price"] and made["triggers"][0]["table"] == "region"


def test_server_options():
    server = database.Server("postgres", "db.example", 5432, "a/b", "me")
    made = server.options("p;w")
    assert made["url"] == "jdbc:postgresql://db.example:5432/a%2Fb?sslmode=prefer" and made["password"] == "p;w" and made["queryTimeout"] == "60"
    assert database.connection_url("mysql", "a:b", "c@d", "h", 3306, "x y") == "mysql://a%3Ab:c%40d@h:3306/x%20y"
    with pytest.raises(ValueError):
        database.connection_url("mysql", "a", "b", "h/../", 3306, "x")


def _zip(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in entries:
            z.writestr(name, body)
    return out.getvalue()


def test_archives_and_kinds(spark):
    data = _zip([("../a/Guide one.pdf", b"%PDF-1"), ("b.pdf", b"no"), ("c.exe", b"x"), ("__MACOSX/._d.txt", b"m"), ("e/", b""), ("e/f.txt", b"text")])
    rows = files.archive_members(spark.createDataFrame([("x.zip", data), ("y.zip", b"broken"), ("z.zip", None)], "path string, content binary")).collect()
    got = {(r.path, r.entry): (r.name and r.name[12:], r.kind, r.error) for r in rows}
    assert got == {("x.zip", "../a/Guide one.pdf"): ("Guide-one.pdf", "document", None), ("x.zip", "b.pdf"): ("b.pdf", "document", "not a PDF"),
                   ("x.zip", "__MACOSX/._d.txt"): ("_d.txt", "metadata", None), ("x.zip", "e/f.txt"): ("f.txt", "document", None),
                   ("y.zip", None): (None, None, "not an archive"), ("z.zip", None): (None, None, "not an archive")}
    kinds = spark.createDataFrame([(b" %PDF-1.4", None), (data, None), (b"\n<!DOCTYPE HTML><p>", ""), (b"<p>", "text/html"), (b"\x00", "x/y"), (b"", None)], "c binary, m string")
    assert [r.k for r in kinds.select(files.file_kind(F.col("c"), F.col("m")).alias("k")).collect()] == ["pdf", "zip", "html", "html", "binary", "binary"]


def test_globs_cross_slashes(spark):
    import fnmatch

    paths = ["a.md", "a/b.md", "a/b/c.txt", "a.b", "[x].md", "A.MD", "a\nb.md"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    for pattern in ("*.md", "a/*", "?.md", "*/b*", "[[]x].md", "[!a]*", "a.b", "*"):
        got = [r.m for r in df.select(inventory.glob_match(F.col("p"), pattern).alias("m")).collect()]
        assert got == [fnmatch.fnmatchcase(p, pattern) for p in paths], pattern


def test_inventory_and_sources(spark):
    long = "select a from b; " * 20
    rows = [("s", "d/a.sql", long.encode(), False), ("s", "d/b.sql", long.encode(), False), ("t", "c.sql", long.encode(), False), ("s", "d/l.sql", b"x", True), ("s", "n.txt", b"x", False),
            ("s", ".git/x.sql", b"x", False), ("s", "d/security.md", b"x", False), ("s", "d/e.sql", b"", False), ("s", "d/bin.sql", b"\0" * 200, False), ("s", "d/k.sql", b"k", False),
            ("s", "d/s.sql", (long + "AKIA" + "A" * 16).encode(), False), ("s", "d/f.md", (long + "{{x}}").encode(), False), ("u", "z.sql", b"x", False), ("s", "d/big.sql", b"y" * 9000, False)]
    made = spark.createDataFrame(rows, "source_id string, path string, content binary, is_link boolean")
    audit, docs = inventory.inventory(made, {"t": ["*.sql"], "s": ["*.sql", "*.md"]}, most_bytes=8000)
    got = {(r.source_id, r.path): (r.status, r.reason) for r in audit.collect()}
    assert got == {("t", "c.sql"): ("included", None), ("s", "d/a.sql"): ("exact-document-duplicate", None), ("s", "d/b.sql"): ("exact-document-duplicate", None),
                   ("s", "d/l.sql"): ("skipped", "symlink"), ("s", "n.txt"): ("skipped", "outside content allowlist"), ("s", "d/security.md"): ("skipped", "outside content allowlist"),
                   ("s", "d/e.sql"): ("skipped", "empty"), ("s", "d/bin.sql"): ("extraction-error", None), ("s", "d/k.sql"): ("skipped", "too little extracted text"),
                   ("s", "d/s.sql"): ("skipped", "credential_pattern_requires_review"), ("s", "d/f.md"): ("included", None), ("s", "d/big.sql"): ("skipped", "oversize")}
    held = {tuple(r.paths): (r.sources, r.quality_flags, r.training_eligible) for r in docs.collect()}
    assert held == {("c.sql", "d/a.sql", "d/b.sql"): (["s", "t"], [], True), ("d/f.md",): (["s"], ["unresolved_template_or_include"], False)}
    sources = spark.createDataFrame([("s", "LICENSE", "detect", "configure", r"VERSION=(\S+)"), ("t", None, "1", None, None)],
                                    "source_id string, notice string, version string, version_file string, version_pattern string")
    given = spark.createDataFrame([("s", "LICENSE", b"free"), ("s", "configure", b"x\nVERSION=17.2 y")], "source_id string, path string, content binary")
    found = {r.source_id: (r.version, r.notice_sha256) for r in inventory.resolved_sources(sources, given).collect()}
    assert found["s"][0] == "17.2" and len(found["s"][1]) == 64 and found["t"] == ("1", None)


def test_export_sets_are_published_whole(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "t", ["s"], ["x"], ["s"], [], "g", "train", True), ("d2", "u", ["s"], ["x"], ["s"], ["loud"], "g", "train", False)],
                                 "id string, text string, sources array<string>, dialects array<string>, source_ids array<string>, quality_flags array<string>, group_id string, split string, training_eligible boolean")
    rolled = corpus.chunk_rollup(corpus.chunks(docs.select("id", F.concat("text", F.lit(" words")).alias("text")), "id"), docs.drop("text", "sources"))
    audit, near = spark.createDataFrame([("a", "included", None)], "path string, status string, reason string"), spark.createDataFrame([], "a string, b string")
    sets = corpus.export_sets(docs, rolled, audit, near)
    sinks.publish(sets, str(tmp_path / "out"), "jsonl")
    counts = {name: sum(len(f.read_text().splitlines()) for f in (tmp_path / "out" / name).glob("part-*")) for name in sets}
    assert counts == {"documents": 2, "chunks": 2, "inventory": 1, "near_duplicates": 0, "review": 1, "train": 1, "validation": 0, "test": 0}


def test_collections(spark):
    repos = spark.createDataFrame([("c", "r1", "downloaded", "u1", ["LICENSE"]), ("c", "r2", "failed", "u2", None)],
                                  "collection string, repository string, status string, url string, license_files array<string>")
    held = spark.createDataFrame([("c", "f1", "downloaded", "publisher_placeholder", None), ("c", "f2", "failed", None, "404"), ("c", "f3", "downloaded", None, None)],
                                 "collection string, url string, status string, document_status string, error string")
    assert sorted((r.kind, r.name, r.error) for r in manifest.collection_gaps(repos, held).collect()) == [
        ("missing license", "r2", None), ("placeholder", "f1", None), ("unavailable", "f2", "404"), ("unavailable", "u2", "Incomplete repository snapshot")]
    anchors = spark.createDataFrame([("7.5", "en", "B", None, "u"), ("7.4", "en", "A", "p", "u"), ("7.5", "en", "B", None, "u")], "version string, language string, title string, publication string, url string")
    row = manifest.library_resources(anchors, 1).first()
    assert [(r.version, r.title) for r in row.references] == [("7.4", "A"), ("7.5", "B")]
    with pytest.raises(manifest.Incomplete):
        manifest.library_resources(anchors)
    old = spark.createDataFrame([("u", ["a"]), ("v", None)], "url string, references array<string>")
    found = spark.createDataFrame([("u", "b"), ("u", "a"), ("w", "c")], "url string, reference string")
    assert {r.url: r.references for r in manifest.upsert_references(old, found).collect()} == {"u": ["a", "b"], "v": [], "w": ["c"]}
    pages = spark.createDataFrame([(1, "p1", '<article><h3><a href="/org">org</a> / <a href="/org/tool"> tool</a></h3><p>Does <b>it</b></p></article><article><h3>none</h3></article>'),
                                   (2, "p2", '<article><h3><a href="/org/tool">t</a></h3><p>Newer</p></article><article><h3><a href="/a/b">b</a></h3></article>')], "n int, url string, html string")
    got = {r.repository: (r.description, r.source_page, r.selected) for r in web.topic_entries(pages, "n", ("a/b",)).collect()}
    assert got == {"org/tool": ("Newer", "p2", False), "a/b": ("", "p2", True)}


def test_reach_without_limits(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)], "src long, dst long")
    seeds = spark.createDataFrame([(0,)], "node long")
    assert manifest.reachable(chain, seeds).count() == 31
    assert manifest.reachable(chain, seeds, None, None).count() == 41


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a c"), (2, "b c"), (3, ""), (4, "a a b")], "doc_id long, text string")
    search.build_index(docs, "doc_id", str(tmp_path / "i"))
    for query in ("a", "a b", "b b", "missing", " "):
        rows = lambda df: [(r.id, round(r.score, 12)) for r in df.collect()]
        assert rows(search.search_index(spark, str(tmp_path / "i"), query)) == rows(search.bm25(docs, query, "doc_id")), query
    with pytest.raises(ValueError):
        search.search_index(spark, str(tmp_path / "i"), "a_b")


def test_touch_defaults_to_now(spark):
    t = spark.createDataFrame([(1, "a", "t0"), (2, "b", "t0")], "k int, v string, at string")
    got = {r.k: r for r in dml.touched(t, F.col("k") == 1, {"v": F.lit("z")}, "at").collect()}
    assert got[1].v == "z" and got[1].at.endswith("Z") and len(got[1].at) == 20 and got[2].at == "t0"


def test_catalog_export(spark):
    from marlstone.sources import catalog

    objects = spark.createDataFrame([("S", "T", "TABLE "), ("S", "V", "VIEW"), ("SX", "T", "TABLE")], "schema_name string, table_name string, kind string")
    columns = spark.createDataFrame([("S", "T", 1, "AMOUNT", "DECIMAL", 9, 2, True), ("S", "T", 0, "ID", "INTEGER", 10, 0, False), ("S", "V", 0, "N", "varchar", 20, None, True), ("SX", "T", 0, "A", "DATE", None, None, True)],
                                    "schema_name string, table_name string, position int, column_name string, type_name string, column_size int, decimal_digits int, nullable boolean")
    keys = spark.createDataFrame([("S", "T", "ID")], "schema_name string, table_name string, column_name string")
    made = catalog.exported(objects, columns, keys, ["S"], {}, "f", "2024-01-01T00:00:00+00:00")
    assert made["tables"] == [
        {"schema": "S", "name": "T", "kind": "table", "columns": [{"name": "ID", "dataType": "INTEGER", "nullable": False, "key": "PK"}, {"name": "AMOUNT", "dataType": "DECIMAL(9,2)", "nullable": True, "key": None}]},
        {"schema": "S", "name": "V", "kind": "view", "columns": [{"name": "N", "dataType": "varchar(20)", "nullable": True, "key": None}]}]
    assert made["warnings"] == [] and catalog.exported(objects, columns, None, ["S"], {}, "f", "t")["warnings"]
    for bad in (objects.filter("false"), objects.union(objects), objects.withColumn("kind", F.lit("ALIAS")), objects.union(spark.createDataFrame([("S", "W", "TABLE")], objects.schema))):
        with pytest.raises(ValueError):
            catalog.exported(bad, columns, keys, ["S"], {}, "f", "t")


def test_pages_links_and_urls(spark):
    page = '<title>Guide</title><nav><a href="/menu.pdf">m</a></nav><article><a href="/a.PDF?x">a</a><a href="b">b</a><a href="https://s.org/c.html">c</a> This manual is to come.' + "x" * 200 + "</article>"
    pages = spark.createDataFrame([("http://s.org/p", "T", page), ("http://s.org/q", "U", "<title>404 - gone</title><body>" + "x" * 300)], "url string, title string, html string")
    assert [r.url for r in web.discovered(pages, "url", "title", within=("article", "main"), suffixes=("pdf",)).collect()] == ["https://s.org/a.PDF?x"]
    got = {r.url: r.verdict for r in web.page_check(pages, "url", placeholders=("is to come",)).collect()}
    assert got == {"http://s.org/p": "placeholder", "http://s.org/q": "error page"}
    urls = spark.createDataFrame([("http://A.x.org/ä b?q=1#f",), ("https://x.org.evil/",), ("ftp://x.org/",), (None,), ("http://[bad",)], "url string")
    assert [(r.canonical, r.error) for r in web.canonical_within(urls, ("x.org",)).collect()] == [
        ("https://A.x.org/%C3%A4%20b?q=1", None), (None, "another host"), (None, "another scheme"), (None, "another scheme"), (None, "not a url")]


def test_pdf_by_an_outside_program(spark, tmp_path, monkeypatch):
    from marlstone.sources import extract

    monkeypatch.setenv("PATH", str(tmp_path))
    with pytest.raises(OSError):
        extract.pdf_text(b"%PDF")
    program = tmp_path / "pdftotext"
    program.write_text("#!/bin/sh\nread line\n[ \"$line\" = '%PDF' ] || exit 1\nprintf 'page  one\\fpage two\\n'\n")
    program.chmod(0o755)
    assert extract.pdf_text(b"%PDF\n") == "page  one\n\npage two"
    with pytest.raises(ValueError):
        extract.pdf_text(b"no\n")


def test_boundary_and_detection(spark):
    spark.range(3).createOrReplaceTempView("boundary_rows")
    db = database.SparkTables(spark)
    db.test()
    assert ("session", "boundary_rows", "view", 0, "id", "bigint", False, None) in db.introspect()
    assert db.execute("select id from boundary_rows order by id").rows == [[0], [1], [2]]
    with pytest.raises(Refused):
        db.execute("drop view boundary_rows")

    def attempt(engine):
        if engine != "mysql":
            raise OSError(f"no {engine}\nmore")

    assert database.detect_engine(5432, attempt) == "mysql"
    with pytest.raises(ConnectionError, match="postgres: no postgres; mysql: no mysql"):
        database.detect_engine(5432, lambda e: (_ for _ in ()).throw(OSError(f"no {e}")))


def test_blake_digests(spark):
    import hashlib

    from marlstone.functions import text as T

    rows = spark.createDataFrame([("",), ("é",), (None,)], "t string").select(T.blake2b_64(F.col("t")).alias("h")).collect()
    assert [r.h for r in rows] == [hashlib.blake2b(b"", digest_size=8).hexdigest(), hashlib.blake2b("é".encode(), digest_size=8).hexdigest(), None]


def test_library_tables(spark):
    page = ('<div class="tabs"><div id="75"><table><tr><td><b>Guide</b> one</td><td>SC1</td><td><a href="/a.pdf">PDF</a> <a href="#top">up</a></td></tr>'
            '<tr><td>PDF format - Japanese</td><td><a href="http://S.org/b.zip#x">all</a></td></tr></table></div><div id="74"><table><tr><td>Guide one</td><td>SC0</td><td><a href="/a.pdf">PDF</a></td></tr></table></div></div>')
    made = web.library_anchors(spark.createDataFrame([("https://s.org/lib", page)], "url string, html string"))
    assert sorted(map(tuple, made.collect()), key=repr) == [("7.4", "en", "Guide one", "SC0", "https://s.org/a.pdf"), ("7.5", "en", "Guide one", "SC1", "https://s.org/a.pdf"),
                                                            ("7.5", "ja", "Complete PDF bundle", None, "https://s.org/b.zip")]
    found = {r.url: len(r.references) for r in manifest.library_resources(made, 2).collect()}
    assert found == {"https://s.org/a.pdf": 2, "https://s.org/b.zip": 1}
