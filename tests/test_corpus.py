import random
import sqlite3

import pytest

from marlstone.operators import corpus, search
from marlstone.operators.components import connected_components
from marlstone.streaming.rapid import rapid_windows


@pytest.mark.parametrize(("limit", "overlap"), [(300, 40), (100, 0), (1000, 499)])
def test_windows_cover_every_character(limit, overlap):
    rng = random.Random(5)
    for _ in range(50):
        text = "".join(rng.choice("abc \n") for _ in range(rng.randint(0, 3000)))
        spans = corpus.windows(text, limit, overlap)
        assert all(0 < b - a <= limit for a, b in spans)
        covered = set()
        for a, b in spans:
            covered |= set(range(a, b))
        assert covered == set(range(len(text)))
    with pytest.raises(ValueError):
        corpus.windows("x", 99, 0)


def test_components_match_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100, k) for k in range(101, 300)] + [(k, k + 1) for k in range(400, 440)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        parent[b] = a
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {x: find(x) for u, v in edges if u != v for x in (u, v)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).isEmpty()


def test_bm25_agrees_with_fts5(spark):
    texts = {1: "the épee duel", 2: "the the the fence", 3: "epee and fence and the duel of epee", 4: "nothing here", 5: "x_y z", 6: "x z y"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(text, tokenize='unicode61')")
    for k, v in texts.items():
        db.execute("insert into f(rowid, text) values (?, ?)", (k, v))
    for query in ("epee", "the duel", "fence", "x_y", "missing", "z"):
        match = " AND ".join(f'"{w}"' for w in query.split())
        want = [(k, round(-s, 6)) for k, s in db.execute("select rowid, bm25(f) from f where f match ? order by bm25(f), rowid", (match,))]
        got = [(r.id, round(r.score, 6)) for r in search.bm25(docs, query, "doc_id").collect()]
        assert got == want, query
    assert search.bm25(docs, " ", "doc_id").isEmpty()


def test_schema_context_errors(spark):
    columns = spark.createDataFrame([(i, f"table_{i}", "c") for i in range(5)], "position int, table_name string, column_name string")
    with pytest.raises(ValueError):
        search.schema_context(columns, "nothing fits", 2)
    assert search.schema_context(columns, "whatever", 9).count() == 5


def test_stream_of_events(spark, sf_small, tmp_path):
    events = spark.read.parquet(f"{sf_small}/events.parquet").selectExpr("cast(ts as timestamp) ts", "user_id").orderBy("ts")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = rapid_windows(stream, least=2).writeStream.format("memory").queryName("rapid_out").outputMode("update").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("rapid_out").count() == rapid_windows(events, least=2).count() > 0


@pytest.mark.parametrize("most_bytes", [corpus.BROADCAST, 0])
def test_contamination_is_that_of_plain_loops(spark, most_bytes):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefg") * rng.randint(1, 3)
    items = {k: [word() for _ in range(rng.randint(0, 40))] for k in range(12)}
    docs = [(None if k % 9 == 0 else k // 2, [word() for _ in range(rng.randint(0, 60))] + (items[k % 12][:rng.randint(0, 40)] if k % 3 == 0 else [])) for k in range(80)]
    runs = lambda w: {tuple(w[i:i + 13]) for i in range(len(w) - 12)}
    want = {}
    for k, w in docs:
        for j, v in items.items():
            if n := len(runs(w) & runs(v)):
                want[k, j] = want.get((k, j), 0) + n
    d = spark.createDataFrame([(k, "  ".join(w)) for k, w in docs] + [(99, None), (98, "")], "doc_id long, text string")
    b = spark.createDataFrame([(k, "\n".join(w)) for k, w in items.items()] + [(50, None)], "item_id int, text string")
    got = {(r.doc_id, r.item_id): r.shared for r in corpus.contamination(d, b, most_bytes=most_bytes).collect()}
    assert got == want and len(want) > 5
    assert corpus.contamination(d, b.limit(0), most_bytes=most_bytes).isEmpty()
