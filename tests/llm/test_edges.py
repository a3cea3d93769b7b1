"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from marlstone.llm import anisotropic, byte_bpe, jaccard_join, line_dedup, packing, page_diff, png_media, quality, substring_dedup, url_trust

DOCS = "doc_id long, text string, lang string, node string, item long, hits string, _id int, h long, key long, score double, body string, vec_id long"
PAD = (None,) * 10
LONG = " ".join(f"w{i}" for i in range(30_000))
ROWS = [(1, None, *PAD), (2, "", *PAD), (3, " \n\t ", *PAD), (4, "one", *PAD), (5, LONG, *PAD), (6, LONG, *PAD), (6, LONG, *PAD), (None, "no id at all here now", *PAD),
        (None, None, *PAD), (7, " 漢字é\x00\x1c", *PAD), (8, "a b c d e\nf g h i j\nk l m n o", *PAD), (9, "a b c d e\nf g h i j\nk l m n o", *PAD)]
LABELS = "doc_id long, quality int, score double"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 0, 0.0), (5, 1, 0.0), (8, 1, 0.0), (8, 1, 0.0), (9, None, 0.0), (None, 1, 0.0), (2, 7, 0.0)], LABELS)


def test_quality(spark, docs, labels):
    out = quality.quality_scores(docs, labels).collect()
    assert len(out) == len(ROWS)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    same = {r.score for r in out if r.doc_id in (1, 2)}
    assert len(same) == 1
    kept = quality.quality_filtered(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.predicted for r in out)
    assert quality.quality_scores(docs.limit(0), labels).isEmpty()
    assert {round(r.score, 6) for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}


def test_jaccard(spark, docs):
    out = jaccard_join.jaccard_join(docs).collect()
    assert len(out) == len(ROWS)
    found = {}
    for r in out:
        found.setdefault(r.doc_id, set()).add((r.class_id, r.n_links, r.n_texts, r.class_size))
    assert found[1] == {(1, 0, 0, 1)}
    assert found[5] == found[6] == {(5, 2, 0, 3)}
    assert found[8] == found[9] == {(8, 1, 0, 2)}
    assert found[2] == {(2, 0, 0, 1)}
    assert found[None] == {(None, 0, 0, 1)}
    assert jaccard_join.jaccard_join(docs.limit(0)).isEmpty()
    kept = jaccard_join.near_duplicates_removed(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {1, 2, 3, 4, 5, 7, 8} <= set(ids) and not {6, 9} & set(ids)


def test_line_dedup(docs):
    out = line_dedup.line_dedup(docs, least_lines=1)
    assert out.columns == [*docs.columns, "n_removed"]
    rows = out.collect()
    assert len(rows) == len(ROWS)
    text = {}
    for r in rows:
        text.setdefault(r.doc_id, []).append(r.text)
    assert text[1] == [None] and text[5] == [LONG] and text[6] == ["", ""] and text[9] == [""] and text[8] == [ROWS[-1][1]]
    assert line_dedup.line_dedup(docs.limit(0)).isEmpty()


def test_substring_dedup(docs):
    out = substring_dedup.substring_dedup(docs)
    assert out.columns == [*docs.columns, "cut_chars"]
    text = {}
    for r in out.collect():
        text.setdefault(r.doc_id, []).append(r.text)
    assert text[1] == [None] and text[5] == [LONG] and text[6] == ["", ""] and text[7] == [ROWS[9][1]]
    assert sum(map(len, text.values())) == len(ROWS)
    assert substring_dedup.substring_dedup(docs.limit(0)).isEmpty()


def test_byte_bpe(docs):
    out = byte_bpe.decode(byte_bpe.encode(docs)).collect()
    assert sorted(bytes(r.bytes) for r in out) == sorted((t or "").encode() for _, t, *_ in ROWS)
    assert all(len(r.ids) == len(r.starts) for r in out)
    assert byte_bpe.encode(docs.limit(0)).isEmpty()


def test_png(docs):
    out = png_media.media_features(png_media.to_media(docs)).collect()
    assert len(out) == len(ROWS)
    assert all(r.payload_bytes % 576 == 0 and r.payload_bytes > 0 for r in out)
    assert png_media.to_media(docs.limit(0)).isEmpty()


def test_packing(docs):
    out = packing.pack_documents(docs).collect()
    fill = {}
    for r in out:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in fill.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert sum(r.piece == 0 for r in out) == len(ROWS)
    assert {r.length for r in out if r.doc_id in (1, 2, 3)} == {1}
    assert packing.pack_documents(docs.limit(0)).isEmpty()


PAGES = [(1, "http://A.com/x", "<p>a</p>"), (2, None, None), (3, "nothing", ""), (4, "https://b.org/es/1?q#f", "<p>b" * 3000), (4, "https://b.org/es/1?q#f", "<p>b" * 3000),
         (None, "http://c.com/fr/2", "<html><article>x &amp; y"), (6, "http://", "<a href='http://a.com/'>"), (7, "ftp://É.Net/Ü", "\x00<")]


def test_pages(spark):
    pages = spark.createDataFrame([(*p, 1, "x") for p in PAGES], "page_id long, url string, html string, key int, host string")
    out = page_diff.main_text(pages).collect()
    assert sorted((r.page_id or 0, r.text[:5]) for r in out) == [(0, "x & y"), (1, "a"), (2, ""), (3, ""), (4, "b\nb\nb"), (4, "b\nb\nb"), (6, ""), (7, "\x00<")]
    assert page_diff.main_text(pages.limit(0)).isEmpty()
    verdicts = {r.page_id: r for r in url_trust.url_verdicts(pages).collect()}
    assert (verdicts[1].host, verdicts[1].path, verdicts[1].rule, verdicts[1].verdict) == ("a.com", "/x", None, "allow")
    assert (verdicts[2].host, verdicts[2].path, verdicts[2].verdict) == ("", "", "allow")
    assert (verdicts[4].host, verdicts[4].path, verdicts[4].rule) == ("b.org", "/es/1", "org/")
    assert (verdicts[6].host, verdicts[7].host) == ("", "É.net")
    assert url_trust.url_verdicts(pages).count() == len(PAGES)
    assert url_trust.url_verdicts(pages.limit(0)).isEmpty()


def test_vectors(spark):
    inf = float("inf")
    rows = [(k, [float(k % 3), 1.0], "x") for k in range(30)] + [(40, None, "x"), (41, [0.0, 0.0], "x"), (42, [None, 1.0], "x"), (43, [inf, 1.0], "x"), (44, [float("nan"), 1.0], "x"),
                                                                 (None, [1.0, 1.0], "x"), (0, [0.0, 1.0], "x"), (45, [1.0], "x"), (46, [], "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, block string")
    out = anisotropic.search(table, table.filter("vec_id % 20 = 0"), top=5).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in out} == {0, 20}
    # all scores tie for the two equal rows (0, 1) of id 0, so the smallest ids win; each has the other as a candidate
    assert [r.vec_id for r in out if r.query_id == 0] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    assert [(r.vec_id, r.score) for r in out if r.query_id == 20] == [(2, 5.0), (5, 5.0), (8, 5.0), (11, 5.0), (14, 5.0)]
    assert anisotropic.search(table.limit(0), table).isEmpty()
    assert anisotropic.search(table.filter("vec_id < 3"), table.filter("vec_id = 0"), top=5).count() == 6


#: Names that the operators use inside, in other cases too.
CLASHES = ("_gone _cut _cut_text _spans _spanned _mark _rep _head gone cut_id cut_text spans spanned mark rep head N_Removed CUT_CHARS c i_ line pos first _part _hot _parts n "
           "size start hi lo copies cluster component tree label sig piece length sequence_id offset word stats y held_out number block rank times_").split()


def _widened(df):
    for k, name in enumerate(CLASHES):
        df = df.withColumn(name, F.lit(f"user {k}"))
    return df


def test_columns_may_clash(spark, docs, labels):
    wide = _widened(docs.select("doc_id", "text").withColumn("n_chars", F.char_length("text")))
    own = {name: f"user {k}" for k, name in enumerate(CLASHES)}
    plain = docs.select("doc_id", "text")
    rows = lambda df: sorted(map(repr, map(tuple, df.select("doc_id", "text").collect())))
    for made, replaced, same in ((line_dedup.line_dedup(wide, least_lines=1), "n_removed", line_dedup.line_dedup(plain, least_lines=1)),
                                 (line_dedup.passages_removed(wide), "n_removed", line_dedup.passages_removed(plain)),
                                 (substring_dedup.substring_dedup(wide), "cut_chars", substring_dedup.substring_dedup(plain)),
                                 (jaccard_join.near_duplicates_removed(wide), None, jaccard_join.near_duplicates_removed(plain)),
                                 (quality.quality_filtered(wide, labels), None, quality.quality_filtered(plain, labels))):
        assert rows(made) == rows(same)
        first = made.collect()[:3]
        for name, value in own.items():
            if name.lower() != replaced:
                assert name in made.columns and all(r[name] == value for r in first)
    count = len(ROWS)
    assert jaccard_join.jaccard_join(wide).count() == quality.quality_scores(wide, _widened(labels.drop("score"))).count() == count
    assert byte_bpe.encode(wide).count() == png_media.to_media(wide).count() == packing.pack_documents(wide).filter("piece = 0").count() == count
    pages = _widened(spark.createDataFrame(PAGES, "page_id long, url string, html string"))
    assert page_diff.main_text(pages).count() == url_trust.url_verdicts(pages).count() == len(PAGES)
    vectors = _widened(spark.createDataFrame([(k, [1.0, float(k)]) for k in range(5)], "vec_id long, embedding array<double>"))
    assert anisotropic.search(vectors, vectors).count() == 20


def test_pipeline_stages_on_edges(spark, docs, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing columns and empty tables in every stage."""
    import corpus_pipeline

    spark.createDataFrame([(k % 7, k % 2, 0) for k in range(14)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    wide = _widened(docs.select("doc_id", "text").withColumn("n_chars", F.char_length("text").cast("long")))
    given = {(r.doc_id, r.text) for r in wide.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, str(tmp_path))
        assert out.columns == wide.columns, name
        rows = out.collect()
        assert all(r["_gone"] == "user 0" and r["CUT_CHARS"] == f"user {CLASHES.index('CUT_CHARS')}" for r in rows), name
        if name in ("line dedup", "substring dedup"):  # no document goes; null texts stay null
            assert len(rows) == len(ROWS) and sum(r.text is None for r in rows) == 2
            assert all(r.n_chars == len(r.text or "") for r in rows)
        else:
            assert {(r.doc_id, r.text) for r in rows} <= given
        assert stage(spark, wide.limit(0), str(tmp_path)).isEmpty(), name
    packed = corpus_pipeline.STAGES[-1][1](spark, wide, str(tmp_path))
    assert packed.filter("piece = 0").count() == len(ROWS)
    assert corpus_pipeline.STAGES[-1][1](spark, wide.limit(0), str(tmp_path)).isEmpty()
