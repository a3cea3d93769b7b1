import json

import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import search
from marlstone.operators.history import DEFAULT_TITLE, History
from marlstone.sources import extract, sinks


def test_markdown_cleans_prose_and_leaves_fences():
    page = ("---\nlayout: wide\ntitle: \"Window frames\"\n---\n"
            "<!-- draft -->Rows <span class=x>before</span>, see {% link ../ranks.md %}.\n"
            "{% tabs %}{% tab title=\"First engine\" %}one{% endtab %}{% endtabs %}\n"
            "~~~text\n{% hint %} <div>kept</div> {{ kept }} <!-- kept -->\n~~~\nend")
    clean, flags = extract.markdown(page)
    assert clean == ("# Window frames\n\nRows before, see ../ranks.md.\n\n### First engine\none\n"
                     "~~~text\n{% hint %} <div>kept</div> {{ kept }} <!-- kept -->\n~~~\nend")
    assert flags == []


def test_markdown_flags_templates_and_keeps_headings():
    assert extract.markdown("# Own\n{% include 'part.md' %} and {{ name }}") == ("# Own\n{% include 'part.md' %} and {{ name }}", [extract.UNRESOLVED_TEMPLATE])
    assert extract.markdown("---\ntitle: Other\n---\n# Own\nx")[0] == "# Own\nx"
    assert extract.markdown("---\nno: title\n---\nx") == ("x", [])
    assert extract.markdown("<p>a</p>\r\n") == ("a", [])


def test_docbook_titles_listings_and_references():
    page = ("<chapter id=\"c\"><title>Joins   of\n tables</title><para>Left  <emphasis>and</emphasis>\n right, in &version; and &major;.</para>"
            "<programlisting>a   |  b &gt; 3\n--+--</programlisting><para>c <xref linkend=\"joins-full\"/> d<indexterm><primary>not <b>this</b></primary></indexterm></para></chapter>")
    text, unresolved = extract.docbook(page, "9.1")
    assert text.startswith("## Joins of tables") and "Left and right, in 9.1 and &major;." in text
    assert "```\na   |  b > 3\n--+--\n```" in text and "c [reference: joins-full] d" in text and "this" not in text
    assert unresolved == ["major"]


def test_docbook_elements_that_close_themselves():
    text, _ = extract.docbook("<para>a</para><programlisting/><para>c   d</para><indexterm/>e   f<para><indexterm>x<y/>z</indexterm>g  h</para>")
    assert "c d" in text and "e f" in text and "g h" in text and "x" not in text
    assert text.count("```") == 2


def test_decode_by_mark_and_fallback():
    word = "Größe → größer"
    assert extract.decode(word.encode("utf-16-be")) == (None, "binary or unmarked UTF-16")
    assert extract.decode(b"\xfe\xff" + word.encode("utf-16-be")) == (word, "utf-16")
    assert extract.decode(b"\xff\xfea") == (None, "damaged UTF-16")
    assert extract.decode(b"\xef\xbb\xbf" + word.encode()) == (word, "utf-8")
    assert extract.decode("Größe".encode("cp1252")) == ("Größe", "cp1252")
    assert extract.decode(b"\x81\x8d") == (None, "no known encoding")


def test_extract_files(spark):
    files = spark.createDataFrame([("a.md", b"# x"), ("b.sgml", b"<para>y</para>"), ("c.sql", b" select 1\r\n"), ("d.bin", b"\0"), ("e.txt", None), ("f.md", b"caf\xe9"), ("g.sgml", b"&some;")], "path string, content binary")
    out = {r.path: r for r in extract.extract(files).collect()}
    assert [out[p].text for p in ("a.md", "b.sgml", "c.sql", "d.bin", "e.txt")] == ["# x", "y", "select 1", None, ""]
    assert out["d.bin"].error
    assert (out["f.md"].text, out["f.md"].flags, out["g.sgml"].flags) == ("café", [extract.LEGACY], [extract.UNRESOLVED_ENTITY])


def test_publish_is_whole_and_never_replaces(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", None), (1, "a", 3)], "z int, a string, m int")
    target = str(tmp_path / "out")
    sinks.publish({"rows": df.coalesce(1)}, target, "jsonl")
    lines = sorted(x for f in (tmp_path / "out" / "rows").glob("part-*") for x in f.read_text().splitlines())
    assert lines == ['{"a":"a","m":3,"z":1}', '{"a":"b","m":null,"z":2}']
    with pytest.raises(FileExistsError):
        sinks.publish({"rows": df}, target)
    with pytest.raises(Exception):  # noqa: B017, PT011
        sinks.publish({"rows": df.select(F.raise_error(F.lit("no")))}, str(tmp_path / "bad"))
    assert {p.name for p in tmp_path.iterdir()} == {"out"}
    sinks.export_json({"a": "1"}, str(tmp_path / "x.json"))
    assert json.loads((tmp_path / "x.json").read_text()) == {"a": "1"}
    with pytest.raises(FileExistsError):
        sinks.export_json({}, str(tmp_path / "x.json"))


def test_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c")], "doc_id long, text string")
    sinks.write_index(search.postings(docs, "doc_id"), str(tmp_path / "index"))
    found = sinks.read_index(spark, str(tmp_path / "index"), ["a", "c"]).orderBy("token").collect()
    assert [(r.id, r.token, r.tf, r.length) for r in found] == [(1, "a", 2, 3), (2, "c", 1, 2)]


def test_history(spark, tmp_path):
    h = History(spark, str(tmp_path / "h"))
    h.save_profile(("p1", "one", "sqlite", "/x", False, "prefer", "t0"))
    h.save_profile(("p2", "two", "sqlite", "/y", False, "prefer", "t0"))
    h.save_profile(("p1", "renamed", "sqlite", "/x", True, "prefer", "t1"))
    h.add_session(("s1", "p1", DEFAULT_TITLE, "chat", "t0", "t0"))
    h.add_message(("m1", "s1", "user", "  how   many\nrows? ", "t1"))
    h.add_message(("m2", "s1", "assistant", "so:\n```sql\nselect 1\n```", "t2"))
    h.add_message(("m3", "s1", "user", "another", "t3"))
    h.backfill_outputs("t4")
    h.backfill_outputs("t5")
    h.save_output(("o9", "s1", "m2", "select 2", None, "t6"))
    assert [r.name for r in h.profiles().collect()] == ["renamed", "two"]
    assert [r.title for r in h.sessions("p1").collect()] == ["how many rows?"]
    assert [r.id for r in h.messages("s1").collect()] == ["m1", "m2", "m3"]
    assert [r.sql for r in h.outputs("s1").collect()] == ["select 1"]
    exported = json.loads(open(h.export_output(h.outputs("s1").first().id, str(tmp_path))).read())
    assert exported["sql"] == "select 1" and exported["session_id"] == "s1"
    with pytest.raises(KeyError):
        h.export_output("none", str(tmp_path))
    h.delete_profile("p1")
    assert [r.id for r in h.profiles().collect()] == ["p2"]
    assert h.read("chat_messages").isEmpty() and h.read("query_outputs").isEmpty()


def test_answers(spark):
    rows = [("```sql\nselect 1\n```", "chroma"), ("```sql\nselect 1\n```", "mixed"), ("```python\nc.add(x)\n```", "mixed"), ("c.add(x)", "chroma"), ("```python\nc.query(x)\n```", "chroma"),
            ("```python\nc.add(x)\n```", "sql")]
    df = spark.createDataFrame(rows, "a string, k string")
    assert [r.e for r in df.select(T.answer_error(F.col("a"), F.col("k")).alias("e")).collect()] == ["sql for a vector source", None, "changes a collection", None, None, None]
    name, rest = T.slash_command(F.col("a"))
    got = spark.createDataFrame([("/plan do it",), ("/other x",), ("hello",)], "a string").select(name.alias("n"), rest.alias("r")).collect()
    assert [tuple(r) for r in got] == [("plan", "do it"), ("", "/other x"), ("", "hello")]
