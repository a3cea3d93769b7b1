"""Line dedup: content-defined chunks of lines, removed where they repeat anywhere.

A hash rolls over the hashes of each two consecutive lines, and a chunk ends where it is less
than before and after, so chunk borders depend on four near lines only and an inserted line
moves no border further away. No two borders adjoin and none stands next to an end of the
text, so every chunk has two lines at least, three on the average (a text of one line is one
chunk). Chunks of two lines or more that occur more than once in all documents are removed,
but for the first occurrence (least doc_id, then position). The lines between a passage's
ends and its first and last border belong to chunks with foreign lines and stay.

`passages_removed`, which the pipeline uses, has no chunks: two line hashes roll over every
position, so that all repeated runs of two lines or more go, wherever they start and end.

Counting moves hashes only; the texts of chunks whose hash repeats are then fetched and
grouped by their bytes, so a clash of hashes removes nothing. Only DataFrame functions
are used; groups are counted with map-side combine and joins spread hot chunks over tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.names import fresh, without
from marlstone.operators.skew import salted_join, total_of
from marlstone.plans.materialize import materialize

LEAST_LINES = 2
#: The hash of a line and the one before: code + FACTOR * code before, modulo MODULUS.
FACTOR, MODULUS = 5, 1 << 32


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once a row."""
    return F.transform(F.array(value), use)[0]


def line_chunks(text: Column) -> Column:
    """array<struct<pos int, lines int, body string>> of a text; joined by newlines the
    bodies give the text back. Null for a null text."""
    code = lambda line: F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")

    def cut(lines: Column, rolled: Column) -> Column:
        last = F.size(lines) - 1
        ends = F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (
            (i > 0) & (i < last - 1) & (rolled[i] < F.get(rolled, i - 1)) & (rolled[i] < F.get(rolled, i + 1))))
        return _let(ends, lambda e: F.transform(e, lambda end, k: _let(
            F.when(k == 0, F.lit(0)).otherwise(e[F.greatest(k - 1, F.lit(0))] + 1), lambda start: F.struct(
                k.alias("pos"), (end - start + 1).alias("lines"), F.array_join(F.slice(lines, start + 1, end - start + 1), "\n").alias("body")))))

    roll = lambda codes: F.transform(codes, lambda c, i: (c + F.lit(FACTOR) * codes[F.greatest(i - 1, F.lit(0))]) % MODULUS)
    return _let(F.split(text, "\n", -1), lambda lines: _let(F.transform(lines, code), lambda codes: _let(roll(codes), lambda rolled: cut(lines, rolled))))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               least_lines: int = LEAST_LINES, count_col: str = "n_removed") -> DataFrame:
    """The documents, all columns, with repeated chunks cut from the text, and `count_col`,
    the number of chunks cut (an existing column of that name is replaced).

    A text that repeats in full is left empty. Null texts and rows with a null id are left
    as they are. Rows of one id count as one document, so a repeated row stays whole where
    it holds the first occurrence. Texts of one line always stay. Empty input gives an
    empty result.
    """
    kept_columns = without(docs.columns, count_col)
    marks, cut_id = fresh(docs.columns, "gone", "cut_id")
    named = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    cut = F.explode(F.filter(line_chunks(F.col("_text")), lambda c: c["lines"] >= least_lines)).alias("c")
    seen = (named.filter("_id is not null and _text is not null").select("_id", cut)
            .select("_id", F.col("c.pos").alias("pos"), F.xxhash64("c.body").alias("h")))
    often = materialize(seen.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "often")
    hits = salted_join(seen, often, ["h"], "n", total_of(often, "n"), ["_id", "pos"]).groupBy("_id").agg(F.collect_set(F.struct("pos", "h")).alias("hits"))
    bodies = materialize(
        named.join(hits, "_id").select("_id", "hits", cut)
        .select("_id", "hits", F.col("c.pos").alias("pos"), F.col("c.body").alias("body"), F.xxhash64("c.body").alias("h"))
        .filter(F.array_contains("hits", F.struct("pos", "h"))).select("_id", "pos", "h", "body"), "chunks")
    groups = materialize(bodies.groupBy("h", "body").agg(F.min(F.struct("_id", "pos")).alias("first"), F.count("*").alias("n")).filter("n > 1"), "groups")
    gone = (salted_join(bodies, groups, ["h", "body"], "n", total_of(groups, "n"), ["_id", "pos"]).filter(F.struct("_id", "pos") != F.col("first"))
            .groupBy(F.col("_id").alias(cut_id)).agg(F.collect_set(F.struct("pos", "h")).alias(marks)))
    base = docs.select(*kept_columns)
    joined = base.join(gone, base[id_col] == F.col(cut_id), "left")
    chunks = line_chunks(F.col(text_col))
    left = _let(chunks, lambda all_: F.filter(all_, lambda c: ~F.array_contains(marks, F.struct(c["pos"], F.xxhash64(c["body"]).alias("h")))))
    kept = _let(left, lambda some: F.array_join(F.transform(some, lambda c: c["body"]), "\n"))
    columns = [F.when(F.col(marks).isNull(), F.col(c)).otherwise(kept).alias(c) if c.lower() == text_col.lower() else F.col(c) for c in kept_columns]
    return joined.select(*columns, F.coalesce(F.size(marks), F.lit(0)).alias(count_col))


def _pairs(text: Column) -> Column:
    """array<struct<pos int, h binary>>: the digest of each two adjacent lines of a text."""
    digest = lambda a, b: F.unhex(F.sha2(F.concat_ws("\n", a, b), 256))
    return _let(F.split(text, "\n", -1), lambda lines: F.transform(
        F.slice(lines, 2, F.size(lines)), lambda line, i: F.struct(i.alias("pos"), digest(lines[i], line).alias("h"))))


def passages_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_removed") -> DataFrame:
    """The documents, all columns, without the runs of two lines or more that occurred before
    (by doc_id, then position), and `count_col`, the number of lines cut (an existing column
    of that name is replaced).

    A line goes where it and a line next to it stood next to each other before, so a passage
    goes whole whatever surrounds it, and the first occurrence of every line stays. Of a pair
    that overlaps its own first occurrence only the second line goes. Pairs are compared by
    256-bit digest. A text that repeats in full is left empty. Null texts, texts of one line
    and rows with a null id are left as they are. Rows of one id and text count as one
    document. Empty input gives an empty result.
    """
    kept_columns = without(docs.columns, count_col)
    marks, cut_id, cut_text = fresh(docs.columns, "gone", "cut_id", "cut_text")
    named = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text"), F.col(text_col).alias("_body"))
    seen = (named.filter(F.col("_id").isNotNull() & F.col("_body").contains("\n"))
            .select("_id", "_text", F.explode(_pairs(F.col("_body"))).alias("c")).select("_id", "_text", "c.pos", "c.h"))
    firsts = materialize(seen.groupBy("h").agg(F.min(F.struct("_id", "_text", "pos")).alias("first"), F.count("*").alias("n")).filter("n > 1"), "firsts")
    again = salted_join(seen, firsts, ["h"], "n", total_of(firsts, "n"), ["_id", "_text", "pos"]).filter(F.struct("_id", "_text", "pos") != F.col("first"))
    overlaps = F.struct("_id", "_text", (F.col("pos") - 1).alias("pos")) == F.col("first")
    at = F.when(overlaps, F.array(F.col("pos") + 1)).otherwise(F.array(F.col("pos"), F.col("pos") + 1))
    gone = (again.select(F.col("_id").alias(cut_id), F.col("_text").alias(cut_text), F.explode(at).alias("line"))
            .groupBy(cut_id, cut_text).agg(F.collect_set("line").alias(marks)))
    base = docs.select(*kept_columns)
    joined = base.join(gone, (base[id_col] == F.col(cut_id)) & (F.xxhash64(base[text_col]) == F.col(cut_text)), "left")
    # a mark sorts just before the line that it removes
    item = lambda pos, kind, line: F.struct(pos.alias("pos"), F.lit(kind).alias("kind"), line.alias("line"))
    items = F.array_sort(F.concat(
        F.transform(F.split(text_col, "\n", -1), lambda line, i: item(i, 1, line)),
        F.transform(marks, lambda i: item(i, 0, F.lit("")))))
    kept = _let(items, lambda all_: F.array_join(F.transform(F.filter(
        all_, lambda e, k: (e["kind"] == 1) & (F.coalesce(F.get(all_, k - 1)["kind"], F.lit(1)) == 1)), lambda e: e["line"]), "\n"))
    columns = [F.when(F.col(marks).isNull(), F.col(c)).otherwise(kept).alias(c) if c.lower() == text_col.lower() else F.col(c) for c in kept_columns]
    return joined.select(*columns, F.coalesce(F.size(marks), F.lit(0)).alias(count_col))


def oracle_sql(least_lines: int = LEAST_LINES) -> str:
    """doc_id, text, n_removed over the view `documents`, for DuckDB."""
    return f"""
    with lines as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i from documents),
      codes as (select *, ('0x' || substr(md5(line), 1, 8))::bigint as code, count(*) over (partition by doc_id) as size from lines),
      rolled as (select *, (code + {FACTOR} * coalesce(lag(code) over w, code)) % {MODULUS} as h from codes window w as (partition by doc_id order by i)),
      ends as (select *, case when i > 0 and i < size - 2 and h < lag(h) over w and h < lead(h) over w then 1 else 0 end as last from rolled window w as (partition by doc_id order by i)),
      placed as (select *, coalesce(sum(last) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as pos from ends),
      chunks as (select doc_id, pos, count(*) as n, string_agg(line, chr(10) order by i) as body from placed group by 1, 2),
      marked as (select *, n >= {least_lines} and row_number() over (partition by body, n >= {least_lines} order by doc_id, pos) > 1 as gone from chunks)
    select doc_id, coalesce(string_agg(body, chr(10) order by pos) filter (where not gone), '') as text, (count(*) filter (where gone))::int as n_removed
    from marked group by 1"""
