"""Full-text search with BM25, and lexical selection of evidence and schema context."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions import text as T
from marlstone.plans.materialize import discard, materialize
from marlstone.sources.sinks import read_index, write_index

K1, B = 1.2, 0.75
#: Folders of an index, and the postings of one file of them.
BUCKETS, PART = 64, 5_000_000
_MARKS = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"


def fold(text: Column) -> Column:
    """Lower case without the accents of Latin-1 letters."""
    plain = "".join(unicodedata.normalize("NFD", c)[0] for c in _MARKS)
    return F.translate(F.lower(text), _MARKS, plain)


def tokens(text: Column) -> Column:
    """Runs of letters and digits of the folded text; an underscore splits."""
    return F.filter(F.split(fold(text), "[^0-9a-z\\x{80}-\\x{10FFFF}]+"), lambda t: t != "")


def postings(docs: DataFrame, id_col: str) -> DataFrame:
    """(id, token, tf, length): term counts with the number of tokens of the document.

    Counts are made per document within its row, so only distinct terms are exploded.
    """
    listed = docs.select(F.col(id_col).alias("id"), tokens(F.col("text")).alias("t"))
    each = listed.select("id", F.size("t").alias("length"), F.explode("t").alias("token"))
    return each.groupBy("id", "token").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def query_phrases(query: str) -> list[list[str]]:
    """Each word of the query as its tokens; a word with underscores is a phrase."""
    found = []
    for word in re.findall(r"\w+", query):
        plain = "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))
        part = [t for t in plain.split("_") if t]
        if part:
            found.append(part)
    return found


def bm25(docs: DataFrame, query: str, id_col: str, limit: int = 5, where: Column | None = None) -> DataFrame:
    """(id, score) of the best documents that hold every word of the query.

    Okapi BM25 with k1 1.2 and b 0.75; the inverse document frequency has a floor of
    1e-6. Higher scores are better; ties go by id. Counts of documents are over all of
    `docs`; `where` filters what is returned. Words are literal, never operators.
    """
    phrases = query_phrases(query)
    if not phrases:
        return docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).limit(0)
    scan = docs.select(F.col(id_col).alias("id"), tokens(F.col("text")).alias("t"), (F.lit(True) if where is None else where).alias("wanted"))

    def frequency(phrase: list[str]) -> Column:
        if len(phrase) == 1:
            return F.size(F.filter("t", lambda x: x == phrase[0]))
        spots = F.sequence(F.lit(0), F.greatest(F.size("t") - len(phrase), F.lit(-1) + 0))
        fits = lambda i: F.array_join(F.slice("t", i + 1, len(phrase)), " ") == " ".join(phrase)
        return F.when(F.size("t") >= len(phrase), F.size(F.filter(spots, fits))).otherwise(0)

    names = [f"f{k}" for k in range(len(phrases))]
    # texts are read and split once: a few numbers a document are kept
    counted = materialize(scan.select("id", "wanted", F.size("t").alias("dl"), *[frequency(p).alias(f) for p, f in zip(phrases, names, strict=True)]), "counts")
    # one row of totals, so its broadcast is of a fixed size
    total = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f) > 0).alias(f"n_{f}") for f in names])
    joined = counted.filter(" and ".join(f"{f} > 0" for f in names) + " and wanted").join(F.broadcast(total))
    return _ranked(joined, names, limit)


def _ranked(joined: DataFrame, names: list[str], limit: int) -> DataFrame:
    """The best rows (id, dl, n, avgdl, and of each word its count f and its documents n_f)."""
    score = F.lit(0.0)
    for f in names:
        idf = F.ln((F.col("n") - F.col(f"n_{f}") + 0.5) / (F.col(f"n_{f}") + 0.5))
        idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
        score = score + idf * F.col(f) * (K1 + 1) / (F.col(f) + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return joined.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def build_index(docs: DataFrame, id_col: str, target: str) -> None:
    """Write an index that queries read without the texts: postings in folders by a hash of
    the token, and one row of totals (documents, and their mean number of tokens)."""
    made = materialize(postings(docs, id_col), "postings")
    write_index(made, f"{target}/postings", BUCKETS, max(1, -(-made.count() // (BUCKETS * PART))))
    discard(made)
    docs.select(F.size(tokens(F.col("text"))).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).write.parquet(f"{target}/totals")


def search_index(spark: SparkSession, target: str, query: str, limit: int = 5) -> DataFrame:
    """(id, score): what `bm25` returns, from an index that `build_index` wrote. Only the
    folders of the query's words are read. The index keeps no positions: ValueError for a
    phrase (a word with underscores)."""
    phrases = query_phrases(query)
    if any(len(p) > 1 for p in phrases):
        raise ValueError("the index keeps no positions, so it cannot find phrases")
    words = [p[0] for p in phrases]
    totals = spark.read.parquet(f"{target}/totals")
    if not words:
        return spark.read.parquet(f"{target}/postings").select("id", F.lit(0.0).alias("score")).limit(0)
    hits = read_index(spark, f"{target}/postings", sorted(set(words)), BUCKETS)
    names = {w: f"f{k}" for k, w in enumerate(sorted(set(words)))}
    counts = [F.sum(F.when(F.col("token") == w, F.col("tf")).otherwise(0)).alias(f) for w, f in names.items()]
    df = hits.agg(*[F.count_if(F.col("token") == w).alias(f"n_{f}") for w, f in names.items()])
    each = hits.groupBy("id").agg(F.first("length").alias("dl"), *counts).filter(" and ".join(f"{f} > 0" for f in names.values()))
    # two tables of one row each
    return _ranked(each.join(F.broadcast(totals)).join(F.broadcast(df)), [names[w] for w in words], limit)


def shared_terms(text: Column, question: str) -> Column:
    """How many distinct terms of the question the text holds."""
    wanted = F.array(*[F.lit(w) for w in sorted({w for w in re.split(r"[^\w]+", question.lower()) if len(w.encode()) > 2})] or [F.lit("")])
    return F.size(F.array_intersect(T.terms(text), wanted))


def evidence(records: DataFrame, question: str, dialect: str, limit: int = 4) -> DataFrame:
    """The best records (id, version, dialect, title, text, source) of the dialect or
    'generic' by shared terms, ties by id, with score and citation; none without a match."""
    scored = records.filter(F.col("dialect").isin(dialect, "generic")).withColumn(
        "score", shared_terms(F.concat_ws(" ", "title", "text"), question)).filter("score > 0")
    return scored.withColumn("citation", F.concat(F.lit("[evidence:"), "id", F.lit("@"), "version", F.lit("]"))).orderBy(F.desc("score"), "id").limit(limit)


def uncited(answer_citations: DataFrame, supplied: DataFrame) -> DataFrame:
    """Citations of an answer that were not supplied; any row rejects the answer."""
    return answer_citations.select("citation").subtract(supplied.select("citation"))


def schema_context(columns: DataFrame, question: str, limit: int) -> DataFrame:
    """The tables of a catalog (position, table_name, column_name) that fit the question.

    All tables if there are at most `limit`. Else a table scores 100 if the question names
    it, or 10 for each term its name shares with it, and 1 for each of its columns that is
    named; the best `limit` with a score are kept, in catalog order. ValueError if nothing
    scores or the question names more tables than the limit.
    """
    asked = sorted({w for w in re.split(r"[^\w]+", question.lower()) if len(w.encode()) > 2})
    wanted = F.array(*[F.lit(w) for w in asked] or [F.lit("")])
    name = F.lower("table_name")
    scored = columns.groupBy("position", "table_name").agg(F.count_if(F.array_contains(wanted, F.lower("column_name"))).alias("named")).withColumn(
        "score", F.when(F.array_contains(wanted, name), 100).otherwise(F.size(F.array_intersect(T.terms(name), wanted)) * 10) + F.col("named"))
    if scored.count() <= limit:
        return scored.select("position", "table_name", F.col("score").cast("long").alias("score")).orderBy("position")
    exact, some = scored.agg(F.count_if(F.col("score") >= 100), F.count_if(F.col("score") > 0)).first()
    if not some:
        raise ValueError("No table or column matches the question; name the ones that are needed.")
    if exact > limit:
        raise ValueError("The question names more tables than the limit.")
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "position"))
    best = scored.filter("score > 0").withColumn("_r", rank).filter(F.col("_r") <= limit)
    return best.select("position", "table_name", F.col("score").cast("long").alias("score")).orderBy("position")
