"""Text, listing and result operators, each over rows of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import dml, manifest
from marlstone.operators.ranges import running_total
from marlstone.plans import execute, gate
from marlstone.session import table
from marlstone.sources import catalog, extract, sinks, web


def jsonl_rows(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as JSON lines with sorted keys."""
    return sinks.jsonl(table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_name", F.when(F.col("s_suppkey") % 4 > 0, F.col("s_name")).alias("alias")))


def slash_commands(spark: SparkSession, d: str) -> DataFrame:
    """Commands that open messages, and the length of what follows."""
    k = F.col("turn") % 4
    message = F.concat(F.when(k == 0, "/plan ").when(k == 1, "/remarks\n").when(k == 2, "/other ").otherwise(""), "text")
    name, rest = T.slash_command(message)
    return table(spark, d, "conversations").select("conv_id", "turn", name.alias("command"), F.char_length(rest).cast("long").alias("rest_chars"))


def answer_gate(spark: SparkSession, d: str) -> DataFrame:
    """Answers with code behind them, and why a vector source refuses them."""
    k = F.col("turn") % 4
    answer = F.concat("text", F.when(k == 0, "\n```sql\nselect 1\n```").when(k == 1, "\n```python\nc.add(x)\n```").when(k == 2, "\n```python\nc.query(x)\n```").otherwise(""))
    kind = F.element_at(F.array(F.lit("chroma"), F.lit("mixed"), F.lit("sql")), (F.col("conv_id") % 3 + 1).cast("int"))
    made = table(spark, d, "conversations").select(kind.alias("kind"), F.coalesce(T.answer_error(answer, kind), F.lit("")).alias("error"))
    return made.groupBy("kind", "error").agg(F.count("*").alias("n"))


def document_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles of documents, some of which get a heading, else their name."""
    k = F.col("doc_id")
    body = F.concat(F.when(k % 3 == 0, F.concat(F.lit("intro\n### Part "), k.cast("string"), F.lit("\n"))).otherwise(""), "text")
    return table(spark, d, "documents").select("doc_id", T.title(body, F.concat(F.lit("doc-"), k.cast("string"))).alias("title"))


def license_classes(spark: SparkSession, d: str) -> DataFrame:
    """Documents by license and eligibility: a marker in the page overrides the declared one."""
    k = F.col("doc_id")
    raw = F.concat(F.when(k % 5 == 0, "This page is licensed: **GPLv2**\n").when(k % 5 == 1, "Adapted from a book.\n").otherwise(""), "text")
    name, eligible = T.license_of(raw, F.when(k % 2 == 0, "MIT").otherwise("Other"), k % 7 != 0)
    return table(spark, d, "documents").select(name.alias("license"), eligible.alias("eligible")).groupBy("license", "eligible").agg(F.count("*").alias("n"))


def decoded_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files in three encodings, decoded: identity and encoding."""
    k = F.col("doc_id") % 3
    content = F.when(k == 0, F.encode("text", "utf-8")).when(k == 1, F.encode("text", "utf-16")).otherwise(F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "utf-8")))
    made = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), content.alias("content"))
    return extract.extract(made).select(F.col("path").cast("long").alias("doc_id"), "encoding", T.digest(F.col("text")).alias("id"))


def markdown_pages(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as Markdown with front matter, wrappers and a fence, cleaned."""
    k = F.col("item_id").cast("string")
    page = F.concat(F.lit("---\ntitle: Item "), k, F.lit("\n---\n<!-- c --><div class='x'>"), "text", F.lit("</div>\n```sql\nselect '<p>' -- "), k, F.lit("\n```\n"))
    made = table(spark, d, "benchmark").select(F.concat(k, F.lit(".md")).alias("path"), F.encode(page, "utf-8").alias("content"))
    return extract.extract(made).select(F.split("path", r"\.")[0].cast("long").alias("item_id"), T.digest(F.col("text")).alias("id"), F.size("flags").alias("flags"))


def docbook_pages(spark: SparkSession, d: str) -> DataFrame:
    """Nations as DocBook: headings, collapsed text, listings kept, an entity unresolved in some."""
    k = F.col("n_nationkey")
    page = F.concat(F.lit("<title>"), "n_name", F.lit("</title><para>Key   of\n it</para><screen>a  &lt; "), k.cast("string"), F.lit("</screen>"), F.when(k % 2 == 0, "<para>&none;</para>").otherwise(""))
    made = table(spark, d, "nation").select(F.concat(k.cast("string"), F.lit(".sgml")).alias("path"), F.encode(page, "utf-8").alias("content"))
    return extract.extract(made).select(F.split("path", r"\.")[0].cast("long").alias("n_nationkey"), "text", F.array_join("flags", ",").alias("flags"))


def listing_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of HTML tables made from nations: cells without markup."""
    row = F.concat(F.lit("<tr><td><b>"), "n_name", F.lit("</b></td>\n<td> key  "), F.col("n_nationkey").cast("string"), F.lit(" </td></tr>"))
    pages = table(spark, d, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("<table>"), F.array_join(F.array_sort(F.collect_list(row)), ""), F.lit("</table>")).alias("html"))
    return web.table_rows(pages, "n_regionkey").select("n_regionkey", F.col("row").cast("long").alias("row"), F.array_join("cells", "|").alias("cells"))


def selected_entries(spark: SparkSession, d: str) -> DataFrame:
    """Parts as catalog entries: which are selected, and by what."""
    entries = table(spark, d, "part").select(F.col("p_name").alias("title"), F.col("p_type").alias("category"))
    return web.catalog_selection(entries, ("ECONOMY",), "^small", "ring$").groupBy("category", "selected", "reason").agg(F.count("*").alias("n"))


def derived_urls(spark: SparkSession, d: str) -> DataFrame:
    """Urls that follow from those of pages, less those that are known."""
    urls = table(spark, d, "pages").select("url").distinct()
    known = table(spark, d, "pages").filter("page_id % 2 = 0").select(F.regexp_replace("url", r"^(https?://[^/]+)/(.+)$", "$1/api/$2").alias("url")).distinct()
    return web.derived_urls(urls, r"^(https?://[^/]+)/(.+)$", "$1/api/$2", known).select("derived")


def manifest_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Hosts with the releases that refer to them, after new references arrive."""
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    pages = table(spark, d, "pages").select(host.alias("url"), (F.col("page_id") % 5).cast("string").alias("reference"), "page_id")
    old = pages.filter("page_id % 3 = 0").groupBy("url").agg(F.collect_set("reference").alias("references"))
    return manifest.upsert_references(old, pages.filter("page_id % 3 > 0").select("url", "reference")).select("url", F.array_join("references", ",").alias("references"))


def snapshot_errors(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots with an unsafe folder, a commit that is none, or another scheme."""
    k = F.col("s_suppkey")
    made = table(spark, d, "supplier").select(
        F.when(k % 7 == 0, F.concat(F.lit("../"), k.cast("string"))).otherwise(F.concat(F.lit("repo-"), k.cast("string"))).alias("directory"),
        F.when(k % 5 == 0, "main").otherwise(F.sha1(F.encode(k.cast("string"), "utf-8"))).alias("commit"), F.when(k % 11 == 0, "http://a.b/c").otherwise("https://a.b/c").alias("url"))
    return manifest.metadata_errors(made).select("directory", F.array_join("errors", ",").alias("errors"))


def seeded_rows(spark: SparkSession, d: str) -> DataFrame:
    """Nations with seeds added where their key is missing."""
    have = table(spark, d, "nation").filter("n_nationkey % 3 > 0").select("n_nationkey", "n_name")
    return manifest.seed_missing(have, table(spark, d, "nation").select("n_nationkey", F.lower("n_name").alias("n_name")), "n_nationkey")


def bounded_projection(spark: SparkSession, d: str) -> DataFrame:
    """Explicit columns of an ordered table up to a limit, and whether rows were left out."""
    orders = table(spark, d, "orders").orderBy("o_orderkey")
    out = []
    for limit in (3, 10_000):
        rows, truncated = catalog.bounded_read(orders.filter("o_orderkey < 9"), ["o_orderkey", "o_custkey"], limit)
        out += [(limit, r[0], r[1], truncated) for r in rows]
    return spark.createDataFrame(out, "row_limit long, o_orderkey long, o_custkey long, truncated boolean")


def result_sample(spark: SparkSession, d: str) -> DataFrame:
    """The first rows of a capped result, and whether the sample says that it is not whole."""
    kept, note = execute.sample(execute.fetch(table(spark, d, "customer").orderBy("c_custkey").select("c_custkey"), 50), 5)
    return spark.createDataFrame([(r[0], kept.truncated, "5 of 50" in note) for r in kept.rows], "c_custkey long, truncated boolean, noted boolean")


def running_budget(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items in order while their bytes, added up, fit a budget."""
    sized = table(spark, d, "benchmark").select("item_id", F.octet_length("text").cast("long").alias("bytes"))
    return running_total(sized, "item_id", F.col("bytes"), "total").filter(F.col("total") <= 5000)


def enforcement(spark: SparkSession, d: str) -> DataFrame:
    """Which operations run without a confirmation, and with one."""
    rows = []
    for operation in gate.LABELS:
        for confirmed in (False, True):
            try:
                gate.permit(gate.Assessment.of(operation), confirmed)
                rows.append((operation, confirmed, True))
            except gate.Refused:
                rows.append((operation, confirmed, False))
    return spark.createDataFrame(rows, "operation string, confirmed boolean, runs boolean")


def immutable_ledger(spark: SparkSession, d: str) -> DataFrame:
    """What a posted table refuses."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    tries = {"update": lambda: dml.update(lines, F.lit(True), {"l_quantity": F.lit(0.0)}, immutable=True), "delete": lambda: dml.delete(lines, F.lit(True), immutable=True),
             "upsert": lambda: dml.upsert(lines, lines, ["l_orderkey", "l_linenumber"], immutable=True), "insert": lambda: dml.insert_ignore(lines, lines, ["l_orderkey", "l_linenumber"])}
    rows = []
    for name, change in tries.items():
        try:
            change()
            rows.append((name, False))
        except dml.Immutable:
            rows.append((name, True))
    return spark.createDataFrame(rows, "operation string, refused boolean")


_SNAPSHOT = ("nation", "region", "supplier")


def catalog_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The session's own catalog: columns of three views in order, with their keys."""
    for t in _SNAPSHOT:
        table(spark, d, t).createOrReplaceTempView(f"snapshot_{t}")
    found = catalog.snapshot(spark, primary={"snapshot_nation": ("n_nationkey",), "snapshot_region": ("r_regionkey", "r_name")})
    return found.filter(F.col("table_name").isin(*[f"snapshot_{t}" for t in _SNAPSHOT])).select(
        "table_name", "kind", F.col("position").cast("long").alias("position"), "column_name", F.coalesce("key", F.lit("")).alias("key"))


def canonical_urls(spark: SparkSession, d: str) -> DataFrame:
    """Urls of pages within two domains in canonical form, and how many are refused."""
    urls = table(spark, d, "pages").select(F.concat("url", F.lit("#part")).alias("url"))
    made = web.canonical_within(urls, ("example.org", "example.net"))
    return made.groupBy(F.coalesce("canonical", F.lit("")).alias("canonical"), F.coalesce("error", F.lit("")).alias("error")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    jsonl_rows, slash_commands, answer_gate, document_titles, license_classes, decoded_files, markdown_pages, docbook_pages, listing_rows, selected_entries, derived_urls, manifest_upsert,
    snapshot_errors, seeded_rows, bounded_projection, result_sample, running_budget, enforcement, immutable_ledger, catalog_snapshot, canonical_urls)}

_S = "[ \\t\\n\\r\\f\\v]"
_STRIP = "regexp_replace(regexp_replace({0}, '^" + _S + "+', ''), '" + _S + "+$', '')"

ORACLE_SQL = {
    "jsonl_rows": """select '{"alias":' || case when s_suppkey % 4 > 0 then '"' || s_name || '"' else 'null' end || ',"s_name":"' || s_name || '","s_nationkey":' || s_nationkey ||
        ',"s_suppkey":' || s_suppkey || '}' as value from supplier""",
    "slash_commands": f"""select conv_id, turn, case turn % 4 when 0 then 'plan' when 1 then 'remarks' else '' end as command, case when turn % 4 < 2 then
        length(regexp_replace(text, '^[ \\t\\n]*', '')) else length(text) + case when turn % 4 = 2 then 7 else 0 end end as rest_chars from conversations""",
    "answer_gate": """select kind, error, count(*) as n from (select kind, case when kind = 'chroma' and t = 0 then 'sql for a vector source'
        when kind in ('chroma', 'mixed') and t = 1 then 'changes a collection' else '' end as error from (
          select ['chroma', 'mixed', 'sql'][conv_id % 3 + 1] as kind, turn % 4 as t from conversations)) group by 1, 2""",
    "document_titles": """select doc_id, case when h <> '' then h else 'doc-' || doc_id end as title from (select doc_id, case when doc_id % 3 = 0 then 'Part ' || doc_id
        else regexp_extract(text, '(?m)^#{1,6}[ \\t]+(.+)$', 1) end as h from documents)""",
    "license_classes": """select license, eligible, count(*) as n from (select case when doc_id % 5 = 0 then 'GPLv2' when doc_id % 2 = 0 then 'MIT' else 'Other' end as license,
        doc_id % 7 <> 0 and doc_id % 5 > 1 and doc_id % 2 = 0 and not regexp_matches(text, '(?i)adapted from|copied.{0,30}(?:from|permission)|originally from') as eligible from documents) group by 1, 2""",
    "decoded_files": f"""select doc_id, case doc_id % 3 when 1 then 'utf-16' else 'utf-8' end as encoding,
        sha256({_STRIP.format("replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))")}) as id from documents""",
    "markdown_pages": """select item_id, sha256('# Item ' || item_id || chr(10) || chr(10) || text || chr(10) || '```sql' || chr(10) || 'select ''<p>'' -- ' || item_id || chr(10) || '```') as id,
        0 as flags from benchmark""",
    "docbook_pages": """select n_nationkey, '## ' || n_name || repeat(chr(10), 4) || 'Key of it' || repeat(chr(10), 4) || '```' || chr(10) || 'a  < ' || n_nationkey || chr(10) || '```' ||
        case when n_nationkey % 2 = 0 then repeat(chr(10), 4) || '&none;' else '' end as text, case when n_nationkey % 2 = 0 then 'unresolved_sgml_entities' else '' end as flags from nation""",
    "listing_rows": "select n_regionkey, row_number() over (partition by n_regionkey order by n_name || '</b>') - 1 as row, n_name || '|key ' || n_nationkey as cells from nation",
    "selected_entries": """select category, reason in ('category', 'title') as selected, reason, count(*) as n from (select p_type as category, case when regexp_matches(p_name, 'ring$') then 'excluded title'
        when p_type = 'ECONOMY' then 'category' when regexp_matches(p_name, '^small') then 'title' else 'no match' end as reason from part) group by 1, 2, 3""",
    "derived_urls": """with u as (select distinct regexp_replace(url, '^(https?://[^/]+)/(.+)$', '\\1/api/\\2') as d from pages where regexp_matches(url, '^(https?://[^/]+)/(.+)$')),
        k as (select regexp_replace(url, '^(https?://[^/]+)/(.+)$', '\\1/api/\\2') as d from pages where page_id % 2 = 0) select d as derived from u where d not in (from k)""",
    "manifest_upsert": """select regexp_extract(url, '^https?://([^/]+)', 1) as url, array_to_string(list_sort(list(distinct cast(page_id % 5 as varchar))), ',') as references from pages group by 1""",
    "snapshot_errors": """select directory, errors from (select case when k % 7 = 0 then '../' || k else 'repo-' || k end as directory, array_to_string(list_filter([
        case when k % 7 = 0 then 'directory' end, case when k % 5 = 0 then 'commit' end, case when k % 11 = 0 then 'url' end], lambda x: x is not null), ',') as errors
        from (select s_suppkey as k from supplier)) where errors <> ''""",
    "seeded_rows": "select n_nationkey, case when n_nationkey % 3 > 0 then n_name else lower(n_name) end as n_name from nation",
    "bounded_projection": """with o as (select o_orderkey, o_custkey, row_number() over (order by o_orderkey) as r, count(*) over () as n from orders where o_orderkey < 9)
        select 3::bigint as row_limit, o_orderkey, o_custkey, n > 3 as truncated from o where r <= 3 union all select 10000, o_orderkey, o_custkey, false from o""",
    "result_sample": "select c_custkey, true as truncated, true as noted from customer order by c_custkey limit 5",
    "running_budget": """select * from (select item_id, strlen(text) as bytes, cast(sum(strlen(text)) over (order by item_id) as bigint) as total from benchmark) where total <= 5000""",
    "enforcement": f"""select operation, confirmed, operation = 'read' or confirmed as runs from (values {', '.join(f"('{o}')" for o in gate.LABELS)}) as o(operation), (values (true), (false)) as c(confirmed)""",
    "immutable_ledger": "select * from (values ('update', true), ('delete', true), ('upsert', true), ('insert', false)) as t(operation, refused)",
    "catalog_snapshot": f"""select 'snapshot_' || table_name as table_name, 'view' as kind, ordinal_position - 1 as position, column_name,
        case when column_name in ('n_nationkey', 'r_regionkey') then 'PK' else '' end as key from information_schema.columns where table_name in {_SNAPSHOT}""",
    "canonical_urls": """select case when regexp_matches(url, '^https?://([^/?#]*[.])?example[.](org|net)(/|$)') then regexp_replace(regexp_replace(url, '#.*$', ''), '^http:', 'https:') else '' end as canonical,
        case when regexp_matches(url, '^https?://([^/?#]*[.])?example[.](org|net)(/|$)') then '' else 'another host' end as error, count(*) as n from pages group by 1, 2""",
}
