"""Main text of web pages by differencing pages of near URLs.

A page becomes lines, one for each block of text. Pages are ordered by host and path, and
each is compared with the page before and the page after it on its host: lines on a
longest common subsequence of the two are shared, hence of the template, and are deleted.
A neighbour that shares nearly all of a page is a copy and says nothing about templates.

Every page is differenced, and an exact check on the markup follows. Lines in elements that
are declared to be something else (navigation, forms, adverts, comments and so on) go even
if no neighbour shares them; so do lines outside the article (an article or main element),
where a page declares one. As articles do quote each other, an article that differencing
leaves a line of gets its shared lines back; one that it leaves nothing of is repeated from
page to page (a teaser, a notice) and stays deleted, unless such are half of the articles'
characters or more, as the text itself is then a copy.

Only hashes of lines move in the search for neighbours, and only the texts that lose a line
meet the result. A host's pages are dealt out by range of path, so that a large host is
spread over many tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from math import isqrt

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.llm.url_trust import host_of, path_of
from marlstone.operators.skew import salted_join, total_of
from marlstone.plans.materialize import materialize

#: Share of a page's characters from which a neighbour that shares them is a copy.
COPY = 0.9
#: Rows of 64 bits in the table that tells which pages lose no line; it is sent to all tasks.
WORDS = 1 << 17

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.IGNORECASE)
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead "
    "title tr ul".split())
_RAW = frozenset("script style textarea title noscript template iframe svg math object canvas xmp noframes".split())
_OTHER = frozenset("nav footer aside form menu dialog select button".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_MARKS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header "
    "masthead menu modal nav navbar navigation newsletter notice popup promo related share sharing sidebar social sponsor sponsored "
    "subscribe toolbar widget".split())
#: Classes of an article element that is not the page's article.
_CARDS = frozenset("comment comments disqus promo related sponsored teaser".split())
_MARKS_INSIDE = _MARKS - {"header", "banner", "masthead", "notice"}
#: What a line is: inside a declared article, plain, or inside something else that is declared.
ARTICLE, PLAIN, DECLARED = 2, 1, 0


def _declared(name: str, attributes: str, inside: bool) -> bool:
    if name in _OTHER or (name == "header" and not inside):
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        if key in ("class", "id", "role"):
            marks = _MARKS_INSIDE if inside else _MARKS
            if not marks.isdisjoint(re.split(r"[\s_-]+", value)):
                return True
    return False


def _card(attributes: str) -> bool:
    return any(key.lower() == "class" and not _CARDS.isdisjoint(re.split(r"[\s_-]+", value.strip("\"'").lower()))
               for key, value in _ATTRIBUTE.findall(attributes))


def _closed(html: str, at: int, name: str, depth: int) -> bool:
    """Whether an element of that name, open `depth` times before `at`, is closed after it,
    in a page that closes as many as it opens."""
    tag = re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])", re.IGNORECASE)
    ends = [bool(m[1]) for m in tag.finditer(html)]
    if 2 * sum(ends) < len(ends):
        return False
    for m in tag.finditer(html, at):
        depth += -1 if m[1] else 1
        if depth == 0:
            return True
    return False


def page_lines(html: str) -> list[tuple[str, int]]:
    """(text, kind) of every block with text, in page order. White space within a block is
    one space; character references are decoded; script, style and the like are left out."""
    return [(text, kind) for text, kind, _ in page_articles(html)]


def page_articles(html: str) -> list[tuple[str, int, int]]:
    """The lines of a page with the number of the outermost article element that each is in,
    from 1; 0 outside of them, so also in a main element."""
    out: list[tuple[str, int, int]] = []
    pieces: list[str] = []
    kind = PLAIN
    inside = 0  # open article or main elements
    number, articles, article = 0, 0, 0  # articles so far, open ones, and the one that lines are in
    closing, depth = "", 0  # the declared element that is open, and how often its name nests
    within, holds = 0, None  # articles in the declared element, and whether it does hold them
    at, size = 0, len(html)

    def close() -> None:
        text = " ".join(unescape("".join(pieces)).split())
        if text:
            out.append((text, kind, article))
        pieces.clear()

    while at < size:
        found = _TOKEN.search(html, at)
        if found is None:
            pieces.append(html[at:])
            break
        pieces.append(html[at:found.start()])
        at = found.end()
        name = found[2]
        if name is None:
            continue
        name, end = name.lower(), bool(found[1])
        if name in _RAW:
            if not end and not found[3].endswith("/"):
                stop = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.IGNORECASE).search(html, at)
                at = stop.end() if stop else size
            continue
        if name == "br":
            pieces.append(" ")
        if name in _BLOCKS:
            close()
        if name in ("article", "main"):
            if closing and not end and holds is None:
                holds = _closed(html, at, closing, depth + (closing == name))
            if end and closing == name:
                depth -= 1
                if depth == 0:
                    closing = ""
            elif end and closing and within:
                within -= 1
            elif end:
                inside = max(0, inside - 1)
                articles = min(inside, max(0, articles - (name == "article")))
            elif closing == name and holds:
                depth += 1
            elif closing and holds:
                within += 1
            elif name == "article" and _card(found[3]):
                closing, depth, within, holds = name, 1, 0, None
            else:
                inside += 1
                number += name == "article" and not articles
                articles += name == "article"
                closing = ""  # an article ends whatever was left open before it
        elif closing:
            if name == closing:
                depth += -1 if end else 1
                if depth == 0:
                    close()
                    closing = ""
        elif not end and name not in _VOID and not found[3].endswith("/") and _declared(name, found[3], inside > 0):
            close()
            closing, depth, within, holds = name, 1, 0, None
        now = DECLARED if closing else ARTICLE if inside else PLAIN
        if now != kind:
            close()
            kind = now
        article = number if articles else 0
    close()
    return out


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in `a` on a longest common subsequence of `a` and `b` (bit-parallel rows,
    equal ends set aside first)."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    mid_a, mid_b = a[head:len(a) - tail], b[head:len(b) - tail]
    both = set(mid_a) & set(mid_b)
    places = [i for i, x in enumerate(mid_a) if x in both]
    x, y = [mid_a[i] for i in places], [v for v in mid_b if v in both]
    masks: dict[int, int] = {}
    for i, v in enumerate(x):
        masks[v] = masks.get(v, 0) | 1 << i
    full = (1 << len(x)) - 1

    def rows_from(row: int, values: list[int]) -> Iterator[int]:
        yield row
        for v in values:
            hit = row & masks[v]
            row = ((row + hit) | (row - hit)) & full
            yield row

    # one row of each `step` is kept, and those between are made again on the way back
    step = isqrt(len(y)) + 1
    kept = [row for j, row in enumerate(rows_from(full, y)) if j % step == 0]
    picked = []
    i, j = len(x), len(y)
    base, rows = len(y) + 1, []
    while i and j:
        if j - 1 < base:
            base = (j - 1) // step * step
            rows = list(rows_from(kept[base // step], y[base:base + step]))
        if x[i - 1] == y[j - 1]:
            picked.append(head + places[i - 1])
            i, j = i - 1, j - 1
        else:  # zeros among the lowest bits of a row count the length so far
            up = i - (rows[j - 1 - base] & ((1 << i) - 1)).bit_count()
            left = i - 1 - (rows[j - base] & ((1 << (i - 1)) - 1)).bit_count()
            i, j = (i, j - 1) if up >= left else (i - 1, j)
    return [*range(head), *reversed(picked), *range(len(a) - tail, len(a))]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of each page: hash and size of all, and the texts and positions of those that
    the check on the markup lets through: those of its articles with the articles' numbers, if
    it declares any, else the plain ones."""
    for batch in batches:
        hashes, sizes, bodies, places, articles = [], [], [], [], []
        for html in batch.column("html").to_pylist():
            found = page_articles(html or "")
            wanted = ARTICLE if any(kind == ARTICLE for _, kind, _ in found) else PLAIN
            hashes.append([xxhash.xxh3_64_intdigest(t) - (1 << 63) for t, _, _ in found])
            sizes.append([len(t) for t, _, _ in found])
            bodies.append("\n".join(t for t, kind, _ in found if kind == wanted))
            places.append([k for k, (_, kind, _) in enumerate(found) if kind == wanted])
            articles.append([article for _, kind, article in found if kind == wanted] if wanted == ARTICLE else None)
        yield pa.RecordBatch.from_arrays([
            *[batch.column(c) for c in ("page_id", "url", "key", "host", "path")], pa.array(hashes, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32())),
            pa.array(bodies, pa.string()), pa.array(places, pa.list_(pa.int32())), pa.array(articles, pa.list_(pa.int32()))],
            names=["page_id", "url", "key", "host", "path", "lines", "sizes", "body", "places", "articles"])


def _shared(copy: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = [], []
            columns = [batch.column(c).to_pylist() for c in ("key", "lines", "sizes", "other")]
            for key, own, sizes, other in zip(*columns, strict=True):
                found = common_lines(own, other)
                if found and sum(sizes[i] for i in found) < copy * sum(sizes):
                    keys.append(key)
                    out.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.list_(pa.int32()))], names=["key", "at"])

    return run


def lines_lost(places: list[int], articles: list[int] | None, sizes: list[int], shared: set[int]) -> list[int]:
    """Which of a text's lines, at `places` of the page, stay deleted if differencing deletes
    those at `shared`. Articles that it leaves a line of are restored, and all lines if the
    other articles hold as many characters: then a neighbour repeats the page's text itself."""
    if articles is None:
        return [k for k, place in enumerate(places) if place in shared]
    own = {article for place, article in zip(places, articles, strict=True) if article and place not in shared}
    kept = repeated = 0
    for place, article in zip(places, articles, strict=True):
        if article in own:
            kept += sizes[place]
        elif article:
            repeated += sizes[place]
    return [k for k, place in enumerate(places) if place in shared and articles[k] not in own] if kept > repeated else []


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pages that differencing deletes lines of, by the check on their markup."""
    for batch in batches:
        keys, gone, counts = [], [], []
        columns = [batch.column(c).to_pylist() for c in ("key", "places", "articles", "sizes", "at")]
        for key, places, articles, sizes, at in zip(*columns, strict=True):
            lost = lines_lost(places, articles, sizes, set(at))
            if lost or articles is None:
                keys.append(key)
                gone.append(lost)
                counts.append(len(at) if articles is None else len(lost))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(gone, pa.list_(pa.int32())), pa.array(counts, pa.int32())], names=["key", "gone", "n_shared"])


def neighbours(keys: DataFrame) -> DataFrame:
    """(key, near): the keys of the rows before and after each in the order of (host, path,
    key), of the same host. Rows are sorted in ranges; the ends of the ranges are joined
    through a table with one row a range."""
    ranged = keys.select("key", "host", "path").repartitionByRange("host", "path", "key").withColumn("part", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")
    place = F.struct("host", "path", "key")
    ends = ranged.groupBy("part").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    by_part = Window.orderBy("part")
    ends = ends.select("part", F.lag("last").over(by_part).alias("before"), F.lead("first").over(by_part).alias("after"))
    order = Window.partitionBy("part").orderBy("host", "path", "key")
    row = F.struct("host", "path", "key")
    sided = (ranged.withColumn("b", F.lag(row).over(order)).withColumn("a", F.lead(row).over(order)).join(ends, "part")
             .select("key", "host", F.explode(F.array(F.coalesce("b", "before"), F.coalesce("a", "after"))).alias("n")))
    return sided.filter("n is not null and n.host = host and n.key <> key").select("key", F.col("n.key").alias("near")).distinct()


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", copy: float = COPY) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars, n_shared (lines that differencing
    deletes because a neighbour shares them; where an article is declared, those of its
    articles that the check does not give back).

    Null html gives an empty text. A null url has an empty host; such pages are compared
    with each other. Repeated rows get equal results. Of neighbours with equal paths the
    order is that of their hashes. A page without neighbours loses no line to differencing.
    Empty input gives an empty result. Other columns are not used.
    """
    named = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    named = named.withColumns({"key": F.xxhash64("page_id", "url", "html"), "host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    id_type = named.schema["page_id"].dataType.simpleString()
    schema = (f"page_id {id_type}, url string, key long, host string, path string, lines array<long>, sizes array<int>, "
              "body string, places array<int>, articles array<int>")
    # every page is parsed once; its markup is not read or moved again
    parsed = materialize(named.mapInArrow(_parsed, schema), "pages")
    # pages with equal lines are one page here, so that each meets the nearest different ones
    lines = parsed.withColumn("same", F.xxhash64("lines"))
    heads = lines.groupBy("host", "same").agg(F.min(F.struct("path", "key")).alias("head"), F.count("*").alias("n"))
    heads = materialize(heads.select("host", "same", "n", "head.path", "head.key"), "heads")
    own = lines.dropDuplicates(["key"]).select("key", "lines", "sizes")
    other = own.select(F.col("key").alias("near"), F.col("lines").alias("other"))
    pairs = neighbours(heads).join(other, "near").join(own, "key").select("key", "lines", "sizes", "other")
    shared = pairs.mapInArrow(_shared(copy), "key long, at array<int>").groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"))
    found = materialize(heads.join(shared, "key").select("host", "same", "n", "at"), "shared")
    met = salted_join(lines.select("key", "host", "same", "places", "articles", "sizes"), found, ["host", "same"], "n", total_of(found, "n"), ["key"])
    lost = met.select("key", "places", "articles", "sizes", "at").mapInArrow(_checked, "key long, gone array<int>, n_shared int")
    lost = materialize(lost.dropDuplicates(["key"]), "lost")
    # texts whose bit is not set lose nothing and stay where they are
    word, bit = F.expr(f"pmod(key, {WORDS})"), F.expr(f"shiftleft(1L, cast(pmod(key div {WORDS}, 64) as int))")
    bits = lost.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    texts = parsed.select("page_id", "url", "key", "body", word.alias("word")).join(F.broadcast(bits), "word", "left")
    may = F.coalesce(F.col("bits").bitwiseAND(bit) != 0, F.lit(False))
    whole = texts.filter(~may).select("page_id", "url", F.col("body").alias("text"), F.lit(0).alias("n_shared"))
    joined = texts.filter(may).select("page_id", "url", "key", "body").join(lost, "key", "left")
    body = F.split("body", "\n")
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(body) - 1), "gone"), lambda k: F.get(body, k))
    text = F.when(F.size("gone") > 0, F.array_join(left, "\n")).otherwise(F.col("body"))
    every = whole.unionByName(joined.select("page_id", "url", text.alias("text"), F.coalesce("n_shared", F.lit(0)).alias("n_shared")))
    return every.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_shared")


def oracle_sql() -> str:
    """page_id, url, text, n_chars over the view `pages`, for DuckDB, where every page
    declares its article and has no character references but the five that escape text, as
    in the given tables: for such pages the text is that of the article's blocks."""
    block = r"</?(?:p|h[1-6]|div|ul|ol|li|table|tr|td|blockquote|section|pre)\b[^>]*>"
    space = "[ \\t\\n\\r\\f\\v]+"
    line = "regexp_replace(regexp_replace(b, '<br[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g')"
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#x27", "''"), ("amp", "&")):
        line = f"regexp_replace({line}, '&{name};?', '{char}', 'g')"
    line = f"trim(regexp_replace({line}, '{space}', ' ', 'g'))"
    return f"""
    with cut as (select page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)(?:</article>|$)', 1), '{block}') as blocks from pages),
      joined as (select page_id, url, array_to_string(list_filter(list_transform(blocks, lambda b: {line}), lambda l: l <> ''), chr(10)) as text from cut)
    select page_id, url, text, length(text) as n_chars from joined"""
