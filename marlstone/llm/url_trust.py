"""URL filter: rules first, then trust and distrust spread over the graph of hosts.

Hosts whose pages the rules allow are trusted seeds, hosts whose pages they block are
distrusted seeds, each with as many units as it has such pages. Trust follows links
(personalised PageRank from the trusted seeds); distrust runs against them, from a
blocked host to the hosts that link to it. A host is blocked where distrust makes up
more than a threshold of its trust and distrust together. Only DataFrame functions are
used; link counts are added up per pair of hosts before anything is joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.skew import LEAST_ROWS, MOST_HOT, salted_join
from marlstone.plans.materialize import materialize

#: (verdict, rule): a rule is a host and a path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DAMPING, ROUNDS, THRESHOLD = 0.85, 8, 0.5
#: Share of a host's mass by which a round may still change it when the rounds end.
TOLERANCE = 1e-6
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_HREF = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, ASCII lower-cased; else ''."""
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; '' if there is no ://."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _fits(rule: str, host: Column, path: Column) -> Column:
    own, slash, rest = rule.partition("/")
    return ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(the longest rule that fits, its verdict), null where none fits; of equally long
    rules the first in the list wins. `rules` is configuration, compiled into the plan."""
    found = verdict = F.lit(None).cast("string")
    for kind, rule in sorted(reversed(rules), key=lambda r: len(r[1])):  # the last that fits stays
        fits = _fits(rule, host, path)
        found, verdict = F.when(fits, F.lit(rule)).otherwise(found), F.when(fits, F.lit(kind)).otherwise(verdict)
    return found, verdict


def host_edges(pages: DataFrame, host: Column, html_col: str = "html") -> DataFrame:
    """(src, dst, links) between different hosts, from the absolute links of the pages."""
    links = F.explode(F.regexp_extract_all(F.col(html_col), F.lit(_HREF), F.lit(1)))
    return (pages.select(host.alias("src"), links.alias("dst")).withColumn("dst", F.translate("dst", _UPPER, _LOWER))
            .filter("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("links")))


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) from edges (src, dst, links) and seeds (host, good, bad).

    Mass at hosts without links to follow is not handed on. A host that no mass reaches
    has no row. After `rounds` rounds at least, they end once a round reaches no new host
    and changes no host's mass by more than `TOLERANCE` of it. Ranks are written out every
    fourth round to keep plans short.
    """
    edges = materialize(edges, "edges")
    count = edges.count()
    degree = lambda side: materialize(edges.groupBy(side).agg(F.sum("links").alias("all"), F.count("*").alias("n")), "degrees")
    part = (F.col("links") / F.col("all"))
    ahead = salted_join(edges, degree("src"), ["src"], "n", count, ["dst"]).select(
        F.col("src").alias("host"), F.col("dst").alias("to"), part.alias("t"), F.lit(0.0).alias("d"))
    behind = salted_join(edges, degree("dst"), ["dst"], "n", count, ["src"]).select(
        F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(0.0).alias("t"), part.alias("d"))
    steps = ahead.unionByName(behind)
    # a hub's steps are dealt to several parts once; each round copies its one rank to them
    per = max(LEAST_ROWS, -(-2 * count // MOST_HOT))
    hubs = steps.groupBy("host").agg(F.count("*").alias("n")).filter(F.col("n") > per).select("host", F.ceil(F.col("n") / per).cast("int").alias("parts"))
    hubs = materialize(hubs, "hubs")  # at most MOST_HOT rows, as each has more than a MOST_HOT-th of all steps
    steps = materialize(steps.join(F.broadcast(hubs), "host", "left").withColumn(
        "part", F.pmod(F.xxhash64("to"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts"), "steps")
    start = materialize(seeds.select("host", (F.col("good") * (1 - damping)).alias("trust"), (F.col("bad") * (1 - damping)).alias("distrust")), "seeds")
    if steps.isEmpty():
        return start
    rank, before, k = start, None, 0
    while True:
        if k >= rounds and k % 4 == 3:
            rank = before = materialize(rank, "ranks")
        copied = rank.join(F.broadcast(hubs), "host", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        moved = steps.join(copied, ["host", "part"]).groupBy(F.col("to").alias("host")).agg(
            (F.sum(F.col("t") * F.col("trust")) * damping).alias("trust"), (F.sum(F.col("d") * F.col("distrust")) * damping).alias("distrust"))
        rank = moved.unionByName(start).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        k += 1
        if k % 4 == 0:
            rank = materialize(rank, "ranks")
            if before is not None:
                old = before.select("host", (F.col("trust") + F.col("distrust")).alias("old"))
                mass = F.col("trust") + F.col("distrust")
                if rank.join(old, "host", "left").filter(mass - F.coalesce("old", F.lit(0.0)) > TOLERANCE * mass).isEmpty():
                    return rank


def url_verdicts(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 damping: float = DAMPING, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict ('allow' or 'block').

    Without a fitting rule the host's verdict holds; a host without trust and distrust is
    allowed. A null url, or one without ://, has an empty host and path and is allowed.
    Null html has no links. Repeated rows count each time. Other columns are not used.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    named = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = named.withColumn("rule", rule).withColumn("by_rule", verdict)
    count = lambda kind: F.sum(F.when(F.col("by_rule") == kind, 1.0).otherwise(0.0))
    seeds = judged.groupBy("host").agg(count("allow").alias("good"), count("block").alias("bad")).filter("good > 0 or bad > 0")
    ranks = spread(host_edges(pages, host, html_col), seeds, damping, rounds)
    blocked = ranks.filter(F.col("distrust") > threshold * (F.col("trust") + F.col("distrust"))).select("host", F.lit("block").alias("by_host"))
    return judged.join(blocked, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", "by_host", F.lit("allow")).alias("verdict"))


def oracle_sql(rules=RULES, damping: float = DAMPING, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> str:
    """The same over the view `pages`, for DuckDB."""
    fit = lambda r: f"((host = '{r.split('/')[0]}' or ends_with(host, '.{r.split('/')[0]}')) and starts_with(path, '/{r.partition('/')[2]}'))"
    longest = sorted(rules, key=lambda r: -len(r[1]))
    case = lambda i: "case " + " ".join(f"when {fit(r[1])} then '{r[i]}'" for r in longest) + " end"
    url, href = _URL.replace("'", "''"), _HREF.replace("'", "''")
    walk = reduce(lambda sql, k: sql + f""",
      r{k + 1} as (select host, sum(trust) as trust, sum(distrust) as distrust from (
        select "to" as host, sum(t * trust) * {damping} as trust, sum(d * distrust) * {damping} as distrust
        from steps join r{k} using (host) group by 1 union all select * from r0) group by 1)""", range(rounds), "")
    return f"""
    with named as (select page_id, html,
        translate(coalesce(regexp_extract(url, '{url}', 1), ''), '{_UPPER}', '{_LOWER}') as host,
        coalesce(regexp_extract(url, '{url}', 2), '') as path from pages),
      judged as (select *, {case(1)} as rule, {case(0)} as by_rule from named),
      raw as (select host as src, translate(unnest(regexp_extract_all(html, '{href}', 1)), '{_UPPER}', '{_LOWER}') as dst from judged),
      edges as (select src, dst, count(*)::double as links from raw where src <> '' and src <> dst group by 1, 2),
      steps as (select src as host, dst as "to", links / sum(links) over (partition by src) as t, 0.0::double as d from edges
        union all select dst, src, 0.0, links / sum(links) over (partition by dst) from edges),
      r0 as (select * from (select host, count(*) filter (where by_rule = 'allow') * (1 - {damping})::double as trust,
        count(*) filter (where by_rule = 'block') * (1 - {damping})::double as distrust from judged group by 1)
        where trust > 0 or distrust > 0){walk}
    select page_id, judged.host, path, rule, coalesce(by_rule, case when distrust > {threshold} * (trust + distrust) then 'block' end, 'allow') as verdict
    from judged left join r{rounds} on judged.host = r{rounds}.host"""
