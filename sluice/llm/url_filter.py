"""URL filters: rules first, then link-graph propagation; DataFrame operations only.

Hosts are judged by two personalised PageRanks over host edges (a page's links, summed per pair of hosts): trust flows
from hosts that an allow rule fits along the links, distrust from hosts that a block rule fits against them (who links
to blocked hosts is not to be trusted). Hosts that are only linked to count like those that have pages. A host is
blocked if its distrust exceeds its trust and DISTRUST.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm import storage

#: (verdict, rule); the host is what stands before the first slash.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DAMPING = 0.85
#: Distrust, as a multiple of an even share of all hosts, from which a host without a rule is blocked.
DISTRUST = 0.1
#: Ranks are right to this share of the blocking limit; ROUNDS that don't get there are an error.
EXACT, ROUNDS = 0.01, 1000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host_: Column, path_: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. A list of rules is a parameter, not data."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host_ == name) | host_.endswith("." + name)) & path_.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float | None = None) -> DataFrame:
    """(host, rank) of a personalised PageRank: ``edges`` (src, dst, weight) are distinct, ``seeds`` (host, share) sum
    to 1. Hosts without rank are left out. Each round is written to the shared folder, and the one before deleted.

    What hosts without links would pass on goes back to the seeds. The ranks that this gives are, but for one factor, those
    without it, so rounds lose it and the end puts ranks to a sum of 1.

    Rounds end when no rank is further than ``tolerance`` from its limit, by default EXACT of the blocking limit: all
    movement to come is at most damping / (1 - damping) of the last round's. With a tolerance of 0, ``rounds`` are made.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("all"))
    flow = storage.persist(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("all")).alias("part")), "flow")
    seeds = storage.persist(seeds, "seeds")
    rank = seeds.select("host", F.col("share").alias("rank"))
    if flow.isEmpty() or seeds.isEmpty():
        return rank
    if tolerance is None:
        tolerance = EXACT * DISTRUST / count_hosts(edges)
    base = seeds.select("host", (F.col("share") * (1 - damping)).alias("rank"))
    for _ in range(rounds):
        passed = flow.join(rank, flow.src == rank.host).groupBy("dst").agg((F.sum(F.col("part") * F.col("rank")) * damping).alias("rank")).select(F.col("dst").alias("host"), "rank")
        new = storage.persist(base.unionByName(passed).groupBy("host").agg(F.sum("rank").alias("rank")), "rank")
        moved = new.join(rank.select("host", F.col("rank").alias("was")), "host", "full").agg(F.sum(F.abs(F.coalesce("rank", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))))).first()[0]
        if hasattr(rank, "_written"):
            storage.drop(rank)
        rank = new
        if moved is None or moved * damping / (1 - damping) <= tolerance * (1 - damping):
            break
    else:
        if tolerance > 0:
            raise RuntimeError(f"ranks still move by {moved} after {rounds} rounds")
    total = rank.agg(F.sum("rank")).first()[0]
    return rank.select("host", (F.col("rank") / total).alias("rank"))


def count_hosts(edges: DataFrame) -> int:
    return edges.select(F.explode(F.array("src", "dst")).alias("host")).distinct().count()


def filter_urls(pages: DataFrame, rules=RULES, distrust: float = DISTRUST) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every row of ``pages`` (page_id, url, html).

    The longest fitting rule decides. Elsewhere the host does: it is blocked if its distrust exceeds its trust and
    ``distrust`` even shares, else allowed; hosts without links, and pages without a host, have neither and are allowed.
    A null url, or one without ``://``, has an empty host and path. Null html has no links, long html is read whole. Repeated rows are judged
    alike; other columns are ignored; an empty table gives an empty result.
    """
    h, p = host(F.col("url")), path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), h.alias("host"), p.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    judged = storage.persist(rows.withColumn("rule", rule).withColumn("ruled", verdict), "judged")
    links = pages.select(h.alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1))).alias("to"))
    target = F.translate(F.regexp_extract("to", r"//([^/?#]*)", 1), _UPPER, _LOWER)
    # what is linked to need not have been crawled: rules are held against the links' targets too
    aimed = matching_rule(target, F.regexp_extract("to", r"//[^/?#]*([^?#]*)", 1), rules)[1]
    links = links.select("src", target.alias("dst"), aimed.alias("ruled")).where("src <> '' AND dst <> ''")
    links = storage.persist(links.groupBy("src", "dst", "ruled").agg(F.count("*").cast("double").alias("weight")), "targets")
    edges = storage.persist(links.where("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "links")
    ruled = judged.select("host", "ruled").unionByName(links.select(F.col("dst").alias("host"), "ruled"))
    seeds = storage.persist(ruled.where("ruled IS NOT NULL AND host <> ''").distinct(), "seeds")
    # a host that both kinds of rules fit trusts and distrusts in equal parts
    n = {r[0]: r[1] for r in seeds.groupBy("ruled").count().collect()}  # two rows
    if edges.isEmpty() or not n:
        ranked = None
    else:
        start = lambda kind: seeds.where(F.col("ruled") == kind).select("host", F.lit(1.0 / max(1, n.get(kind, 0))).alias("share"))
        hosts = max(1, count_hosts(edges))
        exact = EXACT * (distrust or DISTRUST) / hosts
        trust = propagate(edges, start("allow"), tolerance=exact).select("host", F.col("rank").alias("trust"))
        bad = propagate(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"), start("block"), tolerance=exact).select("host", F.col("rank").alias("distrust"))
        ranked = storage.persist(trust.join(bad, "host", "full").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"), F.lit(distrust / hosts).alias("limit")), "ranks")
    if ranked is None:
        out = judged.withColumns({"trust": F.lit(0.0), "distrust": F.lit(0.0), "limit": F.lit(0.0)})
    else:
        out = judged.join(storage.small(ranked), "host", "left").fillna(0.0, ["trust", "distrust", "limit"])
    by_graph = F.when((F.col("distrust") > F.col("trust")) & (F.col("distrust") >= F.col("limit")), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_graph).alias("verdict"), "trust", "distrust")
