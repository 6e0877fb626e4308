"""URL filter: fixed rules first, else trust and distrust spread over the graph of hosts. DataFrame functions only.

Hosts are linked by the links of their pages and, more weakly, with their parent domain. Trust starts at hosts
with pages that a rule allows and follows links; distrust starts at hosts with pages that a rule blocks and follows
links backwards (who links to blocked hosts is suspect). Both are personalised PageRank series, continued until the terms
left cannot change a verdict, however far a host is from the seeds. A host is blocked if its distrust exceeds its trust by
a share ``margin`` of both (rounding alone decides nothing, and neither does the size of the table: any distrust blocks a
host that no trust reaches).

Cases: a url that is null or has no ``://`` has empty host and path, meets no rule and is judged like the empty host
(allowed: it has no links); hosts without any score are allowed; repeated rows are judged one by one; without pages
there are no rows; null html has no links; html of any length is searched whole; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.common import few, materialise, query, table

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DAMPING = 0.85
#: Terms before the first look at what the series still lacks, and terms between two written tables.
TERMS = 12
ROUND = 4
#: Edges to a partition of a term.
PART_EDGES = 500_000
PARENT_WEIGHT = 0.25
MARGIN = 1e-9
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Targets of absolute links in href and src attributes, up to the end of the host.
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """(verdict, rule) of the longest rule that fits, else null."""
    found = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        domain, slash, rest = rule.partition("/")
        fits = (host == domain) | host.endswith("." + domain)
        found.append(F.when(fits & path.startswith(slash + rest), F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))))
    return F.coalesce(*found)


def ruled_pages(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path and what the rules say (null: nothing)."""
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return split.withColumn("said", rule_of(F.col("host"), F.col("path"), rules)).select(
        "page_id", "host", "path", F.col("said.rule").alias("rule"), F.col("said.verdict").alias("ruled"))


def host_edges(pages: DataFrame, parent_weight: float = PARENT_WEIGHT) -> DataFrame:
    """(src, dst, weight): links between different hosts, counted before the shuffle, and parent domains."""
    links = materialise(pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("dst")).select(
        "src", F.translate("dst", _UPPER, _LOWER).alias("dst")).filter("src <> dst AND src <> ''").groupBy("src", "dst").agg(
        F.count(F.lit(1)).cast("double").alias("weight")), "url-links")
    hosts = pages.select(host_of(F.col("url")).alias("host")).distinct().unionByName(links.select(F.col("dst").alias("host")).distinct()).distinct()
    parent = F.regexp_extract("host", r"^[^.]+\.([^.]+\..+)$", 1)
    up = hosts.select(F.col("host").alias("src"), parent.alias("dst"), F.lit(parent_weight).alias("weight")).filter("dst <> ''")
    return links.unionByName(up).unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy(
        "src", "dst").agg(F.sum("weight").alias("weight"))


def _blocked(trust: Column, distrust: Column, margin: float) -> Column:
    return distrust - trust > margin * (distrust + trust)


def _per_host(scores: DataFrame) -> DataFrame:
    def of(kind: str) -> Column:
        return F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0.0))

    return scores.groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust"))


def _settled(ranks: DataFrame, terms: int, damping: float, margin: float) -> bool:
    """Whether the terms left out can change no verdict.

    Two bounds hold for what a host still gets. If the last of n + 1 terms is at most a share e of the sum at every host, all
    later terms together are at most (n + 1) * e of the whole series at every host, as each comes from earlier ones by the same
    nonnegative step; a host that the last term has reached for the first time has e = 1. And no host gets more than all
    the mass still under way, as a step keeps at most the damping of it.
    """
    last = {r["kind"]: r for r in ranks.groupBy("kind").agg(F.max(F.col("term") / F.col("score")).alias("share"), F.sum("term").alias("mass")).collect()}
    share = max([0.0, *(r["share"] or 0.0 for r in last.values())])
    left = (terms + 1) * share
    if left <= margin or share > 1 - 1e-9:  # at a share of 1 some host has just been reached, others may follow
        return left <= margin

    def most(kind: str) -> Column:
        by_mass = F.col(kind) + (last[kind]["mass"] if kind in last else 0.0) * damping / (1 - damping)
        return F.least(F.col(kind) / (1 - left), by_mass) if left < 1 else by_mass

    surely = _blocked(most("trust"), F.col("distrust"), margin)
    maybe = _blocked(F.col("trust"), most("distrust"), margin)
    return _per_host(ranks).filter(maybe & ~surely).isEmpty()


def step(ranks: DataFrame, moves: DataFrame, damping: float) -> DataFrame:
    """The next term. ``moves`` hold a row of each (kind, host) to itself, which keeps its score, so ranks are read once."""
    sent = F.col("term") * F.col("part") * damping
    return ranks.join(moves, ["kind", "host"]).filter(F.col("stays") | (sent > 0)).select(
        "kind", F.col("dst").alias("host"), (F.when(F.col("stays"), F.col("score")).otherwise(0.0) + sent).alias("score"), sent.alias("term")).groupBy(
        "kind", "host").agg(F.sum("score").alias("score"), F.sum("term").alias("term"))


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, terms: int = TERMS, margin: float = MARGIN) -> DataFrame:
    """(kind, host, score): personalised PageRank of both kinds, from ``seeds(kind, host, mass)``.

    Kind ``trust`` follows the edges, kind ``distrust`` their reverse. Mass that reaches a host without edges
    ends there. Each term is one join with the edges and one sum, in as many partitions as the counted edges need; every
    few terms are written. After ``terms`` terms the series goes on until no verdict at ``margin`` is open, or all scores are
    within ``margin`` of their limit.
    """
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    total = both.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    parts = both.join(total, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("weight") / F.col("total")).alias("part"), F.lit(False).alias("stays"))
    hosts = both.select("kind", F.explode(F.array("src", "dst")).alias("host")).unionByName(seeds.select("kind", "host")).distinct()
    moves = parts.unionByName(hosts.select("kind", "host", F.col("host").alias("dst"), F.lit(0.0).alias("part"), F.lit(True).alias("stays")))
    moves = materialise(moves, "url-moves")
    ranks = seeds.select("kind", "host", (F.col("mass") * (1 - damping)).alias("score")).withColumn("term", F.col("score"))
    conf = edges.sparkSession.conf
    before = conf.get("spark.sql.shuffle.partitions")
    conf.set("spark.sql.shuffle.partitions", str(1 + moves.count() // PART_EDGES))
    try:
        done = 0
        while True:
            for _ in range(ROUND):
                ranks, done = step(ranks, moves, damping), done + 1
            ranks = materialise(ranks, "url-ranks")
            if done >= terms and _settled(ranks, done, damping, margin):
                return ranks.drop("term")
    finally:
        conf.set("spark.sql.shuffle.partitions", before)


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, margin: float = MARGIN) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    ruled = materialise(ruled_pages(pages, rules), "url-ruled")
    per_host = ruled.filter("ruled IS NOT NULL").groupBy(
        F.when(F.col("ruled") == "allow", "trust").otherwise("distrust").alias("kind"), "host").agg(F.count(F.lit(1)).alias("n"))
    sums = per_host.groupBy("kind").agg(F.sum("n").alias("all"))
    seeds = materialise(per_host.join(sums, "kind").select("kind", "host", (F.col("n") / F.col("all")).alias("mass")), "url-seeds")
    scores = spread(host_edges(pages), seeds, margin=margin)
    blocked = few(materialise(_per_host(scores).filter(_blocked(F.col("trust"), F.col("distrust"), margin)).select(
        "host", F.lit(True).alias("bad")), "url-blocked"))
    return ruled.join(blocked, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))


@query("op8_url_filters")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, then link-graph verdicts, for all pages."""
    return judge(table(spark, sf_dir, "pages"))
