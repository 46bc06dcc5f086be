"""URL filters: longest-match rules, and link-graph propagation for the pages that no rule fits.

Hosts are the nodes and links between pages the edges. Trust starts at hosts with allowed pages and
follows links (personalised PageRank); distrust starts at hosts with blocked pages and follows them
backwards. A host whose distrust is the larger part is blocked. Every round is one equality join and
one aggregate over host edges, which are counted before anything else, so a host with a third of all
pages is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written

# Fixed values: (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
DAMPING = 0.85
#: Rounds of the query's SQL: propagation runs at least these, and on until it has settled.
ROUNDS = 12
#: Propagation has settled when a round changes trust and distrust of all hosts by no more than this part of their seeds.
TOLERANCE = 1e-9
#: 0.85 ** 1,000 is far below the tolerance: not settled by then is an error.
MOST_ROUNDS = 1_000
#: Part of trust and distrust together from which a host is blocked.
THRESHOLD = 0.5
#: Up to so many rules are looked up in a literal map; more are joined.
LITERAL_RULES = 2_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, A-Z lower-cased; '' without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; '' without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _suffixes(name: Column) -> Column:
    """A host and the domains above it."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _rule(h: Column, p: Column, rules) -> Column:
    """Struct (length, rule, verdict) of the longest of ``rules`` that fits, else null."""
    by_host: dict[str, list] = {}
    for rule_host, rule_path, verdict in rules:
        by_host.setdefault(rule_host, []).append((rule_path, verdict))
    if not by_host:
        return F.lit(None).cast("struct<length: int, rule: string, verdict: string>")
    entry = lambda x, y: F.struct(
        F.lit(len(x) + len(y[0])).alias("length"), F.lit(x + y[0]).alias("rule"), F.lit(y[0]).alias("path"), F.lit(y[1]).alias("verdict")
    )
    table = F.create_map(*[c for x, ys in by_host.items() for c in (F.lit(x), F.array(*[entry(x, y) for y in ys]))])
    # a host that is no key gives null, which takes no part in filter
    fitting = F.filter(
        F.flatten(F.filter(F.transform(_suffixes(h), lambda s: F.try_element_at(table, s)), lambda x: x.isNotNull())),
        lambda x: p.startswith(x["path"]),
    )
    best = F.array_max(F.transform(fitting, lambda x: F.struct(x["length"], x["rule"], x["verdict"])))
    return best


def matched(pages: DataFrame, rules) -> DataFrame:
    """``pages`` (page_id, url) with host, path and the struct ``best`` of the longest rule that fits."""
    rules = list(rules)
    rows = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    if len(rules) <= LITERAL_RULES:
        return rows.withColumn("best", _rule(F.col("host"), F.col("path"), rules))
    table = pages.sparkSession.createDataFrame(rules, "rule_host string, rule_path string, verdict string")
    urls = rows.select("host", "path").distinct()
    fits = (
        urls.withColumn("rule_host", F.explode(_suffixes(F.col("host"))))
        .join(table, "rule_host")
        .filter(F.col("path").startswith(F.col("rule_path")))
        .groupBy("host", "path")
        .agg(F.max(F.struct((F.length("rule_host") + F.length("rule_path")).alias("length"), F.concat("rule_host", "rule_path").alias("rule"), "verdict")).alias("best"))
    )
    return rows.join(fits, ["host", "path"], "left")


def links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): how many links go from host to host; relative links stay on their host."""
    hrefs = F.regexp_extract_all("html", F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""), 1)
    rows = pages.select(host(F.col("url")).alias("src"), F.explode(hrefs).alias("to")).filter("src <> ''")
    # //host/path keeps the page's scheme
    to = F.when(F.col("to").startswith("//"), F.concat(F.lit("x:"), "to")).when(F.col("to").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("to"))
    return rows.select("src", F.coalesce(F.nullif(host(to), F.lit("")), "src").alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) from seeds (host, good, bad) and edges (src, dst, n).

    A round gives each host (1 - damping) of its seed and ``damping`` of what its neighbours pass on, in
    proportion to links; trust follows links and distrust goes against them. Rounds go on, ``rounds`` at
    least, until the summed change of one is at most ``TOLERANCE`` of all seeds.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("of"))
    into = edges.groupBy("dst").agg(F.sum("n").alias("of"))
    ahead = edges.join(out, "src").select(F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("n") / F.col("of")).alias("t"), F.lit(0.0).alias("d"))
    back = edges.join(into, "dst").select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(0.0).alias("t"), (F.col("n") / F.col("of")).alias("d"))
    moves = written(ahead.union(back).groupBy("a", "b").agg(F.sum("t").alias("t"), F.sum("d").alias("d")), "url-moves")
    nodes = edges.select(F.col("src").alias("host")).union(edges.select("dst")).union(seeds.select("host")).distinct()
    base = written(nodes.join(seeds, "host", "left").select("host", F.coalesce("good", F.lit(0.0)).alias("good"), F.coalesce("bad", F.lit(0.0)).alias("bad")), "url-seeds")
    now, held = base.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust")), []
    total = base.agg(F.coalesce(F.sum(F.col("good") + F.col("bad")), F.lit(0.0))).first()[0]
    for k in range(MOST_ROUNDS):
        came = now.filter("trust > 0 or distrust > 0").join(moves, F.col("host") == F.col("a")).groupBy("b").agg(F.sum(F.col("trust") * F.col("t")).alias("t"), F.sum(F.col("distrust") * F.col("d")).alias("d"))
        after = base.join(came, F.col("host") == F.col("b"), "left").select(
            "host",
            (F.col("good") * (1 - damping) + damping * F.coalesce("t", F.lit(0.0))).alias("trust"),
            (F.col("bad") * (1 - damping) + damping * F.coalesce("d", F.lit(0.0))).alias("distrust"),
        )
        if k % 3 != 2 and k != rounds - 1:
            now = after
            continue
        after = written(after, "url-round")
        if k >= rounds - 1:
            was = now.select(F.col("host").alias("_host"), F.col("trust").alias("_trust"), F.col("distrust").alias("_distrust"))
            change = F.abs(F.col("trust") - F.col("_trust")) + F.abs(F.col("distrust") - F.col("_distrust"))
            moved = after.join(was, F.col("host") == F.col("_host")).agg(F.coalesce(F.sum(change), F.lit(0.0))).first()[0]
            if moved <= TOLERANCE * total:
                drop_written(edges.sparkSession, moves, base, *held)
                return after
        drop_written(edges.sparkSession, *held)
        now, held = after, [after]
    raise RuntimeError(f"trust and distrust did not settle in {MOST_ROUNDS} rounds")


def judge(pages: DataFrame, rules=RULES, damping: float = DAMPING, rounds: int = ROUNDS, threshold: float = THRESHOLD, normalised: bool = False) -> DataFrame:
    """One row for each row of ``pages`` (page_id, url, html): page_id, host, path, rule (the longest that
    fits, like ``net/``; null if none does) and verdict, the rule's or else that of the host's trust and
    distrust: block if more than ``threshold`` of both is distrust, allow otherwise.

    Rules are (host, path, verdict). A rule fits its host and all below it if the path starts with the
    rule's. A null url or one without :// has empty host and path, no rule, and is allowed. Null html
    has no links. Repeated rows are judged alike and count as often as they come.

    Seeds are numbers of pages. With ``normalised`` trust and distrust are each divided by their sums over all hosts, so
    that neither side weighs more for having more pages; what hosts without links lose then counts as given back to
    the seeds, as the two forms of PageRank differ by that factor.
    """
    rows = matched(pages, rules)
    seeds = (
        rows.filter("best is not null and host <> ''")
        .groupBy("host")
        .agg(F.count_if(F.col("best.verdict") == "allow").cast("double").alias("good"), F.count_if(F.col("best.verdict") == "block").cast("double").alias("bad"))
    )
    edges = written(links(pages), "url-links")
    seeds = written(seeds, "url-rules")
    scores = propagate(seeds, edges, damping, rounds)
    drop_written(pages.sparkSession, seeds, edges)
    trust, distrust = F.col("trust"), F.col("distrust")
    if normalised:
        sums = scores.agg(F.sum("trust"), F.sum("distrust")).first()
        trust, distrust = (c / F.lit(n or 1.0) for c, n in zip((trust, distrust), sums))
    blocked = scores.filter(distrust > threshold * (trust + distrust)).select(F.col("host").alias("_host"))
    return rows.join(blocked, F.col("host") == F.col("_host"), "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.when(F.col("_host").isNotNull(), "block").otherwise("allow")).alias("verdict"),
    )
