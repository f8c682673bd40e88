"""URL filters: rules first, then trust and distrust spread over links between hosts.

Each page's host and path are judged by the rules; the longest rule that fits decides. Pages without a rule get their
host's verdict: a host's seeds are the shares of its pages that rules allow and block. Trust spreads along links from a
host to those that it links to, distrust against them, from a host to those that link to it (personalised PageRank,
teleporting to the seeds). A host is blocked where distrust reaches LEAST and exceeds RATIO times its trust; any other
is allowed. Shares and out-weights are per host, so the thresholds mean the same at any size.

Links are absolute or scheme-relative `href`s of the pages' anchors to other hosts, summed per pair of hosts before any
join; scores live in a table of hosts, written to the shared folder after every STEPS rounds. Rounds end when no score
moves by more than TOLERANCE. All that a round moves is at most FOLLOW times what the one before moved, so the number
of rounds that is always enough is known; should it not be, an error is raised.

Defined results: null url, or one without `://`: host and path empty, no rule, and the verdict of no host (allow). Null
html: no links. Repeated rows: one result row each, and they weigh in the shares. Empty table: no rows. Further columns
are ignored.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.llm.common import MAX_BROADCAST, discard, publish, short

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
HREF = r"""(?i)<a\s(?:"[^"]*+"|'[^']*+'|[^<>"'h]++|(?<=[\w-])h|h(?!ref\s*+=))*+href\s*+=\s*+["']?+((?:https?:)?//[^"'\s>]++)"""
FOLLOW = 0.85
STEPS = 5
TOLERANCE = 1e-7
LEAST = 0.05
RATIO = 2.0
MAX_RULES = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def best_rule(rules: list[Rule], host: Column, path: Column) -> Column:
    """struct(rule, verdict) of the longest rule (verdict, host, path) that fits, or null.

    Rules are settings, at most MAX_RULES of them; of equally long ones the longer host wins, then block.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[0] == "block")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def links(pages: DataFrame) -> DataFrame:
    """(src, dst, w): links between different hosts."""
    to = F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1)))
    out = pages.where(F.col("html").rlike(HREF)).select(host_of(F.col("url")).alias("src"), to.alias("href"))
    out = out.select("src", host_of(F.concat(F.lit("x:"), F.regexp_replace("href", "(?i)^https?:", ""))).alias("dst"))
    return out.where("src <> dst AND src <> '' AND dst <> ''").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))


def spread(edges: DataFrame, seeds: DataFrame, follow: float = FOLLOW, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) from seeds (host, trust0, distrust0) over edges (src, dst, w)."""
    total = lambda c, name: edges.groupBy(c).agg(F.sum("w").alias(name))
    shares = edges.join(total("src", "out_w"), "src").join(total("dst", "in_w"), "dst")
    shares = publish(shares.select("src", "dst", (F.col("w") / F.col("out_w")).alias("down"), (F.col("w") / F.col("in_w")).alias("up")), "shares")
    nodes = seeds.select("host").union(shares.select("src")).union(shares.select("dst")).distinct()
    base = nodes.join(seeds, "host", "left").select("host", *((1 - follow) * F.coalesce(c, F.lit(0.0)).alias(c) for c in ("trust0", "distrust0")))
    base = publish(base.toDF("host", "trust0", "distrust0"), "hosts")
    now = base.select("host", F.col("trust0").alias("trust"), F.col("distrust0").alias("distrust"))
    if shares.isEmpty():
        return now

    def step(now: DataFrame) -> DataFrame:
        trust = shares.join(now, shares["src"] == now["host"]).select(F.col("dst").alias("host"), (follow * F.col("down") * F.col("trust")).alias("t"), F.lit(0.0).alias("d"))
        distrust = shares.join(now, shares["dst"] == now["host"]).select(F.col("src").alias("host"), F.lit(0.0).alias("t"), (follow * F.col("up") * F.col("distrust")).alias("d"))
        own = base.select("host", F.col("trust0").alias("t"), F.col("distrust0").alias("d"))
        return trust.union(distrust).union(own).groupBy("host").agg(F.sum("t").alias("trust"), F.sum("d").alias("distrust"))

    last, moved = None, 0.0
    whole = base.agg(F.sum(F.col("trust0") + F.col("distrust0")).alias("n")).first()["n"]
    most = 2 * STEPS + ceil(log(tolerance / (1 + whole)) / log(follow))
    for _ in range(0, most, STEPS):
        for _ in range(STEPS - 1):
            now = step(now)
        was = now.select("host", F.col("trust").alias("t1"), F.col("distrust").alias("d1"))
        new = publish(step(now).join(was, "host"), "spread")
        discard(last)
        moved = new.agg(F.max(F.greatest(F.abs(F.col("trust") - F.col("t1")), F.abs(F.col("distrust") - F.col("d1")))).alias("m")).first()["m"]
        last, now = new, new.select("host", "trust", "distrust")
        if moved is None or moved <= tolerance:
            return now
    raise RuntimeError(f"scores still moved by {moved}")


def judged(pages: DataFrame, rules: list[Rule], least: float = LEAST, ratio: float = RATIO, **kw) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust): one row per page."""
    url = F.col("url")
    own = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    own = own.withColumn("_r", best_rule(rules, F.col("host"), F.col("path")))
    own = publish(own.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.col("_r.verdict").alias("ruled")), "urls")
    share = lambda v: F.count_if(F.col("ruled").eqNullSafe(v)) / F.count("*")
    seeds = own.where("host <> ''").groupBy("host").agg(share("allow").alias("trust0"), share("block").alias("distrust0"))
    scores = spread(publish(links(pages), "host-links"), publish(seeds, "seeds"), **kw)
    blocked = (F.col("distrust") >= least) & (F.col("distrust") > ratio * F.col("trust"))
    scores = short(publish(scores.withColumn("by_host", F.when(blocked, "block").otherwise("allow")), "verdicts"), MAX_BROADCAST // 4)
    out = own.join(scores, "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", "by_host", F.lit("allow")).alias("verdict"), "trust", "distrust")
