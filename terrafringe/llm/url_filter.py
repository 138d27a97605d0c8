"""URL verdicts by rules, and by trust and distrust spread over links between hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafringe.llm.common import cut

#: (verdict, host, path): a rule fits its host and all subdomains where the url's path starts with the rule's.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url; both empty for null and where `://` is missing."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substr(url, F.instr(url, "://") + 3, F.length(url)), "#", 1)).otherwise(F.lit(""))
    rest = F.coalesce(F.substring_index(rest, "?", 1), F.lit(""))
    host = F.substring_index(rest, "/", 1)
    return F.translate(host, _CAPITALS, _CAPITALS.lower()), F.substr(rest, F.length(host) + 1, F.length(rest) + 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null where none fits. Of equally long ones the first by text wins."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    text = verdict = F.lit(None).cast("string")
    for kind, h, p in reversed(ordered):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def host_links(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts in the pages' html, counted, also those without a protocol (`//host/`); `pages` has a column host."""
    found = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(r"""(?i)\bhref\s*=\s*["']?\s*((?:https?:)?//[^\s"'<>]*)"""), F.lit(1))
    links = pages.select(F.col("host").alias("src"), F.explode(found).alias("to"))
    whole = F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to")).otherwise(F.col("to"))
    return links.select("src", host_and_path(whole)[0].alias("dst")).filter("src != dst and src != '' and dst != ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(hosts: DataFrame, links: DataFrame, damping: float = 0.85, rounds: int = 300, settled: float = 1e-6) -> DataFrame:
    """(host, trust, distrust) by personalised PageRank from the seeds in `hosts` (host, good, bad).

    Trust follows the links, shared among a host's links by their counts;
    distrust goes against them, shared among the links that point to a host.
    Seeds are shares of a host's pages, so scores lie between 0 and 1 and don't
    shrink with the number of hosts. Hosts that are only linked to take part
    with empty seeds. Rounds end when no score moves by more than `settled`;
    it is an error if they don't in `rounds`, which bounds any graph at 0.85.
    """
    links = cut(links)
    everyone = hosts.select("host").unionByName(links.select(F.col("dst").alias("host"))).distinct()
    seeds = cut(everyone.join(hosts, "host", "left").select("host", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("good", "bad")]))
    keep = 1 - damping
    scores = seeds.select("host", (keep * F.col("good")).alias("trust"), (keep * F.col("bad")).alias("distrust"))
    if links.isEmpty():
        return scores
    out = links.groupBy("src").agg(F.sum("n").alias("out"))
    into = links.groupBy("dst").agg(F.sum("n").alias("into"))
    weights = cut(links.join(out, "src").join(into, "dst").select("src", "dst", (F.col("n") / F.col("out")).alias("w"), (F.col("n") / F.col("into")).alias("v")))
    for _ in range(rounds):
        down = weights.join(scores.select(F.col("host").alias("src"), "trust"), "src").select(F.col("dst").alias("host"), (F.col("w") * F.col("trust")).alias("t"), F.lit(0.0).alias("d"))
        up = weights.join(scores.select(F.col("host").alias("dst"), "distrust"), "dst").select(F.col("src").alias("host"), F.lit(0.0).alias("t"), (F.col("v") * F.col("distrust")).alias("d"))
        moved = down.unionByName(up).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        after = seeds.join(moved, "host", "left").select("host", *[(keep * F.col(s) + damping * F.coalesce(m, F.lit(0.0))).alias(n) for s, m, n in (("good", "t", "trust"), ("bad", "d", "distrust"))])
        before = scores.select("host", F.col("trust").alias("t0"), F.col("distrust").alias("d0"))
        both = cut(after.join(before, "host"))
        scores = both.select("host", "trust", "distrust")
        if both.filter((F.abs(F.col("trust") - F.col("t0")) > settled) | (F.abs(F.col("distrust") - F.col("d0")) > settled)).isEmpty():
            return scores
    raise RuntimeError(f"scores did not settle in {rounds} rounds")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, least_distrust: float = 0.5, damping: float = 0.85, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """`id_col`, host, path, rule, verdict, trust and distrust of every page.

    A rule's verdict holds where one fits. Hosts are seeds of trust by the
    share of their pages that rules allow, and of distrust by the share that
    they block. A page without a rule is blocked if its host is distrusted more
    than trusted and at least as much as a host of which the share
    `least_distrust` is blocked and that has no links; else it is allowed.

    Null urls and urls without `://` have an empty host and path, and null html
    has no links. Repeated rows are judged alike (and count as pages). Rules
    are a short list on the driver. An empty table gives an empty table; other
    columns are not read.
    """
    host, path = host_and_path(F.col(url_col))
    own = pages.select(F.col(id_col).alias("_id"), F.col(html_col).alias("_html"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    own = own.withColumn("rule", rule).withColumn("_verdict", verdict)
    share = lambda kind: F.avg((F.coalesce(F.col("_verdict"), F.lit("")) == kind).cast("double"))
    hosts = cut(own.groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad")))
    scores = spread(hosts, host_links(own, "_html"), damping)
    known = cut(scores.join(hosts.select("host"), "host", "left_semi"))
    bad = (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= (1 - damping) * least_distrust)
    judged = own.drop("_html").join(known, "host", "left")
    return judged.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("_verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")
