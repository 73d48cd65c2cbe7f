"""URL verdicts: host and path rules, and trust that spreads over links between hosts.

A rule fits its host and all subdomains if the url's path starts with the rule's path; the
longest rule wins.  A host is a blocked seed if block rules fit more than half of its pages,
else a trusted seed if an allow rule fits one; it weighs as many as these pages.  Personalised
PageRank carries trust along links from the trusted seeds; the same on the reversed links
carries distrust from the blocked seeds to hosts that lead to them.  A page without a rule is
blocked if its host has more distrust than trust, both as shares of the whole, and at least
``LEAST_DISTRUST`` times an even share of the distrust among all hosts and domains.

Links are the ``href`` targets of a page.  Relative ones name the page's own host; links within
a host move nothing.  Every page also counts as a link between its host and each domain above it
of at least two labels, both ways: hosts of one domain are one owner's, and share what they have
through it, whether or not the domain has pages itself.

Ranks are the sum of DAMPING^k times the seeds carried k links, divided by its total, which is
the PageRank whose hosts without a way on return to the seeds.  A round adds a power, so each
moves at most ``DAMPING`` of the one before and 58 rounds come below ``SETTLED`` whatever the
links; ``ROUNDS`` is a safety bound above that.

Defined results: a null url, or one without ``://``, has empty host and path, no rule, and the
verdict of a host without links (allow); a null html has no links; names of over 253 characters
or without letters have no domain above them; equal trust and distrust allow; repeated rows are
judged alike and count as often as they come; an empty table gives an empty result; other
columns don't matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.line_dedup import LOWER, UPPER
from quire.llm.store import saved

#: (verdict, host, path), as the list is stated.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
DAMPING, ROUNDS, SETTLED = 0.85, 100, 1e-4
LEAST_DISTRUST = 0.5
#: Rows of the link table for each partition of a round, and rounds between looks at how far the ranks moved.
ROUND_ROWS, LOOK = 500_000, 6


def host_of(url: Column) -> Column:
    """The url's host with A-Z lower-cased, empty without ``://``."""
    rest = F.regexp_extract(url, r"^(?s)(?:(?!://).)*://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s)(?:(?!://).)*://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """``pages`` with host, path, rule and rule_verdict (null where no rule fits)."""
    out = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    fitting, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # longer ones are asked first
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        fitting = F.when(fits, F.lit(host + path)).otherwise(fitting)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return out.withColumns({"rule": fitting, "rule_verdict": verdict})


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, links between different hosts and domains; ``pages`` has host and html."""
    known = pages.where("host != ''")
    href = F.regexp_extract_all(F.col("html"), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""), F.lit(1))
    each = known.select(F.col("host").alias("src"), F.explode(href).alias("target"))
    absolute = F.when(F.col("target").startswith("//"), F.concat(F.lit("http:"), F.col("target"))).otherwise(F.col("target"))
    named = absolute.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://")
    linked = each.select("src", F.when(named, host_of(absolute)).otherwise(F.col("src")).alias("dst")).where("dst != '' AND src != dst")
    counted = linked.groupBy("src", "dst").agg(F.count("*").cast("double").alias("links"))

    sizes = known.groupBy("host").agg(F.count("*").cast("double").alias("links"))
    name = F.regexp_replace("host", r"^.*@|:\d*$", "")
    labels = F.when(name.rlike("[a-z]") & (F.char_length(name) <= 253), F.split(name, r"\.")).otherwise(F.array().cast("array<string>"))
    above = sizes.select(F.col("host").alias("src"), "links", labels.alias("labels")).where("size(labels) > 2")
    owned = above.select("src", F.explode(F.expr("transform(sequence(2, size(labels) - 1), k -> array_join(slice(labels, -k, k), '.'))")).alias("dst"), "links")
    both = owned.unionByName(owned.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "links"))
    return counted.unionByName(both).where("src != dst").groupBy("src", "dst").agg(F.sum("links").alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """host, trust, distrust: personalised PageRank on the edges and on the reversed edges.

    ``seeds`` has host, trusted and blocked (weights).  Hosts of the edges are all there, with 0
    if nothing reaches them.  Ends once the ranks move by less than ``SETTLED`` in sum.
    """
    sums = seeds.agg(F.sum("trusted").alias("t"), F.sum("blocked").alias("b")).first()
    share = lambda name, total: (F.sum(name) / F.lit(float(total or 0) or 1.0)).alias(name)
    ways = edges.select("src", "dst", "links", F.lit(0).alias("back")).unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "links", F.lit(1).alias("back")))
    degree = ways.groupBy("src", "back").agg(F.sum("links").alias("degree"))
    ways = saved(ways.join(degree, ["src", "back"]).select("src", "dst", "back", (F.col("links") / F.col("degree") * DAMPING).alias("part")), "ways")
    parts = ways.count() // ROUND_ROWS + 1
    none = F.lit(0.0)
    silent = ways.select(F.col("dst").alias("host"), none.alias("trusted"), none.alias("blocked"))
    start = saved(seeds.select("host", "trusted", "blocked").unionAll(silent).groupBy("host").agg(share("trusted", sums["t"]), share("blocked", sums["b"])), "seeds")

    rank = start.select("host", F.col("trusted").alias("trust"), F.col("blocked").alias("distrust"))
    carried = lambda back, name: F.when(F.col("back") == back, F.col(name) * F.col("part")).otherwise(none).alias(name)
    for step in range(1, rounds + 1):
        sent = rank.join(ways, rank["host"] == ways["src"]).select(F.col("dst").alias("host"), carried(0, "trust"), carried(1, "distrust"))
        new = sent.unionAll(start).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        last, rank = rank, saved(new.coalesce(parts), "ranks")
        if step % LOOK == 0:
            old = last.select("host", F.col("trust").alias("t0"), F.col("distrust").alias("d0"))
            moved = rank.join(old, "host").agg(F.sum(F.abs(F.col("trust") - F.col("t0")) + F.abs(F.col("distrust") - F.col("d0"))).alias("m")).first()["m"]
            if (moved or 0.0) < SETTLED:
                break
    sums = rank.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d")).first()
    part = lambda name, total: (F.col(name) / F.lit(total or 1.0)).alias(name)
    return rank.select("host", part("trust", sums["t"]), part("distrust", sums["d"]))


def verdicts(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page."""
    judged = ruled(pages.select("page_id", "url", "html"), rules)
    ruled_pages = judged.where("host != ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("rule_verdict") == "allow").alias("a"), F.count_if(F.col("rule_verdict") == "block").alias("b"))
    bad = F.col("b") * 2 > F.col("n")
    seeds = ruled_pages.select("host", F.when(bad, 0.0).otherwise(F.col("a").cast("double")).alias("trusted"), F.when(bad, F.col("b").cast("double")).otherwise(0.0).alias("blocked"))
    rank = propagate(saved(host_edges(judged), "host-edges"), seeds)
    even = 1 / max(1, rank.count())
    out = judged.select("page_id", "host", "path", "rule", "rule_verdict").join(rank, "host", "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    apart = F.round(distrust, 9) > F.round(trust, 9)
    spread = F.when(apart & (distrust >= LEAST_DISTRUST * even), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", spread).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
