"""URL filter: rules on hosts and paths, and trust that spreads over the graph of hosts [native].

Pages that a rule allows make their hosts trusted seeds, pages that a rule blocks make theirs
distrusted ones. Personalised PageRank carries trust along the edges of the host graph (whom a
trusted host links to is trusted), and distrust against them (who links to a distrusted host is
distrusted). A host is blocked if its distrust exceeds `factor` times its trust; a page without a rule
gets its host's verdict. Only DataFrame functions are used.

Edges are links of pages to other hosts (absolute or starting with //), weighted by the pages that have
them, and, if `domains` is set, each host and its parent domain in both directions, down to two labels.

Mass is an integer: a host's seed is the share of its pages with such a verdict in units of 10**9,
and an edge carries 17/20 of its host's mass by its share of the weight, rounded down. The result is
therefore the same in any order of sums and after any lost executor. Rounds stop when nothing
changes or after `rounds`. Mass of a host without an edge goes nowhere. 64 bits hold the masses of
up to 5 * 10**8 hosts under one domain.

Edges of a host with many of them are dealt over salts, one for each SALT_ROWS, and its mass is
repeated for each, so a hub is not one task. Counts of pages and links are combined before they are
shuffled. Host tables up to BROADCAST_ROWS are broadcast to the pages, larger ones are joined.

Defined results: a null url, or one without ://, has the empty host and path, no rule, and the verdict
allow; so has a host that no mass reaches. Null html has no links. Of fitting rules the longest
text wins, then the longer host. Repeated rows count each time. An empty table gives an empty
result. Kept columns whose names are taken by new ones are not kept: new ones win.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitweave.llm.common import written

#: (verdict, host and path prefix)
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
UNIT = 1_000_000_000
#: What an edge carries of its host's mass: 0.85.
DAMPING = (17, 20)
SALT_ROWS = 100_000
BROADCAST_ROWS = 200_000
#: Rounds between two writes of the masses.
ROUNDS_A_STEP = 4
#: The host of a link to elsewhere in an attribute href.
LINK = r"""(?i)[ \t\n\f\r"'/]href[ \t\n\f\r]*=[ \t\n\f\r]*["']?[ \t\n\f\r]*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'<> \t\n\f\r]+)"""


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty without ://."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return lowered(host), path


def fitting(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null without one."""
    chosen, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # from the weakest to the strongest, so that the strongest is looked at first
    for kind, rule in sorted(rules, key=lambda x: (len(x[1]), len(x[1].partition("/")[0]))):
        of, _, start = rule.partition("/")
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(f"/{start}")
        chosen, verdict = F.when(fits, rule).otherwise(chosen), F.when(fits, kind).otherwise(verdict)
    return chosen, verdict


def host_seeds(pages: DataFrame) -> DataFrame:
    """(host, trust, distrust) from pages (host, ruled): shares of a host's pages in UNIT."""
    n = pages.where(F.col("host") != "").groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("ruled") == "allow").alias("a"), F.count_if(F.col("ruled") == "block").alias("b"))
    return n.select("host", F.expr(f"{UNIT} * a div n").alias("trust"), F.expr(f"{UNIT} * b div n").alias("distrust"))


def link_edges(pages: DataFrame) -> DataFrame:
    """(a, b, w) from pages (host, html): how many pages of host a link to host b."""
    to = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lowered))
    return pages.where((F.col("host") != "") & F.col("html").contains("//")).select(F.col("host").alias("a"), F.explode(to).alias("b")).where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("w"))


def domain_edges(hosts: DataFrame) -> DataFrame:
    """(a, b, w): every host and its parent domain, both ways. A host of four labels has two ancestors."""
    labels = F.split("host", r"\.")
    up = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda k: F.struct(F.array_join(F.slice(labels, k, 1_000_000), ".").alias("a"), F.array_join(F.slice(labels, k + 1, 1_000_000), ".").alias("b")))
    steps = hosts.where(F.size(labels) > 2).select(F.explode(F.filter(up, lambda x: F.contains(x["b"], F.lit(".")))).alias("s")).select("s.*").distinct()
    return steps.unionByName(steps.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumn("w", F.lit(1).cast("long"))


def spread(seeds: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    """(host, trust, distrust) after so many rounds. edges: (a, b, w), each pair once."""
    # distrust runs against the edges: it is a mass of its own on reversed ones
    both = edges.select(F.lit(0).alias("kind"), "a", "b", "w").unionByName(edges.select(F.lit(1).alias("kind"), F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    out = both.groupBy("kind", "a").agg(F.sum("w").alias("out"), F.expr(f"1 + (count(*) - 1) div {SALT_ROWS}").alias("salts"))
    both = both.join(out, ["kind", "a"]).withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")))
    both, out = written(both.drop("salts"), "edges"), written(out.drop("out"), "hubs")
    start = seeds.select(F.explode(F.array(F.struct(F.lit(0).alias("kind"), "host", F.col("trust").alias("mass")), F.struct(F.lit(1).alias("kind"), "host", F.col("distrust").alias("mass")))).alias("s")).select("s.*").where("mass > 0")
    start = written(start, "seeds")
    num, den = DAMPING
    mass = start
    for done in range(0, rounds, ROUNDS_A_STEP):
        before = mass
        for _ in range(min(ROUNDS_A_STEP, rounds - done)):
            held = mass.join(out, (mass["kind"] == out["kind"]) & (mass["host"] == out["a"])).select(mass["kind"].alias("k"), "host", "mass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("s"))
            sent = held.join(both, (F.col("k") == F.col("kind")) & (F.col("host") == F.col("a")) & (F.col("s") == F.col("salt"))).select("kind", F.col("b").alias("host"), F.expr(f"(mass * {num} div ({den} * out)) * w").alias("mass"))
            mass = start.unionByName(sent).groupBy("kind", "host").agg(F.sum("mass").alias("mass")).where("mass > 0")
        mass = written(mass, "masses")
        if before.exceptAll(mass).isEmpty() and mass.exceptAll(before).isEmpty():
            break
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("mass")).otherwise(F.lit(0).cast("long")))
    return mass.groupBy("host").agg(of(0).alias("trust"), of(1).alias("distrust"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, rounds: int = 12, factor: int = 1, domains: bool = True, url: str = "url", html: str = "html", keep: Sequence[str] = ()) -> DataFrame:
    """keep columns with host, path, rule, verdict, trust and distrust of every page."""
    new = ("host", "path", "rule", "verdict", "trust", "distrust")
    keep = [c for c in dict.fromkeys(keep) if c.lower() not in new]
    host, path = parts(F.col(url))
    rows = pages.select(host.alias("host"), path.alias("path"), F.col(html).alias("html"), F.struct(*(F.col(c) for c in keep)).alias("own") if keep else F.lit(None).alias("own"))
    chosen, kind = fitting(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": chosen, "ruled": kind})
    seeds = written(host_seeds(rows.select("host", "ruled")), "hosts")
    edges = link_edges(rows)
    if domains:
        edges = edges.unionByName(domain_edges(seeds)).groupBy("a", "b").agg(F.sum("w").alias("w"))
    found = written(spread(seeds, edges, rounds), "trust")
    held = found.withColumnRenamed("host", "_host")
    held = F.broadcast(held) if held.count() <= BROADCAST_ROWS else held
    out = rows.join(held, F.col("host") == F.col("_host"), "left")
    trust, distrust = (F.coalesce(c, F.lit(0).cast("long")) for c in ("trust", "distrust"))
    verdict = F.coalesce("ruled", F.when(distrust > trust * factor, "block").otherwise("allow"))
    return out.select(*(F.col("own")[c].alias(c) for c in keep), "host", "path", "rule", verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
