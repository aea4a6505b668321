"""URL filter by rules and by trust that spreads over links between hosts.

A rule is a host and the start of a path; it fits the host and its subdomains, the longest rule
that fits a url decides. Where none does, the host's standing decides: trust flows from hosts
with allowed pages along links (personalised PageRank), distrust flows from hosts with blocked
pages against the links (who links to blocked hosts is suspect), and a host whose share of
distrust passes a threshold is blocked.

DataFrame functions only. Pages are reduced to hosts before anything is exchanged (partial
counts by host, host pair and rule), so a host with a third of all pages is one row from each
task. Pages meet the standing of their hosts, and links the ranks of theirs, by ``shared.hot_join``: hosts with a large share of all rows
are joined where the rows are. The ranks of one iteration are a written table.

Iterations end when no host's rank moves by more than ``TOLERANCE`` of itself and ``PRIOR`` together. Both shrink as seeds grow in
number, so the end does not depend on the size of the input; ranks far below the prior decide nothing. Every step
moves at most ``DAMPING`` of what the one before moved, so the end comes after a number of steps that grows with the logarithm of the number of hosts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.shared import Scratch, hot_join, session_of

DAMPING = 0.85
TOLERANCE = 1e-7
#: A host is blocked if its distrust is more than this share of its distrust, its trust and ``PRIOR``.
THRESHOLD = 0.5
#: Standing of a host that nothing is known of, as a share of an average seed's.
PRIOR = 0.1


def prior_of(seeds: int) -> float:
    return PRIOR * (1 - DAMPING) / max(seeds, 1)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HREF = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*["']?([^"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    """``text`` is host and path, as in ``example.net/en/``."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0].translate(str.maketrans(_UPPER, _LOWER))

    @property
    def path(self) -> str:
        return self.text[len(self.text.partition("/")[0]) :]


RULES = (Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow"))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as struct<text, verdict>; null if none does. Among equally long ones the longer host wins."""
    none = F.lit(None).cast("struct<size:int,host_size:int,text:string,verdict:string>")
    hits = [F.when(((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path), F.struct(F.lit(len(r.text)).alias("size"), F.lit(len(r.host)).alias("host_size"), F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))) for r in rules]
    return F.greatest(*hits, none, none) if hits else none


def host_links(pages: DataFrame) -> DataFrame:
    """Links between different hosts: src, dst, links. Relative links stay on their host and are no edges."""
    found = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.col("html"), F.lit(_HREF), 1)).alias("href"))
    to = found.select("src", host_of(F.when(F.col("href").startswith("//"), F.concat(F.lit("x:"), F.col("href"))).otherwise(F.col("href"))).alias("dst"))
    return to.where("src != '' AND dst != '' AND src != dst").groupBy("src", "dst").agg(F.count("*").alias("links"))


def _seeds(hosts: DataFrame) -> int:
    return hosts.agg(F.sum((F.col("allowed") + F.col("blocked") > 0).cast("int")).alias("n")).first()["n"] or 0


def _moves(links: DataFrame, total: int, frm: str, to: str, share: str, other: str) -> DataFrame:
    """What part of a rank each link takes along: host, to, and a share for one kind of rank."""
    weights = links.groupBy(frm).agg(F.sum("links").alias("w"), F.count("*").alias("n"))
    found = hot_join(links, weights, frm, "n", total, "inner")
    return found.select(F.col(frm).alias("host"), F.col(to).alias("to"), (DAMPING * F.col("links") / F.col("w")).alias(share), F.lit(0.0).alias(other))


def propagate(hosts: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Trust and distrust of each host: from ``hosts`` (host, allowed, blocked) over ``links`` (src, dst, links).

    Seeds share one unit of trust (distrust) by their counts of allowed (blocked) pages. Rank that
    reaches a host without further links ends there.
    """
    totals = hosts.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")).first()
    prior, count = prior_of(_seeds(hosts)), links.count()
    along = _moves(links, count, "src", "dst", "trust_share", "distrust_share")
    against = _moves(links, count, "dst", "src", "distrust_share", "trust_share")
    moves = scratch.keep(along.unionByName(against), "moves")
    degrees = moves.groupBy("host").agg(F.count("*").alias("degree"))
    everyone = hosts.select("host").unionByName(links.select(F.col("dst").alias("host"))).distinct()
    base = everyone.join(hosts, "host", "left").join(degrees, "host", "left").select(
        "host",
        F.coalesce("degree", F.lit(0)).alias("degree"),
        (F.coalesce("allowed", F.lit(0)) * ((1 - DAMPING) / (totals["a"] or 1))).alias("trust_seed"),
        (F.coalesce("blocked", F.lit(0)) * ((1 - DAMPING) / (totals["b"] or 1))).alias("distrust_seed"),
    )
    kept = ["host", "degree", "trust_seed", "distrust_seed", "trust", "distrust"]
    ranks, step = scratch.keep(base.withColumns({"trust": F.col("trust_seed"), "distrust": F.col("distrust_seed")}), "ranks0"), 0
    while count:
        carried = hot_join(moves, ranks.select("host", "degree", "trust", "distrust"), "host", "degree", 2 * count, "inner")
        moved = carried.groupBy(F.col("to").alias("host")).agg(F.sum(F.col("trust") * F.col("trust_share")).alias("t"), F.sum(F.col("distrust") * F.col("distrust_share")).alias("d"))
        after = ranks.join(moved, "host", "left").withColumns({"t": F.col("trust_seed") + F.coalesce("t", F.lit(0.0)), "d": F.col("distrust_seed") + F.coalesce("d", F.lit(0.0))})
        step += 1
        after = scratch.keep(after, f"ranks{step}")
        scratch.drop(f"ranks{step - 1}")
        change = after.agg(F.max(F.greatest(*[F.abs(F.col(now) - F.col(old)) / (F.col(now) + prior) for now, old in (("t", "trust"), ("d", "distrust"))]))).first()[0]
        ranks = after.drop("trust", "distrust").withColumnsRenamed({"t": "trust", "d": "distrust"}).select(*kept)
        if change <= TOLERANCE:
            break
    return ranks.select("host", "trust", "distrust")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each row of ``pages`` (page_id, url, html): page_id, host, path, rule, verdict, trust, distrust.

    Defined cases: a url that is null or has no ``://`` has an empty host and path, fits no rule,
    has no standing and is allowed. A null html has no links. Rows that repeat are judged each. An
    empty table gives an empty result. Other columns are ignored.
    """
    scratch = Scratch(session_of(pages), "url-filter")
    cut = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    cut = cut.withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    counts = [F.count("*").alias("pages"), *[F.count(F.when(F.col("best.verdict") == v, 1)).alias(name) for v, name in (("allow", "allowed"), ("block", "blocked"))]]
    counted = scratch.keep(cut.groupBy("host").agg(*counts), "hosts")
    hosts = counted.where("host != ''").drop("pages")
    ranks, prior = propagate(hosts, scratch.keep(host_links(cut), "links"), scratch), prior_of(_seeds(hosts))
    spread = F.when(F.col("distrust") > THRESHOLD * (F.col("distrust") + F.col("trust") + prior), "block").otherwise("allow")
    standing = scratch.keep(counted.select("host", "pages").join(ranks.withColumn("spread", spread), "host", "left"), "standing")
    total = counted.agg(F.sum("pages")).first()[0] or 0
    judged = hot_join(cut.drop("html"), standing, "host", "pages", total)
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("best.text").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.col("spread"), F.lit("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
