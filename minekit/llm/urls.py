"""URL filters: fixed rules, and a tree of path templates per host that carries their verdicts to other urls.

The path segments of a url are a branch of its host's tree. Segments with
a digit are variable. Going down level by level, a literal segment keeps its own branch if it has at least
``SUPPORT`` urls and its share of blocked urls differs from that of its siblings by a two-proportion test; all others
become the wildcard of their parent. The first ``LEVELS`` levels are always cut; below them a branch goes on as long as a
literal further down can still be kept, however deep that is, and what follows is one wildcard. A template is rejected if the smoothed share of blocked urls among those that a
rule has judged exceeds ``PURITY``; it is smoothed towards its host, and the host towards all hosts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minekit.scale import settle

LEVELS, SUPPORT, Z, WEIGHT, PURITY = 3, 20, 1.96, 4.0, 0.5
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Verdict, host and path of a rule; ``net/`` is the host ``net`` with the path ``/``.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?`` or ``#``, A-Z lower-cased; empty if there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """``rule, verdict`` of the longest rule whose host is the url's or above it and whose path begins the url's; else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(start))
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _shape(path: Column) -> Column:
    """The path with ``*`` for each segment that holds a digit."""
    return F.regexp_replace(path, r"(?<=/)[^/0-9]*+[0-9][^/]*", "*")


def _blocked_share(blocked: Column, judged: Column) -> Column:
    return F.try_divide(blocked, judged)


def template_verdicts(shapes: DataFrame) -> DataFrame:
    """``shapes``: host, shape, urls, blocked, allowed. Adds the ``template``, its ``purity`` and ``verdict``."""
    parent, counted = ["host", "template"], ("urls", "blocked", "allowed", "deeper")
    at, closed, level = settle(shapes.withColumn("template", F.lit(""))), [], 0
    while True:
        level += 1
        parts = F.split("shape", "/")
        s = F.coalesce(F.get(parts, F.lit(level)), F.lit(""))
        deeper = F.when(F.size(parts) > level, F.col("urls")).otherwise(0)
        branches = at.select(*parent, s.alias("s"), "urls", "blocked", "allowed", deeper.alias("deeper")).groupBy(*parent, "s")
        branches = branches.agg(*[F.sum(c).alias(c) for c in counted])
        whole = branches.groupBy(*parent).agg(*[F.sum(c).alias(f"all_{c}") for c in counted])
        if level > LEVELS:
            # no literal below a branch can be kept if it has too few urls there, or no two verdicts to differ
            opened = settle(whole.where((F.col("all_deeper") >= SUPPORT) & (F.col("all_blocked") > 0) & (F.col("all_allowed") > 0)).select(*parent))
            if opened.isEmpty():
                break
            closed.append(settle(at.join(opened, parent, "left_anti").select(*at.columns)))
            at = settle(at.join(opened, parent, "left_semi").select(*at.columns))
            branches, whole = branches.join(opened, parent, "left_semi"), whole.join(opened, parent, "left_semi")
        judged, all_judged = F.col("blocked") + F.col("allowed"), F.col("all_blocked") + F.col("all_allowed")
        rest = all_judged - judged
        pooled = _blocked_share(F.col("all_blocked"), all_judged)
        gap = _blocked_share(F.col("blocked"), judged) - _blocked_share(F.col("all_blocked") - F.col("blocked"), rest)
        error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), judged) + F.try_divide(F.lit(1.0), rest)))
        apart = F.coalesce(F.abs(gap) > Z * error, F.lit(False))
        keeps = (F.col("s") == "") | ((F.col("urls") >= SUPPORT) & apart)
        named = branches.join(whole, parent).select(*parent, "s", F.concat("template", F.lit("/"), F.when(keeps, F.col("s")).otherwise("*")).alias("longer"))
        # as few rows as there are shapes, read several times below
        at = settle(at.withColumn("s", s).join(named, [*parent, "s"]).select(*shapes.columns, F.col("longer").alias("template")))
    for done in closed:
        at = at.unionByName(done)
    sums = [F.sum(c).cast("double").alias(c) for c in ("blocked", "allowed")]
    leaves = at.groupBy(*parent).agg(*sums)
    hosts = leaves.groupBy("host").agg(F.sum("blocked").alias("host_blocked"), F.sum("allowed").alias("host_allowed"))
    everything = hosts.agg(F.coalesce(F.try_divide(F.sum("host_blocked"), F.sum("host_blocked") + F.sum("host_allowed")), F.lit(0.0)).alias("share"))
    hosts = hosts.withColumn("prior", everything.select("share").scalar())
    host_share = (F.col("host_blocked") + WEIGHT * F.col("prior")) / (F.col("host_blocked") + F.col("host_allowed") + WEIGHT)
    leaves = leaves.join(hosts.select("host", host_share.alias("host_share")), "host")
    purity = (F.col("blocked") + WEIGHT * F.col("host_share")) / (F.col("blocked") + F.col("allowed") + WEIGHT)
    judged = leaves.select(*parent, purity.alias("purity"))
    verdict = F.when(F.round("purity", 9) > PURITY, "block").otherwise("allow")
    return at.join(judged, parent).select(*shapes.columns, "template", "purity", verdict.alias("verdict"))


def judge_urls(pages: DataFrame, *, url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Every row with ``host, path, rule, verdict``; the verdict is the rule's, else that of the url's template.

    A null url or one without ``://`` has an empty host and path and forms a host of its own. With no judged url at
    all everything is allowed. Columns of these names are replaced, others pass through, repeated rows each count.
    """
    own = [F.col("__row")[c].alias(c) for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    address = F.col(url)
    split = pages.select(F.struct(*pages.columns).alias("__row"), host_of(address).alias("__host"), path_of(address).alias("__path"))
    ruled = split.withColumn("__rule", rule_for(F.col("__host"), F.col("__path"), rules))
    shaped = ruled.withColumn("__shape", _shape(F.col("__path")))
    counts = shaped.groupBy(F.col("__host").alias("host"), F.col("__shape").alias("shape")).agg(
        F.count("*").alias("urls"),
        F.count_if(F.col("__rule.verdict") == "block").alias("blocked"),
        F.count_if(F.col("__rule.verdict") == "allow").alias("allowed"),
    )
    verdicts = template_verdicts(counts)
    found = verdicts.select(F.col("host").alias("__host"), F.col("shape").alias("__shape"), F.col("verdict").alias("__verdict"))
    done = shaped.join(found, ["__host", "__shape"], "left")
    return done.select(
        *own,
        F.col("__host").alias("host"),
        F.col("__path").alias("path"),
        F.col("__rule.rule").alias("rule"),
        F.coalesce("__rule.verdict", "__verdict").alias("verdict"),
    )
