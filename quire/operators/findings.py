"""Findings: aggregations over the relation of diagnostics, baseline, scope, gate and order.

Columns: rule_id, severity (0 info, 1 warn, 2 error), path, line, target, members (array), message, fingerprint, seq.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quire.functions import text as T
from quire.operators import courses

INFO, WARN, ERROR = 0, 1, 2
#: Rules that need the whole corpus: withheld while some file could not be read.
WHOLE_CORPUS = ("link.broken", "link.title_not_alias", "course.disk_mismatch", "course.disk_unlisted", "provenance.unresolved")
#: The finding of a contract whose navigation roles can't be read, and rules beside the course grammar's that read these roles.
NO_NAVIGATION, BY_NAVIGATION = "schema.navigation_unavailable", ("course.disk_mismatch", "course.disk_unlisted")
SEVERITIES = {"info": INFO, "warn": WARN, "error": ERROR}


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy("path", F.coalesce("line", F.lit(0)), "rule_id", "seq")


def merged(*rules: DataFrame) -> DataFrame:
    """UNION ALL of rule outputs; ``seq`` keeps the rules' order."""
    out = None
    for k, rule in enumerate(rules):
        rule = rule.withColumn("rule_seq", F.lit(k))
        out = rule if out is None else out.unionByName(rule, allowMissingColumns=True)
    return out


def beyond_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings whose fingerprint an earlier run doesn't have; unreadable files always stay."""
    always = F.col("rule_id") == "scan.unreadable"
    new = findings.where(~always).join(baseline.select("fingerprint").distinct(), "fingerprint", "left_anti")
    return findings.where(always).unionByName(new.select(findings.columns))


def scoreboard(findings: DataFrame) -> DataFrame:
    """Errors and warnings of each domain; domains without either drop out."""
    out = findings.groupBy("domain").agg(F.count_if(F.col("severity") == ERROR).alias("errors"), F.count_if(F.col("severity") == WARN).alias("warns"))
    return out.where("errors + warns > 0")


def leverage(findings: DataFrame, key: Column) -> DataFrame:
    """Targets named by several broken links: count, whether all are planned (info), domains, first spelling."""
    return (
        findings.where(F.col("rule_id").isin("link.broken", "link.title_not_alias") & F.col("target").isNotNull())
        .groupBy(key.alias("key"))
        .agg(F.min_by("target", "seq").alias("target"), F.count("*").alias("n"), F.every(F.col("severity") == INFO).alias("planned"), F.sort_array(F.collect_set("domain")).alias("domains"))
        .where("n > 1")
    )


def folded(findings: DataFrame) -> DataFrame:
    """Like findings as one, with the number of places they touch; information drops out, and without a target the path stands for it."""
    return findings.where(F.col("severity") > INFO).groupBy("domain", "rule_id", F.coalesce("target", "path").alias("target")).agg(
        F.sum(F.greatest(F.size("members"), F.lit(1))).alias("blast"), F.min_by("message", "seq").alias("message"), F.min_by("path", "seq").alias("path")
    )


def totals(findings: DataFrame) -> DataFrame:
    """Errors, warnings, hidden (info), external and planned in one row."""
    external = (F.col("severity") == INFO) & (F.col("rule_id") == "link.broken.path")
    out = findings.agg(F.count_if(F.col("severity") == ERROR).alias("errors"), F.count_if(F.col("severity") == WARN).alias("warns"), F.count_if(F.col("severity") == INFO).alias("hidden"), F.count_if(external).alias("external"))
    return out.withColumn("planned", F.col("hidden") - F.col("external"))


def gate(findings: DataFrame, deny: tuple[str, ...] = ("error",)) -> DataFrame:
    """Whether the check fails (deny: severities and rules): a finding at the lowest denied severity, a denied rule at
    warning level, or that navigation is unavailable where a denied rule needs it."""
    hit = F.lit(False)
    if levels := [SEVERITIES[d] for d in deny if d in SEVERITIES]:
        hit = hit | (F.col("severity") >= min(levels))
    rules = [d for d in deny if d not in SEVERITIES]
    if rules:
        hit = hit | (F.col("rule_id").isin(*rules) & (F.col("severity") >= WARN))
    if any(r in BY_NAVIGATION or r in courses.RULES for r in rules):
        hit = hit | (F.col("rule_id") == NO_NAVIGATION)
    return findings.agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("failed"))


def partial_corpus(findings: DataFrame, partial: Column) -> DataFrame:
    return findings.where(~(partial & F.col("rule_id").isin(*WHOLE_CORPUS)))


def below(path: Column, directories: list[str]) -> Column:
    """Whether a path lies at or below one of some directories, by segments and without regard to case."""
    low = F.lower(path)
    out = F.lit(False)
    for d in directories:
        out = out | (low == d.lower()) | low.startswith(d.lower() + "/")
    return out


def allowed(path: Column, withheld: list[str] | None) -> Column:
    """Whether a path may leave; without any authority nothing may."""
    if withheld is None:
        return F.lit(False)
    clean = ~path.rlike(r"(^/|(^|/)\.\.?(/|$)|//|/$|^$)")
    return clean & ~below(path, withheld)


def egress(findings: DataFrame, withheld: list[str] | None) -> DataFrame:
    """Findings all of whose paths may leave."""
    members = F.forall(F.coalesce("members", F.array().cast("array<string>")), lambda m: allowed(m, withheld))
    return findings.where(allowed(F.col("path"), withheld) & members)


def knowledge(path: Column, layers: list[str] | None) -> Column:
    """Membership of the knowledge layer: first segment; everything if none is declared."""
    return F.lit(True) if not layers else F.lower(F.split(path, "/")[0]).isin(*[x.lower() for x in layers])


def scopes(asked: list[str], withheld: list[str] | None, paths: DataFrame) -> list[str]:
    """The prefixes that some scopes stand for; refused are absolute ones, then withheld ones, then those that hold no file."""
    for p in asked:
        if p.startswith("/"):
            raise ValueError(f"a scope is written from the root of the collection: {p}")
    out = []
    for p in asked:
        own = T.nfc(re.sub(r"^(\./+)+", "", p.replace("\\", "/")).rstrip("/"))
        if not own:
            raise ValueError(f"a scope that names no path: {p}")
        if own != "." and (withheld is None or any(own.lower() == d.lower() or own.lower().startswith(d.lower() + "/") for d in withheld)):
            raise ValueError(f"a scope that is withheld: {p}")
        if own != "." and paths.where(inside(F.col("path"), [own])).isEmpty():
            raise ValueError(f"a scope that holds no file: {p}")
        out.append(own)
    return out


def inside(path: Column, prefixes: list[str]) -> Column:
    """Whether a path is one of some prefixes or lies below one, by segments, as spelled; "." holds every path."""
    out = F.lit("." in prefixes)
    for p in prefixes:
        out = out | (path == p) | path.startswith(f"{p}/")
    return out


def in_scope(findings: DataFrame, prefixes: list[str]) -> DataFrame:
    """Findings whose path or a member lies below one of the prefixes."""
    members = F.exists(F.coalesce("members", F.array().cast("array<string>")), lambda m: inside(m, prefixes))
    return findings.where(inside(F.col("path"), prefixes) | members)


def by_note(findings: DataFrame) -> DataFrame:
    """For each note: number of findings, heaviest severity, whether its frontmatter can't be read."""
    return findings.groupBy("path").agg(F.count("*").alias("n"), F.max("severity").alias("heaviest"), F.bool_or(F.col("rule_id") == "schema.frontmatter").alias("unreadable"))


def summary(findings: DataFrame) -> DataFrame:
    """For each rule and severity the findings and the notes they touch."""
    return findings.groupBy("rule_id", "severity").agg(F.count("*").alias("n"), F.count_distinct("path").alias("notes"))


def navigation_unavailable(types: DataFrame) -> DataFrame:
    """Collections whose types (collection, type, role) can't be told by their roles: a role that there isn't, or a role of one type on several."""
    held = types.where("role <> ''").groupBy("collection", "role").agg(F.count_distinct("type").alias("n"))
    fault = ~F.col("role").isin("lesson", "course", "map", "thought") | (F.col("role").isin("lesson", "thought") & (F.col("n") > 1))
    return held.where(fault).groupBy("collection").agg(F.count("*").alias("n_roles")).select(F.lit(NO_NAVIGATION).alias("rule_id"), F.lit(ERROR).alias("severity"), "collection", "n_roles")


def not_boolean(kind: Column) -> Column:
    """Whether a flag is written as anything but a boolean (by the kind of its value; an absent or empty one isn't written)."""
    return F.coalesce(~kind.isin("bool", "null"), F.lit(False))


def not_text(kind: Column) -> Column:
    """Whether a field is written as anything but text."""
    return F.coalesce(~kind.isin("text", "null"), F.lit(False))


def with_fingerprint(findings: DataFrame, target: Column) -> DataFrame:
    return findings.withColumn("fingerprint", T.fingerprint_udf("rule_id", "path", target))
