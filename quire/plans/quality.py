"""Findings: scoreboard, leverage, folding, totals, gate, baseline, scope and order."""

from pyspark.sql import functions as F

from quire.operators import check as C
from quire.operators import findings as Q
from quire.plans.tables import DOCS_SQL, FINDINGS_SQL, doc_notes, findings, query

WITH = f"WITH f AS ({FINDINGS_SQL})"


@query("a7_scoreboard", f"{WITH} SELECT domain, count(*) FILTER (severity = 2) AS errors, count(*) FILTER (severity = 1) AS warns FROM f GROUP BY 1 HAVING count(*) FILTER (severity >= 1) > 0")
def a7_scoreboard(read):
    return Q.scoreboard(findings(read))


@query("a8_leverage", f"""{WITH} SELECT lower(target) AS key, arg_min(target, seq) AS target, count(*) AS n, bool_and(severity = 0) AS planned, array_to_string(list_sort(list(DISTINCT domain)), ',') AS domains
    FROM f WHERE rule_id IN ('link.broken', 'link.title_not_alias') AND target IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def a8_leverage(read):
    return Q.leverage(findings(read), F.lower("target")).withColumn("domains", F.array_join("domains", ","))


@query("o10_leverage_top5", f"{WITH} SELECT lower(target) AS key, count(*) AS n FROM f WHERE rule_id IN ('link.broken', 'link.title_not_alias') AND target IS NOT NULL GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, key LIMIT 5")
def o10_top(read):
    return Q.leverage(findings(read), F.lower("target")).orderBy(F.desc("n"), "key").limit(5).select("key", "n")


@query("a9_folded_findings", f"""{WITH} SELECT domain, rule_id, coalesce(target, path) AS target, sum(greatest(line, 1))::BIGINT AS blast, arg_min(path, seq) AS path FROM f f0 WHERE severity > 0 GROUP BY domain, rule_id, coalesce(target, f0.path)""")
def a9_folded(read):
    rows = findings(read).withColumn("members", F.array_repeat("path", F.col("line"))).withColumn("message", F.col("path"))
    return Q.folded(rows).drop("message")


@query("a10_totals", f"{WITH} SELECT count(*) FILTER (severity = 2) AS errors, count(*) FILTER (severity = 1) AS warns, count(*) FILTER (severity = 0) AS hidden, count(*) FILTER (severity = 0 AND rule_id = 'link.broken.path') AS external, count(*) FILTER (severity = 0 AND rule_id <> 'link.broken.path') AS planned FROM f")
def a10_totals(read):
    return Q.totals(findings(read))


GATE_SQL = f"""{WITH}, g AS (SELECT *, rule_id <> 'schema.frontmatter' AS mild, rule_id IN ('link.title_not_alias', 'link.broken.path') AND severity = 0 AS softest FROM f)
    SELECT 'error' AS deny, bool_or(severity >= 2) AS failed FROM g UNION ALL SELECT 'error, without errors', bool_or(severity >= 2) FROM g WHERE mild
    UNION ALL SELECT 'warn, information only', bool_or(severity >= 1) FROM g WHERE softest UNION ALL SELECT 'rule', bool_or(rule_id = 'link.broken' AND severity >= 1) FROM g WHERE mild
    UNION ALL SELECT 'rule as information', bool_or(rule_id = 'link.title_not_alias' AND severity >= 1) FROM g WHERE softest
    UNION ALL SELECT 'navigation', bool_or(rule_id = 'schema.navigation_unavailable') FROM g WHERE mild UNION ALL SELECT 'nothing found', false"""


@query("a11_gate", GATE_SQL)
def a11_gate(read):
    rows = findings(read)
    mild, softest = rows.where("rule_id <> 'schema.frontmatter'"), rows.where("rule_id in ('link.title_not_alias', 'link.broken.path') and severity = 0")
    cases = {
        "error": (rows, ("error",)), "error, without errors": (mild, ("error",)), "warn, information only": (softest, ("warn",)), "rule": (mild, ("link.broken",)),
        "rule as information": (softest, ("link.title_not_alias",)), "navigation": (mild, ("course.role_missing",)), "nothing found": (rows.where("false"), ("info", "course.disk_mismatch")),
    }
    out = None
    for name, (own, deny) in cases.items():
        row = Q.gate(own, deny).select(F.lit(name).alias("deny"), "failed")
        out = row if out is None else out.unionByName(row)
    return out


@query("a17_findings_by_note", f"{WITH} SELECT path, count(*) AS n, max(severity)::INTEGER AS heaviest, bool_or(rule_id = 'schema.frontmatter') AS unreadable FROM f GROUP BY 1")
def a17_by_note(read):
    return Q.by_note(findings(read))


@query("a18_health_shape", f"{WITH} SELECT count(*) AS total, count(*) FILTER (severity = 2) AS errors, count(*) FILTER (severity = 1) AS warns, count(DISTINCT path) AS files FROM f")
def a18_shape(read):
    level = F.col("severity")
    return findings(read).agg(F.count("*").alias("total"), F.count_if(level == 2).alias("errors"), F.count_if(level == 1).alias("warns"), F.count_distinct("path").alias("files"))


@query("u1_union_of_rules", f"{WITH} SELECT rule_id, seq, (CASE severity WHEN 2 THEN 0 ELSE 1 END)::INTEGER AS rule_seq FROM f WHERE severity >= 1")
def u1_union(read):
    rows = findings(read)
    return Q.merged(rows.where("severity = 2"), rows.where("severity = 1")).select("rule_id", "seq", "rule_seq")


@query("u2_beyond_baseline", f"""{WITH}, k AS (SELECT *, sha256(concat_ws('|', rule_id, path, target)) AS fingerprint, CAST(ts AS DATE) AS day FROM f), days AS (SELECT min(day) AS first FROM k)
    SELECT seq, fingerprint FROM k, days WHERE day = first + 1 AND (rule_id = 'schema.frontmatter' OR fingerprint NOT IN (SELECT fingerprint FROM k, days WHERE day = first))""")
def u2_baseline(read):
    rows = findings(read).withColumn("fingerprint", F.sha2(F.concat_ws("|", "rule_id", "path", "target"), 256)).withColumn("day", F.to_date("ts"))
    rows = rows.withColumn("rule_id", F.when(F.col("rule_id") == "schema.frontmatter", "scan.unreadable").otherwise(F.col("rule_id")))
    first = rows.agg(F.min("day").alias("first"))
    own = rows.crossJoin(F.broadcast(first))  # one row
    return Q.beyond_baseline(own.where("day = date_add(first, 1)"), own.where("day = first")).select("seq", "fingerprint")


@query("f2_egress", f"{WITH} SELECT seq FROM f WHERE path NOT IN ('user-1', 'user-7', 'user-12')")
def f2_egress(read):
    return Q.egress(findings(read).withColumn("members", F.array("path")), ["User-1", "user-7", "user-12"]).select("seq")


@query("f8_scope", f"{WITH} SELECT seq FROM f WHERE path IN ('user-3', 'user-30') OR (line = 2 AND path = 'user-7')")
def f8_scope(read):
    rows = findings(read)
    prefixes = Q.scopes(["./user-3/", "user-30", "box"], ["USER-9"], rows.select(F.explode(F.array("path", F.lit("box/user-7"), F.lit("user-30"))).alias("path")))
    return Q.in_scope(rows.withColumn("members", F.when((F.col("path") == "user-7") & (F.col("line") == 2), F.array(F.lit("box/user-7"))).otherwise(F.array(F.lit("USER-3"), F.lit("user-31"), F.lit("boxes/x")))), prefixes).select("seq")


PARTIAL = ("link.broken", "link.title_not_alias", "course.disk_mismatch", "course.disk_unlisted", "provenance.unresolved")
EXTRA = ("collision.name", "collision.alias", "course.disk_mismatch", "course.disk_unlisted", "provenance.unresolved", "course.role_missing")


@query("f11_partial_corpus", f"{WITH}, m AS (SELECT rule_id FROM f UNION ALL SELECT unnest({list(EXTRA)}) FROM f WHERE severity = 2) SELECT rule_id, count(*) AS n FROM m WHERE rule_id NOT IN {PARTIAL} GROUP BY 1")
def f11_partial(read):
    rows = findings(read)
    more = rows.where("severity = 2").withColumn("rule_id", F.explode(F.array(*map(F.lit, EXTRA))))
    return Q.partial_corpus(rows.unionByName(more), F.lit(True)).groupBy("rule_id").agg(F.count("*").alias("n"))


@query("o2_finding_order", f"{WITH} SELECT path, line, rule_id, seq FROM f ORDER BY path, coalesce(line, 0), rule_id, seq")
def o2_order(read):
    return Q.ordered(findings(read)).select("path", "line", "rule_id", "seq")


@query("o9_scoreboard_order", f"{WITH} SELECT domain, count(*) FILTER (severity = 2) AS errors FROM f GROUP BY 1 ORDER BY errors DESC, domain LIMIT 4")
def o9_order(read):
    return Q.scoreboard(findings(read)).orderBy(F.desc("errors"), "domain").limit(4).select("domain", "errors")


@query("r40_r41_scan_problems", f"""WITH d AS ({DOCS_SQL}) SELECT path, 'scan.unreadable' AS rule_id, 'can''t be read, so nothing was judged from it: ' || n_chars || ' characters' AS message FROM d WHERE source <> 'src2'
    UNION ALL SELECT '', 'scan.unreadable', 'a file in a withheld folder can''t be read' WHERE EXISTS (SELECT 1 FROM d WHERE source = 'src2')""")
def scan_problems(read):
    """Every document as a file that can't be read; those of a withheld folder leave one row together."""
    lost = C.lost_files(doc_notes(read).select("path", F.concat(F.col("n_chars").cast("string"), F.lit(" characters")).alias("cause")), ["Src2"])
    return lost.select("path", "rule_id", "message")
