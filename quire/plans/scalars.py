"""Scalar functions, projections and incremental pieces that SQL can state (X, P, F, N12, Q15, T, K)."""

import uuid

from pyspark.sql import Window, functions as F

from quire.functions import text as T
from quire.operators import findings as Q
from quire.operators import marks as M
from quire.operators import nav as N
from quire.plans.tables import DOCS_SQL, FINDINGS_SQL, doc_notes, findings, query

DOCS = f"d AS ({DOCS_SQL})"


@query("x2_resolver_key", "SELECT c_custkey, lower(trim(c_name)) AS key FROM customer")
def x2_key(read):
    return read("customer").select("c_custkey", T.key_udf("c_name").alias("key"))


@query("x3_search_fold", "SELECT doc_id, sha256(lower(nfc_normalize(split_part(text, chr(10), 1)))) AS folded FROM documents")
def x3_fold(read):
    return doc_notes(read).select("doc_id", F.sha2(T.fold_udf("title"), 256).alias("folded"))


@query("x6_collapsed", "SELECT doc_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS digest FROM documents")
def x6_collapsed(read):
    return read("documents").select("doc_id", F.sha2(T.collapsed(F.col("text")), 256).alias("digest"))


@query("x8_identity", "SELECT doc_id, sha256(text) AS identity FROM documents")
def x8_identity(read):
    return read("documents").select("doc_id", F.sha2("text", 256).alias("identity"))


@query("x16_leading_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def x16_date(read):
    name = F.concat(F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("note"), F.lit(" entry.md"))
    return read("orders").select("o_orderkey", F.date_format(T.leading_date(name), "yyyy-MM-dd").alias("day"))


@query("p4_declared_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def p4_date(read):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(F.col("o_orderkey") % 3 == 0, day).when(F.col("o_orderkey") % 3 == 1, F.concat(day, F.lit("T10:20:30Z"))).otherwise(F.concat(day, F.lit(" or so")))
    return read("orders").select("o_orderkey", F.date_format(T.declared_date(text), "yyyy-MM-dd").alias("day"))


@query("x18_heading_label", "SELECT p_partkey, split_part(p_name, ' ', 1) AS label FROM part")
def x18_label(read):
    return read("part").select("p_partkey", F.trim(F.split_part(F.replace("p_name", F.lit(" "), F.lit(" | ")), F.lit("|"), F.lit(1))).alias("label"))


@query("x19_kinds", "SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'map' WHEN 'PROMO' THEN 'course' ELSE 'note' END AS kind FROM part")
def x19_kinds(read):
    return read("part").select("p_partkey", F.when(F.col("p_type") == "ECONOMY", "map").when(F.col("p_type") == "PROMO", "course").otherwise("note").alias("kind"))


@query("x20_places", f"WITH {DOCS} SELECT doc_id, source AS one, source || '/' || domain AS two FROM d")
def x20_places(read):
    return doc_notes(read).select("doc_id", T.place(F.col("path"), 1).alias("one"), T.place(F.col("path"), 2).alias("two"))


@query("p1_titles", "SELECT doc_id, CASE WHEN split_part(text, chr(10), 1) <> '' THEN split_part(text, chr(10), 1) ELSE lpad(doc_id::VARCHAR, 6, '0') END AS title FROM documents")
def p1_titles(read):
    return doc_notes(read).select("doc_id", F.coalesce(F.nullif("title", F.lit("")), T.stem(F.col("path"))).alias("title"))


@query("p2_domains", f"WITH {DOCS} SELECT doc_id, domain FROM d WHERE source IN ('src1', 'src2')")
def p2_domains(read):
    return doc_notes(read).where(F.split_part("path", F.lit("/"), F.lit(1)).isin("src1", "src2")).select("doc_id", F.split_part("path", F.lit("/"), F.lit(2)).alias("domain"))


@query("p5_link_tokens", """SELECT page_id, len(regexp_extract_all(html, 'href="([^"]*)"')) AS links, list_aggregate(list_sort(regexp_extract_all(html, '<([a-z0-9]+)[ >]', 1)), 'string_agg', ',') AS tags FROM pages""")
def p5_tokens(read):
    rows = read("pages")
    tags = F.sort_array(F.regexp_extract_all("html", F.lit("<([a-z0-9]+)[ >]"), F.lit(1)))
    return rows.select("page_id", F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).cast("bigint").alias("links"), F.array_join(tags, ",").alias("tags"))


@query("p24_concept_ids", f"WITH {DOCS} SELECT doc_id, 'path-' || rtrim(translate(base64(encode(path)), '+/', '-_'), '=') AS id FROM d")
def p24_concepts(read):
    return doc_notes(read).select("doc_id", T.concept_id(F.col("path")).alias("id"))


@query("f1_knowledge", f"WITH {DOCS} SELECT doc_id FROM d WHERE source IN ('src4', 'src5')")
def f1_knowledge(read):
    return doc_notes(read).where(Q.knowledge(F.col("path"), ["SRC4", "src5"])).select("doc_id")


@query("f12_f13_membership", f"WITH {DOCS} SELECT doc_id, source = 'src6' AS journal, regexp_full_match(path, 'src7/en/[^/]+\\.md') AS report FROM d")
def f12_membership(read):
    return doc_notes(read).select("doc_id", Q.below(F.col("path"), ["src6"]).alias("journal"), F.col("path").rlike(r"^src7/en/[^/]+\.md$").alias("report"))


@query("n12_figures", """SELECT page_id, CASE WHEN octet_length(encode(html)) > 40000 THEN 'too-large' WHEN regexp_matches(html, '(?i)<iframe|<frame') THEN 'nested-frame' WHEN regexp_matches(html, '(?i)<(script|img|link)[^>]+(src|href)\\s*=\\s*.?https?:') THEN 'loads-elsewhere'
    WHEN regexp_matches(html, '(?i)\\son[a-z]+\\s*=') THEN 'script-outside-text' ELSE 'served' END AS verdict FROM pages""")
def n12_figures(read):
    html = F.col("html")
    verdict = (
        F.when(F.octet_length(html) > 40000, "too-large")
        .when(html.rlike("(?i)<iframe|<frame"), "nested-frame")
        .when(html.rlike(r"(?i)<(script|img|link)[^>]+(src|href)\s*=\s*.?https?:"), "loads-elsewhere")
        .when(html.rlike(r"(?i)\son[a-z]+\s*="), "script-outside-text")
        .otherwise("served")
    )
    return read("pages").select("page_id", verdict.alias("verdict"))


FRESH_SQL = """p AS (SELECT doc_id, sha256(text) AS page FROM documents WHERE doc_id % 11 <> 0), k AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '.' ELSE text END) AS disk FROM documents WHERE doc_id % 13 <> 0),
    s AS (SELECT doc_id, sha256(CASE WHEN doc_id % 14 = 0 THEN text || '.' ELSE text END) AS published FROM documents)"""


@query("q15_freshness", f"WITH {FRESH_SQL} SELECT doc_id, CASE WHEN disk IS NULL THEN 'gone' WHEN published IS DISTINCT FROM disk THEN 'preparing' WHEN disk IS DISTINCT FROM page THEN 'stale' ELSE 'unchanged' END AS state FROM p FULL JOIN k USING (doc_id) FULL JOIN s USING (doc_id)")
def q15_freshness(read):
    from quire.streaming.generations import freshness

    docs = read("documents").select("doc_id", "text")
    text = lambda k: F.sha2(F.when(F.col("doc_id") % k == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256)
    page = docs.where("doc_id % 11 <> 0").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("page"))
    disk = docs.where("doc_id % 13 <> 0").select(F.col("doc_id").alias("path"), text(7).alias("disk"))
    published = docs.select(F.col("doc_id").alias("path"), text(14).alias("published"))
    return freshness(page, disk, published).select(F.col("path").alias("doc_id"), "state")


@query("u7_scan_equality", "SELECT (SELECT count(*) FROM (SELECT doc_id, n_chars FROM documents WHERE doc_id % 2 = 0 EXCEPT SELECT doc_id, n_chars FROM documents)) = 0 AS subset, (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM documents WHERE doc_id % 2 = 0)) = 0 AS same")
def u7_equal(read):
    docs = read("documents").select("doc_id", "n_chars")
    part = docs.where("doc_id % 2 = 0")
    lost = part.exceptAll(docs).agg((F.count("*") == 0).alias("subset"))
    return lost.crossJoin(docs.exceptAll(part).agg((F.count("*") == 0).alias("same")))  # one row each


@query("t8_new_episodes", f"WITH f AS ({FINDINGS_SQL}), k AS (SELECT DISTINCT path, rule_id, CAST(ts AS DATE) AS day FROM f WHERE severity = 2), d AS (SELECT min(day) AS first FROM k) SELECT path, rule_id FROM k, d WHERE day = first + 1 EXCEPT SELECT path, rule_id FROM k, d WHERE day = first")
def t8_episodes(read):
    from quire.streaming.generations import episodes

    rows = findings(read).where("severity = 2").select("path", "rule_id", F.to_date("ts").alias("day")).distinct()
    days = rows.crossJoin(F.broadcast(rows.agg(F.min("day").alias("first"))))
    return episodes(days.where("day = date_add(first, 1)").select("path", "rule_id"), days.where("day = first").select("path", "rule_id"), True)[0]


@query("t4_carried_sources", "SELECT d.doc_id AS path, CASE WHEN d.doc_id % 5 = 0 THEN d.n_chars ELSE d.n_chars + 1 END AS value, d.doc_id % 5 = 0 AS stale FROM documents d")
def t4_carried(read):
    from quire.streaming.generations import carried

    docs = read("documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("value"))
    new = docs.select("path", F.when(F.col("path") % 5 != 0, F.col("value") + 1).alias("value"))
    return carried(new, docs, ["value"])


@query("s12_baseline", f"WITH f AS ({FINDINGS_SQL}) SELECT rule_id, count(*) AS n, count(DISTINCT path || '|' || coalesce(target, '')) AS fingerprints FROM f WHERE severity > 0 GROUP BY 1")
def s12_baseline(read):
    """Findings written as lines and read back as a baseline: each fingerprint is its rule's, path's and target's."""
    from quire.operators.resolve import cut
    from quire.sources.stores import read_baseline, write_findings

    rows = Q.with_fingerprint(findings(read).where("severity > 0"), F.coalesce("target", F.lit("")))
    spark = rows.sparkSession
    cut(spark.range(1))  # sets the shared folder
    path = f"{spark.sparkContext.getCheckpointDir()}/baseline-{uuid.uuid4().hex}"
    write_findings(rows, path)
    known = read_baseline(spark, path)
    own = rows.select("rule_id", "fingerprint").distinct()
    return known.join(own, "fingerprint").groupBy("rule_id").agg(F.count("*").alias("n"), F.count_distinct("fingerprint").alias("fingerprints"))


@query("k1_jsonl", "SELECT p_partkey, '{\"rule_id\":\"' || p_type || '\",\"path\":\"' || p_brand || '\"' || CASE WHEN p_size % 2 = 0 THEN ',\"line\":' || p_size ELSE '' END || '}' AS line FROM part")
def k1_jsonl(read):
    from quire.sources.stores import json_line

    rows = read("part").select("p_partkey", F.col("p_type").alias("rule_id"), F.col("p_brand").alias("path"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("line"))
    return rows.select("p_partkey", json_line("rule_id", "path", "line").alias("line"))


MARKS_SQL = """h AS (SELECT 'm' || c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'thought' WHEN 1 THEN 'mark' ELSE 'question' END AS kind, 'n' || c_nationkey AS path, c_mktsegment AS quote FROM customer WHERE c_custkey % 2 = 0),
    t AS (SELECT 'm' || c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'thought' WHEN 1 THEN 'mark' ELSE 'question' END AS kind, 'n' || c_nationkey AS path, CASE WHEN c_custkey % 5 = 0 THEN 'own ' || c_custkey ELSE c_mktsegment END AS quote FROM customer WHERE c_custkey % 2 = 1 OR c_custkey % 8 = 0),
    able AS (SELECT * FROM t WHERE path IN (SELECT 'n' || n_nationkey FROM nation WHERE n_regionkey <> 0) AND id NOT IN (SELECT id FROM h)), same AS (SELECT DISTINCT kind, path, quote FROM h)"""


def marks(read):
    """Two stores of marks and the notes that can be read: even customers are held, odd ones and some of the held ids come from elsewhere."""
    n = F.col("c_custkey")
    kind = F.when(n % 3 == 0, "thought").when(n % 3 == 1, "mark").otherwise("question")
    base = read("customer").select(n, F.concat(F.lit("m"), n.cast("string")).alias("id"), kind.alias("kind"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("path"), F.lit(None).cast("string").alias("anchor"), F.col("c_mktsegment").alias("quote"))
    own = F.when(n % 5 == 0, F.concat(F.lit("own "), n.cast("string"))).otherwise(F.col("quote"))
    readable = read("nation").where("n_regionkey <> 0").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("path"))
    return base.where("c_custkey % 2 = 0").drop("c_custkey"), base.where("c_custkey % 2 = 1 or c_custkey % 8 = 0").withColumn("quote", own).drop("c_custkey"), readable


@query("k6_adopted", f"WITH {MARKS_SQL} SELECT id, kind FROM h UNION ALL SELECT id, kind FROM able a WHERE kind = 'thought' OR NOT EXISTS (SELECT 1 FROM same s WHERE s.kind = a.kind AND s.path = a.path AND s.quote = a.quote)")
def k6_adopted(read):
    return M.adopt(*marks(read)).select("id", "kind")


@query("k5_kept_and_toggled", f"""WITH {MARKS_SQL}, other AS (SELECT DISTINCT kind, path, quote FROM t)
    SELECT 'kept' AS op, id FROM h UNION ALL SELECT 'kept', id FROM t a WHERE kind = 'thought' OR NOT EXISTS (SELECT 1 FROM same s WHERE s.kind = a.kind AND s.path = a.path AND s.quote = a.quote)
    UNION ALL SELECT 'toggled', id FROM h a WHERE NOT EXISTS (SELECT 1 FROM other s WHERE s.kind = a.kind AND s.path = a.path AND s.quote = a.quote)
    UNION ALL SELECT 'toggled', id FROM t a WHERE NOT EXISTS (SELECT 1 FROM same s WHERE s.kind = a.kind AND s.path = a.path AND s.quote = a.quote)
    UNION ALL SELECT 'removed', id FROM h WHERE id NOT IN (SELECT id FROM t)""")
def k5_kept(read):
    held, new, _ = marks(read)
    out = M.keep(held, new).select(F.lit("kept").alias("op"), "id").unionByName(M.toggle(held, new).select(F.lit("toggled").alias("op"), "id"))
    return out.unionByName(M.remove(held, new).select(F.lit("removed").alias("op"), "id"))


@query("k5_revised", f"WITH {MARKS_SQL} SELECT id, CASE WHEN kind = 'question' THEN 'because ' || id END AS reason, CASE WHEN kind = 'thought' THEN 'body ' || id END AS body FROM h")
def k5_revised(read):
    held, _, _ = marks(read)
    none = F.lit(None).cast("string")
    full = held.withColumns({"reason": none, "body": none, "resolved": F.lit(None).cast("timestamp")})
    changes = held.select("id", F.concat(F.lit("because "), "id").alias("reason"), F.concat(F.lit("body "), "id").alias("body"), F.lit(None).cast("timestamp").alias("resolved"))
    return M.revise(full, changes).select("id", "reason", "body")


@query("jn16_marks", f"WITH {DOCS} SELECT b.item_id, CASE WHEN d.doc_id IS NULL THEN 'note lost' WHEN contains(d.text, substr(b.text, 1, 20)) THEN 'located' ELSE 'location lost' END AS state FROM benchmark b LEFT JOIN d ON d.doc_id = b.item_id * 40")
def jn16_marks(read):
    from quire.operators.marks import joined

    marks = read("benchmark").select("item_id", (F.col("item_id") * 40).alias("path"), F.substring("text", 1, 20).alias("quote"))
    return joined(marks, doc_notes(read).select(F.col("doc_id").alias("path"), "text")).select("item_id", "state")


@query("n8_open_items", "SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_custkey, o_orderkey LIMIT 100")
def n8_open(read):
    from quire.operators.marks import newest

    rows = read("orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("at"), F.col("o_custkey").alias("sort_key"), F.col("o_orderkey").alias("anchor"))
    return newest(rows).limit(100).select("id", F.date_format("at", "yyyy-MM-dd").alias("day"))


@query("n7_health_kinds", f"WITH f AS ({FINDINGS_SQL}) SELECT CASE rule_id WHEN 'schema.frontmatter' THEN 0 WHEN 'link.broken' THEN 3 ELSE 5 END AS kind, path, count(DISTINCT coalesce(target, '')) AS n FROM f GROUP BY ALL")
def n7_health(read):
    from quire.operators.health import rows_of

    rows = findings(read)
    parts = {0: rows.where("rule_id = 'schema.frontmatter'"), 3: rows.where("rule_id = 'link.broken'"), 5: rows.where("rule_id not in ('schema.frontmatter', 'link.broken')")}
    return rows_of(parts).groupBy("kind", "path").agg(F.count("*").alias("n"))


LINES_SQL = """l AS (SELECT conv_id AS path, turn * 10 + row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) AS line, CASE WHEN role = 'user' THEN 1 + turn % 3 END AS level, text FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)),
    s AS (SELECT path, line, level, (SELECT min(b.line) FROM l b WHERE b.path = a.path AND b.line > a.line AND b.level <= a.level) AS stop FROM l a WHERE level IS NOT NULL),
    w AS (SELECT path, level, min(line) AS line, count(*) AS matches FROM s GROUP BY 1, 2), e AS (SELECT w.path, w.level, w.matches, s.line, s.stop FROM w JOIN s USING (path, line))"""


@query("p18_p20_excerpts", f"""WITH {LINES_SQL} SELECT e.path, e.level AS wanted, e.matches, count(l.line) AS lines, sha256(coalesce(string_agg(l.text, chr(10) ORDER BY l.line), '')) AS digest
    FROM e LEFT JOIN l ON l.path = e.path AND l.line > e.line AND (e.stop IS NULL OR l.line < e.stop) GROUP BY e.path, e.level, e.matches""")
def p18_excerpts(read):
    """Each conversation's turns as lines, those of users as headings of three levels; asked for is the first section of each level."""
    turns = read("conversations").select("conv_id", "turn", "role", "text").distinct()
    line = F.col("turn") * 10 + F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    lines = turns.select(F.col("conv_id").alias("path"), line.alias("line"), F.when(F.col("role") == "user", (F.col("turn") % 3 + 1).cast("int")).alias("level"), "text")
    headings = lines.where("level is not null").select("path", "line", "level", F.col("level").cast("string").alias("id"))
    found = N.excerpts(lines.select("path", "line", "text"), headings, headings.select("path", "id").distinct())
    return found.select("path", F.col("id").cast("bigint").alias("wanted"), "matches", "lines", F.sha2("excerpt", 256).alias("digest"))


@query("x1_nfc", "SELECT doc_id, sha256(nfc_normalize(text)) AS digest FROM documents")
def x1_nfc(read):
    return read("documents").select("doc_id", F.sha2(T.nfc_udf("text"), 256).alias("digest"))


@query("x5_fold_fragment", "SELECT p_partkey, lower(p_name || ' §' || p_size) AS folded FROM part")
def x5_fragment(read):
    return read("part").select("p_partkey", T.fragment_udf(F.concat("p_name", F.lit(" §"), F.col("p_size").cast("string"))).alias("folded"))


@query("p9_section_ids", "SELECT p_partkey, trim(regexp_replace(lower(p_name || ' (' || p_type || '), #' || p_size), '[^a-z0-9]+', '-', 'g'), '-') AS id FROM part")
def p9_sections(read):
    return read("part").select("p_partkey", T.section_id_udf(F.concat("p_name", F.lit(" ("), "p_type", F.lit("), #"), F.col("p_size").cast("string"))).alias("id"))


@query("p10_github_anchors", """WITH h AS (SELECT p_brand AS path, p_partkey, replace(regexp_replace(lower(p_name || ' (' || p_type || ')!'), '[^a-z0-9_ -]', '', 'g'), ' ', '-') AS slug FROM part),
    n AS (SELECT path, p_partkey, slug, row_number() OVER (PARTITION BY path, slug ORDER BY p_partkey) AS k FROM h) SELECT p_partkey, slug || CASE WHEN k > 1 THEN '-' || (k - 1) ELSE '' END AS anchor FROM n""")
def p10_anchors(read):
    own = F.struct("p_partkey", F.concat("p_name", F.lit(" ("), "p_type", F.lit(")!")).alias("name"))
    notes = read("part").groupBy(F.col("p_brand").alias("path")).agg(F.sort_array(F.collect_list(own)).alias("h"))
    both = notes.select("h", T.github_anchors_udf(F.transform("h", lambda x: x["name"])).alias("a"))
    return both.select(F.inline(F.arrays_zip(F.transform("h", lambda x: x["p_partkey"]).alias("p_partkey"), F.col("a").alias("anchor"))))
