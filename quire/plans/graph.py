"""Resolution, backlinks, collisions and coverage (JN, A1-A6, U)."""

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import courses
from quire.operators import coverage as C
from quire.operators import health as H
from quire.operators import resolve as R
from quire.plans.tables import EDGES_SQL, PARTS_SQL, edges, part_notes, query

NAMES_SQL = f"""notes AS ({PARTS_SQL}),
    names AS (SELECT lower(trim(name)) AS key, path, kind, kind <> 'alias' AS located FROM (
        SELECT path, 'stem' AS kind, 'part-' || p_partkey AS name FROM notes UNION ALL SELECT path, 'filename', 'part-' || p_partkey || '.md' FROM notes
        UNION ALL SELECT path, 'path_stem', replace(path, '.md', '') FROM notes UNION ALL SELECT path, 'path', path FROM notes UNION ALL SELECT path, 'alias', alias FROM notes UNION ALL SELECT path, 'alias', alias2 FROM notes)),
    holders AS (SELECT key, list_sort(list(DISTINCT path)) AS paths, bool_or(located) AS located FROM names GROUP BY key),
    edges AS ({EDGES_SQL}),
    targets AS (SELECT 'order-' || l_orderkey AS path, l_linenumber AS line, unnest(['part-' || l_partkey, p_name, 'part-' || (l_partkey + 1000000)]) AS target FROM edges JOIN part ON p_partkey = l_partkey),
    links AS (SELECT path, line, target, lower(trim(target)) AS key FROM targets),
    resolved AS (SELECT l.*, paths, located, CASE WHEN paths IS NULL THEN 'unresolved' WHEN len(paths) = 1 THEN 'unique' ELSE 'ambiguous' END AS resolution FROM links l LEFT JOIN holders USING (key))"""


def names(read):
    return R.claims(part_notes(read), key=T.ascii_key)


def links(read):
    part = read("part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    named = lambda k: F.concat(F.lit("part-"), F.col("l_partkey").__add__(k).cast("string"))
    both = edges(read).join(part, "l_partkey")
    rows = both.select(F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("path"), F.col("l_linenumber").alias("line"), F.explode(F.array(named(0), "p_name", named(1_000_000))).alias("target"))
    return rows.withColumn("key", T.ascii_key(F.col("target")))


@query("a5_coverage", f"""WITH edges AS ({EDGES_SQL}), seen AS (SELECT l_partkey, bool_or(from_map) AS mapped FROM edges GROUP BY 1)
    SELECT coalesce(p_brand, '(none)') AS domain, count(*) AS concepts, count(*) FILTER (mapped) AS mounted, count(*) FILTER (NOT mapped) AS pending, count(*) FILTER (mapped IS NULL) AS orphan
    FROM part LEFT JOIN seen ON l_partkey = p_partkey GROUP BY 1""")
def a5_coverage(read):
    concepts = read("part").select(F.col("p_partkey").alias("path"), F.col("p_brand").alias("domain"))
    return C.coverage(concepts, edges(read).select(F.col("l_partkey").alias("target"), "from_map"))


@query("a6_unrouted", f"""WITH edges AS ({EDGES_SQL}) SELECT p_partkey AS path, p_type AS type, 'F' AS index FROM part WHERE p_type IN ('ECONOMY', 'PROMO')
    AND p_partkey NOT IN (SELECT l_partkey FROM edges WHERE from_map)""")
def a6_unrouted(read):
    notes = read("part").select(F.col("p_partkey").alias("path"), F.col("p_type").alias("type"))
    mapped = edges(read).where("from_map").select(F.lit("F").alias("index"), F.col("l_partkey").alias("target"))
    return C.unrouted(notes, mapped, {"ECONOMY": "F", "PROMO": "F"}).select("path", "type", "index")


@query("jn1_resolution", f"WITH {NAMES_SQL} SELECT path, line, target, resolution, coalesce(len(paths), 0)::INTEGER AS candidates FROM resolved")
def jn1_resolution(read):
    return R.resolve(links(read), names(read), whole=False).select("path", "line", "target", "resolution", "candidates")


@query("jn2_suffix_resolution", f"""WITH {NAMES_SQL}, targets2 AS (SELECT p_partkey, lower(substr(p_brand, 3) || '/part-' || p_partkey) AS bad, lower(p_brand || '/part-' || p_partkey || '.md') AS good FROM part),
    all_paths AS (SELECT 'vault/' || path AS path FROM notes), suffix AS (SELECT lower('vault/' || path) AS full, 'vault/' || path AS path FROM notes),
    asked AS (SELECT p_partkey, unnest([bad, good]) AS key FROM targets2)
    SELECT p_partkey, a.key, CASE WHEN count(s.path) = 0 THEN 'unresolved' WHEN count(s.path) = 1 THEN 'unique' ELSE 'ambiguous' END AS resolution, min(s.path) AS first
    FROM asked a LEFT JOIN suffix s ON s.full = 'vault/' || a.key GROUP BY ALL""")
def jn2_suffix_resolution(read):
    notes = part_notes(read).withColumn("path", F.concat(F.lit("vault/"), "path"))
    bad = F.lower(F.concat(F.substring("domain", 3, 100), F.lit("/part-"), F.col("p_partkey").cast("string")))
    good = F.lower(F.concat("domain", F.lit("/part-"), F.col("p_partkey").cast("string"), F.lit(".md")))
    asked = notes.select("p_partkey", F.explode(F.array(bad, good)).alias("key"))
    found = R.resolve_with_suffixes(asked, R.claims(notes, key=T.ascii_key), notes, key=T.ascii_key, whole=False)
    return found.select("p_partkey", "key", "resolution", F.col("paths")[0].alias("first"))


@query("jn3_only_by_alias", f"WITH {NAMES_SQL} SELECT key, paths[1] AS path FROM holders WHERE len(paths) = 1 AND NOT located")
def jn3_only_by_alias(read):
    return R.only_by_alias(names(read))


BROKEN_SQL = f"""WITH {NAMES_SQL}, titles AS (SELECT lower(p_type) AS key, list_sort(list(DISTINCT 't' || p_size)) AS titled FROM part GROUP BY 1),
    asked AS (SELECT path, line, target, key FROM links UNION ALL SELECT 'order-0', 0, p_type, lower(p_type) FROM part WHERE p_partkey % 50 = 0),
    r AS (SELECT a.*, paths FROM asked a LEFT JOIN holders USING (key)), planned AS (SELECT DISTINCT lower('part-' || (p_partkey + 1000000)) AS key FROM part WHERE p_partkey % 3 = 0)
    SELECT r.path, r.line, r.target, titled IS NOT NULL AS has_title, p.key IS NOT NULL AS planned, CASE WHEN titled IS NULL THEN 'link.broken' ELSE 'link.title_not_alias' END AS rule
    FROM r LEFT JOIN titles t USING (key) LEFT JOIN planned p USING (key) WHERE paths IS NULL"""


@query("jn4_jn5_broken_links", BROKEN_SQL)
def broken_links(read):
    part = read("part")
    more = part.where("p_partkey % 50 = 0").select(F.lit("order-0").alias("path"), F.lit(0).alias("line"), F.col("p_type").alias("target"), F.lower("p_type").alias("key"))
    asked = links(read).unionByName(more)
    titles = part.select(F.lower("p_type").alias("key"), F.concat(F.lit("t"), F.col("p_size").cast("string")).alias("path"))
    planned = part.where("p_partkey % 3 = 0").select(F.concat(F.lit("part-"), (F.col("p_partkey") + 1_000_000).cast("string")).alias("key"))
    out = R.broken(R.resolve(asked, names(read), whole=False), titles, planned)
    return out.select("path", "line", "target", F.col("titled").isNotNull().alias("has_title"), "planned", "rule")


@query("jn6_provenance", f"""WITH {NAMES_SQL}, refs AS (SELECT 'order-' || l_orderkey AS path, CASE l_partkey % 3 WHEN 0 THEN 'part-' || l_partkey WHEN 1 THEN 's' || l_partkey ELSE 'x' || l_partkey END AS value FROM edges)
    SELECT path, value FROM refs WHERE lower(value) NOT IN (SELECT key FROM names) AND value NOT IN (SELECT 's' || p_partkey FROM part WHERE p_size > 10)""")
def jn6_provenance(read):
    k = F.col("l_partkey").cast("string")
    value = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("part-"), k)).when(F.col("l_partkey") % 3 == 1, F.concat(F.lit("s"), k)).otherwise(F.concat(F.lit("x"), k))
    refs = edges(read).select(F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("path"), value.alias("value")).withColumn("key", F.lower("value"))
    notes = read("part").where("p_size > 10").select(F.col("p_partkey").cast("string").alias("path"), F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("slug"), F.col("p_partkey").alias("ord"))
    return R.provenance(refs, names(read), R.by_slug(notes)).select("path", "value")


@query("jn7_backlinks", f"WITH {NAMES_SQL} SELECT DISTINCT paths[1] AS target, path AS source FROM resolved WHERE resolution = 'unique'")
def jn7_backlinks(read):
    return R.backlinks(R.resolve(links(read), names(read), whole=False))


@query("jn8_declared_references", f"""WITH {NAMES_SQL} SELECT path, key, resolution, ord FROM (SELECT path, key, line AS ord, resolution, row_number() OVER (PARTITION BY path, key ORDER BY line) AS rn FROM resolved) WHERE rn = 1""")
def jn8_declared(read):
    refs = links(read).select("path", F.col("line").alias("ord"), F.col("target").alias("value"), "key")
    return R.declared(refs, names(read), whole=False).select("path", "key", "resolution", "ord")


FRAGMENT_SQL = """WITH anchors AS (SELECT DISTINCT conv_id, turn FROM conversations), asked AS (SELECT conv_id, turn + 1 AS turn FROM conversations),
    embeds AS (SELECT DISTINCT conv_id, conv_id + 1 AS other FROM conversations WHERE conv_id % 2 = 0), have AS (SELECT * FROM anchors UNION SELECT e.conv_id, a.turn FROM embeds e JOIN anchors a ON a.conv_id = e.other)
    SELECT 'c' || conv_id AS target_path, 'section' AS kind, 's' || turn AS id FROM asked WHERE (conv_id, turn) NOT IN (SELECT conv_id, turn FROM have)"""


@query("jn9_missing_fragments", FRAGMENT_SQL)
def jn9_fragments(read):
    turns = read("conversations")
    name = lambda k: F.concat(F.lit("c"), (F.col("conv_id") + k).cast("string"))
    ident = lambda k: F.concat(F.lit("s"), (F.col("turn") + k).cast("string")).alias("id")
    anchors = turns.select(name(0).alias("path"), F.lit("section").alias("kind"), ident(0))
    asked = turns.select(name(0).alias("target_path"), F.lit("section").alias("kind"), ident(1))
    embeds = turns.where("conv_id % 2 = 0").select(name(0).alias("path"), name(1).alias("target")).distinct()
    return R.missing_fragments(asked, anchors, embeds)


HREFS_SQL = """hrefs AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)"""


def hrefs(read):
    return read("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


@query("jn10_missing_paths", f"WITH {HREFS_SQL}, known AS (SELECT DISTINCT href FROM hrefs WHERE page_id % 5 = 0) SELECT page_id, href AS file FROM hrefs WHERE href NOT IN (SELECT href FROM known) AND href <> ''")
def jn10_missing_paths(read):
    files = hrefs(read).where("page_id % 5 = 0").select(F.col("href").alias("path"))
    return R.missing_files(hrefs(read).select("page_id", F.col("href").alias("file")), files)


# courses: customers' orders as study paths of their nation, the parts of their lines as units, suppliers' parts as what a nation teaches
COURSE_SQL = """courses AS (SELECT c_custkey AS path, CASE WHEN c_custkey % 10 <> 0 THEN c_nationkey END AS domain FROM customer), lists AS (SELECT DISTINCT o_custkey AS course, l_partkey AS path FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    lessons AS (SELECT DISTINCT l_partkey AS path, s_nationkey AS domain, l_partkey % 9 = 0 AS draft FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)"""


@query("jn12_r15_course_unlisted", f"""WITH {COURSE_SQL}, listed AS (SELECT DISTINCT domain, lists.path FROM lists JOIN courses ON course = courses.path WHERE domain IS NOT NULL), first AS (SELECT domain, min(path) AS course FROM courses WHERE domain IS NOT NULL GROUP BY 1)
    SELECT l.domain, l.path, course FROM lessons l JOIN first USING (domain) WHERE NOT draft AND NOT EXISTS (SELECT 1 FROM listed x WHERE x.domain = l.domain AND x.path = l.path)""")
def jn12_unlisted(read):
    customer = read("customer").select(F.col("c_custkey").alias("path"), F.when(F.col("c_custkey") % 10 != 0, F.col("c_nationkey")).alias("domain"), F.col("c_custkey").alias("ord"))
    lines = read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    lists = lines.join(read("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("course")), "l_orderkey").select("course", F.col("l_partkey").alias("path")).distinct()
    lessons = lines.join(read("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("domain")), "l_suppkey").select(F.col("l_partkey").alias("path"), "domain", (F.col("l_partkey") % 9 == 0).alias("draft")).distinct()
    return courses.disk_unlisted(customer, lessons, lists).join(customer.select(F.col("path").alias("course"), "domain"), "course").select("domain", "path", "course")


@query("r14_course_mismatch", f"WITH {NAMES_SQL} SELECT path, line, target, CASE WHEN line % 2 = 0 THEN 0 ELSE 1 END AS severity FROM resolved WHERE resolution = 'unresolved' OR (resolution = 'ambiguous' AND NOT located)")
def r14_mismatch(read):
    found = R.resolve(links(read), names(read), whole=False).select("path", "line", "target", "resolution", F.coalesce("located", F.lit(False)).alias("claimed"), (F.col("line") % 2 == 0).alias("under_gap"))
    return courses.disk_mismatch(found)


# bodies: each conversation a study path, whose user turns are headings and whose other turns are rows that list the turn
BODY_SQL = """t AS (SELECT DISTINCT conv_id, turn, role FROM conversations), r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS line FROM t),
    h AS (SELECT *, max(CASE WHEN role = 'user' THEN line END) OVER (PARTITION BY conv_id ORDER BY line) AS heading FROM r),
    k AS (SELECT *, turn % 4 AS kind FROM h WHERE role <> 'user')"""


def course_rows(read):
    line = F.when(F.col("role") == "user", F.concat(F.lit("## Turn "), "turn", F.when(F.col("turn") % 3 == 0, F.lit(" {sequence=primary}")).otherwise(F.lit(""))))
    row = F.when(F.col("turn") % 4 == 0, F.lit("- [[a]] and [[b]]")).when(F.col("turn") % 4 == 1, F.concat(F.lit("- [[turn "), "turn", F.lit("]]"))).when(F.col("turn") % 4 == 2, F.lit("- see [[c]]")).otherwise(F.lit("- words"))
    turns = read("conversations").select("conv_id", "turn", "role").distinct().select("conv_id", F.struct("turn", "role", F.coalesce(line, row).alias("text")).alias("x"))
    bodies = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["text"]), "\n").alias("body"))
    return courses.placed(courses.rows(bodies.select(F.col("conv_id").cast("string").alias("path"), "body", F.lit(1).alias("first"))))


@query("p21_r16_r27_course_rules", f"""WITH {BODY_SQL} SELECT conv_id::VARCHAR AS path, line::INTEGER AS line, CASE WHEN heading IS NULL THEN 'course.entry_outside_branch' WHEN kind = 0 THEN 'course.entry_multi_target' ELSE 'course.entry_noncanonical' END AS rule_id
        FROM k WHERE (heading IS NULL AND kind < 3) OR kind IN (0, 2)
    UNION ALL SELECT r.conv_id::VARCHAR, r.line::INTEGER, 'course.role_missing' FROM r WHERE role = 'user' AND turn % 3 <> 0 AND EXISTS (SELECT 1 FROM k WHERE k.conv_id = r.conv_id AND k.heading = r.line AND kind < 3)""")
def course_rules(read):
    return courses.diagnostics(course_rows(read)).select("path", "line", "rule_id")


@query("n2_w3_course_entries", f"""WITH {BODY_SQL} SELECT conv_id::VARCHAR AS path, line::INTEGER AS line, heading::INTEGER AS branch, CASE kind WHEN 0 THEN 'multi_target' WHEN 1 THEN 'accepted' ELSE 'noncanonical' END AS state,
    CASE kind WHEN 1 THEN 'turn ' || turn WHEN 2 THEN 'c' END AS target, row_number() OVER (PARTITION BY conv_id, heading ORDER BY line)::INTEGER AS number FROM k WHERE heading IS NOT NULL AND kind < 3""")
def course_entries(read):
    return courses.entries(course_rows(read)).select("path", "line", "branch", "state", "target", "number")


@query("jn13_course_entries", f"""WITH {NAMES_SQL} SELECT path, line, target, CASE WHEN resolution <> 'unique' THEN resolution WHEN paths[1] LIKE 'Brand#1/%' THEN 'non-instance' ELSE 'resolved' END AS state FROM resolved""")
def jn13_entries(read):
    from quire.operators.findings import below
    from quire.operators.nav import entry_state

    found = R.resolve(links(read), names(read), whole=False)
    own = F.coalesce(F.col("paths")[0], F.lit(""))
    return found.select("path", "line", "target", entry_state(F.col("resolution"), below(own, ["Brand#1"]), own).alias("state"))


@query("jn14_embed_reach", """WITH RECURSIVE embeds AS (SELECT n_nationkey AS path, n_regionkey + 20 AS target FROM nation UNION ALL SELECT n_nationkey, (n_nationkey * 7 + 3) % 25 FROM nation),
    r AS (SELECT n_nationkey AS path, n_nationkey AS reached FROM nation WHERE n_nationkey < 10 UNION SELECT r.path, e.target FROM r JOIN embeds e ON e.path = r.reached) SELECT path, reached FROM r""")
def jn14_reach(read):
    nation = read("nation")
    embeds = nation.select(F.col("n_nationkey").alias("path"), (F.col("n_regionkey") + 20).alias("target")).union(nation.select("n_nationkey", (F.col("n_nationkey") * 7 + 3) % 25))
    return R.reach(embeds, nation.where("n_nationkey < 10").select(F.col("n_nationkey").alias("path")))


@query("jn18_expanded_edges", f"WITH {NAMES_SQL} SELECT DISTINCT path, unnest(paths) AS target FROM resolved WHERE paths IS NOT NULL")
def jn18_expanded(read):
    return R.expanded(links(read), names(read))


@query("a1_collisions", f"WITH {NAMES_SQL} SELECT key, array_to_string(paths, ',') AS members FROM holders WHERE len(paths) > 1")
def a1_collisions(read):
    return R.collisions(names(read)).select("key", F.array_join("members", ",").alias("members"))


@query("a2_a3_cited_collisions", f"WITH {NAMES_SQL} SELECT key, len(paths)::INTEGER AS n FROM holders WHERE len(paths) > 1 AND key IN (SELECT key FROM links)")
def a3_cited(read):
    return R.collisions(names(read), links(read)).select("key", F.size("members").alias("n"))


@query("a4_alias_collisions", "SELECT lower(trim(p_name)) AS key, count(DISTINCT p_partkey)::INTEGER AS n FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1")
def a4_alias(read):
    return R.alias_collisions(names(read)).select("key", F.size("members").alias("n"))


@query("a19_islands", f"""WITH edges AS ({EDGES_SQL}), notes AS ({PARTS_SQL}) SELECT domain AS folder, count(*) AS n, string_agg(path, ',' ORDER BY path) AS notes FROM notes WHERE p_partkey NOT IN (SELECT l_partkey FROM edges WHERE from_map) GROUP BY 1""")
def a19_islands(read):
    notes = part_notes(read)
    cited = edges(read).where("from_map").select(F.col("l_partkey").alias("p_partkey")).distinct().join(notes.select("p_partkey", F.col("path").alias("target")), "p_partkey")
    return H.islands(notes.select("path"), cited, T.folder(F.col("path"))).select("folder", "n", F.array_join("notes", ",").alias("notes"))


@query("a20_unmapped_concepts", f"WITH edges AS ({EDGES_SQL}), notes AS ({PARTS_SQL}) SELECT path FROM notes WHERE p_partkey NOT IN (SELECT l_partkey FROM edges WHERE from_map)")
def a20_unmapped(read):
    concepts = part_notes(read)
    cited = edges(read).select(F.col("l_partkey").alias("p_partkey"), "from_map").join(concepts.select("p_partkey", F.col("path").alias("target")), "p_partkey")
    return C.classified(concepts.select("path", "domain"), cited).where("state <> 'mounted'").select("path")


@query("n13_sources", f"""WITH edges AS ({EDGES_SQL}) SELECT l_orderkey AS path, l_partkey AS source, bool_or(l_linenumber = 1) AS whole, count(DISTINCT l_linenumber) AS places FROM edges GROUP BY 1, 2""")
def n13_sources(read):
    return edges(read).groupBy(F.col("l_orderkey").alias("path"), F.col("l_partkey").alias("source")).agg(F.bool_or(F.col("l_linenumber") == 1).alias("whole"), F.count_distinct("l_linenumber").alias("places"))
