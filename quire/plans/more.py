"""Lists, maps, journals, drills, first sentences and narrowing (A13, A26, F9, JN15, N3, N5, N6, N10, N11, O6, O15, O16, P19, P22, Q5, Q6, R39, X21)."""

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import drills as D
from quire.operators import findings as Q
from quire.operators import nav as N
from quire.operators import resolve as R
from quire.operators import search as S
from quire.plans.search import docs
from quire.plans.tables import DOCS_SQL, FINDINGS_SQL, PARTS_SQL, doc_notes, findings, part_notes, query

DOCS = f"d AS ({DOCS_SQL})"


@query("a13_places", f"WITH {DOCS}, h AS (SELECT source, domain FROM d WHERE contains(lower(text), 'the')), c AS (SELECT (SELECT count(*) FROM h) AS hits, (SELECT count(DISTINCT source) FROM h) AS tops) SELECT source AS place, count(*) AS n FROM h, c WHERE hits > 10 AND tops > 1 GROUP BY 1 UNION ALL SELECT 'src1/' || domain, count(*) FROM h, c WHERE source = 'src1' AND (SELECT count(*) FROM h WHERE source = 'src1') > 10 GROUP BY 1")
def a13_places(read):
    found = docs(read).where(F.col("plain_fold").contains("the"))
    return S.places(found).unionByName(S.places(found.where(F.col("path").startswith("src1/"))))


@query("a26_summary", f"WITH f AS ({FINDINGS_SQL}) SELECT rule_id, severity, count(*) AS n, count(DISTINCT path) AS notes FROM f GROUP BY ALL")
def a26_summary(read):
    return Q.summary(findings(read))


# collections: the brands, with a type for each kind and size of their parts; a role for some
TYPES_SQL = "SELECT DISTINCT p_brand AS collection, p_type || ' ' || p_size AS type, CASE WHEN p_type = 'SMALL' AND p_size > 46 THEN 'lesson' WHEN p_type = 'PROMO' AND p_size < 3 THEN 'thought' WHEN p_type = 'LARGE' AND p_size = 2 THEN 'chapter' WHEN p_size = 7 THEN 'map' ELSE '' END AS role FROM part"


@query("r39_navigation_unavailable", f"""WITH t AS ({TYPES_SQL}), h AS (SELECT collection, role, count(DISTINCT type) AS n FROM t WHERE role <> '' GROUP BY ALL)
    SELECT collection, count(*) AS n_roles, 'schema.navigation_unavailable' AS rule_id, 2 AS severity FROM h WHERE role NOT IN ('lesson', 'course', 'map', 'thought') OR (role IN ('lesson', 'thought') AND n > 1) GROUP BY 1""")
def r39_navigation(read):
    kind, size = F.col("p_type"), F.col("p_size")
    role = F.when((kind == "SMALL") & (size > 46), "lesson").when((kind == "PROMO") & (size < 3), "thought").when((kind == "LARGE") & (size == 2), "chapter").when(size == 7, "map").otherwise("")
    return Q.navigation_unavailable(read("part").select(F.col("p_brand").alias("collection"), F.concat_ws(" ", kind, size.cast("string")).alias("type"), role.alias("role")).distinct())


@query("f9_draft_words", "SELECT l_orderkey, l_linenumber, l_returnflag = 'N' AS not_boolean FROM lineitem WHERE l_returnflag IN ('N', 'R')")
def f9_drafts(read):
    kind = F.when(F.col("l_returnflag") == "N", "text").when(F.col("l_returnflag") == "R", "bool")
    rows = read("lineitem").select("l_orderkey", "l_linenumber", F.map_filter(F.create_map(F.lit("draft"), kind), lambda k, v: v.isNotNull()).alias("kinds"))
    return rows.where(F.col("kinds")["draft"].isNotNull()).select("l_orderkey", "l_linenumber", Q.not_boolean(F.col("kinds")["draft"]).alias("not_boolean"))


@query("f9_value_kinds", """SELECT l_orderkey, l_linenumber, l_linestatus = 'O' AND l_returnflag <> 'R' AS not_boolean, l_linestatus = 'O' AND l_returnflag <> 'N' AS not_text FROM lineitem""")
def f9_kinds(read):
    """Flags of the lines as values of a field: text, a boolean, a number; none where the line is no longer open."""
    kind = F.create_map(F.lit("draft"), F.when(F.col("l_returnflag") == "N", "text").when(F.col("l_returnflag") == "R", "bool").otherwise("int"))
    kinds = F.when(F.col("l_linestatus") == "O", kind).otherwise(F.create_map(F.lit("draft"), F.lit("null")))
    own = read("lineitem").select("l_orderkey", "l_linenumber", kinds["draft"].alias("kind"))
    return own.select("l_orderkey", "l_linenumber", Q.not_boolean(F.col("kind")).alias("not_boolean"), Q.not_text(F.col("kind")).alias("not_text"))


@query("q5_answering_alias", f"WITH notes AS ({PARTS_SQL}) SELECT path, CASE WHEN contains(lower(alias), 'ed') AND contains(lower(alias), 'in') THEN alias WHEN contains(lower(alias2), 'ed') AND contains(lower(alias2), 'in') THEN alias2 END AS alias FROM notes")
def q5_alias(read):
    return part_notes(read).select("path", S.answering_alias(F.col("aliases"), ["ed", "in"]).alias("alias"))


@query("q6_metadata_authority", f"WITH {DOCS} SELECT 'metadata' AS asked, doc_id FROM d WHERE domain = 'en' AND source <> 'src2' AND contains(lower(text), 'the') UNION ALL SELECT 'text', doc_id FROM d WHERE contains(lower(text), 'the')")
def q6_authority(read):
    notes = docs(read).withColumn("instance", ~F.col("path").startswith("src2/"))
    out = [S.answer(notes, S.parse(q), True).select(F.lit(k).alias("asked"), "doc_id") for k, q in (("metadata", "the domain:en"), ("text", "the"), ("refused", "the domain:de"))[:2]]
    refused = S.answer(notes, S.parse("the domain:de"), False).select(F.lit("refused").alias("asked"), "doc_id")
    text = docs(read).where(S.contains_all(F.col("plain_fold"), ["the"])).select("doc_id")
    return out[0].unionByName(out[1]).join(text, "doc_id", "left_semi").unionByName(refused)


@query("o6_second_page", f"WITH {DOCS} SELECT doc_id FROM d WHERE domain = 'en' ORDER BY path LIMIT 20 OFFSET 20")
def o6_page(read):
    return S.page(docs(read).where("domain = 'en'").withColumns({"bucket": F.lit(0), "exact": F.lit(False)}), 2).select("doc_id")


@query("o15_author_order", """SELECT folder, path, row_number() OVER (PARTITION BY folder ORDER BY number IS NULL, number, path) AS place FROM (SELECT p_brand AS folder, p_brand || '/' || CASE WHEN p_partkey % 3 = 0 THEN 'part' ELSE '0' || p_size END || '-' || p_partkey || '.md' AS path,
    CASE WHEN p_partkey % 3 <> 0 THEN p_size END AS number FROM part)""")
def o15_order(read):
    name = F.concat("p_brand", F.lit("/"), F.when(F.col("p_partkey") % 3 == 0, "part").otherwise(F.concat(F.lit("0"), F.col("p_size").cast("string"))), F.lit("-"), F.col("p_partkey").cast("string"), F.lit(".md"))
    return N.author_order(read("part").select(F.col("p_brand").alias("folder"), name.alias("path"))).select("folder", "path", F.col("place").cast("bigint").alias("place"))


@query("o16_folder_panel", f"WITH {DOCS}, f AS (SELECT source AS folder FROM d UNION ALL SELECT source || '/' || domain FROM d) SELECT folder, count(*) AS n FROM f WHERE contains(regexp_extract(folder, '[^/]*$'), 's') GROUP BY 1 ORDER BY len(string_split(folder, '/')), folder LIMIT 4")
def o16_panel(read):
    return S.folder_panel(docs(read).select("path"), ["s"], 4)


# the first end of a sentence: a full-width stop with what closes after it, or other stops with closers before white space or the line's end
STOP = r"[。！？．][」』）)”’\"']*|[.!?](?:[ \t]|$)"


@query("p19_first_sentences", r"""SELECT doc_id, CASE WHEN first = '' THEN '' WHEN regexp_matches(first, '@') THEN rtrim(regexp_extract(first, '^(?s:.*?)(?:@)')) WHEN length(first) > 120 THEN rtrim(substr(first, 1, 120)) || '…' ELSE first END AS sentence
    FROM (SELECT doc_id, trim(split_part(text, chr(10), 1)) AS first FROM documents)""".replace("@", STOP.replace("'", "''")))
def p19_sentences(read):
    return read("documents").select("doc_id", T.first_sentence(F.trim(F.split_part("text", F.lit("\n"), F.lit(1))), 120).alias("sentence"))


# maps: the orders of a customer as headings of three levels, their lines as links
MAP_SQL = """h AS (SELECT o_custkey AS path, o_orderkey * 10 AS line, (2 + o_orderkey % 3)::INTEGER AS level, 'o' || o_orderkey AS heading FROM orders), l AS (SELECT o_custkey AS path, l_orderkey * 10 + l_linenumber AS line, l_partkey AS target FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


def map_rows(read):
    orders = read("orders").select("o_custkey", "o_orderkey")
    headings = orders.select(F.col("o_custkey").alias("path"), (F.col("o_orderkey") * 10).alias("line"), (F.col("o_orderkey") % 3 + 2).cast("int").alias("level"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("heading"))
    lines = R.meet(read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), orders.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey")
    links = lines.select(F.col("o_custkey").alias("path"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), F.col("l_partkey").alias("target"))
    return headings, R.dealt(links, "path", "line", "target").distinct()


@query("p22_map_branches", f"""WITH {MAP_SQL}, s AS (SELECT path, line, level, heading, (SELECT min(b.line) FROM h b WHERE b.path = a.path AND b.line > a.line AND b.level <= a.level) AS stop, (SELECT min(b.line) FROM h b WHERE b.path = a.path AND b.line > a.line) AS following FROM h a),
    k AS (SELECT DISTINCT path, line, target FROM l) SELECT s.path, s.heading, count(k.target) AS below, count(k.target) FILTER (following IS NULL OR k.line < following) AS own FROM s LEFT JOIN k ON k.path = s.path AND k.line > s.line AND (stop IS NULL OR k.line < stop) GROUP BY s.path, s.heading, s.line""")
def p22_map_branches(read):
    """Every branch with its links; those with none below are the empty ones, which are pruned from the tree and listed."""
    return N.map_branches(*map_rows(read)).select("path", "heading", "below", "own")


@query("n3_placements", f"""WITH {MAP_SQL}, k AS (SELECT DISTINCT path, line, target FROM l), p AS (SELECT k.path AS map, k.target, k.line, (SELECT max(line) FROM h WHERE h.path = k.path AND h.line < k.line) AS above FROM k)
    SELECT target AS path, count(*) AS placements, count(DISTINCT map) AS maps, min(map) AS first_map FROM p WHERE above IS NOT NULL GROUP BY 1""")
def n3_placements(read):
    placed = N.placements(*map_rows(read))
    return R.dealt(placed, "target").groupBy(F.col("target").alias("path")).agg(F.count("*").alias("placements"), F.count_distinct("path").alias("maps"), F.min("path").alias("first_map"))


@query("n5_journal", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, row_number() OVER (ORDER BY CAST(o_orderdate AS DATE) DESC, 'Journal/' || strftime(o_orderdate, '%Y-%m-%d') || ' ' || o_orderkey || '.md' DESC) AS place FROM orders WHERE o_orderpriority = '1-URGENT'")
def n5_journal(read):
    folder = F.when(F.col("o_orderpriority") == "1-URGENT", "Journal").otherwise("Ideas")
    notes = read("orders").select("o_orderkey", F.concat(folder, F.lit("/"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" "), F.col("o_orderkey").cast("string"), F.lit(".md")).alias("path"))
    ranked = N.pages(N.journal(notes, "journal").select("o_orderkey", "day", "path"), [F.desc("day"), F.desc("path")])
    return ranked.select("o_orderkey", F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("position").cast("bigint").alias("place"))


@query("n6_siblings", f"WITH {DOCS} SELECT source || '/' || domain AS folder, count(*) AS n, sha256(string_agg(path, ',' ORDER BY path)) AS notes FROM d GROUP BY 1")
def n6_siblings(read):
    return N.directories(doc_notes(read)).select("folder", "n", F.sha2(F.array_join("notes", ","), 256).alias("notes"))


# drills: the parts of a supplier's nation as patterns
DRILL_SQL = """p AS (SELECT p_brand || '/' || (p_partkey % 40) AS source, CASE WHEN p_partkey % 40 = 7 THEN '' ELSE 's' || (p_partkey % 40 % 30) END AS slug, p_partkey AS id, p_size % 4 AS kind FROM part)"""


def patterns(read):
    k, slot = F.col("p_partkey") % 40, lambda color, *fills: F.struct(F.lit(color).alias("color"), F.array(*map(F.lit, fills)).cast("array<string>").alias("fills"))
    kind = F.col("p_size") % 4
    slots = F.when(kind == 0, F.create_map(F.lit("a"), slot("red", "x"))).when(kind == 1, F.create_map(F.lit("a"), slot("mauve", "x"), F.lit("b"), slot(""))).otherwise(F.create_map(F.lit("a"), slot("", "y")))
    template = F.when(kind == 2, "say {a} and {c} and {c}").otherwise("say {a}")
    gloss = F.when(kind == 3, "{a} or {z}").otherwise("{a}")
    return read("part").select(
        F.concat("p_brand", F.lit("/"), k.cast("string")).alias("source"), F.when(k == 7, "").otherwise(F.concat(F.lit("s"), (k % 30).cast("string"))).alias("slug"), F.col("p_partkey").cast("string").alias("id"), template.alias("template"), gloss.alias("gloss"), slots.alias("slots")
    )


FAULTS_SQL = f"""{DRILL_SQL}, f AS (SELECT source, id::VARCHAR AS id, unnest(CASE kind WHEN 1 THEN ['unknown color', 'no fills'] WHEN 2 THEN ['no slot'] WHEN 3 THEN ['gloss key not in template'] ELSE [] END) AS problem, unnest(CASE kind WHEN 1 THEN ['a', 'b'] WHEN 2 THEN ['c'] WHEN 3 THEN ['z'] ELSE [] END) AS key FROM p WHERE slug <> ''),
    sound AS (SELECT DISTINCT source, slug FROM p WHERE slug <> '' AND source NOT IN (SELECT source FROM f)), again AS (SELECT source, slug FROM sound QUALIFY row_number() OVER (PARTITION BY slug ORDER BY source) > 1),
    every AS (SELECT * FROM f UNION ALL SELECT DISTINCT source, NULL, 'no slug', NULL FROM p WHERE slug = '' UNION ALL SELECT source, NULL, 'slug declared before', slug FROM again)"""


@query("n11_drill_problems", f"WITH {FAULTS_SQL} SELECT source, id, problem, key FROM every")
def n11_problems(read):
    return D.problems(patterns(read), ["red", "blue"])


@query("jn15_lesson_drills", f"WITH {FAULTS_SQL} SELECT c_custkey AS path, p.source, p.id::VARCHAR AS id FROM p JOIN customer ON 's' || (c_custkey % 25) = slug WHERE slug <> '' AND p.source NOT IN (SELECT source FROM every)")
def jn15_drills(read):
    lessons = read("customer").select(F.col("c_custkey").alias("path"), F.concat(F.lit("s"), (F.col("c_custkey") % 25).cast("string")).alias("slug"))
    own = patterns(read)
    return D.by_lesson(own, lessons, D.problems(own, ["red", "blue"])).select("path", "source", "id")


@query("x21_pattern_json", """SELECT p_partkey::VARCHAR AS id, '{"id":"' || p_partkey || '","template":"say {a}","gloss":"{a}","slots":{"a":{"color":"red","fills":["x"]}}}' AS line FROM part WHERE p_size % 4 = 0""")
def x21_json(read):
    own = patterns(read).where(F.map_contains_key("slots", "a") & (F.col("slots")["a"]["color"] == "red"))
    return own.select("id", D.pattern_json(own).alias("line"))


@query("n10_concept_sheets", "SELECT p_partkey, 'path-' || rtrim(translate(base64(encode('Concepts/' || p_brand || '/' || p_partkey || '.md')), '+/', '-_'), '=') AS id FROM part WHERE p_partkey % 3 = 0")
def n10_sheets(read):
    k = F.col("p_partkey").cast("string")
    path = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Concepts/"), "p_brand", F.lit("/"), k, F.lit(".md"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("Concepts/"), k, F.lit(".md"))).otherwise(F.concat(F.lit("Ideas/"), "p_brand", F.lit("/"), k, F.lit(".md")))
    return D.sheets(read("part").select("p_partkey", path.alias("path"))).select("p_partkey", "id")
