"""Navigation, lists, calendars and shapes."""

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import nav as N
from quire.plans.tables import DOCS_SQL, doc_notes, query

DOCS = f"d AS ({DOCS_SQL})"
TURNS = "(SELECT DISTINCT conv_id, turn, role FROM conversations)"


def turns(read):
    return read("conversations").select("conv_id", "turn", "role").distinct()


@query("w1_neighbours", f"SELECT conv_id, turn, lag(turn) OVER w AS previous, lead(turn) OVER w AS next FROM (SELECT DISTINCT conv_id, turn FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def w1_neighbours(read):
    return N.neighbours(turns(read).select("conv_id", "turn").distinct(), ["conv_id"], ["turn"], "turn")


@query("w2_folder_neighbours", f"WITH {DOCS} SELECT doc_id, lag(doc_id) OVER w AS previous, lead(doc_id) OVER w AS next FROM d WINDOW w AS (PARTITION BY source, domain ORDER BY path)")
def w2_folder(read):
    notes = doc_notes(read).select("doc_id", "path", T.folder(F.col("path")).alias("folder"))
    return N.neighbours(notes, ["folder"], ["path"], "doc_id").select("doc_id", "previous", "next")


@query("w3_numbered", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS number FROM orders")
def w3_numbered(read):
    return N.numbered(read("orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", F.col("number").cast("bigint").alias("number"))


@query("w4_place", "SELECT o_custkey, o_orderkey, row_number() OVER w AS number, count(*) OVER (PARTITION BY o_custkey) AS size, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS first, max(o_orderkey) OVER (PARTITION BY o_custkey) AS last FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def w4_place(read):
    return N.placed(read("orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], "o_orderkey").withColumn("number", F.col("number").cast("bigint"))


MONTHS = "m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1)"


def order_days(read):
    return read("orders").select(F.to_date("o_orderdate").alias("day"), "o_custkey", "o_orderkey")


@query("a22_months", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
def a22_months(read):
    return N.months(order_days(read))


@query("w5_nearest_months", f"WITH {MONTHS} SELECT month, n, lag(month) OVER (ORDER BY month) AS before, lead(month) OVER (ORDER BY month) AS after FROM m")
def w5_nearest(read):
    return N.nearest_months(N.months(order_days(read)))


@query("w8_calendar", """SELECT strftime(day, '%Y-%m-%d') AS day, (isodow(day) - 1)::INTEGER AS weekday, ((day(day) - 1 + isodow(DATE '1998-03-01') - 1) // 7)::INTEGER AS week, (SELECT count(*) FROM orders WHERE CAST(o_orderdate AS DATE) = day) AS n
    FROM range(DATE '1998-03-01', DATE '1998-04-01', INTERVAL 1 DAY) t(day)""")
def w8_calendar(read):
    return N.calendar(order_days(read), "1998-03").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("w6_pages", "SELECT ceil(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) / 25)::BIGINT AS page, o_orderkey FROM orders")
def w6_pages(read):
    return N.pages(read("orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"]).select(F.col("page").cast("bigint").alias("page"), "o_orderkey")


@query("w7_month_headings", "WITH r AS (SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, count(*) OVER (PARTITION BY o_custkey) AS size, lag(strftime(o_orderdate, '%Y-%m')) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey) AS above FROM orders) SELECT o_orderkey, CASE WHEN size > 8 AND coalesce(above <> month, true) THEN month END AS heading FROM r")
def w7_headings(read):
    rows = order_days(read).select(F.col("o_custkey").alias("folder"), "day", F.col("o_orderkey").alias("path"))
    return N.month_headings(rows, 8).select(F.col("path").alias("o_orderkey"), "heading")


@query("a15_folder_counts", f"WITH {DOCS}, f AS (SELECT '' AS folder, n_chars FROM d UNION ALL SELECT source, n_chars FROM d UNION ALL SELECT source || '/' || domain, n_chars FROM d) SELECT folder, count(*) AS n, max(n_chars) AS latest FROM f GROUP BY 1")
def a15_folders(read):
    return N.folder_counts(doc_notes(read).withColumn("mtime", F.col("n_chars")))


@query("a15_region_rollup", "SELECT r_name, n_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY ROLLUP (r_name, n_name)")
def a15_rollup(read):
    both = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.rollup("r_name", "n_name").agg(F.count("*").alias("n"))


@query("n1_tree", f"WITH {DOCS}, f AS (SELECT DISTINCT '' AS folder FROM d UNION SELECT source FROM d UNION SELECT source || '/' || domain FROM d) SELECT folder, CASE WHEN folder = '' THEN NULL WHEN contains(folder, '/') THEN split_part(folder, '/', 1) ELSE '' END AS parent, CASE WHEN folder = '' THEN 0 WHEN contains(folder, '/') THEN 2 ELSE 1 END AS depth, (SELECT count(*) FROM d WHERE source || '/' || domain = folder) AS own FROM f")
def n1_tree(read):
    return N.tree(doc_notes(read))


@query("a21_shared_titles", "SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_name) = 1 THEN NULL WHEN count(*) OVER (PARTITION BY p_name, p_size) = 1 THEN strftime(DATE '2024-01-01' + p_size, '%Y-%m-%d') ELSE 'part-' || p_partkey || '.md' END AS qualifier FROM part")
def a21_titles(read):
    notes = read("part").select("p_partkey", F.col("p_name").alias("title"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")).alias("day"), F.concat(F.lit("x/part-"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("path"))
    return N.shared_titles(notes).select("p_partkey", "qualifier")


@query("a23_prefix_groups", "WITH t AS (SELECT p_partkey, p_type AS prefix, count(*) OVER (PARTITION BY p_type) AS n FROM part) SELECT p_partkey, CASE WHEN n >= 3 THEN prefix END AS prefix FROM t")
def a23_prefix(read):
    titles = read("part").select("p_partkey", F.concat_ws(": ", "p_type", "p_name").alias("title"))
    return N.prefix_groups(titles).select("p_partkey", "prefix")


@query("a24_list_shape", "SELECT o_custkey AS folder, count(DISTINCT CAST(o_orderdate AS DATE)) >= 3 AS dated, avg(CASE WHEN regexp_matches(o_orderpriority, '^[0-9]') THEN 1.0 ELSE 0 END) > 0.5 AS numbered FROM orders GROUP BY 1")
def a24_shape(read):
    return N.list_shape(read("orders").select(F.col("o_custkey").alias("folder"), F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("title")))


@query("w9_sections", "WITH h AS (SELECT l_orderkey AS path, l_linenumber AS line, 1 + (l_suppkey % 3)::INTEGER AS level FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1) SELECT path, line, level, (SELECT min(b.line) FROM h b WHERE b.path = a.path AND b.line > a.line AND b.level <= a.level) AS stop FROM h a")
def w9_sections(read):
    first = read("lineitem").groupBy(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("line")).agg(F.min(F.struct("l_partkey", "l_suppkey")).alias("f"))
    return N.sections(first.select("path", "line", (F.col("f.l_suppkey") % 3 + 1).cast("int").alias("level")))


@query("p22_w12_heading_above", "WITH r AS (SELECT conv_id AS path, turn AS offset, CASE WHEN role = 'user' THEN 'h' || turn END AS heading FROM (SELECT DISTINCT conv_id, turn, role FROM conversations)) SELECT path, \"offset\", last_value(heading IGNORE NULLS) OVER (PARTITION BY path ORDER BY \"offset\") AS branch FROM r")
def p22_branches(read):
    rows = turns(read).select(F.col("conv_id").alias("path"), F.col("turn").alias("offset"), F.when(F.col("role") == "user", F.concat(F.lit("h"), F.col("turn").cast("string"))).alias("heading"))
    return N.heading_above(rows).select("path", "offset", "branch")


@query("n4_teaching_path", "WITH c AS (SELECT p_brand AS domain, p_partkey AS path FROM part WHERE p_partkey % 60 = 0), u AS (SELECT domain, min(path) AS own, count(*) AS n FROM c GROUP BY 1) SELECT p_partkey AS path, CASE WHEN n = 1 THEN own END AS course FROM part LEFT JOIN u ON u.domain = p_brand")
def n4_teaching(read):
    part = read("part").select(F.col("p_partkey").alias("path"), F.col("p_brand").alias("domain"))
    return N.teaching_path(part.where("path % 60 = 0"), part)


@query("a16_course_counts", "SELECT o_custkey AS course, count(*) AS items, count(*) FILTER (o_orderstatus = 'P') AS planned, count(DISTINCT o_orderpriority) AS branches, count(*) FILTER (o_totalprice < 50000) AS drafts FROM orders GROUP BY 1")
def a16_counts(read):
    items = read("orders").select(F.col("o_custkey").alias("course"), F.col("o_orderpriority").alias("branch"), F.when(F.col("o_orderstatus") == "P", "planned").otherwise("resolved").alias("state"), (F.col("o_totalprice") < 50000).alias("draft"))
    return N.course_counts(items)


@query("o7_map_order", "SELECT p_brand AS domain, p_name AS title, p_partkey AS path FROM part ORDER BY 1, 2, 3")
def o7_order(read):
    return read("part").select(F.col("p_brand").alias("domain"), F.col("p_name").alias("title"), F.col("p_partkey").alias("path")).orderBy("domain", "title", "path")


@query("o8_journal_order", "SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey AS path FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def o8_journal(read):
    return order_days(read).select("day", F.col("o_orderkey").alias("path")).orderBy(F.desc_nulls_last("day"), F.desc("path")).limit(50).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("o13_lifecycle_order", "SELECT source, CASE source WHEN 'src3' THEN 1 WHEN 'src1' THEN 2 ELSE 3 END AS rank, count(*) AS n FROM documents GROUP BY ALL")
def o13_lifecycle(read):
    return read("documents").groupBy("source").agg(F.count("*").alias("n")).select("source", N.lifecycle_order(F.col("source"), ["src3", "src1"]).cast("int").alias("rank"), "n")


@query("u5_u6_union_first_wins", "WITH u AS (SELECT c_nationkey AS k, c_custkey AS id, 0 AS ord FROM customer UNION ALL SELECT s_nationkey, s_suppkey, 1 FROM supplier) SELECT k, arg_min(id, ord * 1000000 + id) AS id, count(*) AS n FROM u GROUP BY k")
def u5_union(read):
    both = read("customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("id"), F.lit(0).alias("ord")).unionByName(read("supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("id"), F.lit(1).alias("ord")))
    return both.groupBy("k").agg(F.min(F.struct("ord", "id"))["id"].alias("id"), F.count("*").alias("n"))
