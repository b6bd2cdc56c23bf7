"""Transclusion, freshness, what changes from one generation to the next, and figures."""

from pyspark.sql import Window, functions as F

from quire.operators import embeds as E
from quire.operators import figures as FG
from quire.operators import resolve as R
from quire.plans.graph import NAMES_SQL, links, names
from quire.plans.tables import query
from quire.shared import remove, written
from quire.streaming import generations as G

FRAME = "lpad(hex(octet_length(encode({0}))::BIGINT), 16, '0') || hex({0})"
EMBEDS_SQL = r"""l AS (SELECT conv_id AS path, turn, turn * 10 + row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) AS line, CASE WHEN role = 'user' THEN 1 + turn % 3 END AS level,
        CASE WHEN role <> 'user' AND turn % 4 = 3 THEN '' WHEN turn % 4 = 1 THEN '- ' || coalesce(text, '') ELSE coalesce(text, '') END AS text FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)),
    s AS (SELECT path, line, level, (SELECT min(b.line) FROM l b WHERE b.path = a.path AND b.line > a.line AND b.level <= a.level) AS stop FROM l a WHERE level IS NOT NULL),
    sections AS (SELECT path, id, matches, line AS start, stop FROM (SELECT path, level, level::VARCHAR AS id, min(line) AS line, count(*) AS matches FROM s GROUP BY 1, 2) JOIN s USING (path, level, line)),
    g AS (SELECT path, line, regexp_matches(text, '^\s*$') AS blank, regexp_matches(text, '^ {0,3}([-*+]|[0-9]{1,9}[.)])([ \t]|$)') AS item, lag(text) OVER (PARTITION BY path ORDER BY line) AS above FROM l),
    m AS (SELECT path, 'b' || (turn % 3) AS id, min(line) AS line FROM l WHERE level IS NULL GROUP BY 1, 2),
    blocks AS (SELECT path, id, 1 AS matches, (SELECT max(g.line) FROM g WHERE g.path = m.path AND g.line <= m.line AND (item OR above IS NULL OR regexp_matches(above, '^\s*$'))) AS start,
        (SELECT min(g.line) FROM g WHERE g.path = m.path AND g.line > m.line AND (item OR blank)) AS stop FROM m),
    e AS (SELECT path, line AS ord, path + turn AS source, CASE turn % 3 WHEN 0 THEN 'note' WHEN 1 THEN 'section' ELSE 'block' END AS kind, CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN '3' ELSE 'b1' END AS id FROM l WHERE level IS NOT NULL),
    known AS (SELECT path AS source, 'section' AS kind, id, matches, start, stop FROM sections UNION ALL SELECT path, 'block', id, matches, start, stop FROM blocks UNION ALL SELECT DISTINCT path, 'note', '', 1, NULL, NULL FROM l),
    cut AS (SELECT k.*, (SELECT sha256(string_agg(text, chr(10) ORDER BY line)) FROM l WHERE l.path = k.source AND (start IS NULL OR line >= start) AND (stop IS NULL OR line < stop)) AS digest,
        (SELECT count(*) FROM e WHERE e.path = k.source AND (start IS NULL OR ord >= start) AND (stop IS NULL OR ord < stop)) AS nested FROM known k),
    shown AS (SELECT e.path, ord, CASE WHEN e.source NOT IN (SELECT path FROM l) THEN 'absent-note' WHEN matches IS NULL THEN 'absent-address' ELSE '' END AS absence, e.source::VARCHAR AS source, coalesce(matches, 0) AS matches,
        coalesce(nested, 0) AS nested, coalesce(digest, '') AS digest FROM e LEFT JOIN cut USING (source, kind, id))"""


def embedded(read):
    """Conversations as notes, a turn a line, those of users as headings of three levels; each user's turn embeds a later conversation, a section or a block of it."""
    turns = read("conversations").select("conv_id", "turn", "role", "text").distinct()
    at = F.col("turn") * 10 + F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    own = F.coalesce("text", F.lit(""))
    text = F.when((F.col("role") != "user") & (F.col("turn") % 4 == 3), "").when(F.col("turn") % 4 == 1, F.concat(F.lit("- "), own)).otherwise(own)
    lines = turns.select(F.col("conv_id").alias("path"), "turn", at.alias("line"), F.when(F.col("role") == "user", (F.col("turn") % 3 + 1).cast("int")).alias("level"), text.alias("text"))
    headings = lines.where("level is not null").select("path", "line", "level", F.col("level").cast("string").alias("id"))
    marks = lines.where("level is null").select("path", "line", F.concat(F.lit("b"), (F.col("turn") % 3).cast("string")).alias("id"))
    kind = F.col("turn") % 3
    embeds = lines.where("level is not null").select("path", "line", F.col("line").alias("ord"), (F.col("path") + F.col("turn")).alias("source"), F.when(kind == 0, "note").when(kind == 1, "section").otherwise("block").alias("kind"), F.when(kind == 0, "").when(kind == 1, "3").otherwise("b1").alias("id"))
    embeds = embeds.join(lines.select(F.col("path").alias("source"), F.lit("unique").alias("resolution")).distinct(), "source", "left")
    embeds = embeds.select("path", "line", "ord", F.col("source").cast("string").alias("target"), F.coalesce("resolution", F.lit("unresolved")).alias("resolution"), "source", F.lit(True).alias("markdown"), "kind", "id")
    asked = embeds.where("resolution = 'unique'").select(*E.ADDRESS).distinct()
    return E.shown(embeds, E.cuts(E.addressed(asked, headings, E.block_ranges(lines.select("path", "line", "text"), marks)), lines.select("path", "line", "text"), embeds))


@query("p20_embeds", f"WITH {EMBEDS_SQL} SELECT path, ord, absence, source, matches, nested, digest FROM shown")
def p20_embeds(read):
    return embedded(read).select("path", "ord", "absence", F.col("source").cast("string").alias("source"), "matches", "nested", "digest")


@query("p20_embed_digests", f"WITH {EMBEDS_SQL} SELECT path, sha256(string_agg({' || '.join(FRAME.format(c) for c in ('absence', 'source', 'matches::VARCHAR', 'digest'))}, '' ORDER BY ord)) AS embeds FROM shown GROUP BY path")
def p20_embed_digests(read):
    return E.identities(embedded(read))


@query("p20_embed_faults", f"""WITH {EMBEDS_SQL} SELECT path, ord, CASE WHEN absence = 'absent-note' THEN 'broken' WHEN absence <> '' THEN 'fragment-missing' ELSE 'fragment-repeated' END AS fault FROM shown WHERE absence <> '' OR matches > 1
    UNION ALL SELECT path, ord, 'not-expanded' FROM shown WHERE nested > 0""")
def p20_embed_faults(read):
    return E.faults(embedded(read)).select("path", "ord", "fault")


@query("q15_freshness_order", """WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS digest, octet_length(encode(coalesce(text, ''))) AS size FROM documents),
    k AS (SELECT doc_id, size, CASE WHEN doc_id % 13 = 1 THEN 'lookup' WHEN doc_id % 13 = 2 THEN 'read' END AS fault, CASE WHEN doc_id % 13 > 2 THEN digest END AS disk FROM d WHERE doc_id % 13 <> 0),
    s AS (SELECT doc_id, CASE WHEN doc_id % 5 <> 1 THEN CASE WHEN doc_id % 7 = 1 THEN sha256(digest) ELSE digest END END AS published, 'e' || (doc_id % 3) AS embeds FROM d WHERE doc_id % 5 <> 0),
    p AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN sha256(digest) ELSE digest END AS page, CASE WHEN doc_id % 4 <> 0 THEN 'e1' END AS embeds FROM d)
    SELECT p.doc_id, CASE WHEN k.doc_id IS NULL THEN 'gone' WHEN fault = 'lookup' THEN CASE WHEN s.doc_id IS NULL THEN 'gone' ELSE 'unreadable' END WHEN size > 2000 THEN CASE WHEN published IS NULL THEN 'stale' ELSE 'preparing' END
        WHEN fault = 'read' THEN 'unreadable' WHEN published IS DISTINCT FROM disk THEN 'preparing' WHEN disk IS DISTINCT FROM page THEN 'stale' WHEN p.embeds <> s.embeds THEN 'stale' ELSE 'unchanged' END AS state
    FROM p LEFT JOIN k USING (doc_id) LEFT JOIN s USING (doc_id)""")
def q15_freshness_order(read):
    """Pages of all documents, of which the disk and the generation lack, withhold or changed some."""
    n, text = F.col("path"), F.coalesce("text", F.lit(""))
    docs = read("documents").select(F.col("doc_id").alias("path"), F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("bigint").alias("size"))
    other = F.sha2("digest", 256)
    fault = F.when(n % 13 == 1, "lookup").when(n % 13 == 2, "read")
    disk = docs.where(n % 13 != 0).select("path", "size", fault.alias("fault"), F.when(n % 13 > 2, F.col("digest")).alias("disk"))
    body = F.when(n % 5 != 1, F.when(n % 7 == 1, other).otherwise(F.col("digest")))
    published = docs.where(n % 5 != 0).select("path", body.alias("published"), F.concat(F.lit("e"), (n % 3).cast("string")).alias("embeds"))
    page = docs.select("path", F.when(n % 6 == 0, other).otherwise(F.col("digest")).alias("page"), F.when(n % 4 != 0, "e1").alias("embeds"))
    return G.freshness(page, disk, published, cap=2000).select(n.alias("doc_id"), "state")


@query("t4_resolve_again", f"WITH {NAMES_SQL} SELECT path, line, target, resolution, coalesce(len(paths), 0)::INTEGER AS candidates FROM resolved")
def t4_resolve_again(read):
    """Every seventh order was changed since, and every ninth part had another alias: the rest keeps the resolution it had."""
    now, every = names(read), links(read)
    order, part = F.substring_index("path", "-", -1).cast("bigint"), F.regexp_extract("path", r"([0-9]+)\.md$", 1).cast("bigint")
    other = (order % 7 == 0) & F.col("target").startswith("part-")
    links_before = every.withColumn("key", F.when(other, F.concat(F.lit("old-"), "key")).otherwise(F.col("key")))
    names_before = now.withColumn("key", F.when((part % 9 == 0) & (F.col("kind") == "alias"), F.concat(F.lit("old-"), "key")).otherwise(F.col("key")))
    before = written(R.resolve(links_before, names_before, whole=False).select("path", "line", "target", "key", "candidates", "resolution"))
    changed = every.where(order % 7 == 0).select("path").distinct()
    again = R.resolve_again(every, now, before, names_before, changed, whole=False).select("path", "line", "target", "resolution", "candidates")
    remove(before)
    return again


#: What stands before the pages in turn, with its verdict and detail.
BEFORE = [
    ("", "served", ""), ("<!-- <iframe> -->", "served", ""), ("<noscript><object></object></noscript>", "nested-frame", "<object>"), ("<meta http-equiv=Refresh content=0>", "loads-elsewhere", '<meta http-equiv="refresh">'),
    ("<a ping=/p>x</a>", "loads-elsewhere", "ping"), ('<a href="Java\nscript:x">x</a>', "script-outside-text", "javascript:"), ("<script type=importmap>{}</script>", "script-outside-text", '<script type="importmap">'), ("<script>1 < 2</script>", "served", ""),
]
CASES_SQL = ", ".join(f"({k}, '{v}', '{d}')" for k, (_, v, d) in enumerate(BEFORE))


@query("n12_figure_inspection", f"""WITH c(k, verdict, detail) AS (VALUES {CASES_SQL}),
    p AS (SELECT page_id, page_id % 10 AS k, page_id % 97 = 10 AS large, to_base64(unhex(sha256(regexp_extract(html, '<script>(.*?)</script>', 1, 's')))) AS own, contains(html, '<script>') AS scripted FROM pages)
    SELECT page_id, CASE WHEN large THEN 'too-large' WHEN k = 8 THEN 'not-text' WHEN k = 9 THEN 'utf-16' ELSE verdict END AS verdict, CASE WHEN large OR k > 7 THEN '' ELSE detail END AS detail,
        CASE WHEN large OR k > 7 OR verdict <> 'served' THEN '' ELSE concat_ws(' ', CASE WHEN k = 7 THEN chr(39) || 'sha256-' || to_base64(unhex(sha256('1 < 2'))) || chr(39) END, CASE WHEN scripted THEN chr(39) || 'sha256-' || own || chr(39) END) END AS scripts
    FROM p LEFT JOIN c USING (k)""")
def n12_figure_inspection(read):
    """All pages as figures, behind markup of each verdict in turn; the pages themselves have inline scripts and nothing that is refused."""
    pages = read("pages").select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    k = F.col("page_id") % 10
    front = F.coalesce(F.get(F.array(*(F.lit(b) for b, _, _ in BEFORE)), k.cast("int")), F.lit(""))
    mark = F.when(k == 8, F.lit(b"\xff")).when(k == 9, F.lit(b"\xfe\xff")).otherwise(F.lit(b""))
    more = F.when(F.col("page_id") % 97 == 10, F.lit(FG.LIMIT + 1)).otherwise(0)
    data = F.concat(mark, F.encode(F.concat(front, "html", F.repeat(F.lit("a"), more)), "UTF-8"))
    return FG.inspected(pages, data).select("page_id", "verdict", F.when(F.col("verdict") == "too-large", "").otherwise(F.col("detail")).alias("detail"), F.array_join("scripts", " ").alias("scripts"))
