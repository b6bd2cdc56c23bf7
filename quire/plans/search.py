"""Search, facets, suggestions, lookups and locating (Q, F4-F7, F14, O3-O6, A12-A14, W11)."""

from pyspark.sql import Window, functions as F

from quire.functions import text as T
from quire.operators import leads, places
from quire.operators import search as S
from quire.plans.tables import DOCS_SQL, doc_notes, query

DOCS = f"d AS (SELECT *, lower(title) AS title_fold, lower(text) AS plain_fold, lower(path) AS path_fold FROM ({DOCS_SQL}))"
BUCKET = """CASE WHEN contains(title_fold, 'the') AND contains(title_fold, 'and') THEN 0 WHEN contains(plain_fold, 'the') AND contains(plain_fold, 'and') THEN 1
    WHEN contains(path_fold, 'the') AND contains(path_fold, 'and') THEN 3 END"""


def docs(read):
    """The driver's documents are NFC without special casing, so the fold is ``lower`` and stays in codegen."""
    notes = doc_notes(read).withColumns({"plain": F.col("text"), "aliases": F.array().cast("array<string>"), "tags": F.array(F.col("domain"))})
    return S.index(notes, fold=F.lower)


@query("q3_search_buckets", f"WITH {DOCS} SELECT bucket::INTEGER AS bucket, count(*) AS n FROM (SELECT {BUCKET} AS bucket FROM d) WHERE bucket IS NOT NULL GROUP BY 1")
def q3_buckets(read):
    return S.hits(docs(read), S.parse("the and")).groupBy("bucket").agg(F.count("*").alias("n"))


@query("q3_o3_search_top20", f"WITH {DOCS}, h AS (SELECT *, {BUCKET} AS bucket FROM d) SELECT doc_id, bucket::INTEGER AS bucket FROM h WHERE bucket IS NOT NULL ORDER BY bucket, (bucket = 0 AND title_fold = 'the and') DESC, path LIMIT 20")
def q3_top(read):
    return S.ranked(S.hits(docs(read), S.parse("The AND")), 20).select("doc_id", "bucket")


@query("q4_tag_shorthand", f"WITH {DOCS} SELECT count(*) AS n, min(CASE WHEN contains(title_fold, '#fr') THEN 0 WHEN contains(plain_fold, '#fr') THEN 1 ELSE 2 END)::INTEGER AS bucket FROM d WHERE domain = 'fr' OR contains(plain_fold, '#fr')")
def q4_tags(read):
    return S.hits(docs(read), S.parse("#fr")).agg(F.count("*").alias("n"), F.min("bucket").alias("bucket"))


@query("f4_f5_filters", f"WITH {DOCS} SELECT doc_id FROM d WHERE domain = 'en' AND path LIKE 'src1/%' AND contains(plain_fold, 'the')")
def f4_filters(read):
    return S.hits(docs(read), S.parse("the domain:EN folder:src1")).select("doc_id")


@query("f6_all_tokens", f"WITH {DOCS} SELECT doc_id FROM d WHERE contains(plain_fold, 'ing') AND contains(plain_fold, 'ed ') AND contains(plain_fold, 'th')")
def f6_tokens(read):
    return docs(read).where(S.contains_all(F.col("plain_fold"), ["ing", "th"]) & F.col("plain_fold").contains("ed ")).select("doc_id")


@query("f7_phrase", f"WITH {DOCS} SELECT doc_id FROM d WHERE regexp_matches(plain_fold, 'of\\s+the')")
def f7_phrase(read):
    return docs(read).where(S.contains_all(F.col("plain_fold"), S.parse('"of  the"').tokens)).select("doc_id")


@query("q7_pure_filter", f"WITH {DOCS} SELECT doc_id, 0 AS bucket FROM d WHERE domain = 'es'")
def q7_filter(read):
    return S.hits(docs(read), S.parse("domain:es")).select("doc_id", "bucket")


@query("a12_search_count", f"WITH {DOCS} SELECT count(*) AS n FROM d WHERE contains(plain_fold, 'license') OR contains(title_fold, 'license') OR contains(path_fold, 'license')")
def a12_count(read):
    return S.hits(docs(read), S.parse("license")).agg(F.count("*").alias("n"))


@query("a13_facets", f"WITH {DOCS}, h AS (SELECT * FROM d WHERE contains(plain_fold, 'the')) SELECT 'kind' AS facet, domain AS value, count(*) AS n FROM h GROUP BY ALL UNION ALL SELECT 'place', source, count(*) FROM h WHERE domain = 'en' GROUP BY ALL")
def a13_facets(read):
    found = S.hits(docs(read), S.parse("the"))
    kinds = S.facets(found, "domain").select(F.lit("kind").alias("facet"), "value", "n")
    places = S.facets(found.withColumn("place", T.place(F.col("path"), 1)), "place", S.filtered(found, [("domain", "en")]).withColumn("place", T.place(F.col("path"), 1)))
    return kinds.unionByName(places.select(F.lit("place").alias("facet"), "value", "n"))


WORDS = "w AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(split_part(text, chr(10), 1)), '[a-z]+')) AS word FROM documents) GROUP BY 1)"


@query("a14_title_words", f"WITH {WORDS} SELECT word, n FROM w")
def a14_words(read):
    words = doc_notes(read).select(F.explode(F.regexp_extract_all(F.lower("title"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


@query("q9_near_word", f"WITH {WORDS} SELECT word, n FROM w WHERE damerau_levenshtein(word, 'tthe') = 1 AND NOT EXISTS (SELECT 1 FROM w WHERE word = 'tthe') ORDER BY n DESC, word LIMIT 1")
def q9_near(read):
    return S.near_word(doc_notes(read), "tthe")


@query("x14_one_edit", f"WITH {WORDS} SELECT a.word AS a, b.word AS b FROM w a, (VALUES ('hte'), ('an'), ('thhe'), ('adn')) b(word) WHERE damerau_levenshtein(a.word, b.word) = 1")
def x14_one_edit(read):
    words = doc_notes(read).select(F.explode(F.regexp_extract_all(F.lower("title"), F.lit("[a-z]+"), F.lit(0))).alias("a")).distinct()
    return words.select("a", F.explode(F.array(*map(F.lit, ("hte", "an", "thhe", "adn")))).alias("b")).where(T.one_edit(F.col("a"), F.col("b")))


STEPPED = 'domain:en "the license" worthless zz99 OR kind:tion'


@query("q10_step_backs", f"""WITH {DOCS}, w(k, query, terms) AS (VALUES (0, 'the license worthless zz99 OR kind:tion', ['the', 'license', 'worthless', 'zz99', 'or', 'kind:tion']), (1, 'the license worthless zz 99 OR kind:tion', ['the', 'license', 'worthless', 'zz', '99', 'or', 'kind:tion']),
        (2, 'the', ['the']), (3, 'license', ['license']), (4, 'worthless', ['worthless']), (5, 'zz99', ['zz99']), (6, 'kind:tion', ['kind:tion'])),
    h AS (SELECT k, query, count(*) AS n FROM d, w WHERE domain = 'en' AND ((SELECT bool_and(contains(title_fold, t)) FROM (SELECT unnest(terms) AS t)) OR (SELECT bool_and(contains(plain_fold, t)) FROM (SELECT unnest(terms) AS t)) OR (SELECT bool_and(contains(lower(domain), t)) FROM (SELECT unnest(terms) AS t)) OR (SELECT bool_and(contains(path_fold, t)) FROM (SELECT unnest(terms) AS t))) GROUP BY ALL)
    SELECT 'domain:en ' || query AS query, n, (row_number() OVER (ORDER BY k))::INTEGER AS rank FROM h ORDER BY k LIMIT 4""")
def q10_step_backs(read):
    return S.offered(docs(read), STEPPED)


@query("q11_q13_folders", f"WITH {DOCS}, f AS (SELECT source AS folder FROM d UNION ALL SELECT source || '/' || domain FROM d) SELECT folder, count(*) AS n FROM f WHERE contains(regexp_extract(folder, '[^/]*$'), 'src1') GROUP BY 1")
def q11_folders(read):
    return S.folder_names(docs(read).select("path"), ["src1"])


@query("q12_exists", """WITH f AS (SELECT 'customer' AS field, c_custkey AS path, c_name AS value FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'part', p_partkey, p_name FROM part)
    SELECT field, path, value, 'exact' AS match FROM f WHERE lower(trim(value)) = 'small ring'""")
def q12_exists(read):
    of = lambda t, k, v: read(t).select(F.lit(t).alias("field"), F.col(k).alias("path"), F.col(v).alias("value"))
    rows = of("customer", "c_custkey", "c_name").union(of("supplier", "s_suppkey", "s_name")).union(of("part", "p_partkey", "p_name"))
    return S.exists(rows, " Small Ring").select("field", "path", "value", "match")


@query("u3_near_minus_exact", "SELECT p_partkey AS path, p_name AS value FROM part WHERE lower(p_name) = 'red widget' EXCEPT SELECT p_partkey, p_name FROM part WHERE p_partkey % 2 = 0")
def u3_near(read):
    rows = read("part").select(F.lit("name").alias("field"), F.col("p_partkey").alias("path"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.regexp_replace("p_name", " ", "  ")).alias("value"))
    return S.exists(rows, "red widget").where("match = 'near'").select("path", F.regexp_replace("value", "  ", " ").alias("value"))


@query("a25_distinct_notes", "SELECT count(DISTINCT p_partkey) AS n FROM part WHERE lower(p_name) = 'red widget'")
def a25_distinct(read):
    rows = read("part").select(F.explode(F.array(F.lit("title"), F.lit("alias"))).alias("field"), F.col("p_partkey").alias("path"), F.col("p_name").alias("value"))
    return S.exists(rows, "red widget").agg(F.count_distinct("path").alias("n"))


@query("q14_w11_located", """WITH q AS (SELECT item_id AS id, text AS quote FROM benchmark), hits AS (SELECT q.id, d.doc_id, len(string_split(d.text, q.quote)) - 1 AS candidates, instr(d.text, q.quote) AS first_at FROM q JOIN documents d ON contains(d.text, q.quote))
    SELECT id, doc_id, candidates::INTEGER AS candidates, (CASE WHEN candidates = 1 THEN first_at END)::INTEGER AS position FROM hits""")
def q14_located(read):
    notes = read("documents").select(F.col("doc_id").alias("path"), "text")
    passages = read("benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("quote"), F.lit("").alias("before"), F.lit("").alias("after"))
    # a passage's second to fifth word find the notes it can stand in, by hash
    words = lambda c: F.split(c, r"\s+")
    four = lambda w, k: F.xxhash64(*(F.get(w, k + i) for i in range(4)))
    asked = passages.select("id", "quote", "before", "after", four(words("quote"), F.lit(1)).alias("gram"))
    grams = notes.select("path", words("text").alias("w")).select("path", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 4, F.lit(0))), lambda k: four(F.col("w"), k)))).alias("gram"))
    wanted = grams.join(asked, "gram").select("id", "path", "quote", "before", "after")  # the asked side is written nowhere: Spark broadcasts it below its threshold
    return S.located(notes, wanted).select("id", F.col("path").alias("doc_id"), "candidates", F.col("at").alias("position"))


@query("w11_contexts", """SELECT p_partkey AS id, (CASE p_size % 3 WHEN 0 THEN length('alpha ') + 1 WHEN 1 THEN length('alpha ') + length(p_name) + length(' beta ') + 1 END)::INTEGER AS position, (CASE p_size % 3 WHEN 2 THEN 2 ELSE 1 END)::INTEGER AS candidates FROM part""")
def w11_contexts(read):
    """Each part's name twice in its note: the words before it decide which place is meant, or don't."""
    rows = read("part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("path"), F.concat(F.lit("alpha "), "p_name", F.lit(" beta "), "p_name", F.lit(" gamma")).alias("text"), F.col("p_name").alias("quote"), F.col("p_size") % 3)
    rows = rows.toDF("id", "path", "text", "quote", "k")
    asked = rows.select("id", "path", "quote", F.when(F.col("k") == 0, "alpha ").when(F.col("k") == 1, "beta ").otherwise("").alias("before"), F.lit("").alias("after"))
    return S.located(rows.select("path", "text"), asked).select("id", F.col("at").cast("int").alias("position"), "candidates")


@query("x10_snippets", f"WITH {DOCS} SELECT doc_id, trim(regexp_replace(substr(text, greatest(instr(plain_fold, 'license') - 40, 1), 200), '\\s+', ' ', 'g')) AS snippet FROM d WHERE contains(plain_fold, 'license')")
def x10_snippets(read):
    found = docs(read).where(F.col("plain_fold").contains("license"))
    return found.select("doc_id", S.snippet(F.col("text"), F.col("plain_fold"), "license").alias("snippet"))


@query("f14_title_filter", f"WITH {DOCS} SELECT source || '/' || domain AS folder, count(*) AS n FROM d WHERE contains(title_fold, 'the') AND path LIKE 'src2/%' GROUP BY 1")
def f14_title(read):
    return S.filtered(docs(read), [("folder", "src2")]).where(F.col("title_fold").contains("the")).groupBy(T.folder(F.col("path")).alias("folder")).agg(F.count("*").alias("n"))


@query("o5_recent", f"WITH {DOCS} SELECT doc_id, n_chars FROM d WHERE contains(plain_fold, 'the') ORDER BY n_chars DESC, path LIMIT 20")
def o5_recent(read):
    return S.hits(docs(read), S.parse("the")).orderBy(F.desc("n_chars"), "path").limit(20).select("doc_id", "n_chars")


# marks of every document: its sixth to eleventh word; the notes are as they were, edited at a word, cut, doubled, or the mark is of a section
WHITE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
MARKS_SQL = f"""docs AS (SELECT doc_id, doc_id % 5 AS k, text, string_split(trim(regexp_replace(text, '{WHITE}', ' ', 'g')), ' ') AS w FROM documents),
    marked AS (SELECT doc_id, CASE WHEN k = 4 THEN '' ELSE array_to_string(w[6:11], ' ') END AS quote, array_to_string(w[1:5], ' ') AS b, array_to_string(w[12:16], ' ') AS a, doc_id % 3 < 2 AS kept,
        regexp_replace(CASE k WHEN 1 THEN array_to_string(w[1:8], ' ') || ' edited words ' || array_to_string(w[10:], ' ') WHEN 2 THEN array_to_string(w[18:], ' ') WHEN 3 THEN text || ' ' || text ELSE text END, '{WHITE}', ' ', 'g') AS s FROM docs),
    places AS (SELECT doc_id, instr(s, quote) AS i FROM marked WHERE quote <> '' AND instr(s, quote) > 0
        UNION ALL SELECT doc_id, i + instr(substr(s, i + 1), quote) FROM places JOIN marked USING (doc_id) WHERE instr(substr(s, i + 1), quote) > 0),
    sides AS (SELECT doc_id, i, quote, hex(encode(rtrim(right(substr(s, 1, i - 1), length(b) + 1)))) AS l, hex(encode(b)) AS lb, hex(encode(ltrim(substr(s, i + length(quote), length(a) + 1)))) AS r, hex(encode(a)) AS ra FROM places JOIN marked USING (doc_id)),
    scored AS (SELECT doc_id, i, list_max(list_filter(range(0, least(len(l), len(lb)) // 2 + 1), lambda n: right(l, 2 * n) = right(lb, 2 * n))) + list_max(list_filter(range(0, least(len(r), len(ra)) // 2 + 1), lambda n: left(r, 2 * n) = left(ra, 2 * n))) AS score FROM sides),
    best AS (SELECT doc_id, count(*) AS n, min(i) AS i FROM (SELECT *, max(score) OVER (PARTITION BY doc_id) AS top FROM scored) WHERE score = top GROUP BY 1),
    steps AS (SELECT doc_id, s, octet_length(encode(quote)) * 3 + 128 AS reach, step, ltrim(right(b, list_max(list_filter(range(0, length(b) + 1), lambda n: octet_length(encode(right(b, n))) <= step)))) AS b,
        rtrim(left(a, list_max(list_filter(range(0, length(a) + 1), lambda n: octet_length(encode(left(a, n))) <= step)))) AS a FROM marked, (VALUES (512), (96), (32)) v(step) WHERE quote <> '' AND b <> '' AND a <> '' AND doc_id NOT IN (SELECT doc_id FROM best)),
    befores AS (SELECT doc_id, step, instr(s, b) AS i FROM steps WHERE instr(s, b) > 0 UNION ALL SELECT doc_id, step, i + instr(substr(s, i + 1), b) FROM befores JOIN steps USING (doc_id, step) WHERE instr(substr(s, i + 1), b) > 0),
    gaps AS (SELECT doc_id, step, i + length(b) AS i, left(substr(s, i + length(b)), greatest(instr(substr(s, i + length(b)), a) - 1, 0)) AS gap, reach FROM befores JOIN steps USING (doc_id, step)),
    spans AS (SELECT doc_id, arg_max(i, step) AS i, arg_max(gap, step) AS gap FROM (SELECT doc_id, step, any_value(i) AS i, any_value(gap) AS gap FROM gaps WHERE trim(gap) <> '' AND octet_length(encode(gap)) <= reach GROUP BY ALL HAVING count(*) = 1) GROUP BY 1),
    answer AS (SELECT doc_id, kept, CASE WHEN quote = '' THEN CASE WHEN kept THEN 'section' ELSE 'changed' END WHEN best.n = 1 OR spans.i IS NOT NULL THEN 'found' ELSE 'changed' END AS status,
        CASE WHEN best.n = 1 THEN true WHEN spans.i IS NOT NULL THEN false END AS exact, CASE WHEN best.n = 1 THEN quote ELSE trim(gap) END AS words, left(s, CASE WHEN best.n = 1 THEN best.i ELSE spans.i END - 1) AS ahead FROM marked LEFT JOIN best USING (doc_id) LEFT JOIN spans USING (doc_id))"""


@query("q14_w11_mark_places", f"""WITH RECURSIVE {MARKS_SQL} SELECT doc_id, status, exact, kept AS section_kept, words, octet_length(encode(replace(ahead, ' ', ''))) AS ahead FROM answer""")
def q14_mark_places(read):
    k, white = F.col("doc_id") % 5, places.SPACE.pattern
    words = F.split(F.trim(F.regexp_replace("text", white, " ")), " ")
    said = lambda start, stop=None: F.array_join(F.slice(words, start, F.lit(stop - start + 1) if stop else F.size(words)), " ")
    quote, before, after = places.words_around(F.col("text"), 6, 6, 5)
    docs = read("documents").where("text is not null")
    marks = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").cast("string").alias("path"), F.concat(F.lit("part-"), (F.col("doc_id") % 3).cast("string")).alias("anchor"), F.when(k != 4, quote).alias("quote"), before.alias("before"), after.alias("after"))
    edited = F.when(k == 1, F.concat_ws(" ", said(1, 8), F.lit("edited words"), said(10))).when(k == 2, said(18)).when(k == 3, F.concat_ws(" ", "text", "text")).otherwise(F.col("text"))
    notes = docs.select(F.col("doc_id").cast("string").alias("path"), edited.alias("text"), F.array(F.lit("part-0"), F.lit("part-1")).alias("sections"))
    # what lies ahead of the place, without its white space, is the same in the squeezed text
    ahead = F.octet_length(F.regexp_replace(F.substring(F.encode("text", "utf-8"), F.lit(1), F.col("start").cast("int")).cast("string"), white, ""))
    return places.located(marks, notes).join(notes.select("path", "text"), "path").select(F.col("path").cast("bigint").alias("doc_id"), "status", "exact", "section_kept", F.regexp_replace("words", white, " ").alias("words"), F.when(F.col("status") == "found", ahead.cast("bigint")).alias("ahead"))


def _edge(text: str, at: str, on: str, back: str) -> str:
    """SQL of a cut that falls between words: ``on`` and ``back`` are the lengths of the word after and before it."""
    return f"CASE WHEN {at} > 0 AND {at} < length({text}) AND {on} > 0 AND {back} > 0 THEN %s ELSE {at} END"


def _word_sql(text: str, at: str, start: bool) -> str:
    on, back = f"length(regexp_extract(substr({text}, {at} + 1), '^[0-9A-Za-z_-]+'))", f"length(regexp_extract(left({text}, {at}), '[0-9A-Za-z_-]+$'))"
    own = f"CASE WHEN {back} <= 24 THEN {at} - {back} ELSE {at} + {on} END" if start else f"CASE WHEN {on} <= 24 THEN {at} + {on} ELSE {at} - {back} END"
    return _edge(text, at, on, back) % own


LEADS_SQL = f"""lines AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE contains(lower(text), 'the')),
    block AS (SELECT doc_id, arg_min(CASE WHEN i > 1 THEN chr(10) ELSE '' END || line, i) AS b FROM lines WHERE contains(lower(line), 'the') AND trim(regexp_replace(lower(line), '\\s+', ' ', 'g')) <> trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) GROUP BY 1),
    hit AS (SELECT doc_id, b, instr(lower(b), 'the') - 1 AS off, length(b) AS n FROM block), seen AS (SELECT *, greatest(off - 120, 0) AS s, substr(b, greatest(off - 120, 0) + 1, least(off, 120)) AS before FROM hit),
    stops AS (SELECT *, greatest(length(regexp_extract(before, '^(?s:.*)[。！？；!?;]')), length(regexp_extract(before, '^(?s:.*)[.] ')) - 1) AS stop FROM seen),
    opened AS (SELECT *, CASE WHEN stop > 0 THEN s + stop + length(regexp_extract(substr(before, stop + 1), '^[ \\t\\n]*')) WHEN s = 0 THEN 0 ELSE least(off, {_word_sql("b", "s", True)}) END AS o FROM stops),
    cuts AS (SELECT *, least(n, o + 240) AS e, least(n, least(off, {_word_sql("b", "greatest(off - 8, 0)", True)}) + 90) AS e2, least(off, {_word_sql("b", "greatest(off - 8, 0)", True)}) AS o2 FROM opened),
    ends AS (SELECT *, least(n, greatest(off + 3, {_word_sql("b", "e", False)})) AS z, least(n, greatest(off + 3, {_word_sql("b", "e2", False)})) AS z2 FROM cuts)"""
_SHOWN = "CASE WHEN {o} > 0 THEN '…' ELSE '' END || regexp_replace(trim(regexp_replace(substr(b, ({o} + 1)::BIGINT, ({z} - {o})::BIGINT), '\\s+', ' ', 'g')), '(?i)(the)', '«\\1»', 'g') || CASE WHEN {z} < n THEN '…' ELSE '' END"


@query("x10_x12_leads", f"""WITH {LEADS_SQL}, d AS (SELECT doc_id FROM documents WHERE contains(lower(text), 'the')) SELECT d.doc_id, coalesce({_SHOWN.format(o="o", z="z")}, '') AS lead, CASE WHEN off - o > 22 THEN {_SHOWN.format(o="o2", z="z2")} ELSE '' END AS near FROM d LEFT JOIN ends USING (doc_id)""")
def x12_leads(read):
    """The leads of all documents that hold a word; their lines are the blocks, the first one the title."""
    lines, newline = F.split("text", "\n"), F.lit("\n")
    stop = F.transform(F.sequence(F.lit(1), F.size(lines)), lambda k: F.struct(F.char_length(F.array_join(F.slice(lines, 1, k), "\n")).alias("stop"), F.lit("paragraph").alias("kind"), F.lit(0).alias("level")))
    short = F.size(lines) <= 64
    found = read("documents").where(F.lower("text").contains("the"))
    # where each line ends: the sum of the lengths up to it, by a window over the lines of longer documents
    ends = found.where(~short).select("doc_id", F.posexplode(lines).alias("k", "line")).withColumn("stop", (F.sum(F.char_length("line") + 1).over(Window.partitionBy("doc_id").orderBy("k")) - 1).cast("int"))
    long = ends.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("stop", F.lit("paragraph").alias("kind"), F.lit(0).alias("level")))).alias("plain_blocks"))
    title = F.split_part("text", newline, F.lit(1)).alias("title")
    both = found.where(short).select("doc_id", title, F.col("text").alias("plain"), stop.alias("plain_blocks")).unionByName(found.where(~short).join(long, "doc_id").select("doc_id", title, F.col("text").alias("plain"), "plain_blocks"))
    said = lambda runs: F.array_join(F.transform(runs, lambda r: F.when(r["hit"], F.concat(F.lit("«"), r["text"], F.lit("»"))).otherwise(r["text"])), "")
    return leads.excerpts(both, ["the"], "doc_id").select("doc_id", said(F.col("lead")).alias("lead"), said(F.col("near")).alias("near"))
