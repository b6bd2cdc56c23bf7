"""Schema rules over documents and labels as records."""

from pyspark.sql import functions as F

from quire.operators import schema_rules as S
from quire.plans.tables import query

RECORDS_SQL = """r AS (SELECT doc_id AS path, CASE l.quality WHEN 1 THEN 'concept' WHEN 0 THEN 'lesson' END AS type, lang, source, CASE WHEN doc_id % 3 = 0 THEN source || '_' || doc_id ELSE source END AS slug,
    CASE l.toxic WHEN 1 THEN 'yes' WHEN 0 THEN 'false' END AS draft FROM documents LEFT JOIN labels l USING (doc_id))"""


def records(read):
    both = read("documents").join(read("labels"), "doc_id", "left")
    kind = F.when(F.col("quality") == 1, "concept").when(F.col("quality") == 0, "lesson")
    slug = F.when(F.col("doc_id") % 3 == 0, F.concat_ws("_", "source", "doc_id")).otherwise(F.col("source"))
    draft = F.when(F.col("toxic") == 1, "yes").when(F.col("toxic") == 0, "false")
    every = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"), F.lit("slug"), slug, F.lit("draft"), draft)
    return both.select(F.col("doc_id").alias("path"), kind.alias("type"), F.map_filter(every, lambda k, v: v.isNotNull()).alias("fields"))


@query("r29_enum", f"WITH {RECORDS_SQL} SELECT path, 'lang' AS field, lang AS value FROM r WHERE lang NOT IN ('en', 'de') UNION ALL SELECT path, 'draft', draft FROM r WHERE draft NOT IN ('true', 'false')")
def r29_enum(read):
    rows = records(read)
    enums = rows.sparkSession.createDataFrame([("lang", "en"), ("lang", "de"), ("draft", "true"), ("draft", "false")], "field string, value string")
    return S.enum_violations(rows, enums).drop("rule_id")


# a third of the records has a word for its type that the contract doesn't have
STANDING_SQL = f"""WITH {RECORDS_SQL}, t AS (SELECT path, CASE WHEN path % 3 = 1 THEN 'Essay' WHEN path % 3 = 2 THEN type END AS word, source, draft FROM r),
    k AS (SELECT path, word, 'source' AS field FROM t WHERE source IS NOT NULL UNION ALL SELECT path, word, 'draft' FROM t WHERE draft IS NOT NULL),
    s AS (SELECT path, word, field, CASE WHEN word = 'lesson' AND field = 'source' THEN 'allowed' WHEN word IN ('lesson', 'concept') THEN 'unknown' WHEN word IS NULL THEN 'unknown' WHEN field = 'source' THEN 'dependent' ELSE 'unknown' END AS standing FROM k)"""
ALLOWED = [(None, "lang"), (None, "slug"), ("lesson", "source"), ("concept", "based_on")]


def typed(read):
    return records(read).withColumn("type", F.when(F.col("path") % 3 == 1, "Essay").when(F.col("path") % 3 == 2, F.col("type")))


@query("r30_unknown_key", f"{STANDING_SQL} SELECT path, field FROM s WHERE standing = 'unknown'")
def r30_unknown(read):
    rows = typed(read)
    return S.unknown_keys(rows, rows.sparkSession.createDataFrame(ALLOWED, "type string, field string")).select("path", "field")


@query("r31_type_dependent", f"{STANDING_SQL} SELECT DISTINCT path, word AS value FROM s WHERE standing = 'dependent'")
def r31_dependent(read):
    rows = typed(read)
    return S.untyped_dependent(rows, rows.sparkSession.createDataFrame(ALLOWED, "type string, field string")).select("path", "value")


@query("r32_required", f"WITH {RECORDS_SQL} SELECT path, f AS field FROM r, (VALUES ('concept', 'created'), ('lesson', 'draft'), ('lesson', 'order')) v(t, f) WHERE type = t AND NOT (f = 'draft' AND draft IS NOT NULL)")
def r32_required(read):
    rows = records(read)
    required = rows.sparkSession.createDataFrame([("concept", "created"), ("lesson", "draft"), ("lesson", "order")], "type string, field string")
    return S.missing_required(rows, required).select("path", "field")


@query("r33_slug", f"WITH {RECORDS_SQL} SELECT path, slug AS value FROM r WHERE type = 'concept' AND NOT regexp_full_match(slug, 'src[0-9]+')")
def r33_slug(read):
    return S.bad_slugs(records(read), {"concept": r"^src[0-9]+$"}).select("path", "value")


@query("r34_language", "SELECT doc_id AS path, CASE doc_id % 5 WHEN 3 THEN lang || '_x' ELSE 'a' || doc_id END AS value FROM documents WHERE doc_id % 5 >= 3")
def r34_language(read):
    k = F.col("doc_id") % 5
    tag = F.when(k == 0, F.concat("lang", F.lit("-Hant-TW"))).when(k == 1, F.concat("lang", F.lit("-419"))).when(k == 2, F.col("lang")).when(k == 3, F.concat("lang", F.lit("_x"))).otherwise(F.concat(F.lit("a"), F.col("doc_id").cast("string")))
    rows = read("documents").select(F.col("doc_id").alias("path"), F.lit("note").alias("type"), F.create_map(F.lit("lang"), tag).alias("fields"))
    return S.bad_languages(rows).select("path", "value")


@query("r35_draft", f"WITH {RECORDS_SQL} SELECT path, draft AS value FROM r WHERE draft = 'yes'")
def r35_draft(read):
    return S.bad_drafts(records(read)).select("path", "value")


@query("r36_provenance", f"WITH {RECORDS_SQL} SELECT path FROM r WHERE type = 'concept' AND path % 2 = 1")
def r36_provenance(read):
    own = records(read).withColumn("fields", F.when(F.col("path") % 2 == 0, F.map_concat("fields", F.create_map(F.lit("based_on"), F.lit("x")))).otherwise(F.col("fields")))
    return S.without_provenance(own, "concept", ["url", "based_on"]).select("path")


@query("r38_unmatched_directories", "SELECT d AS value FROM (VALUES ('SRC1'), ('src3'), ('nowhere'), ('src99')) v(d) WHERE lower(d) NOT IN (SELECT source FROM documents)")
def r38_unmatched(read):
    return S.unmatched_directories(read("documents").select(F.concat_ws("/", "source", "lang").alias("path")), ["SRC1", "src3", "nowhere", "src99"]).select("value")
