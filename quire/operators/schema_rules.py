"""Rules over declared records: vocabulary, keys, required fields, slugs, languages, drafts, provenance.

Records: path, type, fields (map of key to text). The contract is a few small tables from
its file; each rule is a join against one of them and gives findings (path, rule_id, field, value).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quire.operators import findings as Q


def fields(records: DataFrame) -> DataFrame:
    return records.select("path", "type", F.explode("fields").alias("field", "value"))


def enum_violations(records: DataFrame, enums: DataFrame) -> DataFrame:
    """Values outside the vocabulary of their field (enums: field, value)."""
    own = fields(records).where("value is not null").join(F.broadcast(enums.select("field").distinct()), "field", "left_semi")
    bad = own.join(F.broadcast(enums.select("field", "value").distinct()), ["field", "value"], "left_anti")
    return bad.select("path", F.lit("schema.enum").alias("rule_id"), "field", "value")


def key_standing(records: DataFrame, allowed: DataFrame) -> DataFrame:
    """Keys that aren't common to all types, each allowed, unknown, or dependent: only some type has it, and the record's word for its type is
    none (allowed: type, field; type null for all types). A record without a type has no dependent keys."""
    common = allowed.where("type is null").select("field")
    own = allowed.where("type is not null").select(F.lower(F.trim("type")).alias("word"), "field", F.lit(True).alias("has")).distinct()
    known = own.select("word", F.lit(True).alias("declared")).distinct()
    some = own.select("field", F.lit(True).alias("of_some")).distinct()
    out = fields(records).withColumn("word", F.lower(F.trim("type"))).join(F.broadcast(common), "field", "left_anti")
    out = out.join(F.broadcast(own), ["word", "field"], "left").join(F.broadcast(known), "word", "left").join(F.broadcast(some), "field", "left")
    dependent = F.col("declared").isNull() & F.col("of_some").isNotNull() & (F.coalesce("word", F.lit("")) != "")
    return out.select("path", "type", "field", F.when(F.col("has"), "allowed").when(dependent, "dependent").otherwise("unknown").alias("standing"))


def unknown_keys(records: DataFrame, allowed: DataFrame) -> DataFrame:
    """Keys that the record's type, or any if it has none, doesn't have."""
    return key_standing(records, allowed).where("standing = 'unknown'").select("path", F.lit("schema.unknown_key").alias("rule_id"), "field", F.lit(None).cast("string").alias("value"))


def missing_required(records: DataFrame, required: DataFrame) -> DataFrame:
    """Required fields (type, field) that a record lacks."""
    due = records.select("path", "type", F.map_keys("fields").alias("have")).join(F.broadcast(required), "type")
    return due.where(~F.array_contains("have", F.col("field"))).select("path", F.lit("schema.required").alias("rule_id"), "field", F.lit(None).cast("string").alias("value"))


def bad_slugs(records: DataFrame, patterns: dict[str, str]) -> DataFrame:
    bad = F.lit(False)
    slug = F.col("fields")["slug"]
    for kind, pattern in patterns.items():
        bad = bad | ((F.col("type") == kind) & ~slug.rlike(pattern))
    return records.where(slug.isNotNull() & bad).select("path", F.lit("schema.slug").alias("rule_id"), F.lit("slug").alias("field"), slug.alias("value"))


def bad_drafts(records: DataFrame) -> DataFrame:
    draft = F.col("fields")["draft"]
    fault = Q.not_boolean(F.col("kinds")["draft"]) | (F.col("kinds")["draft"] == "null") if "kinds" in records.columns else ~draft.isin("true", "false")
    return records.where(draft.isNotNull() & fault).select("path", F.lit("schema.draft").alias("rule_id"), F.lit("draft").alias("field"), draft.alias("value"))


def bad_languages(records: DataFrame) -> DataFrame:
    tag = F.col("fields")["lang"]
    shape = r"^([A-Za-z]{2,3}|[A-Za-z]{5,8})(-[A-Za-z]{4})?(-([A-Za-z]{2}|[0-9]{3}))?(-([A-Za-z0-9]{5,8}|[0-9][A-Za-z0-9]{3}))*$"
    text = F.col("kinds")["lang"] == "text" if "kinds" in records.columns else F.lit(True)
    return records.where(tag.isNotNull() & ~(text & tag.rlike(shape))).select("path", F.lit("schema.language").alias("rule_id"), F.lit("lang").alias("field"), tag.alias("value"))


def without_provenance(records: DataFrame, kind: str, any_of: list[str]) -> DataFrame:
    none = F.lit(True)
    for f in any_of:
        none = none & F.col("fields")[f].isNull()
    return records.where((F.col("type") == kind) & none).select("path", F.lit("schema.provenance").alias("rule_id"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value"))


def untyped_dependent(records: DataFrame, allowed: DataFrame) -> DataFrame:
    """Records whose type is no declared one and that have a key only a type can judge: one finding each."""
    due = key_standing(records, allowed).where("standing = 'dependent'").select("path", "type").distinct()
    return due.select("path", F.lit("schema.type_dependent").alias("rule_id"), F.lit("type").alias("field"), F.col("type").alias("value"))


def nested_references(records: DataFrame, nested: list[str]) -> DataFrame:
    """Reference fields whose value is a list inside a list."""
    return fields(records).where(F.col("field").isin(*nested) & F.col("value").rlike(r"^\s*\[\s*\[(?!\[)")).select("path", F.lit("schema.reference_nested_sequence").alias("rule_id"), "field", "value")


def unmatched_directories(paths: DataFrame, declared: list[str]) -> DataFrame:
    """Declared top directories that no file lies in."""
    want = paths.sparkSession.createDataFrame([(d,) for d in declared], "value string")
    seen = paths.select(F.lower(F.split("path", "/")[0]).alias("seen")).distinct()
    return want.join(seen, F.lower("value") == F.col("seen"), "left_anti").select(F.lit("schema.unmatched_knowledge_dir").alias("rule_id"), "value")


def frontmatter_faults(records: DataFrame) -> DataFrame:
    """Notes whose frontmatter is missing, malformed or never closed (records: path, has_fm, bad_fm, unclosed_fm)."""
    cause = F.when(F.col("unclosed_fm"), "unclosed").when(F.col("bad_fm"), "invalid").when(~F.col("has_fm"), "missing")
    return records.select("path", F.lit("schema.frontmatter").alias("rule_id"), cause.alias("value")).where("value is not null")
