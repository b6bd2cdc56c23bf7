"""Drills: sentence patterns with slots beside a lesson, their problems, and concept sheets (JN15, N10, N11, X21).

Patterns: source (path of the sidecar), slug, id, template, gloss, slots (map of key to struct of color and fills).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.functions import text as T


def keys(template: Column) -> Column:
    """The keys that a template names in braces, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{([^{}]+)\}"), F.lit(1)))


def problems(patterns: DataFrame, colors: list[str]) -> DataFrame:
    """source, id, problem and key of each fault; a sidecar without a slug has that one alone, a slug is its first source's."""
    named = patterns.where("slug <> ''")
    own = named.withColumns({"named": keys(F.col("template")), "glossed": keys(F.coalesce("gloss", F.lit("")))})
    slot = named.select("source", "id", F.explode("slots").alias("key", "slot"))
    fault = lambda rows, word, key: rows.select("source", "id", F.lit(word).alias("problem"), key.alias("key"))
    has = F.map_keys("slots")
    out = [
        fault(slot.where(F.size(F.coalesce("slot.fills", F.array())) == 0), "no fills", F.col("key")),
        fault(slot.where((F.coalesce("slot.color", F.lit("")) != "") & ~F.col("slot.color").isin(*colors)), "unknown color", F.col("key")),
        fault(own.withColumn("key", F.explode(F.array_except("named", has))), "no slot", F.col("key")),
        fault(own.withColumn("key", F.explode(F.array_except("glossed", "named"))), "gloss key not in template", F.col("key")),
    ]
    none = F.lit(None).cast("string")
    faults = out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])
    bare = patterns.where("slug = '' or slug is null").select("source").distinct().select("source", none.alias("id"), F.lit("no slug").alias("problem"), none.alias("key"))
    sound = named.select("source", "slug").distinct().join(faults.select("source").distinct(), "source", "left_anti")
    again = sound.withColumn("n", F.row_number().over(Window.partitionBy("slug").orderBy("source"))).where("n > 1")
    return faults.unionByName(bare).unionByName(again.select("source", none.alias("id"), F.lit("slug declared before").alias("problem"), F.col("slug").alias("key")))


def by_lesson(patterns: DataFrame, lessons: DataFrame, faults: DataFrame) -> DataFrame:
    """Lessons (path, slug) with the sound patterns of their slug."""
    sound = patterns.join(faults.select("source").distinct(), "source", "left_anti")
    return lessons.join(sound, "slug").select("path", "slug", "source", "id")


def pattern_json(patterns: DataFrame) -> Column:
    """A pattern as one JSON object."""
    return F.to_json(F.struct("id", "template", "gloss", "slots"), {"ignoreNullFields": "true"})


def sheets(notes: DataFrame, folder: str = "Concepts") -> DataFrame:
    """The concept notes, one level or more below their domain, with their ids; the folder's own index is none."""
    return notes.where(F.col("path").rlike(rf"^{folder}/[^/]+/.+\.md$")).withColumn("id", T.concept_id(F.col("path")))
