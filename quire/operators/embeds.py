"""Transclusion, one level deep: what each embed of a page shows, and one digest of all that a page shows of others (P20, Q15).

An address (a note, a section or a block of one) is cut once however many pages embed it; pages get the digest of
the cut, not its text, so that a passage embedded everywhere is carried nowhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.functions import text as T
from quire.operators import nav
from quire.sources import blocks as B

#: The marker of a list item (fixed value).
ITEM = r"^ {0,3}(?:[-*+]|\d{1,9}[.)])(?:[ \t]|$)"
ADDRESS = ["source", "kind", "id"]


def block_ranges(lines: DataFrame, marks: DataFrame) -> DataFrame:
    """The block of each marker (marks: path, line, id): its list item, or the lines between blank ones; of several with one id the first."""
    mine = lines.join(marks.select("path").distinct(), "path", "left_semi")
    blank, item = F.trim(T.collapsed(F.col("text"))) == "", F.col("text").rlike(ITEM)
    order = Window.partitionBy("path").orderBy("line")
    cut = mine.select("path", "line", (item | F.coalesce(F.lag(blank).over(order), F.lit(True))).alias("opens"), (item | blank).alias("closes"))
    start = F.last(F.when(F.col("opens"), F.col("line")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    stop = F.first(F.when(F.col("closes"), F.col("line")), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    placed = cut.select("path", "line", start.alias("start"), stop.alias("stop")).join(marks, ["path", "line"])
    return placed.groupBy("path", "id").agg(F.min(F.struct("line", "start", "stop")).alias("at")).select("path", "id", "at.start", "at.stop")


def addressed(addresses: DataFrame, headings: DataFrame, blocks: DataFrame) -> DataFrame:
    """Where each address (source, kind, id) lies: its first and last line (null: to the note's end) and how many places answer to it.

    ``headings``: path, line, level, id, a heading once for each id it has; ``blocks``: as ``block_ranges`` gives them."""
    parts = nav.sections(headings.select("path", "line", "level").distinct()).select("path", "line", "stop").join(headings.select("path", "line", "id").distinct(), ["path", "line"])
    parts = parts.groupBy("path", "id").agg(F.count("*").alias("matches"), F.min(F.struct(F.col("line").alias("start"), "stop")).alias("at"))
    known = parts.select(F.col("path").alias("source"), F.lit("section").alias("kind"), "id", "matches", "at.start", "at.stop").unionByName(
        blocks.select(F.col("path").alias("source"), F.lit("block").alias("kind"), "id", F.lit(1).cast("bigint").alias("matches"), "start", "stop")
    )
    out = addresses.join(known, ADDRESS, "left")
    return out.withColumn("matches", F.when(F.col("kind") == "note", 1).otherwise(F.coalesce("matches", F.lit(0))).cast("bigint"))


def cuts(places: DataFrame, lines: DataFrame, embeds: DataFrame) -> DataFrame:
    """The text of each address and how many embeds inside it stay links (lines: path, line, text; embeds: path, line).

    A section has its heading, comments are expected to be gone from the lines."""
    inside = lambda rows: (F.col("source") == F.col("path")) & (F.col("start").isNull() | (F.col("line") >= F.col("start"))) & (F.col("stop").isNull() | (F.col("line") < F.col("stop")))
    shown = places.where("matches > 0")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    texts = shown.join(lines, inside(lines)).groupBy(*ADDRESS).agg(text.alias("text"))
    nested = shown.join(embeds.select("path", "line"), inside(embeds)).groupBy(*ADDRESS).agg(F.count("*").alias("nested"))
    out = places.join(texts, ADDRESS, "left").join(nested, ADDRESS, "left")
    return out.withColumns({"text": F.when(F.col("matches") > 0, F.coalesce("text", F.lit(""))), "nested": F.coalesce("nested", F.lit(0).cast("bigint"))})


def shown(embeds: DataFrame, cut: DataFrame) -> DataFrame:
    """What each embed (path, ord, target, resolution, source, markdown, kind, id) came to: one row for each that shows an excerpt of a note or says that there is none.

    ``absence`` is empty for an excerpt, else the note or the address is absent; pictures, other files and ambiguous names leave no row."""
    lost = F.col("resolution") == "unresolved"
    rows = embeds.where(lost | ((F.col("resolution") == "unique") & F.col("markdown")))
    both = rows.join(cut.select(*ADDRESS, "matches", "nested", F.sha2("text", 256).alias("digest")), ADDRESS, "left")
    absence = F.when(lost, "absent-note").when(F.col("matches") == 0, "absent-address").otherwise("")
    return both.select(
        "path", "ord", absence.alias("absence"), F.when(lost, F.col("target")).otherwise(F.col("source")).alias("source"), "kind", "id",
        F.when(lost, 0).otherwise(F.col("matches")).alias("matches"), F.when(lost, 0).otherwise(F.col("nested")).alias("nested"), F.coalesce("digest", F.lit("")).alias("digest"),
    )


def framed(c: Column) -> Column:
    """A value behind its length in bytes, in hexadecimal digits: no two lists of values give one text."""
    return F.concat(F.lpad(F.hex(F.octet_length(c)), 16, "0"), F.hex(F.encode(c, "UTF-8")))


def identities(rows: DataFrame) -> DataFrame:
    """One digest of all that a page's embeds came to, in their order; a page without any has no row."""
    value = F.concat(framed(F.col("absence")), framed(F.col("source")), framed(F.col("matches").cast("string")), framed(F.col("digest")))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("ord", value.alias("value")))), lambda x: x["value"])
    return rows.groupBy("path").agg(F.sha2(F.array_join(listed, ""), 256).alias("embeds"))


def faults(rows: DataFrame) -> DataFrame:
    """What a page tells of its embeds: no such note, no such section or block, a section there are several of (the first is shown), embeds inside that stay links."""
    missing = F.when(F.col("absence") == "absent-note", "broken").when(F.col("absence") != "", "fragment-missing").when(F.col("matches") > 1, "fragment-repeated")
    both = rows.select("path", "ord", "source", "id", F.explode(F.array(missing, F.when(F.col("nested") > 0, "not-expanded"))).alias("fault"))
    return both.where("fault is not null")


def of_notes(tables: dict[str, DataFrame], resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``shown`` and the cuts of a parsed collection (resolved: its links with paths and resolution)."""
    strip = T._udf(B.without_comments)
    lines = tables["notes"].select("path", "body_line", F.posexplode(F.split(strip("body"), "\n")).alias("at", "text")).select("path", (F.col("at") + F.col("body_line")).alias("line"), "text")
    headings = tables["headings"].select("path", "line", "level", T.section_id_udf("text").alias("id"))
    kind = F.when(F.col("block") != "", "block").when(F.col("heading") != "", "section").otherwise("note")
    named = F.when(F.col("block") != "", F.lower("block")).when(F.col("heading") != "", T.section_id_udf("heading")).otherwise("")
    only = F.when(F.col("resolution") == "unique", F.get("paths", F.lit(0)))
    embeds = resolved.where("embed").select("path", F.col("offset").alias("ord"), "line", "target", "resolution", only.alias("source"), F.coalesce(F.lower(only).endswith(".md"), F.lit(False)).alias("markdown"), kind.alias("kind"), named.alias("id"))
    asked = embeds.where("resolution = 'unique' and markdown").select(*ADDRESS).distinct()
    cut = cuts(addressed(asked, headings, block_ranges(lines, tables["blocks"])), lines, embeds)
    return shown(embeds, cut), cut
