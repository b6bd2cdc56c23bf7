"""Reader's marks: keeping, removing, adopting, joining to notes, and their orders (K5, K6, JN16, N8, N9).

A store is a DataFrame of marks; each operation gives the next version of it, which ``sources.stores``
writes to a new directory before it moves the pointer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

IDENTITY = ("kind", "path", "anchor", "quote")
LIMIT = 5000


def _same(a: DataFrame, b: DataFrame):
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in IDENTITY]
    return a.alias("a"), b.alias("b"), on


def keep(marks: DataFrame, new: DataFrame) -> DataFrame:
    """Adds marks that aren't there; a thought is never a duplicate."""
    a, b, on = _same(new.where("kind <> 'thought'"), marks)
    return marks.unionByName(a.join(b, on, "left_anti").select("a.*").unionByName(new.where("kind = 'thought'")))


def toggle(marks: DataFrame, new: DataFrame) -> DataFrame:
    """Removes the marks that match, adds those that don't."""
    a, b, on = _same(new, marks)
    fresh = a.join(b, on, "left_anti").select("a.*")
    c, d, on = _same(marks, new)
    return c.join(d, on, "left_anti").select("a.*").unionByName(fresh)


def remove(marks: DataFrame, ids: DataFrame) -> DataFrame:
    return marks.join(ids.select("id"), "id", "left_anti")


def revise(marks: DataFrame, changes: DataFrame) -> DataFrame:
    """Questions take a reason and a time of resolution (the first one stays), thoughts a body (changes: id, reason, body, resolved)."""
    both = marks.join(changes.select("id", F.col("reason").alias("new_reason"), F.col("body").alias("new_body"), F.col("resolved").alias("new_resolved")), "id", "left")
    question, thought = F.col("kind") == "question", F.col("kind") == "thought"
    return both.withColumns({
        "reason": F.when(question, F.coalesce("new_reason", "reason")).otherwise(F.col("reason")),
        "body": F.when(thought, F.coalesce("new_body", "body")).otherwise(F.col("body")),
        "resolved": F.when(question, F.coalesce("resolved", "new_resolved")).otherwise(F.col("resolved")),
    }).select(marks.columns)


def adopt(held: DataFrame, theirs: DataFrame, readable: DataFrame) -> DataFrame:
    """Rows of an earlier store whose note can be read, unless the id is held, or the identity is and it isn't a thought."""
    able = theirs.join(readable.select("path").distinct(), "path", "left_semi").join(held.select("id"), "id", "left_anti")
    return keep(held, able.select(held.columns))


def joined(marks: DataFrame, notes: DataFrame) -> DataFrame:
    """Whether each mark (path, quote) is located, its place is lost, or its note is."""
    both = marks.join(notes.select("path", F.col("text").alias("note_text")), "path", "left")
    state = F.when(F.col("note_text").isNull(), "note lost").when(F.col("note_text").contains(F.col("quote")), "located").otherwise("location lost")
    return both.withColumn("state", state).drop("note_text")


def newest(items: DataFrame) -> DataFrame:
    return items.orderBy(F.desc_nulls_last("at"), "sort_key", "anchor")


def oldest(items: DataFrame) -> DataFrame:
    return items.orderBy(F.asc_nulls_last("at"), "sort_key", "anchor")


def open_items(marks: DataFrame, drafts: DataFrame) -> DataFrame:
    """Unresolved questions and thoughts, and draft notes as thoughts."""
    return marks.where("resolved is null and kind in ('question', 'thought')").unionByName(drafts, allowMissingColumns=True)
