"""Health of a collection: the kinds of trouble in fixed order, a row for each note and target."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

KINDS = ("blocked", "skipped", "navigation fault", "unwritten", "title only", "island", "unreadable frontmatter", "schema fault", "collision")


def rows_of(parts: dict[int, DataFrame]) -> DataFrame:
    """The kinds' rows (path, target), each note and target once a kind."""
    out = None
    for kind, rows in sorted(parts.items()):
        own = rows.select(F.lit(kind).alias("kind"), "path", "target").dropDuplicates(["path", "target"])
        out = own if out is None else out.unionByName(own)
    return out


def table(rows: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """By kind, then the chosen column."""
    return rows.orderBy("kind", F.desc(column) if descending else F.asc(column), "path", "target")


def islands(notes: DataFrame, backlinks: DataFrame, folder) -> DataFrame:
    """Uncited notes by folder, largest first."""
    alone = notes.join(backlinks.select(F.col("target").alias("path")).distinct(), "path", "left_anti")
    return alone.groupBy(folder.alias("folder")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("path")).alias("notes")).orderBy(F.desc("n"), "folder")
