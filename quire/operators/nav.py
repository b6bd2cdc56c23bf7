"""Navigation: trees, reading sequences, neighbours, calendars and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.functions import text as T
from quire.operators.resolve import cut, dealt


def neighbours(items: DataFrame, group: list[str], order: list[str], item: str) -> DataFrame:
    """Previous and next item inside each group, over the first occurrence of every item."""
    first = Window.partitionBy(*group, item).orderBy(*order)
    line = Window.partitionBy(*group).orderBy(*order)
    kept = items.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")
    return kept.withColumn("previous", F.lag(item).over(line)).withColumn("next", F.lead(item).over(line))


def numbered(items: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    return items.withColumn("number", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def placed(items: DataFrame, group: list[str], order: list[str], item: str) -> DataFrame:
    """Each item's number, the size of its group and the group's first and last item."""
    line = Window.partitionBy(*group).orderBy(*order)
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return items.withColumn("number", F.row_number().over(line)).withColumn("size", F.count("*").over(whole)).withColumn("first", F.first(item).over(whole)).withColumn("last", F.last(item).over(whole))


def folder_counts(notes: DataFrame) -> DataFrame:
    """Notes below each folder at every depth, and the latest change among them."""
    return notes.select(F.explode(T.ancestors(F.col("path"))).alias("folder"), "mtime").groupBy("folder").agg(F.count("*").alias("n"), F.max("mtime").alias("latest"))


def tree(notes: DataFrame) -> DataFrame:
    """The folders as an adjacency table: folder, parent, depth, notes directly inside."""
    inside = notes.groupBy(T.folder(F.col("path")).alias("folder")).agg(F.count("*").alias("own"))
    every = notes.select(F.explode(T.ancestors(F.col("path"))).alias("folder")).distinct().join(inside, "folder", "left")
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    return every.select("folder", F.when(depth > 0, T.folder(F.col("folder"))).alias("parent"), depth.alias("depth"), F.coalesce("own", F.lit(0)).alias("own"))


def shared_titles(notes: DataFrame) -> DataFrame:
    """How a title that several notes share is told apart: by date where that is unique in the group, else by file name."""
    n = F.count("*").over(Window.partitionBy("title"))
    same_day = F.count("*").over(Window.partitionBy("title", "day"))
    return notes.withColumn("qualifier", F.when(n == 1, None).when(F.col("day").isNotNull() & (same_day == 1), F.date_format("day", "yyyy-MM-dd")).otherwise(T.file_name(F.col("path"))))


def months(notes: DataFrame) -> DataFrame:
    """Notes of each month; those without a day under null."""
    return notes.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def nearest_months(counts: DataFrame) -> DataFrame:
    """The months with notes and the nearest such months before and after (a row a month: one small window)."""
    line = Window.orderBy("month")
    return counts.where("month is not null").withColumn("before", F.lag("month").over(line)).withColumn("after", F.lead("month").over(line))


def calendar(days: DataFrame, month: str) -> DataFrame:
    """The days of a month with their week (Monday first) and number of notes."""
    first = F.to_date(F.lit(month + "-01"))
    grid = days.sparkSession.range(1).select(F.explode(F.sequence(first, F.last_day(first))).alias("day"))
    counts = days.groupBy("day").agg(F.count("*").alias("n"))
    lead = F.weekday(first)
    return grid.join(counts, "day", "left").select("day", F.weekday("day").alias("weekday"), F.floor((F.dayofmonth("day") - 1 + lead) / 7).cast("int").alias("week"), F.coalesce("n", F.lit(0)).alias("n"))


def pages(rows: DataFrame, order: list, size: int = 25) -> DataFrame:
    """Page numbers by order; ranges are counted in parallel, so that no single task sorts all rows."""
    # cut off, so that both readers see the same ranges
    ranged = cut(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    counts = ranged.groupBy("range").agg(F.count("*").alias("n"))
    offsets = counts.withColumn("before", F.sum("n").over(Window.orderBy("range")) - F.col("n")).drop("n")  # a row a range
    position = F.row_number().over(Window.partitionBy("range").orderBy(*order)) + F.col("before")
    return ranged.join(F.broadcast(offsets), "range").withColumn("position", position).drop("range", "before").withColumn("page", F.ceil(F.col("position") / size))


def pager(total: int, page: int, size: int = 25, around: int = 2) -> dict:
    """The page shown and the numbers around it."""
    last = max(1, -(-total // size))
    page = min(max(page, 1), last)
    return {"page": page, "last": last, "shown": list(range(max(1, page - around), min(last, page + around) + 1))}


def prefix_groups(titles: DataFrame, least: int = 3) -> DataFrame:
    """The text before a colon or bar, where at least ``least`` titles share it."""
    prefix = F.trim(F.nullif(F.regexp_extract("title", r"^([^:：｜]+)[:：｜]", 1), F.lit("")))
    own = titles.withColumn("prefix", prefix)
    # counts are small and aggregate before they are shuffled; titles without a prefix never meet
    shared = own.where("prefix is not null").groupBy("prefix").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("prefix", F.lit(True).alias("shared"))
    return own.join(shared, "prefix", "left").withColumn("prefix", F.when(F.col("shared"), F.col("prefix"))).drop("shared")


def list_shape(rows: DataFrame) -> DataFrame:
    """Whether a list has three days or more, and whether more than half of its titles start with a number."""
    return rows.groupBy("folder").agg((F.count_distinct("day") >= 3).alias("dated"), (F.avg(F.col("title").rlike(r"^\d").cast("double")) > 0.5).alias("numbered"))


def month_headings(rows: DataFrame, least: int = 20) -> DataFrame:
    """Rows of a folder that open a new month, in lists longer than ``least``."""
    line = Window.partitionBy("folder").orderBy(F.desc_nulls_last("day"), "path")
    month = F.date_format("day", "yyyy-MM")
    new = F.coalesce(F.lag(month).over(line) != month, F.lit(True))
    return rows.withColumn("heading", F.when((F.count("*").over(Window.partitionBy("folder")) > least) & new, month))


def sections(headings: DataFrame) -> DataFrame:
    """Where each section ends: before the next heading of the same or a higher level (headings: path, line, level)."""
    rest = Window.partitionBy("path").orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, -1)
    # from the end of the note upwards: for each level the last heading seen that is as high
    stop = F.coalesce(*(F.when(F.col("level") == k, F.last(F.when(F.col("level") <= k, F.col("line")), ignorenulls=True).over(rest)) for k in range(1, 7)))
    return headings.select("path", "line", "level", stop.alias("stop"))


def excerpts(lines: DataFrame, headings: DataFrame, wanted: DataFrame) -> DataFrame:
    """The text below the first heading that has a wanted id, up to the next one as high (lines: path, line, text; headings: path, line, level, id; wanted: path, id),
    with the number of its lines and of headings that have the id."""
    found = sections(headings).join(headings.select("path", "line", "id"), ["path", "line"]).join(wanted, ["path", "id"])
    first = found.groupBy("path", "id").agg(F.min(F.struct("line", "stop")).alias("at"), F.count("*").alias("matches")).select("path", "id", "matches", F.col("at.line").alias("start"), "at.stop")
    inside = (F.col("line") > F.col("start")) & (F.col("stop").isNull() | (F.col("line") < F.col("stop")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(inside, F.struct("line", "text")))), lambda x: x["text"]), "\n")
    return first.join(lines, "path").groupBy("path", "id", "matches").agg(F.count_if(inside).alias("lines"), text.alias("excerpt"))


def map_branches(headings: DataFrame, links: DataFrame) -> DataFrame:
    """The branches of maps (headings from level 2 on: path, line, level, heading; links: path, line, target): links of their own and with all branches below."""
    parts = sections(headings).join(headings.select("path", "line", "heading"), ["path", "line"])
    own = placements(headings, links).groupBy("path", F.col("at").alias("line")).agg(F.count("*").alias("own"))
    # a branch reaches as far as its section: sums over the branches between
    counted = parts.join(own, ["path", "line"], "left").withColumn("own", F.coalesce("own", F.lit(0)))
    total = F.sum("own").over(Window.partitionBy("path").orderBy("line")) - F.col("own")  # of all branches before
    sums = counted.withColumn("before", total)
    ends = sums.select("path", F.col("line").alias("stop"), F.col("before").alias("until"))
    whole = sums.groupBy("path").agg(F.sum("own").alias("whole"))
    out = sums.join(ends, ["path", "stop"], "left").join(whole, "path")
    return out.select("path", "line", "level", "heading", "own", (F.coalesce("until", "whole") - F.col("before")).alias("below"))


def placements(headings: DataFrame, links: DataFrame) -> DataFrame:
    """Where maps place notes: each link with the nearest heading above it."""
    rows = headings.select("path", "line", F.lit(None).cast(links.schema["target"].dataType).alias("target"), F.col("line").alias("at"), "heading")
    rows = rows.unionByName(links.select("path", "line", "target"), allowMissingColumns=True)
    line = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt(rows, "path").withColumns({"at": F.last("at", ignorenulls=True).over(line), "heading": F.last("heading", ignorenulls=True).over(line)})
    return placed.where("target is not null and at is not null")


def journal(notes: DataFrame, folder: str) -> DataFrame:
    """The notes of the journal's folder with the day that their name begins with; newest first is by day and path, both descending."""
    return notes.where(F.lower("path").startswith(folder.lower() + "/")).withColumn("day", T.leading_date(T.file_name(F.col("path"))))


def directories(notes: DataFrame) -> DataFrame:
    """The notes directly in each folder, in order: a folder's notes are each other's siblings."""
    return notes.groupBy(T.folder(F.col("path")).alias("folder")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("path")).alias("notes"))


def author_order(notes: DataFrame) -> DataFrame:
    """The order that numbers before file names give (digits, then a hyphen, underscore, dot or space); notes without a number come last, by path."""
    digits = F.nullif(F.regexp_extract(T.file_name(F.col("path")), r"^([0-9]+)[-_. ]", 1), F.lit(""))
    bare = F.regexp_replace(digits, "^0+", "")
    line = Window.partitionBy("folder").orderBy(F.asc_nulls_last(F.char_length(bare)), F.asc_nulls_last(bare), "path")
    return notes.withColumn("place", F.row_number().over(line))


def heading_above(rows: DataFrame) -> DataFrame:
    """For each link the nearest heading above it (rows: path, offset, heading or null)."""
    line = Window.partitionBy("path").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("branch", F.last("heading", ignorenulls=True).over(line))


def teaching_path(courses: DataFrame, notes: DataFrame) -> DataFrame:
    """The course of each note: the only one there is, else the only one of its domain."""
    total = courses.agg(F.count("*").alias("total"), F.min("path").alias("sole"))
    by_domain = courses.groupBy("domain").agg(F.count("*").alias("n"), F.min("path").alias("own"))
    out = notes.join(by_domain, "domain", "left").crossJoin(F.broadcast(total))  # one row
    return out.select("path", F.when(F.col("total") == 1, F.col("sole")).when(F.col("n") == 1, F.col("own")).alias("course"))


def course_counts(items: DataFrame) -> DataFrame:
    """Counters of a course (items: course, branch, state, draft)."""
    return items.groupBy("course").agg(
        F.count("*").alias("items"), F.count_if(F.col("state") == "planned").alias("planned"), F.count_distinct("branch").alias("branches"), F.count_if("draft").alias("drafts")
    )


def entry_state(resolution: Column, non_instance: Column, path: Column) -> Column:
    """The state of a course entry."""
    return F.when(resolution != "unique", resolution).when(non_instance, "non-instance").otherwise("resolved")


def lifecycle_order(folder: Column, declared: list[str]) -> Column:
    """Rank of a top folder; unlisted ones last."""
    at = F.array_position(F.array(*map(F.lit, declared)), folder)
    return F.when(at > 0, at).otherwise(len(declared) + 1)
