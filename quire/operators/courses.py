"""Courses: what a study path's body declares, what it lists, and what its author has to decide.

A body's lines become rows (headings, list items with the item they hang from, other text) in one pass a note;
all that the grammar says about them is joins and aggregations over these rows. A heading from level 2 on opens a branch, and
so does a list row that carries ``{sequence=R}`` with a list beneath it, R one of primary, local and none. A list
beneath a row without a declaration is an undeclared branch of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rule ids (fixed values).
RULES = tuple(
    "course." + x
    for x in "role_missing role_duplicate role_conflict role_nested_primary local_orphan nesting_too_deep role_on_entry role_invalid role_misplaced entry_outside_branch entry_multi_target entry_noncanonical".split()
)
HEADING, ITEM = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$"), re.compile(r"([ \t]*)([-*+]|\d{1,9}[.)])([ \t]+)(.*)$")
FENCE = re.compile(r" {0,3}(```|~~~)")
ROW = "path string, line int, kind string, level int, head string, own string, more array<struct<line:int,text:string>>, parent int, above array<int>, branches array<int>"


def _rows(body: str, first: int) -> Iterator[dict]:
    """The rows of a body: kind (heading, item or text), own text, the items it hangs from and the headings it lies under."""
    headings: list[tuple[int, int]] = []  # level, line
    items: list[tuple[int, dict]] = []  # column of the content, row
    fence, blank = None, True
    for line, text in enumerate(body.split("\n"), first):
        text = text.rstrip("\r").expandtabs(4)
        if m := FENCE.match(text):
            fence = None if fence == m[1] else fence or m[1]
            continue
        if fence:
            continue
        if not text.strip():
            blank = True
            continue
        if m := HEADING.match(text):
            items.clear()
            level = len(m[1])
            row = {"line": line, "kind": "heading", "level": level, "head": m[2] or "", "own": m[2] or "", "more": [], "parent": 0, "above": []}
            if level > 1:
                while headings and headings[-1][0] >= level:
                    headings.pop()
                headings.append((level, line))
            yield row | {"branches": [n for _, n in headings]}
        elif m := ITEM.match(text):
            while items and len(m[1]) < items[-1][0]:
                items.pop()
            above = [r["line"] for _, r in items]
            row = {"line": line, "kind": "item", "level": 0, "head": m[4], "own": m[4], "more": [], "parent": above[-1] if above else 0, "above": above, "branches": [n for _, n in headings]}
            items.append((len(m[1]) + len(m[2]) + len(m[3]), row))
            yield row
        else:
            indent = len(text) - len(text.lstrip())
            if blank:
                while items and indent < items[-1][0]:
                    items.pop()
            if items:  # the row's further words
                items[-1][1]["own"] += "\n" + text.strip()
                items[-1][1]["more"].append({"line": line, "text": text.strip()})
            else:
                yield {"line": line, "kind": "text", "level": 0, "head": text.strip(), "own": text.strip(), "more": [], "parent": 0, "above": [], "branches": [n for _, n in headings]}
        blank = False


def rows(notes: DataFrame) -> DataFrame:
    """The rows of course notes (path, body, first: the file line the body begins on), with their declarations and links."""
    schema = pa.schema([
        ("path", pa.string()), ("line", pa.int32()), ("kind", pa.string()), ("level", pa.int32()), ("head", pa.string()), ("own", pa.string()),
        ("more", pa.list_(pa.struct([("line", pa.int32()), ("text", pa.string())]))), ("parent", pa.int32()), ("above", pa.list_(pa.int32())), ("branches", pa.list_(pa.int32())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, body, first in zip(*(c.to_pylist() for c in batch.columns)):
                yield pa.RecordBatch.from_pylist([{"path": path, **r} for r in [*_rows(body or "", first or 1)]], schema=schema)

    out = notes.select("path", "body", F.col("first").cast("int")).mapInArrow(run, ROW)
    head, own = _written(F.col("head")), _written(F.col("own"))
    marks = F.size(_marks(head))
    role = F.regexp_extract(head, r"\{sequence=\s*(primary|local|none)\s*\}\s*$", 1)
    decl = F.when(marks == 0, "none").when(marks > 1, "duplicate").when(~head.rlike(r"\{sequence[^}]*\}\s*$"), "misplaced").when(role == "", "invalid").otherwise("valid")
    task = F.col("head").rlike(r"^\s*\[[ xX]\](\s|$)")
    names = F.transform(F.regexp_extract_all(own, F.lit(r"(?<!!)\[\[([^\[\]|#^]+)[^\[\]]*\]\]"), F.lit(1)), lambda x: F.trim(x))
    children = out.where("kind = 'item' and parent > 0").select("path", F.col("parent").alias("line"), F.lit(True).alias("child")).distinct()
    out = out.withColumns({"decl": decl, "role": F.when(decl == "valid", role), "targets": F.when((F.col("kind") == "item") & ~task, names).otherwise(F.array().cast("array<string>")), "first": head.rlike(r"^[\s*_~]*\[\[")})
    out = out.withColumn("name", F.trim(F.when(decl == "valid", F.regexp_replace("head", r"[ \t]*\{sequence[^}]*\}\s*$", "")).otherwise(F.col("head"))))
    out = out.join(children, ["path", "line"], "left").withColumn("child", F.coalesce("child", F.lit(False)))
    return out.withColumn("container", (F.col("kind") == "item") & (F.col("decl") == "valid") & F.col("child"))


def _written(text: Column) -> Column:
    """A text without code and comments, in which nothing is declared."""
    return F.regexp_replace(F.regexp_replace(text, r"`[^`]*`", ""), r"(?s)%%.*?%%", "")


def _marks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\{sequence[^}]*\}"), F.lit(0))


def placed(rows: DataFrame) -> DataFrame:
    """Rows with what encloses them: number of side branches, whether something is out of the course, and their own branch's line, role and kind."""
    branches = rows.where("container or (kind = 'heading' and level > 1)").select("path", F.col("line").alias("at"), F.col("role").alias("of"), F.col("container").alias("nested"))
    outer = F.when(F.col("kind") == "heading", F.slice("branches", 1, F.greatest(F.size("branches") - 1, F.lit(0)))).otherwise(F.col("branches"))
    around = rows.select("path", "line", F.explode(F.concat(outer, "above")).alias("at")).join(branches, ["path", "at"])
    around = around.groupBy("path", "line").agg(F.count_if((F.col("of") == "local") & F.col("nested")).alias("side"), F.bool_or(F.coalesce(F.col("of") == "none", F.lit(False))).alias("out"), F.bool_or("nested").alias("inside"))
    parents = rows.where("kind = 'item'").select(
        "path", F.col("line").alias("parent"), F.col("container").alias("parent_opens"), F.col("role").alias("parent_role"), (~F.col("container") & (F.size("targets") == 1) & F.col("first") & (F.size("branches") > 0)).alias("parent_entry")
    )
    heads = rows.where("kind = 'heading' and level > 1").select("path", F.col("line").alias("heading"), F.col("role").alias("heading_role"))
    out = rows.withColumn("heading", F.when(F.col("kind") != "heading", F.try_element_at("branches", F.lit(-1))))
    out = out.join(around, ["path", "line"], "left").join(parents, ["path", "parent"], "left").join(heads, ["path", "heading"], "left")
    out = out.withColumns({k: F.coalesce(k, F.lit(v)) for k, v in (("side", 0), ("out", False), ("inside", False), ("parent_opens", False), ("parent_entry", False))})
    own = F.when((F.col("parent") > 0) & F.col("parent_opens"), "container").when((F.col("parent") > 0) & ~F.col("container"), "undeclared").otherwise("heading")
    return out.withColumn("lies_in", own).withColumn(
        "group_role", F.when(F.col("lies_in") == "container", F.col("parent_role")).when(F.col("lies_in") == "heading", F.col("heading_role"))
    )


def entries(placed_rows: DataFrame) -> DataFrame:
    """The units that courses list: path, line, branch (line of the heading, container or row above), role, state, target and number within the branch."""
    n = F.size("targets")
    state = F.when(F.col("container"), "role_on_entry").when(n > 1, "multi_target").when(~F.col("first"), "noncanonical").otherwise("accepted")
    listed = placed_rows.where((F.col("kind") == "item") & (n > 0) & (F.col("heading").isNotNull() | (F.col("lies_in") != "heading")))
    branch = F.when(F.col("lies_in") == "heading", F.col("heading")).otherwise(F.col("parent"))
    out = listed.select("path", "line", branch.alias("branch"), F.coalesce("group_role", F.when(F.col("out"), "none"), F.lit("undeclared")).alias("role"), state.alias("state"), F.when(n == 1, F.col("targets")[0]).alias("target"), "name")
    return out.withColumn("number", F.row_number().over(Window.partitionBy("path", "branch").orderBy("line")))


def diagnostics(placed_rows: DataFrame) -> DataFrame:
    """path, rule_id, line and evidence of everything the grammar reports."""
    x = placed_rows
    item, heading, container = F.col("kind") == "item", F.col("kind") == "heading", F.col("container")
    n, branch = F.size("targets"), F.size("branches") > 0
    plain = item & ~container
    marked = F.size(_marks(_written(F.col("head")))) > 0
    quiet = F.coalesce(F.col("group_role") == "none", F.lit(False)) | (F.col("group_role").isNull() & F.col("out"))
    nested_group = F.col("inside") | ((F.col("parent") > 0) & ~F.col("parent_opens") & ~container)
    found = {
        "role_misplaced": F.when(heading & (F.col("level") < 2), marked).when(F.col("kind") == "text", marked).otherwise((F.col("decl") == "misplaced") | (item & (F.col("decl") == "valid") & ~F.col("child"))),
        "role_duplicate": (heading & (F.col("level") > 1) | item) & (F.col("decl") == "duplicate"),
        "role_invalid": (heading & (F.col("level") > 1) | item) & (F.col("decl") == "invalid"),
        "role_on_entry": container & (n > 0),
        "nesting_too_deep": container & (F.col("role") == "local") & (F.col("side") > 0),
        "role_nested_primary": container & (F.col("role") == "primary") & (F.col("side") > 0),
        "local_orphan": container & (F.col("role") == "local") & ~F.col("parent_entry"),
        "entry_outside_branch": ~branch & ((container & ~F.col("inside")) | (plain & (n > 0) & (F.col("parent") == 0))),
        "entry_multi_target": plain & (n > 1) & (branch | nested_group) & ~quiet,
        "entry_noncanonical": plain & (n == 1) & ~F.col("first") & (branch | nested_group) & ~quiet,
        "role_conflict": ((heading & (F.col("level") > 1)) | (container & branch)) & F.col("role").isin("primary", "local") & F.col("out"),
    }
    every = F.array(*(F.when(hit, F.lit("course." + rule)) for rule, hit in found.items()))
    rule = x.select("path", "line", F.trim("head").alias("evidence"), F.explode(F.filter(every, lambda r: r.isNotNull())).alias("rule_id"))
    further = x.select("path", F.inline("more")).where(F.size(_marks(_written(F.col("text")))) > 0).select("path", "line", F.col("text").alias("evidence"), F.lit("course.role_misplaced").alias("rule_id"))
    # undeclared branches: lists beneath rows that declare nothing, and headings that list units
    beneath = x.where(item & ~container & (F.col("parent") > 0) & ~F.col("parent_opens"))
    line = F.coalesce(F.min(F.when(n > 0, F.col("line"))), F.min("line")).alias("line")
    lists = beneath.groupBy("path", "parent").agg(line, F.first("branches").alias("branches"), F.bool_or("out").alias("out"), F.max(F.size("above")).alias("depth"))
    missing = lists.where((F.size("branches") > 0) & ~F.col("out")).select("path", "line", F.lit("a nested list carrying no declaration").alias("evidence"), F.lit("course.role_missing").alias("rule_id"))
    outside = lists.where((F.size("branches") == 0) & (F.col("depth") == 1)).select("path", "line", F.lit("").alias("evidence"), F.lit("course.entry_outside_branch").alias("rule_id"))
    lists_units = x.where(item & (n > 0) & (F.col("lies_in") == "heading") & F.col("heading").isNotNull()).select("path", F.col("heading").alias("line")).distinct()
    silent = x.where(heading & (F.col("level") > 1) & F.col("role").isNull() & ~F.col("out")).join(lists_units, ["path", "line"], "left_semi")
    silent = silent.select("path", "line", F.col("name").alias("evidence"), F.lit("course.role_missing").alias("rule_id"))
    return rule.unionByName(further).unionByName(missing).unionByName(outside).unionByName(silent)


def disk_mismatch(listed: DataFrame) -> DataFrame:
    """Listed units (path, line, target, resolution, claimed, under_gap) that no note answers; a name that two files share is a collision's to report."""
    lost = (F.col("resolution") == "unresolved") | ((F.col("resolution") == "ambiguous") & ~F.col("claimed"))
    return listed.where(lost).select("path", "line", "target", F.when(F.col("under_gap"), 0).otherwise(1).alias("severity"))


def disk_unlisted(courses: DataFrame, lessons: DataFrame, listed: DataFrame) -> DataFrame:
    """Lessons (path, domain, draft) that no course (path, domain, ord) of their domain lists (listed: course, path), with the domain's first course; drafts may wait."""
    first = courses.where("domain is not null").groupBy("domain").agg(F.min_by("path", "ord").alias("course"))
    union = listed.join(courses.select(F.col("path").alias("course"), "domain"), "course").select("domain", "path").distinct()
    due = lessons.where("domain is not null and not draft").join(union, ["domain", "path"], "left_anti")
    return due.join(first, "domain").select("path", "course")
