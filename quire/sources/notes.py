"""Notes from their Markdown: frontmatter, title, links, headings, addresses, references.

One pandas UDF parses a note to one struct; a note that can't be parsed gives an error instead of
failing the task. What is code and where headings and blocks are follows from the block structure (``sources.blocks``).
"""

from __future__ import annotations

import re

import pandas as pd
import yaml
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, MapType, StringType, StructField, StructType

from quire.functions import text as T
from quire.sources import blocks as B

LINK = re.compile(r"!?\[\[([^\[\]\n]+)\]\]")
INLINE_CODE = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)
COMMENT = re.compile(r"%%.*?%%|<!--.*?-->|%%.*\Z|<!--.*\Z", re.S)
BLOCK_NAME = re.compile(r"(?:^|[ \t])(\^[A-Za-z0-9-]+)[ \t]*$")
CALLOUT = re.compile(r"^[ \t]*>[ \t]*\[!([A-Za-z-]+)\][+-]?[ \t]*(.*)$")
IMAGE = re.compile(r"!\[[^\]]*\]\(\s*<?([^)\s>]+)>?[^)]*\)")
MD_LINK = re.compile(r"(?<!!)\[[^\]]*\]\(\s*<?([^)\s>]+\.md(?:#[^)\s>]*)?)>?[^)]*\)", re.I)
CODE_PATH = re.compile(r"`([^`\s]+\.md)`", re.I)
DEFINITION = re.compile(r"^ {0,3}\[([^\]]+)\]:\s*(\S+)")
USE = re.compile(r"\[([^\]\[]+)\](?!\(|:)")
#: Plain scalars of YAML's core schema, by kind (fixed values); all others are text.
KINDS = (("null", re.compile(r"~|null|Null|NULL|")), ("bool", re.compile(r"true|True|TRUE|false|False|FALSE")), ("int", re.compile(r"[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+")),
         ("float", re.compile(r"[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN)")), ("date", re.compile(r"\d{4}-\d\d?-\d\d?(?:[Tt ][ \t]*\d\d?:\d\d:\d\d(?:\.\d*)?[ \t]*(?:Z|[-+]\d\d?(?::?\d\d)?)?)?")))

NOTE = StructType([
    StructField("has_fm", BooleanType()), StructField("unclosed_fm", BooleanType()), StructField("bad_fm", BooleanType()), StructField("body_line", IntegerType()), StructField("body", StringType()),
    StructField("fm", MapType(StringType(), StringType())), StructField("lists", MapType(StringType(), ArrayType(StringType()))), StructField("nested", ArrayType(StringType())), StructField("kinds", MapType(StringType(), StringType())),
    StructField("title", StringType()), StructField("plain", StringType()),
    StructField("plain_blocks", ArrayType(StructType([StructField("stop", IntegerType()), StructField("kind", StringType()), StructField("level", IntegerType())]))),
    *(StructField(n, ArrayType(StructType([StructField("start", IntegerType()), StructField("stop", IntegerType())]))) for n in ("fences", "hidden", "deleted")),
    StructField("links", ArrayType(StructType([StructField(n, t) for n, t in (("offset", IntegerType()), ("line", IntegerType()), ("target", StringType()), ("display", StringType()), ("heading", StringType()), ("block", StringType()), ("embed", BooleanType()), ("under_gap", BooleanType()))]))),
    StructField("headings", ArrayType(StructType([StructField(n, t) for n, t in (("line", IntegerType()), ("level", IntegerType()), ("text", StringType()), ("section_id", StringType()), ("github_anchor", StringType()))]))),
    StructField("blocks", ArrayType(StructType([StructField("line", IntegerType()), StructField("id", StringType())]))),
    StructField("path_refs", ArrayType(StructType([StructField("line", IntegerType()), StructField("destination", StringType()), StructField("code", BooleanType())]))),
    StructField("images", ArrayType(StructType([StructField("line", IntegerType()), StructField("destination", StringType())]))),
    StructField("unused_definitions", ArrayType(StringType())), StructField("planned", ArrayType(StringType())),
    StructField("callouts", ArrayType(StructType([StructField("line", IntegerType()), StructField("title", StringType()), StructField("markup", BooleanType())]))),
    StructField("error", StringType()),
])


def split_frontmatter(text: str) -> tuple[str | None, str, int, bool]:
    """Frontmatter (null without one), body, the body's first line, and whether a block was opened and never closed."""
    text = text.removeprefix("﻿")
    lines = text.splitlines(keepends=True)
    if not lines or lines[0].rstrip("\r\n") != "---":
        return None, text, 1, False
    for k, line in enumerate(lines[1:], 1):
        if line.rstrip("\r\n") in ("---", "..."):
            return "".join(lines[1:k]), "".join(lines[k + 1 :]), k + 2, False
    return None, text, 1, True


RESOLVER = yaml.SafeLoader("")


def scalar(node: yaml.ScalarNode) -> tuple[str, str]:
    """Kind and text of a scalar: an unquoted one by the core schema (or its tag), with booleans in lower case, integers as decimals and nulls empty."""
    tag, value = node.tag.removeprefix("tag:yaml.org,2002:"), node.value
    if node.style is not None:
        return "text", value
    kind = next((k for k, p in KINDS if p.fullmatch(value)), "text")
    if node.tag != RESOLVER.resolve(yaml.ScalarNode, value, (True, False)):  # a tag was written
        kind = kind if {"timestamp": "date"}.get(tag, tag) == kind else "text"
    if kind == "bool":
        return kind, value.lower()
    if kind == "int":
        return kind, str(int(value, 0) if value[:2] in ("0o", "0x") else int(value))
    return kind, "" if kind == "null" else value


def frontmatter(source: str) -> tuple[dict[str, str], dict[str, list[str]], list[str], dict[str, str], bool]:
    """Scalars and lists of strings by key, keys whose list nests a list, the kind of each value (text, bool, int, float, date, null, list, map), and whether the block is malformed."""
    try:
        node = yaml.compose(source, Loader=yaml.SafeLoader)
    except yaml.YAMLError:
        return {}, {}, [], {}, True
    if node is None:
        return {}, {}, [], {}, False
    if not isinstance(node, yaml.MappingNode) or len({k.value for k, _ in node.value if isinstance(k, yaml.ScalarNode)}) < len(node.value):
        return {}, {}, [], {}, True
    scalars, lists, nested, kinds = {}, {}, [], {}
    for key, value in node.value:
        name = key.value
        if isinstance(value, yaml.ScalarNode):
            kinds[name], scalars[name] = scalar(value)
            if scalars[name]:
                lists[name] = [scalars[name]]
        elif isinstance(value, yaml.SequenceNode):
            kinds[name], lists[name] = "list", [scalar(x)[1] for x in value.value if isinstance(x, yaml.ScalarNode)]
            if any(isinstance(x, yaml.SequenceNode) for x in value.value):
                nested.append(name)
            scalars[name] = ", ".join(lists[name])
        else:
            kinds[name], scalars[name] = "map", ""
    return scalars, lists, nested, kinds, False


def shown(body: str) -> str:
    """The body with code and comments blanked, all places kept."""
    code = B.code_lines(B.scan(body))
    lines = [" " * len(line) if k in code else line for k, line in enumerate(body.split("\n"))]
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    return COMMENT.sub(blank, INLINE_CODE.sub(blank, "\n".join(lines)))


def wikilink(inner: str) -> dict:
    """Target, display, heading and block of what stands between the brackets."""
    before, bar, after = inner.partition("|")
    if bar:
        before = before.rstrip("\\")
    name, mark, fragment = before.partition("#")
    heading, block = fragment.strip(), ""
    if mark and heading.startswith("^"):
        heading, block = "", heading[1:].strip()
    name, caret, rest = name.partition("^")
    if caret and not block:
        block = rest.strip()
    return {"target": name.strip(), "display": after.strip() if bar else inner.strip(), "heading": heading, "block": block}


def headings_of(visible: str, first: int, body: str | None = None) -> list[dict]:
    """The headings outside all containers, their texts as the body has them (``visible`` is the body without code and comments)."""
    lines, out = (visible if body is None else body).split("\n"), []
    for leaf in B.scan(visible):
        if leaf.kind == "heading" and not leaf.depth:
            own = [lines[leaf.first]] if leaf.first == leaf.last else lines[leaf.first : leaf.last]
            text = B.heading_text(B.ATX.match(own[0].strip())) if leaf.first == leaf.last else " ".join(x.strip() for x in own)
            out.append({"line": first + leaf.first, "level": leaf.level, "text": text.strip(), "at": leaf.first})
    ids, anchors = T.heading_ids([h["text"] for h in out]), T.github_anchors([h["text"] for h in out])
    return [h | {"section_id": i, "github_anchor": a} for h, i, a in zip(out, ids, anchors)]


def _without_parentheses(s: str) -> str:
    depth, out = 0, []
    for c in s:
        if c in "(（":
            depth += 1
        elif c in ")）":
            depth = max(0, depth - 1)
        elif not depth:
            out.append(c)
    return "".join(out)


def parse(text: str, stem: str, gap_marks: list[str], inline_marks: list[str]) -> dict:
    source, body, first, unclosed = split_frontmatter(text)
    fm, lists, nested, kinds, bad = frontmatter(source) if source is not None else ({}, {}, [], {}, False)
    visible = shown(body)
    headings = headings_of(visible, first, body)
    plain = B.plain_blocks(body)
    starts = [0]
    for line in visible.split("\n"):
        starts.append(starts[-1] + len(line) + 1)
    line_of = lambda at: first + visible.count("\n", 0, at)
    gaps, level = [], 0  # for each line: whether it lies in a gap section
    by_line = {h["at"]: h for h in headings}
    for k in range(len(starts) - 1):
        if h := by_line.get(k):
            if level and h["level"] <= level:
                level = 0
            if any(m in h["text"] for m in gap_marks):
                level = h["level"]
        gaps.append(bool(level))
    links = []
    for m in LINK.finditer(visible):
        before = visible[: m.start()]
        if (len(before) - len(before.rstrip("\\"))) % 2:
            continue
        link = wikilink(m[1])
        if link["target"]:
            line = line_of(m.start())
            links.append(link | {"offset": len(body[: m.start()].encode()), "line": line, "embed": m[0][0] == "!", "under_gap": gaps[line - first]})
    lines = visible.split("\n")
    planned: list[str] = []
    item: str | None = None
    for k, line in enumerate([*lines, ""]):
        in_gap = k < len(gaps) and gaps[k]
        opens = re.match(r"\s*[-*+] (.*)", line)
        if item is not None and not (in_gap and not opens and line[:1] in " \t" and line.strip()):
            planned += [p.strip() for part in _without_parentheses(item).split("、") for p in part.split(" / ") if p.strip()]
            item = None
        elif item is not None:
            item += " " + line.strip()
        if in_gap and opens:
            item = opens[1].strip()
        if any(m in line for m in inline_marks):
            planned += [t for x in LINK.finditer(line) if (t := wikilink(x[1])["target"])]
    defined = {m[1].lower(): m[0] for line in lines if (m := DEFINITION.match(line))}
    used = {x.lower() for line in lines if not DEFINITION.match(line) for x in USE.findall(line)}
    h1 = next((h["text"] for h in headings if h["level"] == 1 and h["text"]), None)
    quoted = [(first + k, m) for k, line in enumerate(lines) if (m := CALLOUT.match(line)) and m[2].strip()]
    return {
        "has_fm": source is not None, "unclosed_fm": unclosed, "bad_fm": bad, "body_line": first, "body": body, "fm": fm, "lists": lists, "nested": nested, "kinds": kinds,
        "title": h1 or fm.get("title") or stem, "plain": plain["plain"], "plain_blocks": plain["blocks"], **{k: plain[k] for k in ("fences", "hidden", "deleted")}, "links": links, "headings": headings,
        "blocks": [{"line": first + k, "id": m[1][1:].lower()} for k, line in enumerate(lines) if (m := BLOCK_NAME.search(line)) and not re.match(r"^[ \t>]*#{1,6}[ \t]*\^", line)],
        "path_refs": [{"line": line_of(m.start()), "destination": m[1], "code": False} for m in MD_LINK.finditer(visible)] + [{"line": first + body.count("\n", 0, m.start()), "destination": m[1], "code": True} for m in CODE_PATH.finditer(body)],
        "images": [{"line": line_of(m.start()), "destination": m[1]} for m in IMAGE.finditer(visible)],
        "unused_definitions": sorted(k for k in defined if k not in used), "planned": planned,
        "callouts": [{"line": n, "title": m[2].strip(), "markup": bool(re.search(r"\*\*|__|`|\[\[|\]\(|==|~~", m[2]))} for n, m in quoted], "error": None,
    }


def parsed(files: DataFrame, gap_marks: list[str] = (), inline_marks: list[str] = ()) -> DataFrame:
    """``files`` (path, content) with the parsed note in ``note``."""
    gaps, inline = list(gap_marks), list(inline_marks)

    @F.pandas_udf(NOTE)
    def run(content: pd.Series, stem: pd.Series) -> pd.DataFrame:
        rows = []
        for data, name in zip(content, stem):
            try:
                rows.append(parse(bytes(data).decode(), name, gaps, inline))
            except Exception as e:  # the note's own fault becomes its row
                rows.append({f.name: None for f in NOTE} | {"error": f"{type(e).__name__}: {e}"})
        return pd.DataFrame(rows, columns=NOTE.names)

    return files.withColumn("note", run("content", T.stem(F.col("path")))).withColumn("identity", F.sha2("content", 256)).drop("content")


def tables(notes: DataFrame) -> dict[str, DataFrame]:
    """The normalized tables of parsed notes; their columns stay pruned to what a rule reads."""
    ok = notes.where("note.error is null")
    of = lambda c: ok.select("path", F.inline(f"note.{c}"))
    base = ok.select("path", "sort_key", "mtime", "identity", "note.title", "note.plain", F.col("note.fm")["type"].alias("type"), F.col("note.fm")["slug"].alias("slug"), "note.fm", "note.lists", "note.nested", "note.kinds", "note.plain_blocks", "note.fences", "note.hidden", "note.deleted", "note.body", "note.body_line", "note.has_fm", "note.bad_fm", "note.unclosed_fm",
                     F.coalesce(F.col("note.lists")["aliases"], F.array()).alias("aliases"), F.coalesce(F.col("note.lists")["tags"], F.array()).alias("tags"))
    refs = ok.select("path", F.explode(F.map_filter("note.lists", lambda k, v: k.isin("based_on", "related", "prerequisites"))).alias("field", "values")).select("path", "field", F.posexplode("values").alias("ord", "value"))
    target = F.trim(F.regexp_replace(F.regexp_replace("value", r"^\s*!?\[\[|\]\]\s*$", ""), r"[|#^].*$", ""))
    return {
        "notes": base, "links": of("links"), "headings": of("headings"), "blocks": of("blocks"), "path_refs": of("path_refs"), "images": of("images"), "callouts": of("callouts"), "refs": refs.withColumn("target", target),
        "planned": ok.select("path", F.explode("note.planned").alias("name")), "unused_definitions": ok.select("path", F.explode("note.unused_definitions").alias("label")),
        "unreadable": notes.where("note.error is not null").select("path", F.col("note.error").alias("cause")),
    }
