"""Scanning a folder of notes: what is there, what is left out and why.

The driver lists (names and sizes only); the contents are read by Spark's binaryFile source.
"""

from __future__ import annotations

import os
import re
import stat
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.functions import text as T
from quire.sources.contract import Contract

FILE = "path string, raw_path string, ext string, size bigint, mtime timestamp, is_md boolean, sort_key string"
LIMIT = 1 << 20


class CollisionError(ValueError):
    """Two files whose names differ only in Unicode composition."""


def glob_pattern(pattern: str) -> str:
    """A path pattern (* and ? inside a segment, [..] classes) as a regular expression."""
    out = ""
    for m in re.finditer(r"\*|\?|\[\^?[^\]]*\]|\\.|.", pattern):
        x = m[0]
        out += {"*": "[^/]*", "?": "[^/]"}.get(x, x if x[0] == "[" and len(x) > 1 else re.escape(x[-1]))
    return out


@dataclass
class Rule:
    pattern: re.Pattern
    keep: bool
    folders_only: bool


def ignore_rules(text: str) -> list[Rule]:
    """The rules of a .gitignore at the root."""
    rules = []
    for line in text[:LIMIT].splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        line = line[1:] if keep else line.removeprefix("\\")
        folders = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        body = "".join({"**": ".*", "**/": "(?:.*/)?"}.get(part, glob_pattern(part)) for part in re.split(r"(\*\*/?)", line.lstrip("/")) if part)
        rules.append(Rule(re.compile(("" if anchored else "(?:.*/)?") + body + "$"), keep, folders))
    return rules


def ignored(rules: list[Rule], path: str, is_folder: bool) -> bool:
    """The last rule that matches decides."""
    for rule in reversed(rules):
        if (is_folder or not rule.folders_only) and rule.pattern.match(path):
            return not rule.keep
    return False


@dataclass
class Scan:
    root: str
    files: list[tuple] = field(default_factory=list)
    skipped: list[tuple[str, str]] = field(default_factory=list)
    problems: list[tuple[str, str]] = field(default_factory=list)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.files, FILE)

    def skipped_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.skipped, "path string, kind string")

    def unreadable_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.problems, "path string, cause string")


def outside(contract: Contract | None, path: str) -> bool:
    """Whether a folder is declared to lie outside the scan."""
    return bool(contract) and any(re.fullmatch(glob_pattern(p), path) for p in contract.ignored)


def scan(root: str, contract: Contract | None = None, complete: bool = True) -> Scan:
    """Lists the collection; ``complete`` fails on the first trouble, else troubles become rows."""
    out = Scan(root)
    rules: list[Rule] = []
    if os.path.isfile(p := os.path.join(root, ".gitignore")):
        with open(p, errors="replace") as f:
            rules = ignore_rules(f.read(LIMIT))
    seen: dict[str, str] = {}
    todo = [""]
    while todo:
        folder = todo.pop()
        try:
            entries = sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name)
        except OSError as e:
            if complete:
                raise
            out.problems.append((folder, str(e.strerror)))
            continue
        if any(e.name == "pyvenv.cfg" for e in entries) and folder:
            continue
        for e in entries:
            raw = f"{folder}/{e.name}" if folder else e.name
            path = T.nfc(raw)
            if e.name.startswith(".") or e.name == "node_modules":
                continue
            try:
                info = e.stat(follow_symlinks=False)
            except OSError as x:
                if complete:
                    raise
                out.problems.append((path, str(x.strerror)))
                continue
            if ignored(rules, path, stat.S_ISDIR(info.st_mode)):
                continue
            if stat.S_ISLNK(info.st_mode):
                out.skipped.append((path, "symbolic link"))
            elif stat.S_ISDIR(info.st_mode):
                if not outside(contract, path):
                    todo.append(raw)
            elif not stat.S_ISREG(info.st_mode):
                out.skipped.append((path, "not a regular file"))
            elif contract and e.name in contract.skipped_files:
                continue
            else:
                if path in seen:
                    raise CollisionError(f"{seen[path]!r} and {raw!r} are one name")
                seen[path] = raw
                is_md = e.name.lower().endswith(".md")
                if is_md and info.st_size > LIMIT:
                    out.skipped.append((path, "over the source bound"))
                    continue
                out.files.append((path, raw, os.path.splitext(e.name)[1].lower(), info.st_size, datetime.fromtimestamp(info.st_mtime, timezone.utc), is_md, T.sort_key(path)))
    out.files.sort(key=lambda f: f[-1])
    return out


def contents(spark: SparkSession, found: Scan) -> DataFrame:
    """path and content of the notes of a scan, read in parallel."""
    files = found.frame(spark).where("is_md").select("path", "raw_path", "mtime", "sort_key")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[mM][dD]").load(found.root)
    root = os.path.abspath(found.root)
    # the source writes the root as a URI of one or three slashes
    relative = F.substring(F.regexp_replace(F.col("path"), "^file:/+", "/"), len(root) + 2, 1 << 20)
    bodies = read.where(F.col("length") <= LIMIT).select(F.try_url_decode(F.replace(relative, F.lit("+"), F.lit("%2B"))).alias("raw_path"), "content")
    return files.join(bodies, "raw_path").drop("raw_path")
