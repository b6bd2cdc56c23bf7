"""Figures: whether an HTML file may be shown in a frame, and what pins its inline scripts.

A figure is read as tokens twice, with scripting off and on: what stands in a noscript element is markup in the first reading and text in the
second. Tokens are judged, not a repaired tree: a tag that a browser would drop (a frame outside a frameset) is refused as well.
"""

from __future__ import annotations

import base64
import hashlib
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

LIMIT = 1 << 20  # bytes
#: Elements that frame another document, elements that fetch or move addresses, what a meta element may declare, and the kinds of script that a hash pins (fixed values).
FRAMES = frozenset("iframe frame frameset embed object fencedframe portal".split())
FETCHING = frozenset("link base".split())
DECLARED = frozenset("content-type content-language content-security-policy".split())
SCRIPTS = frozenset(["", "module", "text/javascript", "application/javascript", "application/ecmascript", "application/x-ecmascript", "application/x-javascript", "text/ecmascript", *(f"text/javascript1.{k}" for k in range(6)), "text/jscript", "text/livescript", "text/x-ecmascript", "text/x-javascript"])
#: Elements whose content is text (fixed values); noscript is one with scripting on.
RAW = frozenset("script style title textarea xmp noembed noframes iframe".split())


def tag_fault(name: str, own: dict[str, str]) -> tuple[str, str] | None:
    """Verdict and detail of a refused tag, by its name first and then by its attributes in order."""
    word = lambda k: own[k].strip().lower()
    if name in FRAMES:
        return "nested-frame", f"<{name}>"
    if name in FETCHING:
        return "loads-elsewhere", f"<{name}>"
    if name == "meta" and "http-equiv" in own and word("http-equiv") not in DECLARED:
        return "loads-elsewhere", f'<meta http-equiv="{word("http-equiv")}">'
    if name == "script":
        if key := next((k for k in ("src", "href", "xlink:href") if k in own), None):
            return "script-outside-text", f"<script {key}>"
        if "type" in own and word("type") not in SCRIPTS:
            return "script-outside-text", f'<script type="{word("type")}">'
    for key, value in own.items():
        if key in ("ping", "attributionsrc"):
            return "loads-elsewhere", key
        if key.startswith("on"):
            return "script-outside-text", key
        if "javascript:" in value.translate({9: None, 10: None, 13: None}).lower():
            return "script-outside-text", "javascript:"
    return None


class Reading(HTMLParser):
    """One pass over the tokens: the first fault and the texts of the scripts."""

    def __init__(self, scripting: bool):
        super().__init__(convert_charrefs=True)
        self.raw = RAW | {"noscript"} if scripting else RAW
        self.fault: tuple[str, str] | None = None
        self.scripts: list[str] = []
        self.inside = False

    def handle_starttag(self, tag, attrs):
        own: dict[str, str] = {}
        for key, value in attrs:
            own.setdefault(key, value or "")  # of a repeated attribute the first counts
        self.fault = self.fault or tag_fault(tag, own)
        if tag in self.raw:
            self.set_cdata_mode(tag)
        self.inside = tag == "script"
        if self.inside:
            self.scripts.append("")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # the slash means nothing in HTML

    def handle_endtag(self, tag):
        self.inside = False

    def handle_data(self, data):
        if self.inside:
            self.scripts[-1] += data


def inspect(data: bytes) -> tuple[str, str, list[str]]:
    """Verdict, the markup it is for, and the policy hash of each different inline script in order."""
    if len(data) > LIMIT:
        return "too-large", "", []
    if data[:2] in (b"\xfe\xff", b"\xff\xfe"):
        return "utf-16", "", []
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return "not-text", "", []
    if "\0" in text:
        return "not-text", "", []
    for scripting in (False, True):
        reading = Reading(scripting)
        reading.feed(text.replace("\r\n", "\n").replace("\r", "\n"))
        reading.close()
        if reading.fault:
            return *reading.fault, []
    pins = (base64.b64encode(hashlib.sha256(s.encode()).digest()).decode() for s in reading.scripts)
    return "served", "", list(dict.fromkeys(f"'sha256-{p}'" for p in pins))


FOUND = StructType([StructField("verdict", StringType()), StructField("detail", StringType()), StructField("scripts", ArrayType(StringType()))])


@F.pandas_udf(FOUND)
def inspect_udf(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([inspect(bytes(x)) for x in data], columns=FOUND.names)


def inspected(figures: DataFrame, data: Column) -> DataFrame:
    """``figures`` with verdict (served, too-large, utf-16, not-text, nested-frame, loads-elsewhere, script-outside-text), detail and scripts; a null file is an empty one.

    Files over the limit are judged by their size alone and never sent to Python."""
    size = F.coalesce(F.octet_length(data), F.lit(0))
    short = F.when(size <= LIMIT, F.coalesce(data, F.lit(b""))).otherwise(F.lit(b""))
    out = figures.withColumns({"_large": size > LIMIT, "_found": inspect_udf(short)})
    return out.select(*figures.columns, F.when(F.col("_large"), "too-large").otherwise(F.col("_found.verdict")).alias("verdict"), F.col("_found.detail").alias("detail"), F.col("_found.scripts").alias("scripts"))
