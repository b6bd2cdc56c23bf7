"""Text functions of linked-note collections, as pandas UDFs and as column expressions.

``register(spark)`` makes the UDFs callable from SQL. What Catalyst can express (suffixes,
ancestors, whitespace, edit distance, dates) is a column expression and stays in codegen.
"""

from __future__ import annotations

import posixpath
import re
import unicodedata
import urllib.parse
from collections import defaultdict
from itertools import chain, count

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

# ------------------------------------------------------------- plain functions


def nfc(s: str) -> str:
    return s if s.isascii() else unicodedata.normalize("NFC", s)


def rune_lower(s: str) -> str:
    """Lower case character by character: no context, no expansion."""
    if s.isascii():
        return s.lower()
    return "".join(x if len(x := c.lower()) == 1 else {"İ": "i"}.get(c, c) for c in s)


def name_key(s: str) -> str:
    """The key under which a name resolves."""
    return rune_lower(nfc(s.strip()))


_ORBITS: dict[str, str] = {}


def _orbits() -> dict[str, str]:
    """The characters that differ only by simple case, each with the one that stands for all of them."""
    if not _ORBITS:
        groups: dict[str, set[str]] = {}
        for c in map(chr, range(0x80, 0x1E944)):
            peers = {x for x in (c.lower(), c.upper(), c.casefold()) if len(x) == 1} | {c}
            if len(peers) > 1 and c != "İ":
                merged = set().union(*(groups.get(p, {p}) for p in peers))
                for p in merged:
                    groups[p] = merged
        for c, peers in groups.items():
            least = min(peers, key=lambda x: (not x.isalpha(), x))
            lower = least.lower()
            _ORBITS[c] = lower if lower in peers else least
    return _ORBITS


SPACELESS = regex.compile(r"(?<=[\p{Han}\p{Hiragana}\p{Katakana}])\n(?=[\p{Han}\p{Hiragana}\p{Katakana}])")
WIDE = {0xFF01 + k: 0x21 + k for k in range(94)}


def fold(s: str) -> str:
    """The search fold: NFC, no line break inside scripts without spaces, narrow ASCII, simple case."""
    if s.isascii():
        return s.lower()
    s = SPACELESS.sub("", nfc(s)).translate(WIDE)
    table = _orbits()
    return "".join(c.lower() if c < "\x80" else table.get(c, c) for c in s)


def fold_fragment(s: str) -> str:
    return nfc(rune_lower(nfc(s)))


KEPT = regex.compile(r"(?:[\p{L}\p{N}](?:(?![\p{Me}︎️])\p{M})*)+")


def section_id(name: str) -> str:
    return "-".join(KEPT.findall(fold_fragment(name))) or "section"


def github_slug(name: str) -> str:
    return regex.sub(r"[^\p{L}\p{M}\p{N}\p{Pc} -]", "", rune_lower(name)).replace(" ", "-")


def github_anchors(names: list[str]) -> list[str]:
    """Anchors of headings in order: the slug, or where that is taken the slug with the least number that is free."""
    taken: set[str] = set()
    out = []
    numbers = defaultdict(lambda: count(1))  # none below has become free again
    for base in map(github_slug, names):
        taken.add(free := next(x for x in chain([base], (f"{base}-{n}" for n in numbers[base])) if x not in taken))
        out.append(fold_fragment(free))
    return out


def heading_ids(names: list[str]) -> list[str]:
    """Ids of a page's headings: the section id, with a number from the second time on."""
    seen: dict[str, int] = {}
    out = []
    for base in map(section_id, names):
        seen[base] = seen.get(base, 0) + 1
        out.append(base if seen[base] == 1 else f"{base}-{seen[base]}")
    return out


def fingerprint(*parts: str) -> str:
    """FNV-1a over the parts, each closed by the unit separator."""
    h = 0xCBF29CE484222325
    for b in b"".join(p.encode() + b"\x1f" for p in parts):
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return f"v1:{h:016x}"


#: Numerals and what may follow a numbering one (fixed values).
DIGITS = dict(zip("〇零一二三四五六七八九", (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9)))
UNITS = {"十": 10, "百": 100, "千": 1000}
NUMERAL = re.compile("[" + "".join([*DIGITS, *UNITS]) + "]+|[0-9]+")
SEPARATORS, COUNTERS = frozenset("、.．-_ "), frozenset("章課節篇回話卷部期講")


#: A unit with the digit before it, or the last digit.
PLACES = re.compile(f"([{''.join(DIGITS)}]?)([{''.join(UNITS)}])|([{''.join(DIGITS)}])$")


def numeral(s: str) -> int:
    """The number of a numeral: its units by their digits (one without a digit counts once) and the last digit."""
    if s[0].isascii():
        return int(s[:13])
    return sum((DIGITS.get(m[1]) or 1) * UNITS[m[2]] if m[2] else DIGITS[m[3]] for m in PLACES.finditer(s))


def _part_key(s: str) -> str:
    out, at = [], 0
    while at < len(s):
        if m := NUMERAL.match(s, at):
            end = m.end()
            if s[at].isascii() or at and s[at - 1] == "第" or end == len(s) or s[end] in SEPARATORS or s[end] in COUNTERS or s.startswith("單元", end):
                out.append(f"1{numeral(m[0]):014d}")
                at = end
                continue
        out.append(f"2{ord(min(_orbits().get(s[at], s[at]), s[at].upper() if len(s[at].upper()) == 1 else s[at])):06x}")
        at += 1
    return "".join(out) + "0"


def sort_key(path: str) -> str:
    """A string whose order is the natural order of paths: numbers by value before text, folders before their files' names end, spelling last."""
    parts = path.split("/")
    key = ""
    for k, part in enumerate(parts):
        dot = part.rfind(".")
        stem, ext = (part[:dot], part[dot:]) if dot >= 0 else (part, "")
        key += _part_key(stem) + _part_key(ext) + ("1" if k + 1 < len(parts) else "0")
    return key + path


def percent_decoded(s: str) -> str | None:
    """Once decoded; None if malformed. A plus sign stays."""
    if re.search(r"%(?![0-9A-Fa-f]{2})", s):
        return None
    try:
        return urllib.parse.unquote_to_bytes(s).decode()
    except UnicodeDecodeError:
        return None


def markdown_path(source: str, destination: str, outside: bool = False) -> str | None:
    """The collection path that a note's relative link names; None if it isn't a local path inside (``outside``: or outside)."""
    raw = re.split(r"[?#]", destination, maxsplit=1)[0]
    if not raw or raw.startswith(("/", "\\")) or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", raw):
        return None
    decoded = percent_decoded(raw)
    if not decoded or decoded.startswith("/") or re.search(r"[\x00-\x1f\x7f-\x9f\\]", decoded):
        return None
    path = nfc(posixpath.normpath(posixpath.join(posixpath.dirname(source), decoded)))
    return None if OUTSIDE.match(path) and not outside else path


#: Paths that leave the collection.
OUTSIDE = re.compile(r"\.\.(?:/|$)")


LANGUAGE = re.compile(r"(?P<l>[A-Za-z]{2,3}|[A-Za-z]{5,8})(?:-(?P<s>[A-Za-z]{4}))?(?:-(?P<r>[A-Za-z]{2}|[0-9]{3}))?(?P<v>(?:-(?:[A-Za-z0-9]{5,8}|[0-9][A-Za-z0-9]{3}))*)$")


def language_tag(s: str) -> str | None:
    """The canonical spelling of a language tag; None if it isn't one."""
    m = LANGUAGE.match(s.strip())
    return "-".join(x for x in (m["l"].lower(), (m["s"] or "").title(), (m["r"] or "").upper(), m["v"].lower().strip("-")) if x) if m else None


def split_runs(term: str) -> str:
    """A term with a space wherever letters meet digits; empty if nothing changes or a run would be a single character."""
    runs = re.sub(r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])", " ", term)
    return runs if runs != term and all(len(x.encode()) > 1 for x in runs.split(" ")) else ""


IGNORED = regex.compile(r"[\p{Default_Ignorable_Code_Point}\p{Cf}]")
SLASHES = str.maketrans(dict.fromkeys("⁄∕⧸／╱\\", "/"))


def undisguised(text: str) -> str:
    """Entities and percent signs decoded to a fixed point (four rounds at most), compatibility forms, no invisible characters, plain slashes, lower case."""
    import html

    for _ in range(4):
        new = html.unescape(text)
        new = re.sub(r"(?:%[0-9A-Fa-f]{2})+", lambda m: urllib.parse.unquote(m[0]), new)
        if new == text:
            break
        text = new
    return rune_lower(IGNORED.sub("", unicodedata.normalize("NFKC", text)).translate(SLASHES))


def spells(text: str, directories: list[str]) -> bool:
    """Whether a text spells a path at or below one of some directories, however disguised."""
    plain = undisguised(text)
    for d in map(undisguised, directories):
        if re.search(rf"(?<![\w-]){re.escape(d)}(?![\w-])", plain):
            return True
    return False


class Folded:
    """The search fold of a text with the way back: where in the text each character of the fold came from.

    Where folding moves nothing, no map is kept; else ``at`` has the places of the fold's characters and the text's length last."""

    def __init__(self, source: str) -> None:
        self.source, self.text, self.at = source, fold(source), None
        if source.isascii() or (len(self.text) == len(source) and unicodedata.is_normalized("NFC", source)):
            return
        at: list[int] = []
        dropped = {m.start() for m in SPACELESS.finditer(nfc(source))}
        done = 0  # characters of the normal form so far
        for m in regex.finditer(r"\X", source):
            for k, c in enumerate(normal := nfc(m[0])):
                if done + k not in dropped:
                    at.append(m.start() + (k if len(normal) == len(m[0]) else 0))
            done += len(normal)
        self.at = np.array([*at, len(source)])

    def start(self, place: int) -> int:
        """The place in the text where the fold's character at ``place`` begins."""
        return place if self.at is None else int(self.at[place])

    def stop(self, place: int) -> int:
        """The place in the text where what ends at ``place`` in the fold ends: with the character before it, and whatever folds into that."""
        if self.at is None or place == 0:
            return place
        following = int(self.at[place])
        last = int(self.at[place - 1])
        return following if "\n" not in self.source[last:following] else last + len(self.source[last:following].split("\n")[0])


def phrases(folded: str, token: str):
    """The places of a token in a folded text, overlapping ones included; blanks of a token stand for any white space."""
    if token.split() == [token]:
        at = folded.find(token)
        while at >= 0:
            yield at, at + len(token)
            at = folded.find(token, at + 1)
        return
    pattern = re.compile("(?=(" + r"\s+".join(map(re.escape, re.split(r"\s+", token))) + "))")
    for m in pattern.finditer(folded):
        yield m.span(1)


def hit_runs(text: str, tokens: list[str]) -> list[tuple[str, bool]]:
    """A text as runs, those that some token matches marked; what is found in the fold is marked in the text itself. Hits that overlap are one run, hits that only touch are two."""
    folded = Folded(text)
    found = sorted((folded.start(i), folded.stop(j)) for token in filter(str.strip, tokens) for i, j in phrases(folded.text, token))
    hits: list[list[int]] = []
    for start, stop in found:
        if hits and start < hits[-1][1]:
            hits[-1][1] = max(hits[-1][1], stop)
        else:
            hits.append([start, stop])
    out, at = [], 0
    for start, stop in hits:
        out += [(text[at:start], False), (text[start:stop], True)]
        at = stop
    return [run for run in (*out, (text[at:], False)) if run[0]]


# ------------------------------------------------------------------------ UDFs


def _udf(f, kind=StringType()):
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return run


#: Rows of an Arrow batch that are Python strings at one time.
SLICE = 64


@F.arrow_udf(StringType())
def nfc_udf(s: pa.Array) -> pa.Array:
    """Whole texts: a batch stays in Arrow, only a slice of it is in Python strings, and what is in normal form already is not copied."""
    done = []
    for part in (s.slice(k, SLICE) for k in range(0, len(s), SLICE)):
        texts = part.to_pylist()
        new = [x if x is None else nfc(x) for x in texts]
        done.append(part if new == texts else pa.array(new, s.type))
    return pa.concat_arrays(done) if len(done) > 1 else done[0] if done else s


key_udf, fold_udf, fragment_udf = map(_udf, (name_key, fold, fold_fragment))
section_id_udf, slug_udf, sort_key_udf, language_udf, split_runs_udf = map(_udf, (section_id, github_slug, sort_key, language_tag, split_runs))
github_anchors_udf, heading_ids_udf = (_udf(f, ArrayType(StringType())) for f in (github_anchors, heading_ids))


@F.pandas_udf(StringType())
def fingerprint_udf(rule: pd.Series, path: pd.Series, target: pd.Series) -> pd.Series:
    return fingerprints(*(x.fillna("") for x in (rule, path, target)))


def fingerprints(*parts: pd.Series) -> pd.Series:
    """``fingerprint`` of many rows, a byte of all of them at a time."""
    rows = [("\x1f".join(x) + "\x1f").encode() for x in zip(*parts)]
    length = np.array([len(x) for x in rows], np.int64)
    order = np.argsort(-length, kind="stable")  # the rows that still have a byte come first
    data, start = np.frombuffer(b"".join(rows), np.uint8), np.append(0, np.cumsum(length))[:-1][order]
    h = np.full(len(rows), 0xCBF29CE484222325, np.uint64)
    left = np.searchsorted(-length[order], -np.arange(length.max(initial=0)), "left")
    for k, n in enumerate(left.tolist()):
        h[:n] = (h[:n] ^ data[start[:n] + k]) * np.uint64(0x100000001B3)
    out = np.empty(len(rows), np.uint64)
    out[order] = h
    return pd.Series([f"v1:{x:016x}" for x in out.tolist()], dtype=object)


@F.pandas_udf(StringType())
def wide_path_udf(source: pd.Series, destination: pd.Series) -> pd.Series:
    """As ``markdown_path_udf``, with paths that leave the collection as they are (../x)."""
    return pd.Series([markdown_path(a, b, True) if a is not None and b is not None else None for a, b in zip(source, destination)])


@F.pandas_udf(StringType())
def markdown_path_udf(source: pd.Series, destination: pd.Series) -> pd.Series:
    return pd.Series([markdown_path(a, b) if a is not None and b is not None else None for a, b in zip(source, destination)])


def spells_udf(directories: list[str]):
    return _udf(lambda s: spells(s, directories), BooleanType())


NAMED = {
    "note_nfc": nfc_udf, "note_key": key_udf, "note_fold": fold_udf, "note_fragment": fragment_udf, "note_section_id": section_id_udf, "note_slug": slug_udf,
    "note_sort_key": sort_key_udf, "note_language": language_udf, "note_fingerprint": fingerprint_udf, "note_markdown_path": markdown_path_udf, "note_github_anchors": github_anchors_udf,
}


def register(spark: SparkSession) -> None:
    for name, f in NAMED.items():
        spark.udf.register(name, f)


# ---------------------------------------------------------- column expressions


def ascii_key(c: Column) -> Column:
    """``name_key`` where names are known to be NFC and without special casing: stays in codegen."""
    return F.lower(F.trim(c))


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def suffixes(path: Column) -> Column:
    """All whole-segment suffixes of a path, the path itself first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts) - k + 1), "/"))


def ancestors(path: Column) -> Column:
    """All folders above a path, the root (empty) first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def folder(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def place(path: Column, depth: int) -> Column:
    """The first ``depth`` folders of a path."""
    parts = F.split(folder(path), "/")
    return F.array_join(F.slice(parts, 1, depth), "/")


def first_sentence(text: Column, most: int) -> Column:
    """A text up to its first sentence end (a full-width stop, or an ASCII one before a blank or the end) with the quotes and brackets that close it; without one its first ``most`` characters."""
    cut = F.regexp_extract(text, r"(?s)^(.*?(?:[。！？．]|[.!?](?=[ \t]|$))[」』）)”’\"']*)", 1)
    short = F.when(F.char_length(text) > most, F.concat(F.trim(F.substring(text, 1, most)), F.lit("…"))).otherwise(text)
    return F.when(cut != "", cut).otherwise(short)


def leading_date(name: Column) -> Column:
    return F.try_to_date(F.nullif(F.regexp_extract(name, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("")))


def declared_date(text: Column) -> Column:
    """A day from YYYY-MM-DD or an RFC 3339 time; null if neither."""
    return F.coalesce(
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text)),
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"), F.try_to_date(F.substring(text, 1, 10))),
    )


def one_edit(a: Column, b: Column) -> Column:
    """One insertion, deletion, substitution or swap of neighbours apart."""
    n = F.char_length(a)
    swapped = F.exists(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda k: F.concat(F.substring(a, F.lit(1), k - 1), F.substring(a, k + 1, F.lit(1)), F.substring(a, k, F.lit(1)), F.substring(a, k + 2, n)) == b,
    )
    return (F.levenshtein(a, b) == 1) | ((a != b) & (n == F.char_length(b)) & (n > 1) & swapped)


def phrase_pattern(token: str) -> str:
    """A Java pattern for a folded token, whose blanks match any run of white space."""
    return r"\s+".join(re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", x) for x in re.split(r"\s+", token))


def concept_id(path: Column) -> Column:
    return F.concat(F.lit("path-"), F.rtrim(F.translate(F.base64(F.encode(path, "UTF-8")), "+/=\r\n", "-_ ")))


def escaped_markdown(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\`*_\[\]<>|])", r"\\$1")


def escaped_terminal(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x1f\x7f-\x9f]", "�")
