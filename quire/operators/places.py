"""Where a reader's marks stand in notes that have changed since (Q14, W11, JN16).

A mark names words of a note (quote) with what stood before and after them, or a section (anchor). Its place is
looked for in the note's text with white space squeezed: where its words occur once, or with the most in common
around them; where they don't, the one span between what stood around them, if it is near enough to be an edit. White space is squeezed
with a map of runs back to the text, so places are those of the text itself (bytes of its UTF-8 form, end exclusive).

Marks are gathered by note, in chunks, so that a text is read once for many marks and no note with many marks
is one task's work alone; nothing is compared across notes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: White space, and how much of what stood around is asked for, longest first (bytes; fixed values).
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
STEPS = (512, 96, 32)
CHUNK = 1000


class Squeezed:
    """A text with each run of white space as one space, in bytes, and the way back: shifts that hold from a place on."""

    def __init__(self, text: str) -> None:
        pieces, at, shift, done = [], [0], [0], 0
        size = 0
        for run in SPACE.finditer(text):
            piece = text[done : run.start()].encode()
            wide = len(run[0].encode()) - 1
            size += len(piece) + 1
            pieces += [piece, b" "]
            done = run.end()
            if wide:
                at.append(size)
                shift.append(shift[-1] + wide)
        pieces.append(text[done:].encode())
        self.text = b"".join(pieces)
        self.at, self.shift = np.array(at), np.array(shift)

    def source(self, place: int) -> int:
        """The place in the text that a place here came from."""
        return place + int(self.shift[np.searchsorted(self.at, place, "right") - 1])


def squeeze(text: str | None) -> bytes:
    return SPACE.sub(" ", text or "").strip(" ").encode()


def _shared(a: bytes, b: bytes) -> int:
    """Bytes that two strings begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)))


def _occurrences(text: bytes, what: bytes) -> Iterator[int]:
    at = text.find(what)
    while at >= 0:
        yield at
        at = text.find(what, at + 1)


def exact(text: bytes, quote: bytes, before: bytes, after: bytes) -> list[tuple[int, int]]:
    """The occurrences of ``quote`` that have most of what stood around it: none, one, or several that nothing tells apart."""
    best, out = -1, []
    for start in _occurrences(text, quote):
        stop = start + len(quote)
        left = text[max(0, start - len(before) - 1) : start].rstrip(b" ")
        right = text[stop : stop + len(after) + 1].lstrip(b" ")
        score = _shared(left[::-1], before[::-1]) + _shared(right, after)
        if score >= best:
            out = [*(out if score == best else []), (start, stop)]
            best = score
    return out


def _near(context: bytes, step: int, last: bool) -> bytes:
    """The last or first bytes of a context, whole characters only."""
    if len(context) <= step:
        return context
    if last:
        return context[-step:].decode(errors="ignore").encode().lstrip(b" ")
    return context[:step].decode(errors="ignore").encode().rstrip(b" ")


def between(text: bytes, quote: bytes, before: bytes, after: bytes) -> tuple[int, int] | None:
    """The one span between what stood before and after, a few times as long as the quote at most; less and less of what stood there is asked for."""
    if not before or not after:
        return None
    reach = 3 * len(quote) + 128
    for step in STEPS:
        b, a = _near(before, step, True), _near(after, step, False)
        found = []
        for at in _occurrences(text, b) if a and b else ():
            start = at + len(b)
            stop = text.find(a, start, start + reach + len(a) + 1)
            if start < stop <= start + reach and text[start:stop].strip(b" "):
                found.append((start, stop))
        if len(found) == 1:
            start, stop = found[0]
            inner = text[start:stop]
            return start + len(inner) - len(inner.lstrip(b" ")), stop - len(inner) + len(inner.rstrip(b" "))
    return None


def place(text: Squeezed, sections: list[str], anchor: str | None, quote: str | None, before: str | None, after: str | None) -> dict:
    """status: found (with start, stop, and whether these are the words themselves), section (a mark without words), or changed."""
    kept = not anchor or anchor in sections
    words = squeeze(quote)
    out = {"status": "changed", "start": None, "stop": None, "exact": None, "section_kept": kept}
    if not words:
        return out | {"status": "section"} if kept else out
    around = squeeze(before), squeeze(after)
    found = exact(text.text, words, *around)
    span = found[0] if len(found) == 1 else None if found else between(text.text, words, *around)
    if span is None:
        return out
    return out | {"status": "found", "start": text.source(span[0]), "stop": text.source(span[1]), "exact": bool(found)}


PLACE = "id string, status string, start bigint, stop bigint, exact boolean, section_kept boolean, words string"


def located(marks: DataFrame, notes: DataFrame) -> DataFrame:
    """Each mark (id, path, anchor, quote, before, after) with its place in its note (path, text, sections: array of anchors).

    status: found, section, changed, or lost where there is no such note; ``words`` are what stands at the place now."""
    counted = marks.groupBy("path").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    mark = F.struct(F.col("id").cast("string").alias("id"), "anchor", "quote", "before", "after")
    spread = marks.join(counted, "path").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")))
    gathered = spread.groupBy("path", "chunk").agg(F.collect_list(mark).alias("marks"))
    rows = gathered.join(notes.select("path", "text", "sections"), "path", "left").select("path", "text", "sections", "marks")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("path", pa.string()), ("id", pa.string()), ("status", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("exact", pa.bool_()), ("section_kept", pa.bool_()), ("words", pa.string())])
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                text = None if row["text"] is None else Squeezed(row["text"])
                raw, out = (row["text"] or "").encode(), []
                for m in row["marks"]:
                    if text is None:
                        found = {"status": "lost", "start": None, "stop": None, "exact": None, "section_kept": False}
                    else:
                        found = place(text, row["sections"] or [], m["anchor"], m["quote"], m["before"], m["after"])
                    words = raw[found["start"] : found["stop"]].decode() if found["start"] is not None else None
                    out.append({"path": row["path"], "id": m["id"], **found, "words": words})
                yield pa.RecordBatch.from_pylist(out, kind)

    return rows.mapInArrow(work, "path string, " + PLACE)


def words_around(text: Column, first: int, n: int, context: int) -> tuple[Column, Column, Column]:
    """A mark's quote, before and after: ``n`` words from word ``first`` (from 1), and up to ``context`` words on each side."""
    words = F.split(F.trim(F.regexp_replace(text, SPACE.pattern, " ")), " ")
    some = lambda start, count: F.array_join(F.slice(words, start, count), " ")
    return some(first, n), some(max(1, first - context), min(context, first - 1)), some(first + n, context)
