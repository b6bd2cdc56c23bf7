"""What a search result shows of its note: a snippet around the first hit, or the passage that leads to it.

A lead is cut from the first block of running text that holds a hit the reader is shown: not from a heading, not from a
block that repeats the title, and from code only if no prose has one. It opens at the sentence of the hit, if that
begins at most 120 characters back, and runs on for 240; where the hit is over 22 characters into it there is a
narrow lead as well. Cuts fall between words. Hits are found in the folded text and cut from the text itself, by the fold's
own map of places. Each note is worked on by itself, so the hits of a search are read in parallel and nothing is shuffled.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.functions import text as T

#: Characters before and after a hit, and how far back a sentence is looked for (fixed values).
BEFORE, AFTER, BACK = 40, 160, 120
REACH, FIRST_LINE, NEAR_BEFORE, NEAR_REACH = 240, 22, 8, 90
EDGE = 24
STOPS, LEAD_STOPS, CERTAIN = "。！？；.!?;\n", "。！？；!?;", "。！？；\n"
WORD = re.compile(r"[0-9A-Za-z_-]")


def _word(text: str, at: int) -> bool:
    return 0 <= at < len(text) and bool(WORD.match(text[at]))


def _run(text: str, at: int, step: int) -> int:
    """From ``at`` over the characters of a word, back (-1) or on (1)."""
    while _word(text, at - 1 if step < 0 else at):
        at += step
    return at


def word_start(text: str, at: int) -> int:
    """A cut moved back to the start of the word it falls in, or on past a word too long for that."""
    if not (0 < at < len(text) and _word(text, at - 1) and _word(text, at)):
        return at
    back = _run(text, at, -1)
    return back if at - back <= EDGE else _run(text, at, 1)


def word_stop(text: str, at: int) -> int:
    """A cut moved on to the end of the word it falls in, or back before a word too long for that."""
    if not (0 < at < len(text) and _word(text, at - 1) and _word(text, at)):
        return at
    on = _run(text, at, 1)
    return on if on - at <= EDGE else _run(text, at, -1)


def sentence_start(text: str, start: int, off: int) -> int:
    """A snippet's start moved back to where its sentence begins, if that is near enough to the hit."""
    limit = max(0, off - BACK)
    if start <= 0 or limit >= start:
        return start
    for at in range(start - 1, limit - 1, -1):
        if text[at] in STOPS and (text[at] in CERTAIN or at + 1 >= len(text) or text[at + 1].isspace()):
            at += 1
            while at < start and text[at].isspace():
                at += 1
            return at
    return start


def first_hit(folded: T.Folded, tokens: list[str]) -> tuple[int, int] | None:
    """The earliest hit of any token, as places of the text itself."""
    found = [next(T.phrases(folded.text, t), None) for t in tokens if t.strip()]
    best = min((f for f in found if f), key=lambda f: f[0], default=None)
    return best and (folded.start(best[0]), folded.stop(best[1]))


def collapse(text: str) -> str:
    return " ".join(text.split())


def snippet(plain: str, tokens: list[str], fences: list[tuple[int, int]] = ()) -> tuple[int, int, str]:
    """Start and stop of the text around the first hit (in prose, if any has one), and the text itself on one line."""
    folded = T.Folded(plain)
    code = lambda at: next((f for f in fences if f[0] <= at < f[1]), None)
    prose, any_ = [], []
    for token in filter(str.strip, tokens):
        places = [(folded.start(i), folded.stop(j)) for i, j in itertools.islice(T.phrases(folded.text, token), None if fences else 1)]
        any_ += places[:1]
        prose += [h for h in places if not code(h[0])][:1]
    off, stop = min(prose or any_, key=lambda h: h[0], default=(0, 0))
    inside = code(off)
    opening = max(0, off - BEFORE)
    start = min(word_start(plain, opening if inside else sentence_start(plain, opening, off)), off)
    end = max(word_stop(plain, min(len(plain), off + AFTER)), stop)
    if inside:
        start, end = min(max(start, inside[0]), off), max(min(end, inside[1]), stop)
    else:
        for a, b in fences:
            if a < end and b > start:
                if b <= off:
                    start = min(max(start, b + (plain[b : b + 1] == "\n")), off)
                elif a >= stop:
                    end = max(min(end, a), stop)
    budget = BEFORE + AFTER + 2 * EDGE + 2
    while start < off and (n := len(collapse(plain[start:end])) + (start > 0) + (end < len(plain))) > budget:
        start = min(off, start + n - budget)
    return start, end, ("…" if start > 0 else "") + collapse(plain[start:end]) + ("…" if end < len(plain) else "")


def opening(block: str, off: int) -> int:
    """Where the sentence that holds ``off`` begins in its block."""
    start = max(0, off - BACK)
    before = block[start:off]
    stop = max((before.rfind(c) + 1 for c in LEAD_STOPS), default=0)
    stop = max(stop, before.rfind(". ") + 1)
    if not stop:
        return 0 if not start else min(off, word_start(block, start))
    at = start + stop
    while at < off and block[at] in " \t\n":
        at += 1
    return at


def _runs(plain: str, start: int, end: int, tokens: list[str], hidden: list[tuple[int, int]], deleted: list[tuple[int, int]], before: bool, after: bool) -> list[dict]:
    """A passage as runs with their hits and deletions; what isn't shown is left out, white space is one space."""
    kept = [k for k in range(start, end) if not any(a <= k < b for a, b in hidden)] if hidden else [*range(start, end)]
    marks = []  # the number of the hit that a character belongs to, or 0
    for number, (text, hit) in enumerate(T.hit_runs(plain[start:end], tokens), 1):
        marks += [number if hit else 0] * len(text)
    out: list[list] = [["…", 0, False]] if before else []
    space = True
    for k in kept:
        c = " " if plain[k].isspace() else plain[k]
        if c == " " and space:
            continue
        space = c == " "
        state = [marks[k - start], any(a <= k < b for a, b in deleted)]
        if len(out) > before and out[-1][1:] == state:
            out[-1][0] += c
        else:
            out.append([c, *state])
    if len(out) > before and out[-1][0].endswith(" "):
        out[-1][0] = out[-1][0][:-1]
    if after:
        out.append(["…", 0, False])
    return [{"text": t, "hit": h > 0, "deleted": d} for t, h, d in out if t]


def lead(plain: str, tokens: list[str], title: str = "", blocks: list[dict] = (), fences=(), hidden=(), deleted=()) -> dict:
    """runs, near (a narrow lead, or none) and whether the lead is a line of code; no runs where no block has a hit."""
    code = None
    begin = 0
    for block in blocks or ({"stop": len(plain), "kind": "paragraph"},):
        start, end = begin, block["stop"]
        begin = end
        text = plain[start:end]
        if block["kind"] == "heading" or not text or T.fold(collapse(text)) == T.fold(collapse(title)):
            continue
        hit, from_ = None, 0
        while from_ < len(text) and (found := first_hit(T.Folded(text[from_:]), tokens)):
            found = found[0] + from_, found[1] + from_
            if not any(a <= start + found[0] and start + found[1] <= b or a <= start + found[0] < b for a, b in hidden):
                hit = found
                break
            from_ = max(found[1], from_ + 1)
        if hit is None:
            continue
        if any(a <= start + hit[0] < b for a, b in fences):
            code = code or (start, end)
            continue
        cut = lambda a, b: _runs(plain, start + a, start + b, tokens, hidden, deleted, a > 0, b < len(text))  # noqa: B023, E731
        open_ = opening(text, hit[0])
        stop = min(len(text), max(hit[1], word_stop(text, min(len(text), open_ + REACH))))
        out = {"runs": cut(open_, stop), "near": [], "code": False}
        if hit[0] - open_ > FIRST_LINE:
            close = min(hit[0], word_start(text, max(0, hit[0] - NEAR_BEFORE)))
            out["near"] = cut(close, min(len(text), max(hit[1], word_stop(text, min(len(text), close + NEAR_REACH)))))
        return out
    if code:
        begin = code[0] + len(plain[code[0] : code[1]]) - len(plain[code[0] : code[1]].lstrip("\n "))
        line = plain[begin : code[1]].split("\n")[0]
        return {"runs": _runs(plain, begin, begin + len(line), tokens, hidden, deleted, False, begin + len(line) < code[1]), "near": [], "code": True}
    return {"runs": [], "near": [], "code": False}


RUNS = pa.list_(pa.struct([("text", pa.string()), ("hit", pa.bool_()), ("deleted", pa.bool_())]))


def excerpts(found: DataFrame, tokens: list[str], key: str = "path") -> DataFrame:
    """Snippet and lead of each hit (key, title, plain; where notes were parsed also plain_blocks, fences, hidden, deleted)."""
    extra = [c for c in ("plain_blocks", "fences", "hidden", "deleted") if c in found.columns]
    tokens = [T.fold(t) for t in tokens]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            snippets, runs, near, code = [], [], [], []
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                ranges = {c: [(x["start"], x["stop"]) for x in row.get(c) or ()] for c in ("fences", "hidden", "deleted")}
                plain = row["plain"] or ""
                snippets.append(snippet(plain, tokens, ranges["fences"])[2])
                own = lead(plain, tokens, row["title"] or "", row.get("plain_blocks") or (), **ranges)
                runs.append(own["runs"])
                near.append(own["near"])
                code.append(own["code"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(snippets, pa.string()), pa.array(runs, RUNS), pa.array(near, RUNS), pa.array(code, pa.bool_())], [key, "snippet", "lead", "near", "code"])

    kind, run = found.schema[key].dataType.simpleString(), "array<struct<text: string, hit: boolean, deleted: boolean>>"
    return found.select(key, "title", "plain", *extra).mapInArrow(work, f"{key} {kind}, snippet string, lead {run}, near {run}, code boolean")
