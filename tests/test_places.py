"""Places of marks against a slow twin, and the outcomes by name."""

import random
import re

from quire.operators import places as P

WS = "\t\n\v\f\r \x85\xa0        　"


def slow(text, sections, anchor, quote, before, after):
    """Character by character, over a list of (byte, place it came from)."""
    view, k, raw = [], 0, 0
    while k < len(text):
        if text[k] in WS:
            view.append((32, raw))
            while k < len(text) and text[k] in WS:
                raw, k = raw + len(text[k].encode()), k + 1
            continue
        for b in text[k].encode():
            view.append((b, raw))
            raw += 1
        k += 1
    s, where = bytes(b for b, _ in view), [p for _, p in view] + [raw]
    squeeze = lambda x: " ".join(w for w in re.split("[" + WS + "]+", x or "") if w).encode()
    kept = not anchor or anchor in sections
    q, b, a = map(squeeze, (quote, before, after))
    if not q:
        return ("section" if kept else "changed", None, None, None, kept)
    hits = [i for i in range(len(s) - len(q) + 1) if s[i : i + len(q)] == q]
    if hits:
        def score(i):
            left, right, n, m = s[:i].rstrip(b" "), s[i + len(q) :].lstrip(b" "), 0, 0
            while n < min(len(left), len(b)) and left[-1 - n] == b[-1 - n]:
                n += 1
            while m < min(len(right), len(a)) and right[m] == a[m]:
                m += 1
            return n + m

        top = max(map(score, hits))
        best = [i for i in hits if score(i) == top]
        return ("found", where[best[0]], where[best[0] + len(q)], True, kept) if len(best) == 1 else ("changed", None, None, None, kept)
    for step in (512, 96, 32):
        bb = next(x for x in (b.decode()[k:] for k in range(len(b.decode()) + 1)) if len(x.encode()) <= step).lstrip(" ").encode() if len(b) > step else b
        aa = next(x for x in (a.decode()[: len(a.decode()) - k] for k in range(len(a.decode()) + 1)) if len(x.encode()) <= step).rstrip(" ").encode() if len(a) > step else a
        spans = []
        for i in range(len(s)) if bb and aa else ():
            if s[i : i + len(bb)] == bb:
                start = i + len(bb)
                stop = next((j for j in range(start, len(s)) if s[j : j + len(aa)] == aa), -1)
                if start < stop <= start + 3 * len(q) + 128 and s[start:stop].strip(b" "):
                    spans.append((start, stop))
        if len(spans) == 1:
            start, stop = spans[0]
            while s[start] == 32:
                start += 1
            while s[stop - 1] == 32:
                stop -= 1
            return ("found", where[start], where[stop], False, kept)
    return ("changed", None, None, None, kept)


def test_slow_twin():
    rng = random.Random(5)
    words = ["a", "b", "aa", "é", "漢字", "x　y", "ba", "  ", "\n", "\xa0", "long" * 12, "ü" * 20]
    seen = set()
    for _ in range(4000):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "", "\n\t", " "]) for _ in range(rng.randint(0, 40)))
        i, j = sorted(rng.randint(0, len(text)) for _ in range(2))
        j = min(j, i + rng.randint(0, 9))
        before, quote, after = text[max(0, i - rng.randint(0, 60)) : i], text[i:j], text[j : j + rng.randint(0, 60)]
        if rng.random() < 0.5:  # edit the quote or what stands around it
            k = rng.randint(0, len(text))
            text = text[:k] + rng.choice(["", " ", "é", "new words"]) + text[k + rng.randint(0, 8) :]
        anchor = rng.choice(["", None, "s", "gone"])
        got = P.place(P.Squeezed(text), ["s"], anchor, quote, before, after)
        want = slow(text, ["s"], anchor, quote, before, after)
        assert tuple(got[k] for k in ("status", "start", "stop", "exact", "section_kept")) == want, (text, quote, before, after)
        seen.add((want[0], want[3]))
    assert seen == {("found", True), ("found", False), ("changed", None), ("section", None)}


def test_located(spark):
    text = "One two  three\nfour five. Six seven eight two three nine."
    notes = spark.createDataFrame([("a.md", text, ["part"]), ("b.md", None, None)], "path string, text string, sections array<string>")
    marks = [
        ("1", "a.md", None, "two three", "One", "four"), ("2", "a.md", None, "two three", "eight", "nine"), ("3", "a.md", None, "two three", "", ""), ("4", "a.md", None, "one six", "four five.", "eight two"), ("5", "a.md", "part", None, None, None),
        ("6", "a.md", "gone", None, None, None), ("7", "gone.md", None, "x", "", ""), ("8", "a.md", "gone", "nine", "", ""), *((str(k), "a.md", None, f"no {k}", "", "") for k in range(100, 2300)),
    ]
    got = {r.id: r for r in P.located(spark.createDataFrame(marks, "id string, path string, anchor string, quote string, before string, after string"), notes).collect()}
    assert len(got) == len(marks) and all(got[str(k)].status == "changed" for k in range(100, 2300))
    assert [(got[k].status, got[k].words, got[k].exact) for k in "12345678"] == [
        ("found", "two  three", True), ("found", "two three", True), ("changed", None, None), ("found", "Six seven", False), ("section", None, None), ("changed", None, None), ("lost", None, None), ("found", "nine", True),
    ]
    assert text.encode()[got["1"].start : got["1"].stop].decode() == "two  three" and not got["8"].section_kept
