"""Snippets and leads against slow twins, and by name."""

import random

from quire.functions import text as T
from quire.operators import leads as L
from quire.sources import blocks as B

WORD = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-_"


def slow_edge(s, i, forward):
    """Cuts by walking: out of the word at a cut, at most 24 characters one way, else the other."""
    if i <= 0 or i >= len(s) or s[i - 1] not in WORD or s[i] not in WORD:
        return i
    left = right = i
    while left > 0 and s[left - 1] in WORD:
        left -= 1
    while right < len(s) and s[right] in WORD:
        right += 1
    if forward:
        return right if right - i <= 24 else left
    return left if i - left <= 24 else right


def slow_lead(plain, tokens, title, ends):
    begin = 0
    for end in ends:
        text, start = plain[begin:end], begin
        begin = end
        if text and " ".join(text.split()).lower() != " ".join(title.split()).lower():
            low = text.lower()
            hits = sorted((low.index(t), k) for k, t in enumerate(tokens) if t in low)
            if hits:
                off, stop = hits[0][0], hits[0][0] + len(tokens[hits[0][1]])
                o = None
                for at in range(off - 1, max(0, off - 120) - 1, -1):
                    if text[at] in "。！？；!?;" or (text[at] == "." and at + 1 < off and text[at + 1] == " "):
                        o = at + 1
                        break
                if o is None:
                    o = 0 if off <= 120 else min(off, slow_edge(text, off - 120, False))
                else:
                    while o < off and text[o] in " \t\n":
                        o += 1
                e = min(len(text), max(stop, slow_edge(text, min(len(text), o + 240), True)))
                assert start >= 0
                return ("…" if o else "") + " ".join(text[o:e].split()) + ("…" if e < len(text) else "")
    return ""


def test_lead_twin():
    rng = random.Random(4)
    words = ["tree", "Trees", "x", "。", ". ", "e.g.", "!", "; ", "long-" * 9, "word ", " ", "\n", "blue_sky", "Ünder"]
    for _ in range(3000):
        lines = ["".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randint(0, 60))).replace("\n", " ").strip() for _ in range(rng.randint(1, 4))]
        lines = [x for x in lines if x] or ["x"]
        plain, ends = "\n".join(lines), []
        for x in lines:
            ends.append((ends[-1] + 1 if ends else 0) + len(x))
        tokens = rng.sample(["tree", "blue", "e.g.", "zz"], 2)
        got = L.lead(plain, tokens, lines[0], [{"stop": e, "kind": "paragraph"} for e in ends])
        assert "".join(r["text"] for r in got["runs"]) == slow_lead(plain, tokens, lines[0], ends), plain
        assert all(r["text"].lower() in tokens or r["text"].lower().startswith(tuple(tokens)) for r in got["runs"] if r["hit"])
        start, stop, text = L.snippet(plain, tokens)
        low = plain.lower()
        first = min((low.index(t) for t in tokens if t in low), default=0)
        assert start <= first <= stop and len(text) <= 40 + 160 + 2 * 24 + 2 + 24


def test_snippet_by_name():
    assert L.snippet("0Z" + "0" * 184, ["z"])[2] == "0Z…"  # a cut inside a long word never passes the hit
    long = "Before it. " + "word " * 20 + "the hit is here. " + "more " * 60
    start, stop, text = L.snippet(long, ["hit"])
    assert long[:start].endswith("wor") and text.startswith("…d word") and text.endswith("more…") and len(text) == 250  # from the sentence on, clipped to its budget
    plain, fences = "some prose\ncode hit here\nmore prose hit", [(11, 24)]
    assert L.snippet(plain, ["hit"], fences)[2] == "…more prose hit" and L.snippet(plain[:24], ["hit"], fences)[2] == "…code hit here"
    assert L.snippet("no match at all", ["zz"])[:2] == (0, 15)
    assert L.sentence_start("One. Two three", 9, 12) == 5 and L.sentence_start("v1.2 three", 6, 8) == 6


def note(body):
    got = B.plain_blocks(body)
    pairs = lambda k: [(r["start"], r["stop"]) for r in got[k]]
    return lambda *tokens, title="": L.lead(got["plain"], list(tokens), title, got["blocks"], pairs("fences"), pairs("hidden"), pairs("deleted"))


def said(lead, part="runs"):
    return "".join(f"«{r['text']}»" if r["hit"] else r["text"] for r in lead[part])


def test_lead_by_name():
    ask = note("# The tree\n\nThe tree\n\nFirst sentence. A tree grows! [[Oak tree|The oak]] stands ~~dead wood~~.\n\n```\ntree = code\n```\n\n## Tree\n\nLast 東\n京 words.\n")
    assert said(ask("tree", title="The tree")) == "…A «tree» grows! The oak stands dead wood."
    assert said(ask("code")) == "tree = «code»" and ask("code")["code"] and not ask("tree")["code"]
    assert said(ask("stands")) == "…The oak «stands» dead wood." and [r["text"] for r in ask("wood")["runs"] if r["deleted"]] == ["dead ", "wood"]
    assert said(ask("oak tree", title="x")) == ""  # only in a target that isn't shown
    assert said(ask(T.fold("東京"))) == "Last «東 京» words."
    assert said(ask("absent")) == ""
    far = note("One two three four five six seven eight nine ten eleven tree and more words after it.")
    assert said(far("tree"), "near") == "…eleven «tree» and more words after it." and said(far("tree")).startswith("One two")


def test_excerpts(spark):
    rows = [("a", "T", "Say the word. The end.", [{"stop": 22, "kind": "paragraph", "level": 0}]), ("b", None, None, None), ("c", "", "", [])]
    found = spark.createDataFrame(rows, "path string, title string, plain string, plain_blocks array<struct<stop: int, kind: string, level: int>>")
    got = {r.path: r for r in L.excerpts(found, ["WORD"]).collect()}
    assert got["a"].snippet == "Say the word. The end." and [(r.text, r.hit) for r in got["a"].lead] == [("Say the ", False), ("word", True), (". The end.", False)] and got["b"].lead == [] and got["c"].snippet == ""


def test_hits_that_touch():
    """Two hits side by side are two runs, hits that overlap are one."""
    assert T.hit_runs("a theThe b", ["the"]) == [("a ", False), ("the", True), ("The", True), (" b", False)]
    assert T.hit_runs("xabcx", ["ab", "bc"]) == [("x", False), ("abc", True), ("x", False)]
    runs = L.lead("so anathetheaen", ["the"])["runs"]
    assert [(r["text"], r["hit"]) for r in runs] == [("so ana", False), ("the", True), ("the", True), ("aen", False)]
