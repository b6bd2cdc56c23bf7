"""Block structure of Markdown, and the plain text of its blocks.

A note is read line by line against a stack of open containers (quotes and list items), as the CommonMark
specification describes it: a line continues the containers it matches, may open new ones, and belongs to a leaf
(paragraph, heading, fenced or indented code, HTML, rule); a paragraph goes on lazily past containers its line
leaves out. From the leaves follow what is code, where headings are, and the plain text: each leaf's words as they
read, one block after the other, with the places that a reader isn't shown (a link's target before its display, the
marks of deleted text) and that are deleted as ranges of it.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

FENCE = re.compile(r"(`{3,}|~{3,})(.*)$", re.S)
ATX = re.compile(r"(#{1,6})(?:[ \t]+(.*?))?(?:(?:^|[ \t]+)#+)?[ \t]*$")
RULE = re.compile(r"(?:\*[ \t]*){3,}$|(?:-[ \t]*){3,}$|(?:_[ \t]*){3,}$")
ITEM = re.compile(r"([-+*]|\d{1,9}[.)])(?=[ \t]|$)")
UNDERLINE = re.compile(r"(=+|-+)[ \t]*$")
DEFINITION = re.compile(r"\[(?!\^)(?:[^\[\]\\]|\\.)+\]:[ \t]*(?:<[^<>\n]*>|\S+)(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*$")
DELIMITERS = re.compile(r"\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
#: Beginnings and ends of HTML blocks (fixed values of the specification); a block without an end of its own stops at a blank line.
HTML = (
    (re.compile(r"<(?:script|pre|style|textarea)(?:[\s>]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)), (re.compile(r"<!--"), re.compile(r"-->")), (re.compile(r"<\?"), re.compile(r"\?>")), (re.compile(r"<![A-Za-z]"), re.compile(r">")), (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(r"</?(?:address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul)(?:[\s>]|/>|$)", re.I), None),
)
TAG = r"<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>"
ALONE = re.compile(rf"(?:{TAG})[ \t]*$")


@dataclass
class Leaf:
    kind: str  # paragraph, heading, fence, code, html, rule
    first: int  # line, from 0
    last: int
    level: int = 0
    depth: int = 0  # containers around it
    lines: list[str] = field(default_factory=list)  # without the containers' prefixes
    callout: bool = False


@dataclass
class _Container:
    quote: bool
    width: int = 0  # columns an item's content is indented by
    empty: bool = False  # an item without content so far


def _indent(line: str, at: int) -> int:
    return len(line) - at - len(line[at:].lstrip(" "))


def scan(body: str) -> list[Leaf]:
    """The leaves of a body, in order."""
    out: list[Leaf] = []
    stack: list[_Container] = []
    leaf: Leaf | None = None
    fence = ("", 0, 0)
    ends: re.Pattern | None = None

    def close() -> None:
        nonlocal leaf
        if leaf is not None and leaf.kind == "code":
            while leaf.lines and not leaf.lines[-1].strip():
                leaf.lines.pop()
                leaf.last -= 1
        leaf = None

    def start(kind: str, k: int, text: str, level: int = 0) -> Leaf:
        nonlocal leaf
        close()
        leaf = Leaf(kind, k, k, level, len(stack), [text])
        out.append(leaf)
        return leaf

    def goes_on(k: int, text: str) -> None:
        leaf.lines.append(text)
        leaf.last = k

    for k, raw in enumerate(body.split("\n")):
        line = raw.rstrip("\r").expandtabs(4)
        at, matched = 0, 0
        for c in stack:
            indent, blank = _indent(line, at), not line[at:].strip()
            if c.quote:
                if blank or indent > 3 or line[at + indent] != ">":
                    break
                at += indent + 1
                at += line[at : at + 1] == " "
            elif blank:
                if c.empty:
                    break
                at = len(line)
            elif indent >= c.width:
                at += c.width
            else:
                break
            matched += 1
        rest, whole = line[at:], matched == len(stack)
        if whole and leaf is not None and leaf.kind == "fence":
            m = FENCE.match(rest.lstrip(" "))
            if m and _indent(rest, 0) < 4 and m[1][0] == fence[0] and len(m[1]) >= fence[1] and not m[2].strip():
                leaf.last = k
                close()
            else:
                goes_on(k, rest[min(fence[2], _indent(rest, 0)) :])
            continue
        if whole and leaf is not None and leaf.kind == "html" and (ends or rest.strip()):
            goes_on(k, rest)
            if ends and ends.search(rest):
                close()
            continue
        if not rest.strip():
            if leaf is not None and leaf.kind == "code" and whole:
                goes_on(k, rest[4:])
            else:
                close()
            del stack[matched:]
            if stack and not stack[-1].quote and stack[-1].empty:
                stack.pop()
            continue
        if not whole and leaf is not None and leaf.kind != "paragraph":
            close()
        fresh = False  # whether the line opens a container
        while True:
            indent = _indent(line, at)
            text = line[at + indent :]
            reads = leaf is not None and leaf.kind == "paragraph" and not fresh  # a paragraph that the line may go on with
            if not text:
                break
            if indent > 3:
                if reads:
                    goes_on(k, text)
                else:
                    del stack[matched:]
                    if leaf is not None and leaf.kind == "code" and whole and not fresh:
                        goes_on(k, line[at + 4 :])
                    else:
                        start("code", k, line[at + 4 :])
                text = ""
                break
            if text[0] == ">":
                del stack[matched:]
                close()
                stack.append(_Container(True))
                at += indent + 1
                at += line[at : at + 1] == " "
            elif reads and whole and (m := UNDERLINE.match(text)) and any(not DEFINITION.match(x.strip()) for x in leaf.lines):
                leaf.kind, leaf.level, leaf.last = "heading", 1 if m[1][0] == "=" else 2, k
                close()
                text = ""
                break
            elif RULE.match(text):
                del stack[matched:]
                start("rule", k, text)
                close()
                text = ""
                break
            elif (m := ITEM.match(text)) and not (reads and whole and (not text[m.end() :].strip() or m[1] not in ("-", "+", "*", "1.", "1)"))):
                del stack[matched:]
                close()
                after = text[m.end() :]
                space = _indent(after, 0)
                blank = not after.strip()
                width = indent + m.end() + (1 if blank or space > 4 else space)
                stack.append(_Container(False, width, blank))
                at = len(line) if blank else at + width
            else:
                break
            matched, whole, fresh = len(stack), True, True
        if not text:
            continue
        if stack:
            stack[-1].empty = False
        if m := ATX.match(text):
            del stack[matched:]
            start("heading", k, heading_text(m), len(m[1]))
            close()
        elif (m := FENCE.match(text)) and not (m[1][0] == "`" and "`" in m[2]):
            del stack[matched:]
            start("fence", k, "").lines.clear()
            fence = (m[1][0], len(m[1]), indent)
        elif found := next(((b, e) for b, e in HTML if b.match(text)), None) or ((ALONE, None) if not reads and ALONE.match(text) else None):
            del stack[matched:]
            start("html", k, text)
            ends = found[1]
            if ends and ends.search(text):
                close()
        elif reads:  # the paragraph goes on, past containers that the line leaves out as well
            goes_on(k, text)
        else:
            del stack[matched:]
            start("paragraph", k, text)
            leaf.callout = bool(stack) and stack[-1].quote and bool(re.match(r"\[![A-Za-z-]+\]", text))
    close()
    return out


def heading_text(m: re.Match) -> str:
    """The text of a line that ``ATX`` matches; marks alone close a heading without text."""
    return "" if not (m[2] or "").strip("#") else m[2].strip()


def code_lines(leaves: list[Leaf]) -> set[int]:
    """The lines of fenced and indented code, fences included."""
    return {k for x in leaves if x.kind in ("fence", "code") for k in range(x.first, x.last + 1)}


# ----------------------------------------------------------------- plain text

TOKEN = re.compile(
    r"(?P<code>(?<!`)(?P<ticks>`+)(?!`)(?P<inner>.+?)(?<!`)(?P=ticks)(?!`))|(?P<escape>\\[!-/:-@\[-`{-~])|(?P<auto><(?P<url>[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[\w.-]+)>)"
    rf"|(?P<tag>{TAG}|<!--.*?-->)|(?P<wiki>!?\[\[(?P<name>[^\[\]\n]+)\]\])|(?P<link>!?\[(?P<label>(?:[^\[\]\\]|\\.|\[[^\[\]]*\])*)\](?:\((?P<dest>[^()\n]*(?:\([^()\n]*\)[^()\n]*)*)\)|\[[^\[\]]*\]))"
    r"|(?P<run>\*+|_+)|(?P<gone>~~)",
    re.S,
)


@dataclass
class Words:
    """Text as it reads, and ranges of it."""

    text: str = ""
    hidden: list[tuple[int, int]] = field(default_factory=list)
    deleted: list[tuple[int, int]] = field(default_factory=list)


def _unmarked(parts: list[tuple[str, str, bool, bool]]) -> list[str]:
    """Parts (text, kind) with the emphasis marks of matched runs taken away: each run that can close takes from the nearest open run of its kind."""
    left = [len(text) if kind == "run" else 0 for text, kind, _, _ in parts]
    opened: list[int] = []
    for j, (text, kind, opens, closes) in enumerate(parts):
        if kind != "run":
            continue
        while closes and left[j]:
            i = next((i for i in reversed(opened) if parts[i][0][0] == text[0] and left[i] and not ((parts[i][3] or opens) and (len(parts[i][0]) + len(text)) % 3 == 0 and (len(parts[i][0]) % 3 or len(text) % 3))), None)
            if i is None:
                break
            del opened[opened.index(i) + 1 :]
            n = 2 if left[i] > 1 and left[j] > 1 else 1
            left[i] -= n
            left[j] -= n
            if not left[i]:
                opened.remove(i)
        if opens and left[j]:
            opened.append(j)
    return [text if kind != "run" else text[0] * left[k] for k, (text, kind, _, _) in enumerate(parts)]


def inline(source: str) -> Words:
    """A leaf's words: code and link texts as they are, wikilinks by target and display, no tags, no emphasis marks; ruby readings follow the text."""
    parts: list[tuple[str, str, bool, bool]] = []
    spans: list[tuple[int, str, int]] = []  # part, hidden or gone, length
    readings, ruby, done = [], [], 0

    def say(text: str, kind: str = "text", opens: bool = False, closes: bool = False) -> None:
        if ruby and "rp" in ruby:
            return
        if ruby and ruby[-1] in ("rt", "rtc"):
            readings.append(text)
        elif text:
            parts.append((text, kind, opens, closes))

    def prose(text: str) -> None:
        say(html.unescape(re.sub(r"[ \t]*\n[ \t]*", "\n", text)) if "&" in text else re.sub(r"[ \t]*\n[ \t]*", "\n", text))

    def nested(text: str) -> None:
        words, base = inline(text), len(parts)
        cuts = sorted({0, len(words.text), *(x for r in words.hidden + words.deleted for x in r)})
        for a, b in zip(cuts, cuts[1:]):
            say(words.text[a:b])
            spans.extend((len(parts) - 1, name, 0) for name, ranges in (("hidden", words.hidden), ("deleted", words.deleted)) if any(x <= a and b <= y for x, y in ranges) and len(parts) > base)

    for m in TOKEN.finditer(source):
        prose(source[done : m.start()])
        done = m.end()
        kind = m.lastgroup if m.lastgroup in ("run", "gone", "escape", "tag") else next(g for g in ("code", "auto", "wiki", "link", "escape", "tag", "run", "gone") if m[g] is not None)
        if kind == "code":
            inner = m["inner"].replace("\n", " ")
            say(inner[1:-1] if inner[:1] == inner[-1:] == " " and inner.strip() else inner)
        elif kind == "escape":
            say(m[0][1:])
        elif kind == "auto":
            say(m["url"])
        elif kind == "tag":
            name = re.match(r"<(/?)\s*([A-Za-z]*)", m[0])
            word = name[2].lower()
            if word in ("ruby", "rt", "rtc", "rp"):
                if not name[1]:
                    if word == "rt" and readings and readings[-1][-1:] not in (" ", "\n"):
                        readings.append(" ")
                    ruby.append(word)
                elif word in ruby:
                    del ruby[len(ruby) - 1 - ruby[::-1].index(word) :]
        elif kind == "wiki":
            before, bar, after = m["name"].partition("|")
            target = re.split(r"[#^]", before.rstrip("\\") if bar else before)[0].strip()
            display = after.strip() if bar else m["name"].strip()
            if target and target != display:
                say(target + " ")
                spans.append((len(parts) - 1, "hidden", 0))
            say(display)
        elif kind == "link":
            nested(m["label"])
        elif kind == "gone":
            say("~~", "gone")
        else:
            before, after = source[m.start() - 1 : m.start()] or " ", source[m.end() : m.end() + 1] or " "
            mark = lambda c: not (c.isalnum() or c.isspace())
            left = not after.isspace() and (not mark(after) or before.isspace() or mark(before))
            right = not before.isspace() and (not mark(before) or after.isspace() or mark(after))
            under = m[0][0] == "_"
            say(m[0], "run", left and (not under or not right or mark(before)), right and (not under or not left or mark(after)))
    prose(source[done:])
    texts = _unmarked(parts)
    out, at, open_ = Words(), [0], None
    for k, text in enumerate(texts):
        if parts[k][1] == "gone":  # a pair of marks deletes what lies between; the marks themselves aren't shown
            if open_ is None:
                open_ = at[-1]
            else:
                out.hidden += [(open_, open_ + 2), (at[-1], at[-1] + 2)]
                out.deleted.append((open_ + 2, at[-1]))
                open_ = None
        at.append(at[-1] + len(text))
    for k, name, _ in spans:
        getattr(out, name).append((at[k], at[k + 1]))
    out.text = "".join(texts)
    if readings:
        out.text += "\n" + "".join(readings)
    out.hidden.sort()
    out.deleted.sort()
    return out


COMMENT = re.compile(r"%%.*?(?:%%|\Z)", re.S)
ADDRESS = re.compile(r"(?:^|[ \t])\^[A-Za-z0-9-]+[ \t]*$")
ROLE = re.compile(r"[ \t]*\{[^{}]*\}[ \t]*$")
LIMIT = re.compile(r"\[[ xX]\][ \t]+")


def without_comments(body: str) -> str:
    """``%%`` comments taken out, but for line breaks, where they stand outside code."""
    if "%%" not in body:
        return body
    code = code_lines(scan(body))
    lines = body.split("\n")
    masked = "\n".join(re.sub(r"[^\n]", "\0", x) if k in code else re.sub(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", lambda m: "\0" * len(m[0]), x) for k, x in enumerate(lines))
    out, done = [], 0
    for m in COMMENT.finditer(masked):
        out += [body[done : m.start()], "\n" * m[0].count("\n")]
        done = m.end()
    return "".join([*out, body[done:]])


def _cells(line: str) -> list[str]:
    inner = re.sub(r"^[ \t]*\|?|\|?[ \t]*$", "", line)
    return [x.strip().replace("\\|", "|") for x in re.split(r"(?<!\\)\|", inner)]


def plain_blocks(body: str) -> dict:
    """plain: the text of all blocks, a line break between two; blocks: where each ends, its kind and level; fences, hidden and deleted: ranges of plain."""
    text, blocks, fences, hidden, deleted = "", [], [], [], []

    def add(words: Words, kind: str, level: int = 0, fence: bool = False) -> None:
        nonlocal text
        own = words.text.rstrip("\n") if kind == "code" else words.text.strip()
        if not own.strip():
            return
        skip = 0 if kind == "code" else len(words.text) - len(words.text.lstrip())
        if text:
            text += "\n"
        base = len(text)
        text += own
        blocks.append({"stop": len(text), "kind": kind, "level": level})
        if fence:
            fences.append({"start": base, "stop": len(text)})
        for ranges, to in ((words.hidden, hidden), (words.deleted, deleted)):
            to += [{"start": base + max(0, a - skip), "stop": min(base + b - skip, len(text))} for a, b in ranges if b - skip > 0]

    for leaf in scan(without_comments(body)):
        if leaf.kind in ("fence", "code"):
            add(Words("\n".join(leaf.lines)), "code", fence=leaf.kind == "fence")
        elif leaf.kind == "heading":
            said = "\n".join(leaf.lines)
            words = inline(ADDRESS.sub("", ROLE.sub("", said)))
            if (role := ROLE.search(said)) and words.text:  # findable, but not shown
                at = len(words.text)
                words.text += " " + role[0].strip()
                words.hidden.append((at, len(words.text)))
            add(words, "heading", leaf.level)
        elif leaf.kind == "paragraph":
            lines = [ADDRESS.sub("", x) for x in leaf.lines]
            while lines and DEFINITION.match(lines[0]):
                del lines[0]
            if len(lines) > 1 and "|" in lines[1] + lines[0] and DELIMITERS.match(lines[1]) and len(_cells(lines[0])) == len(_cells(lines[1])):
                for line in (lines[0], *lines[2:]):
                    for cell in _cells(line):
                        add(inline(cell), "cell")
                continue
            if leaf.callout:
                add(inline(re.sub(r"^\[![A-Za-z-]+\][+-]?[ \t]*", "", lines[0])), "callout")
                del lines[0]
            if lines:
                lines[0] = LIMIT.sub("", lines[0], count=1) if leaf.depth and LIMIT.match(lines[0]) else re.sub(r"^\[\^[^\]\s]+\]:[ \t]*", "", lines[0])
            add(inline("\n".join(lines)), "paragraph")
    return {"plain": text, "blocks": blocks, "fences": fences, "hidden": hidden, "deleted": deleted}
