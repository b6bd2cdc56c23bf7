"""Block structure on examples of the CommonMark specification, plain text with its ranges, typed values, and folds with their way back."""

import random
import unicodedata

import pytest

from quire.functions import text as T
from quire.sources import blocks as B
from quire.sources import notes as N

EXAMPLES = [
    ("- foo\n\n\tbar", [("paragraph", 1, "foo"), ("paragraph", 1, "bar")]),
    ("- foo\n\n      bar", [("paragraph", 1, "foo"), ("code", 1, "bar")]),
    ("- foo\n  - bar\n    - baz", [("paragraph", 1, "foo"), ("paragraph", 2, "bar"), ("paragraph", 3, "baz")]),
    ("- `one\n- two`", [("paragraph", 1, "`one"), ("paragraph", 1, "two`")]),
    ("***\n---\n___", [("rule", 0, "***"), ("rule", 0, "---"), ("rule", 0, "___")]),
    ("+++", [("paragraph", 0, "+++")]),
    ("    ***", [("code", 0, "***")]),
    ("Foo\n    ***", [("paragraph", 0, "Foo\n***")]),
    ("- foo\n***\n- bar", [("paragraph", 1, "foo"), ("rule", 0, "***"), ("paragraph", 1, "bar")]),
    ("Foo\n---\nbar", [("heading2", 0, "Foo"), ("paragraph", 0, "bar")]),
    ("* Foo\n* * *\n* Bar", [("paragraph", 1, "Foo"), ("rule", 0, "* * *"), ("paragraph", 1, "Bar")]),
    ("- Foo\n- * * *", [("paragraph", 1, "Foo"), ("rule", 1, "* * *")]),
    ("####### foo", [("paragraph", 0, "####### foo")]),
    ("#5 bolt", [("paragraph", 0, "#5 bolt")]),
    ("#  foo #  ", [("heading1", 0, "foo")]),
    ("### foo ### b", [("heading3", 0, "foo ### b")]),
    ("##\n#\n### ###", [("heading2", 0, ""), ("heading1", 0, ""), ("heading3", 0, "")]),
    ("foo\n    # bar", [("paragraph", 0, "foo\n# bar")]),
    ("Foo *bar\nbaz*\n====", [("heading1", 0, "Foo *bar\nbaz*")]),
    ("> Foo\n---", [("paragraph", 1, "Foo"), ("rule", 0, "---")]),
    ("> foo\nbar\n===", [("paragraph", 1, "foo\nbar\n===")]),
    ("- Foo\n---", [("paragraph", 1, "Foo"), ("rule", 0, "---")]),
    ("- foo\n-----", [("paragraph", 1, "foo"), ("rule", 0, "-----")]),
    ("Foo\n= =\n\nFoo\n--- -", [("paragraph", 0, "Foo\n= ="), ("paragraph", 0, "Foo"), ("rule", 0, "--- -")]),
    ("    chunk1\n\n    chunk2\n  \n \n \n    chunk3", [("code", 0, "chunk1\n\nchunk2\n\n\n\nchunk3")]),
    ("```\n<\n >\n```", [("fence", 0, "<\n >")]),
    ("``\nfoo\n``", [("paragraph", 0, "``\nfoo\n``")]),
    ("```\naaa\n~~~\n```", [("fence", 0, "aaa\n~~~")]),
    ("````\naaa\n```\n``````", [("fence", 0, "aaa\n```")]),
    ("```", [("fence", 0, "")]),
    ("`````\n\n```\naaa", [("fence", 0, "\n```\naaa")]),
    ("> ```\n> aaa\n\nbbb", [("fence", 1, "aaa"), ("paragraph", 0, "bbb")]),
    ("   ```\n   aaa\n    aaa\n  aaa\n   ```", [("fence", 0, "aaa\n aaa\naaa")]),
    ("    ```\n    aaa\n    ```", [("code", 0, "```\naaa\n```")]),
    ("``` ```\naaa", [("paragraph", 0, "``` ```\naaa")]),
    ("~~~ aa ``` ~~~\naaa\n~~~", [("fence", 0, "aaa")]),
    ("foo\n```\nbar\n```\nbaz", [("paragraph", 0, "foo"), ("fence", 0, "bar"), ("paragraph", 0, "baz")]),
    ("<table><tr><td>\n<pre>\n**Hello**,\n\n_world_.\n</pre>\n</td></tr></table>", [("html", 0, "<table><tr><td>\n<pre>\n**Hello**,"), ("paragraph", 0, "_world_.\n</pre>"), ("html", 0, "</td></tr></table>")]),
    ("<pre language=\"haskell\"><code>\nimport\n\nmain\n</code></pre>\nokay", [("html", 0, "<pre language=\"haskell\"><code>\nimport\n\nmain\n</code></pre>"), ("paragraph", 0, "okay")]),
    ("<!-- Foo\n\nbar\n   baz -->\nokay", [("html", 0, "<!-- Foo\n\nbar\n   baz -->"), ("paragraph", 0, "okay")]),
    ("Foo\n<div>\nbar\n</div>", [("paragraph", 0, "Foo"), ("html", 0, "<div>\nbar\n</div>")]),
    ("Foo\n<a href=\"bar\">\nbaz", [("paragraph", 0, "Foo\n<a href=\"bar\">\nbaz")]),
    ("<del>\n*foo*\n</del>", [("html", 0, "<del>\n*foo*\n</del>")]),
    ("<del>*foo*</del>", [("paragraph", 0, "<del>*foo*</del>")]),
    ("> # Foo\n> bar\n> baz", [("heading1", 1, "Foo"), ("paragraph", 1, "bar\nbaz")]),
    ("># Foo\n>bar\n> baz", [("heading1", 1, "Foo"), ("paragraph", 1, "bar\nbaz")]),
    ("> bar\nbaz\n> foo", [("paragraph", 1, "bar\nbaz\nfoo")]),
    ("> - foo\n- bar", [("paragraph", 2, "foo"), ("paragraph", 1, "bar")]),
    (">     foo\n    bar", [("code", 1, "foo"), ("code", 0, "bar")]),
    ("> ```\nfoo\n```", [("fence", 1, ""), ("paragraph", 0, "foo"), ("fence", 0, "")]),
    ("> foo\n    - bar", [("paragraph", 1, "foo\n- bar")]),
    (">\n> foo\n>  ", [("paragraph", 1, "foo")]),
    ("> foo\n\n> bar", [("paragraph", 1, "foo"), ("paragraph", 1, "bar")]),
    ("> bar\n\nbaz", [("paragraph", 1, "bar"), ("paragraph", 0, "baz")]),
    ("> > > foo\nbar", [("paragraph", 3, "foo\nbar")]),
    (">     code\n\n>    not code", [("code", 1, "code"), ("paragraph", 1, "not code")]),
    ("1.  A paragraph\n    with two lines.\n\n        indented code\n\n    > A block quote.", [("paragraph", 1, "A paragraph\nwith two lines."), ("code", 1, "indented code"), ("paragraph", 2, "A block quote.")]),
    ("- one\n\n two", [("paragraph", 1, "one"), ("paragraph", 0, "two")]),
    (" -    one\n\n     two", [("paragraph", 1, "one"), ("code", 0, " two")]),
    (" -    one\n\n      two", [("paragraph", 1, "one"), ("paragraph", 1, "two")]),
    ("   > > 1.  one\n>>\n>>     two", [("paragraph", 3, "one"), ("paragraph", 3, "two")]),
    (">>- one\n>>\n  >  > two", [("paragraph", 3, "one"), ("paragraph", 2, "two")]),
    ("-one\n\n2.two", [("paragraph", 0, "-one"), ("paragraph", 0, "2.two")]),
    ("1234567890. not ok", [("paragraph", 0, "1234567890. not ok")]),
    ("- foo\n\n  bar\n\n\n  baz", [("paragraph", 1, "foo"), ("paragraph", 1, "bar"), ("paragraph", 1, "baz")]),
    ("1.     indented code\n\n   paragraph\n\n       more code", [("code", 1, "indented code"), ("paragraph", 1, "paragraph"), ("code", 1, "more code")]),
    ("-\n  foo\n-\n  ```\n  bar\n  ```\n-\n      baz", [("paragraph", 1, "foo"), ("fence", 1, "bar"), ("code", 1, "baz")]),
    ("-\n\n  foo", [("paragraph", 0, "foo")]),
    ("foo\n*\n\nfoo\n1.", [("paragraph", 0, "foo\n*"), ("paragraph", 0, "foo\n1.")]),
    ("    1.  A paragraph", [("code", 0, "1.  A paragraph")]),
    ("  1.  A paragraph\nwith two lines.\n\n          indented code", [("paragraph", 1, "A paragraph\nwith two lines."), ("code", 1, "indented code")]),
    ("> 1. > Blockquote\ncontinued here.", [("paragraph", 3, "Blockquote\ncontinued here.")]),
    ("- foo\n - bar\n  - baz\n   - boo", [("paragraph", 1, x) for x in ("foo", "bar", "baz", "boo")]),
    ("10) foo\n    - bar", [("paragraph", 1, "foo"), ("paragraph", 2, "bar")]),
    ("10) foo\n   - bar", [("paragraph", 1, "foo"), ("paragraph", 1, "bar")]),
    ("- - foo", [("paragraph", 2, "foo")]),
    ("- # Foo\n- Bar\n  ---\n  baz", [("heading1", 1, "Foo"), ("heading2", 1, "Bar"), ("paragraph", 1, "baz")]),
    ("The number is\n14.  The doors", [("paragraph", 0, "The number is\n14.  The doors")]),
    ("The number is\n1.  The doors", [("paragraph", 0, "The number is"), ("paragraph", 1, "The doors")]),
    ("- a\n - b\n  - c\n   - d\n    - e", [("paragraph", 1, "a"), ("paragraph", 1, "b"), ("paragraph", 1, "c"), ("paragraph", 1, "d\n- e")]),
    ("* a\n  > b\n  ```\n  c\n  ```\n- d", [("paragraph", 1, "a"), ("paragraph", 2, "b"), ("fence", 1, "c"), ("paragraph", 1, "d")]),
    ("1. ```\n   foo\n   ```\n\n   bar", [("fence", 1, "foo"), ("paragraph", 1, "bar")]),
    ("aaa\n             bbb", [("paragraph", 0, "aaa\nbbb")]),
    ("\tfoo\tbaz", [("code", 0, "foo baz")]),
    (" - foo\n   - bar\n\t - baz", [("paragraph", 1, "foo"), ("paragraph", 2, "bar"), ("paragraph", 3, "baz")]),
]


@pytest.mark.parametrize("source, want", EXAMPLES)
def test_structure(source, want):
    assert [(x.kind + (str(x.level) if x.level else ""), x.depth, "\n".join(x.lines)) for x in B.scan(source)] == want


def test_lines_belong_to_one_leaf():
    rng = random.Random(3)
    pieces = ["> ", "- ", "1. ", "  ", "    ", "```", "# a", "text", "---", "===", "<div>", "<!--", "-->", "", "\t", "[a]: b", "* * *", "~~~~"]
    for _ in range(3000):
        body = "\n".join("".join(rng.choice(pieces) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(0, 12)))
        leaves = B.scan(body)
        spans = [(x.first, x.last) for x in leaves]
        assert all(a <= b for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:])), body
        assert all(not x.lines or len(x.lines) <= x.last - x.first + 1 for x in leaves)
        B.plain_blocks(body)


@pytest.mark.parametrize("source, want", [
    ("*foo bar*", "foo bar"), ("a * foo bar*", "a * foo bar*"), ("foo*bar*", "foobar"), ("_ foo bar_", "_ foo bar_"), ("foo_bar_", "foo_bar_"), ("__foo__bar", "__foo__bar"), ("foo-_(bar)_", "foo-(bar)"), ("**foo bar**", "foo bar"), ("a**\"foo\"**", "a**\"foo\"**"),
    ("*foo**bar**baz*", "foobarbaz"), ("***foo** bar*", "foo bar"), ("foo***bar***baz", "foobarbaz"), ("*foo**", "foo*"), ("**foo*", "*foo"), ("*foo _bar* baz_", "foo _bar baz_"), ("*foo\nbar*", "foo\nbar"), ("`a*b*`", "a*b*"), ("`` a`b ``", "a`b"),
    ("\\*x\\*", "*x*"), ("&lt;b&gt; &copy;", "<b> ©"), ("<b>x</b><!-- no -->y", "xy"), ("<https://a.b/c>", "https://a.b/c"), ("[a *b*](c \"t\")", "a b"), ("![alt [x]](y)", "alt [x]"), ("[[T]]", "T"), ("[[T#h|d]]", "T d"), ("[[#h]]", "#h"), ("![[pic.png]]", "pic.png"),
    ("<ruby>日<rp>(</rp><rt>ni</rt><rp>)</rp>本<rt>hon</rt></ruby>語", "日本語\nni hon"), ("3 < 4 > 2", "3 < 4 > 2"),
])
def test_inline(source, want):
    assert B.inline(source).text == want


def test_plain_blocks():
    body = "# A {sequence=primary}\n\nOne [[Target|shown]] ~~gone~~ %%no\n\nno%% two. ^id\n\n| h | i |\n|---|---|\n| [[x]] | `y` |\n\n- [ ] do\n\n> [!note] Said\n> more\n\n```\ncode  [[c]]\n```\n\n[r]: u\nrest[^1]\n\n[^1]: foot\n"
    got = B.plain_blocks(body)
    plain, cut = got["plain"], lambda r: got["plain"][r["start"] : r["stop"]]
    assert plain.split("\n") == ["A {sequence=primary}", "One Target shown ~~gone~~", "two.", "h", "i", "x", "y", "do", "Said", "more", "code  [[c]]", "rest[^1]", "foot"]
    assert [plain[a["stop"] : b["stop"]].strip("\n") for a, b in zip([{"stop": 0}, *got["blocks"]], got["blocks"])] == plain.split("\n")
    assert [b["kind"] for b in got["blocks"]] == ["heading", "paragraph", "paragraph", *["cell"] * 4, "paragraph", "callout", "paragraph", "code", "paragraph", "paragraph"]
    assert [cut(r) for r in got["hidden"]] == [" {sequence=primary}", "Target ", "~~", "~~"] and [cut(r) for r in got["deleted"]] == ["gone"] and [cut(r) for r in got["fences"]] == ["code  [[c]]"]


def test_code_in_containers_has_no_links():
    body = "> ```\n> [[a]]\n> ```\n\n- x\n\n      [[b]]\n\n- ~~~\n  [[c]]\n  ~~~\n\n> # [[d]]\n\n[[e]] `[[f]]`\n\nTitle `code`\nmore\n===\n"
    note = N.parse(body, "stem", [], [])
    assert [x["target"] for x in note["links"]] == ["d", "e"]
    assert [(h["level"], h["text"], h["line"]) for h in note["headings"]] == [(1, "Title `code` more", 17)]


def test_typed_values():
    source = 'a: true\nb: "true"\nc: TRUE\nd: yes\ne: 0x1F\nf: 1.50\ng: 2024-01-02\nh: ~\ni:\nj: [1, true, "x"]\nk: {x: 1}\nl: !!str true\nm: |\n  12\nn: 007\n'
    scalars, lists, nested, kinds, bad = N.frontmatter(source)
    assert not bad and not nested and kinds == dict(zip("abcdefghijklmn", "bool text bool text int float date null null list map text text int".split()))
    assert [scalars[k] for k in "abcdefghl"] == ["true", "true", "true", "yes", "31", "1.50", "2024-01-02", "", "true"] and lists["j"] == ["1", "true", "x"] and scalars["n"] == "7"


def test_fold_and_back():
    rng = random.Random(9)
    parts = ["a", "É", "é", "漢", "字", "\n", " ", "Ａ", "ß", "ﬁ", "K", "각", "각", "が", "x̣́", "i̇", "\U0001f600"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        folded = T.Folded(text)
        assert folded.text == T.fold(text)
        for i in range(len(folded.text)):
            a, b = folded.start(i), folded.stop(i + 1)
            assert 0 <= a < b <= len(text) or folded.text[i] == "\n"
            if folded.text[i] != "\n" and unicodedata.is_normalized("NFC", text):
                assert T.fold(text[a:b]).strip("\n") == folded.text[i]
        assert "".join(t for t, _ in T.hit_runs(text, [folded.text[:2]])) == text
    assert [t for t, hit in T.hit_runs("x CAFÉ y 東\n京", ["café", "東京"]) if hit] == ["CAFÉ", "東\n京"]
