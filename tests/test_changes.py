"""Transclusion, freshness and renewal of generations from what changed."""

import datetime as dt
import hashlib
import random

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import embeds as E
from quire.operators import resolve as R
from quire.operators import search as S
from quire.sources import notes as N
from quire.sources import vault as V
from quire.sources.pointer import Pointer
from quire.streaming.generations import Generations, freshness

NOTES = {
    "Host.md": "# Host\n\n![[Guest]]\n\n![[Guest#Part]]\n\n![[Guest#^b1]]\n\n![[Guest#^none]]\n\n![[Nobody]]\n\n![[pic.png]]\n",
    "Guest.md": "# Guest\n\nIntro %%hidden%% words\n\n## Part\n\nOne ![[Host]]\n\n### Below\n\n- item a\n- item b\n  more ^b1\n- item c\n\n## Part\n\nTwo\n",
    "Alone.md": "No embeds, [[Guest]].\n",
    "pic.png": "x",
}


def folder(root, files):
    for name, text in files.items():
        (root / name).write_text(text)
    return str(root)


def test_embeds(spark, tmp_path):
    found = V.scan(folder(tmp_path, NOTES))
    tables = N.tables(N.parsed(V.contents(spark, found)))
    names = R.claims(tables["notes"].select("path", "aliases"), found.frame(spark).where("not is_md"))
    rows, cut = E.of_notes(tables, R.resolve(tables["links"].withColumn("key", T.key_udf("target")), names))
    texts = {(r.kind, r.id): r.text for r in cut.where("source = 'Guest.md'").collect()}
    body = NOTES["Guest.md"].replace("%%hidden%%", "")
    assert texts[("note", "")] == body
    assert texts[("section", "part")] == "## Part\n\nOne ![[Host]]\n\n### Below\n\n- item a\n- item b\n  more ^b1\n- item c\n"
    assert texts[("block", "b1")] == "- item b\n  more ^b1" and texts[("block", "none")] is None
    got = [(r.path, r.absence, r.source, r.matches, r.nested) for r in rows.orderBy("path", "ord").collect()]
    assert got == [
        ("Guest.md", "", "Host.md", 1, 6), ("Host.md", "", "Guest.md", 1, 1), ("Host.md", "", "Guest.md", 2, 1), ("Host.md", "", "Guest.md", 1, 0),
        ("Host.md", "absent-address", "Guest.md", 0, 0), ("Host.md", "absent-note", "Nobody", 0, 0),
    ]
    frame = lambda v: f"{len(v.encode()):016X}{v.encode().hex().upper()}"
    digest = hashlib.sha256(NOTES["Host.md"].encode()).hexdigest()
    want = hashlib.sha256("".join(map(frame, ("", "Host.md", "1", digest))).encode()).hexdigest()
    stamps = {r.path: r.embeds for r in E.identities(rows).collect()}
    assert stamps["Guest.md"] == want and set(stamps) == {"Guest.md", "Host.md"}
    told = [(r.path, r.fault) for r in E.faults(rows).orderBy("path", "ord", "fault").collect()]
    assert told == [("Guest.md", "not-expanded"), ("Host.md", "not-expanded"), ("Host.md", "fragment-repeated"), ("Host.md", "not-expanded"), ("Host.md", "fragment-missing"), ("Host.md", "broken")]


def test_freshness(spark):
    page = spark.createDataFrame([(p, "x", e) for p, e in (("gone", None), ("lost", None), ("unknown", None), ("big", None), ("bigger", None), ("shut", None), ("late", None), ("embed", "e0"), ("same", "e1"), ("plain", None))] + [("old", "w", None)], "path string, page string, embeds string")
    disk = spark.createDataFrame([("lost", None, None, "lookup"), ("unknown", None, None, "lookup"), ("big", None, 99, None), ("bigger", None, 99, None), ("shut", None, 5, "read"), ("late", "y", 5, None), ("old", "x", 5, None), ("embed", "x", 5, None), ("same", "x", 5, None), ("plain", "x", 5, None)], "path string, disk string, size bigint, fault string")
    published = spark.createDataFrame([("lost", None, None), ("big", "x", None), ("bigger", None, None), ("shut", "x", None), ("late", "x", None), ("old", "x", None), ("embed", "x", "e1"), ("same", "x", "e1"), ("plain", "x", "e1"), ("gone", "x", None)], "path string, published string, embeds string")
    got = {r.path: r.state for r in freshness(page, disk, published, cap=50).collect()}
    assert got == {"gone": "gone", "lost": "unreadable", "unknown": "gone", "big": "preparing", "bigger": "stale", "shut": "unreadable", "late": "preparing", "old": "stale", "embed": "stale", "same": "unchanged", "plain": "unchanged"}


def test_pointer(spark, tmp_path):
    pointer = Pointer(spark, str(tmp_path / "deep" / "current"))
    assert pointer.read() is None
    for text in ("one", "zwei é", ""):
        pointer.write(text)
        assert pointer.read() == text
    assert [p.name for p in (tmp_path / "deep").iterdir() if not p.name.startswith(".")] == ["current"]


def test_renewal(spark, tmp_path):
    """Random edits: each generation is what a build from nothing gives, reads changed files only, and keeps what can't be read."""
    rng = random.Random(5)
    root = tmp_path / "v"
    root.mkdir()
    folder(root, {f"n{k}.md": f"# N{k}\n\n[[n{k + 1}]]\n" for k in range(8)})
    scan = lambda: V.scan(str(root)).frame(spark)
    columns = ("path", "error", "identity", "title")

    def parse(files):
        bodies = V.contents(spark, V.scan(str(root))).join(files.select("path"), "path", "left_semi")
        return N.parsed(bodies).select("path", F.col("note.error").alias("error"), "identity", F.col("note.title").alias("title"))

    g = Generations(spark, str(tmp_path / "g"), scan, lambda files, notes: {"titles": notes.select("path", "title")}, parse=parse)
    now = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    assert g.tick(now) == "published" and g.tick(now) == "unchanged" and g.state().tables == ["files", "notes", "titles"]
    rows = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    for turn in range(3):
        now += dt.timedelta(minutes=1)
        edited = {f"n{rng.randrange(8)}.md", f"m{turn}.md"}
        folder(root, {name: f"# Turn {turn} {'x' * rng.randrange(1, 50)}{turn}\n" for name in edited})
        there = sorted(p.name for p in root.iterdir() if p.name not in edited)
        (root / there[rng.randrange(len(there))]).unlink()
        assert g.tick(now) == "published"
        assert {r.path for r in g.read("read").collect()} == edited
        assert rows(g.read("notes")) == rows(parse(scan())) and not g.read("notes").where("stale").count()
    victim = sorted(p.name for p in root.iterdir())[0]
    before = [r for r in rows(g.read("notes")) if r[0] == victim]
    (root / victim).write_bytes(b"# bad \xff\xfe\n")
    assert g.tick(now + dt.timedelta(minutes=1)) == "published"
    kept = g.read("notes").where("stale")
    assert rows(kept) == before
    folder(root, {"new.md": "# New\n"})
    assert g.tick(now + dt.timedelta(minutes=2)) == "published"
    assert {r.path for r in g.read("read").collect()} == {victim, "new.md"}  # what was carried over is tried again
    folder(root, {victim: "# Good again\n"})
    assert g.tick(now + dt.timedelta(minutes=3)) == "published"
    assert not g.read("notes").where("stale").count() and rows(g.read("notes")) == rows(parse(scan()))


def test_resolve_again(spark):
    rng = random.Random(9)
    for _ in range(3):
        def corpus(old=None):
            out = {}
            for k in range(30):
                mine = ([f"a{rng.randrange(12)}" for _ in range(rng.randrange(3))], [f"a{rng.randrange(12)}" for _ in range(3)])
                if old is None or rng.random() < 0.2:
                    out[f"p{k}.md"] = mine
                elif f"p{k}.md" in old and rng.random() < 0.9:
                    out[f"p{k}.md"] = old[f"p{k}.md"]
            return out

        def tables(notes):
            claims = R.claims(spark.createDataFrame([(p, a) for p, (a, _) in notes.items()], "path string, aliases array<string>"))
            return claims, spark.createDataFrame([(p, n, t) for p, (_, ts) in notes.items() for n, t in enumerate(ts)], "path string, line int, key string")

        old = corpus()
        new = corpus(old)
        changed = spark.createDataFrame([(p,) for p in sorted(old.keys() | new.keys()) if old.get(p) != new.get(p)], "path string")
        (names_old, links_old), (names, links) = tables(old), tables(new)
        got = R.resolve_again(links, names, R.resolve(links_old, names_old), names_old, changed)
        want = R.resolve(links, names)
        plain = lambda df: sorted(map(repr, df.select("path", "line", "key", "paths", "located", "resolution").collect()))
        assert plain(got) == plain(want)


def test_step_backs(spark):
    assert S.step_backs('"red fox" go1234') == ["red fox go1234", "red fox go 1234", "red", "fox", "go1234"]
    assert S.step_backs('domain:en folder:"a b" fox OR den') == ['domain:en folder:"a b" fox', 'domain:en folder:"a b" den']
    assert S.step_backs("fox") == [] and S.step_backs("domain:en") == [] and S.step_backs("colour:red fox") == ["colour:red", "fox"]
    notes = spark.createDataFrame([("a.md", "Fox", [], [], "a red den"), ("b.md", "Den", [], [], "fox and den")], "path string, title string, aliases array<string>, tags array<string>, plain string")
    got = [(r["query"], r.n) for r in S.offered(S.index(notes), '"red den" "fox x" zzz').orderBy("rank").collect()]
    assert got == [("red", 1), ("den", 2), ("fox", 2), ("x", 2)]
