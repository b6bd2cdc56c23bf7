"""A small folder of notes, parsed and checked end to end."""

import datetime as dt

import pytest

from quire.operators import check as C
from quire.operators import findings as Q
from quire.sources import contract as K
from quire.sources import notes as N
from quire.sources import stores
from quire.sources import vault as V
from quire.streaming.generations import Generations, backoff

CONTRACT = b"""
schema_version = "2"
[folders]
checked = ["Ideas", "Courses", "Empty"]
domain_from = ["Ideas"]
frontmatter_optional = true
skipped_files = ["README.md"]
ignored = ["Old*"]
[enums]
level = ["easy", "hard"]
[fields]
common = ["type", "aliases", "lang"]
[types.note]
fields = ["based_on", "level"]
[types.lesson]
role = "lesson"
required = ["slug"]
fields = ["slug"]
slug_pattern = "^[a-z-]+$"
[types.concept]
[types.thought]
role = "thought"
fields = ["based_on"]
[rules]
concept_requires_provenance = ["based_on"]
planned_gap_marks = ["To write"]
[privacy]
never_egress_dirs = ["Secret"]
"""

FILES = {
    "Ideas/Trees.md": "---\ntype: note\naliases: [Arbor]\n---\n# Trees and forests\n\nSee [[Leaf]], [[No such]], [[Arbor]], [[Trees#Roots]] and `[[code]]`.\n\n## Roots\n\nDeep ^r1\n\n## To write\n\n- Moss、Fern (soon) / Bark\n",
    "Ideas/Leaf.md": "---\ntype: note\naliases: Arbor\nlevel: odd\nunknown: 1\n---\n# Leaf\n\n[[Trees#Nothing]] [[Trees#^r1]] [[Trees#^r2]] ![[gone.png]] [[Moss]] [[Trees and forests]]\n\n![x](../img/lost.png) [t](Trees.md) [u](Gone.md)\n\n> [!note] A **bold** title\n",
    "Ideas/Why.md": "---\ntype: concept\n---\nNo source.\n",
    "Ideas/Open.md": "---\ntype: note\nnever closed\n",
    "Courses/One.md": "---\ntype: lesson\nslug: Bad Slug\ndraft: maybe\n---\n# One\n",
    "Courses/Two.md": "---\ntype: lesson\nlang: not a tag\n---\n# Two\n",
    "Courses/Thought.md": "---\ntype: thought\nbased_on: ['[[Arbor]]', '[[Nowhere]]', [[x]]]\n---\n",
    "Secret/Diary.md": "[[No such]]\n",
    "README.md": "not a note",
    "Older/x.md": "[[No such]]",
    "node_modules/a.md": "x",
    ".hidden/b.md": "x",
    "img/tree.png": "x",
    "build/c.md": "x",
}


@pytest.fixture(scope="module")
def vault(tmp_path_factory):
    root = tmp_path_factory.mktemp("vault")
    for name, text in FILES.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (root / ".gitignore").write_text("build/\n*.tmp\n!keep.tmp\n")
    (root / "Ideas" / "link.md").symlink_to(root / "Ideas" / "Leaf.md")
    return str(root)


def test_scan(vault):
    found = V.scan(vault, K.parse(CONTRACT))
    paths = [f[0] for f in found.files]
    assert paths == ["Courses/One.md", "Courses/Thought.md", "Courses/Two.md", "Ideas/Leaf.md", "Ideas/Open.md", "Ideas/Trees.md", "Ideas/Why.md", "img/tree.png", "Secret/Diary.md"]
    assert found.skipped == [("Ideas/link.md", "symbolic link")]


def test_ignore_rules():
    rules = V.ignore_rules("# no\n*.log\n!keep.log\n/top\ndocs/**/draft\nout/\n")
    asked = {"a.log": True, "x/keep.log": False, "top": True, "x/top": False, "docs/a/b/draft": True, "out": False}
    assert {p: V.ignored(rules, p, False) for p in asked} == asked
    assert V.ignored(rules, "x/out", True)


def test_contract_faults():
    with pytest.raises(K.ContractError):
        K.parse(b"schema_version = '1'")
    with pytest.raises(K.ContractError):
        K.parse(b"schema_version = '2'\n[types.lesson]\nrole = 'lesson'\n")


def test_note_parser():
    note = N.parse(FILES["Ideas/Trees.md"], "Trees", ["To write"], [])
    assert note["title"] == "Trees and forests" and note["fm"]["type"] == "note" and note["lists"]["aliases"] == ["Arbor"]
    assert [x["target"] for x in note["links"]] == ["Leaf", "No such", "Arbor", "Trees"]
    assert note["links"][3]["heading"] == "Roots" and note["blocks"] == [{"line": 11, "id": "r1"}]
    assert note["planned"] == ["Moss", "Fern", "Bark"] and [h["section_id"] for h in note["headings"]] == ["trees-and-forests", "roots", "to-write"]
    assert N.wikilink(r"a\|b") == {"target": "a", "display": "b", "heading": "", "block": ""}
    assert not N.parse(r"\[[shown]] <!-- [[c]] --> %%[[d]]", "x", [], [])["links"]
    assert N.parse("---\na: 1\na: 2\n---\n", "x", [], [])["bad_fm"]
    assert N.frontmatter("a: [1, [2]]")[2] == ["a"]


def test_check(spark, vault):
    rows = C.check(spark, vault, K.parse(CONTRACT)).collect()
    got = {(r.rule_id, r.path, r.target) for r in rows}
    must = {
        ("link.broken", "Ideas/Trees.md", "No such"),
        ("link.broken", "Ideas/Leaf.md", "Moss"),
        ("link.title_not_alias", "Ideas/Leaf.md", "Trees and forests"),
        ("link.broken.image", "Ideas/Leaf.md", "gone.png"),
        ("link.broken.image", "Ideas/Leaf.md", "../img/lost.png"),
        ("link.broken.path", "Ideas/Leaf.md", "Gone.md"),
        ("link.section_missing", "Ideas/Leaf.md", "Trees#Nothing"),
        ("link.block_missing", "Ideas/Leaf.md", "Trees#^r2"),
        ("collision.alias", "Ideas/Leaf.md", "arbor"),
        ("schema.enum", "Ideas/Leaf.md", "odd"),
        ("schema.frontmatter", "Ideas/Open.md", "unclosed"),
        ("schema.slug", "Courses/One.md", "Bad Slug"),
        ("schema.draft", "Courses/One.md", "maybe"),
        ("schema.language", "Courses/Two.md", "not a tag"),
        ("provenance.unresolved", "Courses/Thought.md", "[[Nowhere]]"),
        ("schema.unmatched_knowledge_dir", "Empty", "Empty"),
        ("scan.skipped", "Ideas/link.md", "symbolic link"),
        ("callout.title_markup", "Ideas/Leaf.md", "A **bold** title"),
    }
    assert must <= got, must - got
    assert {r.field for r in rows if r.rule_id == "schema.unknown_key"} == {"unknown"}
    assert {(r.path, r.field) for r in rows if r.rule_id == "schema.required"} == {("Courses/Two.md", "slug")}
    assert not any(r.path.startswith("Secret") for r in rows)
    assert {r.severity for r in rows if r.target == "Moss"} == {Q.INFO}
    assert rows == sorted(rows, key=lambda r: (r.path, r.line or 0, r.rule_id, r.seq))
    scoped = C.check(spark, vault, K.parse(CONTRACT), scopes=["Courses"]).collect()
    assert scoped and all(r.path.startswith("Courses") for r in scoped)


def test_baseline_and_sink(spark, vault, tmp_path):
    found = C.check(spark, vault, K.parse(CONTRACT))
    names = {0: "info", 1: "warn", 2: "error"}
    assert len(names) == 3
    stores.write_findings(found, str(tmp_path / "run"))
    known = stores.read_baseline(spark, str(tmp_path / "run"))
    assert Q.beyond_baseline(found, known).count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.jsonl").write_text('{"rule_id":"x","fingerprint":"v0:1"}\n')
    with pytest.raises(Exception):
        stores.read_baseline(spark, str(tmp_path / "bad")).collect()


def test_generations(spark, vault, tmp_path):
    contract = K.parse(CONTRACT)
    broken = []

    def build(files):
        if broken:
            raise RuntimeError("no")
        return {"notes": N.tables(N.parsed(V.contents(spark, V.scan(vault, contract))))["notes"].drop("fm", "lists")}

    g = Generations(spark, str(tmp_path / "g"), lambda: V.scan(vault, contract).frame(spark), build)
    now = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    assert g.tick(now) == "published" and g.tick(now) == "unchanged"
    assert g.tick(now + dt.timedelta(hours=2)) == "published" and g.state().generation == 2
    broken.append(1)
    later = now + dt.timedelta(hours=4)
    assert g.tick(later).startswith("failed") and g.tick(later) == "waiting"
    assert g.read("notes").count() == 8 and g.read("notes", 1).count() == 8
    for k in range(1, 4):
        g.tick(later + dt.timedelta(minutes=2 * k))
    assert g.state().degraded
    assert backoff(1).seconds == 2 and backoff(2).seconds == 4 and backoff(20).seconds == 60


WHOLE = """
schema_version = "2"
[folders]
checked = ["Ideas"]
ignored = ["Old*", "a/b?"]
templates = ["System/templates/"]
journal = "Journal"
domain_from = ["Ideas", "Courses/more"]
skipped_files = ["README.md"]
frontmatter_optional = false
[enums]
type = ["note", "map"]
level = ["éasy", "hard"]
domain = ["x"]
[fields]
common = ["aliases", "lang"]
required = ["type"]
[types.lesson]
role = "lesson"
fields = ["slug", "level"]
required = ["slug"]
slug_pattern = "^[a-z]+$"
[types.map]
role = "map"
[types.concept]
[rules]
concept_requires_provenance = ["source_url"]
[privacy]
never_egress_dirs = ["Secret/", "A//B"]
"""


def test_contract(spark):
    c = K.parse(WHOLE.encode())
    assert [*c.types] == ["note", "map", "lesson", "concept"] and c.of_role("map") == ["map"] and c.types["note"] == {"role": "", "required": [], "fields": [], "slug_pattern": ""}
    assert c.enums == {"domain": ["x"], "level": ["éasy", "hard"]} and c.withheld == ["Secret", "A/B"] and c.templates == ["System/templates"] and c.requires_frontmatter and not c.faults
    assert c.gap_marks == [*K.GAP_MARKS] and c.inline_marks == [*K.INLINE_MARKS] and c.ignored == ["Old*", "a/b?"]
    tables = {k: {tuple(r) for r in t.collect()} for k, t in c.tables(spark).items()}
    assert {("concept", "source_url"), (None, "lang"), (None, "draft"), ("lesson", "level")} <= tables["allowed"] and ("type", "note") in tables["enums"]
    assert tables["required"] == {(k, "type") for k in c.types} | {("lesson", "slug")}
    # an empty list tracks nothing, letter case of keys is free, only the written flag asks for frontmatter
    c = K.parse(b'schema_version = "2"\n[Rules]\nPlanned_Gap_Marks = []\n[privacy]\nnever_egress_dirs = []\n')
    assert c.gap_marks == [] and c.inline_marks and c.withheld == [] and not c.requires_frontmatter and c.types == {}


@pytest.mark.parametrize("old, new", [
    ('"2"', '"1"'), ('schema_version = "2"', ""), ('"2"', "2"), ("[fields]", "[field]"), ("[fields]", "[unknown]\n[fields]"), ("role =", "colour ="), ("ignored =", "skipped_dirs ="), ("[types.concept]", "[types.concept]\nRole = 'map'\nrole = 'map'"),
    ("[fields]", "[Folders]\n[fields]"), ('checked = ["Ideas"]', 'checked = "Ideas"'), ('checked = ["Ideas"]', 'checked = ["Ideas", "Ideas"]'), ('checked = ["Ideas"]', 'checked = ["a/b"]'), ('"Old*"', '"/Old"'), ('"Old*"', '"a/../b"'), ('"Old*"', '"[a"'), ('"Old*"', '""'),
    ('"Courses/more"', '"Ideas/more"'), ('"Courses/more"', '"../x"'), ('"README.md"', '"a/README.md"'), ("frontmatter_optional = false", 'frontmatter_optional = "no"'), ('["note", "map"]', '["note", "note"]'), ('["note", "map"]', '["note", ""]'), ('"hard"]', '"éasy"]'),
    ("level = [", "colour = ["), ('"aliases", "lang"', '"aliases", "colour"'), ('required = ["type"]', 'required = ["level"]'), ('"slug", "level"', '"slug", "colour"'), ('required = ["slug"]', 'required = ["created"]'), ('fields = ["slug", "level"]\nrequired = ["slug"]', ""),
    ('"^[a-z]+$"', '"["'), ('["source_url"]', "[]"), ('["source_url"]', '["tags"]'), ('["source_url"]', '["status"]'), ("[types.concept]", "[types.thought]\nrole = 'thought'\n[types.concept]"), ("[types.concept]", '[types.concept]\n[types."é"]\n[types."é"]'),
    ("[privacy]", "[enums.level]\n[privacy]"), ("[privacy]", "[" + ".".join(["types", *"a" * 40]) + "]\n[privacy]"), ('"README.md"', '"' + "x" * (1 << 18) + '"'), ("[folders]", "folders = 1\n[privacy2]"),
])
def test_contract_refusals(old, new):
    assert old in WHOLE
    with pytest.raises(K.ContractError):
        K.parse(WHOLE.replace(old, new, 1).encode())


def test_contract_parts():
    """Faults of the withheld folders, templates, journal and roles close these parts only."""
    private = '[privacy]\nnever_egress_dirs = ["Secret/", "A//B"]\n'
    for new in ("", "[privacy]\n", "[privacy]\nnever_egress_dirs = 'Secret'\n", "[privacy]\nnever_egress_dirs = ['../x']\n", "[privacy]\nnever_egress_dirs = ['a\\\\b']\n", "[privacy]\nnever_egress_dirs = []\nmore = 1\n", "[privacy]\nnever_egress_dirs = [1]\n", "[privacy]\nnever_egress_dirs = ['']\n"):
        c = K.parse(WHOLE.replace(private, new).encode())
        assert c.withheld is None and [*c.faults] == ["privacy"], new
    c = K.parse(WHOLE.replace('"System/templates/"', '"ok", "/x"').replace('journal = "Journal"', 'journal = ".."').encode())
    assert c.templates == [] and c.journal == "" and {*c.faults} == {"templates", "journal"}
    for old, new in (('role = "map"', 'role = "atlas"'), ('role = "map"', 'role = "lesson"\nfields = ["slug"]')):
        c = K.parse(WHOLE.replace(old, new).encode())
        assert [*c.faults] == ["roles"] and c.of_role("lesson") == []


def test_withheld_roles_and_lost_notes(spark, tmp_path):
    """Excluded folders, one row for withheld files that can't be read, refused roles, and shared names of a partial collection."""
    for name in ("a/Same.md", "b/Same.md", "Old/x.md", "Courses/C.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("---\ntype: course\n---\n# C\n\n- [[Nothing]]\n")
    contract = 'schema_version = "2"\n[folders]\nignored = ["Old"]\n[types.course]\nrole = "course"\n%s[privacy]\nnever_egress_dirs = ["Secret"]\n'
    got = C.check(spark, str(tmp_path), K.parse((contract % "").encode())).collect()
    assert not [r for r in got if r.rule_id in ("scan.unreadable", Q.NO_NAVIGATION, "collision.name")] and not any("Old" in r.path for r in got)
    for name in ("Secret/one.md", "Secret/two.md", "open.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"\xff\xfe broken")
    got = C.check(spark, str(tmp_path), K.parse((contract % "[types.x]\nrole = 'odd'\n").encode())).collect()
    lost = [(r.path, r.target) for r in got if r.rule_id == "scan.unreadable"]
    assert lost == [("", None), ("open.md", None)] and len({r.fingerprint for r in got if r.rule_id == "scan.unreadable"}) == 2
    assert [(r.path, r.severity) for r in got if r.rule_id == Q.NO_NAVIGATION] == [(K.PATH, Q.ERROR)]
    assert not any(r.rule_id.startswith("course.") for r in got) and not any("Secret" in r.message for r in got)


def test_lost_notes_keep_shared_names(spark):
    """A name that two files share counts where notes are missing, whether or not a link uses it."""
    from quire.operators import resolve as R

    names = spark.createDataFrame([("same", "a/Same.md", "name", None), ("same", "b/Same.md", "name", None)], "key string, path string, kind string, located boolean")
    links = spark.createDataFrame([], "key string")
    assert R.collisions(names, links).count() == 0 and R.collisions(names, None).count() == 1
