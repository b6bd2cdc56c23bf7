"""The course grammar on one body that breaks every rule, and what it lists."""

from quire.operators import courses

BODY = """# Course {sequence=primary}
- [[before]]
- group {sequence=local}
  - [[a0]]
- [[p0]]
  - [[c0]]

## Silent
- [[one]]
- [[two]] and [[three]]
- see [[four]]
- [ ] [[task]]

## Main {sequence=primary}
1. [[five|Five]] glosses
   - side {sequence=local}
     - [[six]]
     - deeper {sequence=local}
       - [[seven]]
     - wrong {sequence=primary}
       - [[eight]]
2. [[nine]] {sequence=local}
   - [[ten]]
3. [[eleven]]
   - [[twelve]]
   - `{sequence=local}` is quoted
4. lonely {sequence=none}
5. orphan {sequence=local}
   - [[thirteen]]
6. `code` first [[fourteen]]
   {sequence=primary} here

### Twice {sequence=primary} {sequence=none}
### Bad {sequence=other}
### Mid {sequence=local} word
stray {sequence=local}

## Out {sequence=none}
- see [[fifteen]]
- [[a]] [[b]]
- inner {sequence=primary}
  - [[sixteen]]
### Below {sequence=primary}
### Quiet
- [[seventeen]]

```
## fenced {sequence=other}
- [[x]] [[y]]
```
"""


def test_courses(spark):
    notes = spark.createDataFrame([("c.md", BODY, 1), ("d.md", "## A {sequence=primary}\n- [[x]]\n- [[y]]", 5), ("e.md", None, 1)], "path string, body string, first int")
    rows = courses.placed(courses.rows(notes))
    lines = {n: x for n, x in enumerate(BODY.split("\n"), 1)}
    at = lambda text: next(n for n, x in lines.items() if text in x)
    want = {
        ("role_misplaced", at("# Course")), ("entry_outside_branch", at("[[before]]")), ("entry_outside_branch", at("- group")), ("local_orphan", at("- group")), ("entry_outside_branch", at("[[p0]]")), ("entry_outside_branch", at("[[c0]]")),
        ("role_missing", at("## Silent")), ("entry_multi_target", at("[[two]]")), ("entry_noncanonical", at("[[four]]")),
        ("nesting_too_deep", at("deeper")), ("local_orphan", at("deeper")), ("role_nested_primary", at("wrong")), ("role_on_entry", at("[[nine]]")), ("local_orphan", at("[[nine]]")), ("role_missing", at("[[twelve]]")),
        ("role_misplaced", at("lonely")), ("local_orphan", at("orphan")), ("entry_noncanonical", at("[[fourteen]]")), ("role_misplaced", at("} here")),
        ("role_duplicate", at("### Twice")), ("role_invalid", at("### Bad")), ("role_misplaced", at("### Mid")), ("role_misplaced", at("stray")),
        ("role_conflict", at("- inner")), ("role_conflict", at("### Below")),
    }
    got = {(r.rule_id.removeprefix("course."), r.line) for r in courses.diagnostics(rows).where("path = 'c.md'").collect()}
    assert got == want, (sorted(got - want), sorted(want - got))
    assert {"course." + r for r, _ in got} == set(courses.RULES)
    assert courses.diagnostics(rows).where("path <> 'c.md'").count() == 0
    listed = {r.line: r for r in courses.entries(rows).where("path = 'c.md'").collect()}
    assert listed[at("[[five")].target == "five" and listed[at("[[five")].state == "accepted" and listed[at("[[five")].role == "primary" and listed[at("[[five")].number == 1
    assert listed[at("[[six]]")].role == "local" and listed[at("[[nine]]")].state == "role_on_entry" and listed[at("[[twelve]]")].role == "undeclared" and at("[[task]]") not in listed and at("[[before]]") not in listed
    assert [(r.line, r.number) for r in courses.entries(rows).where("path = 'd.md'").orderBy("line").collect()] == [(6, 1), (7, 2)]


def test_disk(spark):
    listed = spark.createDataFrame([("c", 1, "a", "unique", True, False), ("c", 2, "b", "unresolved", False, False), ("c", 3, "d", "ambiguous", True, False), ("c", 4, "e", "ambiguous", False, True)], "path string, line int, target string, resolution string, claimed boolean, under_gap boolean")
    assert sorted((r.line, r.severity) for r in courses.disk_mismatch(listed).collect()) == [(2, 1), (4, 0)]
    paths = spark.createDataFrame([("c1", "x", 1), ("c2", "x", 2), ("c3", None, 3)], "path string, domain string, ord int")
    lessons = spark.createDataFrame([("l1", "x", False), ("l2", "x", False), ("l3", "x", True), ("l4", None, False), ("l5", "y", False), ("l6", "x", False)], "path string, domain string, draft boolean")
    lists = spark.createDataFrame([("c1", "l1"), ("c2", "l2"), ("c3", "l6")], "course string, path string")
    assert [(r.path, r.course) for r in courses.disk_unlisted(paths, lessons, lists).collect()] == [("l6", "c1")]
