"""The declared contract of a collection: TOML, validated strictly, as small tables.

A contract is read against a shape (``SHAPE``): what tables and keys there are and of what kind each value is.
Keys of declared tables are found whatever their letter case, so two that differ only by case are refused, and so
is every key outside the shape. Three parts stand by themselves: the withheld folders, the template folders and the
roles of types. A fault in one of these is no refusal of the contract; it closes what reads that part: nothing may leave,
no note counts as a template, no note is a course, and ``faults`` says why.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
import tomllib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from quire.functions import text as T

PATH = "System/schemas/vault-schema.toml"
VERSION = "2"
LARGEST, DEEPEST, LONGEST = 256 << 10, 32, 256
ROLES = ("lesson", "course", "map", "thought")
CONCEPT = "concept"
#: Fields of notes, names that are always allowed, and names that a note may not take its provenance from (fixed values).
FIELDS = ("type", "aliases", "draft", "based_on", "lang", "created", "slug", "level", "prerequisites", "verified_on", "verified_with")
RESERVED = ("tags", "aliases", "cssclasses")
ALWAYS = ("type", "draft", *RESERVED)
DERIVED = ("domain", "title")
REMOVED = ("status", "replaces", "supersedes", "superseded_by", "archived", "published", "topics", "updated", "source_kind", "source_provider", "map_kind")
#: Marks of a contract that names none (fixed values).
GAP_MARKS = ("缺口", "待補", "待寫", "待整理", "待建")
INLINE_MARKS = ("待整理", "待建", "下一課")

#: Kinds: str, bool, list (of strings), a dict of keys, or {"*": kind} for a table whose keys are names of its own.
SHAPE = {
    "schema_version": str,
    "folders": {"checked": list, "ignored": list, "templates": list, "journal": str, "domain_from": list, "skipped_files": list, "frontmatter_optional": bool},
    "enums": {"*": list},
    "fields": {"common": list, "required": list},
    "types": {"*": {"role": str, "required": list, "fields": list, "slug_pattern": str}},
    "rules": {"concept_requires_provenance": list, "planned_gap_marks": list, "planned_inline_marks": list},
    "privacy": None,  # judged by itself
}


class ContractError(ValueError):
    """The contract doesn't say what it must."""


@dataclass
class Contract:
    types: dict[str, dict] = field(default_factory=dict)
    enums: dict[str, list[str]] = field(default_factory=dict)
    common: list[str] = field(default_factory=list)
    required: list[str] = field(default_factory=list)
    checked: list[str] = field(default_factory=list)
    ignored: list[str] = field(default_factory=list)
    templates: list[str] = field(default_factory=list)
    domain_from: list[str] = field(default_factory=list)
    journal: str = ""
    skipped_files: list[str] = field(default_factory=list)
    requires_frontmatter: bool = False
    provenance: list[str] = field(default_factory=list)
    withheld: list[str] | None = None  # None: nothing may leave
    gap_marks: list[str] = field(default_factory=lambda: [*GAP_MARKS])
    inline_marks: list[str] = field(default_factory=lambda: [*INLINE_MARKS])
    faults: dict[str, str] = field(default_factory=dict)  # by part: privacy, templates, journal, roles
    digest: str = ""

    def of_role(self, role: str) -> list[str]:
        """The types that hold a role; none does where the roles can't be told."""
        return [] if "roles" in self.faults else [k for k, t in self.types.items() if t["role"] == role]

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """types, enums, allowed and required fields; as many rows as the file declares."""
        common = dict.fromkeys([*self.common, *ALWAYS])
        allowed = [(None, f) for f in common] + [(k, f) for k, t in self.types.items() for f in dict.fromkeys([*t["fields"], *(self.provenance if k == CONCEPT else [])])]
        required = [(k, f) for k, t in self.types.items() for f in dict.fromkeys([*self.required, *t["required"]])]
        enums = [(f, v) for f, values in self.enums.items() for v in values] + [("type", k) for k in self.types]
        return {
            "types": spark.createDataFrame([(k, t["role"] or None, t["slug_pattern"] or None) for k, t in self.types.items()], "type string, role string, slug_pattern string"),
            "enums": spark.createDataFrame(enums, "field string, value string"),
            "allowed": spark.createDataFrame(allowed, "type string, field string"),
            "required": spark.createDataFrame(required, "type string, field string"),
        }


def folded(key: str) -> str:
    """Letters that are one but for case, one for one (ß isn't ss)."""
    return "".join(c.casefold() if len(c.casefold()) == 1 else c.lower() for c in key)


def _walk(value, path: tuple[str, ...] = (), depth: int = 0) -> Iterator[tuple[tuple[str, ...], object, int]]:
    yield path, value, depth
    items = value.items() if isinstance(value, dict) else [("", x) for x in value] if isinstance(value, list) else ()
    for key, x in items:
        yield from _walk(x, (*path, key) if key or isinstance(value, dict) else path, depth + 1)


def _read(data: bytes) -> dict:
    """The TOML tree, within bounds of size and nesting and without keys that fold together."""
    if len(data) > LARGEST:
        raise ContractError(f"the contract is over {LARGEST} bytes")
    try:
        tree = tomllib.loads(data.decode())
    except (tomllib.TOMLDecodeError, UnicodeDecodeError, RecursionError) as e:
        raise ContractError(f"the contract can't be read: {e}") from e
    pairs = []
    for path, value, depth in _walk(tree):
        if depth > DEEPEST or len(path) > DEEPEST or len(".".join(path).encode()) > LONGEST:
            raise ContractError("the contract nests too deep")
        if isinstance(value, dict):
            seen: dict[str, str] = {}
            for key in sorted(value):
                other = seen.setdefault(folded(key), key)
                if other != key:
                    pairs.append(f"{'.'.join((*path, other))} and {'.'.join((*path, key))}")
    if pairs:
        raise ContractError("keys differ only by letter case: " + "; ".join(pairs))
    return tree


def _shaped(tree: dict, shape: dict, path: str, unknown: list[str]) -> dict:
    """The tree under the shape's own names; values of another kind are refused, unknown keys are noted."""
    if "*" in shape:
        return {key: _value(x, shape["*"], f"{path}{key}", unknown) for key, x in tree.items()}
    names, out = {folded(k): k for k in shape}, {}
    for key, x in tree.items():
        if (name := names.get(folded(key))) is None:
            unknown.append(f"{path}{key}")
        else:
            out[name] = _value(x, shape[name], f"{path}{key}", unknown)
    return out


def _value(x, kind, path: str, unknown: list[str]):
    if kind is None:
        return x
    if isinstance(kind, dict):
        if not isinstance(x, dict):
            raise ContractError(f"{path} must be a table")
        return _shaped(x, kind, path + ".", unknown)
    if kind is list and isinstance(x, list) and all(isinstance(w, str) for w in x):
        return [*x]
    if kind is not list and isinstance(x, kind):
        return x
    raise ContractError(f"{path} must be {'a list of strings' if kind is list else 'a string' if kind is str else 'true or false'}")


def _distinct(values: list[str], name: str) -> list[str]:
    if "" in values:
        raise ContractError(f"{name}: empty value")
    if again := next((v for k, v in enumerate(values) if v in values[:k]), None):
        raise ContractError(f"{name}: duplicate value {again!r}")
    return values


def _within(values: list[str], allowed, name: str, of: str) -> None:
    if stray := next((v for v in values if v not in allowed), None):
        raise ContractError(f"{name}: {stray!r} is not {of}")


def _component(name: str) -> bool:
    return name not in ("", ".", "..") and not re.search(r"[\0/\\]", name)


def _folder(declared: str) -> str | None:
    """A declared folder from the root, or None if it can't be one."""
    if not declared or "\\" in declared or ".." in declared.split("/") or declared.startswith("/"):
        return None
    clean = posixpath.normpath(T.nfc(declared))
    return None if clean == "." else clean


def _pattern_fault(pattern: str) -> str:
    if not pattern or "\0" in pattern or pattern.startswith("/") or pattern == ".":
        return "is no relative path"
    if posixpath.normpath(pattern) != pattern or ".." in pattern.split("/"):
        return "is no clean path"
    if re.search(r"\\$|\[(?:\^)?\]|\[[^\]\\]*(?:\\.[^\]\\]*)*$", pattern):
        return "is no pattern"
    return ""


def _types(declared: dict[str, dict], named: list[str]) -> dict[str, dict]:
    """Types by name, first those of enums.type: a table of its own or a place there declares one."""
    blank = {"role": "", "required": [], "fields": [], "slug_pattern": ""}
    out: dict[str, dict] = {}
    _distinct([n for n in named if n], "enums.type")
    for name in dict.fromkeys([*named, *declared]):
        word = T.nfc(name)
        if not word:
            raise ContractError("types: empty type name")
        if word in out:
            raise ContractError(f"types: duplicate type {word!r}")
        out[word] = blank | declared.get(name, {})
    return out


def _check_type(name: str, t: dict, everywhere: list[str], provenance: list[str]) -> None:
    _within(_distinct(t["fields"], f"types.{name}.fields"), (*FIELDS, *RESERVED, *provenance), f"types.{name}.fields", "a field of notes")
    own = {*everywhere, *t["fields"], *provenance}
    _within(_distinct(t["required"], f"types.{name}.required"), own, f"types.{name}.required", f"listed in types.{name}.fields")
    needs = {"lesson": "slug", "thought": "based_on"}.get(t["role"])
    if needs and needs not in own:
        raise ContractError(f"types.{name}: the {t['role']} role needs {needs} in its fields")
    if t["slug_pattern"]:
        if "slug" not in own:
            raise ContractError(f"types.{name}.slug_pattern: the type doesn't list slug in its fields")
        try:
            re.compile(t["slug_pattern"])
        except re.error as e:
            raise ContractError(f"types.{name}.slug_pattern: {e}") from e


def _roles_fault(types: dict[str, dict]) -> str:
    for name, t in types.items():
        if t["role"] not in ("", *ROLES):
            return f"type {name!r} has the unknown role {t['role']!r}"
    for role in ("lesson", "thought"):  # roles of one type
        holders = [name for name, t in types.items() if t["role"] == role]
        if len(holders) > 1:
            return f"types {holders[0]!r} and {holders[1]!r} both hold the {role} role"
    return ""


def _privacy(section) -> tuple[list[str] | None, str]:
    """Withheld folders, or None and why: whatever isn't exactly as it must be withholds everything."""
    if section is None:
        return None, "no privacy table"
    if not isinstance(section, dict):
        return None, "privacy is no table"
    keys = {folded(k): v for k, v in section.items()}
    if unknown := sorted(k for k in section if folded(k) != "never_egress_dirs"):
        return None, "unknown keys " + ", ".join(f"privacy.{k}" for k in unknown)
    if "never_egress_dirs" not in keys:
        return None, "never_egress_dirs is missing"
    dirs = keys["never_egress_dirs"]
    if not isinstance(dirs, list) or not all(isinstance(d, str) for d in dirs):
        return None, "never_egress_dirs is no list of strings"
    clean = [_folder(d) for d in dirs]
    return (None, f"never_egress_dirs contains {dirs[clean.index(None)]!r}") if None in clean else (clean, "")


def parse(data: bytes) -> Contract:
    tree = _read(data)
    version = next((v for k, v in tree.items() if folded(k) == "schema_version"), None)
    if version != VERSION:  # before all else: another version has other tables
        raise ContractError(f"schema_version is {version!r}; it must be {VERSION!r}")
    unknown: list[str] = []
    doc = _shaped(tree, SHAPE, "", unknown)
    if unknown:
        raise ContractError("unknown keys: " + ", ".join(sorted(unknown)))
    folders, lists, rules, enums = (doc.get(k, {}) for k in ("folders", "fields", "rules", "enums"))
    types = _types(doc.get("types", {}), enums.pop("type", []))
    enums = {f: [T.nfc(v) for v in enums[f]] for f in sorted(enums)}
    for f, values in enums.items():
        _within([f], (*FIELDS, "domain"), f"enums.{f}", "a field of notes")
        _distinct(values, f"enums.{f}")
    common, required = lists.get("common", []), lists.get("required", [])
    everywhere = [*ALWAYS, *common]
    _within(_distinct(common, "fields.common"), (*FIELDS, *RESERVED), "fields.common", "a field of notes")
    _within(_distinct(required, "fields.required"), everywhere, "fields.required", "listed in fields.common")
    provenance = _distinct(rules.get("concept_requires_provenance", []), "rules.concept_requires_provenance")
    if shut := next((f for f in provenance if f in (*ALWAYS, *DERIVED, *REMOVED)), None):
        raise ContractError(f"rules.concept_requires_provenance: {shut!r} is built in, derived or removed")
    if CONCEPT in types and not provenance:
        raise ContractError("rules.concept_requires_provenance must not be empty where there are concepts")
    for name, t in types.items():
        _check_type(name, t, everywhere, provenance if name == CONCEPT else [])
    marks = [_distinct(rules.get(f"planned_{k}_marks", [*default]), f"rules.planned_{k}_marks") for k, default in (("gap", GAP_MARKS), ("inline", INLINE_MARKS))]
    roots = _distinct(folders.get("domain_from", []), "folders.domain_from")
    for key, fits, word in (("checked", _component, "top folder"), ("skipped_files", _component, "file name"), ("domain_from", lambda d: all(map(_component, d.split("/"))), "relative folder")):
        if bad := next((d for d in _distinct(folders.get(key, []), f"folders.{key}") if not fits(d)), None):
            raise ContractError(f"folders.{key}: {bad!r} is no {word}")
    for k, a in enumerate(roots):
        for b in roots[:k]:
            x, y = (folded(d).split("/") for d in (a, b))
            if x[: len(y)] == y or y[: len(x)] == x:
                raise ContractError(f"folders.domain_from: {b!r} and {a!r} overlap")
    for pattern in _distinct(folders.get("ignored", []), "folders.ignored"):
        if fault := _pattern_fault(pattern):
            raise ContractError(f"folders.ignored: {pattern!r} {fault}")
    withheld, private = _privacy(doc.get("privacy"))
    templates = [_folder(d) for d in folders.get("templates", [])]
    journal = _folder(folders["journal"]) if "journal" in folders else ""
    faults = {
        "privacy": private, "roles": _roles_fault(types), "journal": "journal is no folder" if journal is None else "",
        "templates": f"templates contains {folders['templates'][templates.index(None)]!r}" if None in templates else "",
    }
    return Contract(
        types, enums, common, required, folders.get("checked", []), folders.get("ignored", []), [] if None in templates else templates, roots, journal or "", folders.get("skipped_files", []),
        folders.get("frontmatter_optional") is False, provenance if CONCEPT in types else [], withheld, *marks, {k: v for k, v in faults.items() if v}, hashlib.sha256(data).hexdigest(),
    )
