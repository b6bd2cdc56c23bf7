"""The check of a collection: every rule as a DataFrame of findings, then the filters in their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quire.functions import text as T
from quire.operators import courses as CO
from quire.operators import findings as Q
from quire.operators import resolve as R
from quire.operators import schema_rules as S
from quire.sources import contract as K
from quire.sources import notes as N
from quire.sources import vault as V
from quire.sources.contract import Contract


def _finding(rows: DataFrame, rule: str, severity: Column | int, message: Column, target: Column | None = None, line: str | None = None, members: Column | None = None, field: Column | None = None, printed: Column | None = None, path: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    target = none if target is None else target
    path = F.col("path") if path is None else path
    return rows.select(
        F.lit(rule).alias("rule_id"), (F.lit(severity) if isinstance(severity, int) else severity).alias("severity"), path.alias("path"), (F.col(line) if line else F.lit(None)).cast("int").alias("line"),
        (none if field is None else field).alias("field"), message.alias("message"), target.alias("target"), (F.array().cast("array<string>") if members is None else members).alias("members"),
        # what the fingerprint is of; it is worked out once, after the union of all rules
        (path if members is None or rule.startswith("link") else F.lit("")).alias("print_path"), F.coalesce(target if printed is None else printed, F.lit("")).alias("print_target"),
    )


def rules(spark: SparkSession, contract: Contract, files: DataFrame, tables: dict[str, DataFrame], skipped: DataFrame | None = None, partial: bool = False) -> DataFrame:
    """All findings of a parsed collection; ``partial``: some notes couldn't be read."""
    notes, every = tables["notes"], files.select("path")
    public = notes.where(Q.allowed(F.col("path"), contract.withheld if contract.withheld is not None else []))
    names = R.cut(R.claims(notes.select("path", "aliases"), files.where("not is_md")))
    links = tables["links"].withColumn("key", T.key_udf("target"))
    resolved = R.cut(R.resolve_with_suffixes(links, names, every, whole=False))  # some ten rules read it
    titles = public.select(T.key_udf("title").alias("key"), "path")
    planned = tables["planned"].select(T.key_udf("name").alias("key"))
    broken = R.broken(resolved, titles, planned)
    is_image = F.col("embed") & F.col("target").rlike(r"\.[A-Za-z0-9]{1,5}$")
    plain = broken.where(~is_image)
    soft = F.when(F.col("under_gap") | F.col("planned"), Q.INFO).otherwise(Q.WARN)
    target = F.col("target")
    link = lambda word: F.concat(F.lit("[["), target, F.lit(f"]] {word}"))
    out = [
        _finding(plain.where("rule = 'link.broken'"), "link.broken", soft, link("names no note"), target, "line"),
        _finding(plain.where("rule <> 'link.broken'"), "link.title_not_alias", Q.WARN, link("is a title, not a name"), target, "line", F.when(F.size("titled") > 1, F.col("titled")).otherwise(F.array().cast("array<string>"))),
        _finding(broken.where(is_image), "link.broken.image", Q.WARN, link("names no file"), target, "line"),
    ]
    images = tables["images"].withColumn("file", T.markdown_path_udf("path", "destination")).where("file is not null")
    out.append(_finding(R.missing_files(images, every), "link.broken.image", Q.WARN, F.concat("destination", F.lit(" is no file")), F.col("destination"), "line"))
    # a path that leaves the collection is information; one in code may be written from the root as well, and is lost if neither reading is a file
    refs = tables["path_refs"].withColumn("file", T.wide_path_udf("path", "destination")).where("file is not null")
    leaves = F.col("file").rlike(r"^\.\.(/|$)")
    from_root = refs.where("code").withColumn("file", T.markdown_path_udf(F.lit(""), "destination")).where("file is not null")
    lost = R.missing_files(refs.where(~F.col("code") & ~leaves), every).unionByName(
        R.missing_files(from_root, every).join(R.found_files(refs.where("code"), every).select("path", "line", "destination"), ["path", "line", "destination"], "left_anti")
    )
    for rows, severity, word in ((lost, Q.WARN, " is no file"), (refs.where(~F.col("code") & leaves), Q.INFO, " lies outside")):
        out.append(_finding(rows, "link.broken.path", severity, F.concat("destination", F.lit(word)), F.col("destination"), "line"))
    out.append(_finding(tables["unused_definitions"], "link.unused.definition", Q.INFO, F.concat(F.lit("["), "label", F.lit("] is defined and not used")), F.col("label")))
    # fragments
    unique = resolved.where("resolution = 'unique'").withColumn("target_path", F.col("paths")[0])
    heading = unique.where("heading <> '' and block = ''").withColumns({"kind": F.lit("section"), "id": T.section_id_udf("heading")})
    block = unique.where("block <> ''").withColumns({"kind": F.lit("block"), "id": F.lower("block")})
    section = lambda *ids: tables["headings"].select("path", F.explode(F.array(*ids)).alias("id")).withColumn("kind", F.lit("section"))
    blocks = tables["blocks"].select("path", "id").withColumn("kind", F.lit("block"))
    embeds = unique.where("embed").select("path", F.col("target_path").alias("target"))
    # links may name a heading as GitHub does, and headings of what the target embeds; embeds and blocks may not
    for rows, kind in ((heading, "section"), (block, "block")):
        for embed in (False, True):
            anchors = blocks if kind == "block" else section("section_id") if embed else section("section_id", "github_anchor")
            lost = R.missing_fragments(rows.where(F.col("embed") == embed), anchors, embeds if kind == "section" and not embed else None)
            rule = f"{'embed' if embed else 'link'}.{kind}_missing"
            what = F.concat(target, F.lit("#"), F.col("heading") if kind == "section" else F.concat(F.lit("^"), F.col("block")))
            out.append(_finding(lost, rule, Q.WARN, F.concat(F.lit("[["), what, F.lit(f"]]: no such {kind}")), what, "line"))
    # collisions: withheld members leave before they are counted
    mine = R.claims(public.select("path", "aliases"), files.where("not is_md").where(Q.allowed(F.col("path"), contract.withheld or [])))
    aliased = R.alias_collisions(mine)
    # a collection that lacks notes can't say that no link uses a name: then every shared name counts
    several = R.collisions(mine, None if partial else links.join(public.select("path"), "path", "left_semi")).join(aliased.select("key"), "key", "left_anti")
    for rows, rule in ((aliased, "collision.alias"), (several, "collision.name")):
        out.append(_finding(rows, rule, Q.WARN, F.concat("key", F.lit(" names several files")), F.col("key"), members=F.col("members"), path=F.col("members")[0]))
    # provenance
    based = tables["refs"].where("field in ('based_on', 'related')").withColumn("key", T.key_udf("target"))
    slugs = R.by_slug(notes.withColumn("ord", F.col("sort_key")))
    value = F.col("value")
    out.append(_finding(R.provenance(based, names, slugs), "provenance.unresolved", Q.WARN, F.concat(F.col("field"), F.lit(" -> "), value, F.lit(" resolves to nothing")), value, field=F.col("field")))
    thoughts = notes.where(F.col("type").isin(*contract.of_role("thought"))).select("path")
    through = based.where("field = 'based_on'").join(thoughts, "path", "left_semi").join(R.only_by_alias(names).select("key", F.col("path").alias("resolved_to")), "key")
    out.append(_finding(through, "provenance.alias_resolved", Q.WARN, F.concat(F.lit("based_on -> "), value, F.lit(" resolves only through an alias")), value, field=F.lit("based_on")))
    # schema
    notes = notes.where(~Q.below(F.col("path"), contract.templates))  # templates are no instances
    faults = S.frontmatter_faults(notes)
    if not contract.requires_frontmatter:
        faults = faults.where("value <> 'missing'")
    out.append(_finding(faults, "schema.frontmatter", Q.ERROR, F.concat(F.lit("frontmatter is "), value), value))
    records = notes.where("has_fm and not bad_fm").select("path", "type", F.col("fm").alias("fields"), "kinds")
    tabs = contract.tables(spark)
    enums = tabs["enums"]
    ruled = [
        S.enum_violations(records, enums), S.unknown_keys(records, tabs["allowed"]), S.missing_required(records, tabs["required"]), S.bad_slugs(records, {k: t["slug_pattern"] for k, t in contract.types.items() if t["slug_pattern"]}),
        S.bad_languages(records), S.bad_drafts(records), S.untyped_dependent(records, tabs["allowed"]),
    ]
    if contract.provenance:
        ruled.append(S.without_provenance(records, "concept", contract.provenance))
    for rows in ruled:
        named = rows.withColumn("field", F.coalesce("field", F.lit("")))
        printed = F.concat("field", F.lit("\x1f"), F.coalesce(value, F.lit("")))
        # the rule's own name is a column here
        own = named.select(
            "rule_id", F.lit(Q.ERROR).alias("severity"), "path", F.lit(None).cast("int").alias("line"), F.col("field"), F.concat_ws(" ", F.col("rule_id"), F.col("field"), value).alias("message"),
            value.alias("target"), F.array().cast("array<string>").alias("members"), F.col("path").alias("print_path"), printed.alias("print_target"),
        )
        out.append(own)
    nested = notes.select("path", F.explode("nested").alias("field")).where("field in ('based_on', 'related', 'prerequisites')")
    out.append(_finding(nested, "schema.reference_nested_sequence", Q.ERROR, F.concat("field", F.lit(" nests a list")), F.col("field"), field=F.col("field")))
    out.append(_finding(S.unmatched_directories(every, contract.checked).withColumn("path", F.col("value")), "schema.unmatched_knowledge_dir", Q.ERROR, F.concat(value, F.lit(" holds no file")), value))
    out.append(_finding(tables["callouts"].where("markup"), "callout.title_markup", Q.INFO, F.concat(F.lit("callout title carries markup: "), F.col("title")), F.col("title"), "line", printed=F.concat(F.col("line").cast("string"), F.lit("\x1f"), F.col("title"))))
    if skipped is not None:
        out.append(_finding(skipped, "scan.skipped", Q.WARN, F.concat(F.lit("skipped: "), F.col("kind")), F.col("kind")))
    # courses: the grammar's own reports, and units that no note answers or no course lists
    studies = notes.where(F.col("type").isin(*contract.of_role("course")))
    own = R.cut(CO.placed(CO.rows(studies.select("path", "body", F.col("body_line").alias("first")))))
    grammar = CO.diagnostics(own)
    shown = F.when(F.col("evidence") == "", "the branch lists rows but declares no part in the course").otherwise(F.col("evidence"))
    none = F.lit(None).cast("string")
    out.append(grammar.withColumn("evidence", shown).select(
        "rule_id", F.lit(Q.WARN).alias("severity"), "path", "line", none.alias("field"), F.concat_ws(": ", "rule_id", "evidence").alias("message"), none.alias("target"), F.array().cast("array<string>").alias("members"),
        F.col("path").alias("print_path"), F.col("evidence").alias("print_target"),
    ))
    units = CO.entries(own).where("target is not null").select("path", "line", F.col("target").alias("unit")).join(
        resolved.where("not embed").select("path", "line", "target", F.col("target").alias("unit"), "resolution", "paths", F.coalesce("located", F.lit(False)).alias("claimed"), "under_gap"), ["path", "line", "unit"]
    )
    out.append(_finding(CO.disk_mismatch(units), "course.disk_mismatch", F.col("severity"), F.concat(F.lit("course links [["), target, F.lit("]] but it resolves to nothing")), target, "line"))
    domains = contract.domain_from
    place = F.split("path", "/")
    domain = F.col("fm")["domain"] if not domains else F.coalesce(F.col("fm")["domain"], F.when(place[0].isin(*domains) & (F.size(place) > 2), place[1]))
    paths = studies.select("path", domain.alias("domain"), F.col("sort_key").alias("ord"))
    lessons = notes.where(F.col("type").isin(*contract.of_role("lesson"))).select("path", domain.alias("domain"), F.coalesce((F.col("fm")["draft"] == "true") & (F.col("kinds")["draft"] == "bool"), F.lit(False)).alias("draft"))
    lists = units.where("resolution = 'unique'").select(F.col("path").alias("course"), F.col("paths")[0].alias("path"))
    out.append(_finding(CO.disk_unlisted(paths, lessons, lists), "course.disk_unlisted", Q.WARN, F.concat(F.lit("unit is on disk but not listed in course "), "course"), F.col("path"), printed=F.col("course")))
    every_rule = Q.merged(*out).withColumn("seq", F.col("rule_seq"))
    return every_rule.withColumn("fingerprint", T.fingerprint_udf("rule_id", "print_path", "print_target")).drop("print_path", "print_target")


def check(spark: SparkSession, root: str, contract: Contract, every: bool = False, scopes: list[str] = (), complete: bool = True) -> DataFrame:
    """Findings of a folder: rules, partial-corpus drop, egress, knowledge layer, scope, unreadable files, order."""
    found = V.scan(root, contract, complete)
    # every rule reads the parsed notes; a lost block is parsed again from its files
    parsed = N.parsed(V.contents(spark, found), contract.gap_marks, contract.inline_marks).persist()
    tables = N.tables(parsed)
    unreadable = tables["unreadable"].unionByName(found.unreadable_frame(spark))
    partial = not unreadable.isEmpty()
    out = rules(spark, contract, found.frame(spark), tables, found.skipped_frame(spark), partial)
    out = Q.partial_corpus(out, F.lit(partial))
    out = Q.egress(out, contract.withheld)
    if not every:
        inside = Q.knowledge(F.col("path"), contract.checked)
        out = out.where(inside | F.exists("members", lambda m: Q.knowledge(m, contract.checked)))
    if scopes:
        out = Q.in_scope(out, Q.scopes(list(scopes), contract.withheld, found.frame(spark)))
    # past the scope's filters: what couldn't be read or judged at all
    lost = lost_files(unreadable, contract.withheld)
    closed = Q.navigation_unavailable(contract.tables(spark)["types"].withColumn("collection", F.lit(K.PATH))).select(F.col("collection").alias("path"))
    closed = _finding(closed, Q.NO_NAVIGATION, Q.ERROR, F.lit("a type's role can't be used, so no note is known as a course or a map and the rules about these did not run"))
    last = lost.unionByName(closed).withColumns({"rule_seq": F.lit(99), "seq": F.lit(99)})
    return Q.ordered(out.unionByName(last.withColumn("fingerprint", T.fingerprint_udf("rule_id", "print_path", "print_target")).drop("print_path", "print_target")))


def lost_files(unreadable: DataFrame, withheld: list[str] | None) -> DataFrame:
    """One finding for each unreadable file that may be named, and one without path or cause for all others together.

    A cause is part of the message only: its wording differs between machines and must not move a baseline."""
    named = unreadable.where(Q.allowed(F.col("path"), withheld))
    rest = unreadable.where(~Q.allowed(F.col("path"), withheld)).limit(1).select(F.lit("").alias("path"))
    shown = _finding(named, "scan.unreadable", Q.ERROR, F.concat(F.lit("can't be read, so nothing was judged from it: "), F.col("cause")))
    return shown.unionByName(_finding(rest, "scan.unreadable", Q.ERROR, F.lit("a file in a withheld folder can't be read")))
