"""Ranked search over folded text, facets and suggestions.

A query is a small driver-side value: tokens, structured filters and unknown keys. The documents are a
table with folded columns, written once; a search is a filter, a bucket expression and a top-k.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.functions import text as T

TITLE, BODY, TAG, PATH = 0, 1, 2, 3
KEYS = ("type", "draft", "domain", "slug", "folder")
QUOTES = {'"': '"', "「": "」", "『": "』"}


@dataclass
class Query:
    tokens: list[str] = field(default_factory=list)
    filters: list[tuple[str, str]] = field(default_factory=list)
    unknown: list[str] = field(default_factory=list)
    plain: list[str] = field(default_factory=list)  # bare terms as typed
    words: list[str] = field(default_factory=list)  # these and the words of phrases, in order
    phrased: bool = False  # whether a phrase was quoted


def parse(text: str) -> Query:
    """Terms, quoted phrases and key:value filters; an unknown key stays a term and is told."""
    out = Query()
    at = 0
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        if text[at] in QUOTES and (end := text.find(QUOTES[text[at]], at + 1)) > 0:
            if phrase := text[at + 1 : end].strip():
                out.tokens.append(T.fold(phrase))
                out.words += phrase.split()
                out.phrased = True
            at = end + 1
            continue
        m = re.compile(r'([A-Za-z]+):(?:"([^"]*)"|(\S*))').match(text, at)
        if m and (value := m[2] if m[2] is not None else m[3]):
            key = m[1].lower()
            if key in KEYS:
                out.filters.append((key, value))
                at = m.end()
                continue
            if key not in ("http", "https"):
                out.unknown.append(key)
        word = re.compile(r"\S+").match(text, at)[0]
        out.tokens.append(T.fold(word))
        out.plain.append(word)
        out.words.append(word)
        at += len(word)
    return out


def spelled(query: Query) -> str:
    """The text of a query; parsing it gives the query again."""
    quote = lambda v: f'"{v}"' if re.search(r"\s", v) else v
    return " ".join([*map(quote, query.tokens), *(f"{k}:{quote(v)}" for k, v in query.filters)])


def with_filter(query: Query, key: str, value: str) -> Query:
    kept = [f for f in query.filters if f[0] != key]
    return Query(query.tokens, [*kept, (key, value)], query.unknown, query.plain)


def without_filter(query: Query, key: str) -> Query:
    return Query(query.tokens, [f for f in query.filters if f[0] != key], query.unknown, query.plain)


def index(notes: DataFrame, fold=T.fold_udf) -> DataFrame:
    """The folded columns that searches read (notes: path, title, aliases, tags, plain, and metadata)."""
    each = lambda c: F.transform(c, lambda x: F.lower(x))
    return notes.select("*", fold("title").alias("title_fold"), fold("plain").alias("plain_fold"), fold("path").alias("path_fold"), each("aliases").alias("alias_folds"), each("tags").alias("tag_folds"))


def contains_all(hay: Column, tokens: list[str]) -> Column:
    """Every token occurs; a token with blanks is a phrase that may break across lines."""
    out = F.lit(True)
    for t in tokens:
        out = out & (hay.rlike(T.phrase_pattern(t)) if re.search(r"\s", t) else hay.contains(t))
    return out


def filtered(docs: DataFrame, filters: list[tuple[str, str]]) -> DataFrame:
    """All structured filters hold; a folder holds what lies below it, segment by segment."""
    for key, value in filters:
        if key == "folder":
            docs = docs.where(F.lower("path").startswith(value.strip("/").lower() + "/"))
        elif key == "draft":
            docs = docs.where(F.col("draft") == (value.lower() == "true"))
        else:
            docs = docs.where(F.lower(key) == value.lower())
    return docs


def evidence(tokens: list[str]) -> Column:
    """The strongest kind of match: title (or an alias), body, tag, path; null for none."""
    tags = [t.removeprefix("#") for t in tokens]
    alias = F.exists("alias_folds", lambda a: contains_all(a, tokens))
    tag = F.exists("tag_folds", lambda a: contains_all(a, tags))
    return (
        F.when(contains_all(F.col("title_fold"), tokens) | alias, TITLE)
        .when(contains_all(F.col("plain_fold"), tokens), BODY)
        .when(tag, TAG)
        .when(contains_all(F.col("path_fold"), tokens), PATH)
    )


def hits(docs: DataFrame, query: Query) -> DataFrame:
    """All hits with their bucket and whether the title is the query."""
    if not query.tokens and not query.filters:
        return docs.where(F.lit(False)).withColumn("bucket", F.lit(TITLE)).withColumn("exact", F.lit(False))
    found = filtered(docs, query.filters)
    found = found.withColumn("bucket", evidence(query.tokens) if query.tokens else F.lit(TITLE)).where("bucket is not null")
    return found.withColumn("exact", (F.col("bucket") == TITLE) & (F.col("title_fold") == " ".join(query.tokens)))


def ranked(found: DataFrame, limit: int, outside: Column | None = None, key: str = "path") -> DataFrame:
    """The best hits: bucket, exact titles, notes of the knowledge layer, path order."""
    outside = F.lit(False) if outside is None else outside
    return found.orderBy("bucket", F.desc("exact"), outside, key).limit(limit)


def recent(found: DataFrame, limit: int) -> DataFrame:
    return found.orderBy(F.desc_nulls_last("mtime"), "bucket", F.desc("exact"), "path").limit(limit)


def snippet(plain: Column, folded: Column, token: str, before: int = 40, after: int = 160) -> Column:
    """The text around the first match; a document without one gives its start."""
    at = F.instr(folded, token)
    return T.collapsed(F.substring(plain, F.greatest(at - before, F.lit(1)), F.lit(before + after)))


def facets(found: DataFrame, column: str, chosen: DataFrame | None = None) -> DataFrame:
    """Hits of each value of a facet, counted under the other facets' filters (``chosen``)."""
    return (found if chosen is None else chosen).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def places(found: DataFrame, least: int = 10) -> DataFrame:
    """Hits of each place: the first folder, or the first two where all hits share the first; none where there are only ``least`` hits or one place."""
    shape = found.agg(F.count("*").alias("hits"), F.count_distinct(T.place(F.col("path"), 1)).alias("tops"))
    both = found.crossJoin(F.broadcast(shape))  # one row
    place = F.when(F.col("tops") == 1, F.when(F.size(F.split(T.place(F.col("path"), 2), "/")) > 1, T.place(F.col("path"), 2))).otherwise(T.place(F.col("path"), 1))
    counted = both.where(F.col("hits") > least).groupBy(place.alias("place")).agg(F.count("*").alias("n")).where("place is not null")
    several = counted.agg((F.count("*") > 1).alias("several"))  # a row a place
    return counted.crossJoin(F.broadcast(several)).where("several").select("place", "n")


def answering_alias(aliases: Column, tokens: list[str]) -> Column:
    """The first alias that has all tokens."""
    return F.get(F.filter(aliases, lambda a: contains_all(F.lower(a), tokens)), 0)


def answer(docs: DataFrame, query: Query, trusted: bool) -> DataFrame:
    """Hits as ``hits`` gives them; a query of metadata gets none if the contract can't be trusted, and instances (column ``instance``) only."""
    metadata = any(key != "folder" for key, _ in query.filters)
    if metadata and not trusted:
        return hits(docs.where(F.lit(False)), query)
    return hits(docs.where("instance") if metadata else docs, query)


def page(found: DataFrame, number: int, size: int = 20) -> DataFrame:
    """A page of the ranked hits; a panel shows the first six."""
    return found.orderBy("bucket", F.desc("exact"), "path").offset(size * (number - 1)).limit(size)


def folder_panel(paths: DataFrame, tokens: list[str], most: int = 4) -> DataFrame:
    """The folders of ``folder_names`` nearest to the root, ``most`` of them (the panel's own size)."""
    return folder_names(paths, tokens).orderBy(F.size(F.split("folder", "/")), "folder").limit(most)


def near_word(titles: DataFrame, typed: str) -> DataFrame:
    """The most used title word one edit from a word of three or more letters that no title has."""
    typed = typed.strip().lower()
    words = titles.select(F.explode(F.regexp_extract_all(F.lower("title"), F.lit("[a-z]+"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    if not re.fullmatch(r"[a-z]{3,}", typed):
        return words.where(F.lit(False))
    used = words.where(F.col("word") == typed).select(F.lit(True).alias("used"))
    near = words.where((F.abs(F.char_length("word") - len(typed)) <= 1) & T.one_edit(F.lit(typed), F.col("word")))
    return near.join(used, F.lit(True), "left_anti").orderBy(F.desc("n"), "word").limit(1)


#: Wider queries offered at most.
STEPS = 4


def step_backs(text: str) -> list[str]:
    """Wider queries of one without hits, in the order of offer: a phrase's words apart, letters and digits parted, each term alone; filters stay as they are.

    A term that only looks like a filter is a term. The query itself and a lone OR are no offer."""
    query = parse(text)
    scope = spelled(Query(filters=query.filters))
    joined = " ".join(query.words)
    several = len(query.words) > 1
    parted = " ".join(T.split_runs(w) or w for w in query.words)
    wider = [joined] * (query.phrased and several) + [parted] * (parted != joined) + query.words * several
    known = {"OR"} if query.phrased else {"OR", joined}
    return [f"{scope} {w}".lstrip() for w in dict.fromkeys(wider) if w not in known]


def offered(docs: DataFrame, text: str) -> DataFrame:
    """The first ``STEPS`` wider queries that have hits, with their number (query, n, rank): all are counted in one pass."""
    wider = step_backs(text)
    if not wider:
        return docs.sparkSession.createDataFrame([], "query string, n bigint, rank int")
    names = F.array(*map(F.lit, wider))
    found = counts(docs, [parse(w) for w in wider]).where("n > 0").orderBy("query").limit(STEPS)
    rank = F.row_number().over(Window.orderBy("query")).cast("int")  # over STEPS rows
    return found.select(F.get(names, F.col("query")).alias("text"), "n", rank.alias("rank")).withColumnRenamed("text", "query")


def counts(docs: DataFrame, queries: list[Query]) -> DataFrame:
    """How many hits each of several queries has, in one pass."""
    def match(q: Query) -> Column:
        own = F.lit(True)
        for key, value in q.filters:
            own = own & (F.lower("path").startswith(value.strip("/").lower() + "/") if key == "folder" else F.lower(F.col(key).cast("string")) == value.lower())
        return own & (evidence(q.tokens).isNotNull() if q.tokens else F.lit(True))

    one = docs.agg(*(F.count_if(match(q)).alias(f"q{k}") for k, q in enumerate(queries)))
    return one.select(F.inline(F.array(*(F.struct(F.lit(k).alias("query"), F.col(f"q{k}").alias("n")) for k in range(len(queries))))))


def folder_names(paths: DataFrame, tokens: list[str]) -> DataFrame:
    """Folders whose name has all tokens, with the number of notes below."""
    below = paths.select(F.explode(T.ancestors(F.col("path"))).alias("folder")).where("folder <> ''").groupBy("folder").agg(F.count("*").alias("n"))
    return below.where(contains_all(F.lower(T.file_name(F.col("folder"))), tokens))


def exists(fields: DataFrame, name: str, withheld: Column | None = None) -> DataFrame:
    """Rows (path, field, value) that answer a name exactly by key, or nearly by the search fold (``match``)."""
    withheld = F.lit(False) if withheld is None else withheld
    exact = fields.where(T.ascii_key(F.col("value")) == T.name_key(name)).withColumn("match", F.lit("exact"))
    near = fields.where(F.lower(T.collapsed(F.col("value"))) == T.fold(" ".join(name.split()))).join(exact.select("path", "field", "value"), ["path", "field", "value"], "left_anti").withColumn("match", F.lit("near"))
    return exact.unionByName(near).withColumn("withheld", withheld)


def located(docs: DataFrame, quotes: DataFrame, reach: int = 32) -> DataFrame:
    """Where a quote (id, quote, before, after) stands in its note: the occurrence whose surroundings agree most, if that is one alone."""
    # the places follow from the lengths of what lies between
    between = "split(text, regexp_replace(quote, '([^\\\\p{L}\\\\p{N}\\\\s])', '\\\\\\\\$1'), -1)"
    at = F.expr(f"slice(aggregate({between}, array(1), (done, x) -> array_append(done, element_at(done, -1) + char_length(x) + char_length(quote))), 2, size({between}) - 1)")
    at = F.transform(at, lambda x: x - F.char_length("quote"))
    found = quotes.join(docs, "path").where(F.col("text").contains(F.col("quote"))).select("id", "path", "text", "quote", "before", "after", F.explode(at).alias("at"))
    left = F.substring("text", F.greatest(F.col("at") - reach, F.lit(1)), F.least(F.col("at") - 1, F.lit(reach)))
    right = F.substring("text", F.col("at") + F.char_length("quote"), F.lit(reach))
    score = left.endswith(F.col("before")).cast("int") + right.startswith(F.col("after")).cast("int")
    best = found.withColumn("score", score).groupBy("id", "path").agg(F.max("score").alias("best"), F.collect_list(F.struct("score", "at")).alias("all"))
    top = F.filter("all", lambda x: x["score"] == F.col("best"))
    return best.select("id", "path", F.when(F.size(top) == 1, F.get(top, F.lit(0))["at"]).alias("at"), F.size(top).alias("candidates"))
