"""Fill-in-the-middle order of texts by escaped marker injection, in built-in functions only.

A mark is put behind each unit of a text (a code point, unless another pattern is given): what is
already there of the mark is escaped first, ``regexp_replace`` appends the mark to every unit, the
marks are counted, and ``substring_index`` takes the parts before, between and after the ranks of
two cuts. Without the marks and the escapes the parts are put together behind the markers ``<P>``,
``<S>`` and ``<M>``. The cuts and the form follow from a hash of the row's id, so a row has one
result wherever and whenever it is computed; nothing is shuffled.

A null text is an empty one and an empty text stays plain; a text that holds a marker stays plain,
so every output can be read back (``restore``). A null id hashes as the bare salt. Repeated rows
give repeated results; an empty table gives an empty result; other columns, whatever their names,
are left out unless ``keep`` names them. Texts whose marked form passes a value's bound of 2^31
bytes (about 1 GB of ASCII) can't be held by Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The mark, and the escape that stands for it (followed by 1) and for itself (followed by 0) in escaped text.
MARK, ESCAPE = "\x1e", "\x1b"
UNIT = "(?s)."


def escaped(text: Column) -> Column:
    """Free of the mark; the inverse is ``unescaped``."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0")), F.lit(MARK), F.lit(ESCAPE + "1"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE + "1"), F.lit(MARK)), F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def marked(text: Column, unit: str = UNIT) -> Column:
    """Escaped text with the mark behind every unit; an escape and its digit belong to one character."""
    return F.regexp_replace(escaped(text), f"{ESCAPE}[01]|{unit}", "$0" + MARK)


def ranked(text: Column, low: Column, high: Column, n: Column) -> tuple[Column, Column, Column]:
    """Of a marked text of ``n`` units: those before rank ``low``, from there to ``high``, and the rest."""
    plain = lambda part: unescaped(F.replace(part, F.lit(MARK), F.lit("")))
    return plain(_part(text, low)), plain(_part(_part(text, high), low - high)), plain(_part(text, high - n - 1))


def _part(text: Column, count: Column) -> Column:
    """substring_index with a count that is a column."""
    return F.call_function("substring_index", text, F.lit(MARK), count.cast("int"))


def arranged(prefix: Column, middle: Column, suffix: Column, form: Column) -> Column:
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return F.when(form == "psm", psm).when(form == "spm", spm)


def restore(output: Column, form: Column) -> Column:
    """The text, from the output and its form alone: no part holds a marker, and none arises where a part meets one."""
    inside = lambda left, right: F.substring_index(F.substring_index(output, left, -1), right, 1)
    last = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(inside(PREFIX, SUFFIX), last, inside(SUFFIX, MIDDLE))
    spm = F.concat(inside(PREFIX, MIDDLE), last, inside(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def transform(docs: DataFrame, id: str = "doc_id", text: str = "text", salt: str = "1:", plain: int = 10, spm: int = 20, unit: str = UNIT, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row's text in fill-in-the-middle order.

    ``plain`` and ``spm`` are percentages: of rows that stay as they are, and, among the others, of
    those with the suffix first. Columns: doc_id, those of ``keep``, n (units), form (plain, psm or
    spm), prefix_chars and middle_chars (units, null if plain), output and restored."""
    own = docs.select(F.col(id).alias("doc_id"), *keep, F.coalesce(F.col(text), F.lit("")).alias("_text"), F.sha2(F.concat(F.lit(salt), F.coalesce(F.col(id).cast("string"), F.lit(""))), 256).alias("_hash"))
    part = lambda k: F.conv(F.substring("_hash", 1 + 8 * k, 8), 16, 10).cast("bigint")
    holds = lambda marker: F.contains("_text", F.lit(marker))
    stays = (F.col("_text") == "") | holds(PREFIX) | holds(SUFFIX) | holds(MIDDLE) | (part(2) % 100 >= 100 - plain)
    own = own.withColumn("form", F.when(stays, "plain").when(part(3) % 100 < spm, "spm").otherwise("psm")).withColumn("_marked", marked(F.col("_text"), unit))
    own = own.withColumn("n", F.char_length("_marked").cast("bigint") - F.char_length(F.replace("_marked", F.lit(MARK), F.lit(""))))
    a, b = part(0) % (F.col("n") + 1), part(1) % (F.col("n") + 1)
    own = own.withColumns({"_low": F.least(a, b), "_high": F.greatest(a, b)})
    parts = F.struct(*(c.alias(k) for k, c in zip(("p", "m", "s"), ranked(F.col("_marked"), F.col("_low"), F.col("_high"), F.col("n")))))
    moved = F.col("form") != "plain"
    own = own.withColumn("_parts", F.when(moved, parts)).withColumn("output", F.coalesce(arranged(F.col("_parts.p"), F.col("_parts.m"), F.col("_parts.s"), F.col("form")), "_text"))
    return own.select("doc_id", *keep, "n", "form", F.when(moved, F.col("_low")).alias("prefix_chars"), F.when(moved, F.col("_high") - F.col("_low")).alias("middle_chars"), "output", restore(F.col("output"), F.col("form")).alias("restored"))


def digest(done: DataFrame) -> DataFrame:
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output"), sha("restored"))
