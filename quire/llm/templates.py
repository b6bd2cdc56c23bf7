"""Benchmark decontamination by templates.

Numbers, names and units become typed placeholders, so a question asked again
with other parameters has the same template. A *name* is a run of capitalised words inside a
sentence (New York), a *number* a run of words that start with a digit or spell a number (1,200; twenty
five), a *unit* a unit word after a number; each is one token, whatever its length, whose value is the whole run. Windows of
``window`` template tokens, at least half of them literal, are joined by hash between documents and benchmark
items. Matches of a document and an item are chained in order of place, over neighbouring diagonals too,
as long as the slots are consistent: a value of the item always stands for the same
value of the document and the other way round; where they are not, a new chain begins, and of both chains
only what is verbatim counts. A document is contaminated by an item if a chain covers ``run`` tokens in a row, or ``coverage`` of
the item's windows. Items without a window that is literal enough (formulas) are joined by their words as they are.

Documents are cut into windows in their own partitions, and only windows that a bitmap of the
benchmark's window hashes (2 MB, whatever the benchmark's size) lets through are shuffled; the join itself is Spark's,
by broadcast if the benchmark's windows are below its threshold, else by a shuffle on the hash. Equal texts are one text for
all of this; the leaks of texts are joined back to the rows by a digest of the text.

Null and empty texts are clean; null items and items without words are ignored; an item of
fewer tokens than a window is a window of its own length, wherever it stands in a document; of several chains of an item the
best counts (by share, then tokens in a row, then whether verbatim); repeated rows get repeated results; very long texts are cut into windows like any other; an empty
benchmark leaves every document clean; extra columns, whatever their names, are kept in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.llm.kernel import U64, Words, pieces, scramble, shingles, utf8, words_of
from quire.llm.shared import written

TEXT = 1 << 20
LITERAL, NUMBER, NAME, UNIT = 0, 1, 2, 3
#: Unit words and spelled numbers (fixed values).
UNITS = (
    "percent km m cm mm mile miles inch inches foot feet yard yards kg g mg ton tons pound pounds lb lbs ounce ounces oz l ml liter liters litre litres gallon gallons "
    "second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros usd eur degree degrees watt watts volt volts"
).split()
SPELLED = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety "
    "hundred thousand million billion dozen"
).split()
UNIT_HASHES, SPELLED_HASHES = (np.sort(words_of(pa.array([" ".join(x)])).hash) for x in (UNITS, SPELLED))
PLACEHOLDER = scramble(np.arange(1, 5, dtype=np.uint64) * U64(0xD6E8FEB86659FD93))
#: Capital letters of two UTF-8 bytes.
CAPITAL = np.array([chr(c).isupper() for c in range(0x800)])
#: Bits of the bitmap's index; largest change of diagonal inside a chain, in tokens.
BITS, SLACK = 24, 8
#: With names, without (texts in capitals or without any have none), and words as they are.
TYPED, LOWER, RAW = 0, 1, 2


def _among(hashes: np.ndarray, some: np.ndarray) -> np.ndarray:
    return some[np.minimum(np.searchsorted(some, hashes), len(some) - 1)] == hashes


def _capital(raw: np.ndarray, start: np.ndarray) -> np.ndarray:
    first = raw[start].astype(np.int64)
    second = raw[np.minimum(start + 1, len(raw) - 1)].astype(np.int64)
    return (first >= 65) & (first <= 90) | (first >= 0xC2) & (first < 0xE0) & CAPITAL[((first & 0x1F) << 6 | second & 0x3F) & 0x7FF]


def canonical(column: pa.Array, variant: int = TYPED) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of some texts (words, or runs of words that are one value), the kind of each, its value, and its template hash."""
    names = variant == TYPED
    words = words_of(column, ascii_only=names)  # names need the bytes as they are; without them all letters can be lowered
    raw, offsets = utf8(column) if names else (words.data, None)
    kind = np.zeros(len(words.hash), np.int8)
    if not len(kind) or variant == RAW:
        return words, kind, words.hash, words.hash
    head = raw[words.start]
    number = (head >= 48) & (head <= 57) | _among(words.hash, SPELLED_HASHES)
    kind[number] = NUMBER
    if names and len(upper := np.flatnonzero(_capital(raw, words.start) & ~number)):
        doc_start = offsets[np.searchsorted(offsets, words.start[upper], "right") - 1]
        at = words.start[upper] - 1
        for _ in range(3):  # skip up to three spaces, quotes or brackets
            skip = (at >= doc_start) & np.isin(raw[np.maximum(at, 0)], np.frombuffer(b" \"'(", np.uint8))
            at = at - skip
        begins = (at < doc_start) | np.isin(raw[np.maximum(at, 0)], np.frombuffer(b".!?\n\r:", np.uint8))
        kind[upper[~begins]] = NAME
    # runs of one value
    doc = words.doc()
    gap = raw[np.minimum(words.end[:-1], len(raw) - 1)]
    joined = (kind[1:] == kind[:-1]) & (doc[1:] == doc[:-1]) & (words.start[1:] == words.end[:-1] + 1)
    joined &= np.where(kind[1:] == NUMBER, np.isin(gap, np.frombuffer(b" .,:/-", np.uint8)), (kind[1:] == NAME) & np.isin(gap, np.frombuffer(b" -", np.uint8)))
    begin = np.flatnonzero(np.append(True, ~joined))
    last = np.append(begin[1:], len(kind)) - 1
    value = np.where(begin == last, words.hash[begin], words.span_hash(words.start[begin], words.end[last]))
    tokens = Words(words.data, words.start[begin], words.end[last], value, np.searchsorted(begin, words.first), words.prefix)
    kind = kind[begin]
    after = np.flatnonzero(kind[:-1] == NUMBER) + 1
    kind[after[_among(value[after], UNIT_HASHES) & (kind[after] == LITERAL)]] = UNIT
    return tokens, kind, value, np.where(kind > 0, PLACEHOLDER[kind], value)


def windows(words: Words, kind: np.ndarray, template: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the window from each token, and whether it counts: inside one document, at least half of it literal."""
    shown = Words(words.data, words.start, words.end, template, words.first, words.prefix)
    hashes, ok = shingles(shown, size)
    literal = np.concatenate([[0], np.cumsum(kind == LITERAL)])
    end = np.minimum(np.arange(len(kind)) + size, np.repeat(words.first[1:], np.diff(words.first)))
    return hashes, ok & (end - np.arange(len(kind)) == size) & (2 * (literal[end] - literal[:-1]) >= end - np.arange(len(kind)))


def _window_hash(hashes: np.ndarray, variant: int, size: int) -> np.ndarray:
    return scramble(hashes ^ U64(1 + variant * 256 + size))


def _slots(at: np.ndarray, kind: np.ndarray, value: np.ndarray, size: int) -> list[bytes]:
    """For each window the values of its tokens, 0 for literals."""
    shown = np.where(kind > 0, value | U64(1), U64(0))
    every = shown[at[:, None] + np.arange(size)]
    return [x.tobytes() for x in every]


ITEM = "item bigint, item_id bigint, variant int, size int, place int, hash bigint, slots binary, total int"
FOUND = "text_key string, place int, hash bigint, slots binary"


def benchmark_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """The windows of all items, in each variant; item is a number of (item_id, text)."""
    rows = benchmark.select(F.xxhash64("item_id", "text").alias("item"), F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int32())
    names = [x.split()[0] for x in ITEM.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in pieces(utf8(batch.column(2))[1], TEXT):
                part = batch.slice(i, j - i)
                ids, numbers = part.column(0).to_numpy(), part.column(1).to_pylist()
                literal = np.zeros(len(ids), bool)  # items with a window that counts
                for variant in (TYPED, LOWER, RAW):
                    words, kind, value, template = canonical(part.column(2), variant)
                    lengths = np.minimum(np.diff(words.first), window)
                    for size in sorted({int(n) for n in lengths if n}):
                        hashes, ok = windows(words, kind, template, size)
                        doc = words.doc()
                        at = np.flatnonzero(ok & (lengths[doc] == size) & (~literal[doc] if variant == RAW else True))
                        if not len(at):
                            continue
                        total = np.bincount(doc[at], minlength=len(ids))
                        if variant != RAW:
                            literal[doc[at]] = True
                        columns = (
                            ids[doc[at]], [numbers[d] for d in doc[at]], np.full(len(at), variant), np.full(len(at), size), at - words.first[doc[at]],
                            _window_hash(hashes[at], variant, size).view(np.int64), _slots(at, kind, value, size), total[doc[at]],
                        )
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return written(rows.mapInArrow(cut, ITEM))


def _bitmap(items: DataFrame) -> np.ndarray:
    """Which leading ``BITS`` of a window's hash the benchmark has."""
    slot = F.shiftrightunsigned("hash", 64 - BITS)
    parts = items.select(slot.alias("slot")).distinct().groupBy(F.shiftright("slot", 14).alias("part")).agg(F.collect_list(F.col("slot").bitwiseAND(F.lit((1 << 14) - 1)).cast("int")).alias("slots"))
    out = np.zeros(1 << BITS, bool)
    for part, slots in parts.toLocalIterator():  # at most 2^14 numbers a row
        out[(part << 14) + np.array(slots)] = True
    return np.packbits(out)


def document_windows(texts: DataFrame, items: DataFrame) -> DataFrame:
    """The windows of texts (text_key, text) that the bitmap lets through."""
    kinds = sorted(tuple(r) for r in items.select("variant", "size").distinct().collect())  # at most three times the window's size
    bitmap = texts.sparkSession.sparkContext.broadcast(_bitmap(items))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in pieces(utf8(batch.column(1))[1], TEXT):
                part = batch.slice(i, j - i)
                cut_by = {v: canonical(part.column(1), v) for v in {v for v, _ in kinds}}
                for variant, size in kinds:
                    words, kind, value, template = cut_by[variant]
                    if len(kind) < size:
                        continue
                    hashes, ok = windows(words, kind, template, size)
                    hashes = _window_hash(hashes, variant, size)
                    slot = (hashes >> U64(64 - BITS)).astype(np.int64)
                    at = np.flatnonzero((bitmap.value[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool) & ok)
                    if len(at):
                        doc = np.searchsorted(words.first, at, "right") - 1
                        columns = part.column(0).take(pa.array(doc)), pa.array((at - words.first[doc]).astype(np.int32)), pa.array(hashes[at].view(np.int64)), pa.array(_slots(at, kind, value, size), pa.binary())
                        yield pa.RecordBatch.from_arrays([*columns], names=["text_key", "place", "hash", "slots"])

    return texts.mapInArrow(cut, FOUND)


def chains(places: np.ndarray, others: np.ndarray, slots: list[bytes], other_slots: list[bytes], size: int, total: int):
    """Of the matches of an item (places) and a text (others), each chain: share of the item's windows, most tokens in a row, whether no slot changed.

    Where a value contradicts those before, a chain ends and another begins; of both only the windows without a changed slot count."""
    shift = others - places
    by_shift = np.argsort(shift, kind="stable")
    band = np.empty(len(shift), np.int64)
    band[by_shift] = np.cumsum(np.diff(shift[by_shift], prepend=shift[by_shift[:1]]) > SLACK)
    order = np.lexsort((shift, places, band))
    to: dict[int, int] = {}
    back: dict[int, int] = {}
    chain: list[tuple[int, int, bool]] = []  # places, and whether no slot of the window changed
    of = None

    def counted(some, broken):
        own = [x for x in some if x[2]] if broken else some
        best = row = 0
        for k, (p, q, _) in enumerate(own):
            row = row + 1 if k and (p - 1, q - 1) == own[k - 1][:2] else size
            best = max(best, row)
        return len(own) / total, best, all(x[2] for x in own)

    broken = False
    for k in order.tolist():
        p, q = int(places[k]), int(others[k])
        values = [(int(a), int(b)) for a, b in zip(np.frombuffer(slots[k], np.uint64), np.frombuffer(other_slots[k], np.uint64)) if a]
        if of == band[k] and chain and p <= chain[-1][0]:
            continue  # the item's window is matched already
        new = of != band[k] or chain and q <= chain[-1][1]
        clash = not new and not all(to.get(a, b) == b and back.get(b, a) == a for a, b in values)
        if new or clash:
            if chain:
                yield counted(chain, broken or clash)
            chain, to, back, of, broken = [], {}, {}, band[k], clash
        chain.append((p, q, all(a == b for a, b in values)))
        to.update(values)
        back.update((b, a) for a, b in values)
    if chain:
        yield counted(chain, broken)


MATCH = ("text_key", "item", "variant", "item_id", "size", "total", "place", "slots", "other_place", "other_slots")
LEAK = "array<struct<item_id:bigint,coverage:double,tokens:int,verbatim:boolean>>"


def text_leaks(texts: DataFrame, benchmark: DataFrame, window: int = 8, run: int = 13, coverage: float = 0.5) -> DataFrame:
    """text_key and leaks of the contaminated ones of some texts (text_key, text)."""
    items = benchmark_windows(benchmark, window)
    found = written(document_windows(texts, items).dropDuplicates(["text_key", "place", "hash"]))
    ours = items.select("hash", "item", "variant", "item_id", "size", "total", "place", "slots")
    matches = found.withColumnsRenamed({"place": "other_place", "slots": "other_slots"}).join(ours, "hash").select(*MATCH)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of text, item and variant; a group may go over several batches."""
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table) -> tuple | None:
            size, total = table["size"][0].as_py(), table["total"][0].as_py()
            x = chains(table["place"].to_numpy(), table["other_place"].to_numpy(), table["slots"].to_pylist(), table["other_slots"].to_pylist(), size, total)
            good = [c for c in x if c[1] >= run or c[0] >= coverage]
            return (table["text_key"][0].as_py(), table["item_id"][0].as_py(), *max(good)) if good else None

        def out(rows):
            kinds = (pa.string(), pa.int64(), pa.float64(), pa.int32(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else ((),) * 5, kinds)], names=["text_key", "item_id", "coverage", "tokens", "verbatim"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch]).combine_chunks()
            keys = [table[c].combine_chunks().dictionary_encode().indices.to_numpy() if c == "text_key" else table[c].to_numpy() for c in MATCH[:3]]
            cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            starts = np.append(0, cut)
            rows = [flush(table.slice(i, j - i)) for i, j in zip(starts[:-1], starts[1:])]
            held = table.slice(int(starts[-1])).to_batches()
            yield out([r for r in rows if r])
        if held:
            yield out([r for r in [flush(pa.Table.from_batches(held).combine_chunks())] if r])

    ordered = matches.repartition("text_key", "item").sortWithinPartitions("text_key", "item", "variant", "place", "other_place")
    leaks = ordered.mapInArrow(judge, "text_key string, item_id bigint, coverage double, tokens int, verbatim boolean")
    best = leaks.groupBy("text_key", "item_id").agg(F.max(F.struct("coverage", "tokens", "verbatim")).alias("x")).select("text_key", F.struct("item_id", "x.coverage", "x.tokens", "x.verbatim").alias("leak"))
    return written(best.groupBy("text_key").agg(F.sort_array(F.collect_list("leak")).alias("leaks")))


def _keyed(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with their text's key, and the texts by key."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.substring(F.sha2(text, 256), 1, 32).alias("text_key")
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), key), docs.select(key, text.alias("text"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 8, run: int = 13, coverage: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """``row`` (the columns ``keep`` of a row of ``docs``, all if None) and its ``leaks`` (item_id, covered share, tokens in a row, whether verbatim)."""
    own, texts = _keyed(docs, docs.columns if keep is None else keep)
    leaks = text_leaks(texts, benchmark, window, run, coverage)
    return own.join(leaks, "text_key", "left").select("row", F.coalesce("leaks", F.array().cast(LEAK)).alias("leaks"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """The rows of ``docs`` without a leak; the keys of contaminated texts go to all executors if they are at most ``broadcast_bytes``, else rows are shuffled."""
    own, texts = _keyed(docs, docs.columns)
    keys = text_leaks(texts, benchmark).select("text_key")
    small = keys.count() * 100 <= broadcast_bytes  # a key and its place in a hash table
    return own.join(F.broadcast(keys) if small else keys, "text_key", "left_anti").select("row.*")


def digest(marked: DataFrame) -> DataFrame:
    found = F.col("leaks")
    return marked.select(
        "row.doc_id",
        (F.size(found) > 0).cast("int").alias("contaminated"),
        F.array_sort(F.array_distinct(F.transform(found, lambda x: x["item_id"]))).alias("item_ids"),
        F.coalesce(F.round(F.array_max(F.transform(found, lambda x: x["coverage"])), 6), F.lit(0.0)).alias("best_coverage"),
    )
