"""N-gram Jaccard self-join by chosen paths.

A document is the set of its five-word shingles. Documents with equal sets fall
together first. Then, in each of several runs, every set goes to the bucket of
one sampled shingle (the least under a hash of the run): two sets of Jaccard
similarity s meet with probability s. A bucket of more than ``bucket`` sets is split
again by further sampled shingles, three branches of them, and what is still larger once
more (each time a pair of similarity s stays together in a branch with probability 1 - (1 - s)^3). A leaf that
keeps most of its bucket's sets isn't split further: these are mostly near duplicates
of each other, whose links have to be counted. What is still large is compared in pairs of blocks, of at most ``BLOCK`` sets and about ``BLOCK_BYTES``: a set of a leaf of n goes to n / BLOCK pairs. The runs are repeated until the
chance to meet in one of them, splits included, reaches ``recall`` at the threshold.

Leaves are compared by brute force on the whole sets, exactly. A pair that meets
in several leaves counts in the first of them, which follows from the two sets'
own lists of leaves; a leaf in which all members have met before is not compared
at all. A leaf gives one row a member (its links and the least member it links
with, transitively), never its pairs; components join those rows.

Texts are shuffled once, and the sets of documents that share a leaf once or,
where a leaf adds pairs, more often. Documents without words have no shingles and
no links. Documents of one to four words have one shingle of all their words. Null
texts are empty; any 64-bit doc_id is one like any other; rows without doc_id take part, and class_id is null if nothing of
its class has an id; rows with equal doc_id and other texts have links and classes of their own (by ``text_key``); ties go to the least id; very long texts are
sets like any other; empty tables give empty results; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quire.llm.graph import components
from quire.llm.kernel import U64, pieces, scramble, shingles, utf8, words_of
from quire.llm.shared import written

#: Branches of a split, and splits of a bucket at most.
BRANCHES, DEPTH = 3, 2
WIDE = BRANCHES**DEPTH
#: Sets, and bytes of sets, of a block of a leaf that stays large.
BLOCK, BLOCK_BYTES = 768, 32 << 20
TEXT = 1 << 20


def runs_needed(threshold: float, recall: float) -> int:
    meet = threshold * (1 - (1 - threshold) ** BRANCHES) ** DEPTH
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, one after another, and their offsets."""
    words = words_of(column)
    hashes, ok = shingles(words, size)
    doc = words.doc()[ok]
    hashes = hashes[ok]
    order = np.lexsort((hashes, doc)) if len(hashes) else np.zeros(0, np.int64)
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.searchsorted(doc[new], np.arange(len(column) + 1))


def set_keys(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set."""
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(scramble(hashes ^ U64(0x5BD1E9955BD1E995)))])
    mass = prefix[offsets[1:]] - prefix[offsets[:-1]]
    return scramble(mass ^ scramble(np.diff(offsets).astype(np.uint64) + U64(77)))


def sampled(hashes: np.ndarray, offsets: np.ndarray, number: int) -> np.ndarray:
    """Minima of each (non-empty) set under ``number`` hashes: (sets, number)."""
    seeds = np.random.default_rng(99).integers(1, 2**63, (number, 2), dtype=np.uint64) | U64(1)
    out = np.empty((len(offsets) - 1, number), np.uint64)
    for k, (x, m) in enumerate(seeds):
        t = (hashes ^ x) * m
        t ^= t >> U64(32)
        out[:, k] = np.minimum.reduceat(t * M_SAMPLE, offsets[:-1])
    return out


M_SAMPLE = U64(0x9FB21C651E98DF25)


def jaccard(sets: list[np.ndarray]) -> np.ndarray:
    """Similarities of all pairs of some sets, exactly."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets], np.float64)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        inter = np.array([[sizes[0], both], [both, sizes[1]]])
    else:
        row = np.repeat(np.arange(n), [len(x) for x in sets])
        _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        inter = np.zeros((n, n))
        shared = count > 1
        place = np.cumsum(shared) - 1
        keep = shared[column]
        row, column = row[keep], place[column[keep]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        width = 4096
        for at in range(0, int(shared.sum()), width):
            i, j = np.searchsorted(column, [at, at + width])
            block = np.zeros((n, min(width, int(shared.sum()) - at)), np.float32)
            block[row[i:j], column[i:j] - at] = 1
            inter += block @ block.T
    union = sizes[:, None] + sizes[None, :]
    union -= inter
    np.maximum(union, 1, out=union)
    inter /= union
    return inter


def _roots(linked: np.ndarray) -> np.ndarray:
    """Least member of each member's component."""
    n = len(linked)
    root = np.arange(n)
    while True:
        new = np.minimum(root, np.where(linked, root[None, :], n).min(1))
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(ids, copies, sets, leaves, index: int, side: np.ndarray, pair: bool, threshold: float):
    """Links, weighted by copies, and least linked member of the sets of a leaf (or of a pair of its blocks)."""
    _, keep = np.unique(ids, return_index=True)
    ids, copies, side, leaves = ids[keep], copies[keep], side[keep], leaves[keep]
    sets = [sets[k] for k in keep]
    linked = jaccard(sets) >= threshold - 1e-12
    np.fill_diagonal(linked, False)
    if pair:
        linked &= side[:, None] != side[None, :]
    for k in range(index):
        if not linked.any():
            break
        linked &= ~((leaves[:, k][:, None] == leaves[:, k][None, :]) & (leaves[:, k] != 0)[:, None])
    some = linked.any(1)
    root = _roots(linked)
    return ids[some], (linked @ copies)[some], ids[root[some]]


SLIM = "doc_id bigint, text_key bigint, set_key bigint, size int, samples array<bigint>"
SENT = "leaf bigint, part string, idx int, pair boolean, side int, vertex bigint, copies bigint, leaves array<bigint>, members binary"
LINKS = "vertex bigint, links bigint, root bigint"


def near_duplicates(docs: DataFrame, threshold: float = 0.8, recall: float = 0.99999, size: int = 5, bucket: int = 256) -> DataFrame:
    """doc_id, class_id (least doc_id of its component), n_links and n_copies (rows with the same set, itself included).

    The vertices are the distinct sets. For tables whose ids repeat or lack, class_key names the class (null: a text without
    words, alone in its class), and text_key a row's text, as ``text_key`` gives it."""
    runs = runs_needed(threshold, recall)
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("text_key"), F.col("text").cast("string").alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in pieces(utf8(batch.column(2))[1], TEXT):
                part = batch.slice(i, j - i)
                hashes, offsets = shingle_sets(part.column(2), size)
                full = np.diff(offsets) > 0
                keys, lengths = set_keys(hashes, offsets)[full], np.diff(offsets)[full]
                starts = np.append(offsets[:-1][full], len(hashes))
                ids, texts = (part.column(k).filter(pa.array(full)) for k in (0, 1))
                values = sampled(hashes, starts, runs * (1 + BRANCHES)) if full.any() else np.zeros((0, 1), np.uint64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * (values.shape[1] if len(ids) else 0)), pa.array(values.view(np.int64).reshape(-1)))
                yield pa.RecordBatch.from_arrays([ids, texts, pa.array(keys.view(np.int64)), pa.array(lengths.astype(np.int32)), lists], names=["doc_id", "text_key", "set_key", "size", "samples"])

    slim = written(own.mapInArrow(sign, SLIM))
    sets = written(slim.groupBy("set_key").agg(F.min(row_key()).alias("row"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("samples").alias("samples")))

    # buckets of a run, and the leaves of those that are split again
    width = 1 + BRANCHES
    run = F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.struct((r * WIDE).alias("idx"), F.xxhash64(r, F.element_at("samples", r * width + 1)).alias("leaf")))
    level, done = sets.select("set_key", F.inline(run)).withColumn("parent", F.lit(None).cast("bigint")), None
    for depth in range(DEPTH + 1):
        counts = level.groupBy("idx", "leaf").agg(F.count("*").alias("n")).where("n > 1")
        counted = level.join(counts, ["idx", "leaf"])
        # a leaf with most of the sets of its bucket holds near duplicates, which no further split would part
        final = (F.col("n") <= bucket) | F.coalesce(2 * F.col("n") > F.col("parent"), F.lit(False)) | F.lit(depth == DEPTH)
        leaves = counted.where(final).select("set_key", "idx", "leaf")
        done = leaves if done is None else done.unionByName(leaves)
        if depth < DEPTH:  # the samples of further runs split what is larger
            step = BRANCHES ** (DEPTH - 1 - depth)
            at = lambda b: F.pmod(F.floor(F.col("idx") / WIDE) + depth, F.lit(runs)) * width + 2 + b  # noqa: B023, E731
            branch = F.transform(F.sequence(F.lit(0), F.lit(BRANCHES - 1)), lambda b: F.struct((F.col("idx") + b * step).alias("idx"), F.xxhash64("leaf", b, F.element_at("samples", at(b).cast("int"))).alias("leaf")))  # noqa: B023
            level = written(counted.where(~final).select("set_key", "idx", "leaf", "n").join(sets.select("set_key", "samples"), "set_key").select("set_key", F.col("n").alias("parent"), F.inline(branch)))
    members = written(done)
    lists = members.groupBy("set_key").agg(F.map_from_entries(F.collect_list(F.struct("idx", "leaf"))).alias("of"))
    lists = lists.select("set_key", F.transform(F.sequence(F.lit(0), F.lit(runs * WIDE - 1)), lambda k: F.coalesce(F.element_at("of", k), F.lit(0).cast("bigint"))).alias("leaves"))
    lists = lists.join(sets.select("set_key", "row", "copies", "size"), "set_key")
    placed = members.join(lists, "set_key")
    # a leaf whose members all met in an earlier run adds no pair
    first = [F.element_at("leaves", r * WIDE + 1) for r in range(runs)]
    same = [((F.min(x) == F.max(x)) & (F.min(x) != 0)).alias(f"same{r}") for r, x in enumerate(first)]
    found = placed.groupBy("leaf", "idx").agg(F.count("*").alias("n"), (F.sum("size") * 8).alias("bytes"), *same).where("n > 1")
    earlier = F.lit(False)
    for r in range(runs):
        earlier = earlier | (F.col(f"same{r}") & (F.col("idx") >= (r + 1) * WIDE))
    blocks = F.greatest(F.when(F.col("n") > bucket, F.ceil(F.col("n") / min(BLOCK, 3 * bucket))).otherwise(1), F.ceil(F.col("bytes") / BLOCK_BYTES))
    found = found.where(~earlier).select("leaf", "idx", blocks.cast("int").alias("blocks"))
    wanted = members.join(found, ["leaf", "idx"]).groupBy("set_key").agg(F.collect_list(F.struct("leaf", "idx", "blocks")).alias("wanted"))
    wanted = wanted.join(lists, "set_key")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
        names = [x.split()[0] for x in SENT.split(", ")]
        for batch in batches:
            for i, j in pieces(utf8(batch.column(batch.schema.get_field_index("text")))[1], TEXT):
                part = batch.slice(i, j - i).to_pydict()
                hashes, offsets = shingle_sets(pa.array(part["text"], pa.string()), size)
                rows = []
                for d, key in enumerate(part["set_key"]):
                    data = hashes[offsets[d] : offsets[d + 1]].tobytes()
                    for w in part["wanted"][d]:
                        n, own_block = w["blocks"], key % w["blocks"]
                        for other in range(n):
                            a, b = min(own_block, other), max(own_block, other)
                            rows.append((w["leaf"], f"{a}-{b}", w["idx"], a != b, own_block, key, part["copies"][d], part["leaves"][d], data))
                        if len(rows) > 2000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of leaf and part; a leaf may go over several batches."""
        held: list[dict] = []

        def flush():
            if len(held) < 2:
                return ()
            return _compare(
                np.array([x["vertex"] for x in held], np.int64), np.array([x["copies"] for x in held], np.int64), [np.frombuffer(x["members"], np.uint64) for x in held],
                np.array([x["leaves"] for x in held], np.int64), held[0]["idx"], np.array([x["side"] for x in held]), held[0]["pair"], threshold,
            )

        out: list[tuple] = []

        def table():
            columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["vertex", "links", "root"])

        at = None
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                for row in batch.slice(k, 256).to_pylist():
                    if (row["leaf"], row["part"], row["idx"]) != at:
                        if got := flush():
                            out.append(got)
                        held, at = [], (row["leaf"], row["part"], row["idx"])
                    held.append(row)
            yield table()
            out = []
        if got := flush():
            out.append(got)
        yield table()

    # one row a set: the text of its least row (rows without an id are one for each text)
    some = own.where("doc_id is not null").unionByName(own.where("doc_id is null").groupBy("doc_id", "text_key").agg(F.first("text").alias("text")))
    texts = wanted.join(some.select(row_key().alias("row"), "text"), "row").select("set_key", "copies", "leaves", "wanted", "text")
    sent = texts.mapInArrow(send, SENT)
    links = written(sent.repartition("leaf", "part").sortWithinPartitions("leaf", "part", "idx").mapInArrow(compare, LINKS))
    classes = components(links.select(F.col("vertex").alias("a"), F.col("root").alias("b"))).withColumnRenamed("v", "set_key")
    least = sets.select("set_key", row_id("row").alias("rep"))
    named = classes.join(least, "set_key").groupBy("label").agg(F.min("rep").alias("class_id"))
    sums = links.groupBy(F.col("vertex").alias("set_key")).agg(F.sum("links").alias("links"))
    by_set = sets.select("set_key", row_id("row").alias("rep"), "copies").join(sums, "set_key", "left").join(classes.join(named, "label"), "set_key", "left")
    result = slim.select("doc_id", "text_key", "set_key").join(by_set, "set_key").select(
        "doc_id", F.when(F.col("label").isNull(), F.col("rep")).otherwise(F.col("class_id")).alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.col("copies").alias("n_copies"),
        F.coalesce("label", "set_key").alias("class_key"), "text_key",
    )
    # documents without words
    empty = own.where(~F.lower("text").rlike(WORD) | F.col("text").isNull())
    number = lambda x: F.lit(x).cast("bigint")
    return result.unionByName(empty.select("doc_id", F.col("doc_id").alias("class_id"), number(0).alias("n_links"), number(1).alias("n_copies"), number(None).alias("class_key"), "text_key"))


def text_key(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def row_key(id: str = "doc_id", key: str = "text_key") -> Column:
    """What names a row, also one without an id or whose id has several texts: ids go before none, then smaller ones first."""
    return F.struct(F.col(id).isNull().alias("no_id"), F.coalesce(F.col(id), F.lit(0)).cast("bigint").alias("number"), F.col(key).alias("text_key"))


def row_id(row: str) -> Column:
    return F.when(~F.col(f"{row}.no_id"), F.col(f"{row}.number"))


def representatives(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay when of each class of near duplicates the least row (by id, then text) does; rows without words stay."""
    found = near_duplicates(docs, **options)
    one = found.where("class_key is not null").groupBy("class_key").agg(F.min(row_key()).alias("_row")).select("_row")
    stay = one.unionByName(found.where("class_key is null").select(row_key().alias("_row")).distinct())
    keyed = docs.withColumn("_text_key", text_key()).withColumn("_row", row_key("doc_id", "_text_key"))
    return keyed.join(stay, "_row", "left_semi").dropDuplicates(["doc_id", "text"]).select(docs.columns)


#: A character of a word (of the lower-cased text).
WORD = r"[a-z0-9_\x{80}-\x{10FFFF}]"
