"""Removal of repeated byte strings with a logarithmic family of suffix indexes.

Every byte covered by a string of ``length`` bytes that also starts earlier
(smaller doc_id, or the same document and an earlier start) goes.

Suffixes are cut at depth ``length`` and ordered by a 64-bit fingerprint of that
prefix instead of by its bytes: the order only has to bring equal prefixes
together, and a fixed-width key keeps the merges in numpy.

* Documents fall into *batches*: consecutive ranges of doc_id of about
  ``batch_bytes``, so that an earlier batch means an earlier place.
* Suffix positions are grouped into runs that share their *anchor*, the least
  hash of the 48-byte strings within the next ``length`` bytes. Equal suffixes
  have equal anchors, so a run whose anchor occurs nowhere else holds no repeat.
* Each batch sorts its distinct keys (its suffix array) and sends them, cut by
  hash range, to shards. A shard takes the batches in order: it merge-scans the
  new array against the levels it holds, then merges levels of equal size. The
  answer is one bit a key: does the key lie in an earlier batch (or, for
  anchors, in any other batch)?
* Round one asks for anchors and for whole runs; round two asks for the single
  suffixes of the runs that share an anchor with another run without being a
  copy of an earlier run.

A key reaches a shard at most once a batch, however often it occurs, so hot
passages need no salting. Texts are shuffled once (the exchange is used again),
keys once, and answers are bits. Nothing is gathered in the driver but the
doc_id bounds of the batches (8 bytes a batch).

Null texts are empty, null doc_ids come first, rows with equal doc_ids are
ordered by text; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from quire.llm.kernel import BYTE_HASH, M2, U64, mix, scramble, utf8

#: Bytes of the strings whose hashes anchor the runs.
GRAM = 48
CHUNK = 1 << 16
RUN = 64
ANCHOR, WHOLE, SINGLE = 0, 1, 2


# ---------------------------------------------------------------- suffix keys


def _double(h: np.ndarray, width: int) -> np.ndarray:
    return mix(h[:-width], h[width:])


def _compose(levels: dict[int, np.ndarray], length: int, n: int) -> np.ndarray:
    """Hashes of ``length`` bytes from those of powers of two."""
    out, at = None, 0
    while at < length:
        width = max(w for w in levels if w <= length - at)
        part = levels[width][at : at + n]
        out, at = part if out is None else mix(out, part), at + width
    return out


def suffix_keys(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each start in ``data``: the fingerprint of ``length`` bytes, the anchor within them, and whether it is the string here."""
    n = len(data) - length + 1
    levels = {1: BYTE_HASH[data]}
    width = 1
    while 2 * width <= length:
        levels[2 * width] = _double(levels[width], width)
        width *= 2
    out = _compose(levels, length, n)
    grams = _compose(levels, GRAM, len(data) - GRAM + 1)
    low, span, width = grams, length - GRAM + 1, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if span > width:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    return out, low[:n], low[:n] == grams[:n]


class Batch:
    """The documents of a batch, in order, and the runs of suffixes that share an anchor."""

    def __init__(self, texts: pa.Array, length: int):
        self.data, self.offsets = utf8(texts)
        self.length = length
        n = len(self.data)
        edge = np.zeros(n + 1, np.int8)
        begin, end = self.offsets[:-1], self.offsets[1:]
        some = end > begin
        np.add.at(edge, np.maximum(begin, end - length + 1)[some], 1)
        np.add.at(edge, end[some], -1)
        self.valid = np.cumsum(edge[:n], dtype=np.int8) == 0

    def chunks(self):
        n = len(self.data) - self.length + 1
        for at in range(0, max(n, 0), CHUNK):
            stop = min(at + CHUNK, n)
            if self.valid[at:stop].any():
                yield at, stop, *suffix_keys(self.data[at : stop + self.length - 1], self.length)

    def runs(self) -> dict[str, np.ndarray]:
        """Runs in order of place: first suffix, number, anchor, key of the whole run, and whether its anchor repeats inside."""
        found = []
        for at, stop, key, low, here in self.chunks():
            ok = self.valid[at:stop]
            new = ok.copy()
            same = (low[1:] == low[:-1]) & ok[:-1]
            new[1:] &= ~same
            start = np.flatnonzero(new)
            last = ok.copy()
            last[:-1] &= ~(same & ok[1:])
            end = np.flatnonzero(last) + 1
            if (end - start > RUN).any():
                parts = -(-(end - start) // RUN)
                which = np.repeat(np.arange(len(start)), parts)
                step = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
                start, end = start[which] + step * RUN, np.minimum(start[which] + (step + 1) * RUN, end[which])
            if not len(start):
                continue
            size = end - start
            whole = mix(mix(key[start], key[end - 1]), size.astype(np.uint64) * M2)
            # the anchor leaves the window and its value stays: it occurs twice
            twice = np.zeros(len(low), np.int64)
            twice[:-1] = same & here[:-1]
            inner = np.add.reduceat(twice, start) if len(start) else twice[:0]
            found.append((start + at, size, scramble(low[start]), whole, inner > 0))
        if not found:
            return {"start": np.zeros(0, np.int64), "size": np.zeros(0, np.int64), "anchor": np.zeros(0, np.uint64), "whole": np.zeros(0, np.uint64), "twice": np.zeros(0, bool)}
        return dict(zip(("start", "size", "anchor", "whole", "twice"), map(np.concatenate, zip(*found))))

    def suffixes(self, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and keys of the suffixes of some runs (in order of place)."""
        places, keys = [], []
        for at, stop, key, _, _ in self.chunks():
            i, j = np.searchsorted(start, [at, stop])
            if i == j:
                continue
            n = size[i:j]
            own = np.repeat(start[i:j] - np.cumsum(n) + n, n) + np.arange(n.sum())
            places.append(own)
            keys.append(key[own - at])
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.concatenate(places), np.concatenate(keys)




def suffix_array(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the first place of each, and each place's rank."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    at = np.flatnonzero(new)
    first = np.minimum.reduceat(order, at) if len(at) else at
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(new) - 1
    return ranked[new], first, rank


def distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return keys[new]


# ------------------------------------------------------------- the index family


class IndexFamily:
    """Levels of sorted distinct keys whose sizes at least halve; ``insert`` says which keys are known."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def contains(self, keys: np.ndarray) -> np.ndarray:
        seen = np.zeros(len(keys), bool)
        for level in self.levels:
            at = np.searchsorted(level, keys)
            at[at == len(level)] = 0
            seen |= level[at] == keys
        return seen

    def insert(self, keys: np.ndarray) -> np.ndarray:
        seen = self.contains(keys)
        fresh = keys[~seen]
        while len(fresh) and self.levels and len(self.levels[-1]) < 2 * len(fresh):
            fresh = np.sort(np.concatenate([self.levels.pop(), fresh]), kind="stable")
        if len(fresh):
            self.levels.append(fresh)
        return seen


MESSAGE = "shard int, batch int, kind int, keys binary"
ANSWER = "batch int, shard int, kind int, bits binary"


def _sent(kind: int, keys: np.ndarray, shard: int, shards: int) -> np.ndarray:
    """Anchors only rule runs out, so a shard gets the 32 bits of them below its own leading bits."""
    if kind != ANCHOR:
        return keys
    return ((keys - _bounds(shards)[shard]) >> U64(max(0, 33 - shards.bit_length()))).astype(np.uint32)


def _messages(batch: int, kind: int, keys: np.ndarray, shards: int) -> list[dict]:
    cut = np.searchsorted(keys, _bounds(shards))
    return [{"shard": s, "batch": batch, "kind": kind, "keys": _sent(kind, keys[i:j], s, shards).tobytes()} for s, (i, j) in enumerate(zip(cut[:-1], cut[1:])) if i < j]


def _bounds(shards: int) -> np.ndarray:
    edges = [(s << 64) // shards for s in range(1, shards)]
    return np.array([0, *edges, (1 << 64) - 1], np.uint64)


def _table(rows: list[dict], names: tuple[tuple[str, pa.DataType], ...]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=pa.schema(list(names)))


_MESSAGE_FIELDS = (("shard", pa.int32()), ("batch", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()))
_ANSWER_FIELDS = (("batch", pa.int32()), ("shard", pa.int32()), ("kind", pa.int32()), ("bits", pa.binary()))


def _received(kind: int, blob) -> np.ndarray:
    return np.frombuffer(blob.as_buffer(), np.uint32 if kind == ANCHOR else np.uint64)


def merge_scan(table: pa.Table) -> pa.Table:
    """A shard: batches in order against the index family; one bit a key."""
    table = table.sort_by([("kind", "ascending"), ("batch", "ascending")])
    out = []
    rows = list(zip(table["kind"].to_pylist(), table["batch"].to_pylist(), table["shard"].to_pylist(), table["keys"]))
    families: dict[int, IndexFamily] = {}
    later: dict[int, IndexFamily] = {}
    for kind, batch, shard, blob in rows:
        keys = _received(kind, blob)
        seen = families.setdefault(kind, IndexFamily()).insert(keys)
        if kind == ANCHOR:
            later.setdefault(kind, IndexFamily()).insert(np.sort(keys[seen]))
        else:
            out.append({"batch": batch, "shard": shard, "kind": kind, "bits": np.packbits(seen).tobytes()})
    for kind, batch, shard, blob in rows:  # an anchor counts in whichever batch it was seen first
        if kind == ANCHOR:
            keys = _received(kind, blob)
            out.append({"batch": batch, "shard": shard, "kind": kind, "bits": np.packbits(later[kind].contains(keys)).tobytes()})
    return _table(out, _ANSWER_FIELDS)


def _answers(table: pa.Table, kind: int, keys: np.ndarray, shards: int) -> np.ndarray:
    """The bits of a batch's sorted keys."""
    bits = np.zeros(len(keys), bool)
    cut = np.searchsorted(keys, _bounds(shards))
    for k, s, blob in zip(table["kind"].to_pylist(), table["shard"].to_pylist(), table["bits"]):
        if k == kind:
            n = cut[s + 1] - cut[s]
            bits[cut[s] : cut[s + 1]] = np.unpackbits(np.frombuffer(blob.as_buffer(), np.uint8), count=n).astype(bool)
    return bits


# ------------------------------------------------------------------- the stages


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")]) if table.num_rows > 1 else table


def _nulls_first(table: pa.Table) -> pa.Table:
    table = _sorted(table)
    empty = pc.is_null(table["doc_id"])
    return pa.concat_tables([table.filter(empty), table.filter(pc.invert(empty))]) if pc.any(empty).as_py() else table


def _stage(length: int, shards: int):
    """The three passes over the texts of a batch."""

    def ask_runs(texts: pa.Table) -> pa.Table:
        texts = _nulls_first(texts)
        runs = Batch(texts["text"], length).runs()
        batch = texts["batch"][0].as_py() if texts.num_rows else 0
        rows = _messages(batch, ANCHOR, distinct(runs["anchor"]), shards) + _messages(batch, WHOLE, distinct(runs["whole"]), shards)
        return _table(rows, _MESSAGE_FIELDS)

    def judge(texts: pa.Table, answers: pa.Table):
        """The batch, the runs that repeat an earlier run, and the suffixes to ask for."""
        batch = Batch(texts["text"], length)
        runs = batch.runs()
        anchors, _, rank = suffix_array(runs["anchor"])
        shared = _answers(answers, ANCHOR, anchors, shards) | (np.bincount(rank, minlength=len(anchors)) > 1)
        shared = shared[rank] | runs["twice"]
        wholes, first, rank = suffix_array(runs["whole"])
        known = _answers(answers, WHOLE, wholes, shards)[rank] | (first[rank] != np.arange(len(rank)))
        ask = shared & ~known
        places, keys = batch.suffixes(runs["start"][ask], runs["size"][ask])
        return batch, (runs["start"][known], runs["size"][known]), places, keys

    def ask_suffixes(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _table([], _MESSAGE_FIELDS)
        texts = _nulls_first(texts)
        _, _, _, keys = judge(texts, answers)
        return _table(_messages(texts["batch"][0].as_py(), SINGLE, distinct(keys), shards), _MESSAGE_FIELDS)

    def remove(texts: pa.Table, answers: pa.Table) -> pa.Table:
        texts = _nulls_first(texts)
        batch, (start, size), places, keys = judge(texts, answers)
        uniq, first, rank = suffix_array(keys)
        again = _answers(answers, SINGLE, uniq, shards)[rank] | (first[rank] != np.arange(len(rank)))
        n = len(batch.data)
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + size + length - 1, -1)
        np.add.at(edge, places[again], 1)
        np.add.at(edge, places[again] + length, -1)
        gone = np.cumsum(edge[:n]) > 0
        kept_text, removed, spans, digests, bounds = [], [], [], [], []
        for i, j in zip(batch.offsets[:-1], batch.offsets[1:]):
            own = gone[i:j]
            if own.any():
                step = np.diff(own.astype(np.int8), prepend=0, append=0)
                at = np.stack([np.flatnonzero(step == 1), np.flatnonzero(step == -1)], 1)
                left = batch.data[i:j][~own].tobytes()
            else:
                at, left = np.zeros((0, 2), np.int64), batch.data[i:j].tobytes()
            removed.append(int(own.sum()))
            spans.append(len(at))
            bounds.append([{"start": int(a), "stop": int(b)} for a, b in at])
            digests.append(hashlib.sha256(left).hexdigest())
            kept_text.append(left)
        return pa.table(
            {
                "doc_id": texts["doc_id"],
                "n_bytes": pa.array(np.diff(batch.offsets), pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "n_spans": pa.array(spans, pa.int64()),
                "kept_sha256": pa.array(digests, pa.string()),
                "spans": pa.array(bounds, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                "kept": pa.array(kept_text, pa.binary()),
                "rest": texts["rest"],
            }
        )

    return ask_runs, ask_suffixes, remove


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,stop:bigint>>, kept binary"


def batched(docs: DataFrame, rest: Column, batch_bytes: int, max_batches: int = 1 << 17) -> tuple[DataFrame, int]:
    """doc_id, text, rest and ``batch``: ranges of doc_id of about ``batch_bytes`` each (more when ``max_batches`` would be passed)."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), rest.alias("rest"))
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(max(1, math.ceil(total / batch_bytes)), max_batches)
    bounds = []
    if n > 1:
        bounds = own.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)).first()[0] or []
    bounds = np.array(sorted(set(bounds)), np.int64)

    @F.pandas_udf("int")
    def batch_of(ids):
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), "left"))

    return own.withColumn("batch", batch_of(F.coalesce("doc_id", F.lit(-(1 << 63)))) if len(bounds) else F.lit(0)), len(bounds) + 1


def remove_repeats(docs: DataFrame, length: int = 100, batch_bytes: int = 8 << 20, rest: Column | None = None) -> DataFrame:
    """One row a document: sizes, removed spans (bytes), the kept bytes and their digest, and ``rest``, any column to carry along."""
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    texts, n = batched(docs, F.lit(None).cast("boolean") if rest is None else rest, batch_bytes)
    shards = max(8, n)
    ask_runs, ask_suffixes, remove = _stage(length, shards)

    def scan(messages: DataFrame) -> DataFrame:
        return messages.groupBy("shard").applyInArrow(merge_scan, ANSWER)

    by_batch = texts.groupBy("batch")
    first = scan(by_batch.applyInArrow(ask_runs, MESSAGE))
    second = scan(by_batch.cogroup(first.groupBy("batch")).applyInArrow(ask_suffixes, MESSAGE))
    return by_batch.cogroup(first.unionByName(second).groupBy("batch")).applyInArrow(remove, f"{RESULT}, rest {texts.schema['rest'].dataType.simpleString()}")


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
