"""Byte-level BPE as recursive DuckDB queries inside Spark partitions.

A partition cuts its texts into pieces with the vocabulary's pattern (the usual one by classes of
characters over whole batches, any other by ``regex``) and encodes each distinct piece once. In DuckDB a piece is a set of rows (piece, position,
token, next position, next token); a recursive query joins them to the merge
table, contracts each piece's leftmost pair of least rank, and goes on with the
pieces that changed until no pair is left. An ordered aggregation over the
token rows gives a piece's ids, another over their bytes decodes them. The ids
and the decoded bytes of a document are those of its pieces in order.

Nothing is shuffled: a document needs only its own partition. Known pieces are kept in a cache of
bounded size, two Arrow columns from which a document's pieces are taken; when it is full, the less used half goes.

A round of the query touches all rows of a piece, so long pieces (unspaced scripts, encoded data) are cut
into overlapping windows of ``WINDOW`` bytes. Two windows are joined at a token that both
have: then every two neighbouring tokens of the whole are neighbours in one of the windows, and
tokens of which no two neighbours would be contracted are what the whole piece gives.
Windows without a common token become one, until they have; in the end that is the
piece itself, however long.

Null and empty texts have no ids; repeated rows give repeated results; an empty table gives an empty result;
extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from quire.llm.kernel import pieces, utf8

#: Pieces kept between batches, pieces encoded at once, and bytes of text cut at once.
CACHE, AT_ONCE, TEXT = 600_000, 32_768, 2 << 20
#: Bytes of the windows of a long piece, and between their starts (a multiple of 64: runs of one character keep their phase).
WINDOW, STEP, MARGIN, LONG = 192, 128, 64, 1024

ENCODE = """
WITH RECURSIVE state(p, i, t, j, u, rank, live) AS (
    SELECT s.p, s.i, s.t, s.j, s.u, m.rank, true FROM start s LEFT JOIN merges m ON m.a = s.t AND m.b = s.u
    UNION ALL
    (WITH best AS (SELECT p, min((rank::{kind} << 2 * {bits}) | (i::{kind} << {bits}) | j) AS k FROM state WHERE rank IS NOT NULL GROUP BY p),
    found AS (SELECT p, (k >> 2 * {bits})::INT AS t, ((k >> {bits}) & {mask})::INT AS i, (k & {mask})::INT AS j FROM best),
    right_ AS (SELECT f.p, f.t, f.i, f.j, q.j AS j2, q.u AS u2 FROM state q JOIN found f ON q.p = f.p AND q.i = f.j),
    new AS (SELECT a.p, a.i,
        CASE WHEN a.i = r.i THEN r.t ELSE a.t END AS t,
        CASE WHEN a.i = r.i THEN r.j2 ELSE a.j END AS j,
        CASE WHEN a.i = r.i THEN r.u2 WHEN a.j = r.i THEN r.t ELSE a.u END AS u,
        a.rank, a.i = r.i OR a.j = r.i AS changed, r.p IS NOT NULL AS live
    FROM state a LEFT JOIN right_ r ON r.p = a.p WHERE a.live AND (r.p IS NULL OR a.i <> r.j))
    SELECT n.p, n.i, n.t, n.j, n.u, CASE WHEN n.changed THEN m.rank ELSE n.rank END, n.live
    FROM new n LEFT JOIN merges m ON m.a = CASE WHEN n.changed THEN n.t END AND m.b = n.u)
)
SELECT s.p, list(s.t ORDER BY s.i) AS ids, string_agg(v.hex, '' ORDER BY s.i) AS decoded
FROM state s JOIN vocabulary v ON v.id = s.t WHERE NOT s.live GROUP BY s.p ORDER BY s.p
"""

DECODE = "SELECT p, string_agg(v.hex, '' ORDER BY i) AS decoded FROM given JOIN vocabulary v ON v.id = t GROUP BY p ORDER BY p"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


#: The usual pattern (a fixed value of the public vocabularies), which ``usual_pieces`` cuts by.
USUAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


def character_classes() -> np.ndarray:
    """The class of every code point, as ``regex`` sees it."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            gap = 0x800 * np.array([m.start() >= 0xD800, m.end() > 0xD800])
            out[m.start() + gap[0] : m.end() + gap[1]] = kind
    return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the code points of UTF-8 bytes."""
    place = np.flatnonzero((data & 0xC0) != 0x80)
    value = data[place].astype(np.int32)
    for size, least, bits in ((2, 0xC0, 0x1F), (3, 0xE0, 0x0F), (4, 0xF0, 0x07)):
        at = np.flatnonzero((value >= least) & (data[place] < (0xE0, 0xF0, 0x100)[size - 2]) & (data[place] >= least))
        if len(at):
            code = data[place[at]].astype(np.int32) & bits
            for k in range(1, size):
                code = code << 6 | data[np.minimum(place[at] + k, len(data) - 1)] & 0x3F
            value[at] = np.minimum(code, 0x10FFFF)
    return place, value


def usual_pieces(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where the pieces of some texts (bytes and offsets) begin: runs of a class, with the space before them, and contractions."""
    place, value = code_points(data)
    n = len(place)
    if not n:
        return place
    kind = classes[value]
    first = np.zeros(n + 1, bool)  # of a text
    first[np.searchsorted(place, offsets)] = True
    begin = first[:n].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    # the last character of white space before something else is apart: a space joins what follows
    after = np.flatnonzero(begin & ~first[:n] & (kind != SPACE))
    after = after[kind[after - 1] == SPACE]
    begin[after - 1] = True
    begin[after[value[after - 1] == 32]] = False
    # contractions, where a piece begins with the apostrophe
    at = np.flatnonzero(begin[: n - 1] & (value[: n - 1] == ord("'")) & ~first[1:n] & (kind[1:] == LETTER))
    if len(at):
        one = value[at + 1]
        two = np.where(first[at + 2], 0, value[np.minimum(at + 2, n - 1)])
        short = np.isin(one, [ord(x) for x in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        stop = (at + 2 + long)[short | long]
        begin[at[short | long] + 1] = False
        begin[stop[~first[stop] & (kind[np.minimum(stop, n - 1)] == LETTER)]] = True
    return place[begin]


def run_from(data: np.ndarray, borders: np.ndarray, margin: int) -> tuple[int, int, int] | None:
    """From a window's token borders: one inside a run of some unit, ``margin`` from the window's end, the period of the tokens there, and where the run ends."""
    inner = borders[borders <= borders[-1] - margin]
    if len(inner) < 2:
        return None
    start = int(inner[-1])
    known = data[start : int(borders[-1])]
    unit = next((p for p in range(1, min(len(known) // 2, MARGIN) + 1) if (known[p:] == known[:-p]).all()), None)
    if unit is None:
        return None
    alike = data[int(borders[0]) : start] == data[int(borders[0]) + unit : start + unit]
    low = int(borders[0]) + int(np.append(0, np.flatnonzero(~alike) + 1)[-1])  # from here on the window is the run's
    back = {start - int(b) for b in inner[inner >= low]}
    period = next((d for d in sorted(back) if d and d % unit == 0 and (2 * d in back or start - 2 * d < low)), None)
    if period is None:
        return None
    differs = np.flatnonzero(data[start + unit :] != data[start:-unit])
    return start, period, start + unit + int(differs[0]) if len(differs) else len(data)


class PieceCoder:
    """Encodes distinct pieces; one for each Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.split = regex.compile(pattern).findall
        self.classes = character_classes() if pattern == USUAL else None
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        token, rank = list(ranks), list(ranks.values())
        merges = [(ranks[x[:k]], ranks[x[k:]], n) for x, n in ranks.items() for k in range(1, len(x)) if x[:k] in ranks and x[k:] in ranks]
        a, b, n = map(list, zip(*merges))
        self._store("merges", pa.table({"a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "rank": pa.array(n, pa.int32())}))
        self._store("vocabulary", pa.table({"id": pa.array(rank, pa.int32()), "hex": [x.hex() for x in token]}))
        self.size = np.zeros(max(rank) + 1, np.int64)  # bytes of each token
        self.size[rank] = [len(x) for x in token]
        self.byte_id = np.array([ranks[bytes([x])] for x in range(256)], np.int32)
        self._reset([], pa.array([], pa.large_binary()), pa.array([], pa.large_binary()), np.zeros(0, np.int64))

    def _reset(self, known: list[bytes], ids: pa.Array, decoded: pa.Array, uses: np.ndarray) -> None:
        self.place, self.ids, self.decoded, self.uses = dict(zip(known, range(len(known)))), ids, decoded, uses

    def _store(self, name: str, table: pa.Table) -> None:
        self.db.register("given", table)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def places(self, distinct: list[bytes]) -> np.ndarray:
        """Where the cache has some distinct pieces, after adding those it hasn't."""
        if len(self.place) > CACHE:
            keep = np.sort(np.argsort(-self.uses, kind="stable")[: CACHE // 2])
            known = pa.array(list(self.place), pa.large_binary()).take(keep).to_pylist()
            self._reset(known, self.ids.take(keep), self.decoded.take(keep), self.uses[keep] // 2)
        out = np.fromiter((self.place.get(x, -1) for x in distinct), np.int64, len(distinct))
        missing = np.flatnonzero(out < 0)
        new = [distinct[k] for k in missing]
        ids, decoded = [self.ids], [self.decoded]
        for at in range(0, len(new), AT_ONCE):
            values, lengths, raw, sizes = self.encoded(new[at : at + AT_ONCE])
            ids.append(_cut(values, 4 * np.append(0, np.cumsum(lengths))))
            decoded.append(_cut(raw, np.append(0, np.cumsum(sizes))))
        if new:
            out[missing] = np.arange(len(self.place), len(self.place) + len(new))
            self.place.update(zip(new, out[missing].tolist()))
            self.ids, self.decoded = pa.concat_arrays(ids), pa.concat_arrays(decoded)
            self.uses = np.append(self.uses, np.zeros(len(new), np.int64))
        return out

    def query(self, some: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The recursive query: all ids and their number in each piece, all decoded bytes and their number."""
        data, offsets = utf8(pa.array(some, pa.large_binary()))
        piece = np.repeat(np.arange(len(some), dtype=np.int32), np.diff(offsets))
        place = (np.arange(len(data)) - offsets[piece]).astype(np.int32)
        token = self.byte_id[data]
        last = np.zeros(len(data), bool)
        last[offsets[1:] - 1] = True
        after = pa.array(np.append(token[1:], 0).astype(np.int32), mask=last)
        self.db.register("start", pa.table({"p": piece, "i": place, "t": token, "j": pa.array(place + 1, mask=last), "u": after}))
        kind, bits = ("BIGINT", 23) if np.diff(offsets).max() < 1 << 23 else ("HUGEINT", 31)
        got = self.db.sql(ENCODE.format(kind=kind, bits=bits, mask=(1 << bits) - 1)).to_arrow_table()
        self.db.unregister("start")
        lists = got["ids"].combine_chunks()
        return np.ascontiguousarray(lists.flatten(), np.int32), lists.value_lengths().to_numpy(), *_bytes(got["decoded"])

    def encoded(self, some: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As ``query``, with long pieces in windows."""
        long = [k for k, x in enumerate(some) if len(x) > WINDOW]
        if not long:
            return self.query(some)
        parts, owners = [], []  # of a long piece: (start, stop, ids)
        short = [x for x in some if len(x) <= WINDOW]
        for k in long:
            starts = range(0, max(len(some[k]) - WINDOW + STEP, 1), STEP)
            parts += [some[k][a : a + WINDOW] for a in starts]
            owners += [(k, a) for a in starts]
        some_parts = {x: n for n, x in enumerate(dict.fromkeys(parts), len(short))}  # windows of a run are few different ones
        values, lengths, raw, sizes = self.query(short + list(some_parts))
        ends, byte_ends = np.append(0, np.cumsum(lengths)), np.append(0, np.cumsum(sizes))
        out = {k: values[ends[n] : ends[n + 1]] for n, k in enumerate(k for k, x in enumerate(some) if len(x) <= WINDOW)}
        text = {k: raw[byte_ends[n] : byte_ends[n + 1]] for n, k in enumerate(out)}
        windows: dict[int, list] = {k: [] for k in long}
        for (k, a), x in zip(owners, parts):
            n = some_parts[x]
            windows[k].append((a, values[ends[n] : ends[n + 1]], False))
        for k in long:
            out[k] = self._joined(some[k], windows[k])
        self.db.register("given", pa.table({"p": np.repeat(np.arange(len(long)), [len(out[k]) for k in long]), "i": np.concatenate([np.arange(len(out[k])) for k in long]), "t": np.concatenate([out[k] for k in long])}))
        raw, sizes = _bytes(self.db.sql(DECODE).to_arrow_table()["decoded"])
        self.db.unregister("given")
        byte_ends = np.append(0, np.cumsum(sizes))
        text |= {k: raw[byte_ends[n] : byte_ends[n + 1]] for n, k in enumerate(long)}
        order = range(len(some))
        return np.concatenate([out[k] for k in order]), np.array([len(out[k]) for k in order]), np.concatenate([text[k] for k in order]), np.array([len(text[k]) for k in order])

    def _joined(self, piece: bytes, windows: list[tuple[int, np.ndarray]]) -> np.ndarray:
        """The ids of a piece from those of its overlapping windows (start, ids).

        Neighbours without a common token stand, as a rule, in a run of some unit, whose tokens follow the phase of the run's start: they give way to windows
        from a sure border on, those of the run at steps of the tokens' own period. Each pass sets the first window that is apart right, so the passes end."""
        while True:
            places = [a + np.append(0, np.cumsum(self.size[ids])) for a, ids, _ in windows]
            cuts, low = [], [0]  # how many tokens of a window count, and from which on those of the next do; the place from which on a window counts
            apart = np.zeros(len(windows), bool)
            wide = int(self.size.max()) + 1
            for n, (p, q) in enumerate(zip(places, places[1:])):
                at = None
                if windows[n + 1][2]:  # it was begun at a border of the one before
                    at = int(q[0]) if q[0] >= low[-1] and p[np.searchsorted(p, q[0])] == q[0] else None
                else:
                    both = np.intersect1d(p[:-1] * wide + np.diff(p), q[:-1] * wide + np.diff(q))  # where a token starts, and its length
                    both = both[both >= low[-1] * wide]
                    at = int(both[len(both) // 2] // wide) if len(both) else None
                apart[n + 1] = at is None
                low.append(int(q[0]) if at is None else at)
                cuts.append((int(np.searchsorted(p, low[-1])), int(np.searchsorted(q, low[-1]))))
            if not apart.any():
                begin = [0, *(j for _, j in cuts)]
                stop = [*(i for i, _ in cuts), len(windows[-1][1])]
                return np.concatenate([ids[i:j] for (_, ids, _), i, j in zip(windows, begin, stop)])
            windows = self._relaid(piece, windows, places, apart, low)

    def _relaid(self, piece: bytes, windows: list, places: list[np.ndarray], apart: np.ndarray, low: list[int]) -> list:
        """The windows, with a long one from a sure border on in the place of those that are apart, and behind it, if it shows a run, windows in the run's phase."""
        data, sure = np.frombuffer(piece, np.uint8), {}
        for n in np.flatnonzero(apart):
            p = places[n - 1]
            sure[int(n)] = max(int(p[p <= max(p[-1] - MARGIN, p[0])][-1]), low[n - 1])
        long = dict(zip(sure, self._each([piece[x : x + LONG] for x in sure.values()])))
        out, n, reach = [], 0, 0
        while n < len(windows):
            if n not in long or sure[n] < reach - LONG // 4:  # (what new windows cover already is looked at in the next pass)
                out.append((*windows[n], None))
                n += 1
                continue
            out.append((sure[n], long[n], True, None))
            reach = min(sure[n] + LONG, len(piece))
            run = run_from(data, sure[n] + np.append(0, np.cumsum(self.size[long[n]])), LONG // 4)
            if run and run[2] > reach:  # it goes on past the long window
                start, period, end = run
                starts = range(start, end - WINDOW // 2, period * max(1, STEP // period))
                out += [(x, None, True, piece[x : x + WINDOW]) for x in starts]
                reach = min(starts[-1] + WINDOW, len(piece))
            while n < len(windows) and places[n][-1] <= reach or n + 1 < len(windows) and windows[n + 1][0] <= reach - MARGIN:
                n += 1
            if n < len(windows):
                out.append((windows[n][0], windows[n][1], False, None))
                n += 1
        laid = iter(self._each([x for *_, x in out if x is not None]))
        return [(a, ids if x is None else next(laid), glued) for a, ids, glued, x in out]

    def _each(self, some: list[bytes]) -> list[np.ndarray]:
        """The ids of each; equal ones are asked for once."""
        if not some:
            return []
        distinct = {x: k for k, x in enumerate(dict.fromkeys(some))}
        values, lengths, _, _ = self.query(list(distinct))
        ends = np.append(0, np.cumsum(lengths))
        return [values[ends[distinct[x]] : ends[distinct[x] + 1]] for x in some]

    def code(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """The ids (as 32-bit numbers) and the decoded bytes of some texts, as binary columns."""
        data, offsets = utf8(texts)
        if self.classes is not None:
            start = usual_pieces(data, offsets, self.classes)
            ends = np.searchsorted(start, offsets)
            flat = _cut(data, np.append(start, len(data)))
        else:
            cut = [self.split(x or "") for x in texts.to_pylist()]
            ends = np.append(0, np.cumsum([len(x) for x in cut], dtype=np.int64))
            flat = pa.array([x for own in cut for x in own], pa.large_string()).cast(pa.large_binary())
        flat = flat.dictionary_encode()
        places = self.places(flat.dictionary.to_pylist())[flat.indices.to_numpy()]
        self.uses += np.bincount(places, minlength=len(self.uses))
        out = []
        for column in (self.ids.take(pa.array(places)), self.decoded.take(pa.array(places))):
            data, offsets = utf8(column)
            out.append(_cut(data, offsets[ends]))
        return out[0], out[1]


def _bytes(hexes: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(bytes.fromhex("".join(hexes.to_pylist())), np.uint8), pc.binary_length(hexes).to_numpy() // 2


def _cut(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column of the bytes of ``data`` between ``offsets``."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)])


_CODERS: dict[tuple[str, str], PieceCoder] = {}

RESULT = "doc_id bigint, n_tokens bigint, ids array<int>, decoded binary"


def encode_decode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids and the bytes decoded from them, for every text.

    ``ranks``: path of a rank file that every executor has, as an installed package's data are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (ranks, pattern) not in _CODERS:
            _CODERS[ranks, pattern] = PieceCoder(read_ranks(ranks), pattern)
        coder = _CODERS[ranks, pattern]
        for batch in batches:
            _, offsets = utf8(batch.column(1))
            for i, j in pieces(offsets, TEXT):
                part = batch.slice(i, j - i)
                ids, decoded = coder.code(part.column(1))
                values, offsets = utf8(ids)
                flat = pa.array(values.view(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(offsets) // 4), pa.ListArray.from_arrays(pa.array((offsets // 4).astype(np.int32)), flat), decoded.cast(pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"]
                )

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, RESULT)


def digest(coded: DataFrame) -> DataFrame:
    """Sizes and digests of the ids, written with single spaces, and of the decoded bytes."""
    return coded.select(
        "doc_id", "n_tokens", F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
