"""Secret scans: patterns of credentials, and strings of high entropy.

The patterns (``PATTERNS``) give the base findings. Candidate strings, the maximal runs of a character
class (``CLASSES``), are then read through a sliding window: the Shannon entropy of a window is kept up
to date by the counts of the character that leaves and the one that enters, and windows at or over the
entropy of their class are joined to spans. Long runs are cut into pieces that overlap by a window less
one, and the pieces of a batch slide side by side, one numpy step for each place, so the work grows
with the text and the memory with the batch. The allow list takes back what is known to be
harmless (``ALLOWED``: identifiers, digests, placeholders, ordered alphabets, words); it acts on entropy
findings only, base findings always stay. What a base finding covers isn't reported again.

Rows are independent and nothing is shuffled. Places are code points, the end exclusive. A null text is
an empty one and has no findings; repeated rows give repeated results; an empty table gives an empty
result; extra columns, whatever their names, are left out. Texts are read whole, whatever their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.llm.kernel import pieces, utf8

#: Kinds in their order, each with its pattern over bytes, the group that is measured, and its least length (fixed values).
#: Bytes patterns fold ASCII letters only, which is what "either case" means here.
PATTERNS = (
    ("assign", re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
    ("access", re.compile(rb"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(rb"[0-9a-f]+"), 0, 32),
)
#: Character classes of candidates: name, characters, window, bits of entropy that a window needs. 24 random characters
#: of 16 have 3.4 bits on average (standard deviation 0.15), 24 of 64 have 4.3; words of a language stay below 3.8.
CLASSES = (
    ("hexadecimal", b"0123456789abcdefABCDEF", 24, 2.9),
    ("base64", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 24, 3.9),
)
#: Harmless shapes of a candidate string, and what makes it harmless when it stands just before it (fixed values).
ALLOWED = tuple(re.compile(x) for x in (
    rb"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", rb"[0-9+/_=-]+", rb"[A-Za-z+/_=-]+", rb"(?:[A-Z]?[a-z]{2,}+[0-9]{0,4}+[-_/+=]*+)++", rb"(?:[A-Z]{3,}+[0-9]{0,4}+[-_/+=]*+)++",
    rb"(?i).*(?:example|sample|placeholder|changeme|dummy|redacted|x{6}|abcdefgh|01234567|12345678).*",
))
ALLOWED_BEFORE = re.compile(rb"(?i)(?:sha-?(?:1|256|384|512)|md5|crc|etag|checksum|digest|commit|integrity|base64,?)[\x20\"'=:-]*\Z")
BEFORE, PIECE = 24, 512


def base_spans(data: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes; matches are leftmost and don't overlap within a kind, those that are too short are dropped after matching."""
    return [(m.start(), k, m.end()) for k, (_, pattern, group, least) in enumerate(PATTERNS) for m in pattern.finditer(data) if m.end(group) - m.start(group) >= least]


def runs(data: np.ndarray, offsets: np.ndarray, chars: bytes, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``chars`` that have ``least`` bytes or more; runs end with their document."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = np.isin(np.arange(256), np.frombuffer(chars, np.uint8))[data]
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[1 + cuts]
    ends[cuts - 1] = inside[cuts]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    long = end - start >= least
    return start[long], end[long]


def hot_windows(data: np.ndarray, start: np.ndarray, end: np.ndarray, chars: bytes, window: int, bits: float) -> np.ndarray:
    """Starts of all windows of these runs whose entropy is at least ``bits``, in order."""
    count = np.maximum(1, -(-(end - start - window + 1) // PIECE))  # pieces of PIECE windows
    run = np.repeat(np.arange(len(start)), count)
    at = start[run] + PIECE * (np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count))
    n = np.minimum(PIECE, end[run] - at - window + 1)  # windows of each piece
    order = np.argsort(-n, kind="stable")
    at, n = at[order], n[order]
    code = np.full(256, 0)
    code[np.frombuffer(chars, np.uint8)] = np.arange(len(chars))
    steps = np.arange(window + 1)
    weight = np.rint(np.multiply(steps, np.log2(np.maximum(steps, 1))) * 2**40).astype(np.int64)  # c log2 c, in whole numbers: sums don't depend on their order
    limit = int(np.floor(window * (np.log2(window) - bits) * 2**40 + 0.5))
    held = np.zeros((len(at), len(chars)), np.int16)
    total, rows = np.zeros(len(at), np.int64), np.arange(len(at))
    out = []

    def shift(m: int, places: np.ndarray, by: int) -> None:
        c = code[data[places]]
        was = held[rows[:m], c]
        held[rows[:m], c] = was + by
        total[:m] += weight[was + by] - weight[was]

    for k in range(window):
        shift(len(at), at + k, 1)
    for k in range(int(n[0]) if len(n) else 0):
        m = int(np.searchsorted(-n, -k, "left"))  # pieces with more than k windows
        if k:
            shift(m, at[:m] + k - 1, -1)
            shift(m, at[:m] + k + window - 1, 1)
        out.append(at[:m][total[:m] <= limit] + k)
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)


def entropy_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal spans covered by windows of high entropy, of any class, without those that the allow list takes back."""
    found: list[tuple[int, int]] = []
    raw = data.tobytes()
    for _, chars, window, bits in CLASSES:
        start, end = runs(data, offsets, chars, window)
        hot = hot_windows(data, start, end, chars, window, bits)
        run = np.searchsorted(start, hot, "right") - 1
        for r in np.unique(run):
            s, e = int(start[r]), int(end[r])
            first = int(offsets[np.searchsorted(offsets, s, "right") - 1])
            if any(x.fullmatch(raw, s, e) for x in ALLOWED) or ALLOWED_BEFORE.search(raw[max(first, s - BEFORE) : s]):
                continue
            mine = hot[np.searchsorted(run, r, "left") : np.searchsorted(run, r, "right")]
            breaks = np.flatnonzero(np.diff(mine) > window)
            for a, b in zip(mine[np.concatenate([[0], breaks + 1])], mine[np.concatenate([breaks, [len(mine) - 1]])]):
                if not any(x.fullmatch(raw, int(a), int(b) + window) for x in ALLOWED):
                    found.append((int(a), int(b) + window))
    found.sort()
    out: list[list[int]] = []
    for a, b in found:
        if out and a < out[-1][1]:  # runs, so spans that meet, lie in one text
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return np.array([x[0] for x in out], np.int64), np.array([x[1] for x in out], np.int64)


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
KINDS = (*(p[0] for p in PATTERNS), "entropy")


def _find(data: np.ndarray, offsets: np.ndarray) -> list[list[dict]]:
    """The findings of each text of a batch."""
    first, last = entropy_spans(data, offsets)
    out, raw = [], data.tobytes()
    for i in range(len(offsets) - 1):
        o, e = int(offsets[i]), int(offsets[i + 1])
        spans = base_spans(raw[o:e])
        base = np.array(sorted((s, x) for s, _, x in spans), np.int64).reshape(-1, 2)
        reach = np.maximum.accumulate(base[:, 1])
        for k in range(*np.searchsorted(first, [o, e])):
            s, x = int(first[k]) - o, int(last[k]) - o
            j = int(np.searchsorted(base[:, 0], s, "right")) - 1
            if j < 0 or reach[j] < x:  # no base finding covers it
                spans.append((s, len(PATTERNS), x))
        spans.sort()
        if spans:
            points = np.concatenate([[0], np.cumsum((data[o:e] & 0xC0) != 0x80)])
            out.append([{"kind": KINDS[k], "start": int(points[s]), "end": int(points[x])} for s, k, x in spans])
        else:
            out.append([])
    return out


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text", batch: int = 1 << 22) -> DataFrame:
    """doc_id and spans: kind, start and end of each finding, by start, then kind in the order of ``KINDS``. ``batch``: bytes that slide side by side."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            data, offsets = utf8(rows.column(1))
            for i, j in pieces(offsets, batch):
                spans = _find(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([rows.column(0)[i:j], pa.array(spans, SPANS)], ["doc_id", "spans"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, f"doc_id {kind}, spans array<struct<kind: string, start: bigint, end: bigint>>")


def digest(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
