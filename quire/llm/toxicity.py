"""Toxic passages by maximum-scoring segments.

Each word has a log-odds score between toxic and clean labelled documents, with an
informative Dirichlet prior from the counts of the whole corpus. A word
stands for itself and its prefixes of a few lengths, hashed into a table of
fixed size, and takes the score of the feature with the surest evidence; a margin and a constant drift keep the
expected score of clean text negative. A linear scan finds all maximal-scoring
segments of a document; extreme-value statistics of clean labelled documents (a
segment of score S in n words has significance lambda S - ln(K n)) make the scores of short
and long texts comparable, the significances of a document's segments add
up, and a logistic curve turns the sum into a probability.

What is fitted on labels uses at most ``sample`` labelled documents (by
hash of the id, a documented bound); the corpus counts cover every text.

Null and empty texts have no words and get the score of no evidence, null ids are not held out. Repeated rows
get repeated scores; a document labelled twice is toxic if one label says so; very long texts are scanned whole;
rows of ``labels`` with nulls are ignored, an empty table
of labels gives the neutral score; an empty table of documents an empty result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quire.llm.kernel import Words, pieces, utf8, words_of
from quire.llm.shared import written

SLOTS = 1 << 20
#: Features of a word: itself (0) and its leading bytes.
PREFIXES = (0, 4, 5, 6, 7)
#: Occurrences in the prior, occurrences counted a document, deviations taken off an estimate, log-odds that count as none, drift, largest score of a word.
PRIOR, CAP, SURE, MARGIN, DRIFT, CLIP, TEXT = 500.0, 4, 1.5, 0.8, 0.1, 4.0, 1 << 20
BINS, LOW, HIGH = 400, -20.0, 60.0


def features(words: Words) -> np.ndarray:
    """Slots of each word's features: (features, words); a prefix as long as the word falls back to the word."""
    out = np.empty((len(PREFIXES), len(words.hash)), np.int32)
    for k, n in enumerate(PREFIXES):
        h = words.hash
        if n:
            longer = words.end - words.start > n
            h = np.where(longer, words.span_hash(words.start, np.minimum(words.start + n, words.end)) ^ np.uint64(n * 0x9E3779B97F4A7C15 % 2**64), h)
        out[k] = (h >> np.uint64(36)).astype(np.int64) % SLOTS
    return out


def counts(column: pa.Array) -> np.ndarray:
    """Occurrences of each slot, at most ``CAP`` a document, and at the end their total."""
    words = words_of(column)
    doc = words.doc() * SLOTS
    out = np.zeros(SLOTS + 1, np.int64)
    every = np.concatenate([doc + slots for slots in features(words)])
    every.sort()
    new = np.flatnonzero(np.concatenate([np.ones(min(len(every), 1), bool), every[1:] != every[:-1]]))
    times = np.minimum(np.diff(np.append(new, len(every))), CAP)
    out[:SLOTS] = np.bincount(every[new] % SLOTS, times, minlength=SLOTS).astype(np.int64)
    out[SLOTS] = out[:SLOTS].sum()
    return out


def log_odds(toxic: np.ndarray, clean: np.ndarray, corpus: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds ratio of each slot's share of the occurrences, with a Dirichlet prior in proportion to the corpus, and its z-score."""
    prior = PRIOR * corpus[:SLOTS] / max(corpus[SLOTS], 1) + 0.5
    a, b = toxic[:SLOTS] + prior, clean[:SLOTS] + prior
    ratio = np.log(a / (toxic[SLOTS] + prior.sum() - a)) - np.log(b / (clean[SLOTS] + prior.sum() - b))
    return ratio, ratio / np.sqrt(CAP / a + CAP / b)


def word_scores(slots: np.ndarray, ratio: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Score of each word: the log-odds of its feature with the surest evidence, less its deviation and a margin.

    Words a little more usual in toxic documents (as in longer ones) score nothing, so that the expected score of clean text is the drift, below zero."""
    sure = np.maximum(np.abs(ratio) * (1 - SURE / np.maximum(np.abs(z), 1e-9)) - MARGIN, 0).astype(np.float32) * np.sign(ratio)
    own = sure[slots]
    best = own[np.abs(own).argmax(0), np.arange(slots.shape[1])]
    return np.clip(best, -CLIP, CLIP).astype(np.float64) - DRIFT


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, stop, score) of a sequence, in linear time.

    Runs of scores of one sign stand for one score, then each positive run either
    starts a segment or joins those since the last lower cumulative score."""
    positive = scores > 0
    if not positive.any():
        return []
    start = np.flatnonzero(np.diff(positive, prepend=~positive[:1]))
    sums = np.add.reduceat(scores, start)
    stop = np.append(start[1:], len(scores))
    held: list[tuple[float, float, int, int]] = []  # cumulative before and after, start, stop
    total = 0.0
    for value, i, j in zip(sums.tolist(), start.tolist(), stop.tolist()):
        before, total = total, total + value
        if value <= 0:
            continue
        left, right, begin = before, total, i
        while True:
            k = len(held) - 1
            while k >= 0 and held[k][0] >= left:
                k -= 1
            if k < 0 or held[k][1] >= right:
                held.append((left, right, begin, j))
                break
            left, begin = held[k][0], held[k][2]
            del held[k:]
    return [(i, j, b - a) for a, b, i, j in held]


@dataclass
class Model:
    ratio: np.ndarray
    z: np.ndarray
    rate: float = 1.0  # lambda
    space: float = 0.0  # ln K
    slope: float = 0.0
    offset: float = -3.0  # without usable labels nothing counts as toxic

    def passages(self, column: pa.Array):
        """For each document: words, best segment score, and its segments (first word, word after the last, significance)."""
        words = words_of(column)
        scores = word_scores(features(words), self.ratio, self.z) if len(words.hash) else np.zeros(0)
        for d in range(len(column)):
            i, j = words.first[d], words.first[d + 1]
            n = j - i
            found = segments(scores[i:j]) if n else []
            yield n, max((s for _, _, s in found), default=0.0), [(a, b, self.rate * s - self.space - math.log(n)) for a, b, s in found]

    def evidence(self, column: pa.Array):
        """Words, segments, and the sum of the significances over all significant segments, or the best one if none is."""
        for n, _, found in self.passages(column):
            yield n, found, self.total([x for _, _, x in found])

    def total(self, significances: list[float]) -> float:
        sure = sum(x for x in significances if x > 0)
        return float(np.clip(sure if sure > 0 else max(significances, default=LOW), LOW, HIGH))


def gumbel(best: np.ndarray, n: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Rate and ln K of the largest segment scores of clean documents of n words, by moments."""
    weight = weight / max(weight.sum(), 1)
    mean, mean_n = (weight * best).sum(), (weight * np.log(n)).sum()
    spread = math.sqrt(max((weight * (best - mean) ** 2).sum(), 1e-6))
    rate = math.pi / (spread * math.sqrt(6))
    return rate, rate * mean - 0.5772 - mean_n


def logistic(x: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method on counts at x; a little weight on both sides keeps them finite."""
    n, y = toxic + clean, toxic
    w = np.array([0.0, math.log((toxic.sum() + 1) / (clean.sum() + 1))])
    design = np.stack([x / 10, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        g = design.T @ (y - n * p) - np.array([0.01, 0.0]) * w
        h = (design * (n * p * (1 - p))[:, None]).T @ design + np.diag([0.01, 1e-6])
        step = np.linalg.solve(h, g)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w[0] / 10, w[1]


# ------------------------------------------------------------------ Spark jobs

#: Parts of a table of counts, and the tree that sums them: tasks that come together at each of some levels.
PARTS, FAN, LEVELS = 128, 256, 2


def _texts(docs: DataFrame, *more) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def held_out(doc_id: str = "doc_id"):
    """The rows that no label may be learnt from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def _numbers(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else ((),) * 3, (pa.int32(), pa.int64(), pa.float64()))], names=["toxic", "n", "value"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> Model:
    """Learns from at most ``sample`` labelled documents that aren't held out, and from the counts of all texts."""
    spark = docs.sparkSession
    rows = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    rows = rows.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    known = F.broadcast(spark.createDataFrame(chosen, "doc_id bigint, toxic int"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, SLOTS + 1), np.int64)  # all, clean, toxic
        for batch in batches:
            text, label = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            for i, j in pieces(utf8(text)[1], TEXT):
                sums[0] += counts(text.slice(i, j - i))
            for value in (0, 1):
                if len(own := text.filter(pa.array(label == value))):
                    for i, j in pieces(utf8(own)[1], TEXT):
                        sums[1 + value] += counts(own.slice(i, j - i))
        task = TaskContext.get().partitionId()
        rows = [(k, p, task, x.tobytes()) for k in range(3) for p, x in enumerate(np.array_split(sums[k], PARTS)) if x.any()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["kind", "part", "task", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(1, np.int64)
        for x in table["sums"].to_pylist():
            total = total + np.frombuffer(x, np.int64)
        return pa.table({"kind": table["kind"][:1], "part": table["part"][:1], "task": table["task"][:1], "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "kind int, part int, task int, sums binary"
    labelled = _texts(docs).join(known, "doc_id", "left").select("text", F.col("toxic").cast("double").alias("toxic"))
    sums = np.zeros((3, SLOTS + 1), np.int64)
    edges = np.concatenate([[0], np.cumsum([len(x) for x in np.array_split(sums[0], PARTS)])])
    summed = labelled.mapInArrow(count, schema)
    for _ in range(LEVELS):  # a tree: no group has more than ``FAN`` rows, up to FAN^LEVELS tasks
        summed = summed.withColumn("task", F.floor(F.col("task") / FAN).cast("int")).groupBy("kind", "part", "task").applyInArrow(add, schema)
    for kind, part, _, blob in summed.collect():
        sums[kind, edges[part] : edges[part + 1]] = np.frombuffer(blob, np.int64)
    ratio, z = log_odds(sums[2], sums[1], sums[0])
    model = Model(ratio.astype(np.float32), z.astype(np.float32))
    if not chosen:
        return model
    shared = spark.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(0)
            for i, j in pieces(utf8(text)[1], TEXT):
                found = [(t, n, max((s + math.log(n) for _, _, s in x), default=0.0)) for t, (n, _, x) in zip(batch.column(1).to_pylist()[i:j], shared.value.passages(text.slice(i, j - i)))]
                yield _numbers(found)

    # a few numbers of each of at most ``sample`` documents (or rows of these) come to the driver, in no order
    sampled = written(_texts(docs).join(known, "doc_id").select("text", "toxic"))
    seen = sampled.mapInArrow(scan, "toxic int, n bigint, value double").where("n > 0").collect()
    toxic, size, best = (np.array(x, float) for x in zip(*seen)) if seen else (np.zeros(0),) * 3
    order = np.lexsort((best, toxic, size))
    toxic, size, best = toxic[order], size[order], best[order]
    clean = toxic == 0
    if clean.sum() < 2 or clean.all():
        return model
    model.rate, model.space = gumbel(best[clean], size[clean], np.ones(int(clean.sum())))
    judged = spark.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(0)
            for i, j in pieces(utf8(text)[1], TEXT):
                found = [(t, n, x) for t, (n, _, x) in zip(batch.column(1).to_pylist()[i:j], judged.value.evidence(text.slice(i, j - i)))]
                yield _numbers(found)

    judgements = sampled.mapInArrow(judge, "toxic int, n bigint, value double").where("n > 0").collect()
    proof, toxic = np.array([r.value for r in judgements]), np.array([r.toxic for r in judgements])
    clean = toxic == 0
    bins = np.linspace(LOW, HIGH, BINS + 1)
    model.slope, model.offset = logistic((bins[1:] + bins[:-1]) / 2, np.histogram(proof[~clean], bins)[0].astype(float), np.histogram(proof[clean], bins)[0].astype(float))
    return model


def _scored(model: Model, docs: DataFrame, schema: str, make) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            for i, j in pieces(utf8(text)[1], TEXT):
                rows = list(shared.value.evidence(text.slice(i, j - i)))
                proof = np.array([x[2] for x in rows])
                yield make(batch.slice(i, j - i), rows, 1 / (1 + np.exp(-(shared.value.slope * proof + shared.value.offset))))

    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, and the significant passages (first word, word after the last, significance)."""
    passage = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("significance", pa.float64())]))

    def make(batch, rows, p):
        found = [[{"start": a, "stop": b, "significance": s} for a, b, s in x if s > 0] for _, x, _ in rows]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(found, passage)], names=["doc_id", "score", "passages"])

    out = _scored(model, _texts(docs), "doc_id bigint, score double, passages array<struct<start:bigint,stop:bigint,significance:double>>", make)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages")


def clean_documents(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below the threshold."""

    def make(batch, rows, p):
        return batch.filter(pa.array(p < threshold))

    return _scored(model, docs, docs.schema, make)
