"""The training-data operators against brute force, on small tables with awkward rows."""

import base64
import hashlib
import math
import os
import re
import shutil
import textwrap
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import byte_bpe, chosen_path, compact_windows, html_blocks, licenses, suffix_dedup, telephony, templates, toxicity, warc

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, batch string, path string"
RNG = np.random.default_rng(3)
WORDS = [f"{a}{b}" for a in "ba ce di fo gu ha je ki lo mu na pe".split() for b in "ra se ti vo xu za".split()]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def rows():
    """Exact and near copies, shared passages, periodic text, nulls, empty and very long texts, repeated rows."""
    base, passage = prose(120, 1), prose(60, 2)
    near = base.split()
    near[60] = "changed"
    out = [
        (1, base), (2, base), (3, " ".join(near)), (4, prose(40, 4) + " " + passage + " " + prose(40, 5)), (5, prose(30, 6) + " " + passage), (6, ""), (7, None), (8, "ab" * 200),
        (9, "x" * 150), (10, "Ärger über Öl " * 30), (11, prose(4, 9)), (12, prose(4, 9)), (13, prose(20_000, 10)), (14, "!!! ???"), (15, prose(300, 11)), (15, prose(300, 11)), (None, prose(80, 12)),
    ]
    return [(i, t, "en", "s", None, "clash", "clash") for i, t in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ------------------------------------------------------------- 1: suffix arrays


def test_suffix_dedup(docs, empty):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digest(suffix_dedup.remove_repeats(docs, batch_bytes=3000)).collect())
    seen, want = set(), []
    for i, text in sorted(((i if i is not None else -1, (t or "").encode()) for i, t, *_ in rows()), key=lambda x: (x[0], x[1])):
        gone = bytearray(len(text))
        for p in range(len(text) - 99):
            if text[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(text[p : p + 100])
        kept = bytes(c for c, g in zip(text, gone) if not g)
        want.append((i, len(text), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_index_family():
    family = suffix_dedup.IndexFamily()
    known: set[int] = set()
    for k in range(40):
        keys = np.unique(np.random.default_rng(k).integers(0, 500, 30).astype(np.uint64))
        assert family.insert(keys).tolist() == [int(x) in known for x in keys]
        known |= {*map(int, keys)}
        sizes = [len(x) for x in family.levels]
        assert all(a >= 2 * b or a > b for a, b in zip(sizes, sizes[1:]))


# --------------------------------------------------------------- 2: chosen path


def shingle_set(text):
    words = re.findall(r"[a-z0-9_\u0080-\U0010ffff]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("bucket", [256, 2])
def test_near_duplicates(docs, empty, bucket):
    got = {r.doc_id: (r.class_id, r.n_links) for r in chosen_path.near_duplicates(docs, bucket=bucket).where("doc_id is not null and doc_id <> 15").collect()}
    sets = {i: shingle_set(t) for i, t, *_ in rows() if i is not None and i != 15}
    links = {i: {j for j in sets if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])} for i in sets}
    for i in sets:
        todo, seen = [i], {i}
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        assert got[i] == (min(seen), len(links[i])), i
    assert chosen_path.near_duplicates(empty).count() == 0


def test_large_bucket_pairs():
    """Blocks of a leaf give each pair once."""
    base = np.arange(100, dtype=np.uint64)
    sets = [np.concatenate([base, np.array([1000 + k], np.uint64)]) for k in range(6)]
    ids, copies, root = chosen_path._compare(np.arange(6), np.ones(6, np.int64), sets, np.zeros((6, 24), np.int64), 0, np.array([0, 0, 0, 1, 1, 1]), True, 0.8)
    assert copies.tolist() == [3] * 6 and root.tolist() == [0] * 6


# ------------------------------------------------------------------ 3: byte BPE


def test_byte_bpe(docs, empty):
    public = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = public.path("byte_bpe_50k.tiktoken")
    encoding = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    got = byte_bpe.encode_decode(docs, path, public.PATTERN).collect()
    want = sorted((-1 if i is None else i, encoding.encode_ordinary(t or "")) for i, t, *_ in rows())
    assert sorted((-1 if r.doc_id is None else r.doc_id, list(r.ids)) for r in got) == want
    texts = {i: (t or "").encode() for i, t, *_ in rows()}
    assert all(bytes(r.decoded) == texts[r.doc_id] and r.n_tokens == len(r.ids) for r in got)
    assert byte_bpe.digest(byte_bpe.encode_decode(empty, path, public.PATTERN)).count() == 0
    coder = byte_bpe.PieceCoder(byte_bpe.read_ranks(path), public.PATTERN)
    rng = np.random.default_rng(8)
    odd = [*" \n\t'\u00a0\u3000", "'s", "'re", "'ll", "'vex", "'S", " ", "ab", "é", "東京", "12", "\u0661", "!?", "\U0001f600", "\x1c", "don't", "\u0301"]
    mixed = ["".join(rng.choice(odd, rng.integers(0, 12))) for _ in range(3000)]
    texts = ["a" * 700, " \n\n\tx ", "naïve 東京 \U0001f600", "<|endoftext|>", "don't 12345", "", *mixed]
    slow = byte_bpe.PieceCoder(byte_bpe.read_ranks(path), f"(?:{public.PATTERN})")
    assert coder.classes is not None and slow.classes is None
    for some in (coder, slow):
        ids, decoded = some.code(pa.array(texts))
        assert [np.frombuffer(x.as_py(), np.int32).tolist() for x in ids] == [encoding.encode_ordinary(x) for x in texts]
        assert [x.as_py().decode() for x in decoded] == texts


def test_long_pieces():
    """Pieces without a break, in windows: the ids of tiktoken in linear time, whatever their period."""
    public = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    ranks = byte_bpe.read_ranks(public.path("byte_bpe_50k.tiktoken"))
    encoding = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = byte_bpe.PieceCoder(ranks, public.PATTERN)
    rng = np.random.default_rng(4)
    letters = lambda some, n: "".join(rng.choice(list(some), n))
    texts = [letters("abcdefghijklmnopqrstuvwxyz", n) for n in (191, 192, 193, 320, 321, 1000, 20_000)] + [letters("漢字中文的一是不了人", 2000), letters("ab", 3000)]
    texts += [x * n for x, n in (("a", 1001), ("-", 3000), ("=+", 700), ("abcde", 300), ("the", 500), ("mississippi", 222), (" ", 900))]
    ids, decoded = coder.code(pa.array(texts, pa.large_string()))
    assert [np.frombuffer(x.as_py(), np.int32).tolist() for x in ids] == [encoding.encode_ordinary(x) for x in texts]
    assert [x.as_py().decode() for x in decoded] == texts
    # runs whose period is not that of the windows, between other words, several in a piece, and of a megabyte
    odd = ["─" * 3000, "…" * 3000, "█" * 3000, "ÃÂ" * 2000, "-" * 10_001, "=-" * 5001, "abc" * 3001, "─│" * 1501, "x" + "─" * 1000 + "═" * 1000 + "-" * 500, "".join(c * n for c, n in zip("─═-=_~█…", (700, 311, 999, 64, 1281, 47, 803, 500)))]
    odd += [letters("abcdefghij", 300) + u * 700 + letters("klmnopq", 200) for u in ("no", "ha", "ing", "ÃÂ", "é", "ab1", "漢")] + ["".join(u * int(n) for u, n in zip(rng.choice(["a", "ab", "─", "--", "==", "é", "xyz"], 12), rng.integers(1, 400, 12))) for _ in range(20)]
    ids, decoded = coder.code(pa.array(odd, pa.large_string()))
    assert [np.frombuffer(x.as_py(), np.int32).tolist() for x in ids] == [encoding.encode_ordinary(x) for x in odd]
    for unit in ("─", "…", "█", "ÃÂ", "-", "mississippi", "━┅"):
        began, long = time.time(), unit * ((1 << 20) // len(unit.encode()))
        ids, decoded = coder.code(pa.array([long], pa.large_string()))
        assert time.time() - began < 60 and decoded[0].as_py().decode() == long
        assert np.frombuffer(ids[0].as_py(), np.int32).tolist() == encoding.encode_ordinary(long)
    began, long = time.time(), letters("abcdefghijklmnopqrstuvwxyz", 1 << 20)
    ids, _ = coder.code(pa.array([long], pa.large_string()))
    assert np.frombuffer(ids[0].as_py(), np.int32).tolist() == encoding.encode_ordinary(long) and time.time() - began < 300


# ------------------------------------------------------------------ 4: toxicity


def test_segments():
    for seed in range(60):
        s = np.round(np.random.default_rng(seed).normal(-0.2, 1, 30), 3)
        got = toxicity.segments(s)
        # by definition: repeatedly the best-scoring segment, then the same left and right of it
        def maximal(i, j):
            best = max(((s[a:b].sum(), a - b, a, b) for a in range(i, j) for b in range(a + 1, j + 1)), default=None)
            if best is None or best[0] <= 1e-9:
                return []
            _, _, a, b = max(x for x in ((round(s[a:b].sum(), 9), b - a, a, b) for a in range(i, j) for b in range(a + 1, j + 1)) if abs(x[0] - best[0]) < 1e-9)
            return maximal(i, a) + [(a, b)] + maximal(b, j)
        assert abs(sum(x for *_, x in got) - sum(s[a:b].sum() for a, b in maximal(0, 30))) < 1e-6, seed


def test_toxicity(spark, empty):
    texts = [(i, prose(60, 100 + i) + (" vile foul vile rotten foul" if i % 5 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame([*texts, (1000, ""), (1001, None), (1002, prose(3000, 7))], "doc_id bigint, text string")
    labels = spark.createDataFrame([*((i, 1, int(i % 5 == 0)) for i in range(400)), (None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i in held) and sum(r.held_out for r in got.values() if r.doc_id < 400) == len(held)
    assert all(got[i].predicted == (i % 5 == 0) for i in range(400))
    assert [got[i].predicted for i in (1000, 1001, 1002)] == [0, 0, 0] and all(0 <= r.score <= 1 for r in got.values())
    assert toxicity.clean_documents(docs, model).count() == 403 - 80
    neutral = toxicity.fit(docs, labels.where("false"))
    assert {r.predicted for r in toxicity.score(empty.union(empty).select("doc_id", "text"), neutral).collect()} == set()


def test_toxicity_by_brute_force(spark):
    """Scores worked out document by document: counts, log-odds, segments by definition, calibration, logistic curve."""
    texts = {i: prose(int(30 + i % 50), 3000 + i) + (" vile foul vile rotten" if i % 4 == 0 else "") + (" rotten" if i % 9 == 0 else "") for i in range(240)}
    docs = spark.createDataFrame([*texts.items(), (7, texts[7]), (900, ""), (901, None)], "doc_id bigint, text string").withColumn("toxic", F.lit(5)).withColumn("n", F.lit("x"))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    learnt = [i for i in [*texts, 7] if zlib.crc32(str(i).encode()) % 4 != 2]  # the repeated row counts twice

    def slots(text):
        words = toxicity.words_of(pa.array([text]))
        return toxicity.features(words).T.tolist() if len(words.hash) else []

    def counted(some):
        out = {}
        for i in some:
            own = {}
            for word in slots(texts.get(i, "")):
                for slot in word:
                    own[slot] = own.get(slot, 0) + 1
            for slot, k in own.items():
                out[slot] = out.get(slot, 0) + min(k, toxicity.CAP)
        return out

    every, toxic, clean = counted([*texts, 7]), counted([i for i in learnt if i % 4 == 0]), counted([i for i in learnt if i % 4])
    total, t_all, c_all = (sum(x.values()) for x in (every, toxic, clean))
    prior_sum = toxicity.PRIOR + 0.5 * toxicity.SLOTS

    def word_score(word):
        best = 0.0
        for slot in word:
            prior = toxicity.PRIOR * every.get(slot, 0) / total + 0.5
            a, b = toxic.get(slot, 0) + prior, clean.get(slot, 0) + prior
            ratio = math.log(a / (t_all + prior_sum - a)) - math.log(b / (c_all + prior_sum - b))
            z = abs(ratio) / math.sqrt(toxicity.CAP / a + toxicity.CAP / b)
            sure = max(abs(ratio) * (1 - toxicity.SURE / max(z, 1e-9)) - toxicity.MARGIN, 0) * (1 if ratio > 0 else -1)
            best = sure if abs(sure) > abs(best) else best
        return max(-toxicity.CLIP, min(toxicity.CLIP, best)) - toxicity.DRIFT

    def best_segments(s):
        """All maximal segments: the best one, then those left and right of it."""
        if not s:
            return []
        sums = [0.0]
        for x in s:
            sums.append(sums[-1] + x)
        value, _, i, j = max(((round(sums[j] - sums[i], 9), i - j, i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)))
        return best_segments(s[:i]) + [sums[j] - sums[i]] + best_segments(s[j:]) if value > 1e-9 else []

    found = {i: best_segments([word_score(w) for w in slots(t)]) for i, t in texts.items()}
    size = {i: len(slots(t)) for i, t in texts.items()}
    rows = [(max((x + math.log(size[i]) for x in found[i]), default=0.0), size[i]) for i in learnt if i % 4]
    mean = sum(x for x, _ in rows) / len(rows)
    rate = math.pi / math.sqrt(6 * max(sum((x - mean) ** 2 for x, _ in rows) / len(rows), 1e-6))
    space = rate * mean - 0.5772 - sum(math.log(n) for _, n in rows) / len(rows)
    assert abs(model.rate - rate) < 1e-3 * rate and abs(model.space - space) < 1e-2
    for i in texts:
        values = [rate * x - space - math.log(size[i]) for x in found[i]]
        sure = sum(x for x in values if x > 0)
        proof = max(toxicity.LOW, min(toxicity.HIGH, sure if sure > 0 else max(values, default=toxicity.LOW)))
        assert abs(got[i].score - 1 / (1 + math.exp(-(model.slope * proof + model.offset)))) < 1e-3, i
        assert got[i].predicted == int(got[i].score >= 0.3) and got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    right = [got[i].predicted == (i % 4 == 0) for i in texts if got[i].held_out]
    assert np.mean(right) > 0.95 and got[900].score == got[901].score


# ------------------------------------------------------------------ 5: licences


def wrapped(text, mark="", width=70):
    return "\n".join(f"{mark}{x}".rstrip() for x in textwrap.wrap(text, width))


def test_licenses(spark):
    code = "\n\nint main() { return 0; }\n" + prose(80, 3)
    own = "Copyright (c) 2021 Some Body. All rights reserved.\n\n"
    apache = "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n" + "\n\n".join(wrapped(prose(60, k)) for k in range(30))
    bsd3 = licenses.TEMPLATES["BSD-3-Clause"]["text"][0]
    gpl3 = licenses.TEMPLATES["GPL-3.0"]["notice"][3]
    texts = {
        "a/x.md": "Hello\nLicensed under the Apache License, Version 2.0.", "a/b/LICENSE": "Released under the MIT License.", "a/b/c/y.md": "no word", "a/z.md": None, "d/w.md": "", None: "text",
        "a/b/t.md": prose(50, 1) + "\nlicense plates are metal",
        "mit/LICENSE": "MIT License\n\n" + own + "\n\n".join(map(wrapped, licenses.MIT.split("\n"))), "mit/src/deep/a.c": code,
        "bsd/COPYING": own + wrapped(bsd3), "bsd/a.c": code, "isc/LICENSE": own + wrapped(licenses.ISC), "isc/a.c": code, "zl/LICENSE": own + wrapped(licenses.ZLIB), "zl/b": code,
        "apache/LICENSE": apache, "apache/a.c": code, "gpl/COPYING": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n" + wrapped(prose(900, 8)), "gpl/x/y": code,
        "h/apache.py": wrapped(licenses.APACHE, "# ") + code, "h/gpl.c": "/*\n" + wrapped(gpl3, " * ", 50) + "\n */" + code, "h/gpl2": "GNU General Public License, version 2" + code, "h/mit.c": "// SPDX-License-Identifier: MIT" + code,
        "h/tag.c": "# SPDX-License-Identifier: Apache-2.0" + code, "h/later": "SPDX-License-Identifier: GPL-3.0-or-later" + code, "h/other": "SPDX-License-Identifier: WTFPL" + code, "h/none": prose(400, 2) + "\nthe license of the public software is granted",
    }
    files = spark.createDataFrame([(p, t, "x", 1) for p, t in texts.items()] + [("a/x.md", "other text", "y", 2)], "path string, text string, word string, n int")
    got = {}
    for r in licenses.scan(files).collect():
        got.setdefault(r.path, []).append((r.license, r.origin, r.from_dir))
    one = lambda p: got[p][0]
    assert len(got) == len(texts) and sorted(x[1] for x in got["a/x.md"]) == ["header", "inherited"]  # rows of one path have their own results
    assert one("a/b/c/y.md") == ("MIT", "inherited", "a/b") and one("a/b/t.md") == ("MIT", "inherited", "a/b")
    assert one("a/z.md") == ("Apache-2.0", "inherited", "a") and one("d/w.md")[1] == "none"  # the whole of a/x.md is near enough to a notice
    for path, name in (("mit/src/deep/a.c", "MIT"), ("bsd/a.c", "BSD-3-Clause"), ("isc/a.c", "ISC"), ("zl/b", "Zlib"), ("apache/a.c", "Apache-2.0"), ("gpl/x/y", "GPL-3.0")):
        assert one(path) == (name, "inherited", path.split("/")[0]), path
    for path, name in (("h/apache.py", "Apache-2.0"), ("h/gpl.c", "GPL-3.0"), ("h/gpl2", "GPL-2.0"), ("h/mit.c", "MIT"), ("h/tag.c", "Apache-2.0"), ("h/later", "GPL-3.0")):
        assert one(path)[:2] == (name, "header"), path
    assert one("h/other")[1] == "none" and one("h/none")[1] == "none"
    assert licenses.scan(files.where("false")).count() == 0


# ---------------------------------------------------------- 6: compact windows


def test_passages(docs, empty):
    got = {r.doc_id: r for r in compact_windows.near_duplicate_passages(docs, batch_bytes=4000).where("doc_id <> 15").collect()}
    assert {got[i].class_id for i in (1, 2, 3)} == {1} and got[4].class_id == got[5].class_id == 4
    assert (got[1].n_passages, got[1].n_words) == (got[2].n_passages, got[2].n_words) == (1, 120)  # copies are passages as a whole
    assert 60 <= got[4].n_words <= 75 and got[4].n_passages == 1
    clean = [i for i in got if i not in (1, 2, 3, 4, 5)]
    assert all(got[i].class_id == i and got[i].n_passages == 0 for i in clean)
    assert compact_windows.near_duplicate_passages(empty).count() == 0


def test_middle_members(spark):
    """Pairs whose signatures a line of all documents crowds, so that they are neither first nor last of any, are linked; the other documents aren't."""
    line, data, pairs = prose(14, 999), [], []
    for r in range(12):
        n, edits = (60, (35,)) if r % 2 else (120, (25, 90))
        half = (n - 14) // 2
        passage = f"{prose(half, 3 * r + 1000)} {line} {prose(n - 14 - half, 3 * r + 1001)}".split()
        other = list(passage)
        for at in edits:
            other[at if at < half or at > half + 14 else half + 20] = f"changed{at}"
        for words in (passage, other):
            data.append((len(data) + 100, f"{prose(40, 5000 + len(data))} {' '.join(words)} {prose(30, 6000 + len(data))}"))
        pairs.append((len(data) + 98, len(data) + 99))
    data += [(k, f"{prose(60, 7000 + k)} {line} {prose(60, 8000 + k)}") for k in (*range(40), *range(300, 340))]
    table = spark.createDataFrame([(i, t, "x") for i, t in data], "doc_id bigint, text string, class string")
    got = {r.doc_id: r for r in compact_windows.near_duplicate_passages(table, batch_bytes=1 << 14).collect()}
    assert all(got[a].class_id == got[b].class_id == a and got[b].n_passages == 1 for a, b in pairs)
    assert all(got[k].n_passages == 0 for k, _ in data if not 100 <= k < 124)


def test_crowds(spark):
    """What is crowded under all functions is compared in blocks: every pair of different classes is found."""
    rng, base = np.random.default_rng(3), prose(60, 77).split()
    docs = []
    for k in range(40):
        words = list(base)
        words[int(rng.integers(0, 60))] = f"own{k}"
        docs.append((k, " ".join(words), 0))
    texts = compact_windows._packed(spark.createDataFrame(docs, "doc_id bigint, text string, batch int"))
    crowd = spark.createDataFrame([(1, 40, k, k, 0, 0, 276) for k in range(40)], "`group` bigint, n bigint, class bigint, doc bigint, batch int, `from` int, `to` int")
    crowd_size, compact_windows.CROWD = compact_windows.CROWD, 16
    try:
        got = {(r.a, r.b) for r in compact_windows._crowds(crowd, texts, 46, 0.8).collect()}
    finally:
        compact_windows.CROWD = crowd_size
    rows = [shingle_row(t.split()) for _, t, _ in docs]
    want = {(a, b) for a in range(40) for b in range(a + 1, 40) if [*compact_windows.same_passages(rows[a], rows[b], 46, 0.8)]}
    assert got == want and want


def test_same_passages():
    x = np.arange(200, dtype=np.uint32)
    y = np.concatenate([np.arange(900, 950), np.arange(50, 130), np.arange(950, 990)]).astype(np.uint32)
    assert [tuple(map(int, s)) for s in compact_windows.same_passages(x, y, 46, 0.8)] == [(50, 130, 50, 130)]


def test_candidates():
    """Windows at the threshold are found with the stated recall, and a hit of another diagonal does not part two of one."""
    n = compact_windows.functions_for(0.8)
    agree = np.random.default_rng(0).random((1_000_000, n)) < 0.8
    assert (agree.sum(1) < compact_windows.NEED).mean() < 2e-5
    x = {"place_a": [10, 15, 20, 400], "place_b": [110, 700, 120, 1], "start": [5, 5, 6, 390], "size": [4, 6, 9, 5]}
    got = [*compact_windows._chains({k: np.array(v) for k, v in x.items()}, 46, 2)]
    assert len(got) == 1 and got[0][0] <= 10 and got[0][1] > 20 and got[0][2] <= 110 and 120 < got[0][3] < 300


def shingle_row(words):
    return (compact_windows.shingles(compact_windows.words_of(pa.array([" ".join(words)])), 5)[0][: len(words) - 4] >> np.uint64(32)).astype(np.uint32)


def jaccard(x, y):
    x, y = {*x.tolist()}, {*y.tolist()}
    return len(x & y) / len(x | y)


def test_one_edit_anywhere():
    """A passage with one word replaced, added or left out, in unrelated text."""
    names = [f"w{k}" for k in range(2000)]
    for n in (50, 51, 60, 70, 80, 90, 95, 120):
        for at in range(n):
            before, passage, after = names[:70], names[70 : 70 + n], names[200:260]
            for changed in (passage[:at] + ["new"] + passage[at + 1 :], passage[:at] + ["new"] + passage[at:], passage[:at] + passage[at + 1 :]):
                a, b = shingle_row(passage), shingle_row(changed)
                x, y = shingle_row(before + passage + after), shingle_row(names[300:345] + changed + names[400:480])
                got = [*compact_windows.same_passages(x, y, 46, 0.8)]
                if min(len(a), len(b)) >= 46 and jaccard(a, b) >= 0.8:
                    assert len(got) == 1 and got[0][1] - got[0][0] >= 46, (n, at)
                for i, j, k, m in got:
                    assert j - i >= 46 and m - k >= 46 and jaccard(x[i:j], y[k:m]) >= 0.8, (n, at)


def test_last_places():
    """A token that the other text lacks has no place there."""
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b, before = rng.integers(0, 9, 12), rng.integers(0, 9, 12), int(rng.integers(0, 2))
        want = [max((k for k in range(12) if a[k] == b[i] and k <= i - before), default=-1) for i in range(12)]
        assert compact_windows._last(a, b, before).tolist() == want


def test_stretches_by_sets():
    """Each stretch that is found on a diagonal by its sets is a near duplicate at some end, with repeated tokens and such that one text lacks."""
    rng, found = np.random.default_rng(2), 0
    for _ in range(60):
        x = np.tile(rng.integers(0, 1 << 30, 30), 4).astype(np.uint32)
        y = x.copy()
        y[rng.choice(120, int(rng.integers(10, 60)), replace=False)] = rng.integers(0, 1 << 30)
        hit, every = np.isin(x, y), np.ones(120, bool)
        for i, j, k, m in compact_windows._by_sets(x, y, 0, every, every, hit, 46, 0.8):
            found += 1
            assert (i, j) == (k, m) and any(compact_windows._similar(x[f:e], y[f:e], 0.8) for f in range(i + 1) for e in range(max(j, f + 46), min(f + 92, 120) + 1))
    assert found


def test_pairs_side_by_side(monkeypatch):
    """Pairs that are judged side by side have the passages that each has by itself."""
    rng, xs, ys = np.random.default_rng(4), [], []
    for k in range(200):
        names = rng.integers(0, 1 << 32, 400, dtype=np.uint32)
        x, y = names[: rng.integers(0, 180)], names[rng.integers(0, 60) : rng.integers(60, 240)].copy()
        y[rng.random(len(y)) < k % 8 / 16] = 7 if k % 3 == 0 else k
        if k % 5 == 0:
            y = np.concatenate([y[20:70], names[300:320], y[90:], x[:50]])
        xs.append(x), ys.append(y)
    want = sorted((k, *map(int, r)) for k in range(200) for r in compact_windows.same_passages(xs[k], ys[k], 46, 0.8))
    first = lambda z: np.append(0, np.cumsum([len(t) for t in z]))
    for pairs, size in ((512, 1 << 18), (7, 1 << 18), (512, 100)):
        monkeypatch.setattr(compact_windows, "PAIRS", pairs)
        monkeypatch.setattr(compact_windows, "SLICE", size)
        assert sorted(compact_windows.passages_of_pairs(np.concatenate(xs), first(xs), np.concatenate(ys), first(ys), 46, 0.8)) == want
    assert len({k for k, *_ in want}) > 50


def test_same_passages_by_brute_force():
    """Some stretch of one diagonal has the similarity, with edits and repeated words or without: then it is found, and what is found has it."""
    seen = [0, 0]
    for seed in range(120):
        rng = np.random.default_rng(seed)
        names = [f"w{k}" for k in (rng.integers(0, 30, 400) if seed % 3 == 0 else range(400))]
        passage = names[: rng.integers(48, 90)]
        changed = list(passage)
        for at in rng.integers(0, len(passage), rng.integers(0, 4)):
            changed[at] = f"new{at}"
        if seed % 3 == 1:  # a sentence said twice
            passage = passage[:20] + passage[8:20] + passage[20:]
            changed = changed[:20] + changed[8:20] + changed[20:]
        x, y = shingle_row(names[100 : 100 + rng.integers(0, 20)] + passage + names[150:165]), shingle_row(names[200 : 200 + rng.integers(0, 20)] + changed + names[250:265])
        want = any(
            jaccard(x[i : i + n], y[i + shift : i + shift + n]) >= 0.8
            for shift in range(-25, 26)
            for n in range(46, 80, 3)
            for i in range(max(0, -shift), min(len(x), len(y) - shift) - n + 1, 2)
        )
        got = [*compact_windows.same_passages(x, y, 46, 0.8)]
        assert bool(got) or not want, seed
        assert all(j - i >= 46 and m - k >= 46 for i, j, k, m in got), seed
        seen[want] += 1
    assert min(seen) > 10


# -------------------------------------------------------------------- 7: blocks


def test_html(spark):
    page = '<html><head><title>t</title></head><body><nav><ul><li><a href="/a">A</a><li><a>B</a></ul></nav><article><h1>Title &amp; more</h1><p>One  two<br>three<p>Four.<script>var s="</p>x";</script></article><form><p>name</p></form><footer>&copy; me</footer></body></html>'
    blocks = html_blocks.blocks_of(page)
    assert [b.text for b in blocks] == ["A", "B", "Title & more", "One two three", "Four.", "© me"]
    assert blocks[3].path == ("body", "article", "p") and blocks[0].linked == 1
    lines = [prose(30, k) + "." for k in range(50)]
    rng = np.random.default_rng(1)
    model = html_blocks.train([], steps=150)
    pages = [html_blocks.layout(rng, lines) for _ in range(150)]
    found = model.label([p for p, _ in pages])
    assert np.mean(np.concatenate([a == b for a, (_, b) in zip(found, pages)])) > 0.95
    x, mask = html_blocks._padded([html_blocks.vectors([p]) for p, _ in pages[:3]], [len(p) for p, _ in pages[:3]])
    y = (np.random.default_rng(0).random(mask.shape) > 0.5).astype(np.float32)
    grads, loss = model.gradients(x, mask, y)
    step = 1e-2
    model.gates[0][5, 7] += step
    _, higher = model.gradients(x, mask, y)
    assert abs((higher - loss) / step - grads[0][5, 7]) < 1e-2
    table = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (None, "w", "<p>unclosed <b>text")], "page_id bigint, url string, html string")
    got = {r.page_id: r for r in html_blocks.main_text(table, model).collect()}
    assert got[1].text == "Title & more\n\nOne two three\n\nFour." and got[1].n_chars == len(got[1].text) and got[2].text == got[3].text == ""
    assert html_blocks.main_text(table.where("false"), html_blocks.fit(table.where("false"))).count() == 0


def test_html_held_out():
    """Pages that the labeller has not seen: the blocks of their article, whatever stands around it."""
    parquet = pytest.importorskip("pyarrow.parquet")
    pages = parquet.read_table("/root/testdata/sf0.01/pages.parquet", columns=["page_id", "html"]).to_pylist()
    blocks = [html_blocks.blocks_of(p["html"] or "") for p in sorted(pages, key=lambda p: p["page_id"])]
    model = html_blocks.train(blocks[::2][:100])
    rest = [b for b in blocks[1::2] if any("article" in x.path for x in b)]
    # the article's names are taken away from the pages that are judged, so that only the rest of their layout tells
    hidden = [[html_blocks.Block(x.text, tuple("div" if n == "article" else n for n in x.path), x.linked) for x in b] for b in rest]
    truth = [np.array(["article" in x.path and not any(n in x.path for n in (".comments", ".comment", ".ad")) for x in b]) for b in rest]
    for some, least in ((rest, 0.98), (hidden, 0.9)):
        found = model.label(some)
        assert np.mean(np.concatenate([a == b for a, b in zip(found, truth)])) > least
        assert np.mean([(a == b).all() for a, b in zip(found, truth)]) > least - 0.1


def test_malformed_html():
    """Quotes, nesting and long pages as browsers read them, in linear time."""
    said = lambda page: [b.text for b in html_blocks.blocks_of(page)]
    assert said('<article><p title="x>hello</p><p>world</p></article>') == []  # the quote swallows the rest
    assert said('<p>one</p><p a"b>two</p><p title=\'a>b\' x="c>d">three</p><p x=a"b>four') == ["one", "two", "three", "four"]
    assert said("<!-->a<!-- b --!>c<!-- d > e -->f</>g<?x y>h<!DOCTYPE z>") == ["acfgh"]
    assert said("<p>a<noscript>b</noscript></p><math><mi>x</mi></math><xmp>y</xmp><p>1 < 2 <3") == ["ab", "xy", "1 < 2 <3"]
    began = time.time()
    for page in ('<a "' * 250_000, "<div>x" * 150_000, "<div>" * 100_000 + "</b>" * 100_000, "</script" * 100_000, "<script>" + "</script" * 100_000, "<!--" * 200_000, "<p x='" * 150_000, "<p>" + "y " * 500_000):
        html_blocks.blocks_of(page)
    assert time.time() - began < 60
    assert len(said("<p>" + "word " * 300_000)[0]) == 1_499_999


# ---------------------------------------------------------------- 8: templates


def test_templates(spark, empty):
    item = "A train leaves London at 5 pm and travels 120 km to reach old Paris before the end of the day"  # under 13 words between the names
    bench = spark.createDataFrame([(1, item), (2, None), (3, "tiny item here")], "item_id bigint, text string")
    other = item.replace("London", "Madrid").replace("Paris", "Lisbon").replace("120", "95")
    broken = item.replace("London", "Oslo").replace("Paris", "Oslo")
    table = spark.createDataFrame(
        [(1, prose(30, 1) + " " + item + " " + prose(30, 2)), (2, "So. " + other), (3, broken), (4, prose(200, 3)), (5, None), (6, ""), (7, item.upper()), (8, "say tiny item here now"), (8, "say tiny item here now")], "doc_id bigint, text string"
    )
    got = {r.doc_id: (r.contaminated, r.item_ids, r.best_coverage) for r in templates.digest(templates.find_leaks(table, bench)).collect()}
    assert got[1][:2] == (1, [1]) and got[2][:2] == (1, [1]) and got[7][:2] == (1, [1]) and got[8][:2] == (1, [3])
    assert [got[i][0] for i in (3, 4, 5, 6)] == [0] * 4
    leak = templates.find_leaks(table, bench).where("row.doc_id = 2").first()["leaks"][0]
    assert not leak.verbatim and templates.decontaminate(table, bench).count() == 4
    assert templates.find_leaks(table, bench.where("false")).where("size(leaks) > 0").count() == 0
    clash = table.withColumn("leaks", F.lit(1)).withColumn("row", F.lit("r")).withColumn("text_key", F.lit("k"))
    assert sorted(r.doc_id for r in templates.decontaminate(clash, bench).collect()) == [3, 4, 5, 6] and templates.decontaminate(clash, bench).columns == clash.columns
    assert templates.digest(templates.find_leaks(empty, bench)).count() == 0


def test_parameters(spark):
    """Values that change their length, names of several words, spelled numbers, formulas, changed halves."""
    item = "A farmer sells 120 apples at the market on every day of the week and earns 45 dollars in London before going home to sleep"
    long = prose(16, 50) + " 7 apples " + prose(16, 51) + " 7 pears"
    bench = spark.createDataFrame([(1, item), (2, "12 + 7 * 3 = 33"), (3, "Compute 3 + 5"), (4, long), (5, "Él vive en Ávila con doña Inés desde hace muchos años y nunca sale de casa")], "item_id bigint, text string")
    docs = {
        1: item.replace("120", "1,200"), 2: item.replace("120", "2.5"), 3: item.replace("London", "New York"), 4: item.replace("120", "twenty five").replace("45", "1,000,000"), 5: item.replace("London", "Rio de Janeiro"),
        6: "so 12 + 7 * 3 = 33 then", 7: "Compute 3 + 5 now", 8: long.replace("7 pears", "8 pears"), 9: item.replace("on every day", "on almost every single day"), 10: "Él vive en Úbeda con doña Inés desde hace muchos años y nunca sale de casa",
        11: prose(10, 52) + " 120 apples at 45 dollars in London", 12: "12 + 8 * 3 = 36", 13: prose(300, 53), 14: "Compute 4 + 5",
    }
    table = spark.createDataFrame([*docs.items()], "doc_id bigint, text string")
    got = {r.doc_id: r.item_ids for r in templates.digest(templates.find_leaks(table, bench)).collect()}
    assert got == {1: [1], 2: [1], 3: [1], 4: [1], 5: [1], 6: [2], 7: [3], 8: [4], 9: [1], 10: [5], 11: [], 12: [], 13: [], 14: []}


def test_templates_by_brute_force(spark):
    """Windows, chains and slots worked out by hand, on random texts with numbers."""
    rng = np.random.default_rng(9)
    some = [*"abcdefgh", "3", "4", "11"]
    texts = {k: " ".join(rng.choice(some, rng.integers(0, 60))) for k in range(60)}
    items = {k: " ".join(rng.choice(some, rng.integers(14, 24))) for k in range(8)}
    for k, text in items.items():
        words = text.split()
        texts[100 + k] = " ".join([*rng.choice(some, 5), *(str(int(w) + 5) if w.isdigit() else w for w in words), *rng.choice(some, 5)])
        texts[200 + k] = " ".join([*words[:9], "new", *words[9:]])

    def tokens(text):
        out = []
        for w in text.split():
            if w.isdigit() and out and out[-1][0]:
                out[-1] = (True, f"{out[-1][1]} {w}")
            else:
                out.append((w.isdigit(), w))
        return out

    def cut(text, typed=True, size=4):
        t = tokens(text) if typed else [(False, w) for w in text.split()]
        return [(p, tuple("#" if n else w for n, w in t[p : p + size]), [w for n, w in t[p : p + size] if n]) for p in range(len(t) - size + 1) if 2 * sum(n for n, _ in t[p : p + size]) <= size]

    table = spark.createDataFrame([*texts.items()], "doc_id bigint, text string")
    bench = spark.createDataFrame([*items.items()], "item_id bigint, text string")
    got = {r.row.doc_id: {x.item_id for x in r.leaks} for r in templates.find_leaks(table, bench, window=4, run=8, coverage=0.5).collect()}
    hits = [0, 0]
    for d, text in texts.items():
        for x, item in items.items():
            own = cut(item)
            # by the definition alone: the windows of one diagonal in a row whose values map one to one
            best = 0
            theirs = {}
            for q, w, v in cut(text):
                theirs.setdefault(w, []).append((q, v))
            match = {(p, q): list(zip(v, u)) for p, w, v in own for q, u in theirs.get(w, [])}
            for p, q in match:
                n, pairs = 0, {*match.get((p - 1, q - 1), ())}
                while (p + n, q + n) in match:
                    more = pairs | {*match[p + n, q + n]}
                    if len({a for a, _ in more}) < len(more) or len({b for _, b in more}) < len(more):
                        n *= all(a == b for a, b in pairs)  # values that contradict each other: only what is verbatim counts
                        break
                    pairs, n = more, n + 1
                if (p - 1, q - 1) not in match or all(a == b for a, b in pairs):
                    best = max(best, n)
            sure = best + 3 >= 8 or (own and best / len(own) >= 0.5)
            if sure:
                assert x in got[d], (d, x)
            hits[sure] += 1
    assert min(hits) >= 8 and all(k in got[100 + k] and k in got[200 + k] for k in items)


# --------------------------------------------------------------------- 9: WARC


def test_warc(spark):
    fake = "<p>WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n</p>"
    data = [(1, "u", "same"), (2, "u\nx", "same"), (3, None, fake), (4, "u", None), (5, "u", ""), (6, "u", "é" * 5000), (None, "n", "alone")]
    pages = spark.createDataFrame(data, "page_id bigint, url string, html string").repartition(2)
    got = {r.page_id: r for r in warc.digest(warc.round_trip(pages)).collect()}
    assert len(got) == 7
    for i, _, html in data:
        payload = (html or "").encode()
        assert got[i].payload_bytes == len(payload) and got[i].payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
    assert {i: (got[i].record_type, got[i].refers_to) for i in (1, 2, 4, 5)} == {1: ("revisit", 2), 2: ("response", None), 4: ("revisit", 5), 5: ("response", None)}
    assert warc.round_trip(pages.where("false")).count() == 0
    folder = warc.shared.folder(spark) + "/w"
    manifest = warc.write_archives(pages, folder)
    assert warc.candidates(manifest).count() == 8  # the payload's own record is a candidate and falls away
    # what an attempt that failed has left behind isn't read
    root = folder.removeprefix("file://")
    name = sorted(x for x in os.listdir(root) if x.endswith(".warc"))[0]
    shutil.copy(f"{root}/{name}", f"{root}/part-000000-999-00000.warc")
    assert warc.read_archives(manifest).count() == 7
    clash = warc.digest(warc.round_trip(pages.withColumn("payload", F.lit("x")).withColumn("carrier", F.lit(1)).withColumn("sha1", F.lit("y"))))
    assert {r.page_id: r.payload_digest for r in clash.collect()} == {i: r.payload_digest for i, r in got.items()}


def test_reachable():
    start, following = np.array([0, 10, 15, 30, 99]), np.array([10, 30, 40, 120, 120])
    assert warc.reachable(start, following).tolist() == [True, True, False, True, False]


# ------------------------------------------------------------------- 10: audio


def test_tables():
    u, a = telephony.ulaw_table(), telephony.alaw_table()
    assert (u[0], u[0x80], u[0xFF], u[0x7F]) == (-32124, 32124, 0, 0) and (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    x = np.random.default_rng(0).integers(-32768, 32767, 501).astype(np.int16)
    assert (telephony._twice(x) == telephony.resample(x, 8000, 16000)).all() and len(telephony.resample(x, 8000, 11025)) == 501 * 11025 // 8000


def adpcm(block):
    """One block, sample by sample."""
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(telephony.STEPS[index])
            change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + int(telephony.INDEX_STEP[code & 7])))
            out.append(value)
    return out


def test_media(docs, empty):
    blocks = np.random.default_rng(2).integers(0, 256, (5, 64)).astype(np.uint8)
    assert telephony.decode_adpcm(blocks).tolist() == [adpcm(bytes(b)) for b in blocks]
    texts = {i: (t or "").encode() for i, t, *_ in rows()}
    got = telephony.digest(telephony.media_columns(docs)).collect()
    assert len(got) == len(rows())
    for r in got:
        raw = texts[r.doc_id]
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert telephony.load(telephony.store(payload))[2] == payload
    assert telephony.media_columns(empty).count() == 0
