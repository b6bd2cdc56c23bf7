"""Scalar functions of names, paths and texts on values worked out by hand."""

import numpy as np
import pandas as pd

from quire.functions import text as T


def test_names():
    assert T.nfc("e\u0301") == "\u00e9" and T.name_key("  E\u0301t\u00c9 ") == "\u00e9t\u00e9"
    assert T.fold_fragment("\u00c4B C") == "\u00e4b c" and T.section_id("What's new, \u00c9t\u00e9?") == "what-s-new-\u00e9t\u00e9" and T.section_id("!!") == "section"
    assert T.github_anchors(["A b", "A b", "A-b-1", "A b"]) == ["a-b", "a-b-1", "a-b-1-1", "a-b-2"]
    assert T.heading_ids(["One", "One", "Two"]) == ["one", "one-2", "two"]


def test_fingerprints():
    rng = np.random.default_rng(1)
    rows = [["".join(rng.choice(list("ab/\u00e9\u65e5 "), rng.integers(0, 30))) for _ in range(3)] for _ in range(200)] + [["", "", ""]]

    def fnv(parts):
        h = 14695981039346656037
        for byte in "".join(p + "\x1f" for p in parts).encode():
            h = (h ^ byte) * 1099511628211 % 2**64
        return f"v1:{h:016x}"

    want = [fnv(r) for r in rows]
    assert [T.fingerprint(*r) for r in rows] == want
    assert T.fingerprints(*(pd.Series(c) for c in zip(*rows))).tolist() == want


def test_paths():
    assert T.markdown_path("a/b.md", "../c%20d.md#x") == "c d.md" and T.markdown_path("a.md", "../x.md") is None and T.markdown_path("a.md", "../x.md", True) == "../x.md"
    assert T.markdown_path("a.md", "https://x") is None and T.markdown_path("a.md", "/x") is None and T.markdown_path("a.md", "%zz") is None
    assert T.percent_decoded("a+b%2Fc") == "a+b/c" and T.percent_decoded("%f") is None and T.percent_decoded("%ff") is None
    names = ["b/2.md", "b/10.md", "a10.md", "a2.md", "b.md"]
    assert sorted(names, key=T.sort_key).index("a2.md") < sorted(names, key=T.sort_key).index("a10.md")
    assert sorted(names, key=T.sort_key).index("b/2.md") < sorted(names, key=T.sort_key).index("b/10.md")


def test_disguises():
    assert T.undisguised("Se%63ret&#47;Diary") == "secret/diary" and T.undisguised("\uff33ecret\u200b\u2044x") == "secret/x" and T.undisguised("%2553") == "s"
    assert T.spells("see SECRET\u2215Diary", ["Secret/Diary"]) and not T.spells("secretary", ["Secret"])
    assert T.split_runs("go1234") == "go 1234" and T.split_runs("a1") == "" and T.split_runs("abc") == ""
    assert T.hit_runs("One two one", ["one"]) == [("One", True), (" two ", False), ("one", True)]
    assert T.language_tag("zh-hant-tw") == "zh-Hant-TW" and T.language_tag("x_y") is None


def test_nfc_of_whole_texts(spark):
    """Batches of any texts, with nulls, over slices' ends; of a batch only a slice is in Python strings at one time."""
    import tracemalloc
    import unicodedata

    import pyarrow as pa

    texts = [None if k % 7 == 3 else ("plain " if k % 2 else "é Å ") * (k % 5) for k in range(300)]
    want = [x if x is None else unicodedata.normalize("NFC", x) for x in texts]
    table = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(1)
    T.register(spark)
    for got in (table.select("id", T.nfc_udf("text")), table.selectExpr("id", "note_nfc(text)")):
        assert [r[1] for r in sorted(got.collect())] == want
    assert T.nfc_udf.func(pa.array([], pa.string())).to_pylist() == []
    long = pa.array(["é" * 10_000] * 2_000)
    tracemalloc.start()
    out = T.nfc_udf.func(long)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 2_000 and peak < 10e6 < long.nbytes
