"""The pipeline's rows against its rules worked out by hand, on a small table."""

import hashlib

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
WORDS = [f"{a}{b}" for a in "ba ce di fo gu ha je ki lo mu na pe".split() for b in "ra se ti vo xu za".split()]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def test_pipeline(spark, tmp_path):
    base, passage, item = prose(120, 1), prose(60, 2), prose(30, 3)
    near = base.replace(base.split()[60], "changed", 1)
    texts = {
        1: base, 2: base, 3: near, 4: prose(40, 4) + " " + passage + " " + prose(40, 5), 5: prose(40, 6) + " " + passage + " " + prose(40, 7),
        6: prose(40, 8) + " " + item + " " + prose(40, 9), 7: "", 8: None, 9: prose(500, 10), None: prose(50, 11),
    }
    spark.createDataFrame([(i, t, "en", "s", None) for i, t in texts.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # copies of 1 go, 6 has a benchmark item; without labels nothing is toxic
    seen, want = set(), {}
    for i in (None, 1, 4, 5, 6, 7, 8, 9):
        text = (texts[i] or "").encode()
        gone = bytearray(len(text))
        for p in range(len(text) - 99):
            if text[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(text[p : p + 100])
        want[i] = hashlib.sha256(bytes(c for c, g in zip(text, gone) if not g)).hexdigest()
    assert want[5] != hashlib.sha256(texts[5].encode()).hexdigest()
    del want[6]
    assert got == want


def test_labels_and_awkward_rows(spark, tmp_path):
    """Toxic documents go at the first stage; very long, repeated and wider rows pass; equal ids with other texts stay apart."""
    foul = " vile foul vile rotten foul"
    texts = [(i, prose(70, 100 + i) + (foul if i % 5 == 0 else "")) for i in range(300)] + [(400, ""), (401, None), (402, prose(30_000, 7)), (403, prose(60, 8)), (403, prose(60, 8)), (404, prose(60, 9)), (404, prose(60, 10)), (None, prose(60, 11))]
    docs = spark.createDataFrame([(i, t, "en", "s", None, "more", 1) for i, t in texts], "doc_id bigint, text string, lang string, source string, n_chars bigint, batch string, leaks int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(30, 12))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = corpus_pipeline.without_toxic(spark, kept, str(tmp_path))
    assert left.columns == docs.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect()) == sorted((i is None, i or 0) for i, t in texts if not (t or "").endswith(foul))
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    clean = [i for i in range(300) if i % 5]
    assert got == sorted([*((False, i) for i in (*clean, 400, 401, 402, 403, 404, 404)), (True, 0)])


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
