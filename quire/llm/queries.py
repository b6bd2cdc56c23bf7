"""One query for each operator of the subpackage, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.llm import byte_bpe, chosen_path, compact_windows, fill_middle, html_blocks, kd_clusters, licenses, secrets, suffix_dedup, telephony, templates, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_suffix_array_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")))


@query("op3_byte_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.digest(byte_bpe.encode_decode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN))


@query("op9_warc")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(warc.round_trip(table(spark, sf_dir, "pages")))


@query("op10_media_columns")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.digest(telephony.media_columns(table(spark, sf_dir, "documents")))


#: Five-word shingles of a text (of all its words, if fewer), as in the kernel's definition of a word.
SHINGLES = r"""
    tokens AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-/:-@\[-^`{-\x7f]+') AS w FROM documents),
    grams AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM tokens),
    shingle AS (SELECT DISTINCT doc_id, g FROM grams)"""

OP2_SQL = f"""
WITH RECURSIVE {SHINGLES},
    sizes AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
    shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingle a JOIN shingle b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (SELECT s.a, s.b FROM shared s JOIN sizes x ON x.doc_id = s.a JOIN sizes y ON y.doc_id = s.b WHERE s.n >= 0.8 * (x.n + y.n - s.n) - 1e-9),
    reach AS (SELECT doc_id AS v, doc_id AS r FROM documents UNION SELECT reach.v, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT d.doc_id, (SELECT min(r) FROM reach WHERE v = d.doc_id) AS class_id, (SELECT count(*) FROM links WHERE a = d.doc_id) AS n_links FROM documents d
"""


@query("op2_ngram_jaccard_join", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")


@query("op8_benchmark_decontamination")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return templates.digest(templates.find_leaks(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"]))


@query("op6_substring_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.near_duplicate_passages(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_passages", "n_words")


_TEMPLATES = ", ".join("({}, '{}', '{}', {}, '{}')".format(*(x.replace("'", "''") if isinstance(x, str) else x for x in row)) for row in licenses.template_rows())
OP5_SQL = f"""
WITH templates(template, license, kind, least, text) AS (VALUES {_TEMPLATES}),
    own AS (SELECT doc_id, coalesce(source, '') || '/' || coalesce(lang, '') || '/' || (doc_id // 500) || '/' || doc_id || '.md' AS path, lower(coalesce(text, '')) AS text FROM documents),
    units AS (SELECT path, 'line' AS unit, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM own
        UNION ALL SELECT path, 'run', unnest(regexp_split_to_array(text, '{licenses.GAP}')), generate_subscripts(regexp_split_to_array(text, '{licenses.GAP}'), 1) FROM own
        UNION ALL SELECT path, 'whole', text, 0 FROM own),
    terms AS (SELECT path, unit, n, word, 1 + ln(count(*)) AS tf FROM (SELECT path, unit, n, unnest(regexp_extract_all(text, '{licenses.WORD}')) AS word FROM units) GROUP BY ALL),
    shown AS (SELECT template, word, 1 + ln(count(*)) AS tf FROM (SELECT template, unnest(regexp_extract_all(lower(text), '{licenses.WORD}')) AS word FROM templates) GROUP BY ALL),
    n AS (SELECT (SELECT count(*) FROM own) + (SELECT count(*) FROM templates) AS total),
    idf AS (SELECT word, ln((1 + total) / (1 + count(*))) + 1 AS idf FROM (SELECT word FROM terms WHERE unit = 'whole' AND word IN (SELECT word FROM shown) UNION ALL SELECT word FROM shown), n GROUP BY word, total),
    weights AS (SELECT template, word, tf * idf AS w FROM shown JOIN idf USING (word)),
    norms AS (SELECT template, sqrt(sum(w * w)) AS norm FROM weights GROUP BY template),
    weighed AS (SELECT path, unit, n, word, tf * coalesce(idf, ln(1 + total) + 1) AS w FROM terms LEFT JOIN idf USING (word), n AS t),
    lengths AS (SELECT path, unit, n, sqrt(sum(w * w)) AS length FROM weighed GROUP BY ALL),
    cosines AS (SELECT path, unit, template, license, kind, round(sum(a.w * b.w / norm) / length, 6) AS similarity FROM weighed a JOIN weights b USING (word) JOIN norms USING (template) JOIN templates USING (template)
        JOIN lengths USING (path, unit, n) GROUP BY path, unit, n, template, license, kind, length, least HAVING round(sum(a.w * b.w / norm) / length, 6) >= least),
    best AS (SELECT path, CASE WHEN kind = 'title' OR unit = 'whole' THEN 'file' ELSE 'header' END AS kind, license, similarity FROM cosines WHERE unit <> 'whole' OR kind <> 'tag'
        QUALIFY row_number() OVER (PARTITION BY path, CASE WHEN kind = 'title' OR unit = 'whole' THEN 'file' ELSE 'header' END ORDER BY similarity DESC, template) = 1),
    kept AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, license, similarity FROM best WHERE kind = 'file' QUALIFY row_number() OVER (PARTITION BY dir ORDER BY similarity DESC, path) = 1),
    headers AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY path ORDER BY kind DESC) = 1),
    above AS (SELECT path, array_to_string(string_split(path, '/')[1:k], '/') AS dir, k FROM own, range(0, 4) r(k)),
    nearest AS (SELECT path, dir, license, similarity FROM above JOIN kept USING (dir) QUALIFY row_number() OVER (PARTITION BY path ORDER BY k DESC) = 1)
SELECT o.doc_id, coalesce(h.license, i.license) AS license, coalesce(h.similarity, i.similarity) AS similarity,
    CASE WHEN h.path IS NOT NULL THEN h.kind WHEN i.path IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin, CASE WHEN h.path IS NULL THEN i.dir END AS from_dir
FROM own o LEFT JOIN headers h USING (path) LEFT JOIN nearest i USING (path)
"""


@query("op5_license_scans", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    path = F.concat_ws("/", part("source"), part("lang"), F.floor(F.col("doc_id") / 500).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    found = licenses.scan(docs.select(path.alias("path"), "text"))
    return found.select(F.regexp_extract("path", r"(\d+)\.md$", 1).cast("bigint").alias("doc_id"), "license", "similarity", "origin", "from_dir")


@query("op7_html_extraction")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_blocks.main_text(pages, html_blocks.fit(pages)).select("page_id", "url", "text", "n_chars")


def _op11_sql(k: int = 16, rounds: int = 3) -> str:
    """The rounds one after the other; a vector is a row of its number, its id and its integers."""
    near = """near{r} AS (SELECT row, vec_id, v, c, d FROM (SELECT row, vec_id, v, c, list_sum(list_transform(list_zip(v, w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM own, means{r})
        QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, c) = 1)"""
    mean = """means{s} AS (SELECT c, coalesce(w2, w) AS w FROM means{r} LEFT JOIN (SELECT c, list(m ORDER BY i) AS w2 FROM (SELECT c, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS m
        FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM near{r}) GROUP BY c, i) GROUP BY c) USING (c))"""
    steps = [x for r in range(rounds) for x in (near.format(r=r), mean.format(r=r, s=r + 1))] + [near.format(r=rounds)]
    return f"""
WITH own AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
    means0 AS (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1)::INTEGER AS c, v AS w FROM own ORDER BY sha256('1:' || vec_id), v LIMIT {k}),
    {", ".join(steps)}
SELECT vec_id, c AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
FROM near{rounds} JOIN means{rounds} USING (c)
"""


@query("op11_centroid_clusters", _op11_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_clusters.cluster_vectors(table(spark, sf_dir, "embeddings")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


OP12_SQL = """
WITH own AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
    parts AS (SELECT *, length(text) AS n, [('0x' || substr(h, 1 + 8 * k, 8))::UBIGINT::BIGINT for k in range(4)] AS x FROM own),
    cuts AS (SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS lo, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS hi,
        CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR x[3] % 100 >= 90 THEN 'plain' WHEN x[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM parts),
    said AS (SELECT *, substring(text, 1, lo) AS p, substring(text, lo + 1, hi - lo) AS m, substring(text, hi + 1) AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
    sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256, sha256(text) AS restored_sha256
FROM said
"""


@query("op12_fill_in_middle", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(fill_middle.transform(table(spark, sf_dir, "documents")))


@query("op13_secret_scans")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))
