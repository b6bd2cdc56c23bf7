"""Verdicts of figures on cases worked out by hand."""

import base64
import hashlib

import pytest

from pyspark.sql import functions as F

from quire.operators import figures as G

pin = lambda s: f"'sha256-{base64.b64encode(hashlib.sha256(s.encode()).digest()).decode()}'"
CASES = [
    (b"", "served", "", []),
    (b"<p onx>", "script-outside-text", "onx", []),
    (b"<!-- <iframe> --><svg><title><iframe></title></svg><style>a{b:'<object>'}</style>", "served", "", []),
    (b"<script>if (a<b) '<iframe>'</script><script type=' Module '>x</script><script>if (a<b) '<iframe>'</script>", "served", "", [pin("if (a<b) '<iframe>'"), pin("x")]),
    (b"<script>a\r\nb</script><script></script>", "served", "", [pin("a\nb"), pin("")]),
    (b"<script src=''></script>", "script-outside-text", "<script src>", []),
    (b"<script type=importmap>{}</script>", "script-outside-text", '<script type="importmap">', []),
    (b"<svg><script xlink:href=a /></svg>", "script-outside-text", "<script xlink:href>", []),
    (b"<noscript><object></object></noscript>", "nested-frame", "<object>", []),
    (b"<a href=' JaVa\n\tScript&colon;x'>", "script-outside-text", "javascript:", []),
    (b"<a ping=/p>", "loads-elsewhere", "ping", []),
    (b"<meta http-equiv=' Refresh ' content=1>", "loads-elsewhere", '<meta http-equiv="refresh">', []),
    (b"<meta http-equiv=content-type><meta charset=utf-8>", "served", "", []),
    (b"<LINK rel=preconnect>", "loads-elsewhere", "<link>", []),
    (b"<a onclick=x><iframe>", "script-outside-text", "onclick", []),
    (b"<iframe onload=x>", "nested-frame", "<iframe>", []),
    (b"\xff\xfea", "utf-16", "", []),
    (b"\xff", "not-text", "", []),
    (b"a\0", "not-text", "", []),
    (b"<iframe>" + b"a" * G.LIMIT, "too-large", "", []),
    (b"a" * G.LIMIT, "served", "", []),
]


@pytest.mark.parametrize("data, verdict, detail, scripts", CASES)
def test_inspect(data, verdict, detail, scripts):
    assert G.inspect(data) == (verdict, detail, scripts)


def test_table(spark):
    rows = spark.createDataFrame([(k, c[0], "mine") for k, c in enumerate(CASES)] + [(99, None, "mine")], "id int, data binary, detail0 string")
    got = {r.id: (r.verdict, r.detail, r.scripts) for r in G.inspected(rows, F.col("data")).collect()}
    assert got == {k: c[1:] for k, c in enumerate(CASES)} | {99: ("served", "", [])}
    assert G.inspected(rows.where("false"), F.col("data")).count() == 0
