"""Every registered query of the library proper against its DuckDB SQL on the small tables."""

import os
from decimal import Decimal

import pytest

from quire.plans import registry

DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{DIR}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(x):
    if isinstance(x, (float, Decimal)):
        return round(float(x), 6)
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    if isinstance(x, dict):
        return [plain(y) for y in x.values()]
    return bytes(x) if isinstance(x, bytearray) else x


def table(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted((repr([plain(r[k]) for k in order]) for r in rows))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_oracle(spark, db, name):
    got = registry.QUERIES[name](spark, DIR)
    mine = table(got.columns, got.collect())
    if name not in registry.ORACLES:
        return
    want = db.execute(registry.ORACLES[name])
    assert mine == table([x[0] for x in want.description], want.fetchall())
