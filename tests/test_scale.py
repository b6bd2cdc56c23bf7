"""Steps that meet tables without bound: none is sent whole to all tasks, and no row carries a list that grows with a name's claimants."""

import pytest
from pyspark.sql import functions as F

from quire.operators import resolve as R


@pytest.fixture(scope="module")
def tables(spark):
    """300 files with one name, each with one of its own; every note cites both and a name that none has."""
    names = spark.range(300).select(F.explode(F.array(F.lit("shared"), F.concat(F.lit("k"), "id"))).alias("key"), F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("path"), F.lit("alias").alias("kind"), F.lit(False).alias("located"))
    target = F.explode(F.array(F.lit("shared"), F.concat(F.lit("k"), "id"), F.lit("none")))
    links = spark.range(200).select(F.concat(F.lit("c"), "id").alias("path"), F.lit(1).alias("line"), target.alias("target")).withColumn("key", F.col("target"))
    return links, names


def plan(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_short_lists(tables, capsys):
    """Of 300 claimants the first and their number; the outcome is that of the whole list."""
    links, names = tables
    short, whole = R.resolve(links, names, whole=False), R.resolve(links, names)
    assert "Broadcast" not in plan(short, capsys)
    assert {(r.key == "shared", tuple(r.paths or ()), r.candidates) for r in short.collect() if r.key == "shared"} == {(True, ("n000",), 300)}
    seen = lambda df: sorted((r.path, r.key, r.resolution, r.candidates, (r.paths or [None])[0], r.located) for r in df.collect())
    assert seen(short) == seen(whole) and {len(r.paths) for r in whole.where("key = 'shared'").collect()} == {300}


@pytest.mark.parametrize("step", ["resolve_with_suffixes", "broken", "backlinks", "declared", "provenance", "resolve_again"])
def test_no_broadcast(tables, capsys, step):
    links, names = tables
    found = R.resolve(links, names, whole=False)
    made = {
        "resolve_with_suffixes": lambda: R.resolve_with_suffixes(links, names, names.select("path").distinct(), key=F.lower, whole=False),
        "broken": lambda: R.broken(found, names.select("key", "path"), names.select("key")),
        "backlinks": lambda: R.backlinks(found),
        "declared": lambda: R.declared(links.select("path", F.col("line").alias("ord"), F.col("target").alias("value"), "key"), names, whole=False),
        "provenance": lambda: R.provenance(links.withColumn("value", F.col("target")), names, names.select(F.col("key").alias("slug"), "path")),
        "resolve_again": lambda: R.resolve_again(links, names, found, names, links.where("path < 'c2'").select("path"), whole=False),
    }[step]()
    assert "Broadcast" not in plan(made, capsys)
    assert made.count() == {"resolve_with_suffixes": 600, "broken": 200, "backlinks": 200, "declared": 600, "provenance": 200, "resolve_again": 600}[step]


def test_expanded_edges(spark, tables, capsys):
    """Every edge once, though keys share claimants in part, and no distinct over the edges."""
    links, names = tables
    more = [("c1", "x"), ("c1", "y"), ("c1", "z"), ("c2", "x"), ("c2", "x"), ("c3", "z"), ("c3", "k5"), ("c3", "shared")]
    held = [("x", "n001"), ("x", "n002"), ("y", "n002"), ("y", "n003"), ("y", "n003"), ("z", "n002"), ("z", "n999")]
    links = links.select("path", "key").union(spark.createDataFrame(more, "path string, key string"))
    names = names.select("key", "path").union(spark.createDataFrame(held, "key string, path string"))
    want = sorted(map(tuple, links.join(names.withColumnRenamed("path", "target"), "key").select("path", "target").distinct().collect()))
    got = R.expanded(links, names)
    assert sorted(map(tuple, got.collect())) == want
    top = plan(got, capsys).split("SortMergeJoin")[0]
    assert "Aggregate" not in top and "Exchange" not in top


def test_edges_stay_apart(spark, capsys):
    """Orders and their lines meet sorted, in partitions that aren't merged by their size in bytes."""
    from quire.plans.tables import edges

    text = plan(edges(lambda t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")), capsys)
    assert "SortMergeJoin" in text and "Broadcast" not in text and text.count("REPARTITION_BY_NUM") == 2


def test_partitions_follow_the_input(spark, capsys, monkeypatch):
    """Input files of more than a partition's bytes are dealt into more partitions than a shuffle has, both sides of a join into as many; results stay."""
    from quire.plans.graph import n13_sources

    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
    want = sorted(map(tuple, n13_sources(read).collect()))
    monkeypatch.setattr(R, "PART", 1 << 13)
    got = n13_sources(read)
    n = R.partitions(read("lineitem"), read("orders"))
    text = plan(got, capsys)
    assert n > 4 and text.count(f", {n}), REPARTITION_BY_NUM") == 2 == text.count("Exchange")
    assert sorted(map(tuple, got.collect())) == want


def shuffled(spark):
    """Rows that all stages so far have written to shuffles."""
    sc, jvm = spark.sparkContext, spark._jvm
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {(s := stages.apply(k)).stageId(): s.shuffleWriteRecords() for k in range(stages.size())}


def test_expanded_edges_shuffle_no_products(spark):
    """Of 3000 notes that cite a name of 12,000 files, no more is shuffled than some times the links and names, though there are 36 million edges."""
    names = spark.range(12_000).select(F.lit("shared").alias("key"), F.concat(F.lit("n"), "id").alias("path"))
    links = spark.range(3000).select(F.concat(F.lit("c"), "id").alias("path"), F.lit("shared").alias("key"))
    before = shuffled(spark)
    assert R.expanded(links, names).count() == 36_000_000
    assert sum(n for k, n in shuffled(spark).items() if k not in before) < 10 * (3000 + 12_000)


def test_expanded_edges_in_groups(spark, tables, monkeypatch):
    """Names cut into blocks and notes dealt into groups give every edge once."""
    monkeypatch.setattr(R, "HOLD", 7)
    monkeypatch.setattr(R, "LEAST", 3)
    links, names = tables[0].select("path", "key"), tables[1]
    want = sorted(map(tuple, links.join(names.select("key", F.col("path").alias("target")), "key").select("path", "target").distinct().collect()))
    assert sorted(map(tuple, R.expanded(links, names).collect())) == want


def test_resolve_again_shuffles(spark):
    """The old links and the new ones are dealt by note once, what is left of both by key once, and no plan holds two of these."""
    from quire.shared import written

    names = spark.range(60).select(F.concat(F.lit("k"), "id").alias("key"), F.concat(F.lit("n"), "id").alias("path"), F.lit("alias").alias("kind"), F.lit(False).alias("located"))
    links = spark.range(20_000).select(F.concat(F.lit("c"), F.col("id") % 4000).alias("path"), F.col("id").alias("line"), F.concat(F.lit("k"), F.col("id") % 70).alias("key"))
    before, seen = written(R.resolve(links, names, whole=False)), shuffled(spark)
    got = R.resolve_again(links, names.where("key <> 'k3'"), before, names, links.where("path < 'c2'").select("path"), whole=False)
    lost = sum(k % 70 in (3, *range(60, 70)) for k in range(20_000))
    assert dict(got.groupBy("resolution").count().collect()) == {"unresolved": lost, "unique": 20_000 - lost}
    assert sum(n for k, n in shuffled(spark).items() if k not in seen) < 3.5 * 20_000
