"""Keyed tables: what a batch changes, reads, shuffles and rewrites."""

import os
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import ingest, keyed


@pytest.fixture()
def table(spark, tmp_path):
    rows = [(i, f"k{i % 3}", f"old{i}") for i in range(300)]
    name = f"keyed_{random.randrange(10**9)}"
    yield rows, keyed.create(spark.createDataFrame(rows, "id long, kind string, value string"), name, ["id", "kind"], parts=10, buckets=4, path=f"file://{tmp_path}/t"), tmp_path / "t"
    spark.sql(f"drop table {name}")


def content(table):
    return sorted(map(tuple, table.read().collect()))


def files(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_upserts_and_deletes(spark, table):
    rows, t, _ = table
    fresh = [(5, "k2", "new5"), (7, "k0", "new key"), (999, "k0", "new999"), (5, "k2", "older"), (None, None, "no key"), (None, None, "no key")]
    for _ in range(2):
        t.upsert(spark.createDataFrame(fresh, "id long, kind string, value string"), F.asc("value"))
        want = [r for r in rows if r[:2] != (5, "k2")] + [(5, "k2", "new5"), (7, "k0", "new key"), (999, "k0", "new999")]
        got = [r for r in content_with_nulls(t) if r[0] is not None]
        assert sorted(got) == sorted(want)
    t.delete(spark.createDataFrame([(5, "k2"), (6, "k0"), (12345, "k0")], "id long, kind string"))
    assert {r[0] for r in content_with_nulls(t) if r[1] == "k2" or r[0] == 6} == {i for i in range(300) if i % 3 == 2} - {5}
    t.upsert(spark.createDataFrame([], "id long, kind string, value string"), F.asc("value"))
    assert len(content_with_nulls(t)) >= 301


def content_with_nulls(t):
    return [tuple(r) for r in t.read().collect()]


def test_only_touched_parts_are_rewritten(spark, table):
    rows, t, folder = table
    before = files(folder)
    t.upsert(spark.createDataFrame([(5, "k2", "new5")], "id long, kind string, value string"), F.asc("value"))
    part = spark.createDataFrame([(5, "k2")], "id long, kind string").select(F.pmod(F.xxhash64("id", "kind"), F.lit(10)).alias("p")).first().p
    changed = before ^ files(folder)
    assert changed and all(f"_part={part}/" in f for f in changed)
    assert content(t) == sorted((*r[:2], "new5") if r[0] == 5 else r for r in rows)


def test_the_table_is_not_shuffled(spark, table):
    _, t, _ = table
    batch = spark.createDataFrame([(5, "k2"), (6, "k0")], "id long, kind string")
    plan = keyed.untouched(t.touched(batch), batch, t.keys)._jdf.queryExecution().executedPlan().toString()
    left = plan.split("SortMergeJoin")[1]
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in left and "PartitionFilters: [isnotnull(_part" in plan or "_part" in plan.split("PartitionFilters: [")[1]


def test_merge_of_versions_in_a_keyed_table(spark, tmp_path):
    """The version table after batches is that of the operator over all rows."""
    schema = "document_id long, version_number int, content_hash string, is_current boolean"
    start = spark.createDataFrame([(i, 1, f"h{i}", True) for i in range(40)], schema)
    name = f"versions_{random.randrange(10**9)}"
    t = keyed.create(start, name, ["document_id"], parts=5, buckets=2, path=f"file://{tmp_path}/v")
    want = start
    for n in (3, 4):
        batch = spark.createDataFrame([(i, f"h{i}" if i % 2 else f"n{n}") for i in range(0, 60, n)], "document_id long, content_hash string")
        t.apply(batch, ingest.upsert_versions)
        want = spark.createDataFrame(ingest.upsert_versions(want, batch).collect(), schema)
    assert content(t) == sorted(map(tuple, want.collect()))
    spark.sql(f"drop table {name}")
