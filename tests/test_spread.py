import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stemtable.operators import linking, placement, spread


@pytest.fixture(autouse=True)
def small_chunks(spark):
    """Tiny test data would otherwise be merged into one chunk."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def hot_rows(n=3000):
    rng = random.Random(5)
    keys = ["hot" if rng.random() < 0.5 else f"k{rng.randrange(40)}" for _ in range(n)]
    return pd.DataFrame({"k": keys, "seq": range(n), "v": [rng.randrange(100) for _ in range(n)]})


def test_running_total_splits_a_hot_key(spark):
    pdf = hot_rows()
    df = spark.createDataFrame(pdf)
    got = spread.running_total(df, ["k"], ["seq"], {"total": F.col("v"), "pos": F.lit(1)}).toPandas().sort_values("seq")
    want = pdf.sort_values("seq")
    assert got["total"].tolist() == want.groupby("k")["v"].cumsum().tolist()
    assert got["pos"].tolist() == (want.groupby("k").cumcount() + 1).tolist()
    chunks = spread.ordered_chunks(df.repartition(4), ["k", "seq"])
    assert chunks.filter("k = 'hot'").select("_chunk").distinct().count() > 1


def test_running_total_without_keys(spark):
    pdf = hot_rows(500)
    got = spread.running_total(spark.createDataFrame(pdf), [], ["v", "seq"], {"total": F.col("v")}).toPandas()
    got = got.sort_values(["v", "seq"])
    assert got["total"].tolist() == got["v"].cumsum().tolist()


def test_previous_value(spark):
    pdf = hot_rows()
    got = spread.previous_value(spark.createDataFrame(pdf), ["k"], ["seq"], "v", "before").toPandas().sort_values("seq")
    want = pdf.sort_values("seq").groupby("k")["v"].shift()
    assert got["before"].fillna(-1).tolist() == want.fillna(-1).tolist()


def test_skew_join_splits_in_adaptive_plan(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10kb",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10kb",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, value in settings.items():
        spark.conf.set(k, value)
    try:
        rows = spark.range(0, 200_000, 1, 16).select(
            F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 1000).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v")
        )
        groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        joined = spread.skew_join(rows, groups, ["k"], "inner")
        assert joined.agg(F.sum("n").alias("s")).first().s == sum(r.n * r.n for r in groups.collect())
        joined.write.format("noop").mode("overwrite").save()
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, value in old.items():
            spark.conf.unset(k) if value is None else spark.conf.set(k, value)


def test_skew_join_kinds(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    lookup = spark.createDataFrame([(1, "x")], "k int, w string")
    got = {how: sorted(r.v for r in spread.skew_join(rows, lookup, ["k"], how).collect()) for how in ("inner", "left", "left_semi", "left_anti")}
    assert got == {"inner": ["a"], "left": ["a", "b", "c"], "left_semi": ["a"], "left_anti": ["b", "c"]}


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = sorted((find(a), find(b)))
        parent[rb] = ra
    return {n: find(n) for n in nodes}


def test_linked_groups_random_graph_and_chain(spark):
    rng = random.Random(11)
    nodes = list(range(300))
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(90)]
    edges += [(i, i + 1) for i in range(160, 220)] + [(250, i) for i in range(251, 280)] + [(5, 5)]
    items = spark.createDataFrame([(n,) for n in nodes], "item_id int")
    links = spark.createDataFrame(edges, "src int, dst int")
    got = {r.item_id: r.group_id for r in linking.linked_groups(items, links).collect()}
    assert got == components(nodes, edges)


def test_dedupe_linked(spark):
    rows = [
        ("g1", "v1", 0, "video", "/a", "n"), ("g1", "a1", 1, "audio", "/a", "n"),
        ("g2", "a2", 0, "audio", "/a", "n"), ("g2", "a3", 1, "audio", "/b", "n"),
        ("g3", "a4", 0, "audio", " /a ", "n"), ("g3", "a5", 1, "audio", "/a", "n"), ("g3", "a6", 2, "audio", None, "n"), ("g3", "a7", 3, "audio", "", "n"),
        ("g4", "o1", 0, "subtitle", "/a", "n"), ("g4", "v2", 1, "video", "/a", "n"),
    ]
    items = spark.createDataFrame(rows, "group_id string, item_id string, pos int, track_type string, file_path string, name string")
    got = {r.item_id: (r.suppressed, r.duplicate_of, r.group_size) for r in linking.dedupe_linked(items).collect()}
    assert got == {
        "a1": (False, None, 2), "a2": (False, None, 2), "a3": (False, None, 2), "a4": (False, None, 4),
        "a5": (True, "a4", 4), "a6": (False, None, 4), "a7": (False, None, 4), "v2": (False, None, 2),
    }


def test_distinct_groups(spark):
    rows = [(1, "a", 0), (1, "b", 0), (2, "b", 1), (2, "a", 1), (3, "a", 2), (3, "a", 2)]
    members = spark.createDataFrame(rows, "group_id int, item_id string, pos int")
    got = {(r.group_id, r.n_members) for r in linking.distinct_groups(members).collect()}
    assert got == {(1, 2), (3, 1)}


def test_replace_overlaps_brute_force(spark):
    rng = random.Random(3)

    def spans(n):
        out = []
        for i in range(n):
            start = rng.randrange(0, 400)
            out.append((i, rng.randrange(2), 1, start, start + rng.choice([0, 1, 5, 60, 300])))
        return out

    old, new = spans(300), spans(25)
    schema = "item_id int, timeline int, track int, start_f bigint, end_f bigint"
    for bucket in (7, 64, 1 << 16):
        got = placement.replace_overlaps(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), bucket_frames=bucket)
        marks = {r.item_id: r.replaced for r in got.collect()}
        want = {
            o[0]: any(o[1] == n[1] and o[3] < n[4] and o[4] > n[3] and n[3] < n[4] and o[3] < o[4] for n in new) for o in old
        }
        assert marks == want
