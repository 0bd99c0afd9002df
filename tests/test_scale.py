"""Positions, skew joins, pages and exact top-k on small tables."""

from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import ids, rounds, similarity
from gaugeworks.operators import scale as S


def hot_table(spark, n=400):
    """A third of all rows under one key."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 40).cast("string"))).alias("k"),
        F.pmod(F.col("id") * 7919, F.lit(1009)).alias("v"),
        F.col("id"),
    )


def test_positions(spark):
    df = hot_table(spark).repartition(7)
    got = S.positions(df, ["k"], [F.col("v"), F.col("id")], "p").collect()
    by_key = {}
    for r in sorted(got, key=lambda r: (r["k"], r["v"], r["id"])):
        by_key.setdefault(r["k"], []).append(r["p"])
    assert all(p == list(range(len(p))) for p in by_key.values())
    whole = S.positions(df, [], [F.desc("id")], "p").orderBy("p").collect()
    assert [r["id"] for r in whole] == list(range(399, -1, -1))


def test_positions_null_key(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 5)], "k string, v int")
    got = {(r["k"], r["v"]): r["p"] for r in S.positions(df, ["k"], [F.col("v")], "p").collect()}
    assert got == {(None, 1): 0, (None, 2): 1, ("a", 5): 0}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_same_as_plain(spark, how):
    df = hot_table(spark)
    dim = df.select("k").distinct().filter("k <> 'k1'").withColumn("name", F.upper("k"))
    plain = df.join(dim, "k", how)
    want = sorted(map(tuple, plain.collect()))
    for got in (
        S.skew_join(df, dim, ["k"], how),
        S.skew_join(df, dim, ["k"], how, null_equal=True),
        S.skew_join(df, dim, ["k"], how, hot_rows=50),
        S.skew_join(df, dim, ["k"], how, hot_rows=7, counts=df.groupBy("k").count()),
    ):
        assert got.columns == plain.columns
        assert sorted(map(tuple, got.collect())) == want


def test_hot_keys(spark):
    df = hot_table(spark)
    hot = S.hot_keys(df.groupBy("k").count(), ["k"], "count", 50).collect()
    assert [(r["k"], r["__fan"]) for r in hot] == [("hot", 3)]


def test_skew_join_null_keys(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2)], "k string, v int")
    dim = spark.createDataFrame([(None, "n"), ("a", "x")], "k string, name string")
    for join in (S.skew_join, partial(S.skew_join, hot_rows=0.5)):
        assert join(df, dim, ["k"], "left", null_equal=True).filter("name IS NULL").count() == 0
        assert join(df, dim, ["k"], "left").filter("name IS NULL").count() == 1


def test_lists_keep_everything(spark):
    df = hot_table(spark)
    whole = S.ordered_lists(df, ["k"], ["v", "id"], {"ids": F.col("id")}).collect()
    assert sorted(i for r in whole for i in r["ids"]) == list(range(400))
    assert len({r["k"] for r in whole}) == len(whole)
    order = {r["id"]: (r["v"], r["id"]) for r in df.collect()}
    assert all(r["ids"] == sorted(r["ids"], key=order.get) for r in whole)


def test_first_and_top(spark):
    df = hot_table(spark)
    first = {r["k"]: r["id"] for r in S.first_per_key(df, ["k"], [F.desc("id")]).collect()}
    assert first["hot"] == 399
    top = S.top_per_key(df, ["k"], [F.desc("id")], 2, "rank").filter("k = 'hot'").orderBy("rank").collect()
    assert [(r["id"], r["rank"]) for r in top] == [(399, 0), (396, 1)]


def test_group_limit_before_exchange(spark):
    plan = S.first_per_key(hot_table(spark), ["k"], [F.col("v")])._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_k_range_both_ways(spark):
    df = hot_table(spark).withColumnRenamed("v", "rank_idx")
    near = rounds.k_range(df, 2, 5, keys=["k"], ties=["id"])
    rounds_limit = rounds._GROUP_LIMIT
    try:
        rounds._GROUP_LIMIT = 0
        far = rounds.k_range(df, 2, 5, keys=["k"], ties=["id"])
        assert sorted(r["id"] for r in near.collect()) == sorted(r["id"] for r in far.collect())
    finally:
        rounds._GROUP_LIMIT = rounds_limit


def brute_top(q, v, k):
    sims = np.round(q @ v.T, 12)
    return [np.lexsort((np.arange(len(v)), -s))[:k] for s in sims]


@pytest.mark.parametrize("block,parts", [(1 << 20, 1), (64, 5)])
def test_top_k(spark, block, parts):
    rng = np.random.default_rng(0)
    q, v = rng.normal(size=(5, 8)), rng.normal(size=(60, 8)).astype(np.float32)
    v[17] = v[3]  # copies tie, the lower id wins
    qs = spark.createDataFrame([(f"c{i}", x.tolist()) for i, x in enumerate(q)], "c string, embedding array<double>")
    vs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "instance_idx bigint, embedding array<float>")
    got = similarity.top_k(qs, vs.repartition(parts), 7, query_keys=["c"], block_bytes=block).collect()
    want = brute_top(q, v.astype(float), 7)
    for i in range(5):
        rows = sorted((r["rank_idx"], r["instance_idx"]) for r in got if r["c"] == f"c{i}")
        assert rows == list(enumerate(want[i].tolist()))


def test_top_k_edge_sizes(spark):
    vs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "instance_idx bigint, embedding array<float>")
    qs = spark.createDataFrame([("a", [1.0, 1.0])], "c string, embedding array<double>")
    got = similarity.top_k(qs, vs, 10, query_keys=["c"]).orderBy("rank_idx").collect()
    assert [r["instance_idx"] for r in got] == [1, 2]
    assert similarity.top_k(qs.limit(0), vs, 10, query_keys=["c"]).count() == 0


def test_fetch_keeps_order_and_duplicates(spark):
    ddl = "dset_name string, local_idx bigint, convo array<struct<role:string,content:string>>"
    corpus = spark.createDataFrame(
        [("a", 0, [("user", "a0")]), ("a", 1, [("user", "a1")]), ("b", 0, [("user", "b0")])], ddl
    )
    numbered = ids.global_ids(corpus.select("dset_name", "local_idx"))
    ranges = ids.id_ranges(numbered, shard_size=1)
    assert ids.range_gaps(ranges).count() == 0
    assert ids.range_gaps(ranges.filter("start <> 1")).count() == 1
    wanted = spark.createDataFrame([(0, 2), (1, 0), (2, 2), (3, 9)], "pos int, instance_idx bigint")
    got = ids.fetch(wanted, ranges, corpus, shard_size=1).orderBy("pos").collect()
    assert [(r["dset_name"], r["local_idx"]) for r in got] == [("b", 0), ("a", 0), ("b", 0), (None, None)]
    assert got[0]["convo"][0]["content"] == "b0" and got[3]["convo"] is None
    with pytest.raises(Exception, match="outside every range"):
        ids.require_known(ids.lookup(wanted, ranges, shard_size=1)).collect()


def test_partition_invariance(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    out = []
    try:
        for n in ("1", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = hot_table(spark).repartition(int(n))
            rows = S.positions(df, ["k"], [F.col("v"), F.col("id")], "p").collect()
            out.append(sorted(map(tuple, rows)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out[0] == out[1]


def test_checkpoint_folder_of_the_session(spark):
    from gaugeworks.session import checkpoint_folder, materialised

    folder = checkpoint_folder(spark)
    df = materialised(spark.range(3))
    assert df.inputFiles()[0].replace("file://", "").startswith(folder.replace("file:", ""))


def test_hot_key_is_spread_over_salts(spark):
    """No salt of a hot key holds much more than the wanted number of rows."""
    df = hot_table(spark, 30_000)
    fan = S.hot_keys(df.groupBy("k").count(), ["k"], "count", 500).filter("k = 'hot'").first()["__fan"]
    sizes = df.filter("k = 'hot'").groupBy(F.pmod(F.xxhash64("k", "v", "id"), F.lit(fan))).count().collect()
    assert fan == 20 and len(sizes) == 20 and max(r["count"] for r in sizes) < 750
    dim = df.select("k").distinct()
    out = S.skew_join(df, dim, ["k"], hot_rows=500).groupBy("k").count().filter("k = 'hot'").first()
    assert out["count"] == 10_000
