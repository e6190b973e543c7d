from __future__ import annotations

from pyspark.sql import functions as F

from depgraph.operators import ranking
from depgraph.operators.ranking import dense_index, position_in_group, running_total
from tests.conftest import rows


def test_dense_index_is_the_global_rank(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k"))
    ranked = dense_index(df, ["k"], "place").orderBy("k").collect()
    assert [r["place"] for r in ranked] == list(range(5000))


def test_position_in_a_hot_group_spread_over_partitions(spark):
    df = spark.range(0, 9000).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.col("id").cast("string")).alias("g"), "id"
    ).repartition(8)
    placed = position_in_group(df, ["g"], ["id"], "place")
    hot = placed.filter("g = 'hot'").orderBy("id").collect()
    assert [r["place"] for r in hot] == list(range(6000))
    assert placed.filter("g <> 'hot'").agg(F.max("place")).first()[0] == 0


def test_running_total_is_exclusive(spark):
    df = spark.createDataFrame([("a", 3), ("b", 5), ("c", 2)], "k string, n long")
    assert rows(running_total(df, ["k"], "before", F.col("n")), "k", "before") == [("a", 0), ("b", 3), ("c", 8)]


def test_running_max_of_groups_that_span_partitions(spark):
    import random

    draw = random.Random(3)
    data = [("hot" if i % 3 else f"g{i % 5}", i, draw.choice([None, draw.randrange(1000)])) for i in range(600)]
    frame = spark.createDataFrame(data, "g string, i int, v int").repartition(7)
    found = ranking.running_max(frame, ["i"], "most", F.col("v"), ["g"]).collect()
    best: dict = {}
    want = {}
    for g, i, v in sorted(data, key=lambda r: r[1]):
        best[g] = max((x for x in (best.get(g), v) if x is not None), default=None)
        want[i] = best[g]
    assert {r["i"]: r["most"] for r in found} == want
    whole = ranking.running_max(frame, ["i"], "most", F.col("v")).orderBy("i").collect()
    assert [r["most"] for r in whole][-1] == max(v for _, _, v in data if v is not None)
