from pyspark.sql import functions as F

from lexispark.llm import packing
from lexispark.llm.components import _large_star, components


def test_components_around_hubs(spark):
    """Two stars of thousands of links that meet in one node, a chain, and nodes whose hub is their largest neighbour."""
    star = [(10, i) for i in range(1000, 4000)] + [(20, i) for i in range(5000, 8000)] + [(3999, 5000)]
    down = [(9999, i) for i in range(8000, 9998)]
    chain = [(i, i + 1) for i in range(20000, 20040)]
    links = spark.createDataFrame(star + down + chain + chain + [(7, 7)], "u LONG, v LONG").repartition(5)
    got = {r.node: r.component for r in components(links).collect()}
    want = {10: 10, 20: 10, **{i: 10 for i in range(1000, 4000)}, **{i: 10 for i in range(5000, 8000)}}
    want |= {9999: 8000, **{i: 8000 for i in range(8000, 9998)}, **{i: 20000 for i in range(20000, 20041)}}
    assert got == want


def test_hub_rows_are_joined_by_broadcast(spark):
    links = spark.createDataFrame([(i, 1) for i in range(2, 3000)] + [(5000, 4999)], "u LONG, v LONG")
    plan = _large_star(links, 2999)
    assert "BroadcastHashJoin" in plan._jdf.queryExecution().executedPlan().toString()
    assert {(r.u, r.v) for r in plan.collect()} == {(i, 1) for i in range(2, 3000)} | {(5000, 4999)}


def test_pieces_without_an_id_are_spread_over_shards(spark):
    rows = spark.range(64).select(
        F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"),
        F.lit(2048).cast("long").alias("length"), F.lit(9).cast("long").alias("ids_crc32"),
    )
    got = [r.sequence_id for r in packing.pack(rows, 2048, shard_pieces=8).collect()]
    assert len(set(got)) == 64 and len({s >> 24 for s in got}) > 4
