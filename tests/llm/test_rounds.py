"""What a round of components costs, in exchanges and in rows of one node."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tabwise.llm import common


def _groups(links):
    up = {n: n for pair in links for n in pair}

    def first(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = sorted((first(a), first(b)))
        up[b] = a
    return {n: first(n) for n in up}


def test_a_round_is_three_exchanges(spark):
    """Each exchange is a task for every shuffle partition, which takes time, and memory of the driver."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)], "lo long, hi long")
    small = common._star(common._star(edges, larger=True), larger=False)
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3


def test_rows_of_a_hub_are_one_a_block(spark):
    links = [(5000, i) for i in range(3000)] + [(i, 5000) for i in range(6000, 7000)]
    random.Random(3).shuffle(links)
    edges = spark.sparkContext.parallelize(links, 4).toDF("a long, b long")
    got = [tuple(r) for r in common.contracted(edges).collect()]
    assert max(Counter(hi for _, hi in got).values()) <= 4
    assert _groups(got) == _groups(links)


def test_blocks_end_inside_a_task(spark):
    rng = random.Random(4)
    links = [(rng.randrange(900), rng.randrange(900)) for _ in range(700)] + [(7, 7), (2000, 2000)]
    edges = spark.createDataFrame(links, "a long, b long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = [tuple(r) for r in common.contracted(edges.unionByName(spark.createDataFrame([(None, 3)], "a long, b long")).coalesce(1), block=40).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert all(lo < hi for lo, hi in got)
    assert _groups(got) == _groups([(a, b) for a, b in links if a != b])


def test_hubs_of_any_number(spark):
    """The largest node as a hub, hubs that share leaves, a chain in any order."""
    chain = list(range(20000, 20200))
    random.Random(5).shuffle(chain)
    links = [(9999, i) for i in range(500)] + [(h, 10000 + i) for h in (700, 600, 800) for i in range(300)] + list(zip(chain, chain[1:], strict=False))
    edges = spark.createDataFrame(links, "a long, b long").repartition(16, F.rand(1))
    got = common.components(spark, edges, common.Saved(spark)).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.component for r in got} == _groups(links)
