"""Terms in the same post, against pairs."""

import random

import __spark_entry__
from pyspark.sql import functions as F

from tidewire.operators import cooccurrence, text


def test_term_reach_is_the_sum_of_links(spark):
    rng = random.Random(3)
    rows = [(p, f"{'wö'[rng.random() < 0.3]}{k}") for p in range(80) for k in {int(rng.paretovariate(0.5)) % 400 for _ in range(rng.choice((1, 5, 60)))}]
    terms = spark.createDataFrame([*rows, (None, "w1"), (None, "w2")], "post_id long, term string")
    links = text.term_links(terms).groupBy("a").agg(F.count(F.lit(1)).alias("links"), F.sum("weight").alias("weight"), F.max("weight").alias("strongest"))
    want = sorted(map(tuple, links.collect()))
    for blocks in (1, 7):
        assert want and sorted(map(tuple, cooccurrence.term_reach(terms, blocks=blocks).collect())) == want
    assert not cooccurrence.term_reach(terms, least=1000).collect()


def test_the_query_joins_no_posts_to_themselves(spark):
    plan = __spark_entry__.queries()["N11_D16_term_links"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "weight" in plan
