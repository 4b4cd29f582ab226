"""N-grams and their lift, against plain counting."""

import random
from collections import defaultdict

import __spark_entry__
from pyspark.sql import functions as F

from tidewire.operators import text

SF = "/root/testdata/sf0.001"


def _posts(spark):
    rng = random.Random(7)
    words = [f"{a}{b}{c}" for a in "bdf" for b in "xyz" for c in "klm"]
    bodies = [" ".join(rng.choice(words) for _ in range(rng.choice((1, 2, 3, 12)))) for _ in range(40)]
    return [(p, p % 9, rng.choice(bodies)) for p in range(200)]


def test_ngrams_and_lift_count_posts_and_texts(spark):
    rows = _posts(spark)
    docs = spark.createDataFrame(rows, "post_id long, actor_id long, body string").withColumn("toks", F.split("body", " "))
    seen = defaultdict(list)
    for _, actor, body in rows:
        t = body.split()
        for n in (1, 2, 3):
            for g in {" ".join(t[i : i + n]) for i in range(len(t) - n + 1)}:
                seen[n, g].append((actor % 2, body))
    want = {(n, g, len(x), len({b for _, b in x})) for (n, g), x in seen.items() if len(x) >= 4 and len({b for _, b in x}) >= 2}
    grams = text.ngrams(docs, 3, least_posts=4, least_texts=2)
    assert {tuple(r) for r in grams.collect()} == want and {w[0] for w in want} == {1, 2}
    part = spark.createDataFrame([(a, a % 2) for a in range(9)], "actor_id long, community_id long")
    got = {(r.community_id, r.term, r.posts, r.texts) for r in text.lift(docs, part, grams, least_posts=3, least_lift=0).collect()}
    kept = {w[:2] for w in want}
    assert got == {(c, g, len(y), len(set(y))) for (n, g), x in seen.items() if (n, g) in kept for c in (0, 1) if len(y := [b for k, b in x if k == c]) >= 3}


def test_texts_are_cut_into_words_once(spark):
    for name in ("N4_N5_lift", "N6_N7_N8_subtopics", "N9_N10_labels"):
        plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_extract_all" not in plan, name
