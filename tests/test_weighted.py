import random
from collections import Counter

from pyspark.sql import functions as F

from loomgraph.operators import weighted as V


def test_distinct_mode_mean_percentiles_of_a_hot_key(spark):
    r = random.Random(3)
    rows = [("hot" if r.random() < 0.6 else r.choice(["a", "b", None]), r.choice([None, *range(30)]), r.choice([None, 0.5, 1.0])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "key string, value long, m double").withColumn("rows", F.lit(1))
    w = V.compress(df, F.col("key"), F.col("value"), F.col("m"))
    got = {x.key: x for x in V.per_key(w).collect()}
    pc = {(x.key, x.share): x.value for x in V.percentiles(w, [0.0, 0.5, 0.9, 1.0]).collect()}
    for k in {x[0] for x in rows}:
        own = [x for x in rows if x[0] == k]
        vals = sorted(x[1] for x in own if x[1] is not None)
        ms = [x[2] for x in own if x[2] is not None]
        top = sorted(Counter(vals).items(), key=lambda x: (-x[1], x[0]))[0]
        assert (got[k].rows, got[k].distinct_values, got[k].top_value, got[k].top_rows) == (len(own), len(set(vals)), *top)
        assert abs(got[k].mean - sum(ms) / len(ms)) < 1e-9
        for s in (0.0, 0.5, 0.9, 1.0):
            assert pc[k, s] == vals[max(1, -(-int(s * 1000) * len(vals) // 1000)) - 1]


def test_only_nulls_and_empty(spark):
    df = spark.createDataFrame([("a", None), ("a", None)], "k string, v string")
    w = V.compress(df, F.col("k"), F.col("v"))
    assert [tuple(r) for r in V.per_key(w).collect()] == [("a", 2, 0, None, None, None)]
    assert V.percentiles(w, [0.5]).count() == 0
    assert V.per_key(w.where("false")).count() == 0
