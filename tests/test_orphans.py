import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import orphans as O

T0 = dt.datetime(2025, 1, 1)


def at(h):
    return T0 + dt.timedelta(hours=h)


def data(seed, n):
    r = random.Random(seed)
    key = lambda: "hot" if r.random() < 0.4 else f"k{r.randrange(30)}"
    nodes, used = [], set()
    for _ in range(n // 4):
        k, h = key(), r.randrange(200)
        if (k, h) not in used:
            used.add((k, h))
            nodes.append((k, at(h), r.random() < 0.4))
    return nodes, [(key(), at(r.randrange(200)), i, "target") for i in range(n)]


def brute(nodes, refs, upto=None):
    out = {}
    for k, t, i, _ in refs:
        seen = [(a, g) for x, a, g in nodes if x == k and a <= (upto or t)]
        out[i] = not seen or max(seen)[1]
    return out


NODE, REF = "key string, at timestamp_ntz, gone boolean", "key string, at timestamp_ntz, rel_id long, side string"


@pytest.mark.parametrize("seed", [1, 2])
def test_probe_over_ranges_of_a_hot_key(spark, seed):
    nodes, refs = data(seed, 600)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = {r.rel_id: r.orphan for r in O.probe(spark.createDataFrame(nodes, NODE), spark.createDataFrame(refs, REF), ["rel_id", "side"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute(nodes, refs)


CUTS = [(-1, 40), (40, 90), (90, 300)]


def span(df, lo, hi):
    return df.where((F.col("at") > F.lit(at(lo))) & (F.col("at") <= F.lit(at(hi))))


def test_batches_give_what_one_batch_gives_after_restarts_and_repeats(spark, tmp_path):
    nodes, refs = data(5, 300)
    n, r = spark.createDataFrame(nodes, NODE), spark.createDataFrame(refs, REF)
    for number, (lo, hi) in enumerate(CUTS):
        store = O.OrphanStore(spark, str(tmp_path / "s"), ["side"], 8)  # a new process each time
        for _ in range(2 if number == 1 else 1):  # a batch run again replaces itself
            store.put(number, span(n, lo, hi), span(r, lo, hi), ["rel_id", "side"])
        store.vacuum()
        seen = [x for x in refs if x[1] <= at(hi)]
        got = {x.rel_id: (x.orphan, x.orphan_now) for x in store.open_now().collect()}
        first, now = brute(nodes, seen), brute(nodes, seen, at(hi))
        assert got == {i: (first[i], now[i]) for i in first}
        s = store.snapshots().where(F.col("batch") == number).first()
        assert (s.refs, s.orphans, s.open_now) == (len(seen), sum(first.values()), sum(now.values()))
        assert s.reopened == sum(now[i] and not first[i] for i in first) and s.resolved == sum(first[i] and not now[i] for i in first)


def test_a_batch_reads_and_writes_only_the_buckets_of_its_keys(spark, tmp_path):
    many = [(f"k{i}", at(1), False) for i in range(400)]
    refs = [(f"k{i}", at(2), i, "source") for i in range(800)]
    store = O.OrphanStore(spark, str(tmp_path / "s"), ["side"], 32)
    store.put(0, spark.createDataFrame(many, NODE), spark.createDataFrame(refs, REF), ["rel_id", "side"])
    store.put(1, spark.createDataFrame([("k1", at(3), True), ("k500", at(3), False)], NODE), spark.createDataFrame([("k1", at(4), 900, "target")], REF), ["rel_id", "side"])
    assert len(list((tmp_path / "s/keys/v=0").glob("bucket=*"))) > 20 and len(list((tmp_path / "s/keys/v=1").glob("bucket=*"))) <= 2
    got = {(x.batch, x.side): x[2:] for x in store.snapshots().collect()}
    assert got == {(0, "source"): (800, 400, 400, 0, 0), (1, "source"): (800, 400, 400, 1, 1), (1, "target"): (1, 1, 1, 0, 0)}
    store.put(2, spark.createDataFrame([], NODE), spark.createDataFrame([], REF), ["rel_id", "side"])
    assert {(x.side, x.refs) for x in store.snapshots().where("batch = 2").collect()} == {("source", 800), ("target", 1)}


def test_a_stream_that_is_ended_and_started_again_goes_on(spark, tmp_path):
    from loomgraph.streaming.ingest import OrphanStream

    nodes, refs = data(7, 120)
    land, check, folder = (str(tmp_path / x) for x in ("land", "check", "state"))
    ddl = "kind string, key string, at timestamp_ntz, gone boolean, rel_id long, side string"
    for lo, hi in CUTS:
        rows = [("parent", k, t, g, None, None) for k, t, g in nodes if at(lo) < t <= at(hi)] + [("reference", k, t, None, i, s) for k, t, i, s in refs if at(lo) < t <= at(hi)]
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(land)
        stream = OrphanStream(spark, folder)
        stream.start(spark.readStream.schema(ddl).parquet(land), check).awaitTermination()
    got = {x.rel_id: (x.orphan, x.orphan_now) for x in stream.store.open_now().collect()}
    first, now = brute(nodes, refs), brute(nodes, refs, at(300))
    assert got == {i: (first[i], now[i]) for i in first} and stream.store.snapshots().count() == 3


def test_empty_nulls_and_clashing_columns(spark):
    n, r = spark.createDataFrame([], NODE), spark.createDataFrame([("k", at(1), 1, "source")], REF)
    assert [x.orphan for x in O.probe(n, r, ["rel_id", "side"]).collect()] == [True]
    assert O.probe(n, r.where("false"), ["rel_id", "side"]).count() == 0
    rel = spark.createDataFrame([(1, "a", None, "r", at(1), "x"), (2, "null", "b", None, at(2), "x"), (3, "a", "ext", "r", None, "x")], "rel_id long, source_id string, target_id string, repo string, loaded_at timestamp_ntz, key string")
    ext = spark.createDataFrame([("ext",), (None,)], "id string")
    assert {(x.key, x.rel_id, x.side) for x in O.ends(rel, ext).collect()} == {("a", 1, "source"), ("b", 2, "target")}
