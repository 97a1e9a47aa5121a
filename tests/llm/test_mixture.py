from pyspark.sql import functions as F

from loomgraph.llm.operators import mixture
from loomgraph.llm.operators.tokens import encoder

TARGETS = [("A", 0.5, 1), ("b", 0.25, 3), (" c ", 0.15, 2), ("none", 0.1, 5)]


def data():
    docs = [(i, " A" if i % 3 else "a", "word " * (i % 17 + 1)) for i in range(600)]
    docs += [(1000 + i, "B", "two words here " * 3) for i in range(40)]
    docs += [(2000 + i, "c", "x y z") for i in range(300)] + [(3000, "C", None), (3001, "other", "no"), (3002, None, "no"), (3003, "b", "")]
    return docs


def frames(spark):
    return spark.createDataFrame(data(), "doc_id long, source string, text string").withColumn("tokens", F.lit("clash")), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats long")


def test_shares_against_brute_force(spark):
    docs, targets = frames(spark)
    encode = encoder()
    own = {"a": 0, "b": 0, "c": 0, "none": 0}
    for _, s, t in data():
        if s and s.strip().lower() in own:
            own[s.strip().lower()] += len(encode(t)) if t else 0
    total = sum(own.values())
    got = {r.source: r for r in mixture.shares(mixture.measured(docs, targets), targets).collect()}
    for s, share, cap in TARGETS:
        s = s.strip().lower()
        assert got[s].own_tokens == own[s] and got[s].all_tokens == total
        assert got[s].short == (share * total > cap * own[s]) and got[s].budget == int(min(share * total, cap * own[s]))


def test_mix_stays_within_budgets_and_reaches_them(spark):
    docs, targets = frames(spark)
    taken, report = mixture.mix(docs, targets)
    rows, rep = taken.collect(), {r.source: r for r in report.collect()}
    caps = {s.strip().lower(): c for s, _, c in TARGETS}
    assert len({r.doc_id for r in rows}) == len(rows) and all(1 <= r.copies <= caps[r.source] for r in rows)
    for s, r in rep.items():
        assert r.taken_tokens == sum(x.tokens * x.copies for x in rows if x.source == s) <= r.budget
        biggest = max([x.tokens for x in rows if x.source == s], default=0)
        assert r.budget - r.taken_tokens <= biggest  # the next record would not fit
    assert abs(sum(r.taken_share for r in rep.values()) - 1) < 1e-9


def test_thresholds_refine_to_one_record(spark):
    sizes = spark.range(5000).select(F.lit("s").alias("source"), F.lit(7).cast("long").alias("tokens"), mixture.key_hash(F.col("id")).alias("hash"))
    for want in (0, 6, 7, 700, 34_999, 35_000):
        cut = mixture.thresholds(sizes, {"s": want}, bits=3)["s"]
        assert sizes.where(F.col("hash") < cut).count() == want // 7


def test_empty(spark):
    docs, targets = frames(spark)
    taken, report = mixture.mix(docs.where("false"), targets)
    assert taken.count() == 0 and {r.taken_tokens for r in report.collect()} == {0}


def test_p8_found_takes_the_way_of_the_histograms(spark, monkeypatch):
    from loomgraph.llm import plans

    tables = {"documents": spark.createDataFrame([(f"a{i}", "A", "one two three " * 9) for i in range(20)] + [("b0", "b", "one two")], "doc_id string, source string, text string"), "mix_targets": spark.createDataFrame([("a", 0.5, 3), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")}
    monkeypatch.setattr(plans, "table", lambda _, __, name: tables[name])
    asked, real = [], mixture.thresholds
    monkeypatch.setattr(mixture, "thresholds", lambda sizes, wanted, *a: asked.append(wanted) or real(sizes, wanted, *a))
    assert [r.source for r in plans.p8_found(spark, "").collect()] == ["b"] and len(asked) == 1 and set(asked[0]) == {"a", "b"}
