from loomgraph.llm.operators import invalid


def test_rows_and_rates(spark):
    rows = [("a", "r", "A.java", "class A {}"), ("b", "r", "B.java", "class B {"), ("b", "r", "B.java", "class B {"), ("c", "r", "c.py", "x = 1"), ("d", None, "d.txt", "?"), ("e", "r", None, "x"), ("f", "r", "f.py", None), ("g", "r", "g.kt", "")]
    df = spark.createDataFrame(rows, "id string, repo string, path string, code string").selectExpr("*", "1 AS errors")
    got = {r.id: len(r.errors) for r in invalid.parsed(df).collect()}
    assert got == {"a": 0, "b": 1, "c": 0, "g": 0}
    assert {(r.language, r.files, r.broken, r.rate) for r in invalid.rates(df).collect()} == {("java", 2, 1, 0.5), ("python", 1, 0, 0.0), ("kotlin", 1, 0, 0.0)}
    assert invalid.parsed(df.where("false")).count() == 0
