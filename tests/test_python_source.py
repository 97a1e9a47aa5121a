from loomgraph.sources import python_source


def test_facts(spark):
    code = "import os\nfrom a.b import C as D\n\n@deco(1)\nclass K(D):\n    def m(self):\n        self.n(); f(); os.getcwd()\n    async def n(self): pass\n\ndef f():\n    return K()\n"
    df = spark.createDataFrame([("r", "p/x.py", code), ("r", "bad.py", "def ("), ("r", "n.py", None), ("r", "x.js", "f()")], "repo string, path string, code string")
    g = python_source.read(df)
    assert {(r.label, r.qn) for r in g.nodes.collect()} == {("File", "p/x.py"), ("File", "bad.py"), ("Module", "p.x"), ("Class", "p.x.K"), ("Method", "p.x.K.m"), ("Method", "p.x.K.n"), ("Function", "p.x.f"), ("Module", "os"), ("Module", "a.b.C"), ("Decorator", "deco")}
    e = {(r.src, r.type, r.dst, r.confidence) for r in g.edges.where("type IN ('CALLS', 'EXTENDS', 'DECORATES', 'CONTAINS')").collect()}
    assert ("method:r:p.x.K.m", "CALLS", "method:r:p.x.K.n", 0.95) in e and ("method:r:p.x.K.m", "CALLS", "module:r:os", 0.9) in e and ("function:r:p.x.f", "CALLS", "class:r:p.x.K", 0.95) in e
    assert ("class:r:p.x.K", "EXTENDS", "module:r:a.b.C", None) in e and ("decorator:r:deco", "DECORATES", "class:r:p.x.K", None) in e and ("module:r:p.x", "CONTAINS", "class:r:p.x.K", None) in e
    assert python_source.read(df.where("false")).nodes.count() == 0


def test_equal_paths_of_two_repositories_are_two_nodes(spark):
    df = spark.createDataFrame([("r", "p/x.py", "def f(): pass"), ("s", "p/x.py", "def f(): pass"), (None, "p/x.py", "def f(): pass")], "repo string, path string, code string")
    assert {r.id for r in python_source.read(df).nodes.where("label = 'Function'").collect()} == {"function:r:p.x.f", "function:s:p.x.f", "function:p.x.f"}
