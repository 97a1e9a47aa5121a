import random

import numpy as np
import pytest

from loomgraph.llm.operators import clusters as C
from loomgraph.llm.operators import handwritten as H


def hand(r, n=10):
    w = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    forms = ["int {} = {}.{}({});", "if ({} > 3) {{ {}.run({}); }}", "for (var {} : {}) {{ log({}, 1); }}", 'String {} = "{}" + {};', "return {};", "try {{ {}.go(); }} catch (E e) {{ throw {}; }}"]
    body = "\n".join(r.sample(forms, 6)[k % 6].format(w(), w(), w(), w()) for k in range(n))
    return f"package {w()};\nclass {w()} {{ void {w()}() {{\n{body}\n}} }}"


def generated(r, n):
    w = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    return f"class {w()} {{\n" + "\n".join(f"  Object get{x}() {{ return {x}_; }}\n  void set{x}(Object v) {{ {x}_ = v; }}" for x in (w() for _ in range(n))) + "\n}"


def test_kinds(spark):
    r = random.Random(5)
    rows = [(f"h{i}", f"r{i % 4}", f"src/h{i}.java", hand(r)) for i in range(30)]
    rows += [(f"g{i}", "r1", f"src/g{i}.java", generated(r, 20 + i)) for i in range(4)]
    lib = hand(r, 12)
    rows += [("v1", "r1", "vendor/libx/A.java", lib), ("v2", "r2", "src/own/B.java", "/*\n * libx v1.2.3 - MIT licence\n */\n" + lib), ("v3", "r3", "x/C.java", lib.replace("> 3", "> 4", 1)), ("v4", "r4", "y/D.java", "/*\n * Licensed under X\n * liby 3.1.0\n */\n" + hand(r))]
    rows += [("b1", "r1", "data/T.java", "class T { int[] X = {\n" + "\n".join(", ".join(str(r.randrange(999)) for _ in range(12)) + "," for _ in range(30)) + "\n}; }")]
    rows += [("m1", "r2", "app.js", "".join(f"function {c}(a,b){{return a?b.{c}(a):void 0}}" for c in "abcdefghijklmnopqrstuvwxyz"))]
    rows += [("n1", "r1", "x.java", None), ("n2", "r1", "y.java", ""), (None, "r1", "z.java", lib), ("h0", "r0", "src/h0.java", rows[0][3])]
    rows += [("d1", "r1", "src/d.java", "// Was auto-generated once, rewritten by hand since.\n" + hand(r)), ("d2", "r1", "src/vendors/d.java", "// Writes the DO NOT EDIT banner into stubs.\n" + hand(r)), ("p1", "r1", "p.java", "A sentence stands here and nothing else. " * 40)]
    df = spark.createDataFrame(rows, "id string, repo string, path string, code string").selectExpr("*", "1 AS family")
    got = {x.id: x for x in H.classify(df).collect()}
    assert {k for k, v in got.items() if v.generated and not v.minified} == {f"g{i}" for i in range(4)}
    assert {k for k, v in got.items() if v.vendored} == {"v1", "v2", "v3", "v4"}
    assert {k for k, v in got.items() if v.blob} == {"b1"} and got["m1"].minified
    assert len(got) == 30 + 4 + 4 + 1 + 1 + 3 and got["v1"].copies_in_repos >= 3
    assert H.classify(df.where("false")).count() == 0


def frame(spark, sets):
    rows = [(i, len(s), s, H.sketch(np.array(s, np.uint64)), H.bands(np.array(s, np.uint64), H.STRUCTURE)) for i, s in enumerate(sets)]
    return spark.createDataFrame(rows, "cls long, size int, set array<int>, sketch array<long>, bands array<long>")


def brute(sets):
    m = np.zeros((len(sets), len({x for s in sets for x in s})), np.float32)
    place = {x: k for k, x in enumerate(sorted({x for s in sets for x in s}))}
    for i, s in enumerate(sets):
        m[i, [place[x] for x in s]] = 1
    both, n = m @ m.T, m.sum(axis=1)
    return {(int(i), int(j)) for i, j in zip(*np.nonzero(both >= 0.8 * (n[:, None] + n[None, :] - both))) if i < j}


def closure(n, pairs):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    return {x: top(x) for p in pairs for x in p}


@pytest.mark.parametrize("n, buckets", [(120, (3, 48, 10**9)), (1000, (48, 10**9))])
def test_links_and_clusters_are_brute_force_at_every_bucket_size(spark, n, buckets):
    """A family that drifts, so that its first class is like few of its members, and sets that are like none."""
    r = random.Random(n)
    base = r.sample(range(10**6), 60)
    sets = []
    for k in range(n):
        if k % 10 == 0:
            base[r.randrange(60)] = r.randrange(10**6, 2 * 10**6)
        sets.append(sorted({*base[r.randrange(4) :], *r.sample(range(10**6), r.randrange(4))}))
    sets += [sorted(r.sample(range(3 * 10**6, 4 * 10**6), 60)) for _ in range(20)]
    want = brute(sets)
    df = frame(spark, sets).cache()
    for bucket in buckets:
        got = [tuple(x) for x in C.links(df, 0.8, H.SKETCH, bucket).collect()]
        assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.998 * len(want), bucket
        assert {x.cls: x.cluster for x in C.clusters(df, 0.8, H.SKETCH, bucket).collect()} == closure(len(sets), want), bucket


def test_components_of_long_chains_stars_and_nothing(spark):
    r = random.Random(1)
    pairs = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(2000, 2000), (3001, 3000), (3000, 3001)] + [(4000 + r.randrange(60), 4000 + r.randrange(60)) for _ in range(50)]
    got = {x.cls: x.cluster for x in C.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == closure(5000, [(a, b) for a, b in pairs if a != b])
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sketches_bound_what_sets_do_not_share_and_minima_meet_as_often_as_sets_are_alike():
    r = np.random.RandomState(4)
    met = []
    for n in (1, 3, 40, 300, 3000):
        for share in (0.0, 0.5, 0.9):
            u = r.randint(0, 1 << 32, 2 * n, dtype=np.uint64)
            a, b = u[:n], u[n - int(share * n) : 2 * n - int(share * n)]
            apart = len(np.setxor1d(a, b))
            assert sum(((x ^ y) & 0xFFFFFFFFFFFFFFFF).bit_count() for x, y in zip(H.sketch(a), H.sketch(b))) <= apart
            if n >= 40:
                met.append((np.mean(H.minima(a, 320) == H.minima(b, 320)), 1 - apart / len(np.union1d(a, b))))
    assert all(abs(x - y) < 0.12 for x, y in met)


def test_large_buckets_give_what_small_ones_give(spark):
    r = random.Random(9)
    names = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(60)]
    line = lambda w: f"int {w} = 5;"
    lines = [line(w) for w in names]
    rows = []
    # near copies within r1 and one in r2, most of them unlike the outer ones: links between members count
    for k in range(12):
        own = [line(names[(k * 7 + j) % 60] + "x") for j in range(k % 4)]
        rows.append((f"c{k}", "r2" if k == 5 else "r1", f"src/c{k}.java", "class K {\n" + "\n".join(own + lines[len(own) :]) + "\n}"))
    # generated texts whose families are counted
    rows += [(f"g{i}", f"r{i % 3}", f"src/g{i}.java", generated(r, 20 + i)) for i in range(8)]
    df = spark.createDataFrame(rows, "id string, repo string, path string, code string")
    wide = {tuple(x) for x in H.classify(df, bucket=48).collect()}
    assert {tuple(x) for x in H.classify(df, bucket=3).collect()} == wide
    texts = {k: np.unique(H.shingles(np.array([H._Codes()[t] >> 32 for t in H.tokens(c, p)], np.uint64))) for k, _, p, c in rows if k[0] == "c"}
    alike = lambda a, b: len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
    at = list(texts)
    up = closure(len(at), [(i, j) for i in range(len(at)) for j in range(i) if alike(texts[at[i]], texts[at[j]])])
    repo = {k: q for k, q, _, _ in rows}
    want = {k: len({repo[j] for n, j in enumerate(at) if up.get(n, n) == up.get(m, m)}) for m, k in enumerate(at)}
    got = {x[0]: x[6] for x in wide}
    assert {k: got[k] for k in want} == want and max(want.values()) == 2


def test_headers_stand_anywhere_in_the_comments_and_mentions_do_not_count():
    bsd = "/*\n" + " * Redistribution and use in source and binary forms, with or without change, are permitted.\n" * 30 + " */\n"
    body = "package a.b;\nimport c.d;\nclass X { int f() { return 1; } }\n"
    banner = "// Code generated by tool. DO NOT EDIT.\n"
    lib = "/*!\n * libz v2.3.1\n * Released under the MIT license\n */\n"
    at = lambda code, path="X.java": (H.generator_banner(H.comments(code, path)), H.header_library(H.comments(code, path)))
    assert at(bsd + banner + body)[0] and at("package a.b;\nimport c.d;\n" + bsd + "// Generated by tool on 2024-01-01\nclass X {}")[0] and at(body * 80 + banner)[0]
    assert at(bsd + lib + body)[1] == at(body * 80 + lib + body, "a.js")[1] == ("libz", True)
    assert at("#!/bin/x\n" + "# licence text\n" * 20 + "# Generated by tool on 2024-01-01\nx = 1\n", "a.py")[0]
    # within strings, behind code, of a part of the file only, or names of licences and languages
    assert not at(body + 'String s = `\n' + banner + '`;\n', "a.js")[0] and not at(body + "// generated by the build on 2024-01-01\nclass Y {}\n")[0]
    assert not at("class X {\n  // Code generated by tool. DO NOT EDIT.\n}\n")[0]
    assert at("/*\n * GNU licence\n * version 3.0\n * Python 3.11\n */\n" + body)[1] == (None, False)
    assert at(body + "// libz 2.3\nclass Y {}\n")[1] == (None, False)


def test_small_copies_and_blobs_of_one_literal(spark):
    small = "package q;\nclass Wq { int go() { return 42; } }\n"
    rows = [("s1", "r1", "a/Wq.java", small), ("s2", "r2", "b/Wq.java", "// own\n" + small), ("o1", "r3", "c/V.java", small.replace("42", "43"))]
    rows += [(f"e{i}", f"r{i}", f"e{i}.{x}", c) for i, (x, c) in enumerate([("js", "\n"), ("js", "// a note\n"), ("php", "<?php\n"), ("php", "<?php\n// x\n")])]
    rows += [("b1", "r1", "data.ts", 'export const DATA = "' + "Qx7" * 30_000 + '";\n'), ("d1", "r1", "doc.py", '"""' + "What this package is for. " * 20 + '"""\n'), ("c1", "r1", "v.py", '__version__ = "1.2.3"\n')]
    got = {x.id: x for x in H.classify(spark.createDataFrame(rows, "id string, repo string, path string, code string")).collect()}
    assert {k for k, v in got.items() if v.copies_in_repos == 2} == {k for k, v in got.items() if v.vendored} == {"s1", "s2"}
    assert {k for k, v in got.items() if v.blob} == {"b1"} and len(got) == len(rows)
