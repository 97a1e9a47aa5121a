import random

from loomgraph.llm.operators import spam

PROSE = "The release notes say that the worker must not retry before the queue is empty, and that it should wait for the lock. "


def page(i, body):
    return (i, body, f"host{i}.example")


def test_found_and_not(spark):
    stuffed = [page(i, " ".join(["cheap hosting", "seo plugin", "best price"][(i * k) % 3] for k in range(40))) for i in range(1, 6)]
    links = page(10, "\n".join(f"- [Edge log {k}](https://x{k}.example/a/b)" for k in range(20)))
    tags = page(11, "Tags: " + "; ".join(["cheap hosting", "seo plugin", "best price"] * 8))
    fine = [
        page(20, PROSE * 6), page(21, PROSE * 6 + "\ncheap hosting, seo plugin, best price"), page(22, "```\n" + "x = call(1);\n" * 30 + "```"), page(23, "\n".join(f"2025-01-0{k} 10:00:00 INFO Worker start id={k}" for k in range(1, 9))),
        page(24, "\n".join(f"- [Edge log](https://x.example/{k}) - this page says how the lock is taken and when it must be given back" for k in range(9))), page(25, "## 1.2\n\n" + "\n".join("- The parser is now able to read the file that was written by the old tool" for _ in range(9))),
        page(26, "| a | b |\n|---|---|\n" + "| lock | held |\n" * 20), (27, None, "h"), (28, "", "h"), (29, PROSE * 2000, None),
    ]
    df = spark.createDataFrame(stuffed + [links, tags, *fine], "doc_id long, text string, site string").selectExpr("*", "1 AS phrase")
    got = {r.doc_id for r in spam.spam_scores(df).where("flagged").collect()}
    assert got == {1, 2, 3, 4, 5, 10, 11}
    assert spam.spam_scores(df.where("false")).count() == 0


def test_phrases_decide_and_not_density_alone(spark):
    """The same dense list is spam where its phrases stand on three hosts, and none where they are said nowhere else."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(7))
    own = [(i, "; ".join(f"{word()} {word()}" for _ in range(30)), f"h{i}.example") for i in range(4)]
    farm = "; ".join(f"{word()} {word()}" for _ in range(30))
    shared = [(10 + i, farm, f"h{i}.example") for i in range(3)] + [(20 + i, "Tags: " + farm[::-1], "one.example") for i in range(5)]
    links = [(30, "\n".join(f"* [{word()}](https://{word()}.example/{word()})" for _ in range(20)), "h1.example")]
    run = [(40 + i, " ".join(["seo plugin", "code scanner", "php templates"][(k * (i + 1) + k // 7) % 3] for k in range(60)), f"h{i}.example") for i in range(4)]
    df = spark.createDataFrame(own + shared + links + run, "doc_id long, text string, site string")
    flagged = lambda **k: {x.doc_id for x in spam.spam_scores(df, **k).where("flagged").collect()}
    assert flagged() == {10, 11, 12, 40, 41, 42, 43}
    assert flagged(stitched=0.0) == {x[0] for x in own + shared + links + run}


def test_phrases_of_a_segment():
    said = lambda s, linked=False: list(spam.phrases(s, linked))
    assert said("Diff KA9566 Pro - EUR 100.55 - add to cart") == ["diff 0 pro", "eur 0 0", "add to cart"]
    assert said("#diffAddress #lock2025") == ["diff address", "0"] and said("") == []
    assert said("cheap code scanner free react themes") == ["cheap code scanner", "code scanner free", "scanner free react", "free react themes"]
    assert said("- [Edge log](https://X.example/a) more", True) == ["to x.example", "edge log", "more"]
