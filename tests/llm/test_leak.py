import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.llm.operators import leak


def brute(items, seq, n):
    out = {}
    for i, w in items:
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        hits = [k for k in range(len(seq) - n + 1) if tuple(seq[k : k + n]) in grams]
        if hits:
            runs = []
            for k in hits:
                if runs and k <= runs[-1][1]:
                    runs[-1] = (runs[-1][0], k + n)
                else:
                    runs.append((k, k + n))
            out[i] = runs
    return out


words = st.lists(st.sampled_from("abc"), max_size=25)


@settings(max_examples=300, deadline=None)
@given(st.lists(words, min_size=1, max_size=5), words, st.integers(2, 6))
def test_automaton_is_brute_force(items, seq, n):
    items = list(enumerate(items))
    a = leak.Automaton(items, n)
    got = leak.spans(a, seq)
    assert got == brute(items, seq, n)
    assert a.may_match(seq) or not got


def test_markup_between_words_does_not_count():
    text = "The <b class='x'>quick</b>&nbsp;**brown**_fox_ — jumps\n> over\tthe `LAZY` dog&#33; É 12"
    assert leak.words(text) == "the quick brown fox jumps over the lazy dog é 12".split()
    seq, at = leak.word_spans(text)
    assert seq == leak.words(text) and text[at[1][0] : at[1][1]] == "quick" and text[at[7][0] : at[7][1]] == "LAZY"
    assert leak.words(None) == leak.words("") == [] and leak.words("a < b & c") == ["a", "b", "c"]


def test_spans_and_removal(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    docs = [(1, f"before <i>{passage.upper()}</i> after more words stand here to keep it whole one two three four five six seven"), (2, passage), (3, None), (4, ""), (5, " ".join(passage.split()[:12])), (6, "x " * 50_000 + passage), (1, passage)]
    items = [(7, "start " + passage), (8, None), (9, "short")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1))
    e = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.end - r.start) for r in leak.leaked_spans(d, e).collect()}
    assert got == {(1, 7, 20), (2, 7, 20), (6, 7, 20)}
    clean = {(r.doc_id, r.dropped): r for r in leak.without_leaks(d.where("doc_id <> 1"), e).collect()}
    assert clean[2, True].text is None and clean[6, False].text.strip().endswith("x")
    one = leak.without_leaks(d.where("doc_id = 1").limit(1), e, max_coverage=0.9).first()
    assert one.text.startswith("before <i></i> after") and one.removed_words == 20
    assert leak.leaked_spans(d, e.where("false")).count() == 0 and leak.leaked_spans(d.where("false"), e).count() == 0


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    r = random.Random(1)
    items = [(i, " ".join(r.choice("abcdefgh") for _ in range(40))) for i in range(12)]
    docs = [(i, " ".join(r.choice("abcdefgh") for _ in range(30)) + " " + r.choice(items)[1][10:60]) for i in range(40)]
    d, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, leak.leaked_spans(d, e).collect()))
    monkeypatch.setattr(leak, "BLOCK_WORDS", 90)
    assert sorted(map(tuple, leak.leaked_spans(d, e).collect())) == whole and whole


def test_blocks_of_items_find_what_one_automaton_finds(spark):
    r = random.Random(8)
    w = lambda n: [r.choice("abcdefghijklmnopqrstuvwxyz") * r.randrange(1, 4) for _ in range(n)]
    items = [(i, " ".join(w(40))) for i in range(12)]
    docs = [(i, " ".join(w(30) + items[i % 12][1].split()[5 : 5 + i] + w(30))) for i in range(36)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = sorted(leak.leaked_spans(d, i).collect())
    assert one and sorted(leak.leaked_spans(d, i, block_words=50).collect()) == one
