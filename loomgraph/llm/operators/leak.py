"""Evaluation texts leaking into training text: a generalised suffix automaton over the test items.

The normalised items are put into one automaton (a block of items each where
they exceed ``BLOCK_WORDS``, so that what is broadcast stays bounded whatever
the number of items). Each document's words are streamed through it, tracking
the longest match that ends at each word; where it reaches ``min_words``, the
items are those of the state that stands for the last ``min_words`` words.

Words: runs of letters and digits, in lower case, after HTML tags are taken out
and entities resolved. A null or empty text has no words and no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of items in one automaton: at most twice as many states, each a dictionary, some 400 bytes in a worker.
BLOCK_WORDS = 100_000
#: Automata that meet a document in one scan of the corpus; a worker holds so many.
BLOCKS = 4
MIN_WORDS = 13

_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)


def words(text: str | None) -> list[str]:
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    return _WORD.findall(text.lower())


def word_spans(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Words with their places in the text as it stands: markup is blanked, an entity stands as one place."""
    plain = _TAG.sub(lambda m: " " * len(m.group()), text) if "<" in text else text
    out, at = [], []
    pieces = re.split(r"(&(?:#\d+|#[xX][0-9a-fA-F]+|\w+);)", plain) if "&" in plain else [plain]
    base, grown, marks = 0, [], []
    for p in pieces:
        shown = html.unescape(p) if p.startswith("&") else p
        for i, c in enumerate(shown):
            low = c.lower()
            grown.append(low)
            marks.extend([(base, base + len(p)) if shown is not p and len(shown) != len(p) else (base + i, base + i + 1)] * len(low))
        base += len(p)
    joined = "".join(grown)
    for m in _WORD.finditer(joined):
        out.append(m.group())
        at.append((marks[m.start()][0], marks[m.end() - 1][1]))
    return out, at


class Automaton:
    """Suffix automaton of several word sequences; ``tail[s]`` is the state of the last ``min_words`` words of a match in s."""

    def __init__(self, items: list[tuple[int, list[str]]], min_words: int):
        self.min_words, self.step, self.link, self.length = min_words, [{}], [-1], [0]
        own: list[set[int]] = [set()]
        half = (min_words + 1) // 2
        #: Any match of min_words covers a run of ``half`` words that begins at a multiple of ``half`` - 1 or fewer words in: see scan.
        self.half, self.anchors = half, set()
        for item, seq in items:
            for i in range(len(seq) - half + 1):
                self.anchors.add(" ".join(seq[i : i + half]))
            last = 0
            for w in seq:
                last = self._add(last, w, own)
                own[last].add(item)
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True)
        for s in order:
            own[self.link[s]] |= own[s] if self.length[self.link[s]] >= min_words else set()
        self.tail = [-1] * len(self.link)
        for s in reversed(order):
            up = self.link[s]
            self.tail[s] = -1 if self.length[s] < min_words else s if self.length[up] < min_words else self.tail[up]
        self.items = {s: tuple(sorted(own[s])) for s in set(self.tail) if s >= 0}

    def _add(self, last: int, w: str, own: list[set[int]]) -> int:
        step, link, length = self.step, self.link, self.length
        if w in step[last]:
            q = step[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, w, q, own)
        cur = self._state({}, length[last] + 1, own)
        p = last
        while p != -1 and w not in step[p]:
            step[p][w] = cur
            p = link[p]
        if p == -1:
            link[cur] = 0
        else:
            q = step[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, w, q, own)
        return cur

    def _state(self, edges: dict, length: int, own: list[set[int]]) -> int:
        self.step.append(edges)
        self.link.append(0)
        self.length.append(length)
        own.append(set())
        return len(self.step) - 1

    def _split(self, p: int, w: str, q: int, own: list[set[int]]) -> int:
        step, link = self.step, self.link
        copy = self._state(dict(step[q]), self.length[p] + 1, own)
        link[copy], link[q] = link[q], copy
        while p != -1 and step[p].get(w) == q:
            step[p][w] = copy
            p = link[p]
        return copy

    def may_match(self, seq: list[str]) -> bool:
        """Exact pre-test: a match of n words holds a run of h = (n+1)//2 words that begins at a multiple of n-h+1."""
        h, stride, anchors = self.half, self.min_words - self.half + 1, self.anchors
        return any(" ".join(seq[i : i + h]) in anchors for i in range(0, len(seq) - h + 1, stride))

    def matches(self, seq: list[str]) -> Iterator[tuple[int, int, int]]:
        """(end, length, state of the last min_words words) at each word where the longest match reaches min_words."""
        step, link, length, tail, least = self.step, self.link, self.length, self.tail, self.min_words
        s = n = 0
        for i, w in enumerate(seq):
            to = step[s].get(w)
            while to is None and s:
                s = link[s]
                n = length[s]
                to = step[s].get(w)
            if to is None:
                n = 0
                continue
            s, n = to, n + 1
            if n >= least:
                yield i + 1, n, tail[s]


def spans(automaton: Automaton, seq: list[str]) -> dict[int, list[tuple[int, int]]]:
    """Per item the runs of words of ``seq`` covered by matches, merged where they overlap."""
    out: dict[int, list[tuple[int, int]]] = {}
    least = automaton.min_words
    for end, _, state in automaton.matches(seq):
        for item in automaton.items[state]:
            runs = out.setdefault(item, [])
            if runs and end - least <= runs[-1][1]:
                runs[-1] = (runs[-1][0], end)
            else:
                runs.append((end - least, end))
    return out


def automata(items: DataFrame, min_words: int, block_words: int = BLOCK_WORDS) -> list[Automaton]:
    """Blocks of items; ``items`` (item_id, text) is the held-out set, read to the driver block by block."""
    blocks, block, size = [], [], 0
    for r in items.select("item_id", "text").where("item_id IS NOT NULL").toLocalIterator():
        seq = words(r.text)
        if size + len(seq) > block_words and block:
            blocks.append(Automaton(block, min_words))
            block, size = [], 0
        if len(seq) >= min_words:
            block.append((r.item_id, seq))
            size += len(seq)
    return [*blocks, Automaton(block, min_words)] if block else blocks


def leaked_spans(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(doc_id, item_id, start, end, doc_words)``: runs of words (0-based, end exclusive) shared with an item, each at least min_words long.

    documents: (doc_id, text); rows repeated give repeated results. A document is
    read and cut into words once for ``BLOCKS`` automata.
    """
    spark = documents.sparkSession
    out = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("doc_words", pa.int64())])
    ddl = "doc_id long, item_id long, start long, end long, doc_words long"
    result = None
    sent = [spark.sparkContext.broadcast(a) for a in automata(items, min_words, block_words)]
    for at in range(0, len(sent), BLOCKS):

        def run(batches: Iterator[pa.RecordBatch], sent=sent[at : at + BLOCKS]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    seq = words(text)
                    if len(seq) >= min_words:
                        for a in (x.value for x in sent):
                            if a.may_match(seq):
                                rows.extend((doc, item, s, e, len(seq)) for item, runs in spans(a, seq).items() for s, e in runs)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * 5, out)], schema=out)

        part = documents.select(F.col("doc_id").cast("long"), "text").where("text IS NOT NULL").mapInArrow(run, ddl)
        result = part if result is None else result.unionByName(part)
    return result if result is not None else spark.createDataFrame([], ddl)


def without_leaks(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, max_words: int = 13, max_coverage: float = 0.5) -> DataFrame:
    """``(doc_id, removed_words, dropped, text)`` of the documents that leak.

    Spans of at least ``max_words`` words are cut out of the text (from the
    first letter to the last, the markup between them included); a document of
    which they cover more than ``max_coverage`` is dropped whole (null text).
    """
    found = leaked_spans(documents, items, min_words).where(F.col("end") - F.col("start") >= max_words)
    by_doc = found.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("runs"))
    keep = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL").join(by_doc, "doc_id")
    out = pa.schema([("doc_id", pa.int64()), ("removed_words", pa.int64()), ("dropped", pa.bool_()), ("text", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text, runs in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("runs").to_pylist()):
                seq, at = word_spans(text)
                left, done, removed, kept = 0, 0, 0, []
                for r in runs:
                    s, e = max(r["start"], done), min(r["end"], len(seq))
                    if e <= s:
                        continue
                    kept.append(text[left : at[s][0]])
                    left, done, removed = at[e - 1][1], e, removed + e - s
                kept.append(text[left:])
                drop = removed > max_coverage * max(len(seq), 1)
                rows.append((doc, removed, drop, None if drop else "".join(kept)))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * 4, out)], schema=out)

    return keep.mapInArrow(cut, "doc_id long, removed_words long, dropped boolean, text string")
