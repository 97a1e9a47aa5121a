"""Keyword-stuffed and link-list pages: phrases replicated on other hosts, joined with list density.

Every page is cut into segments (lines, list items, sentences). A segment is
link or list matter if it is no sentence: few function words of the four
languages, or a link with next to nothing said about it; code, logs, tables and
headings are neither. All phrases of that matter, on all pages, are exploded: an
item between two separators (a tag, a cell of a product line, a link's text or
the host it leads to), and every run of three words where no separator stands.
Numbers are masked. Each phrase is counted by distinct hosts.

A page is flagged if both hold: more than half of its text is list or link
matter (density), and that matter is stitched from phrases that stand on
``MIN_HOSTS`` hosts or come back on the page itself. A list of things that are
said nowhere else is no spam, however dense.

Phrases have three words, not five: keyword lists shuffle their keywords, so that
no run of five words comes back.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import materialize

MIN_HOSTS = 3
#: Occurrences of a phrase in one page that count as repetition.
REPEATS = 3
#: Share of a page's phrases that must be replicated or repeated, and of its text that must be list or link matter.
STITCHED, DENSE = 0.4, 0.5
#: Words up to which a stretch between separators is one phrase, and of a phrase in a longer one.
ITEM, RUN = 4, 3

#: Function words of English, German, Spanish and French.
FUNCTION_WORDS = frozenset(
    """
the a an is are was were be been must can cannot may will would should has have had does do did not no and or but nor
because when while once if so then than that which who whose what why how with without within into onto from of to in on at
by as it its their our we you they he she this these those there before after until only between under through let please
der die das den dem des ein eine einen einem einer eines ist sind war waren wird werden muss müssen kann können soll hat haben
nicht kein keine und oder aber weil wenn während bis nachdem bevor damit dass mit ohne von zu zum zur im an auf bei als es wir
sie ihr ihre sich wer was warum erst nur
el la los las un una unos unas son está están ser era fue hay tiene tienen puede debe que y o pero porque si cuando mientras
para por con sin de del al en su sus se lo nos ya antes después hasta aunque sobre como
le les une du et ou mais est sont était être ont peut doit qui quand pour par avec sans dans sur ne pas il elle nous vous ils
ce cette ces au aux avant après faut
""".split()
)

_FENCE = re.compile(r"\s*(?:```|~~~)")
_LOG = re.compile(r"\W{0,2}(?:\d{4}-\d\d-\d\d[T ])?\d\d:\d\d(?::\d\d)?\b")
_BLOCK = re.compile(r"</?(?:li|p|div|tr|td|h\d|dd|dt|ul|ol)\b[^>]*>|<br\s*/?>", re.I)
_LINK = re.compile(r"<a\b[^>]*>(?P<a>.*?)</a>|!?\[(?P<m>[^\]\n]*)\]\([^)\s]*\)|<?(?:\bhttps?://|\bwww\.)[^\s<>\")\]]+>?", re.I | re.S)
_TAG = re.compile(r"<[^<>]*>")
_WORD = re.compile(r"[^\W_]+")
_HEAD = re.compile(r"#{1,6}\s")
_CODE = re.compile(r"[;{}]\s*$|^\s{4,}\S|^\s*(?://|/\*|\*/|\*\s|<\?php|@\w+)|^\s*(?:import|from|package|use|def|class|return|public|private|const|let|var|val|fun|function|if|for|else|try|catch)\b.*[;:{(.=]|\w\(.*\)\s*$|\s=\s")
_ATOM = re.compile(r"[|,;•·>/»«#\t()\[\]\"`*=]+|\s[-–—]+\s|[.!?:]+(?:\s|$)")
_HOST = re.compile(r"(?:https?://|\bwww\.)([^\s/<>\")\]]+)", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def segments(text: str) -> Iterator[tuple[str | None, str]]:
    """(kind or None, segment): lines, cut at block tags; fenced lines are code, dated lines a log."""
    fenced = False
    for line in text.split("\n"):
        if not line or line.isspace():
            continue
        if _FENCE.match(line):
            fenced = not fenced
            yield "code", line
        elif fenced:
            yield "code", line
        elif _LOG.match(line):
            yield "log", line
        elif "<" in line:
            yield from ((None, p) for p in _BLOCK.split(line) if p and not p.isspace())
        else:
            yield None, line


def _itemised(segment: str) -> bool:
    """Three short items or more between separators: one function word in it ("in stock") makes no sentence."""
    sizes = [len(_WORD.findall(x)) for x in _ATOM.split(segment)]
    return max(sizes) <= ITEM and sum(map(bool, sizes)) >= 3


def kind(segment: str) -> str:
    if "://" in segment or "](" in segment or "<a" in segment or "www." in segment:
        bare, links = _LINK.subn(" ", segment)
        if links:
            said = _WORD.findall(_TAG.sub(" ", bare).lower())
            told = sum(w in FUNCTION_WORDS for w in said)
            return "link" if len(said) <= 4 * links and not (told >= 2 and len(said) >= 5 * links) else "prose"
    words = _WORD.findall(segment.lower())
    if not words:
        return "mark"
    told = sum(map(FUNCTION_WORDS.__contains__, words))
    if len(words) >= 4 and told >= 0.12 * len(words) and not (told == 1 and _itemised(segment)):
        return "prose"
    s = segment.strip()
    if _HEAD.match(s):
        return "head"
    if s.startswith("|") and s.endswith("|") and s.count("|") > 2:
        return "table"
    return "code" if _CODE.search(segment) else "list"


def _words(text: str) -> list[str]:
    return ["0" if any(c.isdigit() for c in w) else w for w in _WORD.findall(_CAMEL.sub(" ", text).lower())]


def phrases(segment: str, linked: bool) -> Iterator[str]:
    """Phrases of list or link matter: items between separators, runs of three words of longer stretches, texts and hosts of links."""
    if linked:
        for m in _LINK.finditer(segment):
            host = _HOST.search(m.group())
            if host:
                yield "to " + host.group(1).lower()
            said = " ".join(_words(_TAG.sub(" ", m.group("a") or m.group("m") or "")))
            if said:
                yield said
        segment = _LINK.sub("|", segment)
    for atom in _ATOM.split(_TAG.sub(" ", segment)):
        w = _words(atom)
        if len(w) > ITEM:
            yield from (" ".join(w[i : i + RUN]) for i in range(len(w) - RUN + 1))
        elif w:
            yield " ".join(w)


_OUT = pa.schema([("doc_id", pa.int64()), ("chars", pa.int64()), ("link_chars", pa.int64()), ("list_chars", pa.int64()), ("phrase", pa.int64()), ("n", pa.int32()), ("host", pa.int64())])
_DDL = "doc_id long, chars long, link_chars long, list_chars long, phrase long, n int, host long"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a page with its characters by kind (phrase null), one a page and phrase with the times it stands there."""
    from xxhash import xxh64_intdigest as hashed

    sign = 1 << 63
    for b in batches:
        rows = []
        for doc, text, site in zip(*(b.column(i).to_pylist() for i in range(3))):
            if not text:
                continue
            chars: Counter = Counter()
            said: Counter = Counter()
            for k, s in segments(text):
                k = k or kind(s)
                chars[k] += len(s)
                if k in ("list", "link"):
                    said.update(phrases(s, k == "link"))
            host = hashed(site.strip().lower()) - sign if site and site.strip() else None
            rows.append((doc, sum(chars.values()), chars["link"], chars["list"], None, None, None))
            rows.extend((doc, None, None, None, hashed(p) - sign, n, host) for p, n in said.items())
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * len(_OUT), _OUT)], schema=_OUT)


def spam_scores(documents: DataFrame, min_hosts: int = MIN_HOSTS, stitched: float = STITCHED) -> DataFrame:
    """``(doc_id, list_share, link_share, stitched, flagged)`` of every page.

    documents: (doc_id, text, site). A null or empty text, or a null doc_id,
    gives no row; pages without a site are judged but give no evidence for
    others. Repeated rows of one doc_id are judged as one page with all their
    phrases. With ``stitched`` 0 density alone decides.
    """
    seen = materialize(documents.select(F.col("doc_id").cast("long"), "text", "site").where("doc_id IS NOT NULL").mapInArrow(_scan, _DDL), "phrases")
    said = seen.where("phrase IS NOT NULL").select("doc_id", "phrase", "n", "host")
    # hosts of a phrase: distinct pairs first, so that a phrase on a third of all pages is spread by its hosts
    hosts = said.where("host IS NOT NULL").select("phrase", "host").distinct().groupBy("phrase").agg(F.count("*").alias("hosts"))
    replicated = hosts.where(F.col("hosts") >= min_hosts).select("phrase", F.lit(True).alias("replicated"))
    stuffed = F.when(F.col("replicated").isNotNull() | (F.col("n") >= REPEATS), F.col("n")).otherwise(0)
    marked = said.join(replicated, "phrase", "left").groupBy("doc_id").agg(F.sum("n").alias("phrases"), F.sum(stuffed).alias("stuffed"))
    pages = seen.where("phrase IS NULL").groupBy("doc_id").agg(*[F.max(c).alias(c) for c in ("chars", "link_chars", "list_chars")])
    by = pages.join(marked, "doc_id", "left").withColumn("stitched", F.coalesce(F.col("stuffed") / F.col("phrases"), F.lit(0.0)))
    dense = F.coalesce((F.col("link_chars") + F.col("list_chars")) > DENSE * F.col("chars"), F.lit(False))
    share = lambda c: F.when(F.col("chars") > 0, F.col(c) / F.col("chars")).otherwise(0.0)
    return by.select("doc_id", share("list_chars").alias("list_share"), share("link_chars").alias("link_share"), "stitched", (dense & (F.col("stitched") >= stitched)).alias("flagged"))
