"""Generated, minified or vendored source files and data blobs: what is left is hand-written.

Each text becomes a row of tokens without comments. Shingles are five tokens in
a row, with identifiers and literals masked (structure) and as they stand
(content). Texts of the same set are one class; MinHash bands find candidates
among all classes, which are verified on the sets (Jaccard of at least 0.8), and
the verified links make clusters (connected components):

* structure, all texts: a cluster that holds several texts of different content
  within one repository is a family of *generated* files (*minified*, where lines
  are endless). As an exact check, only members whose structure repeats itself
  count: short hand-written files are alike by chance;
* content, all texts: a cluster over several repositories is *vendored*. The
  libraries and folders of such clusters are learnt, so that a library's file
  with no second copy is known as well, and its whole cluster with it;
* literal-only: texts that are little but literals are clustered by those of
  their shingles that hold nothing but literals and signs; a cluster of several
  texts is of *blobs*.

``rules`` add evidence for texts that stand in no cluster: a generator's banner,
a licence header with the name and version of a library that is not the
repository's own, endless lines, a blob without a second of its kind.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.operators.clusters import clusters
from loomgraph.session import materialize

SHINGLE, SIMILAR = 5, 0.8
#: Bands and rows of structure, then of content. Two sets of similarity 0.8 share no band with probability
#: (1 - 0.8**8)**40 = 0.0006 and (1 - 0.8**5)**20 = 0.0004; hand-written files have 0.44 in structure (one band with 0.05) and 0.02 in content.
STRUCTURE, CONTENT = (40, 8), (20, 5)
#: Classes of a bucket that meet in one block.
BUCKET = 48
#: 64-bit words of a sketch.
SKETCH = 4
#: Share of distinct shingles in all of a structure that repeats itself; of literals in a blob's tokens; of signs in code's.
REPETITIVE, LITERALS, SIGNS = 0.25, 0.3, 0.25
#: Least files of a place, and their share, that stand in several repositories, to make it a library's.
PLACE_FILES, PLACE_SHARE = 3, 0.8
#: Least tokens of a minified text, and of a blob by its share of literal tokens.
LEAST, LEAST_BLOB = 30, 20
#: Share of a blob's characters, without white space and comments, that lie in literals; holds at any size.
LITERAL_CHARS = 0.9

#: Words of the six languages that masking keeps.
KEYWORDS = frozenset(
    """abstract and as assert async await break case catch class const continue def default del do elif else elseif enum
except export extends final finally for foreach from fun function global if implements import in instanceof interface is lambda
let match namespace new not null object or override package pass private protected public raise return static super switch
this throw throws trait true try typeof use val var void when while with yield None True False self""".split()
)
#: Folders that hold copies of third-party code.
VENDOR_FOLDERS = r"(?:^|/)(?:vendor|third_party|third-party|thirdparty|3rdparty|node_modules|bower_components|external|deps|site-packages)/(?P<dir>@?[\w.-]+)/|(?:^|/)lib/(?P<lib>[A-Za-z][\w]*)-\d+\.[\w.]+/"
#: What a generator writes at the top of its output.
BANNER = r"(?im)^[ \t/#*<!;-]*(?:@generated\b|<auto-generated>|auto-?generated (?:file|code|by)\b|(?:this (?:file|code|class) (?:was|is) )?(?:automatically|auto-?) ?generated (?:by|from|file)\b|code generated by .*do not edit|generated (?:from|by) .*(?:do not (?:edit|modify)|changes will be lost)|generated (?:from|by) \S+.*\bon \d{4}|automatisch erzeugt durch .*nicht ändern|généré automatiquement|generado automáticamente|this file is generated)"
#: The beginnings of a third-party licence header, with the library's name and version.
LICENCE = r"(?im)^[ \t/#*!]*(?P<name>[A-Za-z][\w.-]+) v?\d+\.\d+(?:\.\d+)?(?:[ \t]+-[ \t]+.*licen[cs]e)?[ \t\r]*(?:\*/[ \t\r]*)?$"
MINIFIED_BANNER = r"^\s*/\*!\s"
#: Words before a number that name a licence or a language, not a library.
NO_LIBRARY = frozenset("version license licence apache gpl lgpl agpl mpl bsd mit epl cddl gnu python java kotlin php node javascript typescript since release section chapter revision rev copyright".split())
#: Statements that may stand before a file's header comment, and what a banner says further down.
PROLOGUE = r"(?:\s*(?:<\?php\b|package\b[^\n]*|import\b[^\n]*|from\b[^\n]*\bimport\b[^\n]*|use\b[^\n]*|namespace\b[^\n]*|declare\b[^\n]*|@file:[^\n]*|[\"']use strict[\"'];?))*\s*"
FIXED = r"(?i)do not (?:edit|modify)|changes will be lost|nicht ändern|@generated\b|<auto-generated>"

_BANNER, _LICENCE, _VENDOR, _PROLOGUE, _FIXED = re.compile(BANNER), re.compile(LICENCE), re.compile(VENDOR_FOLDERS), re.compile(PROLOGUE), re.compile(FIXED)
#: any banner has one of these
_GENERATED = ("generated", "erzeugt", "généré", "generado")
_RIGHTS = re.compile(r"(?i)licen[cs]e|copyright|\(c\)")
_STRINGS = r'"""(?:[^"\\]|\\.|"(?!""))*"""|\'\'\'(?:[^\'\\]|\\.|\'(?!\'\'))*\'\'\'|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`'
_TOKENS = {
    "hash": re.compile(r"#[^\n]*|([A-Za-z_]\w*|" + _STRINGS + r"|\d[\w.]*|[^\s#])", re.S),
    "slash": re.compile(r"/\*(?:[^*]|\*(?!/))*\*/|//[^\n]*|([A-Za-z_$][\w$]*|" + _STRINGS + r"|\d[\w.]*|\S)", re.S),
    "both": re.compile(r"/\*(?:[^*]|\*(?!/))*\*/|//[^\n]*|#(?!\[)[^\n]*|(\$?[A-Za-z_]\w*|" + _STRINGS + r"|\d[\w.]*|\S)", re.S),
}
_STYLE = {"py": "hash", "pyi": "hash", "php": "both"}

_RNG = np.random.RandomState(20_011)
#: Odd factors of the rows and bands of a key.
_ROW, _BAND = (_RNG.randint(1 << 61, 1 << 62, k).astype(np.uint64) * np.uint64(2) + np.uint64(1) for k in (64, 512))


class _Codes(dict):
    """Codes of tokens: in the upper 32 bits as they stand, then 30 bits masked, then 2 for the kind (0 name, 1 literal, 2 sign, 3 keyword)."""

    def __missing__(self, t: str) -> int:
        if len(self) > 500_000:
            self.clear()
        c = t[0]
        if c in "\"'`" and len(t) > 1:
            m, kind = "S", 1
        elif c.isdigit():
            m, kind = "N", 1
        elif c.isalpha() or c in "_$":
            m, kind = (t, 3) if t in KEYWORDS else ("I", 0)
        else:
            m, kind = t, 2
        crc = zlib.crc32
        v = self[t] = crc(t.encode("utf8", "surrogatepass")) << 32 | crc(m.encode("utf8", "surrogatepass")) >> 2 << 2 | kind
        return v


def tokens(code: str, path: str) -> list[str]:
    """Tokens without comments."""
    style = _STYLE.get(path.rsplit(".", 1)[-1].lower(), "slash")
    return list(filter(None, _TOKENS[style].findall(code)))


def comments(code: str, path: str) -> list[tuple[str, bool]]:
    """Blocks of comments that begin a line at its first column, and whether only a prologue stands before; a Python module's docstring is one.

    Comments with nothing but white space between them are one block.
    """
    style = _STYLE.get(path.rsplit(".", 1)[-1].lower(), "slash")
    out: list[tuple[str, bool]] = []
    start = end = -1
    first, before, leading = True, 0, True
    for m in _TOKENS[style].finditer(code):
        t = m.group(1)
        if t is not None and not (first and style == "hash" and t[:3] in ('"""', "'''")):
            first = False
            if start >= 0:
                out.append((code[start:end], leading))
                start, before = -1, end
            continue
        if start < 0:
            if m.start() and code[m.start() - 1] != "\n" and (code[code.rfind("\n", 0, m.start()) + 1 : m.start()].strip() or not first):
                continue
            leading = leading and _PROLOGUE.fullmatch(code, before, m.start()) is not None
            start = m.start()
        end, first = m.end(), first and t is None
    if start >= 0:
        out.append((code[start:end], leading))
    return out


def generator_banner(blocks: list[tuple[str, bool]]) -> bool:
    """A generator's banner begins a line of a leading comment; further down it also tells not to edit."""
    return any(_BANNER.search(b.replace('"""', "   ").replace("'''", "   ")) and (leading or _FIXED.search(b)) for b, leading in blocks)


def header_library(blocks: list[tuple[str, bool]]) -> tuple[str | None, bool]:
    """The library of a header with name and version, and whether its comment speaks of a licence; one that does goes first."""
    found = [(m.group("name").lower(), bool(_RIGHTS.search(b))) for b, leading in blocks for m in _LICENCE.finditer(b) if m.group("name").lower() not in NO_LIBRARY and (leading or _RIGHTS.search(b))]
    return next((f for f in found if f[1]), found[0] if found else (None, False))


def shingles(codes: np.ndarray) -> np.ndarray:
    """Codes of five tokens in a row; of a shorter text all of it is the one shingle."""
    with np.errstate(over="ignore"):
        n = max(1, len(codes) - SHINGLE + 1)
        out = np.zeros(n, np.uint64)
        for j in range(min(SHINGLE, len(codes))):
            out = out * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + n]
            out ^= out >> np.uint64(31)
        return out >> np.uint64(32)


def minima(distinct: np.ndarray, t: int) -> np.ndarray:
    """``t`` MinHash values of a set, each equal for two sets with the probability of their similarity.

    Fast similarity sketching (Dahlgaard, Knudsen, Thorup 2017): in each round a
    hash of its own throws all elements into ``t`` places; a place keeps the
    first round that hits it and the least hash of that round. That takes some
    t * ln(t) hashes a set in place of t times its size.
    """
    x = distinct.astype(np.uint64)
    out, empty, low = np.zeros(t, np.uint64), np.ones(t, bool), 0
    rounds = min(4096, int(t * (np.log(t) + 1) / len(x)) + 1)
    with np.errstate(over="ignore"):
        while True:
            turn = np.arange(low + 1, low + rounds + 1, dtype=np.uint64)[:, None]
            h = (x ^ turn * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(31)
            h *= np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(29)
            place = (h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32) << np.uint64(48)
            h &= np.uint64(0xFFFFFFFF)
            h |= place
            h |= (turn - np.uint64(low)) << np.uint64(32)
            k = np.sort(h, axis=None)
            at = k >> np.uint64(48)
            first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            at, k = at[first].astype(np.int64), k[first]
            new = empty[at]
            at = at[new]
            out[at] = (k[new] & np.uint64(0xFFFFFFFFFFFF)) + (np.uint64(low) << np.uint64(32))
            empty[at] = False
            if not empty.any():
                return out
            low += rounds


def bands(distinct: np.ndarray, shape: tuple[int, int] = CONTENT, salt: int = 0) -> list[int]:
    """One 64-bit key a band, of its MinHash values. Sets with different salts share no band."""
    n, rows = shape
    with np.errstate(over="ignore"):
        key = (minima(distinct, n * rows).reshape(n, rows) * _ROW[:rows]).sum(axis=1)
        key = (key ^ key >> np.uint64(29)) * (_BAND[:n] + np.uint64(salt * 8192))
        return (key ^ key >> np.uint64(32)).view(np.int64).tolist()


def sketch(distinct: np.ndarray) -> list[int]:
    """Parities of the set's elements by place: two sketches differ in no more bits than the sets have elements not in common."""
    odd = np.bincount((distinct & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


_OUT = pa.schema(
    [("id", pa.string()), ("repo", pa.string()), ("path", pa.string()), ("n", pa.int32()), ("literals", pa.float64()), ("literal_chars", pa.float64()), ("signs", pa.float64()), ("distinct", pa.float64()), ("endless", pa.bool_()), ("banner", pa.bool_()), ("library", pa.string()), ("licensed", pa.bool_()), ("folder", pa.string())]
    + [(f"{k}_{c}", t) for k in ("content", "structure", "literal") for c, t in (("cls", pa.int64()), ("set", pa.list_(pa.int32())), ("sketch", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64())))]
)
_DDL = "id string, repo string, path string, n int, literals double, literal_chars double, signs double, distinct double, endless boolean, banner boolean, library string, licensed boolean, folder string, " + ", ".join(f"{k}_cls long, {k}_set array<int>, {k}_sketch array<long>, {k}_bands array<long>" for k in ("content", "structure", "literal"))


def _digest(a: np.ndarray, seed: int = 0) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(a.tobytes(), seed)).astype(np.int64))


def _class(s: np.ndarray, shape: tuple[int, int], salt: int = 0, key: int | None = None) -> tuple:
    """Key, set, sketch and bands of a distinct set of shingles; texts of one set have one key."""
    return (_digest(s, salt) if key is None else key, s.astype(np.uint32).view(np.int32), sketch(s), bands(s, shape, salt))


def blob_like(n: int, literals: float, literal_chars: float) -> bool:
    """Whether a text is little but literals, by tokens or at any size by characters."""
    return literals >= LITERALS and n >= LEAST_BLOB or literal_chars >= LITERAL_CHARS


def literal_only(kinds: np.ndarray, masked: np.ndarray) -> np.ndarray:
    """The distinct masked shingles that hold nothing but literals and signs; of a text without such a shingle all of them."""
    n = max(1, len(kinds) - SHINGLE + 1)
    only, some = np.ones(n, bool), np.zeros(n, bool)
    for j in range(min(SHINGLE, len(kinds))):
        k = kinds[j : j + n]
        only &= (k == 1) | (k == 2)
        some |= k == 1
    return np.unique(masked[only & some]) if (only & some).any() else np.unique(masked)


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features, classes and bands of texts (id, repo, path, code)."""
    codes = _Codes()
    for b in batches:
        rows = []
        for key, repo, path, code in zip(*(b.column(i).to_pylist() for i in range(4))):
            code = code.removeprefix("﻿")
            toks = tokens(code, path or "")
            both = np.array(list(map(codes.__getitem__, toks)), np.uint64)
            n = len(toks)
            plain, masked, kinds = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF), both & np.uint64(3)
            of_kind = np.bincount(kinds.astype(np.int64), minlength=4)
            lit, signs = (of_kind[1] / n, of_kind[2] / n) if n else (0.0, 0.0)
            doc = 1 if n and toks[0][:3] in ('"""', "'''") else 0  # a module's docstring is documentation
            chars = sum(map(len, toks)) - (len(toks[0]) if doc else 0)
            lit_chars = sum(len(toks[i]) for i in np.flatnonzero(kinds == 1).tolist() if i >= doc) / chars if chars else 0.0
            ms = shingles(masked)
            mset = np.unique(ms)
            lines, low = code.count("\n") + 1, code.lower()
            endless = n >= LEAST and len(code) > 120 * lines and max(map(len, code.split("\n"))) > 400 and signs > 0.4 and lit < LITERALS
            blocks = comments(code, path or "") if any(w in low for w in _GENERATED) and _BANNER.search(code) or _LICENCE.search(code) else []
            lib, rights = header_library(blocks)
            ven = _VENDOR.search(path or "")
            folder = (ven.group("dir") or ven.group("lib")) if ven else None
            empty = toks in ([], ["<", "?", "php"])  # no content to be copied
            none = (None,) * 4
            rows.append(
                (key, repo, path, n, lit, lit_chars, signs, len(mset) / len(ms), endless, generator_banner(blocks), lib, rights and lib not in (repo or "").lower(), re.sub(r"-\d[\w.]*$", "", folder).lower() if folder else None)
                + (none if empty else _class(np.unique(shingles(plain)), CONTENT, 0, _digest(plain)))
                + (none if empty else _class(mset, STRUCTURE, 1))
                + (_class(literal_only(kinds, ms), STRUCTURE, 2) if not empty and blob_like(n, lit, lit_chars) else none)
            )
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_OUT), _OUT)], schema=_OUT)


def _classes(seen: DataFrame, kind: str) -> DataFrame:
    """``(cls, size, set, sketch, bands)``: one row a class of texts, however many have it."""
    own = [F.first(f"{kind}_{c}").alias(c) for c in ("set", "sketch", "bands")]
    return seen.where(F.col(f"{kind}_cls").isNotNull()).groupBy(F.col(f"{kind}_cls").alias("cls")).agg(*own).withColumn("size", F.size("set"))


def _known(rows: DataFrame, other: DataFrame, key: str, as_text: Column) -> DataFrame:
    """``rows`` left-joined with ``other`` by ``key``, with null keys spread over all tasks rather than sent to one."""
    name = other.withColumn("_key", as_text).drop(key)
    return rows.withColumn("_key", F.coalesce(as_text, F.concat(F.lit("\n"), F.xxhash64("id").cast("string")))).join(name, "_key", "left").drop("_key")


def classify(files: DataFrame, bucket: int = BUCKET, rules: bool = True) -> DataFrame:
    """``(id, generated, minified, vendored, blob, clustered, copies_in_repos, family)`` of each distinct text of ``files`` (id, repo, path, code).

    Null and empty texts have no row. A row repeated with the same id, repo,
    path and text is one file. ``copies_in_repos`` is the number of repositories
    of the text's content cluster, ``family`` the number of other texts of its
    structure cluster that repeat themselves. ``clustered`` tells that a cluster
    decides, not a rule; with ``rules`` false, rules decide nothing.
    """
    src = files.select("id", "repo", "path", "code").where(F.col("id").isNotNull() & F.col("code").isNotNull() & (F.length("code") > 0))
    seen = materialize(src.mapInArrow(describe, _DDL), "texts")

    # one run over all classes: the bands and keys of the three kinds are salted apart
    classes = materialize(_classes(seen, "structure").unionByName(_classes(seen, "literal")).unionByName(_classes(seen, "content")), "classes")
    found = materialize(clusters(classes, SIMILAR, SKETCH, bucket), "clusters")
    flat = seen.drop(*[f"{k}_{c}" for k in ("content", "structure", "literal") for c in ("set", "sketch", "bands")])
    for k in ("content", "structure", "literal"):  # a class without a link is a cluster of its own
        flat = _known(flat, found.select(F.col("cls").alias(f"{k}_cls"), F.col("cluster").alias(k)), f"{k}_cls", F.col(f"{k}_cls").cast("string")).withColumn(k, F.coalesce(k, f"{k}_cls"))
    like_blob = (F.col("literals") >= LITERALS) & (F.col("n") >= LEAST_BLOB) | (F.col("literal_chars") >= LITERAL_CHARS)
    code = (F.col("signs") >= SIGNS) & (F.col("n") >= 12)
    repeats = (F.col("distinct") < REPETITIVE) & code & ~like_blob & (F.col("n") >= LEAST)
    flat = materialize(flat.withColumn("like_blob", like_blob).withColumn("code", code).withColumn("repeats", repeats).withColumn("repo", F.coalesce("repo", F.lit(""))), "clustered")

    # families: clusters of structure with two texts of one repository that are not copies of each other; counted by (cluster, repo) first
    per_repo = flat.where("repeats").groupBy("structure", "repo").agg(F.count_distinct("content").alias("texts"))
    family = per_repo.groupBy("structure").agg((F.sum("texts") - 1).alias("family"), (F.max("texts") > 1).alias("is_family"))
    blobs = flat.where("like_blob").select("literal", "content").distinct().groupBy("literal").agg((F.count("*") > 1).alias("is_blobs"))

    # what stands in several repositories, by cluster of content
    spread = materialize(flat.where("content IS NOT NULL").select("content", "repo").distinct().groupBy("content").agg(F.count("*").alias("repos")), "spread")
    at = flat.join(spread, "content", "left")
    # libraries learnt from it
    names = at.where("repos > 1").select(F.explode(F.array("library", "folder")).alias("library"), "repo").where("library IS NOT NULL").distinct().groupBy("library").agg(F.count("*").alias("r")).where("r > 1").select("library")
    # and places: two folders in a row most of whose files stand in several repositories
    steps = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    windows = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda i: F.concat_ws("/", F.element_at(steps, i), F.element_at(steps, i + 1)))
    placed = at.where(F.col("path").isNotNull() & (F.size(steps) > 1)).select("id", "repos", F.explode(windows).alias("place"))
    is_copy = F.coalesce("repos", F.lit(1)) > 1
    places = placed.groupBy("place").agg(F.count("*").alias("files"), F.sum(is_copy.cast("int")).alias("copies")).where((F.col("copies") >= PLACE_FILES) & (F.col("copies") >= PLACE_SHARE * F.col("files"))).select("place")
    there = placed.join(places, "place", "left_semi").select("id").distinct().withColumn("_by_place", F.lit(True))

    out = _known(at.join(family, "structure", "left"), blobs, "literal", F.col("literal").cast("string"))
    out = _known(out, names.select("library", F.lit(True).alias("_by_header")), "library", F.col("library"))
    out = _known(out, names.select(F.col("library").alias("folder"), F.lit(True).alias("_by_folder")), "folder", F.col("folder")).join(there, "id", "left")
    yes = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False))
    learnt = (yes("_by_header") | yes("_by_folder") | yes("_by_place")) & F.col("code")
    licensed = yes("licensed") & F.col("code") if rules else F.lit(False)
    out = out.select("id", "content", "banner", "endless", "like_blob", "repos", "family", "repeats", yes("is_family").alias("is_family"), yes("is_blobs").alias("is_blobs"), learnt.alias("learnt"), licensed.alias("licensed"))
    out = materialize(out, "judged")
    # a cluster of content is a library's as a whole
    owned = out.where("learnt OR licensed").groupBy("content").agg(F.max("learnt").alias("_learnt"), F.max("licensed").alias("_licensed"))
    out = out.join(owned, "content", "left")
    in_family = F.col("repeats") & F.col("is_family")
    by_cluster = {"generated": in_family & ~F.col("endless"), "minified": in_family & F.col("endless"), "vendored": (F.coalesce("repos", F.lit(1)) > 1) | yes("_learnt"), "blob": F.col("like_blob") & F.col("is_blobs")}
    by_rule = {"generated": F.col("banner"), "minified": F.col("endless") & ~F.col("like_blob"), "vendored": yes("_licensed"), "blob": F.col("like_blob")} if rules else dict.fromkeys(by_cluster, F.lit(False))
    any_cluster = reduce(lambda x, y: x | y, by_cluster.values())
    flags = out.select("id", *[(by_cluster[k] | by_rule[k]).alias(k) for k in by_cluster], any_cluster.alias("clustered"), F.coalesce("repos", F.lit(1)).alias("copies_in_repos"), F.when(F.col("repeats"), F.coalesce("family", F.lit(0))).otherwise(0).alias("family"))
    return flags.groupBy("id").agg(*[F.max(c).alias(c) for c in (*by_cluster, "clustered", "copies_in_repos", "family")])
