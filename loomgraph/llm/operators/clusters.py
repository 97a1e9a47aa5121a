"""Links between sets that share a MinHash band, and the clusters (connected components) they make.

Classes are ``(cls, size, sketch, set, bands)``: distinct sets of hashes with
their band keys. A pair of a bucket is a candidate if its sizes and the parities
of its sketches allow the similarity (both are bounds, so that nothing is lost),
and a link if its sets have it. ``clusters`` is exact without comparing all
pairs of a group: every class of a large bucket meets the bucket's first one,
and then only pairs of a bucket that are in different clusters so far.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.session import materialize


def _possible(words: int, threshold: float) -> Column:
    """Whether two sets, by their sizes and sketches in the structs ``l`` and ``r``, may have the similarity."""
    na, nb = F.col("l.size"), F.col("r.size")
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"l.k{i}").bitwiseXOR(F.col(f"r.k{i}"))) for i in range(words)])
    # sets whose sizes differ by more than the threshold cannot be alike, nor those with too many elements not in common
    return (F.least(na, nb) >= threshold * F.greatest(na, nb)) & (apart <= (1 - threshold) / (1 + threshold) * (na + nb) + 1e-6)


def _buckets(classes: DataFrame, words: int) -> DataFrame:
    """``(band, cls, size, k0.., n, head)``: a row a class and band that another class has as well, with the bucket's size and least class."""
    rows = classes.select("cls", "size", *[F.col("sketch")[i].alias(f"k{i}") for i in range(words)], F.explode("bands").alias("band"))
    shared = classes.select("cls", F.explode("bands").alias("band")).groupBy("band").agg(F.count("*").alias("n"), F.min("cls").alias("head")).where("n > 1")
    return materialize(rows.join(shared, "band"), "buckets")


def _pairs(rows: DataFrame, bucket: int, wanted: Column) -> DataFrame:
    """``(a, b)``: pairs within a bucket that fulfil ``wanted`` of ``l`` and ``r``.

    A bucket of more than ``bucket`` classes is cut into blocks, each of which
    meets the whole bucket, so that no task holds all pairs of a hot one.
    """
    small = rows.where(F.col("n") <= bucket)
    large = rows.where(F.col("n") > bucket).withColumn("blocks", F.ceil(F.col("n") / bucket).cast("int"))
    cut = large.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    every = large.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    both = small.alias("l").join(small.alias("r"), "band"), cut.alias("l").join(every.alias("r"), ["band", "block"])
    found = [j.where((F.col("l.cls") < F.col("r.cls")) & wanted).select(F.col("l.cls").alias("a"), F.col("r.cls").alias("b")) for j in both]
    return found[0].unionByName(found[1]).distinct()


def _verified(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (a, b) of class keys those whose sets are alike."""
    both = pairs.join(classes.select(F.col("cls").alias("a"), F.col("set").alias("_sa")), "a").join(classes.select(F.col("cls").alias("b"), F.col("set").alias("_sb")), "b")
    same = F.size(F.array_intersect("_sa", "_sb"))
    return both.where(same >= threshold * (F.size("_sa") + F.size("_sb") - same)).select("a", "b")


def links(classes: DataFrame, threshold: float, words: int, bucket: int) -> DataFrame:
    """All verified pairs ``(a, b)``, a < b, of classes that share a band; the same for every ``bucket``."""
    return _verified(_pairs(_buckets(classes, words), bucket, _possible(words, threshold)), classes, threshold)


def components(edges: DataFrame) -> DataFrame:
    """``(cls, cluster)`` of all ends of ``edges`` (a, b): a component is named by its smallest key.

    Large and small stars in turn: all larger neighbours of a key, then all
    smaller ones are linked to the least neighbour, until every component is one
    star. The rounds grow with the logarithm of its width.
    """
    flat = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    at = materialize(flat, "edges")
    state = [F.count("*"), F.bit_xor(F.xxhash64("u", "v"))]
    before = at.agg(*state).first()
    while before[0]:
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        at = materialize(small, "edges")
        now = at.agg(*state).first()
        if now == before:
            break
        before = now
    return at.select(F.col("u").alias("cls"), F.col("v").alias("cluster")).unionByName(at.select(F.col("v").alias("cls"), F.col("v").alias("cluster")).distinct())


def clusters(classes: DataFrame, threshold: float, words: int, bucket: int) -> DataFrame:
    """``(cls, cluster)``: the connected components of ``links``; a class without a link has no row.

    In a bucket of more than ``bucket`` classes every class first meets the
    bucket's least one, which joins the members of a large group with one
    comparison each; then the pairs of a bucket whose classes are in different
    clusters so far are compared.
    """
    rows, possible = _buckets(classes, words), _possible(words, threshold)
    large = rows.where(F.col("n") > bucket)
    star = large.where("cls <> head").alias("l").join(large.where("cls = head").alias("r"), "band").where(possible).select(F.col("r.cls").alias("a"), F.col("l.cls").alias("b")).distinct()
    stars = components(_verified(star, classes, threshold))
    named = rows.join(stars, "cls", "left").withColumn("cluster", F.coalesce("cluster", "cls"))
    rest = _verified(_pairs(named, bucket, (F.col("l.cluster") != F.col("r.cluster")) & possible), classes, threshold)
    return components(stars.where("cls <> cluster").select(F.col("cls").alias("a"), F.col("cluster").alias("b")).unionByName(rest))
