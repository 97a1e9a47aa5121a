"""Mixing sources to target weights by hash-threshold histograms.

Each record has a 64-bit hash of its key. Tokens are summed by source and the
hash's leading bits; where a source is to give only a part of its tokens, the
budget falls into one bucket of its histogram, and only that bucket is refined
by the next bits, until it holds one record or the bits are used up. The result
is one threshold a source, by which rows are filtered; nothing is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.operators.tokens import VOCABULARY, with_tokens
from loomgraph.session import materialize

BITS = 12


def source_name(col: Column) -> Column:
    """Without letter case and outer spaces."""
    return F.lower(F.trim(col))


def measured(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, source, tokens)`` of documents in the sources of ``targets``; a null text has 0 tokens."""
    names = targets.select(source_name(F.col("source")).alias("source")).where("source IS NOT NULL").distinct()
    docs = documents.select("doc_id", source_name(F.col("source")).alias("source"), "text").join(names, "source", "left_semi")
    return with_tokens(docs, "text", ["doc_id", "source"], vocabulary)


def shares(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, target_share, max_repeats, own_tokens, all_tokens, budget, short)``: what each source gives of all tokens, capped at max_repeats times its own.

    A source of ``targets`` without documents has 0 tokens of its own. Targets
    that name a source twice count with their sum and the larger cap.
    """
    own = sizes.groupBy("source").agg(F.sum("tokens").alias("own_tokens"))
    t = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").where("source IS NOT NULL")
    t = t.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    all_ = own.agg(F.coalesce(F.sum("own_tokens"), F.lit(0)).alias("n"))
    out = t.join(own, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("own_tokens", F.lit(0)).alias("own_tokens"), all_.scalar().alias("all_tokens"))
    wish, most = F.col("target_share") * F.col("all_tokens"), F.col("max_repeats") * F.col("own_tokens")
    return out.select("*", F.floor(F.least(wish, most.cast("double"))).alias("budget"), (wish > most).alias("short"))


def key_hash(key: Column) -> Column:
    """Non-negative 60-bit hash of a record's key: the first 15 digits of its MD5, which other engines have as well."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 15), 16, 10).cast("long")


def thresholds(sizes: DataFrame, wanted: dict[str, int], bits: int = BITS) -> dict[str, int]:
    """Per source the largest threshold for which the tokens of records with ``hash`` below it stay within ``wanted``.

    One aggregation a level, over the boundary buckets alone; the driver gets at
    most 2**bits rows a source (the sources are those of the target table).
    """
    low, left, done = dict.fromkeys(wanted, 0), dict(wanted), {}
    shift = 60
    while shift > 0 and len(done) < len(wanted):
        shift, span = max(0, shift - bits), shift
        inside = F.lit(False)
        for s in wanted:
            if s not in done:
                inside |= (F.col("source") == s) & (F.col("hash") >= low[s]) & (F.col("hash") < low[s] + (1 << span))
        rows = sizes.where(inside).groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).collect()
        for s in [s for s in wanted if s not in done]:
            edge = None
            for r in sorted((r for r in rows if r.source == s), key=lambda r: r.bucket):
                if r.tokens > left[s]:
                    edge = r
                    break
                left[s] -= r.tokens
            if edge is None:  # all of the range fits
                done[s] = low[s] + (1 << span)
            else:
                low[s] = edge.bucket << shift
                if edge.n == 1:
                    done[s] = low[s]
    return {s: done.get(s, low[s]) for s in wanted}


def mix(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, source, tokens, copies)`` of the records to take and ``(source, ..., taken_tokens, taken_share)`` of what is reached.

    A source whose budget is n times its tokens and a rest gives every record n
    times, and once more those with a hash below its threshold.
    """
    return mix_sizes(measured(documents, targets, vocabulary), targets)


def mix_sizes(sizes: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``mix`` of records whose size is known: (doc_id, source, tokens)."""
    sizes = materialize(sizes.withColumn("hash", key_hash(F.col("doc_id"))), "tokens")
    plan = shares(sizes, targets).collect()  # one row a source of the target table
    whole = {r.source: r.budget // r.own_tokens if r.own_tokens else 0 for r in plan}
    cut = thresholds(sizes, {r.source: r.budget - whole[r.source] * r.own_tokens for r in plan})
    copies = F.lit(0).cast("bigint")
    for s, n in whole.items():
        copies = F.when(F.col("source") == s, F.lit(n).cast("bigint") + F.when(F.col("hash") < cut[s], 1).otherwise(0)).otherwise(copies)
    taken = sizes.withColumn("copies", copies).where("copies > 0").select("doc_id", "source", "tokens", "copies")
    got = taken.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("taken_tokens"), F.max("copies").alias("most_copies"))
    total = taken.agg(F.sum(F.col("tokens") * F.col("copies")).alias("n"))
    report = shares(sizes, targets).join(got, "source", "left").withColumn("taken_tokens", F.coalesce("taken_tokens", F.lit(0))).withColumn("taken_share", F.col("taken_tokens") / total.scalar())
    return taken, report


