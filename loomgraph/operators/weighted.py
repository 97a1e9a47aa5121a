"""A few keys holding most records: value-frequency compression.

Rows are grouped by key *and* value first, with the partial sums taken before
the shuffle, then by key. A key with a third of all rows is spread over the
tasks by its values; the second grouping gets at most one row a task and key.
Exact distinct counts and modes follow from the weighted values; exact
percentiles from ranges of (key, value) whose weights are summed by range, so
that a hot key is cut between tasks there as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import materialize, shuffle_partitions


def compress(rows: DataFrame, key: Column, value: Column, measure: Column | None = None) -> DataFrame:
    """``(key, value, rows, measure_sum, measure_rows)``: one row a key and value."""
    m = (measure if measure is not None else F.lit(None)).cast("double")
    return rows.select(key.alias("key"), value.alias("value"), m.alias("m")).groupBy("key", "value").agg(F.count("*").alias("rows"), F.sum("m").alias("measure_sum"), F.count("m").alias("measure_rows"))


def per_key(weighted: DataFrame) -> DataFrame:
    """``(key, rows, distinct_values, top_value, top_rows, mean)`` of each key, the null key included.

    Null values count as rows but not as distinct values, and are no mode; the
    mode is the smallest of the most frequent values; ``mean`` is of the
    measure's non-null values and null where there are none.
    """
    top = F.min(F.when(F.col("value").isNotNull(), F.struct((-F.col("rows")).alias("n"), F.col("value").alias("v"))))
    return (
        weighted.groupBy("key")
        .agg(F.sum("rows").alias("rows"), F.count("value").alias("distinct_values"), top.alias("_top"), F.sum("measure_sum").alias("_s"), F.sum("measure_rows").alias("_n"))
        .select("key", "rows", "distinct_values", F.col("_top.v").alias("top_value"), (-F.col("_top.n")).alias("top_rows"), F.when(F.col("_n") > 0, F.col("_s") / F.col("_n")).alias("mean"))
    )


def percentiles(weighted: DataFrame, shares: list[float]) -> DataFrame:
    """Exact discrete percentiles: ``(key, share, value)``, the least value with at least ``share`` of the key's non-null values at or below it.

    Ranges of (key, value) are sorted by task; the weights of a key are summed
    by range (as many rows as ranges and keys that meet), and the one range that
    holds the wanted rank is searched. No key is gathered in one task.
    """
    spark = weighted.sparkSession
    rows = weighted.where(F.col("value").isNotNull()).select("key", "value", "rows").repartitionByRange(shuffle_partitions(spark), "key", "value")
    cut = materialize(rows.withColumn("part", F.spark_partition_id()), "ranges")
    sums = cut.groupBy("key", "part").agg(F.sum("rows").alias("n"))
    by_key = Window.partitionBy("key").orderBy("part")
    sums = sums.withColumn("before", F.sum("n").over(by_key) - F.col("n")).withColumn("total", F.sum("n").over(Window.partitionBy("key")))
    wanted = sums.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    wanted = wanted.withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("total")))).where("rank > before AND rank <= before + n")
    inner = cut.withColumn("upto", F.sum("rows").over(Window.partitionBy("key", "part").orderBy("value")))
    wanted = wanted.select(F.col("key").alias("_k"), F.col("part").alias("_p"), "share", (F.col("rank") - F.col("before")).alias("rank"))
    hit = inner.join(wanted, F.col("key").eqNullSafe(F.col("_k")) & (F.col("part") == F.col("_p"))).where("upto >= rank AND upto - rows < rank")
    return hit.select("key", "share", "value")
