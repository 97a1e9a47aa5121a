"""Words of a name and joins on common words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that say nothing about what a name is about.
STOP = "api app client component context controller data default fetch function get handler hook http index layout module page post provider query request route router screen service state store tsx ts ui use view".split()


def tokens(name: Column) -> Column:
    """Distinct lower-case words of a name, cut at signs and camel case, without stop words and words under three letters."""
    apart = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "[^A-Za-z0-9]+", " ")
    words = F.split(F.lower(F.trim(apart)), " +")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(STOP)))


def overlaps(left: DataFrame, left_name: str, right: DataFrame, right_name: str, first: int = 3) -> DataFrame:
    """Pairs of names with a common word, of each left name the ``first`` right names in order.

    Of a word only its ``first`` right names can be among those of a left name
    that has it, so that no word, however common, gives all its pairs.
    """
    a = left.select(left_name).distinct().select(left_name, F.explode(tokens(F.col(left_name))).alias("_w"))
    b = right.select(right_name).distinct().select(right_name, F.explode(tokens(F.col(right_name))).alias("_w"))
    b = b.withColumn("_r", F.row_number().over(Window.partitionBy("_w").orderBy(right_name))).where(F.col("_r") <= first)
    pairs = a.join(b, "_w").select(left_name, right_name).distinct()
    return pairs.withColumn("_r", F.row_number().over(Window.partitionBy(left_name).orderBy(right_name))).where(F.col("_r") <= first).drop("_r")
