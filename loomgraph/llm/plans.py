"""Queries of the operators on training text, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.operators import handwritten, invalid, leak, mixture, secrets, spam
from loomgraph.schema import table


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaked_spans(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaked_spans(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return leak.without_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_shares(spark, d).where("short").select("source")


def p8_taken(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def _by_chars(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The same mixture with sizes in characters, which SQL can count."""
    t = table(spark, d, "mix_targets")
    names = t.select(mixture.source_name(F.col("source")).alias("source")).distinct()
    sizes = table(spark, d, "documents").select("doc_id", mixture.source_name(F.col("source")).alias("source"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("tokens"))
    return mixture.mix_sizes(sizes.join(names, "source", "left_semi"), t)


def p8_taken__chars(spark: SparkSession, d: str) -> DataFrame:
    return _by_chars(spark, d)[0].withColumnRenamed("tokens", "chars")


def p8_shares__chars(spark: SparkSession, d: str) -> DataFrame:
    return _by_chars(spark, d)[1].select("source", F.round("target_share", 6).alias("target_share"), F.col("own_tokens").alias("own_chars"), F.col("budget"), "short", F.col("taken_tokens").alias("taken_chars"), F.round("taken_share", 6).alias("taken_share"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_scores(table(spark, d, "documents")).where("flagged").select("doc_id").distinct()


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_scores(table(spark, d, "documents"))


QUERIES = {"p7_found": p7_found, "p7_spans": p7_spans, "p7_cleaned": p7_cleaned, "p8_found": p8_found, "p8_taken": p8_taken, "p8_shares": p8_shares, "p8_taken__chars": p8_taken__chars, "p8_shares__chars": p8_shares__chars, "p9_found": p9_found, "p9_scores": p9_scores}

_TEXT = "regexp_replace(regexp_replace(text, '</?[A-Za-z][^<>]*>', ' ', 'g'), '&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z]+);', ' ', 'g')"
_WORDS = f"list_filter(regexp_split_to_array(lower({_TEXT}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"

#: Records by source in the order of their hash, taken whole copies and once more while the sum of sizes stays within the rest of the budget.
_MIX = """d AS (SELECT doc_id, lower(trim(source)) AS source, CAST(coalesce(length(text), 0) AS BIGINT) AS n, CAST(concat('0x', substr(md5(CAST(doc_id AS VARCHAR)), 1, 15)) AS BIGINT) AS h FROM documents),
t0 AS (SELECT lower(trim(source)) AS source, sum(target_share) AS target_share, max(max_repeats) AS max_repeats FROM mix_targets GROUP BY 1),
t1 AS (SELECT t0.source, t0.target_share, t0.max_repeats, CAST(coalesce(sum(d.n), 0) AS BIGINT) AS own FROM t0 LEFT JOIN d ON d.source = t0.source GROUP BY ALL),
t AS (SELECT *, CAST(floor(least(target_share * (SELECT sum(own) FROM t1), CAST(max_repeats * own AS DOUBLE))) AS BIGINT) AS budget, target_share * (SELECT sum(own) FROM t1) > max_repeats * own AS short FROM t1),
r AS (SELECT d.doc_id, d.source, d.n, CASE WHEN t.own > 0 THEN t.budget // t.own ELSE 0 END AS whole, t.budget - (CASE WHEN t.own > 0 THEN t.budget // t.own ELSE 0 END) * t.own AS rest, sum(d.n) OVER (PARTITION BY d.source ORDER BY d.h) AS upto FROM d JOIN t ON t.source = d.source),
k AS (SELECT doc_id, source, n AS chars, CAST(whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM r WHERE whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END > 0)"""

SQL = {
    "p8_taken__chars": f"WITH {_MIX} SELECT * FROM k",
    "p8_shares__chars": f"WITH {_MIX}, g AS (SELECT source, CAST(sum(chars * copies) AS BIGINT) AS taken FROM k GROUP BY source) SELECT t.source, round(target_share, 6) AS target_share, own AS own_chars, budget, short, coalesce(taken, 0) AS taken_chars, round(coalesce(taken, 0) / (SELECT sum(taken) FROM g), 6) AS taken_share FROM t LEFT JOIN g ON g.source = t.source",
    # tokens counted as characters: the sources that fall short are the same for any usual tokenizer
    "p8_found": """WITH own AS (SELECT lower(trim(source)) AS source, sum(coalesce(length(text), 0)) AS n FROM documents GROUP BY 1),
t AS (SELECT lower(trim(t.source)) AS source, target_share, max_repeats, coalesce(n, 0) AS n FROM mix_targets t LEFT JOIN own o ON o.source = lower(trim(t.source)))
SELECT source FROM t WHERE target_share * (SELECT sum(n) FROM t) > max_repeats * n""",
    "p7_found": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT item_id, {_WORDS} AS w FROM eval_items),
dg AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 12), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d) x),
eg AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 12), ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM e) x)
SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)""",
}


def _coded(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").select("id", "code").unionByName(table(spark, d, "code_nodes").select("id", "code"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.credentials(_coded(spark, d)).select("id", "line_no").distinct()


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    return secrets.credentials(_coded(spark, d), text=True)


QUERIES |= {"p6_found": p6_found, "p6_redacted": p6_redacted}


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return invalid.parsed(table(spark, d, "source_files")).where(F.size("errors") > 0).select("id").distinct()


def p3_errors(spark: SparkSession, d: str) -> DataFrame:
    """All errors of each broken file, the first cause first."""
    bad = invalid.parsed(table(spark, d, "source_files")).where(F.size("errors") > 0)
    return bad.select("id", "path", "language", F.size("errors").alias("n_errors"), F.col("errors")[0]["line"].alias("first_line"), F.col("errors")[0]["message"].alias("first_cause"), "errors")


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return invalid.rates(table(spark, d, "source_files"))


QUERIES |= {"p3_found": p3_found, "p3_errors": p3_errors, "p3_rates": p3_rates}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.classify(table(spark, d, "source_files")).where("generated OR minified OR vendored OR blob").select("id")


def p2_kinds(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.classify(table(spark, d, "source_files"))


QUERIES |= {"p2_found": p2_found, "p2_kinds": p2_kinds}
