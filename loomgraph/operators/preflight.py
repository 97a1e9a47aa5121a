"""Repository metrics before indexing: files, lines, languages, size band, risk; and what changed since the last run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Language family by extension, and folders that are not scanned.
FAMILIES = {"jvm": ["java", "kt", "kts"], "js": ["js", "jsx", "ts", "tsx", "mjs", "cjs"], "python": ["py", "pyi"], "php": ["php", "phtml", "php5", "php7", "php8"]}
IGNORED_ANYWHERE, IGNORED_AT_ROOT = r"(^|/)(\.[^/]+|node_modules|__pycache__|venv|\.venv)/", r"^(build|dist|target)/"
#: Lines up to which a repository is of a band; the bands' weight in the risk is their place.
BANDS = [(10_000, "small"), (50_000, "medium"), (150_000, "large")]


def family(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = None
    for name, exts in FAMILIES.items():
        out = F.when(ext.isin(exts), name) if out is None else out.when(ext.isin(exts), name)
    return out


def lines_of_code(code: Column) -> Column:
    """Lines that are not blank; 0 for a null text."""
    return F.coalesce(F.size(F.filter(F.split(code, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"\t", " ")) != "")), F.lit(0)).cast("bigint")


def metrics(files: DataFrame, max_turns: int = 60, context: int = 120_000) -> DataFrame:
    """``(repo, files, loc, families, band, risk_score, risk)`` of the latest version of each scanned file."""
    f = files.where(~F.col("path").rlike(IGNORED_ANYWHERE) & ~F.col("path").rlike(IGNORED_AT_ROOT)).withColumn("family", family(F.col("path"))).where("family IS NOT NULL")
    f = f.select("repo", "path", "family", "loaded_at", lines_of_code(F.col("code")).alias("loc"))
    f = f.groupBy("repo", "path", "family").agg(F.max_by("loc", F.struct("loaded_at", "loc")).alias("loc"))
    m = f.groupBy("repo").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"), F.array_join(F.array_sort(F.collect_set("family")), ", ").alias("families"), F.count_distinct("family").alias("n"))
    band = points = None
    for i, (top, name) in enumerate(BANDS):
        ok = F.col("loc") <= top
        band = F.when(ok, name) if band is None else band.when(ok, name)
        points = F.when(ok, i) if points is None else points.when(ok, i)
    one = lambda c: F.when(c, 1).otherwise(0)
    score = points.otherwise(len(BANDS)) + one(F.col("files") > 1000) + one(F.col("n") >= 3) + one((F.lit(max_turns) <= 60) & (F.col("loc") > 50_000)) + one((F.lit(context) <= 120_000) & (F.col("loc") > 150_000))
    out = m.select("repo", "files", "loc", "families", band.otherwise("xlarge").alias("band"), score.alias("risk_score"))
    return out.withColumn("risk", F.when(F.col("risk_score") <= 0, "low").when(F.col("risk_score") == 1, "medium").when(F.col("risk_score") == 2, "high").otherwise("critical"))


def manifest(files: DataFrame) -> DataFrame:
    """``(repo, path, hash)``: SHA-256 of the latest text of each file; a null text hashes as an empty one."""
    h = files.select("repo", "path", "loaded_at", F.sha2(F.coalesce("code", F.lit("")), 256).alias("hash"))
    return h.groupBy("repo", "path").agg(F.max_by("hash", F.struct("loaded_at", "hash")).alias("hash"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(repo, path, change)`` between two manifests: added, changed or removed; unchanged files are left out."""
    b, a = before.withColumnRenamed("hash", "old"), after.withColumnRenamed("hash", "new")
    both = b.join(a, ["repo", "path"], "full")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return both.withColumn("change", kind).where("change IS NOT NULL").select("repo", "path", "change")


def method_source(graph, files: DataFrame, span: int = 80, most: int = 150) -> DataFrame:
    """``(method, path, start_line, end_line, source)``: a method's lines out of its file, up to ``span`` where its end is not known and ``most`` in all."""
    latest = files.where(F.col("code").isNotNull()).groupBy("id").agg(F.max_by(F.struct("path", "code"), F.struct("loaded_at", "code")).alias("_")).select("id", "_.path", "_.code")
    m = graph.nodes.where(F.col("label").isin("Method", "Function", "Constructor", "ArrowFunction", "Component", "Hook", "AsyncFunction") & F.col("line").isNotNull() & (F.col("line") > 0)).select("id", "qn", "line", "end_line")
    at = graph.edges.where("type = 'SOURCE_FILE'").select(F.col("src").alias("id"), F.col("dst").alias("file")).distinct()
    j = m.join(at, "id").join(latest.withColumnRenamed("id", "file"), "file").withColumn("_l", F.split("code", "\n"))
    end = F.least(F.coalesce("end_line", F.col("line") + span), F.col("line") + most, F.size("_l"))
    j = j.withColumn("_end", end).where("line <= _end")
    return j.select(F.col("qn").alias("method"), "path", F.col("line").alias("start_line"), F.col("_end").cast("bigint").alias("end_line"), F.array_join(F.slice("_l", F.col("line").cast("int"), (F.col("_end") - F.col("line") + 1).cast("int")), "\n").alias("source"))
