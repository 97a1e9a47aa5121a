"""References to records that do not exist: keyed pending-orphan state, kept incrementally.

``OrphanStore.put`` takes a batch of arrivals (versions of parents and
references to them). New references probe the parent index at their own time: a
reference is an orphan if nothing of its parent arrived before, or if the latest
arrival was a deletion. Arriving parents resolve waiting orphans, deletions
reopen them: what a key's references are now follows from its parent alone, so
that the state is the parent index and, by key, how many references wait.
``snapshots`` are the counts after each batch.

State lies in a folder, cut into buckets by the hash of the key. A batch reads
and writes the buckets of its own keys only; a manifest written last names the
version of each bucket. A batch run again starts from the manifest before it and
replaces what it wrote, and a new process goes on from the newest manifest.

The ordered pass runs over ranges of (key, time), so that a key with a third of
all references is cut between tasks: a task streams its range with constant
memory, says of the references before its first parent row that they need what
an earlier range knows, and tells its last state (one row a range).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import delete, listed, materialize, read_text, scope, shuffle_partitions, write_text


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks the references of a sorted range. States: 1 there, 0 gone or never seen, -1 to be had from an earlier range."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    first = last = None
    state = -1
    schema = None
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        keys = b.column("key")
        if first is None:
            first = keys[0].as_py()
        head = keys[0].as_py() != last
        new = np.empty(n, bool)
        new[0] = head and last is not None
        if n > 1:
            new[1:] = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        gone = pc.fill_null(pc.cast(b.column("gone"), pa.int8()), -2).to_numpy(zero_copy_only=False)  # -2: a reference
        event = np.where(gone == -2, -2, 1 - gone)
        event = np.where((event == -2) & new, 0, event)  # a key begins with a reference: nothing seen
        at = np.maximum.accumulate(np.where(event != -2, np.arange(n), -1))
        now = np.where(at >= 0, event[np.maximum(at, 0)], state)
        last, state = keys[n - 1].as_py(), int(now[-1])
        columns = [b.column(i) for i in range(b.num_columns)]
        refs = pa.array(gone == -2)
        schema = pa.schema([*b.schema, ("known", pa.int8()), ("part", pa.int32()), ("first", pa.string())])
        out = pa.RecordBatch.from_arrays([*columns, pa.array(now.astype(np.int8)), pa.array(np.full(n, part, np.int32)), pa.nulls(n, pa.string())], schema=schema)
        yield out.filter(refs)
    if schema is not None:
        own = {"key": last, "known": state, "part": part, "first": first}
        yield pa.RecordBatch.from_pylist([{f.name: own.get(f.name) for f in schema}], schema=schema)


def probe(parents: DataFrame, references: DataFrame, payload: list[str]) -> DataFrame:
    """``references`` with ``orphan``: what was known of ``key`` at ``at``.

    parents: (key, at, gone), rows at equal times count before a reference, and
    of rows of one parent at one time a deletion comes last. references: (key,
    at, payload...), null keys or times are kept out by the caller.
    """
    spark = references.sparkSession
    kinds = {f.name: f.dataType for f in references.schema}
    left = parents.select("key", "at", F.col("gone").cast("boolean").alias("gone"), *[F.lit(None).cast(kinds[c]).alias(c) for c in payload])
    right = references.select("key", "at", F.lit(None).cast("boolean").alias("gone"), *payload)
    events = left.unionByName(right)
    order = ["key", "at", F.col("gone").isNull(), "gone", *payload[:2]]
    rows = events.repartitionByRange(max(2, shuffle_partitions(spark)), *order).sortWithinPartitions(*order).drop("at")
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "known tinyint, part int, first string"])
    seen = materialize(rows.mapInArrow(_probe, ddl), "probe")
    tips = sorted(seen.where(F.col("first").isNotNull()).select("part", "first", "key", "known").collect())  # one row a range
    before, carry = {}, (None, 0)
    for part, first, last, known in tips:
        before[part] = carry[1] if first == carry[0] else 0
        carry = (last, before[part] if known == -1 else known)
    known = spark.createDataFrame([(k, v) for k, v in before.items()], "part int, before int")
    out = seen.where(F.col("first").isNull()).join(F.broadcast(known), "part", "left")  # one row a range
    return out.select("key", *payload, (F.when(F.col("known") == -1, F.col("before")).otherwise(F.col("known")) == 0).alias("orphan"))


def latest(parents: DataFrame) -> DataFrame:
    """``(key, at, gone)``: the latest arrival of each key, aggregated before the shuffle."""
    return parents.groupBy("key").agg(F.max(F.struct("at", "gone")).alias("_")).select("key", "_.at", "_.gone")


def _tally(keys: DataFrame, counts: DataFrame, by: list[str]) -> DataFrame:
    """Counts by ``by``: references, orphans on arrival, open now, resolved since, reopened or orphaned since."""
    there = F.coalesce(~F.col("gone"), F.lit(False))
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    refs, orphans = F.col("refs"), F.col("orphans")
    return counts.join(keys.select("key", "gone"), "key", "left").groupBy(*by).agg(
        n(refs).alias("refs"), n(orphans).alias("orphans"), n(F.when(~there, refs)).alias("open_now"), n(F.when(there, orphans)).alias("resolved"), n(F.when(~there, refs - orphans)).alias("reopened")
    )


COUNTED = ["refs", "orphans", "open_now", "resolved", "reopened"]


class OrphanStore:
    """Pending-orphan state in ``folder``; ``by`` are the columns of references that snapshots count by.

    ``buckets`` is the number of pieces keys are hashed into, the session's
    shuffle partitions unless given; a folder keeps the number it began with.
    Batches have numbers that grow. Null keys are kept out by the caller.
    """

    def __init__(self, spark: SparkSession, folder: str, by: list[str], buckets: int | None = None) -> None:
        self.spark, self.folder, self.by = spark, folder.rstrip("/"), by
        begun = self._versions()
        self.buckets = self._manifest(begun[-1])["buckets"] if begun else buckets or max(64, shuffle_partitions(spark))

    def _versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in listed(self.spark, f"{self.folder}/manifests") if n.endswith(".json"))

    def _manifest(self, number: int | None) -> dict:
        """The manifest of a batch: by table the version of each bucket, and the columns of references."""
        if number is None:
            return {"keys": {}, "counts": {}, "references": [], "types": {}}
        return json.loads(read_text(self.spark, f"{self.folder}/manifests/{number}.json"))

    def _read(self, manifest: dict, table: str, ddl: str, only: list[int]) -> DataFrame:
        paths = [f"{self.folder}/{table}/v={v}/bucket={b}" for b, v in manifest[table].items() if int(b) in only]
        return self.spark.read.schema(ddl).parquet(*paths) if paths else self.spark.createDataFrame([], ddl)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")

    def _write(self, df: DataFrame, table: str, number: int) -> dict[str, int]:
        """A version of the buckets in ``df``; the buckets that have rows."""
        path = f"{self.folder}/{table}/v={number}"
        df.withColumn("bucket", self._bucket()).repartition(min(self.buckets, 4 * shuffle_partitions(self.spark)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        return {n.removeprefix("bucket="): number for n in listed(self.spark, path) if n.startswith("bucket=")}

    def put(self, number: int, parents: DataFrame, references: DataFrame, payload: list[str]) -> None:
        """Batch ``number``: parents (key, at, gone) and references (key, at, payload...), which arrived later than earlier batches.

        Without rows the state stays as it is and a snapshot is written all the same.
        """
        before = [n for n in self._versions() if n < number]
        last = self._manifest(before[-1] if before else None)
        kinds = {f.name: f.dataType.simpleString() for f in references.schema}
        by = ", ".join(f"`{c}` {kinds[c]}" for c in self.by)
        keys_ddl, counts_ddl = f"key {kinds['key']}, at {kinds['at']}, gone boolean", f"key {kinds['key']}, {by}, refs bigint, orphans bigint"
        totals_ddl = f"{by}, {', '.join(f'{c} bigint' for c in COUNTED)}"
        with scope():
            held, counted = self.spark.createDataFrame([], keys_ddl), self.spark.createDataFrame([], counts_ddl)
            known = parents
            if before:
                touched = [r[0] for r in parents.select(self._bucket().alias("b")).unionByName(references.select(self._bucket().alias("b"))).distinct().collect()]  # at most one row a bucket
                held, counted = self._read(last, "keys", keys_ddl, touched), self._read(last, "counts", counts_ddl, touched)
                known = parents.unionByName(held.join(references.select("key").distinct(), "key", "left_semi"))
            at = f"{self.folder}/references/v={number}"
            probe(known, references, payload).write.mode("overwrite").parquet(at)
            arrived = self.spark.read.schema(", ".join([f"key {kinds['key']}", *(f"`{c}` {kinds[c]}" for c in payload), "orphan boolean"])).parquet(at)
            keys = self._write(latest(held.unionByName(parents) if before else parents), "keys", number)
            new = arrived.groupBy("key", *self.by).agg(F.count("*").alias("refs"), F.sum(F.col("orphan").cast("bigint")).alias("orphans"))
            if before:
                new = counted.unionByName(new).groupBy("key", *self.by).agg(F.sum("refs").alias("refs"), F.sum("orphans").alias("orphans"))
            counts = self._write(new, "counts", number)
            here = {"keys": keys, "counts": counts}
            whole = list(range(self.buckets))
            totals = _tally(self._read(here, "keys", keys_ddl, whole), self._read(here, "counts", counts_ddl, whole), self.by)
            if before:  # what was counted before, without the buckets that are counted anew
                was = _tally(held, counted, self.by).select(*self.by, *[(-F.col(c)).alias(c) for c in COUNTED])
                past = self.spark.read.schema(totals_ddl).parquet(f"{self.folder}/totals/v={before[-1]}")
                totals = past.unionByName(was).unionByName(totals).groupBy(*self.by).agg(*[F.sum(c).alias(c) for c in COUNTED])
            totals.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/totals/v={number}")  # one row a group that is counted by
        manifest = {"keys": last["keys"] | keys, "counts": last["counts"] | counts, "references": [*last["references"], number], "buckets": self.buckets, "types": {"totals": totals_ddl, "payload": payload, "kinds": kinds}}
        write_text(self.spark, f"{self.folder}/manifests/{number}.json", json.dumps(manifest))

    def references(self, number: int | None = None) -> DataFrame:
        """``(key, payload..., orphan)`` of all references up to a batch, the newest if none is named, as they arrived."""
        m = self._manifest(self._versions()[-1] if number is None else number)
        kinds = m["types"]["kinds"]
        ddl = ", ".join([f"key {kinds['key']}", *(f"`{c}` {kinds[c]}" for c in m["types"]["payload"]), "orphan boolean"])
        return self.spark.read.schema(ddl).parquet(*[f"{self.folder}/references/v={v}" for v in m["references"]])

    def open_now(self, number: int | None = None) -> DataFrame:
        """``references`` with ``orphan_now``, by the parent index of that batch."""
        m = self._manifest(self._versions()[-1] if number is None else number)
        kinds = m["types"]["kinds"]
        keys = self._read(m, "keys", f"key {kinds['key']}, at {kinds['at']}, gone boolean", list(range(self.buckets)))
        return self.references(number).join(keys.select("key", "gone"), "key", "left").withColumn("orphan_now", F.coalesce("gone", F.lit(True))).drop("gone")

    def snapshots(self) -> DataFrame:
        """``(batch, by..., refs, orphans, open_now, resolved, reopened)`` after each batch."""
        out = None
        for n in self._versions():
            part = self.spark.read.schema(self._manifest(n)["types"]["totals"]).parquet(f"{self.folder}/totals/v={n}").select(F.lit(n).alias("batch"), *self.by, *COUNTED)
            out = part if out is None else out.unionByName(part)
        return out

    def vacuum(self) -> None:
        """Deletes bucket versions that neither of the two newest manifests names; to be called between batches."""
        kept = [self._manifest(n) for n in self._versions()[-2:]]
        for table in ("keys", "counts"):
            for v in listed(self.spark, f"{self.folder}/{table}"):
                for b in listed(self.spark, f"{self.folder}/{table}/{v}"):
                    if b.startswith("bucket=") and not any(m[table].get(b[7:]) == int(v[2:]) for m in kept):
                        delete(self.spark, f"{self.folder}/{table}/{v}/{b}")


def ends(relationships: DataFrame, external: DataFrame, named: Column | None = None) -> DataFrame:
    """Both ends of each relationship as references ``(key, at, rel_id, side, repo)``, without those to external symbols or to nothing."""
    from loomgraph.schema import names_something

    both = relationships.select(
        F.col("loaded_at").alias("at"), "rel_id", "repo",
        F.inline(F.array(F.struct(F.lit("source").alias("side"), F.col("source_id").alias("key")), F.struct(F.lit("target").alias("side"), F.col("target_id").alias("key")))),
    )
    both = both.where(names_something(F.col("key")) & F.col("at").isNotNull())
    return both.join(external.select(F.col("id").alias("key")).where("key IS NOT NULL").distinct(), "key", "left_anti").select("key", "at", "rel_id", "side", "repo")


def versions(nodes: DataFrame) -> DataFrame:
    """Node rows as arrivals of parents ``(key, at, gone)``; a null ``is_deleted`` is no deletion."""
    return nodes.select(F.col("id").alias("key"), F.col("loaded_at").alias("at"), F.coalesce("is_deleted", F.lit(False)).alias("gone")).where("key IS NOT NULL AND at IS NOT NULL")
