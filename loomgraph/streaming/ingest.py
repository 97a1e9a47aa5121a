"""Streaming: graph files that arrive in a folder, and pending orphans kept over micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.graph import connected, dedupe
from loomgraph.operators import orphans as O
from loomgraph.sources import graph_json


def ingest(spark: SparkSession, landing: str, target: str, checkpoint: str):
    """A stream of interchange JSON files into ``target`` (Parquet by batch); ``current`` reads the graph.

    Exactly once: a batch writes to a folder of its own number, so that a batch
    run again after a failure replaces what it wrote before.
    """

    def put(batch: DataFrame, number: int) -> None:
        nodes, edges = graph_json.frames(batch)
        nodes.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/nodes/batch={number}")
        edges.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/edges/batch={number}")

    stream = spark.readStream.schema(graph_json.SCHEMA).option("multiLine", True).json(landing)
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str):
    """The graph of all batches: of nodes with one id the latest batch's."""
    nodes = spark.read.parquet(f"{target}/nodes/*")
    edges = spark.read.parquet(f"{target}/edges/*").drop("batch")
    return connected(dedupe(nodes, ["batch"]).drop("batch"), edges)


class OrphanStream:
    """Pending-orphan state over micro-batches of arrivals ``(kind, key, at, gone, rel_id, side)``, kind ``parent`` or ``reference``.

    Batches are taken in order of arrival. All state lies in ``folder`` under the
    batch numbers, so that a new process with the stream's checkpoint goes on
    where the old one ended, and a batch run again replaces itself.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.store = O.OrphanStore(spark, folder, ["side"])

    def put(self, batch: DataFrame, number: int) -> None:
        parents = batch.where("kind = 'parent'").select("key", "at", "gone")
        refs = batch.where("kind = 'reference'").select("key", "at", "rel_id", "side")
        self.store.put(number, parents, refs, ["rel_id", "side"])

    def start(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self.put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by tumbling window and type with a watermark for late ones, for dashboards of arrivals."""
    ts = F.col("ts").cast("timestamp")
    return events.withColumn("ts", ts).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
