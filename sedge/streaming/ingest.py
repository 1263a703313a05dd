"""Extension: documents that land in a folder are cleaned, chunked and upserted, each micro-batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sedge.operators.chunkers import ChunkConfig, hierarchical_chunks
from sedge.operators.clean import CleanConfig, clean

SCHEMA = "source string, text string"


def ingest(spark: SparkSession, landing: str, out: str, checkpoint: str, chunking: ChunkConfig = ChunkConfig(), cleaning: CleanConfig = CleanConfig()) -> StreamingQuery:
    """Watch landing (JSON lines of source and text). A batch's chunks go to out/batch=<n>, which a repeated batch
    overwrites; readers take, for each source, the chunks of its last batch (current_chunks)."""

    def write(batch: DataFrame, n: int) -> None:
        latest = batch.dropDuplicates(["source"])
        cleaned, _ = clean(latest, "source", "text", cleaning)
        hierarchical_chunks(cleaned, "source", "text", chunking).write.mode("overwrite").parquet(f"{out}/batch={n}")

    stream = spark.readStream.schema(SCHEMA).json(landing)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_chunks(spark: SparkSession, out: str) -> DataFrame:
    """The chunks of each source's last batch."""
    rows = spark.read.parquet(out)
    last = rows.groupBy("source").agg({"batch": "max"}).withColumnRenamed("max(batch)", "batch")
    return rows.join(last, ["source", "batch"], "left_semi")
