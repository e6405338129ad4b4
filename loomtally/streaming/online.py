"""The online path over streams: stateless, as a document stays one row until its results are out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtally.plans import online

DOCUMENTS = "doc_id long, text string, ts timestamp"


def document_stream(spark: SparkSession, path: str, schema: str = DOCUMENTS, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of documents as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def results_stream(documents: DataFrame, options: online.Options = online.Options()) -> DataFrame:
    """Results of every arriving document."""
    return online.results(documents, options)


def verdicts_per_hour(documents: DataFrame, late: str = "1 hour", options: online.Options = online.Options()) -> DataFrame:
    """Verdict counts per hour of arrival, with a watermark for late documents."""
    keyed = documents.withColumn("doc_id", F.struct("doc_id", "ts"))
    res = online.results(keyed, options).select(F.col("doc_id.ts").alias("ts"), "verdict")
    return res.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "verdict").agg(F.count(F.lit(1)).alias("n"))


def write_results(stream: DataFrame, path: str, checkpoint: str):
    """Append results to a table, exactly once by the checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
