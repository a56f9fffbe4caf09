"""Question-log annotation as a Structured Streaming job.

The reference answers one question at a time in an interactive loop; this is
the same annotation applied to a stream of question files. The annotation
(K1) is pure column expressions, so the batch operator runs unchanged on a
streaming DataFrame. Two sinks:

* ``start_annotation_sink``: every annotated user question, appended to Parquet
  (exactly-once through the checkpoint).
* ``start_volume_sink``: running question counts by metric x dimension x intent
  (K10). The state has one row per combination of a few fixed vocabularies,
  so it stays small however long the stream runs; each micro-batch rewrites
  the whole (small) table.

Checkpoints must be in a shared folder on a cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from revlens.operators import textlog

CONVERSATION_SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def question_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Annotated user questions from a folder of conversation Parquet files."""
    reader = spark.readStream.schema(CONVERSATION_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.parquet(source_dir)
    return textlog.annotate_questions(src.where(F.col("role") == "user").select("conv_id", "turn", "text"))


def start_annotation_sink(annotated: DataFrame, path: str, checkpoint: str,
                          available_now: bool = True) -> StreamingQuery:
    w = (annotated.writeStream.format("parquet").outputMode("append")
         .option("path", path).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def start_volume_sink(annotated: DataFrame, path: str, checkpoint: str,
                      available_now: bool = True) -> StreamingQuery:
    counts = (annotated.groupBy(F.coalesce(F.col("q_metric"), F.lit("(none)")).alias("Metric"),
                                F.coalesce(F.col("q_dimension"), F.lit("(none)")).alias("Dimension"),
                                F.col("q_intent_type").alias("Intent_Type"))
              .agg(F.count(F.lit(1)).alias("Questions")))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    w = (counts.writeStream.outputMode("complete").foreachBatch(write_batch)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
