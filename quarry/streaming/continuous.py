"""The same queries over a corpus that grows: Structured Streaming.

A query is a projection and a filter of each file by itself, so it runs unchanged on micro-batches, without state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.engine import Options, Search
from quarry.sources.files import Corpus


def stream_table(spark: SparkSession, path: str, schema, adapt: Callable[[DataFrame], Corpus], files_per_trigger: int | None = None, form: str = "parquet") -> Corpus:
    """A directory of table files, read as they arrive; ``adapt`` makes a corpus of it."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return adapt(reader.format(form).load(path))


def continuous(spark: SparkSession, corpus: Corpus, text: str, options: Options | None = None) -> DataFrame:
    """The streaming results of a query."""
    return Search(spark, corpus, text, options).results


def hotspots(files: DataFrame, watermark: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Files by first directory and window of their modification times; late files beyond the watermark are left out."""
    first = F.substring_index("root_relative_path", "/", 1)
    return files.withWatermark("modified_at", watermark).groupBy(F.window("modified_at", window), first.alias("path")).agg(F.count("*").alias("candidate_files"))


def start(results: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch goes to ``sink`` once its number is known, which lets it write exactly once."""
    return results.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
