"""Term counts as a stream: the batch plan, run by Structured Streaming over files as they come."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.counts import term_counts
from ..session import shared_dir


def stream_term_counts(spark: SparkSession, path: str, schema: T.StructType, text: str = "text", fmt: str = "parquet") -> DataFrame:
    """(term, cnt) after all files that match ``path`` have been read as a stream.

    The state is the counts; each trigger replaces the result table, so a restart from its checkpoint repeats nothing.
    """
    place = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = spark.readStream.format(fmt).schema(schema).load(path)

    def replace(df: DataFrame, _: int) -> None:
        df.write.mode("overwrite").parquet(f"{place}/result")

    query = term_counts(rows, text).writeStream.outputMode("complete").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(replace).start()
    query.awaitTermination()
    return spark.read.schema("term string, cnt long").parquet(f"{place}/result")
