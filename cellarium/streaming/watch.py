"""Watch a folder: new workbooks go through the batch plan, a micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.documents import flat_rows
from ..plans.extract import extract
from ..sources.workbook import facts


def watch(spark: SparkSession, path: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append the flat rows of new workbooks under ``path`` to Parquet at ``out``."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.[xX][lL][sS][xXmM]").load(path)

    def write(batch: DataFrame, number: int) -> None:
        flat_rows(extract(facts(batch).persist())).write.mode("overwrite").parquet(f"{out}/batch={number}")  # a repeated batch replaces itself

    q = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (q.trigger(availableNow=True) if once else q).start()
