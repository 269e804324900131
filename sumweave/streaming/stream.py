"""Query lines as a stream of text files; answers are appended by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine


def answer_stream(engine: Engine, source: str, sink: str, checkpoint: str, available_now: bool = True, files: int = 100) -> StreamingQuery:
    """Reads query lines from text files that appear in source, and writes (batch, ordinal, query, line) as Parquet to sink.
    The lines of a micro-batch, which has so many files at most, come to the driver; `F` lines end nothing
    here and are passed over. A micro-batch that is repeated after a failure overwrites its own folder."""
    lines = engine.catalog.spark.readStream.option("maxFilesPerTrigger", files).text(source)

    def answer(batch: DataFrame, number: int) -> None:
        queries = [q for q in (r["value"].strip() for r in batch.collect()) if q and q != "F"]
        if queries:
            engine.batch_frame(queries).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = lines.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
