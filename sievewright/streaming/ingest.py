"""Continuous ingest: new files of a folder into the engine's tables, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sievewright.config import SOURCE_TYPES
from sievewright.plans.engine import Engine
from sievewright.sources.ingest import FILES

_BINARY = "path string, modificationTime timestamp, length long, content binary"


def watch(engine: Engine, folder: str, checkpoint: str, rebuild: bool = True, max_files: int = 1000, once: bool = False) -> StreamingQuery:
    """Starts a stream that ingests files as they arrive.

    A batch that runs again after a failure adds nothing twice: files whose name
    and content are known are duplicates.  With ``once`` the stream takes what
    is there and ends.
    """
    pattern = "*.{" + ",".join(sorted(s[1:] for s in SOURCE_TYPES)) + "}"
    files = (
        engine.spark.readStream.format("binaryFile").schema(_BINARY).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(folder)
    )

    def add(batch: DataFrame, number: int) -> None:
        named = batch.selectExpr("element_at(split(path, '/'), -1) AS filename", "content", "path AS source_path")
        assert [f.split(" ")[0] for f in FILES.split(", ")] == named.columns
        engine.ingest(named, rebuild=rebuild)

    writer = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(add)
    return (writer.trigger(availableNow=True) if once else writer).start()
