"""New PDF files of a folder, uploaded as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.plans.library import Library

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, library: Library, checkpoint: str) -> StreamingQuery:
    """Upload all files that are there and stop. The next call, with the same checkpoint, takes those that came since.

    A file that can't be uploaded is set aside as a row of library.rejected() and the others go on; it is tried again when it comes under
    another path; files of no bytes are no rows to Spark's reader. A file is uploaded or set aside once, by path: which file becomes which document is written before the documents are, so a batch that is
    tried again after a failure, wherever that was, skips the files whose documents are there, and those that are set aside.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        files = batch.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content")
        for done in (library.uploaded(), library.rejected()):
            files = files.join(done.select("path"), "path", "left_anti")
        found = library.judged(files)
        library.reject(found)
        good = found.where("fault is null")
        if good.limit(1).count():
            library.store(good)

    found = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", "*.pdf").load(folder)
    return found.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
