"""Starting streams and waiting for the available input."""

import uuid

from sitewise.session import shared_dir


def work_paths(spark, name, folder=None):
    """(output, checkpoint) folders for one run, under the shared folder."""
    root = f"{shared_dir(spark, folder).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    return f"{root}/out", f"{root}/checkpoint"


def table_stream(spark, folder, name, schema, max_files=8):
    """One table of a folder as a stream; ``max_files`` bounds each micro-batch."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", f"{name}.parquet")
        .option("maxFilesPerTrigger", max_files)
        .parquet(folder)
    )


def drain(stream, path, checkpoint):
    """Append everything available to a parquet folder and return when done."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    return path
