"""Session helpers: a local session for tests, and the shared work folder."""

import tempfile
import uuid
from collections import Counter
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

_LOCAL_FOLDERS = {}

#: Rows of a file of a stored table. URLs of a site are packed to a few bytes each, so
#: that tasks which are cut by bytes alone hold more rows the larger the table is.
ROWS_PER_FILE = 50_000

#: (folder, times a name was stored) of the round that is under way; see ``in_place``.
_ROUND = ContextVar("round", default=None)


def local_session(cores="8", app="sitewise"):
    """Session for tests and the local bench. Clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark, folder=None):
    """Folder for stream checkpoints and written intermediate tables.

    ``folder`` where given, else what the session names in ``spark.checkpoint.dir``.
    Only a local session without either, as in tests, gets a folder of its own.
    """
    named = folder or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("name a folder that all executors reach, or set spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = "file://" + tempfile.mkdtemp(prefix="sitewise-")
    return _LOCAL_FOLDERS[app]


@contextmanager
def in_place(folder):
    """A round of work whose stored tables take the place of those of the round before.

    Rounds in the same ``folder`` store the same names in the same order. What one has
    stored must not be read after the next has begun.
    """
    token = _ROUND.set((folder, Counter()))
    try:
        yield
    finally:
        _ROUND.reset(token)


def _table_path(spark, name):
    if (current := _ROUND.get()) is None:
        return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    folder, times = current
    times[name] += 1
    return f"{folder}/{name}-{times[name]}"


def stored(df, name):
    """``df`` written once to the shared folder and read back.

    Later phases plan from its files, and a lost executor costs a read. A file holds
    ``ROWS_PER_FILE`` rows at most: each counts with its opening cost, so a task reads
    about 30 of them, however well they are packed.
    """
    spark = df.sparkSession
    path = _table_path(spark, name)
    df.write.mode("overwrite").option("maxRecordsPerFile", ROWS_PER_FILE).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
