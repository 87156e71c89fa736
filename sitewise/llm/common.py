"""Small helpers shared by the operators: folders, tables, code shipping."""

import ctypes
import functools
import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

_LOCAL_FOLDERS = {}
_SHIPPED = set()

#: Blank characters between words: space and tab to carriage return.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark, folder, name):
    """One of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark, name):
    """A new folder that every executor reaches, below ``spark.checkpoint.dir``.

    Only a local session without the setting, as in tests, gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_FOLDERS:
            _LOCAL_FOLDERS[app] = "file://" + tempfile.mkdtemp(prefix="sitewise-llm-")
        base = _LOCAL_FOLDERS[app]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df, name):
    """``df`` written once to the shared folder and read back.

    Cuts the lineage: a lost executor costs a read, not the work before it.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark):
    """Make this package importable on the workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="sitewise-code-"), "sitewise_code.zip")
    with zipfile.ZipFile(target, "w") as out:
        for top, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(top, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def release():
    """Give memory that a task no longer needs back to the machine: workers are reused
    by later stages, which need it for themselves."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(*caches):
    """Wraps the work on a partition: after it the caches are emptied and the memory
    is released."""

    def wrapped(work):
        @functools.wraps(work)
        def run(batches):
            try:
                yield from work(batches)
            finally:
                for cache in caches:
                    cache.clear()
                release()

        return run

    return wrapped


def let(value, body):
    """``body(value)`` with ``value`` computed once, also inside lambdas of body."""
    return F.transform(F.array(value), body)[0]


def words_of(text):
    """Words of a text column (null: none), natively."""
    parts = F.split(F.coalesce(text, F.lit("")), BLANKS, -1)
    return F.array_remove(parts, "")
