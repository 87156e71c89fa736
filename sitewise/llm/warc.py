"""WARC archives, index first: one compressed member per record, byte-range reads."""

import base64
import gzip
import hashlib
import re

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from sitewise.llm.common import shared_folder, ship

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def digest32(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id):
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def build_record(page_id, url, payload, digest, refers_to, revisit, date):
    """Bytes of one record. A revisit keeps the HTTP header, whose Content-Length
    is that of the payload it leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        safe = _CONTROL.sub(lambda c: f"%{ord(c[0]):02X}", url)
        head.insert(3, f"WARC-Target-URI: {safe}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data):
    """Fields of one record: type, page, digest, payload size and payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    page = lambda name: None if name not in fields else fields[name][10:-1]
    own, other = page("WARC-Record-ID"), page("WARC-Refers-To")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or digest32(payload) != fields["WARC-Payload-Digest"][5:]):
        raise ValueError(f"record of page {own} is damaged")
    return {
        "page_id": None if own == "none" else int(own),
        "payload_bytes": size,
        "payload_digest": fields["WARC-Payload-Digest"][5:],
        "record_type": fields["WARC-Type"],
        "refers_to": None if other in (None, "none") else int(other),
        "payload": None if revisit else payload,
    }


def record_roles(pages, min_revisit_bytes=0):
    """(page_id, digest) -> the page that holds the payload, or null.

    Narrow rows only: one per payload after the map-side maximum, so a payload
    that a third of all pages share costs one row per task.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n"))
    holders = (
        keyed.where(F.col("n") >= min_revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("holder"))
    )
    return keyed.select("page_id", "digest").distinct().join(holders, "digest", "left")


_INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"


def write_archives(pages, folder, min_revisit_bytes=0, date="2024-01-01T00:00:00Z"):
    """Write one archive per partition and the index; return the index.

    pages: (page_id, url, html). Of pages with equal payloads of at least
    ``min_revisit_bytes`` bytes the one with the largest id is the response and
    the others revisit it. Rows equal in id and payload are alike: all responses
    or all revisits. A null html is an empty payload, a null URL leaves its header
    out, pages without id never hold a payload for others. Files carry the task
    attempt in their name, so what a lost executor left half written is in no
    index. Records stream, so a task holds one batch of pages.
    """
    from pyarrow import fs

    spark = pages.sparkSession
    ship(spark)
    store, top = fs.FileSystem.from_uri(folder)
    store.create_dir(f"{top}/warc", recursive=True)
    roles = record_roles(pages, min_revisit_bytes).select(
        F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "holder"
    )
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    placed = rows.join(
        roles, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest"))
    ).select("page_id", "url", "html", "holder")

    def write(batches):
        store, top = fs.FileSystem.from_uri(folder)
        out, path, at = None, "", 0
        task = TaskContext.get()
        for batch in batches:
            index = []
            for page_id, url, html, holder in zip(*[batch[c] for c in ("page_id", "url", "html", "holder")]):
                page_id, url, holder = page_id.as_py(), url.as_py(), holder.as_py()
                payload = html.as_py().encode()
                revisit = holder is not None and holder != page_id
                digest = digest32(payload)
                data = gzip.compress(
                    build_record(page_id, url, payload, digest, holder, revisit, date), 6, mtime=0
                )
                if out is None:
                    path = f"{top}/warc/{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
                    out = store.open_output_stream(path, compression=None)
                out.write(data)
                index.append((path, at, len(data), url, digest, page_id, "revisit" if revisit else "response"))
                at += len(data)
            names = ["file", "offset", "length", "url", "digest", "page_id", "record_type"]
            columns = [pa.array([r[i] for r in index], pa.int64() if names[i] in ("offset", "length", "page_id") else pa.string()) for i in range(7)]
            yield pa.RecordBatch.from_arrays(columns, names)
        if out is not None:
            out.close()

    placed.mapInArrow(write, _INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(_INDEX).parquet(f"{folder}/index")


_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(index, folder, with_payload=False, chunk_bytes=4 << 20, gap=64 << 10, most=8 << 20, task_bytes=128 << 20):
    """The records of the selected index rows, checked against their digests.

    Selected rows are dealt by file and stretch of ``chunk_bytes`` and sorted by
    offset; ranges at most ``gap`` bytes apart become one read of at most ``most``
    bytes (or one longer record). The number of tasks follows from the bytes to read,
    not from the narrow index: one for ``task_bytes``, and below that one for each
    stretch until the cores are used. Repeated index rows are read once each; no rows,
    no reads.
    """
    from pyarrow import fs

    spark = index.sparkSession
    ship(spark)
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, total // task_bytes, min(total // chunk_bytes, 2 * spark.sparkContext.defaultParallelism))

    def read(frames):
        store, _ = fs.FileSystem.from_uri(folder)

        def taken(path, span):
            begin, end = span[0][0], max(o + n for o, n in span)
            with store.open_input_file(path) as data:
                data.seek(begin)
                held = data.read(end - begin)
            rows = [parse_record(gzip.decompress(held[o - begin : o - begin + n])) for o, n in span]
            out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
            out = out.astype({"page_id": "Int64", "refers_to": "Int64"})
            return out if with_payload else out.drop(columns="payload")

        path, span = None, []
        for frame in frames:
            for file, offset, length in zip(frame["file"], frame["offset"].tolist(), frame["length"].tolist()):
                end = span[-1][0] + span[-1][1] if span else 0
                if span and (file != path or offset > end + gap or offset + length - span[0][0] > most):
                    yield taken(path, span)
                    span = []
                path = file
                span.append((offset, length))
        if span:
            yield taken(path, span)

    stretch = (F.col("offset") / chunk_bytes).cast("long")
    return (
        index.select("file", "offset", "length", stretch.alias("stretch"))
        .repartition(tasks, "file", "stretch")
        .sortWithinPartitions("file", "offset")
        .drop("stretch")
        .mapInPandas(read, _RECORD + (", payload binary" if with_payload else ""))
    )


def archive_and_read(pages, folder=None):
    """Write ``pages`` to archives, then read every record back by the index.

    One row for each row of ``pages``: null and empty payloads, repeated rows and pages
    without id as ``write_archives`` says; no pages, no rows; other columns are ignored.
    A payload may be as long as a row can be: it is written, read and checked whole.
    """
    folder = folder or shared_folder(pages.sparkSession, "archives")
    return read_records(write_archives(pages, folder), folder)
