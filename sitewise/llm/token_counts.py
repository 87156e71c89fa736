"""Token counts: whole documents encoded once, tokens attributed by their spans."""

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sitewise.llm.common import ship

_ENCODINGS = {}


def encoding(path, pattern):
    """(tiktoken encoding, bytes per token id) of a file of ranks."""
    if (path, pattern) not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        own = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        _ENCODINGS[path, pattern] = own, sizes
    return _ENCODINGS[path, pattern]


def attribute(token_ends, section_ends, rule):
    """(tokens, shared tokens) per section of one document.

    ``token_ends`` and ``section_ends`` are rising byte offsets; sections follow
    one another from 0. ``start``: a token counts for the section of its first
    byte. ``majority``: for the section with most of its bytes, the first of
    equals. A token is shared by every section it touches if it touches several.
    """
    starts = np.concatenate([[0], token_ends[:-1]])
    first = np.searchsorted(section_ends, starts, "right")
    last = np.searchsorted(section_ends, token_ends - 1, "right")
    home = first.copy()
    across = np.flatnonzero(last > first)
    if rule == "majority":
        for t in across:
            edges = np.clip(section_ends[first[t] : last[t] + 1], starts[t], token_ends[t])
            home[t] = first[t] + int(np.argmax(np.diff(edges, prepend=starts[t])))
    touched = np.zeros(len(section_ends) + 1, np.int64)
    np.add.at(touched, first[across], 1)
    np.add.at(touched, last[across] + 1, -1)
    return np.bincount(home, minlength=len(section_ends)), np.cumsum(touched)[:-1]


COUNTS = pa.schema(
    [("doc_id", pa.int64())]
    + [("field", pa.string())]
    + [(n, pa.int64()) for n in ("section", "n_chars", "n_tokens", "n_shared", "doc_tokens")]
)


def token_counts(docs, ranks_path, pattern, fields=("text",), separator="\n", rule="start"):
    """Tokens per section of every document.

    docs: (doc_id, fields...). The fields of a row, each ended by ``separator``
    but the last, are encoded as one document, once. Sections are the runs of a
    field up to and with each separator; ``section`` counts them from 0 within
    the field. Token byte spans are interval-joined to the sections (a sorted
    search) and a token that crosses a boundary goes by ``rule`` ("start" or
    "majority", see ``attribute``), so the sections of a row add up to its
    ``doc_tokens``.

    A null field is empty; an empty document has one section of no tokens per
    field. Every row is counted alone, so repeated rows and null ids keep their
    own counts; an empty table gives no rows; other columns are ignored.
    """
    if rule not in ("start", "majority"):
        raise ValueError(f"unknown rule {rule!r}")
    ship(docs.sparkSession)

    def count(batches):
        own, sizes = encoding(ranks_path, pattern)
        for batch in batches:
            held, n = {name: [] for name in COUNTS.names}, 0
            for row in range(batch.num_rows):
                parts = [batch[f][row].as_py() or "" for f in fields]
                text = separator.join(parts)
                labels, chars, ends, at = [], [], [], 0
                for k, (field, part) in enumerate(zip(fields, parts)):
                    part += separator if k + 1 < len(fields) else ""
                    runs = part.split(separator)
                    runs = [r + separator for r in runs[:-1]] + runs[-1:]
                    runs = runs[:-1] if len(runs) > 1 and not runs[-1] else runs
                    for i, run in enumerate(runs):
                        at += len(run.encode("utf-8", "replace"))
                        labels.append((field, i))
                        chars.append(len(run))
                        ends.append(at)
                ids = own.encode_to_numpy(text)
                token_ends = np.cumsum(sizes[ids])
                if len(ids):
                    tokens, shared = attribute(token_ends, np.asarray(ends, np.int64), rule)
                else:
                    tokens = shared = np.zeros(len(ends), np.int64)
                held["doc_id"] += [batch["doc_id"][row].as_py()] * len(labels)
                held["field"] += [f for f, _ in labels]
                held["section"] += [i for _, i in labels]
                held["n_chars"] += chars
                held["n_tokens"] += tokens[: len(labels)].tolist()
                held["n_shared"] += shared[: len(labels)].tolist()
                held["doc_tokens"] += [len(ids)] * len(labels)
                n += len(labels)
                if n >= 20_000:
                    yield pa.RecordBatch.from_pydict(held, COUNTS)
                    held, n = {name: [] for name in COUNTS.names}, 0
            yield pa.RecordBatch.from_pydict(held, COUNTS)

    kinds = "doc_id long, field string, section long, n_chars long, n_tokens long, n_shared long, doc_tokens long"
    columns = [F.col("doc_id").cast("long")] + [F.col(f).cast("string") for f in fields]
    return docs.select(*columns).mapInArrow(count, kinds)
