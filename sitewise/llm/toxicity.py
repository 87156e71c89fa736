"""Toxicity: two zstandard dictionaries and the lengths of windows under each."""

import random
import re
import sys
from functools import lru_cache
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sitewise.llm.common import ship, tidy

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGES = ".,;:!?\"'()"
#: Bytes that no text holds as a run. Both dictionaries end with them and every
#: window does, so a window always compresses and its length tells what its word
#: costs, to the byte. Fixed value.
_ANCHOR = b" " + bytes([*range(1, 9), *range(14, 32)])
_LEVEL = 15
_CACHED_WORDS = 300_000
#: Bins of a window: word length up to 12, gain between -4 and 10 bytes.
_LONGEST, _LEAST, _MOST = 12, -4, 10


def window(word):
    return b" " + word.lower().strip(_EDGES).encode("utf-8", "replace") + _ANCHOR


def _trained(samples, size, segment):
    """Dictionary content for the samples; their own end where they are too few."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, level=3, d=6, k=segment).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def _compressor(content):
    import zstandard

    plain = zstandard.ZstdCompressionParameters.from_level(
        _LEVEL,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        write_content_size=0,
        write_checksum=0,
        write_dict_id=0,
        min_match=3,
        window_log=18,
    )
    own = zstandard.ZstdCompressionDict(content + _ANCHOR, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=own, compression_params=plain)


def _lengths(compressor, windows):
    return np.array([len(compressor.compress(w)) for w in windows], np.int64)


@dataclass
class Model:
    """Two dictionaries, a weight per (word length, gain) and the calibration."""

    ordinary: bytes = b""
    toxic: bytes = b""
    weights: dict = field(default_factory=dict)
    calibration: tuple = (0.0, 0.0, 0.0, 0.0, 0.0)
    _made: tuple = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_made": None}

    def weight(self, word):
        """Evidence for toxic text in one window, 0 where it tells nothing."""
        if self._made is None:
            self._made = _compressor(self.ordinary), _compressor(self.toxic), {}
        ordinary, toxic, seen = self._made
        value = seen.get(word)
        if value is None:
            data = window(word)
            gain = len(ordinary.compress(data)) - len(toxic.compress(data))
            value = self.weights.get(_bin(data, gain), 0.0)
            if len(seen) > _CACHED_WORDS:
                seen.clear()
            seen[word] = value
        return value

    def evidence(self, text):
        """(evidence, windows) of a whole text."""
        words = _WORD.findall(text)
        return float(sum(map(self.weight, words))), len(words)

    def score(self, evidence, windows):
        z = features(np.array([evidence]), np.array([windows])) @ np.array(self.calibration)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30)))[0])


def _bin(data, gain):
    return min(len(data) - len(_ANCHOR), _LONGEST), max(_LEAST, min(_MOST, gain))


def features(evidence, windows):
    size, sum_ = np.log1p(windows), np.log1p(evidence)
    density = evidence / np.sqrt(windows + 1.0)
    return np.stack([np.ones(len(size)), sum_, size, density, sum_ * size], axis=1)


def fit_logistic(x, y, ridge=1e-2, rounds=60):
    """Weights of a logistic regression by Newton steps, lightly shrunk."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    x, w = x / scale, np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= np.clip(step, -5, 5)
    return tuple(w / scale)


def fit_dictionaries(toxic_words, ordinary_words, size=64 << 10, extra=3 << 10, rounds=9, last=4, keep=25, seed=7):
    """A model without calibration from word lists of toxic and ordinary texts.

    Both dictionaries begin with content trained on ordinary words. The ordinary
    one ends with more of it, the toxic one with content trained on toxic texts.
    Most words of a toxic text are ordinary, so that content is refined: the lists
    are halved, a dictionary trained on one half is judged on the other, and the
    ``1/keep`` of its windows with the largest gain train the next one. Words
    that help only the text they came from gain nothing in the other half. The
    toxic content is that of the ``last`` rounds: what one of them left out, as
    training may, another holds.
    """
    draw = random.Random(seed)
    group = lambda words: [b"".join(words[i : i + 12]) for i in range(0, len(words), 12)]
    bare = lambda data: data[: 1 - len(_ANCHOR)]
    made, cut = lru_cache(None)(window), lru_cache(None)(lambda w: bare(window(w)))
    halves = [[made(w) for words in toxic_words[h::2] for w in words] for h in (0, 1)]
    ordinary = [cut(w) for words in ordinary_words for w in words]
    del made, cut
    for words in (*halves, ordinary):
        draw.shuffle(words)
    base = _trained(group(ordinary[: len(ordinary) * 3 // 4]), size, 64)
    more = last * extra
    plain = base + _trained(group(ordinary[: len(ordinary) // 4]), more, 16)[-more:]
    known = _compressor(plain)
    lengths = [_lengths(known, half) for half in halves]
    samples, other, contents = [bare(w) for w in halves[0]], 1, []
    for turn in range(rounds):
        contents.append(_trained(group(samples), max(extra, size // 2 >> turn), 16))
        gains = lengths[other] - _lengths(_compressor(base + contents[-1]), halves[other])
        best = np.argsort(-gains, kind="stable")[: max(1, len(gains) // keep)]
        samples, other = [bare(halves[other][i]) for i in best], 1 - other
    contents.append(_trained(group(samples), extra, 16))
    return Model(ordinary=plain, toxic=base + b"".join(c[-extra:] for c in contents[-last:]))


def fit_weights(model, toxic_words, ordinary_words, least=1.0):
    """Log-likelihood ratio per bin; those below ``least`` tell nothing."""
    counts = []
    pair = _compressor(model.ordinary), _compressor(model.toxic)
    for lists in (toxic_words, ordinary_words):
        count = {}
        for data in (window(w) for words in lists for w in words):
            key = _bin(data, len(pair[0].compress(data)) - len(pair[1].compress(data)))
            count[key] = count.get(key, 0) + 1
        counts.append((count, sum(count.values()) + 1))
    (t, nt), (o, no) = counts
    ratio = {k: float(np.log((t.get(k, 0) + 0.5) / nt * no / (o.get(k, 0) + 0.5))) for k in {*t, *o}}
    return {k: v for k, v in ratio.items() if v > least and k[1] > 0}


def _sampled_words(most):
    """Distinct words of a text; of more than ``most`` an even spread of them."""

    def sample(batches):
        for batch in batches:
            words = []
            for text in batch["text"]:
                own = sorted({*_WORD.findall(text.as_py() or "")})
                words.append(" ".join(own[:: -(-len(own) // most)] if own else []))
            yield pa.RecordBatch.from_arrays([batch["_toxic"], pa.array(words, pa.string())], ["toxic", "words"])

    return sample


def _evidence(model):
    def measure(batches):
        for batch in batches:
            found = [model.evidence(text.as_py() or "") for text in batch["text"]]
            yield pa.RecordBatch.from_arrays(
                [batch["_toxic"], pa.array([e for e, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64())],
                ["toxic", "evidence", "windows"],
            )

    return measure


def train(docs, labels, held_out=2, folds=4, most_toxic=1500, most_ordinary=3000, most_words=1000, most_judged=4000):
    """A model from a bounded sample of the labelled rows outside the held-out fold.

    Ids are drawn by hash: at most ``most_toxic`` and ``most_ordinary`` for the
    dictionaries, with at most ``most_words`` distinct words of each text, and at
    most ``most_judged`` others of either class, read whole, for the calibration.
    Only these bounded rows reach the driver. Null ids or labels are no labels; of
    different labels for an id the highest holds. With no labels or no labelled texts
    of one class every score is one and the same.
    """
    spark = docs.sparkSession
    ship(spark)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold != held_out))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("_toxic"))
        .withColumn("_order", F.xxhash64("doc_id"))
    )
    share = known.groupBy("_toxic").count().collect()
    ids = []
    for toxic, most in ((1, most_toxic), (0, most_ordinary)):
        drawn = known.where(F.col("_toxic") == toxic).orderBy("_order", "doc_id").limit(most + most_judged)
        rows = [r.doc_id for r in drawn.select("doc_id").collect()]
        # few rows: two thirds for the dictionaries
        cut = min(most, max(len(rows) * 2 // 3, len(rows) - most_judged))
        ids += [(doc_id, toxic, int(i >= cut)) for i, doc_id in enumerate(rows)]
    count = {r["_toxic"]: r["count"] for r in share}
    constant = lambda p: Model(calibration=(float(np.log(p / (1 - p))), 0.0, 0.0, 0.0, 0.0))
    if not count.get(1) or not count.get(0):
        return constant(0.99 if count.get(1) else 0.01)
    drawn = spark.createDataFrame(ids, "doc_id long, _toxic int, _fold int")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(drawn), "doc_id")
    rows = (
        texts.where("_fold = 0").dropDuplicates(["doc_id"])
        .mapInArrow(_sampled_words(most_words), "toxic int, words string")
        .collect()
    )
    rows = sorted((r.toxic, r.words) for r in rows if r.words)
    # a word that many texts hold is kept once
    lists = [[[*map(sys.intern, words.split(" "))] for toxic, words in rows if toxic == t] for t in (1, 0)]
    model = fit_dictionaries(*lists)
    model.weights = fit_weights(model, *lists)
    judged = texts.where("_fold = 1").mapInArrow(
        _evidence(model), "toxic int, evidence double, windows long"
    ).toPandas()
    if judged["toxic"].nunique() < 2:
        judged = texts.mapInArrow(_evidence(model), "toxic int, evidence double, windows long").toPandas()
    if judged["toxic"].nunique() < 2:
        return constant(0.99 if judged["toxic"].any() else 0.01)
    y = judged["toxic"].to_numpy(float)
    weights = fit_logistic(features(judged["evidence"].to_numpy(float), judged["windows"].to_numpy(float)), y)
    # the sample holds more toxic rows than the table: move the prior back
    shift = np.log(count[1] / count[0]) - np.log(y.sum() / (len(y) - y.sum()))
    model.calibration = (weights[0] + float(shift), *weights[1:])
    return model


def score_toxicity(docs, model, held_out=2, folds=4, threshold=0.3):
    """``docs`` with ``held_out``, ``score`` and ``predicted``, one row per row.

    Every window (one word) of the whole text is compressed under both
    dictionaries; the score is a calibrated function of the summed evidence and the
    number of windows. Null and empty texts have no windows and score like a text
    that tells nothing. Repeated rows, null ids and ties score alike; an empty
    table gives an empty result; columns of the three new names are replaced.
    """
    ship(docs.sparkSession)
    new = ("held_out", "score", "predicted")
    kept = docs.drop(*new)
    names = kept.columns
    at = names.index("text")

    @tidy()
    def judge(batches):
        for batch in batches:
            scores = [model.score(*model.evidence(text.as_py() or "")) for text in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*names, "score"])

    schema = StructType([*kept.schema.fields, StructField("score", DoubleType())])
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    return kept.mapInArrow(judge, schema).select(
        "*",
        F.coalesce(fold == held_out, F.lit(False)).alias("held_out"),
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
