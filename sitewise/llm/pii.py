"""Personal data: base patterns, and terms that disclose what they protect."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sitewise.llm.common import ship, tidy, written

KINDS = ("email", "ip", "card", "phone")

#: The base patterns. The local part of an e-mail is found backwards
#: from its sign, the others from the start of a run of digits.
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGES = ".,;:!?\"'()[]{}"
_NUMBER = re.compile(r"[0-9][0-9.,/-]*")
#: Characters that Arrow may lower otherwise than Python: all but the Latin ones.
_ODD = r"[^\x{0}-\x{12F}\x{131}-\x{24F}]"


def emails(text):
    spans, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            end = found.end()
            spans.append((start, end))
        else:
            end = max(end, at + 1)
        at = text.find("@", max(at + 1, end))
    return spans


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text):
    """(kind, start, end) of every base match: by kind as listed, then by start."""
    spans = [("email", *s) for s in emails(text)] if "@" in text else []
    if _DIGIT.search(text) is None:
        return spans
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            spans.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                spans.append(("phone", m.start(), m.end()))
    return spans


def normal(word):
    return word.strip(_EDGES).lower()


def _hash(text):
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def entity_key(kind, value):
    """The protected entity behind a span: e-mails in any case, numbers by digits."""
    plain = value.lower() if kind in ("email", "ip") else "".join(c for c in value if c.isdigit())
    return _hash(f"{kind}:{plain}")


#: Stands for every text.
_ANY = 0
_CACHED_WORDS = 1 << 16
#: One text in so many, by hash, tells early which terms stand all over the corpus.
_SIFT = 8


def class_key(kind):
    """The kind of an entity as a class, protected besides its values."""
    return _hash(f"class:{kind}")


class TermHashes(dict):
    """Hash of the term of each word, 0 for a word that is none; emptied when full."""

    def __missing__(self, word):
        if len(self) >= _CACHED_WORDS:
            self.clear()
        term = normal(word)
        value = self[word] = _hash(term) if len(term) > 1 else 0
        return value


def words_of_texts(texts):
    """(different words of an array of texts, number of each word, text of each word):
    split at blanks and at tab to carriage return, each different word kept once."""
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    number, owner = coded.indices.to_numpy(), np.repeat(np.arange(len(texts)), sizes)
    real = pc.binary_length(coded.dictionary).to_numpy() > 0
    kept = real[number]
    return coded.dictionary, number[kept], owner[kept]


def different_words(texts):
    """How many different words each text of an array has."""
    words, number, owner = words_of_texts(texts)
    pairs = owner * len(words) + number
    pairs.sort()
    new = np.r_[True, pairs[1:] != pairs[:-1]][: len(pairs)]
    return np.bincount(pairs[new] // max(1, len(words)), minlength=len(texts))


def term_hashes(words):
    """Hash of the term of each word of an array, 0 for a word that is none."""
    plain = pc.utf8_lower(pc.ascii_trim(words, characters=_EDGES)).dictionary_encode()
    terms = plain.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
    hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, terms)), ">u8") ^ np.uint64(1 << 63)
    hashes = hashes.astype(np.uint64).view(np.int64)
    hashes[pc.utf8_length(plain.dictionary).to_numpy() < 2] = 0
    hashes = hashes[plain.indices.to_numpy()]
    odd = pc.match_substring_regex(words, _ODD).to_numpy(zero_copy_only=False).astype(bool)
    own = TermHashes()
    hashes[odd] = [own[w] for w in words.filter(pa.array(odd)).to_pylist()]
    return hashes


def known_words(texts, known):
    """{place of a text: (hashes of the known terms in it, of all its words in order)}
    for the texts of an array that hold some; ``known`` tells of an array of hashes
    which it knows. A word that many texts hold is looked up once."""
    words, number, owner = words_of_texts(texts)
    hashes = term_hashes(words)
    hit = ((hashes != 0) & known(hashes))[number]
    terms, found = hashes[number], {}
    for i, term in zip(owner[hit].tolist(), terms[hit].tolist()):
        found.setdefault(i, set()).add(term)
    begin, end = np.searchsorted(owner, [*found]), np.searchsorted(owner, [*found], "right")
    return {i: (held, terms[a:b]) for (i, held), a, b in zip(found.items(), begin, end)}


def sliced(batch, text, most=8 << 20):
    """A batch in slices of about ``most`` bytes of text, or one longer text: the words
    of a slice are held at once."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def bare_words(text, spans):
    """The words of a text that no span touches."""
    if not spans:
        return _WORD.findall(text)
    words, at, reach, base = [], 0, -1, sorted((a, b) for _, a, b in spans)
    for m in _WORD.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            reach, at = max(reach, base[at][1]), at + 1
        if reach <= m.start():
            words.append(m[0])
    return words


def bare_terms(text, spans, hashes):
    """Hashes of the terms of the words that no span touches, in order."""
    words = bare_words(text, spans)
    return np.fromiter(map(hashes.__getitem__, words), np.int64, len(words))


def first_places(terms):
    """(terms, place of each): the different terms of a text, given in order, and the
    hash of the words beside the first time each stands there. Copies and most near
    copies of a text have the same places."""
    near = np.r_[np.int64(0), terms, np.int64(0)].view(np.uint64)
    places = near[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ (near[2:] + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    found, at = np.unique(terms, return_index=True)
    kept = found != 0
    return found[kept], places[at[kept]].view(np.int64)


def entities_of(text, spans):
    """Keys of the values and of the kinds in a text."""
    return {*(class_key(kind) for kind, _, _ in spans), *(entity_key(kind, text[a:b]) for kind, a, b in spans)}


_HOLDERS = "mark long, entities array<bigint>, terms array<bigint>, places array<bigint>"


@tidy()
def _holders(batches):
    """Texts that hold an entity: its entities, and the terms with their places; and
    without a mark, how many different words the texts of an entity hold (``_ANY``: all
    texts)."""
    hashes = TermHashes()
    for batch in (part for batch in batches for part in sliced(batch, 0)):
        rows, sizes = [], {}
        for text, n in zip(batch["text"], different_words(batch["text"]).tolist()):
            text = text.as_py() or ""
            spans = base_spans(text)
            entities = entities_of(text, spans)
            if entities:
                terms, places = first_places(bare_terms(text, spans, hashes))
                rows.append((_hash(text), [*entities], terms, places))
            for entity in (_ANY, *entities):
                sizes[entity] = sizes.get(entity, 0) + n
        rows.append((None, [*sizes], [*sizes.values()], None))
        kinds = [pa.int64()] + [pa.list_(pa.int64())] * 3
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["mark", "entities", "terms", "places"])


def _columns(parts, names):
    joined = [np.concatenate(c) if c else np.empty(0, np.int64) for c in (zip(*parts) if parts else [()] * len(names))]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in joined], names)


def _marked(texts, terms, at, columns):
    """Rows ``columns(text, terms of it, all its terms)`` of the texts that hold some of ``terms``; a
    bitmap rules most others out beforehand."""
    marks = _marks(terms)

    def marked(hashes):
        held = np.frombuffer(marks, np.uint8)
        place = hashes % (8 * len(held))
        return held[place >> 3] & (128 >> (place & 7)) != 0

    @tidy()
    def wanted(batches):
        for batch in (part for batch in batches for part in sliced(batch, 0)):
            found = known_words(batch["text"], marked)
            yield _columns([columns(batch["text"][i].as_py(), *held) for i, held in found.items()], [at, "term"])

    return texts.mapInArrow(wanted, f"{at} long, term long").distinct().join(terms, "term")


def _places_of(hashes):
    return lambda text, wanted, terms: _beside(text, wanted, terms, hashes)


def _beside(text, wanted, terms, hashes):
    spans = base_spans(text)
    terms, places = first_places(bare_terms(text, spans, hashes) if spans else terms)
    kept = np.isin(terms, [*wanted])
    return places[kept], terms[kept]


def revealing_terms(docs, disclosure=0.5, prior=2.0):
    """(entity, term, disclosure) of the terms that give a protected entity away;
    ``term`` is the 64-bit hash of a term.

    An entity is a value (an e-mail address, a number) or the kind of one as a
    class. A term and an entity are seen together in a place: the words beside the
    first time the term stands in a text that holds the entity. Copies share it, so
    however often a text was copied it counts once. The disclosure is the share of the
    places of a term whose text holds the entity, smoothed by ``prior`` places at the
    rate of chance; at 0.5 and 2 a term seen in one place discloses nothing, whatever
    the size of the corpus: each place has to be foretold by others. The rate of
    chance is the share of the different words of all texts that stand in texts with
    the entity, so long texts, which hold many rare words, count for more.

    The link must also be beyond chance: the likelihood of so many shared places at
    that rate, by Chernoff's bound, times the number of pairs of term and entity in
    the corpus, must be below 1. A larger corpus has more pairs and asks for more.

    Only values of two texts or more and kinds can have such a term. Those that
    pass where nothing but these texts is looked at are counted in an eighth of all
    texts, and where that shows too many places already they are dropped; the others
    are counted in all texts.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col("text").cast("string").alias("text"))
    seen = written(texts.mapInArrow(_holders, _HOLDERS), "holders")
    counted = seen.where("mark is null").select(F.explode(F.arrays_zip("entities", "terms")).alias("x"))
    sizes = counted.groupBy(F.col("x.entities").alias("entity")).agg(F.sum("x.terms").alias("size"))
    sizes = written(sizes, "sizes")
    total = float(sizes.where(F.col("entity") == _ANY).agg(F.max("size")).first()[0] or 1)
    held = seen.where("mark is not null").withColumn("entity", F.explode("entities"))
    # a text is counted once for a value, whatever its copies
    of = held.groupBy("entity").agg(F.min("mark").alias("one"), F.max("mark").alias("other"), F.max(F.size("terms")).alias("most"))
    of = written(of, "values")
    single = of.where("one = other").agg(F.sum("most")).first()[0] or 0
    kinds = F.col("entity").isin([class_key(kind) for kind in KINDS])
    several = of.where("one <> other").select("entity").join(sizes, "entity")
    # the few kinds hold most pairs: their sizes travel to them, values are joined
    held = held.select("entity", "terms", "places")
    held = held.where(~kinds).join(several, "entity").unionByName(held.where(kinds).join(F.broadcast(several.where(kinds)), "entity"))
    pairs = held.select("entity", "size", F.explode(F.arrays_zip("terms", "places")).alias("x"))
    pairs = pairs.groupBy("entity", F.col("x.terms").alias("term"))
    pairs = written(pairs.agg(F.count_distinct("x.places").alias("together"), F.max("size").alias("size")), "pairs")
    tests = float(np.log(max(2, single + pairs.count())))

    def judged(rows, places):
        """``rows`` with their disclosure, given that many places of the term."""
        rate = F.least(F.greatest(F.col("size") / total, F.lit(1e-12)), F.lit(0.999))
        n, k = places.cast("double"), F.col("together").cast("double")
        apart = F.when(n > k, (n - k) * F.log((n - k) / (n * (1 - rate)))).otherwise(F.lit(0.0))
        beyond = (k / n > rate) & (k * F.log(k / (n * rate)) + apart > tests)
        return rows.withColumn("disclosure", (k + prior * rate) / (n + prior)).where(beyond & (F.col("disclosure") >= disclosure))

    # both bounds fall as the places of a term rise, so each step drops for good
    pairs = judged(pairs, F.col("together"))
    for name, part in (("sifted", texts.where(F.pmod(F.xxhash64("text"), F.lit(_SIFT)) == 0)), ("revealing", texts)):
        terms = written(pairs.select("term").distinct(), "terms")
        places = _marked(part, terms, "place", _places_of(TermHashes())).groupBy("term").agg(F.count("*").alias("places"))
        both = pairs.drop("disclosure").join(places, "term", "left")
        found = judged(both, F.greatest("together", F.coalesce("places", F.lit(0)))).drop("places")
        pairs = written(found, name)
    return pairs.select("entity", "term", "disclosure")


def sanitise(text, spans, revealing, hashes):
    """(all spans, sanitised text). ``revealing`` are hashes of terms and ``hashes``
    those of words. Base matches become their kind, a disclosing
    number is generalised to <number>, any other disclosing term is removed."""
    base = sorted(spans, key=lambda s: s[1])
    terms = []
    if revealing:
        at, reach = 0, -1
        for m in _WORD.finditer(text):
            while at < len(base) and base[at][1] < m.end():
                reach, at = max(reach, base[at][2]), at + 1
            if reach <= m.start() and hashes[m[0]] in revealing:
                lead = len(m[0]) - len(m[0].lstrip(_EDGES))
                start = m.start() + lead
                terms.append(("term", start, start + len(m[0].strip(_EDGES))))
    out, end = [], 0
    for kind, a, b in sorted(base + terms, key=lambda s: (s[1], -s[2])):
        if b <= end:
            continue
        out.append(text[end : max(a, end)])
        if kind != "term":
            out.append(f"<{kind}>")
        elif _NUMBER.fullmatch(text, a, b):
            out.append("<number>")
        end = b
    out.append(text[end:])
    return [*spans, *terms], "".join(out) if base or terms else text


def _joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


RESULT = StructType(
    [StructField(f"n_{k}", LongType()) for k in KINDS]
    + [StructField(n, StringType()) for n in ("base_sha256", "spans", "clean_text")]
)


def _apply(names, terms):
    at = names.index("text")

    @tidy()
    def apply(batches):
        hashes, held = TermHashes(), np.array([*(terms or ())], np.int64)
        for batch in (part for batch in batches for part in sliced(batch, at)):
            rows = []
            found = known_words(batch.column(at), lambda x: np.isin(x, held)) if len(held) else {}
            for i, text in enumerate(batch.column(at)):
                text = text.as_py() or ""
                base = base_spans(text)
                if terms is None:
                    revealing = set(batch.column(len(names))[i].as_py() or ())
                else:
                    revealing = found[i][0] if i in found else ()
                spans, clean = sanitise(text, base, revealing, hashes)
                count = [sum(s[0] == k for s in base) for k in KINDS]
                digest = hashlib.sha256(_joined(base).encode()).hexdigest()
                rows.append((*count, digest, _joined(spans), clean))
            types = [pa.int64()] * 4 + [pa.string()] * 3
            new = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *new], [*names, *RESULT.names])

    return apply


def find_pii(docs, revealing=None, broadcast_rows=100_000):
    """``docs`` with counts, spans and ``clean_text``, one row per row.

    Adds n_email, n_ip, n_card, n_phone, base_sha256, spans and clean_text;
    columns of these names, ``_mark`` and ``_terms`` are replaced. ``revealing`` is the result of
    ``revealing_terms``, computed from ``docs`` where it is None. A term is a span
    in every text that holds it, with its entity or without. The terms travel to the
    tasks only up to ``broadcast_rows`` of them; beyond that they are joined.

    Null texts are empty; empty texts have no spans; repeated rows and null ids
    are judged alike; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop(*RESULT.names, "_mark", "_terms")
    if revealing is None:
        revealing = revealing_terms(docs)
    names = docs.columns
    schema = StructType([*docs.schema.fields, *RESULT.fields])
    terms = revealing.select("term").distinct()
    if terms.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return docs.mapInArrow(_apply(names, {r.term for r in terms.collect()}), schema)
    return _join_terms(docs, terms).mapInArrow(_apply(names, None), schema)


def _marks(terms, bits=1 << 26, chunk=1 << 16):
    """A bitmap of fixed size that holds the hash of every term."""

    def places(batches):
        for batch in batches:
            found = [t % bits for t in batch["term"].to_pylist()]
            columns = [pa.array([p // chunk for p in found], pa.int64()), pa.array([p % chunk for p in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["chunk", "at"])

    def packed(table):
        held = np.zeros(chunk, np.uint8)
        held[table["at"].to_numpy()] = 1
        return pa.table({"chunk": table["chunk"].slice(0, 1), "bits": pa.array([np.packbits(held).tobytes()], pa.binary())})

    out = bytearray(bits // 8)
    found = terms.mapInArrow(places, "chunk long, at long").distinct().groupBy("chunk").applyInArrow(packed, "chunk long, bits binary")
    for row in found.toLocalIterator():
        out[row.chunk * (chunk // 8) : (row.chunk + 1) * (chunk // 8)] = row.bits
    return bytes(out)


def _held(text, wanted, _):
    terms = np.array([*wanted], np.int64)
    return np.full(len(terms), _hash(text)), terms


def _join_terms(docs, terms):
    """``docs`` with the disclosing terms of the row, for any number of terms: the
    words of the texts are joined by term and gathered by text."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    found = _marked(texts, terms, "mark", _held).groupBy(F.col("mark").alias("_mark")).agg(F.collect_set("term").alias("_terms"))
    names = docs.columns

    def keyed(batches):
        for batch in batches:
            ids = [_hash(t.as_py() or "") for t in batch.column(names.index("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.int64())], [*names, "_mark"])

    kinds = StructType([*docs.schema.fields, StructField("_mark", LongType())])
    return docs.mapInArrow(keyed, kinds).join(found, "_mark", "left").select(*[docs_column(n) for n in names], "_terms")


def docs_column(name):
    return F.col(f"`{name}`")
